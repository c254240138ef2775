import random

import xxhash
from pyspark.sql import functions as F

from lodevec.llm import simhash as S
from lodevec.llm.queries import op5_simhash


def slow_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(prints, distance=3):
    """Least id of each row's component, by comparing all pairs."""
    keys = sorted(set(prints.values()))
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(a ^ b).count("1") <= distance and find(a) != find(b):
                root[find(a)] = find(b)
    least = {}
    for doc, k in sorted(prints.items()):
        least.setdefault(find(k), doc)
    return {doc: least[find(k)] for doc, k in prints.items()}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_against_bit_counting():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Aa", "b", "É", "dd\tx", "c\n"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    assert [S.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    assert S.fingerprint("") == 0 and S.fingerprint(" \t\n") == 0


def test_links_are_all_pairs_in_reach(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(8)} | {0, 1, 7, 15, (1 << 64) - 1}
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for distance in (1, 3, 7):
        rows = [(r.a, r.b) for r in S.links(nodes.union(nodes), distance).collect()]
        found = set(rows)
        assert len(found) == len(rows)
        slow = {(signed(a), signed(b)) for a in values for b in values if signed(a) < signed(b) and bin(a ^ b).count("1") <= distance}
        assert found == slow


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (300, 7)]
    found = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0} and found[300] == 0
    assert {found[100 + i] for i in range(40)} == {100} and {found[200 + i] for i in range(3)} == {200}
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hostile_rows(docs, no_docs):
    rows = S.near_duplicates(docs).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert len(rows) == docs.count() and of[1] == of[4] == {1} and of[2] == of[3] == {2} and of[8] == {8} and of[None] == {None}
    assert S.near_duplicates(no_docs).count() == 0
    assert S.fingerprints(docs).count() == docs.count() and S.fingerprints(no_docs).count() == 0
    assert S.links(S.fingerprints(no_docs)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    slow = slow_components(prints)
    rows = op5_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", slow[i]) for i in texts}


def test_plan_joins_on_a_key(spark):
    nodes = spark.range(100).select(F.xxhash64("id").alias("fp"))
    plan = S.links(nodes)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
