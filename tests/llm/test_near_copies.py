import random

import numpy as np

import corpus_pipeline as C
from lodevec.llm import near_copies as N
from lodevec.llm import simhash as S


def slow_set(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def slow_kept(texts):
    """Least id of each component, by the Jaccard similarity of all pairs."""
    ids, sets = sorted(texts), {i: slow_set(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if not all_ or 5 * both >= 4 * all_:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {find(i) for i in ids}


def test_stage_finds_all_near_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in C.drop_near_copies(spark, docs, sf_dir).collect()) == sorted(slow_kept(texts))


def test_random_edits_against_all_pairs(spark):
    rng = random.Random(4)
    texts, passage = {}, [f"shared{i}" for i in range(40)]
    for group in range(12):
        base = [f"g{group}w{rng.randint(0, 500)}" for _ in range(rng.randint(3, 120))] + passage * (group % 2)
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            texts[len(texts)] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in N.keep_one(frame).collect()) == sorted(slow_kept(texts))


def test_repeated_ids_keep_a_row_of_each_component(spark):
    other = " ".join(f"word{i}" for i in range(50))
    rows = [(3, other), (5, "a text of its own, unlike all others"), (5, other), (None, other), (None, "no id but one more text"), (None, None), (7, " ")]
    frame = spark.createDataFrame(rows + [(9, "twice the very same row")] * 2, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in N.keep_one(frame).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[1], rows[4], rows[6], (9, "twice the very same row")], key=str)


def test_wide_fingerprints_tell_near_copies_from_shared_passages():
    rng = np.random.default_rng(8)
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(S.widened(a, N.WIDE), S.widened(b, N.WIDE), strict=True))
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    most, least = 0, 256
    for size in (4, 5, 8, 9, 18, 45, 90, 450):
        for _ in range(60):
            base = draw(size)
            lost = size // 9  # |both| = 8/9 of each of two sets of one size is 0.8
            most = max(most, far(base, np.concatenate((base[lost:], draw(lost)))), far(base, np.concatenate((base, draw(size // 4)))))
            if size >= 45:
                least = min(least, far(np.concatenate((base, draw(5 * size))), np.concatenate((base, draw(5 * size)))))
    assert most <= N.WIDE_DISTANCE - 8 and least > N.WIDE_DISTANCE - 8


def test_documents_with_one_passage_make_few_pairs(spark):
    """A passage in many documents that share no more: no two of them are compared."""
    rng = random.Random(2)
    passage = " ".join(f"passage{i}" for i in range(60))
    texts = {i: " ".join(f"d{i}w{rng.randint(0, 10**6)}" for _ in range(120)) + " " + passage for i in range(120)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = []
    keep = N.confirmed
    N.confirmed = lambda pairs, *more: made.append(pairs.count()) or keep(pairs, *more)
    try:
        assert N.keep_one(frame).count() == 120
    finally:
        N.confirmed = keep
    assert made[1] <= 5


def test_columns_named_like_ours(spark):
    names = ["__id", "node", "hash", "chosen_id", "Chosen_Hash", "size", "fp", "prefix", "body", "root", "id", "least"]
    rows = [(1, "one text", *names), (1, "another text altogether", *names), (2, "one text", *names), (2, "one text", *names)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = N.keep_one(frame)
    assert kept.columns == frame.columns and sorted((r[0], r[1]) for r in kept.collect()) == [(1, "another text altogether"), (1, "one text")]


def test_fingerprint_links_alone_miss_pairs(spark, sf_dir):
    """Why the prefix filter completes the fingerprints: some pairs at 0.8 differ in more than three bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: slow_set(t) for i, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    bits = [bin(S.fingerprint(texts[a] or "", 5) ^ S.fingerprint(texts[b] or "", 5)).count("1") for a, b in pairs]
    assert bits and max(bits) > 3


def test_hostile_rows(docs, no_docs):
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "6", "7", "8", "9", "None"]
    assert N.keep_one(no_docs).count() == 0


def test_texts_go_to_workers_in_small_batches(spark):
    """Batches of ten thousand rows with two texts each took tens of megabytes in the JVM and in each worker."""
    name, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, keep = spark.conf.get(name), N.settle
    N.settle = lambda frame, label: sizes.append((label, int(spark.conf.get(name)))) or keep(frame, label)
    try:
        frame = spark.createDataFrame([(i, f"one text of {i % 3} words or more and more") for i in range(9)], "doc_id long, text string")
        assert N.keep_one(frame).count() == 3
    finally:
        N.settle = keep
    texts = [size for label, size in sizes if label in ("nodes", "confirmed")]
    assert len(texts) == 3 and max(texts) == N.BATCH_ROWS and spark.conf.get(name) == before


def siblings(base, changed, copies, rng):
    """Copies of a text of which each has its own words at places of its own."""
    for c in range(copies):
        words = list(base)
        for at in rng.sample(range(len(words)), changed):
            words[at] = f"new{c}at{at}"
        yield " ".join(words)


def counted(name, monkeypatch):
    """How many rows a function of the module gives or gets, call by call."""
    made, keep = [], getattr(N, name)

    def count(frame, *more):
        if name == "confirmed":
            made.append(frame.distinct().count())
            return keep(frame, *more)
        out = keep(frame, *more)
        made.append(out.count())
        return out

    monkeypatch.setattr(N, name, count)
    return made


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Siblings around 0.8 are one component after a few links each; pairs grew with the square of the group."""
    rng = random.Random(6)
    base = [f"word{i}" for i in range(400)]
    texts = dict(enumerate(t for changed in (4, 5, 6) for t in siblings(base, changed, 60, rng)))
    made = counted("confirmed", monkeypatch)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in N.keep_one(frame).collect()) == sorted(slow_kept(texts))
    assert sum(made) < 0.3 * 180 * 179 / 2


def test_a_pair_leaves_the_join_about_once(spark, monkeypatch):
    """Pairs that stay apart came once for each shingle that their prefixes share."""
    rng = random.Random(7)
    texts = dict(enumerate(siblings([f"word{i}" for i in range(500)], 10, 40, rng)))
    made = counted("meetings", monkeypatch)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in N.keep_one(frame).collect()) == sorted(slow_kept(texts))
    assert 0 < made[0] <= 1.5 * 40 * 39 / 2
