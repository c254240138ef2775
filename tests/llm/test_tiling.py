import random
import time
import tracemalloc

import numpy as np

from lodevec.llm import tiling as T
from lodevec.llm.queries import op6_decontamination


def slow_tiles(doc, item, least):
    """Greedy string tiling by trying all places for each length."""
    free_doc, free_item, out = [d >= 0 for d in doc], [True] * len(item), []
    least = max(1, min(least, len(item), len(doc)))
    for size in range(min(len(doc), len(item)), least - 1, -1):
        for j in range(len(item) - size + 1):
            for i in range(len(doc) - size + 1):
                if all(free_doc[i : i + size]) and all(free_item[j : j + size]) and list(doc[i : i + size]) == list(item[j : j + size]):
                    out.append((i, j, size))
                    free_doc[i : i + size] = [False] * size
                    free_item[j : j + size] = [False] * size
    return out


def test_tiles_cover_as_much_as_greedy_tiling_by_hand():
    rng = random.Random(3)
    for _ in range(300):
        doc = np.asarray([rng.choice([-1, 0, 1, 2]) for _ in range(rng.randint(0, 30))])
        item = np.asarray([rng.choice([0, 1, 2]) for _ in range(rng.randint(0, 15))])
        got, want = T.tile(doc, item, 3), slow_tiles(doc, item, 3)
        assert max((n for *_, n in got), default=0) == max((n for *_, n in want), default=0)
        places = [a + k for a, _, n in got for k in range(n)]
        assert len(places) == len(set(places)) and all((doc[a : a + n] == item[b : b + n]).all() for a, b, n in got)
        assert abs(sum(n for *_, n in got) - sum(n for *_, n in want)) <= 3


def test_window_hashes_are_rolling():
    ids = np.asarray([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5] * 3)
    for size in (1, 2, 3, 5, 8, 13):
        hashes = T._window_hashes(ids, size)
        assert len(hashes) == len(ids) - size + 1
        seen = {}
        for i, h in enumerate(hashes.tolist()):
            assert seen.setdefault(h, tuple(ids[i : i + size])) == tuple(ids[i : i + size])


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
BENCH = [(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "two words"), (None, "one two three four five six seven eight")]


def test_reordered_passages_and_hostile_rows(spark, docs, no_docs):
    words = ITEM.split()
    rows = [
        (1, "before " + ITEM.upper() + " after"),
        (2, " ".join(words[10:] + ["noise"] * 5 + words[:10])),
        (3, " ".join(words[:9])),
        (4, " ".join(reversed(words))),
        (5, None),
        (6, "Two, words!"),
        (7, "one two three four five six seven eight"),
        (1, "before " + ITEM.upper() + " after"),
    ]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs, allowMissingColumns=True)
    for block in (10**6, 30):
        found = sorted((r.doc_id, r.item_id or 0, r.n_tiles) for r in T.matches(frame, bench, block_chars=block).collect())
        assert found == [(1, 1, 1), (1, 1, 1), (2, 1, 2), (7, 0, 1)]
        kept = T.drop_contaminated(frame, bench, block_chars=block)
        assert kept.count() == frame.count() - 4 and kept.columns == frame.columns
    short = T.matches(frame, bench, min_item=1).where("item_id = 4").collect()
    assert [r.doc_id for r in short] == [6]
    assert T.matches(no_docs, bench).count() == 0 and T.matches(docs, bench.where("false")).count() == 0
    assert T.drop_contaminated(docs, bench.where("false")).count() == docs.count()


def test_many_items_with_one_opening_take_little_memory():
    rng = random.Random(12)
    opening = [f"start{i}" for i in range(12)]
    items = [(i, " ".join(opening + [f"own{i}x{k}" for k in range(30)])) for i in range(10_000)]
    words = [rng.choice(opening + ["noise", "other"]) for _ in range(98_000)] + (opening + ["noise"]) * 100 + items[77][1].split()
    bench = T.Benchmark(items)
    tracemalloc.start()
    began = time.process_time()
    found = list(T._hits(bench, " ".join(words), T.MIN_TILE, T.MIN_COVERAGE))
    assert [(f[0], f[1]) for f in found] == [(77, 1.0)]
    assert tracemalloc.get_traced_memory()[1] < 100 << 20 and time.process_time() - began < 20
    tracemalloc.stop()


def test_candidates_lose_nothing():
    """With and without the bound on what shared seeds cover, the same items are found."""
    rng = random.Random(7)
    for _ in range(150):
        pool = "abcdefgh"
        items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(5, 14)))) for i in range(8)]
        text = " ".join(rng.choice(pool) for _ in range(60)) + " " + " ".join(items[0][1].split()[2:] + items[1][1].split()[:6])
        bench = T.Benchmark(items)
        doc = np.asarray([bench.ids.get(w, -1) for w in T.tokens(text)])
        want = {i: sum(n for *_, n in T.tile(doc, item)) / len(item) for i, item in bench.items}
        got = {f[0] for f in T._hits(bench, text, T.MIN_TILE, T.MIN_COVERAGE)}
        assert got == {i for i, c in want.items() if c >= T.MIN_COVERAGE}


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, T.tokens(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, T.tokens(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    whole = set()
    for d, words in docs:
        line = " " + " ".join(words) + " "
        whole |= {(d, i) for i, item in items if f" {' '.join(item)} " in line}
    found = {(r.doc_id, r.item_id): r for r in op6_decontamination(spark, sf_dir).collect()}
    assert whole and whole <= set(found)
    assert all(found[k].coverage == 1.0 for k in whole)
