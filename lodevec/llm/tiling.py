"""Benchmark decontamination by greedy string tiling.

A document's seeds, runs of ``SEED_TOKENS`` tokens, are joined with those of the benchmark items by their rolling hash.
An item stays a candidate where the seeds that it shares with the document cover as many of its tokens as the tiles must.
Tiles are then marked by running Karp-Rabin: windows of length s are looked up by rolling hash, matches
grow to full length through unmarked tokens, the longest are marked first, and s shrinks. The share of
the item's tokens under tiles decides, wherever in the document the tiles lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import cool, map_rows, schema_of, text_or_empty

SEED_TOKENS = 5
MIN_TILE = 5
#: Items of fewer tokens say too little to be found in a document; they are left out unless a caller lowers this.
MIN_ITEM = 5
MIN_COVERAGE = 0.6
BLOCK_CHARS = 8_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers are invertible mod 2**64
WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes mod 2**64 of all windows of ``size`` ids, by doubling the window."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total, done = np.zeros(n, np.uint64), 0
        power, width = ids.astype(np.uint64) * BASE + (ids.astype(np.uint64) >> np.uint64(7)), 1
        scale = BASE
        while True:
            if size & width:
                total = total * scale + power[done : done + n]
                done += width
            if 2 * width > size:
                return total
            power = power[:-width] * scale + power[width:]
            width, scale = 2 * width, scale * scale


def tile(doc: np.ndarray, item: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles ``(doc_at, item_at, length)`` of two id sequences; -1 matches nothing.

    Equal lengths are marked in order of (item_at, doc_at). A sequence shorter than ``min_tile`` lowers it
    to its own length.
    """
    least = max(1, min(min_tile, len(item), len(doc)))
    free_doc, free_item = doc >= 0, item >= 0
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(doc)))
    while len(item) and len(doc):
        found = _matches(doc, item, free_doc, free_item, size)
        longest = max((n for _, _, n in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        for at, to, n in sorted(found, key=lambda t: (-t[2], t[1], t[0])):
            if free_doc[at : at + n].all() and free_item[to : to + n].all():
                tiles.append((at, to, n))
                free_doc[at : at + n] = False
                free_item[to : to + n] = False
        # what an earlier tile cut into is found again: the same length once more until nothing is marked
        again = any(n >= size and not (free_doc[a : a + n].all() and free_item[t : t + n].all()) and _longest_free(free_doc, free_item, a, t, n) >= size for a, t, n in found)
        if again:
            continue
        if size == least:
            return tiles
        size = max(least, size // 2)
    return tiles


def _longest_free(free_doc: np.ndarray, free_item: np.ndarray, at: int, to: int, n: int) -> int:
    both = np.concatenate(([0], (free_doc[at : at + n] & free_item[to : to + n]).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(both))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def _matches(doc, item, free_doc, free_item, size) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches of at least ``size`` tokens, each once."""
    doc_ok = np.flatnonzero(_all_free(free_doc, size))
    item_ok = np.flatnonzero(_all_free(free_item, size))
    if not len(doc_ok) or not len(item_ok):
        return []
    doc_hash, item_hash = _window_hashes(doc, size)[doc_ok], _window_hashes(item, size)[item_ok]
    order = np.argsort(item_hash, kind="stable")
    low = np.searchsorted(item_hash, doc_hash, "left", sorter=order)
    high = np.searchsorted(item_hash, doc_hash, "right", sorter=order)
    diagonals: dict[int, list[int]] = {}
    for k in np.flatnonzero(high > low):
        at = int(doc_ok[k])
        for to in item_ok[order[low[k] : high[k]]]:
            if np.array_equal(doc[at : at + size], item[to : to + size]):
                diagonals.setdefault(at - int(to), []).append(at)
    found = []
    for shift, starts in diagonals.items():
        starts.sort()
        begin = last = starts[0]
        for at in [*starts[1:], -1]:
            if at != last + 1:
                found.append((begin, begin - shift, last - begin + size))
                begin = at
            last = at
    return found


def _all_free(free: np.ndarray, size: int) -> np.ndarray:
    if len(free) < size:
        return np.zeros(0, bool)
    marked = np.concatenate(([0], np.cumsum(~free)))
    return marked[size:] == marked[:-size]


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``low .. high``, one range after the other."""
    sizes = high - low
    ends = np.cumsum(sizes)
    return np.repeat(low - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Benchmark:
    """Items as ids, with a sorted table of their seeds by hash: which item has it, and where."""

    def __init__(self, items: list[tuple], seed: int = SEED_TOKENS, min_item: int = MIN_ITEM) -> None:
        self.ids: dict[str, int] = {}
        self.items: list[tuple] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            words = tokens(text or "")
            if not words or len(words) < min_item:
                continue
            ids = np.asarray([self.ids.setdefault(w, len(self.ids)) for w in words], dtype=np.int64)
            k = min(seed, len(ids))
            found.setdefault(k, []).append((_window_hashes(ids, k), len(self.items)))
            self.items.append((item_id, ids))
        self.sizes = np.asarray([len(ids) for _, ids in self.items], np.int64)
        self.lookup = {}
        for k, rows in found.items():
            hashes = np.concatenate([h for h, _ in rows])
            owner = np.concatenate([np.full(len(h), i, np.int32) for h, i in rows])
            place = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in rows])
            order = np.argsort(hashes, kind="stable")
            self.lookup[k] = (hashes[order], owner[order], place[order])

    def candidates(self, doc: np.ndarray, min_coverage: float) -> Iterator[tuple[int, np.ndarray]]:
        """Items whose shared seeds cover enough of them, each with the document's tokens in these seeds; -1 parts their runs."""
        for k, (hashes, owner, place) in self.lookup.items():
            known = np.flatnonzero(_all_free(doc >= 0, k))
            if not len(known):
                continue
            mine = _window_hashes(doc, k)[known]
            order = np.argsort(mine, kind="stable")
            mine, known = mine[order], known[order]
            heads = np.concatenate(([0], np.flatnonzero(mine[1:] != mine[:-1]) + 1))  # of each different hash
            tails = np.append(heads[1:], len(mine))
            low, high = (np.searchsorted(hashes, mine[heads], side) for side in ("left", "right"))
            shared = np.flatnonzero(high > low)
            rows = _ranges(low[shared], high[shared])
            which = np.repeat(shared, (high - low)[shared])  # the document's hash of each row
            by_item = np.lexsort((place[rows], owner[rows]))
            rows, which = rows[by_item], which[by_item]
            items, places = owner[rows], place[rows].astype(np.int64)
            if not len(items):
                continue
            reach = np.full(len(items), k)
            reach[:-1] = np.where(items[1:] == items[:-1], np.minimum(k, np.diff(places)), k)
            begins = np.concatenate(([0], np.flatnonzero(np.diff(items)) + 1))
            ends = np.append(begins[1:], len(items))
            enough = np.add.reduceat(reach, begins) >= min_coverage * self.sizes[items[begins]]
            for a, b in zip(begins[enough], ends[enough], strict=True):
                of = np.unique(which[a:b])
                starts = np.sort(known[_ranges(heads[of], tails[of])])
                at = np.unique((starts[:, None] + np.arange(k)).ravel())
                gaps = np.flatnonzero(np.diff(at) > 1) + 1
                yield int(items[a]), np.insert(doc[at], gaps, -1)


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_chars: int) -> Iterator[Broadcast]:
    """The benchmark as broadcasts of about ``block_chars`` characters; rows without text are left out."""
    wanted = benchmark.select(F.col(item_col).alias("item"), text_or_empty(item_text).alias("body")).where("body <> ''").distinct()
    chars = wanted.agg(F.sum(F.length("body"))).first()[0] or 0  # type: ignore[index]
    blocks = max(1, -(-chars // block_chars))
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block) if blocks > 1 else wanted
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in part.orderBy("item", "body").collect()])


def _hits(bench: Benchmark, text: str, min_tile: int, min_coverage: float) -> Iterator[tuple]:
    """``(item, coverage, n_tiles, longest_tile, item_tokens)`` of each item that the text covers far enough."""
    number = bench.ids.get
    doc = np.asarray([number(w, -1) for w in tokens(text)], dtype=np.int64)
    for i, near in bench.candidates(doc, min_coverage):
        item_id, item = bench.items[i]
        tiles = tile(near, item, min_tile)
        covered = sum(n for _, _, n in tiles) / len(item)
        if tiles and covered >= min_coverage:
            yield (item_id, covered, len(tiles), max(n for _, _, n in tiles), len(item))


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    min_tile: int = MIN_TILE,
    min_coverage: float = MIN_COVERAGE,
    min_item: int = MIN_ITEM,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(id, item, coverage, n_tiles, longest_tile, item_tokens)`` for items covered to ``min_coverage`` or more.

    The benchmark is the stated query set: blocks of about ``block_chars`` characters are broadcast one
    after the other, each against all documents. Documents and items with null or empty text match nothing, nor do items of
    fewer than ``min_item`` tokens; repeated documents repeat their rows; items that repeat an (id, text) count once;
    very long texts are tiled whole; empty tables give an empty result. Other columns aren't looked at.
    """
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = schema_of(f"`{id_col}` {id_kind}, `{item_col}` {item_kind}, coverage double, n_tiles int, longest_tile int, item_tokens int")
    source = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    parts = []
    for shared in _blocks(benchmark, item_col, item_text, block_chars):

        def setup(shared: Broadcast = shared):
            cool()
            bench = Benchmark(shared.value, min(SEED_TOKENS, min_tile), min_item)

            def work(ids: list, texts: list) -> list[tuple]:
                return [(i, *hit) for i, t in zip(ids, texts, strict=True) for hit in _hits(bench, t, min_tile, min_coverage)]

            return work

        parts.append(map_rows(source, setup, out))
    return reduce(DataFrame.unionByName, parts)


def _leaked(shared: Broadcast, text: Column, min_tile: int, min_coverage: float, min_item: int) -> Column:
    @F.arrow_udf("boolean")  # type: ignore[call-overload]
    def leaked(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cool()
        bench = Benchmark(shared.value, min(SEED_TOKENS, min_tile), min_item)
        for texts in columns:
            yield pa.array([any(True for _ in _hits(bench, t.as_py(), min_tile, min_coverage)) for t in texts], pa.bool_())

    return leaked(text)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    min_tile: int = MIN_TILE,
    min_coverage: float = MIN_COVERAGE,
    min_item: int = MIN_ITEM,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` without the rows whose text ``matches`` finds; each row is judged by its text, columns stay."""
    for shared in _blocks(benchmark, item_col, item_text, block_chars):
        docs = docs.where(~_leaked(shared, text_or_empty(text_col), min_tile, min_coverage, min_item))
    return docs
