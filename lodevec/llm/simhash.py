"""SimHash near-duplicates with pigeonring candidate filtering and distributed components.

Fingerprints of equal documents meet in one node first, so thousands of copies cost one row from
there on. Links between different fingerprints come from a join whose key already holds the first two
links of a pigeonring chain; the join's condition tests the rest of the chain and the full distance,
so only true links leave the join. Components come from alternating large-star and small-star steps,
each written to shared scratch space. Nothing but counts reaches the driver.

Pigeonring: cut 64 bits into a ring of ``m = d + 1`` segments. Two fingerprints at distance ``d`` or
less have a segment from which every run of ``l`` segments differs in ``l - 1`` bits at most: its first
segment is equal, the first two differ in one bit at most, the first three in two, and so on.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import map_rows, schema_of, settle, text_or_empty

BITS = 64
SEED = 42
#: Which of 256 byte values have which bit, lowest bit first.
BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; of fewer words the whole sequence is one, of none there is none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z fold, only ASCII space splits
    if not words:
        return np.empty(0, "<u8")
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter((digest(g, seed) for g in grams), dtype="<u8", count=len(grams))


def folded(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of shingle hashes: a bit is set where over half of them have it."""
    rows = hashes.view(np.uint8).reshape(-1, 8)
    set_bits = np.stack([np.bincount(rows[:, k], minlength=256) for k in range(8)]) @ BIT_OF_BYTE
    return int.from_bytes(np.packbits((2 * set_bits > len(hashes)).reshape(-1), bitorder="little").tobytes(), "little")


def widened(hashes: np.ndarray, words: int) -> list[int]:
    """A SimHash of ``64 * words`` bits: the same of as many hash functions, which mix the given hashes with odd constants."""
    out = []
    with np.errstate(over="ignore"):
        for k in range(words):
            mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64))
            out.append(folded(mixed ^ (mixed >> np.uint64(32))))
    return out


def fingerprint(text: str, shingle: int = 3) -> int:
    return folded(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` of each row; fp is the fingerprint as a signed long.

    A null text counts as empty, which has 0; long texts are hashed whole; repeated rows repeat; an empty table gives
    an empty result; other columns aren't looked at.
    """

    def setup():
        def work(ids: list, texts: list) -> list[tuple]:
            values = [fingerprint(t, shingle) for t in texts]
            return [(i, v - (1 << 64) if v >> 63 else v) for i, v in zip(ids, values, strict=True)]

        return work

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    return map_rows(source, setup, schema_of(f"`{id_col}` {kind}, fp bigint"))


def _turned(fp: Column, by: int) -> Column:
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by)) if by else fp


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of different values of ``nodes.fp`` at ``distance`` bits or fewer, each once.

    The segments are ``64 / (distance + 1)`` bits wide. The join key is the number of the first segment
    with the first two segments' bits. One side looks up each value its second segment may have. Rings are turned
    again after the join, so they aren't shuffled; a pair whose chain holds from several segments counts at the first.
    Null fingerprints link to nothing; repeated ones count once; an empty table has no links.
    """
    m = distance + 1
    if BITS % m or not 1 <= distance <= 7:
        raise ValueError("distance must be 1, 3 or 7")
    wide = BITS // m
    head_of = lambda ring: F.shiftrightunsigned(ring, BITS - 2 * wide)
    rings = [(i, head_of(_turned(F.col("fp"), wide * i))) for i in range(m)]
    if 2 * wide <= 58:  # segment number and bits fit one long, which sorts faster
        key = lambda i, bits: F.lit(i << 2 * wide).cast("long").bitwiseOR(bits)
        segment = lambda k: F.shiftrightunsigned(k, 2 * wide).cast("int")
    else:
        key = lambda i, bits: F.struct(F.lit(i).alias("i"), bits.alias("head"))
        segment = lambda k: k["i"]
    values = nodes.select("fp").distinct()
    held = values.select(F.col("fp").alias("b"), F.explode(F.array(*(key(i, bits) for i, bits in rings))).alias("key"))
    masks = [0, *(1 << j for j in range(wide))]
    asked = values.select(F.col("fp").alias("a"), F.explode(F.array(*(key(i, bits.bitwiseXOR(F.lit(mask).cast("long"))) for i, bits in rings for mask in masks))).alias("key"))
    unlike = F.col("a").bitwiseXOR(F.col("b"))

    def chain(i: int) -> Column:
        """Whether every run of segments from the i-th on stays within its share of the differences."""
        turned = _turned(unlike, wide * i)
        holds = F.bit_count(F.shiftrightunsigned(turned, BITS - wide)) <= 0
        for run in range(2, m):
            holds = holds & (F.bit_count(F.shiftrightunsigned(turned, BITS - run * wide)) <= run - 1)
        return holds

    first = F.lit(m)
    for i in reversed(range(m)):
        first = F.when(chain(i), i).otherwise(first)
    joined = asked.join(held, on=(asked.key == held.key) & (F.col("a") < F.col("b")) & (F.bit_count(unlike) <= distance) & (first == segment(asked.key)))
    return joined.select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of undirected ``edges(a, b)``; root is the least node of its component.

    Large-star then small-star until the edges stay the same, which they do after some rounds, as each only lowers
    nodes' neighbours. Minima are aggregated before the shuffle, and a hub's rows only meet in joins that can be
    split. Edges may repeat or lead from a node to itself; without edges there are no rows. Ends mustn't be null.
    """
    star = settle(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")

    def toward_minimum(pairs: DataFrame, larger: bool) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = pairs.join(least, "u")
        if larger:
            return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        kept = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.where("m <> u").select("u", F.col("m").alias("v"))
        return kept.unionByName(own).distinct()

    def signature(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)  # type: ignore[arg-type]

    before = signature(star)
    while before[0]:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settle(toward_minimum(both, larger=True), "large")
        downward = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        star = settle(toward_minimum(downward, larger=False), "small")
        after = signature(star)
        if after == before:
            break
        before = after
    leaves = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """``(id, fp, component_id)``, one row for each row of ``df``; component_id is its component's least id.

    A null text is empty and has fingerprint 0, which links like any other. A row with a null id has its
    component, but null is never the least id unless all ids there are null. Repeated rows stay repeated.
    An empty table gives an empty result. Other columns aren't looked at.
    """
    prints = settle(fingerprints(df, id_col, text_col, shingle), "prints")
    nodes = settle(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")), "nodes")
    joined = components(links(nodes, distance))
    rooted = nodes.join(joined, nodes.fp == joined.node, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = settle(rooted.join(named, "root").select("fp", "component_id"), "named")
    return prints.join(of_print, "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
