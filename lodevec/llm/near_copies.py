"""Operator 5 as a stage: one document of each group whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

A fingerprint of 64 bits can't find all such pairs: at 0.83 two may differ in 17 bits, and no ring of 64 bits has
segments that would still tell them from others. So pigeonring links of fingerprints (``simhash.links``) only come
first. A prefix filter, which loses no pair, completes them: with all shingles in one order, two sets at 0.8 share one
of the first fifth of each. Candidates of either kind are confirmed by the Jaccard similarity of the whole sets, and
components come from ``simhash.components``.

Documents that share a passage and no more would make a candidate of each two of them. So a candidate's wide fingerprints,
of 256 bits, must be within ``WIDE_DISTANCE``. Sets at 0.8 differ in 39 bits on average, with a deviation of 6 (48 and 6
for sets of four and five, the worst), so the chance to lose a pair is below one in a thousand million; sets at 0.1 differ in 113.

Documents of equal sets meet in one node first. The first confirmation has at most ``3 + ORDERS`` candidates a node: what
its fingerprint links to, the member that heads most of the prefixes that they share, and neighbours in orders of the
members of a shingle: each shingle sorts them by a word of the wide fingerprint, turned by bits of its own, so alike members
stand side by side. So a large group of near copies costs a few links each, and nearly all of it is one component by then.
A second, of neighbours in other orders that are of other components, joins most stragglers to it.
The third compares all candidates that aren't in one component. A pair leaves that join where its prefixes meet first, not
once for each shingle that they share: the shingles before are in one set only, which also bounds what they can have
in common. Texts are only fetched for candidates whose prefixes have enough in common: what they share at most is that and
the rest of the set whose prefix ends first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.llm import simhash
from lodevec.llm.common import cool, map_rows, schema_of, settle, small_batches, text_or_empty, unused

WORDS, DISTANCE = 5, 3
#: Longs of a wide fingerprint, and in how many of its bits near copies differ at most.
WIDE, WIDE_DISTANCE = 4, 88
#: Shingles that are common in a sample come last in the order, so prefixes are rare ones. This bears on time, not on results.
SAMPLE_DOCS, COMMON, COMMON_MOST = 10_000, 4, 200_000
SALTS = 64
#: Neighbours that a node is compared with at first and then, in other components, how many bits of a word those may differ in, and how many of all. This bears on time: other pairs wait for the last join.
ORDERS, MORE_ORDERS, WORD_DISTANCE, LINK_DISTANCE = 4, 16, 20, 56
#: How many shingles before a shared one are looked at to tell whether a pair has met before.
BEFORE = 4
#: Tables of keys of up to so many rows, three numbers each, go to all tasks, so the texts beside them aren't shuffled; larger ones are joined by a merge.
BROADCAST_ROWS = 2_000_000
#: Rows of an Arrow batch where it holds texts, one or two a row, and bytes of them that a worker takes at a time.
BATCH_ROWS, CHUNK_BYTES = 512, 1 << 20


def shingle_set(text: str) -> np.ndarray:
    """The sorted hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    return np.unique(simhash.shingle_hashes(text, WORDS))


def near(both: Column | int, first: Column | int, second: Column | int) -> Column | bool:
    """Whether sets of these sizes with ``both`` elements in common have a Jaccard similarity of 0.8 or more, in whole numbers."""
    return 9 * both >= 4 * (first + second)  # type: ignore[operator]


def fits(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can have that similarity at all."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def prefix(shingles: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set, as many as any set at 0.8 must share one of, and a number by which their ends compare."""
    late = np.zeros(len(shingles), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
    first = np.concatenate((shingles[~late], shingles[late]))[: len(shingles) - (4 * len(shingles) + 4) // 5 + 1]
    return first, (int(len(first) > (~late).sum()) << 62 | int(first[-1]) >> 2) if len(first) else 0


def rest_of(size: Column) -> Column:
    """How many of a set of this size aren't in its prefix."""
    return F.greatest(F.ceil(4 * size / 5) - 1, F.lit(0))


def common_shingles(df: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Shingles of ``COMMON`` or more documents of a sample of about ``SAMPLE_DOCS``, at most ``COMMON_MOST``."""
    every = max(1, df.count() // SAMPLE_DOCS)
    sample = df.select(text_or_empty(text_col).alias("t")).where(F.pmod(F.xxhash64(F.col(id_col), "t"), F.lit(every)) == 0)

    def setup():
        cool()
        return lambda texts: [(h,) for t in texts for h in shingle_set(t).view(np.int64).tolist()]

    counted = map_rows(sample, setup, schema_of("h bigint"), chunk_bytes=CHUNK_BYTES).groupBy("h").count().where(F.col("count") >= COMMON)
    with small_batches(df.sparkSession, BATCH_ROWS):
        found = counted.orderBy(F.desc("count"), "h").limit(COMMON_MOST).select("h").toArrow()
    return np.sort(found["h"].to_numpy().astype(np.int64).view(np.uint64))


def small(keys: DataFrame) -> DataFrame:
    """A written table of keys, marked for a broadcast if its size allows."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("merge")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(text_or_empty(text_col))


def prints_and_prefixes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, hash, node, size, fp, prefix, tail, wide)`` of each row: hashes of text and set, the set's size, its fingerprint, prefix, where that ends, and its wide fingerprint."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = schema_of(f"id {kind}, hash bigint, node bigint, size int, fp bigint, prefix array<bigint>, tail bigint, wide array<bigint>")
    shared = df.sparkSession.sparkContext.broadcast(common_shingles(df, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        common = shared.value
        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * (2 << 20) / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                nodes, sizes, prints, heads, tails, wide = [], [], [], [], [], []
                for text in piece.column(2).to_pylist():
                    hashes = simhash.shingle_hashes(text, WORDS)
                    held = np.unique(hashes)
                    nodes.append(xxhash.xxh64_intdigest(held.tobytes(), simhash.SEED))
                    sizes.append(len(held))
                    prints.append(simhash.folded(hashes))
                    first, tail = prefix(held, common)
                    heads.append(first.view(np.int64))
                    tails.append(tail)
                    wide.append(np.asarray(simhash.widened(held, WIDE), np.uint64).view(np.int64))
                ends = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)
                made = [pa.array(np.asarray(v, np.uint64).view(np.int64)) for v in (nodes, prints)]
                rows = [*piece.columns[:2], made[0], pa.array(sizes, pa.int32()), made[1], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads))), pa.array(tails, pa.int64()), pa.array(wide, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(rows, schema.names)

    return df.select(F.col(id_col).alias("id"), text_hash(text_col).alias("hash"), text_or_empty(text_col).alias("body")).mapInArrow(run, schema)


def unlike(first: str, second: str) -> Column:
    """In how many bits two wide fingerprints differ."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(first)[k].bitwiseXOR(F.col(second)[k])) for k in range(WIDE)))


def alike_so_far(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of ``(a, b)``, with x if it is known what two prefixes share, the pairs whose whole sets may reach the similarity."""
    more = [] if "x" in shared.columns else ["prefix"]
    side = lambda s: nodes.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("size", "tail", *more)))
    both = shared.join(side("a"), "a").join(side("b"), "b")
    x = F.size(F.array_intersect("prefix_a", "prefix_b")) if more else F.col("x")
    first, second = rest_of(F.col("size_a")), rest_of(F.col("size_b"))
    rest = F.when(F.col("tail_a") < F.col("tail_b"), first).when(F.col("tail_a") > F.col("tail_b"), second).otherwise(F.greatest(first, second))
    return both.where(near(x + rest, F.col("size_a"), F.col("size_b"))).select("a", "b")


def confirmed(pairs: DataFrame, nodes: DataFrame, texts_of: DataFrame, label: str = "confirmed") -> DataFrame:
    """Those of the pairs ``(a, b)`` of nodes that are near copies by their whole sets. Many pairs may have one ``a``.

    ``texts_of`` has id, hash and body of rows, of which the nodes' own are taken. The rows of a hot ``a`` are dealt
    to ``SALTS`` tasks, each with one copy of its text.
    """
    pairs = settle(pairs.distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = settle(nodes.select("node", F.col("least.id").alias("id"), F.col("least.hash").alias("hash")).join(asked, "node"), "wanted")
    same = texts_of["id"].eqNullSafe(wanted["id"]) & (texts_of["hash"] == wanted["hash"])
    texts = settle(texts_of.join(small(wanted), same).select("node", "body").dropDuplicates(["node"]), "texts")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    heads = salted.select("a", "salt").distinct().join(texts.select(F.col("node").alias("a"), F.col("body").alias("text_a")), "a")
    both = salted.join(texts.select(F.col("node").alias("b"), F.col("body").alias("text_b")), "b").join(heads, ["a", "salt"])

    def setup():
        cool()
        known = lru_cache(64)(shingle_set)

        def work(a: list, b: list, first: list, second: list) -> list[tuple]:
            out = []
            for i, j, s, t in zip(a, b, first, second, strict=True):
                x, y = known(s), shingle_set(t)
                if near(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    out.append((i, j))
            return out

        return work

    with small_batches(pairs.sparkSession, BATCH_ROWS):
        return settle(map_rows(both.select("a", "b", "text_a", "text_b"), setup, schema_of("a bigint, b bigint"), chunk_bytes=CHUNK_BYTES), label)


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidates ``(a, b)`` of pigeonring links: nodes of one fingerprint, and each fingerprint with the least that it links to."""
    heads = settle(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("head")), "heads")
    near_by = simhash.links(heads.select("fp"), DISTANCE).groupBy("b").agg(F.min("a").alias("a"))
    side = lambda s: heads.select(F.col("fp").alias(s), F.col("head").alias(f"head_{s}"))
    linked = near_by.join(side("a"), "a").join(side("b"), "b").where(fits(F.col("head_a.size"), F.col("head_b.size")))
    same = nodes.select("fp", "node", "size").join(heads, "fp").where((F.col("node") != F.col("head.node")) & fits(F.col("size"), F.col("head.size")))
    return linked.select(F.col("head_a.node").alias("a"), F.col("head_b.node").alias("b")).unionByName(same.select(F.col("head.node").alias("a"), F.col("node").alias("b")))


def in_order(shift: int) -> Column:
    """Where a node stands in its shingle's order: a word of its wide fingerprint, turned by bits of the shingle, which are others for another ``shift``."""
    word = "element_at(wide, cast(pmod(shingle + {0}, {1}) + 1 as int))".format(shift, WIDE)
    by = f"cast(pmod(shiftright(shingle, {shift}), 64) as int)"
    return F.expr(f"shiftleft({word}, {by}) | shiftrightunsigned({word}, 64 - {by})")


def neighbours(found: DataFrame, nodes: DataFrame, shares: int) -> DataFrame:
    """Candidates ``(a, b)``: of each node's ``prior``, which are nodes that stand before it in its shingles' orders, the one at the least distance in each of some shares of the shingles."""
    found = found.where(F.col("prior").isNotNull()).groupBy("node", F.pmod(F.shiftright("shingle", 16), F.lit(shares)).alias("share")).agg(F.min("prior").alias("prior"))
    pairs = found.select(F.least("node", "prior.node").alias("a"), F.greatest("node", "prior.node").alias("b")).distinct()
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("wide").alias(f"wide_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(unlike("wide_a", "wide_b") <= LINK_DISTANCE).select("a", "b")


def of_other_roots(open_: DataFrame) -> DataFrame:
    """The members of shingles with the nearest of the two before them, if that is of another component; by another order than ``met`` has."""
    order = Window.partitionBy("shingle").orderBy("turned", "node")
    names = ("node", "size", "root", "wide")
    rows = open_.withColumn("turned", in_order(24)).withColumns({f"last{k}": F.lag(F.struct(*names), k).over(order) for k in (1, 2)})

    def told(k: int) -> Column:
        apart = unlike("wide", f"last{k}.wide")
        return F.when((F.col("root") != F.col(f"last{k}.root")) & fits(F.col("size"), F.col(f"last{k}.size")) & (apart <= LINK_DISTANCE), F.struct(apart.alias("apart"), F.col(f"last{k}.node").alias("node")))

    return rows.select("shingle", "node", F.least(told(1), told(2)).alias("prior"))


def meetings(rows: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of members of one shingle and two roots that may be near copies, from where their prefixes meet first.

    There neither has more in common with the other than is left from that shingle on. A pair that shares one of the
    ``BEFORE`` shingles before has met already, so it comes again only where longer stretches of the prefixes differ.
    """
    side = lambda rows, s: rows.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "size", "root", "left", "before", "wide")))
    enough = near(F.least("left_a", "left_b"), F.col("size_a"), F.col("size_b"))
    apart = (F.col("root_a") < F.col("root_b")) & enough & (unlike("wide_a", "wide_b") <= WIDE_DISTANCE) & ~F.arrays_overlap("before_a", "before_b")
    return side(rows, "a").join(side(rows.where("root <> low"), "b"), "shingle").where(apart).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def links(nodes: DataFrame, texts_of: DataFrame) -> DataFrame:
    """Pairs of nodes that are near copies: all but those that others put in one component already."""
    rows = nodes.select("node", "size", "wide", F.posexplode("prefix").alias("at", "shingle")).select("shingle", "node", "size", "at", in_order(8).alias("turned"))
    group = Window.partitionBy("shingle")
    order = group.orderBy("turned", "node")
    met = rows.withColumns({"head": F.min(F.struct("node", "size")).over(group), "n": F.count("*").over(group), "last": F.lag(F.struct("node", "size", "turned")).over(order)}).where("n > 1")
    apart = F.bit_count(F.col("turned").bitwiseXOR(F.col("last.turned")))
    prior = F.when((apart <= WORD_DISTANCE) & fits(F.col("size"), F.col("last.size")), F.struct(apart.alias("apart"), F.col("last.node").alias("node")))
    met = settle(met.select("shingle", "node", "size", "at", "head", prior.alias("prior")), "met")

    first = met.where((F.col("node") != F.col("head.node")) & fits(F.col("size"), F.col("head.size")))
    first = first.groupBy(F.col("head.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("x"))
    first = first.groupBy("b").agg(F.max(F.struct("x", "a")).alias("s")).select("s.a", "b", "s.x")
    edges = confirmed(alike_so_far(first, nodes).unionByName(by_fingerprint(nodes).select("a", "b")).unionByName(neighbours(met, nodes, ORDERS)), nodes, texts_of)

    joined = simhash.components(edges)
    parted = met.drop("head", "prior").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = parted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    before = F.slice("prefix", F.greatest(F.col("at") + 1 - BEFORE, F.lit(1)), F.least("at", F.lit(BEFORE)))
    held = parted.join(ends, "shingle").join(nodes.select("node", "wide", "prefix"), "node")
    open_ = settle(held.select("shingle", "node", "size", "root", (F.col("size") - F.col("at")).alias("left"), before.alias("before"), "wide"), "open")

    more = confirmed(neighbours(of_other_roots(open_), nodes, MORE_ORDERS), nodes, texts_of, "stragglers")
    root_of = lambda s: joined.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    between = more.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    merged = settle(simhash.components(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))), "merged")
    rooted = open_.join(small(merged.select(F.col("node").alias("root"), F.col("root").alias("lower"))), "root", "left").withColumn("root", F.coalesce("lower", "root"))
    # the largest component of a shingle mostly has the least root, and no pair needs two of its members
    rooted = rooted.withColumns({"low": F.min("root").over(group), "high": F.max("root").over(group)}).where("low <> high")
    return edges.unionByName(more).unionByName(confirmed(alike_so_far(meetings(rooted).distinct(), nodes), nodes, texts_of))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component of near copies, that of the least id and then the least hash of its text; columns stay.

    Texts without words, null or empty, are one component. Ids may be null, which come last, or repeat: only texts decide
    what is alike, so a text unlike all others stays whatever its id. Of rows that repeat id and text one stays, an
    arbitrary one where other columns differ. Very long texts are compared whole. An empty table gives an empty one.
    """
    told = F.struct(F.col("id").isNull().alias("no_id"), "id", "hash", "node")
    nodes = prints_and_prefixes(df, id_col, text_col).groupBy("node").agg(
        F.min(told).alias("least"), F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("tail").alias("tail"), F.first("wide").alias("wide")
    )
    with small_batches(df.sparkSession, BATCH_ROWS):
        nodes = settle(nodes, "nodes")
    texts_of = df.select(F.col(id_col).alias("id"), text_hash(text_col).alias("hash"), text_or_empty(text_col).alias("body"))
    joined = simhash.components(links(nodes, texts_of))
    rooted = nodes.select("node", "least").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = settle(rooted.groupBy("root").agg(F.min("least").alias("s")).select("s.id", "s.hash"), "best")

    name_id, name_hash = unused(df, "chosen_id", "chosen_hash")
    best = best.select(F.col("id").alias(name_id), F.col("hash").alias(name_hash))
    kept = df.join(small(best), df[id_col].eqNullSafe(best[name_id]) & (text_hash(text_col) == best[name_hash]), "left_semi")
    again = df.groupBy(F.col(id_col).alias(name_id), text_hash(text_col).alias(name_hash)).count().where("count > 1").select(name_id, name_hash)
    if again.limit(1).count():
        is_twice = kept[id_col].eqNullSafe(again[name_id]) & (text_hash(text_col) == again[name_hash])
        twice = kept.join(again, is_twice, "left_semi").withColumn(name_hash, text_hash(text_col)).dropDuplicates([id_col, name_hash]).drop(name_hash)
        kept = kept.join(again, is_twice, "left_anti").unionByName(twice)
    return kept
