"""Exact nearest neighbours, filters and reranking as DataFrame plans.

A single query ends in ``orderBy().limit()``, which Spark runs as a bounded top-k in each task and one merge. Many
queries are a stated set in blocks: a block is one matrix product with each Arrow batch of the
corpus, and each task passes on only its best k rows for each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions import vectors as V
from lodevec.plans.budget import candidate_capacity, effective_limit, resolve_knobs
from lodevec.plans.options import MOST_ANY_VALUES, QueryKnobs
from lodevec.sources.files import settle

#: Queries that go to all tasks at a time; a block is this many vectors at most.
QUERY_BLOCK = 2048
#: Rows of an Arrow batch that meet a block of queries at a time.
SLICE = 1024


def filter_column(filters: dict | None) -> Column | None:
    """A conjunction from ``{column: value}``; a list is any of its values, None is null.

    Nulls in a list match nothing, and an empty list matches no row.
    """
    parts = []
    for name, value in (filters or {}).items():
        if value is None:
            parts.append(F.col(name).isNull())
        elif isinstance(value, (list, tuple, set)):
            values = [v for v in value if v is not None]
            if len(values) > MOST_ANY_VALUES:
                raise ValueError(f"at most {MOST_ANY_VALUES} values for {name}")
            parts.append(F.col(name).isin(*values) if values else F.lit(False))
        else:
            parts.append(F.col(name) == F.lit(value))
    return reduce(lambda a, b: a & b, parts) if parts else None


def filtered(df: DataFrame, filters: dict | None) -> DataFrame:
    condition = filter_column(filters)
    return df if condition is None else df.where(condition)


def exact_knn(
    df: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", id_col: str = "id", emb_col: str = "embedding", filters: dict | None = None, payload: Sequence[str] = ()
) -> DataFrame:
    """The k nearest rows: ``(id, distance, payload...)`` by rounded distance and id. Null vectors never match."""
    rows = filtered(df, filters).where(F.col(emb_col).isNotNull())
    found = rows.select(F.col(id_col), *payload, V.rounded(V.distance(metric, F.col(emb_col), V.vector(query))).alias("distance"))
    return found.orderBy("distance", id_col).limit(k)


def within_distance(df: DataFrame, query: Sequence[float], threshold: float, emb_col: str = "embedding") -> DataFrame:
    """Rows whose cosine distance to the query is at most the threshold, which must be between 0 and 2."""
    if not 0 <= threshold <= 2:
        raise ValueError("the threshold must be between 0 and 2")
    checked = V.with_fixed_dimension(df, emb_col, len(query))
    return checked.where(V.cosine_distance(F.col(emb_col), V.vector(query)) <= threshold)


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[list[tuple]]:
    """The rows ``(qid, embedding)`` of a query set in blocks, which are all that the driver holds at a time."""
    block: list[tuple] = []
    for row in queries.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def batch_distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of all queries to all rows, in double precision."""
    inner = q @ x.T
    if metric == "ip":
        return -inner
    if metric == "l2":
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * inner, 0))
    scale = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None, :]
    return np.where(scale > 0, 1 - np.clip(inner / np.where(scale > 0, scale, 1), -1, 1), 1.0)


def batch_knn(
    corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", emb_col: str = "embedding", query_id: str = "qid", query_emb: str = "embedding"
) -> DataFrame:
    """The k nearest rows of each query: ``(qid, id, distance, rank)``.

    Queries go out in blocks. Of several blocks each is written before the next begins, so the driver holds one. Null
    vectors never match; repeated query ids share one ranking; without queries there are no rows.
    """
    V.check_metric(metric)
    kind, asked = corpus.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    source = corpus.where(F.col(emb_col).isNotNull()).select(id_col, emb_col)
    wanted = queries.where(F.col(query_emb).isNotNull()).select(query_id, query_emb)
    parts = []
    for block in query_blocks(wanted):
        shared = corpus.sparkSession.sparkContext.broadcast(block)
        parts.append(source.mapInArrow(_nearest_in_batches(shared, k, metric), f"qid {asked}, id {kind}, distance double"))
        if len(block) == QUERY_BLOCK:
            parts[-1] = settle(parts[-1], "block")
            shared.destroy()
    if not parts:
        return corpus.sparkSession.createDataFrame([], f"qid {asked}, id {kind}, distance double, rank bigint")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


class Nearest:
    """The k nearest rows of each query of a block, of equal rounded distances those of least key.

    Rows come in slices. Only pairs that may be among the best so far are kept, in flat arrays that are cut to k a query as
    they grow, so neither time nor memory has a step for each query and slice.
    """

    def __init__(self, metric: str, queries: np.ndarray, k: int) -> None:
        self.metric, self.k, self.q = metric, k, queries
        if metric == "cosine":
            self.q = _to_length_one(queries)
        self.border = np.full(len(queries), np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places of queries, keys, distances
        self.pending = self.cut_size = 0

    def meet(self, keys: np.ndarray, x: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Compare rows with all queries, or with those at the places ``asking``."""
        asking = np.arange(len(self.q)) if asking is None else asking
        x = _to_length_one(x) if self.metric == "cosine" else x
        width = max(1, min(SLICE, SLICE * QUERY_BLOCK // max(1, len(asking))))
        for at in range(0, len(x), width):
            self._slice(keys[at : at + width], x[at : at + width], asking)

    def _slice(self, keys: np.ndarray, x: np.ndarray, asking: np.ndarray) -> None:
        q, border = self.q[asking], self.border[asking]
        far = 1 - q @ x.T if self.metric == "cosine" else batch_distances(self.metric, q, x)
        fresh = np.isinf(border)
        if len(x) > self.k and fresh.any():
            border[fresh] = np.partition(far[fresh], self.k - 1, axis=1)[:, self.k - 1]
        row, place = np.nonzero(far <= (border + 2e-6)[:, None])  # what rounding may bring within the border
        if len(row):
            distances = np.clip(far[row, place], 0, 2) if self.metric == "cosine" else far[row, place]
            self.kept.append((asking[row], keys[place], np.round(distances, 6) + 0.0))
            self.pending += len(row)
            if self.pending > max(1 << 16, self.cut_size // 2) or fresh.any():
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, keys and distances of the best so far, in this order: query, distance, key."""
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        places, keys, distances = (np.concatenate(c) for c in zip(*self.kept, strict=True))
        order = np.lexsort((keys, distances, places))
        places = places[order]
        first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
        counts = np.diff(np.concatenate((first, [len(places)])))
        rank = np.arange(len(places)) - np.repeat(first, counts)
        full = counts >= self.k
        self.border[places[first[full]]] = distances[order][first[full] + self.k - 1]
        inside = rank < self.k
        self.kept = [(places[inside], keys[order][inside], distances[order][inside])]
        self.pending, self.cut_size = 0, int(inside.sum())
        return self.kept[0]

    def batches(self, ids: list) -> Iterator[pa.RecordBatch]:
        """``(qid, id, distance)`` of the best, with the queries' ids by place."""
        places, keys, distances = self.cut()
        for at in range(0, len(places), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array([ids[n] for n in places[part].tolist()]), pa.array(keys[part].tolist()), pa.array(distances[part])], ["qid", "id", "distance"])


def _to_length_one(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows without length stay zero, so their cosine is 0."""
    length = np.sqrt((x**2).sum(1))[:, None]
    return np.where(length > 0, x / np.where(length > 0, length, 1), 0.0)


def _nearest_in_batches(shared, k: int, metric: str):
    """A task keeps the best k rows of each query over all its batches, and passes on only these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Nearest | None = None
        for batch in batches:
            if batch.num_rows:
                best = best or Nearest(metric, np.asarray([v for _, v in shared.value], np.float64), k)
                x = np.asarray(batch.column(1).values.to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
                best.meet(np.asarray(batch.column(0).to_pylist()), x)
        if best is not None:
            yield from best.batches([q for q, _ in shared.value])

    return run


def nearest_in_lists(rows: DataFrame, ids: list, queries: np.ndarray, chosen: Sequence[Sequence[int]], k: int, metric: str, kind: str, vectors: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """``(qid, id, distance)``: a task's best k rows of each query of a block, among the lists ``chosen`` for it.

    ``rows`` begins with ``(id, list_id)``; ``vectors`` makes a batch of it into vectors. Each row meets only the queries that ask for its list.
    """
    of: dict[int, list[int]] = {}
    for n, lists in enumerate(chosen):
        for i in lists:
            of.setdefault(i, []).append(n)
    shared = rows.sparkSession.sparkContext.broadcast((ids, queries, {i: np.asarray(n) for i, n in of.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, probing = shared.value
        best: Nearest | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            best = best or Nearest(metric, q, k)
            lists = batch.column(1).to_numpy(zero_copy_only=False)
            for place in np.unique(lists):
                asking = probing.get(int(place))
                if asking is not None:
                    inside = np.flatnonzero(lists == place)
                    for at in range(0, len(inside), 4096):
                        part = batch.take(pa.array(inside[at : at + 4096]))
                        best.meet(np.asarray(part.column(0).to_pylist()), vectors(part), asking)
        if best is not None:
            yield from best.batches(names)

    return rows.mapInArrow(run, f"qid {kind}, id {rows.schema['id'].dataType.simpleString()}, distance double")


def knn_of_row(df: DataFrame, one: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", emb_col: str = "embedding") -> DataFrame:
    """The k nearest rows to a query that is the first row of a DataFrame; ``(id, distance)``, none without a query.

    One row meets all others, so the broadcast has a proven bound and the join makes as many rows as there are.
    """
    query = one.select(F.col(emb_col).alias("q")).limit(1)
    rows = df.where(F.col(emb_col).isNotNull()).crossJoin(F.broadcast(query))
    return rows.select(id_col, V.rounded(V.distance(metric, F.col(emb_col), F.col("q"))).alias("distance")).orderBy("distance", id_col).limit(k)


def approx_candidates(df: DataFrame, query: Sequence[float], candidates: int, metric: str = "cosine", id_col: str = "id", emb_col: str = "embedding", filters: dict | None = None) -> DataFrame:
    """``(candidate_id, approximate_rank, approximate_distance)`` of a table without an index."""
    knobs = resolve_knobs(candidates, candidates)
    bound = min(candidates, candidate_capacity(knobs["probes"], knobs["oversample_factor"]))
    found = exact_knn(df, query, bound, metric, id_col, emb_col, filters)
    return ranked_candidates(found, id_col)


def ranked_candidates(found: DataFrame, id_col: str = "id") -> DataFrame:
    """Text ids and ranks of a bounded candidate set, so the window's single partition is bounded too."""
    rank = F.row_number().over(Window.orderBy("distance", id_col))
    return found.select(F.col(id_col).cast("string").alias("candidate_id"), rank.cast("long").alias("approximate_rank"), F.col("distance").alias("approximate_distance"))


def rerank_candidates(
    df: DataFrame, query: Sequence[float], candidates: int, final: int, metric: str = "cosine", id_col: str = "id", emb_col: str = "embedding", knobs: QueryKnobs | None = None, filters: dict | None = None
) -> DataFrame:
    """Candidates with ``exact_rank`` and ``exact_distance``, the final best by rounded distance and id, ranked by distance and text id."""
    knobs = knobs or QueryKnobs()
    limit = effective_limit(candidates, final, knobs.decode_rescore_factor, knobs.decode_rescore_extra_candidates)
    found = approx_candidates(df, query, limit, metric, id_col, emb_col, filters)
    vectors = df.select(F.col(id_col).cast("string").alias("candidate_id"), F.col(emb_col).alias("vector"))
    exact = found.join(vectors, "candidate_id").withColumn("exact_distance", V.rounded(V.distance(metric, F.col("vector"), V.vector(query)))).drop("vector")
    # ranks of candidates go by distance and id, so of equal distances the least ids stay
    kept = exact.orderBy("exact_distance", "approximate_rank").limit(final)
    return kept.withColumn("exact_rank", F.row_number().over(Window.orderBy("exact_distance", "candidate_id")).cast("long"))


def exact_rerank(base: DataFrame, candidates: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", id_col: str = "id", emb_col: str = "embedding") -> DataFrame:
    """Exact distances of a candidate set. Whether the set is broadcast is left to its measured size."""
    joined = base.join(candidates.select(id_col).distinct(), id_col)
    return exact_knn(joined, query, k, metric, id_col, emb_col)


def staged_union(stages: Sequence[tuple[DataFrame, int]], k: int, id_col: str = "id") -> DataFrame:
    """Each stage's best rows within its own limit, put together and cut to k."""
    cut = [df.orderBy("distance", id_col).limit(limit) for df, limit in stages]
    return reduce(DataFrame.unionByName, cut).orderBy("distance", id_col).limit(k)


def fetch_late(base: DataFrame, found: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """Carries columns, as texts, only for the rows that were found. Ids without a row in ``base`` are left out."""
    return base.select(id_col, *columns).join(found, id_col)


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``, of equals the one whose columns come first; null keys are one key.

    Rows are cut down before the shuffle, so a key with many rows costs one row a task.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    found = df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("first_of_key"))
    return found.select(*(F.col(c) if c == key else F.col("first_of_key")[c].alias(c) for c in df.columns))
