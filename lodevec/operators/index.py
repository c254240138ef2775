"""A quantised vector index as a folder of Parquet tables, and its searches, writes and upkeep.

A folder holds versions. Version n has ``meta-n.json``, which is written last and commits it, and tables: ``codes``
by list (id, page, packed code, attributes and the exact vector), ``lists`` and ``pages`` with their statistics,
``centroids``. Inserts and deletes since are in ``delta`` and ``tombstones`` of that version, each
row with a sequence number. A merge writes the next version, with the lists that changes touched; the metadata say
which version has the codes and pages of each other list.

Lists are partitions of ``codes``, so the lists that a search probes are all that is read. Filters and column
selection stand before the Python scoring, so they reach the scan.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodevec.functions import vectors as V
from lodevec.operators import router
from lodevec.operators.codec import CODECS, Codec
from lodevec.operators.knn import batch_knn, exact_rerank, filter_column, nearest_in_lists, query_blocks, ranked_candidates
from lodevec.operators.rotation import rotate_back
from lodevec.plans import budget
from lodevec.plans.options import ATTRIBUTE_TYPES, FORMAT_VERSION, IndexOptions, MaintenanceKnobs, QueryKnobs, lane_count
from lodevec.sources import files

CODE_COLUMNS = ["idx", "sgn", "gamma"]
#: What rounding of stored floats and of distances to six digits may add to a bound.
BOUND_SLACK = 1e-5
#: Stands for the delta where rows are told apart by list.
DELTA_LIST = -1


class BrokenIndex(ValueError):
    """An index folder that can't be used."""


@dataclass
class ScanStats:
    """What a search looked at; returned beside its rows."""

    mode: str = "flat"
    score_mode: str = "decoded"
    nominal_probes: int = 0
    selected_lists: list[int] = field(default_factory=list)
    selected_live_count: int = 0
    selected_page_count: int = 0
    max_visited_codes: int = 0
    max_visited_pages: int = 0
    visited_code_count: int = 0
    visited_page_count: int = 0
    candidate_capacity: int = 0
    near_exhaustive: bool = False
    delta_live_count: int = 0
    score_kernel: str = "numpy"

    def as_dict(self) -> dict:
        return dict(self.__dict__)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _with(batch: pa.RecordBatch, schema: pa.Schema, **added) -> pa.RecordBatch:
    """The batch's columns and more, in the order and with the types of ``schema``."""
    have = dict(zip(batch.schema.names, batch.columns, strict=True))
    have |= {n: c if isinstance(c, pa.Array) else pa.array(c) for n, c in added.items()}
    return pa.RecordBatch.from_arrays([have[f.name].cast(f.type) for f in schema], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


@dataclass
class VectorIndex:
    """An opened version of an index. Build with ``build``, open with ``load``."""

    spark: SparkSession
    path: str
    version: int
    options: IndexOptions
    dimension: int
    id_type: str
    attribute_types: dict[str, str]
    router: dict
    #: Lists whose codes and pages are in an older version, by that version.
    kept: dict[int, list[int]] = field(default_factory=dict)
    memo: dict = field(default_factory=dict, repr=False)

    # ------------------------------------------------------------------ build and load
    @classmethod
    def build(cls, df: DataFrame, path: str, options: IndexOptions | None = None, id_col: str = "id", emb_col: str = "embedding", centroids: np.ndarray | None = None) -> VectorIndex:
        """Index the rows of ``df`` whose vector isn't null, with the options' attributes beside them.

        All vectors must have the same number of dimensions. An empty table gives an index that takes its
        dimension from the first insert. ``centroids``, as many as lists, take the place of training.
        """
        options = options or IndexOptions()
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        for name in options.attributes:
            if kinds[name] not in ATTRIBUTE_TYPES:
                raise BrokenIndex(f"attribute {name} has the unsupported type {kinds[name]}")
        rows = df.select(F.col(id_col).alias("id"), F.col(emb_col).cast("array<float>").alias("embedding"), *options.attributes).where("embedding is not null")
        first = rows.select(F.size("embedding")).first()
        index = cls(df.sparkSession, path.rstrip("/"), 0, options, first[0] if first else 0, kinds[id_col], {a: kinds[a] for a in options.attributes}, {})
        if centroids is not None and len(centroids) != options.lists:
            raise ValueError(f"{options.lists} lists need as many centroids, not {len(centroids)}")
        index._write_version(index._prepared(rows), None if centroids is None else index.codec.rotate(np.asarray(centroids, np.float64)))
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        path = path.rstrip("/")
        versions = [int(n[5:-5]) for n in files.children(spark, path) if n.startswith("meta-") and n.endswith(".json")]
        if not versions:
            raise BrokenIndex(f"no index in {path}")
        try:
            meta = json.loads(files.read_text(spark, f"{path}/meta-{max(versions)}.json"))
            if meta["format_version"] != FORMAT_VERSION:
                raise BrokenIndex(f"index format {meta['format_version']} isn't supported; rebuild the index")
            return cls(spark, path, meta["version"], IndexOptions.from_dict(meta["options"]), meta["dimension"], meta["id_type"], meta["attribute_types"], meta["router"], {int(v): lists for v, lists in meta.get("kept", {}).items()})
        except (KeyError, TypeError, json.JSONDecodeError) as broken:
            raise BrokenIndex(f"the metadata of {path} is damaged") from broken

    @property
    def codec(self) -> Codec:
        return CODECS[self.options.codec](self.dimension, self.options.bits, self.options.sketch_dim)

    def _prepared(self, rows: DataFrame) -> DataFrame:
        rows = V.with_fixed_dimension(rows, "embedding", self.dimension)
        if self.options.input_kind == "halfvec":
            rows = rows.withColumn("embedding", V.half(F.col("embedding")))
        if self.options.normalized:
            rows = rows.withColumn("embedding", V.checked_unit(F.col("embedding")).cast("array<float>"))
        return rows

    def _file(self, name: str) -> str:
        return f"{self.path}/v{self.version}/{name}"

    def _train(self, rows: DataFrame) -> np.ndarray | None:
        """Centroids from a bounded sample; of the restarts that wins which is tightest and most even over all rows."""
        o = self.options
        if not o.lists:
            return None
        sample = rows.select("id", "embedding").orderBy(F.xxhash64(F.lit(o.router_seed), "id"), "id").limit(o.router_samples).select("embedding").toArrow()
        if not sample.num_rows:
            return None
        x = self.codec.rotate(_matrix(sample.column(0).combine_chunks()))
        runs = router.candidates(x, o.lists, o.router_seed, o.router_restarts, o.router_iterations)
        codec, shared = self.codec, self.spark.sparkContext.broadcast(runs)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(shared.value), o.lists, 2))
            for batch in batches:
                if batch.num_rows:
                    rotated = codec.rotate(_matrix(batch.column(0)))
                    for r, centroids in enumerate(shared.value):
                        distances = router.squared_distances(rotated, centroids)
                        owner = distances.argmin(1)
                        total[r, :, 0] += np.bincount(owner, minlength=o.lists)
                        total[r, :, 1] += np.bincount(owner, distances[np.arange(len(owner)), owner], o.lists)
            run, place = np.nonzero(total[:, :, 0])
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(place), pa.array(total[run, place, 0].astype(np.int64)), pa.array(total[run, place, 1])], ["run", "list_id", "n", "distortion"])

        parts = rows.select("embedding").mapInArrow(judge, "run bigint, list_id bigint, n bigint, distortion double")
        sums = parts.groupBy("run", "list_id").agg(F.sum("n"), F.sum("distortion")).collect()
        counts, distortion = np.zeros((len(runs), o.lists)), np.zeros(len(runs))
        for run, place, n, d in sums:
            counts[run, place] = n
            distortion[run] += d
        judged = [router.objective(d, c) for d, c in zip(distortion, counts, strict=True)]
        chosen = router.best(judged)
        self.router = {"samples": sample.num_rows, "restart": chosen, **judged[chosen].__dict__, "penalty": judged[chosen].penalty, "score": judged[chosen].score}
        return runs[chosen]

    def _encoded(self, rows: DataFrame, centroids: np.ndarray | None) -> DataFrame:
        """Adds list and code to prepared rows."""
        schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("list_id int, idx binary, sgn binary, gamma float").fields])
        arrow, codec, place = _arrow(schema), self.codec, rows.columns.index("embedding")
        shared = self.spark.sparkContext.broadcast(centroids)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rotated = codec.rotate(_matrix(batch.column(place)))
                    owner = router.assign(rotated, shared.value) if shared.value is not None else np.zeros(len(rotated))
                    codes, signs, gamma = codec.encode(rotated)
                    idx, sgn = codec.pack(codes, signs)
                    yield _with(batch, arrow, list_id=pa.array(owner.astype(np.int32)), idx=pa.array(idx, pa.binary()), sgn=pa.array(sgn, pa.binary()), gamma=pa.array(gamma.astype(np.float32)))

        return rows.mapInArrow(encode, schema)

    def _paged(self, encoded: DataFrame) -> DataFrame:
        """Adds pages of consecutive rows of a list, each with its first row and the distance to that row's code."""
        schema = T.StructType([*encoded.schema.fields, *T._parse_datatype_string("page_id bigint, page_first boolean, from_first float").fields])
        arrow, codec = _arrow(schema), self.codec
        lanes = lane_count(codec.code_bytes, len(self.options.attributes))
        names = encoded.columns

        def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32  # type: ignore[union-attr]
            held, lane, first = None, 0, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = {n: batch.column(i) for i, n in enumerate(names)}
                codes, signs = codec.unpack(columns["idx"].to_pylist(), columns["sgn"].to_pylist())
                decoded = codec.decode(codes, signs, columns["gamma"].to_numpy(zero_copy_only=False))
                pages, firsts, away = [], [], []
                for row, of in enumerate(columns["list_id"].to_pylist()):
                    if of != held or lane == lanes:
                        number, lane, held, first = number + 1, 0, of, decoded[row]
                    pages.append(number)
                    firsts.append(lane == 0)
                    away.append(float(np.sqrt(((decoded[row] - first) ** 2).sum())))
                    lane += 1
                yield _with(batch, arrow, page_id=pages, page_first=firsts, from_first=away)

        # adaptive execution splits the partitions of large lists
        return encoded.hint("rebalance", "list_id").sortWithinPartitions("list_id", "id").mapInArrow(page, schema)

    def _write_version(self, rows: DataFrame, centroids: np.ndarray | None = None, kept: dict[int, list[int]] | None = None, lists_kept: list[tuple] = ()) -> None:
        """Write rows as this version, beside the lists of older versions with their rows of the table ``lists``."""
        kept = kept or {}
        if self.dimension and centroids is None:
            centroids = self._train(rows)
        if self.dimension:
            coded = self._paged(self._encoded(rows, centroids))
        else:
            more = "list_id int, idx binary, sgn binary, gamma float, page_id bigint, page_first boolean, from_first float"
            coded = self.spark.createDataFrame([], T.StructType([*rows.schema.fields, *T._parse_datatype_string(more).fields]))
        coded.write.partitionBy("list_id").parquet(self._file("codes"))
        codes = self._codes_of(self.version)
        self._synopsis(codes).write.partitionBy("list_id").parquet(self._file("pages"))
        lists = codes.groupBy("list_id").agg(F.count("*").alias("live_count"), F.countDistinct("page_id").alias("page_count"))
        lists.unionByName(self.spark.createDataFrame(list(lists_kept), "list_id int, live_count bigint, page_count bigint")).coalesce(1).write.parquet(self._file("lists"))
        rows_of = [] if centroids is None else [(i, c.tolist()) for i, c in enumerate(centroids)]
        self.spark.createDataFrame(rows_of, "list_id int, centroid array<double>").coalesce(1).write.parquet(self._file("centroids"))
        meta = {"format_version": FORMAT_VERSION, "version": self.version, "options": self.options.as_dict(), "dimension": self.dimension, "id_type": self.id_type, "attribute_types": self.attribute_types, "router": self.router, "kept": kept}
        self.kept = kept
        files.write_text(self.spark, f"{self.path}/meta-{self.version}.json", json.dumps(meta))

    def _synopsis(self, codes: DataFrame) -> DataFrame:
        """Per page: rows, representative code and radius, and each attribute's range and nulls."""
        first = [F.max(F.when(F.col("page_first"), F.col(c))).alias(f"first_{c}") for c in CODE_COLUMNS]
        parts = [F.count("*").alias("live_count"), F.max("from_first").alias("radius"), *first]
        return codes.groupBy("list_id", "page_id").agg(*parts, *attribute_ranges(self.options.attributes))

    # ------------------------------------------------------------------ tables
    def _row_schema(self) -> T.StructType:
        attributes = "".join(f", `{a}` {t}" for a, t in self.attribute_types.items())
        return T._parse_datatype_string(f"id {self.id_type}, embedding array<float>{attributes}")  # type: ignore[return-value]

    def _codes_of(self, version: int) -> DataFrame:
        more = "idx binary, sgn binary, gamma float, page_id bigint, page_first boolean, from_first float, list_id int"
        return self.spark.read.schema(T.StructType([*self._row_schema().fields, *T._parse_datatype_string(more).fields])).parquet(f"{self.path}/v{version}/codes")

    def _pages_of(self, version: int) -> DataFrame:
        firsts = "first_idx binary, first_sgn binary, first_gamma float"
        ranges = "".join(f", `{a}_min` {t}, `{a}_max` {t}, `{a}_null_any` boolean, `{a}_null_all` boolean, `{a}_all_same` boolean" for a, t in self.attribute_types.items())
        schema = T._parse_datatype_string(f"page_id bigint, live_count bigint, radius float, {firsts}{ranges}, list_id int")
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{version}/pages")

    def _parted(self, read: Callable[[int], DataFrame]) -> DataFrame:
        """A table of this version and, of older ones, the lists that are still theirs; these are partition filters."""
        return reduce(DataFrame.unionByName, (read(v).where(F.col("list_id").isin(lists)) for v, lists in self.kept.items()), read(self.version))

    def _codes(self) -> DataFrame:
        return self._parted(self._codes_of)

    def _pages(self) -> DataFrame:
        return self._parted(self._pages_of)

    def _changes(self, name: str, schema: T.StructType) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(self._file(name) + "/*") if files.children(self.spark, self._file(name)) else None

    def _delta(self) -> DataFrame | None:
        more = "list_id int, idx binary, sgn binary, gamma float, seq bigint"
        found = self._changes("delta", T.StructType([*self._row_schema().fields, *T._parse_datatype_string(more).fields]))
        dead = self._tombstones()
        if found is None or dead is None:
            return found
        return found.join(dead, "id", "left").where(F.col("dead_seq").isNull() | (F.col("seq") > F.col("dead_seq"))).drop("dead_seq")

    def _tombstones(self) -> DataFrame | None:
        found = self._changes("tombstones", T._parse_datatype_string(f"id {self.id_type}, seq bigint"))
        return None if found is None else found.groupBy("id").agg(F.max("seq").alias("dead_seq"))

    def _live(self, lists: list[int] | None = None) -> DataFrame:
        """Rows of the chosen lists that no tombstone hides, without the delta."""
        codes = self._codes()
        codes = codes if lists is None else codes.where(F.col("list_id").isin(lists))
        dead = self._tombstones()
        return codes if dead is None else codes.join(dead, "id", "left_anti")

    def rows(self) -> DataFrame:
        """All live rows: id, vector and attributes."""
        names = self._row_schema().names
        delta = self._delta()
        whole = self._live().select(*names)
        return whole if delta is None else whole.unionByName(delta.select(*names))

    def listed(self) -> DataFrame:
        """``(id, embedding, list_id, attributes...)`` of all live rows."""
        names, delta = ("id", "embedding", "list_id", *self.attribute_types), self._delta()
        whole = self._live().select(*names)
        return whole if delta is None else whole.unionByName(delta.select(*names))

    def _once(self, name: str, read: Callable[[DataFrame], object]) -> object:
        """What a small table of this version has; read once, as a version never changes."""
        key = (self.version, name)
        if key not in self.memo:
            self.memo[key] = read(self.spark.read.parquet(self._file(name)))
        return self.memo[key]

    def centroids(self) -> np.ndarray | None:
        """One row a list, None for a flat index."""

        def read(table: DataFrame) -> np.ndarray | None:
            kept = table.orderBy("list_id").collect()
            return np.asarray([r[1] for r in kept]) if kept else None

        return self._once("centroids", read)  # type: ignore[return-value]

    def lists(self) -> list[tuple[int, int, int]]:
        """``(list, live, pages)``, at most as many as the index has lists."""
        return self._once("lists", lambda t: sorted(tuple(r) for r in t.select("list_id", "live_count", "page_count").collect()))  # type: ignore[return-value]

    # ------------------------------------------------------------------ search
    def _query(self, query: Sequence[float]) -> np.ndarray:
        q = np.asarray(query, np.float64)
        if len(q) != self.dimension:
            raise ValueError(f"expected {self.dimension} dimensions, not {len(q)}")
        if self.options.input_kind == "halfvec":
            q = V.half_numpy(q).astype(np.float64)
        if self.options.normalized:
            length = float(np.sqrt((q**2).sum()))
            if abs(length - 1) > V.UNIT_TOLERANCE:
                raise ValueError("a query must be of length one, as the index is for normalized vectors")
            q = q / length
        return self.codec.rotate(q[None, :])[0]

    def _matching_pages(self, filters: dict) -> DataFrame:
        """Pages whose ranges don't rule the filters out."""
        pages = self._pages()
        for name, value in filters.items():
            if value is None:
                pages = pages.where(F.col(f"{name}_null_any"))
                continue
            values = [v for v in (value if isinstance(value, (list, tuple, set)) else [value]) if v is not None]
            inside = F.lit(False)
            for v in values:
                inside = inside | ((F.col(f"{name}_min") <= F.lit(v)) & (F.col(f"{name}_max") >= F.lit(v)))
            pages = pages.where(~F.col(f"{name}_null_all") & inside)
        return pages.select("list_id", "page_id")

    def _matching_counts(self, filters: dict | None) -> dict[int, int] | None:
        """Pages by list that stored filters don't rule out, at most as many as the index has lists; None without such filters."""
        stored = {k: v for k, v in (filters or {}).items() if k in self.attribute_types}
        return {r[0]: r[1] for r in self._matching_pages(stored).groupBy("list_id").count().collect()} if stored else None

    def _choose(self, rotated: np.ndarray, knobs: QueryKnobs, matching: dict[int, int] | None) -> tuple[list[int], list[budget.ListStats]]:
        """The lists that a search reads, in rank order, and what is known of all lists."""
        centroids = self.centroids()
        if centroids is None:
            return [0], []
        of = {c[0]: c for c in self.lists()}
        ranked = [budget.ListStats(i, s, of.get(i, (i, 0, 0))[1], of.get(i, (i, 0, 0))[2]) for i, s in router.rank_lists(rotated, centroids)]
        if not budget.adaptive(len(centroids), knobs.max_visited_codes, knobs.max_visited_pages):
            return [e.list_id for e in ranked[: knobs.probes]], ranked
        if matching is not None:
            ranked = [replace(e, live=budget.filtered_live(e.live, e.pages, matching.get(e.list_id, 0)), pages=matching.get(e.list_id, 0)) for e in ranked]
        return budget.cost_aware_probes(ranked, knobs.probes, knobs.max_visited_codes, knobs.max_visited_pages), ranked

    def plan(self, rotated: np.ndarray, knobs: QueryKnobs, filters: dict | None = None) -> tuple[list[int], ScanStats]:
        """The lists that a search reads, in rank order, and what it is to look at."""
        counts = self.lists()
        total_live, total_pages = sum(c[1] for c in counts), sum(c[2] for c in counts)
        if self.centroids() is None:
            stats = ScanStats(selected_lists=[0], selected_live_count=total_live, selected_page_count=total_pages, visited_code_count=total_live, visited_page_count=total_pages)
            stats.candidate_capacity = budget.candidate_capacity(knobs.probes, knobs.oversample_factor)
            return [0], stats
        bounded = budget.adaptive(len(self.centroids()), knobs.max_visited_codes, knobs.max_visited_pages)
        chosen, ranked = self._choose(rotated, knobs, self._matching_counts(filters) if bounded else None)
        picked = {e.list_id: e for e in ranked if e.list_id in set(chosen)}
        live, pages = sum(e.live for e in picked.values()), sum(e.pages for e in picked.values())
        stats = ScanStats("ivf", "decoded", knobs.probes, chosen, live, pages, knobs.max_visited_codes, knobs.max_visited_pages, live, pages)
        stats.candidate_capacity = budget.candidate_capacity(knobs.probes, knobs.oversample_factor)
        stats.near_exhaustive = budget.near_exhaustive(live, total_live, pages, total_pages)
        return chosen, stats

    def _scored(self, rows: DataFrame, rotated: np.ndarray, keep: int, by_code: bool, bound: tuple[str, ...]) -> DataFrame:
        """``(id, score, bound...)``; each batch passes on its best ``keep`` rows."""
        source = rows.select("id", *CODE_COLUMNS, *(b for b in bound if b not in CODE_COLUMNS))
        fields = {f.name: f for f in source.schema.fields}
        schema = T.StructType([fields["id"], T.StructField("score", T.DoubleType()), *(fields[b] for b in bound)])
        arrow, codec, metric = _arrow(schema), self.codec, self.options.metric

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes, signs = codec.unpack(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                gamma = batch.column(3).to_numpy(zero_copy_only=False)
                scores = score_codes(codec, metric, rotated, codes, signs, gamma, by_code)
                if len(scores) > keep:  # ties at the border stay, so ids decide between them later
                    inside = np.flatnonzero(scores <= np.partition(scores, keep - 1)[keep - 1])
                    batch, scores = batch.take(pa.array(inside)), scores[inside]
                yield _with(batch, arrow, score=pa.array(scores))

        return source.mapInArrow(score, schema)

    def search(self, query: Sequence[float], k: int, knobs: QueryKnobs | None = None, filters: dict | None = None, payload: Sequence[str] = ()) -> tuple[DataFrame, ScanStats]:
        """The approximate best rows ``(id, score, payload...)`` by score and id, and the scan's statistics.

        At most probes times oversample factor rows come back, whatever k is. Filters on stored attributes act
        before ranking. Cosine and l2 compare with the decoded vector, inner products with the estimator.
        """
        knobs = knobs or QueryKnobs()
        if not self.dimension:
            return self.spark.createDataFrame([], f"id {self.id_type}, score double"), ScanStats()
        rotated = self._query(query)
        chosen, stats = self.plan(rotated, knobs, filters)
        condition = filter_column(filters)
        delta = self._delta()
        names = ("id", *CODE_COLUMNS, *self.attribute_types)
        capacity = stats.candidate_capacity
        rescore = knobs.decode_rescore_factor > 1 and self.options.normalized and self.options.metric in ("cosine", "ip")
        by_code = rescore or self.options.metric == "ip" and not knobs.force_decode_score_diagnostics
        stats.score_mode = "code_domain" if by_code else "decoded"

        def rows_of(lists: list[int] | None) -> DataFrame:
            rows = self._live(lists)
            stored = {n: v for n, v in (filters or {}).items() if n in self.attribute_types}
            if stored and stats.mode == "ivf" and not stats.near_exhaustive:
                rows = rows.join(self._matching_pages(stored), ["list_id", "page_id"], "left_semi")
            rows = rows.select(*names)
            if delta is not None:
                rows = rows.unionByName(delta.select(*names))
            return rows if condition is None else rows.where(condition)

        if stats.mode == "ivf" and condition is not None and knobs.iterative_scan != "off" and knobs.min_rows_after_filter > 0:
            chosen = self._completed(chosen, condition, knobs, stats)
        lists = chosen if stats.mode == "ivf" else None
        bound = tuple(dict.fromkeys((*payload, *(CODE_COLUMNS if rescore else ()))))
        keep = capacity * (knobs.decode_rescore_factor if rescore else 1)
        found = self._scored(rows_of(lists), rotated, keep, by_code, bound).orderBy("score", "id").limit(keep)
        if rescore:
            found = self._scored(found.drop("score"), rotated, capacity, False, tuple(payload)).orderBy("score", "id").limit(capacity)
        return found.orderBy("score", "id").limit(min(k, capacity)), stats

    def page_bounds(self, rotated: np.ndarray) -> DataFrame:
        """``(list_id, page_id, best)``: no code of the page has a larger estimated inner product.

        A page's rows lie within its radius of its first row, and an inner product changes by at most
        the query's length times that distance.
        """
        pages = self._pages().select("list_id", "page_id", *(F.col(f"first_{c}").alias(c) for c in CODE_COLUMNS), "radius")
        codec, length = self.codec, float(np.sqrt((rotated**2).sum()))

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    codes, signs = codec.unpack(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                    base, sketch = codec.estimate(rotated, codes, signs, batch.column(4).to_numpy(zero_copy_only=False))
                    radius = batch.column(5).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base + sketch + length * radius + 1e-6)], ["list_id", "page_id", "best"])

        return pages.mapInArrow(bound, "list_id int, page_id bigint, best double")

    def search_pruned(self, query: Sequence[float], k: int, first_pages: int = 16) -> tuple[DataFrame, ScanStats]:
        """As an inner-product ``search`` of all lists, in two passes over pages.

        The first scores the pages of the best bounds and so learns a score that the k-th best has at least; the
        second scores only pages whose bound reaches it. The delta is scored in both.
        """
        if self.options.metric != "ip" or not self.options.normalized:
            raise ValueError("page bounds hold for normalized inner products only")
        rotated = self._query(query)
        bounds = self.page_bounds(rotated)
        names = ("id", *CODE_COLUMNS)
        delta = self._delta()

        def best(pages: DataFrame) -> DataFrame:
            rows = self._live().join(pages.select("list_id", "page_id"), ["list_id", "page_id"], "left_semi").select(*names)
            rows = rows if delta is None else rows.unionByName(delta.select(*names))
            return self._scored(rows, rotated, k, True, ()).orderBy("score", "id").limit(k)

        known = best(bounds.orderBy(F.col("best").desc(), "list_id", "page_id").limit(first_pages)).agg(F.count("*"), F.max("score")).first()
        kept = bounds if known[0] < k else bounds.where(F.col("best") >= F.lit(-known[1] - 1e-6))
        stats = ScanStats("ivf" if self.options.lists else "flat", "code_domain", candidate_capacity=k, visited_page_count=kept.count())
        return best(kept), stats

    def decoded(self) -> DataFrame:
        """``(id, embedding)`` of all live rows, as their codes have them, in the space of the original vectors."""
        names = ("id", *CODE_COLUMNS)
        delta = self._delta()
        rows = self._live().select(*names)
        rows = rows if delta is None else rows.unionByName(delta.select(*names))
        schema = T.StructType([rows.schema["id"], T.StructField("embedding", T.ArrayType(T.DoubleType()))])
        arrow, codec = _arrow(schema), self.codec

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    codes, signs = codec.unpack(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                    x = rotate_back(codec.decode(codes, signs, batch.column(3).to_numpy(zero_copy_only=False)), codec.dimension, codec.seed)
                    ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                    yield _with(batch, arrow, embedding=pa.ListArray.from_arrays(ends, pa.array(x.ravel())))

        return rows.mapInArrow(decode, schema)

    def search_batch(self, queries: DataFrame, k: int, query_id: str = "qid", query_emb: str = "embedding", knobs: QueryKnobs | None = None, filters: dict | None = None) -> DataFrame:
        """``(qid, id, distance, rank)`` of many queries by their codes, as ``search`` has them one by one.

        Without knobs all codes are compared. With knobs each query has the lists, budgets and candidate capacity that it
        would have alone: a block of queries is routed, only lists that one of it probes are read, and
        a batch of codes meets only the queries that probe its list. Filters act before ranking; all queries meet the
        delta. Null queries are left out.
        """
        wanted = queries.where(F.col(query_emb).isNotNull()).select(query_id, query_emb)
        if not self.dimension:
            return self.spark.createDataFrame([], f"qid {queries.schema[query_id].dataType.simpleString()}, id {self.id_type}, distance double, rank bigint")
        if knobs is None and not filters:
            return batch_knn(self.decoded(), wanted, k, self.options.metric, "id", "embedding", query_id, query_emb)
        knobs = knobs or QueryKnobs(probes=max(1, self.options.lists), oversample_factor=1024)
        condition = filter_column(filters)
        matching = self._matching_counts(filters)
        names = ("id", "list_id", *CODE_COLUMNS, *self.attribute_types)
        delta, parts = self._delta(), []
        if delta is not None:
            delta = delta.withColumn("list_id", F.lit(DELTA_LIST)).select(*names)
        for block in query_blocks(wanted):
            rotated = np.asarray([self._query(v) for _, v in block])
            chosen = [self._choose(q, knobs, matching)[0] for q in rotated]
            every = sorted({i for lists in chosen for i in lists})
            rows = self._live(every if self.options.lists else None).select(*names)
            if delta is not None:
                rows = rows.unionByName(delta)
                chosen = [[*lists, DELTA_LIST] for lists in chosen]
            rows = rows if condition is None else rows.where(condition)
            keep = min(k, budget.candidate_capacity(knobs.probes, knobs.oversample_factor))
            parts.append(self._scored_block(rows, [i for i, _ in block], rotated, chosen, keep, queries.schema[query_id].dataType.simpleString()))
            if len(parts) > 1:  # many blocks: each is done with before the next begins, so the driver holds one
                parts[-1] = files.settle(parts[-1], "block")
        if not parts:
            return self.spark.createDataFrame([], f"qid {queries.schema[query_id].dataType.simpleString()}, id {self.id_type}, distance double, rank bigint")
        found = reduce(DataFrame.unionByName, parts)
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
        keep = min(k, budget.candidate_capacity(knobs.probes, knobs.oversample_factor))
        return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= keep)

    def _scored_block(self, rows: DataFrame, ids: list, rotated: np.ndarray, chosen: list[list[int]], keep: int, kind: str) -> DataFrame:
        """``(qid, id, distance)``: a task's best ``keep`` rows of each query, of the lists that the query probes."""
        codec = self.codec

        def decoded(part: pa.RecordBatch) -> np.ndarray:
            codes, signs = codec.unpack(part.column(2).to_pylist(), part.column(3).to_pylist())
            return codec.decode(codes, signs, part.column(4).to_numpy(zero_copy_only=False))

        return nearest_in_lists(rows.select("id", "list_id", *CODE_COLUMNS), ids, rotated, chosen, keep, self.options.metric, kind, decoded)

    def _completed(self, chosen: list[int], condition, knobs: QueryKnobs, stats: ScanStats) -> list[int]:
        """As many of the ranked lists, in order, as give the wanted number of rows; one count by list."""
        counts = {r[0]: r[1] for r in self._live(chosen).where(condition).groupBy("list_id").count().collect()}
        taken, rows = [], 0
        for i in chosen:
            taken.append(i)
            rows += counts.get(i, 0)
            if rows >= knobs.min_rows_after_filter:
                break
        stats.selected_lists = taken
        return taken

    def completed(self, found: DataFrame, query: Sequence[float], k: int, lists: Sequence[int] | None = None, filters: dict | None = None, metric: str | None = None) -> DataFrame:
        """``(id)``: rows among which the k nearest are for certain, of the lists given or of all, with those that match the filters.

        Codes alone can't tell rows apart that are nearer to each other than their error, so a search's bounded set of
        candidates may lack some of the nearest. The exact distance of the k-th of ``found`` is one that the k nearest keep to,
        and the code of a row says how near it can be at most: rows that can't reach that distance are left out, others
        are not, however many. The bounds hold for vectors of length one; of others all rows are taken.
        """
        metric, condition, names = metric or self.options.metric, filter_column(filters), ("id", *CODE_COLUMNS, *self.attribute_types)
        delta, rows = self._delta(), self._live(None if lists is None else list(lists)).select(*names)
        rows = rows if delta is None else rows.unionByName(delta.select(*names))
        rows = rows if condition is None else rows.where(condition)
        known = exact_rerank(self.rows(), found, query, k, metric).agg(F.count("*"), F.max("distance")).first()
        if known[0] < k or not self.options.normalized:
            return rows.select("id")
        asked, border = np.asarray(query, np.float64), known[1] + BOUND_SLACK
        length = float(np.sqrt((asked**2).sum()))
        least = {"cosine": (1 - border) * length, "ip": -border, "l2": (length**2 + 1 - border**2) / 2}[metric] - BOUND_SLACK
        rotated, codec, arrow = self.codec.rotate(asked[None, :])[0], self.codec, _arrow(T.StructType([rows.schema["id"]]))

        def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    codes, signs = codec.unpack(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                    most = codec.most(rotated, codes, signs, batch.column(3).to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.flatnonzero(most >= least)))], schema=arrow)

        return rows.select("id", *CODE_COLUMNS).mapInArrow(reaching, T.StructType([rows.schema["id"]]))

    def candidates(self, query: Sequence[float], candidates: int, final: int | None = None, filters: dict | None = None, knobs: QueryKnobs | None = None) -> DataFrame:
        """``(candidate_id, approximate_rank, approximate_distance)`` of the nearest rows in the lists that the index reads; distances are of their vectors.

        As many as asked for, up to the capacity of a search. Knobs that aren't given follow from the two limits.
        """
        knobs = knobs or QueryKnobs(**budget.resolve_knobs(candidates, final or candidates))
        found, stats = self.search(query, candidates, knobs, filters)
        if self.dimension:
            candidates = min(candidates, stats.candidate_capacity)
            found = self.completed(found, query, candidates, stats.selected_lists if stats.mode == "ivf" else None, filters)
        return ranked_candidates(exact_rerank(self.rows(), found, query, candidates, self.options.metric))

    def rerank(self, query: Sequence[float], candidates: int, final: int, filters: dict | None = None, knobs: QueryKnobs | None = None) -> DataFrame:
        """Candidates with ``exact_rank`` and ``exact_distance``, the final best by the rounded distance and id, ranked by distance and text id.

        The index finds an effective number of candidates; the exact distance is computed from the vectors of the live rows.
        """
        told = knobs or QueryKnobs(**budget.resolve_knobs(candidates, final))
        limit = budget.effective_limit(candidates, final, told.decode_rescore_factor, told.decode_rescore_extra_candidates)
        found = self.candidates(query, limit, filters=filters, knobs=replace(told, oversample_factor=max(told.oversample_factor, math.ceil(limit / told.probes))))
        vectors = self.rows().select(F.col("id").cast("string").alias("candidate_id"), "embedding")
        exact = V.rounded(V.distance(self.options.metric, F.col("embedding"), V.vector(query)))
        joined = found.join(vectors, "candidate_id").withColumn("exact_distance", exact).drop("embedding")
        # ranks of candidates go by distance and id, so of equal distances the least ids stay
        kept = joined.orderBy("exact_distance", "approximate_rank").limit(final)
        return kept.withColumn("exact_rank", F.row_number().over(Window.orderBy("exact_distance", "candidate_id")).cast("long"))

    # ------------------------------------------------------------------ writes
    def _next_seq(self) -> int:
        """A number above all that were taken. It is taken by making its folder, which only one writer can."""
        while True:
            taken = [int(n.removeprefix("seq=")) for n in files.children(self.spark, self._file("taken"))]
            seq = max(taken, default=0) + 1
            if files.make_new(self.spark, self._file(f"taken/seq={seq:06d}")):
                return seq

    def insert(self, df: DataFrame, id_col: str = "id", emb_col: str = "embedding") -> None:
        """Append rows to the delta. An index without rows takes its dimension from them and is built anew."""
        rows = df.select(F.col(id_col).alias("id"), F.col(emb_col).cast("array<float>").alias("embedding"), *self.options.attributes).where("embedding is not null")
        if not self.dimension:
            first = rows.select(F.size("embedding")).first()
            if first:
                self.dimension, self.version = first[0], self._free_version()
                self._write_version(self._prepared(rows))
            return
        seq = self._next_seq()
        self._encoded(self._prepared(rows), self.centroids()).withColumn("seq", F.lit(seq).cast("long")).write.parquet(self._file(f"delta/seq={seq:06d}"))

    def delete(self, ids: DataFrame, id_col: str = "id") -> None:
        """Hide the rows of these ids, as far as they are there now."""
        seq = self._next_seq()
        ids.select(F.col(id_col).cast(self.id_type).alias("id"), F.lit(seq).cast("long").alias("seq")).write.parquet(self._file(f"tombstones/seq={seq:06d}"))

    def upsert(self, df: DataFrame, id_col: str = "id", emb_col: str = "embedding") -> None:
        self.delete(df, id_col)
        self.insert(df, id_col, emb_col)

    def merge(self) -> dict:
        """Write the next version, with the same centroids and anew only the lists that have dead rows or rows in the delta."""
        health = self.list_health().collect() if self.dimension else []
        touched = sorted(r["list_id"] for r in health if r["delta"] or r["dead"])
        names, delta, centroids = self._row_schema().names, self._delta(), self.centroids() if self.dimension else None
        rows = self._live(touched).select(*names)
        rows = rows if delta is None else rows.unionByName(delta.select(*names))
        older = {**self.kept, self.version: [r[0] for r in self.lists()] if self.dimension else []}
        for version, lists in self.kept.items():
            older[self.version] = [i for i in older[self.version] if i not in set(lists)]
        kept = {v: left for v, lists in older.items() if (left := [i for i in lists if i not in set(touched)])}
        lists_kept = [r for r in self.lists() if r[0] not in set(touched)] if self.dimension else []
        old, self.version = self.version, self._free_version()
        try:
            self._write_version(rows, centroids, kept, lists_kept)
        except Exception:
            self.version = old
            raise
        return {"merged": sum(r["delta"] for r in health), "removed": sum(r["dead"] for r in health), "rewritten_lists": len(touched), "version": self.version}

    def _free_version(self) -> int:
        """A number above all versions' folders, also those that a writer left without committing them."""
        return 1 + max(int(n[1:]) for n in files.children(self.spark, self.path) if n[:1] == "v" and n[1:].isdigit())

    def remove_old(self) -> list[int]:
        """Delete the folders of versions that this one doesn't read, and their metadata; readers of older versions must have ended."""
        gone = []
        for name in files.children(self.spark, self.path):
            number = name[1:] if name[:1] == "v" else name.removeprefix("meta-").removesuffix(".json")
            if number.isdigit() and int(number) < self.version and (name[:1] != "v" or int(number) not in self.kept):
                files.remove(self.spark, f"{self.path}/{name}")
                gone += [int(number)] if name[:1] == "v" else []
        return sorted(gone)

    def maintain(self, knobs: MaintenanceKnobs | None = None) -> dict:
        """Merge the delta if there is one, and drop dead rows with it."""
        before = self.metadata(knobs)
        acts = [name for name, due in (("merge_delta", before["delta_live_count"] > 0), ("compact", before["dead_count"] > 0)) if due]
        merged = self.merge() if acts else {}
        after = self.metadata(knobs)
        return {"action": "_and_".join(acts) or "noop", "before": before["maintenance_action_recommended"], "after": after["maintenance_action_recommended"], **merged}

    # ------------------------------------------------------------------ introspection
    def list_health(self) -> DataFrame:
        """``(list_id, live, dead, delta, pages, reclaimable_pages)`` of each list that has rows; a page whose rows are all dead is reclaimable."""
        pages = self._pages().select("list_id", "page_id", "live_count")
        tombstones, delta = self._tombstones(), self._delta()
        gone = F.lit(0).cast("long")
        if tombstones is not None:
            dead = self._codes().select("id", "list_id", "page_id").join(tombstones, "id", "left_semi").groupBy("list_id", "page_id").agg(F.count("*").alias("gone"))
            pages, gone = pages.join(dead, ["list_id", "page_id"], "left"), F.coalesce("gone", F.lit(0))
        lists = pages.groupBy("list_id").agg(
            F.sum(F.col("live_count") - gone).alias("live"), F.sum(gone).alias("dead"), F.count("*").alias("pages"), F.sum((gone == F.col("live_count")).cast("long")).alias("reclaimable_pages")
        )
        if delta is None:
            return lists.select("list_id", "live", "dead", F.lit(0).cast("long").alias("delta"), "pages", "reclaimable_pages")
        fresh = delta.groupBy("list_id").agg(F.count("*").alias("delta"))
        none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return lists.join(fresh, "list_id", "full").select("list_id", *map(none, ("live", "dead", "delta", "pages", "reclaimable_pages")))

    def metadata(self, knobs: MaintenanceKnobs | None = None) -> dict:
        """Format, options, router, list distribution, delta health and what upkeep is advised."""
        lists = self.list_health().collect() if self.dimension else []
        total = lambda name: sum(r[name] for r in lists)
        delta_live, delta_lists, dead, pages = total("delta"), sum(r["delta"] > 0 for r in lists), total("dead"), total("pages")
        lanes = lane_count(self.codec.code_bytes, len(self.options.attributes)) if self.dimension else 16
        delta_pages = math.ceil(delta_live / lanes)
        live, reclaimable = total("live") + delta_live, total("reclaimable_pages")
        return {
            "format_version": FORMAT_VERSION, "version": self.version, "metric": self.options.metric, "options": self.options.as_dict(), "dimension": self.dimension,
            "transform": {"kind": "hadamard", "output_dimension": self.codec.size if self.dimension else 0}, "code_bytes": self.codec.code_bytes if self.dimension else 0,
            "list_count": self.options.lists, "router": self.router, "live_count": live, "dead_count": dead, "page_count": pages + delta_pages, "reclaimable_pages": reclaimable,
            "list_distribution": list_distribution([r["live"] + r["dead"] for r in lists], self.options.lists), "delta_live_count": delta_live,
            "delta_health": {"lists": delta_lists, "page_depth": delta_pages, "delta_page_depth": delta_pages},
            "maintenance_action_recommended": budget.maintenance_action(live, delta_live, delta_pages, dead, reclaimable, knobs or MaintenanceKnobs()),
            "capabilities": {"ordered_scan": True, "bitmap_filter": True, "index_only_scan": True, "parallel_scan": True, "multicolumn": bool(self.options.attributes), "unique": False},
        }


def attribute_ranges(names: Sequence[str]) -> list[Column]:
    """Aggregates by which a group of rows can be ruled out: least, greatest, any null, all null, one value throughout."""
    parts = []
    for name in names:
        null, low, high = F.col(name).isNull(), F.min(name), F.max(name)
        parts += [low.alias(f"{name}_min"), high.alias(f"{name}_max"), F.max(null).alias(f"{name}_null_any"), F.min(null).alias(f"{name}_null_all")]
        parts.append((low.eqNullSafe(high) & ~F.max(null)).alias(f"{name}_all_same"))
    return parts


def assign_lists(rows: DataFrame, centroids: np.ndarray, emb_col: str = "embedding") -> DataFrame:
    """Adds ``list_id``, the nearest centroid by squared distance, of equals the lowest. Centroids go to all tasks."""
    schema = T.StructType([*rows.schema.fields, T.StructField("list_id", T.IntegerType())])
    arrow, place, shared = _arrow(schema), rows.columns.index(emb_col), rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _with(batch, arrow, list_id=router.assign(_matrix(batch.column(place)), shared.value).astype(np.int32))

    return rows.mapInArrow(assign, schema)


def score_codes(codec: Codec, metric: str, query: np.ndarray, codes: np.ndarray, signs: np.ndarray, gamma: np.ndarray, by_code: bool) -> np.ndarray:
    """Distances of codes to a rotated query, smaller is nearer; ``by_code`` uses the inner-product estimator alone."""
    if by_code:
        base, sketch = codec.estimate(query, codes, signs, gamma)
        return (1 if metric == "cosine" else 0) - (base + sketch)
    decoded = codec.decode(codes, signs, gamma)
    inner = decoded @ query
    if metric == "ip":
        return -inner
    if metric == "l2":
        return np.maximum((query**2).sum() + (decoded**2).sum(1) - 2 * inner, 0)
    scale = np.sqrt((query**2).sum()) * np.sqrt((decoded**2).sum(1))
    return np.where(scale > 0, 1 - np.clip(inner / np.where(scale > 0, scale, 1), -1, 1), 1.0)


def list_distribution(sizes: list[int], lists: int) -> dict:
    """Least, greatest, mean, nearest-rank 95 % and unevenness of list sizes; lists without rows count as 0."""
    if not lists:
        return {}
    counts = np.sort(np.asarray([*sizes, *[0] * (lists - len(sizes))]))
    mean = counts.mean()
    return {
        "min_live_count": int(counts[0]), "max_live_count": int(counts[-1]), "avg_live_count": round(float(mean), 2), "p95_list_size": int(counts[math.ceil(0.95 * lists) - 1]),
        "coeff_var": round(float(counts.std() / mean), 4) if mean else 0.0, "max_list_over_avg": round(float(counts[-1] / mean), 4) if mean else 0.0,
    }
