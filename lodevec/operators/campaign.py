"""Retrieval campaigns: scenario plans, runs over query sets, an answer stage, gates, leaders and footprints."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.functions import text as X
from lodevec.operators import evaluate, knn, router
from lodevec.operators.index import VectorIndex
from lodevec.plans.options import QueryKnobs
from lodevec.sources import files, reports

#: The systems of a campaign: three ways to find candidates, each as they come and after exact distances of a deeper set.
#: ``quantized`` compares codes, ``float_lists`` probes k-means lists of plain vectors, ``exact`` compares all vectors.
METHODS, STAGES = ("quantized", "float_lists", "exact"), ("approx", "rerank")
SYSTEMS = tuple(f"{m}_{s}" for m in METHODS for s in STAGES)
KINDS = ("retrieval_only", "end_to_end")
RERANK_MULTIPLE, RERANK_LEAST = 64, 1024


def plan(spark: SparkSession, datasets: Sequence[str], systems: Sequence[str] = SYSTEMS) -> DataFrame:
    """Each dataset with each system and each kind of result: ``(dataset, system_id, result_kind, scenario_id)``. Small by its making."""
    rows = [(d, s, k, f"{d}:{s}:{k}") for d in datasets for s in systems for k in KINDS]
    return spark.createDataFrame(rows, "dataset string, system_id string, result_kind string, scenario_id string")


def check_request(index: VectorIndex, metric: str, system: str, top_k: int, depth: int) -> None:
    """Raises where an index can't answer what a scenario asks for."""
    if metric != index.options.metric:
        raise ValueError(f"the index is built for {index.options.metric}, not {metric}")
    if system not in SYSTEMS:
        raise ValueError(f"unknown system {system!r}")
    if top_k < 1 or depth < top_k:
        raise ValueError("the rerank depth must be at least top_k, and that at least 1")
    if metric == "ip" and not index.options.normalized:
        raise ValueError("inner products need a normalized index")
    if system.startswith("float_lists") and not index.options.lists:
        raise ValueError("float_lists needs an index with lists")


def rerank_depth(system: str, top_k: int, configured: int, live: int | None = None) -> int:
    """Candidates that a system reranks; codes take more, as far as there are rows."""
    if system != "quantized_rerank":
        return configured
    depth = max(configured, RERANK_MULTIPLE * top_k, RERANK_LEAST)
    return min(depth, live) if live else depth


def retrieve(index: VectorIndex, queries: DataFrame, k: int, system: str = "quantized_rerank", depth: int | None = None, knobs: QueryKnobs | None = None, filters: dict | None = None) -> DataFrame:
    """``(qid, retrieved)``, ids as text and best first, for a set of queries ``(qid, embedding)``.

    A reranking system compares the exact distances of ``depth`` candidates, by default as ``rerank_depth`` has it; knobs
    bound what lists are probed, and without them codes are all compared. Queries without a result have no row.
    """
    metric = index.options.metric
    method, stage = system.rsplit("_", 1)
    live = sum(rows for _, rows, _ in index.lists())
    wanted = k if stage == "approx" else max(k, rerank_depth(system, k, k, live) if depth is None else depth)
    if method == "exact":
        found = knn.batch_knn(knn.filtered(index.rows(), filters), queries, wanted, metric)
    elif method == "float_lists":
        found = _probed(index, queries, wanted, metric, (knobs or QueryKnobs()).probes, filters)
    else:
        found = index.search_batch(queries, wanted, knobs=knobs, filters=filters)
    if stage == "rerank":
        found = _exactly(index, queries, found, k, metric)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"))))
    return found.where(F.col("rank") <= k).groupBy("qid").agg(ordered.alias("r")).select("qid", F.transform("r", lambda x: x["id"]).alias("retrieved"))


def _exactly(index: VectorIndex, queries: DataFrame, found: DataFrame, k: int, metric: str) -> DataFrame:
    from pyspark.sql import Window

    from lodevec.functions import vectors as V

    pairs = found.select("qid", "id").join(index.rows().select("id", F.col("embedding").alias("x")), "id")
    pairs = pairs.join(queries.select("qid", F.col("embedding").alias("q")), "qid")
    scored = pairs.select("qid", "id", V.rounded(V.distance(metric, F.col("q"), F.col("x"))).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _probed(index: VectorIndex, queries: DataFrame, k: int, metric: str, probes: int, filters: dict | None = None) -> DataFrame:
    """The k nearest vectors in the ``probes`` lists nearest to each query, by exact distances.

    Queries go out in blocks; a block meets the rows of its lists as a matrix product, and each task passes on only k rows a query.
    """
    from pyspark.sql import Window

    if not index.options.lists:
        raise ValueError("float_lists needs an index with lists")
    codec, unit, centroids = index.codec, index.options.normalized, index.centroids()
    kind = queries.schema["qid"].dataType.simpleString()
    rows = knn.filtered(index.listed(), filters).where("embedding is not null").select("id", "list_id", "embedding")
    parts: list[DataFrame] = []
    for block in knn.query_blocks(queries.where("embedding is not null").select("qid", "embedding")):
        asked = np.asarray([v for _, v in block], np.float64)
        length = np.linalg.norm(asked, axis=1)[:, None]
        rotated = codec.rotate(asked / np.where(length > 0, length, 1) if unit else asked)
        chosen = [[0] if centroids is None else router.first_probes(x, centroids, probes) for x in rotated]
        inside = rows.where(F.col("list_id").isin(sorted({i for lists in chosen for i in lists})))
        parts.append(knn.nearest_in_lists(inside, [q for q, _ in block], asked, chosen, k, metric, kind, _plain_vectors))
        if len(block) == knn.QUERY_BLOCK:  # each block is done with before the next begins, so the driver holds one
            parts[-1] = files.settle(parts[-1], "block")
    if not parts:
        return index.spark.createDataFrame([], f"qid {kind}, id {index.id_type}, distance double, rank bigint")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _plain_vectors(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)


def run_retrieval(
    index: VectorIndex, queries: DataFrame, truth: DataFrame, k: int = 10, system: str = "quantized_rerank", depth: int | None = None, knobs: QueryKnobs | None = None, filters: dict | None = None, timed: int = 0
) -> DataFrame:
    """One row: metrics of a system on queries with ``truth (query_id, relevant, evidence)``, and the queries a second of the whole batch.

    Latencies are those of the first ``timed`` queries, each searched alone, as the queries of a batch have none; with 0 they are null.
    """
    began = time.perf_counter()
    found = files.settle(retrieve(index, queries, k, system, depth, knobs, filters), "retrieved")
    spent = time.perf_counter() - began
    alone = index.spark.createDataFrame(_alone(index, queries, k, system, depth, knobs, filters, timed), f"query_id {queries.schema['qid'].dataType.simpleString()}, latency_ms double")
    rows = found.withColumnRenamed("qid", "query_id").join(truth, "query_id").join(alone, "query_id", "left")
    told = {"system_id": F.lit(system), "index_bytes": F.lit(footprint(index)), "batch_qps": F.round(F.col("query_count") / F.lit(max(spent, 1e-9)), 3)}
    return index.spark.createDataFrame(*(lambda f: (f.collect(), f.schema))(evaluate.retrieval_metrics(rows, k).withColumns(told)))


def _alone(index: VectorIndex, queries: DataFrame, k: int, system: str, depth: int | None, knobs: QueryKnobs | None, filters: dict | None, timed: int) -> list[tuple]:
    """``(qid, milliseconds)`` of the first queries by id, one search each."""
    out = []
    for qid, vector in queries.where("embedding is not null").orderBy("qid").limit(timed).select("qid", "embedding").collect() if timed else ():
        began = time.perf_counter()
        if system.startswith("exact"):
            knn.exact_knn(index.rows(), vector, k, index.options.metric, filters=filters).collect()
        elif system == "quantized_approx":
            index.search(vector, k, knobs, filters)[0].collect()
        elif system == "quantized_rerank":
            index.rerank(vector, depth or k, k, filters, knobs).collect()
        else:
            one = queries.where(F.col("qid") == qid)
            retrieve(index, one, k, system, depth, knobs, filters).collect()
        out.append((qid, (time.perf_counter() - began) * 1000))
    return out


def run_metadata(index: VectorIndex, system: str, k: int, depth: int | None = None, knobs: QueryKnobs | None = None, filters: dict | None = None, payload: Sequence[str] = ()) -> dict:
    """What a run was made with: method and stage, index options, knobs, filters, the delta, and whether the payload covers the answer."""
    method, stage = system.rsplit("_", 1)
    meta = index.metadata()
    knobs = knobs or QueryKnobs()
    chosen = {n: sorted(v, key=str) if isinstance(v, (list, tuple, set)) else v for n, v in (filters or {}).items()}
    return {
        "system_id": system, "method": method, "stage": stage, "metric": index.options.metric, "mode": "ivf" if index.options.lists else "flat", "top_k": k,
        "rerank_depth": None if stage == "approx" else rerank_depth(system, k, depth or k, meta["live_count"]), "knobs": dict(knobs.__dict__), "filters": chosen,
        "filters_in_index": sorted(set(chosen) & set(index.attribute_types)), "index": {"version": index.version, "bits": index.options.bits, "lists": index.options.lists, "format_version": meta["format_version"]},
        "delta": {"live_count": meta["delta_live_count"], "dead_count": meta["dead_count"], "action": meta["maintenance_action_recommended"]},
        "payload": list(payload), "covering": set(payload) <= set(index.attribute_types),
    }


@dataclass
class Dataset:
    """What a campaign needs of a dataset: an index, queries ``(qid, embedding)``, truth, and for answers questions and references."""

    index: VectorIndex
    queries: DataFrame
    truth: DataFrame
    questions: DataFrame | None = None  # (query_id, question)
    passages: DataFrame | None = None  # (id, text)
    references: DataFrame | None = None  # (query_id, references)


def run(
    datasets: dict[str, Dataset], systems: Sequence[str] = SYSTEMS, k: int = 10, depth: int | None = None, knobs: QueryKnobs | None = None, timed: int = 0,
    generator: Callable[[str], str] | None = None, generator_id: str = "none", system_prompt: str = "", max_contexts: int = 5,
) -> dict[str, DataFrame]:
    """The tables of a campaign: retrieval, diagnostics, what reranking changes, comparisons with exact search, leaders, and answers with a generator.

    Every table has a row a dataset and system, so they are small; retrieval itself runs as one batch for each.
    """
    spark = next(iter(datasets.values())).index.spark
    retrieval, diagnostics, answers = [], [], []
    for name, d in datasets.items():
        truth = files.settle(d.truth, "truth")  # often a search of all vectors, which every system is held against
        for system in systems:
            check_request(d.index, d.index.options.metric, system, k, max(k, depth or k))
            tag = {"dataset": F.lit(name), "system_id": F.lit(system)}
            retrieval.append(run_retrieval(d.index, d.queries, truth, k, system, depth, knobs, timed=timed).withColumns(tag))
            diagnostics.append((name, system, *_diagnosed(d, system, knobs)))
            if generator is not None and d.questions is not None and d.passages is not None and d.references is not None:
                found = retrieve(d.index, d.queries, k, system, depth, knobs).select(F.col("qid").cast("string").alias("query_id"), F.posexplode("retrieved").alias("place", "id"))
                texts = found.join(d.passages.select(F.col("id").cast("string").alias("id"), "text"), "id")
                contexts = texts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "text"))).alias("c"))
                cache = d.questions.select(F.col("query_id").cast("string").alias("query_id"), "question").join(contexts, "query_id")
                said = files.settle(answer(cache.select("query_id", "question", F.transform("c", lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text"))).alias("contexts")), generator, system_prompt, max_contexts), "answers")
                scores = answer_scores(said, d.references.withColumn("query_id", F.col("query_id").cast("string")))
                means = said.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("prompt_tokens", "context_tokens")), F.round(F.avg("generator_latency_ms"), 3).alias("generator_ms"))
                answers.append(scores.withColumn("one", F.lit(1)).join(means.withColumn("one", F.lit(1)), "one").drop("one").withColumns({**tag, "generator_id": F.lit(generator_id)}))
    rows = files.settle(reduce(DataFrame.unionByName, retrieval), "campaign")
    kinds = "dataset string, system_id string, mode string, score_mode string, probes double, visited_code_fraction double, visited_page_fraction double"
    best = [df.select("dataset", F.lit(metric).alias("metric"), "system_id", F.col(metric).cast("double").alias("value")) for metric, df in zip(("recall", "p95_ms", "index_bytes"), outcome(rows).values(), strict=True)]
    tables = {
        "retrieval": reports.shaped(rows, "retrieval"),
        "diagnostics": reports.shaped(spark.createDataFrame(diagnostics, kinds), "diagnostics"),
        "two_stage": reports.two_stage(rows),
        "comparisons": reports.shaped(evaluate.comparisons(rows, ["recall", "ndcg", "mrr", "batch_qps"], ["exact_approx"]), "comparisons"),
        "leaders": reports.shaped(reduce(DataFrame.unionByName, best), "leaders"),
    }
    if answers:
        tables["answers"] = reports.shaped(reduce(DataFrame.unionByName, answers), "answers")
    return tables


def _diagnosed(d: Dataset, system: str, knobs: QueryKnobs | None) -> tuple:
    """Mode, score mode, probes and visited shares of a system, as the first query's search plans them."""
    first = d.queries.where("embedding is not null").orderBy("qid").select("embedding").first()
    live, pages = (sum(c[n] for c in d.index.lists()) for n in (1, 2))
    if first is None or system.startswith("exact"):
        return "flat", "exact", 0.0, 1.0, 1.0
    stats = d.index.search(first[0], 1, knobs)[1]
    if system.startswith("quantized") and knobs is None:
        return stats.mode, stats.score_mode, float(d.index.options.lists or 1), 1.0, 1.0
    share = lambda part, whole: round(part / whole, 6) if whole else 0.0
    mode = "exact" if system.startswith("float_lists") else stats.score_mode
    return stats.mode, mode, float(len(stats.selected_lists)), share(stats.visited_code_count, live), share(stats.visited_page_count, pages)


def footprint(index: VectorIndex) -> int:
    """Bytes of codes: rows by code size; the exact vectors beside them don't count."""
    return sum(live for _, live, _ in index.lists()) * index.codec.code_bytes


def stored_bytes(spark: SparkSession, path: str) -> int:
    store, where = files._store(spark, path)
    return store.getContentSummary(where).getLength()


def answer(cache: DataFrame, generator: Callable[[str], str], system_prompt: str, max_contexts: int = 5) -> DataFrame:
    """Answers of a fixed generator: ``(query_id, prompt, answer, prompt_tokens, context_tokens, generator_latency_ms)``.

    ``cache`` has query_id, question and contexts (structs of id and text). The generator runs on the executors.
    """
    contexts = F.slice("contexts", 1, max_contexts)
    ready = cache.select(
        F.col("query_id").cast("string").alias("query_id"), X.prompt(F.lit(system_prompt), F.col("question"), contexts).alias("prompt"), X.context_tokens(F.transform(contexts, lambda c: c["text"])).alias("context_tokens")
    ).withColumn("prompt_tokens", X.token_count(F.col("prompt")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, spent = [], []
            for text in batch.column(1).to_pylist():
                began = time.perf_counter()
                said.append(generator(text))
                spent.append((time.perf_counter() - began) * 1000)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(spent, pa.float64())], [*batch.schema.names, "answer", "generator_latency_ms"])

    return ready.mapInArrow(run, "query_id string, prompt string, context_tokens int, prompt_tokens int, answer string, generator_latency_ms double")


def answer_scores(answers: DataFrame, references: DataFrame) -> DataFrame:
    """Mean exact match and token F1 over queries, each with its best reference of ``(query_id, references)``."""
    pairs = answers.join(references, "query_id").select("query_id", "answer", F.explode("references").alias("gold"))
    best = pairs.groupBy("query_id").agg(F.max(X.exact_match(F.col("answer"), F.col("gold"))).alias("em"), F.max(X.token_f1(F.col("answer"), F.col("gold"))).alias("f1"))
    return best.agg(F.round(F.avg("em"), 6).alias("exact_match"), F.round(F.avg("f1"), 6).alias("f1"))


@dataclass(frozen=True)
class Gate:
    """What a system's row of a campaign must reach."""

    dataset: str
    system_id: str
    recall_floor: float
    visited_code_fraction: float
    visited_page_fraction: float
    score_mode: str
    probes: float


def gate(rows: DataFrame, wanted: Gate) -> DataFrame:
    """A check a row: ``(name, observed, bound, passed)``; a value that is missing fails, and so does a missing row."""
    found = rows.where((F.col("dataset") == wanted.dataset) & (F.col("system_id") == wanted.system_id)).limit(1).collect()
    if not found:
        return rows.sparkSession.createDataFrame([("row_present", None, "present", False)], "name string, observed string, bound string, passed boolean")
    row = found[0].asDict()
    least = lambda v, b: v is not None and v >= b
    most = lambda v, b: v is not None and v <= b
    checks = [("recall_floor", row.get("recall"), wanted.recall_floor, least)]
    checks += [(n, row.get(n), getattr(wanted, n), most) for n in ("visited_code_fraction", "visited_page_fraction")]
    checks += [("score_mode", row.get("score_mode"), wanted.score_mode, lambda v, b: v == b), ("probes", row.get("probes"), wanted.probes, most)]
    out = [(name, None if v is None else str(v), str(b), bool(test(v, b))) for name, v, b, test in checks]
    return rows.sparkSession.createDataFrame(out, "name string, observed string, bound string, passed boolean")


def with_diagnostics(rows: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Campaign rows with the diagnostics of their dataset and system, where there are any."""
    return rows.join(diagnostics, ["dataset", "system_id"], "left")


def outcome(rows: DataFrame) -> dict[str, DataFrame]:
    """The leaders of each dataset by recall, latency and footprint."""
    return {
        "retrieval": evaluate.leaderboard(rows, "recall"),
        "latency": evaluate.leaderboard(rows, "p95_ms", higher=False),
        "footprint": evaluate.leaderboard(rows, "index_bytes", higher=False),
    }
