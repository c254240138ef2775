"""The registered queries of the retrieval engine with the DuckDB SQL that each must agree with.

Names begin with the number of the operator in the inventory. The query set of searches is every vector whose id is
divisible by 50, against all vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodevec.functions import register
from lodevec.functions import text as X
from lodevec.functions import vectors as V
from lodevec.operators import campaign, codec, evaluate, index, knn, rotation
from lodevec.plans import budget
from lodevec.plans.options import IndexOptions, MaintenanceKnobs, QueryKnobs
from lodevec.sources import files, ingest
from lodevec.streaming.churn import index_sink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings")


def _probe(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The vector of one id, which queries ask for."""
    return _vectors(spark, sf_dir).where(F.col("vec_id") == vec_id).select("embedding").first()[0]  # type: ignore[index]


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def _batch(spark: SparkSession, sf_dir: str, k: int, metric: str = "cosine") -> DataFrame:
    return knn.batch_knn(_vectors(spark, sf_dir), _asked(spark, sf_dir), k, metric, id_col="vec_id")


# ---------------------------------------------------------------------- SQL pieces
DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _dot(a: str, b: str) -> str:
    return DOT.format(a=a, b=b)


def _cosine(a: str, b: str) -> str:
    return f"(1 - greatest(-1.0, least(1.0, {_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})))))"


PROBE = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
NEAR_ZERO = f"SELECT vec_id, label, embedding, round({_cosine('embedding', 'q')}, 6) + 0.0 AS distance FROM embeddings, {PROBE}"
NEIGHBOURS = f"""
    SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank
    FROM (SELECT a.vec_id AS qid, b.vec_id AS id, round({_cosine('a.embedding', 'b.embedding')}, 6) + 0.0 AS distance
          FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
"""
RUNS = f"""
    WITH nn AS ({NEIGHBOURS}),
    others AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM nn WHERE id <> qid),
    runs AS (SELECT qid AS query_id, list(id ORDER BY rank) FILTER (rank <= 10) AS retrieved, coalesce(list(id ORDER BY id) FILTER (id % 3 = 0), []) AS relevant,
        coalesce(list(id ORDER BY id) FILTER (id % 6 = 0), []) AS evidence, 1 + (qid % 97) * 0.5 AS latency_ms FROM others WHERE rank <= 30 GROUP BY qid)
"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query rows for evaluation: ten neighbours but the query itself; of the first thirty every third id is relevant."""
    others = _batch(spark, sf_dir, 31).where("id <> qid")
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where("rank <= 30")
    ids = lambda wanted: F.sort_array(F.collect_list(F.when(wanted, F.col("id"))))
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", "id"))))
    found = ranked.groupBy("qid").agg(first.alias("r"), ids(F.col("id") % 3 == 0).alias("relevant"), ids(F.col("id") % 6 == 0).alias("evidence"))
    return found.select(F.col("qid").alias("query_id"), F.transform("r", lambda x: x["id"]).alias("retrieved"), "relevant", "evidence", (1 + (F.col("qid") % 97) * 0.5).alias("latency_ms"))


# ---------------------------------------------------------------------- vectors
def _against_probe(name: str, column: Callable[[Column, Column], Column], sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        probe = V.vector(_probe(spark, sf_dir))
        return _vectors(spark, sf_dir).select("vec_id", V.rounded(column(F.col("embedding"), probe)).alias("value"))

    registered(name, f"SELECT vec_id, round({sql}, 6) + 0.0 AS value FROM embeddings, {PROBE}")(query)


_against_probe("V01_cosine_distance", V.cosine_distance, _cosine("embedding", "q"))
_against_probe("V02_negative_inner_product", V.negative_inner_product, "-" + _dot("embedding", "q"))
_against_probe("V03_l2_distance", V.l2_distance, "list_distance(embedding::DOUBLE[], q::DOUBLE[])")
_against_probe("V03_squared_l2", V.squared_l2, "pow(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 2)")


@registered("V04_norm", f"SELECT vec_id, round(sqrt({_dot('embedding', 'embedding')}), 6) AS norm FROM embeddings")
def v04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", V.rounded(V.norm(F.col("embedding"))).alias("norm"))


_HALF = "round_even(v::DOUBLE / pow(2.0, greatest(floor(log2(abs(v::DOUBLE))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(v::DOUBLE))), -14) - 10)"


@registered("V05_half_norm", f"SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CASE WHEN v = 0 THEN 0 ELSE pow({_HALF}, 2) END)), 6) AS square FROM embeddings")
def v05(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = V.half(F.col("embedding"))
    return _vectors(spark, sf_dir).select("vec_id", V.rounded(V.dot(half, half)).alias("square"))


@registered("V06_checked_unit", f"SELECT vec_id, round(embedding[1]::DOUBLE / sqrt({_dot('embedding', 'embedding')}), 5) + 0.0 AS first FROM embeddings")
def v06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", V.rounded(V.checked_unit(F.col("embedding"))[0], 5).alias("first"))


@registered("V08_text_round_trip", "SELECT vec_id, len(embedding) AS n, true AS same FROM embeddings")
def v08(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = V.parse_vector(V.format_vector(F.col("embedding")))
    return _vectors(spark, sf_dir).select("vec_id", V.dimension(back).cast("long").alias("n"), (back == F.col("embedding")).alias("same"))


@registered("V10_dimension", "SELECT len(embedding)::BIGINT AS dimension, count(*) AS n FROM embeddings GROUP BY 1")
def v10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_fixed_dimension(_vectors(spark, sf_dir), "embedding", 64).groupBy(V.dimension(F.col("embedding")).cast("long").alias("dimension")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------- filters and top-k
def _top(name: str, where: str, build: Callable[[SparkSession, str], DataFrame], k: int = 10, columns: str = "vec_id, distance") -> None:
    registered(name, f"SELECT {columns} FROM ({NEAR_ZERO}) WHERE {where} ORDER BY distance, vec_id LIMIT {k}")(build)


_top("T05_exact_knn", "true", lambda s, d: knn.exact_knn(_vectors(s, d), _probe(s, d), 10, id_col="vec_id"))
_top("F01_equality_filter", "label = 3", lambda s, d: knn.exact_knn(_vectors(s, d), _probe(s, d), 10, id_col="vec_id", filters={"label": 3}))
_top("F02_any_filter", "label IN (1, 2, 5)", lambda s, d: knn.exact_knn(_vectors(s, d), _probe(s, d), 10, id_col="vec_id", filters={"label": [1, 2, 5]}))
_top("F02_any_of_nothing", "false", lambda s, d: knn.exact_knn(_vectors(s, d), _probe(s, d), 10, id_col="vec_id", filters={"label": []}))
_top("F04_conjunction", "label IN (1, 2) AND vec_id % 3 = 0", lambda s, d: knn.exact_knn(_vectors(s, d).withColumn("flag", F.when(F.col("vec_id") % 3 != 0, 1)), _probe(s, d), 10, id_col="vec_id", filters={"label": [1, 2], "flag": None}))
_top("F12_covering_projection", "true", lambda s, d: knn.exact_knn(_vectors(s, d), _probe(s, d), 10, id_col="vec_id", payload=["label"]), columns="vec_id, label, distance")


@registered("F09_cosine_threshold", f"SELECT vec_id, label FROM ({NEAR_ZERO}) WHERE distance <= 0.9")
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.within_distance(_vectors(spark, sf_dir), _probe(spark, sf_dir), 0.9).select("vec_id", "label")


@registered("F10_threshold_and_scalar", f"SELECT vec_id, label FROM ({NEAR_ZERO}) WHERE distance <= 0.95 AND label = 2")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.within_distance(_vectors(spark, sf_dir).where("label = 2"), _probe(spark, sf_dir), 0.95).select("vec_id", "label")


@registered("F11_residual_filter", f"SELECT vec_id, distance FROM (SELECT * FROM ({NEAR_ZERO}) ORDER BY distance, vec_id LIMIT 64) WHERE vec_id % 2 = 1 ORDER BY distance, vec_id LIMIT 10")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.exact_knn(_vectors(spark, sf_dir), _probe(spark, sf_dir), 64, id_col="vec_id")
    return found.where("vec_id % 2 = 1").orderBy("distance", "vec_id").limit(10)


@registered("F14_tombstones", f"SELECT vec_id, distance FROM ({NEAR_ZERO}) WHERE vec_id % 5 <> 4 ORDER BY distance, vec_id LIMIT 10")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    dead = rows.where("vec_id % 5 = 4").select("vec_id")
    return knn.exact_knn(rows.join(dead, "vec_id", "left_anti"), _probe(spark, sf_dir), 10, id_col="vec_id")


@registered("T11_staged_union", f"""
    WITH near AS ({NEAR_ZERO}), base AS (SELECT vec_id, distance FROM near WHERE vec_id % 4 <> 0 ORDER BY distance, vec_id LIMIT 20),
    delta AS (SELECT vec_id, distance FROM near WHERE vec_id % 4 = 0 ORDER BY distance, vec_id LIMIT 5)
    SELECT * FROM (SELECT * FROM base UNION ALL SELECT * FROM delta) ORDER BY distance, vec_id LIMIT 12""")
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, probe = _vectors(spark, sf_dir), V.vector(_probe(spark, sf_dir))
    near = rows.select("vec_id", V.rounded(V.cosine_distance(F.col("embedding"), probe)).alias("distance"))
    return knn.staged_union([(near.where("vec_id % 4 <> 0"), 20), (near.where("vec_id % 4 = 0"), 5)], 12, "vec_id")


@registered("T09_effective_limit", "SELECT * FROM (VALUES (32, 100, 4, 16, 116), (32, 100, 4, 0, 100), (1024, 100, 4, -1, 1536), (10, 5, 1, -1, 10)) t(candidates, final, factor, extra, effective)")
def t09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c, f, k, e, budget.effective_limit(c, f, k, e)) for c, f, k, e in ((32, 100, 4, 16), (32, 100, 4, 0), (1024, 100, 4, -1), (10, 5, 1, -1))]
    return spark.createDataFrame(rows, "candidates int, final int, factor int, extra int, effective int")


@registered("P12_resolved_knobs", """
    SELECT c AS candidates, f AS final, greatest(1, ceil(c / greatest(8, ceil(c / f))))::INT AS probes, greatest(8, ceil(c / f))::INT AS oversample,
        (c * greatest(8, ceil(c / f)))::BIGINT AS codes
    FROM (SELECT unnest([10, 24, 100, 1000])::DOUBLE AS c), (SELECT unnest([1, 10, 25])::DOUBLE AS f)""")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for c in (10, 24, 100, 1000):
        for f in (1, 10, 25):
            k = budget.resolve_knobs(c, f)
            rows.append((float(c), float(f), k["probes"], k["oversample_factor"], k["max_visited_codes"]))
    return spark.createDataFrame(rows, "candidates double, final double, probes int, oversample int, codes bigint")


# ---------------------------------------------------------------------- joins, windows, sets
@registered("J08_batch_knn", f"SELECT qid, id, distance, rank FROM ({NEIGHBOURS}) WHERE rank <= 10")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, 10)


@registered("J08_batch_knn_ip", f"""
    SELECT qid, id, distance, rank FROM (
        SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank
        FROM (SELECT a.vec_id AS qid, b.vec_id AS id, round(-{_dot('a.embedding', 'b.embedding')}, 6) + 0.0 AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 5""")
def j08_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, 5, "ip")


@registered("J01_exact_rerank", f"SELECT vec_id, distance FROM ({NEAR_ZERO}) WHERE vec_id % 7 = 0 ORDER BY distance, vec_id LIMIT 10")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    wanted = rows.where("vec_id % 7 = 0").select("vec_id")
    return knn.exact_knn(rows.join(wanted, "vec_id", "left_semi"), _probe(spark, sf_dir), 10, id_col="vec_id")


@registered("J02_rerank_candidate_array", f"SELECT vec_id, distance FROM ({NEAR_ZERO}) WHERE vec_id IN (3, 5, 8, 13, 21, 34, 55, 89) ORDER BY distance, vec_id LIMIT 5")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.range(1).select(F.explode(F.array(*(F.lit(i).cast("long") for i in (3, 5, 8, 13, 21, 34, 55, 89)))).alias("vec_id"))
    return knn.exact_rerank(_vectors(spark, sf_dir), ids, _probe(spark, sf_dir), 5, id_col="vec_id")


@registered("J04_late_text", f"""
    SELECT vec_id, distance, length(text) AS chars FROM (SELECT vec_id, distance FROM ({NEAR_ZERO}) ORDER BY distance, vec_id LIMIT 10) JOIN documents ON doc_id = vec_id""")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.exact_knn(_vectors(spark, sf_dir), _probe(spark, sf_dir), 10, id_col="vec_id")
    docs = _table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "vec_id")
    return knn.fetch_late(docs, found, ["text"], "vec_id").select("vec_id", "distance", F.length("text").cast("long").alias("chars"))


@registered("J09_overlap", f"""
    WITH a AS (SELECT vec_id FROM ({NEAR_ZERO}) ORDER BY distance, vec_id LIMIT 50), b AS (SELECT vec_id FROM ({NEAR_ZERO}) WHERE vec_id % 2 = 0 ORDER BY distance, vec_id LIMIT 50)
    SELECT count(*) FILTER (a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL) AS overlap, count(*) FILTER (b.vec_id IS NULL) AS left_only, count(*) FILTER (a.vec_id IS NULL) AS right_only
    FROM a FULL JOIN b ON a.vec_id = b.vec_id""")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, probe = _vectors(spark, sf_dir), _probe(spark, sf_dir)
    return evaluate.overlap(knn.exact_knn(rows, probe, 50, id_col="vec_id"), knn.exact_knn(rows.where("vec_id % 2 = 0"), probe, 50, id_col="vec_id"), "vec_id")


@registered("U03_first_seen", "SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.first_seen(_vectors(spark, sf_dir).select("label", "vec_id"), "label", "vec_id")


@registered("A26_array_of_ids", f"SELECT label, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids FROM (SELECT * FROM ({NEAR_ZERO}) ORDER BY distance, vec_id LIMIT 40) GROUP BY label")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.exact_knn(_vectors(spark, sf_dir), _probe(spark, sf_dir), 40, id_col="vec_id", payload=["label"])
    return evaluate.ids_by(found, "label", "vec_id").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@registered("A27_conditional_aggregate", "SELECT label, max(vec_id) FILTER (vec_id % 2 = 0) AS even, max(vec_id) FILTER (vec_id % 2 = 1) AS odd FROM embeddings GROUP BY label")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("vec_id") % 2 == 0
    return evaluate.greatest_where(_vectors(spark, sf_dir), "label", "vec_id", {"even": even, "odd": ~even})


# ---------------------------------------------------------------------- evaluation
@registered("A01_row_count", "SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.row_count(_vectors(spark, sf_dir))


@registered("A03_list_distribution", """
    WITH n AS (SELECT l AS list_id, count(label) FILTER (vec_id % 6 <> 5) AS n FROM range(12) t(l) LEFT JOIN embeddings ON label = l GROUP BY l)
    SELECT min(n) AS min_live, max(n) AS max_live, round(avg(n), 2) AS avg_live, quantile_disc(n, 0.95) AS p95_live, round(stddev_pop(n) / avg(n), 4) AS coeff_var, round(max(n) / avg(n), 4) AS max_over_avg FROM n""")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.index_health(_vectors(spark, sf_dir).select(F.col("label").cast("int").alias("list_id"), (F.col("vec_id") % 6 != 5).alias("live")), 12)


@registered("A06_retrieval_metrics", RUNS + """
    , scored AS (SELECT *, list_has_any(retrieved, relevant) AS hit, list_has_any(retrieved, evidence) AS seen, len(list_intersect(retrieved, relevant)) AS n, len(relevant) AS total,
        list_filter(list_transform(retrieved, lambda x, i: CASE WHEN list_contains(relevant, x) THEN i END), lambda r: r IS NOT NULL) AS ranks FROM runs)
    SELECT count(*) AS query_count, round(avg(CASE WHEN total > 0 THEN n / total ELSE 0 END), 6) AS recall, round(avg(CASE WHEN len(ranks) > 0 THEN 1 / list_min(ranks) ELSE 0 END), 6) AS mrr,
        round(avg(CASE WHEN total > 0 THEN coalesce(list_sum(list_transform(ranks, lambda r: 1 / log2(r + 1))), 0) / list_sum(list_transform(range(1, least(total, 10) + 1), lambda r: 1 / log2(r + 1))) ELSE 0 END), 6) AS ndcg,
        round(avg(hit::INT), 6) AS hit_rate, round(avg(seen::INT), 6) AS evidence_coverage,
        round(quantile_cont(latency_ms::DOUBLE, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms::DOUBLE, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms::DOUBLE, 0.99), 6) AS p99_ms,
        round(count(*) * 1000 / sum(latency_ms::DOUBLE), 6) AS qps FROM scored""")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.retrieval_metrics(_runs(spark, sf_dir), 10)


@registered("A11_nearest_rank_latency", "SELECT event_type, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.percentiles(_table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95}, ["event_type"], nearest=True)
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@registered("A13_stage_distributions", """
    WITH s AS (SELECT value AS retrieval, value * 2 AS rerank, CASE WHEN event_type = 'click' THEN value + 1 END AS generator FROM events),
    l AS (SELECT 'retrieval' AS stage, retrieval AS v FROM s UNION ALL SELECT 'rerank', rerank FROM s UNION ALL SELECT 'generator', generator FROM s)
    SELECT stage, count(*) AS n, round(avg(v), 6) AS avg, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM l WHERE v IS NOT NULL GROUP BY stage""")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    rows = _table(spark, sf_dir, "events").select(value.alias("retrieval"), (value * 2).alias("rerank"), F.when(F.col("event_type") == "click", value + 1).alias("generator"))
    return evaluate.distributions(rows, ["retrieval", "rerank", "generator"])


@registered("A14_cost_summary", "SELECT event_type AS name, 'usd' AS unit, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS avg FROM events GROUP BY event_type")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.lit("usd").alias("unit"), "value")
    return evaluate.cost_summary(rows).withColumn("total", F.round("total", 4))


@registered("A15_scan_stats", """
    SELECT 'user' AS name, count(*) AS n, round(avg(vec_id), 6) AS avg, round(quantile_cont(vec_id::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(vec_id::DOUBLE, 0.95), 6) AS p95, NULL::VARCHAR AS seen, NULL::BOOLEAN AS uniform FROM embeddings
    UNION ALL SELECT 'label', count(*), NULL, NULL, NULL, string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR), count(DISTINCT label) = 1 FROM embeddings""")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select(F.col("vec_id").alias("user"), "label")
    return evaluate.scan_stat_summary(rows, ["user"], ["label"]).withColumn("seen", F.array_join("values", ",")).drop("values")


@registered("A16_multihop", RUNS + """
    SELECT query_id, array_to_string(list_filter(s, lambda x: list_contains(retrieved, x)), ',') AS found, array_to_string(list_filter(s, lambda x: NOT list_contains(retrieved, x)), ',') AS missing,
        (len(list_filter(s, lambda x: NOT list_contains(retrieved, x))) = 0)::INT AS covered FROM (SELECT query_id, retrieved, relevant[1:2] AS s FROM runs)""")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).withColumn("supporting", F.slice("relevant", 1, 2))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return evaluate.multihop(rows, 10).select("query_id", text("retrieved_supporting").alias("found"), text("missing_supporting").alias("missing"), "covered")


@registered("A18_candidate_retention", f"""
    WITH nn AS ({NEIGHBOURS}), e AS (SELECT qid, list(id ORDER BY rank) AS exact FROM nn WHERE rank <= 100 GROUP BY qid), c AS (SELECT qid, list(id) AS candidates FROM nn WHERE rank <= 120 AND id % 4 <> 1 GROUP BY qid),
    p AS (SELECT k, len(list_intersect(exact[1:k], candidates)) AS kept, len(exact[1:k]) AS size FROM e JOIN c USING (qid), (VALUES (10), (100)) t(k))
    SELECT k::BIGINT AS k, round(avg(kept / greatest(size, 1)), 6) AS avg_retention, round(min(kept / greatest(size, 1)), 6) AS worst_retention, sum(size - kept)::BIGINT AS misses FROM p GROUP BY k""")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _batch(spark, sf_dir, 120)
    ordered = F.array_sort(F.collect_list(F.when(F.col("rank") <= 100, F.struct("rank", "id"))))
    pairs = found.groupBy("qid").agg(ordered.alias("e"), F.collect_list(F.when(F.col("id") % 4 != 1, F.col("id"))).alias("candidates"))
    return evaluate.candidate_retention(pairs.select(F.transform("e", lambda x: x["id"]).alias("exact"), "candidates"))


@registered("A19_estimator_quality", f"""
    WITH d AS (SELECT a.vec_id AS q, b.vec_id AS id, round({_dot('a.embedding', 'b.embedding')}, 6) AS exact FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
    n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY -exact, id) <= 200),
    e AS (SELECT *, round(exact, 2) AS estimate FROM n),
    r AS (SELECT *, abs(row_number() OVER (PARTITION BY q ORDER BY exact, id) - row_number() OVER (PARTITION BY q ORDER BY estimate, id)) AS shift FROM e)
    SELECT round(avg(estimate - exact), 6) + 0.0 AS bias, round(var_pop(estimate - exact), 6) AS variance, round(avg(abs(estimate - exact)), 6) AS mae, round(avg(shift), 6) AS avg_rank_shift, max(shift) AS max_rank_shift FROM r""")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 200 nearest of each query, so a task keeps a bounded number of distances."""
    near = _batch(spark, sf_dir, 200, "ip").select(F.col("qid").alias("query_id"), "id", (-F.col("distance")).alias("exact"))
    return evaluate.estimator_quality(near.withColumn("estimate", F.round("exact", 2)))


@registered("A20_exact_match_fraction", f"""
    WITH nn AS ({NEIGHBOURS}), p AS (SELECT qid, list(id ORDER BY id) FILTER (rank <= 5) AS wanted, list(id ORDER BY id) FILTER (rank <= 7 AND (qid % 100 = 0 OR rank <= 5)) AS found FROM nn GROUP BY qid)
    SELECT count(*) AS query_count, round(avg((found = wanted)::INT), 6) AS exact_match_fraction, round(avg(len(found)), 6) AS avg_result_count FROM p""")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda wanted: F.collect_list(F.when(wanted, F.col("id")))
    rank = F.col("rank")
    pairs = _batch(spark, sf_dir, 7).groupBy("qid").agg(ids(rank <= 5).alias("wanted"), ids((rank <= 7) & ((F.col("qid") % 100 == 0) | (rank <= 5))).alias("found"))
    return evaluate.exact_fraction(pairs)


@registered("H18_pairwise", """
    WITH s AS (SELECT event_type AS dataset, user_id AS system_id, max(value) AS value FROM events GROUP BY ALL)
    SELECT a.dataset, a.system_id AS candidate, b.system_id AS baseline, 'value' AS metric, a.value AS candidate_value, b.value AS baseline_value, round(a.value - b.value, 6) + 0.0 AS difference, round(a.value / b.value, 6) AS ratio
    FROM s a JOIN s b ON a.dataset = b.dataset AND b.system_id = 1 AND a.system_id <> 1""")
def h18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dataset"), F.col("user_id").alias("system_id")).agg(F.max("value").alias("value"))
    return evaluate.comparisons(rows, ["value"], [1])


@registered("A21_answer_scores", """
    WITH t AS (SELECT conv_id, turn, coalesce(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), []) AS w FROM conversations WHERE turn <= 1),
    p AS (SELECT a.conv_id, a.w AS p, b.w AS g FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
    s AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) AS shared FROM p)
    SELECT conv_id, (array_to_string(p, ' ') = array_to_string(g, ' '))::INT AS em, round(CASE WHEN len(p) + len(g) = 0 THEN 1 ELSE 2.0 * shared / (len(p) + len(g)) END, 6) AS f1 FROM s""")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    said = turns.where("turn = 0").select("conv_id", F.col("text").alias("said")).join(turns.where("turn = 1").select("conv_id", F.col("text").alias("gold")), "conv_id")
    return said.select("conv_id", X.exact_match(F.col("said"), F.col("gold")).alias("em"), F.round(X.token_f1(F.col("said"), F.col("gold")), 6).alias("f1"))


@registered("A22_leaderboard", "SELECT event_type AS dataset, user_id AS system_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id) = 1")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.leaderboard(_table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").alias("system_id"), "value"), "value")


@registered("A23_work_fractions", "SELECT l_linenumber, round(sum(l_quantity) / (sum(l_quantity) + 7), 6) AS codes, round(count(*) / ceil(sum(l_orderkey) / 8192), 6) AS pages FROM lineitem GROUP BY l_linenumber")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.sum("l_orderkey").alias("k"))
    codes, pages = evaluate.work_fractions(F.col("q"), F.col("q") + 7, F.col("n"), F.col("k"))
    return sums.select("l_linenumber", codes.alias("codes"), pages.alias("pages"))


# ---------------------------------------------------------------------- text and ingestion
@registered("X02_token_count", r"SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))::BIGINT AS tokens FROM documents")
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).cast("long").alias("tokens"))


@registered("X04_prompt", """
    SELECT conv_id, sha256(concat_ws(chr(10), 'Be brief.', '', 'Question: ' || text, '', 'Contexts:', '[7] a', '[8] b', '', 'Answer:')) AS hash FROM conversations WHERE turn = 0""")
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _table(spark, sf_dir, "conversations").where("turn = 0")
    contexts = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(t).alias("text")) for i, t in ((7, "a"), (8, "b"))))
    return first.select("conv_id", X.template_hash(X.prompt(F.lit("Be brief."), F.col("text"), contexts)).alias("hash"))


@registered("X05_canonical_id", "SELECT vec_id, split_part(label || ':' || vec_id, ':', 1) AS id FROM embeddings")
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", X.canonical_id(F.concat_ws(":", "label", "vec_id")).alias("id"))


@registered("S15_popqa_corpus", "SELECT source AS document_id, lang AS title, lang || ' is in ' || doc_id || '.' AS text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("subj_id"), F.col("lang").alias("subj"), F.lit("is in").alias("prop"), F.col("doc_id").cast("string").alias("obj"))
    return ingest.popqa_corpus(rows, "doc_id")


@registered("S16_kilt_corpus", """
    SELECT (conv_id % 40)::VARCHAR AS document_id, 'q' || conv_id AS question, 'a' || turn AS answer FROM conversations WHERE conv_id % 7 <> 0
    QUALIFY row_number() OVER (PARTITION BY conv_id % 40 ORDER BY conv_id, turn) = 1""")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").where("turn is not null").select("conv_id", "turn").distinct()
    page = F.when(F.col("conv_id") % 7 != 0, (F.col("conv_id") % 40).cast("string"))
    one = F.struct(F.col("turn"), F.concat(F.lit("a"), F.col("turn")).alias("answer"), F.array(F.struct(page.alias("wikipedia_id"))).alias("provenance"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("output")).select("conv_id", F.concat(F.lit("q"), F.col("conv_id")).alias("input"), "output")
    return ingest.kilt_corpus(rows, "conv_id")


@registered("S17_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label + 100 FROM embeddings WHERE vec_id % 3 = 0")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", "label")
    changed = rows.where("vec_id % 3 = 0").withColumn("label", (F.col("label") + 100).cast(rows.schema["label"].dataType))
    return ingest.upsert(rows, changed.unionByName(changed.withColumn("vec_id", F.col("vec_id") + 1_000_000)), "vec_id")


@registered("S18_passage_defaults", """
    SELECT doc_id, (doc_id % 4 + 1)::INT AS tenant_id, (doc_id % 8 + 1)::INT AS source_id, 1 AS lang_id, 1 AS doc_version, (doc_id + 1)::INT AS doc_id_int, ((doc_id % 3) + 1)::INT AS chunk_id_int FROM documents""")
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") + 1).alias("ordinal"), (F.col("doc_id") % 3).alias("chunk_index"))
    return ingest.with_passage_defaults(rows, "ordinal").drop("ordinal", "chunk_index")


# ---------------------------------------------------------------------- index
def _built(spark: SparkSession, sf_dir: str, **options) -> index.VectorIndex:
    rows = _vectors(spark, sf_dir).withColumn("tenant", (F.col("vec_id") % 4).cast("int"))
    return index.VectorIndex.build(rows, files.scratch(spark, "index"), IndexOptions(**options), id_col="vec_id")


def _reranked(built: index.VectorIndex, query: Sequence[float], k: int, knobs: QueryKnobs, filters: dict | None = None) -> DataFrame:
    """Candidates of an index with exact distances, and with them all rows that codes can't rule out."""
    found, stats = built.search(query, knobs.probes * knobs.oversample_factor, knobs, filters)
    found = built.completed(found, query, k, stats.selected_lists if stats.mode == "ivf" else None, filters)
    return knn.exact_rerank(built.rows().withColumnRenamed("id", "vec_id"), found.withColumnRenamed("id", "vec_id"), query, k, built.options.metric, "vec_id")


_top("S02_flat_index_rerank", "true", lambda s, d: _reranked(_built(s, d, bits=8), _probe(s, d), 10, QueryKnobs(oversample_factor=16)))
_top("S03_ivf_all_lists_rerank", "true", lambda s, d: _reranked(_built(s, d, bits=8, lists=8), _probe(s, d), 10, QueryKnobs(oversample_factor=16)))
_top("F06_filtered_index_rerank", "vec_id % 4 = 1 AND label IN (1, 2, 3)", lambda s, d: _reranked(_built(s, d, bits=8, lists=8, attributes=("tenant", "label")), _probe(s, d), 10, QueryKnobs(oversample_factor=16), {"tenant": 1, "label": [1, 2, 3]}))
_top("T08_decode_rescore", "true", lambda s, d: _reranked(_built(s, d, bits=6, lists=4), _probe(s, d), 10, QueryKnobs(oversample_factor=16, decode_rescore_factor=4)))


DEEP = QueryKnobs(probes=8, oversample_factor=32)


@registered("H01_approx_candidates", f"SELECT vec_id::VARCHAR AS candidate_id, row_number() OVER (ORDER BY distance, vec_id) AS approximate_rank, distance AS approximate_distance FROM (SELECT * FROM ({NEAR_ZERO}) WHERE vec_id % 4 <> 1 ORDER BY distance, vec_id LIMIT 20)")
def h01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 of the index's 200 candidates, with a filter and rows in the delta."""
    rows = _vectors(spark, sf_dir).withColumn("tenant", (F.col("vec_id") % 4).cast("int"))
    built = index.VectorIndex.build(rows.where("vec_id % 3 <> 0"), files.scratch(spark, "index"), IndexOptions(bits=8, lists=8, attributes=("tenant",)), id_col="vec_id")
    built.insert(rows.where("vec_id % 3 = 0"), "vec_id")
    return built.candidates(_probe(spark, sf_dir), 200, filters={"tenant": [0, 2, 3]}, knobs=DEEP).where("approximate_rank <= 20")


_top("C15_companding_rerank", "true", lambda s, d: _reranked(_built(s, d, bits=6, lists=4, codec="companding"), _probe(s, d), 10, QueryKnobs(oversample_factor=16)))


@registered("C15_companded_codes", f"""
    WITH u AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high FROM embeddings),
    b AS (SELECT vec_id, list_transform(v, lambda x: sign(2 * (x - low) / (high - low) - 1) * ln(1 + 2.5 * abs(2 * (x - low) / (high - low) - 1)) / ln(3.5)) AS bent FROM u)
    SELECT vec_id, list_sum(list_transform(bent, lambda y: round_even((y + 1) / 2 * 15, 0)))::BIGINT AS total, list_max(list_transform(bent, lambda y: round_even((y + 1) / 2 * 15, 0)))::BIGINT AS most FROM b""")
def c15_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and maxima of four-bit companded codes of the plain vectors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).values.to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
                codes = codec.compand_encode(x, 4)[0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.sum(1)), pa.array(codes.max(1))], ["vec_id", "total", "most"])

    return _vectors(spark, sf_dir).select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, total bigint, most bigint")


@registered("H02_rerank_candidates", f"""
    SELECT vec_id::VARCHAR AS candidate_id, row_number() OVER (ORDER BY distance, vec_id) AS approximate_rank, distance AS approximate_distance, row_number() OVER (ORDER BY distance, vec_id::VARCHAR) AS exact_rank, distance AS exact_distance
    FROM (SELECT * FROM ({NEAR_ZERO}) ORDER BY distance, vec_id LIMIT 8)""")
def h02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir, bits=8, lists=8).rerank(_probe(spark, sf_dir), 200, 8, knobs=DEEP)


#: Lists of eight given centroids, the vectors of ids 0 to 7, and the two that are nearest to each query.
PROBED = """
    cells AS (SELECT b.vec_id AS id, b.embedding, min_by(a.vec_id, (round(pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 9), a.vec_id)) AS list_id
        FROM embeddings a, embeddings b WHERE a.vec_id < 8 GROUP BY b.vec_id, b.embedding),
    probes AS (SELECT b.vec_id AS qid, b.embedding AS q, a.vec_id AS list_id FROM embeddings a, embeddings b WHERE a.vec_id < 8 AND b.vec_id % 50 = 0
        QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY round(pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 9), a.vec_id) <= 2)
"""


def _probed_sql(where: str, more: str = "") -> str:
    """The ten nearest ids, as a text, of the rows in each query's two lists, and of more rows whatever their list."""
    near = f"round({_cosine('embedding', 'q')}, 6) + 0.0"
    return f"""
        WITH {PROBED}, met AS (SELECT qid, id, {near} AS distance FROM probes JOIN cells USING (list_id) WHERE {where} {more.format(near=near)}),
        best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= 10)
        SELECT qid, string_agg(id::VARCHAR, ',' ORDER BY distance, id) AS retrieved FROM best GROUP BY qid"""


def _given(spark: SparkSession, sf_dir: str, where: str = "true", **options) -> index.VectorIndex:
    rows = _vectors(spark, sf_dir).withColumn("tenant", (F.col("vec_id") % 4).cast("int"))
    centroids = [r[0] for r in rows.where("vec_id < 8").orderBy("vec_id").select("embedding").collect()]
    return index.VectorIndex.build(rows.where(where), files.scratch(spark, "index"), IndexOptions(lists=8, attributes=("tenant",), **options), id_col="vec_id", centroids=centroids)


def _listed(found: DataFrame) -> DataFrame:
    return found.select("qid", F.array_join("retrieved", ",").alias("retrieved"))


TWO = QueryKnobs(probes=2, oversample_factor=200)


@registered("H06_float_lists", _probed_sql("true"))
def h06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(campaign.retrieve(_given(spark, sf_dir), _asked(spark, sf_dir), 10, "float_lists_approx", knobs=TWO))


@registered("S03_probed_lists_rerank", _probed_sql("true"))
def s03_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of eight lists by codes, then exact distances of what they give."""
    return _listed(campaign.retrieve(_given(spark, sf_dir, bits=8), _asked(spark, sf_dir), 10, "quantized_rerank", depth=300, knobs=TWO))


@registered("F06_filtered_probes", _probed_sql("id % 4 IN (1, 2)"))
def f06_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(campaign.retrieve(_given(spark, sf_dir, bits=8), _asked(spark, sf_dir), 10, "quantized_rerank", depth=300, knobs=TWO, filters={"tenant": [1, 2]}))


@registered("S04_unmerged_delta", _probed_sql("id % 5 <> 0", f"UNION ALL SELECT p.qid, v.vec_id + 1000000, {{near}} FROM (SELECT DISTINCT qid, q FROM probes) p, embeddings v WHERE v.vec_id % 10 = 0"))
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows deleted and inserted since the build, not merged: every query meets the delta."""
    built, rows = _given(spark, sf_dir, bits=8), _vectors(spark, sf_dir)
    built.delete(rows.where("vec_id % 5 = 0"), "vec_id")
    built.insert(rows.where("vec_id % 10 = 0").withColumns({"vec_id": F.col("vec_id") + 1_000_000, "tenant": F.lit(0)}), "vec_id")
    return _listed(campaign.retrieve(built, _asked(spark, sf_dir), 10, "quantized_rerank", depth=300, knobs=TWO))


@registered("M09_upsert_and_search", _probed_sql("id % 5 <> 0", f"UNION ALL SELECT p.qid, v.vec_id, {{near}} FROM (SELECT DISTINCT qid, q FROM probes) p, (SELECT a.vec_id, b.embedding FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 5 = 0) v"))
def m09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row takes its neighbour's vector; one without a neighbour is deleted."""
    built, rows = _given(spark, sf_dir, bits=8), _vectors(spark, sf_dir)
    next_ = rows.select((F.col("vec_id") - 1).alias("vec_id"), "embedding").where("vec_id % 5 = 0").withColumn("tenant", (F.col("vec_id") % 4).cast("int"))
    built.upsert(next_, "vec_id")
    built.delete(rows.where("vec_id % 5 = 0").join(next_, "vec_id", "left_anti"), "vec_id")
    return _listed(campaign.retrieve(built, _asked(spark, sf_dir), 10, "quantized_rerank", depth=300, knobs=TWO))


@registered("A02_list_health", f"""
    WITH {PROBED}, d AS (SELECT list_id::INT AS list_id, id % 7 = 0 AS dead FROM cells)
    SELECT list_id, count(*) FILTER (NOT dead) AS live, count(*) FILTER (dead) AS dead, 0::BIGINT AS delta FROM d GROUP BY list_id""")
def a02_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _given(spark, sf_dir)
    built.delete(_vectors(spark, sf_dir).where("vec_id % 7 = 0"), "vec_id")
    return built.list_health().select("list_id", "live", "dead", "delta")


@registered("K08_rank_probes", f"WITH {PROBED} SELECT qid, string_agg(list_id::VARCHAR, ',' ORDER BY list_id) AS lists FROM probes GROUP BY qid")
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two lists that each query's plan has, one query after the other as a bounded query set allows."""
    built = _given(spark, sf_dir)
    rows = [(q, ",".join(map(str, sorted(built.plan(built._query(v), QueryKnobs(probes=2))[0])))) for q, v in _asked(spark, sf_dir).collect()]
    return spark.createDataFrame(rows, "qid bigint, lists string")


@registered("P03_budgeted_probes", f"""
    WITH {PROBED}, sizes AS (SELECT list_id, count(*) AS n FROM cells GROUP BY list_id), all_ AS (SELECT sum(n) AS total FROM sizes)
    SELECT qid, true AS kept FROM (SELECT DISTINCT qid FROM probes), all_""")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what a budget of a third of the rows selects keeps to it, or is one list where none fits."""
    built = _given(spark, sf_dir)
    most = built.rows().count() // 3
    rows = []
    for q, v in _asked(spark, sf_dir).collect():
        stats = built.plan(built._query(v), QueryKnobs(probes=8, max_visited_codes=most))[1]
        rows.append((q, stats.selected_live_count <= most or len(stats.selected_lists) == 1))
    return spark.createDataFrame(rows, "qid bigint, kept boolean")


@registered("M05_churn_and_merge", f"""
    WITH rows AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings WHERE vec_id % 10 = 0)
    SELECT vec_id, distance FROM (SELECT vec_id, round({_cosine('embedding', 'q')}, 6) + 0.0 AS distance FROM rows, {PROBE}) ORDER BY distance, vec_id LIMIT 10""")
def m05(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _built(spark, sf_dir, bits=8, lists=8)
    rows = _vectors(spark, sf_dir)
    built.delete(rows.where("vec_id % 5 = 0"), "vec_id")
    built.insert(rows.where("vec_id % 10 = 0").withColumns({"vec_id": F.col("vec_id") + 1_000_000, "tenant": F.lit(0)}), "vec_id")
    built.maintain()
    return _reranked(built, _probe(spark, sf_dir), 10, QueryKnobs(oversample_factor=16))


@registered("I01_index_metadata", "SELECT count(*) AS live_count, 0::BIGINT AS dead_count, 8 AS list_count, 36 AS code_bytes, 'healthy' AS action, true AS even_enough FROM embeddings")
def i01(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = _built(spark, sf_dir, bits=4, lists=8).metadata()
    row = (meta["live_count"], meta["dead_count"], meta["list_count"], meta["code_bytes"], meta["maintenance_action_recommended"], meta["list_distribution"]["max_list_over_avg"] < 8)
    return spark.createDataFrame([row], "live_count bigint, dead_count bigint, list_count int, code_bytes int, action string, even_enough boolean")


#: Fixed values, worked out apart from the library: signs and places that SplitMix64 from 0 gives for 64 coordinates, and the Lloyd-Max
#: centroids of three bits for a coordinate of a random unit vector of 64, on a grid of 8,192 cells.
SIGNS = [
    1, -1, 1, -1, 1, -1, 1, -1, 1, -1, 1, -1, 1, 1, 1, 1, 1, -1, -1, -1, 1, 1, -1, -1, 1, 1, -1, -1, -1, -1, 1, 1,
    -1, 1, 1, 1, 1, 1, 1, 1, -1, -1, -1, 1, -1, 1, 1, 1, 1, -1, 1, -1, 1, 1, -1, 1, 1, -1, -1, 1, 1, -1, 1, 1,
]
PLACES = [
    56, 9, 34, 22, 63, 31, 62, 45, 38, 60, 4, 27, 35, 46, 20, 57, 58, 39, 26, 30, 16, 25, 11, 1, 3, 32, 10, 59, 13, 42, 55, 41,
    6, 19, 52, 49, 7, 29, 47, 37, 21, 36, 48, 17, 51, 50, 18, 61, 12, 53, 40, 0, 5, 43, 23, 8, 2, 54, 33, 44, 28, 24, 15, 14,
]
CENTROIDS = [-0.263330162, -0.165558457, -0.093364082, -0.030288709, 0.030288709, 0.093364082, 0.165558457, 0.263330162]
#: Rotated coordinates in SQL: signs, places and the signs of a Hadamard matrix by the parity of common bits.
ROTATED_SQL = f"""
    turn AS (SELECT j, list(({SIGNS})[i + 1] * CASE WHEN bit_count((({PLACES})[i + 1] & j)::INT) % 2 = 0 THEN 1 ELSE -1 END / 8.0 ORDER BY i)::DOUBLE[] AS w FROM range(64) a(i), range(64) b(j) GROUP BY j),
    x AS (SELECT vec_id, j, greatest(-1.0, least(1.0, list_inner_product(list_transform(embedding, lambda v: v::DOUBLE / sqrt({_dot('embedding', 'embedding')})), w))) AS x FROM embeddings, turn)
"""
CODES_SQL = f"""
    WITH {ROTATED_SQL},
    c AS (SELECT *, len(list_filter(list_transform(range(1, 8), lambda i: (({CENTROIDS})[i] + ({CENTROIDS})[i + 1]) / 2)::DOUBLE[], lambda e: e <= x)) AS code FROM x)
    SELECT vec_id, md5(string_agg(code::VARCHAR, ',' ORDER BY j)) AS codes, round(sqrt(sum(pow(x - ({CENTROIDS})[code + 1], 2))), 3) AS gamma FROM c GROUP BY vec_id"""


@registered("R03_rotation", f"WITH {ROTATED_SQL} SELECT vec_id, round(max(x) FILTER (j = 0), 5) + 0.0 AS first, round(max(x) FILTER (j = 37), 5) + 0.0 AS middle, round(max(x) FILTER (j = 63), 5) + 0.0 AS last, true AS back FROM x GROUP BY vec_id")
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rotated coordinates of each unit vector, and whether turning back gives the vector."""
    kept = _vectors(spark, sf_dir).withColumn("embedding", V.unit(F.col("embedding"))).select("vec_id", "embedding")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).values.to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
                y = rotation.rotate(x)
                back = np.abs(rotation.rotate_back(y, x.shape[1]) - x).max(1) < 1e-9
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(y[:, j]) for j in (0, 37, 63)), pa.array(back)], ["vec_id", "first", "middle", "last", "back"])

    found = kept.mapInArrow(run, "vec_id bigint, first double, middle double, last double, back boolean")
    return found.select("vec_id", *(V.rounded(F.col(c), 5).alias(c) for c in ("first", "middle", "last")), "back")


@registered("C04_codes", CODES_SQL)
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes as an index stores them, unpacked, and residual norms before they are stored in float32, where some would round to other decimals."""
    kept = _vectors(spark, sf_dir).withColumn("embedding", V.unit(F.col("embedding"))).select("vec_id", "embedding")
    made = codec.Codec(64, 4)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).values.to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
                codes, signs, gamma = made.encode(made.rotate(x))
                codes = made.unpack(*made.pack(codes, signs))[0]
                text = [",".join(map(str, row)) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text), pa.array(gamma)], ["vec_id", "codes", "gamma"])

    found = kept.mapInArrow(run, "vec_id bigint, codes string, gamma double")
    return found.select("vec_id", F.md5(F.col("codes").cast("binary")).alias("codes"), V.rounded(F.col("gamma"), 3).alias("gamma"))


@registered("K07_assign_lists", """
    SELECT b.vec_id, min_by(a.vec_id, (round(pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 9), a.vec_id))::INT AS list_id
    FROM embeddings a, embeddings b WHERE a.vec_id < 8 GROUP BY b.vec_id""")
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    rows = _vectors(spark, sf_dir)
    centroids = np.asarray([r[0] for r in rows.where("vec_id < 8").orderBy("vec_id").select("embedding").collect()])
    return index.assign_lists(rows.select("vec_id", "embedding"), centroids).select("vec_id", "list_id")


@registered("F07_page_synopsis", """
    WITH r AS (SELECT vec_id // 16 AS page_id, CASE WHEN vec_id % 3 <> 0 THEN label END AS a, (vec_id // 64)::INT AS b FROM embeddings)
    SELECT page_id, min(a) AS a_min, max(a) AS a_max, bool_or(a IS NULL) AS a_null_any, bool_and(a IS NULL) AS a_null_all, (min(a) IS NOT DISTINCT FROM max(a) AND NOT bool_or(a IS NULL)) AS a_all_same,
        min(b) AS b_min, max(b) AS b_max, bool_or(b IS NULL) AS b_null_any, bool_and(b IS NULL) AS b_null_all, (min(b) IS NOT DISTINCT FROM max(b) AND NOT bool_or(b IS NULL)) AS b_all_same FROM r GROUP BY page_id""")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 16).alias("page_id"), F.when(F.col("vec_id") % 3 != 0, F.col("label")).alias("a"), F.floor(F.col("vec_id") / 64).cast("int").alias("b")
    )
    return rows.groupBy("page_id").agg(*index.attribute_ranges(["a", "b"]))


@registered("F03_is_null_filter", f"SELECT vec_id, distance FROM ({NEAR_ZERO}) WHERE vec_id % 3 = 0 ORDER BY distance, vec_id LIMIT 10")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumn("lang", F.when(F.col("vec_id") % 3 != 0, F.col("label")))
    return knn.exact_knn(rows, _probe(spark, sf_dir), 10, id_col="vec_id", filters={"lang": None})


@registered("A02_list_counts", "SELECT label, count(*) FILTER (vec_id % 7 <> 0) AS live, count(*) FILTER (vec_id % 7 = 0) AS dead, count(DISTINCT vec_id // 16) AS pages FROM embeddings GROUP BY label")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.list_counts(_vectors(spark, sf_dir), "label", F.col("vec_id") % 7 != 0, F.floor(F.col("vec_id") / 16))


@registered("A05_upkeep", """
    WITH c AS (SELECT label, count(*) AS live, count(*) FILTER (vec_id % (2 + label) = 0 AND label > 1) AS delta, count(*) FILTER (vec_id % (3 + 2 * label) = 0 AND label % 3 > 0) AS dead, label % 5 AS reclaimable FROM embeddings GROUP BY label),
    d AS (SELECT *, ceil(delta / 16)::INT AS pages FROM c),
    f AS (SELECT *, delta > 0 AND (delta >= 256 OR pages >= 8 OR delta / live >= 0.1) AS merge, (dead > 0 AND dead / (live + dead) >= 0.1) OR reclaimable >= 4 AS compact FROM d)
    SELECT label, CASE WHEN merge AND compact THEN 'merge_delta_and_compact' WHEN merge THEN 'merge_delta' WHEN compact THEN 'compact' WHEN delta > 0 OR dead > 0 OR reclaimable > 0 THEN 'observe' ELSE 'healthy' END AS action FROM f""")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each label's rows would ask for as an index, some in the delta and some dead."""
    n, label = F.col("vec_id"), F.col("label")
    delta, dead = (n % (2 + label) == 0) & (label > 1), (n % (3 + 2 * label) == 0) & (label % 3 > 0)
    counts = _vectors(spark, sf_dir).groupBy("label").agg(F.count("*"), F.count(F.when(delta, 1)), F.count(F.when(dead, 1))).collect()
    rows = [(r[0], budget.maintenance_action(r[1], r[2], -(-r[2] // 16), r[3], r[0] % 5, MaintenanceKnobs())) for r in counts]
    return spark.createDataFrame(rows, "label int, action string")


@registered("P06_crossover", """
    WITH c AS (SELECT label, sum(count(*)) OVER (ORDER BY label) AS taken, sum(count(*)) OVER () AS total FROM embeddings GROUP BY label)
    SELECT label, taken::BIGINT AS taken, taken >= ceil(0.7 * total) AS near FROM c""")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the labels up to each make a search near-exhaustive, were labels lists."""
    counts = sorted(_vectors(spark, sf_dir).groupBy("label").count().collect())
    total, taken, rows = sum(c for _, c in counts), 0, []
    for label, count in counts:
        taken += count
        rows.append((label, taken, budget.near_exhaustive(taken, total, 0, 0)))
    return spark.createDataFrame(rows, "label int, taken bigint, near boolean")


@registered("P15_cost", """
    WITH g AS (SELECT n, l, p FROM (SELECT unnest([100.0, 10000.0, 1000000.0]) AS n), (SELECT unnest([0, 16, 256]) AS l), (SELECT unnest([1, 8]) AS p)),
    f AS (SELECT *, CASE WHEN l = 0 THEN 1.0 ELSE least(l, p) END AS probes, CASE WHEN l = 0 THEN 1.0 ELSE least(l, p) / l END AS share FROM g),
    c AS (SELECT *, least(greatest(p * 8, 10), n * share) AS candidates, greatest(1, n / 16 * share) AS pages FROM f),
    s AS (SELECT *, 1 + CASE WHEN l = 0 THEN 0 ELSE 3 + 0.1 * l + 0.00125 * probes END + 0.00125 * candidates AS startup FROM c)
    SELECT n::DOUBLE AS n, l, p, round(startup::DOUBLE / 7, 4) AS startup, round((startup + 0.6 * pages + n * share * 0.01 + 0.005 + greatest(1, candidates) * 0.21)::DOUBLE / 7, 4) AS total FROM s""")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for n in (100.0, 10_000.0, 1_000_000.0):
        for lists in (0, 16, 256):
            for p in (1, 8):
                cost = budget.estimate_cost(n, n / 16, lists, p, 8, output_rows=10)
                rows.append((n, lists, p, round(cost.startup / 7, 4), round(cost.total / 7, 4)))
    return spark.createDataFrame(rows, "n double, l int, p int, startup double, total double")


@registered("J03_query_as_a_row", f"SELECT vec_id, distance FROM ({NEAR_ZERO}) ORDER BY distance, vec_id LIMIT 10")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return knn.knn_of_row(rows, rows.where("vec_id = 0"), 10, id_col="vec_id")


@registered("J06_diagnostics", "SELECT a.vec_id, a.label AS dataset, b.vec_id AS found FROM embeddings a LEFT JOIN embeddings b ON a.vec_id = b.vec_id AND b.label < 4")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select(F.col("label").alias("dataset"), F.col("vec_id").alias("system_id"))
    joined = campaign.with_diagnostics(rows, rows.where("dataset < 4").withColumn("found", F.col("system_id")))
    return joined.select(F.col("system_id").alias("vec_id"), "dataset", "found")


@registered("U02_array_sets", RUNS + """
    SELECT query_id, array_to_string(list_sort(list_intersect(retrieved, relevant)), ',') AS both, array_to_string(list_sort(list_filter(retrieved, lambda x: NOT list_contains(relevant, x))), ',') AS only FROM runs""")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return _runs(spark, sf_dir).select("query_id", text(evaluate.found_ids()).alias("both"), text(evaluate.other_ids()).alias("only"))


@registered("X07_json_access", """SELECT vec_id, (label + 1)::VARCHAR AS a, 'x' AS b, 'new' AS c, CASE WHEN vec_id % 2 = 0 THEN 'old' END AS d FROM embeddings""")
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a nested document, and of a flat one over which another is laid."""
    made = F.to_json(F.struct((F.col("label") + 1).alias("a"), F.struct(F.lit("x").alias("c")).alias("b")))
    laid = X.json_merged(F.when(F.col("vec_id") % 2 == 0, F.lit('{"c": "old", "d": "old"}')), F.lit('{"c": "new"}'))
    return _vectors(spark, sf_dir).select("vec_id", X.json_value(made, "a").alias("a"), X.json_value(made, "b", "c").alias("b"), X.json_value(laid, "c").alias("c"), X.json_value(laid, "d").alias("d"))


@registered("P13_recommended_knobs", """
    SELECT label, greatest(1, ceil(c / greatest(8, ceil(c / f))))::INT AS probes, greatest(8, ceil(c / f))::INT AS oversample
    FROM (SELECT label, (20 + label * 30)::DOUBLE AS c, 10.0::DOUBLE AS f FROM embeddings GROUP BY label)""")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knobs for each label's limits, through the SQL table function."""
    register.register(spark)
    _vectors(spark, sf_dir).select("label").distinct().createOrReplaceTempView("limits_by_label")
    return spark.sql("SELECT label, k.probes, k.oversample_factor AS oversample FROM limits_by_label, LATERAL vec_recommended_knobs(int(20 + label * 30), 10, CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS STRING)) k")


@registered("P14_index_aware_knobs", """
    WITH n AS (SELECT count(*)::DOUBLE AS live FROM embeddings), s AS (SELECT unnest([0.02, 0.25, 1.0]) AS asked), k AS (SELECT asked, live, greatest(asked, 0.05)::DOUBLE AS share, least(live, ceil(100 / greatest(asked, 0.05)::DOUBLE)) AS wanted FROM s, n)
    SELECT asked::DOUBLE AS selectivity, 10 AS probes, least(1024, greatest(10, ceil(wanted / 10)))::INT AS oversample, greatest(1000, wanted * greatest(2, least(16, greatest(10, ceil(wanted / 10)))))::BIGINT AS codes, 0 AS pages FROM k""")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knobs that a flat index of the table is advised, by selectivity."""
    meta = _built(spark, sf_dir).metadata()
    rows = []
    for share in (0.02, 0.25, 1.0):
        k = budget.recommend_knobs(100, 10, meta, share)
        rows.append((share, k["probes"], k["oversample_factor"], k["max_visited_codes"], k["max_visited_pages"]))
    return spark.createDataFrame(rows, "selectivity double, probes int, oversample int, codes bigint, pages int")


@registered("H10_campaign_recall", f"""
    WITH n AS (SELECT count(*) AS query_count FROM embeddings WHERE vec_id % 50 = 0)
    SELECT s AS system_id, query_count, CASE WHEN s LIKE 'quantized_approx' THEN NULL ELSE 1.0 END AS recall, CASE WHEN s LIKE 'quantized_approx' THEN NULL ELSE 1.0 END AS ndcg, true AS high
    FROM n, (SELECT unnest(['exact_approx', 'float_lists_approx', 'float_lists_rerank', 'quantized_approx', 'quantized_rerank', 'exact_rerank']) AS s)""")
def h10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each system's metrics at 10 over the whole query set, all lists probed; what codes alone find has only a floor."""
    built, asked = _built(spark, sf_dir, bits=8, lists=4), _asked(spark, sf_dir)
    ids = F.collect_list(F.col("id").cast("string"))
    truth = _batch(spark, sf_dir, 10).groupBy(F.col("qid").alias("query_id")).agg(ids.alias("relevant")).withColumn("evidence", F.col("relevant"))
    found = campaign.run({"embeddings": campaign.Dataset(built, asked, truth)}, k=10, depth=200, knobs=QueryKnobs(probes=4, oversample_factor=64))["retrieval"]
    exact = lambda c: F.when(F.col("system_id") != "quantized_approx", F.col(c)).alias(c)
    return found.select("system_id", "query_count", exact("recall"), exact("ndcg"), (F.col("recall") >= 0.9).alias("high"))


@registered("M02_stream_into_index", f"SELECT vec_id, distance FROM ({NEAR_ZERO}) WHERE vec_id % 5 <> 0 ORDER BY distance, vec_id LIMIT 10")
def m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of inserts and deletes over an index of half the rows, then a search with exact distances."""
    rows = _vectors(spark, sf_dir).withColumn("tenant", (F.col("vec_id") % 4).cast("int"))
    path = files.scratch(spark, "index")
    index.VectorIndex.build(rows.where("vec_id % 2 = 0"), path, IndexOptions(bits=8, lists=4), id_col="vec_id")
    stream = spark.readStream.schema(_vectors(spark, sf_dir).schema).parquet(f"{sf_dir}/embeddings.parque[t]")  # a pattern, as a stream's path can't be a file
    events = stream.select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("vec_id") % 5 == 0, "delete").otherwise("insert").alias("op"), F.col("vec_id").alias("seq"))
    index_sink(events, path, files.scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return _reranked(index.VectorIndex.load(spark, path), _probe(spark, sf_dir), 10, QueryKnobs(oversample_factor=16))


@registered("H12_campaign_plan", """
    SELECT d || ':' || s || ':' || k AS scenario_id FROM (SELECT unnest(['nq', 'hotpot']) AS d), (SELECT unnest(['quantized_approx', 'quantized_rerank', 'exact_approx', 'exact_rerank', 'float_lists_approx', 'float_lists_rerank']) AS s),
    (SELECT unnest(['retrieval_only', 'end_to_end']) AS k)""")
def h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.plan(spark, ["nq", "hotpot"]).select("scenario_id")


@registered("H14_regression_gate", RUNS + """
    , m AS (SELECT avg(CASE WHEN len(relevant) > 0 THEN len(list_intersect(retrieved, relevant)) / len(relevant) ELSE 0 END) AS recall FROM runs),
    b AS (SELECT count(*) FILTER (label < 4) / count(*) AS codes, count(*) FILTER (label < 8) / count(*) AS pages FROM embeddings)
    SELECT name, passed FROM (SELECT 'recall_floor' AS name, recall >= 0.3 AS passed FROM m UNION ALL SELECT 'visited_code_fraction', codes <= 0.7 FROM b UNION ALL SELECT 'visited_page_fraction', pages <= 0.7 FROM b
        UNION ALL SELECT 'score_mode', true UNION ALL SELECT 'probes', true)""")
def h14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on a run's own recall, and on shares of the table as what was visited."""
    recall = evaluate.retrieval_metrics(_runs(spark, sf_dir), 10).select("recall")
    share = lambda most: F.avg((F.col("label") < most).cast("int"))
    row = recall.withColumn("one", F.lit(1)).join(_vectors(spark, sf_dir).agg(share(4).alias("visited_code_fraction"), share(8).alias("visited_page_fraction")).withColumn("one", F.lit(1)), "one")
    row = row.withColumns({"dataset": F.lit("hotpot"), "system_id": F.lit("quantized_rerank"), "score_mode": F.lit("decoded"), "probes": F.lit(4.0)})
    return campaign.gate(row, campaign.Gate("hotpot", "quantized_rerank", 0.3, 0.7, 0.7, "decoded", 8)).select("name", "passed")


@registered("I04_shadow_candidates", """SELECT 64::BIGINT AS overlap, 0::BIGINT AS left_only, 0::BIGINT AS right_only""")
def i04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the estimator and by decoded inner products; the two agree up to rounding."""
    built, query = _built(spark, sf_dir, bits=4, metric="ip"), _probe(spark, sf_dir)
    first, _ = built.search(query, 64)
    second, _ = built.search(query, 64, QueryKnobs(force_decode_score_diagnostics=True))
    return evaluate.overlap(first, second)


@registered("P10_two_pass_pruning", f"SELECT vec_id, distance FROM ({NEAR_ZERO}) ORDER BY distance, vec_id LIMIT 10")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose bound can't reach the threshold of a first pass aren't scored; the result stays that of a full scan."""
    built, query = _built(spark, sf_dir, bits=8, lists=8, metric="ip"), _probe(spark, sf_dir)
    found = built.completed(built.search_pruned(query, 128)[0], query, 10, metric="cosine")
    return knn.exact_rerank(built.rows().withColumnRenamed("id", "vec_id"), found.withColumnRenamed("id", "vec_id"), query, 10, "cosine", "vec_id")


@registered("S02_code_recall", "SELECT bits, n AS truth, true AS reached FROM (VALUES (2), (4), (8)) t(bits), (SELECT 10 * count(*) AS n FROM embeddings WHERE vec_id % 50 = 0)")
def s02_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the decoded cosine of flat codes reaches the recall at 10 that its number of bits should have."""
    floors = {2: 0.35, 4: 0.7, 8: 0.9}
    truth = _batch(spark, sf_dir, 10).select("qid", "id")
    parts = []
    for bits, floor in floors.items():
        found = _built(spark, sf_dir, bits=bits).search_batch(_asked(spark, sf_dir), 10)
        hits = found.join(truth, ["qid", "id"], "left_semi").agg(F.count("*").alias("hits")).crossJoin(truth.agg(F.count("*").alias("all")))
        parts.append(hits.select(F.lit(bits).alias("bits"), F.col("all").alias("truth"), (F.col("hits") >= floor * F.col("all")).alias("reached")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
