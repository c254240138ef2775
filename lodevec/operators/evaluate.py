"""Retrieval and answer quality, latency and footprint as aggregations over query rows.

Query rows have ``query_id``, ``retrieved`` (ids, best first), ``relevant``, ``evidence`` and ``latency_ms``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.sources.files import settle


def _top(k: int, retrieved: str = "retrieved") -> Column:
    return F.slice(retrieved, 1, k)


def recall_at(k: int, retrieved: str = "retrieved", relevant: str = "relevant") -> Column:
    """Share of the relevant ids among the first k; 0 where nothing is relevant."""
    found = F.size(F.array_intersect(_top(k, retrieved), F.col(relevant)))
    total = F.size(F.array_distinct(relevant))
    return F.when(total > 0, found / total).otherwise(0.0)


def reciprocal_rank_at(k: int, retrieved: str = "retrieved", relevant: str = "relevant") -> Column:
    ranks = F.filter(F.transform(_top(k, retrieved), lambda x, i: F.when(F.array_contains(F.col(relevant), x), i + 1)), lambda r: r.isNotNull())
    return F.when(F.size(ranks) > 0, 1 / F.array_min(ranks)).otherwise(0.0)


def ndcg_at(k: int, retrieved: str = "retrieved", relevant: str = "relevant") -> Column:
    """Binary gains, discounted by log2 of the rank and one, over the best that k ids could have."""
    gains = F.transform(_top(k, retrieved), lambda x, i: F.when(F.array_contains(F.col(relevant), x), 1 / F.log2(i + 2)).otherwise(0.0))
    best = F.least(F.size(F.array_distinct(relevant)), F.lit(k))
    ideal = F.aggregate(F.when(best > 0, F.sequence(F.lit(1), best)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return F.when(best > 0, F.aggregate(gains, F.lit(0.0), lambda s, g: s + g) / F.when(best > 0, ideal)).otherwise(0.0)


def hit_at(k: int, wanted: str = "relevant", retrieved: str = "retrieved") -> Column:
    """1 where any wanted id is among the first k, else 0; also for no wanted ids."""
    return F.coalesce(F.arrays_overlap(_top(k, retrieved), F.col(wanted)).cast("int"), F.lit(0))


def retrieval_metrics(rows: DataFrame, k: int = 10) -> DataFrame:
    """One row: means over queries, latency percentiles (linear) and queries a second.

    Queries without a latency count for all but the latencies; without any these are null.
    """
    r = lambda c: F.round(c, 6) + F.lit(0.0)
    means = rows.agg(
        F.count("*").alias("query_count"),
        r(F.avg(recall_at(k))).alias("recall"),
        r(F.avg(reciprocal_rank_at(k))).alias("mrr"),
        r(F.avg(ndcg_at(k))).alias("ndcg"),
        r(F.avg(hit_at(k))).alias("hit_rate"),
        r(F.avg(hit_at(k, "evidence"))).alias("evidence_coverage"),
        r(F.when(F.sum("latency_ms") > 0, F.count("latency_ms") * 1000 / F.sum("latency_ms")).otherwise(0.0)).alias("qps"),
    )
    ranks = percentiles(rows, "latency_ms", {f"p{p}_ms": p / 100 for p in (50, 95, 99)}).withColumn("one", F.lit(1))
    joined = means.withColumn("one", F.lit(1)).join(ranks, "one", "left")
    return joined.select(*means.columns[:-1], *(r(F.col(f"p{p}_ms")).alias(f"p{p}_ms") for p in (50, 95, 99)), "qps")


def exact_fraction(rows: DataFrame, found: str = "found", wanted: str = "wanted") -> DataFrame:
    """One row: the share of queries whose found ids are just the wanted ones, and how many ids are found on average.

    Order and repeats of ids don't matter; null lists are empty; without queries both are null.
    """
    plain = lambda c: F.sort_array(F.array_distinct(F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))))
    r = lambda c: F.round(c, 6) + F.lit(0.0)
    return rows.agg(F.count("*").alias("query_count"), r(F.avg((plain(found) == plain(wanted)).cast("int"))).alias("exact_match_fraction"), r(F.avg(F.size(plain(found)))).alias("avg_result_count"))


def comparisons(rows: DataFrame, metrics: Sequence[str], baselines: Sequence[str], group: str = "dataset", system: str = "system_id") -> DataFrame:
    """Each system beside each baseline of its group: ``(group, candidate, baseline, metric, candidate_value, baseline_value, difference, ratio)``.

    A row a group, pair and metric that both have; a ratio to 0 is null. Rows of reports are few, so the join is small.
    """
    long = rows.select(group, system, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([group, system], list(metrics), "metric", "value").where("value is not null")
    base = long.where(F.col(system).isin(list(baselines))).select(group, F.col(system).alias("baseline"), "metric", F.col("value").alias("baseline_value"))
    both = long.select(group, F.col(system).alias("candidate"), "metric", F.col("value").alias("candidate_value")).join(base, [group, "metric"]).where("candidate <> baseline")
    r = lambda c: F.round(c, 6) + F.lit(0.0)
    a, b = F.col("candidate_value"), F.col("baseline_value")
    return both.select(group, "candidate", "baseline", "metric", a, b, r(a - b).alias("difference"), r(F.when(b != 0, a / b)).alias("ratio"))


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], groups: Sequence[str] = (), nearest: bool = False) -> DataFrame:
    """Exact percentiles of each group, a column each: ``(groups..., names...)``, linear between places or by nearest rank.

    Equal values are counted first, then groups and values are dealt out by range, so a group may span all tasks and no task
    holds one. What comes before a part of a group is a running sum over parts. Null values don't count; a group
    without values has no row; no rows give none.
    """
    keys = [F.col(g) for g in groups] or [F.lit(0).alias("all")]
    names = list(groups) or ["all"]
    counted = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v")).groupBy(*names, "v").agg(F.count("*").alias("n"))
    dealt = settle(counted.repartitionByRange(*names, "v").select("*", F.spark_partition_id().alias("part")), "percentiles")
    parts = dealt.groupBy("part", *names).agg(F.sum("n").alias("m"), F.min("v").alias("low"))
    whole = Window.partitionBy(*names)
    before = F.coalesce(F.sum("m").over(whole.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", *(F.col(g).alias(f"of_{g}") for g in names), before.alias("before"), F.sum("m").over(whole).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("part", *names).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in names))
    ranked = dealt.withColumn("inside", inside).join(parts.withColumnRenamed("part", "of_part"), same & (F.col("part") == F.col("of_part")))
    last = F.col("before") + F.col("inside")  # the place of the row's last equal, from 1
    found = []
    for name, share in shares.items():
        place = F.greatest(F.ceil(F.round(share * F.col("total"), 9)), F.lit(1)).cast("double") if nearest else share * (F.col("total") - 1) + 1
        at = lambda p: F.max(F.when((last - F.col("n") < p) & (p <= last), F.col("v")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        found.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return ranked.groupBy(*names).agg(*found).select(*groups, *shares)


def distributions(rows: DataFrame, stages: Sequence[str], id_cols: Sequence[str] = ()) -> DataFrame:
    """Count, mean and percentiles of each stage's values, without nulls: ``(stage, n, avg, p50, p95, p99)``.

    Stages without values have no row.
    """
    long = rows.unpivot(list(id_cols), list(stages), "stage", "value").where("value is not null")
    r = lambda c: F.round(c, 6) + F.lit(0.0)
    sums = long.groupBy("stage").agg(F.count("*").alias("n"), r(F.avg("value")).alias("avg"))
    ranks = percentiles(long, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["stage"])
    return sums.join(ranks, "stage").select("stage", "n", "avg", *(r(F.col(p)).alias(p) for p in ("p50", "p95", "p99")))


def cost_summary(costs: DataFrame) -> DataFrame:
    """``(name, unit, n, total, avg)`` of rows ``(name, unit, value)``; raises where a name has two units."""
    found = costs.groupBy("name").agg(F.collect_set("unit").alias("units"), F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 6).alias("avg"))
    one = F.when(F.size("units") <= 1, F.element_at("units", 1)).otherwise(F.raise_error(F.concat(F.lit("several units of cost "), F.col("name"))))
    return found.select("name", F.when(F.size("units") > 0, one).alias("unit"), "n", "total", "avg")


def scan_stat_summary(stats: DataFrame, numbers: Sequence[str], labels: Sequence[str], most: int = 1000) -> DataFrame:
    """``(name, n, avg, p50, p95, values, uniform)``: distributions of numbers (true counts 1), distinct values of labels.

    A label is a mode or a kind; one of more than ``most`` different values is an error, as it isn't one. Names
    without values have no row.
    """
    none = F.lit(None)
    parts = []
    if numbers:
        dealt = distributions(stats.select(*(F.col(n).cast("double").alias(n) for n in numbers)), numbers)
        parts.append(dealt.select(F.col("stage").alias("name"), "n", "avg", "p50", "p95", none.cast("array<string>").alias("values"), none.cast("boolean").alias("uniform")))
    for name in labels:
        seen = stats.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy("value").limit(most + 1)
        values = F.sort_array(F.collect_list("value"))
        checked = F.when(F.count("*") <= most, values).otherwise(F.raise_error(F.lit(f"{name} has too many values for a label")))
        told = seen.agg(F.lit(name).alias("name"), F.sum("n").alias("n"), *(none.cast("double").alias(c) for c in ("avg", "p50", "p95")), checked.alias("values"), (F.count("*") == 1).alias("uniform"))
        parts.append(told.where("n is not null"))
    return reduce(DataFrame.unionByName, parts)


def multihop(rows: DataFrame, k: int) -> DataFrame:
    """Per query, which supporting ids are among the first k and which aren't, in their own order, and whether all are."""
    top = _top(k)
    inside = F.filter("supporting", lambda s: F.array_contains(top, s))
    missing = F.filter("supporting", lambda s: ~F.array_contains(top, s))
    return rows.select("query_id", inside.alias("retrieved_supporting"), missing.alias("missing_supporting"), (F.size(missing) == 0).cast("int").alias("covered"))


def candidate_retention(pairs: DataFrame, ks: Sequence[int] = (10, 100)) -> DataFrame:
    """How many of the exact first k the candidates hold: mean, worst and misses, of rows ``(query_id, exact, candidates)``."""
    parts = []
    for k in ks:
        best = F.slice("exact", 1, k)
        kept = F.size(F.array_intersect(best, F.col("candidates")))
        share = kept / F.greatest(F.size(best), F.lit(1))
        parts.append(pairs.agg(F.lit(k).cast("long").alias("k"), F.round(F.avg(share), 6).alias("avg_retention"), F.round(F.min(share), 6).alias("worst_retention"), F.sum((F.size(best) - kept).cast("long")).alias("misses")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def estimator_quality(rows: DataFrame) -> DataFrame:
    """Error of estimates ``(query_id, id, exact, estimate)`` and how far ranks move."""
    by = Window.partitionBy("query_id")
    shift = F.abs(F.row_number().over(by.orderBy("exact", "id")) - F.row_number().over(by.orderBy("estimate", "id")))
    ranked = rows.withColumns({"error": F.col("estimate") - F.col("exact"), "shift": shift})
    r = lambda c: F.round(c, 6) + F.lit(0.0)
    return ranked.agg(r(F.avg("error")).alias("bias"), r(F.var_pop("error")).alias("variance"), r(F.avg(F.abs("error"))).alias("mae"), r(F.avg("shift")).alias("avg_rank_shift"), F.max("shift").cast("long").alias("max_rank_shift"))


def leaderboard(rows: DataFrame, metric: str, higher: bool = True, group: str = "dataset", system: str = "system_id") -> DataFrame:
    """The best row of each group, of equals the first system by name. Rows without the metric don't count."""
    order = F.col(metric).desc() if higher else F.col(metric).asc()
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order, system))
    return rows.where(F.col(metric).isNotNull()).withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def work_fractions(visited_codes: Column, live: Column, visited_pages: Column, index_bytes: Column, page_bytes: int = 8192) -> tuple[Column, Column]:
    """Visited shares of rows and of pages."""
    pages = F.ceil(index_bytes / page_bytes)
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return share(visited_codes, live), share(visited_pages, pages)


def overlap(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """Counts of ids in both, only left and only right: of two candidate sets of one search."""
    both = left.select(id_col).distinct().withColumn("l", F.lit(1)).join(right.select(id_col).distinct().withColumn("r", F.lit(1)), id_col, "full")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()
    return both.agg(count(l & r)("overlap"), count(l & ~r)("left_only"), count(~l & r)("right_only"))


def row_count(rows: DataFrame, emb_col: str = "embedding") -> DataFrame:
    """One row ``n``: how many rows have a vector."""
    return rows.where(F.col(emb_col).isNotNull()).agg(F.count("*").alias("n"))


def list_counts(rows: DataFrame, list_col: str, live: Column, page: Column) -> DataFrame:
    """``(list, live, dead, pages)`` of each list; a row whose ``live`` is null counts as dead."""
    alive = F.coalesce(live, F.lit(False)).cast("long")
    return rows.groupBy(list_col).agg(F.sum(alive).alias("live"), F.sum(1 - alive).alias("dead"), F.countDistinct(page).alias("pages"))


def ids_by(rows: DataFrame, group: str, id_col: str) -> DataFrame:
    """``(group, ids)``, ids ascending, of a result that a limit has bounded."""
    return rows.groupBy(group).agg(F.sort_array(F.collect_list(id_col)).alias("ids"))


def greatest_where(rows: DataFrame, group: str, value: str, conditions: dict[str, Column]) -> DataFrame:
    """Per group the greatest value under each condition, a column each; null where none holds."""
    return rows.groupBy(group).agg(*(F.max(F.when(c, F.col(value))).alias(name) for name, c in conditions.items()))


def found_ids(retrieved: str = "retrieved", relevant: str = "relevant") -> Column:
    """Retrieved ids that are relevant, ascending and each once."""
    return F.sort_array(F.array_intersect(retrieved, relevant))


def other_ids(retrieved: str = "retrieved", relevant: str = "relevant") -> Column:
    """Retrieved ids that aren't relevant, ascending and each once."""
    return F.sort_array(F.array_except(retrieved, relevant))


def index_health(codes: DataFrame, lists: int) -> DataFrame:
    """Of rows ``(list_id, live)``: a row with the distribution of live rows over all lists, empty ones as well."""
    every = codes.sparkSession.range(lists).select(F.col("id").cast("int").alias("list_id"))
    counts = every.join(codes.groupBy("list_id").agg(F.sum(F.col("live").cast("long")).alias("n")), "list_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    mean = F.avg("n")
    return counts.agg(
        F.min("n").alias("min_live"), F.max("n").alias("max_live"), F.round(mean, 2).alias("avg_live"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").cast("long").alias("p95_live"),
        F.round(F.stddev_pop("n") / mean, 4).alias("coeff_var"), F.round(F.max("n") / mean, 4).alias("max_over_avg"),
    )
