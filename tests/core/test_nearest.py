"""Blocks of queries against vectors: bounded in memory, without a join of pairs, exact also where copies tie."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec.functions import vectors as V
from lodevec.operators import campaign, knn
from lodevec.operators.codec import Codec
from lodevec.operators.index import VectorIndex
from lodevec.plans.options import IndexOptions, QueryKnobs


def unit_rows(rng, n, size=16):
    x = rng.normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
@pytest.mark.parametrize("k", [1, 7, 400])
def test_kept_rows_are_the_nearest(metric, k):
    rng = np.random.default_rng(k)
    x = np.concatenate([unit_rows(rng, 60)] * 50 + [np.zeros((3, 16)), 3 * unit_rows(rng, 40)])
    keys, q = rng.permutation(len(x)), np.concatenate([x[:20], np.zeros((1, 16))])
    asking = np.arange(0, len(q), 2)
    best = knn.Nearest(metric, q, k)
    for at in range(0, len(x), 500):
        best.meet(keys[at : at + 500], x[at : at + 500], asking)
    found = {}
    for batch in best.batches([f"q{n}" for n in range(len(q))]):
        for name, key, distance in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault(name, []).append((distance, key))
    distances = np.round(knn.batch_distances(metric, q, x), 6) + 0.0
    assert sorted(found) == sorted(f"q{n}" for n in asking)
    for n in asking:
        assert found[f"q{n}"] == sorted(zip(distances[n].tolist(), keys.tolist(), strict=True))[:k]


def test_float_lists_join_no_pairs(spark, tmp_path):
    """Each query met each row of its lists as a row of a join, so the time grew with their product."""
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit_rows(np.random.default_rng(1), 200))], "id long, embedding array<float>")
    built = VectorIndex.build(rows, f"file://{tmp_path}/index", IndexOptions(bits=2, lists=4))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    plan = campaign.retrieve(built, asked, 5, "float_lists_approx", knobs=QueryKnobs(probes=2))._jdf.queryExecution().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    assert campaign.retrieve(built, asked.where("false"), 5, "float_lists_approx").count() == 0


def test_a_campaign_makes_its_truth_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit_rows(np.random.default_rng(2), 100))], "id long, embedding array<float>")
    built = VectorIndex.build(rows, f"file://{tmp_path}/index", IndexOptions(bits=8, lists=2))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    near = knn.batch_knn(rows, asked, 5).groupBy(F.col("qid").alias("query_id")).agg(F.collect_list(F.col("id").cast("string")).alias("relevant"))
    truth = near.withColumn("evidence", F.col("relevant")).mapInArrow(count, "query_id long, relevant array<string>, evidence array<string>")
    found = campaign.run({"d": campaign.Dataset(built, asked, truth)}, ["exact_approx", "float_lists_approx", "exact_rerank"], k=5, depth=10, knobs=QueryKnobs(probes=2))
    assert [r.recall for r in found["retrieval"].collect()] == [1.0] * 3 and made.value == 5


def test_length_is_worked_out_once(spark):
    frame = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    scaled = V.unit(F.col("v"))
    assert [r[0] for r in frame.select(scaled).collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert str(scaled).lower().count("sqrt") == 1


def crowd(spark, seed=5):
    """300 random rows, and 700 near copies of one vector, of which a code can't tell which are nearest; each ten of them are exact copies."""
    rng = np.random.default_rng(seed)
    base, others = unit_rows(rng, 1, 64), unit_rows(rng, 300, 64)
    near = base + rng.normal(size=(70, 64)) * 0.01
    x = np.concatenate([others, np.repeat(near / np.linalg.norm(near, axis=1)[:, None], 10, axis=0)]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    return x, base[0], spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")


def slow_nearest(x, query, metric="cosine"):
    distances = np.round(knn.batch_distances(metric, query[None, :], x.astype(np.float64))[0], 6)
    return [(int(i), float(distances[i])) for i in np.lexsort((np.arange(len(x)), distances))]


@pytest.mark.parametrize(("bits", "codec", "metric"), [(2, "lloyd", "cosine"), (8, "lloyd", "ip"), (6, "companding", "cosine"), (4, "lloyd", "l2")])
def test_codes_lose_none_of_the_nearest(spark, tmp_path, bits, codec, metric):
    x, query, rows = crowd(spark)
    built = VectorIndex.build(rows.where("id % 4 <> 0"), f"file://{tmp_path}/index", IndexOptions(bits=bits, codec=codec, lists=3, metric=metric))
    built.insert(rows.where("id % 4 = 0"))
    found, stats = built.search(query.tolist(), 20, QueryKnobs(probes=4, oversample_factor=5))
    whole = built.completed(found, query.tolist(), 10, stats.selected_lists)
    got = [(r.id, round(r.distance, 6)) for r in knn.exact_rerank(built.rows(), whole, query.tolist(), 10, metric).collect()]
    assert got == slow_nearest(x, query, metric)[:10]
    assert bits < 8 or whole.count() <= 700  # what is far by its code is left out


def test_rerank_keeps_the_least_ids_of_equal_distances(spark, tmp_path):
    """Of copies those of least id stay, not those whose id comes first as a text."""
    _, _, rows = crowd(spark)
    copies = spark.range(30).selectExpr("id + 995 AS id").crossJoin(rows.where("id = 0").select("embedding"))
    query = rows.where("id = 0").first().embedding
    built = VectorIndex.build(copies, f"file://{tmp_path}/index", IndexOptions(bits=8))
    wanted = [str(i) for i in sorted(range(995, 1003), key=str)]
    for frame in (built.rerank(query, 20, 8), knn.rerank_candidates(copies, query, 20, 8)):
        assert [r.candidate_id for r in frame.orderBy("exact_rank").collect()] == wanted


@pytest.mark.parametrize(("bits", "most"), [(2, 0.15), (4, 0.015), (8, 0.0002)])
def test_the_sketch_takes_back_most_of_the_error(bits, most):
    """With two bits the error was 0.28; then too few of the nearest of a large table were found by codes."""
    made, x = Codec(64, bits), unit_rows(np.random.default_rng(9), 20_000, 64)
    rotated = made.rotate(x)
    decoded = made.decode(*made.encode(rotated))
    assert ((decoded - rotated) ** 2).sum(1).mean() < most
    q = rotated[:100]
    exact, by_code = (np.argsort(-(q @ y.T) / np.sqrt((y**2).sum(1)), axis=1)[:, :10] for y in (rotated, decoded))
    found = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.tolist(), by_code.tolist(), strict=True)])
    assert found >= {2: 0.45, 4: 0.75, 8: 0.95}[bits]
