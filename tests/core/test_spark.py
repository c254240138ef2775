import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodevec.functions import register, text
from lodevec.functions import vectors as V
from lodevec.operators import campaign, evaluate, knn
from lodevec.operators.index import BrokenIndex, VectorIndex
from lodevec.plans import budget
from lodevec.plans.options import IndexOptions, QueryKnobs
from lodevec.sources import files, fixtures, ingest, reports
from lodevec.streaming.churn import index_sink


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("int").alias("label"), (F.col("vec_id") % 4).cast("int").alias("tenant"))


@pytest.fixture(scope="module")
def query(rows):
    return rows.where("id = 0").first()["embedding"]


def ids(frame):
    return [r[0] for r in frame.collect()]


def test_distances_of_odd_vectors(spark):
    data = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-3.0, 0.0]), (5, [0.0, 2.0])]
    frame = spark.createDataFrame(data, "id long, embedding array<float>")
    got = {r.id: (r.c, r.i, r.l) for r in frame.select("id", *(V.distance(m, F.col("embedding"), V.vector([2.0, 0.0])).alias(m[0]) for m in ("cosine", "ip", "l2"))).collect()}
    assert got[1] == (0.0, -2.0, 1.0) and got[2][0] == 1.0 and got[4] == (2.0, 6.0, 5.0) and got[5][0] == 1.0
    assert ids(knn.exact_knn(frame, [1.0, 0.0], 10)) == [1, 2, 5, 4]
    with pytest.raises(ValueError):
        V.check_metric("l1")


def test_half_precision(spark):
    values = [0.0, 1.0, 0.1, -0.3333, 65504.0, 65519.0, 65520.0, -1e6, 6e-8, 2e-8, 1e-5, 3.14159, 2049.0, 2051.0]
    frame = spark.createDataFrame([(values,)], "v array<float>")
    assert [float(x) for x in V.half_numpy(np.asarray(values, np.float32))] == frame.select(V.half(F.col("v"))).first()[0]


def test_unit_checks(spark):
    frame = spark.createDataFrame([([0.6, 0.8],), ([0.62, 0.8],)], "v array<float>")
    assert all(abs(sum(x * x for x in r[0]) - 1) < 1e-9 for r in frame.select(V.checked_unit(F.col("v"))).collect())
    for bad in ([2.0, 0.0], [0.0, 0.0]):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "v array<float>").select(V.checked_unit(F.col("v"))).collect()
    with pytest.raises(PySparkException):
        V.with_fixed_dimension(frame, "v", 3).collect()


def test_filters():
    with pytest.raises(ValueError):
        knn.filter_column({"a": list(range(17))})
    assert knn.filter_column({}) is None


def test_batch_agrees_with_single_queries(spark, rows):
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding")
    for metric in ("cosine", "ip", "l2"):
        found = {}
        for r in knn.batch_knn(rows, asked, 5, metric).orderBy("qid", "rank").collect():
            found.setdefault(r.qid, []).append(r.id)
        for r in asked.collect():
            assert found[r.qid] == ids(knn.exact_knn(rows, r.embedding, 5, metric))
    assert knn.batch_knn(rows, asked.where("false"), 5).count() == 0


def test_filters_reach_the_scan(rows, query):
    plan = knn.exact_knn(rows, query, 3, filters={"label": [1, 2]})._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "TakeOrderedAndProject" in plan


@pytest.fixture(scope="module")
def built(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('ivf')}/index"
    return VectorIndex.build(rows, path, IndexOptions(lists=6, attributes=("label", "tenant")))


def test_all_lists_give_what_a_flat_index_gives(spark, rows, query, built, tmp_path):
    flat = VectorIndex.build(rows, f"file://{tmp_path}/flat", IndexOptions())
    knobs = QueryKnobs(probes=6, oversample_factor=8)
    one, stats = flat.search(query, 48, knobs)
    two, other = built.search(query, 48, knobs)
    assert ids(one) == ids(two) and stats.mode == "flat" and other.mode == "ivf"
    assert one.count() == 48 and flat.search(query, 100)[0].count() == 64


def test_filters_act_before_ranking(rows, query, built):
    found, _ = built.search(query, 20, QueryKnobs(probes=6), {"tenant": 1, "label": [1, 2, 3]}, payload=["tenant", "label"])
    got = found.collect()
    assert len(got) == 20 and all(r.tenant == 1 and r.label in (1, 2, 3) for r in got)
    assert built.search(query, 5, filters={"label": []})[0].count() == 0 and built.search(query, 5, filters={"label": None})[0].count() == 0


def test_budgets_are_kept(query, built):
    _, free = built.search(query, 10, QueryKnobs(probes=6))
    _, tight = built.search(query, 10, QueryKnobs(probes=6, max_visited_codes=150))
    assert tight.selected_live_count <= 150 < free.selected_live_count and len(tight.selected_lists) < len(free.selected_lists)
    found, stats = built.search(query, 10, QueryKnobs(probes=6, iterative_scan="strict_order", min_rows_after_filter=5), {"tenant": 2})
    assert len(stats.selected_lists) <= 6 and found.count() >= 5


def test_probes_prune_partitions(query, built):
    found, stats = built.search(query, 10, QueryKnobs(probes=2))
    plan = found._jdf.queryExecution().toString()
    assert "list_id" in plan.split("PartitionFilters")[1][:200]
    assert len(stats.selected_lists) == 2


def test_churn(spark, rows, tmp_path):
    index = VectorIndex.build(rows.where("id < 300"), f"file://{tmp_path}/i", IndexOptions(lists=4, bits=8, attributes=("label", "tenant")))
    probe = rows.where("id = 400").first()["embedding"]
    assert 400 not in ids(index.search(probe, 5)[0])
    index.insert(rows.where("id >= 400"))
    index.delete(rows.where("id < 10"))
    index.upsert(rows.where("id = 20").withColumn("embedding", F.array(*map(F.lit, probe)).cast("array<float>")))
    before = set(ids(index.search(probe, 64, QueryKnobs(probes=4, oversample_factor=16))[0]))
    assert {20, 400} <= before and not before & set(range(10))
    meta = index.metadata()
    assert (meta["live_count"], meta["delta_live_count"], meta["dead_count"]) == (390, 101, 11) and meta["maintenance_action_recommended"] == "merge_delta"
    done = index.maintain()
    assert done["action"] == "merge_delta_and_compact" and done["after"] == "healthy" and index.rows().count() == 390
    again = VectorIndex.load(spark, index.path)
    assert again.version == 1 and set(ids(again.search(probe, 64, QueryKnobs(probes=4, oversample_factor=16))[0])) == before
    assert again.maintain()["action"] == "noop"


def test_empty_and_broken_indexes(spark, rows, tmp_path):
    path = f"file://{tmp_path}/e"
    index = VectorIndex.build(rows.where("false"), path, IndexOptions(lists=3, attributes=("label",)))
    assert index.search([1.0] * 64, 3)[0].count() == 0
    index.insert(rows)
    assert VectorIndex.load(spark, path).search(rows.first()["embedding"], 1)[0].first()[0] == 0
    with pytest.raises(ValueError, match="of length one"):
        index.search([1.0] * 64, 3)
    with pytest.raises(ValueError, match="dimensions"):
        index.search([1.0], 3)
    meta = json.loads(files.read_text(spark, f"{path}/meta-1.json"))
    files.write_text(spark, f"{path}/meta-1.json", json.dumps(meta | {"format_version": 99}))
    with pytest.raises(BrokenIndex, match="format"):
        VectorIndex.load(spark, path)
    files.write_text(spark, f"{path}/meta-1.json", "{")
    with pytest.raises(BrokenIndex):
        VectorIndex.load(spark, path)
    with pytest.raises(BrokenIndex):
        VectorIndex.load(spark, f"{path}-none")
    with pytest.raises(BrokenIndex):
        VectorIndex.build(rows.withColumn("bad", F.array("id")), f"{path}2", IndexOptions(attributes=("bad",)))


def test_other_metrics_and_long_vectors(spark, tmp_path):
    corpus = fixtures.corpus("non_normalized_varied_norms", "quick")
    frame = corpus.frame(spark)
    for metric in ("l2", "cosine"):
        index = VectorIndex.build(frame.select(F.col("id"), "embedding"), f"file://{tmp_path}/{metric}", IndexOptions(metric=metric, normalized=False, bits=8))
        assert index.search(corpus.queries[0].tolist(), 10)[0].count() == 10
    half = VectorIndex.build(fixtures.corpus("clustered").frame(spark), f"file://{tmp_path}/half", IndexOptions(input_kind="halfvec", bits=6))
    x = fixtures.corpus("clustered").vectors[5]
    assert 5 in ids(half.search(x.tolist(), 10)[0])


def test_fixtures_have_their_shapes():
    for kind in ("normalized_dense", "clustered", "mixed_live_dead", "hotpot_skewed", "hotpot_overlap"):
        c = fixtures.corpus(kind)
        assert np.allclose(np.linalg.norm(c.vectors, axis=1), 1) and len(c.queries) == 8
    assert fixtures.corpus("mixed_live_dead").deleted.mean() == pytest.approx(0.2, abs=0.01)
    with pytest.raises(ValueError):
        fixtures.corpus("none")


def test_stream_of_events(spark, rows, tmp_path):
    path = f"file://{tmp_path}/s"
    VectorIndex.build(rows.where("id < 100"), path, IndexOptions(lists=2, attributes=("label", "tenant")))
    events = rows.where("id between 90 and 130").withColumns({"op": F.when(F.col("id") < 100, "delete").otherwise("insert"), "seq": F.col("id")})
    events.coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).json(f"{tmp_path}/in")
    seen = []
    index_sink(stream, path, f"{tmp_path}/check", after=lambda n, a: seen.append((n, a))).trigger(availableNow=True).start().awaitTermination()
    index = VectorIndex.load(spark, path)
    assert sorted(ids(index.rows().select("id"))) == [*range(90), *range(100, 131)] and seen[0][0] == 0


def test_metrics_by_hand(spark):
    data = [("a", ["1", "2", "3"], ["2", "9"], ["3"], 10.0), ("b", ["4", "5"], ["6"], [], 30.0), ("c", [], [], ["7"], 20.0)]
    frame = spark.createDataFrame(data, "query_id string, retrieved array<string>, relevant array<string>, evidence array<string>, latency_ms double")
    m = evaluate.retrieval_metrics(frame, 3).first()
    ideal = 1 + 1 / np.log2(3)
    assert (m.query_count, m.recall, m.mrr, m.hit_rate, m.evidence_coverage) == (3, round(0.5 / 3, 6), round(0.5 / 3, 6), round(1 / 3, 6), round(1 / 3, 6))
    assert m.ndcg == round(1 / np.log2(3) / ideal / 3, 6) and (m.p50_ms, m.p95_ms, m.qps) == (20.0, 29.0, 50.0)
    hops = evaluate.multihop(frame.withColumn("supporting", F.array(F.lit("3"), F.lit("8"), F.lit("1"))), 3).where("query_id = 'a'").first()
    assert (hops.retrieved_supporting, hops.missing_supporting, hops.covered) == (["3", "1"], ["8"], 0)
    with pytest.raises(PySparkException):
        evaluate.cost_summary(spark.createDataFrame([("x", "usd", 1.0), ("x", "eur", 1.0)], "name string, unit string, value double")).collect()


def test_text_scores(spark):
    rows_ = spark.createDataFrame([("The cat sat", "the cat, the dog"), ("", ""), ("a", ""), (None, "x")], "p string, a string")
    got = [(r[0], round(r[1], 6)) for r in rows_.select(text.exact_match(F.col("p"), F.col("a")), text.token_f1(F.col("p"), F.col("a"))).collect()]
    assert got == [(0, round(2 * 2 / 7, 6)), (1, 1.0), (0, 0.0), (0, 0.0)]


def test_addresses_and_configs():
    assert ingest.parse_address("hf://a/b[train]:10") == ingest.DatasetAddress("a/b", "train", 10)
    with pytest.raises(ValueError):
        ingest.parse_address("s3://x")
    good = {"harness": "beir", "dataset_id": "d", "top_k": 2, "metric": "cosine"}
    assert reports.check_config(good, "regression") == good
    for bad, told in (({"harness": "beir"}, "dataset_id isn't there; top_k isn't there"), (good | {"top_k": 0}, "top_k is 0"), (good | {"harness": "x"}, "beir or lotte")):
        with pytest.raises(ValueError, match=told):
            reports.check_config(bad, "regression")
    pack = {"dataset_id": "d", "display_name": "D", "source": {"kind": "hf", "split": "test"}, "retrieval_profile": {"top_k_default": 5}, "evidence": {"enabled": False}, "answer_metrics": [], "stable_passage_id_fields": ["id"]}
    assert reports.check_config(pack, "dataset") == pack
    for name, value in (("source", {"kind": "hf"}), ("source", None), ("retrieval_profile", {"top_k_default": -1}), ("evidence", {}), ("stable_passage_id_fields", [])):
        with pytest.raises(ValueError, match=name):
            reports.check_config(pack | {name: value}, "dataset")


def test_fixture_queries(spark):
    row = reports.fixture_queries(spark, [{"query_id": 7, "query_text": "who?", "query_vector": [1, 0.5], "relevant_ids": [3, "x"]}]).first()
    assert tuple(row) == ("7", "who?", [1.0, 0.5], ["3", "x"])


def test_reports(spark, tmp_path):
    frame = spark.createDataFrame([("nq", 0.5, None), ("a|b", 1.0, 3)], "dataset string, recall double, n int")
    for kind, part in (("json", '"recall": 0.5'), ("csv", "nq,0.5,\n"), ("md", "| a\\|b | 1.0000 | 3 |"), ("html", "<td>a|b</td>")):
        reports.write_report(frame, f"file://{tmp_path}/r.{kind}", "T")
        assert part in files.read_text(spark, f"file://{tmp_path}/r.{kind}")


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(2)
    data = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(0, 40, {"a": 700, "b": 5, None: 60}[g])] + [("a", 3.0)] * 900 + [("c", None)]
    frame = spark.createDataFrame(data, "g string, v double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for nearest in (False, True):
        got = {r.g: list(r)[1:] for r in evaluate.percentiles(frame, "v", shares, ["g"], nearest).collect()}
        assert set(got) == {"a", "b", None}
        for g, found in got.items():
            values = sorted(v for k, v in data if k == g)
            want = [values[max(1, int(np.ceil(round(p * len(values), 9)))) - 1] if nearest else np.percentile(values, 100 * p) for p in shares.values()]
            assert np.allclose(found, want)
    assert evaluate.percentiles(frame, "v", {"m": 0.5}).first().m == np.percentile([v for _, v in data if v is not None], 50)
    assert evaluate.percentiles(frame.where("false"), "v", {"m": 0.5}).count() == 0


def test_exact_fraction_and_comparisons(spark):
    pairs = spark.createDataFrame([([1, 2], [2, 1]), ([1], [1, 2]), (None, []), ([3, 3], [3])], "found array<int>, wanted array<int>")
    assert tuple(evaluate.exact_fraction(pairs).first()) == (4, 0.75, 1.0)
    rows = spark.createDataFrame([("d", "a", 0.5, 2.0), ("d", "b", 0.4, None), ("e", "a", 0.0, 1.0), ("e", "b", 1.0, 1.0)], "dataset string, system_id string, recall double, ms double")
    got = {(r.dataset, r.candidate, r.baseline, r.metric): (r.difference, r.ratio) for r in evaluate.comparisons(rows, ["recall", "ms"], ["a"]).collect()}
    assert got == {("d", "b", "a", "recall"): (-0.1, 0.8), ("e", "b", "a", "recall"): (1.0, None), ("e", "b", "a", "ms"): (0.0, 1.0)}


def test_labels_have_a_bound(spark):
    frame = spark.range(20).select(F.col("id").alias("kind"))
    assert evaluate.scan_stat_summary(frame, [], ["kind"]).first()["values"] == sorted(map(str, range(20)))
    with pytest.raises(PySparkException):
        evaluate.scan_stat_summary(frame, [], ["kind"], most=5).collect()


def test_batch_search_is_search(spark, rows, built):
    """With knobs, filters and a delta each query of a batch has the rows that it has alone."""
    asked = rows.where("id % 60 = 0").select(F.col("id").alias("qid"), "embedding")
    for knobs, filters in ((QueryKnobs(probes=2), None), (QueryKnobs(probes=6, max_visited_codes=150), None), (QueryKnobs(probes=3, oversample_factor=4), {"tenant": [1, 2]}), (QueryKnobs(probes=2), {"label": None})):
        found = {}
        for r in built.search_batch(asked, 8, knobs=knobs, filters=filters).orderBy("qid", "rank").collect():
            found.setdefault(r.qid, []).append(r.id)
        for r in asked.collect():
            alone = built.search(r.embedding, 8, knobs, filters)[0].withColumn("score", F.round("score", 6)).orderBy("score", "id").collect()
            assert found.get(r.qid, []) == [a.id for a in alone]


def test_merge_rewrites_touched_lists_only(spark, rows, query, tmp_path):
    index = VectorIndex.build(rows, f"file://{tmp_path}/i", IndexOptions(lists=8, bits=8, attributes=("label", "tenant")))
    knobs = QueryKnobs(probes=8, oversample_factor=8)
    for step in range(3):
        one = index._codes().where("list_id = 0").orderBy("id").select("id").limit(3)
        dead = ids(one)
        index.delete(spark.createDataFrame([(d,) for d in dead], "id long"))
        index.insert(index.rows().where("false").unionByName(rows.where(F.col("id") == dead[0]).withColumn("id", F.lit(50_000 + step).cast("long"))))
        before = ids(index.search(query, 50, knobs)[0]), sorted(ids(index.rows().select("id")))
        done = index.merge()
        assert done["rewritten_lists"] == 1 and done["removed"] == 3 and done["merged"] == 1 and done["version"] == step + 1
        written = files.children(spark, f"{tmp_path}/i/v{step + 1}/codes")
        assert [n for n in written if n.startswith("list_id=")] == ["list_id=0"] and set(index.kept) == {0}
        again = VectorIndex.load(spark, index.path)
        for i in (index, again):
            assert (ids(i.search(query, 50, knobs)[0]), sorted(ids(i.rows().select("id")))) == before and i.maintain()["action"] == "noop"
            assert sum(n for _, n, _ in i.lists()) == len(before[1])
    assert index.remove_old() == [1, 2] and sorted(ids(VectorIndex.load(spark, index.path).rows().select("id"))) == before[1]


def test_list_health_and_reclaimable_pages(spark, rows, tmp_path):
    index = VectorIndex.build(rows, f"file://{tmp_path}/i", IndexOptions(lists=3, attributes=("label", "tenant")))
    first = index._codes().where("list_id = 0").select("id")
    dead = first.count()
    index.delete(first)
    index.insert(rows.where("id = 3").withColumn("id", F.lit(99_999).cast("long")))
    health = {r.list_id: r for r in index.list_health().collect()}
    assert health[0].live == 0 and health[0].dead == dead and health[0].reclaimable_pages == health[0].pages and health[1].reclaimable_pages == 0
    assert sum(r.delta for r in health.values()) == 1 and index.metadata()["reclaimable_pages"] == health[0].pages
    assert "compact" in index.metadata()["maintenance_action_recommended"]
    assert files.make_new(spark, f"file://{tmp_path}/x") and not files.make_new(spark, f"file://{tmp_path}/x")


def test_campaign_run_and_its_report(spark, rows, built, tmp_path):
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding")
    truth = knn.batch_knn(rows, asked, 5).groupBy(F.col("qid").alias("query_id")).agg(F.collect_list(F.col("id").cast("string")).alias("relevant")).withColumn("evidence", F.col("relevant"))
    questions = asked.select(F.col("qid").alias("query_id"), F.concat(F.lit("which is "), F.col("qid")).alias("question"))
    passages = rows.select("id", F.concat(F.lit("it is "), F.col("id")).alias("text"))
    references = asked.select(F.col("qid").alias("query_id"), F.array(F.col("qid").cast("string")).alias("references"))
    data = campaign.Dataset(built, asked, truth, questions, passages, references)
    tables = campaign.run({"d": data}, ("quantized_approx", "quantized_rerank", "exact_approx"), 5, timed=1, generator=lambda p: p.split("it is ")[1].split()[0], generator_id="first")
    got = {r.system_id: r for r in tables["retrieval"].collect()}
    assert got["exact_approx"].recall == 1.0 and got["quantized_rerank"].recall >= got["quantized_approx"].recall and all(r.p50_ms > 0 and r.batch_qps > 0 for r in got.values())
    assert {r.system_id: r.exact_match for r in tables["answers"].collect()} == {"exact_approx": 1.0, "quantized_approx": 1.0, "quantized_rerank": 1.0}
    assert [r.method for r in tables["two_stage"].collect()] == ["quantized"]
    assert {(r.candidate, r.metric) for r in tables["comparisons"].collect()} >= {("quantized_rerank", "recall"), ("quantized_approx", "ndcg")}
    names = reports.write_tables(tables, f"file://{tmp_path}/report", "Campaign", {"k": 5})
    assert {"retrieval.csv", "report.json", "report.md", "report.html"} <= set(names)
    told = json.loads(files.read_text(spark, f"file://{tmp_path}/report/report.json"))
    assert told["k"] == 5 and len(told["tables"]["retrieval"]) == 3 and "## retrieval" in files.read_text(spark, f"file://{tmp_path}/report/report.md")
    meta = campaign.run_metadata(built, "quantized_rerank", 5, filters={"tenant": {2, 1}}, payload=["label"])
    assert meta["filters"] == {"tenant": [1, 2]} and meta["covering"] and meta["filters_in_index"] == ["tenant"] and meta["rerank_depth"] == 500  # as many as there are rows


def test_campaign(spark, rows, built):
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    truth = knn.batch_knn(rows, asked, 10).groupBy(F.col("qid").alias("query_id")).agg(F.collect_list(F.col("id").cast("string")).alias("relevant")).withColumn("evidence", F.col("relevant"))
    got = {s: campaign.run_retrieval(built, asked, truth, 10, s).first() for s in ("quantized_approx", "quantized_rerank", "exact_approx")}
    assert got["exact_approx"].recall == 1.0 and got["quantized_rerank"].recall >= 0.99 > got["quantized_approx"].recall > 0.7
    assert campaign.rerank_depth("quantized_rerank", 10, 20, 500) == 500 and campaign.rerank_depth("exact_rerank", 10, 20) == 20
    row = spark.createDataFrame([("d", "s", None)], "dataset string, system_id string, recall double")
    assert not any(r.passed for r in campaign.gate(row, campaign.Gate("d", "s", 0.9, 1, 1, "x", 8)).collect())
    assert campaign.gate(row, campaign.Gate("d", "t", 0.9, 1, 1, "x", 8)).first().name == "row_present"
    cache = spark.createDataFrame([("q", "who?", [("1", "Ann did it"), ("2", "no")])], "query_id string, question string, contexts array<struct<id:string,text:string>>")
    said = campaign.answer(cache, lambda p: "Ann" if "[1] Ann" in p else "?", "Be brief.")
    assert said.first().answer == "Ann" and said.first().context_tokens == 4
    refs = spark.createDataFrame([("q", ["Bob", "ann"])], "query_id string, references array<string>")
    assert tuple(campaign.answer_scores(said, refs).first()) == (1.0, 1.0)


def test_sql_functions(spark):
    register.register(spark)
    row = spark.sql("SELECT vec_cosine(array(1f, 0f), array(0f, 2f)), vec_l2(array(1f, 0f), array(1f, 2f)), vec_neg_ip(array(2f), array(3f)), vec_norm(array(3f, 4f)), vec_within(array(1f), array(1f), 0.1D), vec_cosine(array(0f), array(1f))").first()
    assert tuple(row) == (1.0, 2.0, -6.0, 5.0, True, 1.0)


def test_sql_table_function_and_requests(spark, built):
    register.register(spark)
    assert tuple(spark.sql("SELECT * FROM vec_resolved_knobs(24, 10)").first()) == (3, 8, 192, 0)
    meta = json.dumps({"list_count": 64, "page_count": 640, "live_count": 100_000, "list_distribution": {"max_list_over_avg": 4.0}})
    want = budget.recommend_knobs(100, 10, json.loads(meta), 0.1)
    assert tuple(spark.sql(f"SELECT * FROM vec_recommended_knobs(100, 10, '{meta}', 0.1D, NULL)").first()) == tuple(want.values())
    register.register_search(spark, built, "near", built.rows().first()["embedding"], 20, 5)
    assert spark.sql("SELECT count(*) FROM near_candidates").first()[0] == 20 and spark.sql("SELECT max(exact_rank) FROM near_reranked").first()[0] == 5
    campaign.check_request(built, "cosine", "exact_approx", 5, 5)
    for bad in (("ip", "exact_approx", 5, 5), ("cosine", "hnsw", 5, 5), ("cosine", "exact_approx", 5, 4), ("cosine", "exact_approx", 0, 4)):
        with pytest.raises(ValueError):
            campaign.check_request(built, *bad)


def test_upsert_and_first_seen(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, ingest.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    twice = new.unionByName(spark.createDataFrame([(2, "b"), (3, "z"), (None, "n")], "k int, v string"))
    assert sorted(map(tuple, ingest.upsert(old, twice, "k").collect()), key=str) == [(1, "a"), (2, "c"), (3, "z"), (None, "n")]
    assert ingest.upsert(old, new.where("false"), "k").count() == 2
    path = f"file://{tmp_path}/passages"
    ingest.upsert_into(path, old, "k")
    ingest.upsert_into(path, new, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    spark.range(50).repartition(1).write.parquet(f"{tmp_path}/hub/a/b/train.parquet")
    spark.range(50).coalesce(1).write.json(f"{tmp_path}/hub/a/b/test.jsonl")
    for split in ("train", "test"):
        first = ingest.read_dataset(spark, f"hf://a/b[{split}]:7", f"file://{tmp_path}/hub")
        assert first.columns == ["id"] and sorted(ids(first)) == sorted(ids(ingest.read_dataset(spark, f"hf://a/b[{split}]:7", f"file://{tmp_path}/hub"))) and first.count() == 7
