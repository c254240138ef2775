import sentencepiece

import corpus_pipeline as C
from lodevec.llm import common, near_copies, sp_transducer, tiling, toxicity
from lodevec.llm.queries import tokenizer_path
from tests.llm.test_near_copies import slow_kept


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = {i for i, r in rows.items() if toxicity.Scorer(model).scores([r.text or ""])[0] < toxicity.THRESHOLD}
    stage = C.drop_toxic(spark, docs, sf_dir)
    assert {tuple(r) for r in stage.collect()} == {tuple(rows[i]) for i in left} and stage.columns == docs.columns

    left = slow_kept({i: rows[i].text for i in left})
    stage = C.drop_near_copies(spark, stage, sf_dir)
    assert {r.doc_id for r in stage.collect()} == left and stage.columns == docs.columns

    items = [" ".join(tiling.tokens(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    whole = {i for i in left if any(f" {item} " in f" {' '.join(tiling.tokens(rows[i].text))} " for item in items)}
    stage = C.drop_benchmark(spark, stage, sf_dir)
    kept = {r.doc_id for r in stage.collect()}
    assert not kept & whole and len(left - whole - kept) <= 0.01 * len(left) and stage.columns == docs.columns

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = {i: library.encode(rows[i].text or "") for i in kept}
    assert {r.doc_id: list(r.ids) for r in C.encode(spark, stage, sf_dir).collect()} == want
    run = {r.doc_id: list(r.ids) for r in C.run(spark, sf_dir).collect()}
    assert run == want


def test_each_stage_takes_hostile_rows(spark, docs, no_docs, sf_dir):
    for _, stage in C.STAGES:
        for frame in (docs, no_docs):
            out = stage(spark, frame, sf_dir)
            assert out.count() <= frame.count()


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(300))
    frame = spark.createDataFrame([(i, text) for i in (9, 4, 7)] + [(1, "something else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(frame).collect()) == [1, 4]


def test_stages_hold_little_at_once(spark, docs, sf_dir, monkeypatch):
    """Each stage keeps Arrow batches short until its result is run; encoding makes at most a megabyte of texts into Python objects at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for _, stage in C.STAGES:
            spark.conf.set(name, "10000")
            stage(spark, docs, sf_dir)
            assert int(spark.conf.get(name)) <= 512
    finally:
        spark.conf.set(name, before)
    held = {}
    monkeypatch.setattr(sp_transducer, "map_rows", lambda *a, chunk_bytes=16 << 20: held.update(most=chunk_bytes))
    C.encode(spark, docs, sf_dir)
    assert held["most"] <= 1 << 20


def test_workers_let_go_of_what_a_stage_does_not_need():
    made = [common.warm("a stage's table", lambda: [object()])]
    common.cool()
    made.append(common.warm("a stage's table", lambda: [object()]))
    assert made[0] is not made[1]
