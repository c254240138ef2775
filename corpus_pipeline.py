"""A corpus pipeline of four stages over ``documents``, each a call of one operator.

Each stage takes what the one before it kept. Between stages the documents are written as Parquet to
shared scratch space and read again, so a lost executor never sends work back past its own stage.

For all stages: a null text is empty; texts are read whole, however long; other columns stay as they are, whatever their
names; an empty table stays empty. What repeated rows and null ids become is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodevec.llm import near_copies, sp_transducer, tiling, toxicity
from lodevec.llm.common import lower_batches, settle, table
from lodevec.llm.queries import piece_model

#: Rows of an Arrow batch at most. A stage sets this for its session, since what it returns is run later: a batch is held by the JVM and by the
#: Python worker beside it, and of these texts the usual 10,000 rows take about 30 MB on each side, for each core.
BATCH_ROWS = 512


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The model learns from the labelled part of ``docs``.

    Each row is judged by its text, whatever its id: repeats share their fate, and an empty text is scored like any other.
    """
    lower_batches(spark, BATCH_ROWS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

    The least id stays, null ids come last, and texts decide: of repeated rows one stays, of one id with unlike texts each
    text. Texts without words are one component.
    """
    lower_batches(spark, BATCH_ROWS)
    return near_copies.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold most of a benchmark item, in whatever order.

    Each row is judged by its text; empty texts stay. Items without text, or of fewer tokens than ``tiling.MIN_ITEM``, rule nothing out.
    """
    lower_batches(spark, BATCH_ROWS)
    return tiling.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document, read back to see that they give its text: a row for each row, with an empty list for an empty text."""
    lower_batches(spark, BATCH_ROWS)
    return sp_transducer.encoded(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("sentencepiece encoding", encode),
]

#: No stage but the second is SQL, so the tests hold the result against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
