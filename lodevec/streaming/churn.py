"""Inserts and deletes of a stream, written into an index by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lodevec.operators.index import VectorIndex
from lodevec.plans.options import MaintenanceKnobs


def last_events(batch: DataFrame, id_col: str = "id", order: str = "seq") -> DataFrame:
    """The last event of each id; earlier ones of the same batch have no effect."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(order).desc()))
    return batch.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def apply_batch(index: VectorIndex, batch: DataFrame, id_col: str = "id", emb_col: str = "embedding", op_col: str = "op", order: str = "seq", knobs: MaintenanceKnobs | None = None) -> str:
    """Apply rows ``(id, embedding, op, seq, attributes...)``, op insert or delete; merges when the index asks for it."""
    events = last_events(batch, id_col, order).persist()
    try:
        index.delete(events.select(F.col(id_col).alias("id")))
        inserted = events.where(F.col(op_col) == "insert")
        if inserted.limit(1).count():
            index.insert(inserted, id_col, emb_col)
    finally:
        events.unpersist()
    advised = index.metadata(knobs)["maintenance_action_recommended"]
    if advised not in ("healthy", "observe"):
        index.maintain(knobs)
    return advised


def index_sink(stream: DataFrame, path: str, checkpoint: str, knobs: MaintenanceKnobs | None = None, after: Callable[[int, str], None] | None = None) -> DataStreamWriter:
    """A writer that keeps the index in ``path`` up with a stream of events.

    A batch that is replayed after a failure hides and inserts the same ids again, so it has no further effect.
    """

    def each(batch: DataFrame, number: int) -> None:
        advised = apply_batch(VectorIndex.load(batch.sparkSession, path), batch, knobs=knobs)
        if after:
            after(number, advised)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
