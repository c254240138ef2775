"""Helpers that all operators of this subpackage share: reading tables, scratch space, Arrow row maps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has named, by session; ``clear_scratch`` empties the list.
_NAMED: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the one that driver and executors share, which ``spark.checkpoint.dir`` names.

    Where it is unset, a local session, as in tests, takes a temporary folder of this machine; on a cluster
    that is an error, as executors couldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lodevec-")
        spark.sparkContext.setCheckpointDir(base)
    _NAMED.append(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _NAMED[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders that this process made, when their results aren't read any more; gives their number."""
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = 0
    while _NAMED:
        where = store(_NAMED.pop())
        gone += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return gone


_WARM: dict[Any, Any] = {}


def warm(key: Any, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task. Only the latest is kept, so the tables of operators don't pile up."""
    if key not in _WARM:
        _WARM.clear()
        _WARM[key] = make()
    return _WARM[key]


def cool() -> None:
    """Let go of what earlier tasks of a worker process kept warm, where work that doesn't need it begins."""
    _WARM.clear()
    pa.default_memory_pool().release_unused()


def trim() -> None:
    """Give memory that this process has freed back to the system, which glibc otherwise keeps where small objects came and went."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to shared scratch space and read it again.

    This cuts the lineage, so a lost executor costs a re-read and not a recomputation.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lower_batches(spark: SparkSession, rows: int) -> None:
    """Arrow batches of at most so many rows for all that the session runs from now on, as frames that aren't run yet need."""
    before = int(spark.conf.get(BATCH_ROWS_SETTING))
    spark.conf.set(BATCH_ROWS_SETTING, str(min(rows, before) if before > 0 else rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is run inside.

    A batch is held by the JVM and by the Python worker beside it, so of long texts the usual number of rows takes tens of megabytes on each side, for each core.
    """
    before = spark.conf.get(BATCH_ROWS_SETTING)
    lower_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS_SETTING, before)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_rows(
    df: DataFrame,
    setup: Callable[[], Callable[..., list[tuple]]],
    schema: T.StructType,
    chunk_bytes: int = 16 << 20,
) -> DataFrame:
    """Map Arrow batches of ``df`` through a Python function over column lists.

    ``setup()`` runs once in each task and returns ``work(*columns) -> rows``; ``work`` gets equally
    long lists, one for each column of ``df``, and returns output tuples. Batches are cut into pieces
    of about ``chunk_bytes``, so very long texts don't pile up in the worker.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, min(batch.num_rows, int(batch.num_rows * chunk_bytes / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                rows = work(*(column.to_pylist() for column in piece.columns))
                if rows:
                    columns: Any = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                    )

    return df.mapInArrow(run, schema)


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # type: ignore[return-value]
