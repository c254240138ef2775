"""Small files and folders on whatever store Spark writes to, through Spark's own file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one that the session names. Without one a local session takes a temporary folder; a cluster can't."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lodevec-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _store(spark, path)
    return store.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write under another name, then rename, so a reader sees the old or the new file and nothing between."""
    store, where = _store(spark, path)
    _, draft = _store(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if store.exists(where):
        store.delete(where, False)
    if not store.rename(draft, where):
        raise OSError(f"can't rename to {path}")


def read_text(spark: SparkSession, path: str) -> str:
    store, where = _store(spark, path)
    source = store.open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to shared scratch space and read it again, which cuts its lineage."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Give a file or folder another's place; what was there is gone."""
    store, where = _store(spark, path)
    _, goal = _store(spark, to)
    if store.exists(goal):
        store.delete(goal, True)
    if not store.rename(where, goal):
        raise OSError(f"can't rename to {to}")


def make_new(spark: SparkSession, path: str) -> bool:
    """Make an empty file that isn't there yet; false where it is."""
    store, where = _store(spark, path)
    try:
        store.create(where, False).close()
    except Exception as failed:
        if store.exists(where):
            return False
        raise failed
    return True


def remove(spark: SparkSession, path: str) -> bool:
    store, where = _store(spark, path)
    return store.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    store, where = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []
