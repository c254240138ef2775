"""Corpora: dataset addresses, corpus builders, passage defaults and keyed upserts."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodevec.operators.knn import first_seen
from lodevec.sources.files import exists, rename

ADDRESS = re.compile(r"^hf://(?P<name>[^\[\]:]+)\[(?P<split>[^\[\]]+)\](?::(?P<limit>\d+))?$")


@dataclass(frozen=True)
class DatasetAddress:
    name: str
    split: str
    limit: int | None


def parse_address(uri: str) -> DatasetAddress:
    """``hf://name[split]`` or ``hf://name[split]:limit``."""
    found = ADDRESS.match(uri)
    if not found:
        raise ValueError(f"not a dataset address: {uri!r}")
    limit = found["limit"]
    return DatasetAddress(found["name"], found["split"], int(limit) if limit else None)


def read_dataset(spark: SparkSession, uri: str, root: str) -> DataFrame:
    """A downloaded dataset below ``root``: ``name/split.parquet`` or else ``name/split.jsonl``.

    A limit, which is part of the address, takes the first rows in the order of the files, so it repeats.
    """
    address = parse_address(uri)
    base = f"{root.rstrip('/')}/{address.name}/{address.split}"
    stored = exists(spark, f"{base}.parquet")
    df = spark.read.parquet(f"{base}.parquet") if stored else spark.read.json(f"{base}.jsonl")
    if address.limit is None:
        return df
    row = F.col("_metadata.row_index") if stored else F.monotonically_increasing_id()
    places = {"place_file": F.col("_metadata.file_path"), "place_block": F.col("_metadata.file_block_start"), "place_row": row}
    return df.select("*", *(c.alias(n) for n, c in places.items())).orderBy(*places).limit(address.limit).drop(*places)


def popqa_corpus(rows: DataFrame, order: str) -> DataFrame:
    """One passage a subject, from its first row: ``(document_id, title, text)``."""
    first = first_seen(rows, "subj_id", order)
    text = F.concat_ws(" ", F.col("subj"), F.col("prop"), F.concat(F.col("obj"), F.lit(".")))
    return first.select(F.col("subj_id").cast("string").alias("document_id"), F.col("subj").alias("title"), text.alias("text"))


def kilt_corpus(rows: DataFrame, order: str) -> DataFrame:
    """One document a cited page, with the first answer that cites it: ``(document_id, question, answer)``."""
    outputs = rows.select(order, "input", F.posexplode("output").alias("o", "out"))
    cited = outputs.select(order, "o", "input", F.col("out.answer").alias("answer"), F.posexplode("out.provenance").alias("p", "source"))
    cited = cited.select("*", F.col("source.wikipedia_id").alias("wikipedia_id")).where("wikipedia_id is not null")
    first = cited.withColumn("__rank", F.row_number().over(Window.partitionBy("wikipedia_id").orderBy(order, "o", "p"))).where("__rank = 1")
    return first.select(F.col("wikipedia_id").cast("string").alias("document_id"), F.col("input").alias("question"), "answer")


def with_passage_defaults(passages: DataFrame, ordinal: str) -> DataFrame:
    """Fills metadata that is missing from a passage's ordinal, which begins with 1."""
    n = F.col(ordinal)
    defaults = {"tenant_id": (n - 1) % 4 + 1, "source_id": (n - 1) % 8 + 1, "lang_id": F.lit(1), "doc_version": F.lit(1), "doc_id_int": n, "chunk_id_int": F.coalesce(F.col("chunk_index"), F.lit(0)) + 1}
    have = set(passages.columns)
    return passages.withColumns({name: F.coalesce(F.col(name), value).cast("int") if name in have else value.cast("int") for name, value in defaults.items()})


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``new`` in place of the rows of ``old`` with its keys.

    Of new rows that repeat a key the one of the greatest ``order`` stays, of equals, or without an order, the one whose
    columns are greatest. Old rows that aren't replaced stay as they are; rows with a null key are never replaced. Either
    table may be empty.
    """
    first = [order] if order else []
    rest = [c for c in new.columns if c not in (key, order)]
    latest = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*first, *rest)).alias("latest_of_key"))
    latest = latest.select(*(F.col(c) if c == key else F.col("latest_of_key")[c].alias(c) for c in new.columns)).unionByName(new.where(F.col(key).isNull()))
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


def upsert_into(path: str, new: DataFrame, key: str, order: str | None = None) -> None:
    """``upsert`` into a Parquet table at a path, which is made where there is none.

    The new table is written beside the old one and takes its name when it is whole; a reader between sees no table.
    """
    spark, draft = new.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    there = exists(spark, path)
    old = spark.read.parquet(path) if there else new.where(F.lit(False))
    upsert(old, new, key, order).write.parquet(draft)
    rename(spark, draft, path)
