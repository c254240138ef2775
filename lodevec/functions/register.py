"""Names for SQL: vector functions as SQL functions, and what the engine runs on."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import lodevec
from lodevec.operators.index import VectorIndex
from lodevec.plans.budget import recommend_knobs

_DOT = "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, v) -> s + v)"
_SELF = "aggregate(a, 0D, (s, v) -> s + double(v) * double(v))"
_OTHER = "aggregate(b, 0D, (s, v) -> s + double(v) * double(v))"
_SQUARE = "aggregate(zip_with(a, b, (x, y) -> (double(x) - y) * (double(x) - y)), 0D, (s, v) -> s + v)"

#: SQL bodies by name; all are Spark SQL expressions, so Catalyst sees through them.
FUNCTIONS = {
    "vec_dot": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", _DOT),
    "vec_norm": ("a ARRAY<FLOAT>", "DOUBLE", f"sqrt({_SELF})"),
    "vec_neg_ip": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", f"-{_DOT}"),
    "vec_l2": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", f"sqrt({_SQUARE})"),
    "vec_cosine": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", f"CASE WHEN {_SELF} > 0 AND {_OTHER} > 0 THEN 1 - greatest(-1D, least(1D, {_DOT} / (sqrt({_SELF}) * sqrt({_OTHER})))) ELSE 1D END"),
    "vec_within": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>, t DOUBLE", "BOOLEAN", "vec_cosine(a, b) <= t"),
}


#: SQL table functions by name: arguments, columns and query.
TABLE_FUNCTIONS = {
    "vec_resolved_knobs": (
        "candidates INT, final INT",
        "probes INT, oversample_factor INT, max_visited_codes BIGINT, max_visited_pages INT",
        """SELECT int(greatest(1, ceil(candidates / oversample))), int(oversample), bigint(least(2147483647, candidates * oversample)), 0
           FROM (SELECT greatest(8, ceil(candidates / final)) AS oversample)""",
    ),
}


class RecommendedKnobs:
    """A table function of one row: knobs advised for an index, whose metadata and last scan come as JSON texts or null."""

    def eval(self, candidates: int, final: int, meta: str | None, selectivity: float | None, last: str | None):
        found = recommend_knobs(candidates, final, json.loads(meta) if meta else None, selectivity, json.loads(last) if last else None)
        yield found["probes"], found["oversample_factor"], found["max_visited_codes"], found["max_visited_pages"]


KNOBS = "probes int, oversample_factor int, max_visited_codes bigint, max_visited_pages int"


def register_search(spark: SparkSession, index: VectorIndex, name: str, query: list[float], candidates: int, final: int | None = None) -> None:
    """Views ``name_candidates`` and, with a final limit, ``name_reranked`` of one search, for SQL."""
    index.candidates(query, candidates, final).createOrReplaceTempView(f"{name}_candidates")
    if final is not None:
        index.rerank(query, candidates, final).createOrReplaceTempView(f"{name}_reranked")


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session."""
    spark.udtf.register("vec_recommended_knobs", F.udtf(RecommendedKnobs, returnType=KNOBS))
    for name, (arguments, columns, query) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {query}")
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return [*FUNCTIONS, *TABLE_FUNCTIONS, "vec_recommended_knobs"]


def runtime() -> dict:
    """Version of the engine and of what scores vectors."""
    return {"version": lodevec.__version__, "score_kernel": "numpy", "numpy": np.__version__, "arrow": pa.__version__}
