"""Vector mathematics as Column expressions in double precision, and the rounding that results are compared by."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metric names and the operator sign each stands for.
METRICS = {"cosine": "<=>", "ip": "<#>", "l2": "<->"}
UNIT_TOLERANCE = 0.10


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unsupported metric {metric!r}; use one of {', '.join(METRICS)}")
    return metric


def vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.array(*(F.lit(float(v)) for v in values))


def _double(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.greatest(dot(a, a), F.lit(0.0)))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine, the cosine cut to [-1, 1]; 1 where either vector has no length. Norms may be given if known."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(scale > 0, 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / scale))).otherwise(F.lit(1.0))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def distance(metric: str, a: Column, b: Column) -> Column:
    """The distance that queries order by, smaller is nearer."""
    return {"cosine": cosine_distance, "ip": negative_inner_product, "l2": l2_distance}[check_metric(metric)](a, b)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def dimension(a: Column) -> Column:
    return F.size(a)


def with_fixed_dimension(df: DataFrame, column: str, size: int) -> DataFrame:
    """Raises when a vector that isn't null has another number of dimensions."""
    message = F.concat(F.lit(f"expected {size} dimensions, not "), F.size(column).cast("string"))
    checked = F.when(F.col(column).isNull() | (F.size(column) == size), F.col(column)).otherwise(F.raise_error(message))
    return df.withColumn(column, checked)


def unit(a: Column) -> Column:
    """Scaled to length one; a zero vector stays as it is.

    The length is bound as the element of an array, as an expression inside a lambda is worked out for each element anew.
    """
    scaled = F.transform(F.array(norm(a)), lambda length: F.when(length > 0, F.transform(_double(a), lambda v: v / length)).otherwise(_double(a)))
    return F.element_at(scaled, 1)


def checked_unit(a: Column, what: str = "embeddings") -> Column:
    """Scaled to length one; raises where the length is off by more than the tolerance, as zero vectors are."""
    off = F.abs(norm(a) - 1) > UNIT_TOLERANCE
    return F.when(off, F.raise_error(F.lit(f"{what} must be of length one, as the index is for normalized vectors"))).otherwise(unit(a))


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def format_vector(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ","), F.lit("]"))


def half(a: Column) -> Column:
    """Values rounded to IEEE half precision, to even; subnormals and overflow to infinity as the format has them.

    A half keeps 11 significant bits, at steps of 2**-24 at least, so rounding needs only the exponent.
    """

    def one(v: Column) -> Column:
        v = v.cast("double")
        exponent = F.floor(F.log2(F.abs(v)))
        step = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(-14)) - 10)
        near = F.rint(v / step) * step
        return F.when(v == 0, v).when(F.abs(near) >= 65520, F.when(v > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(near).cast("float")

    return F.transform(a, one)


def half_numpy(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # what is too large becomes infinite, as a half does
        return x.astype(np.float16).astype(np.float32)
