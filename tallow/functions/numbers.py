"""Doubles to the last digit as DuckDB has them."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Scaled, rounded half away from zero and scaled back, all in doubles; Spark's own rounds the number as it is written. What
    is beyond scaling stays, and so does the sign of a zero."""
    scale = F.lit(10.0**digits)
    y = x * scale
    found = F.when(y < 0, -F.round(-y)).otherwise(F.round(y)) / scale
    return F.when(F.abs(found) < F.lit(math.inf), found).otherwise(x)


def exp(x: Column) -> Column:
    """The C library's exponential: Java's differs from it in the last place."""
    return F.arrow_udf(_exponentials, "double")(x)


def _exponential(x: float) -> float:
    try:
        return math.exp(x)
    except OverflowError:
        return math.inf


def _exponentials(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else _exponential(v) for v in x.to_pylist()], pa.float64())
