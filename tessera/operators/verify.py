"""Comparison of a result with an expected one: (i, y) each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both(y: DataFrame, expected: DataFrame) -> DataFrame:
    return y.select("i", "y").join(expected.select("i", F.col("y").alias("e")), "i", "full_outer")


def _summary(df: DataFrame, good: Column) -> DataFrame:
    """(n, n_bad, max_error, passed); a row that only one side has is bad."""
    bad = F.sum((~F.coalesce(good, F.lit(False))).cast("long"))
    s = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(bad, F.lit(0)).alias("n_bad"), F.coalesce(F.max(F.abs(F.col("y") - F.col("e"))), F.lit(0.0)).alias("max_error"))
    return s.select("n", "n_bad", "max_error", (F.col("n_bad") == 0).alias("passed"))


def absolute(y: DataFrame, expected: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    return _summary(_both(y, expected), F.abs(F.col("y") - F.col("e")) <= tolerance)


def relative(y: DataFrame, expected: DataFrame, rel: float = 1e-4, least: float = 1e-6) -> DataFrame:
    return _summary(_both(y, expected), F.abs(F.col("y") - F.col("e")) <= F.greatest(rel * F.abs(F.col("e")), F.lit(least)))


def first_rows(y: DataFrame, expected: DataFrame, rows: int = 10, tolerance: float = 1e-3) -> DataFrame:
    """The first rows only: a spot check by definition."""
    return absolute(y.where(F.col("i") < rows), expected.where(F.col("i") < rows), tolerance)


def check_finite(y: DataFrame, value: str = "y") -> DataFrame:
    """(n, n_bad, passed): NaN, infinite and null values are bad."""
    v = F.col(value).cast("double")
    bad = F.sum((v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).cast("long"))
    return y.agg(F.count(F.lit(1)).alias("n"), F.coalesce(bad, F.lit(0)).alias("n_bad")).select("n", "n_bad", (F.col("n_bad") == 0).alias("passed"))
