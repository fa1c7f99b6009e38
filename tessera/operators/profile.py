"""Structure of a matrix in a few numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.convert import row_lengths


def row_length_stats(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """(min_nnz, max_nnz, avg_nnz, std_nnz, cv_percent) over all rows, empty ones
    included; the standard deviation is the population's, from integer sums."""
    n = F.col("n")
    s = row_lengths(entries, rows).agg(F.min("n").alias("min_nnz"), F.max("n").alias("max_nnz"), F.sum("n").alias("_s"), F.sum(n * n).alias("_q"), F.count(F.lit(1)).alias("_c"))
    avg = F.col("_s").cast("double") / F.col("_c")
    std = F.sqrt(F.greatest(F.col("_q").cast("double") / F.col("_c") - avg * avg, F.lit(0.0)))
    return s.select("min_nnz", "max_nnz", avg.alias("avg_nnz"), std.alias("std_nnz"), F.when(avg > 0, 100.0 * std / avg).otherwise(0.0).alias("cv_percent"))


def top_columns(entries: DataFrame, k: int = 10) -> DataFrame:
    """(j, n) of the k most frequent columns; ties by column."""
    return entries.groupBy("j").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "j").limit(k)


def top_share(entries: DataFrame, k: int = 100) -> DataFrame:
    """(share_percent) of the entries in the k most frequent columns."""
    top = top_columns(entries, k).agg(F.sum("n").alias("t"))
    return top.crossJoin(entries.agg(F.count(F.lit(1)).alias("nnz"))).select((100.0 * F.coalesce("t", F.lit(0)) / F.greatest(F.col("nnz"), F.lit(1))).alias("share_percent"))


def column_entropy(entries: DataFrame, num_cols: int, buckets: int = 100) -> DataFrame:
    """(entropy, normalized): of the entries' distribution over buckets of
    max(1, num_cols div buckets) columns, in bits, and as a share of log2(buckets)."""
    width = max(1, num_cols // buckets)
    counts = entries.groupBy(F.floor(F.col("j") / width).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    bits = counts.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(-p * F.log2(p)), F.lit(0.0)).alias("h"))
    return bits.select(F.col("h").alias("entropy"), (F.col("h") / math.log2(buckets)).alias("normalized"))


def row_bandwidth(entries: DataFrame, num_rows: int) -> DataFrame:
    """(avg_bandwidth): the mean distance of a row's outer columns; empty rows count 0."""
    spans = entries.groupBy("i").agg((F.max("j") - F.min("j")).alias("w"))
    return spans.agg((F.coalesce(F.sum("w"), F.lit(0)).cast("double") / max(num_rows, 1)).alias("avg_bandwidth"))


def diagonal_proximity(entries: DataFrame, within: int = 100) -> DataFrame:
    """(near_percent) of entries with |j - i| below ``within``."""
    near = F.sum((F.abs(F.col("j") - F.col("i")) < within).cast("long"))
    return entries.agg((100.0 * F.coalesce(near, F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("near_percent"))


def x_footprint(spark, num_cols: int, float_bytes: int = 4, cache_mb: float = 4.0) -> DataFrame:
    """(x_mb, fit_percent): the size of x, and how much of it a cache holds."""
    mb = float_bytes * num_cols / 2**20
    return spark.range(1).select(F.lit(mb).alias("x_mb"), F.lit(min(100.0, cache_mb / mb * 100) if mb else 100.0).alias("fit_percent"))


def select_strategy(entries: DataFrame, num_rows: int, lanes: int = 64) -> DataFrame:
    """(avg_nnz, strategy): the kernel family that fits the integer mean row length.
    Advisory: Catalyst chooses the physical plan."""
    avg = F.floor(F.count(F.lit(1)) / max(num_rows, 1)).cast("long")
    short = "merge" if lanes == 64 else "scalar"
    return entries.agg(avg.alias("avg_nnz")).select("avg_nnz", F.when(F.col("avg_nnz") < 32, short).otherwise("vector").alias("strategy"), ((F.col("avg_nnz") > 8) & (F.col("avg_nnz") < 1000)).alias("shared_x"))
