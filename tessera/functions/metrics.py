"""Scalar expressions: throughput, traffic, timings, integer helpers."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gflops(nnz: Column, ms: Column) -> Column:
    return F.lit(2.0) * nnz / ms / 1e6


def bandwidth_gbs(nnz: Column, rows: Column, cols: Column, ms: Column, float_bytes: int = 4) -> Column:
    """GB/s when x is read once."""
    return (nnz * float_bytes + nnz * 4 + (rows + 1) * 4 + cols * float_bytes + rows * float_bytes) / ms / 1e6


def bandwidth_gibs_per_entry(nnz: Column, rows: Column, ms: Column, float_bytes: int = 4) -> Column:
    """GiB/s when x is read for every entry."""
    return (nnz * float_bytes + nnz * 4 + (rows + 1) * 4 + nnz * float_bytes + rows * float_bytes) / (ms / 1000.0) / float(2**30)


def memory_model(nnz: Column, rows: Column, cols: Column, float_bytes: int = 4, penalty: float = 2.5) -> dict[str, Column]:
    """Bytes of each array, their sum, and the sum when gathers of x cost ``penalty``
    times their bytes."""
    parts = {"row_ptr_bytes": rows * 8, "col_idx_bytes": nnz * 4, "value_bytes": nnz * float_bytes, "x_bytes": nnz * float_bytes, "y_bytes": rows * float_bytes}
    total = parts["row_ptr_bytes"] + parts["col_idx_bytes"] + parts["value_bytes"] + parts["x_bytes"] + parts["y_bytes"]
    return parts | {"total_bytes": total, "effective_bytes": total - parts["x_bytes"] + parts["x_bytes"] * penalty}


def timing_stats(times: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, min_ms, max_ms, avg_ms, std_ms, median_ms): the population's standard
    deviation, and the upper median, sorted[n / 2]."""
    t = F.col(value)
    stats = times.groupBy(*keys).agg(F.count(t).alias("n"), F.min(t).alias("min_ms"), F.max(t).alias("max_ms"), F.avg(t).alias("avg_ms"), F.stddev_pop(t).alias("std_ms"))
    # the median by counts of equal values, added up in their order: no key is gathered in a row
    counts = times.where(t.isNotNull()).groupBy(*keys, t.alias("_t")).agg(F.count(F.lit(1)).alias("_c"))
    places = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_t"))).withColumn("_all", F.sum("_c").over(Window.partitionBy(*keys)))
    medians = places.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_t").alias("median_ms"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return stats.join(medians, same, "left").select(*keys, "n", "min_ms", "max_ms", "avg_ms", "std_ms", "median_ms")


def conversion_overhead(ms: Column, conversion_ms: Column) -> dict[str, Column]:
    return {"total_ms": ms + conversion_ms, "overhead_percent": conversion_ms / ms * 100.0}


def div_round_up(n: Column, d: int) -> Column:
    return F.floor((n + (d - 1)) / d).cast("long")


def align_up(n: Column, d: int) -> Column:
    return div_round_up(n, d) * d


def next_pow2(n: Column) -> Column:
    """The least power of two that is n or more; 1 for n <= 1. It counts the bits of
    n - 1; powers of two are exact in double precision."""
    bits = F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))
    return F.pow(F.lit(2), bits).cast("long")


def round_up_pow2(n: Column, power: int) -> Column:
    """n rounded up to a multiple of ``power``, a power of two."""
    if power < 1 or power & (power - 1):
        raise ValueError("not a power of two")
    return (n + (power - 1)).bitwiseAND(F.lit(~(power - 1)).cast("long"))
