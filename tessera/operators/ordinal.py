"""Global numbers without a global window.

A window without PARTITION BY runs in one task. Here keys go to ranges of
``width``; totals of the ranges are few, and only they are summed in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def exclusive_sum(df: DataFrame, key: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """``df`` (one row for each non-negative integer ``key``) with the sum of
    ``value`` over all smaller keys in ``out``."""
    ranged = df.withColumn("_range", F.floor(F.col(key) / width))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(totals, "_range").withColumn(out, (F.col("_ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop("_range", "_ahead")


def rank_by(df: DataFrame, order: str, tie: str, out: str, bins: int = 1024) -> DataFrame:
    """``df`` with the 0-based rank of each row by (order, tie); ``order`` is numeric
    and not null. Rows go to equal bins between the extremes of ``order``, the bins'
    sizes are summed up, and rows are numbered within their bin."""
    ends = df.agg(F.min(F.col(order).cast("double")).alias("_lo"), F.max(F.col(order).cast("double")).alias("_hi"))
    spread = F.when(F.col("_hi") > F.col("_lo"), (F.col(order).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    # an extreme is one row, whatever the input's size; equal orders are split by ties
    binned = df.crossJoin(F.broadcast(ends)).withColumn("_bin", F.floor(spread * bins)).drop("_lo", "_hi")
    binned = binned.withColumn("_sub", F.floor(F.col(tie) / WIDTH))
    sizes = binned.groupBy("_bin", order, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    own = sizes.groupBy("_bin").agg(F.sum("_n").alias("_b"))
    ahead = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("_bin", F.coalesce(F.sum("_b").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("_bin").orderBy(order, "_sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.join(own, "_bin").select("_bin", F.col(order).alias("_o"), "_sub", (F.col("_ahead") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_ahead"))
    place = Window.partitionBy("_bin", order, "_sub").orderBy(tie)
    joined = binned.join(sizes.withColumnsRenamed({"_bin": "_b2", "_sub": "_s2"}), (F.col("_bin") == F.col("_b2")) & (F.col(order) == F.col("_o")) & (F.col("_sub") == F.col("_s2")))
    return joined.withColumn(out, (F.col("_ahead") + F.row_number().over(place) - 1).cast("long")).select(*df.columns, out)
