"""Incremental sums over a stream of matrix entries: z = z0 + A x, kept up to date
as entries arrive. It is the accumulating product of tessera.operators.spmv in
Structured Streaming form (entries join a static x, one running sum a row)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_product(entries: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y) for streaming entries (i, j, v) and static x (j, x); write it in
    ``complete`` or ``update`` mode."""
    return entries.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
