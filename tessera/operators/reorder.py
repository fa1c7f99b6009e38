"""Permutations of rows and columns, and how they change locality.

A permutation is (old_id, new_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.convert import row_lengths
from tessera.operators.ordinal import rank_by


def sort_columns(entries: DataFrame) -> DataFrame:
    """(i, pos, j, v): entries of each row by column, ties by value."""
    place = Window.partitionBy("i").orderBy("j", "v")
    return entries.select("i", (F.row_number().over(place) - 1).cast("long").alias("pos"), "j", "v")


def columns_by_mean_row(entries: DataFrame, cols: DataFrame) -> DataFrame:
    """Columns by the mean row of their entries, 0 for empty ones; ties by column."""
    keys = entries.groupBy("j").agg(F.avg("i").alias("_k"))
    keyed = cols.join(keys, "j", "left").select("j", F.coalesce("_k", F.lit(0.0)).alias("_k"))
    return rank_by(keyed, "_k", "j", "new_id").select(F.col("j").alias("old_id"), "new_id")


def columns_by_frequency(entries: DataFrame, cols: DataFrame) -> DataFrame:
    """Columns by number of entries, most first; ties by column."""
    counts = entries.groupBy("j").agg(F.count(F.lit(1)).alias("_n"))
    keyed = cols.join(counts, "j", "left").select("j", (-F.coalesce("_n", F.lit(0))).alias("_k"))
    return rank_by(keyed, "_k", "j", "new_id").select(F.col("j").alias("old_id"), "new_id")


def columns_by_first_row(entries: DataFrame, cols: DataFrame, num_rows: int) -> DataFrame:
    """Columns by their least row; empty ones last."""
    keys = entries.groupBy("j").agg(F.min("i").alias("_k"))
    keyed = cols.join(keys, "j", "left").select("j", F.coalesce("_k", F.lit(num_rows)).cast("long").alias("_k"))
    return rank_by(keyed, "_k", "j", "new_id").select(F.col("j").alias("old_id"), "new_id")


def rows_by_length(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows by number of entries, fewest first; ties by row."""
    return rank_by(row_lengths(entries, rows), "n", "i", "new_id").select(F.col("i").alias("old_id"), "new_id")


def apply_to(df: DataFrame, permutation: DataFrame, column: str) -> DataFrame:
    """``df`` with new ids in ``column``."""
    renamed = permutation.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
    joined = df.join(renamed, column)
    return joined.select(*[F.col("_new").alias(c) if c == column else F.col(c) for c in df.columns])


def restore(df: DataFrame, permutation: DataFrame, column: str) -> DataFrame:
    """``df`` with old ids in ``column``."""
    return apply_to(df, permutation.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id")), column)


def reorder_stats(entries: DataFrame, permutation: DataFrame, max_row: int = 10_000) -> DataFrame:
    """(gap_before, gap_after, ratio): the mean distance of columns that stand next
    to each other in a row, in the original order of entries (j, v), over rows below
    ``max_row``; null without such a pair."""
    new = permutation.select(F.col("old_id").alias("j"), F.col("new_id").alias("_new"))
    some = entries.where(F.col("i") < max_row).join(new, "j")
    place = Window.partitionBy("i").orderBy("j", "v")
    gaps = some.select(F.abs(F.col("j") - F.lag("j").over(place)).alias("a"), F.abs(F.col("_new") - F.lag("_new").over(place)).alias("b"))
    found = gaps.agg((F.sum("a") / F.count("a")).alias("gap_before"), (F.sum("b") / F.count("b")).alias("gap_after"))
    return found.select("gap_before", "gap_after", (F.col("gap_before") / F.greatest(F.col("gap_after"), F.lit(1.0))).alias("ratio"))
