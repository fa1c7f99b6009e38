"""Conversions between coordinate, row-packed, padded, tiled and blocked layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordinal import exclusive_sum
from tessera.operators.spmv import with_ordinal


def row_lengths(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """(i, n) of every row, by one count over entries and rows."""
    both = entries.select("i", F.lit(1).alias("_one")).unionAll(rows.select("i", F.lit(None).cast("int")))
    counts = both.groupBy("i").agg(F.count("_one").alias("n"), F.count(F.lit(1)).alias("_all"))
    return counts.where("_all > n").select("i", "n")


def row_ptr(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """(i, n, row_start): entries of each row, and of all rows before."""
    return exclusive_sum(row_lengths(entries, rows), "i", "n", "row_start").select("i", "n", "row_start")


def coo_to_csr(entries: DataFrame) -> DataFrame:
    """(i, cols, vals): one record a row, ordered by column, then value."""
    packed = entries.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e"))
    return packed.select("i", F.col("e.j").alias("cols"), F.col("e.v").alias("vals"))


def csr_to_coo(packed: DataFrame) -> DataFrame:
    return packed.select("i", F.inline(F.arrays_zip(F.col("cols").alias("j"), F.col("vals").alias("v"))))


def csr_to_ellpack(packed: DataFrame, rows: DataFrame, width: int | None = None) -> DataFrame:
    """(i, cols, vals, dropped) with arrays of equal length, padded by -1 and 0. An
    explicit width cuts longer rows; dropped tells how many entries that costs."""
    zero = F.lit(0).cast(packed.schema["vals"].dataType.elementType)
    n = F.coalesce(F.size("cols"), F.lit(0))
    full = rows.join(packed, "i", "left")
    if width is None:
        # one number, whatever the input's size
        w = packed.agg(F.coalesce(F.max(F.size("cols")), F.lit(0)).alias("_w"))
        full = full.crossJoin(F.broadcast(w))
    else:
        full = full.withColumn("_w", F.lit(width))
    w = F.col("_w")
    pad = F.greatest(w - n, F.lit(0))
    cols = F.when(F.col("cols").isNull(), F.array_repeat(F.lit(-1).cast("long"), w)).otherwise(F.concat(F.slice("cols", F.lit(1), w), F.array_repeat(F.lit(-1).cast("long"), pad)))
    vals = F.when(F.col("vals").isNull(), F.array_repeat(zero, w)).otherwise(F.concat(F.slice("vals", F.lit(1), w), F.array_repeat(zero, pad)))
    return full.select("i", cols.alias("cols"), vals.alias("vals"), F.greatest(n - w, F.lit(0)).cast("long").alias("dropped"))


def ellpack_long(ell: DataFrame) -> DataFrame:
    """(i, slot, j, v)"""
    return ell.select("i", F.posexplode(F.arrays_zip(F.col("cols").alias("j"), F.col("vals").alias("v"))).alias("slot", "e")).select("i", F.col("slot").cast("long").alias("slot"), "e.j", "e.v")


def ellpack_entries(ell: DataFrame) -> DataFrame:
    """The entries (i, j, v) without padding."""
    return ellpack_long(ell).where("j >= 0").select("i", "j", "v")


def csr5_tiles(entries: DataFrame, rows: DataFrame, sigma: int = 256) -> DataFrame:
    """(tile, tile_row, tile_nnz_offset) of every tile of sigma entries: the last row
    that starts at or before the tile's first entry, and the way into it. Empty rows
    share the start of the next one, so the last of them counts."""
    starts = row_ptr(entries, rows)
    first = with_ordinal(entries).where(F.col("p_nnz") % sigma == 0).select(F.col("i").alias("_i"), F.col("p_nnz"))
    own = first.join(starts.select(F.col("i").alias("_i"), "row_start"), "_i")
    return own.select((F.col("p_nnz") / sigma).cast("long").alias("tile"), F.col("_i").alias("tile_row"), (F.col("p_nnz") - F.col("row_start")).alias("tile_nnz_offset"))


def merge_partitions(spark, num_rows: int, nnz: int, parts: int) -> DataFrame:
    """(part, path_start): min(part * ceil((rows + nnz) / parts), rows + nnz)."""
    length = num_rows + nnz
    step = -(-length // parts)
    return spark.range(parts + 1).select(F.col("id").alias("part"), F.least(F.col("id") * step, F.lit(length)).cast("long").alias("path_start"))


def merge_partition_count(num_rows: int, nnz: int, per_partition: int = 16, most: int | None = None) -> int:
    n = (num_rows + nnz) // per_partition
    return max(1, n if most is None else min(n, most))


def merge_path(entries: DataFrame, rows: DataFrame, positions: DataFrame, width: int = 4096) -> DataFrame:
    """(part, path_start, path_row, path_nnz): where the merge of row ends with entry
    numbers is split. A row r ends at path place row_start + n + r; a position k has
    consumed the rows that end before it. Positions and row ends meet in one union,
    counted by ranges of the path, so no range join is needed."""
    ends = row_ptr(entries, rows).select((F.col("row_start") + F.col("n") + F.col("i")).alias("_at"), F.lit(1).alias("_row"), F.lit(None).cast("long").alias("part"))
    marks = positions.select(F.col("path_start").alias("_at"), F.lit(0).alias("_row"), F.col("part"))
    both = ends.unionByName(marks).withColumn("_range", F.floor(F.col("_at") / width))
    totals = both.groupBy("_range").agg(F.sum("_row").alias("_total"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    # a mark comes before a row end at its own place
    inside = Window.partitionBy("_range").orderBy("_at", "_row", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = both.join(totals, "_range").withColumn("path_row", F.col("_ahead") + F.sum("_row").over(inside)).where("part is not null")
    return done.select("part", F.col("_at").alias("path_start"), F.col("path_row").cast("long").alias("path_row"), (F.col("_at") - F.col("path_row")).cast("long").alias("path_nnz"))


def coo_to_bsr(entries: DataFrame, b: int) -> DataFrame:
    """(bi, bj, block): dense blocks of b * b values, row by row; entries add up."""
    cells = entries.groupBy(F.floor(F.col("i") / b).alias("bi"), F.floor(F.col("j") / b).alias("bj"), ((F.col("i") % b) * b + F.col("j") % b).cast("int").alias("pos")).agg(F.sum("v").alias("v"))
    blocks = cells.groupBy("bi", "bj").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("m"))
    zero = F.lit(0).cast(cells.schema["v"].dataType)
    return blocks.select("bi", "bj", F.transform(F.sequence(F.lit(0), F.lit(b * b - 1)), lambda k: F.coalesce(F.element_at("m", k), zero)).alias("block"))


def bsr_to_coo(blocks: DataFrame, b: int, num_rows: int, num_cols: int) -> DataFrame:
    """(i, j, v) of all cells inside the matrix, without zeros."""
    cells = blocks.select("bi", "bj", F.posexplode("block").alias("pos", "v"))
    cells = cells.select((F.col("bi") * b + F.floor(F.col("pos") / b)).alias("i"), (F.col("bj") * b + F.col("pos") % b).alias("j"), "v")
    return cells.where((F.col("i") < num_rows) & (F.col("j") < num_cols) & (F.col("v") != 0))


def two_four_check(entries: DataFrame) -> DataFrame:
    """(i, g, n, ok): occupied columns of each aligned group of four; two at most
    are allowed. Entries of one cell add up first."""
    cells = entries.groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")
    counts = cells.groupBy("i", F.floor(F.col("j") / 4).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("i", "g", "n", (F.col("n") <= 2).alias("ok"))


def two_four_pack(entries: DataFrame) -> DataFrame:
    """(i, g, meta, vals): bit k of meta stands for column 4 g + k; vals in column
    order. Entries of one cell add up first."""
    cells = entries.groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")
    packed = cells.groupBy("i", F.floor(F.col("j") / 4).alias("g")).agg(F.sum(F.pow(F.lit(2), F.col("j") % 4).cast("int")).cast("int").alias("meta"), F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e"))
    return packed.select("i", "g", "meta", F.col("e.v").alias("vals"))
