"""Queries: layouts and partition metadata. Arrays are shown in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import convert as c
from tessera.plans import fixtures as f
from tessera.plans.fixtures import query

#: Fixed small blocks: (bi, bj, block of 2 by 2) of a 5 by 5 matrix.
BLOCKS = [(0, 0, [1.0, 2.0, 0.0, 3.0]), (1, 1, [4.0, 0.0, 0.0, 5.0]), (2, 2, [6.0, 7.0, 8.0, 9.0]), (0, 2, [1.5, 9.0, 0.0, 9.0])]
#: Entries of rows that keep and break the two-of-four rule.
TWO_FOUR = [(0, 0, 1.0), (0, 2, 2.0), (0, 5, 3.0), (1, 0, 1.0), (1, 1, 2.0), (1, 3, 3.0), (2, 7, 4.0), (2, 7, 1.0), (2, 4, 1.0), (2, 5, 1.0), (2, 5, -1.0), (3, 1, 2.0), (3, 1, -2.0)]
_VALUES = ", ".join(f"({i}, {j}, {v}::DOUBLE)" for i, j, v in TWO_FOUR)

ORDINAL = ", o AS (SELECT i, j, v, ROW_NUMBER() OVER (ORDER BY i, j, v) - 1 AS p FROM a)"
SLOT = ", s AS (SELECT i, ROW_NUMBER() OVER (PARTITION BY i ORDER BY j, v) - 1 AS slot, j, v FROM a)"


def _small(spark):
    return spark.createDataFrame(TWO_FOUR, "i long, j long, v double")


@query("row_lengths", "SELECT i, n FROM len")
def _(spark, d):
    return c.row_lengths(f.a(spark, d), f.rows(spark, d))


@query("csr_row_ptr", "SELECT i, n, row_start FROM ptr")
def _(spark, d):
    return c.row_ptr(f.a(spark, d), f.rows(spark, d))


@query("coo_to_csr", SLOT + " SELECT i, slot, j, v FROM s")
def _(spark, d):
    packed = c.coo_to_csr(f.a(spark, d))
    long = packed.select("i", F.posexplode(F.arrays_zip(F.col("cols").alias("j"), F.col("vals").alias("v"))).alias("slot", "e"))
    return long.select("i", F.col("slot").cast("long").alias("slot"), "e.j", "e.v")


@query("csr_to_coo", "SELECT i, j, v FROM a")
def _(spark, d):
    return c.csr_to_coo(c.coo_to_csr(f.a(spark, d)))


@query("csr_to_ellpack", SLOT + ", k AS (SELECT i, unnest(range(0, (SELECT MAX(n) FROM len))) AS slot FROM len) SELECT i, slot, COALESCE(j, -1) AS j, COALESCE(v, 0) AS v FROM k LEFT JOIN s USING (i, slot)")
def _(spark, d):
    return c.ellpack_long(c.csr_to_ellpack(c.coo_to_csr(f.a(spark, d)), f.rows(spark, d)))


@query("ellpack_truncate", "SELECT i, LEAST(n, 4) AS kept, GREATEST(n - 4, 0) AS dropped FROM len")
def _(spark, d):
    ell = c.csr_to_ellpack(c.coo_to_csr(f.a(spark, d)), f.rows(spark, d), width=4)
    return ell.select("i", F.size(F.filter("cols", lambda j: j >= 0)).cast("long").alias("kept"), "dropped")


@query("ellpack_overhead", "SELECT MAX(n) AS width, 100.0::DOUBLE * (COUNT(*) * MAX(n) - SUM(n)) / SUM(n) AS overhead_percent FROM len")
def _(spark, d):
    n = c.row_lengths(f.a(spark, d), f.rows(spark, d)).agg(F.max("n").alias("width"), F.sum("n").alias("nnz"), F.count(F.lit(1)).alias("r"))
    return n.select("width", (100.0 * (F.col("r") * F.col("width") - F.col("nnz")) / F.col("nnz")).alias("overhead_percent"))


TILES = ORDINAL + " SELECT CAST(p // 256 AS BIGINT) AS tile, o.i AS tile_row, p - row_start AS tile_nnz_offset FROM o JOIN ptr USING (i) WHERE p % 256 = 0"


@query("csr_to_csr5_tiles", TILES)
def _(spark, d):
    return c.csr5_tiles(f.a(spark, d), f.rows(spark, d), sigma=256)


@query("convert_csr_to_csr5", TILES)
def _(spark, d):
    """From the row-packed layout."""
    return c.csr5_tiles(c.csr_to_coo(c.coo_to_csr(f.a(spark, d))), f.rows(spark, d), sigma=256)


_SIZES = ", t AS (SELECT (SELECT MAX(o_orderkey) + 1 FROM orders) AS r, (SELECT COUNT(*) FROM lineitem) AS nnz)"


def _totals(spark, d):
    return f.domain(f.rows(spark, d), "i"), f.table(spark, d, "lineitem").count()


@query("merge_partition_count", _SIZES + " SELECT GREATEST(1, (r + nnz) // 16) AS parts FROM t")
def _(spark, d):
    return spark.range(1).select(F.lit(c.merge_partition_count(*_totals(spark, d), per_partition=16)).cast("long").alias("parts"))


_POSITIONS = _SIZES + ", pos AS (SELECT unnest(range(0, 65)) AS part, r, nnz FROM t), k AS (SELECT part, LEAST(part * CAST(ceil((r + nnz) / 64.0) AS BIGINT), r + nnz) AS path_start FROM pos)"


@query("merge_partitions", _POSITIONS + " SELECT part, path_start FROM k")
def _(spark, d):
    return c.merge_partitions(spark, *_totals(spark, d), 64)


@query("merge_path_coords", _POSITIONS + " SELECT part, path_start, COUNT(ptr.i) AS path_row, path_start - COUNT(ptr.i) AS path_nnz FROM k LEFT JOIN ptr ON row_start + n + ptr.i < path_start GROUP BY part, path_start")
def _(spark, d):
    return c.merge_path(f.a(spark, d), f.rows(spark, d), c.merge_partitions(spark, *_totals(spark, d), 64))


@query("coo_to_bsr", ", e AS (SELECT i // 4 AS bi, j // 4 AS bj, (i % 4) * 4 + j % 4 AS pos, SUM(v) AS v FROM a GROUP BY ALL), k AS (SELECT bi, bj, unnest(range(0, 16)) AS pos FROM (SELECT DISTINCT bi, bj FROM e)) SELECT bi, bj, pos, CAST(COALESCE(v, 0) AS BIGINT) AS v FROM k LEFT JOIN e USING (bi, bj, pos)")
def _(spark, d):
    return c.coo_to_bsr(f.a(spark, d), 4).select("bi", "bj", F.posexplode("block").alias("pos", "v")).withColumn("pos", F.col("pos").cast("long"))


@query("bsr_to_csr", "SELECT i, j, CAST(SUM(v) AS BIGINT) AS v FROM a GROUP BY i, j HAVING SUM(v) <> 0")
def _(spark, d):
    rows, cols = f.domain(f.rows(spark, d), "i"), f.domain(f.cols(spark, d), "j")
    return c.csr_to_coo(c.coo_to_csr(c.bsr_to_coo(c.coo_to_bsr(f.a(spark, d), 4), 4, rows, cols)))


@query("bsr_padding", "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 1.0::DOUBLE), (0, 1, 2.0), (1, 1, 3.0), (2, 2, 4.0), (3, 3, 5.0), (4, 4, 6.0), (0, 4, 1.5)) t(i, j, v)", tables=False)
def _(spark, d):
    """Cells outside the matrix are padding, whatever they hold."""
    return c.bsr_to_coo(spark.createDataFrame(BLOCKS, "bi long, bj long, block array<double>"), 2, 5, 5)


@query("csr2_check", "SELECT i, g, COUNT(*) AS n, COUNT(*) <= 2 AS ok FROM (SELECT i, j // 4 AS g, j FROM a GROUP BY i, j HAVING SUM(v) <> 0) GROUP BY i, g")
def _(spark, d):
    return c.two_four_check(f.a(spark, d))


@query("csr2_check_small", f"SELECT i::BIGINT AS i, g::BIGINT AS g, COUNT(*) AS n, COUNT(*) <= 2 AS ok FROM (SELECT i, j // 4 AS g, j FROM (VALUES {_VALUES}) t(i, j, v) GROUP BY i, j HAVING SUM(v) <> 0) GROUP BY i, g", tables=False)
def _(spark, d):
    return c.two_four_check(_small(spark))


@query("csr2_pack", ", e AS (SELECT i, j, SUM(v) AS v FROM a GROUP BY i, j HAVING SUM(v) <> 0), m AS (SELECT i, j // 4 AS g, CAST(SUM(1 << CAST(j % 4 AS INTEGER)) AS INTEGER) AS meta FROM e GROUP BY ALL) SELECT e.i, m.g, m.meta, CAST(ROW_NUMBER() OVER (PARTITION BY e.i, m.g ORDER BY e.j) - 1 AS BIGINT) AS slot, CAST(e.v AS BIGINT) AS v FROM e JOIN m ON m.i = e.i AND m.g = e.j // 4")
def _(spark, d):
    packed = c.two_four_pack(f.a(spark, d))
    return packed.select("i", "g", "meta", F.posexplode("vals").alias("slot", "v")).withColumn("slot", F.col("slot").cast("long"))


@query("csr_memory", "SELECT COUNT(*) AS nnz, CAST(SUM(v) AS BIGINT) AS total, TRUE AS held, TRUE AS released FROM a")
def _(spark, d):
    """The matrix placed in memory, read from there, and released: Spark's counterpart
    of a device's copy."""
    from tessera.model import SparseMatrix

    m = SparseMatrix(f.a(spark, d), f.domain(f.rows(spark, d), "i"), f.domain(f.cols(spark, d), "j"))
    with m.placed() as held:
        total = held.entries.agg(F.count(F.lit(1)).alias("nnz"), F.sum("v").alias("total"))
        scanned = "InMemoryTableScan" in total._jdf.queryExecution().executedPlan().toString()
        row = total.first()
        kept = held.entries.storageLevel.useMemory
    gone = not m.entries.storageLevel.useMemory
    return spark.createDataFrame([(row.nnz, row.total, scanned and kept, gone)], "nnz long, total long, held boolean, released boolean")
