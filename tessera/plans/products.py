"""Queries: every route of the product."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import convert, profile
from tessera.operators import spmv as s
from tessera.plans import fixtures as f
from tessera.plans.fixtures import SCALE, query

Y = "SELECT i, y FROM y"
Z = "SELECT p_partkey AS i, CAST(COALESCE(SUM(v * w.x), 0) AS DOUBLE) / 10000.0 AS y FROM part LEFT JOIN a ON p_partkey = a.j LEFT JOIN w ON w.i = a.i GROUP BY p_partkey"


@query("spmv_csr", Y)
def _(spark, d):
    return s.spmv(f.a(spark, d), f.x(spark, d), f.rows(spark, d), scale=SCALE)


@query("spmv_axpby", "SELECT o_orderkey AS i, 2.0::DOUBLE * y + 0.5::DOUBLE * o_totalprice AS y FROM y JOIN orders ON o_orderkey = i")
def _(spark, d):
    y = s.spmv(f.a(spark, d), f.x(spark, d), f.rows(spark, d), scale=SCALE)
    return s.axpby(y, f.y0(spark, d), 2.0, 0.5)


@query("spmv_transpose", Z)
def _(spark, d):
    return s.spmv(s.transpose(f.a(spark, d)), f.w(spark, d), f.cols(spark, d).withColumnRenamed("j", "i"), scale=SCALE)


@query("spmv_conjugate", Z)
def _(spark, d):
    return s.spmv(s.transpose(f.a(spark, d)), f.w(spark, d), f.cols(spark, d).withColumnRenamed("j", "i"), scale=SCALE)


@query("spmv_transpose_accumulate", "SELECT p_partkey AS i, CAST(CAST(round(p_retailprice * 100) AS BIGINT) * 100 + COALESCE(SUM(v * w.x), 0) AS DOUBLE) / 10000.0 AS z FROM part LEFT JOIN a ON p_partkey = a.j LEFT JOIN w ON w.i = a.i GROUP BY p_partkey, p_retailprice")
def _(spark, d):
    z0 = f.x(spark, d).select(F.col("j").alias("i"), (F.col("x") * 100).alias("z"))
    return s.accumulate(s.transpose(f.a(spark, d)), f.w(spark, d), z0, scale=SCALE)


@query("spmv_float32", "SELECT o_orderkey AS i, CAST(CAST(COALESCE(SUM(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) * CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE)), 0) AS FLOAT) AS DOUBLE) AS y FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey", tables=False)
def _(spark, d):
    entries = f.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").cast("float").cast("double").alias("v"))
    x = f.table(spark, d, "part").select(F.col("p_partkey").alias("j"), F.col("p_retailprice").cast("float").cast("double").alias("x"))
    return s.spmv(entries, x, f.rows(spark, d)).select("i", F.col("y").cast("float").cast("double").alias("y"))


@query("spmv_csr5", Y)
def _(spark, d):
    return s.spmv_tiled(f.a(spark, d), f.x(spark, d), f.rows(spark, d), sigma=256, scale=SCALE)


@query("spmv_merge", Y)
def _(spark, d):
    return s.spmv_merge(f.a(spark, d), f.x(spark, d), f.rows(spark, d), per_partition=16, scale=SCALE)


@query("spmv_sparse_optimized", Y)
def _(spark, d):
    rows = f.rows(spark, d)
    return s.spmv_sparse(f.a(spark, d), f.x(spark, d), rows, f.domain(rows, "i"), scale=SCALE)


@query("spmv_sparse_optimized_long", "SELECT s_suppkey AS i, CAST(COALESCE(SUM(v * x), 0) AS DOUBLE) / 10000.0 AS y FROM supplier LEFT JOIN b ON s_suppkey = b.i LEFT JOIN x USING (j) GROUP BY s_suppkey")
def _(spark, d):
    """Long rows: the other side of the choice."""
    rows = f.suppliers(spark, d)
    return s.spmv_sparse(f.b(spark, d), f.x(spark, d), rows, f.domain(rows, "i"), scale=SCALE)


@query("spmv_x_held", Y)
def _(spark, d):
    """x at every worker, behind a check of its size."""
    return s.spmv(f.a(spark, d), s.hold(f.x(spark, d)), f.rows(spark, d), scale=SCALE)


@query("spmv_ellpack", Y)
def _(spark, d):
    ell = convert.csr_to_ellpack(convert.coo_to_csr(f.a(spark, d)), f.rows(spark, d))
    return s.spmv(convert.ellpack_entries(ell), f.x(spark, d), f.rows(spark, d), scale=SCALE)


@query("spmv_row_ranges", Y)
def _(spark, d):
    rows = f.rows(spark, d)
    return s.spmv_row_ranges(f.a(spark, d), f.x(spark, d), rows, f.domain(rows, "i"), n=4, scale=SCALE)


@query("spmv_batched", Y)
def _(spark, d):
    return s.spmv_batched(f.a(spark, d), f.x(spark, d), f.rows(spark, d), batch_rows=200_000, scale=SCALE)


@query("spmv_salted", "SELECT s_suppkey AS i, CAST(COALESCE(SUM(v * x), 0) AS DOUBLE) / 10000.0 AS y FROM supplier LEFT JOIN b ON s_suppkey = b.i LEFT JOIN x USING (j) GROUP BY s_suppkey")
def _(spark, d):
    """Few heavy rows, and columns spread over eight copies of x."""
    return s.spmv(f.b(spark, d), f.x(spark, d), f.suppliers(spark, d), scale=SCALE, salt=8)


@query("select_strategy_32", "SELECT CAST(floor(COUNT(*) / (SELECT MAX(o_orderkey) + 1 FROM orders)) AS BIGINT) AS avg_nnz, CASE WHEN floor(COUNT(*) / (SELECT MAX(o_orderkey) + 1 FROM orders)) < 32 THEN 'scalar' ELSE 'vector' END AS strategy, floor(COUNT(*) / (SELECT MAX(o_orderkey) + 1 FROM orders)) > 8 AND floor(COUNT(*) / (SELECT MAX(o_orderkey) + 1 FROM orders)) < 1000 AS shared_x FROM a")
def _(spark, d):
    return profile.select_strategy(f.a(spark, d), f.domain(f.rows(spark, d), "i"), lanes=32)


@query("select_strategy", "SELECT CAST(floor(COUNT(*) / (SELECT MAX(o_orderkey) + 1 FROM orders)) AS BIGINT) AS avg_nnz, CASE WHEN floor(COUNT(*) / (SELECT MAX(o_orderkey) + 1 FROM orders)) < 32 THEN 'merge' ELSE 'vector' END AS strategy, floor(COUNT(*) / (SELECT MAX(o_orderkey) + 1 FROM orders)) > 8 AND floor(COUNT(*) / (SELECT MAX(o_orderkey) + 1 FROM orders)) < 1000 AS shared_x FROM a")
def _(spark, d):
    return profile.select_strategy(f.a(spark, d), f.domain(f.rows(spark, d), "i"), lanes=64)
