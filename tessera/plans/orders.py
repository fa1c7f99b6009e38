"""Queries: reordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import reorder as r
from tessera.operators import spmv as s
from tessera.plans import fixtures as f
from tessera.plans.fixtures import SCALE, query

COM = ", com AS (SELECT p_partkey AS old_id, ROW_NUMBER() OVER (ORDER BY COALESCE(AVG(i), 0), p_partkey) - 1 AS new_id FROM part LEFT JOIN a ON j = p_partkey GROUP BY p_partkey)"
LEN = ", perm AS (SELECT i AS old_id, ROW_NUMBER() OVER (ORDER BY n, i) - 1 AS new_id FROM len)"


@query("sort_columns_within_rows", "SELECT i, ROW_NUMBER() OVER (PARTITION BY i ORDER BY j, v) - 1 AS pos, j, v FROM a")
def _(spark, d):
    return r.sort_columns(f.a(spark, d))


@query("reorder_columns_com", COM + " SELECT old_id, new_id FROM com")
def _(spark, d):
    return r.columns_by_mean_row(f.a(spark, d), f.cols(spark, d))


@query("reorder_columns_frequency", "SELECT p_partkey AS old_id, ROW_NUMBER() OVER (ORDER BY COUNT(a.j) DESC, p_partkey) - 1 AS new_id FROM part LEFT JOIN a ON j = p_partkey GROUP BY p_partkey")
def _(spark, d):
    return r.columns_by_frequency(f.a(spark, d), f.cols(spark, d))


@query("reorder_columns_min_row", "SELECT p_partkey AS old_id, ROW_NUMBER() OVER (ORDER BY COALESCE(MIN(i), (SELECT MAX(o_orderkey) + 1 FROM orders)), p_partkey) - 1 AS new_id FROM part LEFT JOIN a ON j = p_partkey GROUP BY p_partkey")
def _(spark, d):
    return r.columns_by_first_row(f.a(spark, d), f.cols(spark, d), f.domain(f.rows(spark, d), "i"))


@query("reorder_rows_by_length", LEN + " SELECT old_id, new_id FROM perm")
def _(spark, d):
    return r.rows_by_length(f.a(spark, d), f.rows(spark, d))


@query("reorder_stats", COM + ", g AS (SELECT ABS(j - LAG(j) OVER q) AS x, ABS(new_id - LAG(new_id) OVER q) AS y FROM a JOIN com ON old_id = j WHERE i < 10000 WINDOW q AS (PARTITION BY i ORDER BY j, v)) SELECT SUM(x)::DOUBLE / COUNT(x) AS gap_before, SUM(y)::DOUBLE / COUNT(y) AS gap_after, (SUM(x)::DOUBLE / COUNT(x)) / GREATEST(SUM(y)::DOUBLE / COUNT(y), 1.0::DOUBLE) AS ratio FROM g")
def _(spark, d):
    a = f.a(spark, d)
    return r.reorder_stats(a, r.columns_by_mean_row(a, f.cols(spark, d)))


@query("reorder_x_vector", COM + " SELECT new_id AS j, x FROM com JOIN x ON j = old_id")
def _(spark, d):
    return r.apply_to(f.x(spark, d), r.columns_by_mean_row(f.a(spark, d), f.cols(spark, d)), "j")


@query("restore_order", "SELECT i, y FROM y")
def _(spark, d):
    """Rows sorted by length, multiplied, and put back."""
    a, rows = f.a(spark, d), f.rows(spark, d)
    p = r.rows_by_length(a, rows)
    y = s.spmv(r.apply_to(a, p, "i"), f.x(spark, d), r.apply_to(rows, p, "i"), scale=SCALE)
    return r.restore(y, p, "i")


@query("reorder_invariance", "SELECT COUNT(*) AS n, 0::BIGINT AS n_changed FROM orders")
def _(spark, d):
    """Rows whose product changes when columns and x are permuted."""
    a, rows, x = f.a(spark, d), f.rows(spark, d), f.x(spark, d)
    p = r.columns_by_mean_row(a, f.cols(spark, d))
    y = s.spmv(a, x, rows, scale=SCALE)
    z = s.spmv(r.apply_to(a, p, "j"), r.apply_to(x, p, "j"), rows, scale=SCALE).withColumnRenamed("y", "z")
    return y.join(z, "i", "full_outer").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("y").eqNullSafe(F.col("z"))).cast("long")).alias("n_changed"))
