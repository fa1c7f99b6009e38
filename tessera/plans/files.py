"""Queries: sources and sinks, each written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import metrics as m
from tessera.model import SparseMatrix
from tessera.plans import fixtures as f
from tessera.plans.fixtures import query
from tessera.scratch import shared_path
from tessera.sources import mtx, results

ENTRIES = "SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem"
#: A small symmetric file, with comments and a blank line.
SYMMETRIC = ["%%MatrixMarket matrix coordinate real symmetric", "% lower half", "4 4 5", "1 1 2.5", "2 1 -1", "", "3 2 4e-1", "% more", "4 4 7", "4 1 1.25"]
PATTERN = ["%%MatrixMarket matrix coordinate pattern general", "3 5 4", "1 5", "2 2", "3 1", "3 4"]
VECTOR = ["5 1", "0.5", "% comment", "1.5", "-2", "3e2", "0"]


def _matrix(spark, d):
    e = f.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return SparseMatrix(e, f.domain(f.rows(spark, d), "i"), f.domain(f.cols(spark, d), "j"))


def _text(spark, lines, name):
    path = shared_path(spark, name) + ".mtx"
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


@query("mtx_header", "SELECT 'real' AS field, FALSE AS symmetric, (SELECT MAX(o_orderkey) + 1 FROM orders) AS num_rows, (SELECT MAX(p_partkey) + 1 FROM part) AS num_cols, (SELECT COUNT(*) FROM lineitem) AS nnz", tables=False)
def _(spark, d):
    path = shared_path(spark, "mtx")
    mtx.write_mtx(_matrix(spark, d), path, ordered=False)
    return mtx.header_frame(spark, mtx.read_header(spark, path))


@query("mtx_read", ENTRIES, tables=False)
def _(spark, d):
    path = shared_path(spark, "mtx")
    mtx.write_mtx(_matrix(spark, d), path, ordered=False)
    return mtx.read_mtx(spark, path).entries


_HALF = "(VALUES (0::BIGINT, 0::BIGINT, 2.5::DOUBLE), (1, 0, -1.0), (2, 1, 0.4), (3, 3, 7.0), (3, 0, 1.25)) t(i, j, v)"


@query("mtx_read_symmetric", f"SELECT i, j, v FROM {_HALF} UNION ALL SELECT j, i, v FROM {_HALF} WHERE i <> j", tables=False)
def _(spark, d):
    return mtx.read_mtx(spark, _text(spark, SYMMETRIC, "symmetric")).entries


@query("mtx_read_coo", f"SELECT i, j, v FROM {_HALF}", tables=False)
def _(spark, d):
    return mtx.read_mtx(spark, _text(spark, SYMMETRIC, "coo"), expand_symmetric=False).entries


@query("mtx_lenient", "SELECT * FROM (VALUES (0::BIGINT, 4::BIGINT, 1.0::DOUBLE), (1, 1, 1.0), (2, 0, 1.0), (2, 3, 1.0)) t(i, j, v)", tables=False)
def _(spark, d):
    """Neither expanded nor counted; pattern entries are 1."""
    return mtx.read_mtx(spark, _text(spark, PATTERN, "pattern"), expand_symmetric=False, check=False).entries


@query("mtx_write", "SELECT (l_orderkey + 1) || ' ' || (l_partkey + 1) || ' ' || CAST(l_quantity AS BIGINT) AS value FROM lineitem", tables=False)
def _(spark, d):
    path = shared_path(spark, "mtx")
    mtx.write_mtx(_matrix(spark, d), path)
    return spark.read.text(f"{path}/entries")


@query("mtx_write_coo", "SELECT (l_orderkey + 1) || ' ' || (l_partkey + 1) || ' ' || CAST(l_quantity AS BIGINT) AS value FROM lineitem", tables=False)
def _(spark, d):
    """In the order of the input."""
    path = shared_path(spark, "coo")
    mtx.write_mtx(_matrix(spark, d), path, ordered=False)
    return spark.read.text(f"{path}/entries")


@query("vector_read", "SELECT * FROM (VALUES (0::BIGINT, 0.5::DOUBLE), (1, 1.5), (2, -2.0), (3, 300.0), (4, 0.0)) t(idx, val)", tables=False)
def _(spark, d):
    return mtx.read_vector(spark, _text(spark, VECTOR, "vector"))


#: Results as if every event type were a device and every value a time.
RESULTS = """WITH e AS (SELECT event_type, value AS ms FROM events WHERE value > 0),
g AS (SELECT event_type, COUNT(*) AS n, MIN(ms) AS lo, MAX(ms) AS hi FROM e GROUP BY event_type),
k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY event_type) AS r FROM g),
flat AS (SELECT n AS rows, 1000::BIGINT AS cols, n * 10 AS nnz, 0.01::DOUBLE AS sparsity, CASE WHEN r % 2 = 0 THEN 32 ELSE 64 END::BIGINT AS warp_size, 1008.0::DOUBLE AS peak_bandwidth, lo AS time_ms, hi - lo AS std_ms, 2.0::DOUBLE * (n * 10) / lo / 1e6 AS gflops, n * 80 / lo / 1e6 AS bandwidth, n * 80 / lo / 1e6 / 1008.0::DOUBLE * 100 AS utilization, r <> 3 AS correct FROM k)"""


def _results(spark, d):
    from pyspark.sql import Window

    e = f.table(spark, d, "events").where("value > 0").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    e = e.withColumn("r", F.row_number().over(Window.orderBy("event_type")))  # a few types
    n, lo = F.col("n"), F.col("lo")
    return e.select(
        n.alias("rows"), F.lit(1000).cast("long").alias("cols"), (n * 10).alias("nnz"), F.lit(0.01).alias("sparsity"), F.when(F.col("r") % 2 == 0, 32).otherwise(64).cast("long").alias("warp_size"), F.lit(1008.0).alias("peak_bandwidth"),
        lo.alias("time_ms"), lo.alias("min_ms"), F.col("hi").alias("max_ms"), lo.alias("avg_ms"), (F.col("hi") - lo).alias("std_ms"), m.gflops(n * 10, lo).alias("gflops"), (n * 80 / lo / 1e6).alias("bandwidth"), (n * 80 / lo / 1e6 / 1008.0 * 100).alias("utilization"), (F.col("r") != 3).alias("correct"),
    )


@query("results_json_read", RESULTS + " SELECT * FROM flat", tables=False)
def _(spark, d):
    path = shared_path(spark, "results")
    results.write_json(_results(spark, d), path)
    return results.read_json(spark, path)


@query("results_json_write", RESULTS + " SELECT COUNT(*) AS n, CAST(SUM(rows) AS BIGINT) AS rows FROM flat", tables=False)
def _(spark, d):
    """The text itself, parsed by JSON functions."""
    one = results.to_json(_results(spark, d))
    return one.select(F.from_json("value", results.SCHEMA)["results"].alias("r")).select(F.size("r").cast("long").alias("n"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["matrix"]["rows"]).alias("rows"))


@query("results_csv", RESULTS + " SELECT rows, warp_size, time_ms, correct FROM flat", tables=False)
def _(spark, d):
    path = shared_path(spark, "csv")
    results.write_csv(_results(spark, d).select("rows", "warp_size", "time_ms", "correct"), path)
    return results.read_csv(spark, path, "rows long, warp_size long, time_ms double, correct boolean")


@query("results_summary", RESULTS + " SELECT warp_size, COUNT(*) AS runs, ROUND(AVG(gflops), 2) AS avg_gflops, ROUND(AVG(utilization), 2) AS avg_utilization, ROUND(AVG(time_ms), 2) AS avg_time_ms, MAX(gflops) AS max_gflops, BOOL_AND(correct) AS all_correct FROM flat GROUP BY warp_size", tables=False)
def _(spark, d):
    return results.summary(_results(spark, d))


@query("results_describe", "SELECT 'l_quantity' AS name, COUNT(l_quantity) AS n, ROUND(AVG(l_quantity), 6) AS mean, ROUND(STDDEV_SAMP(l_quantity), 6) AS std, MIN(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q75, MAX(l_quantity) AS max FROM lineitem", tables=False)
def _(spark, d):
    out = results.describe(f.table(spark, d, "lineitem"), ["l_quantity"])
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))
