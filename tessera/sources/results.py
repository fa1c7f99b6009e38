"""Benchmark results as JSON and CSV, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MATRIX = "struct<rows: bigint, cols: bigint, nnz: bigint, sparsity: double>"
_DEVICE = "struct<id: bigint, warpSize: bigint, peakBandwidthGBs: double>"
_TIMES = "struct<timeMs: double, minTimeMs: double, maxTimeMs: double, avgTimeMs: double, stdDevMs: double, gflops: double, bandwidthGBs: double, bandwidthUtilization: double>"
SCHEMA = f"results array<struct<matrix: {_MATRIX}, device: {_DEVICE}, performance: {_TIMES}, correctnessPassed: boolean>>"

#: Flat columns, and where they stand in a result.
FLAT = {
    "rows": "matrix.rows",
    "cols": "matrix.cols",
    "nnz": "matrix.nnz",
    "sparsity": "matrix.sparsity",
    "warp_size": "device.warpSize",
    "peak_bandwidth": "device.peakBandwidthGBs",
    "time_ms": "performance.timeMs",
    "std_ms": "performance.stdDevMs",
    "gflops": "performance.gflops",
    "bandwidth": "performance.bandwidthGBs",
    "utilization": "performance.bandwidthUtilization",
    "correct": "correctnessPassed",
}


def nest(results: DataFrame) -> DataFrame:
    """Flat results as (matrix, device, performance, correctnessPassed)."""
    c = F.col
    return results.select(
        F.struct(c("rows"), c("cols"), c("nnz"), c("sparsity")).alias("matrix"),
        F.struct(F.lit(0).cast("long").alias("id"), c("warp_size").alias("warpSize"), c("peak_bandwidth").alias("peakBandwidthGBs")).alias("device"),
        F.struct(c("time_ms").alias("timeMs"), c("min_ms").alias("minTimeMs"), c("max_ms").alias("maxTimeMs"), c("avg_ms").alias("avgTimeMs"), c("std_ms").alias("stdDevMs"), c("gflops"), c("bandwidth").alias("bandwidthGBs"), c("utilization").alias("bandwidthUtilization")).alias("performance"),
        c("correct").alias("correctnessPassed"),
    )


def to_json(results: DataFrame) -> DataFrame:
    """One text row {"results": [..]}: a report of benchmark runs, which are few."""
    return nest(results).agg(F.to_json(F.struct(F.collect_list(F.struct("matrix", "device", "performance", "correctnessPassed")).alias("results"))).alias("value"))


def write_json(results: DataFrame, path: str) -> None:
    to_json(results).coalesce(1).write.text(path)


def flatten(documents: DataFrame) -> DataFrame:
    one = documents.select(F.explode("results").alias("r"))
    return one.select(*[F.col(f"r.{where}").alias(name) for name, where in FLAT.items()])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return flatten(spark.read.schema(SCHEMA).json(path, multiLine=True))


def write_csv(results: DataFrame, path: str) -> None:
    results.write.csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def summary(results: DataFrame) -> DataFrame:
    """By warp size: runs, mean and greatest throughput, and whether all were correct."""
    return results.groupBy("warp_size").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("gflops"), 2).alias("avg_gflops"),
        F.round(F.avg("utilization"), 2).alias("avg_utilization"),
        F.round(F.avg("time_ms"), 2).alias("avg_time_ms"),
        F.max("gflops").alias("max_gflops"),
        F.bool_and("correct").alias("all_correct"),
    )


def describe(results: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, mean, std, min, q25, median, q75, max) of each column; quartiles are
    interpolated."""
    long = results.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])))
    return long.groupBy("name").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), *[F.percentile("x", F.lit(q)).alias(a) for a, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))], F.max("x").alias("max"))
