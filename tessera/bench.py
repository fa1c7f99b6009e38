"""Timing of queries: warm-up runs, measured runs into the noop sink, statistics."""

from __future__ import annotations

import os
import tempfile
import time
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.metrics import timing_stats
from tessera.scratch import shared_path


def run_seconds(make: Callable[[], DataFrame]) -> float:
    began = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def measure(spark: SparkSession, make: Callable[[], DataFrame], warm_up: int = 3, runs: int = 10, name: str = "query") -> DataFrame:
    """(name, n, min_ms, max_ms, avg_ms, std_ms, median_ms)"""
    for _ in range(warm_up):
        run_seconds(make)
    times = [(name, run_seconds(make) * 1000) for _ in range(runs)]
    return timing_stats(spark.createDataFrame(times, "name string, ms double"), ["name"], "ms")


def device_info(spark: SparkSession) -> DataFrame:
    """(name, value): what the session has to compute with."""
    keys = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes")
    rows = [(k, spark.conf.get(k)) for k in keys] + [("defaultParallelism", str(spark.sparkContext.defaultParallelism)), ("version", spark.version)]
    return spark.createDataFrame(rows, "name string, value string")


def compare(spark: SparkSession, make: Callable[[], DataFrame], other: Callable[[], pa.RecordBatchReader], name: str, keys: tuple[str, ...], warm_up: int = 1, runs: int = 3, tolerance: float = 1e-9) -> DataFrame:
    """(name, n, avg_ms, other_ms, speed_up, same): a query timed beside another engine's
    ``other``, which gives the rows in batches, with the same columns in the same order;
    same tells whether the rows agree, those of equal ``keys`` in the order of their
    values. Rows are streamed on both sides; the driver holds a batch at a time. The other
    engine comes first."""
    times = []
    for _ in range(warm_up + runs):
        began = time.perf_counter()
        for _ in other():
            pass
        times.append((time.perf_counter() - began) * 1000)
    other_ms = sum(times[warm_up:]) / runs
    rows = _written(spark, other())
    took = measure(spark, make, warm_up, runs, name).first()
    same = same_rows(make(), rows, keys, tolerance)
    return spark.createDataFrame([(name, took.n, took.avg_ms, other_ms, other_ms / took.avg_ms, same)], "name string, n long, avg_ms double, other_ms double, speed_up double, same boolean")


def local_copy(spark: SparkSession, df: DataFrame, folder: str) -> None:
    """Parquet files of ``df`` in a new folder on the driver's machine, for an engine that
    reads no other. The workers write them, in row groups of 8 MB, as a reader may hold a
    row group for each of its threads."""
    path = shared_path(spark, "copy")
    df.write.option("parquet.block.size", 8 << 20).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.copyToLocalFile(False, hadoop(path), hadoop(f"file://{os.path.realpath(folder)}"), True)
    files.delete(hadoop(path), True)


def _written(spark: SparkSession, batches: pa.RecordBatchReader) -> DataFrame:
    """Batches that the driver gets, as a table in the shared folder."""
    path = shared_path(spark, "other")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    with tempfile.TemporaryDirectory() as folder:
        with pq.ParquetWriter(f"{folder}/rows.parquet", batches.schema) as out:
            for batch in batches:
                out.write_batch(batch)
        to = hadoop(path)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(hadoop(f"file://{os.path.realpath(folder)}/rows.parquet"), to)
    return spark.read.parquet(path)


def same_rows(mine: DataFrame, other: DataFrame, keys: tuple[str, ...], tolerance: float = 1e-9) -> bool:
    """Whether two tables of the same columns have the same rows, as often; floating-point
    numbers may differ by ``tolerance`` of the larger one."""
    if len(mine.columns) != len(other.columns):
        return False
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in mine.columns if c not in keys] or keys))
    a, b = (df.toDF(*mine.columns).withColumn("_nth", nth) for df in (mine, other))
    both = reduce(Column.__and__, (a[k].eqNullSafe(b[k]) for k in (*keys, "_nth")))

    def close(c: str, kind: str) -> Column:
        x, y = a[c], b[c]
        near = F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y)) if kind in ("double", "float") else F.lit(False)
        return x.eqNullSafe(y) | F.coalesce(near, F.lit(False))

    agree = reduce(Column.__and__, (close(c, kind) for c, kind in mine.dtypes), a["_nth"].isNotNull() & b["_nth"].isNotNull())
    return a.join(b, both, "full_outer").where(~agree).limit(1).count() == 0
