"""The tables as matrices and vectors.

A: (order, part, quantity) of lineitem. Rows: orders. x: retail prices of parts,
y0: total prices of orders. B: (supplier, part, discount) of lineitem, with few
heavy rows. Values are read in hundredths, as 64-bit integers, so that sums don't
depend on their order; a product of two is divided by 10,000 in the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The same tables in SQL, to be put in front of an oracle.
SQL = """a AS (SELECT l_orderkey AS i, l_partkey AS j, CAST(round(l_quantity * 100) AS BIGINT) AS v FROM lineitem),
b AS (SELECT l_suppkey AS i, l_partkey AS j, CAST(round(l_discount * 100) AS BIGINT) AS v FROM lineitem),
x AS (SELECT p_partkey AS j, CAST(round(p_retailprice * 100) AS BIGINT) AS x FROM part),
w AS (SELECT o_orderkey AS i, CAST(round(o_totalprice * 100) AS BIGINT) AS x FROM orders),
y AS (SELECT o_orderkey AS i, CAST(COALESCE(SUM(v * x), 0) AS DOUBLE) / 10000.0 AS y FROM orders LEFT JOIN a ON o_orderkey = a.i LEFT JOIN x USING (j) GROUP BY o_orderkey),
len AS (SELECT o_orderkey AS i, COUNT(a.i) AS n FROM orders LEFT JOIN a ON o_orderkey = a.i GROUP BY o_orderkey),
ptr AS (SELECT i, n, CAST(SUM(n) OVER (ORDER BY i) - n AS BIGINT) AS row_start FROM len)"""


def query(name: str, oracle: str | None = None, tables: bool = True):
    """Register a query, and its oracle."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = f"WITH {SQL}{oracle if oracle.lstrip().startswith(',') else ' ' + oracle}" if tables else oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(name: str):
    return F.round(F.col(name) * 100).cast("long")


def a(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), _cents("l_quantity").alias("v"))


def b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), _cents("l_discount").alias("v"))


def rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("i"))


def cols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("j"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"))


def x(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("j"), _cents("p_retailprice").alias("x"))


def w(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("j"), _cents("o_totalprice").alias("x"))


def y0(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("y0"))


def domain(df: DataFrame, key: str) -> int:
    """The size of a domain numbered from 0 (one number; from Parquet statistics)."""
    return (df.agg(F.max(key)).first()[0] or -1) + 1


SCALE = 10_000
