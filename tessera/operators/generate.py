"""Matrix generators. Random numbers are hashes of (row or entry number, seed), so
a matrix does not depend on its partitioning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import SparseMatrix

#: Draws are integers below this: rows and columns beyond it could not be hit.
RANGE = 1 << 52


@dataclass(frozen=True)
class Config:
    num_rows: int = 1024
    num_cols: int = 1024
    sparsity: float = 0.01
    bandwidth: int = 1
    block: int = 4
    concentration: float = 5.0
    clusters: int = 10
    alpha: float = 2.5
    avg_nnz: int = 8
    seed: int = 42

    @property
    def nnz(self) -> int:
        return int(self.num_rows * self.num_cols * self.sparsity)


def draw(n: Column, seed: int) -> Column:
    """An integer in [0, 2^52) for the number n: the first 13 digits of a digest
    that any SQL engine can make."""
    digest = F.md5(F.concat(n.cast("long").cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _below(n: Column, seed: int, limit: int) -> Column:
    return (draw(n, seed) % limit).cast("long")


def _unit(n: Column, seed: int) -> Column:
    return draw(n, seed) / float(RANGE)


def _value(n: Column, seed: int) -> Column:
    """0.01, 0.02, .. 1.00"""
    return (_below(n, seed, 100) + 1) / 100.0


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "i")


def diagonal(spark: SparkSession, c: Config) -> DataFrame:
    return _rows(spark, min(c.num_rows, c.num_cols)).select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))


def banded(spark: SparkSession, c: Config) -> DataFrame:
    """1 / (distance + 1) up to ``bandwidth`` from the diagonal."""
    last = c.num_cols - 1
    span = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("i") - c.bandwidth), F.least(F.lit(last).cast("long"), F.col("i") + c.bandwidth))
    out = _rows(spark, min(c.num_rows, c.num_cols + c.bandwidth)).select("i", F.explode(span).alias("j"))
    return out.select("i", "j", (1.0 / (F.abs(F.col("i") - F.col("j")) + 1)).alias("v"))


def banded_half(spark: SparkSession, c: Config) -> DataFrame:
    """Ones up to half of ``bandwidth`` from the diagonal; any shape."""
    half = c.bandwidth // 2
    out = _rows(spark, min(c.num_rows, c.num_cols + half))
    return out.select("i", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("i") - half), F.least(F.lit(c.num_cols - 1).cast("long"), F.col("i") + half))).alias("j"), F.lit(1.0).alias("v"))


def block_diagonal(spark: SparkSession, c: Config) -> DataFrame:
    """Whole blocks of random values; rows after the last whole block are empty."""
    n = min(c.num_rows, c.num_cols) // c.block * c.block
    first = F.floor(F.col("i") / c.block) * c.block
    out = _rows(spark, n).select("i", F.explode(F.sequence(first, first + (c.block - 1))).alias("j"))
    return out.select("i", "j", _value(F.col("i") * c.num_cols + F.col("j"), c.seed).alias("v"))


def block_diagonal_ones(spark: SparkSession, c: Config) -> DataFrame:
    """Blocks of ones; a last partial block stays."""
    n = min(c.num_rows, c.num_cols)
    first = F.floor(F.col("i") / c.block) * c.block
    return _rows(spark, n).select("i", F.explode(F.sequence(first, F.least(first + (c.block - 1), F.lit(n - 1).cast("long")))).alias("j"), F.lit(1.0).alias("v"))


def uniform(spark: SparkSession, c: Config) -> DataFrame:
    """avg_nnz entries in every row, columns drawn with replacement, value 1."""
    out = spark.range(c.num_rows * c.avg_nnz)
    return out.select(F.floor(F.col("id") / c.avg_nnz).alias("i"), _below(F.col("id"), c.seed, c.num_cols).alias("j"), F.lit(1.0).alias("v"))


def random(spark: SparkSession, c: Config) -> DataFrame:
    """nnz entries anywhere, with replacement."""
    n = F.col("id")
    return spark.range(c.nnz).select(_below(n, c.seed, c.num_rows).alias("i"), _below(n, c.seed + 1, c.num_cols).alias("j"), _value(n, c.seed + 2).alias("v"))


def concentrated(spark: SparkSession, c: Config) -> DataFrame:
    """80 % of the entries lie around cluster centres, within half a cell of the
    grid of clusters; places outside are moved to the edge."""
    n = F.col("id")
    cell_r, cell_c = max(1, c.num_rows // c.clusters), max(1, c.num_cols // c.clusters)
    inside = _unit(n, c.seed) < 0.8
    cluster = _below(n, c.seed + 1, c.clusters)
    near = lambda cell, size, seed: F.least(F.greatest(_below(cluster, seed, size) + _below(n, seed + 1, cell) - cell // 2, F.lit(0)), F.lit(size - 1))
    i = F.when(inside, near(cell_r, c.num_rows, c.seed + 2)).otherwise(_below(n, c.seed + 4, c.num_rows))
    j = F.when(inside, near(cell_c, c.num_cols, c.seed + 6)).otherwise(_below(n, c.seed + 8, c.num_cols))
    return spark.range(c.nnz).select(i.cast("long").alias("i"), j.cast("long").alias("j"), _value(n, c.seed + 9).alias("v"))


def powerlaw(spark: SparkSession, c: Config) -> DataFrame:
    """Row min(rows - 1, floor(u^(1 / alpha) * rows)); any column."""
    n = F.col("id")
    i = F.least(F.lit(c.num_rows - 1).cast("long"), F.floor(F.pow(_unit(n, c.seed), F.lit(1.0 / c.alpha)) * c.num_rows))
    return spark.range(c.nnz).select(i.cast("long").alias("i"), _below(n, c.seed + 1, c.num_cols).alias("j"), _value(n, c.seed + 2).alias("v"))


def _varied(spark: SparkSession, c: Config, spread: int) -> DataFrame:
    length = F.least(F.greatest(c.avg_nnz - spread + _below(F.col("i"), c.seed, 2 * spread + 1), F.lit(1).cast("long")), F.lit(c.num_cols).cast("long"))
    out = _rows(spark, c.num_rows).select("i", F.explode(F.sequence(F.lit(0).cast("long"), length - 1)).alias("k"))
    # distinct columns: a start and a step that visits every column once
    start, step = _below(F.col("i"), c.seed + 1, c.num_cols), _below(F.col("i"), c.seed + 2, max(1, c.num_cols // max(1, c.avg_nnz + spread))) + 1
    return out.select("i", ((start + F.col("k") * step) % c.num_cols).alias("j"), F.lit(1.0).alias("v")).distinct()


def avg_nnz(spark: SparkSession, c: Config) -> DataFrame:
    """Rows of avg_nnz - 2 to avg_nnz + 2 distinct columns."""
    return _varied(spark, c, 2)


def row_varied(spark: SparkSession, c: Config) -> DataFrame:
    """Rows of avg_nnz - 1 to avg_nnz + 1 distinct columns."""
    return _varied(spark, c, 1)


GENERATORS: dict[str, Callable[[SparkSession, Config], DataFrame]] = {
    "diagonal": diagonal,
    "banded": banded,
    "banded_half": banded_half,
    "block_diag": block_diagonal,
    "block_diag_ones": block_diagonal_ones,
    "uniform": uniform,
    "random": random,
    "concentrated": concentrated,
    "powerlaw": powerlaw,
    "avg_nnz": avg_nnz,
    "row_varied": row_varied,
}


def generate(spark: SparkSession, kind: str, config: Config | None = None) -> SparseMatrix:
    if kind not in GENERATORS:
        raise ValueError(f"no generator {kind!r}; there are {sorted(GENERATORS)}")
    config = config or Config()
    return SparseMatrix(GENERATORS[kind](spark, config), config.num_rows, config.num_cols)
