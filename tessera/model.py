"""Matrices and vectors as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Op(Enum):
    NORMAL = "normal"
    TRANSPOSE = "transpose"
    CONJUGATE = "conjugate"


@dataclass(frozen=True)
class SparseMatrix:
    """Entries (i, j, v), numbered from 0, of a num_rows by num_cols matrix. Entries
    that share (i, j) add up; rows and columns without entries are zero."""

    entries: DataFrame
    num_rows: int
    num_cols: int

    def __post_init__(self):
        kind = dict(self.entries.dtypes)
        missing = {"i", "j", "v"} - kind.keys()
        if missing:
            raise ValueError(f"entries lack {sorted(missing)}")
        if self.num_rows < 0 or self.num_cols < 0:
            raise ValueError("negative dimension")
        base = kind["v"].split("(")[0]
        if base not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
            raise TypeError(f"values of type {kind['v']} are not supported")

    @property
    def T(self) -> SparseMatrix:
        return SparseMatrix(self.entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.num_cols, self.num_rows)

    def rows(self) -> DataFrame:
        """(i) of all rows."""
        return self.entries.sparkSession.range(self.num_rows).withColumnRenamed("id", "i")

    def cols(self) -> DataFrame:
        """(j) of all columns."""
        return self.entries.sparkSession.range(self.num_cols).withColumnRenamed("id", "j")

    @contextmanager
    def placed(self) -> Iterator[SparseMatrix]:
        """The matrix with its entries held in memory (on disk where they don't fit),
        filled by a first pass over them, and released in the end."""
        self.entries.persist()
        try:
            self.entries.count()
            yield self
        finally:
            self.entries.unpersist(blocking=True)


@dataclass(frozen=True)
class DenseVector:
    """(idx, val) of a vector; indexes from 0 to size - 1."""

    df: DataFrame
    size: int
