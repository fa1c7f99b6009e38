"""Matrix Market files.

Reading: the banner and the size line are looked at on the driver (the first
lines of the file); entries are parsed in parallel by splits of the text.
Writing: entries in order as text parts, next to a header file; ``single_file``
makes the one file that other programs expect.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import SparseMatrix


class MtxError(ValueError):
    """A file that is not a supported coordinate matrix."""


@dataclass(frozen=True)
class Header:
    field: str
    symmetric: bool
    num_rows: int
    num_cols: int
    nnz: int
    lines: int = 0

    @property
    def pattern(self) -> bool:
        return self.field == "pattern"


def parse_header(lines: list[str]) -> Header:
    """From the first lines of a file, up to the size line at least."""
    words = lines[0].split() if lines else []
    if len(words) < 4 or words[0] != "%%MatrixMarket" or words[1].lower() != "matrix":
        raise MtxError("no Matrix Market banner")
    if words[2].lower() != "coordinate":
        raise MtxError(f"format {words[2]!r} is not supported, only coordinate")
    field = words[3].lower()
    if field == "complex":
        raise MtxError("complex values are not supported")
    if field not in ("real", "integer", "pattern"):
        field = "real"
    symmetry = words[4].lower() if len(words) > 4 else "general"
    if symmetry not in ("general", "symmetric"):
        raise MtxError(f"symmetry {symmetry!r} is not supported")
    for k, line in enumerate(lines[1:], 1):
        if not line.strip() or line.lstrip().startswith("%"):
            continue
        try:
            rows, cols, nnz = map(int, line.split())
        except ValueError:
            raise MtxError(f"bad size line {line!r}") from None
        return Header(field, symmetry == "symmetric", rows, cols, nnz, k + 1)
    raise MtxError("no size line")


def _paths(path: str) -> tuple[str, str]:
    """Header and entries of a matrix: one file, or a folder of write_mtx."""
    return (path, path) if path.endswith(".mtx") else (f"{path}/header.mtx", f"{path}/entries")


def read_header(spark: SparkSession, path: str) -> Header:
    """However many comment lines stand before the size line."""
    text = spark.read.text(_paths(path)[0]).withColumn("_n", F.monotonically_increasing_id())
    banner = text.head(1)
    size = text.where((F.col("_n") > 0) & ~F.col("value").rlike(r"^\s*(%|$)")).head(1)
    return replace(parse_header([r.value for r in banner + size]), lines=size[0]["_n"] + 1)


def header_frame(spark: SparkSession, header: Header) -> DataFrame:
    return spark.createDataFrame([(header.field, header.symmetric, header.num_rows, header.num_cols, header.nnz)], "field string, symmetric boolean, num_rows long, num_cols long, nnz long")


def parse_entries(lines: DataFrame, pattern: bool) -> DataFrame:
    """(i, j, v), numbered from 0, of text rows ``value``."""
    t = F.split(F.trim(F.col("value")), r"\s+")
    v = F.lit(1.0) if pattern else F.element_at(t, 3).cast("double")
    rows = lines.where(~F.col("value").rlike(r"^\s*(%|$)"))
    return rows.select((t[0].cast("long") - 1).alias("i"), (t[1].cast("long") - 1).alias("j"), v.alias("v"))


def read_mtx(spark: SparkSession, path: str, expand_symmetric: bool = True, check: bool = True) -> SparseMatrix:
    """The matrix in ``path``; the other half of a symmetric one is added unless told
    otherwise. ``check`` compares the number of entries with the size line."""
    header = read_header(spark, path)
    head, body = _paths(path)
    text = spark.read.text(body)
    if head == body:
        # a text scan numbers its rows in file order, the first split from 0
        text = text.withColumn("_n", F.monotonically_increasing_id()).where(F.col("_n") >= header.lines).drop("_n")
    entries = parse_entries(text, header.pattern)
    if check and (n := entries.count()) != header.nnz:
        raise MtxError(f"{n} entries, but the size line says {header.nnz}")
    if expand_symmetric and header.symmetric:
        entries = entries.unionByName(entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return SparseMatrix(entries, header.num_rows, header.num_cols)


def entry_lines(entries: DataFrame, digits: int | None = None) -> DataFrame:
    """Text rows, numbered from 1. Values have full precision, or ``digits``
    significant ones."""
    v = F.col("v").cast("double")
    number = F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(v.cast("string"))
    if digits is not None:
        number = F.format_string(f"%.{digits - 1}e", v)
    return entries.select(F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), number).alias("value"))


def write_mtx(matrix: SparseMatrix, path: str, symmetric: bool = False, digits: int | None = None, single_file: bool = False, ordered: bool = True) -> None:
    """``symmetric`` writes the upper triangle alone, after checking that the matrix
    is symmetric."""
    entries = matrix.entries
    spark = entries.sparkSession
    if symmetric:
        sums = entries.groupBy("i", "j").agg(F.sum("v").alias("v"))
        other = sums.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
        if sums.join(other, ["i", "j"], "full_outer").where("not coalesce(v = w, coalesce(v, w) = 0)").head(1):
            raise MtxError("the matrix is not symmetric")
        entries = entries.where("i <= j")
    n = entries.count()
    head = f"%%MatrixMarket matrix coordinate real {'symmetric' if symmetric else 'general'}\n{matrix.num_rows} {matrix.num_cols} {n}"
    lines = entry_lines(entries.orderBy("i", "j", "v") if ordered else entries, digits)
    if single_file:
        whole = spark.createDataFrame([(head,)], "value string").coalesce(1).unionByName(lines.coalesce(1)).coalesce(1)
        whole.write.text(path + ".parts")
        hadoop = spark._jvm.org.apache.hadoop.fs
        parts = hadoop.Path(path + ".parts")
        files = parts.getFileSystem(spark._jsc.hadoopConfiguration())
        made = next(s.getPath() for s in files.listStatus(parts) if s.getPath().getName().startswith("part-"))
        files.rename(made, hadoop.Path(path))
        files.delete(parts, True)
    else:
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/header.mtx")
        lines.write.text(f"{path}/entries")


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(idx, val) of a text file: a header line, then a value a line; comment lines
    take no index. Numbers come from the order of the file's splits."""
    text = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
    first = text.where("_n > 0").where(~F.col("value").rlike(r"^\s*(%|$)"))
    # rows of a split lie between multiples of 2^33: count the splits, then number inside
    first = first.withColumn("_part", F.shiftright("_n", 33))
    from pyspark.sql import Window

    sizes = first.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_ahead"))
    place = Window.partitionBy("_part").orderBy("_n")
    return first.join(sizes, "_part").select((F.col("_ahead") + F.row_number().over(place) - 1).cast("long").alias("idx"), F.trim("value").cast("double").alias("val"))
