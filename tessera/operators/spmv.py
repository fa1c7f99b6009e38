"""Sparse matrix times dense vector.

One logical plan: join the entries with x on the column, multiply, and sum by
row with partial aggregation before the shuffle. The rows themselves take part in
that sum with nothing to add, so that empty ones give 0 without a join of their
own: a product costs one shuffle where x is broadcast. Tiles, merge partitions, batches and row ranges are bucket columns
over it, and every route gives the same y.

Catalyst picks the join (broadcast where x is small, else sort-merge, with AQE
splitting of skewed columns). ``salt`` spreads a heavy column over that many
copies of its x beforehand; the copies are always dealt by a shuffle, as Catalyst
estimates them at the size of one and would broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import DenseVector, Op, SparseMatrix
from tessera.operators.ordinal import exclusive_sum


def products(entries: DataFrame, x: DataFrame, salt: int = 1) -> DataFrame:
    """``entries`` with p = v * x_j. x is (j, x)."""
    if salt > 1:
        entries = entries.withColumn("_salt", F.pmod(F.xxhash64("i", "v"), F.lit(salt)))
        x = x.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        joined = entries.join(x.hint("merge"), ["j", "_salt"]).drop("_salt")
    else:
        joined = entries.join(x, "j")
    return joined.withColumn("p", F.col("v") * F.col("x")).drop("x")


def _finish(total: Column, scale: float) -> Column:
    y = F.coalesce(total.cast("double"), F.lit(0.0))
    return y if scale == 1 else y / F.lit(float(scale))


def spmv(entries: DataFrame, x: DataFrame, rows: DataFrame, buckets: tuple[str, ...] = (), scale: float = 1, salt: int = 1) -> DataFrame:
    """(i, y) for every row of ``rows`` (i, each once); entries elsewhere are left out.
    Integer or decimal values give sums that
    don't depend on their order; ``scale`` divides the result. ``buckets`` are columns
    of ``entries`` by which partial sums are made first."""
    made = products(entries, x, salt)
    if buckets:
        made = made.groupBy(*buckets, "i").agg(F.sum("p").alias("p"))
    nothing = F.lit(None).cast(made.schema["p"].dataType)
    both = made.select("i", "p", F.lit(False).alias("_own")).unionAll(rows.select("i", nothing, F.lit(True)))
    sums = both.groupBy("i").agg(F.sum("p").alias("_sum"), F.max("_own").alias("_own")).where("_own")
    return sums.select("i", _finish(F.col("_sum"), scale).alias("y"))


def axpby(y: DataFrame, y0: DataFrame, alpha: float, beta: float) -> DataFrame:
    """alpha * y + beta * y0 for (i, y) and (i, y0)."""
    return y.join(y0, "i", "left").select("i", (F.lit(alpha) * F.col("y") + F.lit(beta) * F.coalesce("y0", F.lit(0.0))).alias("y"))


def transpose(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("j").alias("i"), F.col("i").alias("j"), *[c for c in entries.columns if c not in ("i", "j")])


def accumulate(entries: DataFrame, x: DataFrame, z0: DataFrame, scale: float = 1) -> DataFrame:
    """(i, z) = z0 + A x, by one sum over products and z0 (i, z in the unit of the
    products)."""
    made = products(entries, x).select("i", "p").unionByName(z0.select("i", F.col("z").alias("p")))
    return made.groupBy("i").agg(_finish(F.sum("p"), scale).alias("z"))


def with_ordinal(entries: DataFrame) -> DataFrame:
    """``entries`` with their global position p in row order (i, j, v)."""
    from pyspark.sql import Window

    counts = entries.groupBy("i").agg(F.count(F.lit(1)).alias("_n"))
    starts = exclusive_sum(counts, "i", "_n", "_start").select("i", "_start")
    place = Window.partitionBy("i").orderBy("j", "v")
    return entries.join(starts, "i").withColumn("p_nnz", F.col("_start") + F.row_number().over(place) - 1).drop("_start")


def spmv_tiled(entries: DataFrame, x: DataFrame, rows: DataFrame, sigma: int = 256, scale: float = 1) -> DataFrame:
    """By tiles of sigma entries in row order."""
    tiled = with_ordinal(entries).withColumn("tile", F.floor(F.col("p_nnz") / sigma)).drop("p_nnz")
    return spmv(tiled, x, rows, ("tile",), scale)


def spmv_merge(entries: DataFrame, x: DataFrame, rows: DataFrame, per_partition: int = 16, scale: float = 1) -> DataFrame:
    """By partitions of the merge path: an entry at position p of row i lies at p + i."""
    parted = with_ordinal(entries).withColumn("part", F.floor((F.col("p_nnz") + F.col("i")) / per_partition)).drop("p_nnz")
    return spmv(parted, x, rows, ("part",), scale)


def spmv_batched(entries: DataFrame, x: DataFrame, rows: DataFrame, batch_rows: int = 200_000, scale: float = 1) -> DataFrame:
    return spmv(entries.withColumn("batch", F.floor(F.col("i") / batch_rows)), x, rows, ("batch",), scale)


def spmv_row_ranges(entries: DataFrame, x: DataFrame, rows: DataFrame, num_rows: int, n: int = 4, scale: float = 1) -> DataFrame:
    """By n ranges of ceil(rows / n) rows."""
    chunk = max(1, -(-num_rows // n))
    return spmv(entries.withColumn("range", F.floor(F.col("i") / chunk)), x, rows, ("range",), scale)


def spmv_sparse(entries: DataFrame, x: DataFrame, rows: DataFrame, num_rows: int, scale: float = 1, short: int = 4) -> DataFrame:
    """By rows where they have ``short`` entries or fewer on average (partial sums of a
    finer split would save nothing), else by partitions of the merge path."""
    if entries.count() // max(num_rows, 1) <= short:
        return spmv(entries, x, rows, scale=scale)
    return spmv_merge(entries, x, rows, scale=scale)


def hold(x: DataFrame, limit: int = 64 << 20, row_bytes: int = 16) -> DataFrame:
    """x at every worker if its rows, which are counted, take ``limit`` bytes at most;
    beyond, the join is left to Catalyst."""
    return F.broadcast(x) if x.count() * row_bytes <= limit else x


def multiply(a: SparseMatrix, x: DenseVector, alpha: float = 1.0, beta: float = 0.0, y0: DenseVector | None = None, op: Op = Op.NORMAL) -> DenseVector:
    """y = alpha * op(A) x + beta * y0. Values are real, so the conjugate is the
    transpose. Without entries, y is beta * y0."""
    if op is not Op.NORMAL:
        a = a.T
    if x.size != a.num_cols or (y0 is not None and y0.size != a.num_rows):
        raise ValueError("dimensions don't agree")
    y = spmv(a.entries, x.df.select(F.col("idx").alias("j"), F.col("val").alias("x")), a.rows())
    if alpha != 1.0 or (beta != 0.0 and y0 is not None):
        zero = a.rows().select("i", F.lit(0.0).alias("y0"))
        y = axpby(y, zero if y0 is None else y0.df.select(F.col("idx").alias("i"), F.col("val").alias("y0")), alpha, beta)
    return DenseVector(y.select(F.col("i").alias("idx"), F.col("y").alias("val")), a.num_rows)
