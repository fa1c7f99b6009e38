"""Pieces that several operators of this subpackage share: the shared scratch
folder, text batches for Arrow UDFs, word boundaries and word hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: The separators of words: space and \t \n \v \f \r, as Java and RE2 write them.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch: a batch of texts is held by the JVM and by its worker.
BATCH_ROWS = 1000

#: Most bytes of text that one step of an Arrow UDF works on at a time (a longer
#: single text is still taken whole).
STEP_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's
    ``spark.checkpoint.dir``, or what setCheckpointDir() was given. Where both are
    unset, a local master gets a temporary folder; a cluster has no such folder,
    so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else getattr(spark.sparkContext, "_tessera_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.sparkContext._tessera_dir = tempfile.mkdtemp(prefix="tessera-")
    return found.rstrip("/")


#: Lists that collect what cut() writes, innermost last; one stack a thread.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the folders that cut() writes inside, for remove()."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(token)


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the JVM ends."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    where, files = _path(spark, path)
    files.deleteOnExit(where)
    for made in _scopes.get():
        made.append(path)
    return path


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again. Lineage
    ends there, so that a lost executor costs no recomputation, and the rows are
    the same for every later reader. The files go by discard(), or when the JVM
    ends. ``codec`` is the session's where it isn't given."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what cut() wrote for these, as nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        if path:
            remove(df.sparkSession, [path])


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where, files = _path(spark, path)
        files.delete(where, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: it grows with the cluster's
    input, so hash ranges derived from it keep their size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def steps(batch: pa.RecordBatch, column: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have at most ``limit`` bytes, or one row."""
    n = batch.num_rows
    if not n:
        return
    ends = text_buffer(batch.column(column))[1]
    first = 0
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows into
    them, without a copy. Null rows have no bytes (Arrow writers that leave bytes
    under nulls are handled by filling them with '')."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


#: Bytes that separate words.
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
#: ASCII lower case, as a lookup of bytes.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: An odd multiplier, and a random 64-bit value for each byte.
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            made = []
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                made.append(np.multiply.accumulate(x))
        _powers = made[0], made[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words never cross rows."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~_GAP[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by prefix sums modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def lower_bytes(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[raw]


class Lookup(dict):
    """A table of results by word, made when first asked for. Two generations of
    ``rows`` words bound it: when it is full, its words become the old generation,
    from which words in use come back, and the old generation before it goes."""

    def __init__(self, make, rows: int):
        super().__init__()
        self.make, self.rows, self.old = make, rows, {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(self) >= self.rows:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


#: Most bytes of a table that broadcast_if_small() hands out.
BROADCAST_BYTES = 16 << 20


def _width(value: Column, kind: DataType) -> Column:
    """The bytes that a value takes, about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        if isinstance(inner, (StringType, BinaryType, ArrayType, StructType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _width(x, inner)), F.lit(0)) + 16
        return F.greatest(F.size(value), F.lit(0)) * 8 + 16
    if isinstance(kind, StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already written by cut) with a broadcast hint if its values take
    ``limit`` bytes at most, which is measured; beyond, Spark joins it by shuffle."""
    return F.broadcast(df) if is_small(df, limit) else df


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the values of ``df`` take ``limit`` bytes at most, by a sum over them."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16))
    return (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= limit


def grouped(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of batches that are sorted by their first ``keys`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield key, rows


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (64-bit numbers); component is the
    least node that links reach. Every partition first folds its edges into a
    forest of stars, which it holds; then large-star and small-star steps in turn,
    each a grouping of edges, in which a hub's edges are folded by minima before
    the shuffle (AQE splits a hub's part of the join). Every round is written to
    the shared folder; it ends when the edges stand still."""
    pairs = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    pairs = cut(map_arrow(pairs.select("u", "v"), _forest, "u long, v long"), "links")
    seen = _print_of(pairs)
    while seen[0]:
        # large star: every larger neighbour of u links to the least one of u and its neighbours
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u's smaller neighbours and u link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, pairs = pairs, cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(last)
        now = _print_of(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(pairs.select(F.col("v"), F.col("v")).distinct())


def _print_of(pairs: DataFrame) -> tuple:
    """Count and two order-free digests of (u, v) rows."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars: each node and the least one it reaches."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                above[max(x, y)] = min(x, y)
    leaves = [x for x in above if top(x) != x]
    if leaves:
        yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array([top(x) for x in leaves], pa.int64())], names=["u", "v"])


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with this package at hand on every worker, wherever it runs: its
    source goes out once a session as a Python file. The session's Arrow batches
    are held to BATCH_ROWS rows, which bounds what a batch of texts takes."""
    context = df.sparkSession.sparkContext
    if not getattr(context, "_tessera_sent", False):
        folder = tempfile.mkdtemp(prefix="tessera-source-")
        package = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(f"{folder}/tessera_source.zip", "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        context.addPyFile(f"{folder}/tessera_source.zip")
        context._tessera_sent = True
    if int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished steps, which it does when the
    driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()
