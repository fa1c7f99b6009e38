"""Embedding near-dedup by iterative quantisation.

Rotations for balanced binary codes are learnt on a bounded sample: the vectors'
principal directions, then turns between signs and the rotation that brings the
projections nearest to them, from several random starts, one for each part of the
code. Every vector gets a code, the signs of its rotated projections. Codes are cut
into substrings, one table each (multi-index Hamming). A substring has log2 of the
number of vectors as its length (8 to 32 bits), so that a bucket holds a few
unrelated vectors however many there are, and there are as many tables as it takes
for a pair at the threshold to meet in one with odds of 1 - ``miss``.

Vectors of one label that meet in a table are compared by their codes first: only
pairs within a Hamming radius (what bits of a pair at the threshold differ, plus
five standard deviations) are candidates. Only then are the original vectors fetched,
for those that have a candidate, and reranked: they link when their cosine, in
double precision, is ``threshold`` or more. Equal vectors are one class and are
never compared.

A bucket of more than ``bucket_rows`` classes is dealt out in slices, and every
pair of slices is a task of its own; within a task, pairs are counted, and their
links folded into a spanning forest, so that no more rows leave it than came in.
A pair that meets in several tables counts in the first of them.

Defined results: vectors that are null, zero or hold null or non-finite
components, and rows without a label, link with nothing; vectors of different
lengths are not compared; components of any size are scaled before they are
squared; rows with equal ids are vectors of their own; the component of a null id
is the least id it reaches, or null; other columns are not read. Recall against
brute force is measured in the tests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import broadcast_if_small, components, cut, discard, map_arrow, partitions

#: Bits of one rotation at most.
BITS = 64
_CHUNK = 256


def plan_tables(n: int, threshold: float, miss: float = 0.001) -> tuple[int, int, int]:
    """(substring length, tables, radius) for n vectors: two vectors at the threshold
    agree in a bit with odds of 1 - angle / pi."""
    length = min(max(math.ceil(math.log2(max(n, 2))), 8), 32)
    agree = 1 - math.acos(min(max(threshold, -1), 1)) / math.pi
    tables = max(math.ceil(math.log(miss) / math.log1p(-min(agree**length, 1 - 1e-12))), 1)
    bits = length * tables
    return length, tables, math.ceil(bits * (1 - agree) + 5 * math.sqrt(bits * agree * (1 - agree)))


def fit_rotation(sample: np.ndarray, bits: int, turns: int = 50, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of unit vectors: code = signs of (v - mean) @ projection.
    Beyond the vectors' length, further rotations of the same axes follow."""
    mean = sample.mean(0)
    x = sample - mean
    each = min(BITS, x.shape[1])
    _, _, axes = np.linalg.svd(x.T @ x)
    main = axes[:each].T
    v = x @ main
    rng, parts = np.random.default_rng(seed), []
    for _ in range(-(-bits // each)):
        turn, _ = np.linalg.qr(rng.normal(size=(each, each)))
        for _ in range(turns):
            left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        parts.append(main @ turn)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def _random_rotation(d: int, bits: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """For lengths that no sample was taken of."""
    rng = np.random.default_rng(seed)
    return np.zeros(d), np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-bits // d))], axis=1)[:, :bits]


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of finite numbers, not all 0, at length 1, without overflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _candidates(codes: np.ndarray, subs: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of left with right rows within the radius that meet in no table
    before this one."""
    same = left is right
    for a in range(0, len(left), _CHUNK):
        i = left[a : a + _CHUNK]
        far = np.zeros((len(i), len(right)), np.int32)
        for k in range(codes.shape[1]):
            far += np.bitwise_count(codes[i, k][:, None] ^ codes[right, k][None, :])
        x, y = np.nonzero(far <= radius)
        x, y = i[x], right[y]
        if same:
            x, y = x[x < y], y[x < y]
        if table:
            new = ~(subs[x, :table] == subs[y, :table]).any(1)
            x, y = x[new], y[new]
        if len(x):
            yield x, y


def _fold(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each tree when these links are added to the forest."""
    while len(i):
        low = np.minimum(root[i], root[j])
        if (low == root[i]).all() and (low == root[j]).all():
            break
        for x in (root[i], root[j], i, j):
            np.minimum.at(root, x, low)
        root = root[root]
    return root


def near_links(vectors: DataFrame, threshold: float = 0.98, sample_rows: int = 8192, bucket_rows: int = 2000, miss: float = 0.001, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row. The rotation is fitted on
    the ``sample_rows`` classes with the least hashes."""
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & v.isNotNull() & ~bad & ~zero, F.lit(False))
    rows = rows.withColumn("class", F.when(valid, F.xxhash64("label", "v")))
    classes = cut(rows.where("class is not null").groupBy("class", "label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")), "vectors")
    size = classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    length, tables, radius = plan_tables(size.n if size else 0, threshold, miss)
    models = {}
    if size is not None:
        picked = classes.where(F.size("v") == size.d).orderBy("class").limit(sample_rows).select("v").toPandas()["v"]
        models[size.d] = fit_rotation(unit_vectors(np.stack(picked.to_numpy()).astype(np.float64)), length * tables)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            for d in np.unique(np.diff(at)):
                pick = np.flatnonzero(np.diff(at) == d)
                unit = unit_vectors(flat[at[pick][:, None] + np.arange(d)])
                mean, projection = models[int(d)] if int(d) in models else _random_rotation(int(d), length * tables)
                bits = (unit - mean) @ projection >= 0
                subs = bits.reshape(len(pick), tables, length) @ (1 << np.arange(length, dtype=np.int64))
                codes = np.packbits(bits, axis=1)
                rows = pa.array(pick)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.full(len(pick), d), pa.int32()), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(list(subs), pa.list_(pa.int64())), pa.array([u.tobytes() for u in unit], pa.binary())], names=["class", "d", "code", "subs", "vector"])

    coded = map_arrow(classes.select("class", "v"), encode, "class long, d int, code binary, subs array<long>, vector binary")
    coded = cut(coded.join(classes.select("class", "label", "copies"), "class"), "codes")
    key = ["label", "d", "t", "sub"]
    entries = coded.select("class", "copies", "code", "subs", "label", "d", F.posexplode("subs").alias("t", "sub"))
    # buckets to be dealt out: few, as each holds many classes
    hot = cut(entries.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket_rows).select(*key, F.ceil(F.col("_n") / bucket_rows).alias("slices")), "hot-buckets")
    dealt = entries.join(broadcast_if_small(hot), key, "left").withColumn("slices", F.coalesce("slices", F.lit(1))).withColumn("slice", F.pmod(F.xxhash64("class"), "slices"))
    # slice s meets every slice: pairs (low, high) of slices
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("other"))
    block = [*key, F.least("slice", "other"), F.greatest("slice", "other")]
    dealt = dealt.select(F.xxhash64(*block).alias("b1"), F.xxhash64(F.lit(1), *block).alias("b2"), "t", (F.col("slice") <= F.col("other")).alias("low"), (F.col("slice") >= F.col("other")).alias("high"), "class", "copies", "code", "subs")

    def solve(t: pa.Table):
        """Rows of a block, and its candidate pairs."""
        low, high = (np.flatnonzero(t.column(c).to_numpy()) for c in ("low", "high"))
        if len(low) == len(high) == t.num_rows:
            high = low
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        subs = np.asarray(t.column("subs").combine_chunks().flatten()).reshape(t.num_rows, -1)
        return _candidates(codes, subs, t.column("t")[0].as_py(), low, high, radius)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            has = np.zeros(t.num_rows, bool)
            for i, j in solve(t):
                has[i] = has[j] = True
            if has.any():
                yield from t.filter(pa.array(has)).combine_chunks().to_batches()

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            vectors = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(t.num_rows, -1)
            ids, copies = t.column("class").to_numpy(), t.column("copies").to_numpy()
            links, root = np.zeros(t.num_rows, np.int64), np.arange(t.num_rows)
            for i, j in solve(t):
                for a in range(0, len(i), 1 << 14):
                    x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
                    ok = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= threshold
                    x, y = x[ok], y[ok]
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    root = _fold(root, x, y)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some])], names=["class", "root", "links"])

    parts, schema = partitions(spark), "b1 long, b2 long, t int, low boolean, high boolean, class long, copies long, code binary, subs array<long>"
    close = cut(map_arrow(dealt.repartition(parts, "b1", "b2").sortWithinPartitions("b1", "b2"), near, schema), "near-codes")
    asked = close.join(coded.select("class", "vector"), "class").select(*[f.split()[0] for f in schema.split(", ")], "vector")
    found = cut(map_arrow(asked.repartition(parts, "b1", "b2").sortWithinPartitions("b1", "b2"), rerank, "class long, root long, links long"), "vector-links")
    discard(coded, hot, close)
    comps = components(found, "class", "root").withColumnRenamed("node", "class")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.select("class", "copies", "least").join(counts, "class", "left").join(comps, "class", "left").withColumn("component", F.coalesce("component", "class"))
    known = cut(known, "vector-classes")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "class").join(known, "class", "left")
    own = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block of two or more, from batches sorted by (b1, b2)."""
    held: list[pa.RecordBatch] = []

    def whole() -> Iterator[pa.Table]:
        if sum(x.num_rows for x in held) > 1:
            yield pa.Table.from_batches(held)

    last = None
    for batch in batches:
        k = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))])
        ends = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        for x, y in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            if x == y:
                continue
            if tuple(k[:, x]) != last:
                yield from whole()
                held, last = [], tuple(k[:, x])
            held.append(batch.slice(x, y - x))
    yield from whole()
