"""N-gram Jaccard join with set-relation skipping.

Texts become sets of five-word shingles (64-bit hashes); two sets link when
their Jaccard similarity is ``threshold`` or more. The join is exact over all
rows. Work is skipped at three places:

* Equal sets are one class; copies are never compared.
* Index lists are block-skipped by position. Each set is ordered by a corpus-wide
  token order, rarest first (counts of all rows in a fixed-size sketch), and
  indexed under its prefix, the tokens of which any linked set must share one.
  A list holds (size, position) and is sorted by size. Lists of one class end
  where they are made; in the others, blocks of entries whose sizes or positions
  leave too few tokens for the required overlap are skipped as a whole.
* Answers are derived from those of a similar set. Every list's entries are first
  compared with one pivot of the list; what links shares the pivot's answer (its
  component), and no pair inside a component is compared again. Further rounds
  put each list into another hashed order and compare neighbours from different
  components. In the end all pairs of a list that are still in different
  components are compared, so no link between components is lost.

Shuffles carry packed index entries (24 bytes each), and sets of those classes
alone that share an indexed token with another one.

Defined results: null texts and texts without words have no shingles and link
with nothing; a text of one to four words has one shingle, the whole sequence;
rows that repeat an id are linked by their texts, like any others; a component
of documents without ids has a null component_id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import broadcast_if_small, components, cut, discard, grouped, lower_bytes, map_arrow, mix, partitions, release, span_hashes, steps, text_buffer, word_spans

#: Counters of the token sketch (a fixed 16 MB), and the parts it travels in.
CELLS = 1 << 22
SLICES = 32
_ENTRY = np.dtype([("token", "<i8"), ("set", "<i8"), ("n", "<i4"), ("pos", "<i4")])
_BLOCK = 64
#: Bytes of the folded parities that travel with the entries of the last round.
SIGN = 64
_FACTORS = np.random.default_rng(11).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    low = lower_bytes(raw)
    starts, ends, row = word_spans(low, offsets)
    h = span_hashes(low, starts, ends)
    words = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(words)])
    with np.errstate(over="ignore"):
        n = max(len(h) - width + 1, 0)
        full = np.zeros(n, np.uint64)
        for k in range(width):
            full += h[k : k + n] * _FACTORS[k]
        full = mix(full)
        out = []
        for i, w in enumerate(words):
            a = first[i]
            if w >= width:
                s = np.sort(full[a : a + w - width + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif w:
                out.append(mix((h[a : a + w] * _FACTORS[:w]).sum(keepdims=True) + np.uint64(w)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed integer; 0 for the empty one."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + np.uint64(len(s))
        return int(mix(x).view(np.int64)[0]) or 1


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(20)) & np.uint64(CELLS - 1)


def prefix_length(n: int, num: int, den: int) -> int:
    """Of a set of n: any set that links has a token in its first so many."""
    return n - -(-n * num // den) + 1


def enough(n_a, n_b, num: int, den: int):
    """The least overlap of linked sets: ceil(t / (1 + t) * (n_a + n_b))."""
    return -(-(n_a + n_b) * num // (num + den))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _classes(docs: DataFrame, width: int) -> DataFrame:
    """Rows of kind 0: (id, set, n, parities) of each text. Rows of kind 1: counts of tokens,
    one for each slice of the sketch and task."""
    kind = docs.schema["id"].dataType.simpleString()
    out = pa.schema([("kind", pa.int32()), ("id", pa.string()), ("set", pa.int64()), ("n", pa.int32()), ("parities", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for part in steps(batch, 1):
                sets = shingle_sets(*text_buffer(part.column(1)), width)
                np.add.at(counts, _cell(np.concatenate(sets)).astype(np.int64), np.uint32(1))
                k = len(sets)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k), pa.int32()), part.column(0).cast(pa.string()), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([parities(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(k, pa.binary())], schema=out)
        if counts.any():
            slices = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(SLICES), pa.int32()), pa.nulls(SLICES, pa.string()), pa.array(range(SLICES), pa.int64()), pa.nulls(SLICES, pa.int32()), pa.nulls(SLICES, pa.binary()), pa.array(slices, pa.binary())], schema=out)

    return map_arrow(docs, run, "kind int, id string, set long, n int, parities binary, counts binary").withColumn("id", F.col("id").cast(kind))


def _sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts: CELLS numbers, whatever the input's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(pa.decompress(blob, CELLS // SLICES * 4, "zstd", asbytes=True), np.uint32).astype(np.uint64)
                total[at] = total[at] + x if at in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], names=["at", "counts"])

    found = map_arrow(rows.where("kind = 1").select(F.col("set").alias("at"), "counts").repartition(SLICES, "at"), run, "at long, counts binary").collect()
    out = np.zeros(CELLS, np.uint32)
    for r in found:
        out[r.at * (CELLS // SLICES) : (r.at + 1) * (CELLS // SLICES)] = np.frombuffer(r.counts, np.uint32)
    return out


def _index(docs: DataFrame, width: int, num: int, den: int, sketch) -> DataFrame:
    """(token, set, n, pos, pivot) of the lists that hold two classes or more; pivot
    is the list's least set, where the entry can link with it."""
    spark = docs.sparkSession
    parts = partitions(spark)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sketch.value
        for batch in batches:
            for part in steps(batch, 0):
                found = []
                for s in shingle_sets(*text_buffer(part.column(0)), width):
                    n = len(s)
                    if n:
                        k = prefix_length(n, num, den)
                        counts = order[_cell(s).astype(np.int64)]
                        pick = np.lexsort((s, counts))[:k]
                        entries = np.empty(k, _ENTRY)
                        entries["token"], entries["set"], entries["n"], entries["pos"] = s[pick].view(np.int64), set_key(s), n, np.arange(k)
                        found.append(entries)
                if found:
                    entries = np.concatenate(found)
                    to = (entries["token"].view(np.uint64) >> np.uint64(32)) % np.uint64(parts)
                    by = np.argsort(to, kind="stable")
                    ends = np.concatenate([[0], np.cumsum(np.bincount(to.astype(np.int64), minlength=parts))])
                    entries = entries[by]
                    full = np.flatnonzero(np.diff(ends))
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([entries[ends[p] : ends[p + 1]].tobytes() for p in full], pa.binary())], names=["to", "entries"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
        e = np.frombuffer(b"".join(blobs), _ENTRY)
        del blobs
        e = e[np.lexsort((e["set"], e["token"]))]
        new = np.ones(len(e), bool)
        new[1:] = e["token"][1:] != e["token"][:-1]
        fresh = new.copy()
        fresh[1:] |= e["set"][1:] != e["set"][:-1]
        e, new = e[fresh], new[fresh]
        if not len(e):
            return
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(e)))
        head = np.repeat(at, size)
        long = np.repeat(size > 1, size)
        p = e[head]
        can = _can(e["n"], e["pos"], p["n"], p["pos"], num, den) & (e["set"] != p["set"])
        e, p, can = e[long], p[long], can[long]
        for a in range(0, len(e), 1 << 17):
            x, y = e[a : a + (1 << 17)], p[a : a + (1 << 17)]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x[c])) for c in ("token", "set", "n", "pos")), pa.array(np.ascontiguousarray(y["set"]), mask=~can[a : a + (1 << 17)])], names=["token", "set", "n", "pos", "pivot"])

    packed = map_arrow(docs.select("text"), emit, "to int, entries binary")
    return map_arrow(packed.repartition(parts, "to"), lists, "token long, set long, n int, pos int, pivot long")


def _can(n_a, pos_a, n_b, pos_b, num: int, den: int):
    """Whether sets that meet first at these positions can overlap enough."""
    rest = np.minimum(n_a - pos_a, n_b - pos_b).astype(np.int64)
    return rest >= enough(n_a.astype(np.int64), n_b.astype(np.int64), num, den)


def list_pairs(n: np.ndarray, pos: np.ndarray, group: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one list (sorted by size) from different groups that can link.
    Blocks whose largest remainders or sizes rule every pair out are skipped."""
    m = len(n)
    last = np.searchsorted(n, n * den // num, side="right")  # sizes over n / t can't link
    rest = n - pos
    blocks = range(0, m, _BLOCK)
    most = np.array([rest[b : b + _BLOCK].max() for b in blocks])
    small = np.array([n[b] for b in blocks])
    for k, b in enumerate(blocks):
        end = int(last[b : b + _BLOCK].max())
        for k2 in range(k, -(-end // _BLOCK)):
            if min(most[k], most[k2]) < enough(int(small[k]), int(small[k2]), num, den):
                continue
            i, j = np.meshgrid(np.arange(b, min(b + _BLOCK, m)), np.arange(k2 * _BLOCK, min((k2 + 1) * _BLOCK, m)), indexing="ij")
            ok = (i < j) & (j < last[i]) & (group[i] != group[j]) & _can(n[i], pos[i], n[j], pos[j], num, den)
            if ok.any():
                yield i[ok], j[ok]


def parities(s: np.ndarray) -> bytes:
    """A bitmap of at least 2 n bits: bit k tells whether an odd number of tokens
    falls on k. Where two bitmaps differ, so do the sets."""
    bits = max(256, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their parities;
    the longer bitmap is folded to the length of the shorter one."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _signed(owners: DataFrame) -> DataFrame:
    """``owners`` with sign, their parities folded to SIGN bytes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = []
            for p in batch.column(3).to_pylist():
                x = np.frombuffer(p, np.uint8)
                signs.append(np.bitwise_xor.reduce(x.reshape(-1, min(len(x), SIGN)), axis=0).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs, pa.binary())], names=["set", "id", "n", "parities", "sign"])

    kind = owners.schema["id"].dataType.simpleString()
    return map_arrow(owners.select("set", "id", "n", "parities"), run, f"set long, id {kind}, n int, parities binary, sign binary")


def _kept(batch: pa.RecordBatch, keep: list[bool]) -> pa.RecordBatch:
    mask = pa.array(keep, pa.bool_())
    return pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def _with_both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """(a, b) and ``columns`` of both sets."""
    side = lambda k: sets.select(F.col("set").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns])
    return side("a").join(broadcast_if_small(pairs), "a").join(side("b"), "b").select("a", "b", *[f"{c}_{k}" for c in columns for k in "ab"])


def _likely(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs`` that parities don't rule out, before sets travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(2)).astype(np.int64) + np.asarray(batch.column(3))
            most = n - 2 * enough(n, 0, num, den)
            differ = [differing(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield _kept(batch, [d <= m for d, m in zip(differ, most.tolist(), strict=True)])

    return map_arrow(_with_both(pairs, sets, "n", "parities"), run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs`` that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([s, t]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= enough(len(s), len(t), num, den))
            yield _kept(batch, keep)

    return map_arrow(_with_both(pairs, sets, "tokens"), run, "a long, b long")


def _sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(set, tokens) of the classes in ``needed`` (set, id): the whole sorted sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1):
                sets = shingle_sets(*text_buffer(part.column(1)), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set", "tokens"])

    kind = docs.schema["id"].dataType.simpleString()
    # only the text of a class's first document can hold the class
    docs = docs.join(broadcast_if_small(needed.select(F.col("id").alias("_id")).distinct()), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    made = map_arrow(docs, run, f"id {kind}, set long, tokens binary")
    found = made.join(needed.select(F.col("id").alias("_id"), F.col("set").alias("_set")), (F.col("set") == F.col("_set")) & F.col("id").eqNullSafe(F.col("_id")))
    return found.select("set", "tokens").dropDuplicates(["set"])


def _live(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """``entries`` of the lists that still hold several components, with them."""
    comps = broadcast_if_small(comps.withColumnsRenamed({"node": "set", "component": "_c"}))
    named = entries.select("token", "set", "n", "pos").join(comps, "set", "left").withColumn("comp", F.coalesce("_c", "set"))
    of_list = Window.partitionBy("token")
    named = named.withColumn("_lo", F.min("comp").over(of_list)).withColumn("_hi", F.max("comp").over(of_list))
    return named.where("_lo <> _hi").select("token", "set", "n", "pos", "comp")


def link_classes(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (3, 4), rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """For (id, text) rows: (id, set, n) of every row, and (node, component) of the
    sets that link."""
    num, den = threshold
    spark = docs.sparkSession
    rows = cut(_classes(docs, width), "sets")
    texts = rows.where("kind = 0").select("id", "set", "n")
    sketch = spark.sparkContext.broadcast(_sketch(rows))
    entries = cut(_index(docs, width, num, den, sketch), "lists")
    release(spark)
    sketch.unpersist()
    used = rows.where("kind = 0 and n > 0").join(broadcast_if_small(cut(entries.select("set").distinct(), "listed")), "set")
    first = used.groupBy("set").agg(F.min(F.struct("id", "n", "parities")).alias("r")).select("set", "r.id", "r.n", "r.parities")
    owners = cut(_signed(first), "owners")
    links, comps, tried = None, None, None
    for k in range(rounds + 1):
        if k == 0:
            pairs = entries.where("pivot is not null").select(F.col("pivot").alias("a"), F.col("set").alias("b")).distinct()
        else:
            last, entries = entries, cut(_live(entries, comps), "live-lists")
            discard(last)
            pairs = _neighbours(entries, num, den, k) if k < rounds else _all_pairs(entries.join(broadcast_if_small(owners.select("set", "sign")), "set"), num, den)
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        tried = pairs if tried is None else tried.unionAll(pairs)
        likely = cut(_likely(pairs, owners, num, den), "likely-pairs")
        asked = likely.select(F.col("a").alias("set")).unionAll(likely.select("b")).distinct()
        asked = cut(owners.join(asked, "set").select("set", "id"), "asked")
        sets = cut(_sets(docs, asked, width), "token-sets")
        found = cut(_linked(likely, sets, num, den), "verified")
        discard(asked, sets, likely)
        release(spark)
        if links is None or found.head(1):
            links = found if links is None else links.unionAll(found)
            comps = components(links, "a", "b")
    discard(entries, owners)
    return texts, comps


def _neighbours(live: DataFrame, num: int, den: int, turn: int) -> DataFrame:
    """Of every list, in an order that hashes of sets and ``turn`` give, neighbours
    from different components: two pairs for an entry at most."""
    at = Window.partitionBy("token").orderBy(F.xxhash64(F.lit(turn), "token", "set"), "set")
    rows = live.select("token", "set", "n", "pos", "comp", *[F.lag(c).over(at).alias(f"_{c}") for c in ("set", "n", "pos", "comp")])
    rest = F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos"))
    can = (F.col("comp") != F.col("_comp")) & (rest * (num + den) >= (F.col("n") + F.col("_n")) * num)
    return rows.where(can).select(F.least("set", "_set").alias("a"), F.greatest("set", "_set").alias("b")).distinct()


def _all_pairs(live: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of every list from different components that can link, as far as
    sizes, positions and folded parities tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, 1):
            s, n, pos, comp = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 4))
            length = min(len(r[5]) for r in rows)
            sign = np.stack([np.bitwise_xor.reduce(np.frombuffer(r[5], np.uint8).reshape(-1, length), axis=0) for r in rows])
            for i, j in list_pairs(n, pos, comp, num, den):
                total = n[i] + n[j]
                ok = np.bitwise_count(sign[i] ^ sign[j]).sum(1) <= total - 2 * enough(total, 0, num, den)
                i, j = i[ok], j[ok]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s[i], s[j])), pa.array(np.maximum(s[i], s[j]))], names=["a", "b"])

    return _by_token(live, run, "sign").distinct()


def _by_token(live: DataFrame, run, *more: str) -> DataFrame:
    spark = live.sparkSession
    rows = live.select("token", "set", "n", "pos", "comp", *more).repartition(partitions(spark), "token").sortWithinPartitions("token", "n", "set")
    return map_arrow(rows, run, "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (3, 4), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, set_id) of every row; threshold is a ratio
    of integers. set_id is equal for equal sets (0: no shingles)."""
    texts, comps = link_classes(_slim(docs, id_col, text_col), width, threshold)
    roots = comps.withColumnsRenamed({"node": "set", "component": "_root"})
    # the least id of each set, then of each component: one row a set
    least = texts.where("n > 0").groupBy("set").agg(F.min("id").alias("_least")).join(roots, "set", "left").withColumn("_root", F.coalesce("_root", "set"))
    least = cut(least, "set-roots")
    named = least.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = cut(least.join(named, "_root").select("set", "component_id"), "set-components")
    out = texts.join(named, "set", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.col("set").alias("set_id"))
