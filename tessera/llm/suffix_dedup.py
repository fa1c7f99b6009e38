"""Exact removal of repeated byte strings with suffix arrays.

Every byte covered by a ``length``-byte string that also starts earlier (in a
document before, or in the same one further left) is removed; strings are judged
on the input. It works in these steps, none of which holds more than a bounded
block of text at once:

1. Runs. A window of ``length`` bytes is keyed by the least hash of its
   ``gram``-byte strings. Equal windows have equal keys, so only windows of one
   key are ever compared. Neighbouring windows mostly share their key; a run of
   them is one segment of text.
2. Segments with equal text under one key are one: all but the first are covered
   from end to end. What is left are the distinct segments of keys that occur
   more than once (or that repeat within a segment).
3. Suffix arrays. Blocks of these segments are suffix-sorted by the linear
   grouping construction. Windows that agree in ``length`` bytes are neighbours
   in the array; all but the earliest repeat it. Keys with more text than one
   block are spread over blocks; the first windows of these are dealt out anew by a
   hash of the window, and suffix-sorted in their turn. The result does not depend
   on the size of a block.
4. The removed runs of each document are merged and cut out of its bytes.

Shuffles carry packed entries of 49 bytes for each run (a task folds equal segments
of ``BUFFER`` bytes of entries first, so a passage that is in very many documents
sends a few), then texts of documents with shared segments, and removed runs.
Documents are told apart by their id and 127 bits of hashes of their text.

Defined results: a null text is empty; rows with equal id and text are one
document and get equal results; of different texts with equal ids, the one with
the smaller hash is earlier; null ids are earlier than all others, every real id
among them in its place; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import cut, map_arrow, mix, partitions, release, span_hashes, steps, text_buffer
from tessera.llm.suffix_array import suffix_array

#: Most bytes in a block that is suffix-sorted (a longer single segment is one block).
BLOCK = 1 << 18
#: Bytes of entries that a task folds at a time before they are shuffled.
BUFFER = 1 << 24
_RUN = np.dtype([("key", "<u8"), ("content", "<u8"), ("id", "<i8"), ("h", "<i8"), ("g", "<i8"), ("start", "<i4"), ("windows", "<i4"), ("loop", "?")])
_CUT = np.dtype([("start", "<i4"), ("bytes", "<i4")])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w, by prefix and suffix minima of blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


def runs(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start in row, number of windows, key, content hash, loop) of all runs.
    loop: the key may occur at two places of the run, whose windows may then repeat."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    at = np.arange(n - gram + 1)
    hashes, w = span_hashes(raw, at, at + gram), length - gram + 1
    least = sliding_min(hashes, w)
    # a place gives a window its key if no window over it has a greater key
    edge = np.full(w - 1, np.iinfo(np.uint64).max, np.uint64)
    places = np.flatnonzero(~sliding_min(np.concatenate([edge, ~least, edge]), w) == hashes)
    twice = places[1:][hashes[places[1:]] == hashes[places[:-1]]]
    row = np.searchsorted(offsets, np.arange(n - length + 1), side="right") - 1
    inside = np.arange(n - length + 1) + length <= offsets[row + 1]
    begin = inside.copy()
    begin[1:] &= ~(inside[:-1] & (row[1:] == row[:-1]) & (least[1:] == least[:-1]))
    first = np.flatnonzero(begin)
    breaks = np.flatnonzero(begin | ~inside)
    nxt = np.append(breaks, len(inside))[np.searchsorted(breaks, first, side="right")]
    windows = nxt - first
    content = span_hashes(raw, first, nxt - 1 + length)
    return row[first], first - offsets[row[first]], windows, least[first], content, np.isin(least[first], hashes[twice])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def repeated_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of segments in the order of precedence: for each window of ``length`` bytes,
    one segment after the other, whether an equal one is earlier, and its hash.

    The segments are suffix-sorted word by word (a word ends with white space, so
    no word begins another, and the order is that of the bytes). A window is found
    at the first word that begins in it: equal windows agree in the bytes before,
    and their words' suffixes are neighbours that agree in the bytes after.
    Windows in which no word begins are compared by their hashes."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    begin = end - size
    # words and a separator after each segment
    heads = np.zeros(len(raw), bool)
    heads[begin] = True
    space = _SPACE[raw]
    heads[1:] |= space[:-1]
    at = np.flatnonzero(heads)
    till = np.append(at[1:], len(raw))
    data = raw.tobytes()
    words = [data[a:b] for a, b in zip(at.tolist(), till.tolist(), strict=True)]
    code = {w: k + 1 for k, w in enumerate(sorted(set(words)))}
    of = np.searchsorted(begin, at, side="right") - 1
    symbols = np.zeros(len(at) + len(texts), np.int64)
    slot = np.arange(len(at)) + of
    symbols[slot] = [code[w] for w in words]
    back = np.full(len(symbols), -1)
    back[slot] = np.arange(len(at))
    order = back[suffix_array(symbols)]
    order = order[order >= 0]
    # bytes that neighbours in the suffix array share, within their segments
    padded = np.concatenate([raw, np.zeros(length, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, length)
    shared = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 14):
        b = min(a + (1 << 14), len(order))
        block = view[at[order[a - 1 : b]]]
        same = block[1:] == block[:-1]
        shared[a:b] = np.where(same.all(1), length, same.argmin(1))
    room = (end[of] - at)[order]
    shared[1:] = np.minimum(shared[1:], np.minimum(room[1:], room[:-1]))
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(order))
    # windows
    count = size - length + 1
    first = np.cumsum(count) - count
    start = np.arange(count.sum()) - np.repeat(first - begin, count)
    spaces = np.append(np.flatnonzero(space), 1 << 60)
    before = np.minimum(spaces[np.searchsorted(spaces, start)] - start + 1, length)
    whole = span_hashes(raw, start, start + length)
    group = whole.copy()
    worded = np.flatnonzero(before < length)
    word = np.searchsorted(at, start[worded] + before[worded])
    ahead = span_hashes(raw, start[worded], start[worded] + before[worded])
    interval = np.empty(len(worded), np.int64)
    by = np.argsort(before[worded], kind="stable")
    cuts = np.flatnonzero(np.diff(before[worded][by])) + 1
    for pick in np.split(by, cuts) if len(by) else []:
        r = int(before[worded[pick[0]]])
        interval[pick] = np.cumsum(shared < length - r)[place[word[pick]]]
    with np.errstate(over="ignore"):
        group[worded] = mix(mix(interval.astype(np.uint64) * np.uint64(128) + before[worded].astype(np.uint64)) ^ ahead)
    repeated = np.ones(len(group), bool)
    repeated[np.unique(group, return_index=True)[1]] = False
    return repeated, whole


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: What tells documents apart.
DOC = ["id", "h", "g"]


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, g, text): two hashes tell texts of one id apart; the last bit of g tells
    whether there is an id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = F.col(id_col).isNotNull().cast("long")
    other = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.lit(1), text), 1), 1)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("h"), other.bitwiseOR(known).alias("g"), text.alias("text"))


def _runs_of(docs: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """Kind 0: packed runs for part ``to``. Kind 1: packed (start, bytes) of runs
    that another one of the same buffer precedes."""
    schema = pa.schema([("kind", pa.int32()), ("to", pa.int32()), ("id", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("data", pa.binary())])

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate(held)
        keep, late = _leaders(e)
        docs = list(_by_document(e[late], length))
        for a in range(0, len(docs), 1 << 14):
            some = docs[a : a + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some)), pa.int32()), pa.array([(x[0] + x[1]) % parts for x in some], pa.int32()), *(pa.array([x[c] for x in some], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], schema=schema)
        e = e[keep]
        to = (e["key"] >> np.uint64(8)) % np.uint64(parts)
        e = e[np.argsort(to, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(to.astype(np.int64), minlength=parts))])
        for p in np.flatnonzero(np.diff(ends)):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([p], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in DOC), pa.array([e[ends[p] : ends[p + 1]].tobytes()], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in steps(batch, 3):
                row, start, windows, key, content, loop = runs(*text_buffer(part.column(3)), length, gram)
                if not len(row):
                    continue
                e = np.empty(len(row), _RUN)
                e["key"], e["content"], e["start"], e["windows"], e["loop"] = key, content, start, windows, loop
                for c, name in enumerate(DOC):
                    e[name] = np.asarray(part.column(c))[row]
                held.append(e)
                size += e.nbytes
                if size >= BUFFER:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return map_arrow(docs, run, "kind int, to int, id long, h long, g long, data binary")


def _leaders(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first run of each text, and of all others at other places: a
    repeated row has its runs at the places of the first."""
    by = np.argsort(e["content"], kind="stable")
    c = e["content"][by]
    twice = np.zeros(len(e), bool)
    same = c[1:] == c[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    some, alone = by[twice], by[~twice]
    x = e[some]
    some = some[np.lexsort((x["start"], *_order(x), x["windows"], x["key"], x["content"]))]
    x = e[some]
    first = np.ones(len(some), bool)
    first[1:] = (x["content"][1:] != x["content"][:-1]) | (x["key"][1:] != x["key"][:-1]) | (x["windows"][1:] != x["windows"][:-1])
    again = np.zeros(len(some), bool)
    again[1:] = ~first[1:] & ~_new_document(x) & (x["start"][1:] == x["start"][:-1])
    return np.concatenate([alone, some[first]]), some[~first & ~again]


def _order(e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of the order of documents for lexsort: null ids first, ids, hashes."""
    return e["g"], e["h"], e["id"], e["g"] & 1


def _new_document(e: np.ndarray) -> np.ndarray:
    """Whether each entry but the first is of another document than the one before."""
    return (e["id"][1:] != e["id"][:-1]) | (e["h"][1:] != e["h"][:-1]) | (e["g"][1:] != e["g"][:-1])


def _by_document(e: np.ndarray, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(id, h, g, packed cuts) of whole runs; touching ones are joined."""
    if not len(e):
        return
    e = e[np.lexsort((e["start"], *_order(e)))]
    new = np.ones(len(e), bool)
    new[1:] = _new_document(e) | (e["start"][1:] > e["start"][:-1] + e["windows"][:-1])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(e)) - 1
    cuts = np.empty(len(a), _CUT)
    cuts["start"], cuts["bytes"] = e["start"][a], e["start"][z] + e["windows"][z] + length - 1 - e["start"][a]
    head = e[a]
    doc = np.ones(len(a), bool)
    doc[1:] = _new_document(head)
    at = np.append(np.flatnonzero(doc), len(a))
    for x, y in zip(at[:-1], at[1:], strict=True):
        yield int(head["id"][x]), int(head["h"][x]), int(head["g"][x]), cuts[x:y].tobytes()


def _shared(rows: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """From packed runs. Kind 0: segments that have to be compared (key, block and
    whether the key has several blocks). Kind 1: packed cuts of later copies, those
    of the step before included."""
    names = ["kind", *DOC, "start", "windows", "key", "block", "split", "data"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: list[bytes] = []
        for batch in batches:
            cuts = batch.filter(pc.equal(batch.column(0), 1))
            packed += batch.filter(pc.equal(batch.column(0), 0)).column(5).to_pylist()
            n = cuts.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([cuts.column(0), *cuts.columns[2:5], *(pa.nulls(n, t) for t in types[4:9]), cuts.column(5)], names=names)
        e = np.frombuffer(b"".join(packed), _RUN)
        del packed
        if not len(e):
            return
        by = np.argsort(e["key"], kind="stable")
        k = e["key"][by]
        same = k[1:] == k[:-1]
        pick = e["loop"][by]
        pick[1:] |= same
        pick[:-1] |= same
        e = e[by[pick]]
        keep, late = _leaders(e)
        docs = list(_by_document(e[late], length))
        for a in range(0, len(docs), 1 << 14):
            some = docs[a : a + (1 << 14)]
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n), pa.int32()), *(pa.array([x[c] for x in some], pa.int64()) for c in range(3)), *(pa.nulls(n, t) for t in types[4:9]), pa.array([x[3] for x in some], pa.binary())], names=names)
        e = e[keep]
        e = e[np.lexsort((e["start"], *_order(e), e["key"]))]
        if not len(e):
            return
        new = np.ones(len(e), bool)
        new[1:] = e["key"][1:] != e["key"][:-1]
        head = np.flatnonzero(new)
        texts = np.diff(np.append(head, len(e)))
        loop = np.logical_or.reduceat(e["loop"], head)
        size = np.cumsum(e["windows"].astype(np.int64) + length - 1)
        before = np.repeat(size[head] - e["windows"][head] - length + 1, texts)
        block = (size - before) // BLOCK
        split = np.repeat(np.maximum.reduceat(block, head) > 0, texts)
        need = np.repeat((texts > 1) | loop, texts)
        e, block, split = e[need], block[need], split[need]
        for a in range(0, len(e), 1 << 16):
            x = e[a : a + (1 << 16)]
            n = len(x)
            cols = [np.ascontiguousarray(x[c]) for c in (*DOC, "start", "windows")]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n), pa.int32()), *map(pa.array, cols), pa.array(np.ascontiguousarray(x["key"]).view(np.int64)), pa.array(block[a : a + n], pa.int64()), pa.array(split[a : a + n]), pa.nulls(n, pa.binary())], names=names)

    return map_arrow(rows.repartition(parts, "to"), run, "kind int, id long, h long, g long, start int, windows int, key long, block long, split boolean, data binary")


def _segments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (id, h, g, start, windows, key, block, split) with their bytes, once
    for all rows of equal id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 3):
                raw, offsets = text_buffer(part.column(3))
                lists = part.column(4)
                n = np.diff(np.asarray(lists.offsets))
                flat = lists.flatten()
                start, windows = (np.asarray(flat.field(c)) for c in ("start", "windows"))
                row = np.repeat(np.arange(part.num_rows), n)
                a = offsets[row] + start
                data = memoryview(raw).cast("B") if len(raw) else b""
                texts = [bytes(data[x:y]) for x, y in zip(a.tolist(), (a + windows + length - 1).tolist(), strict=True)]
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([flat.field("key"), flat.field("block"), *(part.column(c).take(pick) for c in range(3)), flat.field("start"), flat.field("split"), pa.array(texts, pa.binary())], names=["key", "block", *DOC, "start", "split", "bytes"])

    asked = wanted.groupBy(DOC).agg(F.collect_list(F.struct("start", "windows", "key", "block", "split")).alias("asked"))
    once = docs.join(asked, DOC).groupBy(DOC).agg(F.first("text").alias("text"), F.first("asked").alias("asked"))
    return map_arrow(once, run, "key long, block long, id long, h long, g long, start int, split boolean, bytes binary")


def _repeats(segments: DataFrame, length: int, parts: int) -> DataFrame:
    """Kind 0: cuts (start, n) of windows that are repeated within a block. Kind 1: the
    first windows in blocks of split keys, with their hashes for blocks."""
    names = ["kind", *DOC, "start", "n", "key", "block", "bytes"]
    schema = "kind int, id long, h long, g long, start int, n int, key long, block long, bytes binary"
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[4] & 1, *r[2:6]))
        repeated, whole = repeated_windows([r[7] for r in rows], length)
        out: list[tuple] = []
        at = 0
        for key, _, i, h, g, start, split, text in rows:
            n = len(text) - length + 1
            mask = repeated[at : at + n]
            out += [(0, i, h, g, start + int(a), int(z - a) + length - 1, None, None, None) for a, z in zip(*_spans(mask), strict=True)]
            if split:
                out += [(1, i, h, g, start + w, None, key, int(whole[at + w].view(np.int64)), text[w : w + length]) for w in np.flatnonzero(~mask).tolist()]
            at += n
            if len(out) >= 1 << 13:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK and row[:2] != last:
                    yield from solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[7]), row[:2]
        if rows:
            yield from solve(rows)

    ordered = segments.repartition(parts, "key", "block").sortWithinPartitions("key", "block")
    return map_arrow(ordered, run, schema)


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, kept binary, removed array<struct<start, bytes>>) of every
    row: what is left of the UTF-8 bytes, and the maximal removed runs."""
    spark = docs.sparkSession
    parts = partitions(spark)
    numbered = _numbered(docs, id_col, text_col)
    shared = cut(_shared(_runs_of(numbered, length, gram, parts), length, gram, parts), "shared")
    release(spark)
    wanted = shared.where("kind = 0").select(*DOC, "start", "windows", "key", "block", "split")
    found = cut(_repeats(_segments(numbered, wanted, length), length, parts), "repeats")
    release(spark)
    # first windows of the blocks of one key, dealt out by the windows themselves
    again = found.where("kind = 1").select("key", "block", *DOC, "start", F.lit(False).alias("split"), "bytes")
    loose = found.where("kind = 0").select(*DOC, "start", "n").unionAll(_repeats(again, length, parts).select(*DOC, "start", "n"))
    loose = loose.groupBy(DOC).agg(F.collect_list(F.struct("start", F.col("n").alias("bytes"))).alias("cuts"))
    packed = shared.where("kind = 1").groupBy(DOC).agg(F.collect_list("data").alias("packed"))
    cuts = packed.join(loose, DOC, "full_outer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1):
                raw, offsets = text_buffer(part.column(1))
                kept, removed = [], []
                for k, (packed, loose) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    text = raw[offsets[k] : offsets[k + 1]]
                    cover = np.zeros(len(text) + 1, np.int32)
                    if packed:
                        c = np.frombuffer(b"".join(packed), _CUT)
                        np.add.at(cover, c["start"], 1)
                        np.add.at(cover, c["start"] + c["bytes"], -1)
                    for c in loose or ():
                        cover[c["start"]] += 1
                        cover[c["start"] + c["bytes"]] -= 1
                    gone = np.cumsum(cover)[:-1] > 0
                    kept.append(text[~gone].tobytes())
                    removed.append([{"start": int(a), "bytes": int(z - a)} for a, z in zip(*_spans(gone), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())])))], names=["id", "n_bytes", "kept", "removed"])

    rows = numbered.join(cuts, DOC, "left").select(F.when(F.col("g").bitwiseAND(1) == 1, F.col("id")).alias("id"), "text", "packed", "cuts")
    out = map_arrow(rows, run, "id long, n_bytes long, kept binary, removed array<struct<start: bigint, bytes: bigint>>")
    return out.select(F.col("id").alias(id_col), "n_bytes", "kept", "removed")
