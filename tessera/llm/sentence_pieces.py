"""SentencePiece encoding and decoding with a distinct-chunk table.

No piece of the supported models holds a whitespace marker after another
character, and none holds a line feed. Merges therefore never cross the start
of a marked word or a line feed, and a text's ids are the ids of its marked
words, one after the other. The property is verified on the model when it is
loaded; a model without it is refused.

The corpus has one table of its distinct marked words, in two parts. The words
that are most frequent in a sample of about ``SAMPLE_BYTES`` of text, up to
``frequent_bytes``, are segmented once each and broadcast. Every other word goes
through a shuffle: texts are taken in steps of half a megabyte, the words of a
step that the first part lacks are brought together by word, segmented once each,
and brought back to the step. The step goes there as the compressed numbers of its
words in the first part, with a hole for each word that this lacks; ids are then
joined by position, and no text is shuffled.
The sample decides which way a word goes, and never a result.

Defined results: a null or empty text has no ids and decodes to the empty text;
repeated rows and null ids are kept as they are; other columns of the input play
no part. ``docs`` is read several times and has to give the same rows in the same
order each time, as a stored table does; a step that does not is an error.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import cut, discard, map_arrow, partitions, release, steps, text_buffer

MARK = "▁"
#: Bytes of text, about, on which the frequent words are chosen.
SAMPLE_BYTES = 64 << 20
#: Most bytes of words and ids that are broadcast.
FREQUENT_BYTES = 48 << 20
#: The place of a step behind its words.
LAST = 2**31 - 1
CHANGED = "the documents changed between two readings"


class Pieces:
    """The library, and the marked words of a text; a word starts with a space (the
    marker) or a line feed."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError(f"pieces cross whitespace markers: {piece!r}")
        probe = "a\n b"
        if self.library.encode(probe) != [*self.library.encode("a"), *self.library.encode("\n")[1:], *self.library.encode("b")]:
            raise ValueError("the model's normalizer changes white space")
        self.mark = self.library.piece_to_id(MARK)
        self.kind = np.uint16 if self.library.get_piece_size() <= 1 << 16 else np.int32

    @staticmethod
    def words(text: str) -> list[str]:
        """The marked words; joined, they are the text after a leading marker."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text or "\0" in text:
            return re.findall(" +[^ \n]*|\n[^ \n]*", " " + text.replace(MARK, " "))
        return (" " + text).replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]

    def segment(self, words: list[str]) -> list[bytes]:
        """ids of words, given to the library once each. encode() puts a marker in
        front: it stands for a word's own space, and is taken off again before a
        line feed."""
        out = []
        for word, ids in zip(words, self.library.encode([w if w[0] == "\n" else w[1:] for w in words], num_threads=1), strict=True):
            out.append(np.array(ids[1:] if word[0] == "\n" else ids or [self.mark], self.kind).tobytes())
        return out


@lru_cache(2)
def _pieces(model_path: str) -> Pieces:
    return Pieces(model_path)


#: Numbers of words from 1 on, the ends of their ids (the first is 0), and the ids.
Table = tuple[dict[str, int], np.ndarray, np.ndarray]


def _frequent(docs: DataFrame, model_path: str, limit: int) -> Table:
    """The words that are most frequent in a sample of ``docs``, by powers of two of
    their counts, and their ids, ``limit`` bytes at most: a word of n bytes has n + 1
    ids of four bytes at most, which bounds what comes to the driver."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sampled = docs.select("text").sample(min(1.0, SAMPLE_BYTES / max(total, 1)), seed=7)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(Pieces.words(text or ""))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _pieces(model_path).segment(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=["word", "level", "ids"])

    counts = map_arrow(sampled, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts.select("word", F.floor(F.log2("n")).cast("int").alias("level")), "word-counts")
    least, left = None, limit
    for level, size in counts.groupBy("level").agg(F.sum(5 * F.octet_length("word") + 36).alias("size")).orderBy(F.desc("level")).collect():
        left -= size
        if left < 0:
            break
        least = level
    words: list[str] = []
    ids: list[bytes] = []
    if least is not None:
        chosen = counts.where(F.col("level") >= least).repartition(partitions(docs.sparkSession))
        got = map_arrow(chosen, segment, "word string, level int, ids binary").toArrow().sort_by([("level", "descending")])
        words, ids = got.column(0).to_pylist(), got.column(2).to_pylist()
    discard(counts)
    release(docs.sparkSession)
    return {w: k for k, w in enumerate(words, 1)}, *_joined(ids, _pieces(model_path).kind)


def _joined(ids: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(ids), kind)
    return np.cumsum([0, *map(len, ids)]) // flat.itemsize, flat


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The steps of a task's rows, by partition, place in it and 12 bits of a checksum
    of the texts, which tells a step from what another reading has in its place."""
    partition, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in steps(batch, 1):
            yield partition << 39 | n << 12 | zlib.crc32(text_buffer(part.column(1))[0]) & 4095, part
            n += 1


def _split(part: pa.RecordBatch, known: dict[str, int]) -> tuple[list[list[str]], dict[str, int]]:
    """The marked words of a step's texts, and the distinct ones that are not ``known``,
    numbered by their first places."""
    split = [Pieces.words(t or "") for t in part.column(1).to_pylist()]
    lacking = dict.fromkeys(w for words in split for w in words if w not in known)
    return split, {w: k for k, w in enumerate(lacking)}


def _holed(part: pa.RecordBatch, known: dict[str, int]) -> pa.RecordBatch:
    """A step's rows as numbers of their words, 0 for a hole, where a word is not
    ``known``; and the numbers of the holes' words, as differences (a word's first is 1).
    The four bytes of a number have a column each, which compresses better."""
    split, lacking = _split(part, known)
    numbers = np.array([known.get(w, 0) for words in split for w in words], "<u4")
    ends = pa.array(np.cumsum([0, *map(len, split)]), pa.int32())
    planes = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x))) for x in numbers.view(np.uint8).reshape(-1, 4).T]
    holes = np.diff(np.array([lacking[w] for words in split for w in words if w in lacking], np.int32), prepend=np.int32(-1))
    ends = np.concatenate([[0], np.cumsum(numbers == 0)])[ends.to_numpy()]
    return pa.RecordBatch.from_arrays([part.column(0), *planes, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(holes))], names=["id", "a", "b", "c", "d", "holes"])


def _filled(part: pa.RecordBatch, rare: list[bytes], frequent: Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of the rows) of what _holed() gives, ``rare`` being the ids of the
    words in the holes."""
    _, ends, flat = frequent
    planes = [c.values.to_numpy() for c in part.columns[1:5]]
    number = np.stack(planes, axis=1).reshape(-1).view("<u4").astype(np.int64) - 1
    holes = np.cumsum(part.column(5).values.to_numpy(), dtype=np.int64) - 1
    if (holes.max() + 1 if len(holes) else 0) != len(rare):
        raise ValueError(CHANGED)
    number[number < 0] = holes + len(ends) - 1
    more, ids = _joined(rare, flat.dtype.type)
    ends, flat = np.concatenate([ends, more[1:] + len(flat)]), np.concatenate([flat, ids])
    first, sizes = ends[number], ends[number + 1] - ends[number]
    places = np.concatenate([[0], np.cumsum(sizes)])
    taken = flat[np.repeat(first - places[:-1], sizes) + np.arange(places[-1])]
    return taken, places[part.column(1).offsets.to_numpy()]


def _rare(docs: DataFrame, model_path: str, frequent) -> DataFrame:
    """(key, place, data): ids of the words of each step that the broadcast part
    lacks, by their place among them; every word is segmented once."""

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in _numbered(batches):
            words = list(_split(part, frequent.value[0])[1])
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), key)), pa.array(np.arange(len(words), dtype=np.int32)), pa.array(words, pa.string())], names=["key", "place", "word"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by word; a word that runs over the end of a batch is carried on."""
        last_word, last_ids = None, b""
        for batch in batches:
            if batch.num_rows:
                coded = batch.column(2).dictionary_encode()
                words = coded.dictionary.to_pylist()
                carried = words[0] == last_word
                ids = [last_ids] * carried + _pieces(model_path).segment(words[carried:])
                last_word, last_ids = words[-1], ids[-1]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.binary()).take(coded.indices)], names=["key", "place", "data"])

    pairs = map_arrow(docs, missing, "key long, place int, word string")
    return map_arrow(pairs.repartition("word").sortWithinPartitions("word"), segment, "key long, place int, data binary")


def _encoded(docs: DataFrame, model_path: str, id_col: str, text_col: str, frequent_bytes: int, decoded: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, model_path, frequent_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in _numbered(batches):
            part = _holed(part, frequent.value[0])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([LAST], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["key", "place", "data"])

    def join(part: pa.RecordBatch, rare: list[bytes]) -> pa.RecordBatch:
        flat, ends = _filled(part, rare, frequent.value)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
        texts = [pa.array(_pieces(model_path).library.decode([flat[a:b].tolist() for a, b in zip(ends, ends[1:])], num_threads=1), pa.string())] if decoded else []
        return pa.RecordBatch.from_arrays([part.column(0), lists, *texts], names=["id", "ids", "decoded"][: 2 + decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and place: a step's rare words, then the step."""
        rare: list[bytes] = []
        now = None

        def take(keys: np.ndarray, data: pa.Array) -> None:
            nonlocal now
            now = keys[0] if now is None else now
            if (keys != now).any():
                raise ValueError(CHANGED)
            rare.extend(data.to_pylist())

        for batch in batches:
            keys, _, data = batch.columns
            keys, first = keys.to_numpy(), 0
            for at in np.flatnonzero(batch.column(1).to_numpy() == LAST).tolist():
                take(keys[first : at + 1], data.slice(first, at - first))
                yield from (join(part, rare) for part in pa.ipc.open_stream(data[at].as_buffer()))
                now, first = None, at + 1
                rare.clear()
            if first < len(keys):
                take(keys[first:], data.slice(first))
        if rare:
            raise ValueError(CHANGED)

    packed = map_arrow(docs, pack, "key long, place int, data binary")
    rows = packed.unionAll(_rare(docs, model_path, frequent)).repartition("key").sortWithinPartitions("key", "place")
    return map_arrow(rows, run, f"id {kind}, ids array<int>" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", frequent_bytes: int = FREQUENT_BYTES) -> DataFrame:
    """(id_col, ids array<int>) of every row of ``docs``."""
    return _encoded(docs, model_path, id_col, text_col, frequent_bytes, decoded=False)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the library's decode(ids) in ``out_col``. Null ids decode to ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _pieces(model_path).library
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [library.decode(x) if x else "" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    out = map_arrow(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), F.col("decoded").alias(out_col))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", frequent_bytes: int = FREQUENT_BYTES) -> DataFrame:
    """(id_col, ids, decoded): encode, then the library's decode of the ids, in one
    pass."""
    return _encoded(docs, model_path, id_col, text_col, frequent_bytes, decoded=True)
