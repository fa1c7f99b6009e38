"""Token ids in ORC files.

Every document becomes one row of an ORC file: its id, its token ids with the
end id, their number, and where they start among the ids of its part. ORC
stores the integers with its run-length encoding, keeps minima and maxima for
each stripe and each ``row_index_stride`` rows, and Bloom filters on the
document ids; a reader takes stripes in parallel, and a look-up of ids skips
every row group whose index or Bloom filter has none of them.

Rows go to parts by ranges of (document id, text hash) and are sorted within a
part, so the files, in the order of their names, hold the documents in
ascending id order, null ids first. A hot id is split by the hash. Texts are
encoded by the tokenizers library; a worker gives it each distinct chunk once
(a chunk starts at a blank or line feed before a visible character, where the
byte-level splitting rule always ends a token).

Defined results: null and empty texts have the end id alone; repeated rows are
kept; equal ids stand in the order of their texts' hashes; other columns of the
input are not written.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import Lookup, broadcast_if_small, cut, map_arrow, partitions, steps

TABLE_ROWS = 500_000
#: Where a chunk can always start: at a blank or line feed before anything visible.
_CUT = re.compile(r"(?=[ \n][^\s\x85\x1c-\x1f])")
#: Texts that can't be cut before every blank, line feed, stop and comma: some blank
#: stands before more white space, or some stop follows no letter or digit and may
#: belong to a run of symbols.
_ODD = r"[ \n][\s\x0b\x1c-\x1f\x{85}\pZ]|\x00|(?:^|[^\pL\pN])[.,]"
#: How byte-level vocabularies write the bytes that don't print.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class ChunkEncoder:
    """ids of texts by the tokenizers library, each distinct chunk once."""

    def __init__(self, tokenizer_path: str, table_rows: int = TABLE_ROWS):
        import json

        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path)
        self.model, self.split = self.library.model, regex.compile(PATTERN).findall
        with open(tokenizer_path) as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.table = Lookup(self.segment, table_rows)
        for probe in ("a b\nc", "it's 12  x\n\n y\t z.", " a", "\na", "a,b. c_. ...é😀 don't.,x\u00a0y", *self.added, f"a{self.added[0] if self.added else ''} b"):
            if np.frombuffer(b"".join(map(self.segment, self.chunks(probe))), np.int32).tolist() != self.library.encode(probe, add_special_tokens=False).ids:
                raise ValueError("this tokenizer does not split as byte-level ones do")

    def chunks(self, text: str) -> list[str]:
        """The text in pieces between which a token always ends; a text with an
        added token is one piece."""
        if any(t in text for t in self.added):
            return [text]
        return [x for x in _CUT.split(text) if x]

    def segment(self, chunk: str) -> bytes:
        """A chunk's ids: its words go to the library's model; a chunk that holds
        an added token goes to the whole tokenizer."""
        if chunk[0] == " " and chunk.isascii() and chunk[1:].isalpha():
            ids = [t.id for t in self.model.tokenize(_LETTER[32] + chunk[1:])]
        elif any(t in chunk for t in self.added):
            ids = self.library.encode(chunk, add_special_tokens=False).ids
        else:
            ids = [t.id for word in self.split(chunk) for t in self.model.tokenize(word.encode().decode("latin-1").translate(_LETTER))]
        return array("i", ids).tobytes()

    def encode(self, texts: pa.Array | list[str | None], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts into the ids, and all ids. Texts that may be cut
        before every blank, line feed, stop and comma are split together, and their
        chunks numbered by Arrow, so that each is looked up once a call."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _ODD)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        cut = pc.if_else(odd, "", texts)
        for mark in " \n.,":
            cut = pc.replace_substring(cut, mark, f"\0{mark}")
        lists = pc.split_pattern(cut, "\0")
        coded = lists.flatten().dictionary_encode()
        words = [b"" if w == "" else self.table[w] for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, words), np.int64, len(words)) // 4
        first = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(words), np.int32)
        index = np.asarray(coded.indices)
        n = size[index]
        done = np.cumsum(n)
        ids = pool[np.arange(done[-1] if len(done) else 0) + np.repeat(first[index] - (done - n), n)]
        upto = np.concatenate([[0], done])[np.asarray(lists.offsets)]
        lengths = np.diff(upto)
        slow = np.flatnonzero(np.asarray(odd))
        if len(slow):
            # the others are in place already: make room for these
            own = [np.frombuffer(b"".join(map(self.table.__getitem__, self.chunks(t))), np.int32) for t in texts.take(pa.array(slow)).to_pylist()]
            lengths[slow] = [len(x) for x in own]
            room = np.zeros(len(texts), bool)
            room[slow] = True
            room = np.repeat(room, lengths)
            out = np.empty(len(room), np.int32)
            out[~room], out[room] = ids, np.concatenate(own)
            ids = out
        if end_id is not None:
            lengths = lengths + 1
            out = np.full(lengths.sum(), end_id, np.int32)
            keep = np.ones(len(out), bool)
            keep[np.cumsum(lengths) - 1] = False
            out[keep] = ids
            ids = out
        return np.concatenate([[0], np.cumsum(lengths)]), ids


@lru_cache(2)
def _encoder(tokenizer_path: str, table_rows: int) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return ChunkEncoder(tokenizer_path, table_rows)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20, row_index_stride: int = 1000, bloom_fpp: float = 0.01, table_rows: int = TABLE_ROWS) -> None:
    """Write the token ids of ``docs`` as ORC files in the folder ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, start, part_no = _encoder(tokenizer_path, table_rows), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in steps(batch, 1, 4 << 20):
                ends, ids = encoder.encode(part.column(1), end_id)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(ends), pa.int64()), pa.array(np.full(part.num_rows, part_no), pa.int32()), pa.array(start + ends[:-1], pa.int64())], names=["doc_id", "tokens", "n_tokens", "part", "part_start"])
                start += int(ends[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = slim.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = map_arrow(ordered, run, f"doc_id {kind}, tokens array<int>, n_tokens long, part int, part_start long")
    rows.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", bloom_fpp).option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", row_index_stride).option("compression", "zstd").orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of the files in ``path``; start counts the
    ids of all documents before. With ``doc_ids``, only these rows: the filter
    reaches the ORC reader, which prunes by file and stripe statistics, row index
    and Bloom filter."""
    rows = spark.read.schema("doc_id long, tokens array<int>, n_tokens long, part int, part_start long").orc(path)
    # one row for each part: parts are as many as shuffle partitions
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("before")), "token-parts")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    return rows.join(broadcast_if_small(parts), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "tokens")


def ids_crc32(rows: DataFrame) -> DataFrame:
    """``rows`` of read_tokens with the crc32 of the ids, as little-endian unsigned
    32-bit integers, in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = np.asarray(lists.offsets).astype(np.int64) * 4
            raw = memoryview(np.ascontiguousarray(np.asarray(lists.values), dtype="<u4")).cast("B")
            crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(rows.select("doc_id", "start", "n_tokens", "tokens"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
