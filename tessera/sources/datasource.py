"""spark.read.format("mtx"): entries of a Matrix Market file as a data source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class MtxSource(DataSource):
    """Option path, a path or URI of any file system that Arrow opens; schema i long,
    j long, v double. Splits are byte ranges; a line belongs to the range in which it
    begins. Entries come in Arrow batches of a block of lines."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return "i long, j long, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _open(path: str):
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return files.open_input_file(inner)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", 32 << 20))
        self.block = int(options.get("block_bytes", 1 << 20))

    def partitions(self):
        with _open(self.path) as f:
            size = f.size()
        return [InputPartition((a, min(a + self.split, size))) for a in range(0, size, self.split)]

    def read(self, partition) -> Iterator:
        import io

        from tessera.sources.mtx import parse_header

        with io.BufferedReader(_open(self.path)) as f:
            lines = []
            while True:
                lines.append(f.readline().decode())
                if len(lines) > 1 and lines[-1].strip() and not lines[-1].lstrip().startswith("%"):
                    break
                if not lines[-1]:
                    return
                del lines[1:-1]  # comments
            header, at = parse_header(lines), f.tell()
            first, last = partition.value
            if first > at:
                f.seek(first - 1)
                f.readline()
                at = f.tell()
            while at < last:
                f.seek(at)
                block = f.read(min(self.block, last - at))
                block += f.readline()  # to the end of the line that begins in the range
                at += len(block)
                yield _batch(block, header.pattern)


def _batch(block: bytes, pattern: bool):
    import numpy as np
    import pyarrow as pa

    rows = [t for t in map(bytes.split, block.split(b"\n")) if t and not t[0].startswith(b"%")]
    i, j = (np.array([int(t[k]) for t in rows], np.int64) - 1 for k in (0, 1))
    v = np.ones(len(rows)) if pattern else np.array([float(t[2]) for t in rows], np.float64)
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], names=["i", "j", "v"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MtxSource)
