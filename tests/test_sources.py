"""Matrix Market files: every branch of the header, and round trips."""

import pytest

from tessera.model import SparseMatrix
from tessera.sources import mtx
from tessera.sources.datasource import register


def head(*lines):
    return mtx.parse_header(list(lines))


def test_headers():
    h = head("%%MatrixMarket matrix coordinate integer general", "% c", "", "2 3 4")
    assert (h.field, h.symmetric, h.num_rows, h.num_cols, h.nnz, h.lines) == ("integer", False, 2, 3, 4, 4)
    assert head("%%MatrixMarket matrix coordinate pattern Symmetric", "1 1 1").symmetric
    assert head("%%MatrixMarket matrix coordinate odd", "1 1 1").field == "real"
    for bad in (
        ["%MatrixMarket matrix coordinate real general", "1 1 1"],
        ["%%MatrixMarket matrix array real general", "1 1"],
        ["%%MatrixMarket matrix coordinate complex general", "1 1 1"],
        ["%%MatrixMarket matrix coordinate real skew-symmetric", "1 1 1"],
        ["%%MatrixMarket matrix coordinate real general", "1 1"],
        ["%%MatrixMarket matrix coordinate real general", "% only"],
        [],
    ):
        with pytest.raises(mtx.MtxError):
            mtx.parse_header(bad)


ENTRIES = [(0, 0, 1.5), (0, 2, -2.0), (2, 1, 1e-9), (2, 1, 3.0)]


def test_round_trip(spark, tmp_path):
    m = SparseMatrix(spark.createDataFrame(ENTRIES, "i long, j long, v double"), 3, 4)
    mtx.write_mtx(m, f"file://{tmp_path}/folder")
    mtx.write_mtx(m, f"file://{tmp_path}/one.mtx", single_file=True)
    for path in (f"file://{tmp_path}/folder", f"file://{tmp_path}/one.mtx"):
        back = mtx.read_mtx(spark, path)
        assert (back.num_rows, back.num_cols) == (3, 4)
        assert sorted(map(tuple, back.entries.collect())) == sorted(ENTRIES)
    register(spark)
    got = spark.read.format("mtx").option("path", f"{tmp_path}/one.mtx").option("split_bytes", 8).load()
    assert sorted(map(tuple, got.collect())) == sorted(ENTRIES)


def test_short_file(spark, tmp_path):
    (tmp_path / "short.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 3\n1 1 1\n")
    with pytest.raises(mtx.MtxError):
        mtx.read_mtx(spark, f"file://{tmp_path}/short.mtx")


def test_symmetric_writer(spark, tmp_path):
    square = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (1, 1, 1.0)], "i long, j long, v double")
    mtx.write_mtx(SparseMatrix(square, 2, 2), f"file://{tmp_path}/s", symmetric=True)
    assert sorted(map(tuple, mtx.read_mtx(spark, f"file://{tmp_path}/s").entries.collect())) == [(0, 1, 2.0), (1, 0, 2.0), (1, 1, 1.0)]
    with pytest.raises(mtx.MtxError):
        mtx.write_mtx(SparseMatrix(square.where("i = 0"), 2, 2), f"file://{tmp_path}/n", symmetric=True)


def test_stream(spark, tmp_path):
    from tessera.streaming.accumulate import running_product

    spark.createDataFrame(ENTRIES, "i long, j long, v double").write.parquet(f"file://{tmp_path}/in")
    x = spark.range(4).selectExpr("id as j", "cast(id + 1 as double) as x")
    stream = running_product(spark.readStream.schema("i long, j long, v double").parquet(f"file://{tmp_path}/in"), x)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("products").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        assert {r.i: r.y for r in spark.table("products").collect()} == {0: -4.5, 2: 2 * (3.0 + 1e-9)}
    finally:
        q.stop()


def test_long_comment(spark, tmp_path):
    """Any number of comment lines before the size line, in both readers."""
    from tessera.sources import datasource
    from tessera.sources.mtx import read_mtx

    path = tmp_path / "a.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real general\n" + "% more\n" * 25_000 + "\n3 4 2\n1 2 1.5\n% in between\n3 4 -2\n")
    m = read_mtx(spark, f"file://{path}")
    want = [(0, 1, 1.5), (2, 3, -2.0)]
    assert (m.num_rows, m.num_cols) == (3, 4) and sorted(map(tuple, m.entries.collect())) == want
    datasource.register(spark)
    for p in (str(path), f"file://{path}"):
        for split, block in ((1 << 20, 1 << 20), (7, 1 << 20), (64, 3)):
            got = spark.read.format("mtx").option("path", p).option("split_bytes", max(split, 4000)).option("block_bytes", block).load().collect()
            assert sorted(map(tuple, got)) == want


def test_cli(spark, tmp_path, capsys):
    from tessera.__main__ import main

    main(["--type", "banded", "--rows", "50", "--cols", "50", "--bandwidth", "3", "--warmup", "0", "--runs", "1", "--route", "merge", "--save", f"file://{tmp_path}/m"])
    main(["--load", f"file://{tmp_path}/m", "--warmup", "0", "--runs", "2"])
    out = capsys.readouterr().out
    assert "merge" in out and "csr" in out and out.count("true") == 2


def test_large_draws(spark):
    """Rows and columns beyond 2^28 are drawn."""
    from pyspark.sql import functions as F

    from tessera.operators.generate import _below

    most = spark.range(2000).agg(F.max(_below(F.col("id"), 1, 1 << 40))).first()[0]
    assert (1 << 39) < most < (1 << 40)


def test_placed(spark):
    from tessera.model import SparseMatrix

    m = SparseMatrix(spark.range(10).selectExpr("id as i", "id as j", "1.0D as v"), 10, 10)
    with m.placed() as held:
        assert held.entries.storageLevel.useMemory
    assert not m.entries.storageLevel.useMemory
