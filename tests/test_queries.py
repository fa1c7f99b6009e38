"""Every query of the catalog against its oracle, on the smallest tables."""

import pytest
from oracle import assert_same

from tessera.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert_same(QUERIES[name], ORACLE[name], spark, DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["i", "y"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_compare_brings_no_rows_to_the_driver(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    from tessera.bench import compare

    mine = spark.range(5000).selectExpr("id % 2500 AS i", "id / 7.0D AS y", "nullif(id % 3, 0) AS z")
    table = pa.Table.from_pandas(mine.toPandas())
    taken, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: taken.append(rows := collect(df)) or rows)
    same = {}
    for name, other in {"equal": table, "less": table.slice(1), "more": pa.concat_tables([table, table.slice(0, 1)]), "empty": table.slice(0, 0)}.items():
        same[name] = compare(spark, lambda: mine, other.to_reader, name, keys=("i",), warm_up=0, runs=1).select("same").toPandas().same.tolist()
    changed = table.set_column(1, "y", pa.array([*table.column("y").to_pylist()[:-1], 1.5]))
    same["changed"] = compare(spark, lambda: mine, changed.to_reader, "changed", keys=("i",), warm_up=0, runs=1).select("same").toPandas().same.tolist()
    assert same == {"equal": [True], "less": [False], "more": [False], "empty": [False], "changed": [False]}
    assert max(map(len, taken), default=0) <= 1


def test_vendor_compare_reads_what_spark_can_read(spark):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tessera.link./in", f"file://{DATA}")
    out = QUERIES["vendor_compare"](spark, "viewfs://tessera/in").select("name", "n", "timed", "same")
    assert [tuple(r) for r in out.collect()] == [("csr", 3, True, True)]


def test_vendor_compare_reads_large_row_groups(spark, tmp_path):
    import duckdb

    keys = "hash(range + {}) & 4611686018427387903"
    tables = {
        "lineitem": f"SELECT CAST({keys.format(1)} AS BIGINT) AS l_orderkey, CAST({keys.format(2)} AS BIGINT) AS l_partkey, 1::BIGINT AS l_suppkey, CAST(hash(range) % 1000000 AS DOUBLE) / 100 AS l_quantity, 0.5::DOUBLE AS l_discount FROM range(8000000) UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount FROM '{DATA}/lineitem.parquet'",
        "orders": f"FROM '{DATA}/orders.parquet'",
        "part": f"FROM '{DATA}/part.parquet'",
        "supplier": f"FROM '{DATA}/supplier.parquet'",
    }
    for name, sql in tables.items():
        duckdb.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 10000000)")
    out = QUERIES["vendor_compare"](spark, str(tmp_path)).select("name", "n", "timed", "same")
    assert [tuple(r) for r in out.collect()] == [("csr", 3, True, True)]


def test_vendor_compare_goes_on_with_fewer_threads(spark, monkeypatch):
    import duckdb

    import tessera.bench

    compare, connect, made, threads = tessera.bench.compare, duckdb.connect, [], []

    def short_of_memory(*args, **named):
        threads.append(made[0].sql("SELECT current_setting('threads')").fetchall()[0][0])
        if threads[-1] > 1:
            raise duckdb.OutOfMemoryException("Out of Memory Error: could not allocate block")
        return compare(*args, **named)

    monkeypatch.setattr(duckdb, "connect", lambda **named: made.append(connect(**named)) or made[0])
    monkeypatch.setattr(tessera.bench, "compare", short_of_memory)
    out = QUERIES["vendor_compare"](spark, DATA).select("name", "n", "timed", "same")
    assert [tuple(r) for r in out.collect()] == [("csr", 3, True, True)]
    assert threads == [4, 2, 1]
