"""Queries: generators. The oracle of each draws from the same digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.generate import Config, generate
from tessera.plans.fixtures import query

C = Config(num_rows=1024, num_cols=1000, sparsity=0.01, bandwidth=20, block=16, clusters=10, alpha=2.5, avg_nnz=8, seed=42)
NNZ = C.nnz


def draw(n: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({n} AS VARCHAR) || ':{seed}'), 1, 13) AS BIGINT)"


def below(n: str, seed: int, limit: int | str) -> str:
    return f"({draw(n, seed)} % {limit})"


def unit(n: str, seed: int) -> str:
    return f"({draw(n, seed)} / 4503599627370496.0::DOUBLE)"


def value(n: str, seed: int) -> str:
    return f"(({below(n, seed, 100)} + 1) / 100.0::DOUBLE)"


ROWS = f"SELECT unnest(range(0, {C.num_rows})) AS i"


def _gen(kind: str, sql: str, config: Config = C):
    @query(f"gen_{kind}", sql, tables=False)
    def _(spark, d):
        return generate(spark, kind, config).entries


_gen("diagonal", "SELECT unnest(range(0, 1000)) AS i, unnest(range(0, 1000)) AS j, 1.0::DOUBLE AS v")
_gen("banded", f"SELECT i, j, 1.0::DOUBLE / (ABS(i - j) + 1) AS v FROM (SELECT i, unnest(range(GREATEST(0, i - 20), LEAST(999, i + 20) + 1)) AS j FROM ({ROWS}))")
_gen("banded_half", f"SELECT i, unnest(range(GREATEST(0, i - 10), LEAST(999, i + 10) + 1)) AS j, 1.0::DOUBLE AS v FROM ({ROWS}) WHERE i < 1010")
_gen("block_diag", f"SELECT i, j, {value('i * 1000 + j', 42)} AS v FROM (SELECT i, unnest(range(i // 16 * 16, i // 16 * 16 + 16)) AS j FROM ({ROWS}) WHERE i < 992)")
_gen("block_diag_ones", f"SELECT i, unnest(range(i // 16 * 16, LEAST(i // 16 * 16 + 16, 1000))) AS j, 1.0::DOUBLE AS v FROM ({ROWS}) WHERE i < 1000")
_gen("uniform", f"SELECT n // 8 AS i, {below('n', 42, 1000)} AS j, 1.0::DOUBLE AS v FROM (SELECT unnest(range(0, 8192)) AS n)")
_gen("random", f"SELECT {below('n', 42, 1024)} AS i, {below('n', 43, 1000)} AS j, {value('n', 44)} AS v FROM (SELECT unnest(range(0, {NNZ})) AS n)")
_near = lambda cell, size, seed: f"LEAST(GREATEST({below('k', seed, size)} + {below('n', seed + 1, cell)} - {cell // 2}, 0), {size - 1})"
_gen("concentrated", f"SELECT CAST(CASE WHEN inside THEN {_near(102, 1024, 44)} ELSE {below('n', 46, 1024)} END AS BIGINT) AS i, CAST(CASE WHEN inside THEN {_near(100, 1000, 48)} ELSE {below('n', 50, 1000)} END AS BIGINT) AS j, {value('n', 51)} AS v FROM (SELECT n, {unit('n', 42)} < 0.8 AS inside, {below('n', 43, 10)} AS k FROM (SELECT unnest(range(0, {NNZ})) AS n))")
_gen("powerlaw", f"SELECT CAST(LEAST(1023, floor(pow({unit('n', 42)}, 0.4::DOUBLE) * 1024)) AS BIGINT) AS i, {below('n', 43, 1000)} AS j, {value('n', 44)} AS v FROM (SELECT unnest(range(0, {NNZ})) AS n)")


def _varied(kind: str, spread: int):
    n = f"LEAST(GREATEST({8 - spread} + {below('i', 42, 2 * spread + 1)}, 1), 1000)"
    _gen(kind, f"SELECT DISTINCT i, (a + k * b) % 1000 AS j, 1.0::DOUBLE AS v FROM (SELECT i, a, b, unnest(range(0, n)) AS k FROM (SELECT i, {n} AS n, {below('i', 43, 1000)} AS a, {below('i', 44, 1000 // (8 + spread))} + 1 AS b FROM ({ROWS})))")


_varied("avg_nnz", 2)
_varied("row_varied", 1)


@query("gen_factory", "SELECT unnest(['avg_nnz', 'banded', 'banded_half', 'block_diag', 'block_diag_ones', 'concentrated', 'diagonal', 'powerlaw', 'random', 'row_varied', 'uniform']) AS kind, 64::BIGINT AS num_rows, 64::BIGINT AS num_cols, TRUE AS inside", tables=False)
def _(spark, d):
    """Every kind by name; all entries lie inside."""
    from tessera.operators.generate import GENERATORS

    small = Config(num_rows=64, num_cols=64, sparsity=0.1, bandwidth=4)
    out = None
    for kind in sorted(GENERATORS):
        m = generate(spark, kind, small)
        inside = F.bool_and((F.col("i") >= 0) & (F.col("i") < m.num_rows) & (F.col("j") >= 0) & (F.col("j") < m.num_cols))
        one = m.entries.agg(F.lit(kind).alias("kind"), F.lit(m.num_rows).cast("long").alias("num_rows"), F.lit(m.num_cols).cast("long").alias("num_cols"), inside.alias("inside"))
        out = one if out is None else out.unionByName(one)
    return out
