"""Products on small matrices: edge cases, and properties that must hold."""

import math

import pytest

from tessera.model import DenseVector, Op, SparseMatrix
from tessera.operators import convert, reorder
from tessera.operators import spmv as s
from tessera.operators.generate import GENERATORS, Config, generate

TINY = [(0, 0, 1.0), (0, 2, 2.0), (1, 1, -3.0), (3, 0, 4.0), (3, 0, 0.5)]  # 4 x 4; row 2 and column 3 empty


def entries(spark, rows=TINY):
    return spark.createDataFrame(rows, "i long, j long, v double")


def vector(spark, values):
    return DenseVector(spark.createDataFrame(list(enumerate(map(float, values))), "idx long, val double"), len(values))


def values(v):
    return [r.val for r in v.df.orderBy("idx").collect()]


def ys(df):
    return {r.i: r.y for r in df.collect()}


X = [1.0, 10.0, 100.0, 1000.0]
Y = {0: 201.0, 1: -30.0, 2: 0.0, 3: 4.5}


def x_of(spark):
    return spark.createDataFrame(list(enumerate(X)), "j long, x double")


@pytest.mark.parametrize(
    "route",
    [
        lambda a, x, r: s.spmv(a, x, r),
        lambda a, x, r: s.spmv(a, x, r, salt=3),
        lambda a, x, r: s.spmv_tiled(a, x, r, sigma=2),
        lambda a, x, r: s.spmv_merge(a, x, r, per_partition=2),
        lambda a, x, r: s.spmv_batched(a, x, r, batch_rows=2),
        lambda a, x, r: s.spmv_row_ranges(a, x, r, 4, n=3),
        lambda a, x, r: s.spmv(convert.ellpack_entries(convert.csr_to_ellpack(convert.coo_to_csr(a), r)), x, r),
        lambda a, x, r: s.spmv(convert.bsr_to_coo(convert.coo_to_bsr(a, 3), 3, 4, 4), x, r),
    ],
)
def test_routes_agree(spark, route):
    assert ys(route(entries(spark), x_of(spark), spark.range(4).withColumnRenamed("id", "i"))) == Y


def test_salted_copies_are_not_broadcast(spark):
    a, x = spark.range(9).selectExpr("id as i", "id % 4 as j", "id as v"), spark.range(4).selectExpr("id as j", "id as x")
    plan = s.products(a, x, salt=3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_one_long_row(spark):
    a = entries(spark, [(0, j, 1.0) for j in range(100)])
    x = spark.range(100).selectExpr("id as j", "1.0D as x")
    rows = spark.range(1).withColumnRenamed("id", "i")
    assert ys(s.spmv_merge(a, x, rows, per_partition=17)) == {0: 100.0}


def test_no_entries(spark):
    a = SparseMatrix(entries(spark, []), 3, 3)
    assert values(s.multiply(a, vector(spark, [1, 2, 3]))) == [0.0] * 3
    assert values(s.multiply(a, vector(spark, [1, 2, 3]), alpha=2, beta=3, y0=vector(spark, [1, 2, 3]))) == [3.0, 6.0, 9.0]


def test_axpby_and_transpose(spark):
    a = SparseMatrix(entries(spark), 4, 4)
    y = s.multiply(a, vector(spark, X), alpha=2.0, beta=-1.0, y0=vector(spark, [1, 1, 1, 1]))
    assert values(y) == [2 * Y[i] - 1 for i in range(4)]
    z = s.multiply(a, vector(spark, [1, 2, 3, 4]), op=Op.TRANSPOSE)
    assert values(z) == [19.0, -6.0, 2.0, 0.0]
    assert values(s.multiply(a.T, vector(spark, [1, 2, 3, 4]))) == values(s.multiply(a, vector(spark, [1, 2, 3, 4]), op=Op.CONJUGATE))


def test_linear(spark):
    a = SparseMatrix(entries(spark), 4, 4)
    p, q = [1, 2, 3, 4], [5, -6, 7, -8]
    both = values(s.multiply(a, vector(spark, [3 * u + v for u, v in zip(p, q)])))
    assert both == [3 * u + v for u, v in zip(values(s.multiply(a, vector(spark, p))), values(s.multiply(a, vector(spark, q))))]


def test_dimensions(spark):
    with pytest.raises(ValueError):
        s.multiply(SparseMatrix(entries(spark), 4, 4), vector(spark, [1, 2]))
    with pytest.raises(TypeError):
        SparseMatrix(entries(spark).selectExpr("i", "j", "cast(v as string) v"), 4, 4)


def test_round_trips(spark):
    a = entries(spark)
    rows = spark.range(4).withColumnRenamed("id", "i")
    want = sorted(TINY)
    assert sorted(map(tuple, convert.csr_to_coo(convert.coo_to_csr(a)).collect())) == want
    ell = convert.csr_to_ellpack(convert.coo_to_csr(a), rows)
    assert sorted(map(tuple, convert.ellpack_entries(ell).collect())) == want
    cut = convert.csr_to_ellpack(convert.coo_to_csr(a), rows, width=1)
    assert {r.i: r.dropped for r in cut.collect()} == {0: 1, 1: 0, 2: 0, 3: 1}
    assert [(r.i, r.row_start) for r in convert.row_ptr(a, rows).orderBy("i").collect()] == [(0, 0), (1, 2), (2, 3), (3, 3)]


def test_merge_path(spark):
    rows = spark.range(4).withColumnRenamed("id", "i")
    got = convert.merge_path(entries(spark), rows, convert.merge_partitions(spark, 4, 5, 3)).orderBy("part").collect()
    ends = [2, 3, 3, 5]
    for r in got:
        # of all splits of the path place, the one that takes row ends as soon as they come
        n = sum(1 for k, e in enumerate(ends) if e + k < r.path_start)
        assert (r.path_row, r.path_nnz) == (n, r.path_start - n)


def test_reorder_and_restore(spark):
    a, cols = entries(spark), spark.range(4).withColumnRenamed("id", "j")
    com = {r.old_id: r.new_id for r in reorder.columns_by_mean_row(a, cols).collect()}
    assert com == {2: 0, 3: 1, 1: 2, 0: 3}
    assert [r.old_id for r in reorder.columns_by_first_row(a, cols, 4).orderBy("new_id").collect()] == [0, 2, 1, 3]
    assert [r.old_id for r in reorder.columns_by_frequency(a, cols).orderBy("new_id").collect()] == [0, 1, 2, 3]
    p = reorder.rows_by_length(a, spark.range(4).withColumnRenamed("id", "i"))
    assert [r.old_id for r in p.orderBy("new_id").collect()] == [2, 1, 0, 3]
    assert sorted(map(tuple, reorder.restore(reorder.apply_to(a, p, "i"), p, "i").collect())) == sorted(TINY)


@pytest.mark.parametrize("kind", sorted(GENERATORS))
def test_generators(spark, kind):
    c = Config(num_rows=60, num_cols=50, sparsity=0.05, bandwidth=5, block=8, avg_nnz=6)
    m = generate(spark, kind, c)
    once, again = (sorted(map(tuple, generate(spark, kind, c).entries.repartition(n).collect())) for n in (1, 5))
    assert once == again and once
    assert all(0 <= i < 60 and 0 <= j < 50 and math.isfinite(v) for i, j, v in once)
    assert m.num_rows == 60


def test_unknown_generator(spark):
    with pytest.raises(ValueError):
        generate(spark, "normal")
