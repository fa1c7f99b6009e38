"""python -m tessera: times one product of a generated or stored matrix.

    python -m tessera --type banded --rows 100000 --cols 100000 --bandwidth 30
    python -m tessera --load file:///data/a.mtx --route merge --json out
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.bench import measure
from tessera.functions.metrics import bandwidth_gbs, gflops
from tessera.operators import spmv as s
from tessera.operators.generate import GENERATORS, Config, generate
from tessera.operators.verify import check_finite
from tessera.sources.mtx import read_mtx, write_mtx

ROUTES = {
    "csr": lambda m, x: s.spmv(m.entries, x, m.rows()),
    "csr5": lambda m, x: s.spmv_tiled(m.entries, x, m.rows()),
    "merge": lambda m, x: s.spmv_merge(m.entries, x, m.rows()),
    "batched": lambda m, x: s.spmv_batched(m.entries, x, m.rows()),
    "ranges": lambda m, x: s.spmv_row_ranges(m.entries, x, m.rows(), m.num_rows),
}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--type", choices=sorted(GENERATORS), default="diagonal")
    for name, kind, default in (("rows", int, 1024), ("cols", int, 1024), ("sparsity", float, 0.01), ("bandwidth", int, 1), ("block", int, 4), ("clusters", int, 10), ("alpha", float, 2.5), ("avg-nnz", int, 8), ("seed", int, 12345), ("warmup", int, 3), ("runs", int, 10)):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--route", choices=sorted(ROUTES), default="csr")
    p.add_argument("--load", help="a Matrix Market file")
    p.add_argument("--save", help="where to write the matrix")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if a.load:
        m = read_mtx(spark, a.load)
    else:
        m = generate(spark, a.type, Config(a.rows, a.cols, a.sparsity, a.bandwidth, a.block, clusters=a.clusters, alpha=a.alpha, avg_nnz=a.avg_nnz, seed=a.seed))
    if a.save:
        write_mtx(m, a.save)
    x = m.cols().select("j", ((F.col("j") % 100 + 1) / 100.0).alias("x"))
    y = ROUTES[a.route](m, x)
    times = measure(spark, lambda: y, a.warmup, a.runs, a.route)
    nnz = F.lit(m.entries.count())
    ms = F.col("median_ms")
    times.select("*", gflops(nnz, ms).alias("gflops"), bandwidth_gbs(nnz, F.lit(m.num_rows), F.lit(m.num_cols), ms).alias("gbs")).show(truncate=False)
    check_finite(y).show()


if __name__ == "__main__":
    main()
