"""The pipeline and the queries as registered."""

import pytest
from oracle import assert_same
from test_texts import odd_rows


def test_stages(spark):
    """Columns, decisions that take effect, and what must not change."""
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(c.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stage(spark, docs, d).persist()
        after = docs.collect()
        assert {r.doc_id for r in after} <= before.keys() and after
        if k < 4:
            assert docs.columns == names
        if k in (0, 2):
            assert all(r.text == before[r.doc_id] for r in after)
        if k == 1:
            assert all(set(r.text.split("\n")) <= set(before[r.doc_id].split("\n")) and r.n_chars == len(r.text) for r in after)
        if k == 3:
            assert max(sum(r.doc_id == i for r in after) for i in before) <= 2
    assert {"doc_id", "n_tokens", "ids"} <= set(docs.columns)
    assert c.run(spark, d).count() == docs.count()


def test_stages_leave_no_texts(spark):
    """Of what a stage writes, only small tables stay, and of a run, only its last input."""
    import os

    import corpus_pipeline as c
    from tessera.llm._common import scratch

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    there = lambda made: [p for p in made if os.path.exists(p.removeprefix("file://"))]
    for stage in (c.line_dedup, c.jaccard_join):
        with scratch() as made:
            out = stage(spark, docs, d)
        assert made and there(made) and not any({"text", "doc"} & set(spark.read.parquet(p).columns) for p in there(made))
        assert out.count() > 0
    with scratch() as made:
        c.mixing(spark, docs, d)
    assert sum("doc" in spark.read.parquet(p).columns for p in there(made)) == 1
    with scratch() as made:
        assert c.run(spark, d).count() > 0
    assert [p.rsplit("/", 1)[1].split("-")[1] for p in there(made)] == ["stage4"]


@pytest.mark.parametrize("n", [0, 40])
def test_odd_input(spark, tmp_path, n):
    """Nulls, repeated rows, long texts; and no rows at all."""
    import corpus_pipeline as c

    rows = [r[:5] for r in odd_rows(n)] if n else []
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert c.run(spark, str(tmp_path)).count() >= 0


def test_jaccard_rows(spark):
    """Null and repeated ids: one row of each group and every clean one stays."""
    from pyspark.sql import functions as F
    from test_duplicates import near_copies, reach, shingles

    import corpus_pipeline as c

    texts = near_copies(3)
    rows = [((None, -7, k, k // 4)[k % 4], t, "en", "a", len(t)) for k, t in enumerate(texts)]
    rows += [(None, f"clean text {k} without an id and without any copy", "en", "a", 1) for k in "abcde"] + [(1, "another text of that id that nothing else is like", "en", "a", 1)]
    rows += rows[::5] + rows[:2] + [(None, texts[0], "fr", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    h = {r.text: r.h for r in docs.select("text", F.lpad(F.hex(F.xxhash64("text")), 16, "0").alias("h")).collect()}
    sets = [shingles(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    top = reach(range(len(rows)), links)
    groups = {t: [rows[k] for k in top if top[k] == t] for t in set(top.values())}
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0, h[r[1]], r[2:])) for g in groups.values()]
    got = [tuple(r) for r in c.jaccard_join(spark, docs, "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_oracles(spark):
    from tessera.llm.queries import ORACLE, QUERIES

    for name, sql in ORACLE.items():
        assert_same(QUERIES[name], sql, spark, "/root/testdata/sf0.001")
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
