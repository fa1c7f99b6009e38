"""Tokens, shards, mixes, outliers, classifier: small texts against brute force and
the libraries, and the defined results of odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, _h long, h long, size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows(n=120, seed=0):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "Γamma", "a", "the", "of", "x1", "don't", "é", "😀", "#$%", "end.", "日本語"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 12, 40, 90])))
        if k % 7 == 0:
            text = text.replace(" ", "\n", 3) + "  \t tail "
        rows.append((k, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", "z", None]), len(text), "clash", k, -k, None))
    rows += [(None, None, None, None, None, None, None, None, None), (None, "null id", "en", "a", 7, "", 0, 0, 0), (n, None, "en", "b", 0, "", 0, 0, 0), (n + 1, "", "fr", "b", 0, "", 0, 0, 0), (n + 2, "word " * 30000, "en", "a", 1, "", 0, 0, 0)]
    return rows + [rows[3], rows[3], rows[5]]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(xs):
    return Counter(map(tuple, xs))


def test_sentence_pieces(docs, rows, empty):
    import sentencepiece

    from tessera.llm.sentence_pieces import decode, encode, encode_decode

    path = tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = bag((r[0], tuple(lib.encode(r[1] or "")), lib.decode(lib.encode(r[1] or ""))) for r in rows)
    # all words by broadcast, none, and some
    for out in (encode_decode(docs, path), encode_decode(docs, path, frequent_bytes=0), decode(encode(docs, path, frequent_bytes=400), path)):
        assert bag((r.doc_id, tuple(r.ids), r.decoded) for r in out.collect()) == want
    for limit in (0, 1 << 20):
        assert encode_decode(empty, path, frequent_bytes=limit).count() == 0


def test_distinct_chunks(docs, rows):
    """Every distinct word goes one way or the other, and a step's rare words come back
    in their places."""
    from tessera.llm import sentence_pieces as s

    pieces = s.Pieces(tokenizer("piece_bpe_32k.model"))
    words = {w for r in rows for w in s.Pieces.words(r[1] or "")}
    docs = docs.selectExpr("doc_id id", "text")
    path = tokenizer("piece_bpe_32k.model")
    for limit in (0, 400, 1 << 20):
        table = s._frequent(docs, path, limit)
        numbers, ends, flat = table
        assert sorted(numbers.values()) == list(range(1, len(ends)))
        frequent = {w: flat[ends[k - 1] : ends[k]].tobytes() for w, k in numbers.items()}
        assert sum(len(w.encode()) + len(x) for w, x in frequent.items()) <= limit
        held = docs.sparkSession.sparkContext.broadcast(table)
        rare = s._rare(docs, path, held).collect()
        ids = {w: x for w, x in zip(sorted(words), pieces.segment(sorted(words)), strict=True)}
        assert frequent == {w: ids[w] for w in frequent} and (limit == 400) == bool(frequent and rare)
        assert {bytes(r.data) for r in rare} == {ids[w] for w in words - frequent.keys()}
        assert len({(r.key, r.place) for r in rare}) == len(rare)


def test_changed_documents(spark):
    """Rows that differ from one reading to the next are an error, not wrong ids."""
    from pyspark.errors import PythonException
    from pyspark.sql import functions as F

    from tessera.llm.sentence_pieces import encode

    fresh = F.udf(lambda: __import__("secrets").token_hex(9)).asNondeterministic()
    docs = spark.range(50, numPartitions=1).select(F.col("id").alias("doc_id"), fresh().alias("text"))
    with pytest.raises(PythonException):
        encode(docs, tokenizer("piece_bpe_32k.model"), frequent_bytes=0).collect()


def test_random_chunks():
    from tessera.llm.sentence_pieces import Pieces
    from tessera.llm.token_files import ChunkEncoder

    pieces, bytes_ = Pieces(tokenizer("piece_bpe_32k.model")), ChunkEncoder(tokenizer("byte_bpe_50k.json"), 50)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "▁", "a", "the", "foo", "\t", "é", "😀", "\0", "\x85", "　", "<s>", "<|endoftext|>", ".", ",", "..", "12", "\r", "'s", "_", "\x1c", "\xa0"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert np.frombuffer(b"".join(pieces.segment(pieces.words(text))), pieces.kind).tolist() == pieces.library.encode(text)
        assert bytes_.encode([text], None)[1].tolist() == bytes_.library.encode(text, add_special_tokens=False).ids


def test_token_files(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    from tessera.llm.token_files import ids_crc32, read_tokens, write_tokens

    path, lib = tokenizer("byte_bpe_50k.json"), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    write_tokens(docs, f"file://{tmp_path}/t", path, 2)
    back = read_tokens(spark, f"file://{tmp_path}/t").collect()
    want = bag((r[0], *lib.encode(r[1] or "", add_special_tokens=False).ids, 2) for r in rows)
    assert bag((r.doc_id, *r.tokens) for r in back) == want
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.tokens)
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(back, key=lambda r: r.start)]
    assert ids == sorted(ids)
    crc = {r.start: r.ids_crc32 for r in ids_crc32(read_tokens(spark, f"file://{tmp_path}/t")).collect()}
    assert all(crc[r.start] == zlib.crc32(np.array(r.tokens, "<u4").tobytes()) for r in back)
    some = read_tokens(spark, f"file://{tmp_path}/t", [4, 9])
    assert sorted((r.doc_id, r.start) for r in some.collect()) == sorted((r.doc_id, r.start) for r in back if r.doc_id in (4, 9))
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    write_tokens(empty, f"file://{tmp_path}/e", path, 2)
    assert read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_shards(docs, rows, empty):
    from tessera.llm.hash_tree import Leaf, cluster, shard

    out = shard(docs, cluster(8), cluster(9)).collect()
    assert bag((r.doc_id, r["size"], r.text_crc32) for r in out) == bag((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 8) for r in out) and any(r.grown_shard == 8 for r in out)
    assert len({(r.doc_id, r.shard) for r in out}) == len({r.doc_id for r in out})
    # more weight in one rack moves documents into its subtree alone
    heavy = [Leaf(x.region, x.rack, x.shard, 3.0 if x.rack == "r0k1" else 1.0) for x in cluster(8)]
    assert all(r.grown_shard == r.shard or r.grown_shard in range(4) for r in shard(docs, cluster(8), heavy).collect())
    assert shard(empty, cluster(8), cluster(9)).count() == 0


def test_shard_weights(spark):
    from tessera.llm.hash_tree import Leaf, shard

    leaves = [Leaf("r0", "k0", 0, 1.0), Leaf("r0", "k1", 1, 2.0), Leaf("r1", "k2", 2, 3.0)]
    many = spark.range(6000).selectExpr("id as doc_id", "'' as text")
    n = Counter(r.shard for r in shard(many, leaves, leaves).collect())
    assert all(abs(n[k] - 1000 * (k + 1)) < 150 for k in range(3))


def water(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while True:
        over = {s for s in free if left * w[s] / sum(w[t] for t in free) > cap * sizes[s]}
        if not over:
            return target | {s: left * w[s] / sum(w[t] for t in free) for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over


def test_mixing(docs, rows, empty):
    from tessera.llm.mixing import mix, mixed_documents

    out = mix(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, mix(docs.repartition(7)).collect()))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    target = water(sizes, (3.0, 1.0, 2.0), 1.5, 2.0)
    got, total = {}, Counter()
    by_id = {(r[0], len(WORD.findall(r[1] or ""))): r[3] for r in rows}
    for r in out:
        s = by_id[r.doc_id, r["size"]]
        got[s], total[s] = r.target, total[s] + r.taken
        assert r.source_size == sizes[s] and r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    for s, t in target.items():
        assert got[s] == pytest.approx(t)
        # the long text of a does not fit a second time: all its others come twice
        assert total[s] == 30000 + 2 * (sizes[s] - 30000) if s == "a" else abs(total[s] - t) <= 25
    copies = sum(r.copies for r in out)
    assert mixed_documents(docs).count() == copies and mixed_documents(docs).columns == docs.columns
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_mixing_rows(spark):
    """Rows equal in id and text in several sources: each source's words are as mix()
    says, and as near its target as texts allow; one long text, many equal rows."""
    from tessera.llm.mixing import mix, mixed_documents

    rows = [(k, "w " * (1 + k * 7 % 30), s, k) for k in range(300) for s in ("b", "c")]
    rows += [(5, "long " * 5000, "b", 0)] + [(7, "same words here", "d", k) for k in range(900)] + [(k, f"x {k}", "d", 0) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long")
    for parts in (1, 6):
        taken = {r.source: r for r in mix(df.repartition(parts)).join(df.select("doc_id", "source").distinct().groupBy("doc_id").agg({"source": "min"}), "doc_id").groupBy("source_size", "target").sum("taken").withColumnRenamed("source_size", "source").collect()}
        got = Counter()
        for r in mixed_documents(df.repartition(parts)).collect():
            got[r.source] += len(WORD.findall(r.text))
        sizes = Counter()
        for r in rows:
            sizes[r[2]] += len(WORD.findall(r[1]))
        for s, n in sizes.items():
            assert got[s] == taken[n]["sum(taken)"] and abs(got[s] - taken[n].target) <= 10
    probabilities = mix(df, share=0.3).groupBy("source_size").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 10 for r in probabilities)


def statistics(text):
    words = WORD.findall(text or "")
    n = len(words)
    grams = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {k for i in range(n - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_outlier_rules(spark, docs, rows, empty):
    from tessera.llm.outlier_rules import quality_rules

    out = quality_rules(docs)
    want = bag((r[0], *statistics(r[1])) for r in rows)
    got = out.collect()
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules(empty).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_outliers_found(spark):
    """Planted outliers go, the others stay."""
    from tessera.llm.outlier_rules import quality_rules

    rng = random.Random(4)
    make = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = [(k, " ".join(make() for _ in range(rng.randrange(60, 400))), "en", "s") for k in range(300)]
    rows += [(1000 + k, " ".join(make() + "#$%|" for _ in range(200)), "en", "s") for k in range(20)]
    out = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(out[k] for k in range(300)) >= 298 and not any(out[1000 + k] for k in range(20))


def test_covariance_determinant(spark):
    """On contaminated data, the determinant is as small as the best of many random
    starts of an exact search, and the contamination is far off. One group of any
    size: the language's moments alone pool with it."""
    from tessera.llm.outlier_rules import FEATURES, _features, robust_verdicts

    rng = np.random.default_rng(1)
    x = rng.lognormal(5, 0.5, (400, 5)).astype(int)
    x[:, 2:] //= 20
    x[:60] = rng.lognormal(7, 0.1, (60, 5)).astype(int)  # a tight cluster elsewhere
    columns = "_id long, _lang string, _source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    df = _features(spark.createDataFrame([(int(k), "en", "s", *map(int, r)) for k, r in enumerate(x)], columns))
    got = robust_verdicts(df).orderBy("_id").toPandas()
    f, least = got[list(FEATURES)].to_numpy(), np.diag(np.array(list(FEATURES.values())) ** 2)
    h = int(np.ceil(0.75 * len(f)))

    def concentrate(subset):
        while True:
            mean, cov = f[subset].mean(0), np.cov(f[subset].T, bias=True) + least
            d = np.einsum("ij,jk,ik->i", f - mean, np.linalg.inv(cov), f - mean)
            new = np.sort(np.argsort(d, kind="stable")[:h])
            if np.array_equal(new, subset):
                return np.linalg.slogdet(cov)[1], d
            subset = new

    best, d = min((concentrate(np.sort(rng.choice(400, h, replace=False))) for _ in range(40)), key=lambda r: r[0])
    mine = np.argsort(got["_d2"].to_numpy(), kind="stable")[:h]
    assert np.linalg.slogdet(np.cov(f[mine].T, bias=True) + least)[1] <= best + 0.05
    assert np.median(got["_d2"][:60]) > 3 * np.quantile(got["_d2"][60:], 0.95)
    assert np.allclose(np.sort(d), np.sort(got["_d2"]), rtol=0.15)


def test_small_groups(spark):
    """Sources of 1, 2, 49, 50, 51, 99, 100 and 101 texts: verdicts don't jump with size."""
    from tessera.llm.outlier_rules import quality_rules

    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 200)))
    rows = []
    for n in (1, 2, 49, 50, 51, 99, 100, 101, 400):
        rows += [(1000 * n + k, text(), "en", f"s{n}") for k in range(n)] + [(-n, " ".join(f"w{k}#$%|<>&" for k in range(90)), "en", f"s{n}")]
    out = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(out[-n] for n in (1, 2, 49, 50, 51, 99, 100, 101, 400))
    assert sum(v for k, v in out.items() if k >= 0) >= 0.99 * sum(k >= 0 for k in out)


def test_classifier(spark, docs, rows, empty):
    from tessera.llm.quality_classifier import fit, score

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(20, 300)))
    # a bad document is bad in one part only
    bad = lambda: good() + " " + " ".join(word().upper() + "!!" for _ in range(80)) + " " + good()
    texts = [(k, bad() if k % 4 == 0 else good(), None if k % 50 == 3 else int(k % 4 != 0)) for k in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string, q int")
    model = fit(df, df.where("doc_id % 5 <> 0"), "q")
    held = score(df.where("doc_id % 5 = 0"), model).collect()
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)
    out = score(docs, model, carry=("lang",)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id: r.score for r in out}[120] == {r.doc_id: r.score for r in out}[121]  # null and empty texts
    assert score(empty, model).count() == 0
    one = fit(df, df.where("q = 1"), "q")
    assert one.constant == 1.0 and fit(df, df.where("q > 5"), "q").constant == 0.5


def test_repeated_ids(spark):
    """An id with many rows is one document of the sample, whatever their order."""
    from tessera.llm.quality_classifier import fit

    rows = [(k % 5, f"text {k} " * 20, k % 2) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, q int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, q int")
    a, b = (fit(x, labels, "q", max_docs=5) for x in (df, df.orderBy("text").repartition(4)))
    once = df.groupBy("doc_id").agg({"text": "min"}).count()
    assert once == 5 and all(np.array_equal(a.w[n], b.w[n]) for n in a.w)


def brute_score(model, text):
    """The bag's score, passage by passage, by the formulas of the docstring."""
    from tessera.llm.quality_classifier import N_FEATURES, encode_passages

    raw = np.frombuffer(text.encode(), np.uint8)
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
    cuts = [words[k][0] for k in range(64, len(words), 64)]
    parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
    h, e = [], []
    for p in parts:
        x = encode_passages(p, np.array([0, len(p)]))[1]
        assert x.shape == (1, N_FEATURES)
        v = np.tanh((x[0] - model.mean) * model.scale @ model.w["W"] + model.w["Wb"])
        h.append(v)
        e.append(sum(np.tanh(v @ model.w["V"]) / (1 + np.exp(-v @ model.w["U"])) * model.w["a"]))
    a = np.exp(e) / sum(np.exp(e))
    return 1 / (1 + np.exp(-(sum(w * v for w, v in zip(a, h)) @ model.w["c"] + model.w["b"][0])))


def test_bag_scores(spark):
    """Scores against a scorer that goes passage by passage."""
    from tessera.llm.quality_classifier import fit, score

    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["good", "bad", "BAD!", "é", "x1", "the"]) for _ in range(rng.randrange(1, 400))), k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, q int")
    model = fit(df, df.select("doc_id", "q"), "q")
    for r in score(df, model).collect():
        assert r.score == pytest.approx(brute_score(model, rows[r.doc_id][1]), abs=1e-4)


def test_gradients():
    from tessera.llm.quality_classifier import N_FEATURES, _forward, _gradients

    rng = np.random.default_rng(0)
    of, x, y = np.array([3, 1, 4]), rng.normal(size=(8, N_FEATURES)), np.array([1.0, 0.0, 1.0])
    w = {"W": rng.normal(size=(N_FEATURES, 4)) * 0.2, "Wb": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "a": rng.normal(size=3), "c": rng.normal(size=4), "b": np.array([0.1])}
    loss = lambda: -np.mean(np.log(np.where(y == 1, _forward(w, x, of)["p"], 1 - _forward(w, x, of)["p"])))
    g = _gradients(w, x, of, y)
    for name, k in (("W", (5, 2)), ("V", (1, 2)), ("U", (3, 0)), ("a", 1), ("c", 2), ("b", 0), ("Wb", 3)):
        old = w[name][k]
        w[name][k] = old + 1e-5
        up = loss()
        w[name][k] = old - 1e-5
        down = loss()
        w[name][k] = old
        assert g[name][k] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_held_out_accuracy(spark):
    from tessera.llm.queries import op1_attention_quality, table

    d = "/root/testdata/sf0.01"
    out = op1_attention_quality(spark, d).toPandas().merge(table(spark, d, "labels").toPandas(), on="doc_id")
    held = out[out.held_out & out.quality.notna()]
    assert (held.predicted == held.quality).mean() > 0.95


def test_decoded_digest(spark):
    from tessera.llm.queries import op2_sentence_pieces, table

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, d, "documents").collect()}
    for r in op2_sentence_pieces(spark, d).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
