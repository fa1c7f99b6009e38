"""Line templates, suffix arrays, Jaccard join, embeddings, components: small inputs
against brute force, and the defined results of odd rows."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from test_texts import SCHEMA, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def reach(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("parts", [1, 7])
def test_components(spark, parts):
    """One partition's forest, and star contractions over several."""
    from tessera.llm._common import components

    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2060)]
    want = reach({x for e in links for x in e if e[0] != e[1]}, [e for e in links if e[0] != e[1]])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    got = components(spark.createDataFrame(links, "a long, b long").repartition(parts), "a", "b")
    assert {r.node: r.component for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_copies(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = word().upper()
            texts.append(" ".join(copy) + (" " + passage if rng.random() < 0.4 else ""))
    return texts + [passage, passage.upper(), passage + " x", "", "one two", "One  two", "one two three"]


def check_jaccard(spark, rows, **options):
    from tessera.llm.jaccard_join import jaccard_components

    sets = {k: shingles(t) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = reach(sets, links)
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert {r.doc_id: r.component_id for r in out} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in out)
    assert len(links) > 30


def test_jaccard(spark):
    check_jaccard(spark, list(enumerate(near_copies())))


def test_jaccard_odd(spark, empty):
    from tessera.llm.jaccard_join import jaccard_components

    rows = odd_rows(40, 5)
    out = jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_shingles) for r in out) == sorted((str(r[0]), len(shingles(r[1]))) for r in rows)
    assert jaccard_components(empty).count() == 0


def test_jaccard_bounds():
    from tessera.llm.jaccard_join import differing, enough, list_pairs, parities, prefix_length

    rng = np.random.default_rng(2)
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        keep = rng.random(len(x)) < 0.9
        y = np.unique(np.concatenate([x[keep], rng.integers(0, 2**63, rng.integers(1, 40), dtype=np.uint64)]))
        assert differing(parities(x), parities(y)) <= len(np.setxor1d(x, y))
    for n in range(1, 60):
        assert prefix_length(n, 3, 4) >= 1
        for m in range(1, 60):
            o = enough(n, m, 3, 4)
            assert (o >= min(n, m) + 1) or 4 * o >= 3 * (n + m - o)
            assert 4 * (o - 1) < 3 * (n + m - o + 1)
    n = np.sort(rng.integers(5, 60, 300))
    pos, group = (rng.random(300) * n / 3).astype(int), rng.integers(0, 40, 300)
    got = {(a, b) for i, j in list_pairs(n, pos, group, 3, 4) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if group[a] != group[b] and min(n[a] - pos[a], n[b] - pos[b]) >= enough(n[a], n[b], 3, 4)}
    assert got == want


def test_suffix_array():
    from tessera.llm.suffix_array import suffix_array

    rng = random.Random(5)
    for _ in range(600):
        n, a = rng.randrange(50), rng.choice([1, 2, 3, 26])
        t = [rng.randrange(a) for _ in range(n)]
        if n and rng.random() < 0.3:
            t = (t[: max(1, n // 4)] * 8)[:n]
        assert suffix_array(np.array(t, np.int64)).tolist() == sorted(range(n), key=lambda i: t[i:])


def brute_cut(rows, length):
    """Kept bytes of (id, text) rows, in the order of ids."""
    seen, out = set(), []
    for k, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out.append((k, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def repeats(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randrange(5, 30))) for _ in range(6)]
    texts = []
    for k in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 6))]
        texts.append((" " if k % 5 else "").join(parts))
    return texts + ["ab " * 80, "x" * 300, "abcabc" * 40, "", None, texts[0], texts[3], texts[3][:150]]


@pytest.mark.parametrize("block", [1 << 18, 200])
def test_suffix_dedup(spark, monkeypatch, block):
    from tessera.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    for length, gram, seed in ((40, 12, 0), (25, 8, 1)):
        rows = list(enumerate(repeats(seed)))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        out = suffix_dedup.remove_repeats(df, length=length, gram=gram).collect()
        assert sorted((r.doc_id, bytes(r.kept)) for r in out) == brute_cut(rows, length)
        for r in out:
            assert r.n_bytes == len(r.kept) + sum(x["bytes"] for x in r.removed)
            ends = [(x["start"], x["start"] + x["bytes"]) for x in r.removed]
            assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_suffix_dedup_odd(spark, empty):
    from tessera.llm.suffix_dedup import remove_repeats

    rows = odd_rows(30, 2)
    out = remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in out) == sorted((str(r[0]), len((r[1] or "").encode())) for r in rows)
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("block", [1 << 18, 200])
def test_suffix_dedup_rows(spark, monkeypatch, block):
    """Repeated rows are one document, with and without an id; null ids come first,
    texts of one id in the order of their hashes."""
    from pyspark.sql import functions as F

    from tessera.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    texts = repeats(2)
    rows = [(None if k % 3 == 0 else k // 2, t) for k, t in enumerate(texts)]
    rows += rows[:20] + rows[5:12] + [(None, "once " * 3 + "only in rows that are repeated as a whole, with a null id")] * 3 + [(500, " ".join(map(str, range(90))))] * 4
    rows += [(-(2**63), texts[1]), (-(2**63), "least id " * 20), (0, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # the hash that tells the texts of an id apart
    order = {(r.doc_id, r.t): r.h for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "t", F.xxhash64("t").alias("h")).collect()}
    ranked = sorted(order, key=lambda r: (r[0] is not None, r[0] or 0, order[r]))
    want = {ranked[k]: b for k, b in brute_cut([(k, t) for k, (_, t) in enumerate(ranked)], 40)}
    out = suffix_dedup.remove_repeats(df, length=40, gram=12).collect()
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in out) == sorted((str(i), want[i, t or ""]) for i, t in rows)


def test_windows():
    """Repeated windows of a block, against a look-up of all windows."""
    from tessera.llm.suffix_dedup import repeated_windows

    rng = random.Random(9)
    for _ in range(60):
        source = "".join(rng.choice("ab \n") for _ in range(60)).encode()
        texts = [source[a : a + rng.randrange(12, 30)] for a in (rng.randrange(30) for _ in range(8))]
        texts = [t for t in texts if len(t) >= 12]
        seen, want = set(), []
        for t in texts:
            for i in range(len(t) - 11):
                want.append(t[i : i + 12] in seen)
                seen.add(t[i : i + 12])
        assert repeated_windows(texts, 12)[0].tolist() == want


def test_line_templates(spark, empty):
    from tessera.llm.line_templates import drop_recurring

    rng = random.Random(1)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(9))
    rows = []
    for k in range(60):
        lines = [prose(), f"Posted by user {k * 7} on day {k} of the forum", prose()]
        if k % 3 == 0:
            lines.insert(0, "Subscribe to our weekly news letter today")
        if k == 5:
            lines += [f"row {i} has the value {i * i} in it" for i in range(30)]  # one document alone
        rows.append((k, "\n".join(lines), "en", "a", 0, "", 0, 0, 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = {r.doc_id: r for r in drop_recurring(docs, min_docs=10).collect()}
    for k, r in enumerate(rows):
        lines = r[1].split("\n")
        kept = [x for x in lines if not ((x.startswith("Posted") or x.startswith("Subscribe")) and k > 0)]
        assert out[k].text.split("\n") == kept
        assert (out[k].n_lines, out[k].n_dropped) == (len(lines), len(lines) - len(kept))
    odd = odd_rows(40, 8)
    back = drop_recurring(spark.createDataFrame(odd, SCHEMA), min_docs=10)
    assert back.count() == len(odd) and [c for c in back.columns if c not in ("n_lines", "n_dropped")] == [c.split()[0] for c in SCHEMA.split(", ")]
    assert back.where("text is null").count() == sum(r[1] is None for r in odd)
    assert drop_recurring(empty).count() == 0


def test_line_copies(spark):
    """Recall on planted long lines by copy count, with one token, too; short lines
    of few documents stay."""
    from tessera.llm.line_templates import drop_recurring

    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    texts = [[words(30)] for _ in range(40)]
    planted = {}
    for copies in range(2, 13):
        for line in (words(20), words(60), words(30).replace(" ", "")):
            where = planted[line] = sorted(rng.sample(range(40), copies))
            for k in where:
                texts[k].insert(rng.randrange(len(texts[k]) + 1), line)
    short = words(5)
    texts[3].append(short), texts[9].append(short)
    rows = [(k, "\n".join(t)) for k, t in enumerate(texts)]
    rows += [rows[5]]  # one document twice
    out = drop_recurring(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_docs=10).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.text.split("\n") == [x for x in texts[r.doc_id] if x not in planted or planted[x][0] == r.doc_id]


def test_line_drift(spark):
    """Short lines that share their first tokens or their numbers alone are no template."""
    from tessera.llm.line_templates import drop_recurring

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    said = ["He was a big cat", "He was a big dog", "He was a good boy"] + [f"He was a {word()} {word()}" for _ in range(20)]
    rows = ["1 2 3 apples sold", "4 5 6 pears sold"] + [f"{k} {k + 1} {k + 2} {word()} {word()}" for k in range(20)]
    texts = list(enumerate(said + rows))
    out = drop_recurring(spark.createDataFrame(texts, "doc_id long, text string"), min_docs=10).collect()
    assert sorted((r.doc_id, r.text) for r in out) == texts


def brute_lines(rows, min_docs, similarity, exact_bytes):
    """Line numbers that go, for (order, text) rows in the order of precedence."""
    masked, leaves = {}, defaultdict(lambda: defaultdict(int))
    for d, text in rows:
        for no, line in enumerate(text.split("\n")):
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in WORD.findall(line)]
            if any(c.isalpha() for t in tokens if t != "<*>" for c in t):
                masked[d, no] = tokens
                for p, t in enumerate(tokens):
                    leaves[len(tokens), *tokens[:3]][p, t] += 1
    groups, exact = defaultdict(set), defaultdict(set)
    for (d, no), tokens in masked.items():
        leaf = (len(tokens), *tokens[:3])
        words = sorted(((-leaves[leaf][p, t], p, t) for p, t in enumerate(tokens) if t != "<*>"))
        keep = words[: math.ceil(similarity * len(words) - 1e-9)]
        groups[leaf, frozenset((p, t) for _, p, t in keep)].add((d, no))
    for d, text in rows:
        for no, line in enumerate(text.split("\n")):
            if WORD.search(line) and len(line.encode()) >= exact_bytes:
                exact[line].add((d, no))
    out = set()
    for least, found in [*((min_docs, g) for g in groups.values()), *((2, g) for g in exact.values())]:
        if len({d for d, _ in found}) >= least:
            out |= {(d, no) for d, no in found if d != min(found)[0]}
    return out


def test_line_brute(spark):
    """Random lines against a brute-force parser, whatever the partitions."""
    from tessera.llm.line_templates import drop_recurring

    rng = random.Random(12)
    word = lambda: rng.choice(["one", "two", "Three", "é", "x-y", "7", "a1", "--", "four", "five"])
    fixed = [[word() for _ in range(rng.randrange(1, 9))] for _ in range(8)]
    rows = []
    for k in range(120):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = list(rng.choice(fixed)) if rng.random() < 0.7 else [word() for _ in range(rng.randrange(0, 7))]
            if line and rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(["zzz", "42", "w" + str(k), "qq"])
            lines.append(rng.choice([" ", "  ", "\t"]).join(line) + rng.choice(["", " ", ""]))
        rows.append((k, "\n".join(lines)))
    for min_docs, exact in ((3, 20), (8, 10**6)):
        gone = brute_lines(rows, min_docs, 0.7, exact)
        want = [(k, "\n".join(x for no, x in enumerate(t.split("\n")) if (k, no) not in gone)) for k, t in rows]
        assert len(gone) > 20
        for parts in (1, 5):
            out = drop_recurring(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), min_docs=min_docs, exact_bytes=exact).collect()
            assert sorted((r.doc_id, r.text) for r in out) == want


def test_line_counts(spark, monkeypatch):
    """Tokens too rare for a recurring template are not carried along."""
    from tessera.llm import line_templates as m

    sizes, cut = {}, m.cut

    def counted(df, name, *a):
        out = cut(df, name, *a)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(m, "cut", counted)
    rows = [(k, f"He said to {chr(97 + k % 26) * (k + 1)} {'xyz'[k % 3] * (k + 1)} well {'w' * (k + 1)}") for k in range(60)]
    rows += [(60 + k, f"He said to all of us {k} times") for k in range(12)]
    out = m.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect()
    assert sorted((r.doc_id, r.text) for r in out if r.text) == rows[:61]
    assert sizes["token-counts"] <= 12 and sizes["line-templates"] <= 12


def test_line_columns(spark):
    """Columns with the operator's own names pass; null and repeated ids; short lines."""
    from tessera.llm.line_templates import drop_recurring

    rows = [(None if k % 3 == 0 else k // 2, f"All rights reserved.\nunlike {chr(97 + k) * 9}\n}}\n{k}", k, -k, "i", [k]) for k in range(12)]
    rows += [rows[4], rows[3], (99, None, 1, 2, None, None), (100, "", 3, 4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, n_dropped long, _drop_i string, __line_drop array<long>")
    out = drop_recurring(df, min_docs=10)
    assert out.columns == [*df.columns, "n_lines_", "n_dropped_"]
    out = out.collect()
    assert sorted(map(str, [(r.n_lines, r.n_dropped, r["_drop_i"], r["__line_drop"]) for r in out])) == sorted(map(str, [tuple(r[2:]) for r in rows]))
    first = [r for r in out if r.text and "rights" in r.text]
    assert len({r.text for r in first}) == 1 and first[0].doc_id is None  # the first document, with its repeated rows
    assert all("}" in r.text and r.text.split("\n")[-1].isdigit() for r in out if r.text)
    assert {(r.doc_id, r.text, r["n_lines_"]) for r in out if r.doc_id in (99, 100)} == {(99, None, 0), (100, "", 1)}


def test_embeddings(spark, empty):
    from tessera.llm.embedding_dedup import near_links

    rng = np.random.default_rng(0)
    rows, base = [], rng.normal(size=(30, 32))
    for k in range(400):
        v = base[k % 30] + rng.normal(size=32) * rng.choice([0.02, 0.1, 0.3])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 30 % 3)))
    rows += [(500, None, 0), (501, [0.0] * 32, 0), (502, [float("nan")] * 32, 0), (503, [None] * 32, 0), (504, rows[0][1], None), (505, rows[0][1], 0), (505, rows[0][1], 0), (None, rows[0][1], 0), (506, [1.0, 2.0], 0), (507, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    for bucket_rows in (2000, 5):
        out = near_links(df, bucket_rows=bucket_rows).collect()
        assert len(out) == len(rows)
        valid = [(i, r) for i, r in enumerate(rows) if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
        links = defaultdict(int)
        pairs = []
        for x, (i, a) in enumerate(valid):
            for j, b in valid[x + 1 :]:
                if a[2] == b[2] and len(a[1]) == len(b[1]):
                    u, v = np.array(a[1], float), np.array(b[1], float)
                    if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                        links[i] += 1
                        links[j] += 1
                        pairs.append((i, j))
        want = sorted((str(r[0]), links[i]) for i, r in enumerate(rows))
        assert sum(a == b for a, b in zip(sorted((str(r.vec_id), r.n_links) for r in out), want)) >= 0.9 * len(rows)
        found, total = sum(r.n_links for r in out), sum(links.values())
        assert 0.95 * total <= found <= total  # recall; no link below the threshold
        assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in out if r.vec_id in (500, 501, 502, 503, 504))
        assert {r.component_id for r in out if r.vec_id in (505, None)} == {r.component_id for r in out if r.vec_id == 0}
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_links(none).count() == 0


def test_large_numbers(spark):
    """Double precision: what float would make infinite or zero."""
    from tessera.llm.embedding_dedup import near_links

    rows = [(0, [1e300, 1.0], 0), (1, [1e300, 2.0], 0), (2, [1e-60, 0.0], 1), (3, [2e-60, 0.0], 1), (4, [1.0, -1.0], 0), (5, [1e-300, 1e-300], 1)]
    for kind in ("array<double>", "array<decimal(38,10)>"):
        if "decimal" in kind:
            from decimal import Decimal

            rows = [(k, [Decimal(str(float(c)))for c in v], n) for k, v, n in ((0, [1, 2], 0), (1, [2, 4], 0), (4, [-1, 0], 0))]
        out = {r[0]: r.n_links for r in near_links(spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int")).collect()}
        assert out == ({0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0} if kind == "array<double>" else {0: 1, 1: 1, 4: 0})


def test_many_vectors(spark):
    """One label, pairs at many angles: recall, and unrelated pairs that no code lets pass."""
    from tessera.llm.embedding_dedup import near_links, plan_tables

    rng = np.random.default_rng(5)
    n, d = 12000, 64
    x = rng.normal(size=(n, d))
    x[6000:9000] = x[:3000] + rng.normal(size=(3000, d)) * rng.uniform(0.02, 0.25, 3000)[:, None]
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    out = near_links(df).toPandas().set_index("vec_id").n_links
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sum(((u[a : a + 1000] @ u.T >= 0.98).sum(1) - 1).sum() for a in range(0, n, 1000))
    assert 0.98 * want <= out.sum() <= want and want > 3000
    for m in (10**3, 10**5, 10**7, 10**9):
        length, tables, _ = plan_tables(m, 0.98)
        assert tables * m / 2**length < 64  # rows that an unrelated vector meets


def test_recall(spark):
    """Against all pairs of the test table: at least 0.9, no link below the threshold."""
    from tessera.llm.queries import op4_itq_near_dedup, table

    d = "/root/testdata/sf0.1"
    v = table(spark, d, "embeddings").toPandas()
    found = op4_itq_near_dedup(spark, d).toPandas().set_index("vec_id").n_links
    total = 0
    for _, g in v.groupby("label"):
        x = np.stack(g.embedding.to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        n = (x @ x.T >= 0.98).sum(1) - 1
        assert all(found[i] <= k for i, k in zip(g.vec_id, n))
        total += n.sum()
    assert found.sum() >= 0.9 * total
