"""Quality rules: base statistics of each text, and robust multivariate outliers.

Native DataFrame operations only. Of every text come its words, the characters
in them, symbols, repeated lines and words in repeated five-word windows; two
base rules reject on them. For each language and source, a minimum-covariance-
determinant estimate of location and scatter of the transformed statistics is
made: the subset of the ``support`` share of texts whose covariance has the least
determinant. It is sought from three starts (medians and quartile ranges; all
texts; the texts within two quartile scales of the medians in every statistic) by
concentration steps: distances are taken, and the texts with the least ones give
new means and covariances. A step counts if it lessens the log determinant by
``tolerance``; a start ends when its step doesn't, and the start with the least
determinant gives the estimate. A text whose squared Mahalanobis distance to it is
over ``cutoff`` is rejected.

Every group's moments, however small the group, are pooled with those of ``prior``
texts of its language: a source of a few texts is judged by its language, one of
many by itself, and nothing switches in between. Quantiles are read off counts of
fixed-width bins, so each step is one aggregate with partial sums, of a few numbers
for each group: no group is gathered, and reruns agree. Variances have a floor
(``floors``), since most texts have no symbols or repeats at all.

Defined results: null text has no words and fails the base rules; null language
or source is a value of its own; repeated rows count as texts of their own;
an empty table gives an empty result; columns besides the four are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import WORD_GAP, broadcast_if_small, cut, discard, is_small

#: Transformed statistics and the least standard deviation of each: log words,
#: log characters a word, log symbols per mille of characters, log repeated lines
#: per mille of words, log repeated words per mille of words.
FEATURES = {"_f0": 0.5, "_f1": 0.1, "_f2": 0.7, "_f3": 1.2, "_f4": 1.2}


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row (a lambda's argument is bound)."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Of an array of word hashes: words in 5-word windows that occur twice or more."""
    n = F.size(hashes)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4]))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))

        def starts(s: Column) -> Column:
            return F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["w"] == x["w"])) | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["w"] == x["w"])))

        at = let(pairs, lambda s: F.sort_array(F.transform(starts(s), lambda x: x["i"])))
        # each start covers up to five words, fewer if the next start comes sooner
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k + 1 < F.size(p), F.least(F.lit(5), F.get(p, k + 1) - x)).otherwise(5)), F.lit(0).cast("long"), lambda a, x: a + x))

    many = let(windows(hashes), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
    return F.when(n < 6, F.lit(0).cast("long")).otherwise(many)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(_id, _lang, _source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source"), text.alias("_text"))
    t = F.col("_text")
    words = F.filter(F.split(t, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = F.struct(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n"), _repeat_words(h).alias("r"))).alias("w"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("d"),
    )
    df = df.select("_id", "_lang", "_source", made.alias("_m"), F.char_length(F.regexp_replace(t, WORD_GAP, "")).cast("long").alias("word_chars"), (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"))
    return df.select("_id", "_lang", "_source", F.col("_m.w.n").alias("n_words"), "word_chars", "n_symbols", F.col("_m.d").alias("n_dup_lines"), F.col("_m.w.r").alias("n_repeat_words"))


def _features(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (
        df.withColumn("_f0", F.log(n))
        .withColumn("_f1", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n))
        .withColumn("_f2", F.log1p(1000.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))))
        .withColumn("_f3", F.log1p(1000.0 * F.col("n_dup_lines") / n))
        .withColumn("_f4", F.log1p(1000.0 * F.col("n_repeat_words") / n))
    )


def _distance(names: list[str], floors: list[float]) -> tuple[list[tuple[str, Column]], Column]:
    """Columns of a Cholesky decomposition of the group's scatter (from the means
    _m.. and mean products _s..), and the squared distance by forward substitution."""
    p, made = len(names), []
    for i in range(p):
        for j in range(i + 1):
            cov = F.col(f"_s{i}_{j}") - F.col(f"_m{i}") * F.col(f"_m{j}")
            cov = cov + F.lit(floors[i] ** 2) if i == j else cov
            for k in range(j):
                cov = cov - F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}")
            made.append((f"_l{i}_{j}", F.sqrt(F.greatest(cov, F.lit(floors[i] ** 2 / 100))) if i == j else cov / F.col(f"_l{j}_{j}")))
    for i in range(p):
        y = F.col(names[i]) - F.col(f"_m{i}")
        for k in range(i):
            y = y - F.col(f"_l{i}_{k}") * F.col(f"_y{k}")
        made.append((f"_y{i}", y / F.col(f"_l{i}_{i}")))
    return made, sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, p)), F.col("_y0") * F.col("_y0"))


def _logdet(p: int) -> Column:
    return sum((2 * F.log(F.col(f"_l{i}_{i}")) for i in range(1, p)), 2 * F.log(F.col("_l0_0")))


def _scatter(estimate: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """``estimate`` with the columns _l.. of its decomposed scatter."""
    for name, value in _distance(names, floors)[0]:
        if name.startswith("_l"):
            estimate = estimate.withColumn(name, value)
    return estimate


def _with_distance(df: DataFrame, estimate: DataFrame, keys: list[str], names: list[str], floors: list[float]) -> DataFrame:
    made, d2 = _distance(names, floors)
    # one row a group and start: where they are few, a hot group's rows need no shuffle
    out = df.join(estimate, keys)
    for name, value in made:
        if name.startswith("_y"):
            out = out.withColumn(name, value)
    return out.withColumn("_d2", d2)


def _pooled(df: DataFrame, keys: list[str], names: list[str], prior: float) -> DataFrame:
    """Means _m.. and mean products _s.. by ``keys`` (the language first, the source
    second), each group's pooled with ``prior`` texts of its language."""
    p = range(len(names))
    terms = {f"m{i}": F.col(names[i]) for i in p} | {f"s{i}_{j}": F.col(names[i]) * F.col(names[j]) for i in p for j in range(i + 1)}
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(x).alias(f"_g{k}") for k, x in terms.items()])
    wide = [k for k in keys if k != "_gs"]
    langs = sums.groupBy(*wide).agg(F.sum("_n").alias("_ln"), *[F.sum(f"_g{k}").alias(f"_h{k}") for k in terms])
    both = sums.join(langs, wide)
    return both.select(*keys, *[((F.col(f"_g{k}") + prior * F.col(f"_h{k}") / F.col("_ln")) / (F.col("_n") + prior)).alias(f"_{k}") for k in terms])


def robust_verdicts(df: DataFrame, support: float = 0.75, cutoff: float = 40.0, prior: float = 200.0, tolerance: float = 0.001, floors: dict[str, float] | None = None) -> DataFrame:
    """``df`` (_lang, _source and the features) with _d2 and _outlier."""
    floors = floors or FEATURES
    names, least = list(floors), list(floors.values())
    p = len(names)
    keys, each = ["_gl", "_gs"], ["_gl", "_gs", "_st"]
    # '=' marks a value, so null is one too
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    df = cut(df.withColumn("_gl", tag("_lang")).withColumn("_gs", tag("_source")), "outlier-features")
    slim = df.select(*keys, *names)
    # medians and quartile ranges, from bins of a hundredth
    values = slim.select(*keys, F.posexplode(F.array(*[F.floor(F.col(n) * 100).cast("long") for n in names])).alias("_k", "_bin"))
    bins = values.groupBy(*keys, "_k", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto, whole = Window.partitionBy(*keys, "_k").orderBy("_bin"), Window.partitionBy(*keys, "_k")
    bins = bins.withColumn("_c", F.sum("_n").over(upto)).withColumn("_t", F.sum("_n").over(whole))
    at = lambda q: F.min(F.when(F.col("_c") >= q * F.col("_t"), F.col("_bin"))) / 100.0
    ranges = bins.groupBy(*keys, "_k").agg(at(0.5).alias("_q2"), ((at(0.75) - at(0.25)) / 1.35).alias("_sd"))
    pick = lambda i, c: F.max(F.when(F.col("_k") == i, F.col(c)))
    ranges = cut(ranges.groupBy(*keys).agg(*[pick(i, "_q2").alias(f"_q{i}") for i in range(p)], *[pick(i, "_sd").alias(f"_d{i}") for i in range(p)]), "outlier-ranges")
    box = slim.join(broadcast_if_small(ranges), keys)
    for i, n in enumerate(names):
        box = box.where(F.abs(F.col(n) - F.col(f"_q{i}")) <= 2 * F.greatest(F.col(f"_d{i}"), F.lit(least[i])))
    moments = [f"_m{i}" for i in range(p)] + [f"_s{i}_{j}" for i in range(p) for j in range(i + 1)]
    middle = ranges.select(*keys, F.lit(0).alias("_st"), *[F.col(f"_q{i}").alias(f"_m{i}") for i in range(p)], *[(F.col(f"_q{i}") * F.col(f"_q{j}") + (F.col(f"_d{i}") * F.col(f"_d{i}") if i == j else 0)).alias(f"_s{i}_{j}") for i in range(p) for j in range(i + 1)])
    starts = [middle, _pooled(slim, keys, names, prior).withColumn("_st", F.lit(1)), _pooled(box, keys, names, prior).withColumn("_st", F.lit(2))]
    starts = [x.select(*each, *moments, F.lit(None).cast("double").alias("_det"), F.lit(True).alias("_moved")) for x in starts]
    estimate = cut(starts[0].unionAll(starts[1]).unionAll(starts[2]), "outlier-starts")
    hint = F.broadcast if is_small(estimate) else lambda x: x
    while estimate.where("_moved").head(1):
        # the other starts have come to their ends
        now = _scatter(hint(estimate.where("_moved")), names, least)
        near = _with_distance(slim, now, keys, names, least).select(*each, *names, F.floor(F.log(F.col("_d2") + 1e-9) * 64).cast("long").alias("_bin"))
        ranks = near.groupBy(*each, "_bin").agg(F.count(F.lit(1)).alias("_n"))
        ranks = ranks.withColumn("_c", F.sum("_n").over(Window.partitionBy(*each).orderBy("_bin"))).withColumn("_t", F.sum("_n").over(Window.partitionBy(*each)))
        limit = ranks.groupBy(*each).agg(F.min(F.when(F.col("_c") >= support * F.col("_t"), F.col("_bin"))).alias("_limit"))
        made = _pooled(near.join(hint(limit), each).where(F.col("_bin") <= F.col("_limit")), each, names, prior)
        made = _scatter(made, names, least).select(*each, *[F.col(c).alias(f"_new{c}") for c in moments], _logdet(p).alias("_newdet"))
        both = estimate.join(hint(made), each, "left")
        better = F.col("_moved") & (F.col("_det").isNull() | (F.col("_newdet") < F.col("_det") - tolerance))
        last, estimate = estimate, cut(both.select(*each, *[F.when(better, F.col(f"_new{c}")).otherwise(F.col(c)).alias(c) for c in moments], F.when(better, F.col("_newdet")).otherwise(F.col("_det")).alias("_det"), better.alias("_moved")), "outlier-step")
        discard(last)
    best = estimate.groupBy(*keys).agg(F.min(F.struct("_det", "_st", *moments)).alias("e")).select(*keys, *[F.col(f"e.{c}").alias(c) for c in moments])
    best = cut(best, "outlier-estimate")
    out = _with_distance(df, _scatter(hint(best), names, least), keys, names, least)
    return out.select(*df.columns, "_d2", (F.col("_d2") > cutoff).alias("_outlier"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance2, kept) of every row."""
    stats = statistics(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = robust_verdicts(_features(stats.withColumn("base_failed", failed)), **options)
    return df.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("_d2").alias("distance2"), (~F.col("base_failed") & ~F.col("_outlier")).alias("kept"))
