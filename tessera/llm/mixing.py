"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words; a source whose share is over ``cap`` times
its words is held there and the excess goes to the others by weight. A target of
r times a source's words (0 <= r <= cap) gives every document floor(r) certain
whole copies. The remaining words are an unequal-probability sample of whole
documents: inclusion probabilities fall slowly with length (``length_power``), so
that a few very long documents don't use up a source's share, and add up to these
words. Where one would pass 1, the document is certain and the others'
probabilities are set anew from what is left; as they fall with length, a source's
certain documents are those below one length, which a sum over its lengths finds.

The others are ranked by random odds over inclusion odds, (u / (1-u)) / (p /
(1-p)), and taken in that order until the next would pass the target: the sample's
size in words is fixed. Documents that don't fit what is missing are then skipped,
and the ranking goes on with the others, ``passes`` times in all: each pass takes,
in the order of ranks, those documents not yet taken that are no longer than the
gap, and the gap that it leaves is shorter than a document that it met. A source
that then misses its target by more than ``slack`` (all short documents are certain
and the long ones don't fit beside them) is drawn again with the shortest document
that was left out in front and the certain ones in the ranking, and keeps what comes
nearer.

u is a hash of id, text hash and seed, so reruns agree. Where a pass ends is found by
sums over 65,536 ranges of the rank, then over the ranks of the range at the end, so no
source is gathered. Rows of equal rank (equal in id and text) are taken by 4,096ths,
which a hash of their place in the input deals. What a source takes is then a few
numbers, and copies are a projection: texts are written once and never shuffled.

Defined results: null text has no words; documents without words are never
taken; null sources are one source and come last; repeated rows count as
documents of their own; an empty input gives an empty result; other columns are
not read by mix() and passed on as they are by mixed_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import WORD, cut, discard, is_small

#: Ranges that a ranking is cut into, and parts of equal rows.
BINS = 1 << 16
PARTS = 1 << 12


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float, *carry: str) -> DataFrame:
    """``sources`` (one row a source: source, source_size) with its target.

    Sources are held at their cap in the order of cap over weight: the water level
    of the remaining ones, left / weight left, settles which, in one ordered sum."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sources.withColumn("_w", weight).withColumn("_top", F.col("source_size") * float(cap))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("_top") / F.col("_w"), F.col("source").asc_nulls_last())
    past = filling.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * float(share)
    df = df.withColumn("_nth", F.row_number().over(filling)).withColumn("_left", total - F.coalesce(F.sum("_top").over(past), F.lit(0.0))).withColumn("_wleft", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(past), F.lit(0.0)))
    free = F.min(F.when(F.col("_top") * F.col("_wleft") >= F.col("_left") * F.col("_w"), F.col("_nth"))).over(everything)
    df = df.withColumn("_free", free).withColumn("_held", F.coalesce(F.col("_nth") < F.col("_free"), F.lit(True)))
    level = F.max(F.when(F.col("_nth") == F.col("_free"), F.col("_left") / F.col("_wleft"))).over(everything)
    return df.select(*carry, "source", "source_size", F.when(F.col("_held"), F.col("_top")).otherwise(level * F.col("_w")).alias("target"))


def _row_hash(seed: int, row_id, text):
    """Hex digits of id and text that any SQL engine can make."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(row_id.cast("string"), F.lit("")), F.md5(text)))


def _rank(length_power: float) -> Column:
    """The random odds over the inclusion odds of a document that may be sampled, as
    a / (1 + a), which keeps their order and lies in [0, 1); null for the others.
    In a second draw (forced is not null), documents of the forced length come
    first, and the certain ones next, in random order."""
    u = (F.conv(F.substring("h", 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)
    size = F.col("size").cast("double")
    p = F.least(F.lit(1.0), F.col("level") * F.pow(size, F.lit(length_power)))
    odds = u * (1 - p) / (u * (1 - p) + p * (1 - u))
    again = F.when(F.col("size") == F.col("forced"), u / 2 - 1 - size).when(p >= 1, u - 1).otherwise(odds)
    return F.when((F.col("gap") > 0) & (F.col("size") > 0) & (p > 0), F.when(F.col("forced").isNotNull(), again).when(F.col("size") >= F.col("free_size"), odds))


#: What orders the ranking: equal ranks by a hash of all columns, and rows equal in
#: that by parts that a hash of their place in the input deals them to.
_KEY = ["rank", "w", "part"]


def _odds(base: DataFrame, known: DataFrame, length_power: float, hint) -> DataFrame:
    """``known`` with sure (copies of every document), gap (words to be sampled after
    certain documents), free_size (documents below it are certain) and level (an
    inclusion probability is level times size to the length_power)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = known.withColumn("sure", F.floor(rate + 1e-12)).withColumn("need", F.when(rate - F.col("sure") > 1e-12, F.col("target") - F.col("sure") * F.col("source_size")).otherwise(0.0))
    sizes = base.where("size > 0").groupBy("k", "size").agg(F.count(F.lit(1)).alias("n"))
    by_size = Window.partitionBy("k").orderBy("size")
    words = F.col("n") * F.col("size")
    weighed = F.col("n") * F.pow(F.col("size").cast("double"), F.lit(1.0 + length_power))
    sizes = sizes.withColumn("below", F.sum(words).over(by_size) - words).withColumn("rest", F.sum(weighed).over(by_size.rowsBetween(0, Window.unboundedFollowing)))
    sizes = sizes.join(hint(known.select("k", "need")), "k").withColumn("level", (F.col("need") - F.col("below")) / F.col("rest"))
    first = sizes.where(F.col("level") * F.pow(F.col("size").cast("double"), F.lit(length_power)) <= 1 + 1e-12).groupBy("k").agg(F.min(F.struct("size", "below", "level")).alias("f"))
    known = known.join(hint(first), "k", "left")
    return known.select("k", "source_size", "target", "sure", "need", F.coalesce(F.col("need") - F.col("f.below"), F.lit(0.0)).alias("gap"), F.coalesce("f.size", F.lit(0)).alias("free_size"), F.coalesce("f.level", F.lit(0.0)).alias("level"), F.lit(None).cast("long").alias("forced"))


def _end(rows: DataFrame, state: DataFrame, hint) -> DataFrame:
    """(k, rest, end): of each source's ranked rows, the first key whose rows
    don't fit the gap in the order of the ranking, and what is left of the gap
    before it; no row for a source whose rows all fit. Every table that ``hint`` is
    given has one row a source at most."""
    left = state.select("k", "gap")
    keys = [F.floor(F.col("rank") * BINS), F.struct(*_KEY)]
    for level, key in enumerate(keys):
        some = rows.withColumn("key", key).join(hint(left), "k")
        if level:
            some = some.where(keys[level - 1] == F.col("at"))
        groups = some.groupBy("k", "key").agg(F.sum("size").alias("n"), F.max("gap").alias("gap"))
        groups = groups.withColumn("before", F.sum("n").over(Window.partitionBy("k").orderBy("key")) - F.col("n"))
        over = groups.where("before + n > gap").groupBy("k").agg(F.min(F.struct("key", "before", "gap")).alias("e"))
        left = over.select("k", F.col("e.key").alias("at"), (F.col("e.gap") - F.col("e.before")).alias("gap"))
    return left.select("k", F.col("gap").alias("rest"), F.col("at").alias("end"))


def _mixed(docs: DataFrame, weights, share, cap, seed, length_power, passes, slack, id_col, text_col, source_col, carry: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    w = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(0).cast("long")
    more = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc")] if carry else []
    base = docs.select(F.col(id_col).alias("id"), k.alias("k"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _row_hash(seed, F.col(id_col), text).alias("h"), w.alias("w"), F.monotonically_increasing_id().alias("row"), *more)
    base = cut(base, "mix", "zstd" if carry else None).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)))
    known = base.groupBy("k", "source").agg(F.sum("size").alias("source_size"))
    known = cut(targets(known, weights, share, cap, "k"), "mix-targets")
    hint = F.broadcast if is_small(known) else lambda df: df
    known = cut(_odds(base, known, length_power, hint), "mix-sources")
    ranked = _ranked(base, known, length_power, hint, "mix-ranked")
    first = _passes(ranked, known.select("k", "gap"), passes, hint, "mix-pass")
    # sources that miss their targets by more than slack: the shortest document that was left
    far = known.join(hint(first.select("k", "taken", F.col("gap").alias("short"))), "k").where(F.col("short") > slack * F.col("target"))
    left = ranked.join(hint(far.select("k", "need", "taken")), "k").where(~_is_taken() & (F.col("size") <= F.col("need")))
    forced = left.groupBy("k").agg(F.min("size").alias("forced"))
    again = cut(known.drop("forced").join(hint(forced), "k").withColumn("gap", F.col("need")), "mix-again")
    taken = first.select("k", "taken", F.lit(None).cast("long").alias("forced"))
    if again.head(1):
        second = _passes(_ranked(base, again, length_power, hint, "mix-ranked2"), again.select("k", "gap"), passes, hint, "mix-again")
        second = second.join(hint(again.select("k", "forced")), "k").select("k", F.col("gap").alias("gap2"), F.col("taken").alias("taken2"), "forced")
        nearer = F.coalesce(F.col("gap2") < F.col("gap"), F.lit(False))
        taken = first.join(hint(second), "k", "left").select("k", F.when(nearer, F.col("taken2")).otherwise(F.col("taken")).alias("taken"), F.when(nearer, F.col("forced")).alias("forced"))
    known = known.drop("forced").join(hint(taken), "k")
    known = cut(known, "mix-taken")
    discard(ranked, first, again)
    out = base.join(hint(known), "k").withColumn("rank", _rank(length_power))
    sampled = F.col("rank").isNotNull() & _is_taken()
    certain = F.col("forced").isNull() & (F.col("size") < F.col("free_size"))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("sure") + (certain | sampled).cast("long")).cast("long")
    return out.withColumn("copies", copies)


def _ranked(base: DataFrame, known: DataFrame, length_power: float, hint, name: str) -> DataFrame:
    """(k, size, rank..) of the documents that may be sampled."""
    df = base.join(hint(known.select("k", "gap", "free_size", "level", "forced")), "k").select("k", "size", _rank(length_power).alias("rank"), "w", "part")
    return cut(df.where("rank is not null"), name)


def _passes(ranked: DataFrame, state: DataFrame, passes: int, hint, name: str) -> DataFrame:
    """(k, gap, taken) after so many passes: what is missing, and for each pass the
    gap that it began with and where it ended."""
    state = state.withColumn("taken", F.array().cast("array<struct<most: double, end: struct<rank: double, w: bigint, part: bigint>>>"))
    for n in range(passes):
        open_rows = ranked.join(hint(state.withColumnRenamed("gap", "most")), "k").where(~_is_taken() & (F.col("size") <= F.col("most"))).select("k", "size", *_KEY)
        had = open_rows.groupBy("k").agg(F.sum("size").alias("had"))
        # a source without an end takes all its rows
        ended = state.join(hint(_end(open_rows, state, hint)), "k", "left").join(hint(had), "k", "left")
        rest = F.when(F.col("end").isNotNull(), F.col("rest")).otherwise(F.col("gap") - F.coalesce("had", F.lit(0)))
        this = F.struct(F.col("gap").alias("most"), F.col("end").alias("end"))
        last, state = state, cut(ended.select("k", rest.alias("gap"), F.when(F.col("gap") > 0, F.concat("taken", F.array(this))).otherwise(F.col("taken")).alias("taken")), f"{name}{n}")
        discard(last)
    return state


def _is_taken() -> Column:
    """Whether some pass took the row: it is no longer than the pass's gap, and ranks
    before the pass's end, if it has one."""
    key = F.struct(*_KEY)
    return F.exists("taken", lambda x: (F.col("size") <= x["most"]) & (x["end"].isNull() | (key < x["end"])))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 1, length_power: float = -0.25, passes: int = 2, slack: float = 0.01, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, copies, taken, row_hash) of every row;
    taken is copies times size, row_hash is equal for rows equal in id and text."""
    out = _mixed(docs, weights, share, cap, seed, length_power, passes, slack, id_col, text_col, source_col, False)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.col("h").alias("row_hash"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 1, length_power: float = -0.25, passes: int = 2, slack: float = 0.01, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    out = _mixed(docs, weights, share, cap, seed, length_power, passes, slack, id_col, text_col, source_col, True).where("copies > 0")
    out = out.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])
