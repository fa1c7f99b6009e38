"""Line dedup with a log-template tree.

The tree has fixed depth: a line goes down by its number of tokens and its first
``DEPTH`` tokens to a leaf; tokens with digits are variable fields from the
start. In a leaf, variable fields are told by how rare they are: of a line's
other tokens, the ``similarity`` share that is most frequent at its place in the
leaf (on a tie, the one further left) makes up the line's template, and the rest
becomes variable. Lines with one template thus agree in at least that share. A
template that occurs in ``min_docs`` documents or more recurs: its lines are
dropped from every document but the first (in id order) that has one. A line of
``exact_bytes`` bytes or more that is exactly repeated needs no template: it
recurs from two documents on.

The texts are parsed once. Templates come from counts over the whole corpus, so
they depend neither on the order of lines nor on partitions, and no leaf is
gathered: counts are taken by (leaf, place, token), over distinct lines of those
leaves alone that have lines enough for a recurring template. A token with a lower
count than a recurring template needs can't be part of one, so neither its count nor
a line that would need it goes any further.

Defined results: null text stays null and has no lines; a line without a token
that has a letter and no digit has no template (rules, brackets and rows of
numbers stay unless they are long and exactly repeated); a document whose lines
all go has the empty text; rows with equal id and text are one document and keep
or lose the same lines; null ids come before all others, and texts of one id in
the order of their hashes; other columns are passed on as they are, and where
the input has a column n_lines or n_dropped, the count's name gets underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import WORD_GAP, broadcast_if_small, cut, discard

DEPTH = 3
VARIABLE = "<*>"


def _doc(id_col: str, text_col: str) -> Column:
    """Orders documents by id, null first, then by text hashes."""
    text = F.col(text_col).cast("string")
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))


def document_lines(docs: DataFrame, id_col: str, text_col: str, exact_bytes: int) -> DataFrame:
    """(_doc, _no, _leaf, _masked, _exact) of all lines that can be dropped: the
    line's leaf (null without a word), its tokens with variable fields, and a hash of
    the line, null for short ones."""

    def parsed(line: Column, no: Column) -> Column:
        tokens = F.filter(F.split(line, WORD_GAP), lambda t: t != "")
        tokens = F.when(line.rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), VARIABLE).otherwise(t))).otherwise(tokens)

        def made(t: Column) -> Column:
            word = F.exists(t, lambda x: x.rlike(r"\p{L}"))
            leaf = F.when(word, F.xxhash64(F.size(t), F.array_join(F.slice(t, 1, DEPTH), " ")))
            exact = F.when((F.size(t) > 0) & (F.octet_length(line) >= exact_bytes), F.xxhash64(line))
            return F.struct(no.alias("_no"), leaf.alias("_leaf"), F.array_join(t, " ").alias("_masked"), exact.alias("_exact"))

        return F.transform(F.array(tokens), made)[0]

    # a generator's fields are made once, however often they are used
    df = docs.select(_doc(id_col, text_col).alias("_doc"), F.explode(F.transform(F.split(F.col(text_col).cast("string"), "\n"), parsed)).alias("_l"))
    return df.select("_doc", "_l.*").where("_leaf is not null or _exact is not null")


def templates(lines: DataFrame, similarity: float, min_lines: int = 1) -> DataFrame:
    """(_leaf, _line, _template) of the distinct lines of ``lines`` (_leaf, _masked),
    _line being a hash, as far as the template has ``min_lines`` lines or more."""
    distinct = lines.groupBy("_leaf", "_masked").agg(F.count(F.lit(1)).alias("_n"))
    words = F.size(F.filter(F.split("_masked", " "), lambda t: t != VARIABLE))
    needed = F.ceil(F.lit(similarity) * words - 1e-9).cast("int")
    distinct = cut(distinct.select("_leaf", F.xxhash64("_masked").alias("_line"), "_masked", "_n", needed.alias("_needed")), "distinct-lines", "zstd")
    tokens = distinct.select("_leaf", "_line", "_n", "_needed", F.posexplode(F.split("_masked", " ")).alias("_place", "_token")).where(F.col("_token") != VARIABLE)
    tokens = tokens.withColumn("_token", F.xxhash64("_token"))
    # every line of a template has its tokens: a token's count is no lower than the template's
    least = min_lines if similarity > 0 else 1
    counts = cut(tokens.groupBy("_leaf", "_place", "_token").agg(F.sum("_n").alias("_count")).where(F.col("_count") >= least), "token-counts")
    ranked = tokens.join(broadcast_if_small(counts), ["_leaf", "_place", "_token"]).groupBy("_leaf", "_line").agg(F.sort_array(F.collect_list(F.struct((-F.col("_count")).alias("c"), F.col("_place").alias("p"), F.col("_token").alias("t")))).alias("_ranked"), F.first("_n").alias("_n"), F.first("_needed").alias("_needed"))
    ranked = ranked.where(F.size("_ranked") >= F.col("_needed"))
    kept = F.slice("_ranked", F.lit(1), F.col("_needed"))
    known = ranked.select("_leaf", "_line", "_n", F.xxhash64("_leaf", F.sort_array(F.transform(kept, lambda x: F.struct(x["p"], x["t"])))).alias("_template"))
    known = cut(known, "line-templates")
    enough = known.groupBy("_template").agg(F.sum("_n").alias("_lines")).where(F.col("_lines") >= min_lines).select("_template")
    out = cut(known.join(broadcast_if_small(cut(enough, "templates")), "_template").select("_leaf", "_line", "_template"), "known-lines")
    discard(distinct, counts, known)
    return out


def _free_name(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def drop_recurring(docs: DataFrame, min_docs: int = 10, similarity: float = 0.7, exact_bytes: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines of recurring templates and long repeated lines taken out
    of the text, and n_lines and n_dropped."""
    lines = cut(document_lines(docs, id_col, text_col, exact_bytes), "all-lines", "zstd")
    places = lines.where("_exact is not null").select("_doc", "_no", "_exact")
    exact = places.groupBy("_exact").agg(F.min("_doc").alias("_keep"), F.max("_doc").alias("_last")).where(F.col("_keep") != F.col("_last"))
    exact = cut(exact.select("_exact", "_keep"), "repeated-lines")
    copies = places.join(broadcast_if_small(exact), "_exact").where(F.col("_doc") != F.col("_keep")).select("_doc", "_no")
    leaves = cut(lines.where("_leaf is not null").groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_docs).select("_leaf"), "leaves")
    some = lines.where("_leaf is not null").join(broadcast_if_small(leaves), "_leaf").select("_doc", "_no", "_leaf", "_masked")
    known = templates(some, similarity, min_docs)
    placed = some.select("_doc", "_no", "_leaf", F.xxhash64("_masked").alias("_line")).join(broadcast_if_small(known), ["_leaf", "_line"])
    found = cut(placed.groupBy("_template", "_doc").agg(F.collect_list("_no").alias("_nos")), "line-places")
    recur = found.groupBy("_template").agg(F.count(F.lit(1)).alias("_docs"), F.min("_doc").alias("_keep")).where(F.col("_docs") >= min_docs)
    recur = cut(recur.select("_template", "_keep"), "recurring")
    gone = found.join(broadcast_if_small(recur), "_template").where(F.col("_doc") != F.col("_keep")).select("_doc", F.explode("_nos").alias("_no"))
    drops = cut(gone.unionAll(copies).groupBy("_doc").agg(F.collect_set("_no").alias("_nos")), "line-drops")
    discard(lines, exact, leaves, known, found, recur)
    names = docs.columns
    i, h, g, nos = (_free_name(f"_drop_{x}", names) for x in "ihgn")
    drops = broadcast_if_small(drops).select(F.col("_doc.id").alias(i), F.col("_doc.h").alias(h), F.col("_doc.g").alias(g), F.col("_nos").alias(nos))
    doc = _doc(id_col, text_col)
    kept = docs.join(drops, doc["id"].eqNullSafe(F.col(i)) & (doc["h"] == F.col(h)) & (doc["g"] == F.col(g)), "left")
    split = F.split(F.col(text_col).cast("string"), "\n")
    left = F.filter(F.transform(split, lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda s: ~F.array_contains(F.col(nos), s["k"]))
    text = F.when(F.col(nos).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda s: s["x"]), "\n"))
    n_lines = F.when(F.col(text_col).isNotNull(), F.size(split)).otherwise(0).cast("long")
    n_dropped = F.when(F.col(nos).isNotNull(), F.size(nos)).otherwise(0).cast("long")
    same = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    return kept.select(*same, n_lines.alias(_free_name("n_lines", names)), n_dropped.alias(_free_name("n_dropped", names)))
