"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing
sources to target weights, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents; the last returns (doc_id, n_tokens, ids,
decoded_sha256), one row for each copy of a document that the mix takes.

Defined results: every stage takes null texts, ids, languages and sources and
repeated rows as its operator says; the Jaccard stage keeps one row of each
group, whether ids are null, repeated or neither, and every row without words; a
document that the line stage leaves empty goes.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import broadcast_if_small, cut, discard, remove, scratch
from tessera.llm.jaccard_join import jaccard_components
from tessera.llm.line_templates import drop_recurring
from tessera.llm.mixing import mixed_documents
from tessera.llm.quality_classifier import fit, score
from tessera.llm.queries import held_out, table, tokenizer
from tessera.llm.sentence_pieces import encode_decode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _stage(f):
    """A stage that writes tables of its own deletes those that its result doesn't read.
    The result itself is not written: it reads the stage's input and small tables (the
    mix: its own copy of the input)."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch() as made:
            out = f(spark, docs, sf_dir)
        read = {x.rsplit("/", 2)[1] for x in out.inputFiles()} if made else set()
        remove(spark, [p for p in made if p.rsplit("/", 1)[1] not in read])
        return out

    return run_stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of
    rows that are not held out, as far as their documents are in ``docs``."""
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()), "quality", max_docs=4000)
    return score(docs, model, carry=("text", "lang", "source", "n_chars"), threshold=0.3).where("predicted = 1").select(COLUMNS)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; emptied ones go."""
    kept = drop_recurring(docs.select(COLUMNS), min_docs=10, similarity=0.7)
    kept = kept.where((F.col("n_dropped") == 0) | (F.length("text") > 0))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


@_stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, one row: the one with the least id (null ids
    last), then text hash, then other columns."""
    # a string in that order, which tells all rows apart but those equal in id and text
    number = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("decimal(20,0)").cast("string"), 20, "0")
    keyed = docs.select(*COLUMNS, F.concat(F.coalesce(number, F.lit("null")), F.lit("|"), F.lpad(F.hex(F.xxhash64("text")), 16, "0")).alias("_key"))
    found = jaccard_components(keyed.select("_key", "text"), width=5, threshold=(3, 4), id_col="_key").where("n_shingles > 0")
    marks = found.groupBy("_key").agg(F.min(F.col("_key") != F.col("component_id")).alias("_gone"), F.count(F.lit(1)).alias("_n")).where("_gone or _n > 1")
    marks = broadcast_if_small(cut(marks.select("_key", "_gone"), "near-duplicates"))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("lang", "source", "n_chars"))
    repeated = keyed.join(marks.where("not _gone"), "_key").withColumn("_nth", nth).where("_nth = 1")
    return keyed.join(marks, "_key", "left_anti").select(COLUMNS).unionAll(repeated.select(COLUMNS))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixed_documents(docs.select(COLUMNS), weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0)


@_stage
def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row."""
    out = encode_decode(docs, tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("mixing sources to target weights", mixing), ("SentencePiece encoding and decoding", sentence_pieces)]

#: No stage but the mix can be put in SQL; the tests hold each stage against a
#: brute-force version or the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on documents; what a stage keeps is written
    to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        last = docs
        with scratch() as made:
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = cut(docs, f"stage{k + 1}", "zstd")
        if k + 1 < len(STAGES):
            remove(spark, [p for p in made if p != docs._tessera_path])
            discard(last)
    return docs
