"""Sharding by a hierarchical weighted hash tree.

A cluster is a tree of regions, racks and shards. A document descends it: at
each level, every child draws an exponential variable from the hash of the
document's key and the child's name, with the weight of the child's subtree as
its rate, and the child whose draw comes first takes the document. Draws of
unchanged children don't change, so that a change of weights moves documents
only into (or out of) the subtrees whose weights change. A further shard is put
into a region of its own: only that region's draw is new, hence documents move
only into the new shard (law ``key``: key and shard count decide).

Everything is a projection over built-in functions; only the gapless slots need
small shuffles of (id, size, crc32) rows, in 4,096 hash ranges for each shard.

Defined results: a null key draws as the empty string; null text has size 1 and
the crc32 of no bytes, as an empty one; equal keys get equal shards; repeated
rows get slots of their own; columns besides key and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import cut


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def cluster(n_shards: int, base: int = 8) -> list[Leaf]:
    """The first ``base`` shards stand in regions of two racks of two shards; each
    further one has a region of its own, so growth only adds a top-level draw."""
    return [Leaf(f"r{i // 4}", f"r{i // 4}k{i % 4 // 2}", i) if i < base else Leaf(f"g{i}", f"g{i}k", i) for i in range(n_shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + name))), 1, 12), 16, 10).cast("long").cast("double")
    return -F.log((bits + 0.5) / float(2**48)) / F.lit(float(weight))


def _first(key: Column, children: dict[str, float]) -> Column:
    """The name of the child that draws first."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.array_min(F.array(*[F.struct(_draw(key, n, w).alias("d"), F.lit(n).alias("n")) for n, w in sorted(children.items())]))["n"]


def _children(leaves: list[Leaf], name) -> dict[str, float]:
    out: dict[str, float] = {}
    for x in leaves:
        if x.weight > 0:
            out[name(x)] = out.get(name(x), 0.0) + x.weight
    return out


def _by_parent(parent: Column, options: dict[str, Column]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, value in options.items():
        out = out.when(parent == name, value)
    return out


def descend(df: DataFrame, key: str, leaves: list[Leaf], out: str) -> DataFrame:
    """``df`` with the shard of column ``key`` (a string) in ``out``."""
    regions = _children(leaves, lambda x: x.region)
    if not regions:
        raise ValueError("no shard has a positive weight")
    k = F.col(key)
    df = df.withColumn("_region", _first(k, regions))
    racks = {r: _children([x for x in leaves if x.region == r], lambda x: x.rack) for r in regions}
    df = df.withColumn("_rack", _by_parent(F.col("_region"), {r: _first(k, c) for r, c in racks.items()}))
    shards = {rack: _children([x for x in leaves if x.rack == rack], lambda x: str(x.shard)) for c in racks.values() for rack in c}
    df = df.withColumn(out, _by_parent(F.col("_rack"), {r: _first(k, {n: w for n, w in c.items()}) for r, c in shards.items()}).cast("int"))
    return df.drop("_region", "_rack")


def shard(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.col("_text")
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"))
    df = df.select("_id", "_key", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    df = descend(descend(df, "_key", leaves, "shard"), "_key", grown, "grown_shard")
    df = df.withColumn("_order", F.md5(F.concat_ws("|", "_key", "text_crc32", "size"))).withColumn("_bucket", F.substring("_order", 1, 3)).drop("_key")
    df = cut(df, "shards")
    sizes = df.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("n"))  # 4096 rows a shard
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_order", F.col("_id").asc_nulls_first())
    ranked = df.withColumn("_rank", F.row_number().over(inside) - 1).join(sizes, ["shard", "_bucket"])
    return ranked.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_rank")).cast("long").alias("slot"), "grown_shard")
