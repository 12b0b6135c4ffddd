"""Sharding by a hierarchical weighted hash tree.

The topology is a tree of regions, racks and shards. A row descends level by level; at each
node every child draws ``-ln(u) / weight`` from a hash of (key, child), and the smallest draw
wins, so a child gets rows in proportion to its weight. A child's draw depends only on its own
weight: when a weight rises, rows move only into that child; all other subtrees keep theirs.
:func:`grown` therefore opens a subtree of its own for a new shard, and rows move only into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def balanced(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> tuple[Leaf, ...]:
    """A tree of ``shards`` equal leaves."""
    return tuple(Leaf(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(shards))


def grown(leaves: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """The same tree with one more shard in a region of its own; no old weight changes."""
    return (*leaves, Leaf(1 + max(x.region for x in leaves), 1 + max(x.rack for x in leaves), 1 + max(x.shard for x in leaves), weight))


def _winner(key: Column, level: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = []
    for child, weight in weights.items():
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}:{child}")), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(child).alias("child")))
    return F.least(*draws)["child"]


def descend(key: Column, leaves: tuple[Leaf, ...]) -> Column:
    """The shard of ``key``: weighted draws at the region, rack and shard level."""

    def total(level: str, among: list[Leaf]) -> dict[int, float]:
        out: dict[int, float] = {}
        for x in among:
            out[getattr(x, level)] = out.get(getattr(x, level), 0.0) + x.weight
        return out

    def step(levels: tuple[str, ...], among: list[Leaf]) -> Column:
        level, *below = levels
        weights = total(level, among)
        won = _winner(key, level, weights)
        if not below:
            return won
        out = None
        for child in weights:
            inner = step(tuple(below), [x for x in among if getattr(x, level) == child])
            out = F.when(won == child, inner) if out is None else out.when(won == child, inner)
        return out

    return step(("region", "rack", "shard"), [x for x in leaves if x.weight > 0])


def shard_documents(docs: DataFrame, leaves: tuple[Leaf, ...] = balanced(8), rows_per_chunk: int = 4096) -> DataFrame:
    """Deal documents to the leaves of the tree and number the rows of each shard.

    Returns doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard after
    :func:`grown`). The key is the doc_id as text (null: the empty text), so repeated ids share
    a shard. Null texts count as empty: size 1, crc32 0. Slots number each shard's rows from 0
    without gaps; they follow a hash chunk, then doc_id and text_crc32; equal rows get
    neighbouring slots. An empty table gives an empty result; other columns are ignored.

    The texts are read once, and only narrow rows are shuffled, dealt by (shard, chunk) with about
    ``rows_per_chunk`` rows or the square root of the row count in each, so no shard is one task. Equal
    rows share a chunk; one with more than twice the rows it should have is dealt further by row number.
    The offsets of the chunks come from counts, not from rows.
    """
    n = docs.count()
    target = max(rows_per_chunk, int(n**0.5))
    chunks, scratch = max(1, n // target), Scratch()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, leaves).cast("int").alias("shard"),
        descend(key, grown(leaves)).cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = scratch(rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("slot")), F.lit(chunks))), "shard-rows")
    crowded = rows.groupBy(F.col("shard").alias("_shard"), F.col("chunk").alias("_chunk")).count().where(F.col("count") > 2 * target)
    crowded = scratch(crowded.select("_shard", "_chunk", F.ceil(F.col("count") / target).alias("_parts")), "shard-crowded")
    dealt = rows.join(small(crowded), (F.col("shard") == F.col("_shard")) & (F.col("chunk") == F.col("_chunk")), "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("_parts")), F.lit(0))).drop("_shard", "_chunk", "_parts")
    counts = dealt.groupBy("shard", "chunk", "part").count()
    before = Window.partitionBy("shard").orderBy("chunk", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch(counts.select("shard", "chunk", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")), "shard-offsets")
    inside = Window.partitionBy("shard", "chunk", "part").orderBy("doc_id", "text_crc32", "row")
    numbered = dealt.withColumn("place", F.row_number().over(inside) - 1)
    out = numbered.join(small(offsets), ["shard", "chunk", "part"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard")
    return scratch.finish(out, "sharded")
