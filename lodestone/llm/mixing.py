"""Mixing sources to target weights by hash-threshold histograms.

Sources share the words of the whole table by weight; a target stops at ``max_epochs`` times
its source's size and the excess goes to the others by weight. A source whose target is k whole
passes and a rest takes every document k times, and once more the documents whose hash lies
below a threshold. Thresholds come from histograms of words by (source, hash bucket): the
bucket in which the budget runs out is split by the next bits of the hash, level by level, so
nothing is sorted and only one bucket of each source is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Words, as the contract of the mix counts them.
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12


def _hash(doc_id: str) -> Column:
    return _hash_of(F.col(doc_id))


def _hash_of(doc_id: Column) -> Column:
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """From (source, source_size) to (source, source_size, target); one row a source.

    Sources by code point, null last, get ``weights`` in turn. The water level is the largest of
    (words left) / (weight left) after capping the sources in the order of cap / weight.
    """
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1)
    rows = sizes.select("source", "source_size", pick.alias("w"), (F.col("source_size") * max_epochs).cast("double").alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = rows.select("*", (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))).alias("words_left"), (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(order), F.lit(0.0))).alias("weight_left"))
    level = F.max(F.col("words_left") / F.col("weight_left")).over(everything)
    return left.select("source", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def _cuts(docs: DataFrame, weights: tuple[float, ...], max_epochs: int) -> tuple[DataFrame, DataFrame, int]:
    """Sized rows; each source's passes and hash threshold, one row a source; the threshold's bits."""
    sized = materialize(docs.select("doc_id", "source", _size("text").alias("size"), _hash("doc_id").alias("h")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = source_targets(sizes, weights, max_epochs).withColumn("passes", passes)
    state = state.select("source", "source_size", "target", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.col("source_size").alias("inside"))
    state, bits = materialize(state, "mix-state"), 0
    while bits < HASH_BITS:
        bits += LEVEL_BITS
        state, most = _refine(sized, state, bits)
        if most <= 1:
            break
    nearer = (F.col("before") + F.col("inside") - F.col("rest")) < (F.col("rest") - F.col("before"))
    return sized, materialize(state.select(F.col("source").alias("_mix_source"), "source_size", "target", "passes", "prefix", nearer.alias("nearer")), "mix-cuts"), bits


def _size(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def _copies(h: Column, size: Column, cuts: DataFrame, bits: int) -> Column:
    bucket = F.shiftright(h, HASH_BITS - bits)
    extra = F.when((bucket < cuts["prefix"]) | ((bucket == cuts["prefix"]) & cuts["nearer"]), 1).otherwise(0)
    return F.when(size > 0, cuts["passes"] + extra).otherwise(F.lit(0)).cast("long")


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies, taken.

    Null texts have size 0, documents of size 0 are never taken; a null source is a source of its
    own. The hash depends on doc_id alone, so reruns agree and repeated ids are taken alike. The
    document (or ids of one hash) in which a budget runs out is taken if that brings the source
    nearer to its target. An empty table gives an empty result. Other columns are ignored.

    The thresholds are one row a source and join as a written table, which Spark broadcasts only
    if its files are below the session's threshold.
    """
    sized, cuts, bits = _cuts(docs, weights, max_epochs)
    joined = sized.join(cuts, sized["source"].eqNullSafe(cuts["_mix_source"]))
    rows = joined.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("h"), F.col("size"), cuts, bits).alias("copies"))
    return rows.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as :func:`plan_mix` takes it, all columns kept.

    The texts themselves are not shuffled: a row's copies follow from its own hash and its
    source's threshold.
    """
    _, cuts, bits = _cuts(docs, weights, max_epochs)
    joined = docs.join(cuts, docs["source"].eqNullSafe(cuts["_mix_source"]))
    copies = _copies(_hash_of(docs["doc_id"]), F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)), cuts, bits)
    return joined.withColumn("_mix_copies", copies).where("_mix_copies > 0").withColumn("_mix_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*[docs[f"`{c}`"] for c in docs.columns])


def _refine(sized: DataFrame, state: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """Split each source's boundary bucket by the next bits; also the most documents in one."""
    at = state.select(F.col("source").alias("s"), "source_size", "target", "passes", "rest", "prefix", "before")
    bucket = F.shiftright("h", HASH_BITS - bits)
    hit = sized.where("size > 0").join(at, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", HASH_BITS - bits + LEVEL_BITS) == F.col("prefix")))
    sums = hit.groupBy("s", "source_size", "target", "passes", "rest", "before", bucket.alias("bucket")).agg(F.sum("size").alias("inside"), F.count("*").alias("n"))
    order = Window.partitionBy("s").orderBy("bucket")
    sums = sums.withColumn("upto", F.col("before") + F.sum("inside").over(order))
    first = sums.where(F.col("upto") > F.col("rest")).withColumn("k", F.row_number().over(order)).where("k = 1")
    out = materialize(first.select(F.col("s").alias("source"), "source_size", "target", "passes", "rest", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("inside")).alias("before"), "inside", "n"), "mix-state")
    # sources without words have no bucket and keep the state in which nothing is taken
    empty = state.where("source_size = 0").select(*[c for c in out.columns if c != "n"], F.lit(0).cast("long").alias("n"))
    return out.unionByName(empty), out.agg(F.max("n")).first()[0] or 0
