"""Which filter removes what, in every order: an audit of filters that overlap.

Words are rows: texts are exploded, (document, word) and then document are aggregated to totals and
distinct words, and the flags of the other filters are joined to them. A document's failures are then
one of 32 sets, and 32 conditional counts a part (and as many of good and of toxic documents) hold all
that the 120 orders of the five filters can say; no order is run over documents again.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: What separates words, and the characters that filter D looks for.
BLANKS, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"


def word_totals(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_distinct of each different (doc_id, text) that has words.

    Repeated rows are combined before anything is shuffled. What is shuffled are whole texts, by (doc_id, hash),
    which takes less room than their words; these are then exploded and aggregated where they are, as
    (document, word) and document both lie inside that partitioning.
    """
    texts = docs.where("text <> ''").groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.first("text").alias("text"))
    words = texts.select("doc_id", "text_hash", F.explode(F.split("text", BLANKS)).alias("word")).where("word <> ''")
    counted = words.groupBy("doc_id", "text_hash", "word").agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, n, A to E, good, toxic: rows that agree in id, text and part once, with their number ``n``."""
    text = F.coalesce("text", F.lit(""))
    flags = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_hash"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        (F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 2).alias("C"),
        text.rlike(SIGNS).alias("D"),
    )
    flags = scratch(flags.groupBy(*flags.columns).agg(F.count("*").alias("n")), "audit-flags")
    least = scratch(flags.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")), "audit-texts")
    flags = join_groups(flags, least, "digest", "doc_id")
    totals = scratch(word_totals(docs), "audit-words").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_words", "n_distinct")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_labelled")).agg(*[F.max(F.coalesce(F.col(x) == 1, F.lit(False))).alias(y) for x, y in (("quality", "good"), ("toxic", "toxic"))])
    whole = flags.join(totals, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    whole = whole.join(scratch(marks, "audit-labels"), F.col("doc_id") == F.col("_labelled"), "left")
    return whole.select(
        "part",
        "n",
        (F.coalesce("n_words", F.lit(0)) < 200).alias("A"),
        F.coalesce(F.col("n_distinct") * 100 < F.col("n_words") * 50, F.lit(False)).alias("B"),
        "C",
        "D",
        F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)).alias("E"),
        *[F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "toxic")],
    )


def _sum_where(counts: str, keeps) -> Column:
    """The sum of an array of counts over the sets of failures that ``keeps`` chooses."""
    chosen = F.filter(F.sequence(F.lit(0), F.lit(SETS - 1)), keeps)
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda total, s: total + F.get(F.col(counts), s))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters: A fewer than 200 words; B fewer than half of the words distinct; C more than 2 % capitals A-Z;
    D one of ``#$%&*|``; E the text of a smaller doc_id. Each part (value of ``source``, null as the empty
    string) has 600 rows: every order of the five and every step of it.

    A null text counts as empty, and fails A. A null doc_id is no smaller id and has none; it has no labels.
    Repeated rows count one by one, and each text of a repeated id is judged alone. An id is good or
    toxic if any of its label rows says 1. Empty ``docs`` give an empty result; other columns are ignored.

    The texts are scanned twice, and each different (doc_id, text) is shuffled once; what else is shuffled are
    narrow rows. A group of copies of any size meets its least id in parts, and counts are combined before
    they are shuffled.
    """
    scratch = Scratch()
    rows = failures(docs, labels, scratch)
    failing = sum((F.when(F.col(f), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.select("part", "n", "good", "toxic", failing.alias("s"))
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = rows.groupBy("part").agg(*[F.sum(F.when((F.col("s") == s) & is_kind, F.col("n")).otherwise(F.lit(0))).alias(f"{kind}_{s}") for kind, is_kind in kinds.items() for s in range(SETS)])
    sums = scratch(sums.select("part", *[F.array(*[F.col(f"{kind}_{s}") for s in range(SETS)]).alias(f"n_{kind}") for kind in kinds]), "audit-counts")

    # (order, step, filters that ran before, this filter) of each step of each order
    steps = [(("".join(o)), k + 1, sum(1 << FILTERS.index(f) for f in o[:k]), 1 << FILTERS.index(o[k])) for o in permutations(FILTERS) for k in range(len(o))]
    listed = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(before).alias("before"), F.lit(own).alias("own")) for o, k, before, own in steps])
    each = sums.withColumn("_step", F.explode(listed)).select("*", "_step.*")
    before, own = F.col("before"), F.col("own")
    fails = lambda s: s.bitwiseAND(own) != 0
    earlier = lambda s: s.bitwiseAND(before) != 0
    removed = lambda s: fails(s) & ~earlier(s)
    counts = each.select(
        "part",
        "filter_order",
        "step",
        _sum_where("n_all", lambda s: s.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        _sum_where("n_all", removed).alias("removed"),
        _sum_where("n_all", lambda s: fails(s) & earlier(s)).alias("redundant"),
        _sum_where("n_all", lambda s: s == own).alias("unique_fails"),
        _sum_where("n_good", removed).alias("good_lost"),
        _sum_where("n_toxic", removed).alias("toxic_lost"),
        own.alias("own"),
    )
    counts = scratch(counts, "audit-steps")
    shares = counts.groupBy(F.col("part").alias("_part"), F.col("own").alias("_own")).agg(F.sum("removed").alias("shapley"))
    out = counts.join(shares, (F.col("part") == F.col("_part")) & (F.col("own") == F.col("_own"))).drop("_part", "_own", "own")
    return scratch.finish(out, "audit")
