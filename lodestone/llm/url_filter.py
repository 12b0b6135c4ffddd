"""URL filter by the ratio of two character language models, in SQL functions only.

URLs that a rule decides train two variable-order Markov models over characters, one of accepted
and one of rejected URLs. Each order is smoothed by the order below it, so a character is scored in
the longest context that its model knows. The score of a URL is the mean, over its characters, of
the log-likelihood difference, and the cut is calibrated on a histogram of the scores of URLs that
trained no model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host and its subdomains where the path starts with ``/path``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("com/en/", "block"),
    Rule("example.com/en/7", "allow"),
    Rule("net/de/", "allow"),
    Rule("example.net/de/8", "block"),
    Rule("org/es/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a text without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER), F.regexp_extract(whole, pattern, 2)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _gram_counts(urls: DataFrame, order: int) -> DataFrame:
    """(gram, a, r): counts among accepted and rejected URLs of all grams up to ``order``."""
    lengths = F.sequence(F.lit(1), F.lit(order))
    # a text shorter than a gram has none of that length
    grams = F.flatten(F.transform(lengths, lambda k: F.transform(F.slice(F.sequence(F.lit(1), F.length("u")), F.lit(1), F.greatest(F.length("u") - k + 1, F.lit(0))), lambda i: F.substring(F.col("u"), i, k))))
    rows = urls.select("accepted", F.explode(grams).alias("gram"))
    return rows.groupBy("gram").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))


def _windows(order: int) -> Column:
    """For each character of ``u`` after the start mark, it and up to ``order`` - 1 characters before it."""
    ends = F.sequence(F.lit(2), F.length("u"))
    return F.transform(ends, lambda i: F.substring(F.col("u"), F.greatest(i - (order - 1), F.lit(1)), F.least(i, F.lit(order))))


def _values(windows: DataFrame, counts: DataFrame, order: int, smoothing: float) -> DataFrame:
    """(gram, n, value) of all windows: log P_accepted - log P_rejected of the last character after the others.

    P of a character after a context is (count of both + smoothing * P after the context without its
    first character) / (count of the context + smoothing), from the context of no character, below
    which all characters are alike. So a character that a context never had costs what the context
    escapes with, which differs between the models, and an unknown context says what its end says.

    Ends of windows are scored from the shortest to the longest, so a join key has at most as many
    rows as there are characters.
    """
    context = F.substring(F.col("gram"), F.lit(1), F.length("gram") - 1).alias("context")
    totals = counts.groupBy(context, F.length("gram").alias("k")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
    below, out = None, None
    for k in range(1, order + 1):
        ends = windows.where(F.length("gram") >= k).select(F.substring(F.col("gram"), -k, k).alias("gram")).distinct()
        here = ends.select("gram", F.substring("gram", 1, k - 1).alias("context"), F.substring(F.col("gram"), 2, max(k - 1, 0)).alias("suffix"))
        here = here.join(counts.where(F.length("gram") == k), "gram", "left").join(totals.where(F.col("k") == k).drop("k"), "context", "left")
        here = here.withColumns({"qa": F.lit(1 / 256), "qr": F.lit(1 / 256)}) if below is None else here.join(below, "suffix")
        n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("a", "r", "ca", "cr")}
        pa, pr = ((n[x] + smoothing * F.col(q)) / (n[c] + smoothing) for x, q, c in (("a", "qa", "ca"), ("r", "qr", "cr")))
        here = here.select("gram", pa.alias("pa"), pr.alias("pr"))
        below = here.select(F.col("gram").alias("suffix"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        out = here if out is None else out.unionByName(here)
    # in steps of 2^-36, so that sums do not depend on the order of their terms
    value = F.rint((F.log("pa") - F.log("pr")) * 2.0**36) / 2.0**36
    return windows.join(out, "gram").select("gram", "n", value.alias("value"))


def _totals(urls: DataFrame, values: DataFrame, order: int, slots: int) -> DataFrame:
    """(id, total): the sum of the values of all windows of a URL; windows of value 0 may be left out."""
    pieces = urls.select("id", F.explode(_windows(order)).alias("gram"))
    often = F.col("n") * slots > values.agg(F.sum("n")).scalar()
    hot, rare = values.where(often).select("gram", "value"), values.where(~often).select("gram", "value")
    found = pieces.join(F.broadcast(hot), "gram").groupBy("id").agg(F.sum("value").alias("total"))
    others = pieces.join(F.broadcast(hot), "gram", "left_anti").join(rare.where("value <> 0"), "gram").groupBy("id").agg(F.sum("value").alias("total"))
    return found.unionByName(others).groupBy("id").agg(F.sum("total").alias("total"))


def _cut(scored: DataFrame, bins: int, span: float) -> Column:
    """The score that parts accepted from rejected URLs best: the cut below which the most rejected and the fewest accepted ones lie.

    It is found on the rows of the fold that trained no model, if these are of both kinds, else on all.
    """
    bin_of = F.least(F.greatest(F.floor((F.col("score") + span) / (2 * span) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    allowed, blocked = F.col("ruled") == "allow", F.col("ruled") == "block"
    histogram = scored.where(F.col("ruled").isNotNull() & F.col("score").isNotNull()).groupBy(bin_of.alias("bin")).agg(
        F.count_if(allowed).alias("all_a"), F.count_if(blocked).alias("all_r"), F.count_if(allowed & F.col("kept_out")).alias("out_a"), F.count_if(blocked & F.col("kept_out")).alias("out_r"))
    upto, everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = {c: F.sum(c).over(everything) for c in ("all_a", "all_r", "out_a", "out_r")}
    both = (total["out_a"] > 0) & (total["out_r"] > 0)
    below = {c: F.coalesce(F.sum(c).over(upto), F.lit(0)) / F.nullif(total[c], F.lit(0)) for c in total}
    # cutting below a bin allows it and all above: accepted from there on, rejected below
    share = F.when(both, below["out_r"] - below["out_a"]).otherwise(below["all_r"] - below["all_a"])
    best = histogram.select("bin", share.alias("gain")).where(F.col("gain").isNotNull()).agg(F.max_by("bin", F.struct("gain", -F.col("bin"))).alias("bin"))
    return best.select((F.col("bin") / bins * 2 * span - span).alias("cut")).scalar()


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = 4, smoothing: float = 4.0, folds: int = 5, slots: int = 1 << 16, bins: int = 512) -> DataFrame:
    """Judge every URL: page_id, host, path, rule, verdict, score.

    A rule's verdict stands; other URLs are allowed if their score (length-normalised
    log-likelihood difference, from the text after ``://``, A-Z lower-cased) reaches the
    calibrated cut. Null urls and urls without ``://`` have no host, path or score and are
    allowed, as all URLs are when the rules decide none or only one kind. Repeated rows are
    judged alike and each kept; an empty table gives an empty result; other columns are ignored.

    URLs that a rule decides train the two models, but for one in ``folds`` of them, chosen by a hash of
    the URL, on which the cut is calibrated. The models have every gram of their URLs, under its own
    text. A URL's grams meet them by join: those that are more than one in ``slots`` of all, at most
    ``slots`` of them, are broadcast, all others are shuffled, so no key of the shuffle is frequent.
    ``slots`` does not change results.
    """
    host, path = split_url(F.col("url"))
    text, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rest = F.translate(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?s)^.*?://(.*)$", 1), UPPER, LOWER)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), F.concat(F.lit("^"), rest, F.lit("$")).alias("u")).withColumns({"rule": text, "ruled": verdict})
    judged = judged.withColumn("kept_out", F.pmod(F.xxhash64("u"), F.lit(folds)) == 0)
    scratch = Scratch()
    # written once, so that ids stay
    judged = scratch(judged.withColumn("id", F.monotonically_increasing_id()), "url-rows")
    training = judged.where(F.col("ruled").isNotNull() & ~F.col("kept_out")).select((F.col("ruled") == "allow").alias("accepted"), "u")
    counts = scratch(_gram_counts(training, order), "url-grams")
    known = judged.where(F.col("u") != F.lit("^$")).select("id", "u")
    windows = scratch(known.select(F.explode(_windows(order)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "url-windows")
    values = scratch(_values(windows, counts, order, smoothing), "url-values")

    score = F.when(F.col("u") != F.lit("^$"), F.coalesce("total", F.lit(0.0)) / (F.length("u") - 1))
    scored = judged.join(_totals(known, values, order, slots), "id", "left").withColumn("score", score)
    scored = scratch.finish(scored.select("page_id", "host", "path", "rule", "ruled", "kept_out", "score"), "url-scores")
    learned = F.when(F.col("score") < F.col("cut"), "block").otherwise("allow")
    return scored.withColumn("cut", _cut(scored, bins, 4.0)).select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score")
