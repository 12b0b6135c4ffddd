"""Event-time windows with watermarks, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, at: str, late: str) -> DataFrame:
    """A stream needs an instant and a watermark; a table only the instant."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, late) if events.isStreaming else rows


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], aggs: dict[str, Column], late: str = "1 hour") -> DataFrame:
    return watermarked(events, at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()]).select("w.start", "w.end", *keys, *aggs)


def sliding(events: DataFrame, at: str, width: str, step: str, keys: list[str], aggs: dict[str, Column], late: str = "1 hour") -> DataFrame:
    return watermarked(events, at, late).groupBy(F.window(at, width, step).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()]).select("w.start", "w.end", *keys, *aggs)


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], aggs: dict[str, Column], late: str = "1 hour") -> DataFrame:
    return watermarked(events, at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()]).select("w.start", "w.end", *keys, *aggs)


def deduplicated(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    rows = watermarked(events, at, late)
    return rows.dropDuplicatesWithinWatermark(keys) if events.isStreaming else rows.dropDuplicates(keys)



def within(left: DataFrame, right: DataFrame, keys: list[str], at: str, other_at: str, most: str, late: str = "1 hour") -> DataFrame:
    """Pairs of equal ``keys`` where the right row comes at most ``most`` after the left one.

    Over two streams each side waits under its watermark: late rows are left out, and rows that no row to come
    can meet any more leave the state.
    """
    renamed = {k: f"_{k}" for k in keys}
    mine, theirs = watermarked(left, at, late), watermarked(right.withColumnsRenamed(renamed), other_at, late)
    met = (F.col(other_at) >= F.col(at)) & (F.col(other_at) <= F.col(at) + F.expr(f"INTERVAL {most}"))
    for k in keys:
        met = (F.col(k) == F.col(f"_{k}")) & met
    return mine.join(theirs, met).drop(*renamed.values())
