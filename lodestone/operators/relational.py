"""Joins, aggregates, rankings and set operations of the engine, each a plain DataFrame plan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package, written


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; Spark drops the others before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def ranked(df: DataFrame, keys: Sequence[str], *order: Column, name: str = "rank", first: int = 0) -> DataFrame:
    """A rank from ``first`` within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + first)


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in order, written once: ``_part`` numbers the ranges that Spark cuts by a sample, ``_place`` the rows.

    Rows that are equal in ``order`` keep one order from here on. A frequent key is many ranges if
    further columns of ``order`` tell its rows apart.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranges")


def prefix_offsets(df: DataFrame, key: str, size: str, name: str = "first", tie: str | None = None) -> DataFrame:
    """The sum of the sizes before each row, by ``key`` and ``tie``: sums of ranges first, then inside each.

    There are as many ranges as shuffle partitions, so no task holds all rows; only their sums, one
    row a range, meet in one task. Null sizes count as 0.
    """
    rows = in_ranges(df, key, *([tie] if tie else []))
    sums = rows.groupBy("_part").agg(F.coalesce(F.sum(size), F.lit(0)).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inside", inside).join(before, "_part").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_place", "_inside", "_before")


def exact_percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, str]) -> DataFrame:
    """(key, one column a share): of each key the least value that at least that share of its values do not exceed.

    ``shares`` gives names and shares as decimal text. Nulls do not count. Values are counted, sorted in ranges and
    summed up range by range, so a key's values are never in one task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_size"))
    summed = prefix_offsets(counted, key, "_size", "_first", value)
    totals = summed.groupBy(F.col(key).alias("_key")).agg(F.min("_first").alias("_start"), F.sum("_size").alias("_total"))
    joined = summed.join(totals, F.col(key).eqNullSafe(F.col("_key")))
    before = F.col("_first") - F.col("_start")

    def at(share: str) -> Column:
        part = Fraction(share)
        place = F.greatest(F.ceil(F.col("_total").cast("decimal(30,0)") * part.numerator / part.denominator), F.lit(1))
        return F.min(F.when((before < place) & (before + F.col("_size") >= place), F.col(value)))

    return joined.groupBy(key).agg(*[at(share).alias(name) for name, share in shares.items()])


def carried_batches(df: DataFrame, group: str, order: str, weight: str, most_weight: int, most_rows: int) -> DataFrame:
    """(group, order, batch): the rows of each group in order, in greedy batches numbered from 0.

    A batch closes before a row that would be its ``most_rows`` + 1st or exceed ``most_weight``; a row
    weighs at most ``most_weight``, a null weight counts as 0. Where a batch ends depends on where it
    began, so one group is a chain. Rows lie in sorted ranges, a large group in many. A range's
    first ``most_rows`` rows may belong to a batch that began before; for each number of such rows the
    range tells how many batches follow and what its last one holds. These few numbers a range are put
    together in one task, and each range then numbers its rows on its own.
    """
    kinds = dict(df.dtypes)
    clean = df.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.least(F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)), F.lit(most_weight)).cast("long").alias("_w"))
    rows = in_ranges(clean, "_g", "_o")

    def batches(weights: list[int], start: int) -> tuple[list[int], int, int, int]:
        """Where batches begin from ``start`` on, their number, and the rows and weight of the last."""
        begins, held, total = [], 0, 0
        for k in range(start, len(weights)):
            if not begins or held >= most_rows or total + weights[k] > most_weight:
                begins.append(k)
                held, total = 0, 0
            held, total = held + 1, total + weights[k]
        return begins, len(begins), held, total

    def tell(table: pa.Table) -> pa.RecordBatch:
        weights = table.column("_w").to_pylist()
        ends = [batches(weights, k)[1:] for k in range(min(most_rows, len(weights)) + 1)]
        row = {"_part": table.column("_part")[0].as_py(), "_g": table.column("_g")[0].as_py(), "n": len(weights), "head": weights[:most_rows], "ends": [list(e) for e in ends]}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("_part", pa.int32()), ("_g", table.schema.field("_g").type), ("n", pa.int64()), ("head", pa.list_(pa.int64())), ("ends", pa.list_(pa.list_(pa.int64())))]))

    def carry(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, batch, held, total = object(), 0, 0, 0
        for table in tables:
            out = []
            for r in table.to_pylist():
                if r["_g"] != name:
                    name, batch, held, total = r["_g"], 0, 0, 0
                taken = 0  # rows that still fit the open batch
                while held and taken < r["n"] and taken < len(r["head"]) and held < most_rows and total + r["head"][taken] <= most_weight:
                    held, total, taken = held + 1, total + r["head"][taken], taken + 1
                out.append((r["_part"], r["_g"], taken, batch))
                if taken < r["n"]:
                    more, held, total = r["ends"][taken]
                    batch += more
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], table.schema.field("_g").type), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())], names=["_part", "_g", "taken", "batch"])

    ship_package(df.sparkSession)
    told = rows.groupBy("_part", "_g").applyInArrow(lambda t: pa.Table.from_batches([tell(t.sort_by("_place"))]), f"_part int, _g {kinds[group]}, n long, head array<long>, ends array<array<long>>")
    told = written(told, "batch-ends")
    # only groups of several ranges are chained: at most one small row a range, and one more a group
    several = told.groupBy(F.col("_g").alias("_h")).count().where("count > 1")
    starts = told.join(several, F.col("_g").eqNullSafe(F.col("_h")), "left_semi").coalesce(1).sortWithinPartitions("_part", "_g").mapInArrow(carry, f"_part int, _g {kinds[group]}, taken long, batch long")
    starts = written(starts, "batches")

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        taken, batch, weights = table.column("taken")[0].as_py(), table.column("batch")[0].as_py(), table.column("_w").to_pylist()
        begins = set(batches(weights, taken)[0])
        at, out = batch - 1, []
        for k in range(len(weights)):
            at += k in begins
            out.append(at)
        return table.select(["_g", "_o"]).append_column("batch", pa.array(out, pa.int64()))

    first = starts.select(F.col("_part").alias("_p"), F.col("_g").alias("_h"), "taken", F.col("batch"))
    joined = rows.join(first, (F.col("_part") == F.col("_p")) & F.col("_g").eqNullSafe(F.col("_h")), "left").drop("_p", "_h").fillna(0, ["taken", "batch"])
    numbered = joined.groupBy("_part", "_g").applyInArrow(number, f"_g {kinds[group]}, _o {kinds[order]}, batch long")
    return numbered.select(F.col("_g").alias(group), F.col("_o").alias(order), "batch")


def first_wins(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in which an earlier table's row of a key hides the later ones."""
    rows = [t.withColumn("_order", F.lit(k)) for k, t in enumerate(tables)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return latest_per_key(out, [key], F.col("_order")).drop("_order")


def resolve_first(keys: DataFrame, key: str, lookups: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """The value of the first lookup (table, name column, value column) that knows the key."""
    out, values = keys, []
    for k, (table, name, value) in enumerate(lookups):
        known = table.groupBy(F.col(name).alias(key)).agg(F.min(value).alias(f"_v{k}"))
        out, values = out.join(known, key, "left"), [*values, F.col(f"_v{k}")]
    return out.withColumn("resolved", F.coalesce(*values)).drop(*[f"_v{k}" for k in range(len(lookups))])


def new_only(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return candidates.join(existing.select(key).distinct(), key, "left_anti")


def allowed_only(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def hydrate(results: DataFrame, table: DataFrame, key: str, number: str = "id") -> DataFrame:
    """Ranked results with their rows; ids that are not numbers are skipped."""
    numbered = results.withColumn("_id", F.col(key).try_cast("long")).where(F.col("_id").isNotNull())
    return numbered.join(table, F.col("_id") == table[number]).drop("_id")


def group_by_file(matches: DataFrame, limit: int, path: str = "path", seq: str = "seq") -> DataFrame:
    """Matches collected by file, files by first match, at most ``limit`` of them."""
    grouped = matches.groupBy(path).agg(F.min(seq).alias("first_seq"), F.array_sort(F.collect_list(F.struct(seq, "line", "content"))).alias("matches"))
    return grouped.orderBy("first_seq", path).limit(limit)


def as_of(rows: DataFrame, at: str, bounds: DataFrame, starts: str, value: str, keys: Sequence[str]) -> DataFrame:
    """The value of the last bound of the same keys that starts at or before each row.

    Rows and bounds are merged into one sorted stream of each key, so no pair of them is formed.
    """
    stream = rows.withColumns({"_t": F.col(at), "_v": F.lit(None).cast(dict(bounds.dtypes)[value]), "_row": F.lit(1)})
    marks = bounds.select(*keys, F.col(starts).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_row"))
    order = Window.partitionBy(*keys).orderBy("_t", "_row").rowsBetween(Window.unboundedPreceding, 0)
    filled = stream.unionByName(marks, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(order))
    return filled.where("_row = 1").withColumn(value, F.col("_last")).drop("_t", "_v", "_row", "_last")


#: A range reaches over at most so many bins of its level; each level's bins are so many times as wide.
FANOUT, LEVELS = 64, 7


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], low: str, high: str, other_low: str, other_high: str, width: int = 16, many: int = 100_000) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose ranges [low, high] and [other_low, other_high] of whole numbers meet.

    All columns of ``left``, then those of ``right`` but the keys. A point is a range of one number; ranges with
    a null or the wrong way round meet nothing.

    Ranges are cut into bins and pairs are found by equal bins, never by comparing all rows. A long range uses
    wider bins, so each is listed a bounded number of times; a pair meets on the wider level of the two, in the
    first bin that both have there, and so once. A bin with more than ``many`` left rows is dealt into parts, each
    of which meets the right rows.
    """

    def binned(rows: DataFrame, start: str, stop: str, side: str) -> DataFrame:
        size = F.col(stop) - F.col(start)
        level = reduce(lambda rest, n: F.when(size < width * FANOUT**n, F.lit(n)).otherwise(rest), range(LEVELS - 2, -1, -1), F.lit(LEVELS - 1))
        rows = rows.where(F.col(start) <= F.col(stop)).withColumn(f"_own_{side}", level)
        rows = rows.withColumn(f"_level_{side}", F.explode(F.sequence(F.col(f"_own_{side}"), F.lit(LEVELS - 1))))
        span = F.lit(width).cast("double") * F.pow(F.lit(float(FANOUT)), F.col(f"_level_{side}"))
        first, last = (F.floor(F.col(c) / span) for c in (start, stop))
        return rows.withColumn(f"_first_{side}", first).withColumn(f"_bin_{side}", F.explode(F.sequence(F.col(f"_first_{side}"), last)))

    mine = binned(left, low, high, "l")
    theirs = binned(right.withColumnsRenamed({k: f"_key_{k}" for k in keys}), other_low, other_high, "r")
    place = [*keys, "_level_l", "_bin_l"]
    crowded = mine.groupBy(*place).agg(F.count("*").alias("_n")).where(F.col("_n") > many).select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(place)], F.ceil(F.col("_n") / many).cast("int").alias("_parts"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_c{i}") for i, c in enumerate(place)])
    parts = F.coalesce("_parts", F.lit(1))
    mine = mine.join(crowded, same, "left").withColumn("_part_l", F.pmod(F.xxhash64(*[c for c in left.columns if not left.schema[c].dataType.simpleString().startswith("map")], F.lit("part")), parts))
    there = [*[f"_key_{k}" for k in keys], "_level_r", "_bin_r"]
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_c{i}") for i, c in enumerate(there)])
    theirs = theirs.join(crowded, same, "left").withColumn("_part_r", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))))
    met = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip([*place, "_part_l"], [*there, "_part_r"], strict=True)])
    once = (F.col("_level_l") == F.greatest("_own_l", "_own_r")) & (F.col("_bin_l") == F.greatest("_first_l", "_first_r"))
    pairs = mine.drop(*[f"_c{i}" for i in range(len(place))], "_parts").join(theirs.drop(*[f"_c{i}" for i in range(len(place))], "_parts"), met)
    pairs = pairs.where(once & (F.col(low) <= F.col(other_high)) & (F.col(other_low) <= F.col(high)))
    return pairs.select(*left.columns, *[c for c in right.columns if c not in keys])


def full_outer_buckets(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """Each id by whether both, one or none of two runs solved it."""
    both = left.select(key, F.col(flag).alias("_l")).join(right.select(key, F.col(flag).alias("_r")), key, "full_outer")
    l, r = (F.coalesce(F.col(c), F.lit(False)) for c in ("_l", "_r"))
    return both.select(key, F.when(l & r, "both").when(l, "left_only").when(r, "right_only").otherwise("neither").alias("bucket"))


def membership(flags: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """How many keys show each combination of flags."""
    return flags.groupBy(key).agg(*[F.max(c).alias(c) for c in columns]).groupBy(*columns).agg(F.count("*").alias("n"))


def rate(flag: Column) -> Column:
    """Share of rows with the flag; 0 without rows."""
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def completion_percent(done: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.least(F.greatest(done * 100.0 / total, F.lit(0.0)), F.lit(100.0)))


def status_rollup(rows: DataFrame, keys: Sequence[str], pending: DataFrame | None = None) -> DataFrame:
    """State of each key from its task rows (state, updated_at, error) and pending queue entries.

    Active work comes first, then a queue, then failures (a majority of successes softens them to
    completed_with_errors), then success; nothing at all is pending.
    """
    state = F.col("state")
    active, failed, done = state.isin("started", "in_progress"), state == "failed", state.isin("completed", "skipped")
    latest = lambda test: F.max(F.when(test, F.col("updated_at")))
    totals = rows.groupBy(*keys).agg(
        F.count_if(active).alias("_active"), F.count_if(failed).alias("_failed"), F.count_if(done).alias("_done"),
        latest(active).alias("_active_at"), latest(failed).alias("_failed_at"), latest(done).alias("_done_at"),
        F.max_by(F.when(failed, F.col("error")), F.when(failed, F.struct("updated_at", "error"))).alias("_error"),
    )
    if pending is not None:
        totals = totals.join(pending.groupBy(*keys).agg(F.count("*").alias("_queued")), list(keys), "full_outer")
    else:
        totals = totals.withColumn("_queued", F.lit(0))
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("_active", "_failed", "_done", "_queued")}
    name = F.when(n["_active"] > 0, "in_progress").when(n["_queued"] > 0, "in_progress").when((n["_failed"] > 0) & (n["_done"] > n["_failed"]), "completed_with_errors").when(n["_failed"] > 0, "failed").when(n["_done"] > 0, "completed").otherwise("pending")
    broken = name.isin("completed_with_errors", "failed")
    at = F.when(n["_active"] > 0, F.col("_active_at")).when(broken, F.col("_failed_at")).when(name == "completed", F.col("_done_at"))
    return totals.select(*keys, name.alias("status"), F.when(broken, F.col("_error")).alias("message"), at.alias("at"))


def repository_summary(repos: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Repositories with a count of each kind of child, 0 where there is none."""
    out = repos
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def directory_hash(files: DataFrame, keys: Sequence[str], path: str, content: str) -> DataFrame:
    """First 40 hex digits of the SHA-256 over all (path, content), by path, of each group.

    Contents are hashed as they pass by, sorted by path, so a folder of any size needs no more memory
    than one batch of files. A digest over a folder's bytes is one chain, so a folder is one task.
    """
    names = [f"_k{n}" for n in range(len(keys))]
    kinds = dict(files.dtypes)
    rows = files.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(path).alias("_p"), F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary")).alias("_c"))
    dealt = rows.repartition(*names).sortWithinPartitions(*names, "_p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        group, total, kind = None, None, None
        row = lambda: pa.RecordBatch.from_arrays([*(pa.array([g], t) for g, t in zip(group, kind, strict=True)), pa.array([total.hexdigest()[:40]])], names=[*names, "hash"])
        for batch in batches:
            kind = [batch.column(n).type for n in range(len(names))]
            for *here, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total is None or here != group:
                    if total is not None:
                        yield row()
                    group, total = here, hashlib.sha256()
                total.update((name or "").encode())
                total.update(data)
        if total is not None:
            yield row()

    schema = ", ".join(f"{n} {kinds[k]}" for k, n in zip(keys, names, strict=True))
    return dealt.mapInArrow(run, f"{schema}, hash string").select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "hash")


def assign_priorities(items: DataFrame, keys: Sequence[str], order: Column, base: Column | int) -> DataFrame:
    """Falling priorities in steps of ten: base + 10 * (n - i) for the i-th of n."""
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(order)) - 1
    n = F.count("*").over(w)
    return items.withColumn("priority", (base if isinstance(base, Column) else F.lit(base)) + 10 * (n - i))


def reduce_union(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of the tables, columns by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
