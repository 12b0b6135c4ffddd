"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, drop_materialized, join_groups, materialize, merge

#: Links that one task joins by union-find: 16 MB. More are joined by shuffles, with the same result.
ONE_TASK = 1_000_000


def components(edges: DataFrame, one_task: int = ONE_TASK, scratch: Scratch | None = None) -> DataFrame:
    """From links (a, b) to (node, component): the smallest id reachable from each linked node.

    Up to ``one_task`` links, counted first, one executor task joins them. Beyond, rounds of
    shuffles repeat until the links form stars. A round only takes minima by node and joins, so a
    node with very many links is combined before it is shuffled and its join can be split. The links
    never leave the cluster.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    scratch = scratch or Scratch()
    links = materialize(links, "links")
    if links.count() <= one_task:
        scratch.tables.append(links)
        return links.coalesce(1).mapInArrow(_join_all, "node long, component long")
    links = links.distinct()
    state = None
    while True:
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small-star on links that lead from the larger to the smaller node
        large = large.union(links.groupBy("a").agg(F.min("b").alias("b"))).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        joined = large.join(small_least, F.col("a") == F.col("u"))
        small = joined.select(F.col("b").alias("x"), "m").union(joined.select(F.col("a").alias("x"), "m")).where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()
        previous, links = links, materialize(small, "links")
        drop_materialized(previous)
    scratch.tables.append(links)
    stars = links.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return stars.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def named(edges: DataFrame, nodes: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """(node, *order) of each linked node: the least values of ``order`` among the nodes it is linked with.

    ``nodes`` holds node and the columns of ``order``; edges (a, b) are of nodes.
    """
    linked = scratch(components(edges, scratch=scratch).join(nodes.select("node", *order), "node"), "labels")
    least = linked.groupBy("component").agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_least")).select("component", "_n", "_least.*")
    return join_groups(linked.select("node", "component"), scratch(least, "least"), "component", "node").select("node", *order)


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, position = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    merge(label, position[: len(a)], position[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], names=["node", "component"])
