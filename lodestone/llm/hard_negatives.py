"""Hard negatives for contrastive training, by dual-tree search.

Anchors and candidates are dealt into trees of their own: a top tree of cells from a bounded sample, under
each cell pieces of bounded size, and inside a piece a tree down to leaves. Every node has a centre and a
radius, so the inner products of all pairs under two nodes lie in an interval. A pair of nodes is dropped for
a whole group of anchors at once if its interval misses what every anchor of the group still looks for; pairs
of leaves that stay are scored exactly. A first pass over the most promising pieces tells how good a score
must be, a second one over all others needs no more than the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, by_batch, by_group, join_groups

#: Rows and bytes of the sample that the top trees are fitted to.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 1 << 25
#: Sampled rows in a cell of the candidates' tree at least; rows of a piece and of a group of anchors, and of their leaves.
CELL, PIECE, GROUP, LEAF, ANCHOR_LEAF = 64, 2048, 128, 32, 8
#: Cells whose first pieces tell how good a score must be, and groups that meet a piece in one task.
SEEDS, TOGETHER = 4, 64
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: What is sought in a group: its window number, the anchor's place, the scores allowed, the k-th best so far, the positive.
SOUGHT = np.dtype([("no", "<i4"), ("anchor", "<i4"), ("low", "<i8"), ("high", "<i8"), ("best", "<i8"), ("positive_id", "<i8"), ("positive_score", "<i8")])


def halves(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
    """A direction, a cut and which rows lie below it: about half of them; None if nearly all rows are equal along it."""
    apart = x - x.mean(axis=0)
    far = apart[int((apart**2).sum(axis=1).argmax())]
    for _ in range(3):
        if not (norm := np.sqrt((far**2).sum())):
            return None
        far = apart.T @ (apart @ (far / norm))
    if not (norm := np.sqrt((far**2).sum())):
        return None
    way = far / norm
    along = x @ way
    cut = float(np.median(along))
    below = along < cut
    if not below.any():
        below = along <= cut
        cut = float(np.nextafter(cut, np.inf))
    return (way, cut, below) if len(x) <= 64 * min(below.sum(), (~below).sum()) else None


@dataclass
class TopTree:
    """Cuts of a binary tree; cells are its leaves, with the centres of the sampled rows in them."""

    ways: np.ndarray
    cuts: np.ndarray
    below: np.ndarray
    above: np.ndarray
    centres: np.ndarray

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row; a child less than 0 is the cell -1 - child."""
        at = np.zeros(len(x), dtype=np.int64) if len(self.cuts) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            low = np.einsum("ij,ij->i", x[inner], self.ways[node]) < self.cuts[node]
            at[inner] = np.where(low, self.below[node], self.above[node])
        return -1 - at


def fit_tree(x: np.ndarray, rows: int) -> TopTree:
    """A tree over sampled rows whose cells have at most ``rows`` of them, unless these are equal."""
    ways, cuts, children, centres = [], [], [], []
    # parts to be cut, and which side of which cut they are
    parts: list[tuple[np.ndarray, list[int], int]] = [(x, [0], 0)]
    while parts:
        part, of, side = parts.pop()
        if len(part) > rows and (cut := halves(part)):
            of[side] = len(cuts)
            ways.append(cut[0])
            cuts.append(cut[1])
            children.append(own := [0, 0])
            parts += [(part[~cut[2]], own, 1), (part[cut[2]], own, 0)]
            continue
        centres.append(part.mean(axis=0))
        of[side] = -len(centres)
    kids = np.array(children, dtype=np.int64).reshape(-1, 2)
    return TopTree(np.array(ways).reshape(len(cuts), x.shape[1]), np.array(cuts), kids[:, 0], kids[:, 1], np.array(centres))


def _leaves(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of a tree's leaves, and where each leaf begins and the last one ends."""
    order, sizes, open_parts = [], [], [np.arange(len(x))]
    while open_parts:
        part = open_parts.pop()
        if len(part) > most and (cut := halves(x[part])):
            open_parts += [part[~cut[2]], part[cut[2]]]
            continue
        # equal rows are alike for every bound, so they may be cut anywhere
        for at in range(0, len(part), most):
            order.append(part[at : at + most])
            sizes.append(len(order[-1]))
    return np.concatenate(order), np.concatenate([[0], np.cumsum(sizes)])


class Block:
    """A piece of candidates or a group of anchors: vectors, ids, labels, row numbers, leaves, and what is sought."""

    def __init__(self, row: dict) -> None:
        self.ids, self.labels, self.nodes, self.starts = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "labels", "nodes", "starts"))
        self.x = np.frombuffer(row["vectors"], dtype=np.float64 if row["wide"] else np.float32)
        self.x = self.x.reshape(len(self.ids), len(self.x) // len(self.ids))
        self.sought = np.frombuffer(row["sought"] or b"", dtype=SOUGHT)
        rows = self.x.astype(np.float64)
        sizes = np.diff(self.starts)
        self.centres = np.add.reduceat(rows, self.starts[:-1], axis=0) / sizes[:, None]
        far = np.sqrt(((rows - np.repeat(self.centres, sizes, axis=0)) ** 2).sum(axis=1))
        self.radii = np.maximum.reduceat(far, self.starts[:-1])
        self.longest = float(np.sqrt((rows**2).sum(axis=1).max(initial=0)))


def usable(rows: DataFrame, anchor: Column, scale: int) -> DataFrame:
    """vec_id, label, anchor, dim, wide, v of the rows that take part: floor(scale * x) of each component, as whole numbers.

    Numbers are kept in single precision where that is exact, in double precision (``wide``) elsewhere.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, vectors, labels, anchors = batch.columns
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.fill_null(pc.list_flatten(vectors).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
        there = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in (ids, vectors, labels)])
        starts, data, wide, keep = np.cumsum(sizes) - sizes, [], [], []
        for k in np.flatnonzero(there).tolist():
            v = flat[starts[k] : starts[k] + sizes[k]]
            if np.isfinite(v).all():
                whole = np.floor(scale * v)
                wide.append(bool(np.abs(whole).max(initial=0) > 1 << 24))
                data.append(whole.astype(np.float64 if wide[-1] else np.float32).tobytes())
                keep.append(k)
        kept = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays(
            [ids.take(kept), labels.take(kept), pc.fill_null(anchors.take(kept), False), pa.array(sizes[keep], pa.int64()), pa.array(wide, pa.bool_()), pa.array(data, pa.binary())],
            names=["vec_id", "label", "anchor", "dim", "wide", "v"],
        )

    chosen = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"), anchor.alias("anchor"))
    return chosen.mapInArrow(by_batch(run), "vec_id long, label long, anchor boolean, dim long, wide boolean, v binary")


def _matrix(wide: list[bool], data: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(data), dim))
    for k, (w, d) in enumerate(zip(wide, data, strict=True)):
        out[k] = np.frombuffer(d, dtype=np.float64 if w else np.float32)
    return out


def intervals(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of any two rows under nodes of centres a, b and radii ra, rb."""
    na, nb = np.sqrt((a**2).sum(axis=1)), np.sqrt((b**2).sum(axis=1))
    middle = a @ b.T
    # a little more than exact arithmetic needs, so that rounding never drops a pair
    slack = (na[:, None] * rb + ra[:, None] * (nb + rb)) * (1 + 1e-9) + 1e-9 * (1 + na[:, None] * nb)
    return middle - slack, middle + slack


def _scores(x: np.ndarray, y: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of whole numbers: the narrowest arithmetic in which no partial sum is rounded."""
    if largest < 1 << 24:
        return (x.astype(np.float32) @ y.astype(np.float32).T).astype(np.int64)
    if largest < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape) @ np.array([[int(v) for v in r] for r in y.tolist()], dtype=object).reshape(y.shape).T
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


def search(group: Block, piece: Block, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, candidate, score): the best ``k`` of the piece for each of the group's windows, ties by smaller id.

    ``same``: candidates of the anchor's label, without the anchor's own row; else of other labels.
    """
    sought = group.sought
    least = np.maximum(sought["low"], sought["best"])
    leaf = np.searchsorted(group.starts, sought["anchor"], side="right") - 1
    low, high = intervals(group.centres, group.radii, piece.centres, piece.radii)
    largest = group.longest * piece.longest * (1 + 1e-6)
    found = []
    for at in np.unique(leaf).tolist():
        own = np.flatnonzero(leaf == at)
        alive = np.flatnonzero((high[at] >= least[own].min()) & (low[at] <= sought["high"][own].max()))
        if not len(alive):
            continue
        rows = np.concatenate([np.arange(piece.starts[i], piece.starts[i + 1]) for i in alive])
        anchors = np.arange(group.starts[at], group.starts[at + 1])
        score = _scores(group.x[anchors], piece.x[rows], largest)
        allowed = group.labels[anchors][:, None] == piece.labels[rows]
        allowed = allowed & (group.nodes[anchors][:, None] != piece.nodes[rows]) if same else ~allowed
        mine = sought["anchor"][own] - anchors[0]
        good = allowed[mine] & (score[mine] <= sought["high"][own, None]) & (score[mine] >= least[own, None])
        if len(rows) > k:
            held = np.where(good, score[mine], _LEAST)
            good &= held >= np.partition(held, len(rows) - k, axis=1)[:, len(rows) - k, None]
        w, c = np.nonzero(good)
        found.append((own[w], rows[c], score[mine[w], c]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    window, row, score = (np.concatenate(f) for f in zip(*found, strict=True))
    order = np.lexsort((piece.ids[row], -score, window))
    window, row, score = window[order], row[order], score[order]
    first = np.searchsorted(window, window)
    best = np.arange(len(window)) - first < k
    return window[best], row[best], score[best]


_PAYLOAD = "wide boolean, vectors binary, ids binary, labels binary, nodes binary, starts binary"
_PARTS = ["wide", "vectors", "ids", "labels", "nodes", "starts"]


def _blocks(rows: DataFrame, dim: int, most_leaf: int) -> DataFrame:
    """block, cell, n, centre, radius and the payload of each block of ``rows`` (block, cell, node, vec_id, label, wide, v)."""

    def pack(table: pa.Table) -> pa.RecordBatch:
        block, cell, nodes, ids, labels, wide = (table.column(c).to_pylist() for c in ("block", "cell", "node", "vec_id", "label", "wide"))
        x = _matrix(wide, table.column("v").to_pylist(), dim)
        order, starts = _leaves(x, most_leaf)
        centre = x.mean(axis=0)
        columns = [np.asarray(c, dtype=np.int64)[order].tobytes() for c in (ids, labels, nodes)]
        out = [block[0], cell[0], len(x), centre.tobytes(), float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()), any(wide), x[order].astype(np.float64 if any(wide) else np.float32).tobytes(), *columns, starts.astype(np.int64).tobytes()]
        return pa.RecordBatch.from_pylist([dict(zip(["block", "cell", "n", "centre", "radius", *_PARTS], out, strict=True))])

    dealt = rows.select("block", "cell", "node", "vec_id", "label", "wide", "v").repartition("block").sortWithinPartitions("block", "node")
    return dealt.mapInArrow(by_group(pack, 1), f"block long, cell long, n long, centre binary, radius double, {_PAYLOAD}")


def _celled(rows: DataFrame, dim: int, tree: TopTree, tile: int, scratch: Scratch) -> DataFrame:
    """The rows with their cell and their block: one of ceil(rows of the cell / ``tile``), by a hash of the row number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        wide, data = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("wide", "v"))
        return batch.append_column("cell", pa.array(tree.cell(_matrix(wide, data, dim)), pa.int64()))

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    celled = rows.mapInArrow(by_batch(run), f"{kinds}, cell long")
    counts = scratch(celled.groupBy("cell").agg(F.count("*").alias("_n")).withColumn("parts", F.ceil(F.col("_n") / tile)), "tree-cells")
    dealt = join_groups(celled, counts, "cell", "node")
    return dealt.withColumn("block", F.shiftleft("cell", 40) + F.pmod(F.xxhash64("node", F.lit("block")), F.col("parts")))


def _sample(rows: DataFrame, dim: int) -> np.ndarray:
    """Vectors of the rows that come first by a hash, as many as SAMPLE_ROWS and SAMPLE_BYTES allow."""
    most = max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(dim, 1))))
    got = rows.orderBy(F.xxhash64("node"), "node").limit(most).select("wide", "v").toPandas()
    return _matrix(got["wide"].tolist(), got["v"].tolist(), dim)


def _near(groups: DataFrame, cells: list, tree: TopTree, seeds: int | None) -> DataFrame:
    """(group, piece) of the cells whose interval meets what a group seeks; with ``seeds``, of the first pieces of its best cells."""
    numbers = np.array([r["cell"] for r in cells], dtype=np.int64)
    parts = np.array([r["parts"] for r in cells], dtype=np.int64)
    radii = np.array([r["radius"] for r in cells], dtype=np.float64)
    centres = tree.centres[numbers]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        block, centre, radius, sought = (batch.column(k).to_pylist() for k in range(4))
        of, pieces = [], []
        for b, c, r, s in zip(block, centre, radius, sought, strict=True):
            here = np.frombuffer(s or b"", dtype=SOUGHT)
            if not len(here):
                continue
            low, high = (v[0] for v in intervals(np.frombuffer(c)[None, :], np.array([r]), centres, radii))
            alive = np.flatnonzero((high >= np.maximum(here["low"], here["best"]).min()) & (low <= here["high"].max()))
            if seeds:
                alive = alive[np.argsort(-(low + high)[alive], kind="stable")[:seeds]]
            for at in alive.tolist():
                mine = (int(numbers[at]) << 40) + np.arange(1 if seeds else parts[at])
                pieces.append(mine)
                of.append(np.full(len(mine), b))
        flat = [np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (of, pieces)]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in flat], names=["group", "piece"])

    return groups.select("block", "centre", "radius", "sought").mapInArrow(by_batch(run), "group long, piece long")


def _pass(pairs: DataFrame, groups: DataFrame, pieces: DataFrame, count: int, k: int, same: bool) -> DataFrame:
    """group, no, anchor_id, anchor_node, positive_id, positive_score, id, node, score: the best of each pair of blocks.

    A piece is sent once for each TOGETHER groups that need it and meets them one after the other, so a
    task holds one piece and one group at a time, however many groups a piece has.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("group"), F.lit(-(-count // TOGETHER))))
    left = dealt.join(groups.withColumnRenamed("block", "group"), "group").select("piece", "part", F.lit(1).alias("kind"), "group", *_PARTS, "sought")
    right = dealt.select("piece", "part").distinct().join(pieces.withColumnRenamed("block", "piece"), "piece").select("piece", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("group"), *_PARTS, F.lit(None).cast("binary").alias("sought"))
    rows = left.unionByName(right).repartition("piece", "part").sortWithinPartitions("piece", "part", "kind", "group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = None
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = batch.slice(k_row, 1).to_pylist()[0]
                if row["kind"] == 0:
                    piece = Block(row)
                    continue
                group = Block(row)
                window, at, score = search(group, piece, k, same)
                if len(window):
                    s = group.sought[window]
                    columns = [np.full(len(window), row["group"]), s["no"], group.ids[s["anchor"]], group.nodes[s["anchor"]], s["positive_id"], s["positive_score"], piece.ids[at], score]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["group", "no", "anchor_id", "anchor_node", "positive_id", "positive_score", "id", "score"])

    out = "group long, no long, anchor_id long, anchor_node long, positive_id long, positive_score long, id long, score long"
    return rows.mapInArrow(run, out)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each window of each group, with their rank."""
    order = Window.partitionBy("group", "no").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _resought(groups: DataFrame, entries: DataFrame, renew) -> DataFrame:
    """``groups`` with what they seek made anew from the rows of ``entries`` (group, entry) of each."""
    listed = entries.groupBy("group").agg(F.collect_list("entry").alias("entries"))
    joined = groups.join(listed, groups["block"] == listed["group"], "left").drop("group")
    names = [c for c in joined.columns if c not in ("sought", "entries")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        sought = [renew(np.frombuffer(s or b"", dtype=SOUGHT), np.frombuffer(n, dtype=np.int64), e or []) for s, n, e in zip(column("sought"), column("nodes"), column("entries"), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array([s.tobytes() for s in sought], pa.binary())], names=[*names, "sought"])

    kinds = ", ".join(f"{c} {k}" for c, k in joined.select(*names).dtypes)
    return joined.mapInArrow(by_batch(run), f"{kinds}, sought binary")


def _search_all(groups: DataFrame, pieces: DataFrame, cells: list, tree: TopTree, count: int, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """The exact best ``k`` of each window: a pass over promising pieces for a bound, then one over all that can reach it."""

    def bounded(sought: np.ndarray, nodes: np.ndarray, entries: list) -> np.ndarray:
        out = sought.copy()
        place = {int(n): i for i, n in enumerate(out["no"])}
        for e in entries:
            out["best"][place[e["no"]]] = e["score"]
        return out

    first = _best(_pass(_near(groups, cells, tree, SEEDS), groups, pieces, count, k, same), k).where(F.col("rank") == k)
    known = scratch(_resought(groups, first.select("group", F.struct("no", "score").alias("entry")), bounded), "anchors-bounded")
    return scratch(_best(_pass(_near(known, cells, tree, None), known, pieces, count, k, same), k), "anchors-best")


def mine_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(``scale`` * x) of each component. An anchor's positives are the first
    ``positives`` other rows of its label, its negatives for each of them the first ``negatives`` rows of other
    labels whose score is from ``low`` to ``high`` percent of the positive's, both ends included. Higher scores
    come first, ties by smaller vec_id.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Rows that
    repeat an id are rows of their own, as anchors too; equal rows are each other's positives. Vectors of
    different length have no inner product and never meet: each length is searched by itself. Scores beyond
    64 bits are held at their ends. label is a whole number. Anchors without positives or without negatives have
    no rows; an empty table gives an empty result; other columns are ignored.

    All rows are searched, whatever the trees look like: the sample only shapes them. Pieces hold about
    PIECE rows and groups about GROUP anchors, also where a third of all vectors are equal.
    """
    scratch = Scratch()
    taking = scratch(usable(rows, anchor, scale).withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = [_mine(taking.where(F.col("dim") == r["dim"]), r["dim"], positives, negatives, low, high, scratch) for r in taking.where("anchor").select("dim").distinct().orderBy("dim").collect()]
    if not found:
        return scratch.finish(rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"), "negatives")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return scratch.finish(out, "negatives")


def _mine(rows: DataFrame, dim: int, positives: int, negatives: int, low: int, high: int, scratch: Scratch) -> DataFrame:
    tile = max(64, min(PIECE, (1 << 20) // (4 * max(dim, 1))))
    sample = _sample(rows, dim)
    # a cell holds a piece at least, since every piece answers for itself
    tree = fit_tree(sample, max(CELL, tile * len(sample) // max(rows.count(), 1)))
    pieces = scratch(_blocks(_celled(rows, dim, tree, tile, scratch), dim, LEAF), "pieces")
    groups = _blocks(_celled(rows.where("anchor"), dim, fit_tree(_sample(rows.where("anchor"), dim), GROUP), GROUP, scratch), dim, ANCHOR_LEAF)

    # one row a cell of the sample's tree: how far its pieces reach from the cell's centre
    centres = tree.centres

    def reach(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, centre, radius = (batch.column(k).to_pylist() for k in range(3))
        far = [float(np.sqrt(((np.frombuffer(c) - centres[at]) ** 2).sum()) + r) * (1 + 1e-9) for at, c, r in zip(cell, centre, radius, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(far)], names=["cell", "far"])

    cells = pieces.select("cell", "centre", "radius").mapInArrow(by_batch(reach), "cell long, far double").join(pieces.groupBy(F.col("cell").alias("_c")).agg(F.max("block").alias("last")), F.col("cell") == F.col("_c"))
    cells = cells.groupBy("cell").agg(F.max("far").alias("radius"), (F.max("last") - F.shiftleft("cell", 40) + 1).alias("parts")).orderBy("cell").collect()

    def all_of(_: np.ndarray, nodes: np.ndarray, entries: list) -> np.ndarray:
        out = np.zeros(len(nodes), dtype=SOUGHT)
        out["no"] = out["anchor"] = np.arange(len(nodes))
        out["low"], out["high"], out["best"] = _LEAST, _MOST, _LEAST
        return out

    def between(_: np.ndarray, nodes: np.ndarray, entries: list) -> np.ndarray:
        out = np.zeros(len(entries), dtype=SOUGHT)
        for k, e in enumerate(sorted(entries, key=lambda e: (e["no"], e["rank"]))):
            out[k] = (k, e["no"], max(_LEAST, -(-low * e["score"] // 100)), high * e["score"] // 100, _LEAST, e["id"], e["score"])
        return out[out["low"] <= out["high"]]

    none = rows.sparkSession.createDataFrame([], "group long, entry long")
    wanted = scratch(_resought(groups.withColumn("sought", F.lit(None).cast("binary")), none, all_of), "anchors")
    count = wanted.count()
    near = _search_all(wanted, pieces, cells, tree, count, positives, True, scratch)
    windows = scratch(_resought(wanted, near.select("group", F.struct("no", "rank", "id", "score").alias("entry")), between), "anchors-between")
    hard = _search_all(windows, pieces, cells, tree, count, negatives, False, scratch)
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
