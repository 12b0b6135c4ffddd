"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors of a label are dealt into tiles, and each pair of tiles is one task. Unit vectors are
quantised to int8 with a scale of their own; the length of each vector's quantisation error is
kept. For x = q + e and y = r + f the cosine differs from <q, r> by at most
|e||r| + |q||f| + |e||f|, so only pairs whose int8 product plus this bound reaches the threshold
are recomputed in double precision; none at or above it can be missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_batch, by_group, in_tiles, merge
from .components import named


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, their scale, the length of the quantised vector and of its error, for rows of unit length."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    # the lengths are rounded up, so that rounding never makes the bound too small
    return q, scale, np.sqrt((back**2).sum(1)) * (1 + 1e-12), np.sqrt(((unit - back) ** 2).sum(1)) * (1 + 1e-12) + 1e-12


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float, rows: int = 512, chunk: int = 20_000):
    """Yield index arrays (i, j) of linked pairs between x and y, or within x (i < j) if y is None."""
    ux, uy = (v / np.sqrt((v**2).sum(1))[:, None] for v in (x, x if y is None else y))
    (qx, sx, nx, ex), (qy, sy, ny, ey) = quantise(ux), quantise(uy)
    # products of int8 vectors are whole numbers, exact in single precision up to 1000 dimensions
    kind = np.float32 if x.shape[1] <= 1000 else np.float64
    right = qy.astype(kind).T
    for at in range(0, len(x), rows):
        part = slice(at, at + rows)
        product = (qx[part].astype(kind) @ right) * sx[part, None] * sy[None, :]
        bound = ex[part, None] * ny[None, :] + (nx + ex)[part, None] * ey[None, :]
        i, j = np.nonzero(product + bound >= threshold - 1e-6)
        i += at
        if y is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), chunk):
            a, b = i[k : k + chunk], j[k : k + chunk]
            left, other = x[a], (x if y is None else y)[b]
            cosine = np.einsum("ij,ij->i", left, other) / np.sqrt(np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", other, other))
            good = cosine >= threshold
            yield a[good], b[good]


def link_embeddings(rows: DataFrame, threshold: float = 0.98, tile: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors of equal label.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label or vec_id, link with nothing: n_links 0, component_id their own id, kept. Vectors of
    different length never link. Each row is a vector of its own, also where ids repeat: rows of one
    id with other vectors are linked each by its own vector. Equal vectors are compared once and
    counted as often as they occur. An empty table gives an empty result; other columns are ignored.
    vec_id is a number.

    A tile holds about ``tile`` different vectors, so a label with a third of all rows is spread over
    (its vectors / ``tile``)^2 / 2 tasks; a task returns counts and a spanning forest, never all pairs.
    """

    # single precision is kept as it is, half the bytes of what is compared; other vectors go in double precision
    single = rows.schema["embedding"].dataType.elementType.typeName() == "float"

    def prepare(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, vectors, labels = batch.columns
        n = len(ids)
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.fill_null(pc.list_flatten(vectors).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        usable = (ids.is_valid().to_numpy(zero_copy_only=False)) & (labels.is_valid().to_numpy(zero_copy_only=False))
        data, keys, names = [None] * n, [None] * n, labels.to_pylist()
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero((sizes == size) & usable)
            v = flat[(ends[at] - size)[:, None] + np.arange(size)]
            largest = np.abs(v).max(axis=1, initial=0)
            good = np.isfinite(v).all(axis=1) & (largest > 0)
            at, own, v = at[good], v[good], v[good] / largest[good, None]
            for k, mine, row in zip(at.tolist(), own.astype(np.float32) if single else v, v, strict=True):
                data[k] = mine.tobytes()
                keys[k] = xxhash.xxh3_128_digest(row.tobytes() + repr(names[k]).encode())
        return pa.RecordBatch.from_arrays([ids, labels, pa.array(data, pa.binary()), pa.array(keys, pa.binary())], names=["vec_id", "label", "v", "key"])

    kinds, scratch = dict(rows.dtypes), Scratch()
    prepared = scratch(rows.select("vec_id", "embedding", "label").mapInArrow(by_batch(prepare), f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary, key binary"), "embedding-rows")
    classes = prepared.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("v").alias("v"))
    # a class of equal vectors is a node of the link graph, so rows that repeat an id with other vectors stay apart
    classes = scratch(classes.withColumns({"dim": F.octet_length("v"), "node": F.monotonically_increasing_id()}), "embedding-classes")
    tiles = in_tiles(classes.select("label", "dim", "node", "times", "v"), ["label", "dim"], "node", tile).select("label", "dim", "i", "j", "t", "node", "times", "v")

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        table = table.sort_by([("t", "ascending"), ("node", "ascending")])
        t, node, times = (table.column(c).to_numpy() for c in ("t", "node", "times"))
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), dtype=np.float32 if single else np.float64).reshape(len(node), -1).astype(np.float64)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        first = len(node) if i == j else int((t == i).sum())
        count, label = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        if first and (i == j or first < len(node)):
            for a, b in tile_links(x[:first], None if i == j else x[first:], threshold):
                b = b + (0 if i == j else first)
                count += np.bincount(a, times[b], len(node)).astype(np.int64) + np.bincount(b, times[a], len(node)).astype(np.int64)
                merge(label, a, b)
        hit = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(count[hit]), pa.array(node[label[hit]])], names=["node", "n", "root"]) if len(hit) else None

    found = scratch(tiles.mapInArrow(by_group(compare, 4), "node long, n long, root long"), "embedding-found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    ids = classes.select("node", "key", "id", "times")
    least = named(edges, ids, ["id"], scratch).withColumnRenamed("id", "component")
    linked = ids.join(counts, "node", "left").join(least, "node", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = prepared.select("vec_id", "key").join(linked, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return scratch.finish(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "embedding-links")
