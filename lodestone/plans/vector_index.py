"""The stored vector index: an inverted file of residual codes, re-ranked exactly.

Vectors lie in a tree: cells, under crowded cells further ones, and at the end lists of about ten vectors each,
however many vectors there are. A list keeps one byte a dimension of each vector's difference from the list's
centroid, its scale and the length of what that leaves out. So a query bounds every similarity in the lists
that it visits from codes alone, and reads whole vectors only of what can still be among the best.

Every level is trained by tasks: centroids of cells by rounds of k-means over a sample, those below by one task
a node over rows of bounded number. The driver holds the centroids of the top level, at most MOST_CELLS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.tables import TableStore, Transaction
from ..session import discard, shared_path, ship_package, source_digest, written
from .retrieval import TOP, _top, batch_topk, exact_topk, probe_count

#: Children of a node at most, sampled vectors for each of them, rounds of k-means.
MOST_CELLS, SAMPLED, ROUNDS = 1024, 256, 6
#: Vectors of a list, and of a node whose lists one task trains.
LIST_ROWS, NODE_ROWS = 10, 16_384
#: Share of true neighbours that the probes of an index are set for, by sampled vectors as queries.
RECALL, CALIBRATED_BY = 0.95, 64
#: Candidates whose whole vectors are looked up by a filter; more are joined.
MOST_CANDIDATES = 1000
PAGE_ROWS = 512


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; a row of length zero stays."""
    norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def nearest(x: np.ndarray, centroids: np.ndarray, rows: int = 2048) -> np.ndarray:
    """The centroid of greatest inner product of each row, some rows at a time."""
    return np.concatenate([(x[at : at + rows] @ centroids.T).argmax(axis=1) for at in range(0, len(x), rows)] or [np.zeros(0, dtype=np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids of unit rows; starts from every n-th row, so the same rows give the same centroids."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest(x, centres), x)
        filled = np.sqrt((sums**2).sum(axis=1)) > 0
        centres[filled] = unit(sums[filled])
    return centres


def encode(u: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the differences, one byte a dimension, their scales, and the lengths of what they leave out, rounded up."""
    rest = u - centroids
    scale = np.abs(rest).max(axis=1, initial=0) / 127
    code = np.rint(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).astype(np.int8)
    return code, scale, np.sqrt(((rest - code * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12


def _rows(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one node after the other, from rows sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        bounds = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(nodes)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a:
                if held and held[0].column(0)[0] != batch.column(0)[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class VectorIndex:
    """Codes and vectors by cell and list, the lists' centroids, and how many lists a query visits."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "id", embedding: str = "embedding") -> None:
        self.spark, self.store, self.key, self.embedding = spark, TableStore(spark, folder, PAGE_ROWS), key, embedding

    @property
    def exists(self) -> bool:
        return self.store.exists("codes")

    # building

    def _train_top(self, vectors: DataFrame, n: int, cells: int) -> np.ndarray:
        """Centroids of the cells, by rounds of k-means over a sample; each round sums up in tasks."""
        every = max(1, n // (cells * SAMPLED))
        sample = written(vectors.where(F.pmod(F.xxhash64(self.key, F.lit("sample")), F.lit(every)) == 0).select(F.xxhash64(self.key).alias("h"), self.embedding), "vector-sample")
        first = sample.orderBy("h").limit(cells).select(self.embedding).toPandas()
        centres = unit(np.array(first[self.embedding].tolist(), dtype=np.float64).reshape(len(first), -1))
        for _ in range(ROUNDS):

            def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
                total, count = np.zeros_like(centres), np.zeros(len(centres), dtype=np.int64)
                for batch in batches:
                    u = unit(_rows(batch.column(0)))
                    near = nearest(u, centres)
                    np.add.at(total, near, u)
                    count += np.bincount(near, minlength=len(centres))
                hit = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array([total[h].tobytes() for h in hit], pa.binary())], names=["cell", "total"])

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for table in _by_node(batches):
                    total = np.sum([np.frombuffer(b) for b in table.column("total").to_pylist()], axis=0)
                    yield pa.RecordBatch.from_arrays([table.column("cell").combine_chunks().slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["cell", "total"])

            parts = sample.select(self.embedding).mapInArrow(sums, "cell long, total binary").repartition("cell").sortWithinPartitions("cell")
            for r in parts.mapInArrow(add, "cell long, total binary").collect():
                total = np.frombuffer(r["total"])
                if np.sqrt((total**2).sum()) > 0:
                    centres[r["cell"]] = total / np.sqrt((total**2).sum())
        discard(sample)
        return centres

    def _children(self, rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
        """``rows`` (key, embedding, cell) with the child of their cell: crowded cells are split into nodes of about NODE_ROWS.

        A cell's children are trained by one task on a sample of bounded size; its rows meet them in parts.
        """
        wanted = {cell: min(MOST_CELLS, -(-n // NODE_ROWS)) for cell, n in sizes.items()}
        crowded = {cell: k for cell, k in wanted.items() if k > 1}
        if not crowded:
            return rows.withColumn("child", F.lit(0))
        # at most MOST_CELLS rows
        known = F.broadcast(self.spark.createDataFrame([(c, k, -(-sizes[c] // NODE_ROWS), max(1, sizes[c] // (k * SAMPLED))) for c, k in crowded.items()], "_cell int, _k int, _parts int, _every long"))
        marked = rows.join(known, F.col("cell") == F.col("_cell"))

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _by_node(batches):
                u = unit(_rows(table.column("v").combine_chunks()))
                centres = kmeans(u, min(table.column("k")[0].as_py(), len(u)))
                yield pa.RecordBatch.from_arrays([table.column("cell").combine_chunks().slice(0, 1), pa.array([centres.tobytes()], pa.binary())], names=["cell", "centres"])

        sampled = marked.where(F.pmod(F.xxhash64(self.key, F.lit("child")), F.col("_every")) == 0)
        sampled = sampled.select("cell", F.col("_k").alias("k"), F.col(self.embedding).alias("v")).repartition("cell").sortWithinPartitions("cell")
        centres = written(sampled.mapInArrow(train, "cell int, centres binary"), "vector-nodes")
        split = self._meet(marked, centres, "child")
        return rows.join(known, F.col("cell") == F.col("_cell"), "left_anti").withColumn("child", F.lit(0)).unionByName(split)

    def _meet(self, rows: DataFrame, centres: DataFrame, out: str) -> DataFrame:
        """``rows`` with the number of their cell's nearest centroid; a cell's rows meet its centroids in ``_parts`` parts."""
        key, embedding, kind = self.key, self.embedding, dict(rows.dtypes)[self.key]
        columns = ["cell", "part", "kind", "centres", "key", "v"]
        sizes = rows.select("cell", "_parts").distinct()
        spread = centres.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(0).alias("kind"), "centres", F.lit(None).cast(kind).alias("key"), F.lit(None).cast("array<double>").alias("v"))
        dealt = rows.select("cell", F.pmod(F.xxhash64(key, F.lit("part")), F.col("_parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("centres"), F.col(key).alias("key"), F.col(embedding).alias("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = None
            for batch in batches:
                kinds, at = batch.column(2).to_numpy(), 0
                # centroids stand before the rows that meet them
                for stop in [*np.flatnonzero(kinds == 0).tolist(), batch.num_rows]:
                    if stop > at:
                        some = batch.slice(at, stop - at)
                        u = unit(_rows(some.column(5)))
                        near = nearest(u, known.reshape(-1, u.shape[1]))
                        yield pa.RecordBatch.from_arrays([some.column(4), some.column(5), some.column(0), pa.array(near.astype(np.int32))], names=[key, embedding, "cell", out])
                    if stop < batch.num_rows:
                        known = np.frombuffer(batch.column(3)[stop].as_py())
                    at = stop + 1

        met = spread.select(*columns).unionByName(dealt.select(*columns)).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
        return met.mapInArrow(run, f"{key} {kind}, {embedding} array<double>, cell int, {out} int")

    def _listed(self, rows: DataFrame) -> DataFrame:
        """(key, embedding, cell, list_id, centroid, code, scale, rest): lists of about LIST_ROWS, trained where their node's rows are.

        The centroid stands in the first row of its list. A node that is still too large, as where many vectors
        are equal, is dealt into several by a hash.
        """
        key, embedding, kind = self.key, self.embedding, dict(rows.dtypes)[self.key]
        sizes = written(rows.groupBy("cell", "child").agg(F.ceil(F.count("*") / (2 * NODE_ROWS)).cast("int").alias("_parts")).where("_parts > 1").withColumnsRenamed({"cell": "_cell", "child": "_child"}), "vector-sizes")
        few = F.broadcast(sizes) if sizes.count() <= 250_000 else sizes
        dealt = rows.join(few, (F.col("cell") == F.col("_cell")) & (F.col("child") == F.col("_child")), "left")
        part = F.coalesce(F.pmod(F.xxhash64(key, F.lit("node")), F.col("_parts")), F.lit(0)).cast("long")
        # cells and children have 10 bits each, parts 24, and lists of a node 13
        node = F.shiftleft(F.shiftleft(F.col("cell").cast("long") * 1024 + F.col("child"), 24) + part, 13)
        dealt = dealt.select(node.alias("node"), F.col(key).alias("key"), F.col(embedding).alias("v"), "cell").repartition("node").sortWithinPartitions("node", F.xxhash64("key"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _by_node(batches):
                table = table.combine_chunks()
                u = unit(_rows(table.column("v").chunk(0)))
                centres = kmeans(u, max(1, len(u) // LIST_ROWS))
                near = nearest(u, centres)
                order = np.argsort(near, kind="stable")
                near, table = near[order], table.take(pa.array(order))
                code, scale, rest = encode(u[order], centres[near])
                first = np.concatenate([[True], near[1:] != near[:-1]]) if len(near) else np.zeros(0, dtype=bool)
                centroid = pa.array([centres[c].tolist() if f else None for c, f in zip(near, first, strict=True)], pa.list_(pa.float64()))
                number = pa.array(near + table.column("node")[0].as_py(), pa.int64())
                made = pa.Table.from_arrays([table.column("key"), table.column("v"), table.column("cell"), number, centroid, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(rest)], names=[key, embedding, "cell", "list_id", "centroid", "code", "scale", "rest"])
                yield from made.to_batches(max_chunksize=2048)

        return dealt.mapInArrow(run, f"{key} {kind}, {embedding} array<double>, cell int, list_id long, centroid array<double>, code binary, scale double, rest double")

    def _put(self, tx: Transaction, listed: DataFrame, replace: bool, by: tuple[str, ...] = ("cell",)) -> None:
        put = tx.replace if replace else tx.append
        for name, columns in (("codes", ["list_id", self.key, "code", "scale", "rest"]), ("vectors", ["list_id", self.key, self.embedding])):
            put(name, listed.select(*columns, "cell").hint("rebalance", "cell").sortWithinPartitions("cell", "list_id"), by)

    def build(self, vectors: DataFrame) -> VectorIndex:
        """Replace the index; a change of the vectors' length is such a rebuild too. Rows without a vector are left out."""
        ship_package(self.spark)
        rows = vectors.where(F.col(self.embedding).isNotNull()).select(self.key, F.col(self.embedding).cast("array<double>").alias(self.embedding))
        n = rows.count()
        lists, least = probe_count(n)
        cells = max(1, min(MOST_CELLS, math.isqrt(lists), n))
        top = self._train_top(rows, n, cells) if n else np.zeros((0, 0))
        placed = written(self._celled(rows, top), "vector-cells")
        sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        nodes = written(self._children(placed, sizes), "vector-nodes")
        listed = written(self._listed(nodes), "vector-lists")

        def change(tx: Transaction) -> None:
            # without a row there is no partition that would tell the columns
            by = ("cell",) if n else ()
            self._put(tx, listed, True, by)
            tx.replace("lists", listed.where("centroid IS NOT NULL").select("list_id", "centroid", "cell").hint("rebalance", "cell").sortWithinPartitions("cell", "list_id"), by)
            tx.replace("cells", self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(top)], "cell int, centroid array<double>"))
            tx.replace("config", self.spark.createDataFrame([(least, max(1, len(top)))], "probes int, cells int"))

        self.store.update(change)
        for table in (placed, nodes, listed):
            discard(table)
        if n:
            self._calibrate(least)
        return self

    def _celled(self, rows: DataFrame, top: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield batch.append_column("cell", pa.array(nearest(unit(_rows(batch.column(1))), top).astype(np.int32)))

        return rows.mapInArrow(run, f"{self.key} {dict(rows.dtypes)[self.key]}, {self.embedding} array<double>, cell int")

    def _calibrate(self, least: int) -> None:
        """Set how many cells and lists a query visits, so that sampled vectors find RECALL of their true neighbours."""
        vectors = self.store.read("vectors")
        queries = vectors.orderBy(F.xxhash64(self.key, F.lit("query"))).limit(CALIBRATED_BY).select(F.col(self.key).alias("query_id"), self.embedding)
        queries = written(queries, "vector-queries")
        near = batch_topk(vectors, queries, TOP + 1, self.key, embedding=self.embedding).where(F.col("query_id") != F.col(self.key))
        near = near.join(vectors.select(self.key, "list_id", "cell"), self.key).select("query_id", "list_id", "cell").toPandas()
        asked = queries.toPandas()
        discard(queries)
        if near.empty:
            return
        place = {q: i for i, q in enumerate(asked["query_id"])}
        u = unit(np.array(asked[self.embedding].tolist(), dtype=np.float64))
        of = near["query_id"].map(place).to_numpy()
        # the rank of a neighbour's cell, and of its list: how many centroids are nearer to the query
        top = u @ self._cells().T
        cell_rank = (top[of] > top[of, near["cell"].to_numpy()][:, None]).sum(axis=1)
        lists = self.store.read("lists", "list_id long, centroid array<double>, cell int")
        wanted = near["list_id"].to_numpy()
        own = {r["list_id"]: np.array(r["centroid"]) for r in lists.where(F.col("list_id").isin([int(x) for x in np.unique(wanted)])).collect()}
        score = np.array([u[q] @ own[x] for q, x in zip(of, wanted, strict=True)])

        def nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.zeros(len(score), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    count += ((u @ _rows(batch.column(0)).T)[of] > score[:, None] + 1e-12).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count))), pa.array(count)], names=["i", "n"])

        ranks = lists.select("centroid").mapInArrow(nearer, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()["n"].to_numpy()
        share = (1 + RECALL) / 2
        probes, cells = (int(np.quantile(r, share, method="higher")) + 1 for r in (ranks, cell_rank))
        self.store.write("config", self.spark.createDataFrame([(max(probes, least), cells)], "probes int, cells int"))

    # changes

    def add(self, vectors: DataFrame) -> None:
        """Add vectors to the lists that are there; to an empty index, build it."""
        ship_package(self.spark)
        if not self.count():
            self.build(vectors)
            return
        rows = vectors.where(F.col(self.embedding).isNotNull()).select(self.key, F.col(self.embedding).cast("array<double>").alias(self.embedding))
        placed = written(self._celled(rows, self._cells()), "vector-cells")
        sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / NODE_ROWS).cast("int").alias("_parts"))
        lists = self.store.read("lists", "list_id long, centroid array<double>, cell int")
        key, embedding, kind = self.key, self.embedding, dict(rows.dtypes)[self.key]

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _by_node(batches):
                centres = _rows(table.column("centroid").combine_chunks())
                yield pa.RecordBatch.from_arrays([table.column("cell").combine_chunks().slice(0, 1), pa.array([centres.tobytes()], pa.binary()), pa.array([table.column("list_id").to_numpy().tobytes()], pa.binary())], names=["cell", "centres", "numbers"])

        blocks = written(lists.select("cell", "list_id", "centroid").repartition("cell").sortWithinPartitions("cell", "list_id").mapInArrow(block, "cell int, centres binary, numbers binary"), "vector-blocks")
        met = self._meet(placed.join(F.broadcast(sizes), "cell"), blocks.select("cell", "centres"), "local")

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                u, centroid = unit(_rows(batch.column(1))), _rows(batch.column(4))
                made, scale, rest = encode(u, centroid)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array([c.tobytes() for c in made], pa.binary()), pa.array(scale), pa.array(rest)], names=[key, embedding, "cell", "list_id", "code", "scale", "rest"])

        # a list's place among its cell's is that of its number
        place = Window.partitionBy("cell").orderBy("list_id")
        numbered = lists.withColumn("local", (F.row_number().over(place) - 1).cast("int")).withColumnRenamed("cell", "_cell")
        joined = met.join(numbered, (F.col("cell") == F.col("_cell")) & (met["local"] == numbered["local"])).select(key, embedding, "cell", "list_id", "centroid")
        listed = written(joined.mapInArrow(code, f"{key} {kind}, {embedding} array<double>, cell int, list_id long, code binary, scale double, rest double"), "vector-lists")
        self.store.update(lambda tx: self._put(tx, listed, False))
        for table in (placed, blocks, listed):
            discard(table)

    def remove(self, keys: DataFrame) -> None:
        """Delete these keys; the vectors stay in their files until the store is compacted."""
        self.store.delete_from({"codes": self.key, "vectors": self.key}, keys, self.key)

    # reading

    def _cells(self) -> np.ndarray:
        rows = self.store.read("cells", "cell int, centroid array<double>").orderBy("cell").collect()
        return np.array([r["centroid"] for r in rows], dtype=np.float64)

    def count(self) -> int:
        return self.store.read("codes").count() if self.exists else 0

    def lists(self) -> int:
        return self.store.read("lists", "list_id long, centroid array<double>, cell int").count()

    def has(self, key: object) -> bool:
        return self.exists and not self.store.read("codes").where(F.col(self.key) == key).isEmpty()

    def visited(self, query: Sequence[float], probes: int | None = None) -> tuple[list[int], dict[int, float]]:
        """The cells that a query reads, and the inner product with the centroid of each list that it visits."""
        q = unit(np.asarray(query, dtype=np.float64)[None, :])
        config, top = self.store.read("config", "probes int, cells int").first(), self._cells()
        if not len(top):
            return [], {}
        cells = np.argsort(-(top @ q[0]), kind="stable")[: config["cells"]].tolist()
        lists = self.store.read("lists", "list_id long, centroid array<double>, cell int").where(F.col("cell").isin(cells))
        dot = F.aggregate(F.zip_with("centroid", F.array(*[F.lit(float(v)) for v in q[0]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        best = lists.select("list_id", "cell", dot.alias("dot")).orderBy(F.desc("dot"), "list_id").limit(probes or config["probes"]).collect()
        return sorted({r["cell"] for r in best}), {r["list_id"]: r["dot"] for r in best}

    def bounded(self, query: Sequence[float], cells: list[int], dots: dict[int, float]) -> DataFrame:
        """(key, list_id, cell, low, high): between what the similarity of each vector of these lists lies, from codes alone."""
        q = unit(np.asarray(query, dtype=np.float64)[None, :])[0]
        numbers = np.array(sorted(dots), dtype=np.int64)
        middle = np.array([dots[x] for x in numbers.tolist()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(0).to_numpy()
                at = np.minimum(np.searchsorted(numbers, lists), len(numbers) - 1)
                mine = np.flatnonzero(numbers[at] == lists)
                if not len(mine):
                    continue
                some = batch.take(pa.array(mine))
                code = np.frombuffer(b"".join(some.column(2).to_pylist()), dtype=np.int8).reshape(len(mine), -1)
                dot = middle[at[mine]] + (code @ q) * some.column(3).to_numpy()
                slack = some.column(4).to_numpy() + 1e-9
                yield pa.RecordBatch.from_arrays([some.column(1), some.column(0), some.column(5), pa.array(dot - slack), pa.array(dot + slack)], names=[self_key, "list_id", "cell", "low", "high"])

        self_key = self.key
        codes = self.store.read("codes").where(F.col("cell").isin(cells)).where(F.col("list_id").between(int(numbers[0]), int(numbers[-1])))
        kind = dict(codes.dtypes)[self.key]
        return codes.select("list_id", self.key, "code", "scale", "rest", "cell").mapInArrow(run, f"{self.key} {kind}, list_id long, cell int, low double, high double")

    def find(self, query: Sequence[float], k: int = TOP, probes: int | None = None) -> DataFrame:
        """The k most similar vectors of the lists that are visited, exactly: key, score.

        Whole vectors are read of those alone whose upper bound reaches the k-th best lower bound.
        """
        ship_package(self.spark)
        k = _top(k)
        cells, dots = self.visited(query, probes)
        vectors = self.store.read("vectors")
        if not dots:
            return exact_topk(vectors.limit(0), query, k, self.key, self.embedding)
        bounds = self.bounded(query, cells, dots)
        best = bounds.orderBy(F.desc("low")).limit(k).select("low").collect()
        able = bounds.where(F.col("high") >= (best[-1]["low"] if len(best) == k else -2.0)).select(self.key, "list_id")
        few = able.limit(MOST_CANDIDATES + 1).collect()
        rows = vectors.where(F.col("cell").isin(cells))
        if len(few) <= MOST_CANDIDATES:
            rows = rows.where(F.col("list_id").isin(sorted({r["list_id"] for r in few})) & F.col(self.key).isin([r[self.key] for r in few]))
        else:
            rows = rows.join(able.select(self.key).distinct(), self.key, "left_semi")
        return exact_topk(rows, query, k, self.key, self.embedding)


def shared_vectors(vectors: DataFrame, key: str, embedding: str = "embedding") -> VectorIndex:
    """The index of a table that is stored in files, in the shared folder; built once for the files as they are."""
    made_by = source_digest(__name__, "lodestone.plans.retrieval")
    index = VectorIndex(vectors.sparkSession, shared_path(vectors, f"vectors {made_by} {key} {embedding}"), key, embedding)
    return index if index.exists else index.build(vectors)
