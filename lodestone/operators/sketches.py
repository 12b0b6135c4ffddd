"""Quantiles and distinct counts from stored sketches, kept up to date by new files alone.

Each file of a table is read once: its groups' counts, quantile sketches (KLL) and distinct-count sketches (HLL)
are stored, and a query merges them. A sketch has one size however many rows it stands for, so no group's values
are ever held, and an append costs what is appended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import TableStore, Transaction


class SketchTable:
    """Sketches of a column's quantiles and of another's distinct values, by group."""

    def __init__(self, store: TableStore, name: str, keys: Sequence[str], value: str, distinct: str, k: int = 400, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """``k`` sets the error of a rank, about 1.7 / k of the rows; ``prepare`` makes the columns from a file's rows."""
        self.store, self.name, self.keys, self.value, self.distinct, self.k, self.prepare = store, name, list(keys), value, distinct, k, prepare

    def _known(self, table: DataFrame) -> dict[str, str]:
        """The table's files and what tells whether one has changed."""
        fs = self.store._fs
        out = {}
        for file in table.inputFiles():
            status = fs.getFileStatus(self.store._path(file))
            out[file] = f"{status.getLen()} {status.getModificationTime()}"
        return out

    def _sketched(self, files: DataFrame) -> DataFrame:
        rows = self.prepare(files)
        return rows.groupBy(*self.keys).agg(
            F.count("*").alias("n"),
            F.kll_sketch_agg_double(F.col(self.value).cast("double"), F.lit(self.k)).alias("quantiles"),
            F.hll_sketch_agg(F.col(self.distinct), F.lit(14)).alias("distinct"),
        )

    def refresh(self, table: DataFrame) -> int:
        """Take in the files of a Parquet table that are new; how many were read. If one is gone or changed, all are."""
        spark, now = table.sparkSession, self._known(table)

        def change(tx: Transaction) -> int:
            name = f"{self.name}_files"
            then = {r["file"]: r["state"] for r in tx.read(name, "file string, state string").collect()} if tx.exists(name) else {}
            whole = any(now.get(f) != s for f, s in then.items())
            fresh = sorted(now if whole else now.keys() - then.keys())
            if not fresh:
                return 0
            put = tx.replace if whole else tx.append
            put(self.name, self._sketched(spark.read.schema(table.schema).parquet(*fresh)))
            put(name, spark.createDataFrame([(f, now[f]) for f in fresh], "file string, state string"))
            return len(fresh)

        return self.store.update(change)

    def merged(self) -> DataFrame:
        """(keys, n, quantiles, distinct) of each group over all files."""
        rows = self.store.read(self.name)
        return rows.groupBy(*self.keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))

    def quantiles(self, shares: Sequence[float]) -> DataFrame:
        """(keys, n, distinct, q0, q1, ...): a value near each share of the sorted values, and about how many distinct ones."""
        wanted = [F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(shares)]
        return self.merged().select(*self.keys, "n", F.hll_sketch_estimate("distinct").alias("distinct"), *wanted)
