"""Changes to tables, as DataFrames and, over a :class:`TableStore`, as commits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Conflict, TableStore, Transaction  # noqa: F401  part of this module's interface


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``changes`` replace those of equal key; with ``update`` only those columns change."""
    if update is None:
        return current.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in update], F.lit(True).alias("_hit"))
    kept = current.join(renamed, list(keys), "left").select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in current.columns])
    return kept.unionByName(changes.join(current.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def delete_where(current: DataFrame, condition: Column | None) -> DataFrame:
    """All rows but those of the condition; a delete without a condition is refused."""
    if condition is None:
        raise ValueError("refusing to delete without a condition")
    return current.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(current: DataFrame, gone: DataFrame, key: str, other: str | None = None) -> DataFrame:
    return current.join(gone.select(F.col(other or key).alias(key)).distinct(), key, "left_anti")


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table (with the column that refers to the key) without the rows of the gone keys."""
    return {name: delete_keys(table, gone, column, key) for name, (table, column) in tables.items()}


def keep_latest(current: DataFrame, keys: Sequence[str], snapshot: str, latest: DataFrame) -> DataFrame:
    """Rows of each key's latest snapshot only."""
    return current.join(latest.select(*keys, snapshot), [*keys, snapshot], "left_semi")


def drop_orphans(rows: DataFrame, references: DataFrame, key: str, other: str | None = None) -> DataFrame:
    return rows.join(references.select(F.col(other or key).alias(key)).distinct(), key, "left_semi")


def backfill(rows: DataFrame, column: str, default: object) -> DataFrame:
    """Null or zero becomes the default."""
    return rows.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(default)))


def migrate(store: TableStore, steps: Sequence[tuple[str, Callable[[TableStore], None]]]) -> list[str]:
    """Run the steps (name, change) that the store has not seen, in order; the names of those run.

    What is done is a table of the store, so a step that fails is run again next time, and none twice.
    """
    spark = store.spark
    done = {r[0] for r in store.read("migrations", "name string").collect()} if store.exists("migrations") else set()
    ran = []
    for name, change in steps:
        if name not in done:
            change(store)
            store.append("migrations", spark.createDataFrame([(name,)], "name string"))
            ran.append(name)
    return ran


def open_store(spark: SparkSession, url: str, **options: str) -> TableStore | Callable[[str], DataFrame]:
    """What an address names: a folder of tables (a path, file:, hdfs: and the like), or a reader of a database's tables by JDBC.

    Databases are given as jdbc:, sqlite:/// or postgres(ql):// addresses; their drivers are the session's.
    """
    scheme, _, rest = url.partition("://")
    known = {"sqlite": lambda: f"jdbc:sqlite:{rest}", "postgres": lambda: f"jdbc:postgresql://{rest}", "postgresql": lambda: f"jdbc:postgresql://{rest}"}
    address = url if url.startswith("jdbc:") else known[scheme]() if scheme in known else None
    if address is None:
        return TableStore(spark, url)

    def read(table: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=address, dbtable=table, **options).load()

    read.address = address
    return read
