"""Session factory with the settings every operator of this package expects."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides single settings.

    The number of shuffle partitions is only the starting point: adaptive execution coalesces
    small partitions and splits skewed ones at run time.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Used only on a local master whose session names no checkpoint folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_FOLDER


def shared_path(table: DataFrame, purpose: str) -> str:
    """A folder in the shared one for what is derived from a table of files, named by the files as they are."""
    spark, known = table.sparkSession, hashlib.sha256(purpose.encode())
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in sorted(table.inputFiles()):
        file = path(name)
        status = file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file)
        known.update(f" {name} {status.getLen()} {status.getModificationTime()}".encode())
    return f"{shared_folder(spark)}/lodestone-{known.hexdigest()[:24]}"


def source_digest(*modules: str) -> str:
    """A digest of modules' sources: part of the name of what they derive, so that other code derives it anew."""
    import importlib
    import inspect

    return hashlib.sha256("".join(inspect.getsource(importlib.import_module(m)) for m in modules).encode()).hexdigest()[:16]


def written(df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and a lost executor costs only its own tasks."""
    path = f"{shared_folder(df.sparkSession)}/lodestone-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`written` wrote, once nothing reads it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodestone-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once a context, through Spark's own file server."""
    import shutil
    import tempfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodestone-")
    context.addPyFile(shutil.make_archive(f"{folder}/lodestone", "zip", here.parent, here.name))
    context._lodestone_shipped = True
