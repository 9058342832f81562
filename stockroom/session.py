"""Sessions, table loading and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    """A session with the engine's settings; keyword arguments name further settings with ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName("stockroom")
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="stockroom-")
        atexit.register(lambda: __import__("shutil").rmtree(_LOCAL, ignore_errors=True))
    return f"file://{_LOCAL}"


_LOCAL: str | None = None


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts the lineage, survives lost executors and keeps column pruning.

    The table is deleted when the driver's process ends, or by ``drop`` or ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stockroom/{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if not _STAGED:
        atexit.register(release, spark)
    _STAGED.append(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._staged_path = path
    return read


#: Tables that were staged and not dropped yet.
_STAGED: list[str] = []


def release(spark: SparkSession) -> None:
    """Drops all staged tables: results that were built from them and not written yet can't be read any more. For long sessions, between jobs."""
    while _STAGED:
        _drop(spark, _STAGED.pop())


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``staged`` at once, when all that was built from them is staged itself."""
    for df in tables:
        _STAGED.remove(df._staged_path)
        _drop(df.sparkSession, df._staged_path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: the shared folder's owner cleans up
        if path.startswith("file://"):
            __import__("shutil").rmtree(path[7:], ignore_errors=True)


