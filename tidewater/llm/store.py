"""Written intermediate tables and size-checked filters shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of one or two longs that are sent to every executor, at most: some 200 MB in its memory.
BROADCAST_ROWS = 1 << 22
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_RECORDERS: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed (a checkout run by its path)."""
    text_batches(spark)
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, environment.get("PYTHONPATH", "")) if x)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    for paths in _RECORDERS:
        paths.append(path)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; frames that were not written are passed over."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            remove(table.sparkSession, [path])


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def recorded(paths: list[str]):
    """Note in ``paths`` what is written meanwhile, for a caller that knows when the last reader is done."""
    _RECORDERS.append(paths)
    try:
        yield
    finally:
        _RECORDERS.pop()


@contextmanager
def only(spark: SparkSession, name: str):
    """Yields ``written`` for the one table, under this name, that outlives the block; the others written in it are deleted at its end."""
    paths: list[str] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(written(df, name))
        return kept[-1]

    with recorded(paths):
        yield keep
    remove(spark, [x for x in paths if x not in {_PATHS[table] for table in kept}])


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of text scans by bytes, so that a worker's memory does not depend on the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_ids(rows: DataFrame, ids: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join of wide rows with a written table of keys.

    Up to BROADCAST_ROWS keys go to the tasks, so that the rows stay where they are; more are joined by a shuffle.
    """
    keys = ids.select(*on)
    return rows.join(F.broadcast(keys) if ids.count() <= BROADCAST_ROWS else keys.hint("merge"), on, how)
