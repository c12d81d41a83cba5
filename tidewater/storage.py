"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of a small table that may go to every task.
SMALL_ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed (a checkout run by its path); call it before a plan takes a Python function."""
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, environment.get("PYTHONPATH", "")) if x)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a small input has fewer parts than there are cores; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None, partition: list[str] | None = None, group_bytes: int = 128 << 20) -> DataFrame:
    """Write a table and read it back, so that it is made once and outlives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", group_bytes).parquet(path, partitionBy=partition)
    return spark.read.schema(df.schema).parquet(path)
