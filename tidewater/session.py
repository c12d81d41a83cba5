"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configured(spark: SparkSession) -> SparkSession:
    """Apply the engine's session settings; partition counts and memory stay with the cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
