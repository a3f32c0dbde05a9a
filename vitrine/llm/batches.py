"""Sizes of the batches in which texts go to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession


def small_batches(spark: SparkSession, rows: int = 512, megabytes: int = 16) -> None:
    """Texts can be long: a worker holds so many rows or bytes at a time, whatever the partition's size; one text more at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
