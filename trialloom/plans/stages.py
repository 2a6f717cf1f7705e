"""Stages whose results are kept: one committed folder each, skipped when it is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], restart: bool = False) -> DataFrame:
    """The rows of a stage: read if its folder is committed, else built and written. ``restart`` builds anew."""
    if restart or not committed(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
