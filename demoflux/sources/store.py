"""Results that are computed once and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a complete result lies at the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def materialize(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False,
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """The stored result, built first if it is missing or to be refreshed."""
    if refresh or not stored(spark, path):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)
