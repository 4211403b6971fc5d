"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demoflux.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed value: a word is a run of characters other than blanks and line controls.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: lost executors can't lose them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete tables that `store` wrote, once nothing reads them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps now, not at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by the key: 13 hex digits of an MD5, which SQL can follow."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
