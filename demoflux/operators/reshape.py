"""Wide and long tables, positions, un-counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoflux.operators.numbering import numbered

UNCOUNT_CHUNK = 4096


def spread(df: DataFrame, by: Sequence[str], key: str, value: str, values: Sequence[str]) -> DataFrame:
    """Long to wide: one column per listed key value; each cell is single.

    Written as one aggregate per value, which needs one shuffle where a pivot needs two.
    """
    return df.groupBy(*by).agg(*[F.max(F.when(F.col(key) == v, F.col(value))).alias(v) for v in values])


def gather(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long over the listed columns."""
    return df.unpivot(list(ids), list(columns), name, value)


def keep_positions(df: DataFrame, order: Sequence[str], positions: Sequence[int]) -> DataFrame:
    """Rows by position in an explicit order."""
    return numbered(df, order, "_position").filter(F.col("_position").isin(list(positions))).drop("_position")


def count_chunks(df: DataFrame, count: str) -> DataFrame:
    """Split each counted row into chunks of bounded size, spread over the cluster.

    Adds chunk (from 0) and chunk_rows. A row standing for billions becomes many chunks
    that different tasks unfold; a second split level keeps every array short.
    """
    size = UNCOUNT_CHUNK
    chunks = F.floor((F.col(count) - 1) / size).cast("long")
    blocks = df.filter(F.col(count) >= 1).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(chunks / size).cast("long")))
    )
    low = F.col("_block") * size
    chunked = blocks.withColumn("chunk", F.explode(F.sequence(low, F.least(low + size - 1, chunks))))
    rows = F.least(F.lit(size).cast("long"), F.col(count).cast("long") - F.col("chunk") * size)
    return chunked.drop("_block").withColumn("chunk_rows", rows)


def spread_chunks(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distribute chunks over a set number of tasks.

    The number is given, as chunk rows are tiny before they unfold and would otherwise be
    merged into few tasks.
    """
    spark = chunks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return chunks.repartition(tasks, *[F.col(k) for k in keys], F.col("chunk"))


def uncount(df: DataFrame, keys: Sequence[str], count: str, index: str = "i") -> DataFrame:
    """N copies of each row, numbered from 1."""
    chunks = spread_chunks(count_chunks(df, count), keys)
    start = F.col("chunk") * UNCOUNT_CHUNK
    unfolded = chunks.withColumn(index, F.explode(F.sequence(start + 1, start + F.col("chunk_rows"))))
    return unfolded.drop("chunk", "chunk_rows")
