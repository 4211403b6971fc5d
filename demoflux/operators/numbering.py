"""Row numbers and dense ranks over a whole table, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demoflux.session import cut_lineage

ROW_BITS = 33  # of monotonically_increasing_id: the lower bits count the rows of a partition, the upper ones the partitions


def _sort_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _with_offsets(placed: DataFrame, size: Column) -> DataFrame:
    """Rows with `_part`, and `_before`: the sum of `size` in all earlier partitions.

    What the driver adds up is one number per partition; it is joined back as a table of as many rows.
    """
    spark = placed.sparkSession
    total, offsets = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("_part").agg(size).collect())):
        offsets.append((part, total))
        total += n
    before = spark.createDataFrame(offsets, "_part bigint, _before bigint")
    return placed.join(F.broadcast(before), "_part")


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Every row with its number 1, 2, ... in the given order.

    Rows are dealt into ranges between sampled splitters and sorted there; a row's number is its place in its range after
    all rows of earlier ranges. Rows that are equal in `order` are told apart by a hash of the whole row, so
    that they are dealt over several ranges as well; rows equal in all columns can stand in any order.
    The sorted rows are written once, as the ranges must not be drawn anew between the two passes.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keys = [*_sort_columns(order), F.col("_tie")]
    dealt = df.withColumn("_tie", tie).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut_lineage(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_at", ROW_BITS))
    place = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    counted = _with_offsets(placed, F.count(F.lit(1)))
    return counted.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + place + 1).alias(name))


def dense_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): every distinct value with its number in sorted order. NULL has none."""
    levels = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return numbered(levels, [column], name)
