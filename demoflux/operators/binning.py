"""Quantile classes, histograms and dense codes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demoflux.operators.joins import join_nullsafe
from demoflux.operators.numbering import dense_ranks

SPLITTERS = 256  # of one level, over all ranks
SKETCH = 10_000  # accuracy of the sketch that splitters come from


def _values_at_ranks(df: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at the given zero-based ranks of the sorted column, exactly.

    All ranks are narrowed down together. Each level takes splitters from a sketch of the values that are still open, and counts the
    rows at every splitter and between neighbours. A rank at a splitter is found; another one moves into the gap that holds it. A
    value with many rows is a splitter soon, and each level leaves fewer values open, so it ends however they
    are spread. Only splitters and counts reach the driver.
    """
    x = F.col(column)
    low, high = df.agg(F.min(x), F.max(x)).first()
    found: dict[int, float] = {}
    opened = [(low, high, 0, sorted(set(ranks)))]
    while opened:
        for low, high, _, wanted in opened:
            if low == high:
                found.update({r: low for r in wanted})
        opened = [o for o in opened if o[0] != o[1]]
        if not opened:
            break
        number = F.lit(None).cast("int")
        for i, (low, high, _, _) in enumerate(opened):
            number = F.when((x >= F.lit(low)) & (x <= F.lit(high)), F.lit(i)).otherwise(number)
        inside = df.select(x, number.alias("_range")).filter(F.col("_range").isNotNull())
        each = max(1, SPLITTERS // len(opened))
        sketch = inside.groupBy("_range").agg(F.percentile_approx(x, [(i + 1) / (each + 1) for i in range(each)], SKETCH).alias("at"))
        splitters = F.array(*[F.lit(v) for v in sorted({v for r in sketch.collect() for v in r["at"]})])
        place = 2 * F.size(F.filter(splitters, lambda v: v < x)) + F.array_contains(splitters, x).cast("int")
        counts = inside.groupBy("_range", place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        closer, seen, last = [], 0, None
        for r in sorted(counts.collect(), key=lambda r: (r["_range"], r["place"])):
            if r["_range"] != last:
                last, seen = r["_range"], opened[r["_range"]][2]
            here = [k for k in opened[last][3] if seen <= k < seen + r["n"]]
            if here:
                closer.append((r["low"], r["high"], seen, here))
            seen += r["n"]
        opened = closer
    return found


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """Quantiles with linear interpolation between neighbouring ranks.

    `df` is read several times, so pass a stored or checkpointed table.
    """
    present = df.select(F.col(column).cast("double").alias(column)).filter(F.col(column).isNotNull())
    n = present.count()
    if n == 0:
        return []
    places = [(n - 1) * p for p in probabilities]
    ranks = {r for h in places for r in (math.floor(h), min(math.floor(h) + 1, n - 1))}
    at = _values_at_ranks(present, column, sorted(ranks))
    result = []
    for h in places:
        low = math.floor(h)
        a, b = at[low], at[min(low + 1, n - 1)]
        result.append(a + (h - low) * (b - a))
    return result


def quantile_class(x: Column, breaks: Sequence[float]) -> Column:
    """Class 1..n of x between quantile breaks: closed on the right, the lowest value included."""
    ladder = F.when((x >= breaks[0]) & (x <= breaks[1]), F.lit(1))
    for i, (low, high) in enumerate(zip(breaks[1:], breaks[2:]), start=2):
        ladder = ladder.when((x > low) & (x <= high), F.lit(i))
    return ladder


def cut_number(df: DataFrame, column: str, classes: int, name: str) -> DataFrame:
    """Add equal-count classes; NULL values have no class."""
    breaks = exact_quantiles(df, column, [i / classes for i in range(classes + 1)])
    if not breaks:
        return df.withColumn(name, F.lit(None).cast("int"))
    if len(set(breaks)) <= classes:
        raise ValueError("too few distinct values for the number of classes")
    return df.withColumn(name, quantile_class(F.col(column), breaks))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Rows per equal-width bin between the smallest and largest value; the last bin is closed.

    Values are counted first, so a frequent value costs one row, and `df` should be stored.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    ends = df.agg(F.struct(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))).scalar()
    bounded = counts.withColumn("_ends", ends)
    low, high = F.col("_ends.low"), F.col("_ends.high")
    width = (high - low) / F.lit(float(bins))
    index = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - low, width)), F.lit(0)), F.lit(bins - 1))
    return bounded.groupBy(index.cast("int").alias("bin")).agg(
        F.min(low + index * width).alias("bin_start"), F.sum("n").alias("n"))


def dense_code(df: DataFrame, column: str, name: str) -> DataFrame:
    """Codes 1, 2, ... for the sorted distinct values of a factor column, of any number; NULL has none."""
    return join_nullsafe(df, dense_ranks(df, column, name), [column], "left")
