"""Weighted aggregates and shares.

Shares come in two forms. `share_in_group` uses a window and is for cells whose
groups are bounded by recode labels (age bands, races). `share_of_total` sums first
and looks the totals up, for cells that grow with the data (areas): no task then
holds all cells of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demoflux.functions.semantics import safe_div
from demoflux.operators.joins import join_nullsafe


def weighted_count(df: DataFrame, by: Sequence[str], weight: str = "PERWT", name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(weight).alias(name))


def conditional_sum(weight: str, condition: Column) -> Column:
    """Sum of the weights where the condition holds; 0 when it never does."""
    return F.sum(F.when(condition, F.col(weight)).otherwise(F.lit(0.0)))


def weighted_mean(x: Column | str, weight: str = "PERWT") -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return safe_div(F.sum(x * F.col(weight)), F.sum(F.when(x.isNotNull(), F.col(weight))))


def weighted_rate(flag: Column, weight: str = "PERWT") -> Column:
    """Weighted share of rows with the flag set."""
    return safe_div(conditional_sum(weight, flag), F.sum(weight))


def strict_sum(x: str) -> Column:
    """Sum that is NULL as soon as one value is missing."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def strict_mean(x: str) -> Column:
    """Mean that is NULL as soon as one value is missing."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def share_in_group(cells: DataFrame, value: str, by: Sequence[str], name: str = "share") -> DataFrame:
    """Each cell's share of its group, by window."""
    return cells.withColumn(name, safe_div(F.col(value), F.sum(value).over(Window.partitionBy(*by))))


def group_total(cells: DataFrame, value: Column | str, by: Sequence[str], name: str) -> DataFrame:
    """Attach a group sum to the rows, by window."""
    return cells.withColumn(name, F.sum(value).over(Window.partitionBy(*by)))


def share_of_total(
    cells: DataFrame, totals_from: DataFrame, value: str, by: Sequence[str] = (), name: str = "share",
) -> DataFrame:
    """Each cell's share of the sum over `totals_from` with the same keys `by`.

    `totals_from` may be rows rather than cells, as sums of sums agree; it is summed with partial
    aggregation, and the totals are joined, however many they are.
    """
    if not by:
        return cells.withColumn(name, safe_div(F.col(value), totals_from.agg(F.sum(value)).scalar()))
    totals = totals_from.groupBy(*by).agg(F.sum(value).alias("_total"))
    joined = join_nullsafe(cells, totals, by, "left")
    return joined.withColumn(name, safe_div(F.col(value), F.col("_total"))).drop("_total")


def aggregate_each(df: DataFrame, by: Sequence[str], columns: Sequence[str], f: Callable[[str], Column]) -> DataFrame:
    """The same aggregate over a list of columns, each keeping its name."""
    return df.groupBy(*by).agg(*[f(c).alias(c) for c in columns])


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def columns_of_type(df: DataFrame, kind: type[T.DataType], skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kind) and f.name not in skip]


def map_columns(df: DataFrame, columns: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    """Replace every listed column by f of it."""
    return df.withColumns({c: f(F.col(c)) for c in columns})


def rename_each(df: DataFrame, columns: Sequence[str], f: Callable[[str], str]) -> DataFrame:
    return df.withColumnsRenamed({c: f(c) for c in columns})


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the columns from first to last, as they stand."""
    names = df.columns
    return names[names.index(first): names.index(last) + 1]


def pack_distinct(column: str) -> Column:
    """Distinct values as an array; for columns with few values per group."""
    return F.collect_set(column)
