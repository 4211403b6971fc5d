"""Completed grids and change between two points in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demoflux.functions.semantics import safe_div


def observed_levels(df: DataFrame, column: str) -> Column:
    """The distinct values of a column as one array value, however many they are.

    The grid it is used for holds every level for every area, so the array is small beside it.
    """
    return df.select(column).distinct().agg(F.sort_array(F.collect_list(column))).scalar()


def _levels(values: Sequence | Column) -> Column:
    return values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])


def complete_grid(
    cells: DataFrame,
    area: Sequence[str],
    levels: dict[str, Sequence | Column],
    fill: dict[str, float | None],
    companions: Sequence[str] = (),
) -> DataFrame:
    """Every (area, level, ...) cell, with missing measures filled.

    `cells` holds one row per (area, levels). The cells of one area are packed into a map
    (at most the product of the level lists), and the grid is unfolded from the area's own
    row, so no table is crossed with another. Companion columns, arrays of values seen with
    the area, are merged per area.
    """
    dims = list(levels)
    entry = F.struct(F.struct(*dims).alias("key"), F.struct(*fill).alias("value"))
    merged = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in companions]
    packed = cells.groupBy(*area).agg(F.map_from_entries(F.collect_list(entry)).alias("_cells"), *merged)
    for name, values in levels.items():
        packed = packed.withColumn(name, F.explode(_levels(values)))
    found = packed.withColumn("_value", F.try_element_at("_cells", F.struct(*dims)))
    filled = [
        (F.col(f"_value.{m}") if default is None else F.coalesce(F.col(f"_value.{m}"), F.lit(default))).alias(m)
        for m, default in fill.items()
    ]
    return found.select(*area, *dims, *filled, *companions)


def value_at(time: str, point: int, value: str) -> Column:
    """The value of the row at one point in time, as an aggregate."""
    return F.max(F.when(F.col(time) == point, F.col(value)))


def two_point(
    df: DataFrame,
    by: Sequence[str],
    time: str,
    first: int,
    last: int,
    values: Sequence[str],
    missing: str = "drop",
    keep: Sequence[Column] = (),
) -> DataFrame:
    """First and last value of each measure per group, one row per group.

    A group without a row at both points is dropped, or kept with NULL when
    missing='null'. `keep` are further aggregates to carry along.
    """
    if missing not in ("drop", "null"):
        raise ValueError("missing is drop or null")
    at_first, at_last = F.col(time) == first, F.col(time) == last
    ends = [
        e for v in values
        for e in (value_at(time, first, v).alias(f"{v}_first"), value_at(time, last, v).alias(f"{v}_last"))
    ]
    grouped = df.filter(at_first | at_last).groupBy(*by).agg(
        F.count(F.when(at_first, 1)).alias("_n_first"), F.count(F.when(at_last, 1)).alias("_n_last"), *ends, *keep
    )
    if missing == "drop":
        grouped = grouped.filter((F.col("_n_first") > 0) & (F.col("_n_last") > 0))
    return grouped.drop("_n_first", "_n_last")


def difference(value: str) -> Column:
    return F.col(f"{value}_last") - F.col(f"{value}_first")


def growth_rate(value: str) -> Column:
    return safe_div(difference(value), F.col(f"{value}_first"))


def end_ratio(value: str) -> Column:
    return safe_div(F.col(f"{value}_last"), F.col(f"{value}_first"))
