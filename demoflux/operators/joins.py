"""Equi-joins with survey-table semantics: missing keys match each other.

No side is forced to be broadcast: Spark broadcasts a side whose size it knows to be
under its threshold, and otherwise shuffles, splitting skewed partitions at run time.
Only tables written out literally in code are hinted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """All columns the two tables have in common."""
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("the tables have no column in common")
    return keys


def join_nullsafe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys where NULL equals NULL; one copy of each key is kept."""
    if how not in ("left", "right", "inner"):
        raise ValueError("how is left, right or inner")
    on = list(on)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    condition: Column | None = None
    for k in on:
        same = left[k].eqNullSafe(renamed[f"_right_{k}"])
        condition = same if condition is None else condition & same
    joined = left.join(renamed, condition, how)
    if how == "right":
        joined = joined.withColumns({k: F.col(f"_right_{k}") for k in on})
    return joined.drop(*[f"_right_{k}" for k in on])


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    return join_nullsafe(left, right, natural_keys(left, right), how)


def role_lookup(lookup: DataFrame, suffix: str) -> DataFrame:
    """The same lookup under other names, to join it a second time in another role."""
    return lookup.withColumnsRenamed({c: f"{c}{suffix}" for c in lookup.columns})


def membership_flag(df: DataFrame, members: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """TRUE where the row's key occurs among the members, else FALSE. No key is collected."""
    marked = members.select(*on).distinct().withColumn(name, F.lit(True))
    return join_nullsafe(df, marked, on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def band_of_ages(labels: DataFrame, ages: str, bands: DataFrame, band_ages: str) -> DataFrame:
    """Join each label to the bands that contain all of its ages.

    The label is joined on its first age with the ages of each band, so the join has an
    equality key; containment of the rest is then checked. Ages that no band holds give a label without band.
    """
    by_age = bands.withColumn("_age", F.explode(band_ages))
    keyed = labels.withColumn("_first", F.array_min(ages))
    inside = F.size(F.array_except(F.col(ages), F.col(band_ages))) == 0
    joined = keyed.join(by_age, (F.col("_first") == F.col("_age")) & inside, "left")
    return joined.drop("_first", "_age")


def fan_out(df: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Lookup keys that would duplicate rows of df, with the number of copies."""
    copies = lookup.groupBy(*on).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    return copies.join(df.select(*on).distinct(), list(on), "left_semi")
