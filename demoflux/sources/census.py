"""Long census tables: selection, normalising, fan-in and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_estimates(
    long: DataFrame,
    variables: Sequence[str] | Mapping[str, str] | None = None,
    states: Sequence[str] | None = None,
    counties: Sequence[str] | None = None,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """The part of a stored long table that a pull would return; filters reach the scan.

    With a mapping, `variables` are given names that replace their codes.
    """
    if variables is not None:
        codes = list(variables.values()) if isinstance(variables, Mapping) else list(variables)
        long = long.filter(F.col("variable").isin(codes))
        if isinstance(variables, Mapping):
            named = None
            for name, code in variables.items():
                hit = F.col("variable") == code
                named = F.when(hit, name) if named is None else named.when(hit, name)
            long = long.withColumn("variable", named)
    for column, values in (("state", states), ("county", counties), ("year", years)):
        if values is not None:
            long = long.filter(F.col(column).isin(list(values)))
    return long


def normalise_decennial(long: DataFrame) -> DataFrame:
    """Counts of a full census under the survey table's column name."""
    return long.withColumnRenamed("value", "estimate")


def fan_in(tables: Sequence[tuple[DataFrame, Mapping[str, object]]]) -> DataFrame:
    """Stack tables by column name, each with its own tags; columns a table lacks are NULL."""
    result = None
    for table, tags in tables:
        tagged = table.withColumns({k: F.lit(v) for k, v in tags.items()})
        result = tagged if result is None else result.unionByName(tagged, allowMissingColumns=True)
    return result


def label_columns(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Attach codebook text to columns."""
    for name, text in labels.items():
        if name in df.columns:
            df = df.withMetadata(name, {"label": text})
    return df


def column_label(df: DataFrame, name: str) -> str | None:
    return df.schema[name].metadata.get("label")
