"""Origin-destination flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demoflux.functions.semantics import safe_div
from demoflux.operators.aggregate import conditional_sum


def flow_matrix(
    df: DataFrame,
    destination: str,
    origin: str,
    by: Sequence[str] = (),
    weight: str = "PERWT",
    name: str = "value",
    zero_diagonal: bool = False,
) -> DataFrame:
    """Weighted flow between every observed pair of places; rows with a missing place are left out."""
    known = df.filter(F.col(destination).isNotNull() & F.col(origin).isNotNull())
    flows = known.groupBy(*by, destination, origin).agg(F.sum(weight).alias(name))
    if zero_diagonal:
        flows = flows.withColumn(name, F.when(F.col(destination) == F.col(origin), F.lit(0.0)).otherwise(F.col(name)))
    return flows


def net_migration(
    df: DataFrame, destination: str, origin: str, by: Sequence[str], weight: str = "PERWT", place: str = "place",
    name: str = "net",
) -> DataFrame:
    """Arrivals minus departures per place, in one pass: each move counts for one place and against another."""
    moves = df.filter(F.col(destination) != F.col(origin))
    flows = moves.groupBy(*by, destination, origin).agg(F.sum(weight).alias("_w"))
    signed = F.array(
        F.struct(F.col(destination).alias("place"), F.col("_w").alias("w")),
        F.struct(F.col(origin).alias("place"), (-F.col("_w")).alias("w")),
    )
    halves = flows.select(*by, F.explode(signed).alias("half"))
    return halves.groupBy(F.col("half.place").alias(place), *by).agg(F.sum("half.w").alias(name))


def arrival_ratio(df: DataFrame, external: Column, by: Sequence[str], weight: str = "PERWT") -> DataFrame:
    """Weight of internal arrivals over external arrivals; NULL where a side is absent."""
    inside = F.sum(F.when(~external, F.col(weight)))
    outside = F.sum(F.when(external, F.col(weight)))
    return df.groupBy(*by).agg(safe_div(inside, outside).alias("ratio"))


def leaving_rate(df: DataFrame, left: Column, by: Sequence[str], weight: str = "PERWT") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), safe_div(conditional_sum(weight, left), F.sum(weight)).alias("rate")
    )
