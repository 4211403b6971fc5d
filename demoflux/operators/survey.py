"""Survey-weighted proportions with confidence limits.

Everything is a ratio of sums, so hot groups are reduced on the map side and each
estimate needs one aggregation of the rows, whose sums are written once and then read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demoflux.functions.semantics import inverse_logit, safe_div
from demoflux.functions.student import t_975
from demoflux.operators.joins import join_nullsafe
from demoflux.session import cut_lineage


@dataclass(frozen=True)
class SurveyDesign:
    """A person table with its weight and, for clustered samples, the sampling units and strata."""

    df: DataFrame
    weight: str = "PERWT"
    psu: str | None = None
    strata: str | None = None


def _with_limits(estimates: DataFrame) -> DataFrame:
    """Limits on the logit scale; NULL at 0 and 1 and where no degree of freedom is left."""
    p, v = F.col("est"), F.greatest(F.col("variance"), F.lit(0.0))
    half = t_975(F.col("df")) * F.sqrt(v) / (p * (1 - p))
    logit = F.log(p / (1 - p))
    inside = (p > 0) & (p < 1)
    return (
        estimates.withColumn("low", F.when(inside, inverse_logit(logit - half)))
        .withColumn("upp", F.when(inside, inverse_logit(logit + half)))
    )


def survey_proportion(
    design: SurveyDesign, y: Column, by: Sequence[str], overall: Mapping[str, object] | None = None
) -> DataFrame:
    """Weighted proportion of a 0/1 value per group, with 95% limits.

    Rows with a NULL value are left out of the estimate but stay in the design. The design's
    row count is the sum of the groups' counts, as one value. `overall` names keys and a label for each:
    further rows then give the proportion over all values of these keys, under the labels. They are
    summed from the groups' sums, so the rows are read once.
    Columns: the keys, est, variance, df, n, low, upp.
    """
    if design.psu is not None:
        raise ValueError("use clustered_proportion for a clustered design")
    w, y = F.col(design.weight), y.cast("double")
    valid = F.when(y.isNotNull(), w)
    # stored, as the total below would otherwise read all rows a second time
    cells = cut_lineage(design.df.groupBy(*by).agg(
        F.sum(valid).alias("_w"), F.sum(w * y).alias("_wy"), F.sum(valid * valid).alias("_ww"),
        F.sum(w * w * y).alias("_wwy"), F.count(y).alias("n"), F.count(F.lit(1)).alias("_rows"),
    ))
    total = cells.agg(F.sum("_rows")).scalar()
    if overall:
        sums = [c for c in cells.columns if c not in by]
        both = cells.withColumn("_over", F.explode(F.array(F.lit(False), F.lit(True))))
        both = both.withColumns({k: F.when(F.col("_over"), F.lit(v)).otherwise(F.col(k)) for k, v in overall.items()})
        cells = both.groupBy(*by, "_over").agg(*[F.sum(c).alias(c) for c in sums])
    est = F.col("_wy") / F.col("_w")
    spread = (1 - 2 * F.col("est")) * F.col("_wwy") + F.col("est") * F.col("est") * F.col("_ww")
    result = (
        cells.withColumn("_total", total.cast("double"))
        .filter(F.col("n") > 0)
        .withColumn("est", est)
        .withColumn("variance", safe_div(F.col("_total"), F.col("_total") - 1) * spread / (F.col("_w") * F.col("_w")))
        .withColumn("df", F.col("n") - 1)
    )
    return _with_limits(result).select(*by, "est", "variance", "df", "n", "low", "upp")


def clustered_proportion(design: SurveyDesign, y: Column, by: Sequence[str]) -> DataFrame:
    """Weighted proportion per group under a stratified cluster design.

    Unit totals are taken first, then combined per stratum. With p the group's estimate
    and (s, w) a unit's sums of w*y and w, the unit's deviation is s - p*w, so the squared
    deviations are sums of s*s, s*w and w*w and need no second look at the rows. Units of a
    stratum without rows in the group count as zero; a stratum with a single unit adds nothing.
    """
    if design.psu is None or design.strata is None:
        raise ValueError("the design needs psu and strata")
    w, y = F.col(design.weight), y.cast("double")
    valid = F.when(y.isNotNull(), w)
    every = cut_lineage(design.df.groupBy(*by, design.strata, design.psu).agg(
        F.sum(w * y).alias("_s"), F.sum(valid).alias("_w"), F.count(y).alias("_n")
    ))
    units = every.filter(F.col("_n") > 0)
    strata = units.groupBy(*by, design.strata).agg(
        F.sum("_s").alias("_s"), F.sum("_w").alias("_w"), F.sum("_n").alias("_n"),
        F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.sum(F.col("_s") * F.col("_w")).alias("_sw"),
        F.sum(F.col("_w") * F.col("_w")).alias("_ww"), F.count(F.lit(1)).alias("_units"),
    )
    sizes = every.select(design.strata, design.psu).distinct().groupBy(design.strata).agg(
        F.count(F.lit(1)).alias("_m"))
    strata = join_nullsafe(strata, sizes, [design.strata], "left")
    group = Window.partitionBy(*by)
    est = F.sum("_s").over(group) / F.sum("_w").over(group)
    m, p = F.col("_m"), F.col("_p")
    deviation = F.col("_ss") - 2 * p * F.col("_sw") + p * p * F.col("_ww")
    total = F.col("_s") - p * F.col("_w")
    part = F.when(m > 1, m / (m - 1) * (deviation - total * total / m)).otherwise(0.0)
    result = (
        strata.withColumn("_p", est).withColumn("_part", part)
        .groupBy(*by).agg(
            F.max("_p").alias("est"), (F.sum("_part") / (F.sum("_w") * F.sum("_w"))).alias("variance"),
            (F.sum("_units") - F.count(F.lit(1))).alias("df"), F.sum("_n").alias("n"),
        )
    )
    return _with_limits(result).select(*by, "est", "variance", "df", "n", "low", "upp")
