"""Survey estimates with limits, and logistic models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoflux.functions import recode
from demoflux.functions.semantics import age_band, paste
from demoflux.functions.student import Z_975, t_table
from demoflux.operators.models import (
    COEFFICIENTS, coefficient_table, covariate_patterns, crossed, design_bic, factor_levels, fit_logistic, fit_many, fitted_probability, predict_band,
    terms,
)
from demoflux.operators.survey import SurveyDesign, clustered_proportion, survey_proportion
from demoflux.plans.person import person, with_person
from demoflux.plans.registry import query, r6


def t_sql(df: str) -> str:
    """The t factor in SQL: the same table for few degrees of freedom, the same series beyond."""
    z = Z_975
    terms_ = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    table = ", ".join(f"{v!r}::DOUBLE" for v in t_table())
    a, b, c = (f"{v!r}::DOUBLE" for v in terms_)
    n = f"CAST({df} AS DOUBLE)"
    return (f"(CASE WHEN {df} > 200 THEN {z!r}::DOUBLE + {a}/{n} + {b}/({n}*{n}) + {c}/({n}*{n}*{n}) "
            f"WHEN {df} >= 1 THEN [{table}][{df}] END)")


def limits_sql(source: str, keys: str) -> str:
    half = f"{t_sql('df')} * sqrt(greatest(v, 0)) / (p * (1 - p))"
    return f"""
SELECT {keys}, n, round(p, 6) AS est,
  CASE WHEN p > 0 AND p < 1 THEN round(1 / (1 + exp(-(ln(p / (1 - p)) - {half}))), 6) END AS low,
  CASE WHEN p > 0 AND p < 1 THEN round(1 / (1 + exp(-(ln(p / (1 - p)) + {half}))), 6) END AS upp
FROM ({source})
"""


def _rounded(estimates, by):
    return estimates.select(*by, "n", *[r6(c).alias(c) for c in ("est", "low", "upp")])


@query("q8_fertility_rate", with_person(limits_sql("""
  SELECT *, (SELECT count(*) FROM person) / ((SELECT count(*) FROM person) - 1.0)
      * ((1 - 2 * p) * wwy + p * p * ww) / (w * w) AS v, n - 1 AS df
  FROM (SELECT band AS age_group, race4 AS race, YEAR AS year, cluster_now AS cluster, count(*) AS n, sum(PERWT) AS w,
          sum(PERWT * PERWT) AS ww, sum(PERWT * PERWT * (FERTYR - 1)) AS wwy, sum(PERWT * (FERTYR - 1)) / sum(PERWT) AS p
        FROM person WHERE FERTYR IN (1, 2) GROUP BY ALL)
""", "age_group, race, year, cluster")))
def fertility_rate(spark, folder):
    rows = person(spark, folder, "AGE", "HISPAN", "RACE", "YEAR", "Cluster", "FERTYR", "PERWT").select(
        age_band("AGE").alias("age_group"), recode.race([4]).alias("race"), F.col("YEAR").alias("year"),
        F.col("Cluster").alias("cluster"), "FERTYR", "PERWT")
    by = ["age_group", "race", "year", "cluster"]
    return _rounded(survey_proportion(SurveyDesign(rows), recode.had_child_last_year(), by), by)


@query("q8a_migration_rate_with_limits", with_person(limits_sql("""
  SELECT *, (SELECT count(*) FROM person) / ((SELECT count(*) FROM person) - 1.0)
      * ((1 - 2 * p) * wwy + p * p * ww) / (w * w) AS v, n - 1 AS df
  FROM (SELECT band AS age_group, origin9 AS origin, YEAR AS year, count(*) AS n, sum(PERWT) AS w,
          sum(PERWT * PERWT) AS ww, sum(CASE WHEN MIGCOUNTY1 <> 0 THEN PERWT * PERWT ELSE 0 END) AS wwy,
          sum(CASE WHEN MIGCOUNTY1 <> 0 THEN PERWT ELSE 0 END) / sum(PERWT) AS p
        FROM person GROUP BY ALL)
""", "age_group, origin, year")))
def migration_rate_with_limits(spark, folder):
    rows = person(spark, folder, "AGE", "HISPAN", "RACE", "BPL", "YEAR", "MIGCOUNTY1", "PERWT").select(
        age_band("AGE").alias("age_group"), recode.origin_nine().alias("origin"), F.col("YEAR").alias("year"),
        "MIGCOUNTY1", "PERWT")
    by = ["age_group", "origin", "year"]
    return _rounded(survey_proportion(SurveyDesign(rows), recode.moved_county(), by), by)


@query("q8c_fertility_by_origin", with_person(limits_sql("""
  SELECT *, (SELECT count(*) FROM person) / ((SELECT count(*) FROM person) - 1.0)
      * ((1 - 2 * p) * wwy + p * p * ww) / (w * w) AS v, n - 1 AS df
  FROM (SELECT band AS age_group, origin9 AS origin, YEAR AS year, cluster_now AS cluster, count(*) AS n, sum(PERWT) AS w,
          sum(PERWT * PERWT) AS ww, sum(PERWT * PERWT * (FERTYR - 1)) AS wwy, sum(PERWT * (FERTYR - 1)) / sum(PERWT) AS p
        FROM person WHERE FERTYR IN (1, 2) GROUP BY ALL)
""", "age_group, origin, year, cluster")))
def fertility_by_origin(spark, folder):
    rows = person(spark, folder, "AGE", "HISPAN", "RACE", "BPL", "YEAR", "Cluster", "FERTYR", "PERWT").select(
        age_band("AGE").alias("age_group"), recode.origin_nine().alias("origin"), F.col("YEAR").alias("year"),
        F.col("Cluster").alias("cluster"), "FERTYR", "PERWT")
    by = ["age_group", "origin", "year", "cluster"]
    return _rounded(survey_proportion(SurveyDesign(rows), recode.had_child_last_year(), by), by)


@query("q8d_migration_trend", with_person(limits_sql("""
  SELECT *, (SELECT count(*) FROM person) / ((SELECT count(*) FROM person) - 1.0)
      * ((1 - 2 * p) * wwy + p * p * ww) / (w * w) AS v, n - 1 AS df
  FROM (SELECT YEAR AS year, CASE WHEN grouping(band) = 1 THEN -1 ELSE band END AS age_group, count(*) AS n, sum(PERWT) AS w,
          sum(PERWT * PERWT) AS ww, sum(CASE WHEN MIGRATE1D >= 24 THEN PERWT * PERWT ELSE 0 END) AS wwy,
          sum(CASE WHEN MIGRATE1D >= 24 THEN PERWT ELSE 0 END) / sum(PERWT) AS p
        FROM person GROUP BY GROUPING SETS ((YEAR), (YEAR, band)))
""", "year, age_group")))
def migration_trend(spark, folder):
    """Migration rate per year, and per year and age band; the rate over all bands has the label -1."""
    rows = person(spark, folder, "AGE", "YEAR", "MIGRATE1D", "PERWT").select(
        age_band("AGE").alias("age_group"), F.col("YEAR").alias("year"), "MIGRATE1D", "PERWT")
    by = ["year", "age_group"]
    return _rounded(survey_proportion(SurveyDesign(rows), recode.moved_area(), by, overall={"age_group": -1}), by)


@query("q8b_clustered_migration_rate", with_person(limits_sql("""
  SELECT year, origin, max(p) AS p, sum(n) AS n, CAST(sum(units) - count(*) AS BIGINT) AS df,
    sum(CASE WHEN m > 1 THEN m / (m - 1.0) * (uu - u * u / m) ELSE 0 END) AS v
  FROM (SELECT year, origin, stratum, any_value(p) AS p, sum(n) AS n, count(*) AS units, sum(u) AS u, sum(u * u) AS uu
        FROM (SELECT r.year, r.origin, stratum, SERIAL, any_value(p) AS p, count(*) AS n, sum(PERWT * (y - p) / w) AS u
              FROM rows r JOIN (SELECT year, origin, sum(PERWT * y) / sum(PERWT) AS p, sum(PERWT) AS w FROM rows GROUP BY ALL) g
                ON r.year = g.year AND r.origin = g.origin
              GROUP BY r.year, r.origin, stratum, SERIAL) GROUP BY year, origin, stratum)
  JOIN (SELECT stratum, count(DISTINCT SERIAL) AS m FROM rows GROUP BY stratum) USING (stratum)
  GROUP BY year, origin
""", "year, origin"), """
rows AS (SELECT YEAR AS year, origin6 AS origin, STRATA || '_' || YEAR AS stratum, SERIAL, PERWT,
  CASE WHEN MIGCOUNTY1 <> 0 THEN 1.0::DOUBLE ELSE 0.0 END AS y FROM person)
""").replace("SELECT year, origin, n,", "SELECT year, origin, CAST(n AS BIGINT) AS n,"))
def clustered_migration_rate(spark, folder):
    rows = person(spark, folder, "YEAR", "BPL", "HISPAN", "STRATA", "SERIAL", "MIGCOUNTY1", "PERWT").select(
        F.col("YEAR").alias("year"), recode.origin_six().alias("origin"), paste("_", "STRATA", "YEAR").alias("stratum"),
        "SERIAL", "MIGCOUNTY1", "PERWT")
    design = SurveyDesign(rows, psu="SERIAL", strata="stratum")
    by = ["year", "origin"]
    return _rounded(clustered_proportion(design, recode.moved_county(), by), by)


def _migration_patterns(spark, folder):
    """Covariate patterns of the migration models: one row per year, sex, origin, region and age."""
    rows = person(spark, folder, "YEAR", "SEX", "HISPAN", "RACE", "BPL", "Cluster", "AGE", "MIGRATE1D", "PERWT")
    kept = rows.withColumns({"BPLCR": recode.origin_collapsed(), "SEX": recode.sex_label()}).filter(
        F.col("BPLCR").isin("Native Hispanic", "Native White", "Mexico")
        & ~F.col("MIGRATE1D").isin(recode.ABROAD_OR_UNKNOWN_MOVE) & F.col("Cluster").isNotNull())
    prepared = kept.withColumns({"hasMigrated": recode.moved_area().cast("int"), "AGE2": F.pow("AGE", F.lit(2))})
    covariates = ["YEAR", "SEX", "BPLCR", "Cluster", "AGE", "AGE2"]
    return covariate_patterns(prepared, covariates, "hasMigrated", "PERWT")


FACTORS = ["YEAR", "SEX", "BPLCR", "Cluster"]


_PLACE = crossed("BPLCR", "Cluster")
_PLACE_AGE = crossed("BPLCR", "Cluster", "AGE")
_PLACE_AGE2 = crossed("AGE2", "BPLCR", "Cluster")

# The ten nested and competing models of moving, from the year alone to all interactions.
MIGRATION_MODELS = {
    "lm1": terms("YEAR"),
    "lm2": terms("YEAR", "SEX"),
    "lm3": terms("YEAR", "SEX", "BPLCR"),
    "lm4": terms("YEAR", "SEX", "BPLCR", "Cluster"),
    "lm5": terms("YEAR", "SEX", _PLACE),
    "lm6": terms("YEAR", "SEX", _PLACE, "AGE", "AGE2"),
    "lm7": terms("SEX", crossed("YEAR", "BPLCR", "Cluster"), "AGE", "AGE2"),
    "lm8": terms("SEX", "YEAR", _PLACE_AGE, _PLACE_AGE2),
    "lm9": terms("YEAR", crossed("SEX", "BPLCR", "Cluster", "AGE"), crossed("AGE2", "BPLCR", "Cluster", "SEX")),
    "lm10": terms("YEAR", crossed("SEX", "BPLCR"), _PLACE_AGE, _PLACE_AGE2),
}


def migration_model(spark, folder, name="lm6"):
    patterns = _migration_patterns(spark, folder)
    return patterns, fit_logistic(patterns, MIGRATION_MODELS[name], factor_levels(patterns, FACTORS))


@query("q27e_fitted_movers", with_person("""
SELECT YEAR AS year, SUM(w) AS persons, sum(wy) AS observed, sum(wy) AS fitted FROM (
  SELECT YEAR, PERWT AS w, CASE WHEN MIGRATE1D >= 24 THEN PERWT ELSE 0 END AS wy FROM person
  WHERE origin_c IN ('Native Hispanic', 'Native White', 'Mexico') AND MIGRATE1D NOT IN (0, 20, 40)
    AND cluster_now IS NOT NULL) GROUP BY ALL
"""))
def fitted_movers(spark, folder):
    """Weighted movers per year, counted and as the model predicts them.

    A fitted logistic model with a factor reproduces the weighted counts of the factor's levels, so
    the two columns agree.
    """
    patterns, fit = migration_model(spark, folder)
    predicted = patterns.withColumn("p", fitted_probability(fit))
    return predicted.groupBy(F.col("YEAR").alias("year")).agg(
        F.sum("_w").alias("persons"), F.sum("_wy").alias("observed"),
        F.round(F.sum(F.col("_w") * F.col("p")), 2).alias("fitted"))


@query("q27d_model_comparison")
def model_comparison(spark, folder):
    """Design-based BIC of two nested models, the larger one being the maximal model."""
    patterns = _migration_patterns(spark, folder)
    levels = factor_levels(patterns, FACTORS)
    fits = {name: fit_logistic(patterns, MIGRATION_MODELS[name], levels) for name in ("lm8", "lm10")}
    scores = [(name, design_bic(fit, fits["lm10"])) for name, fit in fits.items()]
    return spark.createDataFrame(
        [(name, int(s["p"]), s["bic"]) for name, s in scores], "model string, parameters int, bic double")


@query("q27_migration_model_band")
def migration_model_band(spark, folder):
    """Predicted probability of moving at age 25 for every observed group, with a simulated band."""
    patterns, fit = migration_model(spark, folder)
    grid = patterns.select(*FACTORS).distinct().dropna().withColumns({"AGE": F.lit(25), "AGE2": F.lit(625.0)})
    return predict_band(grid, fit, draws=1000, seed=7)


@query("q27b_migration_age_curve")
def migration_age_curve(spark, folder):
    """Over ages 15 to 65, unfolded from each group's own row, for one year: the model in which age meets origin and region."""
    patterns, fit = migration_model(spark, folder, "lm10")
    groups = patterns.filter(F.col("YEAR") == 2000).select(*FACTORS).distinct().dropna()
    grid = groups.withColumn("AGE", F.explode(F.sequence(F.lit(15), F.lit(65)))).withColumn(
        "AGE2", F.pow("AGE", F.lit(2)))
    return predict_band(grid, fit, draws=1000, seed=7)


@query("q27c_migration_model_coefficients")
def migration_model_coefficients(spark, folder):
    _, fit = migration_model(spark, folder)
    return coefficient_table(spark, fit)


@query("q27f_saturated_model_coefficients", with_person("""
SELECT CASE WHEN x.s = 'Female' AND x.o = 'Mexico' THEN '(Intercept)' WHEN x.s = 'Female' THEN 'BPLCR' || x.o
    WHEN x.o = 'Mexico' THEN 'SEX' || x.s ELSE 'SEX' || x.s || ':BPLCR' || x.o END AS term,
  round(x.l - CASE WHEN x.s = 'Male' THEN f.l ELSE 0 END - CASE WHEN x.o <> 'Mexico' THEN m.l ELSE 0 END
    + CASE WHEN x.s = 'Male' AND x.o <> 'Mexico' THEN b.l ELSE 0 END, 4) AS estimate,
  round(sqrt(x.v + CASE WHEN x.s = 'Male' THEN f.v ELSE 0 END + CASE WHEN x.o <> 'Mexico' THEN m.v ELSE 0 END
    + CASE WHEN x.s = 'Male' AND x.o <> 'Mexico' THEN b.v ELSE 0 END), 4) AS std_error
FROM logits x JOIN logits f ON f.s = 'Female' AND f.o = x.o JOIN logits m ON m.s = x.s AND m.o = 'Mexico'
JOIN logits b ON b.s = 'Female' AND b.o = 'Mexico'
""", """
kept AS (
  SELECT CASE WHEN SEX = 1 THEN 'Male' ELSE 'Female' END AS s, origin_c AS o, PERWT AS w,
    CASE WHEN MIGRATE1D >= 24 THEN 1.0::DOUBLE ELSE 0.0 END AS y
  FROM person WHERE origin_c IN ('Native Hispanic', 'Native White', 'Mexico') AND MIGRATE1D NOT IN (0, 20, 40)
    AND cluster_now IS NOT NULL),
rates AS (SELECT s, o, sum(w * y) / sum(w) AS p FROM kept GROUP BY ALL),
logits AS (
  SELECT s, o, ln(p / (1 - p)) AS l,
    (SELECT count(*) / (count(*) - 1.0) FROM kept) * sum(w * w * (y - p) * (y - p)) / pow(sum(w * p * (1 - p)), 2) AS v
  FROM kept JOIN rates USING (s, o) GROUP BY s, o, p)
"""))
def saturated_model_coefficients(spark, folder):
    """Sex x origin with all interactions: estimates and design-based errors, which have a closed form here."""
    patterns = _migration_patterns(spark, folder)
    factors = ["SEX", "BPLCR"]
    fit = fit_logistic(patterns, terms(crossed(*factors)), factor_levels(patterns, factors))
    return coefficient_table(spark, fit).select(
        "term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"))


@query("q27g_coefficients_of_all_models")
def coefficients_of_all_models(spark, folder):
    """All ten formulas from one pattern table, with their design-based errors."""
    patterns = _migration_patterns(spark, folder)
    fits = fit_many(patterns, MIGRATION_MODELS, factor_levels(patterns, FACTORS))
    tables = [coefficient_table(spark, fit).select(F.lit(name).alias("model"), "*") for name, fit in fits.items()]
    return reduce(DataFrame.unionAll, tables)


# The kept persons of the migration models, as cells of year and sex.
YEAR_SEX_SQL = """
kept AS (
  SELECT YEAR AS y, CASE WHEN SEX = 1 THEN 'Male' ELSE 'Female' END AS s, origin_c AS o, PERWT AS w,
    CASE WHEN MIGRATE1D >= 24 THEN 1.0::DOUBLE ELSE 0.0 END AS m
  FROM person WHERE origin_c IN ('Native Hispanic', 'Native White', 'Mexico') AND MIGRATE1D NOT IN (0, 20, 40)
    AND cluster_now IS NOT NULL)
"""


def _alternating_steps(rounds: int) -> str:
    """SQL: the additive model of year and sex, by Newton steps for the years and for the sex in turn."""
    parts = ["at_0 AS (SELECT y, s, sum(w) AS w, sum(w * m) AS wm, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM kept GROUP BY ALL)"]
    p = "(1 / (1 + exp(-(a + b))))"
    for i in range(rounds):
        effect, other, by, where = (("a", "b", "y", ""), ("b", "a", "s", " AND s = 'Male'"))[i % 2]
        parts.append(f"""at_{i + 1} AS MATERIALIZED (
  SELECT y, s, w, wm, {other}, {effect} + CASE WHEN true{where} THEN
    sum(wm - w * {p}) OVER (PARTITION BY {by}) / sum(w * {p} * (1 - {p})) OVER (PARTITION BY {by}) ELSE 0 END AS {effect} FROM at_{i})""")
    return ",\n".join([*parts, f"additive AS (SELECT y, s, a, b FROM at_{rounds})"])


@query("q27h_models_of_year_and_sex", with_person("""
SELECT 'lm1' AS model, CASE WHEN y = first THEN '(Intercept)' ELSE 'YEAR' || y END AS term,
  round(l - CASE WHEN y = first THEN 0 ELSE first_value(l) OVER (ORDER BY y) END, 4) AS estimate
FROM (SELECT y, (SELECT min(y) FROM kept) AS first, ln(sum(w * m) / sum(w * (1 - m))) AS l FROM kept GROUP BY y)
UNION ALL
SELECT 'lm2', CASE WHEN y = first THEN '(Intercept)' ELSE 'YEAR' || y END, round(a - CASE WHEN y = first THEN 0 ELSE first_value(a) OVER (ORDER BY y) END, 4)
FROM (SELECT y, (SELECT min(y) FROM kept) AS first, a FROM additive WHERE s = 'Female')
UNION ALL
SELECT 'lm2', 'SEXMale', round(max(b), 4) FROM additive WHERE s = 'Male'
""", YEAR_SEX_SQL, _alternating_steps(60)))
def models_of_year_and_sex(spark, folder):
    """The two smallest of the formulas, fitted together with all others; these two can be followed in SQL."""
    patterns = _migration_patterns(spark, folder)
    fits = fit_many(patterns, MIGRATION_MODELS, factor_levels(patterns, FACTORS))
    tables = [coefficient_table(spark, fits[name]).select(F.lit(name).alias("model"), "term", F.round("estimate", 4).alias("estimate"))
              for name in ("lm1", "lm2")]
    return reduce(DataFrame.unionAll, tables)


@query("q27i_bic_of_saturated_pair", with_person("""
SELECT model, parameters, round(wald + parameters * ln(n) + log_det + deviance, 3) AS bic FROM (
  SELECT 'SEX * BPLCR' AS model, 6 AS parameters, 0.0::DOUBLE AS wald, 0.0::DOUBLE AS log_det
  UNION ALL
  SELECT 'SEX + BPLCR', 4, (h.b * h.b * w.v - 2 * h.b * w.b * base.v + w.b * w.b * h.v) / (h.v * w.v - base.v * base.v),
    ln((h.v * w.v - base.v * base.v) / (h.u * w.u - base.u * base.u))
  FROM interactions h, interactions w, (SELECT sum(v) AS v, sum(u) AS u FROM logits WHERE o = 'Mexico') base
  WHERE h.o = 'Native Hispanic' AND w.o = 'Native White'),
(SELECT max(n) AS n, -2 * sum(w / mean_w * (p * ln(p) + (1 - p) * ln(1 - p))) AS deviance FROM logits)
""", YEAR_SEX_SQL, """
rates AS (SELECT s, o, sum(w * m) / sum(w) AS p FROM kept GROUP BY ALL),
logits AS (
  SELECT s, o, p, ln(p / (1 - p)) AS l, sum(w) AS w, (SELECT avg(w) FROM kept) AS mean_w, (SELECT count(*) FROM kept) AS n,
    (SELECT count(*) / (count(*) - 1.0) FROM kept) * sum(w * w * (m - p) * (m - p)) / pow(sum(w * p * (1 - p)), 2) AS v,
    (SELECT avg(w) FROM kept) / sum(w * p * (1 - p)) AS u
  FROM kept JOIN rates USING (s, o) GROUP BY s, o, p),
interactions AS (
  SELECT o, sum(CASE WHEN s = 'Male' THEN l ELSE -l END) - (SELECT sum(CASE WHEN s = 'Male' THEN l ELSE -l END) FROM logits WHERE o = 'Mexico') AS b,
    sum(v) + (SELECT sum(v) FROM logits WHERE o = 'Mexico') AS v, sum(u) + (SELECT sum(u) FROM logits WHERE o = 'Mexico') AS u
  FROM logits WHERE o <> 'Mexico' GROUP BY o)
"""))
def bic_of_saturated_pair(spark, folder):
    """Design-based BIC of sex and origin without and with their interaction; the larger model is saturated, so all of it has a closed form."""
    patterns = _migration_patterns(spark, folder)
    factors = ["SEX", "BPLCR"]
    models = {"SEX * BPLCR": terms(crossed(*factors)), "SEX + BPLCR": terms(*factors)}
    fits = fit_many(patterns, models, factor_levels(patterns, factors))
    scores = [(name, design_bic(fit, fits["SEX * BPLCR"])) for name, fit in fits.items()]
    return spark.createDataFrame(
        [(name, int(s["p"]), round(s["bic"], 3)) for name, s in scores], "model string, parameters int, bic double")


@query("q27j_band_of_years", with_person("""
SELECT y AS "YEAR", round(1 / (1 + exp(-max(l))), 6) AS fit,
  round(1 / (1 + exp(-quantile_cont(l + sqrt(v) * z, 0.025))), 6) AS lwr, round(1 / (1 + exp(-quantile_cont(l + sqrt(v) * z, 0.975))), 6) AS upr
FROM logits JOIN draws ON k = j GROUP BY y
""", YEAR_SEX_SQL, """
rates AS (SELECT y, sum(w * m) / sum(w) AS p, dense_rank() OVER (ORDER BY y) - 1 AS k FROM kept GROUP BY y),
logits AS (
  SELECT y, k, ln(p / (1 - p)) AS l,
    (SELECT count(*) / (count(*) - 1.0) FROM kept) * sum(w * w * (m - p) * (m - p)) / pow(sum(w * p * (1 - p)), 2) AS v
  FROM kept JOIN rates USING (y) GROUP BY y, k, p),
draws AS (
  SELECT j, sqrt(-2 * ln((('0x' || md5('r:7:' || i || ':' || j)[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496))
    * cos(2 * pi() * ((('0x' || md5('a:7:' || i || ':' || j)[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496)) AS z
  FROM range(1000) a(i), range(20) b(j))
"""))
def band_of_years(spark, folder):
    """Predicted probability of moving in each year with its simulated band.

    The model has one coefficient a year, so its coefficients' root turns every year's draws into that year's own.
    """
    patterns = _migration_patterns(spark, folder)
    fit = fit_many(patterns, {"lm1": MIGRATION_MODELS["lm1"]}, factor_levels(patterns, ["YEAR"]))["lm1"]
    band = predict_band(patterns.select("YEAR").distinct(), fit, draws=1000, seed=7)
    return band.select("YEAR", *[r6(c).alias(c) for c in ("fit", "lwr", "upr")])


UNWEIGHTED_FACTORS = ["SEX", "AGEG", "EDU", "MARRIED", "CHILD", "YEAR", "ETHCIT1"]


def _unweighted_model(spark, folder, response, *columns, kept):
    """A 0/1 response by sex, age group, schooling, marriage x children and year x ethnicity, without weights. Without rows there is no model."""
    rows = person(
        spark, folder, "SEX", "AGE", "EDUC", "MARST", "NCHILD", "YEAR", "BPL", "HISPAN", "RACE", "CITIZEN", *columns)
    flag = lambda c: F.when(c, "yes").otherwise("no")
    prepared = rows.filter(kept).select(
        "SEX", recode.working_age_group().alias("AGEG"), recode.education().alias("EDU"),
        flag(recode.married()).alias("MARRIED"), flag(recode.has_child()).alias("CHILD"), "YEAR",
        recode.ethnicity_citizenship().alias("ETHCIT1"), response.cast("int").alias("y"))
    patterns = covariate_patterns(prepared, UNWEIGHTED_FACTORS, "y", None)
    if patterns.isEmpty():
        return patterns, None
    model = terms("SEX", "AGEG", "EDU", crossed("MARRIED", "CHILD"), crossed("YEAR", "ETHCIT1"))
    levels = factor_levels(patterns, UNWEIGHTED_FACTORS)
    # the first level is the baseline, so these factors keep the order of their label lists
    levels |= {f: tuple(v for v in order if v in levels[f]) for f, order in (
        ("ETHCIT1", recode.ETHNICITY_CITIZENSHIP), ("EDU", recode.EDUCATION_LEVELS))}
    return patterns, fit_many(patterns, {"all": model}, levels, weighted=False)["all"]


def unweighted_model(spark, folder):
    """Moving to another county, of everyone of working age."""
    return _unweighted_model(spark, folder, recode.moved_county(), "MIGCOUNTY1", kept=F.col("AGE").between(18, 65))


def leaving_model(spark, folder):
    """Leaving the state, of people of working age who could have left it."""
    born = F.col("BPL").isin(200, 210, 300) | (F.col("BPL") <= 99)
    return _unweighted_model(
        spark, folder, recode.left_state(4), "MIGPLAC1", "STATEFIP",
        kept=born & F.col("AGE").between(18, 65) & recode.at_risk_of_leaving(4))


def _fitted_by_ethnicity(patterns, fit):
    predicted = patterns.withColumn("p", fitted_probability(fit) if fit else F.lit(0.0))
    return predicted.groupBy(F.col("ETHCIT1").alias("ethnicity"), F.col("YEAR").alias("year")).agg(
        F.sum("_n").alias("n"), F.sum("_wy").alias("observed"),
        F.round(F.sum(F.col("_w") * F.col("p")), 2).alias("fitted"))


@query("q40_unweighted_logistic")
def unweighted_logistic(spark, folder):
    return coefficient_table(spark, unweighted_model(spark, folder)[1])


@query("q40b_fitted_by_ethnicity", with_person("""
SELECT eth AS ethnicity, YEAR AS year, count(*) AS n, CAST(count(*) FILTER (MIGCOUNTY1 <> 0) AS DOUBLE) AS observed,
  CAST(count(*) FILTER (MIGCOUNTY1 <> 0) AS DOUBLE) AS fitted
FROM (SELECT *, CASE WHEN BPL < 100 AND HISPAN = 1 THEN 'Native Latino' WHEN BPL < 100 AND RACE = 1 THEN 'Native White'
          WHEN BPL >= 150 AND CITIZEN < 3 AND HISPAN = 1 THEN 'FB Latino Citizen'
          WHEN BPL >= 150 AND CITIZEN >= 3 AND HISPAN = 1 THEN 'FB Latino Non-Citizen' END AS eth
      FROM person WHERE AGE BETWEEN 18 AND 65)
WHERE eth IS NOT NULL GROUP BY ALL
"""))
def fitted_by_ethnicity(spark, folder):
    """Movers per ethnicity and year, counted and as the model with that interaction predicts them."""
    return _fitted_by_ethnicity(*unweighted_model(spark, folder))


@query("q40d_leaving_state_model")
def leaving_state_model(spark, folder):
    """All terms of the leaving model."""
    fit = leaving_model(spark, folder)[1]
    return coefficient_table(spark, fit) if fit else spark.createDataFrame([], COEFFICIENTS)


@query("q40e_fitted_leavers_by_ethnicity", with_person("""
SELECT eth AS ethnicity, YEAR AS year, count(*) AS n, CAST(count(*) FILTER (MIGPLAC1 = 4 AND STATEFIP <> 4) AS DOUBLE) AS observed,
  CAST(count(*) FILTER (MIGPLAC1 = 4 AND STATEFIP <> 4) AS DOUBLE) AS fitted
FROM (SELECT *, CASE WHEN BPL < 100 AND HISPAN = 1 THEN 'Native Latino' WHEN BPL < 100 AND RACE = 1 THEN 'Native White'
          WHEN BPL >= 150 AND CITIZEN < 3 AND HISPAN = 1 THEN 'FB Latino Citizen'
          WHEN BPL >= 150 AND CITIZEN >= 3 AND HISPAN = 1 THEN 'FB Latino Non-Citizen' END AS eth
      FROM person WHERE (BPL IN (200, 210, 300) OR BPL <= 99) AND AGE BETWEEN 18 AND 65
        AND ((MIGPLAC1 = 4 AND STATEFIP <> 4) OR (MIGPLAC1 IN (0, 4) AND STATEFIP = 4)))
WHERE eth IS NOT NULL GROUP BY ALL
"""))
def fitted_leavers_by_ethnicity(spark, folder):
    """Leavers per ethnicity and year, counted and as the model with that interaction predicts them."""
    return _fitted_by_ethnicity(*leaving_model(spark, folder))


@query("q40c_leaving_state_logistic", with_person("""
SELECT CASE WHEN x.eth = b.eth THEN '(Intercept)' ELSE 'ETHCIT1' || x.eth END AS term,
  round(ln(x.p / (1 - x.p)) - CASE WHEN x.eth = b.eth THEN 0 ELSE ln(b.p / (1 - b.p)) END, 4) AS estimate,
  round(sqrt(1 / (x.n * x.p * (1 - x.p)) + CASE WHEN x.eth = b.eth THEN 0 ELSE 1 / (b.n * b.p * (1 - b.p)) END), 4) AS std_error
FROM rates x JOIN rates b ON b.eth = 'Native White'
""", """
rates AS (
  SELECT eth, count(*)::DOUBLE AS n, avg(CASE WHEN MIGPLAC1 = 4 AND STATEFIP <> 4 THEN 1.0::DOUBLE ELSE 0.0 END) AS p
  FROM (SELECT *,
          CASE WHEN BPL < 100 AND HISPAN = 1 THEN 'Native Latino' WHEN BPL < 100 AND RACE = 1 THEN 'Native White'
            WHEN BPL >= 150 AND CITIZEN < 3 AND HISPAN = 1 THEN 'FB Latino Citizen'
            WHEN BPL >= 150 AND CITIZEN >= 3 AND HISPAN = 1 THEN 'FB Latino Non-Citizen' END AS eth
        FROM person WHERE (BPL IN (200, 210, 300) OR BPL <= 99) AND AGE BETWEEN 18 AND 65
          AND ((MIGPLAC1 = 4 AND STATEFIP <> 4) OR (MIGPLAC1 IN (0, 4) AND STATEFIP = 4)))
  WHERE eth IS NOT NULL GROUP BY eth)
"""))
def leaving_state_logistic(spark, folder):
    """Leaving the state among people at risk, by ethnicity against native whites, without weights."""
    rows = person(spark, folder, "AGE", "BPL", "HISPAN", "RACE", "CITIZEN", "MIGPLAC1", "STATEFIP")
    born = F.col("BPL").isin(200, 210, 300) | (F.col("BPL") <= 99)
    prepared = rows.filter(born & F.col("AGE").between(18, 65)).filter(recode.at_risk_of_leaving(4)).select(
        recode.ethnicity_citizenship().alias("ETHCIT1"), recode.left_state(4).cast("int").alias("left"))
    patterns = covariate_patterns(prepared, ["ETHCIT1"], "left", None)
    seen = factor_levels(patterns, ["ETHCIT1"])["ETHCIT1"]
    if recode.ETHNICITY_CITIZENSHIP[0] not in seen:  # nobody to compare with
        return spark.createDataFrame([], "term string, estimate double, std_error double")
    levels = {"ETHCIT1": tuple(v for v in recode.ETHNICITY_CITIZENSHIP if v in seen)}
    fit = fit_logistic(patterns, terms("ETHCIT1"), levels, weighted=False)
    return coefficient_table(spark, fit).select(
        "term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"))
