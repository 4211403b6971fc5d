"""Change of small areas between two years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demoflux.functions import recode
from demoflux.functions.semantics import age_band, cut_right, safe_div, short_number, significant
from demoflux.functions.text import popup_text
from demoflux.operators.aggregate import group_total, pack_distinct, share_in_group, weighted_mean
from demoflux.operators.binning import cut_number, histogram
from demoflux.operators.change import complete_grid, difference, end_ratio, growth_rate, observed_levels, two_point
from demoflux.operators.joins import membership_flag
from demoflux.operators.models import regression_band, simple_regression
from demoflux.operators.reshape import spread
from demoflux.plans.person import person, with_person
from demoflux.plans.registry import query, r6
from demoflux.session import cut_lineage

FIRST, LAST = 1996, 2000

# Growth classes and their limits, on the scale of the stored tables.
GROWTH_BREAKS = [-100, 0, 100, 200, 300]
GROWTH_LABELS = ["Pop Decline", "Small Pop Growth", "Pop Growth", "Large Pop Growth"]
RATIO_BREAKS = [float("-inf"), 1, 10, 100, 1000, 10000]


def working_age(spark, folder, *columns, years) -> DataFrame:
    rows = person(spark, folder, "AGE", "YEAR", "CPUMA0010", "BPL", "HISPAN", "PERWT", *columns, years=years)
    return rows.filter((F.col("AGE") > 15) & (F.col("AGE") <= 60))


def growth_cells(spark, folder, companions=False) -> DataFrame:
    """Population and mean schooling per area, origin and year, for the two years."""
    rows = working_age(spark, folder, "EDUC", *(["AREASTATE"] if companions else []), years=[FIRST, LAST])
    keys = [F.col("CPUMA0010").alias("area"), recode.origin_six().alias("origin"), F.col("YEAR").alias("year")]
    if not companions:
        return rows.groupBy(*keys).agg(F.sum("PERWT").alias("est"), weighted_mean("EDUC").alias("mean"))
    # person rows are only summed; the states are collected from the sums
    sums = rows.groupBy(*keys, F.col("AREASTATE").alias("state")).agg(
        F.sum("PERWT").alias("est"), F.sum(F.col("EDUC") * F.col("PERWT")).alias("schooling"),
        F.sum(F.when(F.col("EDUC").isNotNull(), F.col("PERWT"))).alias("schooled"))
    return sums.groupBy("area", "origin", "year").agg(
        F.sum("est").alias("est"), safe_div(F.sum("schooling"), F.sum("schooled")).alias("mean"),
        pack_distinct("state").alias("state"))


def area_growth(spark, folder, companions=False) -> DataFrame:
    """Growth of every origin group in every area; cells without people count as 0.

    The grid has the origins that occur. The cells are stored, since the grid reads them twice.
    """
    extra = ["state"] if companions else []
    cells = cut_lineage(growth_cells(spark, folder, companions))
    grid = complete_grid(
        cells, ["area"], {"origin": observed_levels(cells, "origin"), "year": [FIRST, LAST]},
        {"est": 0.0, "mean": None}, extra)
    change = two_point(
        grid, ["area", "origin"], "year", FIRST, LAST, ["est", "mean"], keep=[F.first(c).alias(c) for c in extra])
    result = change.select(
        "area", "origin", difference("est").alias("pg"), growth_rate("est").alias("pgr"),
        F.col("est_first").alias("pop_first"), F.col("est_last").alias("pop_last"), difference("mean").alias("mean_diff"),
        *extra)
    return result.withColumn("state", F.explode("state")) if companions else result


GRID_SQL = """
cells AS (
  SELECT CPUMA0010 AS area, origin6 AS origin, YEAR AS year, sum(PERWT) AS est, sum(PERWT * EDUC) / sum(PERWT) AS mean
  FROM person WHERE AGE > 15 AND AGE <= 60 AND YEAR IN (1996, 2000) GROUP BY ALL),
grid AS (
  SELECT a.area, o.origin, y.year FROM (SELECT DISTINCT area FROM cells) a, (SELECT DISTINCT origin FROM cells) o,
    (SELECT DISTINCT year FROM cells) y),
full_cells AS (
  SELECT area, origin, year, coalesce(est, 0) AS est, mean FROM grid LEFT JOIN cells USING (area, origin, year)),
growth AS (
  SELECT area, origin, l.est - f.est AS pg, (l.est - f.est) / NULLIF(f.est, 0) AS pgr, f.est AS pop_first,
    l.est AS pop_last, l.mean - f.mean AS mean_diff
  FROM (SELECT * FROM full_cells WHERE year = 1996) f JOIN (SELECT * FROM full_cells WHERE year = 2000) l
    USING (area, origin))
"""


@query("q15_completed_grid_change", with_person("""
SELECT area, origin, state, pg, round(pgr, 6) AS pgr, pop_first, pop_last, round(mean_diff, 6) AS mean_diff
FROM growth LEFT JOIN (SELECT DISTINCT CPUMA0010 AS area, AREASTATE AS state FROM person
  WHERE AGE > 15 AND AGE <= 60 AND YEAR IN (1996, 2000)) USING (area)
""", GRID_SQL))
def completed_grid_change(spark, folder):
    growth = area_growth(spark, folder, companions=True)
    return growth.withColumns({"pgr": r6("pgr"), "mean_diff": r6("mean_diff")})


@query("q16_observed_area_change", with_person("""
SELECT area, max(est) FILTER (year = 2000) - max(est) FILTER (year = 1996) AS pg,
  round((max(est) FILTER (year = 2000) - max(est) FILTER (year = 1996)) / max(est) FILTER (year = 1996), 6) AS pgr,
  max(est) FILTER (year = 1996) AS pop_first, max(est) FILTER (year = 2000) AS pop_last
FROM (SELECT CPUMA0010 AS area, YEAR AS year, sum(PERWT) AS est FROM person
      WHERE BPL = 200 AND AGE > 15 AND AGE <= 60 AND YEAR IN (1996, 2000) GROUP BY ALL)
GROUP BY area HAVING count(*) = 2
"""))
def observed_area_change(spark, folder):
    """Change of the areas seen in both years; the others drop out."""
    rows = working_age(spark, folder, years=[FIRST, LAST]).filter(recode.born_in_mexico())
    cells = rows.groupBy(F.col("CPUMA0010").alias("area"), F.col("YEAR").alias("year")).agg(F.sum("PERWT").alias("est"))
    change = two_point(cells, ["area"], "year", FIRST, LAST, ["est"])
    return change.select(
        "area", difference("est").alias("pg"), r6(growth_rate("est")).alias("pgr"),
        F.col("est_first").alias("pop_first"), F.col("est_last").alias("pop_last"))


@query("q16b_region_change", with_person("""
SELECT cluster, max(n) FILTER (year = 2000) - max(n) FILTER (year = 1996) AS diff
FROM (SELECT cluster_now AS cluster, YEAR AS year, sum(PERWT) AS n FROM person
      WHERE BPL = 200 AND YEAR IN (1996, 2000) GROUP BY ALL)
GROUP BY cluster HAVING count(*) = 2
"""))
def region_change(spark, folder):
    rows = person(spark, folder, "Cluster", "YEAR", "BPL", "PERWT", years=[FIRST, LAST]).filter(recode.born_in_mexico())
    cells = rows.groupBy(F.col("Cluster").alias("cluster"), F.col("YEAR").alias("year")).agg(F.sum("PERWT").alias("n"))
    return two_point(cells, ["cluster"], "year", FIRST, LAST, ["n"]).select("cluster", difference("n").alias("diff"))


@query("q17_growth_class", with_person("""
SELECT area, l.est - f.est AS pg,
  CASE WHEN l.est - f.est > -100 AND l.est - f.est <= 0 THEN 'Pop Decline'
    WHEN l.est - f.est > 0 AND l.est - f.est <= 100 THEN 'Small Pop Growth'
    WHEN l.est - f.est > 100 AND l.est - f.est <= 200 THEN 'Pop Growth'
    WHEN l.est - f.est > 200 AND l.est - f.est <= 300 THEN 'Large Pop Growth' END AS growth
FROM (SELECT CPUMA0010 AS area, sum(PERWT) AS est FROM person WHERE YEAR = 1996 GROUP BY ALL) f
JOIN (SELECT CPUMA0010 AS area, sum(PERWT) AS est FROM person WHERE YEAR = 2000 GROUP BY ALL) l USING (area)
"""))
def growth_class(spark, folder):
    rows = person(spark, folder, "CPUMA0010", "YEAR", "PERWT", years=[FIRST, LAST])
    cells = rows.groupBy(
        F.col("CPUMA0010").alias("area"), F.col("YEAR").alias("year")).agg(F.sum("PERWT").alias("est"))
    change = two_point(cells, ["area"], "year", FIRST, LAST, ["est"]).select("area", difference("est").alias("pg"))
    return change.withColumn("growth", cut_right("pg", GROWTH_BREAKS, GROWTH_LABELS))


@query("q18_peak_year", with_person("""
SELECT state, count(*) FILTER (YEAR = 2000) AS n, round(count(*) FILTER (YEAR = 2000) / count(*), 6) AS prop_peak
FROM (SELECT *, max(est) OVER (PARTITION BY CPUMA0010) AS top
      FROM (SELECT CPUMA0010, YEAR, AREASTATE AS state, sum(PERWT) AS est FROM person
            WHERE bplc = 'Mexico' AND YEAR >= 1996 GROUP BY ALL))
WHERE est = top GROUP BY ALL
"""))
def peak_year(spark, folder):
    """How many areas of each state peak in the latest full year; tied years all count."""
    rows = person(spark, folder, "CPUMA0010", "YEAR", "AREASTATE", "BPL", "PERWT", years=slice(1996, None)).filter(
        recode.born_in_mexico())
    cells = rows.groupBy("CPUMA0010", "YEAR", F.col("AREASTATE").alias("state")).agg(F.sum("PERWT").alias("est"))
    # The years of one area travel as one short array, so the area is its own group.
    years = cells.groupBy("CPUMA0010").agg(F.collect_list(F.struct("YEAR", "state", "est")).alias("years"))
    top = F.array_max(F.transform("years", lambda y: y["est"]))
    peaks = years.select(F.explode(F.filter("years", lambda y: y["est"] == top)).alias("peak"))
    recent = F.col("peak.YEAR") == LAST
    return peaks.groupBy(F.col("peak.state").alias("state")).agg(
        F.count(F.when(recent, 1)).alias("n"), r6(F.avg(recent.cast("double"))).alias("prop_peak"))


@query("q19_endpoint_ratio", with_person("""
SELECT area, CASE WHEN ratio = 0 THEN 0.0 ELSE
    round_even(ratio * pow(10.0, 4.0 - floor(log10(abs(ratio)))), 0) / pow(10.0, 4.0 - floor(log10(abs(ratio)))) END AS ratio,
  round(ln(ratio), 6) AS log_ratio,
  CASE WHEN ratio <= 1 THEN '(-Inf,1]' WHEN ratio <= 10 THEN '(1,10]' WHEN ratio <= 100 THEN '(10,100]'
    WHEN ratio <= 1000 THEN '(100,1000]' WHEN ratio <= 10000 THEN '(1000,10000]' END AS growth
FROM (SELECT area, max(mx) FILTER (year = 2000) / max(mx) FILTER (year = 1995) AS ratio
      FROM (SELECT CPUMA0010 AS area, YEAR AS year, sum(CASE WHEN BPL = 200 THEN PERWT ELSE 0 END) + 1 AS mx
            FROM person WHERE YEAR IN (1995, 2000) GROUP BY ALL) GROUP BY area HAVING count(*) = 2)
"""))
def endpoint_ratio(spark, folder):
    rows = person(spark, folder, "CPUMA0010", "YEAR", "BPL", "PERWT", years=[1995, LAST])
    cells = rows.groupBy(F.col("CPUMA0010").alias("area"), F.col("YEAR").alias("year")).agg(
        (F.sum(F.when(recode.born_in_mexico(), F.col("PERWT")).otherwise(0.0)) + 1).alias("mx"))
    ratios = two_point(cells, ["area"], "year", 1995, LAST, ["mx"]).select("area", end_ratio("mx").alias("exact"))
    return ratios.select(
        "area", significant("exact", 5).alias("ratio"), r6(F.log("exact")).alias("log_ratio"),
        cut_right("exact", RATIO_BREAKS).alias("growth"))


@query("q20_mean_age_change_classes", with_person("""
SELECT area, round(diff, 6) AS mean_age_diff,
  CASE WHEN diff <= q[2] THEN 1 WHEN diff <= q[3] THEN 2 WHEN diff <= q[4] THEN 3 WHEN diff <= q[5] THEN 4
    WHEN diff <= q[6] THEN 5 WHEN diff <= q[7] THEN 6 END AS class
FROM (SELECT area, max(age) FILTER (year = 2000) - max(age) FILTER (year = 1996) AS diff FROM ages GROUP BY area),
  (SELECT quantile_cont(diff, [0.0, 1/6, 2/6, 3/6, 4/6, 5/6, 1.0]) AS q
   FROM (SELECT max(age) FILTER (year = 2000) - max(age) FILTER (year = 1996) AS diff FROM ages GROUP BY area))
""", """
ages AS (SELECT CPUMA0010 AS area, YEAR AS year, sum(PERWT * EDUC) / sum(PERWT) AS age
  FROM person WHERE YEAR IN (1996, 2000) GROUP BY ALL)
"""))
def mean_age_change_classes(spark, folder):
    """Change of each area's mean years of schooling in six classes of equal size.

    An article has one size, so a person's schooling stands in for age here.
    """
    rows = person(spark, folder, "CPUMA0010", "YEAR", "EDUC", "PERWT", years=[FIRST, LAST])
    cells = rows.groupBy(F.col("CPUMA0010").alias("area"), F.col("YEAR").alias("year")).agg(
        weighted_mean("EDUC").alias("age"))
    change = two_point(cells, ["area"], "year", FIRST, LAST, ["age"], missing="null").select(
        "area", difference("age").alias("diff"))
    classed = cut_number(cut_lineage(change), "diff", 6, "class")
    return classed.select("area", r6("diff").alias("mean_age_diff"), "class")


@query("q20b_national_mean_age", with_person("""
SELECT YEAR AS year, round(sum(PERWT * AGE) / sum(PERWT), 6) AS mean_age FROM person WHERE YEAR = 1996 GROUP BY ALL
UNION ALL
SELECT YEAR, round(sum(PERWT * AGE) / sum(PERWT), 6) FROM person WHERE YEAR = 2000 GROUP BY ALL
"""))
def national_mean_age(spark, folder):
    """Mean age of each year over everyone; one pass gives both years."""
    rows = person(spark, folder, "YEAR", "AGE", "PERWT", years=[FIRST, LAST])
    return rows.groupBy(F.col("YEAR").alias("year")).agg(r6(weighted_mean("AGE")).alias("mean_age"))


@query("q24_growth_regression", with_person("""
SELECT round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 6) AS slope, round(regr_r2(y, x), 6) AS r2,
  CAST(regr_count(y, x) AS BIGINT) AS n
FROM (SELECT area, max(pg) FILTER (origin = 'Mexico') AS y, max(pg) FILTER (origin = 'Native Hispanic') AS x
      FROM growth GROUP BY area)
""", GRID_SQL))
def growth_regression(spark, folder):
    wide = spread(area_growth(spark, folder).select("area", "origin", "pg"), ["area"], "origin", "pg", recode.ORIGIN_6)
    line = simple_regression(wide, "Mexico", "Native Hispanic")
    return line.select(r6("intercept").alias("intercept"), r6("slope").alias("slope"), r6("r2").alias("r2"), "n")


@query("q24b_regression_band", with_person("""
SELECT area, round(a + b * x, 6) AS fit,
  round(sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + (x - mx) * (x - mx) / sxx)), 6) AS se
FROM wide, (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_count(y, x) AS n, regr_avgx(y, x) AS mx,
    regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM wide)
""", GRID_SQL, """
wide AS (SELECT area, max(pg) FILTER (origin = 'Mexico') AS y, max(pg) FILTER (origin = 'Native Non-Hispanic') AS x
  FROM growth GROUP BY area)
"""))
def growth_regression_band(spark, folder):
    wide = spread(area_growth(spark, folder).select("area", "origin", "pg"), ["area"], "origin", "pg", recode.ORIGIN_6)
    fitted = regression_band(cut_lineage(wide), "Mexico", "Native Non-Hispanic")
    return fitted.select("area", r6("fit").alias("fit"), r6("se").alias("se"))


@query("q25_age_structure_of_growing_areas", with_person("""
SELECT growing, age_group, n, round(proportion, 6) AS proportion,
  round(sum(age_w * proportion) OVER (PARTITION BY growing), 6) AS mean_age
FROM (SELECT *, n / sum(n) OVER (PARTITION BY growing) AS proportion
      FROM (SELECT CPUMA0010 IN (SELECT area FROM growth WHERE origin = 'Mexico' AND pg > 0) AS growing,
              band AS age_group, sum(PERWT) AS n, sum(AGE * PERWT) / sum(PERWT) AS age_w
            FROM person WHERE AGE > 15 AND AGE <= 60 AND YEAR = 2000 AND origin6 = 'Mexico' GROUP BY ALL))
""", GRID_SQL))
def age_structure_of_growing_areas(spark, folder):
    growing = area_growth(spark, folder).filter((F.col("origin") == "Mexico") & (F.col("pg") > 0)).select("area")
    rows = working_age(spark, folder, years=[LAST]).filter(recode.born_in_mexico()).select(
        F.col("CPUMA0010").alias("area"), age_band("AGE").alias("age_group"), "AGE", "PERWT")
    # Rows are summed per area before the flag is joined; the sums stay exact.
    cells = rows.groupBy("area", "age_group").agg(
        F.sum("PERWT").alias("n"), F.sum(F.col("AGE") * F.col("PERWT")).alias("_years"))
    flagged = membership_flag(cells, growing, ["area"], "growing").groupBy("growing", "age_group").agg(
        F.sum("n").alias("n"), safe_div(F.sum("_years"), F.sum("n")).alias("_age"))
    shared = share_in_group(flagged, "n", ["growing"], "proportion")
    aged = group_total(shared, F.col("_age") * F.col("proportion"), ["growing"], "mean_age")
    return aged.select("growing", "age_group", "n", r6("proportion").alias("proportion"), r6("mean_age").alias("mean_age"))


@query("q25b_growth_with_area_total", with_person("""
SELECT area, origin, pg, pop_last, sum(pop_last) OVER (PARTITION BY area) AS area_total FROM growth
""", GRID_SQL))
def growth_with_area_total(spark, folder):
    growth = area_growth(spark, folder).select("area", "origin", "pg", "pop_last")
    return group_total(growth, "pop_last", ["area"], "area_total")


@query("q28_growth_histogram", with_person("""
SELECT CAST(bin AS INTEGER) AS bin, round(min(low + bin * w), 6) AS bin_start, count(*) AS n
FROM (SELECT low, w, least(floor((pg - low) / w), 29) AS bin
      FROM growth, (SELECT min(pg) AS low, (max(pg) - min(pg)) / 30.0 AS w FROM growth WHERE origin = 'Mexico')
      WHERE origin = 'Mexico')
GROUP BY bin
""", GRID_SQL))
def growth_histogram(spark, folder):
    growth = area_growth(spark, folder).filter(F.col("origin") == "Mexico").select("pg")
    # Equal values are counted first, so what is stored and read twice is small.
    bars = histogram(cut_lineage(growth), "pg", 30)
    return bars.select("bin", r6("bin_start").alias("bin_start"), "n")


@query("q29_popup_and_colour_domain", with_person("""
SELECT state, pg, 'state: ' || state || '<br>growth: ' || CAST(pg AS BIGINT) AS popup, -m AS domain_low, m AS domain_high
FROM per_state, (SELECT max(abs(pg)) AS m FROM per_state)
""", """
per_state AS (SELECT AREASTATE AS state, sum(CASE WHEN YEAR = 2000 THEN PERWT ELSE -PERWT END) AS pg
  FROM person WHERE YEAR IN (1996, 2000) GROUP BY ALL)
"""))
def popup_and_colour_domain(spark, folder):
    rows = person(spark, folder, "AREASTATE", "YEAR", "PERWT", years=[FIRST, LAST])
    cells = rows.groupBy(F.col("AREASTATE").alias("state"), F.col("YEAR").alias("year")).agg(F.sum("PERWT").alias("est"))
    growth = two_point(cells, ["state"], "year", FIRST, LAST, ["est"]).select("state", difference("est").alias("pg"))
    # States are a short list; their extreme comes from a window over it.
    extreme = F.max(F.abs("pg")).over(Window.partitionBy())
    described = growth.withColumn("growth", short_number(F.col("pg")))
    return described.select(
        "state", "pg", popup_text("state", "growth").alias("popup"), (-extreme).alias("domain_low"),
        extreme.alias("domain_high"))
