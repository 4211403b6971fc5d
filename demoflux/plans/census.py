"""Long census tables: wide forms, tables of change, label recodes, age bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demoflux.functions import recode
from demoflux.functions.semantics import interval_label, pad_code, round_even, safe_div, to_number, year_of_range
from demoflux.functions.text import ages_of_label, band_midpoint, title_from
from demoflux.operators.aggregate import (
    aggregate_each, columns_of_type, conditional_sum, map_columns, numeric_columns, rename_each, share_in_group,
    strict_sum, weighted_mean,
)
from demoflux.operators.binning import cut_number, dense_code
from demoflux.operators.change import difference, two_point
from demoflux.operators.joins import band_of_ages, join_nullsafe, natural_join
from demoflux.operators.reshape import gather, keep_positions, spread
from demoflux.plans.person import person, with_person
from demoflux.plans.registry import query, r6
from demoflux.session import cut_lineage
from demoflux.sources.census import fan_in, normalise_decennial, select_estimates
from demoflux.sources.tables import load

YEARS = [1996, 2000]

# Codes of the table variables and the names they get.
VARIABLES = {
    "totalPopulation": "B01003_001",
    "whitePopulation": "B01001H_001",
    "fb1": "B05003I_005",
    "fb2": "B05003I_010",
    "fb3": "B05003I_016",
    "fb4": "B05003I_021",
    "hispanicPopulation": "B01001I_001",
}
SUBGROUPS = ["hispanicPopulation", "whitePopulation", "otherPopulation", "fbHispanicPopulation"]


def geoid():
    return F.concat(pad_code("STATEFIP", 2), F.lit("-"), F.col("STRATA"))


def estimates(spark, folder, years=None) -> DataFrame:
    """Stored long table: GEOID, NAME, state, year, variable, estimate, moe.

    Persons are summed once per area and year, one sum per variable, and the sums unfolded.
    """
    rows = person(
        spark, folder, "STATEFIP", "STRATA", "REGION", "YEAR", "HISPAN", "RACE", "BPL", "SEX", "CITIZEN", "PERWT",
        years=years)
    hispanic, migrant = recode.is_hispanic(), ~recode.is_native()
    men, citizens = F.col("SEX") == 1, recode.citizen()
    everyone = F.lit(True)
    cases = {
        "B01003_001": everyone,
        "B01001H_001": recode.race() == "White",
        "B01001I_001": hispanic,
        "B05003I_005": hispanic & migrant & men & citizens,
        "B05003I_010": hispanic & migrant & men & ~citizens,
        "B05003I_016": hispanic & migrant & ~men & citizens,
        "B05003I_021": hispanic & migrant & ~men & ~citizens,
    }
    by = [geoid().alias("GEOID"), F.concat(F.lit("NATION_"), F.col("STATEFIP")).alias("NAME"),
          F.col("REGION").alias("state"), F.col("YEAR").alias("year")]
    wide = rows.groupBy(*by).agg(*[conditional_sum("PERWT", c).alias(code) for code, c in cases.items()])
    long = gather(wide, ["GEOID", "NAME", "state", "year"], list(cases), "variable", "estimate")
    return long.withColumn("moe", F.col("estimate") * 0.1)


def wide_estimates(spark, folder, years=YEARS) -> DataFrame:
    """Named variables as columns, with the derived population groups."""
    long = select_estimates(estimates(spark, folder, years), VARIABLES)
    wide = spread(long.drop("moe"), ["GEOID", "NAME", "state", "year"], "variable", "estimate", list(VARIABLES))
    fb = ["fb1", "fb2", "fb3", "fb4"]
    return wide.withColumn(
        "otherPopulation", F.col("totalPopulation") - F.col("whitePopulation") - F.col("hispanicPopulation")
    ).withColumn("fbHispanicPopulation", sum((F.col(c) for c in fb[1:]), F.col("fb1"))).drop(*fb)


def changes(spark, folder) -> DataFrame:
    """Change of each population group per area, with the total of the later year."""
    values = [*SUBGROUPS, "totalPopulation"]
    pairs = two_point(wide_estimates(spark, folder), ["GEOID", "NAME", "state"], "year", *YEARS, values)
    return pairs.select(
        "GEOID", "NAME", "state", *[difference(g).alias(g) for g in SUBGROUPS],
        F.col("totalPopulation_last").alias("totalPopulation"))


ACS_SQL = """
acs AS (
  SELECT printf('%02d', STATEFIP) || '-' || STRATA AS geoid, 'NATION_' || STATEFIP AS name, REGION AS state, YEAR AS year,
    sum(PERWT) AS total, sum(CASE WHEN HISPAN = 1 THEN PERWT ELSE 0 END) AS hisp,
    sum(CASE WHEN race3 = 'White' THEN PERWT ELSE 0 END) AS white,
    sum(CASE WHEN HISPAN = 1 AND BPL >= 100 THEN PERWT ELSE 0 END) AS fbhisp,
    sum(CASE WHEN race3 = 'White' OR HISPAN = 1 THEN 0 ELSE PERWT END) AS other
  FROM person GROUP BY ALL),
delta AS (
  SELECT geoid, name, f.state, l.hisp - f.hisp AS hisp, l.white - f.white AS white, l.other - f.other AS other,
    l.fbhisp - f.fbhisp AS fbhisp, l.total AS total
  FROM (SELECT * FROM acs WHERE year = 1996) f JOIN (SELECT * FROM acs WHERE year = 2000) l USING (geoid, name))
"""


@query("q21_growth_quadrants", with_person("""
SELECT state, growth_type, n, round(n / sum(n) OVER (PARTITION BY state), 6) AS p
FROM (SELECT state, CASE WHEN hisp > 0 AND white > 0 AND white > hisp THEN 'White Growth Outpaces Hispanic Growth'
        WHEN hisp > 0 AND white > 0 AND white < hisp THEN 'Hispanic Growth Outpaces White Growth'
        WHEN hisp > 0 AND white < 0 AND abs(white) > hisp THEN 'White Decline Outpaces Hispanic Growth'
        WHEN hisp > 0 AND white < 0 AND abs(white) < hisp THEN 'Hispanic Growth Outpaces White Decline'
        END AS growth_type, count(*) AS n
      FROM delta WHERE total >= 1500 GROUP BY ALL) WHERE growth_type IS NOT NULL
""", ACS_SQL))
def growth_quadrants(spark, folder):
    typed = changes(spark, folder).filter(F.col("totalPopulation") >= 1500).withColumn(
        "growth_type", recode.growth_quadrant("hispanicPopulation", "whitePopulation"))
    counts = typed.filter(F.col("growth_type").isNotNull()).groupBy("state", "growth_type").agg(
        F.count(F.lit(1)).alias("n"))
    shared = share_in_group(counts, "n", ["state"], "p").withColumn("p", r6("p"))
    return shared.orderBy("state", F.desc_nulls_last("p"), "growth_type")


@query("q22_change_by_state", with_person("""
SELECT state AS "State", sum(hisp) AS "Change in Hispanic Population", sum(white) AS "Change in White Population",
  sum(other) AS "Change in Other Population", sum(fbhisp) AS "Change in Fbhispanic Population"
FROM delta GROUP BY ALL
""", ACS_SQL))
def change_by_state(spark, folder):
    sums = aggregate_each(changes(spark, folder), ["state"], SUBGROUPS, F.sum)
    titled = rename_each(sums, SUBGROUPS, lambda c: title_from(c, 10, "Change in ", " Population"))
    return titled.withColumnRenamed("state", "State")


@query("q22b_population_percentages", with_person("""
SELECT state AS "State", year AS "Year", round_even(hisp / t * 100, 2) AS "Percentage Hispanic Population",
  round_even(white / t * 100, 2) AS "Percentage White Population", round_even(other / t * 100, 2) AS "Percentage Other Population",
  round_even(fbhisp / t * 100, 2) AS "Percentage Fbhispanic Population"
FROM (SELECT state, year, sum(hisp) AS hisp, sum(white) AS white, sum(other) AS other, sum(fbhisp) AS fbhisp,
        sum(hisp) + sum(white) + sum(other) AS t FROM acs WHERE year IN (1996, 2000) GROUP BY ALL)
""", ACS_SQL))
def population_percentages(spark, folder):
    sums = aggregate_each(wide_estimates(spark, folder), ["state", "year"], SUBGROUPS, F.sum)
    totals = sums.withColumn("totalPop", sum((F.col(c) for c in SUBGROUPS[1:3]), F.col(SUBGROUPS[0])))
    doubles = columns_of_type(totals, T.DoubleType, skip=["totalPop"])
    shares = map_columns(totals, doubles, lambda c: round_even(c / F.col("totalPop") * 100, 2)).drop("totalPop")
    titled = rename_each(shares, SUBGROUPS, lambda c: title_from(c, 10, "Percentage ", " Population"))
    return titled.withColumnsRenamed({"state": "State", "year": "Year"})


@query("q22c_native_contribution", with_person("""
SELECT state AS "State", sum(hisp) AS hispanic_change, sum(fbhisp) AS fb_hispanic_change,
  round_even((1 - sum(fbhisp) / NULLIF(sum(hisp), 0)) * 100, 2) AS native_contribution
FROM delta GROUP BY ALL
""", ACS_SQL))
def native_contribution(spark, folder):
    change = changes(spark, folder)
    sums = aggregate_each(change, ["state"], numeric_columns(change), F.sum)
    part = round_even((1 - safe_div("fbHispanicPopulation", "hispanicPopulation")) * 100, 2)
    return sums.select(
        F.col("state").alias("State"), F.col("hispanicPopulation").alias("hispanic_change"),
        F.col("fbHispanicPopulation").alias("fb_hispanic_change"), part.alias("native_contribution"))


@query("q22d_mean_change_of_shares", with_person("""
SELECT state, round_even(avg(dh) * 100, 2) AS delta_hispanic, round_even(avg(dw) * 100, 2) AS delta_white,
  round_even(avg(dotr) * 100, 2) AS delta_other, round_even(avg(dfb) * 100, 2) AS delta_fb_hispanic
FROM (SELECT l.state, l.hisp / l.total - f.hisp / f.total AS dh, l.white / l.total - f.white / f.total AS dw,
        l.other / l.total - f.other / f.total AS dotr,
        l.fbhisp / NULLIF(l.hisp, 0) - f.fbhisp / NULLIF(f.hisp, 0) AS dfb
      FROM (SELECT * FROM acs WHERE year = 1996) f JOIN (SELECT * FROM acs WHERE year = 2000) l USING (geoid, name))
GROUP BY ALL
""", ACS_SQL))
def mean_change_of_shares(spark, folder):
    shares = {
        "hispanic": safe_div("hispanicPopulation", "totalPopulation"),
        "white": safe_div("whitePopulation", "totalPopulation"),
        "other": safe_div("otherPopulation", "totalPopulation"),
        "fb_hispanic": safe_div("fbHispanicPopulation", "hispanicPopulation"),
    }
    pairs = two_point(
        wide_estimates(spark, folder).withColumns(shares), ["GEOID", "state"], "year", *YEARS, list(shares))
    deltas = pairs.select("state", *[difference(s).alias(f"delta_{s}") for s in shares])
    means = aggregate_each(deltas, ["state"], numeric_columns(deltas), F.avg)
    return map_columns(means, numeric_columns(means), lambda c: round_even(c * 100, 2))


@query("q22e_filled_shares", with_person("""
SELECT geoid, coalesce(round_even(hisp / NULLIF(total, 0), 4), 0) AS p_hispanic,
  coalesce(round_even(fbhisp / NULLIF(hisp, 0), 4), 0) AS p_fb_hispanic
FROM acs WHERE year = 2000
""", ACS_SQL))
def filled_shares(spark, folder):
    """Rounded shares with 0 in place of 0/0."""
    wide = wide_estimates(spark, folder, [2000])
    share = lambda a, b: F.coalesce(round_even(safe_div(a, b), 4), F.lit(0.0))
    return wide.select(
        F.col("GEOID").alias("geoid"), share("hispanicPopulation", "totalPopulation").alias("p_hispanic"),
        share("fbHispanicPopulation", "hispanicPopulation").alias("p_fb_hispanic"))


@query("q22g_county_totals", with_person("""
SELECT sum(total) AS "totalPopulation", sum(white) AS "whitePopulation", sum(hisp) AS "hispanicPopulation",
  sum(other) AS "otherPopulation", sum(fbhisp) AS "fbHispanicPopulation"
FROM acs WHERE year = 2000 AND substr(geoid, 1, 2) IN ('03', '07', '11')
""", ACS_SQL))
def county_totals(spark, folder):
    """Sums of all numeric columns over a few counties, the county being the head of the area code."""
    wide = wide_estimates(spark, folder, [2000]).withColumn("county", F.substring("GEOID", 1, 2))
    some = wide.filter(F.col("county").isin("03", "07", "11")).drop("year")
    return aggregate_each(some, [], numeric_columns(some), F.sum)


@query("q22f_strict_state_sums", with_person("""
SELECT state, sum(hisp) AS hisp, CASE WHEN count(ratio) = count(*) THEN round(sum(ratio), 6) END AS ratio_sum
FROM (SELECT state, hisp, fbhisp / NULLIF(hisp, 0) AS ratio FROM acs WHERE year = 2000) GROUP BY ALL
""", ACS_SQL))
def strict_state_sums(spark, folder):
    """Sums that are missing as soon as one part is missing."""
    rows = wide_estimates(spark, folder, [2000]).withColumn(
        "ratio", safe_div("fbHispanicPopulation", "hispanicPopulation"))
    return rows.groupBy("state").agg(
        strict_sum("hispanicPopulation").alias("hisp"), r6(strict_sum("ratio")).alias("ratio_sum"))


@query("q23_change_correlation", with_person("""
SELECT round(corr(hisp, white), 6) AS hispanic_white, round(corr(hisp, other), 6) AS hispanic_other FROM delta
""", ACS_SQL))
def change_correlation(spark, folder):
    return changes(spark, folder).agg(
        r6(F.corr("hispanicPopulation", "whitePopulation")).alias("hispanic_white"),
        r6(F.corr("hispanicPopulation", "otherPopulation")).alias("hispanic_other"))


# Coded measures of the wide time series.
HISPANIC_CODES = ["CV4AF", "CV4AG", "CV4AH", "CV4AI", "CV4AJ"]
RANGE_YEARS = {"1997-1999": 1998}


def time_series(spark, folder) -> DataFrame:
    """Wide county series with coded measures; one year is labelled by a range of years."""
    rows = person(spark, folder, "YEAR", "STATEFIP", "PRIORITY", "LINE", "BPL", "PERWT")
    label = F.when(F.col("YEAR") == 1998, "1997-1999").otherwise(F.col("YEAR").cast("string"))
    hispanic = F.col("PRIORITY") == "1-URGENT"
    only = lambda condition: F.sum(F.when(condition, F.col("PERWT")))
    cases = {
        "CV4AA": F.col("PRIORITY") == "2-HIGH", "CV4AB": F.col("PRIORITY") == "3-MEDIUM",
        "CV4AC": F.col("PRIORITY") == "4-NOT SPECIFIED",
        **{code: hispanic & (F.col("LINE") == i + 1) for i, code in enumerate(HISPANIC_CODES[:4])},
        "CV4AJ": hispanic & (F.col("LINE") >= 5), "AT5AA": recode.is_native(), "AT5AB": ~recode.is_native(),
    }
    return rows.groupBy(label.alias("YEAR"), pad_code("STATEFIP", 3).alias("COUNTYFP")).agg(
        *[only(c).alias(code) for code, c in cases.items()])


SERIES_SQL = """
series AS (
  SELECT CASE WHEN YEAR = 1998 THEN '1997-1999' ELSE CAST(YEAR AS VARCHAR) END AS label, printf('%03d', STATEFIP) AS county,
    sum(PERWT) FILTER (PRIORITY = '2-HIGH') AS "White", sum(PERWT) FILTER (PRIORITY = '3-MEDIUM') AS "Black",
    sum(PERWT) FILTER (PRIORITY = '4-NOT SPECIFIED') AS "API",
    sum(PERWT) FILTER (PRIORITY = '1-URGENT' AND LINE = 1) + sum(PERWT) FILTER (PRIORITY = '1-URGENT' AND LINE = 2)
      + sum(PERWT) FILTER (PRIORITY = '1-URGENT' AND LINE = 3) + sum(PERWT) FILTER (PRIORITY = '1-URGENT' AND LINE = 4) AS four,
    sum(PERWT) FILTER (PRIORITY = '1-URGENT' AND LINE >= 5) AS fifth,
    sum(PERWT) FILTER (BPL < 100) AS "Native", sum(PERWT) FILTER (BPL >= 100) AS "Foreign"
  FROM person GROUP BY ALL)
"""


@query("q26_population_series", with_person("""
UNPIVOT (SELECT CAST(label AS INTEGER) AS year, county, "White", "Black",
    CASE WHEN CAST(label AS INTEGER) > 1997 THEN four + fifth ELSE four END AS "Hispanic", "API"
  FROM series WHERE label <> '1997-1999' AND CAST(CASE WHEN label <> '1997-1999' THEN label END AS INTEGER) > 1995)
ON COLUMNS(* EXCLUDE (year, county)) INTO NAME name VALUE value
""", SERIES_SQL))
def population_series(spark, folder):
    """Race series with the sum of codes that each era has; range labels are no years and drop out."""
    rows = time_series(spark, folder).withColumn("YEAR", to_number("YEAR")).filter(F.col("YEAR") > 1995)
    five = sum((F.col(c) for c in HISPANIC_CODES[1:]), F.col(HISPANIC_CODES[0]))
    four = sum((F.col(c) for c in HISPANIC_CODES[1:4]), F.col(HISPANIC_CODES[0]))
    named = rows.withColumn("Hispanic", F.when(F.col("YEAR") > 1997, five).otherwise(four)).select(
        F.col("YEAR").cast("int").alias("year"), F.col("COUNTYFP").alias("county"), F.col("CV4AA").alias("White"),
        F.col("CV4AB").alias("Black"), "Hispanic", F.col("CV4AC").alias("API"))
    return gather(named, ["year", "county"], ["White", "Black", "Hispanic", "API"], "name", "value").filter(
        F.col("value").isNotNull())


@query("q26b_nativity_series", with_person("""
UNPIVOT (SELECT CASE WHEN label = '1997-1999' THEN 1998 ELSE CAST(label AS INTEGER) END AS year, county, "Native", "Foreign"
  FROM series WHERE label <> '1999') ON "Native", "Foreign" INTO NAME name VALUE value
""", SERIES_SQL))
def nativity_series(spark, folder):
    rows = time_series(spark, folder).filter(F.col("YEAR") != "1999").select(
        year_of_range("YEAR", RANGE_YEARS).alias("year"), F.col("COUNTYFP").alias("county"),
        F.col("AT5AA").alias("Native"), F.col("AT5AB").alias("Foreign"))
    return gather(rows, ["year", "county"], ["Native", "Foreign"], "name", "value").filter(F.col("value").isNotNull())


@query("q30_tagged_fan_in", with_person("""
SELECT geoid, fips, state, year, source, variable, estimate, round(moe, 6) AS moe FROM (
  SELECT geoid, printf('%05d', n_nationkey) AS fips, state, year, 'survey' AS source,
    unnest(['totalPopulation', 'hispanicPopulation']) AS variable, unnest([total, hisp]) AS estimate,
    unnest([total * 0.1, hisp * 0.1]) AS moe
  FROM acs JOIN nation ON name = n_name WHERE year IN (1996, 2000)
  UNION ALL
  SELECT geoid, printf('%05d', n_nationkey), state, year, 'census', 'totalPopulation', total, NULL
  FROM acs JOIN nation ON name = n_name WHERE year = 1998)
""", ACS_SQL))
def tagged_fan_in(spark, folder):
    """Survey and full-count tables stacked under one set of columns, with their codes attached by name."""
    named = {k: VARIABLES[k] for k in ("totalPopulation", "hispanicPopulation")}
    survey = select_estimates(estimates(spark, folder, YEARS), named)
    counts = select_estimates(estimates(spark, folder, [1998]), {"totalPopulation": VARIABLES["totalPopulation"]})
    census = normalise_decennial(counts.drop("moe").withColumnRenamed("estimate", "value"))
    stacked = fan_in([(survey, {"source": "survey"}), (census, {"source": "census"})])
    codes = load(spark, folder, "nation").select(F.col("n_name").alias("NAME"), pad_code("n_nationkey", 5).alias("fips"))
    return natural_join(stacked, codes).select(
        F.col("GEOID").alias("geoid"), "fips", "state", "year", "source", "variable", "estimate", r6("moe").alias("moe"))


# Dictionary of the race table (code, label).
RACE_VARIABLES = [
    ("B03002_001", "Estimate!!Total"),
    ("B03002_002", "Estimate!!Total!!Not Hispanic or Latino"),
    ("B03002_003", "Estimate!!Total!!Not Hispanic or Latino!!White alone"),
    ("B03002_004", "Estimate!!Total!!Not Hispanic or Latino!!Black or African American alone"),
    ("B03002_006", "Estimate!!Total!!Not Hispanic or Latino!!Asian alone"),
    ("B03002_007", "Estimate!!Total!!Not Hispanic or Latino!!Native Hawaiian and Other Pacific Islander alone"),
    ("B03002_008", "Estimate!!Total!!Not Hispanic or Latino!!Some other race alone"),
    ("B03002_012", "Estimate!!Total!!Hispanic or Latino"),
]


def race_dictionary(spark: SparkSession) -> DataFrame:
    """The dictionary rows in use, with their race group; a literal table of eight rows."""
    entries = spark.createDataFrame(RACE_VARIABLES, "variable string, label string")
    used = keep_positions(entries, ["variable"], [1, 3, 4, 5, 6, 7, 8])
    return used.withColumn("race", recode.race_from_label("variable", "label", "B03002_001", "B03002_012"))


def race_estimates(spark, folder) -> DataFrame:
    """Race table per area; its total is taken from fewer people than its parts."""
    rows = person(spark, folder, "CPUMA0010", "PRIORITY", "LINE", "PERWT")
    priority, line = F.col("PRIORITY"), F.col("LINE")
    asian = priority == "4-NOT SPECIFIED"
    total = line <= 6
    cases = {
        "B03002_001": total, "B03002_002": total & (priority != "1-URGENT"), "B03002_003": priority == "2-HIGH",
        "B03002_004": priority == "3-MEDIUM", "B03002_006": asian & (line <= 3), "B03002_007": asian & (line > 3),
        "B03002_008": priority == "5-LOW", "B03002_012": priority == "1-URGENT",
    }
    wide = rows.groupBy(F.col("CPUMA0010").alias("geoid")).agg(
        *[conditional_sum("PERWT", c).alias(code) for code, c in cases.items()])
    return gather(wide, ["geoid"], list(cases), "variable", "estimate")


def reconciled(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Race counts per area, and the scale that makes the parts meet the total.

    Both are carried per area row: the parts of one area are a short list of races.
    """
    dictionary = F.broadcast(race_dictionary(spark).drop("label"))  # eight literal rows
    labelled = race_estimates(spark, folder).join(dictionary, "variable")
    is_total = F.col("race") == "Total"
    by_race = labelled.groupBy("geoid", "race").agg(F.sum("estimate").alias("n"))
    scale = by_race.groupBy("geoid").agg(
        F.sum(F.when(is_total, F.col("n"))).alias("nest"), F.sum(F.when(~is_total, F.col("n"))).alias("parts"),
        F.collect_list(F.when(~is_total, F.struct("race", "n"))).alias("races"),
    ).withColumns({
        "error": F.col("nest") - F.col("parts"), "weight": safe_div("nest", "parts"),
        "perr": safe_div(F.abs(F.col("nest") - F.col("parts")), F.col("nest")),
    }).filter(F.col("perr").isNotNull())
    counts = scale.select("geoid", "weight", F.explode("races").alias("r")).select(
        "geoid", F.col("r.race").alias("race"), round_even(F.col("weight") * F.col("r.n")).alias("n"))
    return counts.filter((F.col("n") != 0) & F.col("n").isNotNull()), scale


RACE_SQL = """
race_long AS (
  SELECT CPUMA0010 AS geoid, CASE PRIORITY WHEN '1-URGENT' THEN 'Hispanic' WHEN '2-HIGH' THEN 'White'
      WHEN '3-MEDIUM' THEN 'Black' WHEN '4-NOT SPECIFIED' THEN 'Asian' ELSE 'Other' END AS race, sum(PERWT) AS n
  FROM person GROUP BY ALL),
scale AS (
  SELECT geoid, nest - parts AS error, nest, nest / parts AS weight, abs(nest - parts) / nest AS perr
  FROM (SELECT CPUMA0010 AS geoid, sum(CASE WHEN LINE <= 6 THEN PERWT ELSE 0 END) AS nest, sum(PERWT) AS parts
        FROM person GROUP BY ALL) WHERE nest <> 0),
poly AS (
  SELECT geoid, race, round_even(weight * n, 0) AS n FROM race_long JOIN scale USING (geoid)
  WHERE round_even(weight * n, 0) <> 0)
"""


@query("q31_scaled_race_counts", with_person("SELECT geoid, race, n FROM poly", RACE_SQL))
def scaled_race_counts(spark, folder):
    return reconciled(spark, folder)[0]


@query("q31b_parts_versus_total", with_person("""
SELECT geoid, error, nest, round(weight, 6) AS weight, round(perr, 6) AS perr FROM scale
""", RACE_SQL))
def parts_versus_total(spark, folder):
    scale = reconciled(spark, folder)[1]
    return scale.select("geoid", "error", "nest", r6("weight").alias("weight"), r6("perr").alias("perr"))


@query("q31c_race_shares", with_person("""
SELECT race, n, round(n / sum(n) OVER (), 6) AS p FROM (SELECT race, sum(n) AS n FROM poly GROUP BY ALL)
""", RACE_SQL))
def race_shares(spark, folder):
    sums = reconciled(spark, folder)[0].groupBy("race").agg(F.sum("n").alias("n"))
    return share_in_group(sums, "n", [], "p").withColumn("p", r6("p"))


# Age ranges of the two tables' labels, from birth to the open last one.
SURVEY_AGES = [(0, 4), (5, 9), (10, 14), (15, 17), (18, 19), (20, 20), (21, 21), (22, 24), (25, 29), (30, 34), (35, 39),
               (40, 44), (45, 49), (50, 54), (55, 59), (60, 61), (62, 64), (65, 66), (67, 69), (70, 74), (75, 79), (80, 84), (85, None)]
CENSUS_AGES = [(0, 0), (1, 2), (3, 4), (5, 5), (6, 6), (7, 9), (10, 11), (12, 13), (14, 14), (15, 15), (16, 16), (17, 17),
               (18, 18), (19, 19), (20, 20), (21, 21), (22, 24), (25, 29), (30, 34), (35, 39), (40, 44), (45, 49), (50, 54),
               (55, 59), (60, 61), (62, 64), (65, 69), (70, 74), (75, 79), (80, 84), (85, None)]


def _label_text(low, high):
    if high is None:
        return f"{low} years and over"
    if low == 0:
        return "Under 1 year" if high == 0 else f"Under {high + 1} years"
    if low == high:
        return f"{low} years"
    return f"{low} and {high} years" if high == low + 1 else f"{low} to {high} years"


def _age_label(ranges):
    chain = None
    for low, high in ranges:
        hit = F.col("AGE") >= low if high is None else F.col("AGE").between(low, high)
        text = _label_text(low, high)
        chain = F.when(hit, text) if chain is None else chain.when(hit, text)
    return chain


def _ranges_sql(ranges):
    """SQL: the labels with the ages that each is read as: the number of a single 'under' means 0 to 4, 65 to 69 is one band."""
    rows = []
    for low, high in ranges:
        read = (0, 4) if low == 0 else (65, 69) if low in (65, 67) else (low, low if high is None else high)
        rows.append(f"({low}, {999 if high is None else high}, '{_label_text(low, high)}', {read[0]}, {read[1]})")
    return "VALUES " + ", ".join(rows)


def age_estimates(spark, folder) -> DataFrame:
    """Long age table: the earlier year under the census labels, the later under the survey labels."""
    rows = person(spark, folder, "STATEFIP", "STRATA", "YEAR", "AGE", "PERWT", years=YEARS)
    label = F.when(F.col("YEAR") == YEARS[0], _age_label(CENSUS_AGES)).otherwise(_age_label(SURVEY_AGES))
    return rows.groupBy(geoid().alias("geoid"), F.col("YEAR").alias("year"), label.alias("label")).agg(
        F.sum("PERWT").alias("estimate"))


def age_bands(dictionary: DataFrame) -> DataFrame:
    """Bands of the survey labels: ages, code and mean age."""
    bands = dictionary.select(ages_of_label(F.col("label")).alias("band_ages")).distinct()
    coded = dense_code(bands.withColumn("_first", F.array_min("band_ages")), "_first", "band")
    return coded.select("band", "band_ages", band_midpoint(F.col("band_ages")).alias("age_mean"))


def harmonised_labels(table: DataFrame) -> DataFrame:
    """Every label of the long table with the survey band that contains its ages."""
    labels = table.select("year", "label").distinct()
    bands = age_bands(labels.filter(F.col("year") == YEARS[1]))
    keyed = labels.withColumn("ages", ages_of_label(F.col("label")))
    return band_of_ages(keyed, "ages", bands, "band_ages")


@query("q32_mean_age_from_labels", with_person("""
SELECT geoid, year, round(sum(mid * PERWT) / sum(PERWT), 6) AS mean_age
FROM (SELECT printf('%02d', STATEFIP) || '-' || STRATA AS geoid, YEAR AS year, PERWT,
        CASE WHEN AGE >= 85 THEN 85.5 WHEN AGE IN (60, 61) THEN 61.0 WHEN AGE BETWEEN 62 AND 64 THEN 63.5
          WHEN AGE < 15 OR AGE >= 25 THEN (AGE // 5) * 5 + 2.5 WHEN AGE <= 17 THEN 16.5 WHEN AGE <= 19 THEN 19.0
          WHEN AGE <= 21 THEN AGE + 0.5 ELSE 23.5 END AS mid
      FROM person WHERE YEAR IN (1996, 2000)) GROUP BY ALL
"""))
def mean_age_from_labels(spark, folder):
    return _mean_ages(spark, folder).withColumn("mean_age", r6("mean_age"))


def _mean_ages(spark, folder) -> DataFrame:
    table = cut_lineage(age_estimates(spark, folder))
    placed = join_nullsafe(table, harmonised_labels(table).select("year", "label", "band", "age_mean"), ["year", "label"])
    summed = placed.groupBy("geoid", "year", "band", "age_mean").agg(F.sum("estimate").alias("estimate"))
    return summed.groupBy("geoid", "year").agg(weighted_mean("age_mean", "estimate").alias("mean_age"))


@query("q32d_mean_age_change_from_labels", with_person("""
SELECT geoid, round(diff, 6) AS mean_age_diff,
  CASE WHEN diff <= q[2] THEN 1 WHEN diff <= q[3] THEN 2 WHEN diff <= q[4] THEN 3 WHEN diff <= q[5] THEN 4
    WHEN diff <= q[6] THEN 5 WHEN diff <= q[7] THEN 6 END AS class
FROM diffs, (SELECT quantile_cont(diff, [0.0, 1/6, 2/6, 3/6, 4/6, 5/6, 1.0]) AS q FROM diffs)
""", """
diffs AS (
  SELECT geoid, sum(mid * PERWT) FILTER (year = 2000) / sum(PERWT) FILTER (year = 2000)
    - sum(mid * PERWT) FILTER (year = 1996) / sum(PERWT) FILTER (year = 1996) AS diff
  FROM (SELECT printf('%02d', STATEFIP) || '-' || STRATA AS geoid, YEAR AS year, PERWT,
          CASE WHEN AGE >= 85 THEN 85.5 WHEN AGE IN (60, 61) THEN 61.0 WHEN AGE BETWEEN 62 AND 64 THEN 63.5
          WHEN AGE < 15 OR AGE >= 25 THEN (AGE // 5) * 5 + 2.5 WHEN AGE <= 17 THEN 16.5 WHEN AGE <= 19 THEN 19.0
            WHEN AGE <= 21 THEN AGE + 0.5 ELSE 23.5 END AS mid
        FROM person WHERE YEAR IN (1996, 2000)) GROUP BY ALL)
"""))
def mean_age_change_from_labels(spark, folder):
    """Ageing of every area between the two tables, in six classes of equal size."""
    ages = _mean_ages(spark, folder)
    change = two_point(ages, ["geoid"], "year", *YEARS, ["mean_age"], missing="null").select(
        "geoid", difference("mean_age").alias("diff"))
    classed = cut_number(cut_lineage(change), "diff", 6, "class")
    return classed.select("geoid", r6("diff").alias("mean_age_diff"), "class")


@query("q32b_age_dictionary", f"""
WITH seen AS (SELECT DISTINCT year, AGE FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, p_size AS AGE
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) WHERE year IN (1996, 2000)),
survey(low, high, label, a, z) AS ({_ranges_sql(SURVEY_AGES)}), census(low, high, label, a, z) AS ({_ranges_sql(CENSUS_AGES)}),
labels AS (
  SELECT DISTINCT year, label, a, z FROM seen JOIN survey ON year = 2000 AND AGE BETWEEN low AND high
  UNION ALL SELECT DISTINCT year, label, a, z FROM seen JOIN census ON year = 1996 AND AGE BETWEEN low AND high),
bands AS (SELECT a, z, row_number() OVER (ORDER BY a) AS band FROM (SELECT DISTINCT a, z FROM labels WHERE year = 2000))
SELECT year, label, CAST(r.z - r.a + 1 AS INTEGER) AS n_ages, CAST(band AS BIGINT) AS band, (s.a + s.z + 1) / 2.0 AS age_mean
FROM labels r LEFT JOIN bands s ON r.a >= s.a AND r.z <= s.z
""")
def age_dictionary(spark, folder):
    table = age_estimates(spark, folder)
    found = harmonised_labels(cut_lineage(table.select("year", "label").distinct()))
    return found.select("year", "label", F.size("ages").alias("n_ages"), "band", "age_mean")


@query("q32c_numbers_in_text", """
SELECT doc_id, CAST(len(d) AS INTEGER) AS n_numbers, list_max([len(x) for x in d]) AS longest,
  CASE WHEN list_max([len(x) for x in d]) <= 36 THEN CAST(list_sum([TRY_CAST(x AS DECIMAL(38, 0)) for x in d]) AS VARCHAR) END AS number_sum
FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS d FROM documents) WHERE len(d) > 0
""")
def numbers_in_text(spark, folder):
    """Digit runs of every whole text: how many, how long, and the sum of the numbers.

    The sum is exact, or NULL where a run has more than 36 digits, as no number type holds the sum of such.
    """
    runs = F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1))
    found = load(spark, folder, "documents").select("doc_id", runs.alias("runs")).filter(F.size("runs") > 0)
    longest = F.array_max(F.transform("runs", lambda d: F.length(d).cast("bigint")))
    whole = F.lit(0).cast("decimal(38,0)")
    total = F.aggregate(
        F.transform("runs", lambda d: d.try_cast("decimal(38,0)")), whole, lambda acc, v: (acc + v).cast("decimal(38,0)"))
    return found.select(
        "doc_id", F.size("runs").alias("n_numbers"), longest.alias("longest"),
        F.when(longest <= 36, total).cast("string").alias("number_sum"))


@query("q38_labelled_interval_bands", with_person("""
SELECT CASE WHEN i = 0 THEN '[' ELSE '(' END || regexp_replace(CAST(round(lo + i * 0.2, 6) AS VARCHAR), '\\.0$', '') || ','
    || regexp_replace(CAST(round(lo + (i + 1) * 0.2, 6) AS VARCHAR), '\\.0$', '') || ']' AS band, n
FROM (SELECT lo, i, count(*) AS n
  FROM (SELECT lo, greatest(CAST(ceil((p - lo) / CAST(0.2 AS DOUBLE)) AS INTEGER) - 1, 0) AS i
        FROM shares, (SELECT floor(min(p) / CAST(0.2 AS DOUBLE)) * CAST(0.2 AS DOUBLE) AS lo FROM shares)) GROUP BY ALL)
""", """
shares AS (SELECT CPUMA0010, sum(CASE WHEN fb THEN PERWT ELSE 0 END) / sum(PERWT) AS p
  FROM person WHERE YEAR = 2000 GROUP BY ALL)
"""))
def labelled_interval_bands(spark, folder):
    rows = person(spark, folder, "CPUMA0010", "YRIMMIG", "PERWT", years=[2000])
    shares = cut_lineage(rows.groupBy("CPUMA0010").agg(
        safe_div(conditional_sum("PERWT", recode.foreign_born()), F.sum("PERWT")).alias("p")))
    origin = shares.agg(F.floor(F.min("p") / F.lit(0.2)) * F.lit(0.2)).scalar()
    banded = shares.withColumn("_origin", origin)
    return banded.groupBy(interval_label("p", 0.2, F.col("_origin")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
