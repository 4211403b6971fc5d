"""Population counts, age structure, shares and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from demoflux.functions import recode
from demoflux.functions.semantics import age_band, in_set, pad_code, safe_div, short_number
from demoflux.operators.aggregate import (
    conditional_sum, group_total, share_in_group, share_of_total, weighted_count, weighted_mean, weighted_rate,
)
from demoflux.operators.change import difference, two_point
from demoflux.operators.flows import leaving_rate
from demoflux.operators.joins import join_nullsafe, natural_join
from demoflux.operators.models import crossed, factor_levels, linear_bic, terms
from demoflux.plans.person import person, state_clusters, with_person
from demoflux.plans.registry import query, r6
from demoflux.session import cut_lineage


@query("q1_population_by_race_and_birthplace", with_person("""
SELECT YEAR AS year, coalesce(race4, 'Other') AS race, bplc AS birthplace, fb AS foreign_born, sum(PERWT) AS n
FROM person GROUP BY ALL
"""))
def population_by_race_and_birthplace(spark, folder):
    rows = person(spark, folder, "YEAR", "HISPAN", "RACE", "BPL", "YRIMMIG", "PERWT")
    cells = rows.groupBy(
        F.col("YEAR").alias("year"), recode.race([4, 5, 6]).alias("race"),
        recode.birthplace().alias("birthplace"), recode.foreign_born().alias("foreign_born"),
    ).agg(F.sum("PERWT").alias("n"))
    return cells.withColumn("race", recode.race_or_other(F.col("race")))


@query("q1b_state_population_series", with_person("""
SELECT n_name AS name, YEAR AS year, coalesce(race4, 'Other') AS race, fb AS foreign_born, sum(PERWT) AS n
FROM person JOIN nation ON STATEFIP = n_nationkey WHERE n_name = 'NATION_6' GROUP BY ALL
"""))
def state_population_series(spark, folder):
    names = state_clusters(spark, folder).select("STATEFIP", F.col("Name").alias("name")).filter("name = 'NATION_6'")
    rows = person(spark, folder, "STATEFIP", "YEAR", "HISPAN", "RACE", "YRIMMIG", "PERWT")
    cells = rows.join(names.select("STATEFIP"), "STATEFIP", "left_semi").groupBy(
        "STATEFIP", F.col("YEAR").alias("year"), recode.race([4, 5, 6]).alias("race"),
        recode.foreign_born().alias("foreign_born"),
    ).agg(F.sum("PERWT").alias("n")).withColumn("race", recode.race_or_other(F.col("race")))
    return natural_join(cells, names).drop("STATEFIP")


def _age_distribution(rows, by, mean_age):
    """Counts per band with their share of the group and the group's mean age."""
    cells = rows.groupBy(*by, "age_group").agg(F.sum("PERWT").alias("n"), mean_age.alias("_age"))
    shared = share_in_group(cells, "n", by, "proportion")
    aged = group_total(shared, F.col("_age") * F.col("proportion"), by, "mean_age")
    return aged.select(*by, "age_group", "n", r6("proportion").alias("proportion"), r6("mean_age").alias("mean_age"))


@query("q2_age_distribution", with_person("""
SELECT year, origin, age_group, n, round(proportion, 6) AS proportion,
  round(sum(age_w * proportion) OVER (PARTITION BY year, origin), 6) AS mean_age
FROM (SELECT *, n / sum(n) OVER (PARTITION BY year, origin) AS proportion
      FROM (SELECT YEAR AS year, origin6 AS origin, band AS age_group, sum(PERWT) AS n, avg(AGE) AS age_w
            FROM person GROUP BY ALL))
"""))
def age_distribution(spark, folder):
    rows = person(spark, folder, "YEAR", "HISPAN", "BPL", "AGE", "PERWT").select(
        F.col("YEAR").alias("year"), recode.origin_six().alias("origin"), age_band("AGE").alias("age_group"),
        "AGE", "PERWT")
    return _age_distribution(rows, ["year", "origin"], F.avg("AGE"))


@query("q2b_age_distribution_by_region", with_person("""
SELECT year, origin, cluster, age_group, n, round(proportion, 6) AS proportion,
  round(sum(age_w * proportion) OVER (PARTITION BY year, origin, cluster), 6) AS mean_age
FROM (SELECT *, n / sum(n) OVER (PARTITION BY year, origin, cluster) AS proportion
      FROM (SELECT YEAR AS year, origin9 AS origin, cluster_now AS cluster, band AS age_group, sum(PERWT) AS n,
              sum(AGE * PERWT) / sum(PERWT) AS age_w
            FROM person WHERE AGE > 15 AND AGE <= 65
              AND (origin9 LIKE '%Hispanic%' OR origin9 = 'Mexico' OR origin9 = 'Native White') GROUP BY ALL))
"""))
def age_distribution_by_region(spark, folder):
    rows = person(spark, folder, "YEAR", "HISPAN", "RACE", "BPL", "AGE", "Cluster", "PERWT").filter(
        (F.col("AGE") > 15) & (F.col("AGE") <= 65)
    ).select(
        F.col("YEAR").alias("year"), recode.origin_nine().alias("origin"), F.col("Cluster").alias("cluster"),
        age_band("AGE").alias("age_group"), "AGE", "PERWT",
    ).filter(F.col("origin").rlike("Hispanic") | F.col("origin").isin("Mexico", "Native White"))
    return _age_distribution(rows, ["year", "origin", "cluster"], weighted_mean("AGE"))


@query("q2c_age_distribution_of_movers", with_person("""
SELECT origin, age_group, n, round(proportion, 6) AS proportion,
  round(sum(age_w * proportion) OVER (PARTITION BY origin), 6) AS mean_age
FROM (SELECT *, n / sum(n) OVER (PARTITION BY origin) AS proportion
      FROM (SELECT origin6 AS origin, band AS age_group, sum(PERWT) AS n, sum(AGE * PERWT) / sum(PERWT) AS age_w
            FROM person WHERE AGE > 15 AND AGE <= 65 AND MIGCOUNTY1 <> 0
              AND (origin6 LIKE '%Hispanic%' OR origin6 = 'Mexico') GROUP BY ALL))
"""))
def age_distribution_of_movers(spark, folder):
    rows = person(spark, folder, "HISPAN", "BPL", "AGE", "MIGCOUNTY1", "PERWT").filter(
        (F.col("AGE") > 15) & (F.col("AGE") <= 65) & recode.moved_county()
    ).select(recode.origin_six().alias("origin"), age_band("AGE").alias("age_group"), "AGE", "PERWT").filter(
        F.col("origin").rlike("Hispanic") | (F.col("origin") == "Mexico"))
    return _age_distribution(rows, ["origin"], weighted_mean("AGE"))


@query("q3_migration_rate", with_person("""
SELECT band AS age_group, origin_c AS origin, YEAR AS year, CASE WHEN SEX = 1 THEN 'Male' ELSE 'Female' END AS sex,
  round(sum(CASE WHEN MIGRATE1D >= 24 THEN PERWT ELSE 0 END) / sum(PERWT), 6) AS mig_rate
FROM person
WHERE origin_c IN ('Native Hispanic', 'Native White', 'Mexico', 'Other Migrant') GROUP BY ALL
"""))
def migration_rate(spark, folder):
    rows = person(spark, folder, "AGE", "HISPAN", "RACE", "BPL", "YEAR", "SEX", "MIGRATE1D", "PERWT").withColumn(
        "origin", recode.origin_collapsed())
    kept = rows.filter(F.col("origin").isin(recode.ANALYSIS_GROUPS))
    rates = kept.groupBy(
        age_band("AGE").alias("age_group"), "origin", F.col("YEAR").alias("year"), recode.sex_label().alias("sex")
    ).agg(r6(weighted_rate(recode.moved_area())).alias("mig_rate"))
    return rates.filter(F.col("mig_rate").isNotNull())


@query("q3b_migration_rate_by_region", with_person("""
SELECT band AS age_group, origin_c AS origin, YEAR AS year, CASE WHEN SEX = 1 THEN 'Male' ELSE 'Female' END AS sex,
  cluster_now AS cluster, round(sum(CASE WHEN MIGRATE1D >= 24 THEN PERWT ELSE 0 END) / sum(PERWT), 6) AS mig_rate
FROM person
WHERE origin_c IN ('Mexico', 'Native White') AND band > 0 AND band < 60 AND cluster_now IS NOT NULL GROUP BY ALL
"""))
def migration_rate_by_region(spark, folder):
    rows = person(
        spark, folder, "AGE", "HISPAN", "RACE", "BPL", "YEAR", "SEX", "MIGRATE1D", "Cluster", "PERWT"
    ).withColumns({"origin": recode.origin_collapsed(), "age_group": age_band("AGE")})
    kept = rows.filter(
        F.col("origin").isin("Mexico", "Native White") & (F.col("age_group") > 0) & (F.col("age_group") < 60)
        & F.col("Cluster").isNotNull())
    return kept.groupBy(
        "age_group", "origin", F.col("YEAR").alias("year"), recode.sex_label().alias("sex"),
        F.col("Cluster").alias("cluster"),
    ).agg(r6(weighted_rate(recode.moved_area())).alias("mig_rate"))


@query("q4_comparison_population", with_person("""
SELECT year, foreign_born, cluster, age_group, n, round(n / sum(n) OVER w, 6) AS proportion,
  round(sum(age_group * n) OVER w / sum(n) OVER w, 6) AS med_age
FROM (SELECT YEAR AS year, fb AS foreign_born, cluster_now AS cluster, band AS age_group, count(*) AS n
      FROM person WHERE NOT (fb AND race3 <> 'Hispanic') GROUP BY ALL)
WHERE cluster IS NOT NULL WINDOW w AS (PARTITION BY year, foreign_born, cluster)
"""))
def comparison_population(spark, folder):
    rows = person(spark, folder, "YEAR", "YRIMMIG", "HISPAN", "RACE", "Cluster", "AGE").withColumns(
        {"foreign_born": recode.foreign_born(), "race": recode.race()})
    cells = rows.filter(~(F.col("foreign_born") & (F.col("race") != "Hispanic"))).groupBy(
        F.col("YEAR").alias("year"), "foreign_born", F.col("Cluster").alias("cluster"),
        age_band("AGE").alias("age_group"),
    ).agg(F.count(F.lit(1)).alias("n")).filter(F.col("cluster").isNotNull())
    by = ["year", "foreign_born", "cluster"]
    shared = share_in_group(cells, "n", by, "proportion")
    aged = group_total(shared, F.col("age_group") * F.col("proportion"), by, "med_age")
    return aged.select(*by, "age_group", "n", r6("proportion").alias("proportion"), r6("med_age").alias("med_age"))


def eligible(rows):
    """Residents of the listed states whose place one year ago is known, or who came from Mexico.

    The place of people from Mexico is coded 99.
    """
    kept = rows.filter((F.col("STATEFIP") < 56) & ~in_set("STATEFIP", [2, 15])).filter(
        ~in_set("MIGRATE1D", recode.ABROAD_OR_UNKNOWN_MOVE) | (F.col("MIGPLAC1") == recode.MEXICO))
    placed = kept.withColumn("MIGPLAC1", F.when(F.col("MIGPLAC1") == recode.MEXICO, 99).otherwise(F.col("MIGPLAC1")))
    return placed.filter(~in_set("MIGPLAC1", [110, 2, 15]))


ELIGIBLE_SQL = """
eligible AS (
  SELECT * EXCLUDE (MIGPLAC1), CASE WHEN MIGPLAC1 = 200 THEN 99 ELSE MIGPLAC1 END AS MIGPLAC1
  FROM person
  WHERE STATEFIP < 56 AND STATEFIP NOT IN (2, 15) AND (MIGRATE1D NOT IN (0, 20, 40) OR MIGPLAC1 = 200)
    AND (CASE WHEN MIGPLAC1 = 200 THEN 99 ELSE MIGPLAC1 END) NOT IN (110, 2, 15))
"""


@query("q5_eligible_population", with_person("""
SELECT YEAR AS year, printf('%02d', STATEFIP) AS state, printf('%02d', MIGPLAC1) AS prior_place,
  count(*) AS n_rows, sum(PERWT) AS n
FROM eligible GROUP BY ALL
""", ELIGIBLE_SQL))
def eligible_population(spark, folder):
    rows = eligible(person(spark, folder, "YEAR", "STATEFIP", "MIGRATE1D", "MIGPLAC1", "PERWT"))
    return rows.groupBy(
        F.col("YEAR").alias("year"), pad_code("STATEFIP", 2).alias("state"), pad_code("MIGPLAC1", 2).alias("prior_place")
    ).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("PERWT").alias("n"))


@query("q6_population_by_region", with_person("""
SELECT YEAR AS year, cluster_now AS cluster, count(DISTINCT STATEFIP) AS states, sum(PERWT) AS n
FROM person GROUP BY ALL
"""))
def population_by_region(spark, folder):
    states = weighted_count(person(spark, folder, "YEAR", "STATEFIP", "PERWT"), ["YEAR", "STATEFIP"])
    clustered = join_nullsafe(states, state_clusters(spark, folder).drop("Name"), ["STATEFIP"], "left")
    return clustered.groupBy(F.col("YEAR").alias("year"), F.col("Cluster").alias("cluster")).agg(
        F.count(F.lit(1)).alias("states"), F.sum("n").alias("n"))


@query("q7_standardised_mean_age", with_person("""
SELECT year, race, foreign_born, round(sum(p * age), 6) AS age
FROM (SELECT *, n / sum(n) OVER (PARTITION BY year, race, foreign_born) AS p
      FROM (SELECT CPUMA0010, YEAR AS year, race3 AS race, fb AS foreign_born, avg(AGE) AS age, count(*) AS n
            FROM person GROUP BY ALL) WHERE race IS NOT NULL)
GROUP BY ALL
"""))
def standardised_mean_age(spark, folder):
    return _standardised_ages(spark, folder).withColumn("age", r6("age"))


def _standardised_ages(spark, folder):
    """Mean of area means, each weighted by the area's share of the group.

    The weighted sum is written as a ratio of sums over the areas, so no window ever holds
    all areas of a group.
    """
    rows = person(spark, folder, "CPUMA0010", "YEAR", "HISPAN", "RACE", "YRIMMIG", "AGE")
    areas = rows.groupBy(
        "CPUMA0010", F.col("YEAR").alias("year"), recode.race().alias("race"),
        recode.foreign_born().alias("foreign_born"),
    ).agg(F.avg("AGE").alias("age"), F.count(F.lit(1)).alias("n"))
    return areas.filter(F.col("race").isNotNull()).groupBy("year", "race", "foreign_born").agg(
        weighted_mean("age", "n").alias("age"))


@query("q7b_age_shares_with_mean_age", with_person("""
SELECT year, race, foreign_born, age_group, n, round(n / sum(n) OVER (PARTITION BY year, race, foreign_born), 6) AS proportion,
  round(age, 6) AS age
FROM (SELECT YEAR AS year, race3 AS race, fb AS foreign_born, band AS age_group, count(*) AS n
      FROM person WHERE race3 IS NOT NULL GROUP BY ALL)
LEFT JOIN (SELECT year, race, foreign_born, sum(n * age) / sum(n) AS age
           FROM (SELECT CPUMA0010, YEAR AS year, race3 AS race, fb AS foreign_born, avg(AGE) AS age, count(*) AS n
                 FROM person GROUP BY ALL) GROUP BY ALL) USING (year, race, foreign_born)
"""))
def age_shares_with_mean_age(spark, folder):
    """Unweighted age shares with the standardised mean age, joined on all common columns."""
    rows = person(spark, folder, "YEAR", "HISPAN", "RACE", "YRIMMIG", "AGE")
    cells = rows.groupBy(
        F.col("YEAR").alias("year"), recode.race().alias("race"), recode.foreign_born().alias("foreign_born"),
        age_band("AGE").alias("age_group"),
    ).agg(F.count(F.lit(1)).alias("n")).filter(F.col("race").isNotNull())
    shared = share_in_group(cells, "n", ["year", "race", "foreign_born"], "proportion")
    return natural_join(shared, _standardised_ages(spark, folder)).withColumns(
        {"proportion": r6("proportion"), "age": r6("age")})


@query("q9_leaving_rate", with_person("""
SELECT YEAR AS year, eth AS ethnicity, CASE eth WHEN 'Native White' THEN 1 WHEN 'Native Latino' THEN 2
    WHEN 'FB Latino Citizen' THEN 3 ELSE 4 END AS ethnicity_order,
  count(*) AS n, round(sum(CASE WHEN left_state THEN PERWT ELSE 0 END) / sum(PERWT), 6) AS rate
FROM (SELECT *, MIGPLAC1 = 4 AND STATEFIP <> 4 AS left_state,
        CASE WHEN BPL < 100 AND HISPAN = 1 THEN 'Native Latino' WHEN BPL < 100 AND RACE = 1 THEN 'Native White'
          WHEN BPL >= 150 AND CITIZEN < 3 AND HISPAN = 1 THEN 'FB Latino Citizen'
          WHEN BPL >= 150 AND CITIZEN >= 3 AND HISPAN = 1 THEN 'FB Latino Non-Citizen' END AS eth
      FROM person WHERE (BPL IN (200, 210, 300) OR BPL <= 99) AND AGE BETWEEN 18 AND 65)
WHERE (left_state OR (MIGPLAC1 IN (0, 4) AND STATEFIP = 4)) AND eth IS NOT NULL AND YEAR <> 1995
GROUP BY ALL
"""))
def leaving_rate_by_ethnicity(spark, folder):
    rows = _at_risk(person(
        spark, folder, "YEAR", "BPL", "HISPAN", "RACE", "CITIZEN", "AGE", "MIGPLAC1", "STATEFIP", "PERWT"))
    grouped = rows.withColumn("ethnicity", recode.ethnicity_citizenship()).filter(
        F.col("ethnicity").isNotNull() & (F.col("YEAR") != 1995))
    return leaving_rate(
        grouped.withColumns({
            "year": F.col("YEAR"), "ethnicity_order": recode.level_order("ethnicity", recode.ETHNICITY_CITIZENSHIP)}),
        recode.left_state(4), ["year", "ethnicity", "ethnicity_order"],
    ).withColumn("rate", r6("rate"))


def _studied(rows):
    born = F.col("BPL").isin(200, 210, 300) | (F.col("BPL") <= 99)
    return rows.filter(born & F.col("AGE").between(18, 65))


def _at_risk(rows):
    return _studied(rows).filter(recode.at_risk_of_leaving(4))


@query("q9c_control_state_leavers", with_person("""
SELECT YEAR AS year, eth AS ethnicity, count(*) AS n,
  round(sum(CASE WHEN MIGPLAC1 IN (6, 32) THEN PERWT ELSE 0 END), 6) AS left_control,
  round(sum(CASE WHEN MIGPLAC1 = 4 AND STATEFIP <> 4 THEN PERWT ELSE 0 END), 6) AS left_state,
  round(sum(CASE WHEN MIGPLAC1 IN (6, 32) THEN PERWT ELSE 0 END) / sum(PERWT), 6) AS control_share
FROM (SELECT *,
        CASE WHEN BPL < 100 AND HISPAN = 1 THEN 'Native Latino' WHEN BPL < 100 AND RACE = 1 THEN 'Native White'
          WHEN BPL >= 150 AND CITIZEN < 3 AND HISPAN = 1 THEN 'FB Latino Citizen'
          WHEN BPL >= 150 AND CITIZEN >= 3 AND HISPAN = 1 THEN 'FB Latino Non-Citizen' END AS eth
      FROM person WHERE (BPL IN (200, 210, 300) OR BPL <= 99) AND AGE BETWEEN 18 AND 65)
WHERE eth IS NOT NULL GROUP BY ALL
"""))
def control_state_leavers(spark, folder):
    """People who came from the control states, next to those who left the state under study."""
    rows = _studied(person(
        spark, folder, "YEAR", "BPL", "HISPAN", "RACE", "CITIZEN", "AGE", "MIGPLAC1", "STATEFIP", "PERWT"))
    cells = rows.withColumn("ethnicity", recode.ethnicity_citizenship()).filter(F.col("ethnicity").isNotNull()).groupBy(
        F.col("YEAR").alias("year"), "ethnicity").agg(
        F.count("*").alias("n"), F.sum(F.when(recode.left_control(), F.col("PERWT")).otherwise(0.0)).alias("left_control"),
        F.sum(F.when(recode.left_state(4), F.col("PERWT")).otherwise(0.0)).alias("left_state"), F.sum("PERWT").alias("people"))
    return cells.select(
        "year", "ethnicity", "n", r6("left_control").alias("left_control"), r6("left_state").alias("left_state"),
        r6(safe_div(F.col("left_control"), F.col("people"))).alias("control_share"))


@query("q9b_leaving_rate_by_profile", with_person("""
SELECT CASE WHEN AGE <= 29 THEN '(17,29]' WHEN AGE <= 39 THEN '(29,39]' WHEN AGE <= 49 THEN '(39,49]' ELSE '(49,65]' END
    AS age_group,
  CASE WHEN EDUC < 6 THEN 'Below High School' WHEN EDUC = 6 THEN 'High School' WHEN EDUC < 10 THEN 'Some College'
    ELSE 'College' END AS education,
  CASE WHEN EDUC < 6 THEN 1 WHEN EDUC = 6 THEN 2 WHEN EDUC < 10 THEN 3 ELSE 4 END AS education_order,
  CITIZEN >= 3 AND YRIMMIG >= 1990 AND EDUC <= 7 AND SCHOOL <> 2 AND CLASSWKRD NOT IN (24, 25, 26, 27, 28) AS undocumented,
  CASE WHEN BPL < 100 AND HISPAN = 1 THEN 'Native Hispanic' WHEN BPL < 100 AND RACE = 1 THEN 'Native White'
    WHEN BPL IN (200, 210, 300) AND CITIZEN < 3 THEN 'FB Latino Citizen'
    WHEN BPL IN (200, 210, 300) AND CITIZEN >= 3 AND YRIMMIG >= 1990 AND EDUC <= 7 AND SCHOOL <> 2
      AND CLASSWKRD NOT IN (24, 25, 26, 27, 28) THEN 'FB Latino Undocumented'
    WHEN BPL IN (200, 210, 300) THEN 'FB Latino Non-Citizen' END AS status,
  CASE WHEN BPL < 100 AND HISPAN = 1 THEN 'Native Hispanic' WHEN BPL < 100 THEN 'Native Other'
    WHEN BPL = 200 THEN 'Mexico' ELSE 'Other Migrant' END AS origin,
  BPL = 200 AS mx, NCHILD <> 0 AS child, MARST <= 2 AS married, count(*) AS n,
  round(sum(CASE WHEN MIGPLAC1 = 4 AND STATEFIP <> 4 THEN PERWT ELSE 0 END) / sum(PERWT), 6) AS rate
FROM person
WHERE (BPL IN (200, 210, 300) OR BPL <= 99) AND AGE BETWEEN 18 AND 65
  AND ((MIGPLAC1 = 4 AND STATEFIP <> 4) OR (MIGPLAC1 IN (0, 4) AND STATEFIP = 4))
GROUP BY ALL
"""))
def leaving_rate_by_profile(spark, folder):
    rows = _at_risk(person(
        spark, folder, "YEAR", "BPL", "HISPAN", "RACE", "CITIZEN", "YRIMMIG", "EDUC", "SCHOOL", "CLASSWKRD", "NCHILD",
        "MARST", "AGE", "MIGPLAC1", "STATEFIP", "PERWT"))
    described = rows.withColumns({
        "age_group": recode.working_age_group(), "education": recode.education(),
        "undocumented": recode.likely_undocumented(), "status": recode.ethnicity_legal_status(),
        "origin": recode.origin_latino_study(), "mx": recode.born_in_mexico(), "child": recode.has_child(),
        "married": recode.married(),
    }).withColumn("education_order", recode.level_order("education", recode.EDUCATION_LEVELS))
    by = ["age_group", "education", "education_order", "undocumented", "status", "origin", "mx", "child", "married"]
    return leaving_rate(described, recode.left_state(4), by).withColumn("rate", r6("rate"))


@query("q12_mean_age_by_area", with_person("""
SELECT CPUMA0010 AS area, round(sum(PERWT * AGE) / sum(PERWT), 6) AS age
FROM person WHERE bplc = 'Mexico' AND YEAR = 2000 GROUP BY ALL
"""))
def mean_age_by_area(spark, folder):
    rows = person(spark, folder, "CPUMA0010", "BPL", "AGE", "PERWT", years=[2000])
    return rows.filter(recode.born_in_mexico()).groupBy(F.col("CPUMA0010").alias("area")).agg(
        r6(weighted_mean("AGE")).alias("age"))


@query("q13_area_share", with_person("""
SELECT area, pop, round(pop / sum(pop) OVER (), 9) AS share
FROM (SELECT CPUMA0010 AS area, sum(CASE WHEN bplc = 'Mexico' THEN PERWT ELSE 0 END) AS pop
      FROM person WHERE YEAR = 2000 GROUP BY ALL)
"""))
def area_share(spark, folder):
    """Each area's share of the Mexican-born; the grand total is one value, not a window over all areas."""
    rows = person(spark, folder, "CPUMA0010", "BPL", "PERWT", years=[2000])
    cells = rows.groupBy(F.col("CPUMA0010").alias("area")).agg(
        conditional_sum("PERWT", recode.born_in_mexico()).alias("pop"))
    shared = share_of_total(cells, cells, "pop")
    return shared.select("area", "pop", F.round("share", 9).alias("share"))


@query("q14_change_in_area_share", with_person("""
SELECT area, round(max(CASE WHEN year = 2000 THEN share END) - max(CASE WHEN year = 1996 THEN share END), 9) AS delta_share
FROM (SELECT *, pop / sum(pop) OVER (PARTITION BY year) AS share
      FROM (SELECT YEAR AS year, CPUMA0010 AS area, sum(CASE WHEN bplc = 'Mexico' THEN PERWT ELSE 0 END) AS pop
            FROM person WHERE YEAR IN (1996, 2000) GROUP BY ALL))
GROUP BY area HAVING count(*) = 2
"""))
def change_in_area_share(spark, folder):
    rows = person(spark, folder, "YEAR", "CPUMA0010", "BPL", "PERWT", years=[1996, 2000])
    named = rows.select(F.col("YEAR").alias("year"), F.col("CPUMA0010").alias("area"), "BPL", "PERWT")
    cells = named.groupBy("year", "area").agg(conditional_sum("PERWT", recode.born_in_mexico()).alias("pop"))
    shared = share_of_total(cells, cells, "pop", ["year"])
    change = two_point(shared, ["area"], "year", 1996, 2000, ["share"])
    return change.select("area", F.round(difference("share"), 9).alias("delta_share"))


@query("q14b_change_with_mean_age", with_person("""
SELECT area, l.pop - f.pop AS delta_pop, round(age, 6) AS age
FROM (SELECT CPUMA0010 AS area, sum(CASE WHEN BPL = 200 THEN PERWT ELSE 0 END) AS pop FROM person WHERE YEAR = 1996 GROUP BY ALL) f
JOIN (SELECT CPUMA0010 AS area, sum(CASE WHEN BPL = 200 THEN PERWT ELSE 0 END) AS pop FROM person WHERE YEAR = 2000 GROUP BY ALL) l
  USING (area)
LEFT JOIN (SELECT CPUMA0010 AS area, sum(AGE * PERWT) / sum(PERWT) AS age FROM person WHERE YEAR = 2000 AND BPL = 200 GROUP BY ALL)
  USING (area)
"""))
def change_with_mean_age(spark, folder):
    """Change of the Mexican-born per area with their mean age in the later year, from one pass."""
    rows = person(spark, folder, "YEAR", "CPUMA0010", "BPL", "AGE", "PERWT", years=[1996, 2000])
    mexican = recode.born_in_mexico()
    weight = F.when(mexican, F.col("PERWT"))
    cells = rows.groupBy(F.col("YEAR").alias("year"), F.col("CPUMA0010").alias("area")).agg(
        conditional_sum("PERWT", mexican).alias("pop"), safe_div(F.sum(F.col("AGE") * weight), F.sum(weight)).alias("age"))
    change = two_point(cells, ["area"], "year", 1996, 2000, ["pop", "age"])
    return change.select("area", difference("pop").alias("delta_pop"), r6("age_last").alias("age"))


@query("q39_mean_of_yearly_rates", with_person("""
SELECT origin, round(avg(prop), 6) AS mig_rate
FROM (SELECT YEAR, origin6 AS origin, sum(CASE WHEN MIGCOUNTY1 <> 0 THEN PERWT ELSE 0 END) / sum(PERWT) AS prop
      FROM person GROUP BY ALL)
WHERE origin LIKE '%Hispanic%' OR origin = 'Mexico' GROUP BY ALL
"""))
def mean_of_yearly_rates(spark, folder):
    rows = person(spark, folder, "YEAR", "BPL", "HISPAN", "MIGCOUNTY1", "PERWT")
    yearly = rows.groupBy("YEAR", recode.origin_six().alias("origin")).agg(
        weighted_rate(recode.moved_county()).alias("rate"))
    kept = yearly.filter(F.col("origin").rlike("Hispanic") | (F.col("origin") == "Mexico"))
    return kept.groupBy("origin").agg(r6(F.avg("rate")).alias("mig_rate"))


@query("q29b_birthplace_share_labels", with_person("""
SELECT year, birthplace, n, round(pr, 6) AS share,
  'Percent: ' || regexp_replace(CAST(round_even(100 * pr, 2) AS VARCHAR), '\\.0$', '') AS label
FROM (SELECT *, n / sum(n) OVER (PARTITION BY year) AS pr
      FROM (SELECT YEAR AS year, bplc AS birthplace, sum(PERWT) AS n FROM person GROUP BY ALL)
      WHERE birthplace <> 'Native')
"""))
def birthplace_share_labels(spark, folder):
    rows = person(spark, folder, "YEAR", "BPL", "PERWT")
    cells = rows.groupBy(F.col("YEAR").alias("year"), recode.birthplace().alias("birthplace")).agg(
        F.sum("PERWT").alias("n")).filter(F.col("birthplace") != "Native")
    shared = share_in_group(cells, "n", ["year"])
    label = F.concat(F.lit("Percent: "), short_number(F.bround(100 * F.col("share"), 2)))
    return shared.select("year", "birthplace", "n", r6("share").alias("share"), label.alias("label"))


@query("q41_age_gap_between_groups", with_person("""
SELECT year, area, state, round(max(CASE WHEN fb THEN age END) - max(CASE WHEN NOT fb THEN age END), 6) AS fb_older_diff
FROM (SELECT YEAR AS year, CPUMA0010 AS area, AREASTATE AS state, fb, avg(EDUC) AS age
      FROM person WHERE YEAR > 1995 AND NOT (fb AND race3 <> 'Hispanic') GROUP BY ALL)
GROUP BY year, area, state HAVING count(*) = 2
"""))
def age_gap_between_groups(spark, folder):
    return _age_gaps(spark, folder).withColumn("fb_older_diff", r6("fb_older_diff"))


def _age_gaps(spark, folder, measure="EDUC"):
    """Mean of the foreign-born Hispanic minus the native, per area and year with both groups.

    An article has one size, so all people of an area are of one age; schooling stands in for it.
    """
    rows = person(spark, folder, "YEAR", "CPUMA0010", "AREASTATE", "YRIMMIG", "HISPAN", "RACE", measure, years=slice(1996, None)).withColumns(
        {"fb": recode.foreign_born(), "race": recode.race()})
    kept = rows.filter(~(F.col("fb") & (F.col("race") != "Hispanic")))
    by = [F.col("YEAR").alias("year"), F.col("CPUMA0010").alias("area"), F.col("AREASTATE").alias("state")]
    gaps = kept.groupBy(*by).agg(
        F.avg(F.when(F.col("fb"), F.col(measure))).alias("migrant"),
        F.avg(F.when(~F.col("fb"), F.col(measure))).alias("native"),
    )
    both = gaps.filter(F.col("migrant").isNotNull() & F.col("native").isNotNull())
    return both.select("year", "area", "state", (F.col("migrant") - F.col("native")).alias("fb_older_diff"))


def _additive_steps(rounds: int) -> str:
    """SQL: residuals of year plus cluster effects, by taking out the means of either in turn until nothing is left of both."""
    parts = ["left_0 AS (SELECT year, cluster, y FROM gaps)"]
    for i in range(2 * rounds):
        by = ("year", "cluster")[i % 2]
        parts.append(f"left_{i + 1} AS (SELECT year, cluster, y - avg(y) OVER (PARTITION BY {by}) AS y FROM left_{i})")
    return ",\n".join([*parts, f"residuals AS (SELECT y FROM left_{2 * rounds})"])


@query("q41b_models_of_age_gap", with_person("""
SELECT model, CAST(k AS INTEGER) AS k, n, round(rss, 3) AS rss, round(n * ln(rss / n) + (k + 1) * ln(n), 3) AS bic FROM (
  SELECT '1' AS model, 1 AS k, count(*) AS n, sum((y - m) ** 2) AS rss FROM (SELECT y, avg(y) OVER () AS m FROM gaps)
  UNION ALL SELECT 'Year', (SELECT count(DISTINCT year) FROM gaps), count(*), sum((y - m) ** 2)
    FROM (SELECT y, avg(y) OVER (PARTITION BY year) AS m FROM gaps)
  UNION ALL SELECT 'Cluster', (SELECT count(DISTINCT cluster) FROM gaps), count(*), sum((y - m) ** 2)
    FROM (SELECT y, avg(y) OVER (PARTITION BY cluster) AS m FROM gaps)
  UNION ALL SELECT 'Year + Cluster', (SELECT count(DISTINCT year) + count(DISTINCT cluster) - 1 FROM gaps), count(*), sum(y ** 2)
    FROM residuals
  UNION ALL SELECT 'Year * Cluster', (SELECT count(*) FROM (SELECT DISTINCT year, cluster FROM gaps)), count(*), sum((y - m) ** 2)
    FROM (SELECT y, avg(y) OVER (PARTITION BY year, cluster) AS m FROM gaps))
""", """
gaps AS (
  SELECT year, r_name AS cluster, avg(EDUC) FILTER (fb) - avg(EDUC) FILTER (NOT fb) AS y
  FROM (SELECT YEAR AS year, CPUMA0010 AS area, AREASTATE AS state, fb, EDUC
        FROM person WHERE YEAR > 1995 AND NOT (fb AND race3 <> 'Hispanic'))
  JOIN nation ON state = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name <> 'MIDDLE EAST' GROUP BY year, area, state, r_name HAVING count(DISTINCT fb) = 2)
""", _additive_steps(25)))
def models_of_age_gap(spark, folder):
    """Linear models of the gap between the two groups, on areas with both, with their BIC."""
    gaps = _age_gaps(spark, folder)
    clusters = state_clusters(spark, folder).select(F.col("STATEFIP").alias("state"), F.col("Cluster").alias("cluster"))
    rows = cut_lineage(join_nullsafe(gaps, clusters, ["state"], "left").dropna())
    levels = factor_levels(rows, ["year", "cluster"])
    models = {
        "1": [], "Year": terms("year"), "Cluster": terms("cluster"), "Year + Cluster": terms("year", "cluster"),
        "Year * Cluster": terms(crossed("year", "cluster"))}
    scores = [(name, linear_bic(rows, "fb_older_diff", model, levels)) for name, model in models.items()]
    return spark.createDataFrame(
        [(name, int(s["k"]), int(s["n"]), round(s["rss"], 3), round(s["bic"], 3)) for name, s in scores],
        "model string, k int, n bigint, rss double, bic double")
