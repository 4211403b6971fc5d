"""Flows between places and net migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoflux.functions import recode
from demoflux.functions.semantics import if_else_na, pad_code
from demoflux.operators.flows import arrival_ratio, flow_matrix, net_migration
from demoflux.operators.joins import join_nullsafe, role_lookup
from demoflux.plans.person import person, state_clusters, with_person
from demoflux.plans.population import ELIGIBLE_SQL, eligible
from demoflux.plans.registry import query, r6
from demoflux.sources.tables import load

# Migration area of each market segment, and the second area that some places overlap.
AREA_OF_SEGMENT = {"AUTOMOBILE": "00010", "BUILDING": "00020", "FURNITURE": "00030", "HOUSEHOLD": "00040",
                   "MACHINERY": "00050"}
OVERLAPPED_AREA = "00060"


def area_crosswalk(spark, folder) -> DataFrame:
    """Places and the migration areas they overlap; a place may overlap two."""
    places = load(spark, folder, "customer")
    first = None
    for segment, area in AREA_OF_SEGMENT.items():
        hit = F.col("c_mktsegment") == segment
        first = F.when(hit, area) if first is None else first.when(hit, area)
    areas = F.when(F.col("c_acctbal") < 0, F.array(first, F.lit(OVERLAPPED_AREA))).otherwise(F.array(first))
    return places.select(
        pad_code("c_nationkey", 2).alias("STATEFIP"), pad_code("c_custkey", 5).alias("PUMA"),
        F.explode(areas).alias("MIGPUMA"))


def area_moves(spark, folder, years=None) -> DataFrame:
    """Weight per area now, area one year ago, year, origin and whether moved.

    Persons are summed on the crosswalk's key before it is joined, and the result is summed
    to areas before anything else is: sums pass through the joins unchanged, and every later
    join works on area pairs instead of persons.
    """
    rows = eligible(person(
        spark, folder, "YEAR", "STATEFIP", "PUMA", "MIGRATE1D", "MIGPLAC1", "MIGPUMA1", "BPL", "HISPAN", "RACE", "PERWT",
        years=years))
    grouped = rows.withColumns({"BPLCR": recode.origin_collapsed(), "hasMigrated": recode.moved_area()}).filter(
        F.col("BPLCR").isin(recode.ANALYSIS_GROUPS))
    keys = ["YEAR", "BPLCR", "hasMigrated", "STATEFIP", "MIGPLAC1", "MIGPUMA1"]
    cells = grouped.groupBy(*keys, "PUMA").agg(F.sum("PERWT").alias("PERWT"))
    placed = join_nullsafe(
        cells.withColumn("PUMA", F.concat(pad_code("STATEFIP", 2), pad_code("PUMA", 5))),
        area_crosswalk(spark, folder).select(
            F.concat("STATEFIP", "PUMA").alias("PUMA"), F.concat("STATEFIP", "MIGPUMA").alias("MIGPUMA")),
        ["PUMA"], "left")
    pairs = placed.groupBy(*keys, "MIGPUMA").agg(F.sum("PERWT").alias("PERWT"))
    prior = pad_code("MIGPUMA1", 5)
    coded = pairs.withColumns({"STATEFIP": pad_code("STATEFIP", 2), "MIGPLAC1": pad_code("MIGPLAC1", 2)})
    known = if_else_na(prior == "00000", F.lit(None).cast("string"), prior)
    return coded.withColumn("MIGPUMA1", F.concat("MIGPLAC1", known)).withColumn("MEX1", recode.arrived_from_mexico())


def moves(spark, folder) -> DataFrame:
    """Weight per cluster now, cluster one year ago, year, origin and kind of move."""
    pairs = area_moves(spark, folder)
    before = area_crosswalk(spark, folder).select(
        F.concat("STATEFIP", "MIGPUMA").alias("MIGPUMA1"), F.col("STATEFIP").alias("STATEFIP1")).distinct()
    keys = ["YEAR", "BPLCR", "hasMigrated", "MEX1", "STATEFIP", "STATEFIP1"]
    states = join_nullsafe(pairs, before, ["MIGPUMA1"], "left").groupBy(*keys).agg(F.sum("PERWT").alias("PERWT"))
    clusters = state_clusters(spark, folder).select(pad_code("STATEFIP", 2).alias("STATEFIP"), "Cluster")
    return join_nullsafe(
        join_nullsafe(states, clusters, ["STATEFIP"], "left"), role_lookup(clusters, "1"), ["STATEFIP1"], "left")


MOVES_SQL = """
cw AS (
  SELECT printf('%02d', c_nationkey) AS state, printf('%05d', c_custkey) AS puma, unnest(
    CASE WHEN c_acctbal < 0 THEN [a, '00060'] ELSE [a] END) AS migpuma
  FROM (SELECT *, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '00010' WHEN 'BUILDING' THEN '00020'
      WHEN 'FURNITURE' THEN '00030' WHEN 'HOUSEHOLD' THEN '00040' WHEN 'MACHINERY' THEN '00050' END AS a FROM customer)),
clusters AS (
  SELECT printf('%02d', n_nationkey) AS state, CASE WHEN r_name <> 'MIDDLE EAST' THEN r_name END AS cluster
  FROM nation JOIN region ON n_regionkey = r_regionkey),
moves AS (
  SELECT e.YEAR AS year, e.origin_c AS origin, e.MIGRATE1D >= 24 AS moved, e.PERWT, cw.state || cw.migpuma AS migpuma,
    e.prior AS migpuma1, c.cluster AS cluster, c1.cluster AS cluster1,
    CASE WHEN e.MIGRATE1D >= 24 THEN e.MIGPLAC1 = 99 END AS mex1
  FROM (SELECT *, printf('%02d', MIGPLAC1) || CASE WHEN MIGPUMA1 <> 0 THEN printf('%05d', MIGPUMA1) END AS prior,
          printf('%02d', STATEFIP) AS state FROM eligible
        WHERE origin_c IN ('Native Hispanic', 'Native White', 'Mexico', 'Other Migrant')) e
  LEFT JOIN cw ON e.state = cw.state AND printf('%05d', e.PUMA) = cw.puma
  LEFT JOIN (SELECT DISTINCT state, state || migpuma AS migpuma FROM cw) b ON e.prior = b.migpuma
  LEFT JOIN clusters c ON e.state = c.state
  LEFT JOIN clusters c1 ON b.state = c1.state)
"""


@query("q10_region_flow", with_person("""
SELECT cluster, cluster1, sum(PERWT) AS value FROM moves
WHERE cluster IS NOT NULL AND cluster1 IS NOT NULL GROUP BY ALL
""", ELIGIBLE_SQL, MOVES_SQL))
def region_flow(spark, folder):
    return flow_matrix(moves(spark, folder), "Cluster", "Cluster1").withColumnsRenamed(
        {"Cluster": "cluster", "Cluster1": "cluster1"})


@query("q10b_region_flow_by_group", with_person("""
SELECT origin, cluster, cluster1, CASE WHEN cluster = cluster1 THEN 0 ELSE with_stayers END AS value, with_stayers
FROM (SELECT origin, cluster, cluster1, sum(PERWT) AS with_stayers FROM moves
      WHERE cluster IS NOT NULL AND cluster1 IS NOT NULL GROUP BY ALL)
""", ELIGIBLE_SQL, MOVES_SQL))
def region_flow_by_group(spark, folder):
    flows = flow_matrix(moves(spark, folder), "Cluster", "Cluster1", ["BPLCR"], name="with_stayers")
    same = F.col("Cluster") == F.col("Cluster1")
    return flows.select(
        F.col("BPLCR").alias("origin"), F.col("Cluster").alias("cluster"), F.col("Cluster1").alias("cluster1"),
        F.when(same, 0.0).otherwise(F.col("with_stayers")).alias("value"), "with_stayers")


@query("q11_arrival_ratio", with_person("""
SELECT year, round(sum(PERWT) FILTER (NOT mex1) / sum(PERWT) FILTER (mex1), 6) AS ratio
FROM moves WHERE moved AND origin = 'Mexico' GROUP BY ALL
""", ELIGIBLE_SQL, MOVES_SQL))
def arrivals(spark, folder):
    movers = moves(spark, folder).filter(F.col("hasMigrated") & (F.col("BPLCR") == "Mexico"))
    return arrival_ratio(movers.withColumnRenamed("YEAR", "year"), F.col("MEX1"), ["year"]).withColumn("ratio", r6("ratio"))


@query("q11a_arrival_ratio_by_region", with_person("""
SELECT year, cluster, round(sum(PERWT) FILTER (NOT mex1) / sum(PERWT) FILTER (mex1), 6) AS ratio
FROM moves WHERE moved AND origin = 'Mexico' GROUP BY ALL
""", ELIGIBLE_SQL, MOVES_SQL))
def arrivals_by_region(spark, folder):
    movers = moves(spark, folder).filter(F.col("hasMigrated") & (F.col("BPLCR") == "Mexico"))
    named = movers.withColumnsRenamed({"YEAR": "year", "Cluster": "cluster"})
    return arrival_ratio(named, F.col("MEX1"), ["year", "cluster"]).withColumn("ratio", r6("ratio"))


@query("q11b_top_area_flows", with_person("""
SELECT migpuma, migpuma1, origin, sum(PERWT) AS n FROM moves
WHERE migpuma IS NOT NULL AND migpuma1 IS NOT NULL AND migpuma <> migpuma1 AND year = 2000
GROUP BY ALL ORDER BY n DESC, migpuma, migpuma1, origin LIMIT 30
""", ELIGIBLE_SQL, MOVES_SQL))
def top_area_flows(spark, folder):
    """The 30 largest flows between different areas in one year."""
    named = area_moves(spark, folder, [2000]).withColumnsRenamed({"MIGPUMA": "migpuma", "MIGPUMA1": "migpuma1", "BPLCR": "origin"})
    moved = named.filter(F.col("migpuma") != F.col("migpuma1"))
    flows = flow_matrix(moved, "migpuma", "migpuma1", ["origin"], name="n")
    return flows.select("migpuma", "migpuma1", "origin", "n").orderBy(
        F.desc_nulls_last("n"), "migpuma", "migpuma1", "origin").limit(30)


@query("q11c_area_flows", with_person("""
SELECT year, migpuma, migpuma1, sum(PERWT) AS n FROM moves
WHERE migpuma IS NOT NULL AND migpuma1 IS NOT NULL GROUP BY ALL
""", ELIGIBLE_SQL, MOVES_SQL))
def area_flows(spark, folder):
    named = area_moves(spark, folder).withColumnsRenamed({"MIGPUMA": "migpuma", "MIGPUMA1": "migpuma1", "YEAR": "year"})
    return flow_matrix(named, "migpuma", "migpuma1", ["year"], name="n").select("year", "migpuma", "migpuma1", "n")


@query("q12b_net_migration", with_person("""
SELECT cluster, year, origin, sum(w) AS net
FROM (SELECT cluster, year, origin, PERWT AS w FROM moves WHERE cluster <> cluster1
      UNION ALL SELECT cluster1, year, origin, -PERWT FROM moves WHERE cluster <> cluster1)
GROUP BY ALL
""", ELIGIBLE_SQL, MOVES_SQL))
def net_migration_by_region(spark, folder):
    named = moves(spark, folder).withColumnsRenamed({"YEAR": "year", "BPLCR": "origin"})
    return net_migration(named, "Cluster", "Cluster1", ["year", "origin"], place="cluster")
