"""The person view: survey columns played by columns of the stored tables.

A person row is an order line with its order, buyer, seller and article. Only the tables
that the asked-for columns need are joined, so a query on origin and weight never reads
the article table. Spark broadcasts a stored table only if its size allows it; only the
literal codebooks are hinted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demoflux.session import split_hot_keys
from demoflux.sources.store import materialize
from demoflux.sources.tables import load

# Which survey codes the categories of the stored tables stand for.
NATIVE_BIRTHPLACE = 6
BIRTHPLACES = """
    SELECT * FROM VALUES ('A', 'F', 200), ('N', 'F', 210), ('R', 'F', 300), ('R', 'O', 500), ('A', 'O', 6), ('N', 'O', 6)
    AS birthplaces(flag, status, birthplace)"""
ETHNICITIES = """
    SELECT * FROM VALUES ('1-URGENT', 1, 1), ('2-HIGH', 0, 1), ('3-MEDIUM', 0, 2), ('4-NOT SPECIFIED', 0, 4), ('5-LOW', 0, 7)
    AS ethnicities(priority, hispanic, race)"""
CITIZEN_OF_STATUS = {"F": 0, "O": 2, "P": 3}
REGION_WITHOUT_CLUSTER = "MIDDLE EAST"
PRIOR_NATION_MEXICO = 24
PRIOR_NATION_ABROAD = 23


def _lookup(column: str, table: dict) -> Column:
    chain = None
    for key, value in table.items():
        hit = F.col(column) == key
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return chain


def _birthplace_code() -> Column:
    return F.coalesce("birthplace", F.lit(NATIVE_BIRTHPLACE))


def _cluster(region: str) -> Column:
    return F.when(F.col(region) != REGION_WITHOUT_CLUSTER, F.col(region))


def _move_code() -> Column:
    before = F.col("s_nationkey")
    return (
        F.when(before.isin(PRIOR_NATION_ABROAD, PRIOR_NATION_MEXICO), 40)
        .when(F.col("c_nationkey") == before, 10)
        .when(F.col("now_regionkey") == F.col("before_regionkey"), 23)
        .otherwise(31)
    )


def _prior_place() -> Column:
    before = F.col("s_nationkey")
    return F.when(before == PRIOR_NATION_MEXICO, 200).when(before == PRIOR_NATION_ABROAD, 110).otherwise(before)


def _prior_area() -> Column:
    balance = F.col("s_acctbal")
    return (
        F.when(balance < 0, 0).when(balance < 2500, 10).when(balance < 5000, 20).when(balance < 7500, 30).otherwise(40)
    )


# Survey column -> (tables it needs besides lineitem, expression).
ROLES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "PERWT": ((), lambda: F.col("l_quantity")),
    "CPUMA0010": ((), lambda: F.col("l_partkey")),
    "SERIAL": ((), lambda: F.col("l_orderkey")),
    "LINE": ((), lambda: F.col("l_linenumber")),
    "BPL": (("birthplaces",), _birthplace_code),
    "YRIMMIG": (("birthplaces",), lambda: F.when(_birthplace_code() < 100, 0).otherwise(1980 + 3 * F.col("l_linenumber"))),
    "SEX": ((), lambda: F.when(F.col("l_linenumber") <= 3, 1).otherwise(2)),
    "FERTYR": ((), lambda: F.when(F.col("l_discount") < 0.015, 0).when(F.col("l_discount") < 0.075, 1).otherwise(2)),
    "EDUC": ((), lambda: F.round(F.col("l_tax") * 100).cast("int") + 3),
    "SCHOOL": ((), lambda: F.when(F.col("l_linenumber") == 1, 2).otherwise(1)),
    "CLASSWKRD": ((), lambda: 20 + F.col("l_linenumber")),
    "MARST": ((), lambda: F.col("l_linenumber")),
    "YEAR": (("orders",), lambda: F.year("o_orderdate")),
    "PRIORITY": (("orders",), lambda: F.col("o_orderpriority")),
    "HISPAN": (("orders", "ethnicities"), lambda: F.col("hispanic")),
    "RACE": (("orders", "ethnicities"), lambda: F.col("race")),
    "NCHILD": (("orders",), lambda: F.when(F.col("o_totalprice") < 150000, 0).when(
        F.col("o_totalprice") < 300000, 1).otherwise(2)),
    "CITIZEN": (("orders",), lambda: _lookup("o_orderstatus", CITIZEN_OF_STATUS)),
    "STATEFIP": (("orders", "customer"), lambda: F.col("c_nationkey")),
    "PUMA": (("orders", "customer"), lambda: F.col("c_custkey")),
    "STRATA": (("orders", "customer"), lambda: F.col("c_mktsegment")),
    "REGION": (("orders", "customer", "now"), lambda: F.col("now_region")),
    "Cluster": (("orders", "customer", "now"), lambda: _cluster("now_region")),
    "MIGPLAC1": (("supplier",), _prior_place),
    "MIGPUMA1": (("supplier",), _prior_area),
    "MIGRATE1D": (("orders", "customer", "supplier", "now", "before"), _move_code),
    "MIGCOUNTY1": (("orders", "customer", "supplier", "now", "before"), lambda: F.when(
        F.col("now_regionkey") == F.col("before_regionkey"), 0).otherwise(1 + F.col("s_nationkey"))),
    "AGE": (("part",), lambda: F.col("p_size")),
    "AREASTATE": (("part",), lambda: F.substring(F.col("p_brand"), 7, 3).cast("int")),
}


def _in_years(years: Sequence[int] | slice) -> Column:
    """Date ranges of whole years, in a form that reaches the parquet scan."""
    start = lambda year: F.lit(f"{year}-01-01").cast("timestamp_ntz")
    if isinstance(years, slice):
        return F.col("o_orderdate") >= start(years.start)
    inside = None
    for year in years:
        within = (F.col("o_orderdate") >= start(year)) & (F.col("o_orderdate") < start(year + 1))
        inside = within if inside is None else inside | within
    return inside


# Session setting that names a stored person view.
STORED_VIEW = "spark.demoflux.personView"
STORED_FOLDER = "spark.demoflux.personViewFolder"


def store_person(spark: SparkSession, folder: str, path: str, refresh: bool = False) -> DataFrame:
    """Write the whole person view once, partitioned by year, and use it for later queries of the session.

    The joins are then paid once, and a query on two years reads two partitions.
    """
    spark.conf.unset(STORED_VIEW)
    spark.conf.set(STORED_FOLDER, folder.rstrip("/"))
    stored_view = materialize(spark, path, lambda: person(spark, folder, *ROLES), refresh, ("YEAR",))
    spark.conf.set(STORED_VIEW, path)
    return stored_view


def person(spark: SparkSession, folder: str, *columns: str, years: Sequence[int] | slice | None = None) -> DataFrame:
    """The asked-for survey columns of every person row, or of the rows of some years; slice(1996, None) is all years from 1996 on."""
    stored_view = spark.conf.get(STORED_VIEW, None)
    if stored_view and spark.conf.get(STORED_FOLDER, None) == folder.rstrip("/"):
        rows = spark.read.parquet(stored_view)
        if years is not None:
            rows = rows.filter(F.col("YEAR") >= years.start if isinstance(years, slice) else F.col("YEAR").isin(list(years)))
        return rows.select(*columns)
    split_hot_keys(spark)
    needs = {table for c in columns for table in ROLES[c][0]}

    def placed(side: DataFrame, role: str, key: str) -> DataFrame:
        if role not in needs:
            return side
        place = nation_region(spark, folder).withColumnsRenamed(
            {"nation": f"{role}_nation", "regionkey": f"{role}_regionkey", "region": f"{role}_region"})
        return side.join(place, F.col(key) == F.col(f"{role}_nation"))

    rows = load(spark, folder, "lineitem")
    # buyers are joined to orders and sellers to their places first, so the order lines are moved once for each side
    if needs & {"orders", "customer", "now"} or years is not None:
        orders = load(spark, folder, "orders")
        if years is not None:
            orders = orders.filter(_in_years(years))
        if needs & {"customer", "now"}:
            buyers = placed(load(spark, folder, "customer"), "now", "c_nationkey")
            orders = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # Codebooks are literal tables of a few rows, so they may be broadcast. Joining them keeps the codes
    # as plain columns: recodes and pushed-down filters do not repeat a chain of comparisons for every use.
    if "birthplaces" in needs:
        rows = rows.join(F.broadcast(spark.sql(BIRTHPLACES)), (F.col("l_returnflag") == F.col("flag")) & (
            F.col("l_linestatus") == F.col("status")), "left")
    if "ethnicities" in needs:
        rows = rows.join(F.broadcast(spark.sql(ETHNICITIES)), F.col("o_orderpriority") == F.col("priority"), "left")
    if "part" in needs:
        rows = rows.join(load(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if needs & {"supplier", "before"}:
        sellers = placed(load(spark, folder, "supplier"), "before", "s_nationkey")
        rows = rows.join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(*[ROLES[c][1]().alias(c) for c in columns])


def nation_region(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = load(spark, folder, "nation"), load(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nation"), F.col("r_regionkey").alias("regionkey"), F.col("r_name").alias("region"))


def state_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters attached to all states, keeping the states that belong to none."""
    nation, region = load(spark, folder, "nation"), load(spark, folder, "region")
    members = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).filter(
        F.col("r_name") != REGION_WITHOUT_CLUSTER).select(F.col("n_name").alias("Name"), F.col("r_name").alias("Cluster"))
    states = nation.select(F.col("n_name").alias("Name"), F.col("n_nationkey").alias("STATEFIP"))
    return members.join(states, "Name", "right").select("STATEFIP", "Name", "Cluster")


# The same view for the SQL checks, written out by hand.
PERSON_SQL = """
person AS (
  SELECT p0.*,
    CASE WHEN HISPAN = 1 THEN 'Hispanic' WHEN RACE = 1 THEN 'White' WHEN RACE = 2 THEN 'Black' END AS race3,
    CASE WHEN HISPAN = 1 THEN 'Hispanic' WHEN RACE = 1 THEN 'White' WHEN RACE = 2 THEN 'Black'
         WHEN RACE BETWEEN 4 AND 6 THEN 'Asian' END AS race4,
    CASE WHEN BPL < 100 THEN 'Native' WHEN BPL IN (210, 250, 260) THEN 'CentralAmerica/Caribbean'
         WHEN BPL = 300 THEN 'SouthAmerica' WHEN BPL = 200 THEN 'Mexico' ELSE 'Other' END AS bplc,
    CASE WHEN BPL < 100 AND HISPAN = 1 THEN 'Native Hispanic' WHEN BPL < 100 THEN 'Native Non-Hispanic'
         WHEN BPL IN (210, 250, 260) THEN 'Central America/Caribbean' WHEN BPL = 300 THEN 'South America'
         WHEN BPL = 200 THEN 'Mexico' ELSE 'Other' END AS origin6,
    CASE WHEN BPL < 100 AND HISPAN = 1 THEN 'Native Hispanic' WHEN BPL < 100 AND RACE = 1 THEN 'Native White'
         WHEN BPL < 100 AND RACE = 2 THEN 'Native Black' WHEN BPL < 100 AND RACE = 4 THEN 'Native Asian'
         WHEN BPL < 100 THEN 'Native Other'
         WHEN BPL IN (210, 250, 260) THEN 'Central America/Caribbean' WHEN BPL = 300 THEN 'South America'
         WHEN BPL = 200 THEN 'Mexico' ELSE 'Other Migrant' END AS origin9,
    CASE WHEN BPL < 100 AND HISPAN = 1 THEN 'Native Hispanic' WHEN BPL < 100 AND RACE = 1 THEN 'Native White'
         WHEN BPL < 100 AND RACE = 2 THEN 'Native Black' WHEN BPL < 100 AND RACE = 4 THEN 'Native Asian'
         WHEN BPL < 100 THEN 'Native Other'
         WHEN BPL = 200 THEN 'Mexico' ELSE 'Other Migrant' END AS origin_c,
    YRIMMIG <> 0 AS fb,
    CAST(CASE WHEN AGE <= 5 THEN 0 ELSE ((AGE - 1) // 5) * 5 END AS INTEGER) AS band
  FROM (
    SELECT l_quantity AS PERWT, l_partkey AS CPUMA0010, l_orderkey AS SERIAL, l_linenumber AS LINE,
      l_discount, l_tax,
      CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END AS SEX,
      CASE WHEN l_discount < 0.015 THEN 0 WHEN l_discount < 0.075 THEN 1 ELSE 2 END AS FERTYR,
      CAST(round(l_tax * 100) AS INTEGER) + 3 AS EDUC,
      CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END AS SCHOOL,
      20 + l_linenumber AS CLASSWKRD, l_linenumber AS MARST,
      CASE WHEN o_totalprice < 150000 THEN 0 WHEN o_totalprice < 300000 THEN 1 ELSE 2 END AS NCHILD,
      b.BPL,
      CASE WHEN b.BPL < 100 THEN 0 ELSE 1980 + 3 * l_linenumber END AS YRIMMIG,
      CAST(year(o_orderdate) AS INTEGER) AS YEAR, o_orderpriority AS PRIORITY,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS HISPAN,
      CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
        WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 7 END AS RACE,
      CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS CITIZEN,
      c_nationkey AS STATEFIP, c_custkey AS PUMA, c_mktsegment AS STRATA, c_acctbal,
      nr.r_name AS REGION, CASE WHEN nr.r_name <> 'MIDDLE EAST' THEN nr.r_name END AS cluster_now,
      CASE s_nationkey WHEN 24 THEN 200 WHEN 23 THEN 110 ELSE s_nationkey END AS MIGPLAC1,
      CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal < 2500 THEN 10 WHEN s_acctbal < 5000 THEN 20
        WHEN s_acctbal < 7500 THEN 30 ELSE 40 END AS MIGPUMA1,
      CASE WHEN s_nationkey IN (23, 24) THEN 40 WHEN c_nationkey = s_nationkey THEN 10
        WHEN cn.n_regionkey = sn.n_regionkey THEN 23 ELSE 31 END AS MIGRATE1D,
      CASE WHEN cn.n_regionkey = sn.n_regionkey THEN 0 ELSE 1 + s_nationkey END AS MIGCOUNTY1,
      p_size AS AGE, CAST(substr(p_brand, 7) AS INTEGER) AS AREASTATE
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey
    JOIN part ON l_partkey = p_partkey
    JOIN nation cn ON c_nationkey = cn.n_nationkey
    JOIN region nr ON cn.n_regionkey = nr.r_regionkey
    JOIN nation sn ON s_nationkey = sn.n_nationkey
    JOIN (VALUES ('A','F',200), ('N','F',210), ('R','F',300), ('R','O',500), ('A','O',6), ('N','O',6))
      b(flag, status, BPL) ON l_returnflag = b.flag AND l_linestatus = b.status
  ) p0
)
"""


def with_person(sql: str, *more: str) -> str:
    """A check query that starts from the person view, with further named parts."""
    return "WITH " + ", ".join([PERSON_SQL.strip(), *[m.strip() for m in more]]) + "\n" + sql.strip()
