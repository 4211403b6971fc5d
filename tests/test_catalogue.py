"""Every registered query against its SQL on the smallest tables, and invariants of the results."""

import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from demoflux.operators import survey
from demoflux.plans.catalogue import CHECKS, QUERIES
from demoflux.session import cut_lineage

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck(folder):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return connection


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def order(row):
    return tuple((v is None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    answer = duck.execute(CHECKS[name])
    names = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order)
    wanted = sorted((tuple(r[names.index(c)] for c in columns) for r in answer.fetchall()), key=order)
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_queries_without_sql(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    assert rows
    if "lwr" in rows[0]:
        assert all(0 <= r.lwr <= r.fit <= r.upr <= 1 for r in rows)


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_invariants(spark, folder):
    shares = QUERIES["q2_age_distribution"](spark, folder).groupBy("year", "origin").agg(F.sum("proportion").alias("s"))
    assert all(abs(r.s - 1) < 1e-4 for r in shares.collect())
    net = QUERIES["q12b_net_migration"](spark, folder).groupBy("year", "origin").agg(F.sum("net").alias("s"))
    assert all(r.s == 0 for r in net.collect())
    limits = QUERIES["q8_fertility_rate"](spark, folder).filter("low is not null").collect()
    assert all(r.low <= r.est <= r.upp for r in limits)


def test_grid_has_the_origins_that_occur(spark, folder, tmp_path):
    from demoflux.plans.growth import area_growth

    for t in TABLES:
        if t != "lineitem" and os.path.exists(f"{folder}/{t}.parquet"):
            os.symlink(f"{folder}/{t}.parquet", tmp_path / f"{t}.parquet")
    # without one flag nobody is born in South America
    spark.read.parquet(f"{folder}/lineitem.parquet").filter(
        "not (l_returnflag = 'R' and l_linestatus = 'F')").write.parquet(str(tmp_path / "lineitem.parquet"))
    growth = area_growth(spark, str(tmp_path))
    origins = {r.origin for r in growth.select("origin").distinct().collect()}
    assert origins and "South America" not in origins
    assert growth.count() == growth.select("area").distinct().count() * len(origins)


@pytest.mark.parametrize("name", ["q8_fertility_rate", "q8a_migration_rate_with_limits", "q8d_migration_trend", "q8b_clustered_migration_rate"])
def test_survey_queries_read_the_lines_once(spark, folder, name, monkeypatch):
    written = []
    monkeypatch.setattr(survey, "cut_lineage", lambda df: written.append(df) or cut_lineage(df))
    df = QUERIES[name](spark, folder)
    df.collect()
    scans = lambda d: d._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).split("Initial Plan")[0].count("lineitem.parquet")
    # what is stored has the only scan of the lines; the rest of the query, subqueries included, has none
    assert [scans(d) for d in written] == [1] and scans(df) == 0


def test_later_years_reach_the_scan_of_orders(spark, folder):
    for name in ("q18_peak_year", "q41_age_gap_between_groups", "q11b_top_area_flows"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(o_orderdate," in plan, name


def test_scans_read_only_needed_columns(spark, folder):
    plan = QUERIES["q1_population_by_race_and_birthplace"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "supplier" not in plan and "BatchEvalPython" not in plan


def test_stored_view_gives_the_same_answers(spark, folder, tmp_path):
    from demoflux.plans import person as view

    names = ["q2_age_distribution", "q14_change_in_area_share", "q10_region_flow"]
    order_of = lambda df: sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=order)
    before = {n: order_of(QUERIES[n](spark, folder)) for n in names}
    try:
        view.store_person(spark, folder, str(tmp_path / "view"))
        after = {n: order_of(QUERIES[n](spark, folder)) for n in names}
        plan = QUERIES[names[1]](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(view.STORED_VIEW)
    assert before == after
    assert "PartitionFilters: [isnotnull(YEAR" in plan or "PartitionFilters: [YEAR" in plan


SMALL_PARTITIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4kb",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4kb",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_hot_join_key_is_split_and_whole(spark, folder, tmp_path):
    """A third of all rows belong to one article; its join is split and no row is lost."""
    for t in TABLES:
        if t != "lineitem" and os.path.exists(f"{folder}/{t}.parquet"):
            os.symlink(f"{folder}/{t}.parquet", tmp_path / f"{t}.parquet")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").withColumn(
        "l_partkey", F.when(F.col("l_linenumber") <= 2, 3).otherwise(F.col("l_partkey")))
    lines.repartition(8).write.parquet(str(tmp_path / "lineitem.parquet"))
    names = ["q7_standardised_mean_age", "q41_age_gap_between_groups", "q15_completed_grid_change"]
    rows_of = lambda df: sorted((tuple(r) for r in df.collect()), key=order)
    wanted = {n: rows_of(QUERIES[n](spark, str(tmp_path))) for n in names}
    before = {k: spark.conf.get(k, None) for k in SMALL_PARTITIONS}
    try:
        for k, v in SMALL_PARTITIONS.items():
            spark.conf.set(k, v)
        for n in names:
            df = QUERIES[n](spark, str(tmp_path))
            got = rows_of(df)
            assert len(got) == len(wanted[n])
            assert all(same(x, y) for a, b in zip(got, wanted[n]) for x, y in zip(a, b))
            if n == "q41_age_gap_between_groups":
                assert "SortMergeJoin(skew=true) [l_partkey" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_peak_rows_keep_ties(spark, folder):
    assert QUERIES["q18_peak_year"](spark, folder).filter("prop_peak > 1 or prop_peak < 0").count() == 0
