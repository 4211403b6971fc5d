"""Joins, grids, change, flows, reshaping and bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from demoflux.operators import aggregate as a
from demoflux.operators import binning
from demoflux.operators import change as c
from demoflux.operators import flows, joins, reshape
from demoflux.operators.binning import dense_code
from demoflux.operators.numbering import numbered
from demoflux.operators.reshape import keep_positions


def test_missing_keys_match(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (4, "z")], "k int, r string")
    assert rows_of(joins.join_nullsafe(left, right, ["k"])) == sorted([(1, "a", "x"), (None, "b", "y"), (3, "c", None)], key=repr)
    kept = joins.join_nullsafe(left, right, ["k"], "right")
    assert rows_of(kept.select("k", "l", "r")) == sorted([(1, "a", "x"), (None, "b", "y"), (4, None, "z")], key=repr)
    assert joins.natural_keys(left, right) == ["k"]
    with pytest.raises(ValueError):
        joins.natural_keys(left, right.withColumnRenamed("k", "q"))


def test_membership_and_fan_out(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    members = spark.createDataFrame([(1,), (1,)], "k int")
    assert rows_of(joins.membership_flag(left, members, ["k"], "f")) == sorted([(1, True), (2, False), (None, False)], key=repr)
    lookup = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9, "d"), (9, "e")], "k int, v string")
    assert rows_of(joins.fan_out(left, lookup, ["k"])) == [(1, 2)]


def test_bands_contain_all_ages(spark):
    bands = spark.createDataFrame([(1, [0, 1, 2, 3, 4]), (2, [5, 6, 7])], "band int, band_ages array<int>")
    labels = spark.createDataFrame([("a", [1, 2]), ("b", [4, 5]), ("c", [7])], "label string, ages array<int>")
    got = joins.band_of_ages(labels, "ages", bands, "band_ages").select("label", "band")
    assert rows_of(got) == [("a", 1), ("b", None), ("c", 2)]


def test_strict_and_conditional_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 3.0), ("b", 4.0, 0.0)], "g string, x double, w double")
    got = df.groupBy("g").agg(
        a.strict_sum("x"), a.strict_mean("x"), a.weighted_mean("x", "w"), a.conditional_sum("w", F.col("x") > 1))
    assert rows_of(got) == [("a", None, None, 1.0, 0.0), ("b", 4.0, 4.0, None, 4.0 * 0)]


def test_shares_agree(spark):
    cells = spark.createDataFrame(
        [(y, k, float(v)) for y in (1, 2, None) for k, v in enumerate([1, 2, 5])], "y int, k int, n double")
    window = a.share_in_group(cells, "n", ["y"])
    looked_up = a.share_of_total(cells, cells, "n", ["y"])
    assert rows_of(window) == rows_of(looked_up)
    assert a.share_of_total(cells, cells, "n").agg(F.sum("share")).first()[0] == pytest.approx(1.0)


def test_share_of_total_of_many_groups(spark):
    cells = spark.range(10_500).select(F.col("id").alias("y"), F.lit(2.0).alias("n"))
    got = a.share_of_total(cells, cells, "n", ["y"]).agg(F.count("share"), F.min("share"), F.max("share")).first()
    assert tuple(got) == (10_500, 1.0, 1.0)


def test_type_driven_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 4.0)], "s string, i int, x double, y double")
    assert a.numeric_columns(df) == ["i", "x", "y"]
    assert a.column_range(df, "i", "x") == ["i", "x"]
    assert a.map_columns(df, ["x", "y"], lambda v: v * 10).first()[2:] == (20.0, 40.0)
    assert a.rename_each(df, ["x"], str.upper).columns == ["s", "i", "X", "y"]


GRID = [("p", "m", 1, 5.0), ("p", "m", 2, 7.0), ("p", "n", 1, 3.0), ("q", "n", 2, 4.0), (None, "m", 2, 1.0)]


def test_grid_is_complete(spark):
    cells = spark.createDataFrame(GRID, "area string, g string, t int, est double")
    grid = c.complete_grid(cells, ["area"], {"g": ["m", "n"], "t": [1, 2]}, {"est": 0.0})
    assert grid.count() == 3 * 2 * 2
    assert grid.agg(F.sum("est")).first()[0] == 20.0
    observed = c.complete_grid(cells, ["area"], {"g": c.observed_levels(cells, "g"), "t": [1, 2]}, {"est": None})
    assert observed.filter("est is null").count() == 7
    change = c.two_point(grid, ["area", "g"], "t", 1, 2, ["est"])
    got = change.select("area", "g", c.difference("est"), c.growth_rate("est"), c.end_ratio("est"))
    assert ("p", "m", 2.0, 0.4, 1.4) in rows_of(got)
    assert ("q", "n", 4.0, None, None) in rows_of(got)


def test_many_levels_are_observed(spark):
    levels = spark.range(1).select(c.observed_levels(spark.range(1200), "id").alias("l")).first()["l"]
    assert levels == list(range(1200))


def test_one_year_areas(spark):
    cells = spark.createDataFrame(GRID, "area string, g string, t int, est double")
    dropped = c.two_point(cells, ["area", "g"], "t", 1, 2, ["est"]).select("area", "g", c.difference("est"))
    assert rows_of(dropped) == [("p", "m", 2.0)]
    kept = c.two_point(cells, ["area", "g"], "t", 1, 2, ["est"], missing="null").select("area", "g", c.difference("est"))
    assert kept.count() == 4 and kept.filter("`(est_last - est_first)` is null").count() == 3


MOVES = [("A", "A", 9.0), ("A", "B", 2.0), ("B", "A", 5.0), ("C", "A", 1.0), (None, "A", 7.0), ("B", None, 7.0)]


def test_flows_and_net_migration(spark):
    df = spark.createDataFrame(MOVES, "dst string, src string, PERWT double")
    assert rows_of(flows.flow_matrix(df, "dst", "src", zero_diagonal=True)) == [
        ("A", "A", 0.0), ("A", "B", 2.0), ("B", "A", 5.0), ("C", "A", 1.0)]
    net = flows.net_migration(df, "dst", "src", [])
    assert rows_of(net) == [("A", -4.0), ("B", 3.0), ("C", 1.0)]
    assert net.agg(F.sum("net")).first()[0] == 0.0


def test_arrival_ratio_without_one_side(spark):
    df = spark.createDataFrame([(1, True, 2.0), (1, False, 6.0), (2, False, 1.0)], "y int, ext boolean, PERWT double")
    assert rows_of(flows.arrival_ratio(df, F.col("ext"), ["y"])) == [(1, 3.0), (2, None)]


def test_spread_and_gather(spark):
    series = spark.createDataFrame(
        [(2000, 8664000, 12204000), (2010, 11708000, 21208000), (2015, 11508000, 24250000), (2017, 11190000, 25444000)],
        "Year int, `Mexican Born` int, `US Born` int")
    long = reshape.gather(series, ["Year"], ["Mexican Born", "US Born"], "Heritage", "Population")
    assert long.count() == 8
    back = reshape.spread(long, ["Year"], "Heritage", "Population", ["Mexican Born", "US Born"])
    assert rows_of(back) == rows_of(series)


def test_positions(spark):
    df = spark.createDataFrame([(x,) for x in "cabd"], "v string")
    assert rows_of(reshape.keep_positions(df, ["v"], [1, 3])) == [("a",), ("c",)]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_uncount_keeps_every_row(spark, monkeypatch, chunk):
    monkeypatch.setattr(reshape, "UNCOUNT_CHUNK", chunk)
    df = spark.createDataFrame([("a", 1.0), ("b", 10.0), ("c", 0.0), ("d", 9.0)], "k string, n double")
    got = reshape.uncount(df, ["k"], "n").groupBy("k").agg(
        F.count(F.lit(1)), F.min("i"), F.max("i"), F.count_distinct("i"))
    assert rows_of(got) == [("a", 1, 1, 1, 1), ("b", 10, 1, 10, 10), ("d", 9, 1, 9, 9)]


@pytest.mark.parametrize("splitters,accuracy", [(256, 10_000), (5, 10_000), (3, 2)])
def test_quantiles_are_exact(spark, monkeypatch, splitters, accuracy):
    monkeypatch.setattr(binning, "SPLITTERS", splitters)
    monkeypatch.setattr(binning, "SKETCH", accuracy)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=200), np.full(150, 0.25), rng.normal(size=50) * 1e6, [1e300, -1e300, -0.0, 0.0]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    probabilities = [0.0, 1 / 6, 0.5, 0.9, 1.0]
    assert binning.exact_quantiles(df, "x", probabilities) == pytest.approx(list(np.quantile(values, probabilities)), rel=1e-12)


def test_quantiles_of_ties_and_many_values(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 1.0).alias("x"))
    values = np.array([7.0 if i % 3 == 0 else i for i in range(200_000)])
    assert binning.exact_quantiles(df, "x", [0.0, 0.1, 0.34, 0.8, 1.0]) == pytest.approx(list(np.quantile(values, [0.0, 0.1, 0.34, 0.8, 1.0])))
    assert binning.exact_quantiles(df.filter("x = 7"), "x", [0.0, 0.5, 1.0]) == [7.0] * 3


def test_cut_number(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 13)] + [(None,)], "x double")
    got = binning.cut_number(df, "x", 6, "q").groupBy("q").count()
    assert rows_of(got) == sorted([(i, 2) for i in range(1, 7)] + [(None, 1)], key=repr)


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 2, 9, 10]], "x double")
    assert rows_of(binning.histogram(df, "x", 5)) == [(0, 0.0, 3), (1, 2.0, 1), (4, 8.0, 2)]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert rows_of(binning.histogram(flat, "x", 5).select("bin", "n")) == [(0, 2)]


def test_dense_code(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "f string")
    assert rows_of(binning.dense_code(df, "f", "code")) == sorted([("a", 1), ("b", 2), ("b", 2), (None, None)], key=repr)


def test_one_hot_area_is_whole(spark):
    """One area holds a third of all rows; nothing is lost and no weight changes."""
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("area"), (F.col("id") % 2).cast("int").alias("t"),
        F.lit("m").alias("g"), F.lit(1.0).alias("PERWT"))
    cells = rows.groupBy("area", "g", "t").agg(F.sum("PERWT").alias("est"))
    grid = c.complete_grid(cells, ["area"], {"g": ["m"], "t": [0, 1]}, {"est": 0.0})
    assert grid.agg(F.sum("est")).first()[0] == 30000.0
    assert rows_of(grid.filter("area = 0").select("t", "est")) == [(0, 5000.0), (1, 5000.0)]


def test_numbers_over_a_whole_table(spark):
    values = [(i * 7919 % 1000, i % 3, f"r{i}") for i in range(5000)] + [(5, 0, "same")] * 700 + [(None, 1, None)] * 3
    df = spark.createDataFrame(values, "v int, k int, s string").repartition(7)
    got = [tuple(r) for r in numbered(df, [F.col("v").desc_nulls_last(), "k"], "n").orderBy("n").collect()]
    assert [r[3] for r in got] == list(range(1, len(values) + 1))
    assert sorted(map(repr, (r[:3] for r in got))) == sorted(map(repr, values))
    keys = [(r[0] is None, -(r[0] or 0), r[1]) for r in got]
    assert keys == sorted(keys)
    assert numbered(df.filter("v = -1"), ["v"], "n").count() == 0
    # a single row per range
    assert sorted(tuple(r) for r in numbered(df.limit(1), ["v"], "n").select("n").collect()) == [(1,)]


def test_dense_codes_and_positions_without_a_whole_window(spark):
    df = spark.createDataFrame([(f"l{i * 37 % 501:03}",) for i in range(2004)] + [(None,)], "level string")
    coded = dense_code(df, "level", "code")
    assert {(r["level"], r["code"]) for r in coded.collect()} == {(f"l{i:03}", i + 1) for i in range(501)} | {(None, None)}
    kept = keep_positions(df.distinct().filter("level is not null"), ["level"], [1, 501, 777])
    assert sorted(r["level"] for r in kept.collect()) == ["l000", "l500"]
    for plan in (coded, kept):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in text and "SinglePartition" not in text
