"""Group recodes on every combination of codes that matters."""

from pyspark.sql import functions as F

from demoflux.functions import recode as r
from demoflux.functions import text as t


def test_origin_and_race(spark):
    rows = [(1, 1, 10), (0, 1, 10), (0, 2, 10), (0, 4, 10), (0, 5, 10), (0, 9, 10), (3, 9, 200), (0, 1, 250), (0, 1, 300),
            (0, 1, 410), (None, 1, 10)]
    df = spark.createDataFrame(rows, "HISPAN int, RACE int, BPL int")
    got = df.select(r.race().alias("a"), r.race([4, 5, 6]).alias("b"), r.birthplace().alias("c"), r.origin_six().alias("d"),
                    r.origin_nine().alias("e"), r.origin_collapsed().alias("f"), r.origin_latino_study().alias("g")).collect()
    assert [x.a for x in got] == ["Hispanic", "White", "Black", None, None, None, "Hispanic", "White", "White", "White", "White"]
    assert [x.b for x in got][3:6] == ["Asian", "Asian", None]
    assert [x.c for x in got][5:] == ["Native", "Mexico", "CentralAmerica/Caribbean", "SouthAmerica", "Other", "Native"]
    assert [x.d for x in got][:2] == ["Native Hispanic", "Native Non-Hispanic"]
    assert [x.e for x in got][1:6] == ["Native White", "Native Black", "Native Asian", "Native Other", "Native Other"]
    assert [x.e for x in got][7:10] == ["Central America/Caribbean", "South America", "Other Migrant"]
    assert [x.f for x in got][6:10] == ["Mexico", "Other Migrant", "Other Migrant", "Other Migrant"]
    assert [x.g for x in got][:2] == ["Native Hispanic", "Native Other"]


def test_moves_and_status(spark):
    df = spark.createDataFrame(
        [(24, "99", 4, 3), (24, "06", 4, 4), (10, "99", 0, 4), (None, "99", 6, 4)],
        "MIGRATE1D int, MIGPLAC1 string, place int, STATEFIP int")
    flagged = df.withColumn("hasMigrated", r.moved_area())
    assert [x[0] for x in flagged.select(r.arrived_from_mexico()).collect()] == [True, False, None, None]
    codes = df.select(F.col("place").alias("MIGPLAC1"), "STATEFIP")
    assert [tuple(x) for x in codes.select(r.left_state(4), r.at_risk_of_leaving(4)).collect()] == [
        (True, True), (False, True), (False, True), (False, False)]


def test_education_order(spark):
    df = spark.createDataFrame([(3,), (6,), (8,), (11,), (None,)], "EDUC int").withColumn("e", r.education())
    got = df.select("e", r.level_order("e", r.EDUCATION_LEVELS)).collect()
    assert [tuple(x) for x in got] == [
        ("Below High School", 1), ("High School", 2), ("Some College", 3), ("College", 4), (None, None)]


def test_undocumented_needs_every_condition(spark):
    rows = [(3, 1995, 5, 1, 10), (2, 1995, 5, 1, 10), (3, 1985, 5, 1, 10), (3, 1995, 9, 1, 10), (3, 1995, 5, 2, 10),
            (3, 1995, 5, 1, 25)]
    df = spark.createDataFrame(rows, "CITIZEN int, YRIMMIG int, EDUC int, SCHOOL int, CLASSWKRD int")
    assert [x[0] for x in df.select(r.likely_undocumented()).collect()] == [True] + [False] * 5


def test_growth_quadrant_ties_are_missing(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (1, -2), (2, -1), (1, 1), (1, -1), (-1, 5)], "h int, w int")
    got = [x[0] for x in df.select(r.growth_quadrant("h", "w")).collect()]
    assert got[:4] == ["White Growth Outpaces Hispanic Growth", "Hispanic Growth Outpaces White Growth",
                       "White Decline Outpaces Hispanic Growth", "Hispanic Growth Outpaces White Decline"]
    assert got[4:] == [None, None, None]


def test_age_labels(spark):
    labels = ["Under 5 years", "5 to 9 years", "65 and 66 years", "67 to 69 years", "85 years and over", "20 years", "<1 year"]
    df = spark.createDataFrame([(x,) for x in labels], "label string").withColumn("ages", t.ages_of_label(F.col("label")))
    got = df.select("ages", t.band_midpoint(F.col("ages"))).collect()
    assert [x[0] for x in got] == [
        [0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [65, 66, 67, 68, 69], [65, 66, 67, 68, 69], [85], [20], [0, 1, 2, 3, 4]]
    assert [x[1] for x in got][:2] == [2.5, 7.5]
    assert got[4][1] == 85.5


def test_titles():
    assert t.title_from("fbHispanicPopulation", 10, "Change in ", " Population") == "Change in Fbhispanic Population"
