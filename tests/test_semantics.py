"""Missing values, binning, padding and rounding on small literal tables."""

import math

import pytest
from pyspark.sql import functions as F

from demoflux.functions import semantics as s
from demoflux.functions.student import t_975
from demoflux.plans import census


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expression.alias("y")).orderBy("i").select("y").collect()]


def test_age_band_is_closed_on_the_right(spark):
    ages = [0, 1, 5, 6, 10, 11, 15, 16, 50, None]
    assert column(spark, ages, "int", s.age_band("x")) == [0, 0, 0, 5, 5, 10, 10, 15, 45, None]


def test_age_band_counts_from_its_origin(spark):
    assert column(spark, [15, 20, 21], "int", s.age_band("x", origin=15)) == [0, 0, 5]


def test_interval_label(spark):
    labels = column(spark, [0.0, 0.2, 0.21, 0.6, 1.0, None], "double", s.interval_label("x", 0.2))
    assert labels == ["[0,0.2]", "[0,0.2]", "(0.2,0.4]", "(0.4,0.6]", "(0.8,1]", None]


def test_cut_right_edges(spark):
    labels = ["a", "b", "c", "d"]
    values = [-50000.0, -49999.0, 0.0, 1.0, 50000.0, 150000.0, 150001.0, None]
    got = column(spark, values, "double", s.cut_right("x", [-50000, 0, 50000, 100000, 150000], labels))
    assert got == [None, "a", "a", "b", "b", "d", None, None]
    ratios = column(spark, [0.5, 1.0, 10.0, 100.0], "double", s.cut_right("x", [float("-inf"), 1, 10, 100]))
    assert ratios == ["(-Inf,1]", "(-Inf,1]", "(1,10]", "(10,100]"]


def test_cut_right_needs_a_label_per_bin():
    with pytest.raises(ValueError):
        s.cut_right("x", [0, 1, 2], ["a"])


def test_missing_conditions(spark):
    chosen = column(spark, [1, 2, None], "int", s.if_else_na(F.col("x") == 1, F.lit("yes"), F.lit("no")))
    assert chosen == ["yes", "no", None]
    assert column(spark, [1, 2, None], "int", s.in_set("x", [1])) == [True, False, False]
    assert column(spark, [1, 2, None], "int", ~s.in_set("x", [1])) == [False, True, True]


def test_division_and_finiteness(spark):
    assert column(spark, [2.0, 0.0, None], "double", s.safe_div(F.lit(1.0), "x")) == [0.5, None, None]
    values = [1.0, float("nan"), float("inf"), float("-inf"), None]
    assert column(spark, values, "double", s.is_finite("x")) == [True, False, False, False, False]


def test_padding_never_truncates(spark):
    assert column(spark, [2, 15, 110, 0, -5, None], "int", s.pad_code("x", 2)) == ["02", "15", "110", "00", "-5", None]
    assert column(spark, [-5, 7], "int", s.pad_code("x", 5)) == ["-0005", "00007"]


def test_paste_writes_missing_parts(spark):
    assert column(spark, ["a", None], "string", s.paste("_", "x", F.lit(3))) == ["a_3", "NA_3"]


def test_years_from_text(spark):
    texts = ["1990", "2010", "2008-2012", "x", None]
    assert column(spark, texts, "string", s.year_of_range("x", {"2008-2012": 2010})) == [1990, 2010, 2010, None, None]
    assert column(spark, texts, "string", s.to_number("x")) == [1990.0, 2010.0, None, None, None]


def test_rounding_to_even(spark):
    assert column(spark, [0.5, 1.5, 2.5], "double", s.round_even("x")) == [0.0, 2.0, 2.0]
    assert column(spark, [0.00005], "double", s.round_even("x", 4)) == [0.0]


def test_significant_digits(spark):
    got = column(spark, [123456.0, 0.00123456, 0.0, -98765.4], "double", s.significant("x", 3))
    assert got[2] == 0.0
    assert [got[0], got[3]] == [123000.0, -98800.0]
    assert math.isclose(got[1], 0.00123)


def test_inverse_logit(spark):
    assert column(spark, [0.0], "double", s.inverse_logit("x")) == [0.5]


def test_t_points(spark):
    got = column(spark, [0, 1, 5, 10, 30, 200, 201, 10000], "int", t_975(F.col("x")))
    wanted = [12.706205, 2.570582, 2.228139, 2.042272, 1.971896, 1.971837, 1.960201]
    assert got[0] is None
    assert [round(v, 6) for v in got[1:]] == wanted


def test_age_labels_from_birth_to_the_open_end(spark):
    ages = spark.createDataFrame([(a,) for a in (0, 1, 4, 17, 24, 55, 61, 64, 65, 66, 67, 69, 84, 85, 90)], "AGE int")
    survey = ages.select("AGE", F.lit(census.YEARS[1]).alias("year"), census._age_label(census.SURVEY_AGES).alias("label"))
    earlier = ages.select("AGE", F.lit(census.YEARS[0]).alias("year"), census._age_label(census.CENSUS_AGES).alias("label"))
    got = {(r["year"], r["label"]): (min(r["ages"]), max(r["ages"]), min(r["band_ages"]), r["age_mean"])
           for r in census.harmonised_labels(survey.unionAll(earlier)).collect()}
    later, before = census.YEARS[1], census.YEARS[0]
    assert got[later, "65 and 66 years"] == got[later, "67 to 69 years"] == got[before, "65 to 69 years"] == (65, 69, 65, 67.5)
    assert got[later, "Under 5 years"] == got[before, "Under 1 year"] == (0, 4, 0, 2.5)
    assert got[before, "1 and 2 years"] == (1, 2, 0, 2.5) and got[before, "17 years"] == (17, 17, 15, 16.5)
    assert got[later, "60 and 61 years"] == (60, 61, 60, 61.0) and got[before, "55 to 59 years"] == (55, 59, 55, 57.5)
    assert got[later, "85 years and over"] == got[before, "85 years and over"] == (85, 85, 85, 85.5)
    assert all(v is not None for row in got.values() for v in row)
