"""Survey estimates and models against independent numpy calculations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demoflux.functions.student import t_table
from demoflux.operators import models as m
from demoflux.operators.survey import SurveyDesign, clustered_proportion, survey_proportion


def people(seed=5, n=900):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, n)
    stratum, psu = rng.integers(0, 4, n), rng.integers(0, 40, n)
    w = rng.integers(1, 50, n).astype(float)
    age = rng.integers(15, 60, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(-1 + 0.6 * g - 0.02 * (age - 30))))).astype(int)
    return g, stratum, stratum * 100 + psu, w, age, y


def as_table(spark, *columns, schema):
    return spark.createDataFrame([tuple(v.item() for v in row) for row in zip(*columns)], schema)


def limits(p, variance, df):
    if not 0 < p < 1:
        return None, None
    t = t_table()[df - 1] if df <= 200 else 1.96
    logit, half = math.log(p / (1 - p)), t * math.sqrt(variance) / (p * (1 - p))
    return 1 / (1 + math.exp(-logit + half)), 1 / (1 + math.exp(-logit - half))


def test_weighted_proportion(spark):
    g, _, _, w, _, y = people()
    df = as_table(spark, g, w, y, schema="g int, PERWT double, y int")
    got = {r.g: r for r in survey_proportion(SurveyDesign(df), F.col("y"), ["g"]).collect()}
    n = len(g)
    for k in range(3):
        inside = g == k
        p = np.sum(w[inside] * y[inside]) / np.sum(w[inside])
        u = np.where(inside, w * (y - p) / np.sum(w[inside]), 0.0)
        variance = n / (n - 1) * np.sum((u - u.mean()) ** 2)
        assert got[k].est == pytest.approx(p)
        assert got[k].variance == pytest.approx(variance)
        assert got[k].low < got[k].est < got[k].upp
        if got[k].df <= 200:
            assert (got[k].low, got[k].upp) == pytest.approx(limits(p, variance, got[k].df))


def test_degenerate_proportions(spark):
    rows = [("all", 1, 2.0), ("all", 1, 3.0), ("none", 0, 1.0), ("none", 0, 1.0), ("one", 1, 4.0), ("gone", None, 4.0),
            ("mixed", 1, 1.0), ("mixed", 0, 1.0), ("mixed", None, 9.0)]
    df = spark.createDataFrame(rows, "g string, y int, PERWT double")
    got = {r.g: r for r in survey_proportion(SurveyDesign(df), F.col("y"), ["g"]).collect()}
    assert set(got) == {"all", "none", "one", "mixed"}
    assert (got["all"].est, got["all"].low, got["none"].est, got["none"].upp) == (1.0, None, 0.0, None)
    assert got["mixed"].est == 0.5 and got["mixed"].n == 2 and got["mixed"].low is not None
    assert got["one"].low is None


def test_overall_rows_equal_a_pass_of_their_own(spark):
    g, s, _, w, _, y = people()
    df = as_table(spark, g, s, w, y, schema="g int, s int, PERWT double, y int")
    design = SurveyDesign(df)
    both = survey_proportion(design, F.col("y"), ["g", "s"], overall={"s": -1}).collect()
    assert len(both) == 15
    alone = {r.g: r for r in survey_proportion(design, F.col("y"), ["g"]).collect()}
    for r in both:
        if r.s == -1:
            assert (r.est, r.variance, r.low) == pytest.approx((alone[r.g].est, alone[r.g].variance, alone[r.g].low))
            assert (r.n, r.df) == (alone[r.g].n, alone[r.g].df)


def test_clustered_proportion(spark):
    g, stratum, psu, w, _, y = people()
    df = as_table(spark, g, stratum, psu, w, y, schema="g int, s int, c int, PERWT double, y int")
    got = {r.g: r for r in clustered_proportion(SurveyDesign(df, psu="c", strata="s"), F.col("y"), ["g"]).collect()}
    for k in range(3):
        inside = g == k
        p = np.sum(w[inside] * y[inside]) / np.sum(w[inside])
        u = np.where(inside, w * (y - p) / np.sum(w[inside]), 0.0)
        variance = 0.0
        for s in np.unique(stratum):
            totals = np.array([u[(stratum == s) & (psu == c)].sum() for c in np.unique(psu[stratum == s])])
            variance += len(totals) / (len(totals) - 1) * np.sum((totals - totals.mean()) ** 2)
        units = len({(a, b) for a, b in zip(stratum[inside], psu[inside])})
        assert got[k].est == pytest.approx(p)
        assert got[k].variance == pytest.approx(variance)
        assert got[k].df == units - len(np.unique(stratum[inside]))


def newton(x, y, w, steps=40):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (y - p)))
    return beta


def model_data(spark):
    g, stratum, _, w, age, y = people(seed=8, n=1500)
    df = as_table(spark, g, stratum, age, w, y, schema="g int, s int, AGE int, PERWT double, y int")
    x = np.column_stack([np.ones(len(g)), g == 1, g == 2, s_ := stratum == 1, stratum == 2, stratum == 3, age]).astype(float)
    del s_
    return df, x, g, stratum, age, w, y


def test_logistic_fit_and_sandwich(spark):
    df, x, g, stratum, age, w, y = model_data(spark)
    patterns = m.covariate_patterns(df, ["g", "s", "AGE"], "y", "PERWT")
    levels = m.factor_levels(patterns, ["g", "s"])
    fit = m.fit_logistic(patterns, m.terms("g", "s", "AGE"), levels)
    w1 = w / w.mean()
    beta = newton(x, y, w1)
    assert fit.design.names() == ["(Intercept)", "g1", "g2", "s1", "s2", "s3", "AGE"]
    assert fit.coefficients == pytest.approx(beta, abs=1e-6)
    p = 1 / (1 + np.exp(-x @ beta))
    a = (x * (w1 * p * (1 - p))[:, None]).T @ x
    u = x * (w1 * (y - p))[:, None]
    n = len(y)
    wanted = np.linalg.inv(a) @ (u.T @ u) @ np.linalg.inv(a) * n / (n - 1)
    assert fit.standard_errors() == pytest.approx(np.sqrt(np.diag(wanted)), rel=1e-5)
    deviance = -2 * np.sum(w1 * (y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert fit.deviance == pytest.approx(deviance, rel=1e-9)


def test_unweighted_fit_with_interaction(spark):
    df, _, g, stratum, age, _, y = model_data(spark)
    high = (stratum > 1).astype(int)
    df = df.withColumn("h", (F.col("s") > 1).cast("int"))
    patterns = m.covariate_patterns(df, ["g", "h"], "y", None)
    fit = m.fit_logistic(patterns, m.terms(m.crossed("g", "h")), m.factor_levels(patterns, ["g", "h"]), weighted=False)
    x = np.column_stack([np.ones(len(g)), g == 1, g == 2, high, (g == 1) * high, (g == 2) * high]).astype(float)
    beta = newton(x, y, np.ones(len(y)))
    p = 1 / (1 + np.exp(-x @ beta))
    assert fit.design.names() == ["(Intercept)", "g1", "g2", "h1", "g1:h1", "g2:h1"]
    assert fit.coefficients == pytest.approx(beta, abs=1e-6)
    information = (x * (p * (1 - p))[:, None]).T @ x
    assert fit.standard_errors() == pytest.approx(np.sqrt(np.diag(np.linalg.inv(information))), rel=1e-5)


def test_design_bic(spark):
    df, *_ = model_data(spark)
    patterns = m.covariate_patterns(df, ["g", "s", "AGE"], "y", "PERWT")
    levels = m.factor_levels(patterns, ["g", "s"])
    small, large = (m.fit_logistic(patterns, m.terms(*t), levels) for t in (("g",), ("g", "s", "AGE")))
    out = [3, 4, 5, 6]
    beta, v, v0 = large.coefficients[out], large.covariance[np.ix_(out, out)], large.model_covariance[np.ix_(out, out)]
    wanted = beta @ np.linalg.inv(v) @ beta + 3 * np.log(large.n) + np.log(np.linalg.det(np.linalg.inv(v0) @ v)) + large.deviance
    assert m.design_bic(small, large)["bic"] == pytest.approx(wanted)
    assert m.design_bic(large, large)["bic"] == pytest.approx(7 * np.log(large.n) + large.deviance)
    with pytest.raises(ValueError):
        m.design_bic(large, small)


def test_prediction_band(spark):
    df, x, *_ = model_data(spark)
    patterns = m.covariate_patterns(df, ["g", "s", "AGE"], "y", "PERWT")
    fit = m.fit_logistic(patterns, m.terms("g", "s", "AGE"), m.factor_levels(patterns, ["g", "s"]))
    grid = patterns.select("g", "s").distinct().withColumn("AGE", F.lit(25))
    rows = m.predict_band(grid, fit, draws=4000, seed=2).collect()
    assert len(rows) == 12
    for r in rows:
        row = np.array([1, r.g == 1, r.g == 2, r.s == 1, r.s == 2, r.s == 3, 25], dtype=float)
        eta, se = row @ fit.coefficients, math.sqrt(row @ fit.covariance @ row)
        logistic = lambda v: 1 / (1 + math.exp(-v))
        assert r.fit == pytest.approx(logistic(eta))
        assert (r.lwr, r.upr) == pytest.approx((logistic(eta - 1.96 * se), logistic(eta + 1.96 * se)), abs=0.01)
    again = m.predict_band(grid, fit, draws=4000, seed=2).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_many_models_fit_together_as_each_alone(spark):
    df, x, g, stratum, age, w, y = model_data(spark)
    patterns = m.covariate_patterns(df, ["g", "s", "AGE"], "y", "PERWT")
    levels = m.factor_levels(patterns, ["g", "s"])
    models = {"none": [], "g": m.terms("g"), "age": m.terms("AGE", "s"), "full": m.terms("g", "s", "AGE"), "cross": m.terms(m.crossed("g", "AGE"))}
    fits = m.fit_many(patterns, models, levels)
    assert list(fits) == list(models)
    for name, model in models.items():
        if name == "none":
            p = np.average(y, weights=w)
            assert fits[name].coefficients == pytest.approx([np.log(p / (1 - p))])
            continue
        alone = m.fit_logistic(patterns, model, levels)
        assert fits[name].design.names() == alone.design.names()
        assert fits[name].coefficients == pytest.approx(alone.coefficients, abs=1e-5)
        assert fits[name].standard_errors() == pytest.approx(alone.standard_errors(), rel=1e-4)
        assert fits[name].deviance == pytest.approx(alone.deviance, rel=1e-9)
    assert fits["full"].coefficients == pytest.approx(newton(x, y, w / w.mean()), abs=1e-6)


def test_levels_without_rows_have_no_band(spark):
    rows = [(g, h, int(i % 3 == 0), 1.0) for i in range(60) for g, h in (("a", "x"), ("a", "y"), ("b", "x"))]
    patterns = m.covariate_patterns(spark.createDataFrame(rows, "g string, h string, y int, w double"), ["g", "h"], "y", "w")
    levels = m.factor_levels(patterns, ["g", "h"])
    fit = m.fit_many(patterns, {"m": m.terms(m.crossed("g", "h"))}, levels)["m"]
    assert np.isnan(fit.standard_errors()[-1])
    grid = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "g string, h string")
    got = {(r.g, r.h): r for r in m.predict_band(grid, fit, 200, 3).collect()}
    assert got["b", "x"].lwr < got["b", "x"].fit < got["b", "x"].upr
    assert got["b", "y"].fit is None and got["b", "y"].lwr is None and got["b", "y"].upr is None


def test_normal_draws_are_normal_and_fixed():
    z = m.normal_draws(7, 3000, 3)
    assert np.array_equal(z[:5], m.normal_draws(7, 5, 3)) and not np.array_equal(z[:5], m.normal_draws(8, 5, 3))
    assert abs(z.mean(axis=0)).max() < 0.07 and abs(np.cov(z.T) - np.eye(3)).max() < 0.1
    assert abs(np.quantile(z, 0.975) - 1.96) < 0.06


def test_model_terms():
    assert m.terms("YEAR", m.crossed("a", "b"), m.crossed("b", "c"), "a") == [
        ("YEAR",), ("a",), ("b",), ("c",), ("a", "b"), ("b", "c")]
    assert len(m.crossed("a", "b", "c")) == 7


def test_linear_models_of_area_gaps(spark):
    rng = np.random.default_rng(4)
    year, cluster = rng.integers(0, 3, 400), rng.integers(0, 2, 400)
    y = 2 + 1.5 * (year == 1) - cluster + rng.normal(size=400)
    df = as_table(spark, year, cluster, y, schema="Year int, Cluster int, gap double")
    levels = m.factor_levels(df, ["Year", "Cluster"])
    scores = {}
    for name, model in {"1": [], "Y": m.terms("Year"), "C": m.terms("Cluster"), "Y+C": m.terms("Year", "Cluster"),
                        "Y*C": m.terms(m.crossed("Year", "Cluster"))}.items():
        scores[name] = m.linear_bic(df, "gap", model, levels)
    x = np.column_stack([np.ones(400), year == 1, year == 2, cluster]).astype(float)
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert scores["Y+C"]["rss"] == pytest.approx(rss[0])
    assert scores["Y+C"]["b[Year1]"] == pytest.approx(beta[1])
    assert scores["Y+C"]["bic"] == pytest.approx(400 * np.log(rss[0] / 400) + 5 * np.log(400))
    assert min(scores, key=lambda k: scores[k]["bic"]) == "Y+C"


def test_regression_band(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=60)
    y = 1 + 2 * x + rng.normal(size=60)
    df = as_table(spark, x, y, schema="x double, y double")
    line = m.simple_regression(df, "y", "x").first()
    slope, intercept = np.polyfit(x, y, 1)
    assert (line.intercept, line.slope, line.n) == pytest.approx((intercept, slope, 60))
    residual = y - intercept - slope * x
    s2 = residual @ residual / 58
    for r in m.regression_band(df, "y", "x").collect():
        assert r.se == pytest.approx(math.sqrt(s2 * (1 / 60 + (r.x - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())))
