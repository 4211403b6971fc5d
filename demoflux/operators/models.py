"""Weighted logistic models on categorical covariates, and linear models of areas.

Rows are first collapsed to covariate patterns: the fit, its variance and its
predictions need only a few sums per pattern, so every pass after the first works on a
table whose size depends on the covariates' levels and not on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demoflux.functions.semantics import inverse_logit
from demoflux.session import cut_lineage



def crossed(*names: str) -> list[tuple[str, ...]]:
    """Main effects and all interactions of the named variables."""
    return [c for size in range(1, len(names) + 1) for c in combinations(names, size)]


def terms(*parts: str | list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Terms of a model from names and crossed groups, without repeats, lower orders first."""
    seen: dict[frozenset, tuple[str, ...]] = {}
    for part in parts:
        for term in [(part,)] if isinstance(part, str) else part:
            seen.setdefault(frozenset(term), term)
    return sorted(seen.values(), key=len)


@dataclass(frozen=True)
class DesignMatrix:
    """Columns of a model: an intercept, then treatment contrasts and products for each term."""

    terms: tuple[tuple[str, ...], ...]
    levels: dict[str, tuple]

    def columns(self) -> list[tuple[str, Column]]:
        """Name and value of every model column."""
        return [(name, self._value(parts)) for name, parts in self._parts()]

    def names(self) -> list[str]:
        return [name for name, _ in self._parts()]

    def _parts(self) -> list[tuple[str, tuple[tuple[str, object], ...]]]:
        """Every model column as a name and the (variable, level) pairs it multiplies."""
        out = [("(Intercept)", ())]
        for term in self.terms:
            partial = [((), ())]
            for variable in term:
                choices = self.levels[variable][1:] if variable in self.levels else [None]
                partial = [
                    ((*names, variable if level is None else f"{variable}{level}"), (*pairs, (variable, level)))
                    for level in choices for names, pairs in partial
                ]
            out.extend((":".join(names), pairs) for names, pairs in partial)
        return out

    @staticmethod
    def _value(pairs: tuple[tuple[str, object], ...]) -> Column:
        """Product of the numeric variables where all factor levels hold, else 0."""
        numbers = [F.col(v).cast("double") for v, level in pairs if level is None]
        product = F.lit(1.0)
        for i, number in enumerate(numbers):
            product = number if i == 0 else product * number
        held = None
        for variable, level in pairs:
            if level is not None:
                hit = F.col(variable) == F.lit(level)
                held = hit if held is None else held & hit
        return product if held is None else F.when(held, product).otherwise(0.0)

    def row(self) -> Column:
        """The design row as an array."""
        return F.array(*[value for _, value in self.columns()])

    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for term in self.terms for v in term))


@dataclass(frozen=True)
class LogisticFit:
    design: DesignMatrix
    coefficients: np.ndarray
    covariance: np.ndarray
    model_covariance: np.ndarray
    deviance: float
    n: int

    def standard_errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))


def factor_levels(df: DataFrame, factors: Sequence[str], limit: int | None = None) -> dict[str, tuple]:
    """Sorted levels of each factor. A caller may refuse factors of more than `limit` levels."""
    levels = {}
    for f in factors:
        seen = df.select(f).filter(F.col(f).isNotNull()).distinct()
        values = [r[0] for r in (seen if limit is None else seen.limit(limit + 1)).collect()]
        if limit is not None and len(values) > limit:
            raise ValueError(f"{f} has more than {limit} levels, too many for a factor")
        levels[f] = tuple(sorted(values))
    return levels


def covariate_patterns(df: DataFrame, covariates: Sequence[str], y: str, weight: str | None) -> DataFrame:
    """Sums per covariate pattern, stored once. Rows with a missing value are left out."""
    used = df.select(*covariates, y, *([weight] if weight else [])).dropna("any")
    w, v = (F.col(weight) if weight else F.lit(1.0)), F.col(y).cast("double")
    return cut_lineage(used.groupBy(*covariates).agg(
        F.sum(w).alias("_w"), F.sum(w * v).alias("_wy"), F.sum(w * w).alias("_ww"),
        F.sum(w * w * v).alias("_wwy"), F.count(F.lit(1)).alias("_n"),
    ))


def _information(rows: DataFrame, beta: np.ndarray) -> DataFrame:
    """Per partition: the upper triangles of the information and score-variance sums."""
    k = len(beta)
    upper = np.triu_indices(k)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            if batch.empty:
                continue
            x = np.vstack(batch["x"].to_numpy())
            p = 1.0 / (1.0 + np.exp(-x @ beta))
            inner = (batch["_w"] * p * (1 - p)).to_numpy()
            outer = ((1 - 2 * p) * batch["_wwy"] + p * p * batch["_ww"]).to_numpy()
            a += (x * inner[:, None]).T @ x
            b += (x * outer[:, None]).T @ x
        yield pd.DataFrame({"i": upper[0], "j": upper[1], "a": a[upper], "b": b[upper]})

    return rows.mapInPandas(partial, "i int, j int, a double, b double")


def _covariances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse information and sandwich; columns the data say nothing about are NaN.

    Columns of unlike size are brought to one scale before inverting.
    """
    known = np.flatnonzero(np.diag(a) > 0)
    block = np.ix_(known, known)
    scale = 1.0 / np.sqrt(np.diag(a)[known])
    small = np.linalg.inv(a[block] * np.outer(scale, scale)) * np.outer(scale, scale)
    inverse, sandwich = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    inverse[block], sandwich[block] = small, small @ b[block] @ small
    return inverse, sandwich


def _predictor(row: Column, beta: np.ndarray) -> Column:
    """Product of a design row and the coefficients."""
    products = F.zip_with(row, F.array(*[F.lit(float(v)) for v in beta]), lambda u, v: u * v)
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def fitted_probability(fit: LogisticFit) -> Column:
    """The model's probability for a row with the model's covariates."""
    return inverse_logit(_predictor(fit.design.row(), fit.coefficients))


def fit_logistic(
    patterns: DataFrame, model: Sequence[tuple[str, ...]], levels: dict[str, tuple], weighted: bool = True
) -> LogisticFit:
    """Logistic regression on collapsed patterns.

    With `weighted`, the covariance is the design-based sandwich; otherwise it is the
    model-based inverse information. The k x k algebra is done on the driver, in memory of a few
    times 8 k * k bytes.
    """
    design = DesignMatrix(tuple(model), levels)
    k = len(design.names())
    totals = patterns.agg(F.sum("_n").alias("n"), F.sum("_w").alias("w")).first()
    if not totals["n"]:
        raise ValueError("there are no rows to fit a model on")
    n, mean_weight = int(totals["n"]), float(totals["w"]) / int(totals["n"])
    scaled = [(F.col(c) / F.lit(s)).alias(c) for c, s in
              (("_w", mean_weight), ("_wy", mean_weight), ("_ww", mean_weight**2), ("_wwy", mean_weight**2))]
    rows = cut_lineage(patterns.select(design.row().alias("x"), *scaled))
    features = F.slice("x", 2, k - 1) if k > 1 else F.array(F.lit(0.0))
    fitted = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol="label", featuresCol="features", weightCol="_w",
        fitIntercept=True, maxIter=50, tol=1e-10, regParam=0.0,
    ).fit(rows.select(
        array_to_vector(features).alias("features"), (F.col("_wy") / F.col("_w")).alias("label"), "_w"))
    beta = np.concatenate([[fitted.intercept], np.asarray(fitted.coefficients)[: k - 1]])

    a, b = np.zeros((k, k)), np.zeros((k, k))
    sums = _information(rows, beta).groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    for r in sums.collect():
        a[r["i"], r["j"]] = a[r["j"], r["i"]] = r["a"]
        b[r["i"], r["j"]] = b[r["j"], r["i"]] = r["b"]
    inverse, sandwich = _covariances(a, b * (n / (n - 1.0)))

    eta = _predictor(F.col("x"), beta)
    log_lik = F.sum(F.col("_wy") * eta - F.col("_w") * (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))))
    deviance = -2.0 * float(rows.agg(log_lik).first()[0])
    return LogisticFit(design, beta, sandwich if weighted else inverse, inverse, deviance, n)


def _steps(rows: DataFrame, parts: dict[str, np.ndarray], betas: dict[str, np.ndarray]) -> DataFrame:
    """Per partition and model: upper triangles of information and score variance, and, as rows i with j = -1, scores; the deviance is at i = -1."""
    state = [(name, parts[name], betas[name]) for name in betas]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {name: [np.zeros((len(beta), len(beta))), np.zeros((len(beta), len(beta))), np.zeros(len(beta)), 0.0] for name, _, beta in state}
        for batch in batches:
            if batch.empty:
                continue
            wide = np.vstack(batch["x"].to_numpy())
            w, wy, ww, wwy = (batch[c].to_numpy() for c in ("_w", "_wy", "_ww", "_wwy"))
            for name, columns, beta in state:
                x = wide[:, columns]
                eta = x @ beta
                p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
                into = sums[name]
                into[0] += (x * (w * p * (1 - p))[:, None]).T @ x
                into[1] += (x * ((1 - 2 * p) * wwy + p * p * ww)[:, None]).T @ x
                into[2] += x.T @ (wy - w * p)
                into[3] -= 2 * float(np.sum(wy * eta - w * (np.maximum(eta, 0) + np.log1p(np.exp(-np.abs(eta))))))
        for name, (a, b, score, deviance) in sums.items():
            upper = np.triu_indices(len(a))
            k = len(score)
            yield pd.DataFrame({
                "model": name, "i": np.concatenate([upper[0], np.arange(k), [-1]]), "j": np.concatenate([upper[1], np.full(k + 1, -1)]),
                "a": np.concatenate([a[upper], score, [deviance]]), "b": np.concatenate([b[upper], np.zeros(k + 1)])})

    return rows.mapInPandas(partial, "model string, i int, j int, a double, b double")


def fit_many(
    patterns: DataFrame, models: Mapping[str, Sequence[tuple[str, ...]]], levels: dict[str, tuple], weighted: bool = True,
    tolerance: float = 1e-10, most_steps: int = 50,
) -> dict[str, LogisticFit]:
    """Logistic regressions of many formulas on the same patterns, fitted together.

    One table holds the design rows of all formulas' columns. Each Newton step reads it once for all models that still
    move: every model takes its own columns, and gives sums of a size that its number of columns fixes. A model is done when a step
    changes its deviance by less than `tolerance` of it; a step that raises the deviance is halved. What the data say nothing
    about has coefficient 0 and no variance (NaN).
    """
    every = DesignMatrix(tuple(terms(*[[t for t in model] for model in models.values()])), levels)
    place = {frozenset(pairs): i for i, (_, pairs) in enumerate(every._parts())}
    designs = {name: DesignMatrix(tuple(model), levels) for name, model in models.items()}
    parts = {name: np.array([place[frozenset(pairs)] for _, pairs in d._parts()]) for name, d in designs.items()}
    totals = patterns.agg(F.sum("_n").alias("n"), F.sum("_w").alias("w"), F.sum("_wy").alias("wy")).first()
    if not totals["n"]:
        raise ValueError("there are no rows to fit a model on")
    n, mean_weight = int(totals["n"]), float(totals["w"]) / int(totals["n"])
    scaled = [(F.col(c) / F.lit(s)).alias(c) for c, s in
              (("_w", mean_weight), ("_wy", mean_weight), ("_ww", mean_weight**2), ("_wwy", mean_weight**2))]
    rows = cut_lineage(patterns.select(every.row().alias("x"), *scaled))
    share = min(max(float(totals["wy"]) / float(totals["w"]), 1e-6), 1 - 1e-6)
    betas = {name: np.concatenate([[np.log(share / (1 - share))], np.zeros(len(p) - 1)]) for name, p in parts.items()}
    moves = {name: np.zeros(len(p)) for name, p in parts.items()}
    before = {name: np.inf for name in parts}
    fits: dict[str, LogisticFit] = {}
    for step in range(most_steps):
        found: dict[str, list] = {name: [np.zeros((len(b), len(b))), np.zeros((len(b), len(b))), np.zeros(len(b)), 0.0] for name, b in betas.items()}
        for r in _steps(rows, parts, betas).groupBy("model", "i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
            into = found[r["model"]]
            if r["i"] < 0:
                into[3] = r["a"]
            elif r["j"] < 0:
                into[2][r["i"]] = r["a"]
            else:
                into[0][r["i"], r["j"]] = into[0][r["j"], r["i"]] = r["a"]
                into[1][r["i"], r["j"]] = into[1][r["j"], r["i"]] = r["b"]
        for name, (a, b, score, deviance) in found.items():
            if deviance > before[name] * (1 + tolerance) + tolerance and step + 1 < most_steps:
                moves[name] = moves[name] / 2
                betas[name] = betas[name] - moves[name]
                continue
            if abs(before[name] - deviance) < tolerance * (abs(deviance) + 0.1) or step + 1 == most_steps:
                inverse, sandwich = _covariances(a, b * (n / (n - 1.0)))
                fits[name] = LogisticFit(designs[name], betas.pop(name), sandwich if weighted else inverse, inverse, deviance, n)
                continue
            before[name] = deviance
            known = np.flatnonzero(np.diag(a) > 0)
            scale = 1.0 / np.sqrt(np.diag(a)[known])
            move = np.zeros(len(score))
            move[known] = scale * np.linalg.lstsq(a[np.ix_(known, known)] * np.outer(scale, scale), scale * score[known], rcond=1e-12)[0]
            moves[name], betas[name] = move, betas[name] + move
        if not betas:
            break
    return {name: fits[name] for name in models}


def design_bic(fit: LogisticFit, maximal: LogisticFit) -> dict[str, float]:
    """Design-based BIC of a model nested in the maximal one (Lumley and Scott 2015).

    The maximal model's deviance, plus the Wald statistic of the coefficients left out, plus
    p log n, plus the log determinant of their design effect matrix.
    """
    names, all_names = fit.design.names(), maximal.design.names()
    if not set(names) <= set(all_names):
        raise ValueError("the model is not nested in the maximal model")
    left_out = [i for i, name in enumerate(all_names) if name not in set(names)]
    wald, log_det = 0.0, 0.0
    if left_out:
        block = np.ix_(left_out, left_out)
        beta = maximal.coefficients[left_out]
        wald = float(beta @ np.linalg.solve(maximal.covariance[block], beta))
        effect = np.linalg.solve(maximal.model_covariance[block], maximal.covariance[block])
        log_det = float(np.linalg.slogdet(effect)[1])
    bic = wald + len(names) * np.log(fit.n) + log_det + maximal.deviance
    return {"p": float(len(names)), "bic": float(bic)}


COEFFICIENTS = "position int, term string, estimate double, std_error double"


def coefficient_table(spark, fit: LogisticFit) -> DataFrame:
    """Coefficients and standard errors as a table."""
    rows = [(i, name, float(b), float(s)) for i, (name, b, s) in enumerate(
        zip(fit.design.names(), fit.coefficients, fit.standard_errors()))]
    return spark.createDataFrame(rows, COEFFICIENTS)


def normal_draws(seed: int, draws: int, size: int) -> np.ndarray:
    """draws x size independent standard normal numbers, each fixed by its place: by the polar form, from two MD5 digests.

    A digest's first 13 hex digits are a uniform number, so SQL can make the same ones.
    """
    def uniform(kind: str, i: int, j: int) -> float:
        return (int(hashlib.md5(f"{kind}:{seed}:{i}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)

    radius = np.array([[uniform("r", i, j) for j in range(size)] for i in range(draws)])
    angle = np.array([[uniform("a", i, j) for j in range(size)] for i in range(draws)])
    return np.sqrt(-2.0 * np.log(radius)) * np.cos(2.0 * np.pi * angle)


def _root(covariance: np.ndarray) -> np.ndarray:
    """Lower triangular root of a covariance; where some combination of coefficients has no variance, a root by eigenvalues."""
    try:
        return np.linalg.cholesky(covariance)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(covariance)
        return vectors * np.sqrt(np.maximum(values, 0.0))


def predict_band(grid: DataFrame, fit: LogisticFit, draws: int = 1000, seed: int = 1) -> DataFrame:
    """Fitted probability and simulated 95% band for every row of a covariate grid.

    The draws of the coefficients (draws x k numbers) travel to the tasks; each batch of
    grid rows is one matrix product. A row that needs a coefficient of which the data say nothing has no band (NULL).
    """
    beta = fit.coefficients
    known = np.flatnonzero(~np.isnan(np.diag(fit.covariance)))
    lost = np.setdiff1d(np.arange(len(beta)), known)
    root = _root(fit.covariance[np.ix_(known, known)])
    simulated = beta[known][:, None] + root @ normal_draws(seed, draws, len(beta))[:, known].T

    @F.pandas_udf("fit double, lwr double, upr double")
    def band(x: pd.Series) -> pd.DataFrame:
        if x.empty:
            return pd.DataFrame({"fit": [], "lwr": [], "upr": []}, dtype=float)
        rows = np.vstack(x.to_numpy())
        low, high = np.quantile(rows[:, known] @ simulated, [0.025, 0.975], axis=1)
        logistic = lambda v: 1.0 / (1.0 + np.exp(-v))
        told = pd.DataFrame({"fit": logistic(rows[:, known] @ beta[known]), "lwr": logistic(low), "upr": logistic(high)})
        told.loc[(rows[:, lost] != 0).any(axis=1)] = np.nan
        return told

    return grid.withColumn("_band", band(fit.design.row())).select(*grid.columns, "_band.fit", "_band.lwr", "_band.upr")


def simple_regression(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Intercept, slope, R squared and row count of y on x, from one aggregation."""
    y_, x_ = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*by).agg(
        F.regr_intercept(y_, x_).alias("intercept"), F.regr_slope(y_, x_).alias("slope"),
        F.regr_r2(y_, x_).alias("r2"), F.regr_count(y_, x_).alias("n"),
    )


def regression_band(df: DataFrame, y: str, x: str) -> DataFrame:
    """Fitted value and its standard error for every row.

    The few sums of the fit come back as one scalar struct, so the rows are not shuffled.
    """
    y_, x_ = F.col(y).cast("double"), F.col(x).cast("double")
    line = df.agg(F.struct(
        F.regr_intercept(y_, x_).alias("a"), F.regr_slope(y_, x_).alias("b"), F.regr_count(y_, x_).alias("n"),
        F.regr_avgx(y_, x_).alias("mx"), F.regr_sxx(y_, x_).alias("sxx"), F.regr_syy(y_, x_).alias("syy"),
        F.regr_sxy(y_, x_).alias("sxy"),
    )).scalar()
    s = lambda name: F.col(f"_line.{name}")
    residual = F.greatest(s("syy") - s("sxy") * s("sxy") / s("sxx"), F.lit(0.0)) / (s("n") - 2)
    offset = x_ - s("mx")
    return (
        df.withColumn("_line", line)
        .withColumn("fit", s("a") + s("b") * x_)
        .withColumn("se", F.sqrt(residual * (1 / s("n") + offset * offset / s("sxx"))))
        .drop("_line")
    )


def linear_bic(df: DataFrame, y: str, model: Sequence[tuple[str, ...]], levels: dict[str, tuple]) -> dict[str, float]:
    """Least squares with treatment contrasts, and BIC up to a constant shared by all models of y."""
    design = DesignMatrix(tuple(model), levels)
    k = len(design.names())
    rows = df.select(design.row().alias("x"), F.col(y).cast("double").alias("y")).filter(F.col("y").isNotNull())

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k + 1))
        n = 0
        for batch in batches:
            if batch.empty:
                continue
            z = np.column_stack([np.vstack(batch["x"].to_numpy()), batch["y"].to_numpy()])
            total += z.T @ z
            n += len(z)
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel(), "n": n})

    sums = rows.mapInPandas(partial, "i int, j int, v double, n long").groupBy("i", "j").agg(
        F.sum("v").alias("v"), F.sum("n").alias("n"))
    gram, n = np.zeros((k + 1, k + 1)), 0
    for r in sums.collect():
        gram[r["i"], r["j"]], n = r["v"], r["n"]
    beta = np.linalg.solve(gram[:k, :k], gram[:k, k])
    rss = float(gram[k, k] - beta @ gram[:k, k])
    return {"rss": rss, "n": float(n), "k": float(k), "bic": float(n * np.log(rss / n) + (k + 1) * np.log(n)),
            **{f"b[{name}]": float(b) for name, b in zip(design.names(), beta)}}
