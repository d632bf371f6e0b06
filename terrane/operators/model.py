"""Nested spherical models: fitting, choice by information criterion, bootstrap and cross-validation.

Variograms are a row a bin; a fit is a task over one, run in parallel by (configuration, start) or replicate with
applyInPandas.  Fits are bounded Levenberg-Marquardt with steps clipped to the bounds, numpy only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalars import EPSILON
from terrane.operators.sampling import normal

#: (components, nugget) that are tried, the simpler first.
CONFIGURATIONS = tuple((n, g) for g in (False, True) for n in (1, 2, 3))
STARTS = 5


def gamma(h: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Semivariance of sills p[:n], ranges p[n:2n] and a nugget if there is one more."""
    r = np.minimum(h[:, None] / p[n : 2 * n], 1.0)
    return (p[:n] * (1.5 * r - 0.5 * r**3)).sum(1) + (p[2 * n] if len(p) > 2 * n else 0.0)


def _jacobian(h: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    q = h[:, None] / p[n : 2 * n]
    r = np.minimum(q, 1.0)
    by_sill = 1.5 * r - 0.5 * r**3
    by_range = np.where(q < 1, p[:n] * (1.5 - 1.5 * r**2) * (-r / p[n : 2 * n]), 0.0)
    return np.hstack([by_sill, by_range, np.ones((len(h), len(p) - 2 * n))])


def fit(h: np.ndarray, g: np.ndarray, sigma: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weighted least squares within bounds; parameters and sum of squares."""
    p, damping = np.clip(start, low, high), 1e-3
    residual = (gamma(h, p, n) - g) / sigma
    cost = residual @ residual
    for _ in range(rounds):
        j = _jacobian(h, p, n) / sigma[:, None]
        normal_, slope = j.T @ j, j.T @ residual
        held = ((p <= low) & (slope > 0)) | ((p >= high) & (slope < 0))
        free = ~held
        if not free.any() or np.abs(slope[free]).max() < 1e-14:
            break
        step = np.zeros_like(p)
        m = normal_[np.ix_(free, free)]
        step[free] = np.linalg.lstsq(m + damping * np.diag(np.maximum(np.diag(m), 1e-12)), -slope[free], rcond=None)[0]
        new = np.clip(p + step, low, high)
        r = (gamma(h, new, n) - g) / sigma
        if (c := r @ r) < cost:
            done = cost - c <= 1e-12 * cost
            p, residual, cost, damping = new, r, c, damping / 3
            if done:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    return p, float(cost)


def base_guess(g: np.ndarray, longest: float, n: int, nugget: bool) -> np.ndarray:
    """Start of a fit: equal sills of 1.5 times the largest semivariance, ranges in thirds of half the largest lag."""
    top = float(np.max(g))
    return np.array([1.5 * top / n] * n + [longest / 2 / 3 * (i + 1) for i in range(n)] + [1.5 * top / 4] * nugget)


def bounds(longest: float, n: int, nugget: bool) -> tuple[np.ndarray, np.ndarray]:
    return np.array([0.0] * n + [1e-6] * n + [0.0] * nugget), np.array([np.inf] * n + [2 * longest] * n + [np.inf] * nugget)


def log_likelihood(vario: DataFrame, fitted, sigma: str = "sigma") -> DataFrame:
    s = F.when(F.col(sigma) > 0, F.col(sigma)).otherwise(EPSILON)
    r = F.col("gamma") - fitted
    return vario.agg((F.sum(F.log(2 * np.pi * s * s) + r * r / (s * s)) * -0.5).alias("loglike"))


RESULT = "config int, start int, components int, nugget boolean, params array<double>, aic double"


def search(vario: DataFrame, seed: int = 42, sigma: str = "sigma", starts: int = STARTS) -> DataFrame:
    """All fits of ``vario(lag, gamma, sigma)``: a row a configuration and start, with its AIC."""
    tasks = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(s).alias("start")) for c in range(len(CONFIGURATIONS)) for s in range(starts)])
    rows = vario.select(F.explode(tasks).alias("t"), "lag", "gamma", F.col(sigma).alias("sigma")).select("t.*", "lag", "gamma", "sigma")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        config, start = int(pdf.config.iloc[0]), int(pdf.start.iloc[0])
        n, nugget = CONFIGURATIONS[config]
        h, g = pdf.lag.to_numpy(float), pdf.gamma.to_numpy(float)
        s = np.where(pdf.sigma.to_numpy(float) > 0, pdf.sigma.to_numpy(float), EPSILON)
        guess = base_guess(g, h.max(), n, nugget)
        tilt = np.random.default_rng([seed, config, start]).uniform(0.5, 1.5, len(guess))
        p, _ = fit(h, g, s, guess * tilt, *bounds(h.max(), n, nugget), n)
        r = (g - gamma(h, p, n)) / s
        aic = 2 * len(p) + (np.log(2 * np.pi * s**2) + r**2).sum()
        order = np.argsort(p[n : 2 * n], kind="stable")
        p = np.concatenate((p[:n][order], p[n : 2 * n][order], p[2 * n :]))
        return pd.DataFrame([{"config": config, "start": start, "components": n, "nugget": nugget, "params": p.tolist(), "aic": float(aic)}])

    return rows.groupBy("config", "start").applyInPandas(one, RESULT)


def best(searched: DataFrame) -> DataFrame:
    """The fit of lowest AIC, the earlier (simpler) of equals, as sills, ranges and nugget."""
    p, n = F.col("m.params"), F.col("m.components")
    top = searched.agg(F.min_by(F.struct("components", "nugget", "params", "aic"), F.struct("aic", "config", "start")).alias("m"))
    nug = F.when(F.col("m.nugget"), F.element_at(p, -1)).otherwise(0.0)
    return top.select(n.alias("components"), F.slice(p, F.lit(1), n).alias("sills"), F.slice(p, n + 1, n).alias("ranges"), nug.alias("nug"), F.col("m.aic").alias("aic"))


def bootstrap(vario: DataFrame, sills: list[float], ranges: list[float], nugget: float | None, replicates: int = 500, seed: int = 42) -> DataFrame:
    """rep and params of refits to normal draws about the mean variogram; fits that fail are left out."""
    n = len(sills)
    start = np.array([*sills, *ranges, *([nugget] if nugget is not None else [])])
    rows = vario.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).select("rep", "lag", (F.col("gamma") + F.col("sigma") * normal(seed, "rep", "bin")).alias("gamma"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h, g = pdf.lag.to_numpy(float), pdf.gamma.to_numpy(float)
        p, cost = fit(h, g, np.ones(len(h)), start, *bounds(h.max(), n, nugget is not None), n)
        return pd.DataFrame([{"rep": int(pdf.rep.iloc[0]), "params": p.tolist()}] if np.isfinite(cost) else [], columns=["rep", "params"])

    return rows.groupBy("rep").applyInPandas(one, "rep int, params array<double>")


def intervals(replicates: DataFrame, count: int, point: list[float]) -> DataFrame:
    """16, 50 and 84 percentiles of each parameter; the point estimate where no replicate succeeded."""
    at = replicates.select(F.posexplode("params").alias("param", "value")).groupBy("param").agg(F.percentile("value", F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84))).alias("p"))
    spine = replicates.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(point[:count])], "param int, point double")
    return spine.join(at, "param", "left").select("param", *[F.coalesce(F.col("p")[i], "point").alias(x) for i, x in enumerate(("low", "median", "high"))])


def cross_validate(folded: DataFrame, n: int, nugget: bool, k: int = 5) -> DataFrame:
    """Mean RMSE, MAE, ME and MSE over folds of fits to the rest; bins without a fold only train."""
    rows = folded.withColumn("test", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        held = (pdf.fold == pdf.test).to_numpy()
        columns = ["rmse", "mae", "me", "mse"]
        train, test = pdf[~held], pdf[held]
        if not len(test) or len(train) < 2:
            return pd.DataFrame([], columns=columns)
        h, g = train.lag.to_numpy(float), train.gamma.to_numpy(float)
        s = np.where(train.sigma.to_numpy(float) > 0, train.sigma.to_numpy(float), EPSILON)
        p, _ = fit(h, g, s, base_guess(g, h.max(), n, nugget), *bounds(h.max(), n, nugget), n)
        e = gamma(test.lag.to_numpy(float), p, n) - test.gamma.to_numpy(float)
        return pd.DataFrame([{"rmse": float(np.sqrt((e**2).mean())), "mae": float(np.abs(e).mean()), "me": float(e.mean()), "mse": float((e**2).mean())}])

    found = rows.groupBy("test").applyInPandas(one, "rmse double, mae double, me double, mse double")
    return found.agg(*[F.avg(c).alias(c) for c in ("rmse", "mae", "me", "mse")], F.count("*").alias("folds"))


