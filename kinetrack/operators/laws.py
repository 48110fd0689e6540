"""Dwell laws (M1-M4): likelihoods over dwell histograms, with and without censoring.

Spark reduces episodes to counts of equal dwells (bounded by a video's length); exponential and log-normal laws are
closed forms in SQL, gamma and Weibull need a few Newton steps on the histogram's rows of one group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import FPS
from ..functions.special import gamma_tail
from .ranks import exact_quantiles


def closed_laws(histogram: DataFrame, by: Sequence[str] = ("state",), fps: float = FPS, min_n: int = 1) -> DataFrame:
    """Exponential and log-normal fits by maximum likelihood with AIC, dwells in seconds."""
    x, n = F.col("run") / fps, F.col("n")
    s = histogram.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(n * x).alias("sx"), F.sum(n * F.log(x)).alias("sl"), F.sum(n * F.log(x) * F.log(x)).alias("sl2")).filter(F.col("n") >= min_n)
    mean, mu = F.col("sx") / F.col("n"), F.col("sl") / F.col("n")
    var = F.col("sl2") / F.col("n") - mu * mu
    ll_exp = -F.col("n") * (F.log(mean) + 1)
    ll_ln = F.when(var > 0, -F.col("n") * (0.5 * F.log(2 * math.pi * var) + 0.5) - F.col("sl"))
    out = s.select(*by, "n", F.explode(F.array(
        F.struct(F.lit("exponential").alias("law"), mean.alias("a"), F.lit(None).cast("double").alias("b"), (2 - 2 * ll_exp).alias("aic")),
        F.struct(F.lit("lognormal").alias("law"), mu.alias("a"), F.sqrt(var).alias("b"), (4 - 2 * ll_ln).alias("aic")),
    )).alias("x"))
    return out.select(*by, "n", "x.*")


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y / 42))


def fit_gamma(x: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Shape, scale and log-likelihood (Newton on the shape)."""
    total, mean = n.sum(), (n * x).sum() / n.sum()
    s = math.log(mean) - (n * np.log(x)).sum() / total
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        step = (math.log(k) - digamma(k) - s) / (1 / k - trigamma(k))
        k = max(k - step, k / 10)
        if abs(step) < 1e-12 * k:
            break
    theta = mean / k
    return k, theta, float((n * ((k - 1) * np.log(x) - x / theta)).sum() - total * (k * math.log(theta) + math.lgamma(k)))


def fit_weibull(x: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Shape, scale and log-likelihood (Newton on the shape)."""
    total, logs = n.sum(), np.log(x)
    mean_log = (n * logs).sum() / total
    k = 1.0
    for _ in range(100):
        p = n * np.exp(k * (logs - logs.max()))
        a, b, c = p.sum(), (p * logs).sum(), (p * logs * logs).sum()
        f, d = b / a - 1 / k - mean_log, c / a - (b / a) ** 2 + 1 / (k * k)
        new = max(k - f / d, k / 4)
        if abs(new - k) < 1e-12 * k:
            break
        k = new
    lam = math.exp(logs.max()) * ((n * np.exp(k * (logs - logs.max()))).sum() / total) ** (1 / k)
    return k, lam, float((n * (math.log(k / lam) + (k - 1) * (logs - math.log(lam)) - (x / lam) ** k)).sum())


def dwell_laws(histogram: DataFrame, by: Sequence[str] = ("state",), fps: float = FPS, min_n: int = 30) -> DataFrame:
    """M1: the four laws with parameters, AIC and delta to the best; groups below ``min_n`` dwells, or with equal ones only, have none."""
    by = list(by)

    def fit(h: pd.DataFrame) -> pd.DataFrame:
        x, n = h["run"].to_numpy() / fps, h["n"].to_numpy().astype(float)
        if n.sum() < min_n or len(x) < 2:
            return pd.DataFrame(columns=[*by, "law", "a", "b", "aic", "n"])
        total, mean, logs = n.sum(), (n * x).sum() / n.sum(), np.log(x)
        mu = (n * logs).sum() / total
        sd = math.sqrt((n * (logs - mu) ** 2).sum() / total)
        rows = [("exponential", mean, None, 2 + 2 * total * (math.log(mean) + 1)), ("lognormal", mu, sd, 4 + 2 * (total * (math.log(sd) + 0.5 * math.log(2 * math.pi) + 0.5) + (n * logs).sum()))]
        for law, f in (("gamma", fit_gamma), ("weibull", fit_weibull)):
            a, b, ll = f(x, n)
            rows.append((law, a, b, 4 - 2 * ll))
        out = pd.DataFrame(rows, columns=["law", "a", "b", "aic"]).assign(n=int(total))
        return out.assign(**{c: h[c].iloc[0] for c in by})[[*by, "law", "a", "b", "aic", "n"]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in histogram.select(*by).schema)
    fits = histogram.groupBy(*by).applyInPandas(fit, f"{kinds}, law string, a double, b double, aic double, n long")
    best = fits.groupBy(*by).agg(F.min("aic").alias("best"))
    return fits.join(best, by).withColumn("delta_aic", F.col("aic") - F.col("best")).drop("best")


def censored_exponential(histogram: DataFrame, by: Sequence[str] = ("state",), fps: float = FPS) -> DataFrame:
    """M2: exponential rate with boundary dwells as survivors: events / total time; AIC null without events."""
    s = histogram.groupBy(*by).agg(F.sum(F.when(~F.col("censored"), F.col("n")).otherwise(0)).alias("events"), (F.sum(F.col("n") * F.col("run")) / fps).alias("seconds"))
    rate = F.when(F.col("events") > 0, F.col("events") / F.col("seconds"))
    return s.select(*by, "events", "seconds", rate.alias("rate"), (2 - 2 * (F.col("events") * F.log(rate) - F.col("events"))).alias("aic"))


def minimum(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Downhill simplex for a function of one or two parameters."""
    points = [np.array(start, float)] + [np.array(start, float) + 0.3 * e for e in np.eye(len(start))]
    told = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(told)
        points, told = [points[k] for k in order], [told[k] for k in order]
        if told[-1] - told[0] < tol * (1 + abs(told[0])) and max(np.abs(p - points[0]).max() for p in points) < 1e-8:
            break
        mid, worst = np.mean(points[:-1], axis=0), points[-1]
        best = 2 * mid - worst
        value = f(best)
        if value < told[0] and (far := f(mid + 2 * (mid - worst))) < value:
            best, value = mid + 2 * (mid - worst), far
        elif value >= told[-2]:
            inner = mid + (0.5 if value < told[-1] else -0.5) * (mid - worst)
            if (near := f(inner)) < min(value, told[-1]):
                best, value = inner, near
            elif value >= told[-1]:
                points = [points[0]] + [(p + points[0]) / 2 for p in points[1:]]
                told = [told[0]] + [f(p) for p in points[1:]]
                continue
        points[-1], told[-1] = best, value
    k = int(np.argmin(told))
    return points[k], told[k]


def censored_log_likelihood(law: str, a: float, b: float, x: np.ndarray, done: np.ndarray, cut: np.ndarray) -> float:
    """Log-likelihood of ``done`` whole dwells and ``cut`` boundary dwells of each length ``x``: densities and survivals."""
    logs = np.log(x)
    if law == "exponential":
        density, survival = -math.log(a) - x / a, -x / a
    elif law == "gamma":
        density = (a - 1) * logs - x / b - a * math.log(b) - math.lgamma(a)
        survival = np.array([math.log(max(gamma_tail(a, v / b), 1e-300)) if c else 0.0 for v, c in zip(x, cut, strict=True)])
    elif law == "weibull":
        z = (x / b) ** a
        density, survival = math.log(a / b) + (a - 1) * (logs - math.log(b)) - z, -z
    else:
        z = (logs - math.log(b)) / a
        density = -logs - math.log(a) - 0.5 * math.log(2 * math.pi) - 0.5 * z * z
        survival = np.array([math.log(max(0.5 * math.erfc(v / math.sqrt(2)), 1e-300)) for v in z])
    return float((done * density + cut * survival).sum())


def censored_laws(histogram: DataFrame, by: Sequence[str] = ("state",), fps: float = FPS) -> DataFrame:
    """M2: the four laws with boundary dwells as survivors: parameters (shape a, scale b; the exponential's scale is a), AIC, delta to the best.

    ``histogram`` has (by, run, censored, n). Groups without a whole dwell have no law. A group is a table of
    distinct dwells, bounded by a video's length.
    """
    by = list(by)
    columns = [*by, "law", "a", "b", "aic", "events", "n"]

    def fit(h: pd.DataFrame) -> pd.DataFrame:
        wide = h.pivot_table(index="run", columns="censored", values="n", aggfunc="sum", fill_value=0).reindex(columns=[False, True], fill_value=0)
        x, done, cut = wide.index.to_numpy() / fps, wide[False].to_numpy(float), wide[True].to_numpy(float)
        if not done.sum():
            return pd.DataFrame(columns=columns)
        n, logs = done.sum(), np.log(x)
        mean = (done * x).sum() / n
        sd = max(math.sqrt(max((done * (x - mean) ** 2).sum() / n, 0)), 1e-3)
        mid = (done * logs).sum() / n
        log_sd = max(math.sqrt(max((done * (logs - mid) ** 2).sum() / n, 0)), 0.1)
        starts = {"gamma": ((mean / sd) ** 2, sd**2 / mean), "weibull": (1.2, mean), "lognormal": (log_sd, math.exp(mid))}
        rate = (done * x + cut * x).sum() / n
        rows = [("exponential", rate, None, 2 - 2 * censored_log_likelihood("exponential", rate, 0, x, done, cut))]
        for law, start in starts.items():

            def cost(theta: np.ndarray, law: str = law) -> float:
                a, b = np.exp(np.clip(theta, -30, 30))
                value = -censored_log_likelihood(law, float(a), float(b), x, done, cut)
                return value if math.isfinite(value) else 1e18

            with np.errstate(over="ignore", invalid="ignore"):
                best, value = minimum(cost, np.log(np.maximum(start, 1e-3)))
            rows.append((law, float(np.exp(best[0])), float(np.exp(best[1])), 4 + 2 * value))
        out = pd.DataFrame(rows, columns=["law", "a", "b", "aic"]).assign(events=int(n), n=int(n + cut.sum()))
        return out.assign(**{c: h[c].iloc[0] for c in by})[columns]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in histogram.select(*by).schema)
    fits = histogram.groupBy(*by).applyInPandas(fit, f"{kinds}, law string, a double, b double, aic double, events long, n long")
    best = fits.groupBy(*by).agg(F.min("aic").alias("best"))
    return fits.join(best, by).withColumn("delta_aic", F.col("aic") - F.col("best")).drop("best")


def hill_exponent(eps: DataFrame, by: Sequence[str] = ("state",), quantile: float = 0.5, fps: float = FPS, min_n: int = 50) -> DataFrame:
    """M3: Hill tail exponent above a quantile of the dwells; null below ``min_n`` tail dwells."""
    cut = exact_quantiles(eps.select(*by, (F.col("run") / fps).alias("x")), {"x": {"xmin": quantile}}, by)
    tail = eps.join(cut, list(by)).withColumn("x", F.col("run") / fps).filter("x >= xmin")
    s = tail.groupBy(*by, "xmin").agg(F.count("*").alias("n_tail"), F.sum(F.log(F.col("x") / F.col("xmin"))).alias("s"))
    return s.select(*by, "xmin", "n_tail", F.when((F.col("n_tail") >= min_n) & (F.col("s") > 0), 1 + F.col("n_tail") / F.col("s")).alias("alpha"))
