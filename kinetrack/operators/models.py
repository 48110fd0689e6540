"""Models on grouped data (M8, M9, M20, M22, M23, M25, M26): Spark gathers sufficient statistics, the driver solves small systems."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import FPS
from ..sources.files import stored
from .kinematics import KEY
from .ranks import hash_number, numbered, permuted
from .serial import hashed


def _standardised(df: DataFrame, names: Sequence[str]) -> tuple[list[Column], dict]:
    """Columns scaled to mean 0 and population SD 1 (constant ones to 0), and the moments."""
    m = df.agg(*[f(c).alias(f"{c}|{n}") for c in names for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first().asDict()
    return [((F.col(c) - m[f"{c}|m"]) / m[f"{c}|s"]) if m[f"{c}|s"] else F.lit(0.0) for c in names], m


def _gram(df: DataFrame, x: Sequence[Column], y: Column, by: Sequence[str] = ()) -> list[tuple[tuple, np.ndarray, np.ndarray, int, float]]:
    """X'X, X'y, n and sum y^2 of each group: p (p + 3) / 2 + 2 numbers a group, however many rows."""
    p = len(x)
    cells = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    rows = df.groupBy(*by).agg(*cells, *[F.sum(x[i] * y).alias(f"h{i}") for i in range(p)], F.count("*").alias("n"), F.sum(y * y).alias("yy")).collect()
    out = []
    for r in rows:
        g = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                g[i, j] = g[j, i] = r[f"g{i}_{j}"]
        out.append((tuple(r[c] for c in by), g, np.array([r[f"h{i}"] for i in range(p)]), r["n"], r["yy"]))
    return out


def _linear(x: Sequence[Column], beta: np.ndarray) -> Column:
    return sum((c * float(b) for c, b in zip(x, beta, strict=True)), F.lit(0.0))


def ridge_loo(df: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """Leave-one-out MAE of ridge regression for each alpha, beside the mean predictor's.

    Features are scaled by the training rows alone: each row downdates the table of sums by itself (rank one), so one
    pass for the sums and one over the rows do for all alphas.
    """
    data = df.select(*features, target).dropna()
    x, _ = _standardised(data, features)  # keeps the sums well conditioned; each fit scales anew
    p, spark, schema = len(features), df.sparkSession, "alpha double, mae double, mae_mean double, n long"
    (_, g, h, n, _), *_ = _gram(data, [*x, F.lit(1.0)], F.col(target))
    if n < 3:
        return spark.createDataFrame([], schema)

    def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = f.to_numpy(float)
            out = np.empty((len(rows), len(alphas)))
            for k, row in enumerate(rows):
                z, y = np.append(row[:p], 1.0), row[p]
                for j, alpha in enumerate(alphas):
                    (m, sd), w, base = _train_fit(g - np.outer(z, z), h - z * y, p, alpha)
                    out[k, j] = abs(y - base - (row[:p] - m) / sd @ w)
            yield pd.DataFrame(out, columns=[f"e{j}" for j in range(len(alphas))]).assign(base=np.abs(rows[:, p] - h[p] / n) * n / (n - 1))

    told = data.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], F.col(target).cast("double").alias("y")).mapInPandas(errors, ", ".join(f"e{j} double" for j in range(len(alphas))) + ", base double")
    row = told.agg(*[F.avg(f"e{j}").alias(f"e{j}") for j in range(len(alphas))], F.avg("base").alias("base")).first()
    return spark.createDataFrame([(float(a), row[f"e{j}"], row["base"], n) for j, a in enumerate(alphas)], schema)


def ridge_kfold(df: DataFrame, features: Sequence[str], target: str, fold: Column, alpha: float = 1.0) -> DataFrame:
    """K-fold MAE of ridge regression on features scaled by their training rows alone.

    A fold's training sums are the total less its own, so one pass gives every fold's moments and Gram matrix.
    """
    data = df.select(*features, target, fold.alias("_fold")).dropna()
    x, _ = _standardised(data, features)  # keeps the sums well conditioned; folds are scaled anew below
    one, p = [*x, F.lit(1.0)], len(x)
    parts = _gram(data, one, F.col(target), ["_fold"])
    g, h = sum(q[1] for q in parts), sum(q[2] for q in parts)
    pred = F.lit(None).cast("double")
    for (f,), gf, hf, *_ in parts:
        (m, sd), w, base = _train_fit(g - gf, h - hf, p, alpha)
        scaled = [(c - float(a)) / float(b) for c, a, b in zip(x, m, sd, strict=True)]
        pred = F.when(F.col("_fold") == f, _linear(scaled, w) + float(base)).otherwise(pred)
    return data.groupBy("_fold").agg(F.avg(F.abs(F.col(target) - pred)).alias("mae"), F.count("*").alias("n")).withColumnRenamed("_fold", "fold")


def _train_fit(g: np.ndarray, h: np.ndarray, p: int, alpha: float) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, float]:
    """Means and SDs of the training rows, ridge weights on features scaled by them, and the target's mean, from sums with a last column of ones."""
    n = g[p, p]
    m, base = g[:p, p] / n, h[p] / n
    cov = g[:p, :p] - n * np.outer(m, m)
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    w = np.linalg.solve(cov / np.outer(sd, sd) + alpha * np.eye(p), (h[:p] - n * m * base) / sd)
    return (m, sd), w, base


#: Participants of one block of the nested test; every block of held-out ones meets every block of training ones.
BLOCK = 512
DESIGNS = ("A", "B", "C", "Bperp")


def _design(g: np.ndarray, design: str, pa: int, pb: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """From the training rows' sums over (1, a, b, y): the map of a row (1, a, b) to principal coordinates, their eigenvalues and loads, and the target's mean."""
    q, n = 1 + pa + pb, g[0, 0]
    take = {"A": np.eye(q)[1 : 1 + pa], "B": np.eye(q)[1 + pa :], "C": np.eye(q)[1:]}.get(design)
    if take is None:  # b freed from (1, a) on the training rows
        base = slice(0, 1 + pa)
        take = np.eye(q)[1 + pa :]
        take[:, base] -= np.linalg.lstsq(g[base, base], g[base, 1 + pa : q], rcond=None)[0].T
    means = take @ g[:q, 0] / n
    take = take - np.outer(means, np.eye(q)[0])
    spread = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", take, g[:q, :q], take) / n, 0))
    take /= np.where(spread > 1e-10, spread, 1.0)[:, None]
    values, vectors = np.linalg.eigh(take @ g[:q, :q] @ take.T)
    to = vectors.T @ take
    mean = g[0, q] / n
    return to, np.maximum(values, 0), to @ (g[:q, q] - mean * g[:q, 0]), mean


def nested_loo(df: DataFrame, a: Sequence[str], b: Sequence[str], target: str, key: str = "video", alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0, 1000.0)) -> DataFrame:
    """(key, design, y, predicted): each participant predicted by ridge regression on all others.

    Designs: A, B, C (both) and Bperp (B freed from [1, A] on the training rows). Scaling and the choice of alpha (by
    the training rows' own leave-one-out error, with the hat matrix) see no held-out row. The driver holds one table
    of sums; every held-out row is a rank-one downdate of it, and the eigenvalues serve all alphas. Errors of the
    training rows need all of them for each held-out one: blocks of rows meet in tasks, and only sums leave those.
    """
    a, b = list(a), list(b)
    data = df.select(key, *a, *b, F.col(target).cast("double").alias("_y")).dropna()
    x, _ = _standardised(data, [*a, *b])  # keeps the sums well conditioned; each fit scales anew
    pa, pb, alpha, spark = len(a), len(b), np.array(alphas, float), df.sparkSession
    rows = stored(data.select(F.monotonically_increasing_id().alias("_i"), key, F.array(F.lit(1.0), *x, F.col("_y")).alias("_z")))
    z = [F.get("_z", k) for k in range(2 + pa + pb)]
    (_, g, h, n, _), *_ = _gram(rows, z, F.lit(1.0))
    kind = dict(data.dtypes)[key]
    if n < 3:
        return spark.createDataFrame([], f"{key} {kind}, design string, y double, predicted double")

    def block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), BLOCK):
                part = f.iloc[at : at + BLOCK]
                yield pd.DataFrame({"i": [part["_i"].to_numpy(np.int64).tobytes()], "z": [np.stack(part["_z"].to_list()).astype(float).tobytes()]})

    blocks = stored(rows.select("_i", "_z").mapInPandas(block, "i binary, z binary"))

    def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for held_i, held_z, i, z in zip(f["hi"], f["hz"], f["i"], f["z"], strict=True):
                names, others = np.frombuffer(held_i, np.int64), np.frombuffer(i, np.int64)
                held, train = (np.frombuffer(v, float).reshape(-1, 2 + pa + pb) for v in (held_z, z))
                out = []
                for name, row in zip(names, held, strict=True):
                    sums = g - np.outer(row, row)
                    keep = others != name
                    for d in DESIGNS:
                        to, values, loads, mean = _design(sums, d, pa, pb)
                        shrink = 1 / (values[:, None] + alpha)
                        t = train[keep, :-1] @ to.T
                        error = np.abs((train[keep, -1, None] - mean - t @ (loads[:, None] * shrink)) / np.clip(1 - t**2 @ shrink, 1e-8, None)).sum(0)
                        own = to @ row[:-1] @ (loads[:, None] * shrink) + mean if held_i == i else None
                        out.append((int(name), d, error.tolist(), None if own is None else own.tolist()))
                yield pd.DataFrame(out, columns=["_i", "design", "error", "own"])

    pairs = blocks.select(F.col("i").alias("hi"), F.col("z").alias("hz")).crossJoin(blocks)
    told = pairs.mapInPandas(errors, "_i long, design string, error array<double>, own array<double>")
    summed = told.groupBy("_i", "design").agg(F.array(*[F.sum(F.get("error", k)) for k in range(len(alphas))]).alias("error"), F.max("own").alias("own"))
    best = F.array_position("error", F.array_min("error")).cast("int") - 1
    return summed.join(rows.select("_i", key, F.element_at("_z", -1).alias("y")), "_i").select(key, "design", "y", F.get("own", best).alias("predicted"))


def prediction_errors(predictions: DataFrame) -> DataFrame:
    """MAE of each design, beside that of predicting the others' mean."""
    total = predictions.groupBy("design").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    base = (F.col("t") - F.col("y")) / (F.col("n") - 1)
    return predictions.join(total, "design").groupBy("design").agg(F.avg(F.abs(F.col("y") - F.col("predicted"))).alias("mae"), F.avg(F.abs(F.col("y") - base)).alias("mae_mean"), F.count("*").alias("n"))


def permutation_test(df: DataFrame, features: Sequence[str], target: str, key: str, reps: int = 200, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """Ridge fit (explained share of y'y) against fits to permuted targets; X'X is shared, X'y comes per replicate.

    Rows are numbered once; a replicate's permutation is a keyed bijection of those numbers, so nothing is sorted and
    no replicate is gathered.
    """
    data = df.select(key, *features, target).dropna()
    x, _ = _standardised(data, features)
    mean = data.agg(F.avg(target)).first()[0] or 0.0
    y = F.col(target) - mean
    (_, g, h, _, yy), *_ = _gram(data, x, y)
    inv = np.linalg.inv(g + alpha * np.eye(len(g)))
    fit = lambda v: float(v @ inv @ v) / yy if yy else 0.0
    rows = stored(numbered(data.select(key, *[c.alias(f"_x{i}") for i, c in enumerate(x)], y.alias("_y")), [key], "_i").withColumn("_i", F.col("_i") - 1))
    n = rows.count()
    each = rows.drop("_y").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    left = each.withColumn("_j", permuted(F.col("_i"), n, F.col("rep"), F.lit(seed)))
    stats = left.join(rows.select(F.col("_i").alias("_j"), "_y"), "_j").groupBy("rep").agg(*[F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"h{i}") for i in range(len(x))])
    null = [fit(np.array([r[f"h{i}"] for i in range(len(x))])) for r in stats.collect()]
    seen = fit(h)
    p = (1 + sum(v >= seen - 1e-12 for v in null)) / (1 + len(null))
    return df.sparkSession.createDataFrame([(seen, float(np.mean(null)), p, len(null))], "r2 double, null_mean double, p double, reps long")


def normal_quantile(p: float) -> float:
    """Inverse normal CDF by bisection on erfc."""
    lo, hi = -9.0, 9.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def bootstrap_means(df: DataFrame, value: str, key: str, reps: int = 500, seed: int = 0) -> DataFrame:
    """(rep, m): means of bootstrap samples. Slot s of a sample takes the row whose number the MD5 of (rep, s) names.

    Slots are drawn without the rows; how often a row is drawn is counted before its value is joined.
    """
    rows = stored(numbered(df.select(key, F.col(value).cast("double").alias("_v")).dropna(), [key], "_i").select((F.col("_i") - 1).alias("_i"), "_v"))
    n = rows.count()
    slots = df.sparkSession.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    times = slots.select("rep", (hash_number(F.col("rep"), F.col("id"), F.lit(seed)) % max(n, 1)).alias("_i")).groupBy("rep", "_i").agg(F.count("*").alias("_w"))
    return times.join(rows, "_i").groupBy("rep").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("m"))


def bca_interval(df: DataFrame, value: str, key: str, reps: int = 500, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Bias-corrected and accelerated bootstrap interval of a mean; jackknife values by subtraction."""
    data = df.select(key, F.col(value).cast("double").alias("v")).dropna()
    s = data.agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.sum("v").alias("t")).first()
    n, mean = s["n"], s["m"]
    schema = "mean double, low double, high double, reps long"
    if n < 2:
        return df.sparkSession.createDataFrame([], schema)
    leave = (F.lit(s["t"]) - F.col("v")) / (n - 1)
    d = F.lit(mean) - leave  # the jackknife values' mean is the mean itself
    a = data.agg(F.sum(d * d * d).alias("c"), F.sum(d * d).alias("q")).first()
    accel = a["c"] / (6 * a["q"] ** 1.5) if a["q"] else 0.0
    means = np.sort([r["m"] for r in bootstrap_means(data, "v", key, reps, seed).collect()])
    share = min(max(float((means < mean).mean()), 1 / (reps + 1)), reps / (reps + 1))
    z0 = normal_quantile(share)

    def end(q: float) -> float:
        z = z0 + normal_quantile(q)
        return float(np.quantile(means, 0.5 * math.erfc(-(z0 + z / (1 - accel * z)) / math.sqrt(2))))

    return df.sparkSession.createDataFrame([(mean, end((1 - level) / 2), end((1 + level) / 2), len(means))], schema)


def forest_regression(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str] = KEY, folds: int = 5, repeats: int = 20, trees: int = 400, leaf: int = 5, seed: int = 0) -> DataFrame:
    """(repeat, mae, n, folds): random-forest regression with median imputation, predictions of all held-out rows pooled over the folds of each repeat.

    Folds are hashed anew for each repeat. The rows are cached while this runs, since every fold's fit reads them again.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from .order import fold_of

    data = df.select(*key, *[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("label")).filter("label is not null").cache()
    forest = RandomForestRegressor(numTrees=trees, maxDepth=4, minInstancesPerNode=leaf, seed=seed)
    pipe = Pipeline(stages=[Imputer(strategy="median", inputCols=list(features), outputCols=[f"{c}_" for c in features]), VectorAssembler(inputCols=[f"{c}_" for c in features], outputCol="features"), forest])
    try:
        out = []
        for repeat in range(repeats):
            parts = data.withColumn("fold", fold_of(key, folds, seed + repeat))
            for f in sorted(r["fold"] for r in parts.select("fold").distinct().collect()):
                scored = pipe.fit(parts.filter(F.col("fold") != f)).transform(parts.filter(F.col("fold") == f))
                r = scored.agg(F.sum(F.abs(F.col("prediction") - F.col("label"))).alias("e"), F.count("*").alias("n")).first()
                out.append((repeat, f, r["e"], r["n"]))
    finally:
        data.unpersist()
    told = df.sparkSession.createDataFrame(out, "repeat int, fold int, e double, n long")
    return told.groupBy("repeat").agg((F.sum("e") / F.sum("n")).alias("mae"), F.sum("n").alias("n"), F.count("*").alias("folds"))


#: Added to the diagonal of every covariance (of z-scored features).
RIDGE = 1e-5
#: Rows whose densities under all components are held at once.
ROWS = 2048


def _log_parts(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log of weight times density of each row under each component."""
    out = np.empty((len(x), len(weight)))
    for c in range(len(weight)):
        low = np.linalg.cholesky(cov[c])
        z = np.linalg.solve(low, (x - mean[c]).T)
        out[:, c] = np.log(max(weight[c], 1e-300)) - 0.5 * (z**2).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
    return out


Mixture = tuple[np.ndarray, np.ndarray, np.ndarray]  # weights, means, covariances


def _products(x: np.ndarray) -> np.ndarray:
    """1, the values, and their products, each pair once."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], 1)


def _stacked(models: Sequence[Mixture]) -> np.ndarray:
    """All components side by side, as the matrix that takes a row's ``_products`` to its ``_log_parts``."""
    out = []
    for weight, mean, cov in models:
        d = mean.shape[1]
        i, j = np.triu_indices(d)
        low = np.linalg.cholesky(cov)
        inverse = np.linalg.inv(low)
        centre = np.einsum("cij,cj->ci", inverse, mean)
        precision = inverse.transpose(0, 2, 1) @ inverse
        top = np.log(np.maximum(weight, 1e-300)) - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1) - 0.5 * d * math.log(2 * math.pi) - 0.5 * (centre**2).sum(1)
        out.append(np.concatenate([top[:, None], np.einsum("cij,ci->cj", inverse, centre), -precision[:, i, j] * np.where(i == j, 0.5, 1.0)], 1))
    return np.concatenate(out).T


def _log_sum(parts: np.ndarray) -> np.ndarray:
    top = parts.max(1)
    return top + np.log(np.exp(parts - top[:, None]).sum(1))




def mixtures(z: DataFrame, features: Sequence[str], starts: Sequence[tuple[int, int, str | None]], iterations: int = 40, tol: float = 1e-5) -> list[tuple[Mixture, float]]:
    """Gaussian mixtures by EM for every start (k, seed, column of row weights), all side by side: (parameters, log-likelihood).

    Each iteration is one pass over the rows for all models that still move: all their components are one matrix, by
    which a task multiplies some thousand rows at a time, and a task returns one row of sums for each component (its
    weight, mean and products). A start takes ``k`` rows as means, drawn by the MD5 of the row and the seed.
    """
    d, names = len(features), list(features)
    weights = sorted({w for *_, w in starts if w})
    text = [F.round(c, 9) for c in names]
    models: list[Mixture] = []
    drawn: dict[tuple, list] = {}
    for k, seed, w in starts:
        held = drawn.get((seed, w))
        if held is None or len(held) < k:
            most = max(k2 for k2, s2, w2 in starts if (s2, w2) == (seed, w))
            rows = z.filter(F.col(w) > 0) if w else z
            held = drawn[seed, w] = [list(r) for r in rows.select(*names).distinct().orderBy(hashed(*text, F.lit(seed)), *names).limit(most).collect()]
        means = np.array(held[:k], float).reshape(-1, d)
        models.append((np.full(len(means), 1 / max(len(means), 1)), means, np.tile(np.eye(d), (len(means), 1, 1))))
    last, open_ = [-math.inf] * len(models), [i for i, m in enumerate(models) if len(m[0])]
    schema = "m int, c int, ll double, n double, s array<double>, q array<double>"

    for _ in range(iterations):
        now = {i: models[i] for i in open_}

        stacked = _stacked(list(now.values()))
        places = np.cumsum([0, *[len(m[0]) for m in now.values()]])

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            i, j = np.triu_indices(d)
            s, ll = np.zeros((places[-1], 1 + d + len(i))), np.zeros(len(now))  # noqa: B023
            for f in frames:
                for at in range(0, len(f), ROWS):
                    g = f.iloc[at : at + ROWS]
                    x = g[names].to_numpy(float)
                    products = _products(x)
                    parts = products @ stacked  # noqa: B023
                    for k, m in enumerate(now):  # noqa: B023
                        p = parts[:, places[k] : places[k + 1]]  # noqa: B023
                        total = _log_sum(p)
                        w = g[starts[m][2]].to_numpy(float) if starts[m][2] else 1.0
                        ll[k] += (w * total).sum()
                        np.exp(p - total[:, None], out=p)
                        p *= np.reshape(w, (-1, 1))
                    s += parts.T @ products
            q = np.empty((len(s), d, d))
            q[:, i, j] = q[:, j, i] = s[:, 1 + d :]
            out = [(m, c, float(ll[k]) if not c else 0.0, float(s[p, 0]), s[p, 1 : 1 + d].tolist(), q[p].ravel().tolist()) for k, m in enumerate(now) for c, p in enumerate(range(places[k], places[k + 1]))]  # noqa: B023
            yield pd.DataFrame(out, columns=["m", "c", "ll", "n", "s", "q"])

        total = z.select(*names, *weights).mapInPandas(sums, schema).groupBy("m", "c").agg(F.sum("ll").alias("ll"), F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", k)) for k in range(d)]).alias("s"), F.array(*[F.sum(F.get("q", k)) for k in range(d * d)]).alias("q"))
        told: dict[int, dict] = {}
        for r in total.collect():
            told.setdefault(r["m"], {})[r["c"]] = r
        for i, parts in told.items():
            weight, mean, cov = (x.copy() for x in models[i])
            all_ = sum(r["n"] for r in parts.values())
            for c, r in parts.items():
                weight[c] = r["n"] / all_
                if r["n"] > 1e-6 * all_:
                    mean[c] = np.array(r["s"]) / r["n"]
                    cov[c] = np.array(r["q"]).reshape(d, d) / r["n"] - np.outer(mean[c], mean[c]) + RIDGE * np.eye(d)
            ll = sum(r["ll"] for r in parts.values())
            if ll - last[i] <= tol * abs(ll):
                open_.remove(i)
            else:
                models[i] = (weight, mean, cov)
            last[i] = max(ll, last[i])
        if not open_:
            break
    return list(zip(models, last, strict=True))


def _bic_table(z: DataFrame, features: Sequence[str], ks: Sequence[int], seeds: Sequence[int], iterations: int) -> tuple[list[tuple], dict[int, Mixture]]:
    """(k, log-likelihood, BIC, n) of the best start of each k, and its parameters."""
    d, n = len(features), z.count()
    starts = [(k, seed, None) for k in ks for seed in (seeds if k > 1 else seeds[:1])]
    best: dict[int, tuple[float, Mixture]] = {}
    for (k, *_), (model, ll) in zip(starts, mixtures(z, features, starts, iterations), strict=True):
        if len(model[0]) == k and (k not in best or ll > best[k][0]):
            best[k] = (ll, model)
    return [(k, ll, -2 * ll + (k * (d + d * (d + 1) // 2) + k - 1) * math.log(n), n) for k, (ll, _) in sorted(best.items())], {k: m for k, (_, m) in best.items()}


def mixture_bic(df: DataFrame, features: Sequence[str], ks: Sequence[int] = tuple(range(1, 11)), seeds: Sequence[int] = (1, 2, 3, 4), iterations: int = 40) -> DataFrame:
    """Gaussian mixtures on z-scored features: the best start of each k by likelihood, its BIC, and which k is best. All starts are fitted side by side."""
    out, _ = _bic_table(stored(_spread(_scaled(df, features))), features, ks, seeds, iterations)
    best = min(out, key=lambda r: (r[2], r[0]))[0] if out else None
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in out], "k int, log_likelihood double, bic double, n long, best boolean")


def mixture_stability(df: DataFrame, features: Sequence[str], key: Sequence[str], k: int | None = None, boots: int = 20, seed: int = 1, ks: Sequence[int] = tuple(range(1, 11)), seeds: Sequence[int] = (1, 2, 3, 4), iterations: int = 40) -> DataFrame:
    """(boot, k, ari): adjusted Rand index between the clusters of all rows and those that a fit to each hashed bootstrap gives the same rows.

    ``k`` is the one of smallest BIC among ``ks`` unless it is given. A bootstrap weighs each row by a Poisson(1) draw
    from the hash of its key. All bootstraps are fitted side by side, and only tables of cluster pairs leave the tasks.
    """
    names = list(features)
    u = lambda b: F.conv(F.substring(hashed(*key, F.lit(b), F.lit(seed)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    cuts = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)])
    times = {f"_w{b}": sum((F.when(u(b) > float(c), 1).otherwise(0) for c in cuts), F.lit(0)) for b in range(1, boots + 1)}
    z = stored(_spread(_scaled(df, features, key)).withColumns(times))
    table, fits = _bic_table(z, features, [k] if k else ks, seeds, iterations)
    schema = "boot int, k int, ari double"
    if not table:
        return df.sparkSession.createDataFrame([], schema)
    best = min(table, key=lambda r: (r[2], r[0]))[0]
    whole, again = fits[best], [m for m, _ in mixtures(z, features, [(best, seed + b, f"_w{b}") for b in range(1, boots + 1)], iterations)]

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = f[names].to_numpy(float)
            a = _log_parts(x, *whole).argmax(1)
            for b, model in enumerate(again):
                if len(model[0]):
                    cell, n = np.unique(a * best + _log_parts(x, *model).argmax(1), return_counts=True)
                    yield pd.DataFrame({"boot": b + 1, "a": cell // best, "b": cell % best, "n": n})

    cells: dict[int, np.ndarray] = {}
    for r in z.select(*names).mapInPandas(pairs, "boot int, a int, b int, n long").groupBy("boot", "a", "b").agg(F.sum("n").alias("n")).collect():
        cells.setdefault(r["boot"], np.zeros((best, best)))[r["a"], r["b"]] = r["n"]
    return df.sparkSession.createDataFrame([(b, best, _adjusted_rand(t)) for b, t in sorted(cells.items())], schema)


def _adjusted_rand(table: np.ndarray) -> float:
    """From a table of counts of label pairs; 1 where both labelings are one cluster."""
    two = lambda n: float((n * (n - 1) / 2).sum())
    both, a, b, n = two(table), two(table.sum(1)), two(table.sum(0)), table.sum()
    chance = a * b / (n * (n - 1) / 2) if n > 1 else 0.0
    return float((both - chance) / ((a + b) / 2 - chance)) if (a + b) / 2 != chance else 1.0


def _spread(z: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores: a table of few bytes but much work a row would be read by a few tasks."""
    return z.repartition(z.sparkSession.sparkContext.defaultParallelism)


def _scaled(df: DataFrame, features: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    data = df.select(*key, *features).dropna()
    x, _ = _standardised(data, features)
    return data.select(*key, *[c.alias(n) for c, n in zip(x, features, strict=True)])


def tail_counts(states: DataFrame, key: Sequence[str] = KEY, index: str = "idx") -> DataFrame:
    """M9: (state, to, j, tracks): how many tracks move more than ``j`` times from a state to each state; to -1: anywhere.

    Tracks collapse to counts of counts first, so what is summed up is bounded by the moves of the longest track.
    """
    w = Window.partitionBy(*key).orderBy(index)
    moves = states.select(*key, "state", F.lead("state").over(w).alias("to")).filter("to is not null")
    each = moves.select(*key, "state", F.explode(F.array("to", F.lit(-1))).alias("to")).groupBy(*key, "state", "to").agg(F.count("*").alias("c"))
    many = each.groupBy("state", "to", "c").agg(F.count("*").alias("m"))
    beyond = F.sum("m").over(Window.partitionBy("state", "to").orderBy(F.col("c").desc()))
    above = many.withColumns({"tracks": beyond, "_low": F.coalesce(F.lag("c").over(Window.partitionBy("state", "to").orderBy("c")), F.lit(0))})
    return above.select("state", "to", F.explode(F.sequence(F.col("_low"), F.col("c") - 1)).alias("j"), "tracks")


# Bounds of the concentration, fewest tracks, and what is added to each pooled count.
CONCENTRATION_BOUNDS, FEWEST_TRACKS, POOLED_PRIOR = (0.05, 1e5), 5, 0.5


def concentration(states: DataFrame, key: Sequence[str] = KEY, index: str = "idx", symbols: int = 3) -> DataFrame:
    """M9: Dirichlet-multinomial concentration of each state's outgoing moves over tracks, around the pooled row.

    The log-likelihood is a sum over tail counts (how many tracks make more than j moves), so the driver sees one table
    whose size is the longest track's moves. Safeguarded Newton steps on the log scale find the root of the slope
    beside the best point of a coarse grid; infinite below the fewest tracks.
    """
    tails: dict[int, dict[int, np.ndarray]] = {}
    for r in tail_counts(states, key, index).orderBy("state", "to", "j").collect():
        tails.setdefault(r["state"], {}).setdefault(r["to"], []).append(r["tracks"])
    rows, (low, high) = [], np.log(CONCENTRATION_BOUNDS)
    for s, told in sorted(tails.items()):
        u = [np.array(told.get(k, []), float) for k in range(symbols)]
        t = np.array(told[-1], float)
        m = np.array([x.sum() + POOLED_PRIOR for x in u])
        m /= m.sum()
        if t[0] < FEWEST_TRACKS:
            rows.append((int(s), math.inf, None, int(t[0])))
            continue

        def value(x: float) -> tuple[float, float, float]:
            """Log-likelihood, and its first two derivatives by the log of the concentration."""
            k, ll, g, h = math.exp(x), 0.0, 0.0, 0.0  # noqa: B023
            for c, p, sign in ((t, 1.0, -1.0), *((x, p, 1.0) for x, p in zip(u, m, strict=True))):  # noqa: B023
                at = k * p + np.arange(len(c))
                ll += sign * float((c * np.log(at)).sum())
                g += sign * float((c * k * p / at).sum())
                h += sign * float((c * k * p * np.arange(len(c)) / at**2).sum())
            return ll, g, h

        grid = np.linspace(low, high, 61)
        best = int(np.argmax([value(x)[0] for x in grid]))
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
        x = grid[best]
        for _ in range(100):
            _, g, h = value(x)
            lo, hi = (x, hi) if g > 0 else (lo, x)
            step = x - g / h if h < 0 else lo
            nxt = step if lo < step < hi else (lo + hi) / 2
            if abs(nxt - x) < 1e-12:
                break
            x = nxt
        rows.append((int(s), math.exp(x), value(x)[0], int(t[0])))
    return states.sparkSession.createDataFrame(rows, "state int, concentration double, log_likelihood double, tracks long")


def markov_and_hmm(sequences: DataFrame, orders: Sequence[int] = (0, 1, 2, 3), hidden: Sequence[int] = (2, 3, 4, 5), key: Sequence[str] = KEY, index: str = "idx", **options) -> DataFrame:
    """M8: (model, size, ll_per_token, n_tokens): Markov chains and hidden Markov models held out on the same folds of the same sequences."""
    from .order import order_test

    chains = order_test(sequences, orders, key=key, index=index).select(F.lit("markov").alias("model"), F.col("order").cast("int").alias("size"), "ll_per_token", "n_tokens")
    models = hidden_markov(sequences, hidden, key=key, index=index, **options).select(F.lit("hmm"), "hidden", "heldout_ll_per_token", "n_tokens")
    return chains.union(models)


def hidden_markov(sequences: DataFrame, hidden: Sequence[int] = (2, 3, 4, 5), folds: int = 5, restarts: int = 3, iterations: int = 20, key: Sequence[str] = KEY, index: str = "idx", symbols: int = 3) -> DataFrame:
    """M8: held-out log-likelihood per token of discrete HMMs by Baum-Welch, for each number of hidden states.

    All models (states x folds x starts) are fitted side by side: each iteration sends their parameters to the tasks,
    which run forward-backward over whole sequences (a track each) for every model at once and return expected counts
    of the models that the sequence's fold trains. Of a fold's starts, the one of best training likelihood is judged.
    """
    from .order import fold_of

    key, top = list(key), max(hidden)
    models = [(k, f, r) for k in hidden for f in range(folds) for r in range(restarts)]
    size = len(models)
    pi, a, b = np.zeros((size, top)), np.zeros((size, top, top)), np.zeros((size, top, symbols))
    for m, (k, _, r) in enumerate(models):
        rng = np.random.default_rng(r)
        pi[m, :k] = 1 / k
        a[m, :k, :k] = rng.dirichlet(np.ones(k), k) + 2 * np.eye(k)
        b[m, :k] = rng.dirichlet(np.ones(symbols), k)
    a /= np.maximum(a.sum(2, keepdims=True), 1e-300)
    of_fold = np.array([f for _, f, _ in models])
    states = sequences.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct(index, "state"))), lambda x: x["state"]).alias("seq"))
    seqs = states.select("seq", fold_of(key, folds).alias("fold")).groupBy("seq", "fold").agg(F.count("*").alias("n")).cache()
    width = top * (1 + top + symbols) + 4

    def expect(frames: Iterator[pd.DataFrame], pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, width))
        for f in frames:
            for seq, fold, n in zip(f["seq"], f["fold"], f["n"], strict=True):
                o = np.asarray(seq)
                t, emit = len(o), b[:, :, o]  # (models, states, time)
                alpha, scale, beta = np.zeros((t, size, top)), np.zeros((t, size)), np.ones((t, size, top))
                for k in range(t):
                    alpha[k] = (np.matmul(alpha[k - 1][:, None], a)[:, 0] if k else pi) * emit[:, :, k]
                    scale[k] = np.maximum(alpha[k].sum(1), 1e-300)
                    alpha[k] /= scale[k][:, None]
                for k in range(t - 2, -1, -1):
                    beta[k] = np.matmul(a, (emit[:, :, k + 1] * beta[k + 1])[:, :, None])[:, :, 0] / scale[k + 1][:, None]
                gamma = alpha * beta
                ahead = emit[:, :, 1:].transpose(2, 0, 1) * beta[1:] / scale[1:, :, None]
                xi = a * np.einsum("tmi,tmj->mij", alpha[:-1], ahead)
                seen = np.stack([gamma[o == s].sum(0) for s in range(symbols)], 2)
                ll, train = np.log(scale).sum(0), of_fold != fold
                counts = np.concatenate([gamma[0], xi.reshape(size, -1), seen.reshape(size, -1)], 1) * train[:, None]
                total += n * np.concatenate([counts, np.stack([ll * train, t * train, ll * ~train, t * ~train], 1)], 1)
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    for step in range(iterations + 1):
        task = lambda frames, p=pi, q=a, e=b: expect(frames, p, q, e)
        got = np.zeros(size * width)
        for r in seqs.mapInPandas(task, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            got[r["i"]] = r["v"]
        got = got.reshape(size, width)
        if step < iterations:
            k1, k2 = top, top + top * top
            live = np.stack([np.arange(top) < k for k, _, _ in models])
            pi, a, b = (got[:, :k1] + 1e-9) * live, (got[:, k1:k2].reshape(size, top, top) + 1e-9) * live[:, :, None] * live[:, None], (got[:, k2:-4].reshape(size, top, symbols) + 1e-9) * live[:, :, None]
            pi, a, b = pi / pi.sum(1, keepdims=True), a / np.maximum(a.sum(2, keepdims=True), 1e-300), b / np.maximum(b.sum(2, keepdims=True), 1e-300)
    seqs.unpersist()
    out = []
    for k in hidden:
        best = [max((m for m, x in enumerate(models) if x[:2] == (k, f)), key=lambda m: got[m, -4]) for f in range(folds)]
        trained, told = got[best, -4].sum() / max(got[best, -3].sum(), 1), got[best, -2].sum() / max(got[best, -1].sum(), 1)
        out.append((k, float(trained), float(told), int(got[best, -1].sum()), (k - 1) + k * (k - 1) + k * (symbols - 1)))
    return sequences.sparkSession.createDataFrame(out, "hidden int, train_ll_per_token double, heldout_ll_per_token double, n_tokens long, n_params int")


def markov_parameters(order: int, symbols: int = 3) -> int:
    """M8: free parameters of an order-k chain."""
    return symbols**order * (symbols - 1)


LOG_SD_EXPONENTIAL = math.pi / math.sqrt(6)  # SD of the logarithm of an exponential variable
# Chebyshev coefficients of the complementary error function (relative error 1.2e-7).
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def log_survival(x: np.ndarray) -> np.ndarray:
    """Logarithm of the standard normal's upper tail."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    tail = np.log(t) - z * z + np.polyval(ERFC[::-1], t) - math.log(2)
    return np.where(x >= 0, tail, np.log1p(-np.exp(np.minimum(tail, -1e-300))))


def frailty(eps: DataFrame, key: Sequence[str] = KEY, fps: float = FPS, nodes: int = 24, max_iter: int = 250, tol: float = 1e-6) -> DataFrame:
    """Random-effects Tobit of log-dwells by EM, for each state: log d = mu + b(track) + e, boundary dwells being lower bounds.

    Gauss-Hermite nodes stand for b. An iteration sends three numbers a state to the tasks, which hold one track's
    dwells in a state at a time and return sums; equal sets of dwells are gathered once with their number. Returns
    within- and between-track SDs (kept within 0.05 .. 4 and 0.001 .. 4), ICC, CVs and the ratio to a memoryless dwell's SD.
    """
    points, weights = np.polynomial.hermite_e.hermegauss(nodes)
    prior = np.log(weights) - 0.5 * math.log(2 * math.pi)
    item = F.struct(F.log(F.col("run") / fps).alias("y"), F.col("censored").alias("c"))
    cells = eps.groupBy(*key, "state").agg(F.sort_array(F.collect_list(item)).alias("d")).groupBy("state", "d").agg(F.count("*").alias("m"))
    cells = cells.select("state", F.transform("d", lambda x: x["y"]).alias("y"), F.transform("d", lambda x: x["c"].cast("int")).alias("c"), "m").cache()
    log = F.log(F.col("run") / fps)
    first = eps.groupBy("state").agg(F.avg(log).alias("mu"), F.var_pop(log).alias("v"), F.count("*").alias("n"), F.avg(F.col("censored").cast("double")).alias("frac_censored")).collect()
    at = {r["state"]: np.array([r["mu"], math.sqrt(0.7 * (r["v"] + 1e-3)), math.sqrt(0.3 * (r["v"] + 1e-3))]) for r in first}

    def expect(frames: Iterator[pd.DataFrame], at: dict) -> Iterator[pd.DataFrame]:
        for f in frames:
            for state, part in f.groupby("state"):
                mu, sigma, tau = at[state]
                sizes, m = part["y"].map(len).to_numpy(), part["m"].to_numpy(float)
                y, c = np.concatenate(part["y"].to_numpy()), np.concatenate(part["c"].to_numpy()).astype(bool)
                b = tau * points
                r = (y - mu - b[:, None]) / sigma
                tail = log_survival(r)
                ll = np.where(c, tail, -0.5 * math.log(2 * math.pi) - math.log(sigma) - 0.5 * r * r)
                begin = np.cumsum(sizes) - sizes
                post = prior[:, None] + np.add.reduceat(ll, begin, axis=1)
                peak = post.max(0)
                z = peak + np.log(np.exp(post - peak).sum(0))
                post = np.exp(post - z)
                lam = np.exp(-0.5 * math.log(2 * math.pi) - 0.5 * r * r - tail)
                seen = np.where(c, mu + b[:, None] + sigma * lam, y)
                square = np.where(c, sigma**2 * (1 + r * lam), (sigma * r) ** 2)
                each, w = np.repeat(post, sizes, 1), np.repeat(m, sizes)
                sums = [(w * (each * (seen - b[:, None])).sum(0)).sum(), (w * (each * square).sum(0)).sum(), (m * (b[:, None] ** 2 * post).sum(0)).sum(), w.sum(), m.sum(), (m * z).sum()]
                yield pd.DataFrame([[state, *map(float, sums)]], columns=["state", "s1", "s2", "s3", "n", "cells", "ll"])

    last: dict = {}
    for _ in range(max_iter):
        task = lambda frames, now=dict(at): expect(frames, now)
        sums = cells.mapInPandas(task, "state int, s1 double, s2 double, s3 double, n double, cells double, ll double")
        moved = 0.0
        for r in sums.groupBy("state").agg(*[F.sum(c).alias(c) for c in ("s1", "s2", "s3", "n", "cells", "ll")]).collect():
            new = np.array([r["s1"] / r["n"], np.clip(math.sqrt(max(r["s2"] / r["n"], 1e-9)), 0.05, 4.0), np.clip(math.sqrt(max(r["s3"] / r["cells"], 1e-9)), 1e-3, 4.0)])
            moved = max(moved, float(np.abs(new - at[r["state"]]).max()))
            at[r["state"]], last[r["state"]] = new, r
        if moved < tol:
            break
    cells.unpersist()
    out = []
    for r in first:
        mu, sigma, tau = map(float, at[r["state"]])
        ratio = sigma / LOG_SD_EXPONENTIAL
        verdict = "over-dispersed" if ratio >= 1.15 else "more regular" if ratio <= 0.87 else "memoryless"
        out.append((r["state"], mu, sigma, tau, tau**2 / (tau**2 + sigma**2), math.sqrt(math.expm1(min(sigma**2, 20.0))), math.sqrt(math.expm1(min(sigma**2 + tau**2, 20.0))), ratio, verdict, int(last[r["state"]]["cells"]), r["n"], r["frac_censored"]))
    return eps.sparkSession.createDataFrame(out, "state int, mu double, sigma_within double, tau_between double, icc double, within_cv double, pooled_cv double, over_exponential double, verdict string, n_tracks long, n_episodes long, frac_censored double")
