"""Models against refits and closed forms in NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrack import queries
from kinetrack.operators import models, ranks
from kinetrack.operators.order import fold_of


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2)) * [3, 0.2] + [5, -1]
    y = 2 * x[:, 0] - 10 * x[:, 1] + rng.normal(0, 0.5, 40)
    df = spark.createDataFrame([(f"r{k:02d}", float(a), float(b), float(c), k % 4) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id string, a double, b double, y double, f int").repartition(3).cache()
    return df, (x - x.mean(0)) / x.std(0), y


def test_ridge_leave_one_out(table):
    """Each row against a fit to the others, on features scaled by the others."""
    df, _, y = table
    x = np.array([(r.a, r.b) for r in sorted(df.collect())])
    for r in models.ridge_loo(df, ["a", "b"], "y", (0.5, 20.0)).collect():
        errors = []
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            m, sd = x[keep].mean(0), x[keep].std(0)
            z, t = (x[keep] - m) / sd, y[keep] - y[keep].mean()
            errors.append(abs(y[i] - y[keep].mean() - (x[i] - m) / sd @ np.linalg.solve(z.T @ z + r.alpha * np.eye(2), z.T @ t)))
        assert abs(r.mae - np.mean(errors)) < 1e-9
        assert abs(r.mae_mean - np.mean(np.abs(y - (y.sum() - y) / (len(y) - 1)))) < 1e-9
    assert models.ridge_loo(df.limit(2), ["a", "b"], "y").count() == 0


def test_ridge_folds(spark, table):
    df, _, y = table
    x = np.array([(r.a, r.b) for r in sorted(df.collect())])
    fold = np.arange(40) % 4
    for r in models.ridge_kfold(df, ["a", "b"], "y", F.col("f"), 1.0).collect():
        t = fold != r.fold
        z = (x - x[t].mean(0)) / x[t].std(0)
        w = np.linalg.solve(z[t].T @ z[t] + np.eye(2), z[t].T @ (y[t] - y[t].mean()))
        assert abs(r.mae - np.abs(y[~t] - y[t].mean() - z[~t] @ w).mean()) < 1e-6


def test_nested_leave_one_out(spark, table):
    """Every held-out row against fits that leave out one row at a time, inside and outside."""
    df, _, y = table
    x = np.array([(r.a, r.b) for r in sorted(df.collect())])
    small, alphas = df.filter("id < 'r12'"), (0.1, 10.0)
    got = {(r.id, r.design): r.predicted for r in models.nested_loo(small, ["a"], ["b"], "y", "id", alphas).collect()}
    x, y = x[:12], y[:12]

    def fit(z, t, alpha):
        return np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ t)

    for j in range(12):
        keep = [i for i in range(12) if i != j]
        slope, base = np.polyfit(x[keep, 0], x[keep, 1], 1)
        for design, full in (("A", x[:, :1]), ("B", x[:, 1:]), ("C", x), ("Bperp", (x[:, 1] - base - slope * x[:, 0])[:, None])):
            z, t = (full - full[keep].mean(0)) / full[keep].std(0), y - y[keep].mean()
            inner = []
            for alpha in alphas:
                # the shortcut keeps the training rows' scale and mean
                inv = np.linalg.inv(z[keep].T @ z[keep] + alpha * np.eye(z.shape[1]))
                inner.append(np.mean([abs((t[i] - z[i] @ fit(z[keep], t[keep], alpha)) / (1 - z[i] @ inv @ z[i])) for i in keep]))
            w = fit(z[keep], t[keep], alphas[int(np.argmin(inner))])
            assert got[f"r{j:02d}", design] == pytest.approx(z[j] @ w + y[keep].mean(), abs=1e-8)
    errors = {r.design: r for r in models.prediction_errors(models.nested_loo(df, ["a"], ["b"], "y", "id")).collect()}
    assert errors["C"].mae < errors["A"].mae < errors["A"].mae_mean and errors["C"].n == 40
    assert models.nested_loo(df.limit(2), ["a"], ["b"], "y", "id").count() == 0


def test_permutation_and_interval(table):
    df, _, y = table
    r = models.permutation_test(df, ["a", "b"], "y", "id", 60).first()
    assert r.r2 > 0.9 and r.null_mean < 0.2 and r.p == pytest.approx(1 / 61)
    b = models.bca_interval(df, "y", "id", 300).first()
    se = y.std(ddof=1) / math.sqrt(len(y))
    assert b.low < b.mean < b.high and abs((b.high - b.low) / (2 * 1.96 * se) - 1) < 0.25
    assert abs(models.normal_quantile(0.975) - 1.959964) < 1e-5


def test_markov_beside_hmm(spark):
    """On a planted two-state chain seen through noise, the hidden model beats the chain of order 1 on the same tokens."""
    rng = np.random.default_rng(8)
    rows = []
    for t in range(60):
        hidden = rng.integers(0, 2)
        for k in range(40):
            hidden = hidden if rng.random() < 0.95 else 1 - hidden
            rows.append(("v", t, k, int(rng.choice(3, p=(0.7, 0.2, 0.1) if hidden else (0.1, 0.2, 0.7)))))
    df = spark.createDataFrame(rows, "video string, track_id long, block int, state int")
    got = {(r.model, r.size): r for r in models.markov_and_hmm(df, (0, 1), (2,), index="block", restarts=2, iterations=25).collect()}
    assert got["hmm", 2].n_tokens == got["markov", 0].n_tokens == 2400 and got["markov", 1].n_tokens == 2340
    assert got["markov", 0].ll_per_token < got["markov", 1].ll_per_token < got["hmm", 2].ll_per_token


def test_permutation_is_a_bijection(spark):
    """Every key gives another order of all places, whatever their number, and places go everywhere about equally often."""
    for n in (1, 2, 3, 20, 97):
        told = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("rep")).select("rep", "id", ranks.permuted(F.col("id"), n, F.col("rep"), F.lit(0)).alias("to")).collect()
        orders = {}
        for r in sorted(told):
            orders.setdefault(r.rep, []).append(r.to)
        assert all(sorted(o) == list(range(n)) for o in orders.values())
        assert n < 20 or len(set(map(tuple, orders.values()))) == 40
    many = spark.range(6).select("id", F.explode(F.sequence(F.lit(1), F.lit(3000))).alias("rep")).select("id", ranks.permuted(F.col("id"), 6, F.col("rep"), F.lit(0)).alias("to"))
    table = np.zeros((6, 6))
    for r in many.groupBy("id", "to").count().collect():
        table[r.id, r.to] = r["count"]
    assert np.abs(table - 500).max() < 120  # about five standard deviations


def test_bootstrap_means(spark, table):
    df, _, y = table
    means = [r.m for r in models.bootstrap_means(df, "y", "id", 400).collect()]
    assert len(means) == 400 and abs(np.mean(means) - y.mean()) < 4 * y.std() / math.sqrt(40 * 400) and abs(np.std(means) / (y.std() / math.sqrt(40)) - 1) < 0.15
    assert models.bootstrap_means(df.limit(0), "y", "id", 5).count() == 0


def test_nested_blocks(spark, table, monkeypatch):
    """Blocks of rows change nothing."""
    df, _, _ = table
    whole = {(r.id, r.design): r.predicted for r in models.nested_loo(df, ["a"], ["b"], "y", "id").collect()}
    monkeypatch.setattr(models, "BLOCK", 3)
    parts = {(r.id, r.design): r.predicted for r in models.nested_loo(df.repartition(5), ["a"], ["b"], "y", "id").collect()}
    assert len(whole) == 160 and all(parts[k] == pytest.approx(v, abs=1e-9) for k, v in whole.items())


def test_mixture_and_forest(table):
    df, z, _ = table
    rows = {r.k: r for r in models.mixture_bic(df, ["a", "b"], (1, 2)).collect()}
    assert [r.best for r in rows.values()] == [True, False]
    cov = z.T @ z / len(z)
    assert abs(rows[1].log_likelihood + 0.5 * len(z) * (2 * math.log(2 * math.pi) + math.log(np.linalg.det(cov)) + 2)) < 1e-3
    assert rows[1].bic < rows[2].bic  # one cloud
    told = models.forest_regression(df.withColumn("a", F.when(F.col("id") != "r03", F.col("a"))), ["a", "b"], "y", ["id"], 4, 2, trees=10, leaf=2).collect()
    assert sorted((r["repeat"], r.n, r.folds) for r in told) == [(0, 40, 4), (1, 40, 4)] and max(r.mae for r in told) < 6
    one = models.forest_regression(df, ["a", "b"], "y", ["id"], 4, 1, trees=1, leaf=40).first()  # no split is allowed: the training rows' mean, or nearly
    assert one.mae == pytest.approx(np.abs(df.toPandas().y - df.toPandas().y.mean()).mean(), rel=0.2)


def test_concentration_and_hmm(spark):
    rng = np.random.default_rng(3)
    seqs = {}
    for t in range(40):
        p = rng.dirichlet(np.array([6.0, 3.0, 1.0]), 3)
        s = [0]
        for _ in range(80):
            s.append(int(rng.choice(3, p=p[s[-1]])))
        seqs[t] = s
    df = spark.createDataFrame([("v", t, k, s) for t, seq in seqs.items() for k, s in enumerate(seq)], "video string, track_id long, idx int, state int")
    got = {r.state: r.concentration for r in models.concentration(df).collect()}
    counts = {s: np.array([[sum(a == s and b == k for a, b in zip(q, q[1:])) for k in range(3)] for q in seqs.values()]) for s in range(3)}
    for s in range(3):
        base, c = (counts[s].sum(0) + 0.5) / (counts[s].sum() + 1.5), counts[s][counts[s].sum(1) > 0]
        ll = lambda a: sum(math.lgamma(a) - math.lgamma(a + r.sum()) + sum(math.lgamma(a * p + x) - math.lgamma(a * p) for p, x in zip(base, r)) for r in c)  # noqa: B023, E731
        assert ll(got[s]) >= max(ll(a) for a in np.geomspace(0.05, 1e5, 900)) - 1e-6
        for to in range(3):
            tails = [r.tracks for r in sorted(models.tail_counts(df).filter(f"state = {s} and to = {to}").collect(), key=lambda r: r.j)]
            assert tails == [int((c[:, to] > j).sum()) for j in range(c[:, to].max())]
    few = {r.state: r.concentration for r in models.concentration(df.filter("track_id < 4")).collect()}
    assert set(few.values()) == {math.inf}
    fold = {r.track_id: r.f for r in df.select("track_id", fold_of(("video", "track_id")).alias("f")).distinct().collect()}
    got = {r.hidden: r for r in models.hidden_markov(df, (1, 2), restarts=2, iterations=12).collect()}
    ll = n = 0
    for f in range(5):  # one hidden state: symbols drawn on their own
        p = np.bincount([x for t, q in seqs.items() if fold[t] != f for x in q], minlength=3) + 1e-9
        told = [x for t, q in seqs.items() if fold[t] == f for x in q]
        ll, n = ll + np.log(p / p.sum())[told].sum(), n + len(told)
    assert got[1].n_tokens == got[2].n_tokens == n and abs(got[1].heldout_ll_per_token - ll / n) < 1e-6
    assert got[2].train_ll_per_token > got[1].train_ll_per_token and (got[1].n_params, got[2].n_params) == (2, 7) and models.markov_parameters(2) == 18


def test_frailty(spark):
    """The estimate beats its neighbours in the marginal likelihood, which is integrated anew on a fine grid."""
    rng = np.random.default_rng(4)
    rows, cells = [], []
    for t in range(60):
        b, cell = rng.normal(0, 0.5), []
        for k in range(rng.integers(1, 9)):
            run, cut = max(1, int(round(50 * math.exp(-1 + b + rng.normal(0, 0.7))))), bool(rng.random() < 0.2)
            rows.append(("v", t, k, 0, run, cut))
            cell.append((math.log(run / 50), cut))
        cells.append(cell)
    eps = spark.createDataFrame(rows, "video string, track_id long, ep_idx int, state int, run long, censored boolean")
    r = models.frailty(eps).first()
    assert r.n_tracks == 60 and r.n_episodes == len(rows) and abs(r.icc - r.tau_between**2 / (r.tau_between**2 + r.sigma_within**2)) < 1e-12
    grid = np.linspace(-5, 5, 801)

    def likelihood(mu, sigma, tau):
        total = 0.0
        for cell in cells:
            f = np.exp(-0.5 * grid**2) / math.sqrt(2 * math.pi)
            for y, cut in cell:
                z = (y - mu - tau * grid) / sigma
                f = f * (np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z]) if cut else np.exp(-0.5 * z * z) / sigma / math.sqrt(2 * math.pi))
            total += math.log(f.sum() * (grid[1] - grid[0]))
        return total

    best = likelihood(r.mu, r.sigma_within, r.tau_between)
    for a, b, c in ((0.02, 0, 0), (-0.02, 0, 0), (0, 0.02, 0), (0, -0.02, 0), (0, 0, 0.03), (0, 0, -0.03)):
        assert best > likelihood(r.mu + a, r.sigma_within + b, r.tau_between + c)
    x = np.array([-8.0, -2.0, -0.1, 0.0, 0.5, 3.0, 9.0])
    assert np.allclose(models.log_survival(x), [math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in x], atol=1e-6)


def test_mixture_stability(spark):
    rng = np.random.default_rng(5)
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([rng.normal(m, 0.3, (60, 2)) for m in (0, 4)]))]
    df = spark.createDataFrame(points, "id long, a double, b double")
    assert all(r.ari > 0.95 for r in models.mixture_stability(df, ["a", "b"], ["id"], 2, 2).collect())
    assert [r.k for r in models.mixture_bic(df, ["a", "b"], (1, 2, 3)).filter("best").collect()] == [2]


def test_bootstrap_ties_round_up(spark, sf_dir, monkeypatch):
    """Means of 20 values with 3 decimals often end in a five at the fifth decimal, which summation noise must not push down."""
    import decimal
    import hashlib

    values = [decimal.Decimal(1000 + 137 * k * k % 7919) / 1000 for k in range(20)]
    monkeypatch.setattr(queries, "by_video", lambda s, d: s.createDataFrame([(f"{k:02d}", float(v)) for k, v in enumerate(values)], "video string, VCL double"))
    got = {r.rep: r.m for r in queries.QUERIES["M23_bootstrap_means"](spark, sf_dir).collect()}
    ties = 0
    for rep in range(1, 501):
        mean = sum(values[int(hashlib.md5(f"{rep}|{k}|0".encode()).hexdigest()[:8], 16) % 20] for k in range(20)) / 20
        ties += mean * 10000 % 1 == decimal.Decimal("0.5")
        assert got[rep] == float(mean.quantize(decimal.Decimal("0.0001"), decimal.ROUND_HALF_UP))
    assert ties > 10


def test_mixture_sums_side_by_side(spark, monkeypatch):
    rng = np.random.default_rng(3)
    fits = []
    for k in (1, 3, 4):
        cov = rng.normal(size=(k, 3, 3))
        fits.append((rng.dirichlet(np.ones(k)), rng.normal(size=(k, 3)), cov @ cov.transpose(0, 2, 1) + 1e-5 * np.eye(3)))
    x = rng.normal(size=(500, 3))
    told = models._products(x) @ models._stacked(fits)
    assert np.allclose(told, np.concatenate([models._log_parts(x, *m) for m in fits], 1), rtol=1e-7, atol=1e-6)
    # work a row, not bytes, decides how many tasks read the rows, and each returns one row a component
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double").coalesce(1)
    assert models.stored(models._spread(df)).rdd.getNumPartitions() >= 2
    z = models._scaled(df, ["a", "b"])
    starts = [(k, s, None) for k in (1, 2, 3) for s in (1, 2)]
    whole = models.mixtures(z, ["a", "b"], starts, 5)
    monkeypatch.setattr(models, "ROWS", 7)
    for (m, ll), (again, ll2) in zip(whole, models.mixtures(z.repartition(3), ["a", "b"], starts, 5), strict=True):
        assert ll == pytest.approx(ll2, rel=1e-9) and np.allclose(m[1], again[1], atol=1e-6)
