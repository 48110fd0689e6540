"""Trajectory operators against hand-made tracks, naive loops and invariants."""

import glob
import math
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetrack import fixtures, oracles, queries
from kinetrack.functions import scalar
from kinetrack.operators import association, episodes, features, kinematics, laws, order, serial, states, summary
from kinetrack.sources import files

TRACK = "video string, track_id long, frame int, cx double, cy double, conf double"
PPM, FPS = 1.422, 50


def frame_of(spark, tracks, conf=0.9):
    return spark.createDataFrame([("v", t, k, float(x), float(y), conf) for t, pts in tracks.items() for k, (x, y) in enumerate(pts)], TRACK)


def reflect_smooth(x, size=5):
    p = np.concatenate([x[:2][::-1], x, x[-2:][::-1]])
    return np.convolve(p, np.ones(size) / size, "valid")


def naive_metrics(x, y):
    n, dt = len(x), 1 / FPS
    sx, sy = reflect_smooth(x), reflect_smooth(y)
    vcl = np.hypot(np.diff(x), np.diff(y)).mean() / PPM / dt
    vsl = math.hypot(x[-1] - x[0], y[-1] - y[0]) / PPM / ((n - 1) * dt)
    vap = np.hypot(np.diff(sx), np.diff(sy)).mean() / PPM / dt
    side = np.sign(np.round(x[:-1] - sx[:-1], 9))
    return vcl, vsl, vap, np.hypot(x - sx, y - sy)[:-1].mean() / PPM, (np.diff(side) != 0).sum() / ((n - 1) * dt)


def naive_state(x, y):
    if len(x) < 3:
        return 2
    sx, sy = reflect_smooth(x), reflect_smooth(y)
    vcl = np.hypot(np.diff(x), np.diff(y)).mean() / PPM * FPS
    path = np.hypot(np.diff(sx), np.diff(sy)).sum()
    s = math.hypot(x[-1] - x[0], y[-1] - y[0]) / path if path > 0 else 0
    return 2 if vcl <= 5 else 0 if vcl >= 25 and s >= 0.5 else 1


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(1)
    return {t: np.cumsum(rng.normal(0, 0.05 * 2 ** (t % 6), (n, 2)) + (t % 3) * 0.4, 0) + 300 for t, n in enumerate([10, 12, 24, 25, 26, 40, 60, 90, 9, 3])}


def test_track_metrics(spark, walks):
    got = {r.track_id: r for r in kinematics.track_metrics(frame_of(spark, walks)).collect()}
    assert set(got) == {t for t, p in walks.items() if len(p) >= 10}
    for t, r in got.items():
        vcl, vsl, vap, alh, bcf = naive_metrics(*walks[t].T)
        assert np.allclose([r.VCL, r.VSL, r.VAP, r.ALH, r.BCF], [vcl, vsl, vap, alh, bcf], atol=0.0051)
        assert abs(r.LIN - vsl / vcl) < 6e-4 and abs(r.STR - vsl / vap) < 6e-4


def test_classes_of_plain_tracks(spark):
    tracks = {1: [(100, 100)] * 30, 2: [(5 * k, 100) for k in range(30)], 3: [(100 + k % 2, 100) for k in range(30)]}
    got = {r.track_id: r.motility for r in kinematics.judged_tracks(frame_of(spark, tracks)).collect()}
    assert got == {1: "immotile", 2: "progressive", 3: "non_progressive"}
    rows = spark.createDataFrame([(2.0, 0.9), (50.0, 0.8), (50.0, 0.2), (15.0, 0.9), (5.0, 1.0)], "v double, s double")
    assert [r[0] for r in rows.select(scalar.motility(F.col("v"), F.col("s"))).collect()] == ["immotile", "progressive", "non_progressive", "non_progressive", "immotile"]


def test_filters_in_order(spark):
    far = {1: [(900 * (k % 2), 0) for k in range(30)]}
    assert kinematics.judged_tracks(frame_of(spark, far, 0.3)).first().reason == "low_conf"
    assert kinematics.judged_tracks(frame_of(spark, far)).first().reason == "high_vcl"
    jitter = {1: [(2 * (k % 2), 0) for k in range(31)]}
    assert kinematics.judged_tracks(frame_of(spark, jitter)).first().reason == "jitter"
    assert kinematics.judged_tracks(frame_of(spark, {1: [(k, 0) for k in range(12)]})).first().reason == "short_duration"


@pytest.mark.parametrize("window", [9, 25])
def test_frame_states(spark, walks, window):
    h = window // 2
    got = {(r.track_id, r.frame): r.state for r in states.frame_states(frame_of(spark, walks), window).collect()}
    want = {}
    for t, p in walks.items():
        for k in range(len(p)) if len(p) >= 10 else []:
            a, b = (max(0, k - h), min(len(p), k + h + 1)) if len(p) >= window else (0, len(p))
            want[t, k] = naive_state(*p[a:b].T)
    assert got == want and len(set(want.values())) == 3


def test_block_and_modal_states(spark, walks):
    df = frame_of(spark, walks)
    got = {(r.track_id, r.block): r.state for r in states.block_states(df, 9).collect()}
    assert got == {(t, b): naive_state(*p[9 * b : 9 * b + 9].T) for t, p in walks.items() if len(p) // 9 >= 3 for b in range(len(p) // 9)}
    seq = {}
    for r in sorted(states.frame_states(df, 9).collect(), key=lambda r: (r.track_id, r.idx)):
        seq.setdefault(r.track_id, []).append(r.state)
    modal = {(r.track_id, r.block): r.state for r in states.modal_blocks(states.frame_states(df, 9), 7).collect()}
    assert modal == {(t, b): int(np.bincount(s[7 * b : 7 * b + 7], minlength=3).argmax()) for t, s in seq.items() if len(s) // 7 >= 2 for b in range(len(s) // 7)}


def test_temporal_windows_with_gaps(spark, walks):
    rng = random.Random(2)
    rows = [("v", t, f, float(x), float(y), 0.9) for t, p in walks.items() for f, (x, y) in zip(sorted(rng.sample(range(150), len(p))), p, strict=True)]
    df = spark.createDataFrame(rows, TRACK)
    state = {(r.track_id, r.frame): r.state for r in states.frame_states(df).collect()}
    n_windows, want = max(1, max(r[2] for r in rows) // 21), {}
    for w in range(n_windows):
        lo, hi = w * 21, w * 21 + 21
        for t in {k[0] for k in state}:
            fs = sorted(f for k, f in state if k == t)
            if fs[-1] >= lo and fs[0] < hi:
                at = next((f for f in fs if f >= (lo + hi) // 2), fs[-1])
                want.setdefault(w + 1, [0, 0, 0])[state[t, at]] += 1
    got = {r.window: [r.n_progressive, r.n_non_progressive, r.n_immotile] for r in states.temporal_windows(df, 21).collect()}
    assert got == want


def sequences(spark, seqs):
    return spark.createDataFrame([("v%d" % (t % 4), t, k, k, s) for t, seq in seqs.items() for k, s in enumerate(seq)], "video string, track_id long, frame int, idx int, state int")


@pytest.fixture(scope="module")
def seqs():
    rng = random.Random(4)
    out = {}
    for t in range(60):
        s, seq = rng.randrange(3), []
        while len(seq) < rng.randrange(5, 120):
            seq += [s] * rng.choice([1, 1, 2, 3, 8, 15])
            s = rng.choice([x for x in range(3) if x != s])
        out[t] = seq
    return out


def runs_of(seq):
    out = []
    for s in seq:
        if out and out[-1][0] == s:
            out[-1][1] += 1
        else:
            out.append([s, 1])
    return [tuple(x) for x in out]


def test_episodes(spark, seqs):
    got = {}
    for r in sorted(episodes.episodes(sequences(spark, seqs)).collect(), key=lambda r: (r.track_id, r.ep_idx)):
        got.setdefault(r.track_id, []).append((r.state, r.run))
        assert r.censored == (r.ep_idx in (0, r.n_eps - 1))
    assert got == {t: runs_of(s) for t, s in seqs.items()}


def test_flicker_merge(spark, seqs):
    def settled(eps, thr):
        """The leftmost short run between two of one state joins them; then the same for what that gives."""
        at = next((k for k, (head, mid, tail) in enumerate(zip(eps, eps[1:], eps[2:])) if head[0] == tail[0] and mid[1] <= thr), None)
        return eps if at is None else settled([*eps[:at], (eps[at][0], sum(n for _, n in eps[at : at + 3])), *eps[at + 3 :]], thr)

    for thr in (1, 2, 8):
        got = {}
        for r in sorted(episodes.merge_flickers(episodes.episodes(sequences(spark, seqs)), thr).collect(), key=lambda r: (r.track_id, r.ep_idx)):
            got.setdefault(r.track_id, []).append((r.state, r.run))
        assert got == {t: settled(runs_of(s), thr) for t, s in seqs.items()}


def test_hysteresis(spark):
    rng = np.random.default_rng(5)
    v, s = rng.uniform(3, 30, 200), rng.uniform(0.3, 0.7, 200)
    df = spark.createDataFrame([("v", 1, k, k, float(a), float(b)) for k, (a, b) in enumerate(zip(v, s, strict=True))], "video string, track_id long, frame int, idx int, vcl double, straightness double")
    m, want = 0.1, []
    for a, b in zip(v, s, strict=True):
        fast = a >= 25 * (1 + m) and b >= 0.5 * (1 + m)
        if not want:
            want.append(2 if a <= 5 else 0 if a >= 25 and b >= 0.5 else 1)
        elif want[-1] == 2:
            want.append((0 if fast else 1) if a > 5 * (1 + m) else 2)
        elif want[-1] == 0:
            want.append(2 if a <= 5 * (1 - m) else 1 if a < 25 * (1 - m) or b < 0.5 * (1 - m) else 0)
        else:
            want.append(2 if a <= 5 * (1 - m) else 0 if fast else 1)
    assert [r.state for r in episodes.hysteresis_states(df, m).orderBy("idx").collect()] == want


def test_transitions_and_stationary(spark, seqs):
    counts = episodes.transition_counts(sequences(spark, seqs))
    n = episodes.matrix_of(counts.collect())
    want = np.zeros((3, 3))
    for s in seqs.values():
        np.add.at(want, (s[:-1], s[1:]), 1)
    assert (n == want).all() and n.sum() == sum(len(s) - 1 for s in seqs.values())
    p = n / n.sum(1, keepdims=True)
    w, vec = np.linalg.eig(p.T)
    pi = np.real(vec[:, np.argmax(np.real(w))])
    got = [r.pi for r in episodes.stationary(episodes.transition_probabilities(counts)).orderBy("state").collect()]
    assert np.allclose(got, pi / pi.sum())


def test_fano_counts_empty_windows(spark, seqs):
    got = {r["T"]: (r.fano, r.n_tracks) for r in episodes.fano(episodes.episodes(sequences(spark, seqs)), (0.125, 0.25), min_tracks=1).collect()}
    for T in (0.125, 0.25):
        f = []
        for s in seqs.values():
            n = int(len(s) / FPS // T)
            at = np.cumsum([r for _, r in runs_of(s)])[:-1] / FPS
            c = np.array([((at // T) == w).sum() for w in range(n)])
            if n >= 4 and c.sum():
                f.append(c.var(ddof=1) / c.mean())
        assert got[T][1] == len(f) and abs(got[T][0] - np.median(f)) < 1e-9


def test_order_test(spark, seqs):
    df = sequences(spark, seqs).withColumn("fold", order.fold_of())
    fold = {r.track_id: r.fold for r in df.select("track_id", "fold").distinct().collect()}
    got = {r.order: (r.ll_per_token, r.n_tokens) for r in order.order_test(df).collect()}
    for k in range(4):
        ll = n = 0
        for test in range(5):
            tab, g = {}, np.full(3, 0.5)
            for t, s in seqs.items():
                if fold[t] != test:
                    g += np.bincount(s, minlength=3)
                    for i in range(k, len(s)):
                        tab.setdefault(tuple(s[i - k : i]), np.full(3, 0.5))[s[i]] += 1
            for t, s in seqs.items():
                for i in range(k, len(s)) if fold[t] == test else []:
                    c = tab.get(tuple(s[i - k : i]), g)
                    ll, n = ll + math.log(c[s[i]] / c.sum() + 1e-12), n + 1
        assert got[k][1] == n and abs(got[k][0] - ll / n) < 1e-9
    rng = random.Random(6)
    iid = order.order_gains(order.order_test(sequences(spark, {t: [rng.randrange(3) for _ in range(300)] for t in range(20)}))).collect()
    assert all(abs(r.gain) < 0.02 for r in iid)


def test_laws_recover_parameters(spark):
    rng = np.random.default_rng(7)
    x = np.maximum(1, np.round(rng.gamma(3, 40, 4000))).astype(int)
    k, theta, _ = laws.fit_gamma(x.astype(float), np.ones(len(x)))
    assert abs(k - 3) < 0.2 and abs(theta - 40) < 3
    w, lam, _ = laws.fit_weibull(rng.weibull(1.7, 4000) * 20, np.ones(4000))
    assert abs(w - 1.7) < 0.08 and abs(lam - 20) < 0.8
    e = np.maximum(1, np.round(rng.exponential(400, 5000))).astype(int)
    h = spark.createDataFrame(pd.DataFrame({"state": 0, "run": e})).groupBy("state", "run").agg(F.count("*").alias("n"))
    aic = {r.law: r.aic for r in laws.dwell_laws(h).collect()}
    assert aic["exponential"] <= min(aic.values()) + 2.5 and aic["lognormal"] > aic["exponential"] + 100
    assert abs(laws.digamma(1.0) + 0.5772156649) < 1e-9 and abs(laws.trigamma(1.0) - math.pi**2 / 6) < 1e-9


def rank(x):
    x = np.round(x, 9)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_spearman_with_ties_and_weights(spark):
    rng = np.random.default_rng(8)
    x, y, w = rng.integers(0, 6, 80), rng.integers(0, 6, 80), rng.integers(1, 4, 80)
    df = spark.createDataFrame([(int(k % 2), float(a), float(b), int(c)) for k, (a, b, c) in enumerate(zip(x, y, w, strict=True))], "g int, x double, y double, w long")
    got = {r.g: r.rho for r in serial.spearman(df, ["g"]).collect()}
    for g in (0, 1):
        assert abs(got[g] - np.corrcoef(rank(x[g::2]), rank(y[g::2]))[0, 1]) < 1e-9
    heavy = serial.weighted_spearman(df.withColumn("one", F.lit(1)), ["one"], "w").first()
    assert abs(heavy.rho - np.corrcoef(rank(np.repeat(x, w)), rank(np.repeat(y, w)))[0, 1]) < 1e-9 and heavy.n == w.sum()


def test_permutation_and_bootstrap(spark, seqs):
    resid = serial.residuals(episodes.episodes(sequences(spark, seqs)))
    tracks = {}
    for r in sorted(resid.collect(), key=lambda r: (r.track_id, r.ep_idx)):
        tracks.setdefault((r.video, r.track_id), []).append(round(r.resid, 9))
    counts = serial.pair_counts(resid, 6, 2)
    got = {}
    for r in counts.collect():
        got.setdefault((r.perm, r.lag), {})[r.video, r.x, r.y] = r.c
    want = {lag: pd.Series([(t[0], x, y) for t, v in tracks.items() for x, y in zip(v, v[lag:])]).value_counts().to_dict() for lag in (1, 2)}
    assert {lag: got[0, lag] for lag in (1, 2)} == want
    assert set(got) == {(p, lag) for p in range(7) for lag in (1, 2)} and len({str(sorted(got[p, 1].items())) for p in range(7)}) == 7
    for p in range(1, 7):  # an order of the same values: as many pairs
        assert sum(got[p, 1].values()) == sum(want[1].values()) and {x for _, x, _ in got[p, 1]} <= {x for v in tracks.values() for x in v}
    assert sorted(counts.collect()) == sorted(serial.pair_counts(resid.repartition(7), 6, 2).collect())
    pairs = [(x, y) for (_, x, y), c in want[1].items() for _ in range(c)]
    null = serial.permutation_null(resid, 20).first()
    assert abs(null.observed - np.corrcoef(rank([x for x, _ in pairs]), rank([y for _, y in pairs]))[0, 1]) < 1e-9
    assert null.n == len(pairs) and 0 <= null.p <= 1 and abs(null.delta - (null.observed - null.null_mean)) < 1e-12
    draws = serial.resampled_videos(resid, 30).groupBy("rep").agg(F.count("*").alias("m"), F.count_distinct("slot").alias("s")).collect()
    assert len(draws) == 30 and {(r.m, r.s) for r in draws} == {(4, 4)}
    b = serial.interval(serial.bootstrap_deltas(serial.pair_counts(resid, 8), 20)).first()
    assert b.low <= b.median <= b.high and b.n_reps == 20
    one = serial.bootstrap_deltas(serial.pair_counts(resid, 8), 10)
    same = serial.cohort_difference(one, one).first()
    assert same.low == same.high == 0 and same.p_positive == 1
    loo = {r.left_out: r.rho for r in serial.leave_one_out(serial.pair_counts(resid)).collect()}
    for video, rho in loo.items():
        rest = [(x, y) for (v, x, y), c in want[1].items() if v != video for _ in range(c)]
        assert abs(rho - np.corrcoef(rank([x for x, _ in rest]), rank([y for _, y in rest]))[0, 1]) < 1e-9
    t = serial.wild_bootstrap_t(spark.createDataFrame([(f"v{k}", 1.0 + k / 100) for k in range(12)], "video string, delta double"), 200).first()
    assert t.p == pytest.approx(1 / 201, abs=0.02) and t.low < t.mean < t.high and abs(t.t - t.mean / t.se) < 1e-9
    profile = {r.lag: r for r in serial.scc_profile(resid, 2, perms=5).collect()}
    assert all(profile[k].n == sum(want[k].values()) for k in profile)


def test_pair_counts_in_blocks(spark, seqs, monkeypatch):
    """Blocks of a few episodes give the same orders and counts; shuffles differ between tracks, perms and seeds."""
    resid = serial.residuals(episodes.episodes(sequences(spark, seqs)))
    whole = sorted(serial.pair_counts(resid, 3, 2).collect())
    monkeypatch.setattr(serial, "EPISODES_HELD", 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert sorted(serial.pair_counts(resid, 3, 2).collect()) == whole
        assert sorted(serial.pair_counts(resid, 3, 2, seed=1).collect()) != whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert serial.pair_counts(resid.limit(0), 3, 2).count() == 0


def chains(rng, n, phi=0.35, length=16):
    out = np.zeros((n, length))
    out[:, 0] = rng.normal(size=n)
    for k in range(1, length):
        out[:, k] = phi * out[:, k - 1] + np.sqrt(1 - phi**2) * rng.normal(size=n)
    return out.round(2)


def test_interval_covers_known_correlation(spark):
    """Bootstrap intervals of the memory of simulated chains hold its true value about as often as they say."""
    rng = np.random.default_rng(12)
    spearman = lambda v: np.corrcoef(rank(v[:, :-1].ravel().tolist()), rank(v[:, 1:].ravel().tolist()))[0, 1]
    small = chains(rng, 800)
    truth = spearman(small) - np.mean([spearman(rng.permuted(small, axis=1)) for _ in range(3)])
    inside = 0
    for seed in range(5):
        rows = [(f"{k % 24:02d}", k, i, float(x)) for k, v in enumerate(chains(rng, 96)) for i, x in enumerate(v)]
        counts = serial.pair_counts(spark.createDataFrame(rows, "video string, track_id long, ep_idx int, resid double"), 20, 1, seed=seed)
        told = serial.interval(serial.bootstrap_deltas(counts, 60, seed=seed)).first()
        inside += told.low <= truth <= told.high
        assert 0.05 < told.high - told.low < 0.3
    assert inside >= 4


def test_greedy_matches(spark):
    rng = np.random.default_rng(9)
    gt = [("v", t, f, float(x), float(y), 1.0) for f in range(6) for t, (x, y) in enumerate(rng.uniform(-40, 40, (25, 2)))]
    pr = [("v", t, f, float(x), float(y), 1.0) for f in range(6) for t, (x, y) in enumerate(rng.uniform(-40, 40, (30, 2)))]

    def iou(a, b):
        w, h = max(0, 16 - abs(a[3] - b[3])), max(0, 16 - abs(a[4] - b[4]))
        return round(w * h / (512 - w * h), 9)

    want = []
    for f in range(6):
        used = set()
        for a in sorted(x for x in gt if x[2] == f):
            best = max(((iou(a, b), -b[1]) for b in pr if b[2] == f and b[1] not in used), default=(0, 0))
            if best[0] >= 0.5:
                used.add(-best[1])
                want.append((f, a[1], -best[1]))
    got = association.greedy_matches(association.candidates(spark.createDataFrame(gt, TRACK), spark.createDataFrame(pr, TRACK))).collect()
    assert sorted((r.frame, r.gt, r.pred) for r in got) == sorted(want) and len(want) > 10


def test_candidates_without_join(spark):
    rng = np.random.default_rng(8)

    def boxes(n, off):
        # a pile of more pairs than are measured at a time, boxes on both sides of cell borders, ids that stand twice or are null, odd places
        pile = [("a", t, 0, 320 + int(x) / 1000 + off, 240 + int(y) / 1000, 1.0) for t, (x, y) in enumerate(rng.integers(-4000, 4000, (n, 2)))]
        wide = [("b", t % 50, f, float(x), float(y), 1.0) for f in range(2) for t, (x, y) in enumerate(rng.uniform(-70, 70, (n, 2)))]
        return [*pile, *wide, ("b", None, 0, 64.0, -64.0, 1.0), ("c", 1, 3, 5.0, 5.0, 1.0), ("c", 2, 3, None, 5.0, 1.0), ("c", 3, 3, float("nan"), 5.0, 1.0), ("c", 4, None, 5.0, 5.0, 1.0), ("d", 1, int(off), 5.0, 5.0, 1.0)]

    gt, pr = (spark.createDataFrame(boxes(*x), TRACK) for x in ((300, 0.0), (320, 1.0)))
    w, h = (F.greatest(F.lit(0.0), F.least(f"a.{c}", f"b.{c}") + 8 - (F.greatest(f"a.{c}", f"b.{c}") - 8)) for c in ("cx", "cy"))
    told = gt.alias("a").join(pr.alias("b"), ["video", "frame"]).filter("abs(a.cx) < 1e9 and abs(b.cx) < 1e9")
    every = told.select("video", "frame", F.col("a.track_id").alias("gt"), F.col("b.track_id").alias("pred"), F.round(w * h / (512 - w * h), 9).alias("iou"))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for least in (0.5, 0.8, 0.1):
        got = association.candidates(gt, pr, least)
        want = sorted(map(tuple, every.filter(F.col("iou") >= least).collect()), key=key)
        assert sorted(map(tuple, got.collect()), key=key) == want
        if least < 0.5:
            assert len(want) > association.PAIRS_HELD
        assert sorted(map(tuple, association.candidates(gt, pr, least, 16.0).collect()), key=key) == want
    # pairs are no rows of a join: what is shuffled are boxes, a truth box once
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert association.candidates(gt.limit(0), pr).count() == association.candidates(gt, pr.limit(0)).count() == 0
    v = np.concatenate([(2 * rng.integers(0, 5 * 10**8, 500) + 1) / 2e9, rng.uniform(0, 1, 500), [0.0, 0.4999999995, 1.0]])
    rounded = [r.x for r in spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "k int, x double").select("k", F.round("x", 9).alias("x")).orderBy("k").collect()]
    assert association._nine(v).tolist() == rounded


def test_overlap_as_in_sql(spark):
    # places of 6 x sf0.1 where edges taken from each other give no area of 256: the ninth decimal was another than that of SQL
    met = [(373.94, 249.066, 374.574, 248.966, 0.912727333), (370.902, 248.934, 372.256, 249.876, 0.756670093), (362.762, 250.056, 365.4, 247.012, 0.510850706), (364.116, 249.59, 364.216, 248.956, 0.912727333), (376.84000000000003, 251.796, 377.402, 249.42, 0.697203692)]
    gt, pr = (spark.createDataFrame([("v", 1, f, x[k], x[k + 1], 1.0) for f, x in enumerate(met)], TRACK) for k in (0, 2))
    want = [(f, x[4]) for f, x in enumerate(met)]
    assert sorted((r.frame, r.iou) for r in association.candidates(gt, pr).collect()) == want
    assert sorted((r.frame, r.iou) for r in association.greedy(gt, pr).collect()) == want
    a, b = (",".join(f"({f}, {x[k]!r}::DOUBLE, {x[k + 1]!r}::DOUBLE)" for f, x in enumerate(met)) for k in (0, 2))
    sql = f"SELECT a.frame, round({queries.IOU} / (512 - {queries.IOU}), 9) FROM (VALUES {a}) a(frame, cx, cy) JOIN (VALUES {b}) b(frame, cx, cy) ON a.frame = b.frame ORDER BY 1"
    assert duckdb.sql(sql).fetchall() == want


def test_greedy_without_candidates(spark):
    rng = np.random.default_rng(4)

    def boxes(n, off):
        # piles with boxes at one place, ids that stand twice, boxes far apart, and a frame that only one side has
        near = [("a", int(t), 0, float(320 + x / 100 + off), float(240 + y / 100 - off), 1.0) for t, (x, y) in zip(rng.integers(0, n, n), rng.integers(-4, 5, (n, 2)))]
        wide = [("b", t, f, float(x), float(y), 1.0) for f in range(3) for t, (x, y) in enumerate(rng.uniform(-90, 90, (n, 2)))]
        return [*near, *wide, ("c", 1, int(off), 5.0, 5.0, 1.0), ("a", None, 0, 320.0, 240.0, 1.0)]

    gt, pr = (spark.createDataFrame(boxes(*x), TRACK) for x in ((300, 0.0), (350, 1.0)))
    want = association.greedy_matches(association.candidates(gt.filter("track_id is not null"), pr.filter("track_id is not null")))
    got = association.greedy(gt, pr)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 300
    assert sorted(association.greedy(gt.repartition(7), pr).collect()) == sorted(got.collect())
    told = association.greedy_matches(association.candidates(gt.filter("track_id is not null"), pr.filter("track_id is not null"), 0.7))
    assert sorted(association.greedy(gt, pr, 0.7).collect()) == sorted(told.collect())
    assert association.greedy(gt.limit(0), pr).count() == association.greedy(gt, pr.limit(0)).count() == 0
    # 4 x 2,000 boxes on one spot are 16 million pairs: none of them is joined
    pile = spark.range(8000).selectExpr("'v' as video", "id as track_id", "cast(0 as int) as frame", "320 + (id * 7919 % 101) / 1000D as cx", "240 + (id * 104729 % 97) / 1000D as cy", "1D as conf")
    assert "Join" not in association.greedy(pile, pile)._jdf.queryExecution().optimizedPlan().toString()
    assert association.tracking_quality(pile.filter("track_id < 2000"), pile).first().coverage == 1.0


def test_greedy_over_batches(spark):
    rows = spark.range(30).selectExpr("'v' as video", "id as track_id", "explode(sequence(0, 9)) as frame", "100D * id as cx", "0D as cy", "1D as conf").withColumn("frame", F.col("frame").cast("int"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted((r.frame, r.gt, r.pred) for r in association.greedy(rows, rows).collect()) == sorted((f, t, t) for f in range(10) for t in range(30))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_order_test_of_groups(spark, seqs):
    st = spark.createDataFrame([(t % 2, "v", t, k, s) for t, seq in seqs.items() for k, s in enumerate(seq)], "cohort int, video string, track_id long, idx int, state int")
    told = {(r.cohort, r.order): (r.ll_per_token, r.n_tokens) for r in order.order_test(st, by=["cohort"]).collect()}
    for g in (0, 1):
        for r in order.order_test(st.filter(F.col("cohort") == g)).collect():
            assert told[g, r.order] == (pytest.approx(r.ll_per_token, abs=1e-12), r.n_tokens)
    assert order.order_gains(order.order_test(st, by=["cohort"]), ["cohort"]).count() == 6


def test_summary_invariants(spark, sf_dir):
    rows = queries.QUERIES["A06_video_summary"](spark, sf_dir).collect()
    for r in rows:
        assert r.progressive + r.non_progressive + r.immotile == r.total_tracks
        assert r.tracks_before_filter == r.total_tracks + r.filtered_low_conf + r.filtered_high_vcl + r.filtered_jitter + r.filtered_short_duration
        if r.total_tracks:
            assert abs(r.progressive_pct + r.non_progressive_pct + r.immotile_pct - 100) <= 0.5
    assert kinematics.track_metrics(spark.createDataFrame([], TRACK)).count() == 0
    assert summary.video_summary(spark.createDataFrame([], TRACK)).count() == 0


def test_multiplicity_and_gini(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = features.benjamini_hochberg(features.holm(spark.createDataFrame([(x,) for x in p], "p double")))
    got = {round(r.p, 3): (round(r.holm, 6), round(r.bh, 6)) for r in df.collect()}
    assert got == {0.005: (0.02, 0.02), 0.01: (0.03, 0.02), 0.03: (0.06, 0.04), 0.04: (0.06, 0.04)}
    g = features.gini(spark.createDataFrame([("a", float(x)) for x in (1, 1, 2, 4)] + [("z", 0.0)], "v string, x double"), "x", ["v"])
    x = np.array([1, 1, 2, 4.0])
    assert {r.v: round(r.gini, 9) for r in g.collect()} == {"a": round(float((2 * np.arange(1, 5) - 5) @ x / (4 * x.sum())), 9), "z": 0.0}


def test_file_sources(spark, tmp_path):
    head = "track_id,frame,cx,cy,x1,y1,x2,y2,conf\n"
    for name in ("12_tracks.csv", "12_botsort_reid_tracks.csv", "7_bytetrack_tracks.csv", "notes.csv"):
        (tmp_path / name).write_text(head + "1,0,1.5,2.5,0,0,3,5,0.9\n1,1,2.5,2.5,0,0,3,5,0.9\n")
    df = files.read_tracks(spark, str(tmp_path))
    assert sorted({(r.video, r.tracker) for r in df.collect()}) == [("12", "botsort_reid"), ("12", "plain"), ("7", "bytetrack")]
    assert files.read_tracks(spark, str(tmp_path), plain_only=True).count() == 2
    assert files.validated(df).first().n_rows == 6
    with pytest.raises(ValueError):
        files.validated(df.drop("cx"))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "v1_frame_2_with_ftid.txt").write_text("b 0 0.5 0.5 0.1 0.2\nshort 1\n")
    (tmp_path / "a" / "v1_frame_1_with_ftid.txt").write_text("c 0 0.25 0.5 0.1 0.2\nb 0 0.5 0.25 0.1 0.2")
    got = files.parse_annotations(files.read_annotation_texts(spark, str(tmp_path / "a"))).orderBy("frame", "track_id").collect()
    assert [(r.track_id, r.frame, r.cx, r.cy, round(r.x1, 6)) for r in got] == [(1, 1, 160.0, 240.0, 128.0), (2, 1, 320.0, 120.0, 288.0), (2, 2, 320.0, 240.0, 288.0)]
    js = spark.createDataFrame([('[{"frame": 1, "x": 1.0, "y": 2.0, "w": 3.0, "h": 4.0}]',), ('{"frames": [{"frame_id": 5, "objects": [{"bbox_x": 7.0, "bbox_y": 8.0, "width": 9.0, "height": 1.0}]}]}',)], "value string")
    assert sorted(map(tuple, files.parse_json_annotations(js).collect())) == [(1, 1.0, 2.0, 3.0, 4.0), (5, 7.0, 8.0, 9.0, 1.0)]
    (tmp_path / "c.csv").write_text(" ID ; DFI (%) ;Age\n 1 ;12,5;x\n2;;30\n")
    rows = files.read_decimal_comma(spark, str(tmp_path / "c.csv"), "ID")
    assert [tuple(r) for r in rows.orderBy("ID").collect()] == [("1", 12.5, None), ("2", None, 30.0)]
    assert files.pick_column(rows, "dfi") == "DFI (%)"
    with pytest.raises(KeyError):
        files.pick_column(rows, "nothing")
    alias = files.by_alias(spark.createDataFrame([(3, 1.0, 2.0)], "Frame_ID int, left double, top double"))
    assert tuple(alias.first()) == (3.0, 1.0, 2.0, 0.0, 0.0)
    out = str(tmp_path / "out")
    files.write_table(df, out, by=["video"])
    files.write_table(df.filter("video = '7'").limit(1), out, by=["video"])
    assert spark.read.parquet(out).count() == 5


ORACLE_SAMPLE = ["A06_video_summary", "A12_threshold_sweep", "W12_frame_states", "W15_temporal_windows", "W16_episodes", "A20_geometric_test", "A22_icc", "M06_order_test", "W24_spearman_by_lag", "A28_sample_features", "W33_ar2_fit", "J07_iou_candidates", "S05_annotation_tracks", "A36_partition_agreement"]


@pytest.mark.parametrize("name", ORACLE_SAMPLE if not os.environ.get("ALL_ORACLES") else sorted(queries.ORACLES))
def test_against_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    a, b = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    a, b = (x[cols].astype(object).where(x[cols].notna(), None).astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


def test_heatmap_has_every_window(spark, sf_dir):
    long = {(r.video, r.window): r.pct_progressive for r in queries.QUERIES["W15_temporal_windows"](spark, sf_dir).collect()}
    assert max(w for _, w in long) > 3
    wide = queries.plain(states.wide_heatmap(queries.windows(spark, sf_dir)))
    assert wide.columns == ["video", *map(str, sorted({w for _, w in long}))]
    cells = {(r.video, int(c)): r[c] for r in wide.collect() for c in wide.columns[1:]}
    assert {k: v for k, v in cells.items() if v is not None} == long
    assert {(r.video, r.window): r.pct_progressive for r in queries.QUERIES["A37_video_by_window"](spark, sf_dir).collect()} == cells


def test_grid_has_the_range_of_the_survey(spark, sf_dir):
    """10 to 55 by 5, 0.40 to 0.90 by 0.05, 2 to 14; each combination counts the tracks."""
    want = [(float(v), s / 100, float(i)) for v in range(10, 60, 5) for s in range(40, 95, 5) for i in range(2, 15)]
    got = {r.combo: (r.vcl_prog, r.str_prog, r.vcl_imm) for r in queries.QUERIES["A12_threshold_sweep"](spark, sf_dir).collect()}
    assert got == dict(enumerate(want))
    kept = [(r.VCL, r.STR) for r in queries.kept(spark, sf_dir).collect()]
    mix = {r.combo: (r.n, r.p, r.i) for r in queries.QUERIES["J10_grid_class_mix"](spark, sf_dir).collect()}
    assert mix == {k: (len(kept), sum(x > i and x >= v and y >= s for x, y in kept), sum(x <= i for x, _ in kept)) for k, (v, s, i) in enumerate(want)}


def test_fixture_sql_is_the_same_in_both(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    want = con.execute(oracles.compose("SELECT count(*), sum(cx), sum(track_id) FROM tracks")).fetchall()[0]
    got = fixtures.tracks(spark, sf_dir).agg(F.count("*"), F.sum("cx"), F.sum("track_id")).first()
    assert got[0] == want[0] and got[2] == want[2] and abs(got[1] - want[1]) < 1e-6


def test_stream_of_class_mix(spark, sf_dir, tmp_path):
    from kinetrack.streaming.class_mix import class_mix_stream

    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    q = class_mix_stream(stream, "1 day", "365 days").writeStream.outputMode("complete").format("memory").queryName("mix").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.w.start, r.event_type): r.n for r in batch.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r.window_start, r.kind): r.n for r in spark.table("mix").collect()} == want
