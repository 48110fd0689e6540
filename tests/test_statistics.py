"""Test statistics, censored laws, spectra, file readers and reports against closed forms and naive loops."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetrack import fixtures, queries
from kinetrack.functions import special
from kinetrack.operators import agreement, episodes, features, laws, order, report, signal, states
from kinetrack.sources import files

TRACK = "video string, track_id long, frame int, cx double, cy double, conf double"


def test_tail_probabilities():
    # textbook critical values
    assert special.student_p(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and special.student_p(12.706205, 1) == pytest.approx(0.05, abs=1e-7)
    assert special.student_p(0, 5) == 1 and special.student_p(3, 0) == 1 and special.student_p(math.inf, 4) == 0
    assert special.chi2_p(3.841459, 1) == pytest.approx(0.05, abs=1e-7) and special.chi2_p(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert special.normal_p(1.959964) == pytest.approx(0.05, abs=1e-7) and special.kolmogorov_p(1.358099 / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-5)
    for a, b, x in ((0.5, 3, 0.2), (7, 2.5, 0.9), (40, 60, 0.4), (1, 1, 0.3)):
        t = np.linspace(0, x, 400_001)[1:] - x / 800_000
        area = (t ** (a - 1) * (1 - t) ** (b - 1)).sum() * x / 400_000 * math.gamma(a + b) / math.gamma(a) / math.gamma(b)
        assert special.beta_tail(a, b, x) == pytest.approx(area, abs=2e-3 if a < 1 else 1e-7)
        assert special.beta_tail(a, b, x) + special.beta_tail(b, a, 1 - x) == pytest.approx(1)
    for x in (0.1, 1.0, 5.0, 30.0):
        assert special.gamma_tail(3, x) == pytest.approx(math.exp(-x) * (1 + x + x * x / 2), rel=1e-10)
        assert special.gamma_tail(0.5, x) == pytest.approx(math.erfc(math.sqrt(x)), rel=1e-9)


def test_p_columns(spark):
    df = spark.createDataFrame([(0.5, 12), (None, 5), (1.0, 9), (0.3, 2)], "r double, n long")
    got = [r.p for r in df.withColumn("p", special.column_of(special.correlation_p, "r", "n")).collect()]
    t = 0.5 * math.sqrt(10 / 0.75)
    assert got[0] == pytest.approx(special.student_p(t, 10)) and got[1:] == [None, 0.0, 1.0]
    w = spark.createDataFrame([(1.0, 0.0), (3.0, 1.0), (0.0, 4.0), (2.0, 2.0), (5.0, 0.0), (7.0, 1.0)], "a double, b double")
    r = features.wilcoxon(w, "a", "b").first()  # differences 1, 2, -4, 0, 5, 6: ranks 1, 2, 3, 4, 5
    assert (r.w_plus, r.w_minus, r.n) == (12, 3, 5) and r.p == pytest.approx(special.normal_p((3 - 7.5) / math.sqrt(5 * 6 * 11 / 24)))


def test_censored_laws(spark):
    rng = np.random.default_rng(1)
    runs = np.maximum(1, (rng.gamma(2, 30, 600)).round().astype(int))
    cut = rng.random(600) < 0.3
    h = spark.createDataFrame(pd.DataFrame({"state": 1, "run": runs, "censored": cut})).groupBy("state", "run", "censored").agg(F.count("*").alias("n"))
    got = {r.law: r for r in laws.censored_laws(h).collect()}
    x, done, stopped = runs / 50, (~cut).astype(float), cut.astype(float)
    assert got["exponential"].a == pytest.approx(x.sum() / done.sum()) and {r.n for r in got.values()} == {600} and {r.events for r in got.values()} == {int(done.sum())}
    assert min(r.delta_aic for r in got.values()) == 0 and got["gamma"].delta_aic < 10
    for law in ("gamma", "weibull", "lognormal"):
        a, b = got[law].a, got[law].b
        best = laws.censored_log_likelihood(law, a, b, x, done, stopped)
        assert got[law].aic == pytest.approx(4 - 2 * best)
        assert all(best > laws.censored_log_likelihood(law, a * p, b * q, x, done, stopped) for p, q in ((1.02, 1), (0.98, 1), (1, 1.02), (1, 0.98)))
    whole = h.filter("not censored")
    plain = {r.law: (r.a, r.b, r.aic) for r in laws.dwell_laws(whole.select("state", "run", "n")).collect()}
    again = {r.law: (r.a, r.b, r.aic) for r in laws.censored_laws(whole).collect()}
    assert again["gamma"][0] == pytest.approx(plain["gamma"][0], rel=1e-3) and again["weibull"] == pytest.approx(plain["weibull"], rel=1e-3) and again["exponential"][2] == pytest.approx(plain["exponential"][2])
    assert again["lognormal"][2] == pytest.approx(plain["lognormal"][2], rel=1e-6)
    assert laws.censored_laws(h.filter("censored")).count() == 0


def test_spectra(spark):
    rng = np.random.default_rng(2)
    rows, want = [], []
    for t, n in enumerate([64, 101, 20]):
        p = np.cumsum(rng.normal(0, 1, (n, 2)), 0) + np.column_stack([3 * np.sin(np.arange(n) * 2 * math.pi * 6 / 50), np.zeros(n)])
        rows += [("v", t, k, float(x), float(y), 1.0) for k, (x, y) in enumerate(p)]
        if n >= 32:
            v = np.diff(p, axis=0)
            power = sum(abs(np.fft.rfft((v[:, c] - v[:, c].mean()) * np.hanning(n - 1))) ** 2 for c in (0, 1))
            want.append(np.interp(np.arange(1, 101) / 4, np.fft.rfftfreq(n - 1, 0.02), power / power.sum()))
    each = signal.periodogram(spark.createDataFrame(rows, TRACK), min_points=32)
    got = {r.freq: r for r in signal.mean_spectrum(each).collect()}
    assert np.allclose([got[f].power for f in sorted(got)], np.mean(want, 0)) and {r.n_tracks for r in got.values()} == {2} and len(got) == 100
    mean = np.mean(want, 0)
    band = signal.band_power(signal.mean_spectrum(each)).first()
    assert band.band_share == pytest.approx(mean[19:80].sum() / mean.sum()) and band.peak_freq == pytest.approx((8 + int(mean[7:96].argmax())) / 4)
    own = signal.track_spectra(signal.velocities(spark.createDataFrame(rows, TRACK), ppm=1.0, fps=1.0), ["vx", "vy"], min_points=31)
    peaks = []
    for n in (63, 100):  # at the track's own frequencies, not on the grid
        bins = sorted((r.freq, r.power) for r in own.collect() if r.track_id == (0 if n == 63 else 1))
        assert [f for f, _ in bins] == pytest.approx(np.fft.rfftfreq(n, 0.02)) and sum(p for _, p in bins) == pytest.approx(1)
        peaks.append(max((p, f) for f, p in bins if 2 <= f <= 24)[1])
    told = signal.track_peaks(own).first()
    assert told.n_tracks == 2 and told.median == pytest.approx(np.median(peaks)) and told.q25 == pytest.approx(np.quantile(peaks, 0.25))
    for r in signal.fit_ou(spark.createDataFrame(rows, TRACK)).collect():
        v = np.diff(np.array([(x, y) for _, t, _, x, y, _ in rows if t == r.track_id]), axis=0) / 1.422 * 50
        c = v - v.mean(0)
        assert (r.mx, r.my, r.var_x, r.var_y) == pytest.approx((*v.mean(0), *v.var(0))) and r.phi == pytest.approx((c[1:] * c[:-1]).sum() / (c * c).sum())


def test_whole_groups():
    """Groups over many small frames come out whole and once, also those of a null key."""
    rows = pd.DataFrame([(v, t, k) for v, t, n in (("a", 1, 5), ("a", 2, 1), (None, 2, 3), ("b", 2, 12)) for k in range(n)], columns=["v", "t", "k"])
    for size in (1, 2, 5, 100):
        frames = (rows.iloc[a : a + size] for a in range(0, len(rows), size))
        got = [f.iloc[a:b]["k"].tolist() for f, bounds in signal.whole_groups(frames, ["v", "t"]) for a, b in bounds]
        assert got == [list(range(n)) for n in (5, 1, 3, 12)]
    assert not list(signal.whole_groups(iter([rows.iloc[:0]]), ["v"]))


@pytest.mark.parametrize("block", [7, 4096])
def test_autocorrelation_in_blocks(spark, block):
    """Lag sums of blocks add up to those of the whole track; lags beyond a track count for nothing."""
    rng = np.random.default_rng(block)
    tracks = {t: np.cumsum(rng.normal(size=(n, 2)), 0) for t, n in enumerate((1, 2, 5, 30, 61, 14))}
    df = spark.createDataFrame([("v", t, k, float(x), float(y)) for t, v in tracks.items() for k, (x, y) in enumerate(v)], "video string, track_id long, idx int, vx double, vy double").repartition(3)
    got = {r.lag: r for r in signal.acf(df, ["vx", "vy"], 6, block=block).collect()}
    for lag in range(7):
        values = []
        for v in tracks.values():
            c = v - v.mean(0)
            if len(v) > max(lag, 1):
                values.append((c[lag:] * c[: len(c) - lag]).sum() / (c * c).sum())
        assert got[lag].acf == pytest.approx(np.mean(values), abs=1e-9) and got[lag].n_tracks == len(values)


def test_fidelity_over_variants(spark):
    quality = spark.createDataFrame([("a", 0.9, 1.0), ("b", 0.7, 2.5), ("c", 0.4, 2.0), ("d", 0.8, None)], "variant string, coverage double, id_switches double")
    dynamics = spark.createDataFrame([("truth", 0.2, 1.5), ("a", 0.25, 1.2), ("b", 0.1, 1.8), ("c", -0.1, 1.5), ("d", 0.2, 1.6)], "variant string, g2 double, dwell_cv double")
    table = agreement.tracker_fidelity(quality, dynamics, "truth")
    rows = {r.variant: r for r in table.collect()}
    assert {k: (r.g2_error, r.cv_error) for k, r in rows.items()} == {k: (pytest.approx(abs(g - 0.2)), pytest.approx(abs(c / 1.5 - 1))) for k, g, c in (("a", 0.25, 1.2), ("b", 0.1, 1.8), ("c", -0.1, 1.5), ("d", 0.2, 1.6))}
    got = {(r.quality, r.error): (r.r, r.n) for r in agreement.dissociation(table, ["coverage", "id_switches"], ["g2_error", "cv_error"]).collect()}
    for (q, e), (value, n) in got.items():
        xy = [(r[q], r[e]) for r in rows.values() if r[q] is not None]
        assert n == len(xy) and value == pytest.approx(np.corrcoef(*zip(*xy, strict=True))[0, 1])
    flat = agreement.dissociation(table.withColumn("coverage", F.lit(1.0)), ["coverage"], ["g2_error"]).first()
    assert (flat.r, flat.n) == (None, 4) and agreement.dissociation(table.limit(2), ["coverage"], ["g2_error"]).first().r is None


def test_class_mix_like_a_product(spark):
    """The cumulative table against every combination on every track; values on the cuts, repeated and unsorted cuts."""
    rng = np.random.default_rng(4)
    rows = [(f"v{k % 3}", float(rng.integers(0, 12)), float(rng.integers(0, 5)) / 4) for k in range(200)]
    df = spark.createDataFrame(rows, "video string, VCL double, STR double")
    vcl, straightness, immotile = [6, 3, 9], [0.5, 0.25, 0.5], [2, 5]
    for by in ([], ["video"]):
        got = {(*[r[c] for c in by], r.combo): (r.vcl_prog, r.str_prog, r.vcl_imm, r.n, r.p, r.i) for r in agreement.class_mix(df, vcl, straightness, immotile, by).collect()}
        want = {}
        for g in {tuple([r[0]] if by else []) for r in rows}:
            for k, (v, s, i) in enumerate((v, s, i) for v in vcl for s in straightness for i in immotile):
                held = [r for r in rows if not by or r[0] == g[0]]
                want[(*g, k)] = (v, s, i, len(held), sum(x > i and x >= v and y >= s for _, x, y in held), sum(x <= i for _, x, y in held))
        assert got == want


def test_coverage_counts_shared_frames(spark):
    """A truth track seen in 10 frames, 6 of which the predictions lack altogether: 2 matches of 4 are half."""
    gt = [("v", 1, k, 10.0, 10.0, 1.0) for k in range(10)] + [("v", 2, k, 90.0, 90.0, 1.0) for k in range(20, 23)]
    pr = [("v", 7, 0, 10.0, 10.0, 1.0), ("v", 7, 1, 10.0, 10.0, 1.0), ("v", 8, 2, 300.0, 10.0, 1.0), ("v", 8, 3, 300.0, 10.0, 1.0)]
    from kinetrack.operators import association

    r = association.tracking_quality(spark.createDataFrame(gt, TRACK), spark.createDataFrame(pr, TRACK)).first()
    assert (r.n_gt, r.coverage, r.id_switches, r.fragmentation) == (2, 0.5, 0.0, 1.0)


def test_partial_spearman_of_two_controls(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "x double, y double, c double, d double")
    ranks = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in np.round(v, 9)])
    r = np.stack([ranks(np.round(x[:, k], 9)) for k in range(4)], 1)
    base = np.column_stack([np.ones(60), r[:, 2:]])
    rest = r[:, :2] - base @ np.linalg.lstsq(base, r[:, :2], rcond=None)[0]
    rho = np.corrcoef(ranks(np.round(rest[:, 0], 9)), ranks(np.round(rest[:, 1], 9)))[0, 1]
    got = features.partial_spearman(df, "x", "y", "c", "d").first()
    assert got.rho == pytest.approx(rho) and got.p == pytest.approx(special.correlation_p(rho, 60)) and got.n == 60


def test_truncated_tracks(spark):
    rows = [("v", t, k, float(k), 0.0, 1.0) for t, n in enumerate([8, 12, 30, 30, 50]) for k in range(n)]
    ref = [("v", t, k, 0.0, 0.0, 1.0) for t, n in enumerate([11, 11, 20, 40]) for k in range(n)]
    df, reference = spark.createDataFrame(rows, TRACK), spark.createDataFrame(ref, TRACK)
    seen = set()
    for seed in range(12):
        got = {}
        for r in episodes.truncated(df, reference, seed=seed).collect():
            got.setdefault(r.track_id, []).append(r.frame)
        for t, f in got.items():
            assert sorted(f) == list(range(min(f), max(f) + 1))
            seen.add((t, len(f)))
    # tracks 0 (too short) go; track 1 can only be 11 long; longer ones take any length that fits
    assert seen == {(1, 11), (2, 11), (2, 20), (3, 11), (3, 20), (4, 11), (4, 20), (4, 40)}


def test_designs_and_display(spark):
    kin = spark.createDataFrame([("v", 1, 0, 4.5, 0.9), ("v", 1, 1, 22.0, 0.45), ("v", 1, 2, 40.0, 0.7)], "video string, track_id long, idx int, vcl double, straightness double")
    designs = spark.createDataFrame(queries.DESIGNS, "config string, v_imm double, v_prog double, s_prog double")
    got = {}
    for r in sorted(agreement.state_sweep(kin, designs).collect(), key=lambda r: r.idx):
        got.setdefault(r.config, []).append(r.state)
    assert len(got) == 11 and got["baseline"] == [2, 1, 0] and got["v_imm_4"] == [1, 1, 0] and got["joint_loose"] == [1, 0, 0] and got["v_prog_20"] == [2, 1, 0]
    assert [r.idx for r in report.display_rows(kin, "idx", rows=2).collect()] == [0, 1]
    shares = spark.createDataFrame([(0.4, 0.1, 0.0), (0.2, 0.1, 0.2)], "a double, b double, c double").select(order.memory_share(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()
    assert shares[0].s == pytest.approx(0.75) and shares[1].s is None


def test_motility_files_and_work_list(spark, tmp_path):
    for video, n in (("a_1", 2), ("b", 3)):
        pd.DataFrame({"track_id": range(n), "VCL": [1.5] * n, "motility": "immotile"}).to_csv(tmp_path / f"{video}_motility.csv", index=False)
    (tmp_path / "other.csv").write_text("x\n1\n")
    got = files.read_motility(spark, str(tmp_path))
    assert sorted((r.video, r.track_id, r.VCL) for r in got.collect()) == [("a_1", 0, 1.5), ("a_1", 1, 1.5), ("b", 0, 1.5), ("b", 1, 1.5), ("b", 2, 1.5)]
    exps, vids = spark.createDataFrame([("x",), ("y",)], "experiment string"), got.select("video")
    work, unknown = files.work_list(exps, vids)
    assert work.count() == 4 and unknown.count() == 0
    work, unknown = files.work_list(exps, vids, spark.createDataFrame([("video", "b"), ("video", "no")], "kind string, name string"))
    assert sorted(map(tuple, work.collect())) == [("x", "b"), ("y", "b")] and list(map(tuple, unknown.collect())) == [("video", "no")]


def test_named_files(spark, tmp_path):
    """One file a name with its rows in order; names are kept as they are, a second write replaces its own files alone."""
    rows = [("a b=1%", 2, 1), ("a b=1%", 1, 2), ("c", 5, 3), ("ü/x".replace("/", "-"), 1, 4)]
    df = spark.createDataFrame(rows, "video string, track_id long, frame int").repartition(3)
    path = str(tmp_path / "out")
    files.write_named(df, path, F.concat("video", F.lit("_t.csv")), ["track_id", "frame"], ["track_id"])
    held = lambda: {p.name: p.read_text() for p in (tmp_path / "out").glob("*.csv")}
    assert held() == {"a b=1%_t.csv": "track_id,frame\n1,2\n2,1\n", "c_t.csv": "track_id,frame\n5,3\n", "ü-x_t.csv": "track_id,frame\n1,4\n"}
    files.write_named(df.filter("video = 'c'").withColumn("frame", F.lit(9)), path, F.concat("video", F.lit("_t.csv")), ["track_id", "frame"])
    assert held()["c_t.csv"] == "track_id,frame\n5,9\n" and len(held()) == 3
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_attempt")]
    with pytest.raises(Exception, match="without a file name"):
        files.write_named(df, path, F.lit(None).cast("string"), ["frame"])
    assert len(held()) == 3 and not [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    files.write_named(df.limit(0), path, F.col("video"), ["frame"])
    tracks = spark.createDataFrame([("12", "plain", 1, 0, 1.5, 2.5), ("12", "ocsort", 1, 0, 1.5, 2.5)], "video string, tracker string, track_id long, frame int, cx double, cy double")
    files.write_tracks(tracks, str(tmp_path / "tracks"))
    assert sorted((r.video, r.tracker, r.cx, r.x1) for r in files.read_tracks(spark, str(tmp_path / "tracks")).collect()) == [("12", "ocsort", 1.5, None), ("12", "plain", 1.5, None)]


def test_video_context(spark, sf_dir):
    rows = queries.QUERIES["M32_video_context"](spark, sf_dir).collect()
    moves = {}
    for r in episodes.transition_counts(queries.frame_states(spark, sf_dir), ["video"]).collect():
        moves.setdefault(r.video, {})[r["from"], r["to"]] = r.n
    assert rows and all(json.loads(r.transitions) == [moves[r.video][a, b] for a in range(3) for b in range(3)] for r in rows)
    meets = {r.video: r.meets_total for r in queries.QUERIES["P08_compliance"](spark, sf_dir).collect()}
    assert {r.video: r.meets_total for r in rows} == meets


@pytest.mark.parametrize("name", ["M02_censored_laws", "M04_laws_by_window", "M07_block_order_test", "M15_scc_profile", "M31_cohort_battery"])
def test_whole_jobs_give_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_battery_ratio_is_of_the_parts(spark, sf_dir):
    got = {r.metric: r for r in queries.QUERIES["M31_cohort_battery"](spark, sf_dir).collect()}
    st = states.frame_states(fixtures.tracks(spark, sf_dir), 9)
    assert got["all.switch_rate"].a == pytest.approx(episodes.switch_rate(st).first().switch_rate, abs=1e-6)
    assert got["all.switch_rate"].ratio == pytest.approx(got["all.switch_rate"].b / got["all.switch_rate"].a, abs=1e-5)
