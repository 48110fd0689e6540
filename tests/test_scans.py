"""Prefix scans and the carried stack against plain loops, and on long tracks."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetrack import fixtures
from kinetrack.operators import episodes, scans, serial
from kinetrack.plans import battery


def loop_states(rows, margin, v_imm=5.0, v_prog=25.0, s_prog=0.5):
    """States of one track, frame by frame."""
    lo_i, hi_i, lo_p, hi_p, lo_s, hi_s = (x * (1 + s * margin) for x in (v_imm, v_prog, s_prog) for s in (-1, 1))
    out = []
    for v, s in rows:
        if not out:
            now = 2 if v <= v_imm else 0 if v >= v_prog and s >= s_prog else 1
        elif out[-1] == 2:
            now = 2 if v <= hi_i else 0 if v >= hi_p and s >= hi_s else 1
        elif v <= lo_i:
            now = 2
        elif out[-1] == 0:
            now = 1 if v < lo_p or s < lo_s else 0
        else:
            now = 0 if v >= hi_p and s >= hi_s else 1
        out.append(now)
    return out


@pytest.mark.parametrize("chunk", [2, 5, 4096])
def test_composed_maps(spark, chunk):
    rng = random.Random(chunk)
    tracks = {("a", k): [[rng.randrange(3) for _ in range(3)] for _ in range(n)] for k, n in enumerate((1, 2, 3, 17, 64, 131))}
    tracks = {k: [[m[0][0]] * 3, *m[1:]] for k, m in tracks.items()}  # a track begins in a known state
    rows = [(v, t, i, f"{i}", *m) for (v, t), maps in tracks.items() for i, m in enumerate(maps)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "video string, track_id long, idx long, tag string, m0 long, m1 long, m2 long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.video, r.track_id, r.idx): r for r in scans.composed_maps(df, chunk=chunk).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for (v, t), maps in tracks.items():
        now = 0
        for i, m in enumerate(maps):
            now = m[now]
            assert (got[v, t, i].m0, got[v, t, i].tag) == (now, f"{i}")
    assert len(got) == len(rows) and scans.composed_maps(df.limit(0)).count() == 0


def test_hysteresis_of_many_tracks(spark):
    rng = random.Random(7)
    seqs = {t: [(rng.uniform(0, 40), rng.random()) for _ in range(rng.randrange(1, 90))] for t in range(40)}
    df = spark.createDataFrame([("v", t, i, 10 * i, x, s) for t, rows in seqs.items() for i, (x, s) in enumerate(rows)], "video string, track_id long, idx int, frame int, vcl double, straightness double")
    for margin in (0.0, 0.1, 0.4):
        got = {(r.track_id, r.idx): (r.state, r.frame) for r in episodes.hysteresis_states(df, margin).collect()}
        assert got == {(t, i): (state, 10 * i) for t, rows in seqs.items() for i, state in enumerate(loop_states(rows, margin))}


def test_a_million_frames_of_one_track(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("v").alias("video"), F.lit(1).cast("long").alias("track_id"), F.col("id").alias("idx"), F.col("id").cast("int").alias("frame"),
                               (F.pmod(F.xxhash64("id"), 400) / 10).alias("vcl"), (F.pmod(F.xxhash64("id", F.lit(1)), 100) / 100).alias("straightness")).repartition(8)
    start = time.time()
    out = episodes.hysteresis_states(df, 0.1).toPandas().sort_values("idx")
    assert time.time() - start < 60
    rows = df.toPandas().sort_values("idx")
    assert out.state.tolist() == loop_states(zip(rows.vcl.tolist(), rows.straightness.tolist(), strict=True), 0.1)


def loop_merge(eps, threshold):
    """Drop the leftmost short episode between two of one state, again and again."""
    eps = list(eps)
    k = 1
    while k < len(eps) - 1:
        if eps[k][1] <= threshold and eps[k - 1][0] == eps[k + 1][0] != eps[k][0]:
            eps[k - 1 : k + 2] = [(eps[k - 1][0], sum(e[1] for e in eps[k - 1 : k + 2]))]
            k = max(1, k - 1)
        else:
            k += 1
    return eps


def chains(rng, n):
    out, state = [], rng.randrange(3)
    for _ in range(n):
        out.append((state, rng.choice((1, 1, 2, 3, 4, 9))))
        state = (state + rng.randrange(1, 3)) % 3
    return out


def test_stack_over_batches(spark):
    rng = random.Random(5)
    tracks = {t: chains(rng, rng.randrange(1, 60)) for t in range(60)}
    df = spark.createDataFrame([("v", t, k, s, r) for t, eps in tracks.items() for k, (s, r) in enumerate(eps)], "video string, track_id long, ep_idx int, state int, run int").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        for threshold in (0, 1, 3, 20):
            got = {}
            for r in sorted(episodes.merge_flickers(df, threshold).collect(), key=lambda r: (r.track_id, r.ep_idx)):
                got.setdefault(r.track_id, []).append((r.state, r.run))
            assert got == {t: loop_merge(eps, threshold) for t, eps in tracks.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert episodes.merge_flickers(df.limit(0), 3).count() == 0


def test_a_million_episodes_of_one_track(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("v").alias("video"), F.lit(1).alias("track_id"), F.col("id").alias("ep_idx"), F.pmod(F.col("id"), F.lit(2)).cast("int").alias("state"), (F.pmod(F.xxhash64("id"), 9) + 1).alias("run"))
    start = time.time()
    merged = episodes.merge_flickers(df, 3).agg(F.sum("run"), F.count("*"), F.max("ep_idx")).first()
    assert time.time() - start < 60
    runs = df.toPandas().sort_values("ep_idx").run.to_numpy()
    assert merged[0] == np.sum(runs) and merged[1] == merged[2] + 1 < n


def test_designs_copy_no_frames(spark, sf_dir, monkeypatch):
    tracks = fixtures.tracks(spark, sf_dir)
    frames = battery.states.frame_states(tracks).count()
    composed = []

    def counted(maps, key, *rest):
        composed.append(maps.count())
        return scans.composed_maps(maps, key, *rest)

    monkeypatch.setattr(episodes, "composed_maps", counted)
    battery.design_sweep(tracks, 2, 3)
    assert 0 < sum(composed) < frames  # all margins together compose changes only
    by = ["config", "video", "track_id"]
    columns = [*by, "ep_idx", "state", "run", "n_eps", "is_first", "is_last", "censored"]
    want = episodes.episodes(battery.designed_states(tracks), by).select(columns)
    got = battery.designed_episodes(tracks).select(columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 500
    assert got.dtypes == want.dtypes and got.select("config").distinct().count() == 16


def test_weighted_ranks_without_a_join(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(x), float(y), int(c)) for g, x, y, c in zip(rng.integers(0, 4, 600), rng.integers(0, 9, 600) / 3, rng.normal(size=600), rng.integers(1, 5, 600), strict=True)]
    df = spark.createDataFrame(rows, "g int, x double, y double, c long")
    told = serial.weighted_spearman(df, ["g"], "c")
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()
    for r in told.collect():
        x, y = np.array([(x, y) for g, x, y, c in rows if g == r.g for _ in range(c)]).T
        assert r.n == len(x) and r.rho == pytest.approx(np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1], abs=1e-9)
