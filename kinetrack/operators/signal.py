"""Signals along tracks (W26-W33): sliding speed, autocorrelation, crossings, spectra, autoregressive fits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import FPS, PX_PER_UM, distance, px_to_um, ratio
from .kinematics import KEY, ordered
from .ranks import exact_quantiles


def velocities(tracks: DataFrame, key: Sequence[str] = KEY, ppm: float = PX_PER_UM, fps: float = FPS) -> DataFrame:
    """(key, idx, vx, vy) in um/s; a track's first point has none."""
    w = ordered(key)
    at = tracks.select(*key, (F.row_number().over(w) - 2).alias("idx"), *[(px_to_um(F.col(c) - F.lag(c).over(w), ppm) * fps).alias(v) for c, v in (("cx", "vx"), ("cy", "vy"))])
    return at.filter("idx >= 0")


def sliding_vcl(tracks: DataFrame, steps: int = 24, key: Sequence[str] = KEY) -> DataFrame:
    """Mean speed of each full run of ``steps`` steps."""
    w = Window.partitionBy(*key).orderBy("idx").rowsBetween(1 - steps, 0)
    speed = velocities(tracks, key).withColumn("speed", distance(F.col("vx"), F.col("vy")))
    return speed.withColumns({"wvcl": F.avg("speed").over(w), "_n": F.count("*").over(w)}).filter(F.col("_n") == steps).select(*key, (F.col("idx") - steps + 1).alias("idx"), "wvcl")


def block_kinematics(tracks: DataFrame, window: int = 25, key: Sequence[str] = KEY, ppm: float = PX_PER_UM, fps: float = FPS) -> DataFrame:
    """VCL and LIN of non-overlapping windows of points; a tail is dropped."""
    numbered = tracks.withColumn("block", F.floor((F.row_number().over(ordered(key)) - 1) / window))
    w = Window.partitionBy(*key, "block").orderBy("frame")
    step = numbered.withColumn("step", distance(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)))
    s = step.groupBy(*key, "block").agg(F.count("*").alias("m"), F.sum("step").alias("path"), F.min_by(F.struct("cx", "cy"), "frame").alias("a"), F.max_by(F.struct("cx", "cy"), "frame").alias("b")).filter(F.col("m") == window)
    net = distance(F.col("b.cx") - F.col("a.cx"), F.col("b.cy") - F.col("a.cy"))
    return s.select(*key, "block", (F.col("path") / ppm / (window - 1) * fps).alias("vcl"), ratio(net, F.col("path")).alias("lin"))


def whole_groups(frames: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Rows sorted by ``by``, in frames of whole groups, with the bounds of each group; a group may lie over many batches."""
    by, held = list(by), None
    for f in frames:
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        if not len(f):
            continue
        k = f[by]
        starts = np.flatnonzero(((k != k.shift()) & ~(k.isna() & k.shift().isna())).any(axis=1).to_numpy() | (np.arange(len(f)) == 0))
        if len(starts) > 1:
            yield f, list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
        held = f.iloc[starts[-1] :].reset_index(drop=True)
    if held is not None:
        yield held, [(0, len(held))]


#: Points of a track whose lagged products one transform makes.
ACF_BLOCK = 4096


def lag_products(block: np.ndarray, tail: np.ndarray, max_lag: int) -> np.ndarray:
    """Sums over the rows t of ``block`` of the products of rows t and t + k, k = 0 .. max_lag, where ``tail`` follows the block.

    By padded transforms: the cost does not grow with the number of lags.
    """
    whole = np.concatenate([block, tail])
    size = 1 << int(np.ceil(np.log2(len(block) + len(whole))))
    product = (np.fft.rfft(block, size, axis=0).conj() * np.fft.rfft(whole, size, axis=0)).sum(1)
    return np.fft.irfft(product, size)[: min(max_lag, len(whole) - 1) + 1]


def acf(series: DataFrame, columns: Sequence[str], max_lag: int = 50, key: Sequence[str] = KEY, min_points: int = 2, block: int = ACF_BLOCK) -> DataFrame:
    """Autocorrelation to ``max_lag`` of each track's centred (vector) series, averaged over tracks.

    Tracks are cut into blocks; the first ``max_lag`` points of a block are also sent to the one before it, and the lag
    sums of a track's blocks add up, so a track may span tasks and lag 100 costs what lag 20 costs.
    """
    key, block = list(key), max(block, max_lag)
    whole = Window.partitionBy(*key)
    mid = series.withColumn("_n", F.count("*").over(whole)).filter(F.col("_n") >= min_points).select(*key, "idx", *[(F.col(c) - F.avg(c).over(whole)).alias(f"_v{i}") for i, c in enumerate(columns)])
    at, values = F.floor(F.col("idx") / block), [f"_v{i}" for i in range(len(columns))]
    early = (F.col("idx") % block < max_lag) & (at > 0)
    told = mid.select(*key, "idx", *values, F.explode(F.when(early, F.array(at, at - 1)).otherwise(F.array(at))).alias("_block"))

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, bounds in whole_groups(frames, [*key, "_block"]):
            v, inside, parts = f[values].to_numpy(float), (f["idx"] // block == f["_block"]).to_numpy(), []
            for a, b in bounds:
                cut = a + int(inside[a:b].sum())  # what the next block lends comes last
                parts.append(lag_products(v[a:cut], v[cut:b], max_lag))
            out = f[key].iloc[np.repeat([a for a, _ in bounds], [len(p) for p in parts])].reset_index(drop=True)
            yield out.assign(lag=np.concatenate([np.arange(len(p)) for p in parts]), _p=np.concatenate(parts))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.select(*key).schema)
    dealt = told.repartition(*key, "_block").sortWithinPartitions(*key, "_block", "idx")
    sums = dealt.mapInPandas(products, f"{kinds}, lag int, _p double").groupBy(*key, "lag").agg(F.sum("_p").alias("_p"))
    own = F.max(F.when(F.col("lag") == 0, F.col("_p"))).over(Window.partitionBy(*key))
    return sums.withColumn("_z", own).filter("_z > 1e-12").groupBy("lag").agg(F.avg(F.col("_p") / F.col("_z")).alias("acf"), F.count("*").alias("n_tracks"))


def acf_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean absolute difference of two autocorrelations."""
    return a.select("lag", F.col("acf").alias("x")).join(b.select("lag", F.col("acf").alias("y")), "lag").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mad"))


def crossings(series: DataFrame, column: str, threshold: float, key: Sequence[str] = KEY, fps: float = FPS) -> DataFrame:
    """Crossings of a threshold per second, and mean and CV of the seconds between a track's crossings."""
    return crossing_gaps(series, column, threshold, key, fps).agg(F.sum("c").alias("crossings"), (F.sum("c") / (F.count("*") / fps)).alias("rate"), F.avg("gap").alias("mean_gap"), (F.stddev_pop("gap") / F.avg("gap")).alias("cv_gap"))


def crossing_gaps(series: DataFrame, column: str, threshold: float, key: Sequence[str] = KEY, fps: float = FPS) -> DataFrame:
    """Each point with ``c`` (1 where a threshold is crossed) and the seconds since the track's crossing before it."""
    w = Window.partitionBy(*key).orderBy("idx")
    at = series.withColumn("c", F.coalesce(((F.col(column) >= threshold) != F.lag(F.col(column) >= threshold).over(w)).cast("int"), F.lit(0)))
    at = at.withColumn("at", F.when(F.col("c") == 1, F.col("idx")))
    before = F.max("at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return at.withColumn("gap", F.when(F.col("c") == 1, (F.col("idx") - before) / fps))


def track_spectra(series: DataFrame, columns: Sequence[str], key: Sequence[str] = KEY, fps: float = FPS, min_points: int = 256) -> DataFrame:
    """(key, bin, freq, power): power of a track's (vector) series under a Hann window at the track's own frequencies.

    A track's powers sum to 1, so that tracks weigh equally; tracks with fewer than ``min_points`` values are left out.
    A task holds one track at a time.
    """
    key, columns = list(key), list(columns)

    def spectrum(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, bounds in whole_groups(frames, key):
            told, values = [], f[columns].to_numpy(float)
            for a, b in bounds:
                v = values[a:b]
                power = (np.abs(np.fft.rfft((v - v.mean(0)) * np.hanning(len(v))[:, None], axis=0)) ** 2).sum(1)
                told.append((np.arange(len(power)), np.fft.rfftfreq(len(v), 1 / fps), power / max(power.sum(), 1e-12)))
            out = f[key].iloc[np.repeat([a for a, _ in bounds], [len(t[0]) for t in told])].reset_index(drop=True)
            bins, freqs, powers = (np.concatenate(x) for x in zip(*told, strict=True))
            yield out.assign(bin=bins, freq=freqs, power=powers)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.select(*key).schema)
    long = series.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).filter(F.col("_n") >= min_points).drop("_n")
    return long.select(*key, "idx", *columns).repartition(*key).sortWithinPartitions(*key, "idx").mapInPandas(spectrum, f"{kinds}, bin int, freq double, power double")


def track_peaks(spectra: DataFrame, key: Sequence[str] = KEY, search: tuple[float, float] = (2.0, 24.0)) -> DataFrame:
    """Median and quartiles over tracks of the frequency, of the track's own, with the largest power in a search range (the lower on ties)."""
    peak = spectra.filter(F.col("freq").between(*search)).groupBy(*key).agg(F.max_by("freq", F.struct("power", (-F.col("freq")).alias("f"))).alias("peak"))
    return exact_quantiles(peak, {"peak": {"median": 0.5, "q25": 0.25, "q75": 0.75}}, count="n_tracks")


def on_grid(spectra: DataFrame, step: float = 0.25, top: float = FPS / 2, key: Sequence[str] = KEY) -> DataFrame:
    """(key, freq, power) on the common grid ``step`` .. ``top``, linearly between a track's own frequencies; beyond the last one its power."""
    w = Window.partitionBy(*key).orderBy("bin")
    n = int(round(top / step))
    at = spectra.withColumns({"_f": F.lead("freq").over(w), "_p": F.lead("power").over(w)})
    first = F.greatest(F.lit(1), F.ceil(F.col("freq") / step - 1e-9)).cast("int")
    last = F.least(F.lit(n), F.when(F.col("_f").isNull(), n).otherwise(F.ceil(F.col("_f") / step - 1e-9) - 1)).cast("int")
    points = at.filter(first <= last).withColumn("_k", F.explode(F.sequence(first, last))).withColumn("_at", F.col("_k") * step)
    power = F.coalesce(F.col("power") + (F.col("_p") - F.col("power")) * (F.col("_at") - F.col("freq")) / (F.col("_f") - F.col("freq")), F.col("power"))
    return points.select(*key, F.col("_at").alias("freq"), power.alias("power"))


def periodogram(tracks: DataFrame, key: Sequence[str] = KEY, fps: float = FPS, min_points: int = 256, step: float = 0.25) -> DataFrame:
    """Power of both velocity components on the common grid, for tracks of ``min_points`` points."""
    return on_grid(track_spectra(velocities(tracks, key, 1.0, 1.0), ["vx", "vy"], key, fps, min_points - 1), step, fps / 2, key)


def mean_spectrum(spectra: DataFrame) -> DataFrame:
    """Mean power of all tracks at each frequency."""
    return spectra.groupBy("freq").agg(F.avg("power").alias("power"), F.count("*").alias("n_tracks"))


def band_power(mean: DataFrame, low: float = 5.0, high: float = 20.0, search: tuple[float, float] = (2.0, 24.0)) -> DataFrame:
    """Share of the mean spectrum's power within a band, and the frequency of its largest power in a search range (the lower on ties)."""
    inside, searched = F.col("freq").between(low, high), F.col("freq").between(*search)
    best = F.max_by(F.when(searched, F.col("freq")), F.when(searched, F.struct("power", (-F.col("freq")).alias("f"))))
    return mean.agg((F.sum(F.when(inside, F.col("power")).otherwise(0.0)) / F.sum("power")).alias("band_share"), best.alias("peak_freq"))


def lag_one(tracks: DataFrame, key: Sequence[str] = KEY, min_points: int = 50, fps: float = FPS) -> DataFrame:
    """Lag-1 autocorrelation of uncentred velocity, its median over tracks, and the relaxation time in seconds."""
    w = Window.partitionBy(*key).orderBy("idx")
    v = velocities(tracks, key).withColumns({"p": F.col("vx") * F.lead("vx").over(w) + F.col("vy") * F.lead("vy").over(w), "q": F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")})
    a = v.groupBy(*key).agg(F.count("*").alias("n"), (F.sum("p") / F.sum("q")).alias("a")).filter((F.col("n") >= min_points - 1) & F.col("a").isNotNull())
    med = exact_quantiles(a, {"a": {"a": 0.5}}, count="n_tracks")
    return med.select("a", "n_tracks", F.when((F.col("a") > 0) & (F.col("a") < 1), -1 / F.log("a") / fps).alias("tau_s"))


def _moments(tracks: DataFrame, lags: int, key: Sequence[str], pooled: bool) -> DataFrame:
    whole, w = Window.partitionBy(*([] if pooled else key)), Window.partitionBy(*key).orderBy("idx")
    v = velocities(tracks, key)
    if pooled:
        means = v.agg(F.avg("vx").alias("mx"), F.avg("vy").alias("my"))
        v = v.crossJoin(F.broadcast(means))
    else:
        v = v.withColumns({"mx": F.avg("vx").over(whole), "my": F.avg("vy").over(whole)})
    v = v.withColumns({"x": F.col("vx") - F.col("mx"), "y": F.col("vy") - F.col("my")})
    prods = {f"c{k}": F.col("x") * F.lead("x", k).over(w) + F.col("y") * F.lead("y", k).over(w) for k in range(1, lags + 1)}
    v = v.withColumns({"c0": F.col("x") * F.col("x") + F.col("y") * F.col("y")} | prods)
    by = [] if pooled else list(key)
    return v.groupBy(*by).agg(F.count("*").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), *[(F.sum(f"c{k}") / F.sum("c0")).alias(f"r{k}") for k in range(1, lags + 1)], F.var_pop("vx").alias("var_x"), F.var_pop("vy").alias("var_y"))


def fit_ou(tracks: DataFrame, key: Sequence[str] = KEY, pooled: bool = False, min_points: int = 10) -> DataFrame:
    """Mean and variance of each velocity component and their joint lag-1 coefficient (clipped to +-0.995), per track or over all tracks."""
    m = _moments(tracks, 1, key, pooled).filter(F.col("n") >= min_points - 1)
    return m.withColumn("phi", F.greatest(F.lit(-0.995), F.least(F.lit(0.995), F.coalesce("r1", F.lit(0.0))))).drop("r1")


def fit_ar2(tracks: DataFrame, key: Sequence[str] = KEY, min_points: int = 10) -> DataFrame:
    """AR(2) by Yule-Walker; a fit that is not well inside the stationary region falls back to AR(1), still series to 0."""
    m = _moments(tracks, 2, key, False).filter(F.col("n") >= min_points - 1)
    r1, r2 = F.coalesce("r1", F.lit(0.0)), F.coalesce("r2", F.lit(0.0))
    d = 1 - r1 * r1
    p1, p2 = r1 * (1 - r2) / d, (r2 - r1 * r1) / d
    ok = (d >= 1e-9) & (F.abs(p2) < 0.999) & (p1 + p2 < 0.999) & (p2 - p1 < 0.999)
    clip = F.greatest(F.lit(-0.995), F.least(F.lit(0.995), r1))
    return m.select(*key, "n", "var_x", "var_y", F.coalesce(F.when(ok, p1), clip).alias("phi1"), F.coalesce(F.when(ok, p2), F.lit(0.0)).alias("phi2"))
