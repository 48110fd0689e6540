"""Serial memory of dwells: residuals (W21, W22), lag pairs (W23), Spearman (W24, M12), permutation and bootstrap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import FPS, pearson
from ..sources.files import stored
from .kinematics import KEY
from .ranks import distinct_ranks, hash_number, numbered


def hashed(*parts: Column | str) -> Column:
    """Deterministic random order: MD5 of the parts' text, the same in every engine."""
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def residuals(eps: DataFrame, min_eps: int = 4, fps: float = FPS, by: Sequence[str] = ()) -> DataFrame:
    """Log-dwell less its state's mean (within ``by``), for tracks with ``min_eps`` episodes (the means use all episodes)."""
    means = eps.groupBy(*by, "state").agg(F.avg(F.log(F.col("run") / fps)).alias("m"))
    return eps.filter(F.col("n_eps") >= min_eps).join(means, [*by, "state"]).withColumn("resid", F.log(F.col("run") / fps) - F.col("m")).drop("m")


def trait_residuals(eps: DataFrame, min_eps: int = 4, key: Sequence[str] = KEY, fps: float = FPS) -> DataFrame:
    """Log-dwell less its own track's mean in that state; tracks that visit any state only once are left out."""
    w = Window.partitionBy(*key, "state")
    log = F.log(F.col("run") / fps)
    at = eps.filter(F.col("n_eps") >= min_eps).withColumns({"resid": log - F.avg(log).over(w), "_n": F.count("*").over(w)})
    return at.withColumn("_low", F.min("_n").over(Window.partitionBy(*key))).filter("_low >= 2").drop("_n", "_low")


def lag_pairs(resid: DataFrame, lags: int = 5, key: Sequence[str] = KEY, by: Sequence[str] = ()) -> DataFrame:
    """Pairs (x, y) of residuals k episodes apart, k = 1 .. lags."""
    w = Window.partitionBy(*by, *key).orderBy("ep_idx")
    later = resid.select(*by, *key, F.col("resid").alias("x"), F.array(*[F.lead("resid", k).over(w) for k in range(1, lags + 1)]).alias("ys"))
    return later.select(*by, *key, "x", F.posexplode("ys").alias("k", "y")).filter("y is not null").select(*by, *key, "x", (F.col("k") + 1).alias("lag"), "y")


def average_ranks(df: DataFrame, names: dict[str, str], by: Sequence[str] = (), weight: Column | None = None, few: bool | None = None) -> DataFrame:
    """Adds average ranks ``{column: name}`` within ``by``, through one table of distinct values and their counts.

    Ties collapse before anything is ordered. Values are rounded to 9 decimals, so that equal residuals tie in every
    engine. ``weight``: how many times a row stands. ``few``: few, large groups (the default without ``by``) are ordered
    by range partitions; otherwise each group is ordered in one task.
    """
    one = F.lit(1) if weight is None else weight
    values = F.array(*[F.struct(F.lit(c).alias("c"), F.round(c, 9).alias("v")) for c in names])
    h = df.select(*by, one.alias("_w"), F.explode(values).alias("_x")).groupBy(*by, "_x.c", "_x.v").agg(F.sum("_w").alias("_n"))
    if few or (few is None and not by):
        r = stored(distinct_ranks(h, [*by, "c"], "v", "_n", "_r"))
    else:
        r = h.withColumn("_r", F.sum("_n").over(Window.partitionBy(*by, "c").orderBy("v")) - (F.col("_n") - 1) / 2)
    out = df
    for c, to in names.items():
        out = out.withColumn("_v", F.round(c, 9)).join(r.filter(F.col("c") == c).select(*by, F.col("v").alias("_v"), F.col("_r").alias(to)), [*by, "_v"]).drop("_v")
    return out


def spearman(pairs: DataFrame, by: Sequence[str] = (), x: str = "x", y: str = "y", min_n: int = 3, few: bool | None = None) -> DataFrame:
    """Correlation of average ranks in each group; ``few`` as in ``average_ranks``."""
    ranked = average_ranks(pairs, {x: "_rx", y: "_ry"}, by, few=few)
    return ranked.groupBy(*by).agg(F.when(F.count("*") >= min_n, pearson("_rx", "_ry")).alias("rho"), F.count("*").alias("n"))


def per_cell_memory(eps: DataFrame, min_eps: int = 6, key: Sequence[str] = KEY) -> DataFrame:
    """Lag-1 Spearman within each track, averaged on Fisher's z scale (clipped to 0.999)."""
    pairs = lag_pairs(residuals(eps, min_eps), 1, key)
    rho = spearman(pairs, list(key)).filter("rho is not null and not isnan(rho)")
    z = F.atanh(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col("rho"))))
    return rho.agg(F.tanh(F.avg(z)).alias("mean_rho"), F.count("*").alias("n_tracks"))


#: Episodes that a task shuffles and counts at a time (whole tracks); bounds its memory.
EPISODES_HELD = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """Random 64-bit numbers from counters (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_counts(resid: DataFrame, perms: int = 0, lags: int = 1, key: Sequence[str] = KEY, by: Sequence[str] = ("video",), seed: int = 0) -> DataFrame:
    """(by, perm, lag, x, y, c): how often residuals y stand ``lag`` episodes behind x; perm 0 is the observed order.

    Perms 1 .. ``perms`` put each track's episodes in new random orders: by counter-based random keys of track, seed,
    perm and place, the same wherever the track lies. Tracks are dealt to tasks whole and sorted; a task shuffles some
    thousand tracks at once and counts equal pairs before any row leaves it. Values are rounded to 9 decimals, so that
    equal residuals tie. The counts are written once.
    """
    key, by = list(key), list(by)
    rows = resid.select(*by, *[c for c in key if c not in by], "ep_idx", F.xxhash64(*key, F.lit(seed)).alias("_t"), F.round("resid", 9).alias("_v"))
    dealt = rows.repartition(*key).sortWithinPartitions("_t", *key, "ep_idx").select(*by, F.xxhash64(*key).alias("_k"), "_t", "_v")
    kinds = [(f.name, f.dataType.simpleString()) for f in dealt.select(*by).schema]
    names = [*by, "perm", "lag", "x", "y", "c"]

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        k, t, v = (table.column(c).to_numpy() for c in ("_k", "_t", "_v"))
        start = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
        track = np.cumsum(start) - 1
        place = (np.arange(len(v)) - np.flatnonzero(start)[track]).astype(np.uint64)
        values, codes = np.unique(v, return_inverse=True)
        units = table.select(by).to_pandas() if by else pd.DataFrame(index=range(len(v)))
        unit = units.groupby(by, sort=False, dropna=False).ngroup().to_numpy() if by else np.zeros(len(v), np.int64)
        first = np.unique(unit, return_index=True)[1]
        d = len(values)
        for perm in range(perms + 1):
            seen = codes
            if perm:
                keys = _mixed(_mixed(t.view(np.uint64) + np.uint64(perm * 0x9E3779B97F4A7C15 % 2**64)) + place)
                seen = codes[np.lexsort((keys, track))]
            for lag in range(1, lags + 1):
                inside = np.flatnonzero(track[:-lag] == track[lag:]) if len(v) > lag else []
                if not len(inside):
                    continue
                cell, c = np.unique((unit[inside] * d + seen[inside]) * d + seen[inside + lag], return_counts=True)
                at = first[cell // (d * d)]
                held = [table.column(b).take(pa.array(at)).combine_chunks() for b in by]
                held = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in held]
                n = len(cell)
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.full(n, perm, np.int32)), pa.array(np.full(n, lag, np.int32)), pa.array(values[cell // d % d]), pa.array(values[cell % d]), pa.array(c)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= EPISODES_HELD:
                table = pa.Table.from_batches(held)
                k = table.column("_k").to_numpy()
                whole = np.flatnonzero(k != k[-1])  # the last track may go on
                cut = int(whole[-1]) + 1 if len(whole) else 0
                if cut:
                    yield from counted(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            yield from counted(table)

    schema = ", ".join([*[f"{n} {t}" for n, t in kinds], "perm int", "lag int", "x double", "y double", "c long"])
    return stored(dealt.mapInArrow(run, schema).groupBy(*by, "perm", "lag", "x", "y").agg(F.sum("c").alias("c")))


def deltas(rho: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """From (by, perm, rho, n): observed, mean of the permuted ones, their difference, and the share of them at or above the observed."""
    seen = rho.filter("perm = 0").select(*by, F.col("rho").alias("observed"), "n")
    null = rho.filter("perm > 0").select(*by, "rho")
    both = null.join(seen, list(by)) if by else null.crossJoin(seen)
    out = both.groupBy(*by, "observed", "n").agg(F.avg("rho").alias("null_mean"), F.avg((F.round("rho", 9) >= F.round("observed", 9)).cast("double")).alias("p"))
    return out.withColumn("delta", F.col("observed") - F.col("null_mean"))


def permutation_null(resid: DataFrame, reps: int = 50, lag: int = 1, key: Sequence[str] = KEY, seed: int = 0, by: Sequence[str] = (), min_pairs: int = 3) -> DataFrame:
    """Observed lag Spearman (of each group), mean of the within-track permuted ones, difference, share at or above the observed."""
    counts = pair_counts(resid, reps, lag, key, by, seed).filter(F.col("lag") == lag)
    return deltas(weighted_spearman(counts, [*by, "perm"], "c", min_pairs), by)


def resampled_videos(videos: DataFrame, reps: int, seed: int = 0) -> DataFrame:
    """(rep, slot, video): bootstrap replicates of as many hashed draws as there are videos, with replacement."""
    names = stored(numbered(videos.select("video").distinct(), ["video"], "_i").select("video", (F.col("_i") - 1).alias("_i")))
    n = names.count()
    slots = videos.sparkSession.range(n).select(F.col("id").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    return slots.withColumn("_i", hash_number(F.col("rep"), F.col("slot"), F.lit(seed)) % max(n, 1)).join(names, "_i").select("rep", "slot", "video")


def weighted_spearman(pairs: DataFrame, by: Sequence[str], weight: str, min_n: int = 3) -> DataFrame:
    """Spearman of pairs that each stand ``weight`` times; null below ``min_n`` pairs.

    With ``by``, each group is ordered in one task, by x and by y, and nothing is joined; a group that is the whole
    table is ordered by range partitions.
    """
    w = F.col(weight)
    if by:
        r = pairs.withColumns({"_x": F.round("x", 9), "_y": F.round("y", 9)})
        ranked = lambda c: F.sum(w).over(Window.partitionBy(*by).orderBy(c)) - (F.sum(w).over(Window.partitionBy(*by, c)) - 1) / 2
        r = r.withColumn("_rx", ranked("_x")).withColumn("_ry", ranked("_y"))
    else:
        r = average_ranks(pairs, {"x": "_rx", "y": "_ry"}, by, w)
    s = r.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * F.col("_rx")).alias("sx"), F.sum(w * F.col("_ry")).alias("sy"), F.sum(w * F.col("_rx") * F.col("_ry")).alias("sxy"), F.sum(w * F.col("_rx") * F.col("_rx")).alias("sxx"), F.sum(w * F.col("_ry") * F.col("_ry")).alias("syy"))
    n = F.col("n")
    cov, vx, vy = F.col("sxy") - F.col("sx") * F.col("sy") / n, F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    return s.select(*by, F.when((n >= min_n) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("rho"), "n")


def bootstrap_deltas(counts: DataFrame, reps: int = 200, by: Sequence[str] = (), seed: int = 0, min_pairs: int = 3, orders: int = 3) -> DataFrame:
    """(by, rep, delta) over resampled videos, from ``pair_counts`` by (video and ``by``) with permuted orders in it.

    Each replicate draws ``orders`` permuted orders of its own for each of its videos (twice drawn, twice shuffled) out
    of those in ``counts``: with many of them replicates hardly ever share a shuffle.
    """
    pool = counts.agg(F.max("perm")).first()[0] or 0
    drawn = resampled_videos(counts, reps, seed)
    again = drawn.withColumn("_q", F.explode(F.sequence(F.lit(1), F.lit(orders))))
    fresh = again.withColumn("perm", (hash_number(F.col("rep"), F.col("slot"), F.col("_q"), F.lit(seed)) % max(pool, 1) + 1).cast("int"))
    draws = drawn.select("rep", "video", F.lit(0).alias("_q"), F.lit(0).alias("perm")).union(fresh.select("rep", "video", "_q", "perm")).groupBy("rep", "video", "_q", "perm").agg(F.count("*").alias("m"))
    # counts are dealt by pair before replicates multiply them; what then moves is one row a replicate and pair
    dealt = counts.repartition(*by, "x", "y").join(stored(draws), ["video", "perm"])
    weighed = dealt.groupBy(*by, "rep", F.col("_q").alias("perm"), "x", "y").agg(F.sum(F.col("c") * F.col("m")).alias("w"))
    return deltas(stored(weighted_spearman(weighed, [*by, "rep", "perm"], "w", min_pairs)), [*by, "rep"]).select(*by, "rep", "delta").filter("delta is not null")


def interval(replicates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """95 % interval and median of replicate deltas, and the share at or above 0."""
    return replicates.groupBy(*by).agg(F.percentile("delta", 0.025).alias("low"), F.percentile("delta", 0.5).alias("median"), F.percentile("delta", 0.975).alias("high"), F.avg((F.col("delta") >= 0).cast("double")).alias("p_positive"), F.count("*").alias("n_reps"))


def cohort_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Interval of the difference of two cohorts' replicate deltas, which are independent: replicates are paired by number."""
    return interval(a.join(b.select("rep", F.col("delta").alias("_b")), "rep").select("rep", (F.col("delta") - F.col("_b")).alias("delta")))


def leave_one_out(counts: DataFrame, by: Sequence[str] = (), weight: str = "c") -> DataFrame:
    """Spearman without each video in turn, from counts of equal pairs by video.

    A total less a video's own: a row enters with a negative weight, so that nothing is copied for every video but the
    pooled counts of distinct pairs.
    """
    pooled = counts.groupBy(*by, "x", "y").agg(F.sum(weight).alias("c"))
    videos = counts.select(F.col("video").alias("left_out")).distinct()
    less = counts.select(F.col("video").alias("left_out"), *by, "x", "y", (-F.col(weight)).alias("c"))
    each = stored(pooled.crossJoin(videos).select("left_out", *by, "x", "y", "c").unionByName(less).groupBy("left_out", *by, "x", "y").agg(F.sum("c").alias("c")).filter("c > 0"))
    return weighted_spearman(each, ["left_out", *by], "c")


def wild_bootstrap_t(deltas: DataFrame, reps: int = 999, value: str = "delta", unit: str = "video", seed: int = 0) -> DataFrame:
    """Rademacher signs on per-video deltas, imposing a mean of 0: t, two-sided p = (count + 1) / (reps + 1), 95 % interval by the bootstrapped t."""
    sized = deltas.filter(F.col(value).isNotNull())
    n, m, sd = F.count("*"), F.avg(value), F.stddev_samp(value)
    seen = sized.agg((m / (sd / F.sqrt(n))).alias("t0"), m.alias("mean"), (sd / F.sqrt(n)).alias("se"), n.alias("n_units"))
    sign = F.when(F.conv(F.substring(hashed("rep", unit, F.lit(seed)), 1, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    star = sized.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("_v", sign * F.col(value))
    se = F.stddev_samp("_v") / F.sqrt(F.count("*"))
    t = star.groupBy("rep").agg(F.when(se > 0, F.avg("_v") / se).otherwise(0.0).alias("t"))
    out = t.crossJoin(seen).groupBy("t0", "mean", "se", "n_units").agg(F.count_if(F.abs("t") >= F.abs(F.col("t0"))).alias("_k"), F.count("*").alias("_n"), F.percentile(F.abs("t"), 0.975).alias("_q"))
    return out.select(F.col("t0").alias("t"), "mean", "se", "n_units", ((F.col("_k") + 1) / (F.col("_n") + 1)).alias("p"), (F.col("mean") - F.col("_q") * F.col("se")).alias("low"), (F.col("mean") + F.col("_q") * F.col("se")).alias("high"))


def scc_profile(resid: DataFrame, lags: int = 5, key: Sequence[str] = KEY, perms: int = 20, seed: int = 0) -> DataFrame:
    """At each lag the serial correlation of dwells, its permutation mean, and the difference; null below 30 pairs."""
    counts = pair_counts(resid, perms, lags, key, (), seed)
    return deltas(weighted_spearman(counts, ["lag", "perm"], "c", 30), ["lag"])


def scc_intervals(resid: DataFrame, lags: int = 5, key: Sequence[str] = KEY, perms: int = 60, reps: int = 100, seed: int = 0) -> DataFrame:
    """95 % interval over resampled videos of each lag's difference, with permuted orders drawn out of ``perms``."""
    counts = pair_counts(resid, perms, lags, key, ["video"], seed)
    return interval(bootstrap_deltas(counts, reps, ["lag"], seed, 30), ["lag"])
