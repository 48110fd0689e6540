"""Per-track kinematics (W1-W10), track filters (P4, P6) and classes (P5).

All windows share one partitioning and order, so a single exchange and sort feed every column; the grouped
aggregate that follows reuses the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import FPS, MIN_LENGTH, PX_PER_UM, distance, half_even, motility, px_to_um, ratio
from .ranks import exact_quantiles

KEY = ("video", "track_id")
METRICS = ["VCL", "VSL", "VAP", "LIN", "STR", "WOB", "ALH", "BCF"]


def ordered(key: Sequence[str] = KEY):
    return Window.partitionBy(*key).orderBy("frame")


def smooth(c: str, w) -> Column:
    """Centred mean of 5 points, the path reflected at its ends (``b a | a b c ... | z y``)."""
    x = F.col(c)
    back, fore = F.lag(c).over(w), F.lead(c).over(w)
    back2 = F.coalesce(F.lag(c, 2).over(w), F.when(back.isNull(), fore).otherwise(back), x)
    fore2 = F.coalesce(F.lead(c, 2).over(w), F.when(fore.isNull(), back).otherwise(fore), x)
    return (back2 + F.coalesce(back, x) + x + F.coalesce(fore, x) + fore2) / 5


def path_columns(tracks: DataFrame, key: Sequence[str] = KEY, ppm: float = PX_PER_UM) -> DataFrame:
    """Step (um, null at a track's first point), smoothed position, smoothed step, residual, last-point flag."""
    w = ordered(key)
    at = tracks.withColumns({
        "step": px_to_um(distance(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)), ppm),
        "sx": smooth("cx", w), "sy": smooth("cy", w), "is_last": F.lead("frame").over(w).isNull(),
    })
    at = at.withColumns({
        "smooth_step": px_to_um(distance(F.col("sx") - F.lag("sx").over(w), F.col("sy") - F.lag("sy").over(w)), ppm),
        "lateral": F.when(~F.col("is_last"), px_to_um(distance(F.col("cx") - F.col("sx"), F.col("cy") - F.col("sy")), ppm)),
        # the residual of a straight stretch is rounding noise: rounded away before its sign counts
        "side": F.when(~F.col("is_last"), F.signum(F.round(F.col("cx") - F.col("sx"), 9))),
    })
    return at.withColumn("crosses", F.col("side") != F.lag("side").over(w))


def track_metrics(tracks: DataFrame, key: Sequence[str] = KEY, ppm: float = PX_PER_UM, fps: float = FPS, min_length: int = MIN_LENGTH) -> DataFrame:
    """Metrics of each track with at least ``min_length`` points, rounded half-even to 2 or 3 decimals."""
    n = F.count("*")
    total = (F.col("n_frames") - 1) * (1.0 / fps)
    sums = path_columns(tracks, key, ppm).groupBy(*key).agg(
        n.cast("int").alias("n_frames"), F.avg("step").alias("step"), F.avg("smooth_step").alias("smooth_step"), F.avg("lateral").alias("lateral"),
        F.count_if("crosses").alias("crossings"), F.min_by(F.struct("cx", "cy"), "frame").alias("a"), F.max_by(F.struct("cx", "cy"), "frame").alias("b"),
    ).filter(F.col("n_frames") >= min_length)
    raw = sums.select(
        *key, "n_frames", F.round(total, 6).alias("duration_s"), (F.col("step") * fps).alias("vcl"),
        ratio(px_to_um(distance(F.col("b.cx") - F.col("a.cx"), F.col("b.cy") - F.col("a.cy")), ppm), total).alias("vsl"),
        (F.col("smooth_step") * fps).alias("vap"), F.col("lateral").alias("alh"), ratio(F.col("crossings"), total).alias("bcf"),
    )
    return raw.select(
        *key, "n_frames", "duration_s", half_even("vcl", 2).alias("VCL"), half_even("vsl", 2).alias("VSL"), half_even("vap", 2).alias("VAP"),
        half_even(ratio(F.col("vsl"), F.col("vcl")), 3).alias("LIN"), half_even(ratio(F.col("vsl"), F.col("vap")), 3).alias("STR"),
        half_even(ratio(F.col("vap"), F.col("vcl")), 3).alias("WOB"), half_even("alh", 2).alias("ALH"), half_even("bcf", 2).alias("BCF"),
    )


def extra_metrics(tracks: DataFrame, key: Sequence[str] = KEY, min_length: int = MIN_LENGTH) -> DataFrame:
    """Circular SD of turning angles (pi where directions cancel) and coefficient of variation of speed."""
    w = ordered(key)
    step = tracks.withColumns({"dx": F.col("cx") - F.lag("cx").over(w), "dy": F.col("cy") - F.lag("cy").over(w)})
    turn = step.withColumns({"speed": distance(F.col("dx"), F.col("dy")), "heading": F.atan2("dy", "dx")}).withColumn("turn", F.col("heading") - F.lag("heading").over(w))
    sums = turn.groupBy(*key).agg(F.count("*").alias("n"), F.avg(F.sin("turn")).alias("s"), F.avg(F.cos("turn")).alias("c"), F.stddev_pop("speed").alias("sd"), F.avg("speed").alias("mean"))
    r = distance(F.col("s"), F.col("c"))
    tac = F.when(F.col("n") < 3, 0.0).when(r > 1e-12, F.sqrt(F.greatest(F.lit(0.0), -2 * F.log(r)))).otherwise(3.141592653589793)
    return sums.filter(F.col("n") >= min_length).select(*key, half_even(tac, 4).alias("TAC"), half_even(ratio(F.col("sd"), F.col("mean")), 4).alias("VAR_V"))


def long_enough(tracks: DataFrame, n: int = MIN_LENGTH, key: Sequence[str] = KEY) -> DataFrame:
    """Points of tracks that have at least ``n``."""
    return tracks.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).filter(F.col("_n") >= n).drop("_n")


def track_lengths(tracks: DataFrame, points: Sequence[float] = (0.05, 0.5, 0.95), key: Sequence[str] = KEY) -> DataFrame:
    """Quantiles and mean of the tracks' numbers of points."""
    lengths = tracks.groupBy(*key).agg(F.count("*").alias("n"))
    told = exact_quantiles(lengths, {"n": {f"q{int(p * 100)}": p for p in points}})
    return told.crossJoin(lengths.agg(F.avg("n").alias("mean"), F.count("*").alias("n_tracks")))


def mean_confidence(tracks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """A1."""
    return tracks.groupBy(*key).agg(F.avg("conf").alias("mean_conf"))


def reject_reason(conf_min: float = 0.4, vcl_max: float = 200.0, jitter_vcl: float = 20.0, jitter_lin: float = 0.02, min_seconds: float = 0.3) -> Column:
    """The first reason that drops a track, or null; a track without confidence counts as 0."""
    return (
        F.when(F.coalesce("mean_conf", F.lit(0.0)) < conf_min, "low_conf").when(F.col("VCL") > vcl_max, "high_vcl")
        .when((F.col("VCL") > jitter_vcl) & (F.col("LIN") < jitter_lin), "jitter").when(F.col("duration_s") < min_seconds, "short_duration")
    )


def judged_tracks(tracks: DataFrame, key: Sequence[str] = KEY, **metric_options) -> DataFrame:
    """Metrics with mean confidence, reason of rejection (null: kept) and class."""
    metrics = track_metrics(tracks, key, **metric_options)
    joined = metrics.join(mean_confidence(tracks, key), list(key), "left")
    return joined.withColumn("reason", reject_reason()).withColumn("motility", motility(F.col("VCL"), F.col("STR")))


def track_features(tracks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Kept tracks with metrics, class, PWR = ALH * BCF, TAC, VAR_V and DUR."""
    kept = judged_tracks(tracks, key).filter("reason is null").drop("reason", "mean_conf")
    return kept.join(extra_metrics(tracks, key), list(key)).withColumns({"PWR": half_even(F.col("ALH") * F.col("BCF"), 4), "DUR": F.col("duration_s")})
