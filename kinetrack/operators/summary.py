"""Video and cohort summaries (A2-A8), rankings (T1k-T3k) and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import CLASSES, half_even, who_flags
from .kinematics import KEY, judged_tracks


def active_tracks(tracks: DataFrame, video: str = "video") -> DataFrame:
    """A2: tracks per frame, averaged over a video's frames (two partial aggregations instead of one distinct count per frame)."""
    per_frame = tracks.select(video, "frame", "track_id").distinct().groupBy(video, "frame").agg(F.count("*").alias("n"))
    return per_frame.groupBy(video).agg(F.avg("n").alias("avg_active"))


def detection_stats(detections: DataFrame, video: str = "video", cls: int = 0) -> DataFrame:
    """A3: boxes of one class per frame; frames without a box count, a video without any gives nulls."""
    per_frame = detections.groupBy(video, "frame").agg(F.count_if(F.col("cls") == cls).alias("n"))
    out = per_frame.groupBy(video).agg(F.sum("n").alias("total"), F.avg("n").alias("mean"), F.count_if(F.col("n") > 0).alias("frames"))
    seen = F.col("total") > 0
    return out.select(video, F.when(seen, F.col("total")).alias("total_detections"), F.when(seen, F.col("mean")).alias("avg_detections"), F.when(seen, F.col("frames")).alias("frames_with_boxes"))


def class_counts(kept: DataFrame, by: Sequence[str] = ("video",)) -> DataFrame:
    """A4: tracks and percentages of each class."""
    counts = kept.groupBy(*by).agg(F.count("*").alias("total_tracks"), *[F.count_if(F.col("motility") == c).alias(c) for c in CLASSES])
    return counts.withColumns({f"{c}_pct": half_even(100.0 * F.col(c) / F.col("total_tracks"), 1) for c in CLASSES})


def adjusted(df: DataFrame) -> DataFrame:
    """A5: untracked objects counted as immotile, from avg_detections and avg_active (null detections: no adjustment)."""
    det, act, total = F.coalesce("avg_detections", F.lit(0.0)), F.col("avg_active"), F.col("total_tracks")
    known = F.col("avg_detections").isNotNull()
    missing = F.when(known, F.greatest(F.lit(0.0), half_even(det - act, 0))).otherwise(0.0).cast("long")
    fraction = F.when(known & (det > 0), F.greatest(F.lit(0.0), (det - act) / det)).otherwise(0.0)
    pct = {c: F.when(total > 0, half_even(100 * (F.col(c) / total) * (1 - F.col("_fraction")), 1)).otherwise(0.0) for c in CLASSES[:2]}
    out = df.withColumns({"estimated_untracked": missing, "_fraction": fraction}).withColumns({f"adjusted_{c}_pct": x for c, x in pct.items()})
    return out.withColumns({
        "adjusted_immotile_pct": half_even(100.0 - F.col("adjusted_progressive_pct") - F.col("adjusted_non_progressive_pct"), 1),
        "adjusted_total": total + F.col("estimated_untracked"), "adjusted_immotile": F.col("immotile") + F.col("estimated_untracked"),
        "untracked_fraction": half_even("_fraction", 4),
    }).drop("_fraction")


def video_summary(tracks: DataFrame, detections: DataFrame | None = None, key: Sequence[str] = KEY, video: str = "video") -> DataFrame:
    """One row per video with filter counters, class mix, adjusted mix and mean kinematics, for all videos at once.

    Videos whose tracks are all rejected or too short keep a row with zero counts and null means.
    """
    judged = judged_tracks(tracks, key)
    kept = F.col("reason").isNull()
    one = lambda c: F.when(kept, F.col(c))
    agg = judged.groupBy(video).agg(
        F.count("*").alias("tracks_before_filter"), *[F.count_if(F.col("reason") == r).alias(f"filtered_{r}") for r in ("low_conf", "high_vcl", "jitter", "short_duration")],
        F.count_if(kept).alias("total_tracks"), *[F.count_if(kept & (F.col("motility") == c)).alias(c) for c in CLASSES],
        *[half_even(F.round(F.avg(one(m)), 9), d).alias(f"mean_{m}") for m, d in (("VCL", 2), ("VSL", 2), ("VAP", 2), ("LIN", 3), ("STR", 3), ("WOB", 3), ("ALH", 2), ("BCF", 2))],
    )
    agg = agg.withColumns({f"{c}_pct": F.when(F.col("total_tracks") > 0, half_even(100.0 * F.col(c) / F.col("total_tracks"), 1)) for c in CLASSES})
    joined = agg.join(active_tracks(tracks, video), video, "left")
    if detections is None:
        joined = joined.withColumn("avg_detections", F.lit(None).cast("double"))
    else:
        joined = joined.join(detection_stats(detections, video).select(video, "avg_detections"), video, "left")
    return adjusted(joined).withColumns({"avg_active": half_even("avg_active", 2), "avg_detections": half_even(F.coalesce("avg_detections", F.lit(0.0)), 2)})


def cohort_means(summaries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means of summary columns over videos."""
    return summaries.agg(F.count("*").alias("n_videos"), *[F.avg(c).alias(c) for c in columns])


def weighted_mix(summaries: DataFrame) -> DataFrame:
    """Class mix weighted by each video's number of tracks."""
    return summaries.agg(*[(F.sum(F.col("total_tracks") * F.col(f"{c}_pct")) / F.sum("total_tracks")).alias(f"{c}_pct") for c in CLASSES])


def compliance(summaries: DataFrame) -> DataFrame:
    """Whether a video meets the reference limits."""
    total, prog = who_flags(F.col("progressive_pct") + F.col("non_progressive_pct"), F.col("progressive_pct"))
    return summaries.select("video", total.alias("meets_total"), prog.alias("meets_progressive"))


def fastest(kept: DataFrame, n: int = 5, motility: str | None = "progressive", by: str = "VCL") -> DataFrame:
    """T1k: the n largest of each video, ties by track id."""
    pool = kept.filter(F.col("motility") == motility) if motility else kept
    w = Window.partitionBy("video").orderBy(F.col(by).desc(), "track_id")
    return pool.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def numeric_order(df: DataFrame, column: str = "video") -> DataFrame:
    """T3k: rows ordered as numbers where the id is one, then as text."""
    return df.orderBy(F.expr(f"try_cast({column} as int)").asc_nulls_last(), column)


def seeded_cap(df: DataFrame, cap: int, key: Sequence[str] = KEY, group: str = "video", seed: int = 0) -> DataFrame:
    """T4k: rows of at most ``cap`` keys a group, those of smallest MD5 of key and seed (without replacement)."""
    keys = df.select(*key).distinct()
    order = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    picked = keys.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order, *key))).filter(F.col("_n") <= cap).drop("_n")
    return df.join(picked, list(key), "left_semi")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shared_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U2 / J6."""
    return a.select(*keys).intersect(b.select(*keys))


def unknown_keys(wanted: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys asked for that are not known."""
    return wanted.select(*keys).distinct().join(known, list(keys), "left_anti")
