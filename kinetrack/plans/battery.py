"""Composite jobs: the cohort battery (M31), the design sweep (M16) and the batch pipeline from tracks to agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import CLASSES, state_code
from ..operators import agreement, episodes, laws, order, serial, states, summary
from ..operators.kinematics import KEY
from ..sources.files import stored


def labelled(df: DataFrame, name: str, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of a result as rows (metric, value); a metric's name holds the group."""
    label = F.concat_ws(".", F.lit(name), *[F.col(c).cast("string") for c in by])
    pairs = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])
    return df.select(label.alias("part"), F.explode(pairs).alias("metric", "value")).select(F.concat_ws(".", "part", "metric").alias("metric"), "value")


def cohort_battery(tracks: DataFrame, window: int = 25, key: Sequence[str] = KEY, blocks: Sequence[int] = (13, 25, 51)) -> DataFrame:
    """Dwell laws, dispersion, order gains by frame and by block, ICCs, within-cell CVs and serial memory of a cohort, as (metric, value) rows."""
    st = stored(states.frame_states(tracks, window, key))
    eps = stored(episodes.episodes(st, key))
    hist = episodes.dwell_histogram(eps)
    resid = serial.residuals(eps, 3)
    rows = labelled
    parts = [
        rows(laws.dwell_laws(hist), "law", ["law", "state"], ["a", "aic", "delta_aic"]),
        rows(episodes.geometric_test(hist), "dwell", ["state"], ["mean_s", "cv", "tail_excess", "ks"]),
        rows(order.order_gains(order.order_test(st, key=key)), "order", ["order"], ["gain"]),
        rows(episodes.anova_icc(resid, "resid", list(key)), "log_dwell", [], ["icc"]),
        rows(episodes.rank_icc(resid, key), "rank", ["state"], ["icc"]),
        rows(episodes.pooled_cv(eps), "pooled", ["state"], ["pooled_cv"]),
        rows(episodes.within_cv(eps, 5, key), "within", ["state"], ["median_cv"]),
        rows(serial.permutation_null(serial.residuals(eps), 20, 1, key), "lag1", [], ["observed", "null_mean", "delta"]),
        rows(episodes.switch_rate(st, key=key), "all", [], ["switch_rate"]),
    ]
    # frames, episodes and pair counts are written once: every part reads them again
    for w in blocks:
        parts.append(rows(order.order_gains(order.order_test(states.block_states(tracks, w), key=key, index="block")), f"block{w}", ["order"], ["gain"]))
    return summary.union_all(parts)


def two_cohort_battery(cohorts: dict[str, DataFrame], window: int = 25, key: Sequence[str] = KEY, blocks: Sequence[int] = (13, 25, 51)) -> DataFrame:
    """The battery of two cohorts side by side, with the second one's inflation over the first, (metric, a, b, ratio)."""
    (_, first), (_, second) = cohorts.items()
    a, b = (cohort_battery(t, window, key, blocks) for t in (first, second))
    both = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), "metric", "full")
    return both.select("metric", "a", "b", F.when((F.col("a") != 0) & F.col("a").isNotNull(), F.col("b") / F.col("a")).alias("ratio"))


#: Designs of the classifier: name, immotile and progressive speed, progressive straightness.
DESIGNS = [
    ("baseline", 5.0, 25.0, 0.5), ("v_imm_3", 3.0, 25.0, 0.5), ("v_imm_4", 4.0, 25.0, 0.5), ("v_imm_6", 6.0, 25.0, 0.5), ("v_imm_8", 8.0, 25.0, 0.5), ("v_prog_20", 5.0, 20.0, 0.5),
    ("v_prog_30", 5.0, 30.0, 0.5), ("s_prog_040", 5.0, 25.0, 0.4), ("s_prog_060", 5.0, 25.0, 0.6), ("joint_loose", 3.0, 20.0, 0.4), ("joint_strict", 8.0, 30.0, 0.6),
]


def designed_states(tracks: DataFrame, window: int = 25, margins: Sequence[float] = (0.1, 0.2, 0.3), windows: Sequence[int] = (13, 51), key: Sequence[str] = KEY, designs: Sequence[tuple] = DESIGNS) -> DataFrame:
    """(config, key, frame, idx, state) under each threshold design, hysteresis margin and window; the designs are a bounded list."""
    kin = states.frame_kinematics(tracks, window, key)
    plain = agreement.state_sweep(kin, tracks.sparkSession.createDataFrame(list(designs), "config string, v_imm double, v_prog double, s_prog double"))
    at = [*key, "frame", "idx", "state"]
    parts = [plain.select("config", *at)]
    parts += [episodes.hysteresis_states(kin, m, key).select(F.lit(f"margin_{round(m * 100)}").alias("config"), *at) for m in margins]
    parts += [states.frame_states(tracks, w, key).select(F.lit(f"window_{w}").alias("config"), *at) for w in windows]
    return summary.union_all(parts)


def designed_episodes(tracks: DataFrame, window: int = 25, margins: Sequence[float] = (0.1, 0.2, 0.3), windows: Sequence[int] = (13, 51), key: Sequence[str] = KEY, designs: Sequence[tuple] = DESIGNS) -> DataFrame:
    """The episodes, by config, of ``designed_states``, from one pass over the tracks: frames are not copied for each design, only changes are rows."""
    kin = states.windowed_kinematics(tracks, sorted({window, *windows}), key)
    at = lambda w: (F.col(f"vcl_{w}"), F.col(f"straightness_{w}"))
    plain = {name: state_code(*at(window), *cuts) for name, *cuts in designs} | {f"window_{w}": state_code(*at(w)) for w in windows}
    maps = {}
    for m in margins:
        a, b, c = episodes.hysteresis_maps(m, f"vcl_{window}", f"straightness_{window}")
        maps[f"margin_{round(m * 100)}"] = (a + 3 * b + 9 * c).cast("int")
    by = ["config", *key]
    points = stored(episodes.changes(kin, plain | maps, key))
    held = points.filter(~F.col("config").isin(*maps)).select(*by, "idx", "n_track", F.col("code").alias("state"))
    if maps:
        held = held.unionByName(episodes.hysteresis_changes(points.filter(F.col("config").isin(*maps)), by))
    return episodes.episodes_of_changes(held, by)


def design_sweep(tracks: DataFrame, perms: int = 20, reps: int = 50, key: Sequence[str] = KEY, **options) -> DataFrame:
    """Of each design the lag-1 memory beyond its permutation mean, with its interval over resampled videos, and the number of episodes."""
    key = list(key)
    eps = stored(designed_episodes(tracks, key=key, **options))
    resid = serial.residuals(eps, by=["config"])
    counts = serial.pair_counts(resid, perms, 1, ["config", *key], ["config", "video"])
    pooled = counts.groupBy("config", "perm", "x", "y").agg(F.sum("c").alias("c"))
    seen = serial.deltas(serial.weighted_spearman(pooled, ["config", "perm"], "c", 30), ["config"])
    spread = serial.interval(serial.bootstrap_deltas(counts, reps, ["config"], min_pairs=30), ["config"])
    return seen.join(eps.groupBy("config").agg(F.count("*").alias("n_episodes")), "config").join(spread.select("config", "low", "high"), "config", "left")


def batch_agreement(tracks: DataFrame, detections: DataFrame, clinical: DataFrame) -> DataFrame:
    """Tracks to video summaries to agreement with the clinical table, as one plan over all videos."""
    summaries = summary.video_summary(tracks, detections)
    return agreement.agreement(agreement.compared(clinical, summaries.select("video", *[f"{c}_pct" for c in CLASSES])))
