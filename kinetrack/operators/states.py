"""Frame-level states (W11, W12), block states (W13, W14), temporal windows (W15) and as-of classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import FPS, MIN_LENGTH, PX_PER_UM, STATE_WINDOW, distance, ratio, state_code
from ..functions.special import column_of, correlation_p
from .kinematics import KEY, ordered


def with_steps(tracks: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Columns from which any window's path, net and smoothed path follow (in pixels).

    The 5-point smoothing is reflected at a window's own ends; its steps are then |p[j+3] - p[j-2]| / 5 inside, and
    four short differences at the two ends (``elo``, ``ehi``).
    """
    w = ordered(key)

    def gap(a: int, b: int) -> Column:
        x, y = ((F.lead(c, a) if a else F.col(c)) if a >= 0 else F.lag(c, -a) for c in ("cx", "cy"))
        u, v = ((F.lead(c, b) if b else F.col(c)) if b >= 0 else F.lag(c, -b) for c in ("cx", "cy"))
        x, y = (q.over(w) if a else q for q in (x, y))
        u, v = (q.over(w) if b else q for q in (u, v))
        return distance(x - u, y - v)

    return tracks.withColumns({"idx": F.row_number().over(w) - 1, "n_track": F.count("*").over(Window.partitionBy(*key)), "step": gap(0, -1), "g": gap(3, -2), "elo": gap(3, 1) + gap(4, 0), "ehi": gap(0, -4) + gap(-1, -3)})


def window_kinematics(path: Column, net: Column, inner: Column, elo: Column, ehi: Column, m: Column, ppm: float, fps: float) -> tuple[Column, Column]:
    """VCL and STR of a window of ``m`` points from its sums."""
    smooth = (F.coalesce(inner, F.lit(0.0)) + elo + ehi) / 5
    return path / (m - 1) / ppm * fps, ratio(net, smooth)


def windowed_kinematics(tracks: DataFrame, windows: Sequence[int], key: Sequence[str] = KEY, ppm: float = PX_PER_UM, fps: float = FPS, min_length: int = MIN_LENGTH) -> DataFrame:
    """VCL and STR (``vcl_<window>``, ``straightness_<window>``) of each centred window at each frame, from one pass over the ordered tracks.

    Windows are cut at a track's ends, short tracks are one window. Each is odd and at least 9, so that every cut window
    still holds 5 points.
    """
    if any(window % 2 == 0 or window < 9 for window in windows):
        raise ValueError("the window must be odd and at least 9")
    w, whole = ordered(key), Window.partitionBy(*key).orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = with_steps(tracks, key).filter(F.col("n_track") >= min_length)

    def parts(span, steps, inner) -> tuple[Column, ...]:
        ends = [F.first(c).over(span) for c in ("cx", "cy")], [F.last(c).over(span) for c in ("cx", "cy")]
        return F.sum("step").over(steps), distance(ends[1][0] - ends[0][0], ends[1][1] - ends[0][1]), F.sum("g").over(inner), F.first("elo").over(span), F.last("ehi").over(span), F.count("*").over(span)

    all_ = window_kinematics(*parts(whole, whole, whole), ppm, fps)
    told = []
    for window in windows:
        h = window // 2
        cut = window_kinematics(*parts(w.rowsBetween(-h, h), w.rowsBetween(1 - h, h), w.rowsBetween(2 - h, h - 3)), ppm, fps)
        short = F.col("n_track") < window
        told += [F.when(short, of_all).otherwise(of_cut).alias(f"{name}_{window}") for name, of_all, of_cut in zip(("vcl", "straightness"), all_, cut, strict=True)]
    return base.select(*key, "frame", "idx", "n_track", *told)


def frame_kinematics(tracks: DataFrame, window: int = STATE_WINDOW, key: Sequence[str] = KEY, **options) -> DataFrame:
    """VCL and STR of the centred window at each frame, see ``windowed_kinematics``."""
    return windowed_kinematics(tracks, [window], key, **options).select(*key, "frame", "idx", "n_track", F.col(f"vcl_{window}").alias("vcl"), F.col(f"straightness_{window}").alias("straightness"))


def frame_states(tracks: DataFrame, window: int = STATE_WINDOW, key: Sequence[str] = KEY, **options) -> DataFrame:
    """(key, frame, idx, state) with the state as 0 progressive, 1 non-progressive, 2 immotile."""
    return frame_kinematics(tracks, window, key, **options).select(*key, "frame", "idx", state_code(F.col("vcl"), F.col("straightness")).alias("state"))


def block_states(tracks: DataFrame, block: int = STATE_WINDOW, key: Sequence[str] = KEY, min_blocks: int = 3, ppm: float = PX_PER_UM, fps: float = FPS) -> DataFrame:
    """One state per non-overlapping block of ``block`` points; a tail is dropped, tracks need ``min_blocks`` blocks."""
    numbered = tracks.withColumn("idx", F.row_number().over(ordered(key)) - 1).withColumn("block", F.floor(F.col("idx") / block)).withColumn("n_track", F.count("*").over(Window.partitionBy(*key)))
    full = numbered.filter((F.floor(F.col("n_track") / block) >= min_blocks) & (F.col("block") < F.floor(F.col("n_track") / block))).drop("idx")
    inside = with_steps(full.drop("n_track"), (*key, "block"))
    ends = F.min_by(F.struct("cx", "cy", "elo"), "frame").alias("a"), F.max_by(F.struct("cx", "cy", "ehi"), "frame").alias("b")
    sums = inside.groupBy(*key, "block").agg(F.sum("step").alias("path"), F.sum("g").alias("g"), F.count("*").alias("m"), *ends)
    net = distance(F.col("b.cx") - F.col("a.cx"), F.col("b.cy") - F.col("a.cy"))
    vcl, straight = window_kinematics(F.col("path"), net, F.col("g"), F.col("a.elo"), F.col("b.ehi"), F.col("m"), ppm, fps)
    return sums.select(*key, "block", state_code(vcl, straight).alias("state"))


def modal_blocks(states: DataFrame, block: int = STATE_WINDOW, key: Sequence[str] = KEY, min_blocks: int = 2) -> DataFrame:
    """The most frequent state of each block of frames (ties: the lowest), for tracks with ``min_blocks`` whole blocks."""
    sized = states.withColumn("blocks", F.floor(F.count("*").over(Window.partitionBy(*key)) / block)).withColumn("block", F.floor(F.col("idx") / block))
    counts = sized.filter((F.col("blocks") >= min_blocks) & (F.col("block") < F.col("blocks"))).groupBy(*key, "block", "state").agg(F.count("*").alias("n"))
    return counts.groupBy(*key, "block").agg(F.max(F.struct("n", (-F.col("state")).alias("s"))).alias("m")).select(*key, "block", (-F.col("m.s")).cast("int").alias("state"))


def temporal_windows(tracks: DataFrame, window_frames: int = 250, state_window: int = STATE_WINDOW, video: str = "video", key: Sequence[str] = KEY, fps: float = FPS) -> DataFrame:
    """Class mix of each fixed window of a video, from the state of each overlapping track at its middle.

    The interval join is a list of window numbers per track; the as-of lookup takes the first frame at or after the
    middle, else the track's last. A video's trailing part of a window is dropped unless it is the only one.
    """
    videos = tracks.groupBy(video).agg(F.greatest(F.lit(1), F.floor(F.max("frame") / window_frames)).alias("n_windows"))
    states = frame_states(tracks, state_window, key)
    half, w = window_frames // 2, ordered(key)
    # each frame answers for the windows whose middle lies behind its predecessor; the last one for all that remain
    lone = states.withColumns({"before": F.lag("frame").over(w), "is_last": F.lead("frame").over(w).isNull()})
    low = F.when(F.col("before").isNull(), F.floor(F.col("frame") / window_frames)).otherwise(F.floor((F.col("before") - half) / window_frames) + 1)
    high = F.when(F.col("is_last"), F.floor(F.col("frame") / window_frames)).otherwise(F.floor((F.col("frame") - half) / window_frames))
    asof = lone.withColumns({"low": low, "high": high}).filter("low <= high").select(*key, "state", F.explode(F.sequence("low", "high")).alias("window"))
    state = asof.join(videos, video).filter(F.col("window") < F.col("n_windows"))
    mix = state.groupBy(video, "window").agg(F.count("*").alias("n_active"), *[F.count_if(F.col("state") == k).alias(f"n_{c}") for k, c in enumerate(("progressive", "non_progressive", "immotile"))])
    return mix.select(
        video, (F.col("window") + 1).alias("window"), (F.col("window") * window_frames / fps).alias("t_start_s"), ((F.col("window") + 0.5) * window_frames / fps).alias("t_mid_s"), ((F.col("window") + 1) * window_frames / fps).alias("t_end_s"),
        "n_active", *[f"n_{c}" for c in ("progressive", "non_progressive", "immotile")], *[(100.0 * F.col(f"n_{c}") / F.col("n_active")).alias(f"pct_{c}") for c in ("progressive", "non_progressive", "immotile")],
    )


def temporal_aggregate(windows: DataFrame) -> DataFrame:
    """Mean and sample SD over videos for each window."""
    pct = ("progressive", "non_progressive", "immotile")
    return windows.groupBy("window").agg(F.first("t_mid_s").alias("t_mid_s"), F.count_distinct("video").alias("n_videos"), F.avg("n_active").alias("n_active_mean"), *[f(f"pct_{c}").alias(f"pct_{c}_{n}") for c in pct for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def linear_trends(windows: DataFrame, x: str = "t_mid_s", columns: Sequence[str] = ("pct_progressive", "pct_non_progressive", "pct_immotile")) -> DataFrame:
    """Slope, intercept, R2 and the slope's two-sided p of each column over time."""
    long = windows.select(F.col(x).alias("x"), F.explode(F.create_map(*[v for c in columns for v in (F.lit(c), F.col(c))])).alias("series", "y"))
    fits = long.groupBy("series").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.regr_count("y", "x").alias("_n"))
    return fits.withColumn("p", column_of(correlation_p, F.sqrt("r2"), "_n")).drop("_n")


def wide_heatmap(windows: DataFrame, windows_shown: Sequence[int] | None = None, value: str = "pct_progressive") -> DataFrame:
    """Video by window matrix; all windows of the data where none are named, as many as the longest video has."""
    shown = sorted(r["window"] for r in windows.select("window").distinct().collect()) if windows_shown is None else list(windows_shown)
    return windows.groupBy("video").pivot("window", shown).agg(F.first(value))


def heatmap_cells(wide: DataFrame, value: str = "pct_progressive") -> DataFrame:
    """The cells of a video by window matrix as rows (video, window, value), empty cells null."""
    shown = [c for c in wide.columns if c != "video"]
    return wide.unpivot("video", shown, "window", value).withColumn("window", F.col("window").cast("long"))
