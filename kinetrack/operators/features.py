"""Participant and sample features (A24-A29, A31, P11), rank statistics (M18, M19, M27, M28) and multiplicity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import FPS, pearson
from ..functions.special import column_of, correlation_p, normal_p
from ..sources.files import stored
from .episodes import episodes, transition_counts, transition_probabilities
from .kinematics import KEY
from .ranks import exact_quantiles
from .serial import average_ranks, hashed

SHORT = ("prog", "nonprog", "immotile")


def gini(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Gini coefficient of each group, from counts of equal values; 0 for a zero sum."""
    h = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    ranked = h.withColumn("r", F.sum("c").over(w) - (F.col("c") - 1) / 2)
    s = ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col(value)).alias("s"), F.sum(F.col("c") * F.col("r") * F.col(value)).alias("rs"))
    return s.select(*by, F.when(F.col("s") > 0, (2 * F.col("rs") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))).otherwise(0.0).alias("gini"))


def cell_rates(states: DataFrame, min_frames: int = 10, key: Sequence[str] = KEY, fps: float = FPS) -> DataFrame:
    """Switches per second of each track."""
    w = Window.partitionBy(*key).orderBy("idx")
    sw = states.withColumn("sw", F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(0)))
    per = sw.groupBy(*key).agg(F.sum("sw").alias("switches"), F.count("*").alias("n"), F.min_by("state", "idx").alias("first_state"))
    return per.filter(F.col("n") >= min_frames).withColumn("rate", F.col("switches") / (F.col("n") / fps))


def rate_features(rates: DataFrame, video: str = "video") -> DataFrame:
    """Participant summary of switch rates."""
    base = rates.groupBy(video).agg(F.count("*").alias("n_cells"), F.avg("rate").alias("mean_rate"), F.stddev_pop("rate").alias("sd_rate"), F.avg((F.col("switches") == 0).cast("double")).alias("stayer_frac"))
    base = base.withColumn("cv_rate", F.when(F.col("mean_rate") > 0, F.col("sd_rate") / F.col("mean_rate")))
    return base.join(gini(rates.withColumn("rate", F.round("rate", 9)), "rate", [video]).withColumnRenamed("gini", "gini_rate"), video)


def stayer_features(states: DataFrame, video: str = "video", key: Sequence[str] = KEY, min_frames: int = 10) -> DataFrame:
    """Shares of tracks that never switch, by their state, and the frame composition."""
    cells = cell_rates(states, min_frames, key)
    stay = F.col("switches") == 0
    share = lambda c: F.avg(c.cast("double"))
    per = cells.groupBy(video).agg(F.count("*").alias("n_cells"), share(stay).alias("stayer_frac"), *[share(stay & (F.col("first_state") == k)).alias(f"stable_{n}_frac") for k, n in enumerate(SHORT)])
    comp = states.join(cells.select(*key), list(key), "left_semi").groupBy(video).agg(*[share(F.col("state") == k).alias(f"frac_{n}") for k, n in enumerate(SHORT)])
    return per.join(comp, video)


def participant_features(metrics: DataFrame, states: DataFrame, video: str = "video", key: Sequence[str] = KEY, fps: float = FPS) -> DataFrame:
    """Means and sample SDs of the metrics, state composition, persistence, asymmetries and dwell statistics (10 dwells or null)."""
    names = ["VCL", "VSL", "VAP", "LIN", "STR", "WOB", "ALH", "BCF"]
    casa = metrics.groupBy(video).agg(F.count("*").alias("n_tracks"), *[f(m).alias(f"{m}_{s}") for m in names for f, s in ((F.avg, "mean"), (F.stddev_samp, "sd"))])
    comp = states.groupBy(video).agg(F.count("*").alias("n_frames"), *[F.avg((F.col("state") == k).cast("double")).alias(f"frac_{n}") for k, n in enumerate(SHORT)])
    p = transition_probabilities(transition_counts(states, [video], key), [video])
    cell = lambda i, j: F.sum(F.when((F.col("from") == i) & (F.col("to") == j), F.col("p")))
    move = p.groupBy(video).agg(*[cell(k, k).alias(f"stay_{n}") for k, n in enumerate(SHORT)], *[(cell(a, b) - cell(b, a)).alias(f"asym_{SHORT[a]}_{SHORT[b]}") for a, b in ((0, 1), (1, 2), (0, 2))])
    run = lambda k: F.when(F.col("state") == k, F.col("run"))
    enough = lambda k, c: F.when(F.count(run(k)) >= 10, c)
    dwell = episodes(states, key).groupBy(video).agg(*[c for k, n in enumerate(SHORT) for c in (enough(k, F.avg(run(k)) / fps).alias(f"dwell_mean_{n}"), enough(k, F.stddev_pop(run(k)) / F.avg(run(k))).alias(f"dwell_cv_{n}"))])
    return casa.join(comp, video).join(move, video).join(dwell, video)


def sample_features(features: DataFrame, by: str = "video", min_tracks: int = 1) -> DataFrame:
    """Class mix (set A) and the kinematic distribution (set B, 24 columns) of each sample."""
    three, spread = {"p10": 0.1, "p50": 0.5, "p90": 0.9}, {"_q1": 0.25, "_q3": 0.75}
    points = {m: three | spread for m in ("VCL", "ALH", "BCF", "LIN")} | {"PWR": {"p90": 0.9} | spread, "TAC": {"med": 0.5} | spread, "VAR_V": {"med": 0.5}, "DUR": {"med": 0.5}}
    wanted = {m: {f"{m}_{n}": p for n, p in told.items()} for m, told in points.items()}
    pct = [(100.0 * F.count_if(F.col("motility") == m) / F.count("*")).alias(f"{n}_pct") for m, n in (("progressive", "prog"), ("non_progressive", "nonprog"), ("immotile", "immot"))]
    bands = [F.avg((F.col("VCL") > 50).cast("double")).alias("vigorous_frac"), F.avg(F.col("VCL").between(5, 25).cast("double")).alias("intermediate_frac"), F.log(F.count("*")).alias("log_ntracks")]
    mix = features.groupBy(by).agg(*pct, *bands, F.count("*").alias("n_tracks")).filter(F.col("n_tracks") >= min_tracks)
    told = exact_quantiles(features, wanted, [by])
    columns = [c for m in points for c in (*[x for x in wanted[m] if not x.endswith(("_q1", "_q3"))], *([f"{m}_iqr"] if "_q1" in points[m] else []))]
    for m in (m for m in points if "_q1" in points[m]):
        told = told.withColumn(f"{m}_iqr", F.col(f"{m}__q3") - F.col(f"{m}__q1"))
    return mix.join(told.select(F.col(by).alias("_by"), *columns), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def partial_spearman(df: DataFrame, x: str, y: str, *controls: str) -> DataFrame:
    """Spearman of x and y after their ranks are freed, linearly, from the controls' ranks, with its two-sided p.

    The normal equations are one aggregate of (controls + 1)^2 sums; constant controls are harmless (least squares of
    smallest norm).
    """
    names = [x, y, *controls]
    ranked = stored(average_ranks(stored(df.select(*dict.fromkeys(names)).dropna()), {c: f"_r_{c}" for c in dict.fromkeys(names)}))
    one = [F.lit(1.0), *[F.col(f"_r_{c}") for c in controls]]
    cells = {f"g{i}_{j}": F.sum(a * b) for i, a in enumerate(one) for j, b in enumerate([*one, F.col(f"_r_{x}"), F.col(f"_r_{y}")])}
    sums = ranked.agg(*[c.alias(k) for k, c in cells.items()]).first()
    p = len(one)
    g = np.array([[sums[f"g{i}_{j}"] or 0.0 for j in range(p + 2)] for i in range(p)])
    beta = np.linalg.lstsq(g[:, :p], g[:, p:], rcond=None)[0]
    rest = lambda c, k: F.col(f"_r_{c}") - sum((b * float(w) for b, w in zip(one, beta[:, k], strict=True)), F.lit(0.0))
    left = ranked.select(rest(x, 0).alias("x"), rest(y, 1).alias("y"))
    again = average_ranks(left, {"x": "_a", "y": "_b"})
    out = again.agg(pearson("_a", "_b").alias("rho"), F.count("*").alias("n"))
    return out.withColumn("p", column_of(correlation_p, "rho", "n"))


def split_half_features(rates: DataFrame, key: Sequence[str] = KEY, video: str = "video", seed: int = 0) -> DataFrame:
    """(video, feature, x, y): CV of rates, stayer share and Gini of each hashed half of a participant's tracks."""
    half = F.row_number().over(Window.partitionBy(video).orderBy(hashed(*key, F.lit(seed)), *key)) % 2
    per = rate_features(rates.withColumn("half", half).withColumn("_unit", F.struct(video, "half")), "_unit")
    names = ("cv_rate", "stayer_frac", "gini_rate")
    long = per.select(F.col(f"_unit.{video}").alias(video), F.col("_unit.half").alias("half"), F.explode(F.create_map(*[v for c in names for v in (F.lit(c), F.col(c))])).alias("feature", "v"))
    side = lambda k: F.max(F.when(F.col("half") == k, F.col("v")))
    return long.groupBy(video, "feature").agg(side(0).alias("x"), side(1).alias("y")).filter("x is not null and y is not null")


def split_half(rates: DataFrame, key: Sequence[str] = KEY, video: str = "video", seed: int = 0) -> DataFrame:
    """Mean rate of each hashed half of a participant's tracks."""
    half = F.row_number().over(Window.partitionBy(video).orderBy(hashed(*key, F.lit(seed)), *key)) % 2
    return rates.withColumn("half", half).groupBy(video).agg(F.avg(F.when(F.col("half") == 0, F.col("rate"))).alias("x"), F.avg(F.when(F.col("half") == 1, F.col("rate"))).alias("y")).filter("x is not null and y is not null")


def holm(df: DataFrame, p: str = "p") -> DataFrame:
    """Holm-adjusted p-values (running maximum of (m - rank + 1) p); one row per test, a bounded table."""
    w = Window.orderBy(p)
    m = F.count("*").over(Window.partitionBy())
    ranked = df.withColumn("_a", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    return ranked.withColumn("holm", F.max("_a").over(w)).drop("_a")


def benjamini_hochberg(df: DataFrame, p: str = "p") -> DataFrame:
    """BH-adjusted p-values (running minimum of m p / rank, from the largest down)."""
    m = F.count("*").over(Window.partitionBy())
    ranked = df.withColumn("_a", F.least(F.lit(1.0), m * F.col(p) / F.row_number().over(Window.orderBy(p))))
    return ranked.withColumn("bh", F.min("_a").over(Window.orderBy(F.col(p).desc()))).drop("_a")


def univariate_spearman(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Spearman of each feature with the target, all in one pass over a long table."""
    from .serial import spearman

    long = df.select(F.col(target).cast("double").alias("y"), F.explode(F.create_map(*[v for c in features for v in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "x"))
    return spearman(long.filter("x is not null and y is not null"), ["feature"], few=True)


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank sums of paired differences (zeros dropped, average ranks) and the two-sided normal p, corrected for ties."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).filter("abs(d) > 1e-12").withColumn("m", F.abs("d"))
    r = average_ranks(d, {"m": "r"})
    out = r.agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"), F.count("*").alias("n"))
    t = F.col("t")
    ties = d.groupBy(F.round("m", 9).alias("m")).agg(F.count("*").alias("t")).agg(F.coalesce(F.sum(t * t * t - t), F.lit(0)).alias("ties"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.when(spread > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / spread)
    return out.crossJoin(ties).select("w_plus", "w_minus", "n", column_of(normal_p, z).alias("p"))
