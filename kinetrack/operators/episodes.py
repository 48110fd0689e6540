"""Dwell episodes (W16-W18, W25, W34), transitions (A15-A20) and dwell statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import FPS, MIN_LENGTH
from ..functions.special import column_of, kolmogorov_p
from ..sources.files import stored
from .kinematics import KEY, ordered
from .ranks import exact_quantiles
from .scans import MAPS, composed_maps, stack_merge
from .serial import average_ranks, hashed, spearman


def episodes(states: DataFrame, key: Sequence[str] = KEY, order: str = "idx") -> DataFrame:
    """Runs of equal states: (key, ep_idx, state, run, n_eps, is_first, is_last, censored).

    ``censored``: the run touches an end of its track. One exchange: the grouping reuses the windows' partitioning.
    """
    w = Window.partitionBy(*key).orderBy(order)
    marked = states.withColumn("_new", F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(0))).withColumn("ep_idx", F.sum("_new").over(w))
    runs = marked.groupBy(*key, "ep_idx").agg(F.first("state").alias("state"), F.count("*").alias("run"))
    out = runs.withColumn("n_eps", F.count("*").over(Window.partitionBy(*key)))
    first, last = F.col("ep_idx") == 0, F.col("ep_idx") == F.col("n_eps") - 1
    return out.withColumns({"is_first": first, "is_last": last, "censored": first | last})


def changes(df: DataFrame, codes: Mapping[str, Column], key: Sequence[str] = KEY, order: str = "frame", name: str = "config") -> DataFrame:
    """(name, key, idx, n_track, code): of several codes a row, each code where it differs from that of the track's row before.

    One pass over the ordered tracks, however many codes there are: only changes become rows. ``df`` has idx and n_track.
    """
    w, names = Window.partitionBy(*key).orderBy(order), list(codes)
    now = df.select(*key, order, "idx", "n_track", *[c.alias(f"_c{k}") for k, c in enumerate(codes.values())])
    new = [F.col(f"_c{k}") != F.coalesce(F.col(f"_b{k}"), F.lit(-1)) for k in range(len(names))]
    seen = now.withColumns({f"_b{k}": F.lag(f"_c{k}").over(w) for k in range(len(names))}).filter(reduce(or_, new))
    rows = F.array(*[F.when(x, F.struct(F.lit(n).alias(name), F.col(f"_c{k}").alias("code"))) for k, (n, x) in enumerate(zip(names, new, strict=True))])
    return seen.select(*key, "idx", "n_track", F.explode(rows).alias("_x")).filter("_x is not null").select(f"_x.{name}", *key, "idx", "n_track", "_x.code")


def episodes_of_changes(points: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``episodes`` from the rows (key, idx, n_track, state) at which a track's state changes, its first row included."""
    w, whole = Window.partitionBy(*key).orderBy("idx"), Window.partitionBy(*key)
    run = F.coalesce(F.lead("idx").over(w).cast("long"), F.col("n_track")) - F.col("idx")
    out = points.select(*key, (F.row_number().over(w) - 1).cast("long").alias("ep_idx"), "state", run.alias("run"), F.count("*").over(whole).alias("n_eps"))
    first, last = F.col("ep_idx") == 0, F.col("ep_idx") == F.col("n_eps") - 1
    return out.withColumns({"is_first": first, "is_last": last, "censored": first | last})


def transition_counts(states: DataFrame, by: Sequence[str] = (), key: Sequence[str] = KEY, order: str = "idx", n_states: int = 3) -> DataFrame:
    """(by, from, to, n) with zero cells; a last state has no successor."""
    nxt = states.select(*key, *[c for c in by if c not in key], F.col("state").alias("from"), F.lead("state").over(Window.partitionBy(*key).orderBy(order)).alias("to"))
    counts = nxt.filter("to is not null").groupBy(*by, "from", "to").agg(F.count("*").alias("n"))
    cells = states.select(*by).distinct() if by else states.sparkSession.range(1).select()
    grid = cells.withColumn("from", F.explode(F.array(*map(F.lit, range(n_states))))).withColumn("to", F.explode(F.array(*map(F.lit, range(n_states)))))
    return grid.join(counts, [*by, "from", "to"], "left").select(*by, "from", "to", F.coalesce("n", F.lit(0)).alias("n"))


def transition_probabilities(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows normalised; an empty row stays 0."""
    total = F.sum("n").over(Window.partitionBy(*by, "from"))
    return counts.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def persistence(probabilities: DataFrame, by: Sequence[str] = (), fps: float = FPS) -> DataFrame:
    """Probability to stay, mean sojourn 1 / (1 - p) in frames and seconds (null if p is 1), likeliest other state."""
    stay = F.max(F.when(F.col("from") == F.col("to"), F.col("p")))
    nxt = F.max(F.when(F.col("from") != F.col("to"), F.struct("p", (-F.col("to")).alias("t"))))
    out = probabilities.groupBy(*by, "from").agg(stay.alias("p_stay"), nxt.alias("x"))
    sojourn = F.when(F.col("p_stay") < 1, 1 / (1 - F.col("p_stay")))
    return out.select(*by, F.col("from").alias("state"), "p_stay", sojourn.alias("sojourn_frames"), (sojourn / fps).alias("sojourn_s"), F.when(F.col("x.p") > 0, -F.col("x.t")).alias("next_state"))


def stationary(probabilities: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stationary distribution of each 3 x 3 matrix: in closed form, by the determinants of its spanning trees."""
    p = probabilities.groupBy(*by).pivot("from", [0, 1, 2]).agg(F.sum(F.when(F.col("to") == 0, F.col("p"))).alias("0"), F.sum(F.when(F.col("to") == 1, F.col("p"))).alias("1"), F.sum(F.when(F.col("to") == 2, F.col("p"))).alias("2"))
    q = lambda i, j: F.col(f"{i}_{j}")
    # weight of state i: over all ways in which the two other states lead to it
    weight = [q(j, i) * q(k, i) + q(j, i) * q(k, j) + q(k, i) * q(j, k) for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1))]
    out = p.select(*by, *[w.alias(f"w{i}") for i, w in enumerate(weight)])
    total = F.col("w0") + F.col("w1") + F.col("w2")
    return out.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("state"), F.when(total > 0, F.col(f"w{i}") / total).alias("pi")) for i in range(3)])).alias("x")).select(*by, "x.*")


def dwell_histogram(eps: DataFrame, by: Sequence[str] = ("state",), censoring: bool = False) -> DataFrame:
    """Counts of equal runs: all that the likelihoods and geometric tests need, whatever the number of episodes."""
    return eps.groupBy(*by, "run", *(["censored"] if censoring else [])).agg(F.count("*").alias("n"))


def geometric_test(histogram: DataFrame, by: Sequence[str] = ("state",), fps: float = FPS, min_n: int = 1) -> DataFrame:
    """Mean, CV, tail beyond 3 means against the fitted geometric law, KS distance at each whole dwell."""
    moments = histogram.groupBy(*by).agg(F.sum("n").alias("n_episodes"), (F.sum(F.col("n") * F.col("run")) / F.sum("n")).alias("mean"), (F.sum(F.col("n") * F.col("run") * F.col("run")) / F.sum("n")).alias("sq"), F.max("run").alias("top")).filter(F.col("n_episodes") >= min_n)
    p = F.greatest(F.lit(1e-6), 1 - 1 / F.col("mean"))
    moments = moments.withColumn("p_stay", p)
    joined = histogram.join(moments, list(by))
    tail = joined.groupBy(*by).agg((F.sum(F.when(F.col("run") > 3 * F.col("mean"), F.col("n")).otherwise(0)) / F.first("n_episodes")).alias("emp_tail"))
    # the empirical CDF is flat between its steps, the fitted one grows: the largest gap of a flat stretch is at one of its ends
    w = Window.partitionBy(*by).orderBy("run")
    steps = joined.withColumn("ecdf", F.sum("n").over(w) / F.col("n_episodes")).withColumn("until", F.coalesce(F.lead("run").over(w) - 1, F.col("top")))
    before = F.coalesce(F.lag("ecdf").over(w), F.lit(0.0))
    fitted = lambda k: 1 - F.pow(F.col("p_stay"), k)
    gaps = steps.withColumn("gap", F.greatest(F.abs(F.col("ecdf") - fitted(F.col("run"))), F.abs(F.col("ecdf") - fitted(F.col("until"))), F.when(F.col("run") > 1, F.abs(before - fitted(F.col("run") - 1))).otherwise(0.0)))
    ks = gaps.groupBy(*by).agg(F.max("gap").alias("ks"))
    geo = F.pow(F.col("p_stay"), F.floor(3 * F.col("mean")))
    return moments.join(tail, list(by)).join(ks, list(by)).select(
        *by, "n_episodes", "mean", (F.col("mean") / fps).alias("mean_s"), (F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mean") * F.col("mean"))) / F.col("mean")).alias("cv"),
        "emp_tail", geo.alias("geo_tail"), F.when(geo > 0, F.col("emp_tail") / geo).alias("tail_excess"), "ks",
    )


def pooled_cv(eps: DataFrame, by: Sequence[str] = ("state",)) -> DataFrame:
    return eps.groupBy(*by).agg((F.stddev_pop("run") / F.avg("run")).alias("pooled_cv"), F.count("*").alias("n"))


def within_cv(eps: DataFrame, min_eps: int = 5, key: Sequence[str] = KEY) -> DataFrame:
    """Median and quartiles over tracks of the CV of at least ``min_eps`` dwells in a state."""
    per = eps.groupBy(*key, "state").agg(F.count("*").alias("n"), (F.stddev_pop("run") / F.avg("run")).alias("cv")).filter(F.col("n") >= min_eps)
    return exact_quantiles(per, {"cv": {"median_cv": 0.5, "q25": 0.25, "q75": 0.75}}, ["state"], "n_tracks")


def anova_icc(df: DataFrame, value: str, group: Sequence[str], by: Sequence[str] = (), min_n: int = 3) -> DataFrame:
    """One-way random-effects ICC with unequal group sizes, and eta squared, from per-group sums."""
    per = df.groupBy(*by, *group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).filter(F.col("n") >= min_n)
    tot = per.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("n2"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nm2"), F.sum(F.col("n") * F.col("v")).alias("ssw"))
    ssb = F.col("nm2") - F.col("N") * F.col("grand") * F.col("grand")
    msb, msw = ssb / (F.col("k") - 1), F.col("ssw") / (F.col("N") - F.col("k"))
    n0 = (F.col("N") - F.col("n2") / F.col("N")) / (F.col("k") - 1)
    enough = (F.col("k") > 1) & (F.col("N") > F.col("k"))
    return tot.select(*by, F.when(enough, (msb - msw) / (msb + (n0 - 1) * msw)).alias("icc"), F.when(F.col("k") > 1, ssb / (ssb + F.col("ssw"))).alias("eta2"), F.col("k").alias("n_groups"), F.col("N").alias("n"))


def rank_icc(resid: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The ICC of each state on the scale of ranks over all residuals, for tracks with two dwells in the state."""
    n = resid.agg(F.count("*").alias("_all"))
    ranked = average_ranks(resid, {"resid": "_rank"}).crossJoin(n).withColumn("_rank", F.col("_rank") / F.col("_all"))
    return anova_icc(ranked, "_rank", key, ["state"], min_n=2)


def state_pairs(resid: DataFrame, key: Sequence[str] = KEY, min_dwells: int = 2, min_tracks: int = 8) -> DataFrame:
    """(a, b, n, rho): Spearman over tracks of the mean dwell ranks in each two states, for tracks with enough dwells in both."""
    per = average_ranks(resid, {"resid": "_rank"}).groupBy(*key, "state").agg(F.avg("_rank").alias("mean"), F.count("*").alias("_n")).filter(F.col("_n") >= min_dwells)
    per = stored(per.select(*key, "state", "mean"))
    pairs = per.select(*key, F.col("state").alias("a"), F.col("mean").alias("x")).join(per.select(*key, F.col("state").alias("b"), F.col("mean").alias("y")), list(key)).filter("a < b")
    return spearman(pairs, ["a", "b"], min_n=min_tracks, few=True).filter(F.col("n") >= min_tracks).select("a", "b", "n", "rho")


def pooled_icc(per_state: DataFrame, min_groups: int = 5) -> DataFrame:
    """ICCs of the states that have ``min_groups`` tracks, weighted by their dwells."""
    return per_state.filter(F.col("n_groups") >= min_groups).agg((F.sum(F.col("icc") * F.col("n")) / F.sum("n")).alias("icc"), F.sum("n").alias("n"))


def truncated(tracks: DataFrame, reference: DataFrame, key: Sequence[str] = KEY, seed: int = 0, min_length: int = MIN_LENGTH) -> DataFrame:
    """Of each track a random run of points, as long as a random reference track that is no longer than it is.

    A track shorter than every reference stays whole; runs below ``min_length`` points go. The reference enters as
    one row: its distinct lengths with running counts, bounded by a video's length. Draws are MD5 of track and seed.
    """
    key = list(key)
    lengths = reference.groupBy(*key).agg(F.count("*").alias("len")).groupBy("len").agg(F.count("*").alias("c"))
    running = lengths.withColumn("cum", F.sum("c").over(Window.orderBy("len")))
    one = running.agg(F.sort_array(F.collect_list(F.struct("len", "cum"))).alias("lens"))
    draw = lambda what: F.conv(F.substring(hashed(*key, F.lit(what), F.lit(seed)), 1, 8), 16, 10).cast("long")
    sized = tracks.groupBy(*key).agg(F.count("*").alias("n")).crossJoin(one)
    fit = F.filter("lens", lambda x: x["len"] <= F.col("n"))
    spot = draw("length") % F.element_at(F.col("fit"), -1)["cum"]
    length = F.when(F.size("fit") == 0, F.col("n")).otherwise(F.element_at(F.filter("fit", lambda x: x["cum"] > spot), 1)["len"])
    part = sized.withColumn("fit", fit).withColumn("len", length).filter(F.col("len") >= min_length)
    part = part.select(*key, "len", (draw("start") % (F.col("n") - F.col("len") + 1)).alias("start"))
    placed = tracks.withColumn("_i", F.row_number().over(ordered(key)) - 1).join(part, key)
    return placed.filter((F.col("_i") >= F.col("start")) & (F.col("_i") < F.col("start") + F.col("len"))).select(*tracks.columns)


def survival(eps: DataFrame, by: Sequence[str] = ("state",)) -> DataFrame:
    """Share of dwells longer than each observed dwell."""
    h = dwell_histogram(eps, by)
    return h.select(*by, "run", (1 - F.sum("n").over(Window.partitionBy(*by).orderBy("run")) / F.sum("n").over(Window.partitionBy(*by))).alias("survival"))


def two_sample_ks(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Largest distance of two empirical distributions, from their histograms, and its asymptotic p."""
    h = a.select(F.col(value).alias("x"), F.lit(1).alias("na"), F.lit(0).alias("nb")).union(b.select(F.col(value), F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    w = Window.orderBy("x")  # one row per distinct value: dwell and track lengths are bounded by a video's length
    gap = F.abs(F.sum("na").over(w) / F.sum("na").over(Window.partitionBy()) - F.sum("nb").over(w) / F.sum("nb").over(Window.partitionBy()))
    out = h.select(gap.alias("gap"), "na", "nb").agg(F.max("gap").alias("ks"), F.sum("na").alias("_n"), F.sum("nb").alias("_m"))
    return out.select("ks", column_of(kolmogorov_p, "ks", "_n", "_m").alias("p"))


def boundary_fractions(eps: DataFrame) -> DataFrame:
    """Shares of episodes that touch one end of their track, both, or none."""
    both = F.col("is_first") & F.col("is_last")
    return eps.agg(F.count("*").alias("n"), F.avg((F.col("censored") & ~both).cast("double")).alias("one_boundary"), F.avg(both.cast("double")).alias("whole_track"), F.avg((~F.col("censored")).cast("double")).alias("interior"))


def restricted_fractions(eps: DataFrame, window: int, by: Sequence[str] = ("state",)) -> DataFrame:
    """Shares of dwells below 1, 2 and 3 windows."""
    return eps.groupBy(*by).agg(*[F.avg((F.col("run") < k * window).cast("double")).alias(f"below_{k}w") for k in (1, 2, 3)])


def fano(eps: DataFrame, seconds: Sequence[float] = (0.5, 1, 2, 4, 8), key: Sequence[str] = KEY, fps: float = FPS, min_windows: int = 4, min_tracks: int = 20) -> DataFrame:
    """Median over tracks of variance / mean of switch counts in tiled windows of each length; null below ``min_tracks``.

    Empty windows need no rows: the sums over a track's windows follow from the occupied ones and their number.
    """
    w = Window.partitionBy(*key).orderBy("ep_idx")
    ends = eps.select(*key, "is_last", F.sum("run").over(w).alias("end"), F.sum("run").over(Window.partitionBy(*key)).alias("total"))
    spread = ends.withColumn("T", F.explode(F.array(*[F.lit(float(t)) for t in seconds])))
    sized = spread.withColumn("n_win", F.floor(F.col("total") / fps / F.col("T"))).filter(F.col("n_win") >= min_windows)
    inside = sized.withColumn("win", F.floor(F.col("end") / fps / F.col("T"))).withColumn("one", F.when(~F.col("is_last") & (F.col("win") < F.col("n_win")), 1).otherwise(0))
    per_win = inside.groupBy(*key, "T", "n_win", "win").agg(F.sum("one").alias("c"))
    per = per_win.groupBy(*key, "T", "n_win").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("s2")).filter("s > 0")
    f = (F.col("s2") - F.col("s") * F.col("s") / F.col("n_win")) / (F.col("n_win") - 1) / (F.col("s") / F.col("n_win"))
    median = exact_quantiles(per.withColumn("fano", f), {"fano": {"fano": 0.5}}, ["T"], "n_tracks")
    return median.select("T", F.when(F.col("n_tracks") >= min_tracks, F.col("fano")).alias("fano"), "n_tracks")


def switch_rate(states: DataFrame, by: Sequence[str] = (), key: Sequence[str] = KEY, fps: float = FPS, order: str = "idx") -> DataFrame:
    """Switches per second over all tracks of a group."""
    sw = states.withColumn("sw", F.coalesce((F.col("state") != F.lag("state").over(Window.partitionBy(*key).orderBy(order))).cast("int"), F.lit(0)))
    return sw.groupBy(*by).agg((F.sum("sw") / (F.count("*") / fps)).alias("switch_rate"), F.sum("sw").alias("switches"))


def embedded_chain(eps: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """First- and second-order counts of the chain of episodes (no self-loops); ``c`` is -1 at first order."""
    w = Window.partitionBy(*key).orderBy("ep_idx")
    seq = eps.select(F.col("state").alias("a"), F.lead("state").over(w).alias("b"), F.lead("state", 2).over(w).alias("c"))
    one = seq.filter("b is not null").groupBy("a", "b").agg(F.count("*").alias("n")).select(F.lit(1).alias("order"), "a", "b", F.lit(-1).alias("c"), "n")
    two = seq.filter("c is not null").groupBy("a", "b", "c").agg(F.count("*").alias("n")).select(F.lit(2), "a", "b", "c", "n")
    return one.union(two)


def merge_flickers(eps: DataFrame, threshold: int, key: Sequence[str] = KEY) -> DataFrame:
    """Drop episodes of at most ``threshold`` frames between two of one state, leftmost first, until none is left.

    The leftmost candidate is settled before anything to its right, so one pass with a stack is enough: (key, ep_idx,
    state, run), linear in the episodes.
    """
    return stack_merge(eps, threshold, key)


def hysteresis_maps(margin: float, vcl: str = "vcl", straightness: str = "straightness", v_imm: float = 5.0, v_prog: float = 25.0, s_prog: float = 0.5) -> list[Column]:
    """The states to which a frame sends the states 0, 1, 2 before it."""
    lo_i, hi_i, lo_p, hi_p, lo_s, hi_s = (x * (1 + s * margin) for x in (v_imm, v_prog, s_prog) for s in (-1, 1))
    v, s = F.col(vcl), F.col(straightness)
    plain = F.when(v <= v_imm, 2).when((v >= v_prog) & (s >= s_prog), 0).otherwise(1)
    fast = (v >= hi_p) & (s >= hi_s)
    from_imm = F.when(v > hi_i, F.when(fast, 0).otherwise(1)).otherwise(2)
    from_prog = F.when(v <= lo_i, 2).when((v < lo_p) | (s < lo_s), 1).otherwise(0)
    from_np = F.when(v <= lo_i, 2).when(fast, 0).otherwise(1)
    start = F.col("idx") == 0  # whatever came before, a track begins in its plain state
    return [F.when(start, plain).otherwise(c) for c in (from_prog, from_np, from_imm)]


def hysteresis_states(kinematics: DataFrame, margin: float, key: Sequence[str] = KEY, **thresholds: float) -> DataFrame:
    """Schmitt-trigger states from windowed VCL and STR: strict to enter, loose to leave.

    Each frame is a map of the state before it to its own state; the maps of a track are composed by a prefix scan.
    """
    maps = kinematics.select(*key, F.col("idx").cast("long").alias("idx"), "frame", *[c.cast("long").alias(m) for m, c in zip(MAPS, hysteresis_maps(margin, **thresholds), strict=True)])
    return composed_maps(maps, key).select(*key, "frame", "idx", F.col("m0").cast("int").alias("state"))


def hysteresis_changes(maps: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, idx, n_track, state) where a Schmitt-trigger's state changes, from the ``changes`` of its map (code m0 + 3 m1 + 9 m2).

    A map sends its own results to themselves, so a frame with the map of the frame before leaves the state as it is:
    only frames with another map are composed.
    """
    w = Window.partitionBy(*key).orderBy("idx")
    rows = maps.select(*key, F.col("idx").alias("_at"), "n_track", (F.row_number().over(w) - 1).cast("long").alias("idx"), *[(F.floor(F.col("code") / 3**k) % 3).cast("long").alias(m) for k, m in enumerate(MAPS)])
    states = composed_maps(rows, key).select(*key, F.col("_at").alias("idx"), "n_track", F.col("m0").cast("int").alias("state"))
    return states.withColumn("_before", F.lag("state").over(w)).filter("_before is null or _before != state").drop("_before")


def matrix_of(rows: Sequence, n: int = 3) -> np.ndarray:
    """Collected (from, to, n) rows as an array."""
    out = np.zeros((n, n))
    for r in rows:
        out[r["from"], r["to"]] = r["n"]
    return out
