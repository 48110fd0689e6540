"""Data behind reports and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import CLASSES
from ..functions.special import chi2_p, column_of
from .ranks import exact_quantiles


def heat_map(points: DataFrame, value: str, cells: int = 20, x: str = "cx", y: str = "cy") -> DataFrame:
    """Mean value on a grid scaled to the largest coordinates, empty cells 0; points left of 0 fall in the first cell."""
    top = points.agg(F.max(x).alias("mx"), F.max(y).alias("my"))
    at = lambda c, m: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(F.col(c) / (F.col(m) + 1) * cells))).cast("int")
    sums = points.crossJoin(F.broadcast(top)).groupBy(at(x, "mx").alias("gx"), at(y, "my").alias("gy")).agg(F.avg(value).alias("mean"))
    grid = points.sparkSession.range(cells * cells).select((F.col("id") % cells).cast("int").alias("gx"), F.expr(f"cast(id div {cells} as int)").alias("gy"))
    return grid.join(sums, ["gx", "gy"], "left").select("gx", "gy", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def histogram(df: DataFrame, value: str, bins: int = 30, top_quantile: float | None = None) -> DataFrame:
    """Equal-width bins between the extremes (or up to a quantile, larger values left out); the last bin is closed."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    if top_quantile:
        ends = ends.select("lo").crossJoin(exact_quantiles(df, {value: {"hi": top_quantile}}))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0).cast("int")
    return df.crossJoin(F.broadcast(ends)).filter(F.col(value) <= F.col("hi")).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles and whiskers (the farthest values within 1.5 interquartile ranges).

    Whiskers are looked up among distinct values with their counts, so a hot group is no larger than its distinct values.
    """
    q = exact_quantiles(df, {value: {"q1": 0.25, "median": 0.5, "q3": 0.75}}, [by])
    values = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    iqr = F.col("q3") - F.col("q1")
    inside = F.when(F.col(value).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr), F.col(value))
    return values.join(q, by).groupBy(by, "q1", "median", "q3").agg(F.min(inside).alias("low"), F.max(inside).alias("high"), F.sum("_n").alias("n"))


def cross_tab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts, row shares, and whether one column holds over half of a row."""
    c = df.groupBy(row, column).agg(F.count("*").alias("n"))
    w = Window.partitionBy(row)
    s = c.withColumn("share", F.col("n") / F.sum("n").over(w))
    return s.withColumn("dominated", F.max("share").over(w) > 0.5)


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square statistic of a cross table, by sum n^2 / (r c): empty cells need no rows; with its p."""
    c = df.groupBy(row, column).agg(F.count("*").alias("n"))
    r, k = c.groupBy(row).agg(F.sum("n").alias("r")), c.groupBy(column).agg(F.sum("n").alias("k"))
    out = c.join(r, row).join(k, column).agg((F.sum("n") * (F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("k"))) - 1)).alias("chi2"), ((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).alias("dof"))
    return out.withColumn("p", column_of(chi2_p, "chi2", "dof"))


def display_rows(df: DataFrame, *order: str, rows: int = 200) -> DataFrame:
    """T5k: the first rows of a table for display, in a stated order."""
    return df.orderBy(*order).limit(rows)


def partition_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information (arithmetic mean) and adjusted Rand index of two labelings."""
    c = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = lambda x: F.sum(F.col(x) * (F.col(x) - 1) / 2)
    ent = lambda x, t: -F.sum(F.col(x) / F.col(t) * F.log(F.col(x) / F.col(t)))
    total = c.agg(F.sum("n").alias("t"))
    ra = c.groupBy(a).agg(F.sum("n").alias("r")).crossJoin(F.broadcast(total)).agg(pairs("r").alias("pa"), ent("r", "t").alias("ha"))
    rb = c.groupBy(b).agg(F.sum("n").alias("k")).crossJoin(F.broadcast(total)).agg(pairs("k").alias("pb"), ent("k", "t").alias("hb"))
    rab = c.crossJoin(F.broadcast(total)).agg(pairs("n").alias("pab"), ent("n", "t").alias("hab"), F.first("t").alias("t"))
    s = rab.crossJoin(ra).crossJoin(rb)
    expected = F.col("pa") * F.col("pb") / (F.col("t") * (F.col("t") - 1) / 2)
    top, mean = (F.col("pa") + F.col("pb")) / 2, (F.col("ha") + F.col("hb")) / 2
    return s.select(F.when(mean > 0, (F.col("ha") + F.col("hb") - F.col("hab")) / mean).otherwise(1.0).alias("nmi"), F.when(top != expected, (F.col("pab") - expected) / (top - expected)).otherwise(1.0).alias("ari"))


def status_table(runs: DataFrame) -> DataFrame:
    """Runs of each experiment by status."""
    return runs.groupBy("experiment").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skip", "error", "no_tracks")])


def trails(tracks: DataFrame, at: int, length: int = 60) -> DataFrame:
    """P10: points of the last ``length`` frames before ``at``, of tracks that have two of them."""
    near = tracks.filter(F.col("frame").between(at - length, at))
    return near.withColumn("_n", F.count("*").over(Window.partitionBy("video", "track_id"))).filter("_n >= 2").drop("_n")


def video_context(summaries: DataFrame, fastest: DataFrame, moves: DataFrame, compliance: DataFrame) -> DataFrame:
    """One row per video with its summary line, its fastest tracks and its transition matrix as JSON, and whether it meets the references.

    ``moves`` has (video, from, to, n), ``compliance`` a row per video; the text around them is the caller's.
    """
    top = fastest.groupBy("video").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("rank", "track_id", "VCL"))), lambda x: F.struct(x["track_id"].alias("track_id"), x["VCL"].alias("VCL")))).alias("fastest"))
    line = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("total_tracks", *CLASSES)])
    cells = F.transform(F.sort_array(F.collect_list(F.struct("from", "to", "n"))), lambda x: x["n"])
    matrix = moves.groupBy("video").agg(F.to_json(cells).alias("transitions"))
    return summaries.select("video", line.alias("line")).join(top, "video", "left").join(matrix, "video", "left").join(compliance, "video", "left")
