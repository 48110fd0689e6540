"""Agreement with reference values (A9-A12), threshold sweeps (J10, P12) and result comparisons."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.scalar import CLASSES, pearson, state_code
from ..functions.special import column_of, correlation_p
from .kinematics import KEY, track_metrics


def compared(clinical: DataFrame, predicted: DataFrame, on: str = "video") -> DataFrame:
    """Long table (on, category, truth, predicted); predicted columns are named ``<class>_pct``."""
    both = clinical.join(predicted, on)
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"gt_{c}").alias("truth"), F.col(f"{c}_pct").cast("double").alias("predicted")) for c in CLASSES])
    rest = [c for c in predicted.columns if c != on and c not in {f"{x}_pct" for x in CLASSES}]
    return both.select(on, *rest, F.explode(pairs).alias("p")).select(on, *rest, "p.*")


def agreement(long: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """MAE, RMSE, bias, Pearson r (0 with fewer than 3 pairs), its two-sided p (1 then) and n of each group."""
    e = F.col("predicted") - F.col("truth")
    out = long.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.when(F.count("*") < 3, 0.0).otherwise(pearson("truth", "predicted")).alias("r"), F.count("*").alias("n"),
    )
    return out.withColumn("p", column_of(correlation_p, "r", "n"))


def bland_altman(long: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """Bias and limits of agreement (population SD)."""
    d = F.col("predicted") - F.col("truth")
    out = long.groupBy(*by).agg(F.avg(d).alias("bias"), F.stddev_pop(d).alias("sd"))
    return out.select(*by, "bias", "sd", (F.col("bias") - 1.96 * F.col("sd")).alias("low"), (F.col("bias") + 1.96 * F.col("sd")).alias("high"))


def _place(value: Column, cuts: Sequence[float], closed: bool) -> Column:
    """How many of the sorted ``cuts`` lie at or below ``value`` (below it, unless ``closed``)."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: (c <= value) if closed else (c < value)))


def class_cells(metrics: DataFrame, vcl: Sequence[float], straightness: Sequence[float], immotile: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, ``cells``): counts of tracks in the cells between thresholds, flat over (VCL cut, STR cut, immotile cut).

    A track falls in one cell: how many of the VCL cuts and STR cuts it reaches, and how many immotile cuts lie below
    it. Its number of rows does not depend on the number of combinations; a group's table is as large as the grid.
    """
    sizes = [len(vcl) + 1, len(straightness) + 1, len(immotile) + 1]
    a, b, c = _place(F.col("VCL"), vcl, True), _place(F.col("STR"), straightness, True), _place(F.col("VCL"), immotile, False)
    cell = ((a * sizes[1] + b) * sizes[2] + c).cast("int")
    counts = metrics.groupBy(*by, cell.alias("_cell")).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_n"))).alias("cells"))


def class_mix(metrics: DataFrame, vcl: Sequence[float], straightness: Sequence[float], immotile: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, combo, vcl_prog, str_prog, vcl_imm, n, p, i): tracks, progressive and immotile ones under each combination.

    Sums over the upper corner of a cumulative table tell all combinations of a group at once; combinations are
    numbered in nested order.
    """
    by, axes = list(by), [sorted(map(float, x)) for x in (vcl, straightness, immotile)]
    sizes = [len(x) + 1 for x in axes]
    order = [[axis.index(float(x)) for x in given] for axis, given in zip(axes, (vcl, straightness, immotile), strict=True)]
    combos = [(float(v), float(s), float(i)) for v in vcl for s in straightness for i in immotile]
    keys = metrics.select(*by).schema.fields

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                table = np.zeros(sizes, np.int64)
                cells = dict(batch.column(len(by))[row].as_py())
                table.reshape(-1)[list(cells)] = list(cells.values())
                above = table[::-1, ::-1, ::-1].cumsum(0).cumsum(1).cumsum(2)[::-1, ::-1, ::-1]  # at or beyond each corner
                p = above[1:, 1:, 1:][np.ix_(*order)].reshape(-1)
                i = (above[0, 0, 0] - above[0, 0, 1:])[order[2]]
                i = np.broadcast_to(i, (len(vcl), len(straightness), len(immotile))).reshape(-1)
                n = len(combos)
                held = [pa.array(batch.column(k).slice(row, 1).to_pylist() * n, batch.schema.field(k).type) for k in range(len(by))]
                columns = [pa.array(np.arange(n, dtype=np.int32)), *[pa.array(x, pa.float64()) for x in zip(*combos, strict=True)], pa.array(np.full(n, int(above[0, 0, 0]))), pa.array(p), pa.array(np.ascontiguousarray(i))]
                yield pa.RecordBatch.from_arrays([*held, *columns], [*by, *MIX])

    told = [StructField(c, IntegerType() if c == "combo" else LongType() if c in ("n", "p", "i") else DoubleType()) for c in MIX]
    return class_cells(metrics, *axes, by).mapInArrow(sums, StructType([*keys, *told]))


MIX = ["combo", "vcl_prog", "str_prog", "vcl_imm", "n", "p", "i"]


def threshold_sweep(metrics: DataFrame, clinical: DataFrame, vcl: Sequence[float], straightness: Sequence[float], immotile: Sequence[float]) -> DataFrame:
    """For each combination the mean over videos of the summed absolute error of the three percentages."""
    mix = class_mix(metrics, vcl, straightness, immotile, ["video"])
    pct = {"progressive": 100.0 * F.col("p") / F.col("n"), "immotile": 100.0 * F.col("i") / F.col("n"), "non_progressive": 100.0 * (F.col("n") - F.col("p") - F.col("i")) / F.col("n")}
    error = sum((F.abs(x - F.col(f"gt_{c}")) for c, x in pct.items()), F.lit(0.0))
    return mix.join(clinical, "video").groupBy("combo", "vcl_prog", "str_prog", "vcl_imm").agg(F.avg(error).alias("total_mae"), F.count("*").alias("n_videos"))


def best_rows(sweep: DataFrame, n: int = 10) -> DataFrame:
    """T2k: the n smallest errors; the first combination wins ties."""
    return sweep.orderBy(F.round("total_mae", 9), "combo").limit(n)


def state_sweep(kinematics: DataFrame, configs: DataFrame) -> DataFrame:
    """The state code of each frame under each configuration (config, v_imm, v_prog, s_prog), a list that the caller bounds."""
    both = kinematics.crossJoin(F.broadcast(configs))
    return both.withColumn("state", state_code(F.col("vcl"), F.col("straightness"), F.col("v_imm"), F.col("v_prog"), F.col("s_prog"))).drop("v_imm", "v_prog", "s_prog")


def class_sweep(metrics: DataFrame, configs: DataFrame) -> DataFrame:
    """Class counts under each configuration of thresholds (config, v_imm, v_prog, s_prog)."""
    counts = metrics.groupBy("VCL", "STR").agg(F.count("*").alias("n")).crossJoin(F.broadcast(configs))
    kind = F.when(F.col("VCL") <= F.col("v_imm"), "immotile").when((F.col("VCL") >= F.col("v_prog")) & (F.col("STR") >= F.col("s_prog")), "progressive").otherwise("non_progressive")
    return counts.groupBy("config", kind.alias("motility")).agg(F.sum("n").alias("n"))


def compare_cohorts(stats: DataFrame, a: str, b: str, cohort: str = "cohort", metric: str = "metric", value: str = "value") -> DataFrame:
    """Value of each metric in two cohorts, ratio and difference."""
    pick = lambda name, to: stats.filter(F.col(cohort) == name).select(metric, F.col(value).alias(to))
    return pick(a, "a").join(pick(b, "b"), metric).withColumns({"ratio": F.when(F.col("b") != 0, F.col("a") / F.col("b")), "difference": F.col("a") - F.col("b")})


def recalibrated(tracks: DataFrame, calibrations: Sequence[tuple[str, float, float]], key: Sequence[str] = KEY) -> DataFrame:
    """Metrics of each track under each (name, px per um, FPS)."""
    frames = [track_metrics(tracks, key, ppm=ppm, fps=fps).withColumn("calibration", F.lit(name)) for name, ppm, fps in calibrations]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r of two columns."""
    return df.agg(pearson(x, y).alias("r"), F.count("*").alias("n"))


def dissociation(variants: DataFrame, quality: Sequence[str], errors: Sequence[str], min_n: int = 3) -> DataFrame:
    """(quality, error, r, n): Pearson's r over variants, one row each, of every quality with every error.

    Variants in which either is null do not count; r is null below ``min_n`` variants, or where either does not vary.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(q).alias("quality"), F.lit(e).alias("error"), F.col(q).cast("double").alias("x"), F.col(e).cast("double").alias("y")) for q in quality for e in errors]))
    long = variants.select(pairs.alias("p")).select("p.*").filter("x is not null and y is not null")
    varies = (F.max("x") > F.min("x")) & (F.max("y") > F.min("y"))
    return long.groupBy("quality", "error").agg(F.when((F.count("*") >= min_n) & varies, pearson("x", "y")).alias("r"), F.count("*").alias("n"))


def tracker_fidelity(quality: DataFrame, dynamics: DataFrame, truth: str, by: str = "variant") -> DataFrame:
    """Of each variant but ``truth`` its association quality beside its dynamical errors: |g2 - true g2| and |CV / true CV - 1|.

    ``quality`` has (by, coverage, id_switches), ``dynamics`` (by, g2, dwell_cv) with a row of the truth.
    """
    real = dynamics.filter(F.col(by) == truth).select(F.col("g2").alias("_g2"), F.col("dwell_cv").alias("_cv"))
    told = dynamics.filter(F.col(by) != truth).crossJoin(real)
    wrong = told.select(by, "g2", "dwell_cv", F.abs(F.col("g2") - F.col("_g2")).alias("g2_error"), F.when(F.col("_cv") != 0, F.abs(F.col("dwell_cv") / F.col("_cv") - 1)).alias("cv_error"))
    return quality.join(wrong, by)


def share(count: Column, *by: str) -> Column:
    return count / F.sum(count).over(Window.partitionBy(*by))
