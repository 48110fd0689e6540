"""Registered queries of the trajectory operators and the DuckDB SQL of their expected results.

Every query works on whole tables. Floating-point results are rounded to 6 decimals, integers are long, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import scalar
from .operators import agreement, association, episodes, features, kinematics, laws, models, order, report, serial, signal, states, summary
from .operators.ranks import exact_quantiles
from .oracles import CTES, STATE, compose, kinematics as kinematics_sql, ranks
from .plans import battery
from .sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
METRICS = kinematics.METRICS
K = list(kinematics.KEY)
FIVE = (0.05, 0.25, 0.5, 0.75, 0.95)


def plain(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Doubles rounded (without negative zero; None: not), integers as long."""
    r = lambda c: c if digits is None else F.round(c, digits)
    kinds = {"double": lambda c: r(c) + F.lit(0.0), "float": lambda c: r(c.cast("double")) + F.lit(0.0), "int": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long"), "tinyint": lambda c: c.cast("long")}
    return df.select(*[kinds.get(t, lambda c: c)(F.col(f"`{n}`")).alias(n) for n, t in df.dtypes])


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None, digits: int = 6, rounded: bool = False):
    """Register a query; ``sql`` selects from named blocks, and its doubles are rounded as the query's are (``rounded``: by the operator)."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir), None if rounded else digits)
        if sql:
            ORACLES[name] = compose(sql if digits == 6 else sql.replace(", 6) + 0.0", f", {digits}) + 0.0"), extra)
        return f

    return add


def r(*columns: str) -> str:
    return ", ".join(f'round({c.rsplit(" AS ", 1)[0]}, 6) + 0.0 AS {c.rsplit(" AS ", 1)[-1]}' for c in columns)


def L(*columns: str) -> str:  # noqa: N802
    return ", ".join(f'CAST({c.rsplit(" AS ", 1)[0]} AS BIGINT) AS {c.rsplit(" AS ", 1)[-1]}' for c in columns)


def r_p(r: str, n: str) -> str:
    """Two-sided p of a correlation of n pairs: Student's t has a finite series for whole degrees of freedom."""
    a = f"abs({r})"
    odd = f"asin({a}) + {a} * coalesce(list_sum(list_transform(range(1, CAST(floor(({n} - 3) / 2) + 1 AS BIGINT)), lambda j: exp(lgamma(j) + lgamma(1.5) - lgamma(j + 0.5)) * power(1 - {r} * {r}, j - 0.5))), 0)"
    even = f"{a} * coalesce(list_sum(list_transform(range(0, CAST(floor(({n} - 2) / 2) AS BIGINT)), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * power(1 - {r} * {r}, j))), 0)"
    return f"CASE WHEN {n} < 3 THEN 1 WHEN {a} >= 1 THEN 0 WHEN {n} % 2 = 1 THEN 1 - 2 / pi() * ({odd}) ELSE 1 - ({even}) END"


Q = [f'"{m}"' for m in METRICS]
tracks, clinical, pred = fixtures.tracks, fixtures.clinical, fixtures.pred_tracks


def kept(s: SparkSession, d: str) -> DataFrame:
    return kinematics.judged_tracks(tracks(s, d)).filter("reason is null")


def frame_states(s: SparkSession, d: str, window: int = 25) -> DataFrame:
    return states.frame_states(tracks(s, d), window)


def eps9(s: SparkSession, d: str) -> DataFrame:
    return episodes.episodes(frame_states(s, d, 9))


def resid(s: SparkSession, d: str) -> DataFrame:
    return serial.residuals(eps9(s, d))


def summaries(s: SparkSession, d: str) -> DataFrame:
    return summary.video_summary(tracks(s, d), fixtures.detections(s, d))


# ---- kinematics
query("W09_track_metrics", f"SELECT {', '.join(K)}, {L('n_frames')}, duration_s, {r(*Q)} FROM metrics")(lambda s, d: kinematics.track_metrics(tracks(s, d)))
query("W10_extra_metrics", f"SELECT {', '.join(K)}, {r('round_even(tac, 4) AS \"TAC\"', 'round_even(var_v, 4) AS \"VAR_V\"')} FROM turns")(lambda s, d: kinematics.extra_metrics(tracks(s, d)))
query("P06_filter_reasons", "SELECT reason, count(*) AS n FROM judged GROUP BY reason")(lambda s, d: kinematics.judged_tracks(tracks(s, d)).groupBy("reason").agg(F.count("*").alias("n")))
query("P05_motility_class", f"SELECT {', '.join(K)}, motility FROM judged")(lambda s, d: kinematics.judged_tracks(tracks(s, d)).select(*K, "motility"))
query("P01_units", f"SELECT {', '.join(K)}, {L('frame')}, {r('cx / 1.422 AS x_um', 'cy / 1.422 AS y_um', 'frame * 0.02 AS t_s')} FROM tracks")(
    lambda s, d: tracks(s, d).select(*K, "frame", scalar.px_to_um(F.col("cx")).alias("x_um"), scalar.px_to_um(F.col("cy")).alias("y_um"), (F.col("frame") * scalar.frame_interval()).alias("t_s"))
)
query("P02_box_centroids", f"SELECT video, {L('frame', 'cls')}, {r('(x1 + x2) / 2 AS cx', '(y1 + y2) / 2 AS cy', 'x2 - x1 AS w', 'y2 - y1 AS h')} FROM detections")(
    lambda s, d: fixtures.detections(s, d).select("video", "frame", "cls", *[c.alias(n) for c, n in zip(scalar.centroid(*[F.col(x) for x in ("x1", "y1", "x2", "y2")]), ("cx", "cy", "w", "h"), strict=True)])
)
query("P03_normalised_boxes", f"SELECT video, {L('frame')}, {r('greatest(0, least(1, (x1 + x2) / 2 / 640)) AS nx', 'greatest(0, least(1, (y1 + y2) / 2 / 480)) AS ny', 'greatest(0, least(1, (x2 - x1) / 640)) AS w', 'greatest(0, least(1, (y2 - y1) / 480)) AS h')} FROM detections", digits=12)(
    lambda s, d: fixtures.detections(s, d).select("video", "frame", *[c.alias(n) for c, n in zip(scalar.normalise(*[F.col(x) for x in ("x1", "y1", "x2", "y2")], 640, 480), ("nx", "ny", "w", "h"), strict=True)])
)
query("P04_long_tracks", "SELECT video, count(*) AS n_points FROM (SELECT video, count(*) OVER (PARTITION BY video, track_id) AS n FROM tracks) WHERE n >= 50 GROUP BY video")(lambda s, d: kinematics.long_enough(tracks(s, d), 50).groupBy("video").agg(F.count("*").alias("n_points")))
query("P07_video_set", "SELECT video, count(DISTINCT track_id) AS n FROM tracks WHERE video IN ('1', '4', '7', '11') GROUP BY video")(lambda s, d: tracks(s, d).filter(F.col("video").isin("1", "4", "7", "11")).groupBy("video").agg(F.count_distinct("track_id").alias("n")))
query("P08_compliance", "SELECT video, progressive_pct + non_progressive_pct >= 42 AS meets_total, progressive_pct >= 30 AS meets_progressive FROM summary")(lambda s, d: summary.compliance(summaries(s, d)))
query("P09_standard_labels", "SELECT CASE motility WHEN 'progressive' THEN 'Progressive' WHEN 'non_progressive' THEN 'Non-progressive' ELSE 'Immotile' END AS label, count(*) AS n FROM kept GROUP BY 1")(lambda s, d: kept(s, d).groupBy(scalar.standard_label(F.col("motility")).alias("label")).agg(F.count("*").alias("n")))
query("P10_trails", f"SELECT * FROM (SELECT video, track_id, {L('frame')}, count(*) OVER (PARTITION BY video, track_id) AS k FROM tracks WHERE frame BETWEEN 20 AND 40) WHERE k >= 2")(lambda s, d: report.trails(tracks(s, d), 40, 20).select(*K, "frame", F.count("*").over(report.Window.partitionBy(*K)).alias("k")))
query("P11_band_fractions", f"SELECT video, {r('avg(CASE WHEN \"VCL\" > 50 THEN 1.0 ELSE 0 END) AS vigorous', 'avg(CASE WHEN \"VCL\" BETWEEN 5 AND 25 THEN 1.0 ELSE 0 END) AS intermediate')} FROM kept GROUP BY video")(
    lambda s, d: kept(s, d).groupBy("video").agg(F.avg((F.col("VCL") > 50).cast("double")).alias("vigorous"), F.avg(F.col("VCL").between(5, 25).cast("double")).alias("intermediate"))
)
DESIGNS = battery.DESIGNS
query("P12_threshold_configs", f"SELECT config, CAST(CASE WHEN vcl <= v_imm THEN 2 WHEN vcl >= v_prog AND straightness >= s_prog THEN 0 ELSE 1 END AS BIGINT) AS state, count(*) AS n FROM kin, (VALUES {', '.join(map(str, DESIGNS))}) c(config, v_imm, v_prog, s_prog) GROUP BY 1, 2")(
    lambda s, d: agreement.state_sweep(states.frame_kinematics(tracks(s, d)), s.createDataFrame(DESIGNS, "config string, v_imm double, v_prog double, s_prog double")).groupBy("config", "state").agg(F.count("*").alias("n"))
)
query("P12_class_configs", f"SELECT config, CASE WHEN \"VCL\" <= v_imm THEN 'immotile' WHEN \"VCL\" >= v_prog AND \"STR\" >= s_prog THEN 'progressive' ELSE 'non_progressive' END AS motility, count(*) AS n FROM metrics, (VALUES {', '.join(map(str, DESIGNS))}) c(config, v_imm, v_prog, s_prog) GROUP BY 1, 2")(
    lambda s, d: agreement.class_sweep(kinematics.track_metrics(tracks(s, d)), s.createDataFrame(DESIGNS, "config string, v_imm double, v_prog double, s_prog double"))
)
query("P13_short_dwells", f"SELECT state, {r(*[f'avg(CASE WHEN run < {9 * k} THEN 1.0 ELSE 0 END) AS below_{k}w' for k in (1, 2, 3)])} FROM eps9 GROUP BY state".replace("SELECT state", "SELECT CAST(state AS BIGINT) AS state"))(lambda s, d: episodes.restricted_fractions(eps9(s, d), 9))

# ---- summaries and agreement
query("A01_mean_confidence", f"SELECT video, track_id, {r('avg(conf) AS mean_conf')} FROM tracks GROUP BY ALL")(lambda s, d: kinematics.mean_confidence(tracks(s, d)))
query("A02_active_tracks", f"SELECT video, {r('avg_active')} FROM active")(lambda s, d: summary.active_tracks(tracks(s, d)))
query("A03_detection_stats", f"SELECT video, total_detections, {r('avg_detections')}, frames_with_boxes FROM detected")(lambda s, d: summary.detection_stats(fixtures.detections(s, d)))
query("A04_class_counts", f"SELECT video, count(*) AS total_tracks, {', '.join(f'count(*) FILTER (motility = \'{c}\') AS {c}' for c in scalar.CLASSES)}, {r(*[f'round_even(100 * count(*) FILTER (motility = \'{c}\') / count(*), 1) AS {c}_pct' for c in scalar.CLASSES])} FROM kept GROUP BY video")(lambda s, d: summary.class_counts(kept(s, d)))
SUMMARY = ["tracks_before_filter", "filtered_low_conf", "filtered_high_vcl", "filtered_jitter", "filtered_short_duration", "total_tracks", *scalar.CLASSES, "estimated_untracked", "adjusted_total", "adjusted_immotile"]
SUMMARY_R = [*[f'"mean_{m}"' for m in METRICS], *[f"{c}_pct" for c in scalar.CLASSES], *[f"adjusted_{c}_pct" for c in scalar.CLASSES], "untracked_fraction", "round_even(avg_active, 2) AS avg_active", "round_even(avg_detections, 2) AS avg_detections"]
query("A06_video_summary", f"SELECT video, {L(*SUMMARY)}, {r(*SUMMARY_R)} FROM summary")(summaries)
query("A05_adjusted_mix", f"SELECT video, {L('estimated_untracked', 'adjusted_total')}, {r(*[f'adjusted_{c}_pct' for c in scalar.CLASSES])} FROM summary")(lambda s, d: summaries(s, d).select("video", "estimated_untracked", "adjusted_total", *[f"adjusted_{c}_pct" for c in scalar.CLASSES]))
query("A07_cohort_means", f"SELECT count(*) AS n_videos, {r('avg(\"mean_VCL\") AS \"mean_VCL\"', 'avg(progressive_pct) AS progressive_pct', 'avg(total_tracks) AS total_tracks')} FROM summary")(lambda s, d: summary.cohort_means(summaries(s, d), ["mean_VCL", "progressive_pct", "total_tracks"]))
query("A08_weighted_mix", f"SELECT {r(*[f'sum(total_tracks * {c}_pct) / sum(total_tracks) AS {c}_pct' for c in scalar.CLASSES])} FROM summary")(lambda s, d: summary.weighted_mix(summaries(s, d)))
LONG = {"long": "SELECT c.video, category, truth, predicted FROM clinical c JOIN summary s USING (video), LATERAL (VALUES ('progressive', gt_progressive, progressive_pct), ('non_progressive', gt_non_progressive, non_progressive_pct), ('immotile', gt_immotile, immotile_pct)) v(category, truth, predicted)"}


def compared(s: SparkSession, d: str) -> DataFrame:
    return agreement.compared(clinical(s, d), summaries(s, d).select("video", *[f"{c}_pct" for c in scalar.CLASSES]))


AGREE_RAW = "avg(abs(predicted - truth)) AS mae, sqrt(avg(power(predicted - truth, 2))) AS rmse, avg(predicted - truth) AS bias, CASE WHEN count(*) < 3 THEN 0 ELSE corr(truth, predicted) END AS r"
AGREE_P = r("mae", "rmse", "bias", "r", f"{r_p('r', 'n')} AS p")
query("A09_agreement", f"SELECT category, {AGREE_P}, n FROM (SELECT category, {AGREE_RAW}, count(*) AS n FROM long GROUP BY category)", LONG)(lambda s, d: agreement.agreement(compared(s, d)))
RUNS = LONG | {"runs": "SELECT *, 'all' AS experiment FROM long UNION ALL SELECT *, 'even' FROM long WHERE CAST(video AS INT) % 2 = 0"}
query("A10_experiments", f"SELECT experiment, category, {AGREE_P}, n FROM (SELECT experiment, category, {AGREE_RAW}, count(*) AS n FROM runs GROUP BY experiment, category)", RUNS)(
    lambda s, d: agreement.agreement(compared(s, d).withColumn("experiment", F.explode(F.when(F.col("video").cast("int") % 2 == 0, F.array(F.lit("all"), F.lit("even"))).otherwise(F.array(F.lit("all"))))), ["experiment", "category"])
)
BA = [f"avg(predicted - truth) {x} AS {n}" for x, n in (("", "bias"), ("- 1.96 * stddev_pop(predicted - truth)", "low"), ("+ 1.96 * stddev_pop(predicted - truth)", "high"))]
query("A11_bland_altman", f"SELECT category, {r(*BA, 'stddev_pop(predicted - truth) AS sd')} FROM long GROUP BY category", LONG)(lambda s, d: agreement.bland_altman(compared(s, d)))
VCLS, STRS, IMMS = list(range(10, 60, 5)), [k / 100 for k in range(40, 95, 5)], list(range(2, 15))
GRID = {
    "grid": f"SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS BIGINT) AS combo, CAST(a AS DOUBLE) AS vcl_prog, CAST(b AS DOUBLE) AS str_prog, CAST(c AS DOUBLE) AS vcl_imm FROM (SELECT unnest({VCLS}) AS a), (SELECT unnest({STRS}) AS b), (SELECT unnest({IMMS}) AS c)",
    "mix": 'SELECT combo, vcl_prog, str_prog, vcl_imm, video, count(*) AS n, count(*) FILTER ("VCL" > vcl_imm AND "VCL" >= vcl_prog AND "STR" >= str_prog) AS p, count(*) FILTER ("VCL" <= vcl_imm) AS i FROM kept, grid GROUP BY ALL',
    "sweep": "SELECT combo, vcl_prog, str_prog, vcl_imm, avg(abs(100 * p / n - gt_progressive) + abs(100 * i / n - gt_immotile) + abs(100 * (n - p - i) / n - gt_non_progressive)) AS total_mae, count(*) AS n_videos FROM mix JOIN clinical USING (video) GROUP BY ALL",
}


def sweep(s: SparkSession, d: str) -> DataFrame:
    return agreement.threshold_sweep(kept(s, d), clinical(s, d), VCLS, STRS, IMMS)


query("A12_threshold_sweep", f"SELECT combo, {r('vcl_prog', 'str_prog', 'vcl_imm', 'total_mae')}, n_videos FROM sweep", GRID)(sweep)
query("T02_best_thresholds", f"SELECT combo, {r('vcl_prog', 'str_prog', 'vcl_imm', 'total_mae')}, n_videos FROM sweep ORDER BY round(sweep.total_mae, 9), combo LIMIT 10", GRID)(lambda s, d: agreement.best_rows(sweep(s, d)))
query("T01_fastest", f"SELECT video, track_id, {r('\"VCL\"')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY \"VCL\" DESC, track_id) AS rank FROM kept WHERE motility = 'progressive') WHERE rank <= 5")(lambda s, d: summary.fastest(kept(s, d)).select(*K, "VCL", "rank"))
query("T03_numeric_order", "SELECT video, row_number() OVER (ORDER BY CAST(video AS INT)) AS place FROM (SELECT DISTINCT video FROM tracks)")(lambda s, d: tracks(s, d).select("video").distinct().withColumn("place", F.row_number().over(report.Window.orderBy(F.expr("try_cast(video as int)"), "video"))))
query("T04_seeded_cap", "SELECT video, track_id FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY md5(video || '|' || track_id || '|0'), track_id) AS k FROM (SELECT DISTINCT video, track_id FROM tracks)) WHERE k <= 3")(lambda s, d: summary.seeded_cap(tracks(s, d), 3).select(*K).distinct())
query("U01_union", "SELECT video, count(*) AS n, count(tracker) AS tagged FROM (SELECT video, NULL AS tracker FROM tracks UNION ALL SELECT video, 'auto' FROM pred_tracks) GROUP BY video")(lambda s, d: summary.union_all([tracks(s, d), pred(s, d).withColumn("tracker", F.lit("auto"))]).groupBy("video").agg(F.count("*").alias("n"), F.count("tracker").alias("tagged")))
query("U02_shared_frames", f"SELECT DISTINCT video, {L('frame')} FROM (SELECT video, frame FROM tracks INTERSECT SELECT video, frame FROM pred_tracks)")(lambda s, d: summary.shared_keys(tracks(s, d), pred(s, d), ["video", "frame"]))
query("U03_unmatched_tracks", "SELECT DISTINCT video, track_id FROM pred_tracks WHERE (video, track_id) NOT IN (SELECT video, track_id FROM tracks)")(lambda s, d: summary.unknown_keys(pred(s, d), tracks(s, d).select(*K).distinct(), K))
query("U04_video_list", "SELECT video FROM tracks UNION SELECT video FROM pred_tracks UNION SELECT video FROM clinical")(lambda s, d: tracks(s, d).select("video").union(pred(s, d).select("video")).union(clinical(s, d).select("video")).distinct())

# ---- joins
query("J01_class_on_points", "SELECT t.video, coalesce(motility, 'unknown') AS motility, count(*) AS n FROM tracks t LEFT JOIN kept k USING (video, track_id) GROUP BY ALL")(lambda s, d: tracks(s, d).join(kept(s, d).select(*K, "motility"), K, "left").groupBy("video", F.coalesce("motility", F.lit("unknown")).alias("motility")).agg(F.count("*").alias("n")))
query("J02_speed_on_points", f"SELECT t.video, count(*) AS n, {r('avg(\"VCL\") AS vcl')} FROM tracks t JOIN kept k USING (video, track_id) GROUP BY t.video")(lambda s, d: tracks(s, d).join(kept(s, d).select(*K, "VCL"), K).groupBy("video").agg(F.count("*").alias("n"), F.avg("VCL").alias("vcl")))
query("J03_clinical_join", f"SELECT video, category, {r('truth', 'predicted')} FROM long", LONG)(compared)
query("J04_features_with_targets", f"SELECT v.video, {r('VCL AS vcl', 'dfi')} FROM (SELECT video, avg(\"VCL\") AS VCL FROM kept GROUP BY video) v LEFT JOIN clinical USING (video)")(lambda s, d: kept(s, d).groupBy("video").agg(F.avg("VCL").alias("vcl")).join(clinical(s, d).select("video", "dfi"), "video", "left"))
query("J10_grid_class_mix", "SELECT combo, sum(n)::BIGINT AS n, sum(p)::BIGINT AS p, sum(i)::BIGINT AS i FROM mix GROUP BY combo", GRID)(
    lambda s, d: agreement.class_mix(kept(s, d), VCLS, STRS, IMMS).select("combo", "n", "p", "i")
)
IOU = "greatest(0, least(a.cx, b.cx) + 8 - (greatest(a.cx, b.cx) - 8)) * greatest(0, least(a.cy, b.cy) + 8 - (greatest(a.cy, b.cy) - 8))"
query("J07_iou_candidates", f"SELECT a.video, CAST(a.frame AS BIGINT) AS frame, a.track_id AS gt, b.track_id AS pred, {r(f'{IOU} / (512 - {IOU}) AS iou')} FROM tracks a JOIN pred_tracks b ON a.video = b.video AND a.frame = b.frame WHERE round({IOU} / (512 - {IOU}), 9) >= 0.5", digits=9, rounded=True)(lambda s, d: association.candidates(tracks(s, d), pred(s, d)))
GREEDY = {
    "gc": f"SELECT a.video, CAST(a.frame AS BIGINT) AS frame, a.track_id AS gt, b.track_id AS pred, round({IOU} / (512 - {IOU}), 9) AS iou FROM tracks a JOIN pred_tracks b ON a.video = b.video AND a.frame = b.frame WHERE round({IOU} / (512 - {IOU}), 9) >= 0.5",
    "gl": "SELECT video, frame, list_reduce(list([{gt: gt, pred: pred, iou: iou}] ORDER BY gt, iou DESC, pred), lambda a, x: CASE WHEN len(list_filter(a, lambda m: m.gt = x[1].gt OR m.pred = x[1].pred)) > 0 THEN a ELSE list_concat(a, x) END) AS m FROM gc GROUP BY video, frame",
    "gm": "SELECT video, frame, u.gt AS gt, u.pred AS pred, u.iou AS iou FROM (SELECT video, frame, unnest(m) AS u FROM gl)",
}
query("J07_greedy_matches", "SELECT video, frame, gt, pred, iou + 0.0 AS iou FROM gm", GREEDY, digits=9)(lambda s, d: association.greedy(tracks(s, d), pred(s, d)))
GREEDY |= {
    "gh": "SELECT video, gt, count(*) AS hit, sum(sw) AS sw FROM (SELECT video, gt, CASE WHEN pred <> lag(pred) OVER (PARTITION BY video, gt ORDER BY frame) THEN 1 ELSE 0 END AS sw FROM gm) GROUP BY video, gt",
    "gs": "SELECT t.video, t.track_id AS gt, count(p.frame) AS n FROM tracks t LEFT JOIN (SELECT DISTINCT video, frame FROM pred_tracks) p ON p.video = t.video AND p.frame = t.frame GROUP BY t.video, t.track_id",
    "gf": "SELECT video, avg(CASE WHEN n < 25 THEN 1.0 ELSE 0 END) AS fragmentation FROM (SELECT video, track_id, count(*) AS n FROM pred_tracks GROUP BY video, track_id) GROUP BY video",
}
query("A41_tracking_quality", f"SELECT s.video, count(*) AS n_gt, {r('avg(CASE WHEN n > 0 AND coalesce(hit, 0) >= 0.5 * n THEN 1.0 ELSE 0 END) AS coverage', 'coalesce(sum(sw), 0) / count(*) AS id_switches', 'any_value(fragmentation) AS fragmentation')} FROM gs s LEFT JOIN gh h ON h.video = s.video AND h.gt = s.gt LEFT JOIN gf f ON f.video = s.video GROUP BY s.video", GREEDY)(lambda s, d: association.tracking_quality(tracks(s, d), pred(s, d)))

# ---- states
query("W12_frame_states", f"SELECT {', '.join(K)}, {L('frame', 'idx', 'state')} FROM states")(frame_states)
query("W12_frame_states_9", f"SELECT {', '.join(K)}, {L('frame', 'idx', 'state')} FROM states9")(lambda s, d: frame_states(s, d, 9))
query("W11_windowed_kinematics", f"SELECT {', '.join(K)}, {L('frame', 'idx', 'n_track')}, {r('vcl', 'straightness')} FROM kin")(lambda s, d: states.frame_kinematics(tracks(s, d)))
BLOCKS = {
    "blocked": "SELECT * FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY video, track_id ORDER BY frame) - 1) / 9) AS BIGINT) AS block, floor(count(*) OVER (PARTITION BY video, track_id) / 9) AS blocks FROM tracks) WHERE blocks >= 3 AND block < blocks",
    "bsteps": "SELECT *, sqrt(power(cx - lag(cx) OVER t, 2) + power(cy - lag(cy) OVER t, 2)) AS step, sqrt(power(lead(cx, 3) OVER t - lag(cx, 2) OVER t, 2) + power(lead(cy, 3) OVER t - lag(cy, 2) OVER t, 2)) AS g, row_number() OVER t AS k, lead(cx) OVER t AS x1, lead(cy) OVER t AS y1, lead(cx, 2) OVER t AS x2, lead(cy, 2) OVER t AS y2, lead(cx, 3) OVER t AS x3, lead(cy, 3) OVER t AS y3, lead(cx, 4) OVER t AS x4, lead(cy, 4) OVER t AS y4 FROM blocked WINDOW t AS (PARTITION BY video, track_id, block ORDER BY frame)",
    "bsums": "SELECT video, track_id, block, sum(step) / 8 / 1.422 * 50 AS vcl, sqrt(power(max(cx) FILTER (k = 9) - max(cx) FILTER (k = 1), 2) + power(max(cy) FILTER (k = 9) - max(cy) FILTER (k = 1), 2)) AS net, (sum(g) + sum(sqrt(power(x3 - x1, 2) + power(y3 - y1, 2)) + sqrt(power(x4 - cx, 2) + power(y4 - cy, 2))) FILTER (k = 1) + sum(sqrt(power(x4 - cx, 2) + power(y4 - cy, 2))) FILTER (k = 5) + sum(sqrt(power(x2 - cx, 2) + power(y2 - cy, 2))) FILTER (k = 6)) / 5 AS smooth FROM bsteps GROUP BY ALL",
    "bstates": f"SELECT video, track_id, block, {STATE} AS state FROM (SELECT *, CASE WHEN smooth > 0 THEN net / smooth ELSE 0 END AS straightness FROM bsums)",
}
query("W13_block_states", f"SELECT video, track_id, block, {L('state')} FROM bstates", BLOCKS)(lambda s, d: states.block_states(tracks(s, d), 9))
query("W14_modal_blocks", f"SELECT video, track_id, block, {L('state')} FROM (SELECT *, row_number() OVER (PARTITION BY video, track_id, block ORDER BY n DESC, state) AS k FROM (SELECT video, track_id, block, state, count(*) AS n FROM (SELECT *, CAST(floor(idx / 25) AS BIGINT) AS block, floor(count(*) OVER (PARTITION BY video, track_id) / 25) AS blocks FROM states) WHERE blocks >= 2 AND block < blocks GROUP BY ALL)) WHERE k = 1")(lambda s, d: states.modal_blocks(frame_states(s, d)))
WINDOWS = {
    "wn": "SELECT video, greatest(1, CAST(floor(max(frame) / 20) AS BIGINT)) AS n_windows FROM tracks GROUP BY video",
    "span": "SELECT video, track_id, min(frame) AS a, max(frame) AS b FROM states GROUP BY ALL",
    "w": "SELECT video, track_id, window_id FROM span JOIN wn USING (video), LATERAL (SELECT unnest(range(n_windows)) AS window_id) WHERE a < (window_id + 1) * 20 AND b >= window_id * 20",
    "at_mid": "SELECT w.video, w.track_id, w.window_id, coalesce(arg_min(s.state, s.frame) FILTER (s.frame >= w.window_id * 20 + 10), arg_max(s.state, s.frame)) AS state FROM w JOIN states s ON w.video = s.video AND w.track_id = s.track_id GROUP BY ALL",
    "twin": "SELECT video, window_id + 1 AS \"window\", window_id * 20 / 50 AS t_start_s, (window_id + 0.5) * 20 / 50 AS t_mid_s, (window_id + 1) * 20 / 50 AS t_end_s, count(*) AS n_active, count(*) FILTER (state = 0) AS n_progressive, count(*) FILTER (state = 1) AS n_non_progressive, count(*) FILTER (state = 2) AS n_immotile, 100 * count(*) FILTER (state = 0) / count(*) AS pct_progressive, 100 * count(*) FILTER (state = 1) / count(*) AS pct_non_progressive, 100 * count(*) FILTER (state = 2) / count(*) AS pct_immotile FROM at_mid GROUP BY video, window_id",
}


def windows(s: SparkSession, d: str) -> DataFrame:
    return states.temporal_windows(tracks(s, d), 20)


PCT = ["pct_progressive", "pct_non_progressive", "pct_immotile"]
query("W15_temporal_windows", f"SELECT video, {L('\"window\"', 'n_active', 'n_progressive', 'n_non_progressive', 'n_immotile')}, {r('t_start_s', 't_mid_s', 't_end_s', *PCT)} FROM twin", WINDOWS)(windows)
query("A13_temporal_aggregate", f"SELECT {L('\"window\"')}, {r('any_value(t_mid_s) AS t_mid_s', 'avg(n_active) AS n_active_mean', *[f'{f}({c}) AS {c}_{n}' for c in PCT for f, n in (('avg', 'mean'), ('stddev_samp', 'std'))])}, count(DISTINCT video) AS n_videos FROM twin GROUP BY \"window\"", WINDOWS)(lambda s, d: states.temporal_aggregate(windows(s, d)))
TREND = " UNION ALL ".join(f"SELECT '{c}' AS series, {r('slope', 'intercept', 'r2', r_p('sqrt(r2)', 'n') + ' AS p')} FROM (SELECT regr_slope({c}, t_mid_s) AS slope, regr_intercept({c}, t_mid_s) AS intercept, regr_r2({c}, t_mid_s) AS r2, count(*) AS n FROM twin)" for c in PCT)
query("A14_trends", TREND, WINDOWS)(lambda s, d: states.linear_trends(windows(s, d)))
query("A37_video_by_window", f"SELECT v.video, {L('w.\"window\" AS \"window\"')}, {r('t.pct_progressive AS pct_progressive')} FROM (SELECT DISTINCT video FROM twin) v CROSS JOIN (SELECT DISTINCT \"window\" FROM twin) w LEFT JOIN twin t ON t.video = v.video AND t.\"window\" = w.\"window\"", WINDOWS)(lambda s, d: states.heatmap_cells(states.wide_heatmap(windows(s, d))))

# ---- transitions and episodes
query("A15_transition_counts", f"SELECT {L('f AS \"from\"', 't AS \"to\"', 'n')} FROM counts")(lambda s, d: episodes.transition_counts(frame_states(s, d)))
query("A15_transition_counts_by_video", f"SELECT v.video, {L('a.f AS \"from\"', 'b.t AS \"to\"', 'count(m.f) AS n')} FROM (SELECT DISTINCT video FROM states) v, (VALUES (0), (1), (2)) a(f), (VALUES (0), (1), (2)) b(t) LEFT JOIN moves m ON m.video = v.video AND m.f = a.f AND m.t = b.t GROUP BY v.video, a.f, b.t")(lambda s, d: episodes.transition_counts(frame_states(s, d), ["video"]))
query("A16_transition_probabilities", f"SELECT {L('f AS \"from\"', 't AS \"to\"', 'n')}, {r('p')} FROM probs")(lambda s, d: episodes.transition_probabilities(episodes.transition_counts(frame_states(s, d))))
query("A17_persistence", f"SELECT {L('f AS state')}, {r('max(p) FILTER (f = t) AS p_stay', 'CASE WHEN max(p) FILTER (f = t) < 1 THEN 1 / (1 - max(p) FILTER (f = t)) END AS sojourn_frames', 'CASE WHEN max(p) FILTER (f = t) < 1 THEN 1 / (1 - max(p) FILTER (f = t)) END / 50 AS sojourn_s')}, {L('CASE WHEN max(p) FILTER (f <> t) > 0 THEN arg_max(t, p) FILTER (f <> t) END AS next_state')} FROM probs GROUP BY f")(lambda s, d: episodes.persistence(episodes.transition_probabilities(episodes.transition_counts(frame_states(s, d)))))
P3 = "SELECT {by} " + ", ".join(f"max(p) FILTER (f = {i} AND t = {j}) AS p{i}{j}" for i in range(3) for j in range(3)) + " FROM {source}"
TREES = {"w": ", ".join(f"p{j}{i} * p{k}{i} + p{j}{i} * p{k}{j} + p{k}{i} * p{j}{k} AS w{i}" for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1)))}
query("A18_stationary", f"SELECT {L('state')}, {r('CASE WHEN w0 + w1 + w2 > 0 THEN CASE state WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END / (w0 + w1 + w2) END AS pi')} FROM (SELECT {TREES['w']} FROM p3), (VALUES (0), (1), (2)) x(state)", {"p3": P3.format(by="", source="probs")})(lambda s, d: episodes.stationary(episodes.transition_probabilities(episodes.transition_counts(frame_states(s, d)))))


def two_cohorts(s: SparkSession, d: str) -> DataFrame:
    return summary.union_all([states.frame_states(t(s, d).withColumn("cohort", F.lit(n)), key=("cohort", *K)) for n, t in (("gt", tracks), ("auto", pred))])


PRED = {"psteps": CTES["steps"].replace("FROM tracks", "FROM pred_tracks"), "pkin": kinematics_sql(25, "psteps"), "pstates": f"SELECT video, track_id, frame, idx, {STATE} AS state FROM pkin"}
BOTH = PRED | {"cohorts": "SELECT 'gt' AS cohort, * FROM states UNION ALL SELECT 'auto', * FROM pstates", "bmoves": "SELECT cohort, state AS f, lead(state) OVER (PARTITION BY cohort, video, track_id ORDER BY idx) AS t FROM cohorts"}
BOTH |= {"bcounts": "SELECT c.cohort, a.f, b.t, (SELECT count(*) FROM bmoves m WHERE m.cohort = c.cohort AND m.f = a.f AND m.t = b.t) AS n FROM (SELECT DISTINCT cohort FROM cohorts) c, (VALUES (0), (1), (2)) a(f), (VALUES (0), (1), (2)) b(t)", "bprobs": "SELECT *, CASE WHEN sum(n) OVER (PARTITION BY cohort, f) > 0 THEN n / sum(n) OVER (PARTITION BY cohort, f) ELSE 0 END AS p FROM bcounts"}
query("A19_cohort_matrices", f"SELECT cohort, {L('f AS \"from\"', 't AS \"to\"', 'n')}, {r('p')} FROM bprobs", BOTH)(lambda s, d: episodes.transition_probabilities(episodes.transition_counts(two_cohorts(s, d), ["cohort"], ("cohort", *K)), ["cohort"]))
query("A19_cohort_stationary", f"SELECT cohort, {L('state')}, {r('CASE WHEN w0 + w1 + w2 > 0 THEN CASE state WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END / (w0 + w1 + w2) END AS pi')} FROM (SELECT cohort, {TREES['w']} FROM p3), (VALUES (0), (1), (2)) x(state)", BOTH | {"p3": P3.format(by="cohort,", source="bprobs GROUP BY cohort")})(lambda s, d: episodes.stationary(episodes.transition_probabilities(episodes.transition_counts(two_cohorts(s, d), ["cohort"], ("cohort", *K)), ["cohort"]), ["cohort"]))
query("A44_switch_rate", f"SELECT video, {r('sum(switches) / (sum(n) / 50) AS switch_rate')}, {L('sum(switches) AS switches')} FROM rates GROUP BY video")(lambda s, d: episodes.switch_rate(frame_states(s, d, 9), ["video"]))
query("W16_episodes", f"SELECT {', '.join(K)}, {L('ep_idx', 'state', 'run', 'n_eps')}, is_first, is_last, censored FROM eps9")(eps9)
query("W17_censored_runs", f"SELECT {L('state')}, censored, count(*) AS n, {L('sum(run) AS frames')} FROM eps9 GROUP BY state, censored")(lambda s, d: eps9(s, d).groupBy("state", "censored").agg(F.count("*").alias("n"), F.sum("run").alias("frames")))
query("W18_dwell_seconds", f"SELECT {L('state')}, {r('run / 50 AS seconds')}, n FROM hist")(lambda s, d: episodes.dwell_histogram(eps9(s, d)).select("state", (F.col("run") / 50).alias("seconds"), "n"))
query("W25_interior_runs", f"SELECT {L('state', 'run')}, count(*) AS n FROM eps9 WHERE NOT censored GROUP BY state, run")(lambda s, d: episodes.dwell_histogram(eps9(s, d).filter("not censored")))
FLICK = {
    "flists": "SELECT video, track_id, list([{ep_idx: CAST(ep_idx AS BIGINT), state: state, run: CAST(run AS BIGINT)}] ORDER BY ep_idx) AS eps FROM eps9 GROUP BY video, track_id",
    "fmerged": "SELECT video, track_id, list_reduce(eps, lambda a, x: CASE WHEN len(a) >= 2 AND a[-1].run <= 3 AND a[-2].state = x[1].state AND a[-1].state <> x[1].state THEN list_concat(a[:len(a) - 2], [{ep_idx: a[-2].ep_idx, state: a[-2].state, run: a[-2].run + a[-1].run + x[1].run}]) ELSE list_concat(a, x) END) AS eps FROM flists",
}
query("W19_flicker_merge", f"SELECT video, track_id, {L('k - 1 AS ep_idx', 'eps[k].state AS state', 'eps[k].run AS run')} FROM (SELECT *, unnest(range(1, len(eps) + 1)) AS k FROM fmerged)", FLICK)(lambda s, d: episodes.merge_flickers(eps9(s, d), 3))
NEXT = "CASE a.st[-1] WHEN 2 THEN CASE WHEN x.v <= 5.5 THEN 2 WHEN x.v >= 27.5 AND x.s >= 0.55 THEN 0 ELSE 1 END WHEN 0 THEN CASE WHEN x.v <= 4.5 THEN 2 WHEN x.v < 22.5 OR x.s < 0.45 THEN 1 ELSE 0 END ELSE CASE WHEN x.v <= 4.5 THEN 2 WHEN x.v >= 27.5 AND x.s >= 0.55 THEN 0 ELSE 1 END END"
HYST = {"hlists": f"SELECT video, track_id, list({{v: vcl, s: straightness, st: [CAST({STATE} AS INT)]}} ORDER BY idx) AS h, list(frame ORDER BY idx) AS f FROM kin GROUP BY video, track_id", "hstates": f"SELECT video, track_id, f, list_reduce(h, lambda a, x: {{v: x.v, s: x.s, st: list_append(a.st, CAST({NEXT} AS INT))}}).st AS st FROM hlists"}
query("W20_hysteresis_states", f"SELECT video, track_id, {L('f[k] AS frame', 'k - 1 AS idx', 'st[k] AS state')} FROM (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM hstates)", HYST)(lambda s, d: episodes.hysteresis_states(states.frame_kinematics(tracks(s, d)), 0.1))
GEO = {
    "mom": "SELECT state, sum(n) AS n, sum(n * run) / sum(n) AS mean, sum(n * run * run) / sum(n) AS sq, max(run) AS top FROM hist GROUP BY state",
    "ks": "SELECT m.state, max(abs((SELECT sum(n) FROM hist h WHERE h.state = m.state AND h.run <= k) / m.n - (1 - power(greatest(1e-6, 1 - 1 / mean), k)))) AS ks FROM (SELECT *, unnest(range((SELECT min(run) FROM hist), top + 1)) AS k FROM mom) m GROUP BY m.state",
    "ks0": "SELECT state, max(abs(coalesce((SELECT sum(n) FROM hist h WHERE h.state = m.state AND h.run <= k), 0) / m.n - (1 - power(greatest(1e-6, 1 - 1 / mean), k)))) AS ks FROM (SELECT *, unnest(range(1, top + 1)) AS k FROM mom) m GROUP BY state",
}
query("A20_geometric_test", f"SELECT {L('m.state AS state', 'n AS n_episodes')}, {r('mean', 'mean / 50 AS mean_s', 'sqrt(greatest(0, sq - mean * mean)) / mean AS cv', '(SELECT coalesce(sum(h.n), 0) FROM hist h WHERE h.state = m.state AND h.run > 3 * mean) / n AS emp_tail', 'power(greatest(1e-6, 1 - 1 / mean), floor(3 * mean)) AS geo_tail', '(SELECT coalesce(sum(h.n), 0) FROM hist h WHERE h.state = m.state AND h.run > 3 * mean) / n / power(greatest(1e-6, 1 - 1 / mean), floor(3 * mean)) AS tail_excess', 'ks')} FROM mom m JOIN ks0 ON m.state = ks0.state", GEO)(lambda s, d: episodes.geometric_test(episodes.dwell_histogram(eps9(s, d))))
query("A21_pooled_cv", f"SELECT {L('state')}, {r('stddev_pop(run) / avg(run) AS pooled_cv')}, count(*) AS n FROM eps9 GROUP BY state")(lambda s, d: episodes.pooled_cv(eps9(s, d)))
query("A21_within_cv", f"SELECT {L('state')}, count(*) AS n_tracks, {r('quantile_cont(cv, 0.5) AS median_cv', 'quantile_cont(cv, 0.25) AS q25', 'quantile_cont(cv, 0.75) AS q75')} FROM (SELECT state, stddev_pop(run) / avg(run) AS cv FROM eps9 GROUP BY video, track_id, state HAVING count(*) >= 3) GROUP BY state")(lambda s, d: episodes.within_cv(eps9(s, d), 3))
ICC = {"resid3": "SELECT e.*, ln(run / 50) - m AS resid FROM eps9 e JOIN (SELECT state, avg(ln(run / 50)) AS m FROM eps9 GROUP BY state) USING (state) WHERE n_eps >= 3", "per": "SELECT video, track_id, count(*) AS n, avg(resid) AS m, var_pop(resid) AS v FROM resid3 GROUP BY ALL HAVING count(*) >= 3", "tot": "SELECT count(*) AS k, sum(n) AS nn, sum(n * n) AS n2, sum(n * m * m) - sum(n) * power(sum(n * m) / sum(n), 2) AS ssb, sum(n * v) AS ssw FROM per"}
query("A22_icc", f"SELECT {r('(ssb / (k - 1) - ssw / (nn - k)) / (ssb / (k - 1) + ((nn - n2 / nn) / (k - 1) - 1) * ssw / (nn - k)) AS icc', 'ssb / (ssb + ssw) AS eta2')}, {L('k AS n_groups', 'nn AS n')} FROM tot", ICC)(lambda s, d: episodes.anova_icc(serial.residuals(eps9(s, d), 3), "resid", K))
RICC = {
    "rres": ranks("SELECT video, track_id, state, resid AS x, 0 AS y FROM resid"),
    "rper": "SELECT video, track_id, state, count(*) AS n, avg(rk) AS m, var_pop(rk) AS v FROM (SELECT *, rx / count(*) OVER () AS rk FROM rres) GROUP BY ALL HAVING count(*) >= 2",
    "rtot": "SELECT p.state, count(*) AS k, sum(n) AS nn, sum(n * n) AS n2, sum(n * power(m - g, 2)) AS ssb, sum(n * v) AS ssw FROM rper p JOIN (SELECT state, sum(n * m) / sum(n) AS g FROM rper GROUP BY state) USING (state) GROUP BY p.state",
    "ricc": "SELECT *, (ssb / (k - 1) - ssw / (nn - k)) / (ssb / (k - 1) + ((nn - n2 / nn) / (k - 1) - 1) * ssw / (nn - k)) AS icc, ssb / (ssb + ssw) AS eta2 FROM rtot WHERE k > 1 AND nn > k",
}
query("A22_rank_icc", f"SELECT {L('state', 'k AS n_groups', 'nn AS n')}, {r('icc', 'eta2')} FROM ricc", RICC)(lambda s, d: episodes.rank_icc(resid(s, d)).filter("icc is not null"))
query("A22_rank_icc_pooled", f"SELECT {r('sum(icc * nn) / sum(nn) AS icc')}, {L('sum(nn) AS n')} FROM ricc WHERE k >= 5", RICC)(lambda s, d: episodes.pooled_icc(episodes.rank_icc(resid(s, d))))
TRUNC = {
    "plens": "SELECT len, sum(c) OVER (ORDER BY len) AS cum FROM (SELECT len, count(*) AS c FROM (SELECT count(*) AS len FROM pred_tracks GROUP BY video, track_id) GROUP BY len)",
    "tsize": "SELECT video, track_id, n, CAST(('0x' || substr(md5(video || '|' || track_id || '|length|0'), 1, 8)) AS BIGINT) AS u, CAST(('0x' || substr(md5(video || '|' || track_id || '|start|0'), 1, 8)) AS BIGINT) AS w, (SELECT max(cum) FROM plens WHERE len <= n) AS top FROM (SELECT video, track_id, count(*) AS n FROM tracks GROUP BY ALL)",
    "tpick": "SELECT video, track_id, w % (n - len + 1) AS start, len FROM (SELECT *, CASE WHEN top IS NULL THEN n ELSE (SELECT min(p.len) FROM plens p WHERE p.cum > u % top) END AS len FROM tsize) WHERE len >= 10",
    "tseg": "SELECT t.* EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY video, track_id ORDER BY frame) - 1 AS i FROM tracks) t JOIN tpick USING (video, track_id) WHERE i >= start AND i < start + len",
    "tsteps": CTES["steps"].replace("FROM tracks", "FROM tseg"), "tkin": kinematics_sql(9, "tsteps"), "tstates": f"SELECT video, track_id, frame, idx, {STATE} AS state FROM tkin",
    "teps": CTES["eps9"].replace("FROM states9", "FROM tstates"),
}
query("J13_truncated_tracks", f"SELECT video, track_id, {L('frame')}, {r('cx', 'cy')} FROM tseg", TRUNC)(lambda s, d: episodes.truncated(tracks(s, d), pred(s, d)).select(*K, "frame", "cx", "cy"))
query("J13_truncated_dwells", f"SELECT {L('state')}, count(*) AS n, {r('avg(run) / 50 AS mean_s', 'stddev_pop(run) / avg(run) AS cv')} FROM teps GROUP BY state", TRUNC)(
    lambda s, d: episodes.episodes(states.frame_states(episodes.truncated(tracks(s, d), pred(s, d)), 9)).groupBy("state").agg(F.count("*").alias("n"), (F.avg("run") / 50).alias("mean_s"), (F.stddev_pop("run") / F.avg("run")).alias("cv"))
)
query("A23_eta_squared", f"SELECT {r('sum(n * power(m - g, 2)) / sum(n * power(m - g, 2) + n * v) AS eta2')} FROM (SELECT count(*) AS n, avg(vcl) AS m, var_pop(vcl) AS v FROM kin GROUP BY video, track_id), (SELECT avg(vcl) AS g FROM kin)")(lambda s, d: episodes.anova_icc(states.frame_kinematics(tracks(s, d)), "vcl", K, min_n=1).select("eta2"))
query("A30_occupancy", f"SELECT {L('state')}, {r('count(*) / sum(count(*)) OVER () AS share')} FROM states GROUP BY state")(lambda s, d: frame_states(s, d).groupBy("state").agg(F.count("*").alias("n")).select("state", agreement.share(F.col("n")).alias("share")))
query("A31_quantiles", f"SELECT {r(*[f'quantile_cont(vcl, {p}) AS q{int(p * 100)}' for p in (0.05, 0.25, 0.5, 0.75, 0.95)])} FROM kin")(lambda s, d: exact_quantiles(states.frame_kinematics(tracks(s, d)), {"vcl": {f"q{int(p * 100)}": p for p in FIVE}}))
W27_STEPS = "SELECT *, sqrt(power(cx - lag(cx) OVER t, 2) + power(cy - lag(cy) OVER t, 2)) AS step FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY video, track_id ORDER BY frame) - 1) / 25) AS BIGINT) AS block FROM tracks) WINDOW t AS (PARTITION BY video, track_id, block ORDER BY frame)"

query("A31_block_quantiles", f"SELECT {r(*[f'quantile_cont({c}, {p}) AS {c}_q{int(p * 100)}' for c in ('vcl', 'lin') for p in FIVE])} FROM bkin", {"b25": W27_STEPS, "bkin": "SELECT sum(step) / 1.422 / 24 * 50 AS vcl, CASE WHEN sum(step) > 0 THEN sqrt(power(arg_max(cx, frame) - arg_min(cx, frame), 2) + power(arg_max(cy, frame) - arg_min(cy, frame), 2)) / sum(step) ELSE 0 END AS lin FROM b25 GROUP BY video, track_id, block HAVING count(*) = 25"})(lambda s, d: exact_quantiles(signal.block_kinematics(tracks(s, d)), {c: {f"{c}_q{int(p * 100)}": p for p in FIVE} for c in ("vcl", "lin")}))
query("A31_crossing_intervals", f"SELECT {r(*[f'quantile_cont(gap, {p}) AS q{int(p * 100)}' for p in FIVE])} FROM (SELECT (idx - lag(idx) OVER (PARTITION BY video, track_id ORDER BY idx)) / 50 AS gap FROM (SELECT *, CASE WHEN (sp >= 25) <> (lag(sp) OVER (PARTITION BY video, track_id ORDER BY idx) >= 25) THEN 1 ELSE 0 END AS c FROM (SELECT video, track_id, idx, sqrt(vx * vx + vy * vy) AS sp FROM vel)) WHERE c = 1)")(lambda s, d: exact_quantiles(signal.crossing_gaps(signal.velocities(tracks(s, d)).withColumn("speed", scalar.distance(F.col("vx"), F.col("vy"))), "speed", 25.0), {"gap": {f"q{int(p * 100)}": p for p in FIVE}}))
query("A38_survival", f"SELECT {L('state', 'run')}, {r('1 - sum(n) OVER (PARTITION BY state ORDER BY run) / sum(n) OVER (PARTITION BY state) AS survival')} FROM hist")(lambda s, d: episodes.survival(eps9(s, d)))
query("A39_track_lengths", f"SELECT {r(*[f'quantile_cont(n, {p}) AS q{int(p * 100)}' for p in (0.05, 0.5, 0.95)], 'avg(n) AS mean')}, count(*) AS n_tracks FROM (SELECT count(*) AS n FROM tracks GROUP BY video, track_id)")(lambda s, d: kinematics.track_lengths(tracks(s, d)))
KSP = "CASE WHEN ks * sqrt(tn * tm / (tn + tm)) < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: power(-1, k - 1) * exp(-2 * k * k * ks * ks * tn * tm / (tn + tm)))))) END AS p"
query("A39_ks_dwell_length", f"SELECT {r('ks', KSP)} FROM (SELECT max(abs(a - b)) AS ks, any_value(tn) AS tn, any_value(tm) AS tm FROM (SELECT sum(na) OVER () AS tn, sum(nb) OVER () AS tm, sum(na) OVER (ORDER BY x) / sum(na) OVER () AS a, sum(nb) OVER (ORDER BY x) / sum(nb) OVER () AS b FROM (SELECT x, sum(na) AS na, sum(nb) AS nb FROM (SELECT run AS x, 1 AS na, 0 AS nb FROM eps9 UNION ALL SELECT count(*), 0, 1 FROM tracks GROUP BY video, track_id) GROUP BY x)))")(lambda s, d: episodes.two_sample_ks(eps9(s, d).select("run"), tracks(s, d).groupBy(*K).agg(F.count("*").alias("run")), "run"))
query("A40_boundary_fractions", f"SELECT count(*) AS n, {r('avg(CASE WHEN censored AND NOT (is_first AND is_last) THEN 1.0 ELSE 0 END) AS one_boundary', 'avg(CASE WHEN is_first AND is_last THEN 1.0 ELSE 0 END) AS whole_track', 'avg(CASE WHEN censored THEN 0 ELSE 1.0 END) AS interior')} FROM eps9")(lambda s, d: episodes.boundary_fractions(eps9(s, d)))
FANO = {
    "ends": "SELECT video, track_id, is_last, sum(run) OVER (PARTITION BY video, track_id ORDER BY ep_idx) AS e, sum(run) OVER (PARTITION BY video, track_id) AS total FROM eps9",
    "wins": "SELECT video, track_id, t, unnest(range(CAST(floor(total / 50 / t) AS BIGINT))) AS w FROM (SELECT DISTINCT video, track_id, total FROM ends), (VALUES (0.2), (0.3)) x(t) WHERE floor(total / 50 / t) >= 4",
    "cnt": "SELECT w.video, w.track_id, w.t, w.w, count(e.e) AS c FROM wins w LEFT JOIN ends e ON e.video = w.video AND e.track_id = w.track_id AND NOT e.is_last AND floor(e.e / 50 / w.t) = w.w GROUP BY ALL",
}
query("A43_fano", f"SELECT {r('CAST(t AS DOUBLE) AS \"T\"', 'CASE WHEN count(*) >= 10 THEN quantile_cont(f, 0.5) END AS fano')}, count(*) AS n_tracks FROM (SELECT t, var_samp(c) / avg(c) AS f FROM cnt GROUP BY video, track_id, t HAVING sum(c) > 0) GROUP BY t", FANO)(lambda s, d: episodes.fano(eps9(s, d), (0.2, 0.3), min_tracks=10))
query("W34_embedded_chain", f"SELECT {L('1 AS \"order\"', 'a', 'b', '-1 AS c', 'count(*) AS n')} FROM (SELECT state AS a, lead(state) OVER (PARTITION BY video, track_id ORDER BY ep_idx) AS b FROM eps9) WHERE b IS NOT NULL GROUP BY a, b UNION ALL SELECT {L('2 AS "order"', 'a', 'b', 'c', 'count(*) AS n')} FROM (SELECT state AS a, lead(state) OVER t AS b, lead(state, 2) OVER t AS c FROM eps9 WINDOW t AS (PARTITION BY video, track_id ORDER BY ep_idx)) WHERE c IS NOT NULL GROUP BY a, b, c")(lambda s, d: episodes.embedded_chain(eps9(s, d)))
JPAIR = {
    "jres": ranks("SELECT video, track_id, state, resid AS x, 0 AS y FROM resid"),
    "jper": "SELECT video, track_id, state, avg(rx) AS m FROM jres GROUP BY ALL HAVING count(*) >= 2",
    "jrk": ranks("SELECT p.state AS a, q.state AS b, p.m AS x, q.m AS y FROM jper p JOIN jper q ON p.video = q.video AND p.track_id = q.track_id AND p.state < q.state", "a, b"),
}
query("J11_state_pairs", f"SELECT {L('a', 'b')}, count(*) AS n, {r('corr(rx, ry) AS rho')} FROM jrk GROUP BY a, b HAVING count(*) >= 8", JPAIR)(lambda s, d: episodes.state_pairs(resid(s, d)))

# ---- order, laws
FOLD = "CAST(('0x' || substr(md5(video || '|' || track_id || '|0'), 1, 8)) AS BIGINT) % 5"
CTX = {"tok": f"SELECT {FOLD} AS fold, state AS nxt, lag(state) OVER t AS s1, lag(state, 2) OVER t AS s2, lag(state, 3) OVER t AS s3 FROM states WINDOW t AS (PARTITION BY video, track_id ORDER BY idx)", "ctok": "SELECT 0 AS o, fold, '' AS ctx, nxt FROM tok UNION ALL SELECT 1, fold, s1::VARCHAR, nxt FROM tok WHERE s1 IS NOT NULL UNION ALL SELECT 2, fold, s2::VARCHAR || s1, nxt FROM tok WHERE s2 IS NOT NULL UNION ALL SELECT 3, fold, s3::VARCHAR || s2 || s1, nxt FROM tok WHERE s3 IS NOT NULL"}
CTX |= {
    "cf": "SELECT o, fold, ctx, nxt, count(*) AS n FROM ctok GROUP BY ALL",
    "ca": "SELECT o, ctx, nxt, sum(n) AS t FROM cf GROUP BY ALL",
    "cx": "SELECT o, ctx, sum(n) AS ct FROM cf GROUP BY ALL",
    "cxf": "SELECT o, fold, ctx, sum(n) AS c FROM cf GROUP BY ALL",
    "uni": "SELECT f.fold, u.nxt, (u.t - coalesce(c.n, 0) + 0.5) / (sum(u.t - coalesce(c.n, 0)) OVER (PARTITION BY f.fold) + 1.5) AS g FROM (SELECT DISTINCT fold FROM cf) f CROSS JOIN (SELECT nxt, t FROM ca WHERE o = 0) u LEFT JOIN (SELECT * FROM cf WHERE o = 0) c ON c.fold = f.fold AND c.nxt = u.nxt",
    "ll": "SELECT cf.o, sum(cf.n * ln(CASE WHEN ct - c > 0 THEN (t - cf.n + 0.5) / (ct - c + 1.5) ELSE g END + 1e-12)) / sum(cf.n) AS ll, sum(cf.n) AS n FROM cf JOIN ca ON cf.o = ca.o AND cf.ctx = ca.ctx AND cf.nxt = ca.nxt JOIN cx ON cf.o = cx.o AND cf.ctx = cx.ctx JOIN cxf ON cf.o = cxf.o AND cf.ctx = cxf.ctx AND cf.fold = cxf.fold JOIN uni ON cf.fold = uni.fold AND cf.nxt = uni.nxt GROUP BY cf.o",
}
query("M05_context_counts", f"SELECT ctx, {L('nxt AS next', 't AS n')} FROM ca WHERE o = 2", CTX)(lambda s, d: order.context_counts(frame_states(s, d), 2))
query("M06_order_test", f"SELECT {L('o AS \"order\"', 'n AS n_tokens')}, {r('ll AS ll_per_token')} FROM ll", CTX)(lambda s, d: order.order_test(frame_states(s, d)))
query("M06_order_gains", f"SELECT {L('a.o AS \"order\"')}, {r('a.ll - b.ll AS gain', 'exp(b.ll - a.ll) AS perplexity_ratio')} FROM ll a JOIN ll b ON a.o = b.o + 1", CTX)(lambda s, d: order.order_gains(order.order_test(frame_states(s, d))))
MODAL9 = "SELECT video, track_id, block, CAST(state AS BIGINT) AS state FROM (SELECT *, row_number() OVER (PARTITION BY video, track_id, block ORDER BY n DESC, state) AS k FROM (SELECT video, track_id, block, state, count(*) AS n FROM (SELECT *, CAST(floor(idx / 9) AS BIGINT) AS block, floor(count(*) OVER (PARTITION BY video, track_id) / 9) AS blocks FROM states) WHERE blocks >= 2 AND block < blocks GROUP BY ALL)) WHERE k = 1"
MODAL = CTX | BLOCKS | {"tok": CTX["tok"].replace("FROM states", "FROM bstates").replace("ORDER BY idx", "ORDER BY block")}
query("M07_block_order_test", f"SELECT {L('o AS \"order\"', 'n AS n_tokens')}, {r('ll AS ll_per_token')} FROM ll", MODAL)(lambda s, d: order.order_test(states.block_states(tracks(s, d), 9), index="block"))
LAWS = {"sums": "SELECT state, sum(n) AS n, sum(n * run / 50) AS sx, sum(n * ln(run / 50)) AS sl, sum(n * power(ln(run / 50), 2)) AS sl2 FROM hist GROUP BY state", "va": "SELECT *, sl2 / n - power(sl / n, 2) AS v FROM sums"}
query("M01_closed_laws", f"SELECT {L('state', 'n')}, 'exponential' AS law, {r('sx / n AS a', 'CAST(NULL AS DOUBLE) AS b', '2 + 2 * n * (ln(sx / n) + 1) AS aic')} FROM sums UNION ALL SELECT {L('state', 'n')}, 'lognormal', {r('sl / n AS a', 'sqrt(v) AS b', '4 + 2 * (n * (0.5 * ln(2 * pi() * v) + 0.5) + sl) AS aic')} FROM va", LAWS)(lambda s, d: laws.closed_laws(episodes.dwell_histogram(eps9(s, d))))
query("M01_dwell_laws")(lambda s, d: laws.dwell_laws(episodes.dwell_histogram(eps9(s, d))))
query("M02_censored_exponential", f"SELECT {L('state', 'events')}, {r('seconds', 'events / seconds AS rate', '2 - 2 * (events * ln(events / seconds) - events) AS aic')} FROM (SELECT state, count(*) FILTER (NOT censored) AS events, sum(run) / 50 AS seconds FROM eps9 GROUP BY state)")(lambda s, d: laws.censored_exponential(episodes.dwell_histogram(eps9(s, d), censoring=True)))
query("M02_censored_laws")(lambda s, d: laws.censored_laws(episodes.dwell_histogram(eps9(s, d), censoring=True)))
query("M10_frailty")(lambda s, d: models.frailty(eps9(s, d), max_iter=60, tol=1e-4))
query("M03_hill_exponent", f"SELECT {L('state')}, {r('xmin')}, count(*) AS n_tail, {r('CASE WHEN count(*) >= 50 AND sum(ln(run / 50 / xmin)) > 0 THEN 1 + count(*) / sum(ln(run / 50 / xmin)) END AS alpha')} FROM eps9 JOIN (SELECT state, quantile_cont(run / 50, 0.5) AS xmin FROM eps9 GROUP BY state) USING (state) WHERE run / 50 >= xmin GROUP BY state, xmin")(lambda s, d: laws.hill_exponent(eps9(s, d)))
M4_WINDOWS = (9, 13, 25, 51)
M4 = {}
for _w in M4_WINDOWS:
    M4 |= {f"m4kin{_w}": kinematics_sql(_w), f"m4states{_w}": f"SELECT video, track_id, frame, idx, {STATE} AS state FROM m4kin{_w}", f"m4eps{_w}": CTES["eps9"].replace("FROM states9", f"FROM m4states{_w}")}
M4["sums"] = " UNION ALL ".join(f"SELECT {w} AS state_window, state, count(*) AS n, sum(run / 50) AS sx, sum(ln(run / 50)) AS sl, sum(power(ln(run / 50), 2)) AS sl2 FROM m4eps{w} GROUP BY state" for w in M4_WINDOWS)
M4["va"] = LAWS["va"]
query("M04_closed_laws_by_window", f"SELECT {L('state_window', 'state', 'n')}, 'exponential' AS law, {r('sx / n AS a', 'CAST(NULL AS DOUBLE) AS b', '2 + 2 * n * (ln(sx / n) + 1) AS aic')} FROM sums UNION ALL SELECT {L('state_window', 'state', 'n')}, 'lognormal', {r('sl / n AS a', 'CASE WHEN v > 1e-12 THEN sqrt(v) ELSE 0 END AS b', 'CASE WHEN v > 1e-12 THEN 4 + 2 * (n * (0.5 * ln(2 * pi() * v) + 0.5) + sl) END AS aic')} FROM va", M4)(
    lambda s, d: summary.union_all([laws.closed_laws(episodes.dwell_histogram(episodes.episodes(frame_states(s, d, w)))).withColumn("state_window", F.lit(w)) for w in M4_WINDOWS])
)
query("M04_laws_by_window")(lambda s, d: laws.dwell_laws(episodes.dwell_histogram(summary.union_all([episodes.episodes(frame_states(s, d, w)).withColumn("state_window", F.lit(w)) for w in M4_WINDOWS]), ["state_window", "state"]), ["state_window", "state"]))
query("M04_restricted_laws")(lambda s, d: laws.dwell_laws(episodes.dwell_histogram(eps9(s, d).filter("run >= 9"))))

# ---- serial memory
query("W21_residuals", f"SELECT {', '.join(K)}, {L('ep_idx', 'state')}, {r('resid')} FROM resid")(lambda s, d: resid(s, d).select(*K, "ep_idx", "state", "resid"))
query("W22_trait_residuals", f"SELECT {', '.join(K)}, {L('ep_idx', 'state')}, {r('resid')} FROM trait")(lambda s, d: serial.trait_residuals(eps9(s, d)).select(*K, "ep_idx", "state", "resid"))
query("W23_lag_pairs", f"SELECT {', '.join(K)}, {L('lag')}, {r('x', 'y')} FROM pairs")(lambda s, d: serial.lag_pairs(resid(s, d)))
query("W24_spearman_by_lag", f"SELECT {L('lag')}, {r('CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS rho')}, count(*) AS n FROM ranked GROUP BY lag", {"ranked": ranks("SELECT * FROM pairs", "lag")})(lambda s, d: serial.spearman(serial.lag_pairs(resid(s, d)), ["lag"], few=True))
CELL = {"res6": "SELECT e.*, ln(run / 50) - m AS resid FROM eps9 e JOIN (SELECT state, avg(ln(run / 50)) AS m FROM eps9 GROUP BY state) USING (state) WHERE n_eps >= 5", "p6": "SELECT video, track_id, x, y FROM (SELECT video, track_id, resid AS x, lead(resid) OVER (PARTITION BY video, track_id ORDER BY ep_idx) AS y FROM res6) WHERE y IS NOT NULL", "rk6": ranks("SELECT * FROM p6", "video, track_id"), "rho6": "SELECT CASE WHEN count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM rk6 GROUP BY video, track_id"}
query("M12_per_cell_memory", f"SELECT {r('tanh(avg(atanh(greatest(-0.999, least(0.999, rho))))) AS mean_rho')}, count(*) AS n_tracks FROM rho6 WHERE rho IS NOT NULL", CELL)(lambda s, d: serial.per_cell_memory(eps9(s, d), 5))
query("M11_permutation_null")(lambda s, d: serial.permutation_null(resid(s, d)))
def lag_counts(s: SparkSession, d: str, t=tracks, perms: int = 30) -> DataFrame:
    """Counts of successive residuals by video, observed and permuted."""
    return serial.pair_counts(serial.residuals(episodes.episodes(states.frame_states(t(s, d), 9))), perms, 1)


query("M13_bootstrap")(lambda s, d: serial.interval(serial.bootstrap_deltas(lag_counts(s, d), 100)))
query("M13_cohort_difference")(lambda s, d: serial.cohort_difference(serial.bootstrap_deltas(lag_counts(s, d), 100), serial.bootstrap_deltas(lag_counts(s, d, pred), 100, seed=1)))
query("M13_leave_one_out_range")(lambda s, d: serial.deltas(serial.leave_one_out(lag_counts(s, d, perms=3), ["perm"]), ["left_out"]).agg(F.min("delta").alias("low"), F.max("delta").alias("high"), F.count("*").alias("n_videos")))
LOO = {"cp": "SELECT l.video AS left_out, p.video, x, y FROM pairs p, (SELECT DISTINCT video FROM pairs WHERE lag = 1) l WHERE lag = 1 AND p.video <> l.video", "rkl": ranks("SELECT * FROM cp", "left_out")}
query("M13_leave_one_out", f"SELECT left_out, {r('CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho')}, count(*) AS n FROM rkl GROUP BY left_out", LOO)(lambda s, d: serial.leave_one_out(serial.pair_counts(resid(s, d))))
query("M14_wild_bootstrap")(lambda s, d: serial.wild_bootstrap_t(serial.permutation_null(resid(s, d), 50, 1, by=["video"], min_pairs=30)))
query("M15_scc_profile")(lambda s, d: summary.union_all([serial.scc_profile(x).withColumn("variant", F.lit(n)) for n, x in (("raw", resid(s, d)), ("trait", serial.trait_residuals(eps9(s, d))))]))
query("M15_scc_intervals")(lambda s, d: serial.scc_intervals(resid(s, d), 5, perms=30, reps=100))
query("M16_design_sweep")(lambda s, d: battery.design_sweep(tracks(s, d), 10, 40))

# ---- features and statistics
query("A24_gini", f"SELECT video, {r('CASE WHEN sum(x) > 0 THEN sum((2 * k - n - 1) * x) / (n * sum(x)) ELSE 0 END AS gini')} FROM (SELECT video, round(rate, 9) AS x, row_number() OVER (PARTITION BY video ORDER BY rate) AS k, count(*) OVER (PARTITION BY video) AS n FROM rates) GROUP BY video, n")(lambda s, d: features.gini(features.cell_rates(frame_states(s, d, 9)).withColumn("rate", F.round("rate", 9)), "rate", ["video"]))
query("A25_cell_rates", f"SELECT {', '.join(K)}, {L('switches', 'n', 'first_state')}, {r('rate')} FROM rates")(lambda s, d: features.cell_rates(frame_states(s, d, 9)))
RATEF = {"rgini": "SELECT video, CASE WHEN sum(x) > 0 THEN sum((2 * k - n - 1) * x) / (n * sum(x)) ELSE 0 END AS g FROM (SELECT video, round(rate, 9) AS x, row_number() OVER (PARTITION BY video ORDER BY rate) AS k, count(*) OVER (PARTITION BY video) AS n FROM rates) GROUP BY video, n", "rsum": "SELECT video, count(*) AS n, avg(rate) AS m, stddev_pop(rate) AS sd, avg(CASE WHEN switches = 0 THEN 1.0 ELSE 0 END) AS st FROM rates GROUP BY video"}
query("A25_rate_features", f"SELECT video, {L('n AS n_cells')}, {r('m AS mean_rate', 'sd AS sd_rate', 'st AS stayer_frac', 'CASE WHEN m > 0 THEN sd / m END AS cv_rate', 'g AS gini_rate')} FROM rsum JOIN rgini USING (video)", RATEF)(lambda s, d: features.rate_features(features.cell_rates(frame_states(s, d, 9))))
query("A26_stayer_features", f"SELECT a.*, frac_prog, frac_nonprog, frac_immotile FROM (SELECT video, count(*) AS n_cells, {r('avg(CASE WHEN switches = 0 THEN 1.0 ELSE 0 END) AS stayer_frac', *[f'avg(CASE WHEN switches = 0 AND first_state = {k} THEN 1.0 ELSE 0 END) AS stable_{n}_frac' for k, n in enumerate(features.SHORT)])} FROM rates GROUP BY video) a JOIN (SELECT video, {r(*[f'avg(CASE WHEN state = {k} THEN 1.0 ELSE 0 END) AS frac_{n}' for k, n in enumerate(features.SHORT)])} FROM states9 GROUP BY video) b USING (video)")(lambda s, d: features.stayer_features(frame_states(s, d, 9)))
SHORT = features.SHORT
PART = {
    "casa": "SELECT video, count(*) AS n_tracks, " + ", ".join(f'{f}("{m}") AS "{m}_{n}"' for m in METRICS for f, n in (("avg", "mean"), ("stddev_samp", "sd"))) + " FROM metrics GROUP BY video",
    "pcomp": "SELECT video, count(*) AS n_frames, " + ", ".join(f"avg(CASE WHEN state = {k} THEN 1.0 ELSE 0 END) AS frac_{n}" for k, n in enumerate(SHORT)) + " FROM states9 GROUP BY video",
    "pmoves": "SELECT video, f, t, count(*) AS n FROM (SELECT video, state AS f, lead(state) OVER (PARTITION BY video, track_id ORDER BY idx) AS t FROM states9) WHERE t IS NOT NULL GROUP BY ALL",
    "pprob": "SELECT v.video, a.f, b.t, coalesce(m.n / sum(m.n) OVER (PARTITION BY v.video, a.f), 0) AS p FROM (SELECT DISTINCT video FROM states9) v CROSS JOIN (VALUES (0), (1), (2)) a(f) CROSS JOIN (VALUES (0), (1), (2)) b(t) LEFT JOIN pmoves m ON m.video = v.video AND m.f = a.f AND m.t = b.t",
    "pstay": "SELECT video, " + ", ".join([f"max(p) FILTER (f = {k} AND t = {k}) AS stay_{n}" for k, n in enumerate(SHORT)] + [f"max(p) FILTER (f = {a} AND t = {b}) - max(p) FILTER (f = {b} AND t = {a}) AS asym_{SHORT[a]}_{SHORT[b]}" for a, b in ((0, 1), (1, 2), (0, 2))]) + " FROM pprob GROUP BY video",
    "pdwell": "SELECT video, " + ", ".join(f"CASE WHEN count(*) FILTER (state = {k}) >= 10 THEN {e} END AS {x}_{n}" for k, n in enumerate(SHORT) for x, e in (("dwell_mean", f"avg(run) FILTER (state = {k}) / 50"), ("dwell_cv", f"stddev_pop(run) FILTER (state = {k}) / avg(run) FILTER (state = {k})"))) + " FROM eps9 GROUP BY video",
}
PARTS = [f'"{m}_{n}"' for m in METRICS for n in ("mean", "sd")] + [f"frac_{n}" for n in SHORT] + [f"stay_{n}" for n in SHORT] + [f"asym_{SHORT[a]}_{SHORT[b]}" for a, b in ((0, 1), (1, 2), (0, 2))] + [f"{x}_{n}" for n in SHORT for x in ("dwell_mean", "dwell_cv")]
query("A27_participant_features", f"SELECT video, {L('n_tracks', 'n_frames')}, {r(*PARTS)} FROM casa JOIN pcomp USING (video) JOIN pstay USING (video) JOIN pdwell USING (video)", PART)(lambda s, d: features.participant_features(kinematics.track_metrics(tracks(s, d)), frame_states(s, d, 9)))
QS = [f'quantile_cont("{m}", {p}) AS "{m}_{n}"' for m in ("VCL", "ALH", "BCF", "LIN") for p, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))] + [f'quantile_cont("{m}", 0.75) - quantile_cont("{m}", 0.25) AS "{m}_iqr"' for m in ("VCL", "ALH", "BCF", "LIN", "PWR", "TAC")]
QS += ['quantile_cont("PWR", 0.9) AS "PWR_p90"', 'quantile_cont("TAC", 0.5) AS "TAC_med"', 'quantile_cont("VAR_V", 0.5) AS "VAR_V_med"', 'avg(CASE WHEN "VCL" > 50 THEN 1.0 ELSE 0 END) AS vigorous_frac', 'avg(CASE WHEN "VCL" BETWEEN 5 AND 25 THEN 1.0 ELSE 0 END) AS intermediate_frac', "ln(count(*)) AS log_ntracks", 'quantile_cont("DUR", 0.5) AS "DUR_med"']
QS += [f"100 * count(*) FILTER (motility = '{m}') / count(*) AS {n}_pct" for m, n in (("progressive", "prog"), ("non_progressive", "nonprog"), ("immotile", "immot"))]
query("A28_sample_features", f"SELECT video, {r(*QS)}, count(*) AS n_tracks FROM features GROUP BY video HAVING count(*) >= 3")(lambda s, d: features.sample_features(kinematics.track_features(tracks(s, d)), min_tracks=3))
PSP = {
    "prk": "SELECT *, rank() OVER (ORDER BY \"VCL\") + (count(*) OVER (PARTITION BY \"VCL\") - 1) / 2 AS a, rank() OVER (ORDER BY \"STR\") + (count(*) OVER (PARTITION BY \"STR\") - 1) / 2 AS b, rank() OVER (ORDER BY \"ALH\") + (count(*) OVER (PARTITION BY \"ALH\") - 1) / 2 AS c FROM kept",
    "pfit": "SELECT regr_slope(a, c) AS sa, regr_intercept(a, c) AS ia, regr_slope(b, c) AS sb, regr_intercept(b, c) AS ib FROM prk",
    "pleft": ranks("SELECT a - ia - sa * c AS x, b - ib - sb * c AS y FROM prk, pfit"),
}
query("M18_partial_spearman", f"SELECT {r('rho', r_p('rho', 'n') + ' AS p')}, n FROM (SELECT corr(rx, ry) AS rho, count(*) AS n FROM pleft)", PSP)(lambda s, d: features.partial_spearman(kept(s, d), "VCL", "STR", "ALH"))
query("M18_two_controls")(lambda s, d: features.partial_spearman(kept(s, d), "VCL", "STR", "ALH", "BCF"))
HALF = {
    "hr": "SELECT *, row_number() OVER (PARTITION BY video ORDER BY md5(video || '|' || track_id || '|0'), video, track_id) % 2 AS half FROM rates",
    "hg": "SELECT video, half, CASE WHEN sum(x) > 0 THEN sum((2 * k - n - 1) * x) / (n * sum(x)) ELSE 0 END AS g FROM (SELECT video, half, round(rate, 9) AS x, row_number() OVER (PARTITION BY video, half ORDER BY rate) AS k, count(*) OVER (PARTITION BY video, half) AS n FROM hr) GROUP BY video, half, n",
    "hs": "SELECT video, half, CASE WHEN avg(rate) > 0 THEN stddev_pop(rate) / avg(rate) END AS cv, avg(CASE WHEN switches = 0 THEN 1.0 ELSE 0 END) AS st, avg(rate) AS m FROM hr GROUP BY video, half",
    "hl": "SELECT video, half, feature, v FROM hs JOIN hg USING (video, half), LATERAL (VALUES ('cv_rate', cv), ('stayer_frac', st), ('gini_rate', g)) x(feature, v)",
    "hp": "SELECT video, feature, max(v) FILTER (half = 0) AS x, max(v) FILTER (half = 1) AS y FROM hl GROUP BY video, feature HAVING max(v) FILTER (half = 0) IS NOT NULL AND max(v) FILTER (half = 1) IS NOT NULL",
    "hk": ranks("SELECT * FROM hp", "feature"),
    "hm": ranks("SELECT max(m) FILTER (half = 0) AS x, max(m) FILTER (half = 1) AS y FROM hs GROUP BY video HAVING count(*) = 2"),
}
query("M19_split_half", f"SELECT {r('CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS rho')}, count(*) AS n FROM hm", HALF)(lambda s, d: serial.spearman(features.split_half(features.cell_rates(frame_states(s, d, 9)))))
query("M19_split_half_features", f"SELECT feature, {r('CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS rho')}, count(*) AS n FROM hk GROUP BY feature", HALF)(lambda s, d: serial.spearman(features.split_half_features(features.cell_rates(frame_states(s, d, 9))), ["feature"]))
query("M24_multiplicity", f"SELECT video, {r('p', 'holm', 'bh')} FROM (SELECT video, p, max(least(1, (m - k + 1) * p)) OVER (ORDER BY p, video) AS holm, min(least(1, m * p / k)) OVER (ORDER BY p DESC, video DESC) AS bh FROM (SELECT video, dfi / 100 + CAST(video AS INT) / 10000 AS p, row_number() OVER (ORDER BY dfi / 100 + CAST(video AS INT) / 10000) AS k, count(*) OVER () AS m FROM clinical))")(
    lambda s, d: features.benjamini_hochberg(features.holm(clinical(s, d).select("video", (F.col("dfi") / 100 + F.col("video").cast("int") / 10000).alias("p"))))
)
UNI = {"uv": f"SELECT feature, x, y FROM (SELECT video, dfi AS y, {', '.join(f'avg(\"{m}\") AS \"{m}\"' for m in METRICS)} FROM kept JOIN clinical USING (video) GROUP BY video, dfi), LATERAL (VALUES {', '.join(f'(\'{m}\', \"{m}\")' for m in METRICS)}) v(feature, x)", "ruv": ranks("SELECT * FROM uv", "feature")}
query("M27_univariate", f"SELECT feature, {r('corr(rx, ry) AS rho')}, count(*) AS n FROM ruv GROUP BY feature", UNI)(lambda s, d: features.univariate_spearman(kept(s, d).groupBy("video").agg(*[F.avg(m).alias(m) for m in METRICS]).join(clinical(s, d), "video"), METRICS, "dfi"))
WZ = "(n * (n + 1) / 4 - least(wp, wm)) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)"
WP = f"1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k: power(-1, k) * exp((2 * k + 1) * ln({WZ} / sqrt(2)) - lgamma(k + 1)) / (2 * k + 1))) AS p"
query("M28_wilcoxon", f"SELECT {r('wp AS w_plus', 'wm AS w_minus', WP)}, n FROM (SELECT sum(CASE WHEN dd > 0 THEN rx ELSE 0 END) AS wp, sum(CASE WHEN dd < 0 THEN rx ELSE 0 END) AS wm, count(*) AS n, (SELECT coalesce(sum(t * t * t - t), 0) FROM (SELECT count(*) AS t FROM wr GROUP BY round(x, 9))) AS ties FROM wr)", LONG | {"wd": "SELECT predicted - truth AS dd, abs(predicted - truth) AS x, 0 AS y FROM long WHERE category = 'progressive' AND abs(predicted - truth) > 1e-12", "wr": ranks("SELECT * FROM wd")})(lambda s, d: features.wilcoxon(compared(s, d).filter("category = 'progressive'"), "predicted", "truth"))
#: Trackers worse than the truth: name, every how many boxes one is missed, which tracks change their name, from which frame on.
VARIANTS = [("misses_10", 10, 4, 30), ("misses_5", 5, 4, 30), ("misses_3", 3, 4, 20), ("switches_2", 10, 2, 15), ("switches_3", 7, 3, 10)]


def variants(s: SparkSession, d: str) -> DataFrame:
    """Tracks as each variant sees them; the truth is a variant of its own."""
    t = tracks(s, d).withColumn("variant", F.lit("truth"))
    changed = lambda m, f: F.when((F.col("track_id") % m == 1) & (F.col("frame") >= f), F.col("track_id") + 1_000_000).otherwise(F.col("track_id"))
    return summary.union_all([t, *[t.filter((F.col("track_id") * 31 + F.col("frame")) % k != 0).withColumns({"track_id": changed(m, f), "variant": F.lit(name)}) for name, k, m, f in VARIANTS]])


def fidelity(s: SparkSession, d: str) -> DataFrame:
    told = files.stored(variants(s, d))
    within = lambda df: df.withColumn("video", F.concat_ws(":", "variant", "video"))
    seen = within(told.filter("variant <> 'truth'"))
    truth = told.filter("variant = 'truth'").drop("variant").crossJoin(F.broadcast(s.createDataFrame([(v[0],) for v in VARIANTS], "variant string")))
    quality = association.tracking_quality(within(truth).drop("variant"), seen.drop("variant")).groupBy(F.substring_index("video", ":", 1).alias("variant")).agg(F.avg("coverage").alias("coverage"), F.avg("id_switches").alias("id_switches"))
    key = ["variant", *K]
    at = files.stored(states.frame_states(told, 9, key=key))
    cv = episodes.episodes(at, key).groupBy("variant").agg((F.stddev_pop("run") / F.avg("run")).alias("dwell_cv"))
    gains = order.order_gains(order.order_test(at, (1, 2), key=key, by=["variant"]), ["variant"]).filter("order = 2").select("variant", F.col("gain").alias("g2"))
    return agreement.tracker_fidelity(quality, gains.join(cv, "variant"), "truth")


query("M29_correlation", f"SELECT {r('corr(\"VCL\", \"STR\") AS r')}, count(*) AS n FROM kept")(lambda s, d: agreement.correlation(kept(s, d), "VCL", "STR"))
query("M29_tracker_fidelity")(fidelity)
query("M29_dissociation")(lambda s, d: agreement.dissociation(fidelity(s, d), ["coverage", "id_switches"], ["g2_error", "cv_error"]))
query("M30_recalibration", f"SELECT {', '.join(K)}, {L('n_frames')}, duration_s, {r(*Q)}, 'new' AS calibration FROM metrics UNION ALL SELECT {', '.join(K)}, {L('n_frames')}, duration_s, {r(*Q)}, 'old' FROM metrics_old")(lambda s, d: agreement.recalibrated(tracks(s, d), [("new", 1.422, 50), ("old", 1.0, 30)]))
STATS = {"cm": "SELECT 'gt' AS cohort, count(*) AS n, avg(conf) AS conf FROM tracks UNION ALL SELECT 'auto', count(*), avg(conf) FROM pred_tracks"}
query("J14_cohort_comparison", f"SELECT metric, {r('a', 'b', 'a / b AS ratio', 'a - b AS difference')} FROM (SELECT 'n' AS metric, max(n) FILTER (cohort = 'auto')::DOUBLE AS a, max(n) FILTER (cohort = 'gt')::DOUBLE AS b FROM cm UNION ALL SELECT 'conf', max(conf) FILTER (cohort = 'auto'), max(conf) FILTER (cohort = 'gt') FROM cm)", STATS)(
    lambda s, d: agreement.compare_cohorts(summary.union_all([t(s, d).agg(F.count("*").cast("double").alias("n"), F.avg("conf").alias("conf")).select(F.lit(n).alias("cohort"), F.explode(F.create_map(F.lit("n"), F.col("n"), F.lit("conf"), F.col("conf"))).alias("metric", "value")) for n, t in (("gt", tracks), ("auto", pred))]), "auto", "gt")
)

# ---- signals
query("W26_sliding_vcl", f"SELECT {', '.join(K)}, {L('idx - 23 AS idx')}, {r('w AS wvcl')} FROM (SELECT *, avg(sqrt(vx * vx + vy * vy)) OVER t AS w, count(*) OVER t AS c FROM vel WINDOW t AS (PARTITION BY video, track_id ORDER BY idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE c = 24")(lambda s, d: signal.sliding_vcl(tracks(s, d)))
W27 = {"b25": "SELECT *, sqrt(power(cx - lag(cx) OVER t, 2) + power(cy - lag(cy) OVER t, 2)) AS step FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY video, track_id ORDER BY frame) - 1) / 25) AS BIGINT) AS block FROM tracks) WINDOW t AS (PARTITION BY video, track_id, block ORDER BY frame)"}
query("W27_block_kinematics", f"SELECT video, track_id, block, {r('sum(step) / 1.422 / 24 * 50 AS vcl', 'CASE WHEN sum(step) > 0 THEN sqrt(power(arg_max(cx, frame) - arg_min(cx, frame), 2) + power(arg_max(cy, frame) - arg_min(cy, frame), 2)) / sum(step) ELSE 0 END AS lin')} FROM b25 GROUP BY ALL HAVING count(*) = 25", W27)(lambda s, d: signal.block_kinematics(tracks(s, d)))
ACF = {"mid": "SELECT video, track_id, idx, vx - avg(vx) OVER (PARTITION BY video, track_id) AS x, vy - avg(vy) OVER (PARTITION BY video, track_id) AS y FROM vel", "z": "SELECT video, track_id, sum(x * x + y * y) AS z FROM mid GROUP BY ALL HAVING sum(x * x + y * y) > 0 AND count(*) >= 2", "prod": "SELECT a.video, a.track_id, b.idx - a.idx AS lag, sum(a.x * b.x + a.y * b.y) AS p FROM mid a JOIN mid b ON a.video = b.video AND a.track_id = b.track_id AND b.idx - a.idx BETWEEN 0 AND 20 GROUP BY ALL"}
query("W28_velocity_acf", f"SELECT {L('lag')}, {r('avg(p / z) AS acf')}, count(*) AS n_tracks FROM prod JOIN z USING (video, track_id) GROUP BY lag", ACF)(lambda s, d: signal.acf(signal.velocities(tracks(s, d)), ["vx", "vy"], 20))


def acf_sql(series: str, tag: str, columns: tuple[str, ...] = ("vx", "vy"), lags: int = 20) -> dict[str, str]:
    part = "PARTITION BY video, track_id"
    mid, own, lagged = ", ".join(f"{c} - avg({c}) OVER ({part}) AS {c}" for c in columns), " + ".join(f"{c} * {c}" for c in columns), " + ".join(f"a.{c} * b.{c}" for c in columns)
    return {
        f"{tag}mid": f"SELECT video, track_id, idx, {mid} FROM {series}",
        f"{tag}z": f"SELECT video, track_id, sum({own}) AS z FROM {tag}mid GROUP BY ALL HAVING sum({own}) > 1e-12 AND count(*) >= 2",
        f"{tag}prod": f"SELECT a.video, a.track_id, b.idx - a.idx AS lag, sum({lagged}) AS p FROM {tag}mid a JOIN {tag}mid b ON a.video = b.video AND a.track_id = b.track_id AND b.idx BETWEEN a.idx AND a.idx + {lags} GROUP BY ALL",
        f"{tag}acf": f"SELECT lag, avg(p / z) AS acf, count(*) AS n_tracks FROM {tag}prod JOIN {tag}z USING (video, track_id) GROUP BY lag",
    }


query("W28_acf_distance", f"SELECT {r('avg(abs(a.acf - b.acf)) AS mad')} FROM ggacf a JOIN paacf b ON a.lag = b.lag", {"pvel": CTES["vel"].replace("FROM tracks", "FROM pred_tracks")} | acf_sql("vel", "gg") | acf_sql("pvel", "pa"))(lambda s, d: signal.acf_distance(signal.acf(signal.velocities(tracks(s, d)), ["vx", "vy"], 20), signal.acf(signal.velocities(pred(s, d)), ["vx", "vy"], 20)))
CROSS = {"sp": "SELECT video, track_id, idx, sqrt(vx * vx + vy * vy) AS sp FROM vel", "cr": "SELECT *, CASE WHEN (sp >= 25) <> (lag(sp) OVER (PARTITION BY video, track_id ORDER BY idx) >= 25) THEN 1 ELSE 0 END AS c FROM sp", "gaps": "SELECT (idx - lag(idx) OVER (PARTITION BY video, track_id ORDER BY idx)) / 50 AS gap FROM cr WHERE c = 1"}
query("W29_crossings", f"SELECT {L('(SELECT sum(c) FROM cr) AS crossings')}, {r('(SELECT sum(c) / (count(*) / 50) FROM cr) AS rate', 'avg(gap) AS mean_gap', 'stddev_pop(gap) / avg(gap) AS cv_gap')} FROM gaps", CROSS)(lambda s, d: signal.crossings(signal.velocities(tracks(s, d)).withColumn("speed", scalar.distance(F.col("vx"), F.col("vy"))), "speed", 25.0))

def spectra_sql(columns: tuple[str, ...], source: str, pre: str, step: float, top: float, least: int) -> dict[str, str]:
    """Own-frequency spectra as a join of each track with sines, and the same on a grid."""
    centred = ", ".join(f"({c} - avg({c}) OVER t) * (0.5 - 0.5 * cos(2 * pi() * (row_number() OVER o - 1) / (count(*) OVER t - 1))) AS {c}" for c in columns)
    power = " + ".join(f"power(sum({c} * cos(2 * pi() * k * i / n)), 2) + power(sum({c} * sin(2 * pi() * k * i / n)), 2)" for c in columns)
    return {
        f"{pre}h": f"SELECT video, track_id, row_number() OVER o - 1 AS i, count(*) OVER t AS n, {centred} FROM {source} WINDOW t AS (PARTITION BY video, track_id), o AS (PARTITION BY video, track_id ORDER BY idx)",
        f"{pre}k": f"SELECT video, track_id, n, k, {power} AS p FROM (SELECT *, unnest(range(CAST(floor(n / 2) AS BIGINT) + 1)) AS k FROM {pre}h WHERE n >= {least}) GROUP BY video, track_id, n, k",
        f"{pre}s": f"SELECT video, track_id, n, k, k * 50 / n AS freq, p / greatest(sum(p) OVER (PARTITION BY video, track_id), 1e-12) AS power FROM {pre}k",
        f"{pre}g": f"SELECT g * {step} AS freq, avg(coalesce(a.power + (b.power - a.power) * (g * {step} * a.n / 50 - a.k), a.power)) AS power, count(*) AS n_tracks FROM {pre}s a LEFT JOIN {pre}s b ON a.video = b.video AND a.track_id = b.track_id AND b.k = a.k + 1, (SELECT unnest(range(1, {int(round(top / step)) + 1})) AS g) WHERE a.k = least(floor(g * {step} * a.n / 50 + 1e-9), floor(a.n / 2)) GROUP BY g",
    }


def peaks_sql(pre: str, low: float, high: float) -> str:
    return f"SELECT {r(*[f'quantile_cont(freq, {p}) AS {n}' for p, n in ((0.5, 'median'), (0.25, 'q25'), (0.75, 'q75'))])}, count(*) AS n_tracks FROM (SELECT freq FROM {pre}s WHERE freq BETWEEN {low} AND {high} QUALIFY row_number() OVER (PARTITION BY video, track_id ORDER BY round(power, 12) DESC, freq) = 1)"


SPEC = spectra_sql(("vx", "vy"), "vel", "sp", 0.25, 25.0, 31)
WV = {"wv": "SELECT video, track_id, idx - 23 AS idx, w AS wvcl FROM (SELECT *, avg(sqrt(vx * vx + vy * vy)) OVER t AS w, count(*) OVER t AS c FROM vel WINDOW t AS (PARTITION BY video, track_id ORDER BY idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE c = 24"}
WSPEC = WV | spectra_sql(("wvcl",), "wv", "ws", 0.05, 10.0, 32)


def wvcl_spectra(s: SparkSession, d: str) -> DataFrame:
    return signal.track_spectra(signal.sliding_vcl(tracks(s, d)), ["wvcl"], min_points=32)


query("W30_track_spectra", f"SELECT video, track_id, {L('k AS bin')}, {r('freq', 'power')} FROM sps", SPEC)(lambda s, d: signal.track_spectra(signal.velocities(tracks(s, d)), ["vx", "vy"], min_points=31))
query("W30_wvcl_spectrum", f"SELECT {r('freq', 'power')}, n_tracks FROM wsg", WSPEC)(lambda s, d: signal.mean_spectrum(signal.on_grid(wvcl_spectra(s, d), 0.05, 10.0)))
query("W30_wvcl_peaks", peaks_sql("ws", 0.1, 2.0), WSPEC)(lambda s, d: signal.track_peaks(wvcl_spectra(s, d), search=(0.1, 2.0)))
query("W28_wvcl_acf", f"SELECT {L('lag')}, {r('acf')}, n_tracks FROM wvacf", WV | acf_sql("wv", "wv", ("wvcl",), 100))(lambda s, d: signal.acf(signal.sliding_vcl(tracks(s, d)), ["wvcl"], 100))
query("W30_periodogram", f"SELECT {r('freq', 'power')}, n_tracks FROM spg", SPEC)(lambda s, d: signal.mean_spectrum(signal.periodogram(tracks(s, d), min_points=32)))
query("W30_band_power", f"SELECT {r('sum(CASE WHEN freq BETWEEN 5 AND 20 THEN power ELSE 0 END) / sum(power) AS band_share', 'arg_max(freq, power) FILTER (freq BETWEEN 2 AND 24) AS peak_freq')} FROM spg", SPEC)(lambda s, d: signal.band_power(signal.mean_spectrum(signal.periodogram(tracks(s, d), min_points=32))))
query("W30_track_peaks", peaks_sql("sp", 2.0, 24.0), SPEC)(lambda s, d: signal.track_peaks(signal.track_spectra(signal.velocities(tracks(s, d)), ["vx", "vy"], min_points=31)))
W31 = {"pq": "SELECT video, track_id, vx * lead(vx) OVER t + vy * lead(vy) OVER t AS p, vx * vx + vy * vy AS q FROM vel WINDOW t AS (PARTITION BY video, track_id ORDER BY idx)", "aa": "SELECT sum(p) / sum(q) AS a FROM pq GROUP BY video, track_id HAVING count(*) >= 49 AND sum(q) > 0", "am": "SELECT quantile_cont(a, 0.5) AS a, count(*) AS n FROM aa"}
query("W31_relaxation", f"SELECT {r('a', 'CASE WHEN a > 0 AND a < 1 THEN -1 / ln(a) / 50 END AS tau_s')}, n AS n_tracks FROM am", W31)(lambda s, d: signal.lag_one(tracks(s, d)))
AR = {"cv": "SELECT *, vx - avg(vx) OVER (PARTITION BY video, track_id) AS x, vy - avg(vy) OVER (PARTITION BY video, track_id) AS y, avg(vx) OVER (PARTITION BY video, track_id) AS mx, avg(vy) OVER (PARTITION BY video, track_id) AS my FROM vel", "lg": "SELECT *, x * x + y * y AS c0, x * lead(x) OVER t + y * lead(y) OVER t AS c1, x * lead(x, 2) OVER t + y * lead(y, 2) OVER t AS c2 FROM cv WINDOW t AS (PARTITION BY video, track_id ORDER BY idx)", "ar": "SELECT video, track_id, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, var_pop(vx) AS var_x, var_pop(vy) AS var_y, sum(c1) / sum(c0) AS r1, sum(c2) / sum(c0) AS r2 FROM lg GROUP BY ALL HAVING count(*) >= 9"}
query("W32_ou_fit", f"SELECT {', '.join(K)}, n, {r('mx', 'my', 'var_x', 'var_y', 'greatest(-0.995, least(0.995, coalesce(r1, 0))) AS phi')} FROM ar", AR)(lambda s, d: signal.fit_ou(tracks(s, d)))
POOL = {"pm": "SELECT avg(vx) AS mx, avg(vy) AS my, var_pop(vx) AS var_x, var_pop(vy) AS var_y, count(*) AS n FROM vel", "pc": "SELECT video, track_id, idx, vx - mx AS x, vy - my AS y FROM vel, pm", "pr": "SELECT sum(c1) / sum(c0) AS r1 FROM (SELECT x * x + y * y AS c0, x * lead(x) OVER t + y * lead(y) OVER t AS c1 FROM pc WINDOW t AS (PARTITION BY video, track_id ORDER BY idx))"}
query("W32_ou_pooled", f"SELECT n, {r('mx', 'my', 'var_x', 'var_y', 'greatest(-0.995, least(0.995, coalesce(r1, 0))) AS phi')} FROM pm, pr", POOL)(lambda s, d: signal.fit_ou(tracks(s, d), pooled=True))
PHI1, PHI2 = "r1 * (1 - r2) / (1 - r1 * r1)", "(r2 - r1 * r1) / (1 - r1 * r1)"
OK = f"1 - r1 * r1 >= 1e-9 AND abs({PHI2}) < 0.999 AND {PHI1} + {PHI2} < 0.999 AND {PHI2} - {PHI1} < 0.999"
query("W33_ar2_fit", f"SELECT {', '.join(K)}, n, {r('var_x', 'var_y', f'CASE WHEN {OK} THEN {PHI1} ELSE greatest(-0.995, least(0.995, r1)) END AS phi1', f'CASE WHEN {OK} THEN {PHI2} ELSE 0 END AS phi2')} FROM (SELECT * EXCLUDE (r1, r2), coalesce(r1, 0) AS r1, coalesce(r2, 0) AS r2 FROM ar)", AR)(lambda s, d: signal.fit_ar2(tracks(s, d)))

# ---- reports
HEAT = {"pts": 'SELECT t.*, k."VCL" AS v, max(cx) OVER () AS mx, max(cy) OVER () AS my FROM tracks t JOIN kept k USING (video, track_id)'}
CELLS = "CAST(greatest(0, least(19, floor(cx / (mx + 1) * 20))) AS BIGINT) AS gx, CAST(greatest(0, least(19, floor(cy / (my + 1) * 20))) AS BIGINT) AS gy"
query("A32_heat_map", f"SELECT g.gx, h.gy, {r('coalesce(m, 0) AS mean')} FROM (SELECT unnest(range(20)) AS gx) g CROSS JOIN (SELECT unnest(range(20)) AS gy) h LEFT JOIN (SELECT {CELLS}, avg(v) AS m FROM pts GROUP BY 1, 2) x ON x.gx = g.gx AND x.gy = h.gy", HEAT)(lambda s, d: report.heat_map(tracks(s, d).join(kept(s, d).select(*K, "VCL"), K), "VCL"))
query("A33_histogram", "SELECT CAST(least(29, floor((\"VCL\" - lo) / (hi - lo) * 30)) AS BIGINT) AS bin, count(*) AS n FROM kept, (SELECT min(\"VCL\") AS lo, max(\"VCL\") AS hi FROM kept) GROUP BY 1")(lambda s, d: report.histogram(kept(s, d), "VCL"))
query("A34_box_stats", f"SELECT motility, {r('q1', 'med AS median', 'q3', 'min(\"VCL\") FILTER (\"VCL\" BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low', 'max(\"VCL\") FILTER (\"VCL\" BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high')}, count(*) AS n FROM kept JOIN (SELECT motility, quantile_cont(\"VCL\", 0.25) AS q1, quantile_cont(\"VCL\", 0.5) AS med, quantile_cont(\"VCL\", 0.75) AS q3 FROM kept GROUP BY motility) USING (motility) GROUP BY motility, q1, med, q3")(lambda s, d: report.box_stats(kept(s, d), "VCL", "motility"))
query("A35_cross_tab", f"SELECT video, motility, n, {r('share')}, max(share) OVER (PARTITION BY video) > 0.5 AS dominated FROM (SELECT video, motility, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY video) AS share FROM kept GROUP BY video, motility)")(lambda s, d: report.cross_tab(kept(s, d), "video", "motility"))
CHI = {"xt": "SELECT video, motility, count(*) AS n FROM kept GROUP BY ALL"}
query("A35_chi_square", f"SELECT {r('chi2', 'list_sum(list_transform(range(0, CAST(dof / 2 AS BIGINT)), lambda i: exp(i * ln(chi2 / 2) - chi2 / 2 - lgamma(i + 1)))) AS p')}, {L('dof')} FROM (SELECT sum(n) * (sum(n * n / (rr * kk)) - 1) AS chi2, (count(DISTINCT video) - 1) * (count(DISTINCT motility) - 1) AS dof FROM (SELECT *, sum(n) OVER (PARTITION BY video) AS rr, sum(n) OVER (PARTITION BY motility) AS kk FROM xt))", CHI)(lambda s, d: report.chi_square(kept(s, d), "video", "motility"))
AGR = {"emb": "SELECT label AS a, CAST(vec_id % 7 AS BIGINT) AS b, count(*) AS n FROM embeddings GROUP BY ALL", "ta": "SELECT sum(n) AS t FROM emb", "ea": "SELECT sum(x * (x - 1) / 2) AS p, -sum(x / t * ln(x / t)) AS h FROM (SELECT sum(n) AS x FROM emb GROUP BY a), ta", "eb": "SELECT sum(x * (x - 1) / 2) AS p, -sum(x / t * ln(x / t)) AS h FROM (SELECT sum(n) AS x FROM emb GROUP BY b), ta", "eab": "SELECT sum(n * (n - 1) / 2) AS p, -sum(n / t * ln(n / t)) AS h FROM emb, ta"}
query("A36_partition_agreement", f"SELECT {r('(ea.h + eb.h - eab.h) / ((ea.h + eb.h) / 2) AS nmi', '(eab.p - ea.p * eb.p / (t * (t - 1) / 2)) / ((ea.p + eb.p) / 2 - ea.p * eb.p / (t * (t - 1) / 2)) AS ari')} FROM ea, eb, eab, ta", AGR)(lambda s, d: report.partition_agreement(fixtures.table(s, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("b")), "label", "b"))
CONTEXT = {
    "vtop": "SELECT video, '[' || string_agg('{\"track_id\":' || track_id || ',\"VCL\":' || \"VCL\" || '}', ',' ORDER BY rank) || ']' AS fastest FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY \"VCL\" DESC, track_id) AS rank FROM kept WHERE motility = 'progressive') WHERE rank <= 5 GROUP BY video",
    "vmat": "SELECT video, '[' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY f, t) || ']' AS transitions FROM (SELECT v.video, a.f, b.t, count(m.f) AS n FROM (SELECT DISTINCT video FROM states) v, (VALUES (0), (1), (2)) a(f), (VALUES (0), (1), (2)) b(t) LEFT JOIN moves m ON m.video = v.video AND m.f = a.f AND m.t = b.t GROUP BY ALL) GROUP BY video",
}
query("M32_video_context", "SELECT video, 'total_tracks: ' || CAST(total_tracks AS BIGINT) || ', progressive: ' || CAST(progressive AS BIGINT) || ', non_progressive: ' || CAST(non_progressive AS BIGINT) || ', immotile: ' || CAST(immotile AS BIGINT) AS line, fastest, transitions, progressive_pct + non_progressive_pct >= 42 AS meets_total, progressive_pct >= 30 AS meets_progressive FROM summary LEFT JOIN vtop USING (video) LEFT JOIN vmat USING (video)", CONTEXT)(lambda s, d: report.video_context(summaries(s, d), summary.fastest(kept(s, d)), episodes.transition_counts(frame_states(s, d), ["video"]), summary.compliance(summaries(s, d))))
query("T05_display_rows", f"SELECT {', '.join(K)}, {r('\"VCL\"')} FROM kept ORDER BY video, track_id LIMIT 200")(lambda s, d: report.display_rows(kept(s, d), *K).select(*K, "VCL"))
RUN_SQL = "SELECT 'gt' AS experiment, video, CASE WHEN max(n_kept) > 0 THEN 'ok' ELSE 'no_tracks' END AS status FROM (SELECT DISTINCT video FROM tracks) LEFT JOIN (SELECT video, count(*) AS n_kept FROM kept GROUP BY video) USING (video) GROUP BY video UNION ALL SELECT 'auto', video, CASE WHEN CAST(video AS INT) % 3 = 0 THEN 'skip' WHEN CAST(video AS INT) % 3 = 1 THEN 'error' ELSE 'ok' END FROM (SELECT DISTINCT video FROM pred_tracks)"
query("A42_status_table", f"SELECT experiment, {', '.join(f'count(*) FILTER (status = \'{x}\') AS {x}' for x in ('ok', 'skip', 'error', 'no_tracks'))} FROM runs GROUP BY experiment", {"runs": RUN_SQL})(
    lambda s, d: report.status_table(tracks(s, d).select("video").distinct().join(kept(s, d).groupBy("video").agg(F.count("*").alias("n")), "video", "left").select(F.lit("gt").alias("experiment"), "video", F.when(F.col("n") > 0, "ok").otherwise("no_tracks").alias("status")).union(pred(s, d).select("video").distinct().select(F.lit("auto"), "video", F.when(F.expr("cast(video as int) % 3 = 0"), "skip").when(F.expr("cast(video as int) % 3 = 1"), "error").otherwise("ok"))))
)
query("M17_memory_shares", f"SELECT {L('a.o AS \"order\"')}, {r('CASE WHEN a.ll - b.ll <> 0 THEN (a.ll - b.ll - (a.ll - c.ll)) / (a.ll - b.ll) END AS share')} FROM ll a JOIN ll b ON b.o = 0 JOIN ll c ON c.o = a.o - 1 WHERE a.o >= 1", CTX)(
    lambda s, d: (lambda t: t.alias("a").join(t.alias("b"), F.expr("b.order = 0")).join(t.alias("c"), F.expr("c.order = a.order - 1")).filter("a.order >= 1").select(F.col("a.order").alias("order"), order.memory_share(F.expr("a.ll_per_token - b.ll_per_token"), F.expr("a.ll_per_token - c.ll_per_token"), F.lit(0.0)).alias("share")))(order.order_test(frame_states(s, d)))
)

# ---- sources over derived tables
query("S05_annotation_tracks", f"SELECT video, CAST(dense_rank() OVER (PARTITION BY video ORDER BY f0, k0) AS BIGINT) AS track_id, {L('frame')}, {r('nx * 640 AS cx', 'ny * 480 AS cy')} FROM (SELECT *, first(frame) OVER (PARTITION BY video, fid ORDER BY frame, pos) AS f0, first(pos) OVER (PARTITION BY video, fid ORDER BY frame, pos) AS k0 FROM (SELECT video, frame, 'c' || track_id AS fid, row_number() OVER (PARTITION BY video, frame ORDER BY track_id) - 1 AS pos, round(cx / 640, 9) AS nx, round(cy / 480, 9) AS ny FROM tracks))")(
    lambda s, d: files.parse_annotations(tracks(s, d).select("video", "frame", (F.row_number().over(report.Window.partitionBy("video", "frame").orderBy("track_id")) - 1).alias("pos"), F.format_string("c%d 0 %.9f %.9f 0.025000 0.033333", "track_id", F.round(F.col("cx") / 640, 9), F.round(F.col("cy") / 480, 9)).alias("line"))).select(*K, "frame", "cx", "cy")
)
query("S08_nested_detections", f"SELECT video, {L('frame', 'cls')}, {r('x1', 'y1', 'x2', 'y2', 'conf')} FROM detections")(lambda s, d: files.explode_detections(files.nest_detections(fixtures.detections(s, d))).select("video", "frame", "cls", "x1", "y1", "x2", "y2", "conf"))
query("S04_source_preference", "SELECT video, source, count(*) AS n FROM (SELECT video, 'plain' AS source FROM tracks WHERE CAST(video AS INT) % 3 = 0 UNION ALL SELECT video, 'extra' FROM pred_tracks WHERE CAST(video AS INT) % 3 <> 0) GROUP BY ALL")(lambda s, d: files.prefer_source([("plain", tracks(s, d).filter("cast(video as int) % 3 = 0")), ("extra", pred(s, d))]).groupBy("video", "source").agg(F.count("*").alias("n")))
query("S10_decimal_commas", f"SELECT video, {r('dfi')} FROM clinical")(lambda s, d: clinical(s, d).select("video", files.decimal_comma(F.concat(F.lit(" "), F.regexp_replace(F.col("dfi").cast("string"), r"\.", ","))).alias("dfi")))
query("S12_preferred_percentages", f"SELECT video, {r(*[f'adjusted_{c}_pct AS {c}_pct' for c in scalar.CLASSES])} FROM summary")(lambda s, d: files.preferred_percentages(summaries(s, d)))
query("S16_pending_work", "SELECT DISTINCT video, e AS experiment FROM tracks, (VALUES ('a'), ('b')) x(e) WHERE NOT (e = 'a' AND CAST(video AS INT) % 2 = 0)")(lambda s, d: files.pending(tracks(s, d).select("video").distinct().withColumn("experiment", F.explode(F.array(F.lit("a"), F.lit("b")))), tracks(s, d).select("video", F.lit("a").alias("experiment")).distinct().filter("cast(video as int) % 2 = 0")))
LAB = ", ".join(f"floor(greatest(0, least(1, {e})) * 1e6 + 0.500001) / 1e6" for e in ("(x1 + x2) / 2 / 640", "(y1 + y2) / 2 / 480", "(x2 - x1) / 640", "(y2 - y1) / 480"))
query("S17_label_lines", f"SELECT video, {L('frame')}, string_agg(line, chr(10) ORDER BY line) AS labels FROM (SELECT video, frame, printf('%d %.6f %.6f %.6f %.6f', 0, {LAB}) AS line FROM detections) GROUP BY video, frame")(lambda s, d: files.label_lines(fixtures.detections(s, d), 640, 480))


def written(s: SparkSession, d: str) -> DataFrame:
    """Tracks written by video as Parquet, JSON and CSV, and read back."""
    t, root = tracks(s, d), files.scratch(s)
    out = []
    for form in ("parquet", "json", "csv"):
        files.write_table(t, f"{root}/{form}", form, ["video"])
        back = s.read.schema(t.schema).option("header", True).format(form).load(f"{root}/{form}")
        out.append(back.select(F.lit(form).alias("form"), F.col("video").cast("string").alias("video"), "track_id", "frame", "cx"))
    return summary.union_all(out)


query("S15_written_tables", f"SELECT form, video, count(*) AS n, {L('sum(track_id) AS ids', 'sum(frame) AS frames')}, {r('avg(cx) AS cx')} FROM tracks, (VALUES ('parquet'), ('json'), ('csv')) f(form) GROUP BY form, video")(lambda s, d: written(s, d).groupBy("form", "video").agg(F.count("*").alias("n"), F.sum("track_id").alias("ids"), F.sum("frame").alias("frames"), F.avg("cx").alias("cx")))
def track_folder(s: SparkSession, d: str) -> str:
    """A folder of track files: plain ones, and a second tracker's."""
    root = files.scratch(s)
    both = summary.union_all([tracks(s, d).withColumn("tracker", F.lit("plain")), pred(s, d).withColumn("tracker", F.lit("bytetrack"))])
    files.write_tracks(both, root)
    return root


def motility_folder(s: SparkSession, d: str) -> str:
    root = files.scratch(s)
    files.write_motility(kept(s, d), root)
    return root


FILED = {"filed": "SELECT *, 'plain' AS tracker FROM tracks UNION ALL SELECT *, 'bytetrack' FROM pred_tracks"}
query("S01_track_files", f"SELECT video, tracker, track_id, {L('frame')}, {r('cx', 'cy', 'conf')} FROM filed", FILED)(lambda s, d: files.read_tracks(s, track_folder(s, d)).select("video", "tracker", "track_id", "frame", "cx", "cy", "conf"))
query("S02_file_names", "SELECT DISTINCT video, tracker, video || CASE tracker WHEN 'plain' THEN '' ELSE '_' || tracker END || '_tracks.csv' AS file FROM filed", FILED)(
    lambda s, d: s.read.text(track_folder(s, d)).select(F.col("_metadata.file_name").alias("file")).distinct().select(*[c.alias(n) for c, n in zip(files.name_parts(F.col("file")), ("video", "tracker"), strict=True)], "file")
)
query("S03_plain_files", "SELECT video, count(*) AS n, count(DISTINCT track_id) AS n_tracks FROM tracks GROUP BY video")(lambda s, d: files.read_tracks(s, track_folder(s, d), plain_only=True).groupBy("video").agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("n_tracks")))
query("S14_motility_files", f"SELECT video, track_id, {L('n_frames')}, duration_s, {r(*Q)}, motility FROM kept")(lambda s, d: files.read_motility(s, motility_folder(s, d)).select("video", "track_id", "n_frames", "duration_s", *METRICS, "motility"))
query("S06_json_annotations", f"SELECT video, {L('frame')}, {r('x1 AS x', 'y1 AS y', 'x2 - x1 AS w', 'y2 - y1 AS h')} FROM detections")(
    lambda s, d: files.parse_json_annotations(
        fixtures.detections(s, d).groupBy("video", "frame", F.col("cls").alias("k")).agg(F.collect_list(F.struct("frame", F.col("x1").alias("x"), F.col("y1").alias("bbox_y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("bbox_h"))).alias("b"))
        .select("video", F.when(F.col("k") == 0, F.to_json("b")).otherwise(F.to_json(F.struct(F.array(F.struct(F.col("frame").alias("frame_id"), F.col("b").alias("objects"))).alias("frames")))).alias("value"))
    )
)
query("S07_aliased_columns", f"SELECT {r('CAST(frame AS DOUBLE) AS frame', 'x1 AS x', 'y1 AS y', 'x2 - x1 AS w', '0.0 AS h')} FROM detections")(lambda s, d: files.by_alias(fixtures.detections(s, d).select(F.col("frame").alias("frame_idx"), F.col("x1").alias("LEFT"), F.col("y1").alias(" top"), (F.col("x2") - F.col("x1")).alias("bbox_w"))))
query("S09_trimmed_headers", f"SELECT video, {r('dfi AS share')} FROM clinical")(lambda s, d: files.trimmed(clinical(s, d).select(F.col("video").alias(" video "), F.col("dfi").alias("dfi ")), {"dfi": "share"}, "video"))
query("S11_picked_column", f"SELECT video, {r('gt_immotile AS value')} FROM clinical")(lambda s, d: clinical(s, d).select("video", F.col(files.pick_column(clinical(s, d), "IMMOT")).alias("value")))
query("S13_experiments", "SELECT DISTINCT CASE WHEN CAST(video AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS experiment FROM summary")(lambda s, d: files.experiments(summaries(s, d).withColumn("experiment", F.when(F.expr("cast(video as int) % 2 = 0"), "even").otherwise("odd"))))
WANTED = [("experiment", "a"), ("experiment", "zz"), ("video", "1"), ("video", "2"), ("video", "99")]
NAMED = lambda s: s.createDataFrame([("a",), ("b",)], "experiment string")
query("J12_work_list", "SELECT 'a' AS experiment, video FROM (SELECT DISTINCT video FROM tracks) WHERE video IN ('1', '2')")(lambda s, d: files.work_list(NAMED(s), tracks(s, d), s.createDataFrame(WANTED, "kind string, name string"))[0])
query("J12_unknown_names", "SELECT * FROM (VALUES ('experiment', 'zz'), ('video', '99')) x(kind, name) WHERE name NOT IN (SELECT DISTINCT video FROM tracks)")(lambda s, d: files.work_list(NAMED(s), tracks(s, d), s.createDataFrame(WANTED, "kind string, name string"))[1])
query("S18_validation", "SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT video, track_id FROM tracks)) AS n_tracks, count(DISTINCT frame) AS n_frames FROM tracks")(lambda s, d: files.validated(tracks(s, d)))
query("S19_label_census", f"SELECT split, {L('cls')}, n, {r('n / sum(n) OVER (PARTITION BY split) AS share')} FROM (SELECT CASE video WHEN '1' THEN 'val' WHEN '2' THEN 'test' ELSE 'train' END AS split, cls, count(*) AS n FROM detections GROUP BY 1, 2)")(lambda s, d: files.label_census(fixtures.detections(s, d), {"1": "val", "2": "test"}))
query("S20_frame_split", f"SELECT video, {L('frame')}, CASE WHEN row_number() OVER (PARTITION BY video ORDER BY md5(video || '|' || frame || '|0'), frame) <= greatest(1, floor(count(*) OVER (PARTITION BY video) * 0.2)) THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT video, frame FROM tracks)")(lambda s, d: files.frame_split(tracks(s, d)))

query("M31_cohort_battery")(lambda s, d: battery.two_cohort_battery({"gt": tracks(s, d), "auto": pred(s, d)}, 9, blocks=(9, 13)))
query("E01_batch_agreement", f"SELECT category, {AGREE_P}, n FROM (SELECT category, {AGREE_RAW}, count(*) AS n FROM long GROUP BY category)", LONG)(lambda s, d: battery.batch_agreement(tracks(s, d), fixtures.detections(s, d), clinical(s, d)))


# ---- models
def by_video(s: SparkSession, d: str) -> DataFrame:
    return kept(s, d).groupBy("video").agg(*[F.avg(m).alias(m) for m in METRICS]).join(clinical(s, d).select("video", "dfi"), "video")


FEATURES = ["VCL", "LIN", "ALH"]
query("M07_modal_order_test", f"SELECT {L('o AS \"order\"', 'n AS n_tokens')}, {r('ll AS ll_per_token')} FROM ll", CTX | {"mblocks": MODAL9, "tok": CTX["tok"].replace("FROM states", "FROM mblocks").replace("ORDER BY idx", "ORDER BY block")})(lambda s, d: order.order_test(states.modal_blocks(frame_states(s, d), 9), index="block"))
query("M08_hidden_markov")(lambda s, d: models.hidden_markov(states.block_states(tracks(s, d), 9), index="block"))
query("M08_markov_and_hmm")(lambda s, d: models.markov_and_hmm(states.block_states(tracks(s, d), 9), index="block"))
TAILS = {
    "tmoves": "SELECT video, track_id, state, lead(state) OVER (PARTITION BY video, track_id ORDER BY idx) AS nxt FROM states9",
    "teach": "SELECT video, track_id, state, t.k AS nxt, count(*) AS c FROM tmoves, LATERAL (SELECT unnest([nxt, -1]) AS k) t WHERE nxt IS NOT NULL GROUP BY video, track_id, state, t.k",
}
query("M09_tail_counts", f"SELECT {L('state', 'nxt AS \"to\"', 'j', 'count(*) AS tracks')} FROM (SELECT *, unnest(range(c)) AS j FROM teach) GROUP BY state, nxt, j", TAILS)(lambda s, d: models.tail_counts(frame_states(s, d, 9)))
query("M09_concentration")(lambda s, d: models.concentration(frame_states(s, d, 9)))
query("M20_ridge_loo")(lambda s, d: models.ridge_loo(by_video(s, d), FEATURES, "dfi"))
query("M20_ridge_kfold")(lambda s, d: models.ridge_kfold(kept(s, d), ["LIN", "ALH", "BCF"], "VCL", order.fold_of()))
query("M20_nested_loo")(lambda s, d: models.prediction_errors(models.nested_loo(by_video(s, d), ["VCL", "LIN"], ["ALH", "BCF"], "dfi")))
query("M21_mean_predictor", f"SELECT {r('avg(abs(dfi - (t - dfi) / (n - 1))) AS mae')}, any_value(n) AS n FROM (SELECT dfi, sum(dfi) OVER () AS t, count(*) OVER () AS n FROM clinical)")(
    lambda s, d: clinical(s, d).crossJoin(clinical(s, d).agg(F.sum("dfi").alias("t"), F.count("*").alias("n"))).agg(F.avg(F.abs(F.col("dfi") - (F.col("t") - F.col("dfi")) / (F.col("n") - 1))).alias("mae"), F.first("n").alias("n"))
)
BYV = {
    "bv": "SELECT v.*, dfi FROM (SELECT video, avg(\"VCL\") AS \"VCL\", avg(\"LIN\") AS \"LIN\", avg(\"ALH\") AS \"ALH\" FROM kept GROUP BY video) v JOIN clinical USING (video)",
    "bz": "SELECT video, (\"VCL\" - avg(\"VCL\") OVER ()) / stddev_pop(\"VCL\") OVER () AS x0, (\"LIN\" - avg(\"LIN\") OVER ()) / stddev_pop(\"LIN\") OVER () AS x1, (\"ALH\" - avg(\"ALH\") OVER ()) / stddev_pop(\"ALH\") OVER () AS x2, dfi - avg(dfi) OVER () AS y, row_number() OVER (ORDER BY video) - 1 AS i, count(*) OVER () AS n FROM bv",
    "bg": "SELECT sum(x0 * x0) + 1 AS m00, sum(x0 * x1) AS m01, sum(x0 * x2) AS m02, sum(x1 * x1) + 1 AS m11, sum(x1 * x2) AS m12, sum(x2 * x2) + 1 AS m22, sum(y * y) AS yy FROM bz",
}


def md5_number(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5({' || \'|\' || '.join(parts)}), 1, 8)) AS BIGINT)"


#: The explained share v' (X'X + I)^-1 v / y'y of three features, by cofactors.
SHARE = (
    "((m11 * m22 - m12 * m12) * h0 * h0 + (m00 * m22 - m02 * m02) * h1 * h1 + (m00 * m11 - m01 * m01) * h2 * h2 + 2 * ((m02 * m12 - m01 * m22) * h0 * h1 + (m01 * m12 - m02 * m11) * h0 * h2 + (m01 * m02 - m00 * m12) * h1 * h2))"
    " / (m00 * (m11 * m22 - m12 * m12) + m01 * (m02 * m12 - m01 * m22) + m02 * (m01 * m12 - m02 * m11)) / yy"
)
_other = f"(({md5_number('rep', '0', 'k')} % n - a + n) % n)"
PERMS = BYV | {
    "bp": f"SELECT rep, x0, x1, x2, list_reduce(list_prepend(i, range(1, 25)), lambda a, k: CASE WHEN {md5_number('rep', '0', 'k', f'greatest(a, {_other})')} % 2 = 1 THEN {_other} ELSE a END) AS j FROM bz, (SELECT unnest(range(1, 201)) AS rep)",
    "bh": "SELECT rep, sum(p.x0 * z.y) AS h0, sum(p.x1 * z.y) AS h1, sum(p.x2 * z.y) AS h2 FROM bp p JOIN bz z ON z.i = p.j GROUP BY rep",
    "bn": f"SELECT {SHARE} AS v FROM bh, bg",
    "bs": f"SELECT {SHARE} AS seen FROM (SELECT sum(x0 * y) AS h0, sum(x1 * y) AS h1, sum(x2 * y) AS h2 FROM bz), bg",
}
query("M22_permutation_test", f"SELECT {r('any_value(seen) AS r2', 'avg(v) AS null_mean', '(1 + count(*) FILTER (v >= seen - 1e-12)) / (1 + count(*)) AS p')}, count(*) AS reps FROM bn, bs", PERMS)(lambda s, d: models.permutation_test(by_video(s, d), FEATURES, "dfi", "video"))
_cdf = "(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda j: exp((2 * j + 1) * ln(abs({x}) + 1e-300) - lgamma(2 * j + 2) + j * ln(2) + lgamma(j + 1)))))"


def normal_quantile_sql(p: str) -> str:
    """Bisection between -9 and 9, 80 steps."""
    mid = "((a.lo + a.hi) / 2)"
    step = f"CASE WHEN {_cdf.format(x=mid)} < {p} THEN {{lo: {mid}, hi: a.hi}} ELSE {{lo: a.lo, hi: {mid}}} END"
    return f"list_transform([list_reduce(list_transform(range(0, 81), lambda k: {{lo: CAST(-9 AS DOUBLE), hi: CAST(9 AS DOUBLE)}}), lambda a, x: {step})], lambda u: (u.lo + u.hi) / 2)[1]"


def _bca_end(q: float) -> str:
    z = f"(z0 + {models.normal_quantile(q)!r})"
    place = f"({_cdf.format(x=f'(z0 + {z} / (1 - accel * {z}))')} * (reps - 1))"
    return f"means[CAST(floor({place}) AS BIGINT) + 1] + ({place} - floor({place})) * (means[least(CAST(floor({place}) AS BIGINT) + 2, reps)] - means[CAST(floor({place}) AS BIGINT) + 1])"


BOOT = BYV | {
    "br": "SELECT row_number() OVER (ORDER BY video) - 1 AS i, \"VCL\" AS v, count(*) OVER () AS n FROM bv",
    "bm": f"SELECT rep, avg(v) AS m FROM (SELECT rep, {md5_number('rep', 'i', '0')} % n AS j FROM br, (SELECT unnest(range(1, 501)) AS rep)) d JOIN br ON br.i = d.j GROUP BY rep",
    "bj": "SELECT any_value(m) AS mean, sum(power(m - l, 3)) / (6 * power(sum(power(m - l, 2)), 1.5)) AS accel FROM (SELECT avg(v) OVER () AS m, (sum(v) OVER () - v) / (n - 1) AS l FROM br)",
    "bq": "SELECT any_value(mean) AS mean, any_value(accel) AS accel, list_sort(list(m)) AS means, count(*) AS reps, least(greatest(avg(CASE WHEN m < mean THEN 1.0 ELSE 0 END), 1 / (count(*) + 1)), count(*) / (count(*) + 1)) AS s FROM bm, bj",
    "bz0": f"SELECT *, {normal_quantile_sql('s')} AS z0 FROM bq",
}
query("M23_bootstrap_means", f"SELECT {L('rep')}, {r('m')} FROM bm", BOOT, digits=4)(lambda s, d: models.bootstrap_means(by_video(s, d), "VCL", "video").withColumn("m", F.round("m", 9)))  # sums differ in their last bits: noise must not decide a tie in the fifth decimal
query("M23_bca_interval", f"SELECT {r('mean', f'{_bca_end(0.025)} AS low', f'{_bca_end(0.975)} AS high')}, reps FROM bz0", BOOT)(lambda s, d: models.bca_interval(by_video(s, d), "VCL", "video"))
query("M25_forest")(lambda s, d: models.forest_regression(kept(s, d), ["LIN", "ALH", "BCF"], "VCL", repeats=1))
SIX = ["VCL", "LIN", "ALH", "BCF", "PWR", "TAC"]
query("M26_mixture_bic")(lambda s, d: models.mixture_bic(kinematics.track_features(tracks(s, d)), SIX))
query("M26_mixture_stability")(lambda s, d: models.mixture_stability(kinematics.track_features(tracks(s, d)), SIX, K, boots=10, seeds=(1, 2)))
