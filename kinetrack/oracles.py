"""Named SQL building blocks (DuckDB) from which the queries' expected results are put together."""

from __future__ import annotations

import re

from . import fixtures

K = "video, track_id"


def _smooth(c: str) -> str:
    back, fore = f"lag({c}) OVER t", f"lead({c}) OVER t"
    return f"(coalesce(lag({c}, 2) OVER t, CASE WHEN {back} IS NULL THEN {fore} ELSE {back} END, {c}) + coalesce({back}, {c}) + {c} + coalesce({fore}, {c}) + coalesce(lead({c}, 2) OVER t, CASE WHEN {fore} IS NULL THEN {back} ELSE {fore} END, {c})) / 5"


def _gap(a: int, b: int) -> str:
    at = lambda c, k: c if k == 0 else f"lead({c}, {k}) OVER t" if k > 0 else f"lag({c}, {-k}) OVER t"
    return f"sqrt(({at('cx', a)} - {at('cx', b)}) * ({at('cx', a)} - {at('cx', b)}) + ({at('cy', a)} - {at('cy', b)}) * ({at('cy', a)} - {at('cy', b)}))"


def kinematics(window: int, source: str = "steps") -> str:
    h = window // 2

    def part(span: str, steps: str, inner: str, end: str) -> str:
        net = f"sqrt(power(last(cx) OVER {span} - first(cx) OVER {span}, 2) + power(last(cy) OVER {span} - first(cy) OVER {span}, 2))"
        smooth = f"((coalesce(sum(g) OVER {inner}, 0) + first(elo) OVER {span} + last(ehi) OVER {span}) / 5)"
        return f"sum(step) OVER {steps} / (count(*) OVER {span} - 1) / 1.422 * 50 AS vcl{end}, CASE WHEN {smooth} > 0 THEN {net} / {smooth} ELSE 0 END AS str{end}"

    t = f"PARTITION BY {K} ORDER BY frame ROWS BETWEEN"
    return f"""
  SELECT {K}, frame, idx, n_track, CASE WHEN n_track < {window} THEN vcl_a ELSE vcl_c END AS vcl, CASE WHEN n_track < {window} THEN str_a ELSE str_c END AS straightness
  FROM (SELECT {K}, frame, idx, n_track, {part("sp", "st", "si", "_c")}, {part("al", "al", "al", "_a")}
    FROM {source} WHERE n_track >= 10
    WINDOW sp AS ({t} {h} PRECEDING AND {h} FOLLOWING), st AS ({t} {h - 1} PRECEDING AND {h} FOLLOWING), si AS ({t} {h - 2} PRECEDING AND {h - 3} FOLLOWING), al AS ({t} UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


STATE = "CASE WHEN vcl <= 5 THEN 2 WHEN vcl >= 25 AND straightness >= 0.5 THEN 0 ELSE 1 END"


def _metrics(ppm: float = 1.422, fps: float = 50) -> str:
    um = lambda x: f"({x} / {ppm})"
    vsl = um("sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))")
    return f"""
  SELECT {K}, CAST(n AS INT) AS n_frames, round(total, 6) AS duration_s, round_even(vcl, 2) AS "VCL", round_even(vsl, 2) AS "VSL", round_even(vap, 2) AS "VAP",
         round_even(CASE WHEN vcl > 0 THEN vsl / vcl ELSE 0 END, 3) AS "LIN", round_even(CASE WHEN vap > 0 THEN vsl / vap ELSE 0 END, 3) AS "STR",
         round_even(CASE WHEN vcl > 0 THEN vap / vcl ELSE 0 END, 3) AS "WOB", round_even(alh, 2) AS "ALH", round_even(bcf, 2) AS "BCF"
  FROM (SELECT *, CASE WHEN total > 0 THEN {vsl} / total ELSE 0 END AS vsl, crossings / total AS bcf
    FROM (SELECT {K}, count(*) AS n, (count(*) - 1) * (1.0 / {fps}) AS total, avg(step / {ppm}) * {fps} AS vcl, avg(sstep / {ppm}) * {fps} AS vap, avg(lat_ / {ppm}) AS alh,
                 count(*) FILTER (side <> before) AS crossings, arg_min(cx, frame) AS ax, arg_min(cy, frame) AS ay, arg_max(cx, frame) AS bx, arg_max(cy, frame) AS by_
          FROM (SELECT *, sqrt(power(sx - lag(sx) OVER t, 2) + power(sy - lag(sy) OVER t, 2)) AS sstep, lag(side) OVER t AS before
                FROM (SELECT *, CASE WHEN NOT is_last THEN sqrt(power(cx - sx, 2) + power(cy - sy, 2)) END AS lat_, CASE WHEN NOT is_last THEN sign(round(cx - sx, 9)) END AS side
                      FROM (SELECT *, {_gap(0, -1)} AS step, {_smooth("cx")} AS sx, {_smooth("cy")} AS sy, lead(frame) OVER t IS NULL AS is_last
                            FROM tracks WINDOW t AS (PARTITION BY {K} ORDER BY frame)))
                WINDOW t AS (PARTITION BY {K} ORDER BY frame))
          GROUP BY {K}))
  WHERE n >= 10"""


CTES: dict[str, str] = {
    "tracks": fixtures.TRACKS.replace("{events}", "events"),
    "pred_tracks": fixtures.PRED_TRACKS.replace("{tracks}", "tracks"),
    "clinical": fixtures.CLINICAL.replace("{nation}", "nation"),
    "detections": fixtures.DETECTIONS.replace("{tracks}", "tracks"),
    "metrics": _metrics(),
    "metrics_old": _metrics(1.0, 30),
    "judged": """
  SELECT m.*, conf AS mean_conf, CASE WHEN coalesce(conf, 0) < 0.4 THEN 'low_conf' WHEN "VCL" > 200 THEN 'high_vcl' WHEN "VCL" > 20 AND "LIN" < 0.02 THEN 'jitter' WHEN duration_s < 0.3 THEN 'short_duration' END AS reason,
         CASE WHEN "VCL" <= 5 THEN 'immotile' WHEN "VCL" >= 25 AND "STR" >= 0.5 THEN 'progressive' ELSE 'non_progressive' END AS motility
  FROM metrics m LEFT JOIN (SELECT video, track_id, avg(conf) AS conf FROM tracks GROUP BY ALL) c USING (video, track_id)""",
    "kept": "SELECT * FROM judged WHERE reason IS NULL",
    "turns": f"""
  SELECT {K}, n, tac, var_v FROM (
    SELECT {K}, count(*) AS n, CASE WHEN count(*) < 3 THEN 0 WHEN sqrt(power(avg(sin(turn)), 2) + power(avg(cos(turn)), 2)) > 1e-12
             THEN sqrt(greatest(0, -2 * ln(sqrt(power(avg(sin(turn)), 2) + power(avg(cos(turn)), 2))))) ELSE pi() END AS tac, CASE WHEN avg(speed) > 0 THEN stddev_pop(speed) / avg(speed) ELSE 0 END AS var_v
    FROM (SELECT *, sqrt(dx * dx + dy * dy) AS speed, atan2(dy, dx) - lag(atan2(dy, dx)) OVER (PARTITION BY {K} ORDER BY frame) AS turn
          FROM (SELECT {K}, frame, cx - lag(cx) OVER t AS dx, cy - lag(cy) OVER t AS dy FROM tracks WINDOW t AS (PARTITION BY {K} ORDER BY frame)))
    GROUP BY {K}) WHERE n >= 10""",
    "features": """
  SELECT k.* EXCLUDE (reason, mean_conf), round_even(tac, 4) AS "TAC", round_even(var_v, 4) AS "VAR_V", round_even("ALH" * "BCF", 4) AS "PWR", duration_s AS "DUR"
  FROM kept k JOIN turns USING (video, track_id)""",
    "active": "SELECT video, avg(n) AS avg_active FROM (SELECT video, frame, count(DISTINCT track_id) AS n FROM tracks GROUP BY ALL) GROUP BY video",
    "detected": """
  SELECT video, CASE WHEN sum(n) > 0 THEN CAST(sum(n) AS BIGINT) END AS total_detections, CASE WHEN sum(n) > 0 THEN avg(n) END AS avg_detections, CASE WHEN sum(n) > 0 THEN count(*) FILTER (n > 0) END AS frames_with_boxes
  FROM (SELECT video, frame, count(*) FILTER (cls = 0) AS n FROM detections GROUP BY ALL) GROUP BY video""",
    "summary": """
  SELECT *, round_even(100 - adjusted_progressive_pct - adjusted_non_progressive_pct, 1) AS adjusted_immotile_pct, total_tracks + estimated_untracked AS adjusted_total,
         immotile + estimated_untracked AS adjusted_immotile, round_even(fraction, 4) AS untracked_fraction
  FROM (SELECT *, CASE WHEN total_tracks > 0 THEN round_even(100 * (progressive / total_tracks) * (1 - fraction), 1) ELSE 0 END AS adjusted_progressive_pct,
               CASE WHEN total_tracks > 0 THEN round_even(100 * (non_progressive / total_tracks) * (1 - fraction), 1) ELSE 0 END AS adjusted_non_progressive_pct
        FROM (SELECT *, CAST(greatest(0, round_even(avg_detections - avg_active, 0)) AS BIGINT) AS estimated_untracked, greatest(0, (avg_detections - avg_active) / avg_detections) AS fraction
              FROM (SELECT video, count(*) AS tracks_before_filter, count(*) FILTER (reason = 'low_conf') AS filtered_low_conf, count(*) FILTER (reason = 'high_vcl') AS filtered_high_vcl,
                           count(*) FILTER (reason = 'jitter') AS filtered_jitter, count(*) FILTER (reason = 'short_duration') AS filtered_short_duration,
                           count(*) FILTER (reason IS NULL) AS total_tracks, count(*) FILTER (reason IS NULL AND motility = 'progressive') AS progressive,
                           count(*) FILTER (reason IS NULL AND motility = 'non_progressive') AS non_progressive, count(*) FILTER (reason IS NULL AND motility = 'immotile') AS immotile,
                           round_even(round(avg("VCL") FILTER (reason IS NULL), 9), 2) AS "mean_VCL", round_even(round(avg("VSL") FILTER (reason IS NULL), 9), 2) AS "mean_VSL", round_even(round(avg("VAP") FILTER (reason IS NULL), 9), 2) AS "mean_VAP",
                           round_even(round(avg("LIN") FILTER (reason IS NULL), 9), 3) AS "mean_LIN", round_even(round(avg("STR") FILTER (reason IS NULL), 9), 3) AS "mean_STR", round_even(round(avg("WOB") FILTER (reason IS NULL), 9), 3) AS "mean_WOB",
                           round_even(round(avg("ALH") FILTER (reason IS NULL), 9), 2) AS "mean_ALH", round_even(round(avg("BCF") FILTER (reason IS NULL), 9), 2) AS "mean_BCF",
                           round_even(100 * count(*) FILTER (reason IS NULL AND motility = 'progressive') / count(*) FILTER (reason IS NULL), 1) AS progressive_pct,
                           round_even(100 * count(*) FILTER (reason IS NULL AND motility = 'non_progressive') / count(*) FILTER (reason IS NULL), 1) AS non_progressive_pct,
                           round_even(100 * count(*) FILTER (reason IS NULL AND motility = 'immotile') / count(*) FILTER (reason IS NULL), 1) AS immotile_pct
                    FROM judged GROUP BY video) JOIN active USING (video) JOIN detected USING (video)))""",
    "steps": f"SELECT *, row_number() OVER t - 1 AS idx, count(*) OVER (PARTITION BY {K}) AS n_track, {_gap(0, -1)} AS step, {_gap(3, -2)} AS g, {_gap(3, 1)} + {_gap(4, 0)} AS elo, {_gap(0, -4)} + {_gap(-1, -3)} AS ehi FROM tracks WINDOW t AS (PARTITION BY {K} ORDER BY frame)",
    "kin": kinematics(25),
    "states": f"SELECT {K}, frame, idx, {STATE} AS state FROM kin",
    "kin9": kinematics(9),
    "states9": f"SELECT {K}, frame, idx, {STATE} AS state FROM kin9",
}
for _s, _e in (("states", "eps"), ("states9", "eps9")):
    CTES[_e] = f"""
  SELECT *, ep_idx = 0 AS is_first, ep_idx = n_eps - 1 AS is_last, ep_idx = 0 OR ep_idx = n_eps - 1 AS censored
  FROM (SELECT *, count(*) OVER (PARTITION BY {K}) AS n_eps
    FROM (SELECT {K}, ep_idx, any_value(state) AS state, count(*) AS run
          FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY {K} ORDER BY idx) AS BIGINT) AS ep_idx
                FROM (SELECT *, CASE WHEN state <> lag(state) OVER (PARTITION BY {K} ORDER BY idx) THEN 1 ELSE 0 END AS new FROM {_s}))
          GROUP BY {K}, ep_idx))"""
CTES |= {
    "moves": f"SELECT video, track_id, state AS f, lead(state) OVER (PARTITION BY {K} ORDER BY idx) AS t FROM states",
    "counts": "SELECT f, t, (SELECT count(*) FROM moves WHERE moves.f = a.f AND moves.t = b.t) AS n FROM (VALUES (0), (1), (2)) a(f), (VALUES (0), (1), (2)) b(t)",
    "probs": "SELECT *, CASE WHEN sum(n) OVER (PARTITION BY f) > 0 THEN n / sum(n) OVER (PARTITION BY f) ELSE 0 END AS p FROM counts",
    "hist": "SELECT state, run, count(*) AS n FROM eps9 GROUP BY ALL",
    "resid": "SELECT e.*, ln(run / 50) - m AS resid FROM eps9 e JOIN (SELECT state, avg(ln(run / 50)) AS m FROM eps9 GROUP BY state) USING (state) WHERE n_eps >= 4",
    "trait": f"SELECT * FROM (SELECT *, min(c) OVER (PARTITION BY {K}) AS low FROM (SELECT *, ln(run / 50) - avg(ln(run / 50)) OVER (PARTITION BY {K}, state) AS resid, count(*) OVER (PARTITION BY {K}, state) AS c FROM eps9 WHERE n_eps >= 4)) WHERE low >= 2",
    "pairs": f"SELECT video, track_id, k AS lag, x, y FROM (SELECT video, track_id, k, resid AS x, CASE k WHEN 1 THEN lead(resid, 1) OVER t WHEN 2 THEN lead(resid, 2) OVER t WHEN 3 THEN lead(resid, 3) OVER t WHEN 4 THEN lead(resid, 4) OVER t ELSE lead(resid, 5) OVER t END AS y FROM resid, (VALUES (1), (2), (3), (4), (5)) l(k) WINDOW t AS (PARTITION BY k, {K} ORDER BY ep_idx)) WHERE y IS NOT NULL",
    "rates": f"SELECT {K}, CAST(sum(sw) AS BIGINT) AS switches, count(*) AS n, arg_min(state, idx) AS first_state, sum(sw) / (count(*) / 50) AS rate FROM (SELECT *, CASE WHEN state <> lag(state) OVER (PARTITION BY {K} ORDER BY idx) THEN 1 ELSE 0 END AS sw FROM states9) GROUP BY {K}",
    "vel": f"SELECT {K}, rn - 2 AS idx, vx, vy FROM (SELECT {K}, row_number() OVER t AS rn, (cx - lag(cx) OVER t) / 1.422 * 50 AS vx, (cy - lag(cy) OVER t) / 1.422 * 50 AS vy FROM tracks WINDOW t AS (PARTITION BY {K} ORDER BY frame)) WHERE rn > 1",
}


def ranks(source: str, by: str = "") -> str:
    """``source`` (x, y, and ``by``) with average ranks rx, ry."""
    part = f"PARTITION BY {by}" if by else ""
    comma = f", {by}" if by else ""
    one = lambda c: f"rank() OVER ({part} ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY round({c}, 9){comma}) - 1) / 2 AS r{c}"
    return f"SELECT *, {one('x')}, {one('y')} FROM ({source})"


def compose(select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` with every named block that it needs, in order."""
    blocks = CTES | (extra or {})
    order: list[str] = []

    def need(text: str) -> None:
        for name in blocks:
            if name not in order and re.search(rf"(?i)\b(?:FROM|JOIN|,)\s*\(?{name}\b", text):
                need(blocks[name])
                if name not in order:
                    order.append(name)

    need(select)
    return "WITH " + ",\n".join(f"{n} AS ({blocks[n]})" for n in order) + "\n" + select if order else select
