"""Trajectory tables derived from the given tables by SQL that Spark and DuckDB both run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACKS = """
WITH e AS (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame
  FROM {events}),
s AS (
  SELECT *, ((event_id * 7919 + user_id * 104729) % 201) - 100 AS nx, ((event_id * 6841 + user_id * 7907) % 201) - 100 AS ny,
         CASE WHEN user_id % 23 = 5 THEN 4 WHEN user_id % 5 = 0 THEN 0 WHEN user_id % 5 = 1 THEN 2
              ELSE (user_id + CAST(floor(frame / 9.0) AS BIGINT) * (1 + user_id % 3)) % 4 END AS regime,
         CASE WHEN user_id % 29 = 11 THEN 10 ELSE 1 END AS amp
  FROM e),
d AS (
  SELECT *,
         amp * CASE regime WHEN 0 THEN CAST(floor(nx / 2.0) AS BIGINT) WHEN 1 THEN nx * 10 WHEN 2 THEN 1000 + nx * 2 WHEN 3 THEN nx * 3
                           ELSE CASE WHEN frame % 2 = 0 THEN 900 ELSE -900 END END AS dx,
         amp * CASE regime WHEN 0 THEN CAST(floor(ny / 2.0) AS BIGINT) WHEN 1 THEN ny * 10 WHEN 2 THEN 200 + ny * 2 WHEN 3 THEN ny * 3 ELSE 0 END AS dy
  FROM s),
c AS (
  SELECT *, sum(dx) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS sx,
         sum(dy) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS sy
  FROM d
  WHERE NOT (user_id % 31 = 7 AND frame >= 12) AND NOT (user_id % 37 = 9 AND frame >= 8))
SELECT CAST(user_id % 20 AS VARCHAR(10)) AS video, user_id AS track_id, CAST(frame AS INT) AS frame,
       CAST(320 AS DOUBLE) + CAST(sx AS DOUBLE) / 1000 AS cx, CAST(240 AS DOUBLE) + CAST(sy AS DOUBLE) / 1000 AS cy,
       CAST(CASE WHEN user_id % 17 = 3 THEN 30 ELSE 50 + event_id % 50 END AS DOUBLE) / 100 AS conf
FROM c"""

PRED_TRACKS = """
SELECT video, CASE WHEN track_id % 4 = 1 AND frame >= 30 THEN track_id + 1000000 ELSE track_id END AS track_id,
       frame, cx + 1 AS cx, cy - 1 AS cy, conf
FROM {tracks} WHERE NOT (track_id % 6 = 2) AND NOT ((track_id * 31 + frame) % 10 = 0)"""

CLINICAL = """
SELECT CAST(n_nationkey AS VARCHAR(10)) AS video, CAST((n_nationkey * 7 + 11) % 50 AS DOUBLE) AS gt_progressive,
       CAST((n_nationkey * 5 + 3) % 30 AS DOUBLE) AS gt_non_progressive,
       CAST(100 - (n_nationkey * 7 + 11) % 50 - (n_nationkey * 5 + 3) % 30 AS DOUBLE) AS gt_immotile,
       CAST(5 + (n_nationkey * 11) % 40 AS DOUBLE) AS dfi
FROM {nation} WHERE n_nationkey < 20"""

DETECTIONS = """
SELECT video, frame, 0 AS cls, cx - 8 AS x1, cy - 8 AS y1, cx + 8 AS x2, cy + 8 AS y2, conf FROM {tracks}
UNION ALL
SELECT video, frame, CAST(track_id % 2 AS INT) AS cls, cx - 4 AS x1, cy - 4 AS y1, cx + 12 AS x2, cy + 12 AS y2, conf FROM {tracks} WHERE (track_id + frame) % 7 = 0"""


def _plain(df: DataFrame) -> DataFrame:
    """VARCHAR(n) columns as plain strings."""
    return df.select(*[df[c].cast("string").alias(c) if t.startswith(("varchar", "char")) else df[c] for c, t in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark.sql(TRACKS, events=table(spark, sf_dir, "events")))


def pred_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PRED_TRACKS, tracks=tracks(spark, sf_dir))


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark.sql(CLINICAL, nation=table(spark, sf_dir, "nation")))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DETECTIONS, tracks=tracks(spark, sf_dir))
