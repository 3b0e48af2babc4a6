"""Deterministic views over the driver's tables, for there are no video tables: the same SELECT in Spark and DuckDB.

Boxes from lineitem, track timelines from events, grey frames and face vectors from embeddings. The numbers carry no visual meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_D = "CAST({} AS DOUBLE)"
BOXES = """SELECT 'v0' AS video_id, l_orderkey AS frame_idx,
  CASE l_returnflag WHEN 'A' THEN 'face' WHEN 'N' THEN 'text' ELSE 'logo' END AS class_name,
  l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, (l_partkey % 40) * 4 AS bx, (l_suppkey % 10) * 6 AS by_,
  40 + l_linenumber * 4 AS w, CAST(30 + l_quantity AS INT) AS h,
  CAST(round(l_discount * 100) AS INT) AS dx, CAST(round(l_tax * 100) AS INT) AS dy,
  CAST(0.3 AS DOUBLE) + CAST((l_partkey * 31 + l_suppkey * 17) % 700 AS DOUBLE) / CAST(1000 AS DOUBLE) AS confidence
FROM lineitem"""
GT = f"""SELECT video_id, frame_idx, class_name, ln, pk, sk, bx AS x1, by_ AS y1, bx + w AS x2, by_ + h AS y2 FROM ({BOXES}) b WHERE ln <> 7"""
PRED = f"""SELECT video_id, frame_idx, class_name, ln, pk, sk, bx + dx AS x1, by_ + dy AS y1, bx + dx + w AS x2, by_ + dy + h AS y2, confidence FROM ({BOXES}) b WHERE ln <> 1"""
TIMELINE = {
    "spark": """SELECT 'v0' AS video_id, 0 AS scene_id, event_type AS class_name, user_id AS track_id, event_id,
  CAST(floor((unix_timestamp(CAST(ts AS TIMESTAMP)) - 1704067200) / 86400) AS INT) AS frame_idx, CAST(value * 10 AS INT) AS x1 FROM events""",
    "duckdb": """SELECT 'v0' AS video_id, 0 AS scene_id, event_type AS class_name, user_id AS track_id, event_id,
  CAST(floor((epoch(ts) - 1704067200) / 86400) AS INT) AS frame_idx, CAST(trunc(value * 10) AS INT) AS x1 FROM events""",
}
#: One row for each track and day: the largest x1 of the day.
DAYS = {k: f"SELECT video_id, scene_id, class_name, track_id, frame_idx, max(x1) AS x1 FROM ({v}) t GROUP BY video_id, scene_id, class_name, track_id, frame_idx" for k, v in TIMELINE.items()}
#: Sixteen videos, whose frames are numbered without gaps.
VIDEOS = 16
GREY = f"SELECT concat('v', CAST(vec_id % {VIDEOS} AS STRING)) AS video_id, CAST(floor(vec_id / {VIDEOS}) AS INT) AS frame_idx, embedding AS grey FROM embeddings"

FRAME_WIDTH, FRAME_HEIGHT = 160, 110
CUT = 0.15


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SELECT over the parquet tables of sf_dir that it names, without leaving a table name behind."""
    for t in ("lineitem", "events", "embeddings", "orders", "documents"):
        if f"FROM {t}" in sql:
            sql = sql.replace(f"FROM {t}", f"FROM parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(sql)
