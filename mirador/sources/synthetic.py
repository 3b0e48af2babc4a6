"""Five synthetic clips with exact boxes, in closed form: 60 frames of 1280 x 720 at 30 a second."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
WIDTH, HEIGHT, FPS, FRAMES = 1280, 720, 30, 60


def _face(cx: str, cy: int, rx: int, ry: int) -> tuple[str, str, str, str]:
    return f"greatest(0, {cx} - {rx})", f"greatest(0, {cy - ry})", f"least({WIDTH}, {cx} + {rx})", f"least({HEIGHT}, {cy + ry})"


def _text(y: int) -> tuple[str, str, str, str]:
    return "30", str(y - 40), str(WIDTH - 30), str(y + 10)


def _logo(x: int, y: int) -> tuple[str, str, str, str]:
    return str(x), str(y), str(x + 180), str(y + 60)


#: Clip, class, track, corners as expressions of the frame number i.
BOXES = (
    ("synth_interview", "face", 1, _face("640 + i", 340, 100, 120)),
    ("synth_interview", "text", 10, _text(HEIGHT - 90)),
    ("synth_interview", "logo", 20, _logo(WIDTH - 200, 15)),
    ("synth_news", "face", 1, _face("300", 350, 90, 110)),
    ("synth_news", "face", 2, _face("950", 250, 55, 65)),
    ("synth_news", "text", 10, _text(HEIGHT - 100)),
    ("synth_news", "logo", 20, _logo(WIDTH - 195, 12)),
    ("synth_panel", "face", 1, _face("220 + CAST(floor(i / 10) AS INT) * 2", 360, 80, 95)),
    ("synth_panel", "face", 2, _face("640 + CAST(floor(i / 10) AS INT) * 2", 360, 80, 95)),
    ("synth_panel", "face", 3, _face("1060 + CAST(floor(i / 10) AS INT) * 2", 360, 80, 95)),
    ("synth_panel", "text", 10, _text(HEIGHT - 90)),
    ("synth_panel", "logo", 20, _logo(15, 15)),
    ("synth_ugc", "face", 1, _face("640 + CAST(trunc_(10 * sin(CAST(0.3 AS DOUBLE) * i)) AS INT)", 320, 75, 90)),
    ("synth_ugc", "text", 10, ("290", str(HEIGHT - 120), "990", str(HEIGHT - 60))),
    ("synth_cctv", "face", 1, _face("200 + 8 * i", 420, 40, 50)),
    ("synth_cctv", "face", 2, _face("900 - 4 * i", 380, 35, 42)),
    ("synth_cctv", "text", 10, ("5", "5", "420", "45")),
)


def truth(spark: SparkSession) -> DataFrame:
    """video_id, frame_idx, class_name, track_id, x1, y1, x2, y2."""
    frames = spark.range(FRAMES).select(F.col("id").cast("int").alias("i"))
    # CAST truncates toward zero here, so the truncation that SQL elsewhere needs is none
    parts = [frames.selectExpr(f"'{v}' AS video_id", "i AS frame_idx", f"'{c}' AS class_name", f"{t} AS track_id", *[f"{e.replace('trunc_', '')} AS {n}" for e, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)]) for v, c, t, box in BOXES]
    return reduce(DataFrame.unionByName, parts)


def truth_sql() -> str:
    one = lambda v, c, t, box: f"SELECT '{v}' AS video_id, i AS frame_idx, '{c}' AS class_name, {t} AS track_id, " + ", ".join(f"{e.replace('trunc_', 'trunc')} AS {n}" for e, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)) + f" FROM (SELECT CAST(unnest(range({FRAMES})) AS INT) AS i)"
    return " UNION ALL ".join(one(*b) for b in BOXES)
