"""Every relational operator as a query over the views, with the same question in DuckDB's SQL.

Whole numbers are returned as longs and doubles rounded to six places, in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirador.config import CLASSES, Config
from mirador.functions import geometry as g
from mirador.operators import boxes, frames, metrics, pictures, reid, tracks
from mirador.sources import files, synthetic, views
from mirador.sources.files import output_path, stem
from mirador.sources.views import DAYS, FRAME_HEIGHT, FRAME_WIDTH, GREY, GT, PRED, view

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}
W, H = FRAME_WIDTH, FRAME_HEIGHT


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[name] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _found.items() if s}


def tidy(df: DataFrame, *cols: str) -> DataFrame:
    """Only these columns: whole numbers as longs, doubles to six places."""
    kinds = dict(df.dtypes)
    one = lambda c: F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint", "smallint") else F.round(c, 6).alias(c) if kinds[c] in ("double", "float") else F.col(c)
    return df.select(*[one(c) for c in (cols or df.columns)])


def _pred(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, PRED)


def _gt(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, GT)


def _days(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, DAYS["spark"])


#: Whatever two boxes of a frame differ in; ids alone may repeat.
TIE = GT_ORDER = ("ln", "pk", "sk", "x1", "y1", "x2", "y2")
_IDS = "frame_idx, class_name, ln, pk, sk"
_ID = ("frame_idx", "class_name", "ln", "pk", "sk")
_BIG = lambda *names: ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


# -- matching and its rates -------------------------------------------------------------------------------------------------

_IOU = """CASE WHEN least(p.x2, g.x2) > greatest(p.x1, g.x1) AND least(p.y2, g.y2) > greatest(p.y1, g.y1) THEN
  CAST((least(p.x2, g.x2) - greatest(p.x1, g.x1)) * (least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS DOUBLE) /
  CAST((p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - (least(p.x2, g.x2) - greatest(p.x1, g.x1)) * (least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS DOUBLE)
  ELSE CAST(0 AS DOUBLE) END"""
_MATCHED = f"""
gt AS (SELECT *, row_number() OVER (PARTITION BY frame_idx, class_name ORDER BY ln, pk, sk, x1, y1, x2, y2) AS gid FROM ({GT}) x),
pred AS (SELECT *, row_number() OVER (PARTITION BY frame_idx, class_name ORDER BY confidence DESC, ln, pk, sk, x1, y1, x2, y2) AS rk FROM ({PRED}) x),
pairs AS (SELECT p.frame_idx, p.class_name, p.rk, g.gid, {_IOU} AS iou FROM pred p JOIN gt g ON p.frame_idx = g.frame_idx AND p.class_name = g.class_name),
wanted AS (SELECT p.frame_idx, p.class_name, p.rk, coalesce(list(q.gid ORDER BY q.iou DESC, q.gid) FILTER (WHERE q.gid IS NOT NULL), []) AS c
  FROM pred p LEFT JOIN (SELECT * FROM pairs WHERE iou >= 0.5) q ON p.frame_idx = q.frame_idx AND p.class_name = q.class_name AND p.rk = q.rk
  GROUP BY p.frame_idx, p.class_name, p.rk),
walk AS (
  SELECT DISTINCT frame_idx, class_name, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS used FROM pred
  UNION ALL
  SELECT w.frame_idx, w.class_name, n.rk, CASE WHEN len(list_filter(n.c, lambda x: NOT list_contains(w.used, x))) > 0
    THEN list_append(w.used, list_filter(n.c, lambda x: NOT list_contains(w.used, x))[1]) ELSE w.used END
  FROM walk w JOIN wanted n ON w.frame_idx = n.frame_idx AND w.class_name = n.class_name AND n.rk = w.rk + 1),
hits AS (SELECT frame_idx, class_name, max(len(used)) AS tp, max(rk) AS n_pred FROM walk GROUP BY frame_idx, class_name),
ng AS (SELECT frame_idx, class_name, count(*) AS n_gt FROM gt GROUP BY frame_idx, class_name),
groups AS (SELECT coalesce(h.frame_idx, n.frame_idx) AS frame_idx, coalesce(h.class_name, n.class_name) AS class_name,
  CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(n_pred, 0) AS BIGINT) AS n_pred, CAST(coalesce(n_gt, 0) AS BIGINT) AS n_gt
  FROM hits h FULL JOIN ng n ON h.frame_idx = n.frame_idx AND h.class_name = n.class_name)"""
_CLASSES = "(SELECT unnest(['face', 'text', 'logo']) AS class_name)"
_ALARMS = f"""
seen AS (SELECT DISTINCT frame_idx, class_name FROM ({PRED}) x), real_ AS (SELECT DISTINCT frame_idx, class_name FROM ({GT}) x),
alarms AS (SELECT c.class_name, (SELECT count(DISTINCT l_orderkey) FROM lineitem) - (SELECT count(*) FROM real_ r WHERE r.class_name = c.class_name) AS negative_frames,
  (SELECT count(*) FROM seen s WHERE s.class_name = c.class_name AND NOT EXISTS (SELECT 1 FROM real_ r WHERE r.class_name = s.class_name AND r.frame_idx = s.frame_idx)) AS false_alarm_frames FROM {_CLASSES} c)"""
_RATE = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def _frames(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "SELECT DISTINCT 'v0' AS video_id, l_orderkey AS frame_idx FROM lineitem")


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.detection_metrics(_frames(s, d), _pred(s, d), _gt(s, d), 0.5, tie=TIE, truth_order=GT_ORDER)


@query("detection_metrics", f"""
WITH RECURSIVE {_MATCHED}, {_ALARMS},
sums AS (SELECT a.class_name, coalesce(sum(tp), 0) AS tp, coalesce(sum(n_pred - tp), 0) AS fp, coalesce(sum(n_gt - tp), 0) AS fn, any_value(negative_frames) AS negative_frames,
  any_value(false_alarm_frames) AS false_alarm_frames FROM alarms a LEFT JOIN groups g ON a.class_name = g.class_name GROUP BY a.class_name),
rated AS (SELECT *, {_RATE('tp', 'tp + fn')} AS r, {_RATE('tp', 'tp + fp')} AS p FROM sums)
SELECT class_name, {_BIG('tp', 'fp', 'fn', 'negative_frames', 'false_alarm_frames')}, round(r, 6) AS recall, round(p, 6) AS precision,
  round({_RATE('2 * p * r', 'p + r')}, 6) AS f1, round({_RATE('false_alarm_frames', 'negative_frames')}, 6) AS fpr FROM rated""")
def detection_metrics(s: SparkSession, d: str) -> DataFrame:
    """Recall, precision, F1 and false-positive rate by class: the flagship."""
    return tidy(_metrics(s, d), "class_name", "tp", "fp", "fn", "negative_frames", "false_alarm_frames", "recall", "precision", "f1", "fpr")


@query("greedy_match", f"WITH RECURSIVE {_MATCHED} SELECT {_BIG('frame_idx')}, class_name, tp, n_pred - tp AS fp, n_gt - tp AS fn FROM groups")
def greedy_match(s: SparkSession, d: str) -> DataFrame:
    return tidy(boxes.matched(_pred(s, d), _gt(s, d), 0.5, tie=TIE, truth_order=GT_ORDER), "frame_idx", "class_name", "tp", "fp", "fn")


@query("pair_iou", f"SELECT {', '.join(f'CAST(p.{c} AS BIGINT) AS {c}' if c != 'class_name' else 'p.class_name' for c in _ID)}, CAST(g.ln AS BIGINT) AS g_ln, CAST(g.pk AS BIGINT) AS g_pk, CAST(g.sk AS BIGINT) AS g_sk, round({_IOU}, 6) AS iou FROM ({PRED}) p JOIN ({GT}) g ON p.frame_idx = g.frame_idx AND p.class_name = g.class_name")
def pair_iou(s: SparkSession, d: str) -> DataFrame:
    truth = _gt(s, d).select("frame_idx", "class_name", *[F.col(c).alias(f"g_{c}") for c in ("ln", "pk", "sk")], *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    both = _pred(s, d).join(truth, ["frame_idx", "class_name"])
    return tidy(both.withColumn("iou", g.iou(g.box(), g.box("g"))), *_ID, "g_ln", "g_pk", "g_sk", "iou")


@query("best_match", f"""WITH q AS (SELECT p.frame_idx, p.class_name, p.ln, p.pk, p.sk, {_IOU} AS iou FROM ({PRED}) p JOIN ({GT}) g ON p.frame_idx = g.frame_idx AND p.class_name = g.class_name)
SELECT {_BIG('frame_idx')}, class_name, {_BIG('ln', 'pk', 'sk')}, round(max(iou), 6) AS best_iou FROM q GROUP BY {_IDS}""")
def best_match(s: SparkSession, d: str) -> DataFrame:
    return tidy(pair_iou(s, d).groupBy(*_ID).agg(F.max("iou").alias("best_iou")), *_ID, "best_iou")


@query("false_alarms", f"WITH {_ALARMS} SELECT class_name, {_BIG('negative_frames', 'false_alarm_frames')}, round({_RATE('false_alarm_frames', 'negative_frames')}, 6) AS fpr FROM alarms")
def false_alarms(s: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.false_alarms(_frames(s, d), _pred(s, d), _gt(s, d)), "class_name", "negative_frames", "false_alarm_frames", "fpr")


_VIDEO = "'v' || CAST(frame_idx % 7 AS VARCHAR)"
_BYVIDEO = f"""sums AS (SELECT {_VIDEO} AS video_id, class_name, sum(tp) AS tp, sum(n_pred - tp) AS fp, sum(n_gt - tp) AS fn FROM groups GROUP BY {_VIDEO}, class_name)"""


def _by_video(s: SparkSession, d: str) -> DataFrame:
    part = lambda df: df.withColumn("video_id", F.concat(F.lit("v"), (F.col("frame_idx") % 7).cast("string")))
    return metrics.detection_metrics(part(_frames(s, d)), part(_pred(s, d)), part(_gt(s, d)), 0.5, tie=TIE, truth_order=GT_ORDER)


@query("metrics_by_video", f"""WITH RECURSIVE {_MATCHED}, {_BYVIDEO}, rated AS (SELECT *, {_RATE('tp', 'tp + fn')} AS r, {_RATE('tp', 'tp + fp')} AS p FROM sums)
SELECT video_id, class_name, {_BIG('tp', 'fp', 'fn')}, round(r, 6) AS recall, round(p, 6) AS precision FROM rated""")
def metrics_by_video(s: SparkSession, d: str) -> DataFrame:
    return tidy(_by_video(s, d), "video_id", "class_name", "tp", "fp", "fn", "recall", "precision")


@query("micro_average", f"""WITH RECURSIVE {_MATCHED}, {_BYVIDEO}, t AS (SELECT class_name, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) AS n_videos FROM sums GROUP BY class_name),
rated AS (SELECT *, {_RATE('tp', 'tp + fn')} AS r, {_RATE('tp', 'tp + fp')} AS p FROM t)
SELECT class_name, {_BIG('tp', 'fp', 'fn', 'n_videos')}, round(r, 6) AS recall, round(p, 6) AS precision, round({_RATE('2 * p * r', 'p + r')}, 6) AS f1 FROM rated""")
def micro_average(s: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.micro(_by_video(s, d)), "class_name", "tp", "fp", "fn", "n_videos", "recall", "precision", "f1")


@query("nms", f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY confidence DESC, ln, pk, sk) AS rk FROM ({PRED}) x),
near AS (SELECT p.frame_idx, p.rk, coalesce(list(g.rk) FILTER (WHERE g.rk IS NOT NULL), []) AS c FROM r p LEFT JOIN (SELECT p.frame_idx, p.rk AS prk, g.rk FROM r p JOIN r g ON p.frame_idx = g.frame_idx AND g.rk < p.rk WHERE {_IOU} >= 0.5) g
  ON g.frame_idx = p.frame_idx AND g.prk = p.rk GROUP BY p.frame_idx, p.rk),
walk AS (SELECT DISTINCT frame_idx, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept FROM r UNION ALL
  SELECT w.frame_idx, n.rk, CASE WHEN len(list_intersect(n.c, w.kept)) > 0 THEN w.kept ELSE list_append(w.kept, n.rk) END FROM walk w JOIN near n ON n.frame_idx = w.frame_idx AND n.rk = w.rk + 1),
final AS (SELECT frame_idx, unnest(arg_max(kept, rk)) AS rk FROM walk GROUP BY frame_idx)
SELECT CAST(r.frame_idx AS BIGINT) AS frame_idx, r.class_name, {', '.join(f'CAST(r.{c} AS BIGINT) AS {c}' for c in ('ln', 'pk', 'sk'))}, round(r.confidence, 6) AS confidence FROM final f JOIN r ON r.frame_idx = f.frame_idx AND r.rk = f.rk""")
def nms(s: SparkSession, d: str) -> DataFrame:
    return tidy(boxes.suppressed(_pred(s, d), 0.5, ("video_id", "frame_idx"), ("ln", "pk", "sk")), *_ID, "confidence")


# -- boxes ------------------------------------------------------------------------------------------------------------------

def _boxes_as(df: DataFrame, b) -> DataFrame:
    return tidy(df.select(*_ID, *[c.alias(n) for c, n in zip(b, ("bx1", "by1", "bx2", "by2"), strict=True)]))


_BOXED = lambda a, b, c, e: f"SELECT {_BIG('frame_idx')}, class_name, {_BIG('ln', 'pk', 'sk')}, CAST({a} AS BIGINT) AS bx1, CAST({b} AS BIGINT) AS by1, CAST({c} AS BIGINT) AS bx2, CAST({e} AS BIGINT) AS by2 FROM ({PRED}) x"
_DX, _DY = ("CAST(trunc((x2 - x1) * CAST(0.15 AS DOUBLE) / 2) AS INT)", "CAST(trunc((y2 - y1) * CAST(0.15 AS DOUBLE) / 2) AS INT)")


@query("clamp_bbox", _BOXED("greatest(0, x1)", "greatest(0, y1)", f"least({W}, x2)", f"least({H}, y2)"))
def clamp_bbox(s: SparkSession, d: str) -> DataFrame:
    return _boxes_as(_pred(s, d), g.clamp(g.box(), F.lit(W), F.lit(H)))


@query("expand_bbox", _BOXED(f"greatest(0, x1 - {_DX})", f"greatest(0, y1 - {_DY})", f"least({W}, x2 + {_DX})", f"least({H}, y2 + {_DY})"))
def expand_bbox(s: SparkSession, d: str) -> DataFrame:
    return _boxes_as(_pred(s, d), g.expand(g.box(), 0.15, F.lit(W), F.lit(H)))


@query("scale_detection", _BOXED(*[f"trunc({c} / CAST(0.6 AS DOUBLE))" for c in ("x1", "y1", "x2", "y2")]))
def scale_detection(s: SparkSession, d: str) -> DataFrame:
    return _boxes_as(_pred(s, d), g.rescale(g.box(), F.lit(0.6)))


_SHIFTED = f"greatest(0, x1 - 60)", f"greatest(0, y1 - 50)", f"least({W} - 60, x2 - 60)", f"least({H} - 50, y2 - 50)"


@query("degenerate_drop", f"SELECT {_BIG('frame_idx')}, class_name, {_BIG('ln', 'pk', 'sk')} FROM ({PRED}) x WHERE NOT ({_SHIFTED[2]} <= {_SHIFTED[0]} OR {_SHIFTED[3]} <= {_SHIFTED[1]})")
def degenerate_drop(s: SparkSession, d: str) -> DataFrame:
    x1, y1, x2, y2 = g.box()
    return tidy(_pred(s, d).where(~g.degenerate(g.clamp((x1 - 60, y1 - 50, x2 - 60, y2 - 50), F.lit(W - 60), F.lit(H - 50)))), *_ID)


@query("overlay_filter", f"SELECT {_BIG('frame_idx')}, class_name, {_BIG('ln', 'pk', 'sk')} FROM ({PRED}) x WHERE (y1 + y2) / CAST(2 AS DOUBLE) < {H} * CAST(0.2 AS DOUBLE) OR (y1 + y2) / CAST(2 AS DOUBLE) > {H} * CAST(0.7 AS DOUBLE) OR x2 < {W} * CAST(0.08 AS DOUBLE) OR x1 > {W} * CAST(0.92 AS DOUBLE)")
def overlay_filter(s: SparkSession, d: str) -> DataFrame:
    return tidy(_pred(s, d).where(g.overlay(g.box(), F.lit(W), F.lit(H))), *_ID)


@query("confidence_filter", f"SELECT {_BIG('frame_idx')}, class_name, {_BIG('ln', 'pk', 'sk')}, round(confidence, 6) AS confidence FROM ({PRED}) x WHERE confidence >= CASE class_name WHEN 'face' THEN CAST(0.45 AS DOUBLE) WHEN 'text' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END")
def confidence_filter(s: SparkSession, d: str) -> DataFrame:
    return tidy(boxes.confident(_pred(s, d), Config.for_evaluation().thresholds()), *_ID, "confidence")


@query("blur_kernel", f"SELECT {_BIG('frame_idx')}, class_name, {_BIG('ln', 'pk', 'sk')}, CAST(greatest(1, least(51, x2 - x1, y2 - y1) - (1 - least(51, x2 - x1, y2 - y1) % 2)) AS BIGINT) AS kernel, (y2 - y1) > 6 AND (x2 - x1) > 6 AS feathered, least(x2 - x1, y2 - y1) >= 45 AS large_enough FROM ({PRED}) x")
def blur_kernel(s: SparkSession, d: str) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return tidy(_pred(s, d).withColumn("kernel", g.kernel(w, h)).withColumn("feathered", g.feathered(w, h)).withColumn("large_enough", F.least(w, h) >= 45), *_ID, "kernel", "feathered", "large_enough")


@query("resize_dims", f"SELECT {_BIG('frame_idx')}, class_name, {_BIG('ln', 'pk', 'sk')}, round(CASE WHEN greatest(x2, y2) > 150 THEN CAST(150 AS DOUBLE) / greatest(x2, y2) ELSE CAST(1 AS DOUBLE) END, 6) AS scale FROM ({PRED}) x")
def resize_dims(s: SparkSession, d: str) -> DataFrame:
    return tidy(_pred(s, d).withColumn("scale", g.resize_scale("x2", "y2", 150)), *_ID, "scale")


@query("polygon_bbox", _BOXED("x1", "y1 - 2", "x2 + 1", "y2"))
def polygon_bbox(s: SparkSession, d: str) -> DataFrame:
    x1, y1, x2, y2 = (c.cast("double") for c in g.box())
    corner = lambda x, y: F.array(x, y)
    polygon = F.array(corner(x1 + 0.4, y1), corner(x2 + 1.7, y1 - 2), corner(x2, y2 + 0.9), corner(x1 + 0.9, y2))
    return _boxes_as(_pred(s, d), g.polygon_box(polygon))


@query("malformed_polygons", _BOXED("x1", "y1", "x2", "y2") + " WHERE (ln * 3 + pk) % 6 = 5")
def malformed_polygons(s: SparkSession, d: str) -> DataFrame:
    """Of polygons without points, without a coordinate, with a null one, of nulls, and no polygon at all, only whole ones have a box."""
    x1, y1, x2, y2 = (c.cast("double") for c in g.box())
    corner, none = lambda *x: F.array(*x), F.lit(None).cast("double")
    kinds = [F.array().cast("array<array<double>>"), F.array(corner(x1, y1), corner(x2)), F.array(corner(x1, y1), corner(x2, none)), F.array(F.lit(None).cast("array<double>")), F.lit(None).cast("array<array<double>>")]
    kind = (F.col("ln") * 3 + F.col("pk")) % 6
    whole = F.array(corner(x1 + 0.4, y1), corner(x2, y1 + 0.2), corner(x2 + 0.9, y2), corner(x1, y2 + 0.3))
    polygon = F.coalesce(*[F.when(kind == k, p) for k, p in enumerate(kinds[:4])], F.when(kind == 4, kinds[4]), F.when(kind == 5, whole))
    return _boxes_as(boxes.from_polygons(_pred(s, d).withColumn("polygon", polygon)), g.box())


@query("prompt_union", _found["nms"][1].replace(f"FROM ({PRED}) x)", f"FROM ({PRED}) x WHERE class_name = 'logo')", 1))
def prompt_union(s: SparkSession, d: str) -> DataFrame:
    """Logos found by three prompts, as one set without those that another prompt found too."""
    logos = _pred(s, d).where("class_name = 'logo'")
    by_prompt = [logos.where(F.pmod("pk", F.lit(3)) == k) for k in range(3)]
    return tidy(boxes.prompted(by_prompt, 0.5, tie=("ln", "pk", "sk")), *_ID, "confidence")


@query("tie_rank", f"SELECT {_BIG('frame_idx')}, class_name, {_BIG('ln', 'pk', 'sk')}, row_number() OVER (PARTITION BY frame_idx, class_name ORDER BY confidence DESC, ln, pk, sk) AS rank FROM ({PRED}) x")
def tie_rank(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("frame_idx", "class_name").orderBy(F.desc("confidence"), "ln", "pk", "sk")
    return tidy(_pred(s, d).withColumn("rank", F.row_number().over(w)), *_ID, "rank")


@query("detector_union", f"SELECT {_BIG('frame_idx')}, class_name, {_BIG('ln', 'pk', 'sk')}, CAST(CASE class_name WHEN 'face' THEN 0 WHEN 'text' THEN 1 ELSE 2 END AS BIGINT) AS detector_rank FROM ({PRED}) x")
def detector_union(s: SparkSession, d: str) -> DataFrame:
    p = _pred(s, d)
    return tidy(boxes.all_detectors({c: p.where(F.col("class_name") == c) for c in CLASSES}), *_ID, "detector_rank")


# -- frames -----------------------------------------------------------------------------------------------------------------

_MAD = f"""mads AS (SELECT video_id, frame_idx, CASE WHEN b IS NULL THEN NULL ELSE list_sum(list_transform(list_zip(grey, b), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) / len(grey) END AS mad
  FROM (SELECT *, lag(grey) OVER (PARTITION BY video_id ORDER BY frame_idx) AS b FROM ({GREY}) x)),
cuts AS (SELECT video_id, frame_idx, mad, coalesce(mad > {views.CUT}, false) AS is_scene_cut FROM mads),
scened AS (SELECT *, sum(CAST(is_scene_cut AS INT)) OVER (PARTITION BY video_id ORDER BY frame_idx) AS scene_id, frame_idx % 5 = 0 OR is_scene_cut AS is_detection_frame FROM cuts)"""


def _gated(s: SparkSession, d: str) -> DataFrame:
    return frames.gated(frames.scenes(frames.scene_cuts(view(s, d, GREY), views.CUT)), 5)


@query("scene_cuts", f"WITH {_MAD} SELECT video_id, {_BIG('frame_idx')}, round(mad, 6) AS mad, is_scene_cut FROM cuts")
def scene_cuts(s: SparkSession, d: str) -> DataFrame:
    return tidy(_gated(s, d), "video_id", "frame_idx", "mad", "is_scene_cut")


@query("scene_segments", f"WITH {_MAD} SELECT video_id, {_BIG('frame_idx', 'scene_id')} FROM scened")
def scene_segments(s: SparkSession, d: str) -> DataFrame:
    return tidy(_gated(s, d), "video_id", "frame_idx", "scene_id")


@query("sparse_gate", f"WITH {_MAD} SELECT video_id, {_BIG('frame_idx')}, is_detection_frame FROM scened")
def sparse_gate(s: SparkSession, d: str) -> DataFrame:
    return tidy(_gated(s, d), "video_id", "frame_idx", "is_detection_frame")


@query("frame_sample", f"SELECT video_id, {_BIG('frame_idx')}, CAST(frame_idx // 30 AS BIGINT) AS sample_idx, round(frame_idx / CAST(25 AS DOUBLE) * 1000, 6) AS timestamp_ms FROM ({GREY}) x WHERE frame_idx % 30 = 0 AND frame_idx < 400")
def frame_sample(s: SparkSession, d: str) -> DataFrame:
    f = view(s, d, GREY).select("video_id", "frame_idx", F.lit(25.0).alias("fps"))
    f = frames.timestamps(frames.sampled(frames.first_frames(f, 400), 30))
    return tidy(f.withColumn("sample_idx", F.expr("frame_idx div 30")), "video_id", "frame_idx", "sample_idx", "timestamp_ms")


@query("frame_count", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(greatest(coalesce(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 100 - 10 END, 0), 0) AS BIGINT) AS n_frames FROM orders")
def frame_count(s: SparkSession, d: str) -> DataFrame:
    """Containers that give no count, or a negative one, have no frames."""
    given = view(s, d, "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 100 - 10 END AS n FROM orders")
    return tidy(given.select("o_orderkey", frames.frame_count("n").alias("n_frames")))


_TRACKED = f"SELECT concat('v', CAST(l_orderkey % {views.VIDEOS} AS STRING)) AS video_id, CAST(floor(l_orderkey / {views.VIDEOS}) % 500 AS INT) AS frame_idx, CAST(l_orderkey AS BIGINT) AS track_id, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey"


@query("hold_last", f"""WITH {_MAD}, t AS ({_TRACKED}), held AS (SELECT video_id, frame_idx, max(CASE WHEN is_detection_frame THEN frame_idx END) OVER (PARTITION BY video_id ORDER BY frame_idx) AS gate_frame FROM scened)
SELECT h.video_id, {', '.join(f'CAST(h.{c} AS BIGINT) AS {c}' for c in ('frame_idx', 'gate_frame'))}, t.track_id, t.n FROM held h JOIN t ON t.video_id = h.video_id AND t.frame_idx = h.gate_frame""")
def hold_last(s: SparkSession, d: str) -> DataFrame:
    return tidy(frames.hold_last(_gated(s, d), view(s, d, _TRACKED)), "video_id", "frame_idx", "gate_frame", "track_id", "n")


# -- tracks -----------------------------------------------------------------------------------------------------------------

_DAY = DAYS["duckdb"]
_K = "class_name, track_id"


@query("track_age", f"SELECT class_name, {_BIG('track_id', 'frame_idx')}, CAST(min(frame_idx) OVER (PARTITION BY {_K}) AS BIGINT) AS birth_frame, CAST(frame_idx - min(frame_idx) OVER (PARTITION BY {_K}) + 1 AS BIGINT) AS age FROM ({_DAY}) x")
def track_age(s: SparkSession, d: str) -> DataFrame:
    return tidy(tracks.ages(_days(s, d)), "class_name", "track_id", "frame_idx", "birth_frame", "age")


@query("track_islands", f"SELECT class_name, {_BIG('track_id')}, CAST(min(frame_idx) AS BIGINT) AS first_frame, CAST(count(*) AS BIGINT) AS n_frames FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY {_K} ORDER BY frame_idx) AS island FROM ({_DAY}) x) y GROUP BY class_name, track_id, island")
def track_islands(s: SparkSession, d: str) -> DataFrame:
    by = tracks.islands(_days(s, d)).groupBy("class_name", "track_id", "island")
    return tidy(by.agg(F.min("frame_idx").alias("first_frame"), F.count("*").alias("n_frames")), "class_name", "track_id", "first_frame", "n_frames")


@query("ema_smoothing", f"""WITH RECURSIVE d AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY {_K} ORDER BY frame_idx) AS island, row_number() OVER (PARTITION BY {_K} ORDER BY frame_idx) AS n FROM ({_DAY}) x),
f AS (SELECT class_name, track_id, island, frame_idx, x1 FROM (SELECT *, row_number() OVER (PARTITION BY {_K}, island ORDER BY frame_idx) AS k FROM d) y WHERE k = 1
  UNION ALL SELECT d.class_name, d.track_id, d.island, d.frame_idx, CAST(trunc(CAST(0.7 AS DOUBLE) * d.x1 + (1 - CAST(0.7 AS DOUBLE)) * f.x1) AS INT)
  FROM f JOIN d ON d.class_name = f.class_name AND d.track_id = f.track_id AND d.island = f.island AND d.frame_idx = f.frame_idx + 1)
SELECT class_name, {_BIG('track_id', 'frame_idx')}, CAST(x1 AS BIGINT) AS smoothed FROM f""")
def ema_smoothing(s: SparkSession, d: str) -> DataFrame:
    return tidy(tracks.smoothed(_days(s, d), ("x1",)).withColumnRenamed("x1", "smoothed"), "class_name", "track_id", "frame_idx", "smoothed")


@query("dead_tracks", f"SELECT class_name, {_BIG('track_id')}, CAST(frame_idx + 1 AS BIGINT) AS frame_idx FROM ({_DAY}) x WHERE NOT EXISTS (SELECT 1 FROM ({_DAY}) y WHERE y.class_name = x.class_name AND y.track_id = x.track_id AND y.frame_idx = x.frame_idx + 1)")
def dead_tracks(s: SparkSession, d: str) -> DataFrame:
    return tidy(tracks.dead(_days(s, d)), "class_name", "track_id", "frame_idx")


_TC = f"SELECT class_name, track_id, count(DISTINCT frame_idx) AS n_frames, max(frame_idx) - min(frame_idx) + 1 AS span FROM ({_DAY}) x GROUP BY class_name, track_id"


@query("track_consistency", f"SELECT class_name, {_BIG('track_id', 'n_frames', 'span')}, round(CAST(n_frames AS DOUBLE) / span, 6) AS consistency FROM ({_TC}) t")
def track_consistency(s: SparkSession, d: str) -> DataFrame:
    return tidy(tracks.consistency_by_track(_days(s, d)), "class_name", "track_id", "n_frames", "span", "consistency")


@query("temporal_consistency", f"SELECT class_name, round(coalesce(avg(CAST(n_frames AS DOUBLE) / span), 1), 6) AS temporal_consistency, CAST(count(*) AS BIGINT) AS n_tracks FROM ({_TC}) t GROUP BY class_name")
def temporal_consistency(s: SparkSession, d: str) -> DataFrame:
    return tidy(tracks.temporal_consistency(_days(s, d), ("class_name",)))


@query("active_counts", f"SELECT CAST(frame_idx AS BIGINT) AS frame_idx, {', '.join(f'''count(*) FILTER (WHERE class_name = '{c}') AS n_{c}''' for c in CLASSES)} FROM ({GT}) x GROUP BY frame_idx")
def active_counts(s: SparkSession, d: str) -> DataFrame:
    return tidy(tracks.active_counts(_gt(s, d)), "frame_idx", "n_face", "n_text", "n_logo")


# -- re-identification ------------------------------------------------------------------------------------------------------

_FACES = "SELECT CAST(b.vec_id AS BIGINT) AS frame_idx, 10 + b.label * 12 AS face_size_px, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE 10 + b.label * 12 >= 20"
_COMPARED = f"SELECT frame_idx, face_size_px, coalesce(list_dot_product(CAST(x AS DOUBLE[]), CAST(y AS DOUBLE[])) / nullif(sqrt(list_dot_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[]))) * sqrt(list_dot_product(CAST(y AS DOUBLE[]), CAST(y AS DOUBLE[]))), 0), 0) AS similarity, CASE WHEN face_size_px < 40 THEN 'small' WHEN face_size_px < 80 THEN 'medium' WHEN face_size_px < 10000 THEN 'large' END AS bucket FROM ({_FACES}) f"


def _faces(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet")
    a = e.select((F.col("vec_id") + 1).alias("frame_idx"), F.col("embedding").alias("embedding_original"))
    b = e.select(F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("embedding_redacted"), (10 + F.col("label") * 12).alias("face_size_px"))
    return reid.compared(a.join(b, "frame_idx"), 0.1, 20)


@query("reid_similarity", f"SELECT frame_idx, {_BIG('face_size_px')}, bucket, round(similarity, 6) AS similarity, round(similarity, 6) >= 0.1 AS is_reidentified FROM ({_COMPARED}) c")
def reid_similarity(s: SparkSession, d: str) -> DataFrame:
    return tidy(_faces(s, d), "frame_idx", "face_size_px", "bucket", "similarity", "is_reidentified")


@query("reid_summary", f"""WITH c AS (SELECT *, similarity >= 0.1 AS hit FROM ({_COMPARED}) c)
SELECT count(*) AS n_tested, count(*) FILTER (WHERE hit) AS n_reidentified, round(coalesce(avg(similarity), 0), 6) AS mean_similarity, round({_RATE('count(*) FILTER (WHERE hit)', 'count(*)')}, 6) AS reid_rate,
{', '.join(f'''count(*) FILTER (WHERE bucket = '{b}') AS n_{b}, round({_RATE(f"count(*) FILTER (WHERE hit AND bucket = '{b}')", f"count(*) FILTER (WHERE bucket = '{b}')")}, 6) AS rate_{b}''' for b in reid.BUCKETS)} FROM c""")
def reid_summary(s: SparkSession, d: str) -> DataFrame:
    return tidy(reid.summary(_faces(s, d)), "n_tested", "n_reidentified", "mean_similarity", "reid_rate", *[f"{k}_{b}" for b in reid.BUCKETS for k in ("n", "rate")])


@query("normalised_vectors", """SELECT CAST(vec_id AS BIGINT) AS vec_id, round(sqrt(list_dot_product(v, v)), 6) AS length, round(v[1], 6) AS first FROM (
  SELECT vec_id, CASE WHEN n > 0 THEN list_transform(e, lambda x: x / n) ELSE e END AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings) a) b""")
def normalised_vectors(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", g.normalised("embedding").alias("v"))
    return tidy(e.select("vec_id", g.norm("v").alias("length"), F.get("v", F.lit(0)).alias("first")))


_SEEN = f"SELECT video_id, frame_idx, grey FROM ({GREY}) x"
_TRUE_FACES = f"SELECT concat('v', CAST(frame_idx % {views.VIDEOS} AS STRING)) AS video_id, CAST(floor(frame_idx / {views.VIDEOS}) AS INT) AS frame_idx, class_name, ln, pk, sk FROM ({GT}) b"


@query("sampled_faces", f"""SELECT f.video_id, CAST(f.frame_idx AS BIGINT) AS frame_idx, CAST(f.frame_idx // 30 AS BIGINT) AS sample_idx, {', '.join(f'CAST(f.{c} AS BIGINT) AS {c}' for c in ('ln', 'pk', 'sk'))}, round(CAST(a.grey[1] AS DOUBLE), 6) AS before, round(CAST(b.grey[2] AS DOUBLE), 6) AS after
FROM ({_TRUE_FACES}) f JOIN ({_SEEN}) a ON a.video_id = f.video_id AND a.frame_idx = f.frame_idx JOIN ({_SEEN}) b ON b.video_id = f.video_id AND b.frame_idx = f.frame_idx WHERE f.class_name = 'face' AND f.frame_idx % 30 = 0""")
def sampled_faces(s: SparkSession, d: str) -> DataFrame:
    """Faces of the truth on sampled frames that both videos have, with what these frames hold."""
    seen = view(s, d, GREY)
    before = seen.select("video_id", "frame_idx", F.get("grey", F.lit(0)).cast("double").alias("before"))
    after = seen.select("video_id", "frame_idx", F.get("grey", F.lit(1)).cast("double").alias("after"))
    return tidy(reid.sampled_faces(view(s, d, _TRUE_FACES), before, after, 30), "video_id", "frame_idx", "sample_idx", "ln", "pk", "sk", "before", "after")


_PAIRED = f"SELECT concat('v', CAST(o_orderkey % {views.VIDEOS} AS STRING)) AS original_id, concat('v', CAST(o_orderkey % 5 AS STRING)) AS changed_id, CAST(o_orderkey % 90 AS INT) AS frame_idx, CAST(o_orderkey AS BIGINT) AS sample_id FROM orders"


@query("sample_pairs", f"""SELECT p.original_id, p.changed_id, CAST(p.frame_idx AS BIGINT) AS frame_idx, p.sample_id, round(CAST(a.grey[1] AS DOUBLE), 6) AS before, round(CAST(b.grey[1] AS DOUBLE), 6) AS after
FROM ({_PAIRED}) p JOIN ({_SEEN}) a ON a.video_id = p.original_id AND a.frame_idx = p.frame_idx JOIN ({_SEEN}) b ON b.video_id = p.changed_id AND b.frame_idx = p.frame_idx""")
def sample_pairs(s: SparkSession, d: str) -> DataFrame:
    """The frames before and after of a list of samples, without those that either video lacks."""
    seen = view(s, d, GREY).select("video_id", "frame_idx", F.get("grey", F.lit(0)).cast("double").alias("value"))
    pairs = pictures.sample_pairs(seen, seen, view(s, d, _PAIRED))
    return tidy(pairs.select("original_id", "changed_id", "frame_idx", "sample_id", F.col("before.value").alias("before"), F.col("after.value").alias("after")))


_PROBED = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 4 * 12 - 6 AS DOUBLE) END AS fps, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 1000 END AS frame_count FROM orders"


@query("video_metadata", f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, round(f, 6) AS fps, CAST(n AS BIGINT) AS frame_count, round(CASE WHEN f > 0 THEN CAST(n AS DOUBLE) / f ELSE CAST(0 AS DOUBLE) END, 6) AS duration_seconds FROM (SELECT o_orderkey, CASE WHEN coalesce(fps, 0) = 0 THEN CAST(30 AS DOUBLE) ELSE fps END AS f, coalesce(frame_count, 0) AS n FROM ({_PROBED}) p) q")
def video_metadata(s: SparkSession, d: str) -> DataFrame:
    """What a probe of containers leaves out, and their durations."""
    return tidy(files.metadata(view(s, d, _PROBED)), "o_orderkey", "fps", "frame_count", "duration_seconds")


# -- reports ----------------------------------------------------------------------------------------------------------------

_VALUES = ", ".join(f"CAST(round((100 - n % {7 + k}) / CAST(100 AS DOUBLE), 2) AS DOUBLE) AS {n}" for k, n in enumerate([c[0] for c in metrics.CHECKS if c[0] != "false_positive_rate"] + ["face_fpr", "text_fpr", "logo_fpr"]))
_RESULTS = f"SELECT 'v' || n AS video_id, {_VALUES} FROM (SELECT CAST(l_suppkey AS INT) AS n FROM lineitem GROUP BY l_suppkey) s"
_CHECK = " UNION ALL ".join(f"SELECT video_id, '{n}' AS check_name, round({v}, 6) AS value, CAST({t} AS DOUBLE) AS threshold, {v} {'>=' if up else '<='} CAST({t} AS DOUBLE) AS passed FROM r" for n, t, up in metrics.CHECKS for v in [n if n != "false_positive_rate" else "((face_fpr + text_fpr + logo_fpr) / 3)"])


@query("passes_assignment", f"WITH r AS ({_RESULTS}) {_CHECK}")
def passes_assignment(s: SparkSession, d: str) -> DataFrame:
    """The 13 checks of each result."""
    return tidy(metrics.checklist(view(s, d, _RESULTS)), "video_id", "check_name", "value", "threshold", "passed")


@query("mean_over_videos", f"WITH r AS ({_RESULTS}) SELECT {', '.join(f'round(avg({n}), 6) AS {n}' for n in ('temporal_consistency', 'ssim', 'reid_rate', 'face_fpr', 'text_fpr', 'logo_fpr'))} FROM r")
def mean_over_videos(s: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.macro(view(s, d, _RESULTS), ("temporal_consistency", "ssim", "reid_rate", "face_fpr", "text_fpr", "logo_fpr")))


_COUNTED = "SELECT concat('v', CAST(l_suppkey AS STRING)) AS video_id, CASE l_returnflag WHEN 'A' THEN 'face' ELSE 'text' END AS class_name, CAST(sum(l_linenumber) AS BIGINT) AS tp, CAST(count(*) AS BIGINT) AS fp, CAST(max(l_linenumber) AS BIGINT) AS fn, round(avg(l_discount), 6) AS fpr FROM lineitem GROUP BY l_suppkey, CASE l_returnflag WHEN 'A' THEN 'face' ELSE 'text' END"


@query("aggregate_metrics", f"""WITH t AS (SELECT class_name, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(fpr) AS fpr, count(*) AS n_videos FROM ({_COUNTED}) c GROUP BY class_name),
m AS (SELECT avg(temporal_consistency) AS temporal_consistency, avg(ssim) AS ssim, avg(face_fpr) * 10 AS fps, avg(reid_rate) AS reid_rate FROM ({_RESULTS}) r),
z AS (SELECT c.class_name, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(fpr, 0) AS fpr, coalesce(n_videos, 0) AS n_videos FROM {_CLASSES} c LEFT JOIN t ON t.class_name = c.class_name),
rated AS (SELECT *, {_RATE('tp', 'tp + fn')} AS r, {_RATE('tp', 'tp + fp')} AS p FROM z)
SELECT class_name, {_BIG('tp', 'fp', 'fn', 'n_videos')}, round(r, 6) AS recall, round(p, 6) AS precision, round({_RATE('2 * p * r', 'p + r')}, 6) AS f1, round(fpr, 6) AS fpr,
  round(temporal_consistency, 6) AS temporal_consistency, round(ssim, 6) AS ssim, round(fps, 6) AS fps, round(reid_rate, 6) AS reid_rate FROM rated, m""")
def aggregate_metrics(s: SparkSession, d: str) -> DataFrame:
    """All videos as one result: a class that no video has counts 0."""
    means = view(s, d, _RESULTS).withColumn("fps", F.col("face_fpr") * 10)
    out = metrics.aggregate(view(s, d, _COUNTED), means)
    return tidy(out, "class_name", "tp", "fp", "fn", "n_videos", "recall", "precision", "f1", "fpr", "temporal_consistency", "ssim", "fps", "reid_rate")


@query("metric_display", f"WITH r AS ({_RESULTS}) SELECT video_id, printf('%.1f%%', face_recall * 100) AS shown, CASE WHEN face_recall >= 0.95 THEN 'pass' ELSE 'fail' END AS status FROM r")
def metric_display(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, _RESULTS).select("video_id", g.percent("face_recall").alias("shown"), g.status("face_recall", 0.95, True).alias("status"))


_TIMED = "SELECT event_type AS detector_set, value AS face_ms, value * 2 AS text_ms, value / 2 AS logo_ms FROM events"


@query("latency_summary", f"SELECT detector_set, count(*) AS n_frames, round(avg(face_ms), 6) AS face_ms, round(avg(text_ms), 6) AS text_ms, round(avg(face_ms) + avg(text_ms) + avg(logo_ms), 6) AS total_ms, round((avg(face_ms) + avg(text_ms) + avg(logo_ms)) / 5, 6) AS amortised_ms, round(1000 / nullif((avg(face_ms) + avg(text_ms) + avg(logo_ms)) / 5, 0), 6) AS fps_ceiling FROM ({_TIMED}) t GROUP BY detector_set")
def latency_summary(s: SparkSession, d: str) -> DataFrame:
    return tidy(metrics.latency(view(s, d, _TIMED), 5, ("detector_set",)), "detector_set", "n_frames", "face_ms", "text_ms", "total_ms", "amortised_ms", "fps_ceiling")


@query("throughput", "SELECT CAST(user_id AS BIGINT) AS user_id, count(*) AS n_frames, round(CASE WHEN sum(value) - 100 > 0 THEN count(*) / (sum(value) - 100) ELSE 0 END, 6) AS fps FROM events GROUP BY user_id")
def throughput(s: SparkSession, d: str) -> DataFrame:
    by = view(s, d, "SELECT user_id, count(*) AS n_frames, sum(value) - 100 AS seconds FROM events GROUP BY user_id")
    return tidy(by.withColumn("fps", metrics.throughput("n_frames", "seconds")), "user_id", "n_frames", "fps")


_CODES = "SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(828601953 + o_orderkey * 65537 AS BIGINT) AS code FROM orders"


@query("fourcc", f"SELECT k, coalesce(nullif(regexp_replace(chr(CAST(code & 255 AS INT)) || chr(CAST((code >> 8) & 255 AS INT)) || chr(CAST((code >> 16) & 255 AS INT)) || chr(CAST((code >> 24) & 255 AS INT)), '[^\\x20-\\x7E]', '', 'g'), ''), 'unknown') AS codec FROM ({_CODES}) c")
def fourcc(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, _CODES).select("k", g.fourcc("code").alias("codec"))


_PATHS = "SELECT DISTINCT concat('/videos/', source, '/clip_', CAST(doc_id % 50 AS STRING), CASE WHEN doc_id % 3 = 0 THEN '.mp4' ELSE '.mkv' END) AS path FROM documents"


@query("output_path", f"SELECT path, 'outputs/anon_' || regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) || '.mp4' AS output FROM ({_PATHS}) p")
def output_paths(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, _PATHS).select("path", output_path("path").alias("output"))


@query("work_list", f"""WITH p AS (SELECT path, regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) AS stem FROM ({_PATHS}) p), a AS (SELECT DISTINCT stem, 'annotations/' || stem || '.json' AS annotation_path FROM p WHERE path LIKE '%.mp4')
SELECT p.path, a.annotation_path FROM p LEFT JOIN a ON a.stem = p.stem""")
def work_list(s: SparkSession, d: str) -> DataFrame:
    paths = view(s, d, _PATHS).withColumn("stem", stem("path"))
    a = paths.where("path LIKE '%.mp4'").select("stem", F.concat(F.lit("annotations/"), "stem", F.lit(".json")).alias("annotation_path")).distinct()
    return paths.join(a, "stem", "left").select("path", "annotation_path")


@query("synthetic_truth", f"SELECT video_id, CAST(frame_idx AS BIGINT) AS frame_idx, class_name, {_BIG('track_id', 'x1', 'y1', 'x2', 'y2')} FROM ({synthetic.truth_sql()}) t")
def synthetic_truth(s: SparkSession, d: str) -> DataFrame:
    return tidy(synthetic.truth(s))


@query("annotation_cap", f"SELECT {_BIG('frame_idx')}, class_name, {_BIG('ln', 'pk', 'sk')} FROM (SELECT *, dense_rank() OVER (ORDER BY frame_idx) AS n FROM ({GT}) x WHERE frame_idx % 3 = 0) y WHERE n <= 300")
def annotation_cap(s: SparkSession, d: str) -> DataFrame:
    """Annotations of every third frame, the first 300 of them: the cap is the feature."""
    kept = _gt(s, d).where(F.pmod("frame_idx", F.lit(3)) == 0)
    first = kept.select("video_id", "frame_idx").distinct().orderBy("frame_idx").limit(300)
    return tidy(kept.join(F.broadcast(first), ["video_id", "frame_idx"], "left_semi"), *_ID)


@query("processed_frames", f"SELECT {_BIG('frame_idx')}, class_name, {_BIG('ln', 'pk', 'sk')} FROM ({GT}) x WHERE EXISTS (SELECT 1 FROM ({PRED}) y WHERE y.frame_idx = x.frame_idx)")
def processed_frames(s: SparkSession, d: str) -> DataFrame:
    return tidy(_gt(s, d).join(_pred(s, d), "frame_idx", "left_semi"), *_ID)


@query("negative_frames", f"SELECT {_BIG('frame_idx')}, class_name, {_BIG('ln', 'pk', 'sk')} FROM ({PRED}) x WHERE NOT EXISTS (SELECT 1 FROM ({GT}) y WHERE y.frame_idx = x.frame_idx AND y.class_name = x.class_name)")
def negative_frames(s: SparkSession, d: str) -> DataFrame:
    return tidy(_pred(s, d).join(_gt(s, d), ["frame_idx", "class_name"], "left_anti"), *_ID)
