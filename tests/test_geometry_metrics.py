import random

import duckdb
import pytest

import __spark_entry__ as entry
from mirador.config import Config
from mirador.functions import geometry as g
from mirador.operators import boxes, frames, metrics, tracks
from mirador.sources import files, synthetic
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PLAIN = [k for k in entry.oracle_sql() if not (k.startswith("op") and k[2].isdigit()) and k != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "events", "embeddings", "orders", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", PLAIN)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    assert tidy(df.select(*cols).collect()) == tidy([[r[names.index(c)] for c in cols] for r in got.fetchall()])


def test_flagship_golden(spark):
    found = entry.queries()["detection_metrics"](spark, "/root/testdata/sf0.01").collect()
    assert {r["class_name"]: (r["tp"], r["fp"], r["fn"]) for r in found} == {"face": (14167, 2970, 2985), "logo": (14241, 2956, 2964), "text": (14110, 2966, 2935)}
    assert entry.entry(spark).count() == 3


def test_iou_properties(spark):
    rng = random.Random(1)
    rows = [tuple(v for _ in range(2) for x, y in [(rng.randrange(50), rng.randrange(50))] for v in (x, y, x + rng.randrange(1, 30), y + rng.randrange(1, 30))) for _ in range(300)]
    rows += [(0, 0, 4, 4, 4, 0, 8, 4), (0, 0, 4, 4, 0, 0, 4, 4), (3, 3, 1, 1, 0, 0, 5, 5)]
    df = spark.createDataFrame(rows, "x1 int, y1 int, x2 int, y2 int, bx1 int, by1 int, bx2 int, by2 int")
    a, b = g.box(), g.box("b")
    for r in df.select("*", g.iou(a, b).alias("ab"), g.iou(b, a).alias("ba"), g.iou(a, a).alias("aa"), g.iou_clamped(a, b).alias("c")).collect():
        if r["x2"] > r["x1"]:
            assert r["ab"] == r["ba"] == r["c"] and 0 <= r["ab"] <= 1 and r["aa"] == 1
    assert df.select(g.iou(a, b).alias("v")).collect()[300]["v"] == 0


def predictions(spark, every):
    """A perfect detector on every `every`-th frame, held, smoothed and widened."""
    truth = synthetic.truth(spark).withColumn("scene_id", F.lit(0))
    f = truth.select("video_id", "frame_idx").distinct().withColumn("is_scene_cut", F.lit(False))
    f = frames.gated(f, every)
    seen = truth.join(f.where("is_detection_frame").select("video_id", "frame_idx"), ["video_id", "frame_idx"])
    held = frames.hold_last(f, seen)
    smooth = tracks.smoothed(held.drop("gate_frame"))
    wide = g.expand(g.box(), 0.15, F.lit(synthetic.WIDTH), F.lit(synthetic.HEIGHT))
    return truth, f, smooth.select("video_id", "frame_idx", "class_name", "track_id", F.lit(1.0).alias("confidence"), *[c.alias(n) for c, n in zip(wide, ("x1", "y1", "x2", "y2"), strict=True)])


@pytest.mark.parametrize(("every", "want"), [(1, (120, 0, 0)), (5, (97, 23, 23)), (8, (71, 49, 49))])
def test_cctv_goldens(spark, every, want):
    truth, f, p = predictions(spark, every)
    found = metrics.detection_metrics(f, p, truth, tie=("track_id",), truth_order=("track_id",)).where("video_id = 'synth_cctv'").collect()
    by = {r["class_name"]: (r["tp"], r["fp"], r["fn"]) for r in found}
    assert by["face"] == want and by["text"] == (60, 0, 0) and by["logo"] == (0, 0, 0)


def test_matching_invariants_and_ties(spark):
    p = spark.createDataFrame([("v", 0, "face", 1, 0, 0, 10, 10, 0.9), ("v", 0, "face", 2, 0, 0, 10, 10, 0.9), ("v", 1, "face", 3, 0, 0, 10, 10, 0.5)], "video_id string, frame_idx int, class_name string, det_id long, x1 int, y1 int, x2 int, y2 int, confidence double")
    t = spark.createDataFrame([("v", 0, "face", 1, 0, 0, 10, 10), ("v", 2, "face", 1, 0, 0, 5, 5), ("v", 99, "face", 1, 0, 0, 5, 5)], "video_id string, frame_idx int, class_name string, gt_id int, x1 int, y1 int, x2 int, y2 int")
    f = spark.createDataFrame([("v", k) for k in range(4)], "video_id string, frame_idx int")
    r = {x["class_name"]: x for x in metrics.detection_metrics(f, p, t).collect()}
    assert (r["face"]["tp"], r["face"]["fp"], r["face"]["fn"], r["face"]["negative_frames"], r["face"]["false_alarm_frames"]) == (1, 2, 1, 2, 1)
    assert r["logo"]["recall"] == 0 and r["logo"]["negative_frames"] == 4
    with pytest.raises(ValueError, match="above 0"):
        metrics.detection_metrics(f, p, t, 0.0)
    kept = boxes.suppressed(p, 0.5)
    assert [(x["frame_idx"], x["det_id"]) for x in kept.orderBy("frame_idx").collect()] == [(0, 1), (1, 3)]
    assert boxes.suppressed(kept, 0.5).count() == 2


def test_hold_clears_on_an_empty_detection_frame(spark):
    f = spark.createDataFrame([("v", k, k % 2 == 0) for k in range(6)], "video_id string, frame_idx int, is_detection_frame boolean")
    t = spark.createDataFrame([("v", 0, 7), ("v", 4, 8)], "video_id string, frame_idx int, track_id int")
    assert sorted((r["frame_idx"], r["track_id"]) for r in frames.hold_last(f, t).collect()) == [(0, 7), (1, 7), (4, 8), (5, 8)]


def test_smoothing_truncates_and_restarts(spark):
    t = spark.createDataFrame([("v", 0, "face", 1, k, x, x) for k, x in ((0, 10), (1, 20), (2, 30), (4, 100))], "video_id string, scene_id int, class_name string, track_id int, frame_idx int, x1 int, y1 int")
    got = {r["frame_idx"]: r["x1"] for r in tracks.smoothed(t, ("x1", "y1")).collect()}
    assert got == {0: 10, 1: 17, 2: 26, 4: 100}


def test_config():
    assert Config().thresholds()["logo"] == 0.01 and Config.for_evaluation().thresholds()["logo"] == 0.30
    for bad in ({"match_iou": 0.0}, {"detect_every": 0}, {"ema_alpha": 2.0}, {"max_frames": -1}):
        with pytest.raises(ValueError, match="."):
            Config(**bad)
    assert "every 5" in Config().describe()


def test_annotation_files(spark, tmp_path):
    (tmp_path / "clip_a.json").write_text('{"annotations": [{"frame_idx": 3, "bbox": [1, 2, 3, 4], "class": "face", "track_id": null}]}')
    (tmp_path / "clip_b.json").write_text('{"annotations": []}')
    (tmp_path / "clip_c.json").write_text("{}")
    found = files.annotations(spark, str(tmp_path)).collect()
    assert [(r["video_id"], r["frame_idx"], r["x2"], r["class_name"], r["track_id"]) for r in found] == [("clip_a", 3, 3, "face", None)]
    names = spark.createDataFrame([("/x/a_1.mp4",), ("/x/b.mp4",)], "path string")
    notes = spark.createDataFrame([("/y/b.json",)], "path string")
    assert [(r["path"], r["annotation_path"]) for r in files.work_list(names, notes).collect()] == [("/x/a_1.mp4", None), ("/x/b.mp4", "/y/b.json")]
    assert names.select(files.output_path("path").alias("o")).first()["o"] == "outputs/anon_a_1.mp4"


def test_smoothing_by_a_loop(spark):
    """Long tracks in many islands against the recurrence, row by row."""
    rng = random.Random(9)
    rows = []
    for t in range(5):
        at = 0
        for _ in range(400):
            at += 1 if rng.random() < 0.9 else rng.randint(2, 4)
            rows.append(("v", 0, "face" if t else None, t % 2, at + 2000 * t, rng.randrange(-300, 300), rng.randrange(300), "kept"))
    df = spark.createDataFrame(rows, "video_id string, scene_id int, class_name string, track_id int, frame_idx int, x1 int, y1 int, name string").repartition(5)
    want, last = {}, {}
    for v, s, c, t, f, x, y, _ in sorted(rows, key=lambda r: (str(r[2]), r[3], r[4])):
        was = last.get((c, t))
        new = (x, y) if was is None or was[0] != f - 1 else tuple(int(0.7 * a + (1 - 0.7) * b) for a, b in zip((x, y), was[1], strict=True))
        last[(c, t)] = (f, new)
        want[(c, t, f)] = new
    got = tracks.smoothed(df, ("x1", "y1"))
    assert {(r["class_name"], r["track_id"], r["frame_idx"]): (r["x1"], r["y1"]) for r in got.collect()} == want
    by = {}
    for r in got.collect():
        by.setdefault((r["class_name"], r["track_id"], r["island"]), []).append(r["frame_idx"])
    assert all(max(f) - min(f) == len(f) - 1 for f in by.values()) and {r["name"] for r in got.collect()} == {"kept"}
    assert tracks.smoothed(df.limit(0), ("x1",)).count() == 0


def test_identical_truths_are_two(spark):
    p = spark.createDataFrame([("v", 0, "face", k, 0, 0, 10, 10, 0.9) for k in range(3)], "video_id string, frame_idx int, class_name string, det_id long, x1 int, y1 int, x2 int, y2 int, confidence double")
    t = spark.createDataFrame([("v", 0, "face", 1, 0, 0, 10, 10)] * 2, "video_id string, frame_idx int, class_name string, gt_id int, x1 int, y1 int, x2 int, y2 int")
    r = boxes.matched(p, t).first()
    assert (r["tp"], r["fp"], r["fn"], r["n_pred"], r["n_gt"]) == (2, 1, 0, 3, 2)
    r = boxes.matched(p, t.limit(0)).first()
    assert (r["tp"], r["fp"], r["fn"]) == (0, 3, 0)
    r = boxes.matched(p.limit(0), t).first()
    assert (r["tp"], r["fp"], r["fn"]) == (0, 0, 2)


def test_aggregate_of_nothing(spark):
    none = spark.createDataFrame([], "video_id string, class_name string, tp long, fp long, fn long, fpr double")
    means = spark.createDataFrame([], "temporal_consistency double, ssim double, fps double, reid_rate double")
    got = metrics.aggregate(none, means).collect()
    assert sorted(r["class_name"] for r in got) == ["face", "logo", "text"]
    assert all((r["tp"], r["recall"], r["temporal_consistency"], r["ssim"], r["fps"], r["reid_rate"], r["n_videos"]) == (0, 0.0, 1.0, 1.0, 0.0, 0.0, 0) for r in got)


def test_frame_queries_split_by_video(spark):
    for name in ("scene_cuts", "scene_segments", "sparse_gate", "hold_last"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name


def test_result_files(spark, tmp_path):
    for n in ("a_result", "aggregate_result", "smoke_test_result"):
        (tmp_path / f"{n}.json").write_text('{"temporal_consistency": 0.5, "face": {"recall": 1.0}}')
    assert [(r["label"], r["temporal_consistency"]) for r in files.results(spark, str(tmp_path), {"a": "Clip A"}).collect()] == [("Clip A", 0.5)]


def test_empty_inputs(spark):
    empty = tracks.temporal_consistency(spark.createDataFrame([], "video_id string, scene_id int, class_name string, track_id int, frame_idx int"))
    assert empty.first()["temporal_consistency"] == 1.0
    assert metrics.latency(spark.createDataFrame([], "face_ms double, text_ms double, logo_ms double"), 5).first()["fps_ceiling"] is None
    none = frames.first_frames(spark.createDataFrame([("v", 0)], "video_id string, frame_idx int"), 0)
    assert none.count() == 0


def test_checklist_report_holds_all_videos(spark):
    from mirador.plans import report

    rows = spark.range(1300).selectExpr("concat('v', lpad(id div 13, 3, '0')) AS video_id", "concat('c', lpad(id % 13, 2, '0')) AS check_name", "0.5D AS value", "0.4D AS threshold", "true AS passed")
    lines = report.checklist(rows.repartition(5)).split("\n")[2:]
    assert len(lines) == 1300 and lines == sorted(lines)
