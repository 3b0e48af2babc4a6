import numpy as np
import pandas as pd
import pytest
from mirador.config import Config
from mirador.functions import pixels
from mirador.operators import pictures
from mirador.operators.tracking import Tracker, assignment
from mirador.plans import pipeline
from mirador.plans.report import table
from mirador.sources import files
from mirador.streaming.smoothing import smoothed
from pyspark.sql import functions as F


def test_blur_and_fill():
    flat = np.full((16, 16, 3), 90, np.uint8)
    assert pixels.blur(flat, (2, 2, 14, 14)) and (flat == 90).all()
    image = np.random.default_rng(0).integers(0, 255, (32, 32, 3)).astype(np.uint8)
    out, left = pixels.redact(image, [("face", (4, 4, 20, 20)), ("text", (22, 22, 30, 30)), ("face", (0, 0, 2, 9))])
    assert left == 1
    mask = np.ones((32, 32), bool)
    mask[4:20, 4:20] = mask[22:30, 22:30] = False
    assert (out[mask] == image[mask]).all() and out[4:20, 4:20].std() < image[4:20, 4:20].std()
    assert len(np.unique(out[22:30, 22:30])) == 1
    assert pixels.border_luma(image, (0, 0, 32, 32)) == 128
    assert pixels.kernel_size(100, 100) == 51 and pixels.kernel_size(8, 30) == 7 and pixels.kernel_size(2, 9) == 1


def test_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (20, 24, 3)).astype(np.uint8)
    b = a.copy()
    b[5:9, 5:9] = 0
    assert pixels.ssim(a, a) == 1 and pixels.ssim(a, b) < 1 and pixels.ssim(a, b, [(1, 1, 13, 13)]) == 1
    assert pixels.ssim(a, b, [(0, 0, 24, 20)]) == 1 and pixels.ssim(a[:6], b[:6]) is None


def test_resize_and_gray():
    ramp = np.repeat(np.arange(0, 160, 10, dtype=np.uint8)[None, :, None], 8, 0).repeat(3, 2)
    small, scale = pixels.resize_longest(ramp, 8)
    assert small.shape == (4, 8, 3) and scale == 0.5 and (np.diff(small[0, :, 0].astype(int)) > 0).all()
    assert pixels.gray(np.full((1, 1, 3), 200, np.uint8))[0, 0] == 200 and pixels.crop(ramp, (3, 3, 3, 5)) is None
    assert pixels.crop(ramp, (0, 0, 8, 8)).shape == (112, 112, 3)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 2), (4, 4)):
        c = rng.random((n, m))
        got = sum(c[r, k] for r, k in assignment(c))
        small, big = (c, m) if n <= m else (c.T, n)
        assert abs(got - min(sum(small[r, k] for r, k in enumerate(p)) for p in permutations(range(big), min(n, m)))) < 1e-9


def test_tracker_scenes():
    steps = lambda tracker, frames: [tracker.update(np.array([b[:4] for b in f], float).reshape(-1, 4), np.array([b[4] for b in f])) for f in frames]
    moving = [[(10 + 2 * k, 10, 50 + 2 * k, 50, 0.9)] for k in range(6)]
    assert {i for f in steps(Tracker(0.45), moving) for i, _ in f} == {1}
    # a weak detection keeps a track alive, but starts none
    weak = moving[:3] + [[(*moving[3][0][:4], 0.2)]] + moving[4:]
    assert [len(f) for f in steps(Tracker(0.45), weak)] == [1] * 6
    assert steps(Tracker(0.45), [[(0, 0, 9, 9, 0.5)]] * 3) == [[], [], []]
    assert steps(Tracker(0.45, Config(activation_floor_bonus=0.0)), [[(0, 0, 9, 9, 0.5)]]) == [[(1, 0)]]
    # occluded for a while, then back
    hidden = moving[:3] + [[]] + moving[4:]
    assert [i for f in steps(Tracker(0.45), hidden) for i, _ in f] == [1] * 5


def clip(n=12):
    rng = np.random.default_rng(3)
    ground = rng.integers(0, 60, (48, 64, 3)).astype(np.uint8)
    out = []
    for k in range(n):
        image = ground + np.uint8(120 if k >= 8 else 0)
        image[10:26, 8 + k : 24 + k] = rng.integers(100, 255, (16, 16, 3))
        out.append(("v", k, 64, 48, image.tobytes()))
    return pd.DataFrame(out, columns=["video_id", "frame_idx", "width", "height", "bgr"])


def test_anonymise_and_evaluate(spark):
    class Failing:  # here, for workers can't import this module
        def detect(self, image, frame_idx):
            raise RuntimeError("no model")

    frames = spark.createDataFrame(clip(), "video_id string, frame_idx int, width int, height int, bgr binary")
    boxes = {k: [(8 + k, 10, 24 + k, 26, 0.9)] for k in range(12)}
    detectors = {"face": lambda: pictures.KnownBoxes(boxes), "text": Failing, "logo": lambda: pictures.KnownBoxes({0: [(40, 2, 60, 12, 0.5), (40, 2, 60, 12, 0.4)]})}
    config = Config(detect_every=2, sample_every=3)
    prepared = {r["frame_idx"]: r for r in pipeline.prepared(frames, config).collect()}
    assert [k for k, r in sorted(prepared.items()) if r["is_scene_cut"]] == [8] and prepared[11]["scene_id"] == 1
    redacted, found = pipeline.anonymise(frames, detectors, config)
    found = found.cache()
    by = {(r["class_name"], r["frame_idx"]) for r in found.collect()}
    assert {k for c, k in by if c == "face"} == set(range(12)) and {k for c, k in by if c == "logo"} == {0, 1} and not {k for c, k in by if c == "text"}
    pictures_out = redacted.collect()
    assert len(pictures_out) == 12 and all(r["unredacted"] == 0 for r in pictures_out)
    truth = spark.createDataFrame([("v", k, 1, "face", 8 + k, 10, 24 + k, 26) for k in range(12)], "video_id string, frame_idx int, gt_id int, class_name string, x1 int, y1 int, x2 int, y2 int")
    result = {r["class_name"]: r for r in pipeline.evaluate(frames, redacted, found, truth, config=config).collect()}
    assert result["face"]["recall"] == 1.0 and result["face"]["ssim"] > 0.9 and result["face"]["reid_rate"] is None and result["face"]["n_tested"] == 0
    assert "| face |" in table(spark.createDataFrame([("face", 0.5)], "class_name string, recall double"))


def test_stream_equals_batch(spark, tmp_path):
    schema = "video_id string, class_name string, track_id long, frame_idx long, x1 long, y1 long, x2 long, y2 long"
    rows = [("v", "face", 1, k, x, x, x, x) for k, x in ((0, 10), (1, 20), (2, 30), (4, 100))]
    spark.createDataFrame(rows[:2], schema).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    spark.createDataFrame(rows[2:], schema).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = smoothed(stream).writeStream.format("memory").queryName("smooth").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["frame_idx"]: r["x1"] for r in spark.table("smooth").collect()} == {0: 10, 1: 17, 2: 26, 4: 100}


def test_differences_across_runs(spark, monkeypatch):
    from mirador.operators import pictures

    monkeypatch.setattr(pictures, "RUN", 4)
    rng = np.random.default_rng(8)
    images = {("a", k): rng.integers(0, 255, (6, 5, 3), dtype=np.uint8) for k in range(11)} | {("b", k): rng.integers(0, 255, (6, 5, 3), dtype=np.uint8) for k in (0, 1, 3)}
    df = spark.createDataFrame([(v, k, 5, 6, x.tobytes()) for (v, k), x in images.items()], "video_id string, frame_idx int, width int, height int, bgr binary").repartition(3)
    got = {(r["video_id"], r["frame_idx"]): r["mad"] for r in pictures.differences(df).collect()}
    grey = {k: pixels.gray(x).astype(int) for k, x in images.items()}
    assert got.keys() == images.keys()
    for (v, k), mad in got.items():
        if (v, k - 1) in grey:
            assert mad == pytest.approx(np.abs(grey[v, k] - grey[v, k - 1]).mean())
        else:
            assert mad is None


def test_reid_end_to_end(spark):
    from mirador.operators import reid

    rng = np.random.default_rng(4)
    before = {k: rng.integers(0, 255, (80, 100, 3), dtype=np.uint8) for k in range(3)}
    after = {k: x.copy() for k, x in before.items()}
    after[0][10:60, 10:60] = 90  # redacted; in frame 1 the face is left
    pack = lambda images: spark.createDataFrame([("v", k, 100, 80, x.tobytes()) for k, x in images.items()], "video_id string, frame_idx int, width int, height int, bgr binary")
    truth = spark.createDataFrame(
        [("v", 0, "face", 10, 10, 60, 60), ("v", 1, "face", -5, 5, 60, 50), ("v", 1, "face", 0, 0, 10, 50), ("v", 1, "logo", 0, 0, 50, 50), ("v", 2, "face", 200, 0, 260, 50), ("v", 9, "face", 0, 0, 50, 50)],
        "video_id string, frame_idx int, class_name string, x1 int, y1 int, x2 int, y2 int",
    )
    got = reid.tested(truth, pack(before), pack(after), reid.GradientEmbedder)
    rows = {r["frame_idx"]: r for r in got.collect()}
    assert set(rows) == {0, 1} and rows[1]["is_reidentified"] and rows[1]["similarity"] == pytest.approx(1.0) and not rows[0]["is_reidentified"]
    s = reid.summary(got).first()
    assert (s["n_tested"], s["n_reidentified"], s["reid_rate"]) == (2, 1, 0.5)
    assert reid.summary(reid.tested(truth.limit(0), pack(before), pack(after), reid.GradientEmbedder)).first()["n_tested"] == 0


def test_sample_pictures(spark):
    schema = "video_id string, frame_idx int, width int, height int, bgr binary"
    frames = spark.createDataFrame(clip(4), schema)
    changed = frames.withColumn("video_id", F.lit("anon_v")).where("frame_idx <> 2")
    samples = spark.createDataFrame([("v", "anon_v", 1, "one"), ("v", "anon_v", 2, "no frame"), ("w", "anon_v", 1, "no video")], "original_id string, changed_id string, frame_idx int, label string")
    assert [r["label"] for r in pictures.sample_pairs(frames, changed, samples).collect()] == ["one"]
    (r,) = pictures.sample_pictures(frames, changed, samples, height=24).collect()
    image = np.frombuffer(r["bgr"], np.uint8).reshape(r["height"], r["width"], 3)
    assert image.shape == (24, 64, 3) and (image[:, :32] == image[:, 32:]).all()
    assert (pixels.flipped(pixels.flipped(image)) == image).all() and (pixels.flipped(image)[..., 0] == image[..., 2]).all()
    assert not pictures.sample_pictures(frames, changed, samples.limit(0)).collect()


def test_auto_annotate(spark):
    class Warm(pictures.KnownBoxes):  # here, for workers can't import this module
        warm = False

        def warmup(self):
            self.warm = True

        def detect(self, image, frame_idx):
            return super().detect(image, frame_idx) if self.warm else []

    frames = spark.createDataFrame(clip(), "video_id string, frame_idx int, width int, height int, bgr binary")
    faces = {k: [(8, 10, 24, 26, 0.26), (30, 10, 40, 26, 0.24)] for k in range(12)}
    found = pipeline.auto_annotate(frames, {"face": lambda: Warm(faces)}, every=3, most=3).collect()
    assert sorted(r["frame_idx"] for r in found) == [0, 3, 6] and {(r["x1"], r["class_name"], r["track_id"]) for r in found} == {(8, "face", None)}


def test_picture_files_and_pushed_frames(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"picture")
    (tmp_path / "b.png").write_bytes(b"")
    assert files.loaded(spark, [str(tmp_path / "a.png")]).first()["content"] == b"picture"
    for bad in ("b.png", "missing.png"):
        with pytest.raises(ValueError, match="unreadable picture"):
            files.loaded(spark, [str(tmp_path / bad)])
    files.write_pixels(spark.createDataFrame(clip(4), "video_id string, frame_idx int, width int, height int, bgr binary"), str(tmp_path / "frames"))
    one = files.read_pixels(spark, str(tmp_path / "frames")).where("video_id = 'v' AND frame_idx = 3")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(frame_idx,3)" in plan.split("PushedFilters")[1] and "(video_id" in plan.split("PartitionFilters")[1] and one.count() == 1


def test_written_results(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.9), ("b", 0.7)], "video_id string, ssim double")
    total = rows.agg(F.avg("ssim").alias("ssim"))
    files.write_results(rows, total, str(tmp_path / "two"))
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "two/results")).select("video_id", "ssim").collect()} == {("a", 0.9), ("b", 0.7)}
    assert spark.read.json(str(tmp_path / "two/aggregate")).first()["ssim"] == pytest.approx(0.8)
    files.write_results(rows.where("video_id = 'a'"), total, str(tmp_path / "one"))
    assert not (tmp_path / "one/aggregate").exists()
