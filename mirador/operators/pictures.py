"""Frames' pixels through numpy kernels: redaction, similarity, detectors. Filter first, then call: a Python function under a
false branch would run all the same. Pixels never enter a shuffle by class or track; a frame's boxes come to it as one array."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.functions import pixels
from mirador.functions.geometry import overlay, rescale
from mirador.operators.boxes import all_detectors, suppressed

#: Fixed order in which boxes of a frame are redacted.
RANK = {"face": 0, "text": 1, "logo": 2}


def _image(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 3)


def with_boxes(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """frames with boxes: the array of a frame's tracks in the order of redaction."""
    rank = F.when(F.col("class_name") == "face", 0).when(F.col("class_name") == "text", 1).otherwise(2)
    one = F.struct(rank.alias("rank"), F.col("track_id").cast("long").alias("track_id"), "class_name", *[F.col(k).cast("int").alias(k) for k in ("x1", "y1", "x2", "y2")])
    by = tracks.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(one)).alias("boxes"))
    return frames.join(by, ["video_id", "frame_idx"], "left")


def _boxes(value) -> list[tuple[str, tuple[int, int, int, int]]]:
    return [(b["class_name"], (b["x1"], b["y1"], b["x2"], b["y2"])) for b in (value if value is not None else [])]


def redacted(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """frame_pixels with redacted pixels and unredacted: boxes too small for a kernel, or outside the frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [pixels.redact(_image(r.bgr, r.width, r.height), _boxes(r.boxes)) for r in rows.itertuples()]
            yield rows[["video_id", "frame_idx", "width", "height"]].assign(bgr=[o[0].tobytes() for o in out], unredacted=[o[1] for o in out])

    return with_boxes(frames, tracks).mapInPandas(run, "video_id string, frame_idx int, width int, height int, bgr binary, unredacted int")


def similarity(original: DataFrame, changed: DataFrame, tracks: DataFrame) -> DataFrame:
    """(video_id, frame_idx, ssim) outside the tracks' boxes; null for frames that are too small."""
    other = changed.select("video_id", "frame_idx", F.col("bgr").alias("changed"))
    both = with_boxes(original, tracks).join(other, ["video_id", "frame_idx"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            s = [pixels.ssim(_image(r.bgr, r.width, r.height), _image(r.changed, r.width, r.height), [b for _, b in _boxes(r.boxes)]) for r in rows.itertuples()]
            yield rows[["video_id", "frame_idx"]].assign(ssim=pd.array(s, dtype="Float64"))

    return both.mapInPandas(run, "video_id string, frame_idx int, ssim double")


def sample_pairs(original: DataFrame, changed: DataFrame, samples: DataFrame) -> DataFrame:
    """samples(original_id, changed_id, frame_idx, ...) with other columns of their frames as struct `before` and `after`; a sample that lacks
    either frame is left out."""
    side = lambda frames, key, name: frames.select(F.col("video_id").alias(key), "frame_idx", F.struct(*[c for c in frames.columns if c not in ("video_id", "frame_idx")]).alias(name))
    return samples.join(side(original, "original_id", "before"), ["original_id", "frame_idx"]).join(side(changed, "changed_id", "after"), ["changed_id", "frame_idx"])


def sample_pictures(original: DataFrame, changed: DataFrame, samples: DataFrame, height: int = 360) -> DataFrame:
    """(original_id, changed_id, frame_idx, width, height, bgr): each sample's frames beside each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [pixels.side_by_side(*[_image(x["bgr"], x["width"], x["height"]) for x in (r.before, r.after)], height) for r in rows.itertuples()]
            yield rows[["original_id", "changed_id", "frame_idx"]].assign(width=[o.shape[1] for o in out], height=height, bgr=[o.tobytes() for o in out])

    slim = lambda frames: frames.select("video_id", "frame_idx", "width", "height", "bgr")
    pairs = sample_pairs(slim(original), slim(changed), samples.select("original_id", "changed_id", "frame_idx"))
    return pairs.mapInPandas(run, "original_id string, changed_id string, frame_idx int, width int, height int, bgr binary")


def mean_similarity(values: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    return values.groupBy(*group).agg(F.coalesce(F.avg("ssim"), F.lit(1.0)).alias("ssim"), F.count("ssim").alias("n_ssim"))


#: Frames of a video that one task compares with their neighbours.
RUN = 256


def differences(frames: DataFrame) -> DataFrame:
    """(video_id, frame_idx, mad): the mean absolute difference of each frame's luma to the frame before, null for the first frame.

    Luma is taken where the pixels lie, a byte a pixel. Runs of RUN frames are compared by a task each, with the last frame of the run
    before, so a long video is dealt out and only numbers leave. Frames are numbered without gaps; a frame whose predecessor
    is missing has none, and neither have frames of another size than their predecessor's.
    """

    def luma(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.to_pydict()
            grey = [pixels.gray(_image(*x)).astype(np.uint8).tobytes() for x in zip(r["bgr"], r["width"], r["height"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("frame_idx"), pa.array(grey, pa.binary())], ["video_id", "frame_idx", "grey"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, None
        for batch in batches:
            out = []
            for video, run, frame, grey in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3), strict=True):
                now = np.frombuffer(grey.as_buffer(), dtype=np.uint8).astype(np.int16)
                if frame // RUN == run:  # else it is here for the run after its own
                    near = at == (video, frame - 1) and len(last) == len(now)
                    out.append((video, frame, float(np.abs(now - last).mean()) if near else None))
                last, at = now, (video, frame)
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.float64()), strict=True)], ["video_id", "frame_idx", "mad"])

    grey = frames.select("video_id", "frame_idx", "width", "height", "bgr").mapInArrow(luma, "video_id string, frame_idx int, grey binary")
    own = F.floor(F.col("frame_idx") / RUN).cast("int")
    runs = F.when(F.pmod("frame_idx", F.lit(RUN)) == RUN - 1, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = grey.select("video_id", F.explode(runs).alias("run"), "frame_idx", "grey")
    dealt = dealt.repartition("video_id", "run").sortWithinPartitions("video_id", "run", "frame_idx")
    return dealt.mapInArrow(compare, "video_id string, frame_idx int, mad double")


class Detector(Protocol):
    """Finds boxes of one class. Made once a task by its factory, and if it has `warmup()`, that is called before the first frame."""

    def detect(self, image: np.ndarray, frame_idx: int) -> list[tuple[float, float, float, float, float]]:
        """(x1, y1, x2, y2, confidence) in pixels of the image."""


class OnnxDetector:
    """A model file whose output rows are x1, y1, x2, y2, confidence. Loaded on first use."""

    def __init__(self, path: str):
        self.path, self.session = path, None

    def warmup(self) -> None:
        import onnxruntime

        self.session = self.session or onnxruntime.InferenceSession(self.path)

    def detect(self, image: np.ndarray, frame_idx: int) -> list[tuple[float, float, float, float, float]]:
        self.warmup()
        x = image.astype(np.float32).transpose(2, 0, 1)[None] / 255.0
        return [tuple(map(float, r[:5])) for r in self.session.run(None, {self.session.get_inputs()[0].name: x})[0].reshape(-1, 5)]


class KnownBoxes:
    """Returns given boxes by frame: for tests, and for the upper bound that a perfect detector would reach."""

    def __init__(self, boxes: dict[int, list[tuple[float, float, float, float, float]]]):
        self.boxes = boxes

    def detect(self, image: np.ndarray, frame_idx: int) -> list[tuple[float, float, float, float, float]]:
        return self.boxes.get(frame_idx, [])


def detected(frames: DataFrame, class_name: str, factory: Callable[[], Detector], longest: int | None = None) -> DataFrame:
    """Detections of one class on frames that the gate has let through, and error: a detector that fails on a frame finds nothing
    there. Boxes are truncated to whole pixels; with `longest`, the frame is shrunk first and boxes are scaled back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = None
        for rows in batches:
            out = []
            for r in rows.itertuples():
                scale, found, error = 1.0, [], None
                try:
                    if detector is None:
                        made = factory()
                        getattr(made, "warmup", lambda: None)()
                        detector = made
                    image = _image(r.bgr, r.width, r.height)
                    if longest:
                        image, scale = pixels.resize_longest(image, longest)
                    found = detector.detect(image, r.frame_idx)
                except Exception:  # noqa: BLE001  one detector's failure must not end the others
                    error = traceback.format_exc(limit=1)
                out += [(r.video_id, r.frame_idx, n, class_name, *map(int, b[:4]), float(b[4]), scale, r.width, r.height, None) for n, b in enumerate(found)]
                if error:
                    out.append((r.video_id, r.frame_idx, None, class_name, None, None, None, None, None, scale, r.width, r.height, error))
            yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n in ("det_id", "x1", "y1", "x2", "y2")})

    names = ["video_id", "frame_idx", "det_id", "class_name", "x1", "y1", "x2", "y2", "confidence", "scale", "width", "height", "error"]
    schema = "video_id string, frame_idx int, det_id long, class_name string, x1 int, y1 int, x2 int, y2 int, confidence double, scale double, width int, height int, error string"
    return frames.mapInPandas(run, schema)


def ensemble(frames: DataFrame, factories: dict[str, Callable[[], Detector]], thresholds: dict[str, float], nms_iou: float = 0.5, longest: int = 1280) -> DataFrame:
    """All detections on gated frames: text only near the edges, logos from a shrunk frame, scaled back and suppressed; errors dropped."""
    gated = frames.where("is_detection_frame")
    by: dict[str, DataFrame] = {}
    for name, factory in factories.items():
        d = detected(gated, name, factory, longest if name == "logo" else None).where(F.col("error").isNull() & (F.col("confidence") >= thresholds[name]))
        corners = tuple(F.col(k) for k in ("x1", "y1", "x2", "y2"))
        if name == "text":
            d = d.where(overlay(corners, "width", "height") & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
        if name == "logo":
            d = d.select("video_id", "frame_idx", "det_id", "class_name", *[c.alias(k) for c, k in zip(rescale(corners, "scale"), ("x1", "y1", "x2", "y2"), strict=True)], "confidence")
            d = suppressed(d, nms_iou)
        by[name] = d.select("video_id", "frame_idx", "det_id", "class_name", "x1", "y1", "x2", "y2", "confidence")
    return all_detectors(by)
