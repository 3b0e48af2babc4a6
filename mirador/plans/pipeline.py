"""Anonymising and evaluating videos as one plan over all of them, keyed by video: no loop over videos or frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.config import Config
from mirador.functions.geometry import box, expand
from mirador.operators import frames as fr
from mirador.operators import metrics, pictures, reid
from mirador.operators import tracks as tr
from mirador.operators.pictures import Detector
from mirador.operators.tracking import tracked

#: The thresholds of proxy annotations.
ANNOTATION_THRESHOLDS = {"face": 0.25, "text": 0.30, "logo": 0.20}


def prepared(frame_pixels: DataFrame, config: Config) -> DataFrame:
    """Frames without pixels: scene cuts, scenes and the gate. Only numbers enter the windows."""
    limited = fr.first_frames(frame_pixels, config.max_frames)
    cut = fr.scenes(fr.cuts(pictures.differences(limited), config.scene_cut))
    size = limited.select("video_id", "frame_idx", "width", "height")
    return fr.gated(cut, config.detect_every).join(size, ["video_id", "frame_idx"])


def boxes_to_redact(frames: DataFrame, tracks: DataFrame, config: Config) -> DataFrame:
    """Held, smoothed and widened boxes of every frame."""
    key = ("video_id", "scene_id", "class_name", "track_id")
    held = fr.hold_last(frames, tracks.drop("scene_id")).join(frames.select("video_id", "frame_idx", "scene_id", "width", "height"), ["video_id", "frame_idx"])
    smooth = tr.smoothed(held.select(*key, "frame_idx", "x1", "y1", "x2", "y2", "confidence", "width", "height"), alpha=config.ema_alpha, key=key)
    wide = expand(box(), config.expand, "width", "height")
    return smooth.select(*key, "frame_idx", "confidence", *[c.cast("int").alias(n) for c, n in zip(wide, ("x1", "y1", "x2", "y2"), strict=True)])


def anonymise(frame_pixels: DataFrame, detectors: dict[str, Callable[[], Detector]], config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(redacted frames, the boxes redacted in them) of frames(video_id, frame_idx, width, height, bgr)."""
    config = config or Config()
    frames = prepared(frame_pixels, config)
    pixels = fr.first_frames(frame_pixels, config.max_frames).join(frames.select("video_id", "frame_idx", "is_detection_frame"), ["video_id", "frame_idx"])
    found = pictures.ensemble(pixels, detectors, config.thresholds(), config.nms_iou)
    boxes = boxes_to_redact(frames, tracked(found, frames, config), config)
    return pictures.redacted(pixels.drop("is_detection_frame"), boxes), boxes


def auto_annotate(frame_pixels: DataFrame, detectors: dict[str, Callable[[], Detector]], every: int = 3, most: int = 300) -> DataFrame:
    """Proxy ground truth(video_id, frame_idx, x1, y1, x2, y2, class_name, track_id): all that the detectors find at low thresholds on every
    `every`-th frame, `most` frames a video at most; no gate, no tracks."""
    frames = fr.sampled(fr.first_frames(frame_pixels, every * most), every).withColumn("is_detection_frame", F.lit(True))
    found = pictures.ensemble(frames, detectors, ANNOTATION_THRESHOLDS)
    return found.select("video_id", "frame_idx", "x1", "y1", "x2", "y2", "class_name", F.lit(None).cast("int").alias("track_id"))


def evaluate(frame_pixels: DataFrame, redacted: DataFrame, boxes: DataFrame, truth: DataFrame, faces: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """A row for each video and class: rates, and the video's temporal consistency, similarity outside boxes on sampled frames, and
    re-identification of faces(video_id, face_size_px, embedding_original, embedding_redacted), null where that wasn't run."""
    config = config or Config.for_evaluation()
    frames = fr.first_frames(frame_pixels, config.max_frames).select("video_id", "frame_idx")
    predictions = boxes.withColumn("det_id", F.col("track_id"))
    by_class = metrics.detection_metrics(frames, predictions, truth, config.match_iou, tie=("scene_id", "det_id"))
    steady = tr.temporal_consistency(boxes, ("video_id",))
    some = lambda df: fr.sampled(fr.first_frames(df, config.max_frames), config.sample_every)
    alike = pictures.mean_similarity(pictures.similarity(some(frame_pixels), some(redacted), some(boxes)), ("video_id",))
    out = by_class.join(steady, "video_id", "left").join(alike, "video_id", "left").fillna(1.0, ["temporal_consistency", "ssim"])
    if faces is None:
        return out.withColumn("reid_rate", F.lit(None).cast("double")).withColumn("n_tested", F.lit(0).cast("long"))
    tested = reid.summary(reid.compared(faces, config.reid_similarity, config.least_face), ("video_id",)).select("video_id", "reid_rate", "n_tested")
    return out.join(tested, "video_id", "left").fillna(0, ["n_tested"])
