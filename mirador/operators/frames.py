"""Frames: the gate, scene cuts and scenes, sampling, limits, hold-last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirador.functions.geometry import mad


def _video(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy("frame_idx")


def timestamps(frames: DataFrame, fps: str = "fps") -> DataFrame:
    return frames.withColumn("timestamp_ms", F.col("frame_idx") / F.col(fps) * 1000)


def first_frames(frames: DataFrame, n: int | None) -> DataFrame:
    """The first n frames of each video: a filter, so that it reaches the scan; 0 gives none, None all."""
    return frames if n is None else frames.where(F.col("frame_idx") < n)


def sampled(frames: DataFrame, every: int = 30) -> DataFrame:
    return frames.where(F.pmod(F.col("frame_idx"), F.lit(every)) == 0)


def frame_count(n) -> Column:
    """Frames of a video by its container: unknown or negative counts are 0."""
    return F.greatest(F.coalesce(F.col(n) if isinstance(n, str) else n, F.lit(0)), F.lit(0))


def scene_cuts(frames: DataFrame, threshold: float = 30.0, grey: str = "grey", keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """mad and is_scene_cut: the mean absolute difference to the frame before is over the threshold; the first frame isn't a cut."""
    before = F.lag(grey).over(_video(keys))
    out = frames.withColumn("_before", before)
    return cuts(out.withColumn("mad", F.when(F.col("_before").isNotNull(), mad(grey, "_before"))).drop("_before"), threshold)


def cuts(frames: DataFrame, threshold: float = 30.0) -> DataFrame:
    """is_scene_cut of frames with mad, which is null for the first."""
    return frames.withColumn("is_scene_cut", F.coalesce(F.col("mad") > threshold, F.lit(False)))


def scenes(frames: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """scene_id: cuts up to and with this frame."""
    return frames.withColumn("scene_id", F.sum(F.col("is_scene_cut").cast("int")).over(_video(keys).rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def gate(every: int) -> Column:
    return (F.pmod(F.col("frame_idx"), F.lit(every)) == 0) | F.col("is_scene_cut")


def gated(frames: DataFrame, every: int = 5) -> DataFrame:
    return frames.withColumn("is_detection_frame", gate(every))


def hold_last(frames: DataFrame, tracks: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """The set of tracks of each frame: that of the last detection frame, replaced whole, even by an empty set.

    frames: keys, frame_idx, is_detection_frame. tracks: keys, frame_idx and what else they carry. Driven from the gate, not from
    track rows, so that a detection frame without detections clears the boxes.
    """
    at = F.max(F.when(F.col("is_detection_frame"), F.col("frame_idx"))).over(_video(keys).rowsBetween(Window.unboundedPreceding, 0))
    held = frames.select(*keys, "frame_idx", at.alias("gate_frame"))
    return held.join(tracks.withColumnRenamed("frame_idx", "gate_frame"), [*keys, "gate_frame"])
