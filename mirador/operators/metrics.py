"""Evaluation: matching to rates, false alarms, micro and macro averages, the checklist, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.config import CLASSES
from mirador.functions.geometry import rate
from mirador.operators.boxes import matched

#: The checklist of 13 thresholds (name, threshold, whether at least).
CHECKS = (
    ("face_recall", 0.95, True), ("text_recall", 0.90, True), ("logo_recall", 0.90, True),
    ("face_precision", 0.90, True), ("text_precision", 0.90, True), ("logo_precision", 0.90, True),
    ("face_f1", 0.92, True), ("text_f1", 0.90, True), ("logo_f1", 0.90, True),
    ("temporal_consistency", 0.98, True), ("ssim", 0.85, True), ("reid_rate", 0.02, False), ("false_positive_rate", 0.05, False),
)


def rates(counts: DataFrame) -> DataFrame:
    """recall, precision and f1 of tp, fp, fn; 0 where nothing was counted."""
    out = counts.withColumn("recall", rate("tp", F.col("tp") + F.col("fn"))).withColumn("precision", rate("tp", F.col("tp") + F.col("fp")))
    return out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def false_alarms(frames: DataFrame, predictions: DataFrame, truth: DataFrame, video: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """For each video and class: frames without truth (negative_frames), those of them with predictions, and their rate.

    Counts by subtraction: frames less frames with truth, so nothing is crossed with the classes but the videos.
    """
    key = [*video, "frame_idx", "class_name"]
    seen = predictions.select(*key).distinct().withColumn("_p", F.lit(1))
    real = truth.select(*key).distinct().withColumn("_t", F.lit(1))
    # truth beyond the processed frames doesn't count
    both = seen.join(real, key, "full").join(frames.select(*video, "frame_idx").distinct(), [*video, "frame_idx"], "left_semi")
    by = both.groupBy(*video, "class_name").agg(F.count("_t").alias("_with"), F.count_if(F.col("_t").isNull()).alias("false_alarm_frames"))
    total = frames.select(*video, "frame_idx").distinct().groupBy(*video).agg(F.count("*").alias("_all"))
    classes = total.select("*", F.explode(F.array(*map(F.lit, CLASSES))).alias("class_name"))
    out = classes.join(by, [*video, "class_name"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select(*video, "class_name", (F.col("_all") - n("_with")).alias("negative_frames"), n("false_alarm_frames").alias("false_alarm_frames"))
    return out.withColumn("fpr", rate("false_alarm_frames", "negative_frames"))


def detection_metrics(frames: DataFrame, predictions: DataFrame, truth: DataFrame, threshold: float = 0.5, video: tuple[str, ...] = ("video_id",), **order) -> DataFrame:
    """For each video and class: tp, fp, fn, recall, precision, f1, fpr and the counts behind them.

    All of it comes from one table of matched groups: a frame without truth but with predictions is a false alarm, and negative frames
    are all processed ones but those with truth. Truth beyond the processed frames doesn't count.
    """
    if threshold <= 0:
        raise ValueError("an overlap threshold lies above 0")
    processed = frames.select(*video, "frame_idx").distinct()
    groups = matched(predictions, truth, threshold, (*video, "frame_idx", "class_name"), **order)
    groups = groups.join(processed.withColumn("_in", F.lit(True)), [*video, "frame_idx"], "left")
    inside = lambda c, else_=0: F.sum(F.when(F.col("_in"), F.col(c)).otherwise(else_)).alias(c)
    sums = groups.groupBy(*video, "class_name").agg(
        inside("tp"), inside("fp", F.col("n_pred")), inside("fn"), F.count_if(F.col("_in") & (F.col("n_gt") > 0)).alias("_with"),
        F.count_if(F.col("_in") & (F.col("n_gt") == 0) & (F.col("n_pred") > 0)).alias("false_alarm_frames"),
    )
    total = processed.groupBy(*video).agg(F.count("*").alias("_all"))
    classes = total.select("*", F.explode(F.array(*map(F.lit, CLASSES))).alias("class_name"))
    out = classes.join(sums, [*video, "class_name"], "left").fillna(0, ["tp", "fp", "fn", "_with", "false_alarm_frames"])
    out = out.withColumn("negative_frames", F.col("_all") - F.col("_with")).drop("_all", "_with")
    return rates(out.withColumn("fpr", rate("false_alarm_frames", "negative_frames")))


def micro(by_video: DataFrame) -> DataFrame:
    """tp, fp, fn summed over videos, then rates; fpr as the plain mean, and that of videos with annotations alone."""
    sums = by_video.groupBy("class_name").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.avg("fpr").alias("fpr"),
        F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("fpr"))).alias("fpr_annotated_only"), F.count("*").alias("n_videos"),
    )
    return rates(sums)


#: What a result says of a video beside its classes, and its value where there are no videos. Similarity and consistency of nothing are whole.
MEANS = {"temporal_consistency": 1.0, "ssim": 1.0, "fps": 0.0, "reid_rate": 0.0}


def macro(results: DataFrame, columns: tuple[str, ...] = tuple(MEANS)) -> DataFrame:
    """One row: the plain mean over videos of each column that results have, null where it has none."""
    return results.agg(*[F.avg(c).alias(c) for c in columns])


def aggregate(by_video: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each class over all videos: counts summed before their rates, fpr as the mean of the videos', and the macro means of results
    beside them. Classes without rows count 0; without videos the means are those of MEANS."""
    means = macro(results).withColumn("class_name", F.explode(F.array(*map(F.lit, CLASSES))))
    # a row a class
    out = means.join(F.broadcast(micro(by_video)), "class_name", "left")
    return out.fillna(0, ["tp", "fp", "fn", "recall", "precision", "f1", "fpr", "n_videos"]).fillna(MEANS)


def nested(by_video: DataFrame) -> DataFrame:
    """One row a video, a struct for each class: the shape of the result files."""
    one = lambda c: F.max(F.when(F.col("class_name") == c, F.struct(*["recall", "precision", "f1", "fpr", "tp", "fp", "fn"]))).alias(c)
    return by_video.groupBy("video_id").agg(*[one(c) for c in CLASSES])


def checklist(results: DataFrame, key: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """(key, check_name, value, threshold, passed), 13 rows a row of results; its columns are the checks but the last, whose
    value is the mean of the classes' false-positive rates (face_fpr, text_fpr, logo_fpr)."""
    combined = (F.col("face_fpr") + F.col("text_fpr") + F.col("logo_fpr")) / 3
    value = lambda n: combined if n == "false_positive_rate" else F.col(n).cast("double")
    rows = [F.struct(F.lit(n).alias("check_name"), value(n).alias("value"), F.lit(t).alias("threshold"), F.when(F.lit(up), value(n) >= t).otherwise(value(n) <= t).alias("passed")) for n, t, up in CHECKS]
    return results.select(*key, F.explode(F.array(*rows)).alias("_r")).select(*key, "_r.*")


def latency(timings: DataFrame, every: int, group: tuple[str, ...] = ()) -> DataFrame:
    """Averages by detection frame of face_ms, text_ms, logo_ms, their total, its share a frame and the frames a second that allows."""
    n = F.greatest(F.count("*"), F.lit(1))
    by = timings.groupBy(*group).agg(F.count("*").alias("n_frames"), *[(F.coalesce(F.sum(c), F.lit(0.0)) / n).alias(c) for c in ("face_ms", "text_ms", "logo_ms")])
    by = by.withColumn("total_ms", F.col("face_ms") + F.col("text_ms") + F.col("logo_ms")).withColumn("amortised_ms", F.col("total_ms") / every)
    return by.withColumn("fps_ceiling", F.try_divide(F.lit(1000.0), F.col("amortised_ms")))


def throughput(n_frames, seconds):
    return F.when(F.col(seconds) > 0, F.col(n_frames) / F.col(seconds)).otherwise(0.0)
