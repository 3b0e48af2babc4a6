"""Annotation, result and video files as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.schemas import ANNOTATION_FILE, EVAL_RESULTS


def stem(path: str | Column) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(c, r"([^/]*?)(\.[^./]*)?$", 1)


def output_path(path: str | Column, folder: str = "outputs") -> Column:
    return F.concat(F.lit(f"{folder}/anon_"), stem(path), F.lit(".mp4"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth of JSON files, one a video, named by it; a file without a list has no boxes."""
    files = spark.read.schema(ANNOTATION_FILE).option("multiLine", True).json(path).select("*", stem("_metadata.file_name").alias("video_id"))
    rows = files.select("video_id", F.posexplode("annotations").alias("gt_id", "a"))
    corner = [F.try_element_at("a.bbox", F.lit(k + 1)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    return rows.select("video_id", "gt_id", F.col("a.frame_idx").alias("frame_idx"), *corner, F.col("a.class").alias("class_name"), F.col("a.track_id").alias("track_id"))


def write_annotations(truth: DataFrame, path: str) -> None:
    """A folder for each video with its boxes as one JSON object."""
    one = F.struct("frame_idx", F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col("class_name").alias("class"), "track_id")
    by = truth.groupBy("video_id").agg(F.array_sort(F.collect_list(one)).alias("annotations"))
    by.write.partitionBy("video_id").mode("overwrite").json(path)


def results(spark: SparkSession, path: str, labels: dict[str, str] | None = None) -> DataFrame:
    """Per-video results by their file names, with a display label (the stem where none is given); not the aggregate, not smoke tests."""
    rows = spark.read.schema(EVAL_RESULTS).json(path).withColumn("_stem", F.regexp_replace(stem("_metadata.file_name"), "_result$", ""))
    rows = rows.where(~F.col("_stem").isin("aggregate", "smoke_test"))
    names = F.create_map(*[F.lit(x) for kv in (labels or {"": ""}).items() for x in kv])
    return rows.withColumn("label", F.coalesce(F.try_element_at(names, F.col("_stem")), F.col("_stem"))).drop("_stem")


def write_results(results_: DataFrame, aggregate: DataFrame, path: str) -> None:
    """Results, one row a video, as JSON in a folder for each video below results; the aggregate beside them, if there are several."""
    results_.write.partitionBy("video_id").mode("overwrite").json(f"{path}/results")
    if len(results_.select("video_id").distinct().take(2)) > 1:
        aggregate.write.mode("overwrite").json(f"{path}/aggregate")


def metadata(probed: DataFrame) -> DataFrame:
    """Rows of a probe(fps, frame_count, ...) with the defaults of containers that say nothing: 30 frames a second, no frames; and their
    duration_seconds, 0 where the rate isn't above 0."""
    fps = F.when(F.coalesce(F.col("fps"), F.lit(0.0)) == 0, 30.0).otherwise(F.col("fps").cast("double"))
    rows = probed.withColumn("fps", fps).withColumn("frame_count", F.coalesce("frame_count", F.lit(0)))
    return rows.withColumn("duration_seconds", F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps")).otherwise(0.0))


def loaded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of the picture files of a list; a file that is missing or empty is an error. Spark's readers pass over empty files
    in silence, so these are looked for first."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for path in map(hadoop.Path, paths):
        fs = path.getFileSystem(conf)
        if not fs.exists(path) or not fs.getFileStatus(path).getLen():
            raise ValueError(f"unreadable picture: {path}")
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def work_list(videos: DataFrame, truths: DataFrame) -> DataFrame:
    """Videos by path, in order, with their annotation file by the same stem, null where there is none."""
    v = videos.select("path", stem("path").alias("stem"))
    t = truths.select(F.col("path").alias("annotation_path"), stem("path").alias("stem"))
    return v.join(t, "stem", "left").orderBy("path")


def listing(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "modificationTime", "length")


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_pixels(frames: DataFrame, path: str) -> None:
    """Frames by video, in order within each file and from file to file: what an encoder would read from front to back. Ranges of
    frames, not videos, are dealt to tasks."""
    frames.repartitionByRange("video_id", "frame_idx").sortWithinPartitions("video_id", "frame_idx").write.mode("overwrite").partitionBy("video_id").parquet(path)
