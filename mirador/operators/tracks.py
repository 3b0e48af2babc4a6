"""Tracks over time: ages, islands, smoothing, counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("video_id", "scene_id", "class_name", "track_id")


def ages(tracks: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """birth_frame and age, from 1, since the last reset."""
    born = F.min("frame_idx").over(Window.partitionBy(*key))
    return tracks.withColumn("birth_frame", born).withColumn("age", F.col("frame_idx") - F.col("birth_frame") + 1)


def islands(tracks: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """island: a new one after any frame that the track misses, for then its state is gone."""
    return tracks.withColumn("island", F.col("frame_idx") - F.row_number().over(Window.partitionBy(*key).orderBy("frame_idx")))


def dead(tracks: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, frame_idx) of each frame at which a track of the frame before is missing: where state is evicted."""
    after = F.lead("frame_idx").over(Window.partitionBy(*key).orderBy("frame_idx"))
    gone = tracks.withColumn("_next", after).where(F.col("_next").isNull() | (F.col("_next") > F.col("frame_idx") + 1))
    return gone.select(*key, (F.col("frame_idx") + 1).alias("frame_idx"))


def smoothed(tracks: DataFrame, values: tuple[str, ...] = ("x1", "y1", "x2", "y2"), alpha: float = 0.7, key: tuple[str, ...] = KEY) -> DataFrame:
    """Exponential smoothing of each island, truncated to whole pixels at every frame; its state is the truncated value.

    That recurrence isn't linear, so no weighted window sum can stand for it: the rows of a track, sorted, pass by one after another
    and leave only the last one's values behind, whatever the length of the track.
    """
    rest = [c for c in tracks.columns if c not in key and c != "frame_idx"]
    whole = [F.col(c).cast("int").alias(c) if c in values else F.col(c) for c in rest]
    rows = tracks.select(*key, "frame_idx", *whole)
    n_keys, at = len(key), [rows.columns.index(v) for v in values]
    names = [*key, "island", "frame_idx", *rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, frame, seen, state = None, None, 0, [None] * len(at)
        for batch in batches:
            keys = zip(*[batch.column(k).to_pylist() for k in range(n_keys)], strict=True)
            out, islands_ = [[] for _ in at], []
            for own, now, *new in zip(keys, batch.column(n_keys).to_pylist(), *[batch.column(k).to_pylist() for k in at], strict=True):
                if own != track:
                    track, frame, seen = own, None, 0
                if frame is not None and now == frame + 1:
                    new = [None if x is None or s is None else int(alpha * x + (1 - alpha) * s) for x, s in zip(new, state, strict=True)]
                frame, state, seen = now, new, seen + 1
                islands_.append(now - seen)
                for o, x in zip(out, new, strict=True):
                    o.append(x)
            cols = list(batch.columns)
            for k, o in zip(at, out, strict=True):
                cols[k] = pa.array(o, pa.int32())
            yield pa.RecordBatch.from_arrays([*cols[:n_keys], pa.array(islands_, pa.int64()), *cols[n_keys:]], names)

    kinds = dict(rows.dtypes) | {"island": "bigint"}
    dealt = rows.repartition(*key).sortWithinPartitions(*key, "frame_idx")
    return dealt.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def active_counts(tracks: DataFrame, group: tuple[str, ...] = ("video_id", "frame_idx")) -> DataFrame:
    return tracks.groupBy(*group).agg(*[F.count_if(F.col("class_name") == c).alias(f"n_{c}") for c in ("face", "text", "logo")])


def consistency_by_track(tracks: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Distinct frames of a track over its span."""
    by = tracks.groupBy(*key).agg(F.count_distinct("frame_idx").alias("n_frames"), (F.max("frame_idx") - F.min("frame_idx") + 1).alias("span"))
    return by.withColumn("consistency", F.col("n_frames") / F.col("span"))


def temporal_consistency(tracks: DataFrame, group: tuple[str, ...] = (), key: tuple[str, ...] = KEY) -> DataFrame:
    """The mean over tracks; 1 if there are none."""
    by = consistency_by_track(tracks, key).groupBy(*group)
    return by.agg(F.coalesce(F.avg("consistency"), F.lit(1.0)).alias("temporal_consistency"), F.count("*").alias("n_tracks"))
