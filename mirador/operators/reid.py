"""Re-identification: face vectors before and after redaction, compared and summed up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.functions import pixels
from mirador.functions.geometry import cosine, face_bucket, rate

BUCKETS = ("small", "medium", "large")


def compared(faces: DataFrame, similarity: float = 0.6, least: int = 20) -> DataFrame:
    """faces(face_size_px, embedding_original, embedding_redacted) of the least size and above, with similarity, flag and bucket."""
    kept = faces.where(F.col("face_size_px") >= least)
    out = kept.withColumn("similarity", cosine("embedding_original", "embedding_redacted"))
    return out.withColumn("is_reidentified", F.col("similarity") >= similarity).withColumn("bucket", face_bucket("face_size_px"))


def summary(faces: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates of compared faces; n_tested stands beside every rate, for a rate of none is 0 too."""
    hit = F.col("is_reidentified")
    by = faces.groupBy(*group).agg(
        F.count("*").alias("n_tested"), F.count_if(hit).alias("n_reidentified"), F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("mean_similarity"),
        *[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in BUCKETS], *[F.count_if((F.col("bucket") == b) & hit).alias(f"_{b}") for b in BUCKETS],
    )
    out = by.withColumn("reid_rate", rate("n_reidentified", "n_tested"))
    for b in BUCKETS:
        out = out.withColumn(f"rate_{b}", rate(f"_{b}", f"n_{b}")).drop(f"_{b}")
    return out


class Embedder(Protocol):
    """Turns a face of 112 x 112 BGR pixels into a vector. Made once a task by its factory; load models there."""

    def embed(self, face: np.ndarray) -> np.ndarray:
        """A vector of any length, the same for all faces."""


class GradientEmbedder:
    """Orientations of luma gradients in a grid of cells, normalised: deterministic and without a model, for tests and dry runs."""

    def __init__(self, cells: int = 7, directions: int = 8):
        self.cells, self.directions = cells, directions

    def embed(self, face: np.ndarray) -> np.ndarray:
        y = pixels.gray(face).astype(np.float64)
        dy, dx = np.gradient(y)
        kind = ((np.arctan2(dy, dx) / (2 * np.pi) % 1.0) * self.directions).astype(int) % self.directions
        row = np.arange(y.shape[0])[:, None] * self.cells // y.shape[0]
        cell = row * self.cells + (np.arange(y.shape[1]) * self.cells // y.shape[1])[None, :]
        v = np.bincount((cell * self.directions + kind).ravel(), weights=np.hypot(dx, dy).ravel(), minlength=self.cells**2 * self.directions)
        n = np.linalg.norm(v)
        return v / n if n else v


def embedded(faces: DataFrame, factory: Callable[[], Embedder]) -> DataFrame:
    """faces(video_id, frame_idx, x1, y1, x2, y2, width, height, bgr, changed) with face_size_px, the smaller side of the box, and the
    vectors of both crops, which are clamped to the frame; faces outside of it go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = None
        for rows in batches:
            out = []
            for r in rows.itertuples():
                box = (r.x1, r.y1, r.x2, r.y2)
                both = [pixels.crop(np.frombuffer(p, dtype=np.uint8).reshape(r.height, r.width, 3), box) for p in (r.bgr, r.changed)]
                if both[0] is not None and both[1] is not None:
                    embedder = embedder or factory()
                    out.append((r.video_id, r.frame_idx, *box, min(r.x2 - r.x1, r.y2 - r.y1), *[embedder.embed(c).tolist() for c in both]))
            yield pd.DataFrame(out, columns=names)

    names = ["video_id", "frame_idx", "x1", "y1", "x2", "y2", "face_size_px", "embedding_original", "embedding_redacted"]
    schema = "video_id string, frame_idx int, x1 int, y1 int, x2 int, y2 int, face_size_px int, embedding_original array<double>, embedding_redacted array<double>"
    return faces.mapInPandas(run, schema)


def tested(truth: DataFrame, original: DataFrame, redacted: DataFrame, factory: Callable[[], Embedder], every: int = 1, similarity: float = 0.6, least: int = 20) -> DataFrame:
    """The whole test on frames(video_id, frame_idx, width, height, bgr): faces of the truth that are large enough, cut out of the
    frames before and after redaction, embedded and compared. Small faces go before any pixels are joined."""
    large = truth.where(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= least)
    after = redacted.select("video_id", "frame_idx", F.col("bgr").alias("changed"))
    return compared(embedded(sampled_faces(large, original, after, every), factory), similarity, least)


def sampled_faces(truth: DataFrame, original: DataFrame, redacted: DataFrame, every: int = 30) -> DataFrame:
    """Faces of the truth on sampled frames, with both pictures' rows and the frame's number among the samples."""
    faces = truth.where((F.col("class_name") == "face") & (F.pmod(F.col("frame_idx"), F.lit(every)) == 0))
    faces = faces.withColumn("sample_idx", F.expr(f"frame_idx div {int(every)}"))
    return faces.join(original, ["video_id", "frame_idx"]).join(redacted, ["video_id", "frame_idx"])
