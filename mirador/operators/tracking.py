"""Multi-object tracking after ByteTrack (Zhang et al., ECCV 2022), one group for each video, scene and class.

A scene cut resets tracking, so scenes are groups of their own: one video is tracked in parallel over its scenes. Within a group frames
follow one another: constant-velocity Kalman prediction, assignment of strong detections to tracks by overlap, then of weak ones to
what is left; unmatched strong ones start tracks, unmatched tracks are lost and dropped after a number of updates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.config import Config

SCHEMA = "video_id string, scene_id int, frame_idx int, class_name string, track_id long, x1 int, y1 int, x2 int, y2 int, confidence double, age int, frames_since_update int, is_confirmed boolean"


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost: shortest augmenting paths with potentials."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            free = ~used[1:]
            reduced = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inner = np.clip(high - low, 0, None).prod(axis=2)
    area = lambda x: (x[:, 2:] - x[:, :2]).prod(axis=1)
    return inner / np.maximum(area(a)[:, None] + area(b)[None, :] - inner, 1e-9)


class Kalman:
    """Centre, aspect ratio and height with their velocities."""

    def __init__(self, box: np.ndarray):
        self.x = np.concatenate([self._measure(box), np.zeros(4)])
        h = self.x[3]
        self.p = np.diag([h / 10, h / 10, 1e-2, h / 10, h / 16, h / 16, 1e-5, h / 16]) ** 2

    @staticmethod
    def _measure(b: np.ndarray) -> np.ndarray:
        w, h = max(b[2] - b[0], 1e-6), max(b[3] - b[1], 1e-6)
        return np.array([b[0] + w / 2, b[1] + h / 2, w / h, h])

    def predict(self) -> np.ndarray:
        f, h = np.eye(8) + np.eye(8, k=4), self.x[3]
        q = np.diag([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]) ** 2
        self.x, self.p = f @ self.x, f @ self.p @ f.T + q
        return self.box()

    def update(self, box: np.ndarray) -> None:
        g, h = np.eye(4, 8), self.x[3]
        s = g @ self.p @ g.T + np.diag([h / 20, h / 20, 1e-1, h / 20]) ** 2
        k = self.p @ g.T @ np.linalg.inv(s)
        self.x = self.x + k @ (self._measure(box) - g @ self.x)
        self.p = (np.eye(8) - k @ g) @ self.p

    def box(self) -> np.ndarray:
        w, h = self.x[2] * self.x[3], self.x[3]
        return np.array([self.x[0] - w / 2, self.x[1] - h / 2, self.x[0] + w / 2, self.x[1] + h / 2])


class Tracker:
    """State of one class in one scene. update() takes the detections of the next detection frame."""

    def __init__(self, threshold: float, config: Config | None = None):
        c = config or Config()
        self.threshold, self.floor, self.buffer, self.least = threshold, threshold + c.activation_floor_bonus, c.lost_buffer, 1 - c.track_iou
        self.tracks: list[dict] = []
        self.made, self.at = 0, 0

    def update(self, boxes: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
        """(track id, detection number) of this frame's tracks."""
        self.at += 1
        boxes = np.asarray(boxes, dtype=float).reshape(-1, 4)
        places = np.array([t["kalman"].predict() for t in self.tracks]).reshape(-1, 4)
        strong, weak = np.nonzero(scores >= self.threshold)[0], np.nonzero((scores > 0.1) & (scores < self.threshold))[0]
        found: list[tuple[int, int]] = []
        left = list(range(len(self.tracks)))
        for some, least in ((strong, self.least), (weak, 0.5)):
            # lost tracks come back by strong detections only
            open_ = [t for t in left if some is strong or self.tracks[t]["seen"] == self.at - 1]
            iou = overlaps(places[open_], boxes[some])
            for r, c in assignment(1 - iou):
                if iou[r, c] >= least:
                    t = open_[r]
                    self.tracks[t]["kalman"].update(boxes[some[c]])
                    self.tracks[t]["seen"] = self.at
                    found.append((self.tracks[t]["id"], int(some[c])))
                    left.remove(t)
        used = {d for _, d in found}
        for d in strong:
            if int(d) not in used and scores[d] >= self.floor:
                self.made += 1
                self.tracks.append({"id": self.made, "kalman": Kalman(boxes[d]), "seen": self.at})
                found.append((self.made, int(d)))
        self.tracks = [t for t in self.tracks if self.at - t["seen"] <= self.buffer]
        return sorted(found)


def _tracked(group: pd.DataFrame, config: Config) -> pd.DataFrame:
    group = group.sort_values(["frame_idx", "det_id"])
    name = group["class_name"].iloc[0]
    tracker = Tracker(config.thresholds()[name], config)
    born: dict[int, int] = {}
    out = []
    for frame, rows in group.groupby("frame_idx", sort=True):
        real = rows[rows["x1"].notna()]  # a detection frame without detections still lets tracks age
        boxes, scores = real[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float), real["confidence"].to_numpy(dtype=float)
        for track, d in tracker.update(boxes, scores):
            r = real.iloc[d]
            born.setdefault(track, frame)
            out.append((r["video_id"], r["scene_id"], frame, name, track, *(int(v) for v in boxes[d]), scores[d], frame - born[track] + 1, 0, True))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def tracked(detections: DataFrame, frames: DataFrame, config: Config | None = None) -> DataFrame:
    """Tracks of detections(video_id, frame_idx, det_id, class_name, box, confidence) on frames(video_id, frame_idx, scene_id,
    is_detection_frame). Faces and text are tracked; each logo is a track of its own, with an id from its frame and number."""
    config = config or Config()
    at = frames.where("is_detection_frame").select("video_id", "frame_idx", "scene_id")
    both = at.crossJoin(F.broadcast(frames.sparkSession.createDataFrame([("face",), ("text",)], "class_name string")))
    rest = detections.select("video_id", "frame_idx", "class_name", "det_id", *[F.col(k).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")], "confidence")
    rows = both.join(rest, ["video_id", "frame_idx", "class_name"], "left")
    followed = rows.groupBy("video_id", "scene_id", "class_name").applyInPandas(lambda g: _tracked(g, config), SCHEMA)
    return followed.unionByName(logo_tracks(detections, at))


def logo_tracks(detections: DataFrame, at: DataFrame) -> DataFrame:
    """Logos aren't followed: an id that is the same in every run, never an address, and never shared within a video."""
    logos = detections.where("class_name = 'logo'").join(at, ["video_id", "frame_idx"])
    return logos.select(
        "video_id", "scene_id", "frame_idx", "class_name", (F.col("frame_idx").cast("long") * 100_000 + F.col("det_id")).alias("track_id"),
        *[F.col(k).cast("int").alias(k) for k in ("x1", "y1", "x2", "y2")], F.col("confidence").cast("double").alias("confidence"),
        F.lit(1).alias("age"), F.lit(0).alias("frames_since_update"), F.lit(True).alias("is_confirmed"),
    )
