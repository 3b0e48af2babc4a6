"""Smoothing of tracks as a stream: state for each track, dropped when the track misses a frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "video_id string, class_name string, track_id long, frame_idx long, x1 long, y1 long, x2 long, y2 long"
STATE = "frame_idx long, x1 long, y1 long, x2 long, y2 long"
_SIDES = ["x1", "y1", "x2", "y2"]


def smoothed(tracks: DataFrame, alpha: float = 0.7) -> DataFrame:
    """The truncating moving average of a stream tracks(video_id, class_name, track_id, frame_idx, x1, y1, x2, y2), whose frames
    arrive in order from batch to batch. A gap of one frame starts anew, as in the batch operator; idle state times out."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("frame_idx").itertuples():
            new = [int(getattr(r, s)) for s in _SIDES]
            if last is not None and last[0] == r.frame_idx - 1:
                new = [int(alpha * n + (1 - alpha) * o) for n, o in zip(new, last[1:], strict=True)]
            last = (int(r.frame_idx), *new)
            out.append((*key, *last))
        state.update(last)
        state.setTimeoutDuration(600_000)
        yield pd.DataFrame(out, columns=["video_id", "class_name", "track_id", "frame_idx", *_SIDES])

    return tracks.groupBy("video_id", "class_name", "track_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
