"""Settings of a run, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, replace

CLASSES = ("face", "text", "logo")


@dataclass(frozen=True)
class Config:
    """Defaults are those for anonymising; `for_evaluation` gives those of the evaluation entry point."""

    detect_every: int = 5
    face_confidence: float = 0.45
    text_confidence: float = 0.50
    logo_confidence: float = 0.01
    nms_iou: float = 0.5
    match_iou: float = 0.5
    lost_buffer: int = 30
    track_iou: float = 0.8
    #: A score must pass its class threshold by this much to start a track; 0 lets constant scores start one.
    activation_floor_bonus: float = 0.1
    ema_alpha: float = 0.7
    expand: float = 0.15
    kernel: int = 51
    sigma: float = 20.0
    feather: int = 3
    scene_cut: float = 30.0
    sample_every: int = 30
    reid_similarity: float = 0.6
    least_face: int = 20
    max_frames: int | None = None

    def __post_init__(self) -> None:
        if self.detect_every < 1 or self.sample_every < 1:
            raise ValueError("frames are taken every 1 or more")
        if not 0 < self.match_iou <= 1 or not 0 < self.nms_iou <= 1:
            raise ValueError("an overlap threshold lies above 0 and at most at 1")
        if not 0 < self.ema_alpha <= 1:
            raise ValueError("ema_alpha lies above 0 and at most at 1")
        if self.max_frames is not None and self.max_frames < 0:
            raise ValueError("max_frames can't be negative")

    @classmethod
    def for_evaluation(cls, **changes) -> Config:
        return replace(cls(logo_confidence=0.30), **changes)

    def thresholds(self) -> dict[str, float]:
        return dict(zip(CLASSES, (self.face_confidence, self.text_confidence, self.logo_confidence), strict=True))

    def describe(self) -> str:
        return f"every {self.detect_every} frames; thresholds {self.thresholds()}; EMA {self.ema_alpha}; margin {self.expand:.0%}"
