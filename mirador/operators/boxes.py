"""Detections: thresholds, union of detectors, greedy suppression and greedy matching within a frame.

Both greedy steps are folds over the few boxes of one frame and class, sorted by score with a deterministic tie-break; frames are
independent, so a frame's boxes meet by one equi-join and groups stay small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.config import CLASSES
from mirador.functions.geometry import box, degenerate, iou, iou_clamped, is_polygon, polygon_box


def confident(detections: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """A literal predicate by class, which the scan can take, instead of a join with the thresholds."""
    return detections.where(reduce(lambda a, b: a | b, [(F.col("class_name") == c) & (F.col("confidence") >= t) for c, t in thresholds.items()]))


def sound(detections: DataFrame) -> DataFrame:
    return detections.where(~degenerate(box()))


def from_polygons(detections: DataFrame, polygon: str = "polygon") -> DataFrame:
    """detections with the boxes of their polygons; malformed polygons go."""
    sound_ = detections.where(is_polygon(polygon))
    return sound_.withColumns(dict(zip(("x1", "y1", "x2", "y2"), polygon_box(polygon), strict=True))).drop(polygon)


def all_detectors(by_class: dict[str, DataFrame]) -> DataFrame:
    """Union in the fixed order face, text, logo, kept as detector_rank."""
    parts = [by_class[c].withColumn("detector_rank", F.lit(n)) for n, c in enumerate(CLASSES) if c in by_class]
    return reduce(DataFrame.unionByName, parts)


def suppressed(detections: DataFrame, threshold: float = 0.5, group: tuple[str, ...] = ("video_id", "frame_idx"), tie: tuple[str, ...] = ("det_id",)) -> DataFrame:
    """Greedy non-maximum suppression: by falling confidence, a box stays if it overlaps every box kept so far by less."""
    rest = [c for c in detections.columns if c not in group]
    order = F.struct((-F.col("confidence")).alias("_o"), *[F.col(t).alias(f"_t{k}") for k, t in enumerate(tie)], F.struct(*rest).alias("d"))
    grouped = detections.groupBy(*group).agg(F.array_sort(F.collect_list(order)).alias("_all"))
    corners = lambda s: tuple(s["d"][k] for k in ("x1", "y1", "x2", "y2"))
    kept = F.aggregate(
        "_all", F.slice("_all", 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda k: iou_clamped(corners(k), corners(x)) >= threshold), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return grouped.select(*group, F.explode(kept).alias("_k")).select(*group, "_k.d.*")


def matched(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5, group: tuple[str, ...] = ("video_id", "frame_idx", "class_name"), tie: tuple[str, ...] = ("det_id",), truth_order: tuple[str, ...] = ("gt_id",)) -> DataFrame:
    """tp, fp, fn of each group. By falling confidence each prediction takes the free truth that it overlaps most, the first of
    equals, if by the threshold at least. Truths are told apart by their place in their order, so ids may repeat.

    Each side is gathered once by group and the two meet in one join of equally partitioned rows; pairs exist only within a group's fold.
    """
    sides = ("x1", "y1", "x2", "y2")
    corners = lambda b: tuple(b[k] for k in sides)
    one = lambda *order: F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("order"), *sides)))
    p = predictions.groupBy(*group).agg(one((-F.col("confidence")).alias("_o"), *[F.col(t).alias(f"_t{k}") for k, t in enumerate(tie)]).alias("_p"))
    g = truth.groupBy(*group).agg(one(*[F.col(t).alias(f"_t{k}") for k, t in enumerate(truth_order)]).alias("_g"))

    def step(used, x):
        over = F.transform("_g", lambda t, n: F.struct((-iou(corners(x), corners(t))).alias("o"), n.alias("n")))
        free = F.array_sort(F.filter(over, lambda c: (c["o"] <= -threshold) & ~F.array_contains(used, c["n"])))
        return F.concat(used, F.transform(F.slice(free, 1, 1), lambda c: c["n"]))

    hits = F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), F.size(F.aggregate("_p", F.array().cast("array<int>"), step))).otherwise(0)
    both = p.join(g, list(group), "full").select(*group, hits.cast("long").alias("tp"), *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(k) for c, k in (("_p", "n_pred"), ("_g", "n_gt"))])
    return both.select(*group, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), "n_pred", "n_gt")


def prompted(by_prompt: list[DataFrame], threshold: float = 0.5, **order) -> DataFrame:
    """Detections of several prompts for one class as one set: their union, suppressed across prompts."""
    return suppressed(reduce(DataFrame.unionByName, by_prompt), threshold, **order)
