"""Boxes and rates as Column expressions: no UDFs, so predicates reach the scan and all stays in generated code.

Corners are absolute pixels. Python's int() truncates toward zero, and so does CAST in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + k) for k in ("x1", "y1", "x2", "y2"))


def rate(a, b, empty: float = 0.0) -> Column:
    """a / b; `empty` where nothing was counted."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(empty))


def area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def _inner(a, b) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def iou(a, b) -> Column:
    """Overlap of boxes by their raw areas; 0 if they are apart or touch."""
    inner = _inner(a, b)
    return F.when(inner > 0, rate(inner, area(a) + area(b) - inner)).otherwise(0.0)


def iou_clamped(a, b) -> Column:
    """The same with the areas of inverted boxes as 0."""
    zero = lambda x: F.greatest(x, F.lit(0))
    sides = lambda x: zero(x[2] - x[0]) * zero(x[3] - x[1])
    inner = _inner(a, b)
    return F.when(inner > 0, rate(inner, sides(a) + sides(b) - inner)).otherwise(0.0)


def clamp(b, width, height) -> tuple[Column, ...]:
    return F.greatest(F.lit(0), b[0]), F.greatest(F.lit(0), b[1]), F.least(_c(width), b[2]), F.least(_c(height), b[3])


def expand(b, share: float, width, height) -> tuple[Column, ...]:
    """A margin of half the share on each side, truncated, then clamped to the frame."""
    dx = ((b[2] - b[0]) * F.lit(share) / 2).cast("int")
    dy = ((b[3] - b[1]) * F.lit(share) / 2).cast("int")
    return clamp((b[0] - dx, b[1] - dy, b[2] + dx, b[3] + dy), width, height)


def degenerate(b) -> Column:
    return (b[2] <= b[0]) | (b[3] <= b[1])


def overlay(b, width, height) -> Column:
    """Text near the frame's edges: centre in the top 20 % or below 70 %, or all of it in a side margin of 8 %."""
    w, h, cy = _c(width), _c(height), (b[1] + b[3]) / 2.0
    return (cy < h * F.lit(0.20)) | (cy > h * F.lit(0.70)) | (b[2] < w * F.lit(0.08)) | (b[0] > w * F.lit(0.92))


def polygon_box(points) -> tuple[Column, ...]:
    """The truncated bounding box of array<array<number>>; null for a malformed polygon."""
    xs = F.transform(_c(points), lambda p: F.try_element_at(p, F.lit(1)))
    ys = F.transform(_c(points), lambda p: F.try_element_at(p, F.lit(2)))
    return tuple(x.cast("int") for x in (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def is_polygon(points) -> Column:
    """Whether there are points and each has both coordinates."""
    c = _c(points)
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda p: F.coalesce((F.size(p) >= 2) & F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull(), F.lit(False))), F.lit(False))


def resize_scale(width, height, longest: int) -> Column:
    side = F.greatest(_c(width), _c(height))
    return F.when(side > longest, F.lit(float(longest)) / side).otherwise(1.0)


def rescale(b, scale) -> tuple[Column, ...]:
    """Boxes found on a shrunk frame, back in its own pixels; a scale of 1 leaves them."""
    s = _c(scale)
    return tuple(F.when(s < 1, (x / s).cast("int")).otherwise(x.cast("int")) for x in b)


def kernel(width, height, most: int = 51) -> Column:
    """Odd, at most `most` and the smaller side, 1 at least: a kernel of 1 blurs nothing."""
    k = F.least(F.lit(most), _c(width), _c(height))
    return F.greatest(F.lit(1), k - (1 - F.pmod(k, F.lit(2))))


def feathered(width, height, feather: int = 3) -> Column:
    return (_c(height) > 2 * feather) & (_c(width) > 2 * feather)


def face_bucket(size) -> Column:
    s = _c(size)
    return F.when(s < 40, "small").when(s < 80, "medium").when(s < 10_000, "large")


def fourcc(code) -> Column:
    """Four little-endian bytes as characters, the printable ones of them; 'unknown' if there are none."""
    letters = [F.chr(F.shiftright(_c(code), 8 * k).bitwiseAND(F.lit(255))) for k in range(4)]
    return F.coalesce(F.nullif(F.regexp_replace(F.concat(*letters), r"[^\x20-\x7E]", ""), F.lit("")), F.lit("unknown"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)).otherwise(F.transform(_c(a), lambda x: x.cast("double")))


def cosine(a, b) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def mad(a, b) -> Column:
    """Mean absolute difference of two flat grey frames."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(_c(a))


def percent(v) -> Column:
    return F.format_string("%.1f%%", _c(v) * 100)


def status(v, threshold, at_least: bool) -> Column:
    return F.when((_c(v) >= threshold) if at_least else (_c(v) <= threshold), "pass").otherwise("fail")
