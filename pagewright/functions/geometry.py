"""Boxes as native column expressions: 32-bit edges, 64-bit arithmetic.

A box is four integer columns or a struct with left, top, right and bottom.
Edges are widened before any arithmetic; ``div`` truncates toward zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("left", "top", "right", "bottom")


class Box:
    """Four edge columns, widened to 64 bits."""

    def __init__(self, left, top, right, bottom):
        self.left, self.top, self.right, self.bottom = ((F.col(e) if isinstance(e, str) else e).cast("bigint") for e in (left, top, right, bottom))

    @classmethod
    def named(cls, prefix: str = "", suffix: str = "") -> Box:
        return cls(*(f"{prefix}{e}{suffix}" for e in EDGES))

    @classmethod
    def of(cls, struct: Column) -> Box:
        return cls(*(struct[e] for e in EDGES))

    @property
    def width(self) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), self.right - self.left)

    @property
    def height(self) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), self.bottom - self.top)

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def centre_x(self) -> Column:
        return half(self.left + self.right)

    @property
    def centre_y(self) -> Column:
        return half(self.top + self.bottom)

    def contains(self, x: Column, y: Column) -> Column:
        """Edges belong to the box."""
        return x.between(self.left, self.right) & y.between(self.top, self.bottom)


def half(x: Column) -> Column:
    """x / 2, truncated toward zero."""
    return F.call_function("div", x, F.lit(2).cast("bigint"))


def polygon_box(polygon: str = "polygon") -> Column:
    """Struct of the least and largest coordinates of a polygon; zeros if it has no point."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    edge = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return F.struct(edge(F.array_min(xs), "left"), edge(F.array_min(ys), "top"), edge(F.array_max(xs), "right"), edge(F.array_max(ys), "bottom"))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union as a 32-bit float; 0 for disjoint or empty boxes."""
    w = F.least(a.right, b.right) - F.greatest(a.left, b.left)
    h = F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top)
    shared = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0).cast("bigint"))
    union = a.area + b.area - shared
    return F.when((shared > 0) & (union > 0), shared.cast("double") / union).otherwise(F.lit(0.0)).cast("float")


def overlaps(a: Box, b: Box, threshold: float = 0.25) -> Column:
    """Either centre lies in the other box, or their IoU reaches the threshold."""
    return a.contains(b.centre_x, b.centre_y) | b.contains(a.centre_x, a.centre_y) | (iou(a, b) >= F.lit(threshold).cast("float"))


def clip(box: Box, width: Column, height: Column) -> Column:
    """The box clamped to a raster; all zeros if nothing is left."""
    into = lambda x, most: F.greatest(F.lit(0).cast("bigint"), F.least(x, most.cast("bigint")))
    l, r = into(box.left, width), into(box.right, width)  # noqa: E741
    t, b = into(box.top, height), into(box.bottom, height)
    some = (r > l) & (b > t)
    return F.struct(*(F.when(some, c).otherwise(F.lit(0)).cast("int").alias(n) for c, n in ((l, "left"), (t, "top"), (r, "right"), (b, "bottom"))))


def union_box(prefix: str = "") -> list[Column]:
    """Aggregates: the smallest box that holds all."""
    return [F.min(f"{prefix}left").alias("left"), F.min(f"{prefix}top").alias("top"), F.max(f"{prefix}right").alias("right"), F.max(f"{prefix}bottom").alias("bottom")]


def pixels(points: Column, dpi: int = 200) -> Column:
    """Points of 1/72 inch as pixels, rounded half away from zero."""
    return F.round(points * F.lit(float(dpi)) / F.lit(72.0)).cast("int")


def preview_scale(width: Column, height: Column, longest: int = 1100) -> Column:
    """Factor that brings the longer side down to ``longest``; 1 if it is not longer."""
    side = F.greatest(width, height)
    return F.when(side > longest, F.lit(float(longest)) / side).otherwise(F.lit(1.0))


def clamp32(x: Column) -> Column:
    """Into 0 to 2^31 - 1."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(x.cast("bigint"), F.lit(2147483647).cast("bigint"))).cast("int")


def page_local(box: Box, origin_x: Column, origin_y: Column, local: Column) -> Column:
    """A box in page coordinates; a box that is local already, or whose page is unknown, is kept."""
    dx = F.when(local, F.lit(0)).otherwise(F.coalesce(origin_x, F.lit(0))).cast("bigint")
    dy = F.when(local, F.lit(0)).otherwise(F.coalesce(origin_y, F.lit(0))).cast("bigint")
    return F.struct((box.left - dx).alias("left"), (box.top - dy).alias("top"), (box.right - dx).alias("right"), (box.bottom - dy).alias("bottom"))


def caret_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The box between two caret positions."""
    return F.struct(F.least(x1, x2).alias("left"), F.least(y1, y2).alias("top"), F.greatest(x1, x2).alias("right"), F.greatest(y1, y2).alias("bottom"))


def image_twips(px: Column, dpi: Column, known: Column) -> Column:
    """Page length in twips: the known one if positive, else from pixels and DPI."""
    return F.when(known > 0, known).when(dpi > 0, px * F.lit(1440.0) / dpi).otherwise(known)


def corners_box(points: Column, scale_x: Column, scale_y: Column, width: Column, height: Column) -> Column:
    """Box of eight corner coordinates x0, y0, ... x3, y3, rescaled, rounded and clamped to a crop."""
    at = lambda k: F.transform(F.filter(points, lambda _, i: i % 2 == k), lambda v: v)
    fit = lambda v, s, most: F.greatest(F.lit(0), F.least(F.round(v * s).cast("int"), most.cast("int")))
    xs, ys = at(0), at(1)
    return F.struct(
        fit(F.array_min(xs), scale_x, width).alias("left"), fit(F.array_min(ys), scale_y, height).alias("top"), fit(F.array_max(xs), scale_x, width).alias("right"), fit(F.array_max(ys), scale_y, height).alias("bottom")
    )
