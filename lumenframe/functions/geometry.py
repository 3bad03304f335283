"""Box algebra as column expressions.

A box is four columns: corners (x1, y1, x2, y2), or a centre and sides. Nulls make
results null; ``strict`` raises on malformed boxes instead.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Corner box."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, *names: str) -> Box:
        return cls(*(F.col(n).cast("double") for n in names))

    @classmethod
    def of_array(cls, array: Column, strict: bool = False) -> Box:
        well_formed = is_well_formed(array)
        checked = F.when(well_formed, array)
        if strict:
            checked = checked.otherwise(F.raise_error(F.lit("a box has exactly four numbers")).cast("array<double>"))
        return cls(*(F.get(checked, F.lit(k)).cast("double") for k in range(4)))

    def as_array(self) -> Column:
        return F.array(*self)


def is_well_formed(array: Column) -> Column:
    return F.coalesce((F.size(array) == 4) & F.forall(array, lambda x: x.isNotNull()), F.lit(False))


def _at_least_zero(value: Column) -> Column:
    """Null stays null: ``greatest`` alone would skip it."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))


def width(b: Box) -> Column:
    return _at_least_zero(b.x2 - b.x1)


def height(b: Box) -> Column:
    return _at_least_zero(b.y2 - b.y1)


def area(b: Box) -> Column:
    return width(b) * height(b)


def center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0


def diagonal(b: Box) -> Column:
    return F.sqrt(width(b) * width(b) + height(b) * height(b))


def corners_to_center(b: Box, image_width: Column, image_height: Column) -> Box:
    """Pixel corners to a normalised centre and sides; null for a frame without area."""
    w, h = _frame(image_width), _frame(image_height)
    x, y = center(b)
    return Box(x / w, y / h, (b.x2 - b.x1) / w, (b.y2 - b.y1) / h)


def center_to_corners(b: Box, image_width: Column, image_height: Column) -> Box:
    """Normalised centre (x1, y1) and sides (x2, y2) to pixel corners."""
    w, h = _frame(image_width), _frame(image_height)
    xc, yc, bw, bh = b.x1 * w, b.y1 * h, b.x2 * w, b.y2 * h
    return Box(xc - bw / 2.0, yc - bh / 2.0, xc + bw / 2.0, yc + bh / 2.0)


def _frame(side: Column) -> Column:
    return F.when(side > 0, side.cast("double"))


def convert(b: Box, source: str, target: str, image_width: Column, image_height: Column) -> Box:
    """Between ``voc`` (pixel corners) and ``yolo`` (normalised centre)."""
    a, z = source.strip().lower(), target.strip().lower()
    if not {a, z} <= {"voc", "yolo"}:
        raise ValueError(f"unknown box format: {source!r} or {target!r}")
    if a == z:
        return b
    return (corners_to_center if a == "voc" else center_to_corners)(b, image_width, image_height)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    absent = F.greatest(*[v.isNull() for v in (*a, *b)])
    return F.when(absent, F.lit(None)).when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def union_area(a: Box, b: Box) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Box, b: Box) -> Column:
    whole = union_area(a, b)
    return F.when(whole > 0, intersection(a, b) / whole).when(whole.isNotNull(), F.lit(0.0))


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    smaller = F.least(area(a), area(b))
    inside = intersection(a, b)
    return F.when(smaller > 0, inside / smaller).when(inside.isNotNull(), F.lit(0.0))


def intersects(a: Box, b: Box) -> Column:
    return intersection(a, b) > 0


def contains(outer: Box, inner: Box) -> Column:
    return (inner.x1 >= outer.x1) & (inner.y1 >= outer.y1) & (inner.x2 <= outer.x2) & (inner.y2 <= outer.y2)


def clip(b: Box, image_width: Column, image_height: Column) -> Box:
    def at(value: Column, most: Column) -> Column:
        return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(value, most.cast("double"))))

    return Box(at(b.x1, image_width), at(b.y1, image_height), at(b.x2, image_width), at(b.y2, image_height))


def inside_image(b: Box, image_width: Column, image_height: Column) -> Column:
    return (b.x1 >= 0) & (b.y1 >= 0) & (b.x2 <= image_width) & (b.y2 <= image_height)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def center_distance(a: Box, b: Box) -> Column:
    return distance(*center(a), *center(b))


def scale(b: Box, sx, sy) -> Box:
    return Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy)


def translate(b: Box, dx, dy) -> Box:
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)


def expand(b: Box, margin) -> Box:
    return Box(b.x1 - margin, b.y1 - margin, b.x2 + margin, b.y2 + margin)


def shrink(b: Box, margin) -> Box:
    return expand(b, -margin)


def is_valid_center_box(xc: Column, yc: Column, w: Column, h: Column) -> Column:
    ok = xc.between(0.0, 1.0) & yc.between(0.0, 1.0) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1)
    return F.coalesce(ok, F.lit(False))


def side_area(w: Column, h: Column) -> Column:
    """Area from sides; 0 if one is null."""
    return F.coalesce(w * h, F.lit(0.0))


def crop_bounds(b: Box, image_width: Column, image_height: Column, padding: float = 0.1) -> Box:
    """Pixel rectangle of a normalised centre box with padding, truncated and clamped."""
    w, h = image_width.cast("double"), image_height.cast("double")
    bw, bh = b.x2 * w * (1 + 2 * padding), b.y2 * h * (1 + 2 * padding)

    def at(value: Column, most: Column) -> Column:
        return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(value.cast("int"), most.cast("int"))))

    xc, yc = b.x1 * w, b.y1 * h
    return Box(at(xc - bw / 2, w), at(yc - bh / 2, h), at(xc + bw / 2, w), at(yc + bh / 2, h))
