"""Boxes: structs of x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for v, n in zip((x, y, w, h), "xywh")])


def area(a: Column) -> Column:
    return F.greatest(a.w, F.lit(0.0)) * F.greatest(a.h, F.lit(0.0))


def common_area(a: Column, b: Column) -> Column:
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = common_area(a, b)
    return _share(both, area(a) + area(b) - both)


def containment(a: Column, b: Column) -> Column:
    """Common area as a share of the smaller box."""
    return _share(common_area(a, b), F.least(area(a), area(b)))


def share_inside(a: Column, b: Column) -> Column:
    """Common area as a share of ``a``."""
    return _share(common_area(a, b), area(a))


def united(a: Column, b: Column) -> Column:
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return box(x, y, F.greatest(a.x + a.w, b.x + b.w) - x, F.greatest(a.y + a.h, b.y + b.h) - y)


def padded(a: Column, pad: float, width: Column, height: Column) -> Column:
    """Grown on every side, held inside the viewport."""
    x, y = F.greatest(a.x - pad, F.lit(0.0)), F.greatest(a.y - pad, F.lit(0.0))
    right, bottom = F.least(a.x + a.w + pad, width), F.least(a.y + a.h + pad, height)
    return box(x, y, F.greatest(right - x, F.lit(0.0)), F.greatest(bottom - y, F.lit(0.0)))


def device_box(a: Column, dpr: Column, width: Column, height: Column) -> Column:
    """Device pixels that cover the box, held inside the image."""
    x, y = F.greatest(F.floor(a.x * dpr), F.lit(0)), F.greatest(F.floor(a.y * dpr), F.lit(0))
    right, bottom = F.least(F.ceil((a.x + a.w) * dpr), width), F.least(F.ceil((a.y + a.h) * dpr), height)
    return box(x, y, F.greatest(right - x, F.lit(0)), F.greatest(bottom - y, F.lit(0)))
