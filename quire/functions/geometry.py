"""Boxes and intervals as arrays of numbers, computed within the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL_IMAGE = 0.002


def box(x0, y0, x1, y1) -> Column:
    return F.array(*(F.lit(v) if not isinstance(v, Column) else v for v in (x0, y0, x1, y1))).cast("array<double>")


def area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is 0."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = area(a) + area(b) - w * h
    return F.when(union == 0, 0.0).otherwise(w * h / union)


def normalised(b: Column, width: Column, height: Column) -> Column:
    return F.array(b[0] / width, b[1] / height, b[2] / width, b[3] / height)


def denormalised(b: Column, width: Column, height: Column) -> Column:
    return F.array(*((b[i] * (width, height)[i % 2]).cast("int") for i in range(4)))


def crop_bounds(b: Column, width: Column, height: Column) -> Column:
    """(left, top, right, bottom) in pixels of a box in [0, 1], clamped to the image."""
    p = denormalised(b, width, height)
    zero = F.lit(0)
    return F.array(F.greatest(zero, p[0]), F.greatest(zero, p[1]), F.least(width.cast("int"), p[2]), F.least(height.cast("int"), p[3]))


def flipped(b: Column, height: Column) -> Column:
    """Origin at the bottom left to origin at the top left."""
    return F.array(F.least(b[0], b[2]), height - F.greatest(b[1], b[3]), F.greatest(b[0], b[2]), height - F.least(b[1], b[3]))


def bounds_of(points: Column) -> Column:
    """The box around an array of (x, y) points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)).cast("array<int>")


def merged_length(intervals: Column) -> Column:
    """Total length covered by intervals (arrays of start and end); touching ones are one."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        gain = F.greatest(F.lit(0.0), x[1] - F.greatest(acc["end"], x[0]))
        return F.struct((acc["sum"] + gain).alias("sum"), F.greatest(acc["end"], x[1]).alias("end"))

    return F.aggregate(F.array_sort(intervals), start, step, lambda acc: acc["sum"])


def merged_intervals(intervals: Column) -> Column:
    """Intervals in order, overlapping and touching ones joined."""
    none = F.array().cast("array<array<double>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = last.isNotNull() & (x[0] <= last[1])
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(last[0], F.greatest(last[1], x[1]))))
        return F.when(joins, longer).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(intervals), none, step)


def union_area(boxes: Column) -> Column:
    """Area covered by boxes: between neighbouring x-coordinates, the y-extent that the boxes there cover. Corners may be swapped."""
    upright = F.transform(boxes, lambda b: F.array(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3])))
    ok = F.filter(upright, lambda b: (b[2] > b[0]) & (b[3] > b[1]))
    xs = F.array_sort(F.array_distinct(F.flatten(F.transform(ok, lambda b: F.array(b[0], b[2])))))
    strips = F.transform(xs, lambda x, i: F.struct(x.alias("x"), F.get(xs, i + 1).alias("next")))

    def strip(s: Column) -> Column:
        here = F.transform(F.filter(ok, lambda b: (b[0] <= s["x"]) & (b[2] >= s["next"])), lambda b: F.array(b[1], b[3]))
        return (s["next"] - s["x"]) * merged_length(here)

    return F.aggregate(F.filter(strips, lambda s: s["next"].isNotNull()), F.lit(0.0), lambda acc, s: acc + strip(s))


def cover_ratio(boxes: Column, width: Column, height: Column) -> Column:
    """Share of a page under images; those of at most a five-hundredth of the page don't count; 0 for a page without area."""
    page = width * height
    large = F.filter(boxes, lambda b: area(b) / page > SMALL_IMAGE)
    return F.when(page > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), union_area(large) / page))).otherwise(0.0)
