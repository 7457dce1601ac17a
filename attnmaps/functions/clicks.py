"""Column functions on click lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_KERNEL = 51


def parse_clicks(text) -> Column:
    """Click text of either form, ``[(1, 2), (3, 4)]`` or ``{"(1,2)","(3,4)"}``, as pairs."""
    xs = F.transform(F.regexp_extract_all(text, F.lit(r"\(\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*\)"), F.lit(1)), lambda v: v.cast("int"))
    ys = F.transform(F.regexp_extract_all(text, F.lit(r"\(\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*\)"), F.lit(2)), lambda v: v.cast("int"))
    return zip_clicks(xs, ys)


def zip_clicks(x: Column, y: Column) -> Column:
    """Pairs of coordinates, as many as the shorter list has; a null list is empty."""
    none = F.array().cast("array<int>")
    x, y = F.coalesce(x, none), F.coalesce(y, none)
    n = F.least(F.size(x), F.size(y))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda a, b: F.struct(a.alias("x"), b.alias("y")))


def normalise_mobile(flags: Column) -> Column:
    """First flag of a list, false if there is none."""
    return F.coalesce(F.get(flags, 0), F.lit(False))


def click_prefix(clicks, n) -> Column:
    """The first n clicks."""
    return F.slice(clicks, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def bin_features(clicks, div: int) -> Column:
    """Sets of visited coarse columns and rows, sorted."""
    part = lambda name: F.array_sort(F.array_distinct(F.transform(clicks, lambda c: F.floor(c[name] / div).cast("int"))))
    return F.struct(part("x").alias("cols"), part("y").alias("rows"))


def kernel_size(blur: int, width, height, image_shape: tuple[int, int], cap: int = MAX_KERNEL) -> Column:
    """Blur size scaled to an image's short side, rounded half to even, odd and capped.

    Without dimensions it is the blur size itself, made odd.
    """
    width, height = (F.col(c) if isinstance(c, str) else c for c in (width, height))
    scaled = F.bround(F.lit(float(blur)) * F.least(width, height) / min(image_shape), 0).cast("int")
    odd = F.when(scaled % 2 == 0, scaled + 1).otherwise(scaled)
    plain = blur + (blur % 2 == 0)
    return F.when(width.isNull() | height.isNull(), F.lit(plain)).otherwise(F.least(odd, F.lit(cap)))


def time_bins(n: Column, min_clicks: int, t: int) -> Column:
    """Cut points of one submission: t values from half its clicks to all, truncated."""
    low = F.greatest(F.floor(n / 2) * 0.1, F.lit(float(min_clicks)))
    return linspace(low, n.cast("double"), t)


def linspace(low: Column, high: Column, t: int) -> Column:
    """t evenly spaced values, truncated to whole numbers."""
    step = (high - low) / F.lit(float(max(1, t - 1)))
    last = t - 1
    return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda k: F.when(k == last, high).otherwise(low + k * step).cast("int"))


def count_bins(mean: Column, most: Column, t: int) -> Column:
    """Cut points of an image: half of them up to the mean click count, half up to the most."""
    m = mean.cast("int")
    return F.concat(linspace(m * 0.1, (m + 1).cast("double"), t // 2), linspace((m + 1).cast("double"), (most + 1).cast("double"), t // 2))
