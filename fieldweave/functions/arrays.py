"""Column functions over arrays of numbers: profiles, sorted descriptors and their distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def top_padded(values: Column, n: int, fill: float = 0) -> Column:
    """The n largest, filled up with `fill`."""
    return F.slice(F.concat(F.sort_array(values, False), F.array_repeat(F.lit(fill), n)), 1, n)


def quantiles(values: Column, n: Column) -> Column:
    """n quantiles at equal steps of a sorted array, linear between its values; n is 1 or more."""
    size = F.size(values)

    def at(i: Column) -> Column:
        place = F.when(n > 1, i.cast("double") * (size - 1) / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0))
        low = F.floor(place).cast("int")
        part = place - low
        a, b = F.get(values, low), F.get(values, F.least(low + 1, size - 1))
        return a + (b - a) * part

    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), at)


def mean_abs_difference(a: Column, b: Column) -> Column:
    """Over the places that both have; null if there is none."""
    n = F.least(F.size(a), F.size(b))
    total = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, total / n)


def peak_scaled(a: Column) -> Column:
    peak = F.greatest(F.array_max(F.transform(a, F.abs)), F.lit(1.0))
    return F.transform(a, lambda x: x / peak)


def shape_distance(a: Column, b: Column, scaled: bool = False, most: int = 11) -> Column:
    """Mean distance of two sorted arrays after both are resampled to at most `most` quantiles; 0 if one is empty."""
    n = F.greatest(F.least(F.lit(most), F.size(a), F.size(b)), F.lit(1))
    left, right = quantiles(F.sort_array(a), n), quantiles(F.sort_array(b), n)
    if scaled:
        left, right = peak_scaled(left), peak_scaled(right)
    empty = (F.size(a) < 1) | (F.size(b) < 1)
    return F.when(empty, 0.0).otherwise(mean_abs_difference(left, right))


def profile_distance(a: Column, b: Column) -> Column:
    """Mean distance of two profiles, each scaled by its peak (1 at least); 2 if one is empty."""
    def scaled(v: Column) -> Column:
        peak = F.greatest(F.array_max(v), F.lit(1.0))
        return F.transform(v, lambda x: x / peak)

    return F.coalesce(mean_abs_difference(scaled(a), scaled(b)), F.lit(2.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def present(*flags: Column) -> Column:
    """The array of those that are not null, such as reasons made by when()."""
    return F.array_compact(F.array(*flags))


def running_ema(values: Column, keep: float) -> Column:
    """The exponential average of an array, begun at its first value; null for an empty one."""
    first = F.get(values, F.lit(0)).cast("double")
    return F.aggregate(values, first, lambda s, x: s * keep + x * (1 - keep))
