"""Column functions over coordinates, boxes, segments and 3x3 projective matrices (array<array<double>>)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH, WIDTH = 120.0, 160.0 / 3


def half_even(c: Column) -> Column:
    """Rounded to a whole number, halves to even ones."""
    return F.rint(c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def facing_right(x: Column, y: Column, direction: Column) -> tuple[Column, Column]:
    """Coordinates turned so that play goes to the right."""
    left = F.coalesce(F.lower(direction) == "left", F.lit(False))
    return F.when(left, LENGTH - x).otherwise(x), F.when(left, WIDTH - y).otherwise(y)


def flipped(x: Column, y: Column, flip_x: Column, flip_y: Column, shift_x: Column | None = None) -> tuple[Column, Column]:
    x = F.when(flip_x, LENGTH - x).otherwise(x)
    return (x if shift_x is None else x + shift_x), F.when(flip_y, WIDTH - y).otherwise(y)


def out_of_bounds(x: Column, y: Column) -> Column:
    """How far outside of the field a place is; 0 inside."""
    return F.greatest(-x, x - LENGTH, -y, y - WIDTH, F.lit(0.0))


def on_field(x: Column, y: Column, p95: Column) -> Column:
    """Within a margin that follows the calibration's error, of 3 to 8."""
    return out_of_bounds(x, y) <= F.least(F.lit(8.0), F.greatest(F.lit(3.0), p95))


def in_bounds(x: Column, y: Column) -> Column:
    return x.between(0, LENGTH) & y.between(0, WIDTH)


def _m(matrix: Column, i: int, j: int) -> Column:
    return matrix[i][j]


def perspective(matrix: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The place to which the matrix takes (x, y); null at infinity."""
    w = _m(matrix, 2, 0) * x + _m(matrix, 2, 1) * y + _m(matrix, 2, 2)
    w = F.nullif(w, F.lit(0.0))
    return (_m(matrix, 0, 0) * x + _m(matrix, 0, 1) * y + _m(matrix, 0, 2)) / w, (_m(matrix, 1, 0) * x + _m(matrix, 1, 1) * y + _m(matrix, 1, 2)) / w


def inverse3(matrix: Column) -> Column:
    """The inverse of a 3x3 matrix by cofactors; null if there is none."""
    m = [[_m(matrix, i, j) for j in range(3)] for i in range(3)]

    def cofactor(i: int, j: int) -> Column:
        a, b = [k for k in range(3) if k != i]
        c, d = [k for k in range(3) if k != j]
        value = m[a][c] * m[b][d] - m[a][d] * m[b][c]
        return -value if (i + j) % 2 else value

    det = F.nullif(sum((m[0][j] * cofactor(0, j) for j in range(1, 3)), m[0][0] * cofactor(0, 0)), F.lit(0.0))
    return F.when(det.isNotNull(), F.array(*[F.array(*[cofactor(j, i) / det for j in range(3)]) for i in range(3)]))


def product3(a: Column, b: Column) -> Column:
    return F.array(*[F.array(*[_m(a, i, 0) * _m(b, 0, j) + _m(a, i, 1) * _m(b, 1, j) + _m(a, i, 2) * _m(b, 2, j) for j in range(3)]) for i in range(3)])


def moved_along(matrix: Column, shift: Column) -> Column:
    """The matrix followed by a shift of its results along x."""
    move = F.array(F.array(F.lit(1.0), F.lit(0.0), shift.cast("double")), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return product3(move, matrix)


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2)."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = wide * high
    area = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(area > 0, both / area).otherwise(0.0)


def shape_change(a: Column, b: Column) -> Column:
    """The absolute logarithm of the ratio of two lengths."""
    return F.abs(F.log(a / b))


def gaussian_similarity(d: Column, tau: float) -> Column:
    """1 at distance 0, .05 at tau."""
    if tau <= 0:
        raise ValueError("tau must be positive")
    return F.exp(F.lit(math.log(0.05)) * d * d / (tau * tau))


def angle_between(a: Column, b: Column, period: float = 180.0) -> Column:
    """The distance of two angles on a circle of this period."""
    d = F.pmod(a - b, F.lit(period))
    return F.least(d, F.lit(period) - d)


def segment_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def segment_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """In degrees, of 0 to 180."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))


def phase_shift(candidates: Column, estimate: Column, most: float = 10.0, residual: float = 2.5, separation: float = 12.0, clear: float = 5.0) -> Column:
    """struct(shift, candidate, residual): whole five-unit steps from the estimate toward one of two candidates.

    The candidate of the smaller shift; null if none is within reach, if both are about as near, or if they
    are close together.
    """

    def option(candidate: Column) -> Column:
        shift = F.rint((candidate - estimate) / 5) * 5
        left = F.abs(candidate - estimate - shift)
        return F.struct(F.abs(shift).alias("size"), left.alias("residual"), candidate.alias("candidate"), shift.alias("shift"))

    options = F.array_sort(F.filter(F.transform(candidates, option), lambda o: (o["size"] <= most) & (o["residual"] <= residual)))
    first, second = F.get(options, F.lit(0)), F.get(options, F.lit(1))
    apart = F.abs(F.get(candidates, F.lit(0)) - F.get(candidates, F.lit(1))) >= separation
    alone = F.coalesce(second["size"] - first["size"] >= clear, F.lit(True))
    return F.when(apart & first.isNotNull() & alone, F.struct(first["shift"].alias("shift"), first["candidate"].alias("candidate"), first["residual"].alias("residual")))
