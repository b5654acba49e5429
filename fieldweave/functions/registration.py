"""Column functions over what is read off a frame of the field: painted numbers, yard lines, and checks of a frame's projection.

Lines are array<struct<x1, y1, x2, y2>>, numbers are array<struct<value, x, y, confidence>>; a frame has some dozens of either.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels import placing
from .arrays import present
from .geometry import LENGTH, WIDTH, perspective

# The numbers painted on the field, how sure their reading must be, and what a frame may plausibly show.
PAINTED = (10, 20, 30, 40, 50)
LEAST_CONFIDENCE = 0.55
NUMBER_GAP = 0.28
SPAN_ALONG, SPAN_ACROSS, MARGIN = (5.0, 400.0), (3.0, 300.0), 20.0
PIXELS_PER_YARD, MOST_SKEW = (2.0, 60.0), 4.0
NUMBER_ROW = 12.0  # from a sideline to the painted numbers


def painted_number(read: Column, confidence: Column) -> Column:
    """The first of the painted numbers whose digits, forward or backward, are among those read; null if none is or the reading is unsure."""
    digits = F.regexp_replace(read, r"\D", "")
    found = F.coalesce(*[F.when(digits.contains(str(n)) | digits.contains(str(n)[::-1]), F.lit(n)) for n in PAINTED])
    return F.when(confidence >= LEAST_CONFIDENCE, found)


def credible_numbers(numbers: Column, width: Column, height: Column) -> Column:
    """Whether a frame's numbers can be the field's: one value at two places far apart, or three numbers of two values."""
    far = NUMBER_GAP * F.least(width, height)
    apart = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]) >= far
    twice = F.exists(numbers, lambda a: F.exists(numbers, lambda b: (a["value"] == b["value"]) & apart(a, b)))
    values = F.size(F.array_distinct(F.transform(numbers, lambda n: n["value"])))
    return F.coalesce((F.size(numbers) >= 2) & (twice | ((F.size(numbers) >= 3) & (values >= 2))), F.lit(False))


def line_places(lines: Column) -> Column:
    """How far each line's middle lies along the normal of the first line."""
    first = lines[0]
    dx, dy = first["x2"] - first["x1"], first["y2"] - first["y1"]
    length = F.nullif(F.hypot(dx, dy), F.lit(0.0))
    return F.transform(lines, lambda s: ((s["y1"] + s["y2"]) * dx - (s["x1"] + s["x2"]) * dy) / (2 * length))


def place_along(lines: Column, x: Column, y: Column) -> Column:
    """Where a point lies along the same normal."""
    first = lines[0]
    dx, dy = first["x2"] - first["x1"], first["y2"] - first["y1"]
    return (y * dx - x * dy) / F.nullif(F.hypot(dx, dy), F.lit(0.0))


def nearest_index(values: Column, target: Column) -> Column:
    """The number, from 0, of the value nearest to the target; of equally near ones the first."""
    return F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - target).alias("d"), i.alias("i"))))["i"]


def line_distance(line: Column, x: Column, y: Column) -> Column:
    """The distance of a point from the line through a segment."""
    dx, dy = line["x2"] - line["x1"], line["y2"] - line["y1"]
    return F.abs(dx * (y - line["y1"]) - dy * (x - line["x1"])) / F.greatest(F.hypot(dx, dy), F.lit(1e-9))


def nearest_line(lines: Column, x: Column, y: Column) -> Column:
    """The number, from 0, of the line nearest to a point."""
    return F.array_min(F.transform(lines, lambda s, i: F.struct(line_distance(s, x, y).alias("d"), i.alias("i"))))["i"]


def number_path(values: Column) -> Column:
    """The places along the field of painted numbers that are read one after another; null if they can't stand in that order.

    A number stands on either half of the field, 50 in its middle. Of the ways that never go back, the
    shortest one counts, of equal ones that which stays longest in the near half. A state is where the last
    number stands, with the best way to get there, so there are two for each number.
    """
    near, far = lambda v: 10.0 + v, lambda v: 110.0 - v
    state = "array<struct<went:double,picks:array<int>,way:array<double>>>"

    def on(states: Column, value: Column) -> Column:
        def arrive(at: Column, pick: int) -> Column:
            last = lambda s: F.element_at(s["way"], -1)
            open_ = F.filter(states, lambda s: (F.size(s["way"]) == 0) | (F.try_element_at(s["way"], F.lit(-1)) <= at))
            went = lambda s: F.when(F.size(s["way"]) == 0, 0.0).otherwise(s["went"] + at - last(s))
            return F.array_min(F.transform(open_, lambda s: F.struct(went(s).alias("went"), F.concat(s["picks"], F.array(F.lit(pick))).alias("picks"), F.concat(s["way"], F.array(at)).alias("way"))))

        return F.array_compact(F.array(arrive(near(value), 0), F.when(value != 50, arrive(far(value), 1)))).cast(state)

    none = F.array(F.struct(F.lit(0.0).alias("went"), F.array().cast("array<int>").alias("picks"), F.array().cast("array<double>").alias("way"))).cast(state)
    return F.array_min(F.aggregate(values, none, on))["way"]


def _pair(x: Column, y: Column, along: Column, across: Column) -> Column:
    return F.struct(x.alias("image_x"), y.alias("image_y"), along.alias("field_x"), across.alias("field_y"))


def line_pairs(lines: Column) -> Column:
    """Image and field points of yard lines clicked at both sidelines: array<struct<image_x, image_y, field_x, field_y>>.

    The lines are five units apart with their middle at midfield; where along the field they stand isn't known. The lines'
    common direction is the mean of their doubled angles, which doesn't care at which end a line begins;
    it points as the first line does. Null with fewer than two lines.
    """
    dx, dy = lambda s: s["x2"] - s["x1"], lambda s: s["y2"] - s["y1"]
    total = lambda f: F.aggregate(F.transform(lines, f), F.lit(0.0), lambda a, v: a + v)
    square = lambda s: F.greatest(dx(s) * dx(s) + dy(s) * dy(s), F.lit(1e-18))
    angle = F.atan2(total(lambda s: 2 * dx(s) * dy(s) / square(s)), total(lambda s: (dx(s) * dx(s) - dy(s) * dy(s)) / square(s))) / 2
    ahead = F.when(F.cos(angle) * dx(lines[0]) + F.sin(angle) * dy(lines[0]) < 0, -1.0).otherwise(1.0)
    cx, cy = ahead * F.cos(angle), ahead * F.sin(angle)
    ordered = F.array_sort(F.transform(lines, lambda s, i: F.struct(((s["y1"] + s["y2"]) * cx - (s["x1"] + s["x2"]) * cy).alias("place"), i.alias("i"), s.alias("s"))))
    last = F.size(lines) - 1

    def ends(row: Column, i: Column) -> Column:
        s, x = row["s"], 60.0 + 5.0 * (i - last / 2)
        turned = dx(s) * cx + dy(s) * cy < 0
        at = lambda a, b: F.when(turned, s[a]).otherwise(s[b])
        return F.array(_pair(at("x2", "x1"), at("y2", "y1"), x, F.lit(0.0)), _pair(at("x1", "x2"), at("y1", "y2"), x, F.lit(WIDTH)))

    return F.when(F.size(lines) >= 2, F.flatten(F.transform(ordered, ends)))


def number_pairs(numbers: Column) -> Column:
    """Image and field points of clicks on painted numbers of both rows, array<struct<value, x, y>>: as line_pairs, with known places.

    The clicks' main direction runs along the field; across it the rows part at the widest gap. Null if a
    value isn't painted, there are fewer than four, the rows are less than two pixels apart, or the numbers are
    in no order that the field has, read from left to right or back.
    """
    n = F.size(numbers)
    mean = lambda f: F.aggregate(F.transform(numbers, f), F.lit(0.0), lambda a, v: a + v) / n
    mx, my = mean(lambda p: p["x"]), mean(lambda p: p["y"])
    sxx, syy = mean(lambda p: (p["x"] - mx) * (p["x"] - mx)), mean(lambda p: (p["y"] - my) * (p["y"] - my))
    sxy = mean(lambda p: (p["x"] - mx) * (p["y"] - my))
    angle = F.atan2(2 * sxy, sxx - syy) / 2
    along = lambda p: p["x"] * F.cos(angle) + p["y"] * F.sin(angle)
    across = lambda p: p["y"] * F.cos(angle) - p["x"] * F.sin(angle)
    sides = F.array_sort(F.transform(numbers, across))
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct((F.get(sides, i) - F.get(sides, i - 1)).alias("gap"), (-i).alias("first"), F.get(sides, i).alias("split")))
    widest = F.array_max(gaps)
    row = F.array_sort(F.transform(numbers, lambda p, i: F.struct(along(p).alias("at"), i.alias("i"), p.alias("p"))))
    back = F.reverse(row)
    read = lambda r: number_path(F.transform(r, lambda s: s["p"]["value"]))
    placed = lambda r, way: F.zip_with(r, way, lambda s, x: F.struct(s["i"].alias("i"), _pair(s["p"]["x"], s["p"]["y"], x, F.when(across(s["p"]) < widest["split"], NUMBER_ROW).otherwise(WIDTH - NUMBER_ROW)).alias("pair")))
    pairs = F.coalesce(placed(row, read(row)), placed(back, read(back)))
    fits = (n >= 4) & F.forall(numbers, lambda p: F.coalesce(p["value"].isin(*PAINTED), F.lit(False))) & (widest["gap"] >= 2)
    return F.when(fits, F.transform(F.array_sort(pairs), lambda s: s["pair"]))


def _placed(n_lines: pd.Series, anchors: pd.Series) -> pd.DataFrame:
    found = [placing.placed(int(n), *(np.array([r[c] for r in a], float) for c in ("index", "value", "confidence"))) if a is not None and len(a) else ([], 0.0) for n, a in zip(n_lines, anchors)]
    return pd.DataFrame({"values": [v for v, _ in found], "score": [s for _, s in found]})


def numbered_lines(n_lines: Column, anchors: Column) -> Column:
    """struct(values, clear, score): where along the field each of n lines in order stands, five units from the next.

    anchors: array<struct<index, value, confidence>>, the line next to each number. Without numbers the
    lines are centred and not clear. What the numbers mean is found by a bounded search (kernels.placing).
    """
    best = F.pandas_udf(_placed, "struct<values:array<double>,score:double>")(n_lines, F.transform(anchors, lambda a: F.struct(a["index"].cast("double").alias("index"), a["value"].cast("double").alias("value"), a["confidence"].cast("double").alias("confidence"))))
    centred = F.transform(F.sequence(F.lit(0), n_lines - 1), lambda i: 60 + (i - (n_lines - 1) / 2) * 5)
    known = F.struct(best["values"].alias("values"), (best["score"] < 2).alias("clear"), best["score"].alias("score"))
    return F.when(F.size(anchors) > 0, known).otherwise(F.struct(centred.alias("values"), F.lit(False).alias("clear"), F.lit(0.0).alias("score")))


def registration_faults(matrix: Column, width: Column, height: Column) -> Column:
    """The reasons why a frame's projection is implausible; empty if it is not."""
    corners = [perspective(matrix, x, y) for x, y in ((F.lit(0.0), F.lit(0.0)), (width, F.lit(0.0)), (width, height), (F.lit(0.0), height))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    finite = F.lit(True)
    for c in (*xs, *ys):
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    minor = [(j, k) for j, k in ((1, 2), (0, 2), (0, 1))]
    det = sum(((-1) ** i * matrix[0][i] * (matrix[1][j] * matrix[2][k] - matrix[1][k] * matrix[2][j]) for i, (j, k) in enumerate(minor)), F.lit(0.0))
    span_x, span_y = F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)
    mx, my = width / 2, height / 2
    at = perspective(matrix, mx, my)

    def scale(x: Column, y: Column) -> Column:
        there = perspective(matrix, x, y)
        return F.hypot(there[0] - at[0], there[1] - at[1])

    steps = {"horizontal": scale(mx + 1, my), "vertical": scale(mx, my + 1)}
    reasons = [
        F.when(~span_x.between(*SPAN_ALONG), F.format_string("frame spans %.0f yd along the field", span_x)),
        F.when(~span_y.between(*SPAN_ACROSS), F.format_string("frame spans %.0f yd across the field", span_y)),
        F.when((F.greatest(*xs) < -MARGIN) | (F.least(*xs) > LENGTH + MARGIN), "frame projects entirely off the end of the field"),
        F.when((F.greatest(*ys) < -MARGIN) | (F.least(*ys) > WIDTH + MARGIN), "frame projects entirely off the side of the field"),
    ]
    for name, step in steps.items():
        degenerate = F.coalesce(step <= 0, F.lit(True)) | F.isnan(step)
        reasons.append(F.when(degenerate, f"{name} scale is degenerate").when(~(1 / step).between(*PIXELS_PER_YARD), F.format_string(f"{name} scale is %.1f px/yd", 1 / step)))
    a, b = steps.values()
    skew = F.greatest(a, b) / F.least(a, b)
    reasons.append(F.when((a > 0) & (b > 0) & (skew > MOST_SKEW), F.format_string("anisotropic scale ratio %.1f", skew)))
    flat = matrix[0][0] * matrix[1][1] - matrix[0][1] * matrix[1][0]
    reasons.append(F.when(F.coalesce(flat == 0, F.lit(True)) | F.isnan(flat), "degenerate linear part"))
    return F.when(F.coalesce(det == 0, F.lit(True)), F.array(F.lit("matrix is singular"))).when(~finite, F.array(F.lit("projection is not finite"))).otherwise(present(*reasons))
