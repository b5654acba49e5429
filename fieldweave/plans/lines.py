"""Families of parallel painted lines from the line segments found in a frame: a table of segments in, a table of lines out."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.folds import clustered
from ..operators.grouped import mapped_groups

Names = Sequence[str]

# How far directions of one family differ at most, in degrees, and how far apart pieces of one line may lie.
MOST_TURN = 8.0
LEAST_REACH, REACH_SHARE = 12.0, 0.03
_ARCS = 22  # equal arcs of the half circle, each a little longer than MOST_TURN


def line_families(segments: DataFrame, frame: Names, width: str, height: str) -> DataFrame:
    """The lines of each frame's best family: frame, line_no, x1, y1, x2, y2, offset, pieces and angle (degrees).

    segments: frame, segment_id, x1, y1, x2, y2 and the frame's size. Directions are on a circle of 180 degrees. Each observed direction
    makes a family of what is within MOST_TURN of it; along its normal, a piece joins the line before it if it lies within reach of that
    line's mean so far. A line goes to its pieces' outermost ends. The family with the greatest square of its number of lines times
    the median length of its pieces counts, of equal ones that of the first segment; frames without two parallel lines
    have none. Segments without a length don't count.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    angle = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))
    rows = segments.withColumns({"length": F.hypot(dx, dy), "angle": angle, "mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2}).filter("length > 0")
    arc = F.floor(F.col("angle") / (180.0 / _ARCS)).cast("int") % _ARCS
    rows = rows.withColumn("arc", arc)
    seeds = rows.select(*frame, F.col("segment_id").alias("seed"), F.col("angle").alias("turned"), F.explode(F.array(*[F.pmod(F.col("arc") + k, F.lit(_ARCS)) for k in (-1, 0, 1)])).alias("arc"))
    apart = F.abs(F.pmod(F.col("angle") - F.col("turned") + 90, F.lit(180.0)) - 90)
    family = seeds.join(rows, [*frame, "arc"]).filter(apart < MOST_TURN)
    c, s = F.cos(F.radians("turned")), F.sin(F.radians("turned"))
    along = lambda x, y: F.col(x) * c + F.col(y) * s
    reach = F.greatest(F.lit(LEAST_REACH), REACH_SHARE * F.hypot(F.col(width), F.col(height)))
    pieces = family.select(
        *frame, "seed", "segment_id", "turned", "length", "mx", "my", (F.col("my") * c - F.col("mx") * s).alias("offset"), reach.alias("reach"),
        F.least(along("x1", "y1"), along("x2", "y2")).alias("low"), F.greatest(along("x1", "y1"), along("x2", "y2")).alias("high"),
    )

    def lines(part: pa.Table) -> dict[str, pa.Array]:
        offset = part.column("offset").to_numpy()
        return {"line": pa.array(clustered(offset, part.column("reach")[0].as_py()).astype(np.int64)), "segment_id": part.column("segment_id").combine_chunks()}

    kind = dict(segments.dtypes)["segment_id"]
    numbered = mapped_groups(pieces, [*frame, "seed"], lines, f"line long, segment_id {kind}", order=["offset", "segment_id"])
    placed = pieces.join(numbered, [*frame, "seed", "segment_id"])
    merged = placed.groupBy(*frame, "seed", "turned", "line").agg(F.count("*").alias("pieces"), F.avg("mx").alias("ox"), F.avg("my").alias("oy"), F.min("low").alias("low"), F.max("high").alias("high"))
    scores = placed.groupBy(*frame, "seed").agg((F.pow(F.countDistinct("line"), F.lit(2)) * F.median("length")).alias("score"), F.countDistinct("line").alias("n")).filter("n >= 2")
    best = scores.groupBy(*frame).agg(F.min_by("seed", F.struct(-F.col("score"), "seed")).alias("seed"))
    chosen = merged.join(best, [*frame, "seed"])
    middle = along("ox", "oy")
    ends = {f"{v}{i}": F.col(f"o{v}") + (F.col(side) - middle) * way for i, side in ((1, "low"), (2, "high")) for v, way in (("x", c), ("y", s))}
    found = chosen.withColumns({**ends, "offset": F.col("oy") * c - F.col("ox") * s})
    number = F.row_number().over(Window.partitionBy(*frame).orderBy("offset")) - 1
    return found.select(*frame, number.alias("line_no"), "x1", "y1", "x2", "y2", "offset", "pieces", F.col("turned").alias("angle"))
