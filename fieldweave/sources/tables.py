"""Scans: delimited tracking files, event files, markup tables, artifact tables, manifests and documents.

Schemas are given, never inferred; ids stay text; null tokens and NaN become null here and nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..schemas import require_columns

# The names under which a tracking file may have each field.
ALIASES: Mapping[str, Sequence[str]] = {
    "game_id": ("game_id", "gameId"),
    "play_id": ("play_id", "playId"),
    "frame_id": ("frame_id", "frameId"),
    "player_id": ("nfl_id", "nflId"),
    "team": ("team", "club", "player_side"),
    "jersey_number": ("jersey_number", "jerseyNumber"),
    "x": ("x",),
    "y": ("y",),
    "speed": ("s", "speed"),
    "acceleration": ("a", "acceleration"),
    "direction": ("dir", "direction"),
    "orientation": ("o", "orientation"),
    "event": ("event",),
    "play_direction": ("play_direction", "playDirection"),
}
REQUIRED = ("game_id", "play_id", "frame_id", "x", "y")
WHOLE = ("frame_id", "jersey_number")
REAL = ("x", "y", "speed", "acceleration", "direction", "orientation")


def read_text_columns(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A delimited file with a header, all columns as text, without a byte order mark."""
    raw = spark.read.option("header", True).option("sep", separator).option("inferSchema", False).csv(path)
    return raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])


def resolved(raw: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str]) -> DataFrame:
    """One column for each field, from the first of its names that has a value in the row; fields without a column are null."""
    found: dict[str, Column] = {}
    for field, names in aliases.items():
        there = [text.null_tokens(F.col(f"`{n}`")) for n in names if n in raw.columns]
        if not there and field in required:
            raise ValueError(f"no column for {field}: any of {', '.join(names)}")
        found[field] = F.coalesce(*there) if there else F.lit(None).cast("string")
    return raw.select(*[c.alias(f) for f, c in found.items()])


def tracking_csv(spark: SparkSession, path: str) -> DataFrame:
    """A tracking file by the names it may use; numbers are cut toward zero where whole ones are asked for."""
    rows = resolved(read_text_columns(spark, path), ALIASES, REQUIRED)
    cast = {c: text.nullable_int(F.col(c)) for c in WHOLE} | {c: text.nan_to_null(F.col(c).try_cast("double")) for c in REAL}
    return rows.withColumns(cast)


PLAY_COLUMNS = ("game_id", "play_id", "qtr", "time", "posteam", "down", "ydstogo", "yrdln", "desc", "play_type", "qb_kneel", "qb_spike", "play_deleted")


def plays_parquet(spark: SparkSession, path: str, source_game: str, game_id: str) -> DataFrame:
    """One game's plays, numbered in the order of their ids; filter and columns reach the scan. Raises if there are none."""
    rows = spark.read.parquet(path).select(*PLAY_COLUMNS).filter(F.col("game_id") == source_game)
    described = rows.withColumn("desc", text.null_if_blank(F.col("desc"))).filter("desc is not null")
    if described.isEmpty():
        raise ValueError(f"no plays of {source_game}")
    eligible = text.eligible_by_flags(F.col("play_type"), F.col("play_deleted"), F.col("qb_kneel"), F.col("qb_spike"))
    return described.select(
        F.lit(game_id).alias("game_id"), F.row_number().over(Window.partitionBy("game_id").orderBy(F.col("play_id").cast("long"))).alias("ordinal"),
        F.col("qtr").cast("int").alias("quarter"), text.null_if_blank(F.col("time")).alias("clock"), text.null_if_blank(F.col("posteam")).alias("possession"), F.col("down").cast("int").alias("down"),
        F.col("ydstogo").cast("int").alias("distance"), text.null_if_blank(F.col("yrdln")).alias("yard_line"), F.col("desc").alias("description"), F.coalesce("play_type", F.lit("unknown")).alias("play_type"), eligible.alias("eligible"), F.col("play_id").cast("string").alias("source_row_id"),
    )


def html_rows(pages: DataFrame, keys: Sequence[str], html: str, table: str = r"play_by_play|pbp", skip: str = "thead") -> DataFrame:
    """Body rows of the first table of each page whose id matches: keys, row_no, row_id and cells (map from data-stat to text).

    Tables within comments count where no other matches. Rows outside of the table's body, if it has one, and
    those of the skipped class are left out. For markup written by programs: elements are found by patterns,
    not by a parser.
    """
    named = rf"(?is)<table\b[^>]*\bid\s*=\s*[\"'][^\"']*(?:{table})[^\"']*[\"'].*?</table>"
    first = lambda c: F.nullif(F.regexp_extract(c, named, 0), F.lit(""))
    found = F.coalesce(first(text.without_comments(F.col(html))), first(text.without_comment_marks(F.col(html))))
    bodies = F.regexp_extract_all("t", F.lit(r"(?is)<tbody\b[^>]*>(.*?)</tbody>"), F.lit(1))
    body = F.when(F.size(bodies) > 0, F.array_join(bodies, "")).otherwise(F.regexp_replace("t", r"(?is)<(thead|tfoot)\b.*?</\1>", ""))
    rows = pages.select(*keys, found.alias("t")).filter("t is not null").select(*keys, body.alias("t"))
    rows = rows.select(*keys, F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)(<tr\b.*?</tr>)"), F.lit(1))).alias("row_no", "r"))
    tag = F.regexp_extract("r", r"(?is)^<tr\b[^>]*>", 0)
    rows = rows.filter(~tag.rlike(rf"(?i)\bclass\s*=\s*[\"']([^\"']*\s)?{skip}(\s[^\"']*)?[\"']"))
    cell = r"(?is)<t[dh]\b[^>]*\bdata-stat\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</t[dh]>"
    names = F.regexp_extract_all("r", F.lit(cell), F.lit(1))
    texts = F.transform(F.regexp_extract_all("r", F.lit(cell), F.lit(2)), text.joined_text)
    # A name that comes twice keeps its last cell.
    pairs = F.arrays_zip(names.alias("k"), texts.alias("v"))
    placed = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i")))
    last = F.filter(placed, lambda p: ~F.exists(F.slice(names, p["i"] + 2, F.size(names)), lambda n: n == p["k"]))
    cells = F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"]))).alias("cells")
    row_id = F.nullif(F.regexp_extract(tag, r"(?i)\bid\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")).alias("row_id")
    return rows.select(*keys, "row_no", row_id, cells).filter(F.size("cells") > 0)


def html_plays(pages: DataFrame, game: str, html: str) -> DataFrame:
    """Plays of a play-by-play page: rows without a description go, then the quarter is carried on; the kind comes from the prose."""
    from ..operators.sequence import filled_forward

    cell = lambda *names: F.coalesce(*[F.nullif(F.col("cells")[n], F.lit("")) for n in names])
    rows = html_rows(pages, [game], html).withColumn("description", cell("detail", "description")).filter("description is not null")
    rows = rows.withColumn("quarter", filled_forward(text.first_int(cell("quarter")), [game], "row_no"))
    kind = text.play_type(F.col("description"))
    return rows.select(
        game, F.row_number().over(Window.partitionBy(game).orderBy("row_no")).alias("ordinal"), "quarter", cell("time", "game_time").alias("clock"), cell("team", "possession").alias("possession"),
        text.first_int(cell("down")).alias("down"), text.first_int(cell("yds_to_go", "distance")).alias("distance"), cell("location", "yard_line").alias("yard_line"), "description",
        kind.alias("play_type"), kind.isin("pass", "run").alias("eligible"), F.col("row_id").alias("source_row_id"),
    )


def pages_without_plays(pages: DataFrame, game: str, html: str) -> DataFrame:
    """Pages that lack a play-by-play table, to be refused by an import."""
    return pages.join(html_rows(pages, [game], html).select(game).distinct(), game, "left_anti").select(game)


def catalogue_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """A catalogue with ids as text; raises if a column is missing."""
    rows = read_text_columns(spark, path)
    require_columns(rows, required)
    return rows


def artifact(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """One kind of artifact of all clips, with old and new columns together."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    require_columns(rows, required)
    return rows


def manifest(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def every_kth_frame(frames: DataFrame, number: str, rate: float, wanted: float) -> DataFrame:
    """Frames sampled down to about the wanted rate."""
    return frames.filter(F.pmod(F.col(number), F.lit(max(1, round(rate / wanted)))) == 0)


def video_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths, times and sizes of media files; what decodes them is given to mapInPandas by the caller."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime", "length")


def best_variant(variants: DataFrame, keys: Sequence[str], width: str, height: str, bandwidth: str) -> DataFrame:
    """The variant of the most pixels, then of the greatest bandwidth."""
    w = Window.partitionBy(*keys).orderBy((F.col(width) * F.col(height)).desc(), F.col(bandwidth).desc())
    return variants.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def paired_examples(manifest: DataFrame, labels: DataFrame, keys: Sequence[str], rate: float = 10.0) -> DataFrame:
    """For each frame of each manifest entry all its label rows, in order; frames before the film's begin are left out."""
    at = F.col("snap_s") + (F.col("frame_id") - F.col("snap_frame")) / rate
    rows = manifest.join(labels, list(keys)).withColumn("video_timestamp", at).filter("video_timestamp >= 0")
    rest = [c for c in labels.columns if c not in keys and c != "frame_id"]
    return rows.groupBy(*keys, "frame_id", "video_timestamp").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("answers"))


class DecodeError(ValueError):
    """A frame that an example needs can't be decoded."""


def ordered_examples(examples: DataFrame, keys: Sequence[str], decode: Callable[[Row], object | None]) -> Iterator[tuple[Row, object]]:
    """(example, frame) in ascending order of keys and frame_id, one partition at a time on the driver.

    decode gives the frame of an example, or None if it can't, which raises.
    """
    for row in examples.orderBy(*keys, "frame_id").toLocalIterator(prefetchPartitions=True):
        frame = decode(row)
        if frame is None:
            raise DecodeError(f"decoding failed for {'/'.join(str(row[k]) for k in keys)} at {row['video_timestamp']:.3f}s")
        yield row, frame


def of_one_clip(rows: DataFrame, clip_id: str) -> DataFrame:
    """rows, which must all be of this clip; raises if there is another, or none."""
    found = {r[0] for r in rows.select("clip_id").distinct().limit(2).collect()}
    if found != {clip_id}:
        raise ValueError(f"the artifact is not of the clip {clip_id} alone")
    return rows

