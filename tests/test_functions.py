import pytest
from pyspark.sql import functions as F

from fieldweave.functions import arrays, geometry, text


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_play_types_follow_word_rules(spark):
    rows = spark.createDataFrame([("J.  Doe pass short",), ("X left tackle for 3",), ("Y punts? punt 40 yards",), ("QB kneels",), ("coin toss",)], "d string")
    assert [r[0] for r in rows.select(text.play_type(F.col("d"))).collect()] == ["pass", "run", "excluded", "administrative", "administrative"]


def test_filmed_events_and_categories(spark):
    rows = spark.createDataFrame([("Timeout #1", "pass"), ("punt return", "excluded"), ("kickoff", None), ("false start", "excluded"), ("run", "run"), (None, None)], "d string, k string")
    got = rows.select(text.is_filmed(F.col("d"), F.col("k")), text.event_category(F.col("d"), F.col("k"))).collect()
    assert [tuple(r) for r in got] == [(False, "pass"), (True, "punt"), (True, "kickoff"), (True, "no_play"), (True, "run"), (False, "unknown")]


@pytest.mark.parametrize("position, owner, want", [("BUF 25", "BUF", [35.0, 85.0]), ("LA 25", "BUF", [85.0, 35.0]), ("MID 50", "BUF", [60.0, 60.0]), (None, "BUF", None), ("BUF xx", "BUF", None), ("BUF 0", "BUF", None)])
def test_line_candidates(spark, position, owner, want):
    assert one(spark, text.line_candidates(F.lit(position).cast("string"), F.lit(owner)))[0] == want


def test_phase_shift(spark):
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    row = one(spark, geometry.phase_shift(pair(35.0, 85.0), F.lit(29.6)), geometry.phase_shift(pair(60.0, 60.0), F.lit(59.0)), geometry.phase_shift(pair(35.0, 85.0), F.lit(10.0)))
    assert row[0]["shift"] == 5.0 and row[0]["candidate"] == 35.0 and row[0]["residual"] == pytest.approx(0.4)
    assert row[1] is None and row[2] is None


def test_perspective_and_inverse(spark):
    m = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in ((0.1, 0, 10), (0, 0.2, 0), (0, 0, 1))])
    x, y = geometry.perspective(m, F.lit(50.0), F.lit(25.0))
    u, v = geometry.perspective(geometry.inverse3(m), x, y)
    moved = geometry.perspective(geometry.moved_along(m, F.lit(5.0)), F.lit(50.0), F.lit(25.0))
    row = one(spark, x, y, u, v, *moved)
    assert list(row) == pytest.approx([15, 5, 50, 25, 20, 5])


def test_scalars(spark):
    row = one(
        spark, geometry.half_even(F.lit(2.5)), geometry.gaussian_similarity(F.lit(2.5), 2.5), geometry.angle_between(F.lit(175.0), F.lit(5.0)), geometry.overlap([F.lit(v) for v in (0.0, 0.0, 2.0, 2.0)], [F.lit(v) for v in (1.0, 0.0, 3.0, 2.0)]),
        text.nullable_int(F.lit("1.9")), text.nullable_int(F.lit("NA")), text.trailing_number(F.lit("g:17")), text.hash_unit(F.lit("a")), geometry.out_of_bounds(F.lit(5.0), F.lit(-40.0)),
    )
    assert list(row) == [2.0, pytest.approx(0.05), 10.0, pytest.approx(1 / 3), 1, None, 17, pytest.approx(int("ca978112", 16) / 0xFFFFFFFF), 40.0]
    with pytest.raises(ValueError):
        geometry.gaussian_similarity(F.lit(1.0), 0)


def test_arrays(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    row = one(spark, arrays.top_padded(a(3, 9, 5), 2), arrays.top_padded(a(3), 2), arrays.quantiles(a(0, 10, 20), F.lit(5)), arrays.shape_distance(a(1, 2), a(2, 4), scaled=True), arrays.profile_distance(a(), a(1)), arrays.running_ema(a(1, 3), 0.5))
    assert row[0] == [9, 5] and row[1] == [3, 0] and row[2] == [0, 5, 10, 15, 20] and row[3] == pytest.approx(0.0) and row[4] == 2.0 and row[5] == 2.0
