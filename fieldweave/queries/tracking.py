"""Queries that run the tracking operators over events laid out as detections. Where SQL has no word for an operator, tests on fixtures hold its values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..kernels.tracker import TrackerOptions
from ..operators import match, metrics, tracking
from ..plans import actions, catalog, evaluation, ledger, reconstruction
from .registry import EVENTS, events, query, table


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of groups of 22 users as detections of a clip for each group, six hours as a tenth of a second. Clips grow in number with the users."""
    e = events(spark, sf_dir)
    user, t0 = F.col("user_id"), F.floor(F.col("t") / 21600)
    return e.select(
        F.concat(F.lit("c"), F.floor(user / 22)).alias("clip_id"), (t0 % 200 / 10).cast("double").alias("video_timestamp"), F.col("event_id").alias("detection_id"), (user * 7 % 120 + F.col("value") / 50).alias("field_x"),
        (F.col("k") % 53).cast("double").alias("field_y"), (0.3 + F.col("event_id") % 7 / 10).cast("double").alias("confidence"), F.when(user % 3 == 0, "team_0").when(user % 3 == 1, "team_1").otherwise("unknown").alias("team"), user.cast("string").alias("label"), "value",
    )


#: The same in SQL.
DETECTIONS = (
    f"{EVENTS}, de as (select 'c' || user_id // 22 as clip_id, (cast(floor(t / 21600) as bigint) % 200) / 10.0 as video_timestamp, event_id as detection_id, user_id * 7 % 120 + value / 50 as field_x, (k % 53)::double as field_y, 0.3 + event_id % 7 / 10.0 as confidence, "
    "case user_id % 3 when 0 then 'team_0' when 1 then 'team_1' else 'unknown' end as team, user_id::varchar as label, value from ev)"
)


def _named_apart(rows: DataFrame) -> DataFrame:
    """Rows whose label occurs again in its frame have the number of the occurrence in their label."""
    w = Window.partitionBy("clip_id", "video_timestamp", "label").orderBy("detection_id")
    return rows.withColumn("label", F.concat_ws("-", "label", F.row_number().over(w).cast("string")))


@query()
def tracker(spark, sf_dir):
    return tracking.tracked(detections(spark, sf_dir), "clip_id").select("clip_id", "video_timestamp", "detection_id", "track_id", "vx", "vy", "crowd_burst")


@query()
def hota_full(spark, sf_dir):
    rows = _named_apart(detections(spark, sf_dir)).withColumn("frame_id", F.rint(F.col("video_timestamp") * 10).cast("long"))
    truth = rows.select("clip_id", "frame_id", "label", F.col("field_x").alias("x"), F.col("field_y").alias("y"))
    tracks = rows.filter("detection_id % 10 <> 3").select("clip_id", "frame_id", F.concat(F.lit("t"), "label").alias("track_id"), (F.col("field_x") + 0.3).alias("field_x"), "field_y")
    return metrics.hota(truth, tracks, ["clip_id"], tau=5.0)


@query()
def evaluated_sources(spark, sf_dir):
    """All clips as scored sources: the grid of offsets and flips, the correction, and every score, of tracks that lag, are mirrored and miss a tenth."""
    rows = _named_apart(detections(spark, sf_dir)).withColumn("frame_id", F.rint(F.col("video_timestamp") * 10).cast("long"))
    truth = rows.select(F.col("clip_id").alias("play"), "frame_id", F.col("label").alias("player_id"), F.col("field_x").alias("x"), F.col("field_y").alias("y"), F.when(F.col("frame_id") == 5, "ball_snap").alias("event"))
    tracks = rows.filter("detection_id % 10 <> 3").select("clip_id", (F.col("video_timestamp") + 3.0).alias("video_timestamp"), F.concat(F.lit("t"), "label").alias("track_id"), (119.7 - F.col("field_x")).alias("field_x"), "field_y", F.lit(0.9).alias("confidence"))
    windows = truth.filter("event is not null").select(F.col("play").alias("clip_id"), "play").distinct().withColumns({"snap_s": F.lit(3.4), "dead_s": F.lit(9.4)})
    found = evaluation.scored_windows(windows, tracks, truth)
    return found.results.select("clip_id", "snap_adjustment_s", "flip_x", "flip_y", "median_error", "player_coverage", "held_out_median", "HOTA", "purity", "switches_per_100", "snap_matched", "isolated_recall")


@query(f"""
with {DETECTIONS}, m as (select clip_id, video_timestamp as "at", label || '-' || row_number() over (partition by clip_id, video_timestamp,
label order by detection_id) as label, 't' || cast(floor(field_x / 10) as int) as track_id, value as distance from de),
n as (select clip_id, count(*) as matched, median(distance) as err from m group by 1), c as (select clip_id, track_id, label, count(*) as n
from m group by 1, 2, 3), b as (select clip_id, track_id, max(n) as best, sum(n) as total from c group by 1, 2), p as (select clip_id,
sum(best) / sum(total) as purity from b group by 1),
s as (select clip_id, sum(ch::int) as switches from (select clip_id, coalesce(track_id <> lag(track_id) over (partition by clip_id, label
order by "at", track_id), false) as ch from m) group by 1), f as (select clip_id, avg(n) as fragments from (select clip_id, label,
count(distinct track_id) as n from m group by 1, 2) group by 1)
select clip_id, matched as matched_assignments, round(err, 6) as median_error, round(purity, 6) as purity, switches::bigint as id_switches,
round(fragments, 6) as fragments, round(100.0 * switches / matched, 6) as per_100 from n join p using (clip_id) join s using (clip_id) join
f using (clip_id)
""")
def identity(spark, sf_dir):
    rows = _named_apart(detections(spark, sf_dir))
    matched = rows.select("clip_id", F.col("video_timestamp").alias("at"), "label", F.concat(F.lit("t"), F.floor(F.col("field_x") / 10).cast("string")).alias("track_id"), F.col("value").alias("distance"))
    found = metrics.identity_metrics(matched, ["clip_id"], "at")
    return found.select("clip_id", "matched_assignments", F.round("median_assignment_error", 6).alias("median_error"), F.round("purity", 6).alias("purity"), "id_switches", F.round("fragments", 6).alias("fragments"), F.round("switches_per_100", 6).alias("per_100"))


@query()
def relinked_and_chained(spark, sf_dir):
    rows = tracking.tracked(detections(spark, sf_dir), "clip_id").withColumn("width", F.lit(1.0)).withColumn("height", F.lit(2.0)).withColumn("appearance", F.array(F.col("field_x") / 50))
    return match.chained(match.relinked(rows, ["clip_id"]), ["clip_id"]).groupBy("clip_id", "track_id").agg(F.count("*").alias("n"))


@query()
def roster(spark, sf_dir):
    rows = tracking.tracked(detections(spark, sf_dir), "clip_id").withColumn("person_role", F.lit("player"))
    return tracking.with_roster(rows, "clip_id", reliable=0.05).groupBy("clip_id", "track_id").agg(F.max("track_coverage").alias("coverage"), F.max("roster_candidate").alias("roster_candidate"))


@query(f"""
with {DETECTIONS}, s as (select clip_id, label, median(value) as x from de group by 1, 2), z as (select clip_id, count(*) as n, min(x) as
lo, max(x) as hi from s group by 1 having count(*) >= 3),
g as (select clip_id, lo + k * 0.25 as c from (select clip_id, lo, unnest(range(0, cast(ceil((hi + 0.251 - lo) / 0.25) as bigint))) as k
from z)), k as (select g.clip_id, c, count(*) as n from g join s on g.clip_id = s.clip_id and abs(x - c) <= 1 group by 1, 2),
m as (select clip_id, max(n) as members from k group by 1), b as (select k.clip_id, members, median(c) as centre from k join m on k.clip_id
= m.clip_id and k.n = members group by 1, 2),
e as (select s.clip_id, x, lead(x) over w as nxt, row_number() over w as l, n from s join z using (clip_id) window w as (partition by
s.clip_id order by x)), f as (select e.clip_id, (x + nxt) / 2 as threshold, nxt - x as gap, l, n - l as r, centre, members, abs((x + nxt) /
2 - centre) as away from e join b using (clip_id) where nxt is not null)
select clip_id, round(threshold, 6) as threshold, round(gap, 6) as gap, l as "left", r as "right", round(centre, 6) as dense_center, members
as dense_members from f where away <= 30 and l >= 1 and r >= 1 qualify row_number() over (partition by clip_id order by away, gap desc,
threshold) = 1
""")
def team_split(spark, sf_dir):
    snap = detections(spark, sf_dir).groupBy("clip_id", F.col("label").alias("track_id")).agg(F.median("value").alias("snap_x"))
    found = tracking.team_split(snap, ["clip_id"], "snap_x", dense=1, gap=0.0, side=1, near=30.0, least=3)
    return found.select("clip_id", F.round("threshold", 6).alias("threshold"), F.round("gap", 6).alias("gap"), F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), F.round("dense_center", 6).alias("dense_center"), "dense_members")


@query(f"""
with {EVENTS}, a as (select user_id, row_number() over (partition by user_id order by event_id) / 5.0 as t, value as score, event_type =
'error' as cut, count(*) over (partition by user_id) as n from ev), s as (select *, sum(score) over (partition by user_id order by t rows
between 2 preceding and 2 following) / 5 as x from a where n >= 10),
q as (select user_id, quantile_cont(x, 0.35) as p35, quantile_cont(x, 0.42) as p42, quantile_cont(x, 0.67) as p67, median(x) as m from s
where not cut group by 1), d as (select s.user_id, median(abs(x - m)) as d from s join q using (user_id) where not cut group by 1),
h as (select user_id, greatest(p67, p35 + 1.5 * case when d = 0 then 1 else d end) as hi, greatest(p42, p35 + 0.35 * case when d = 0 then 1
else d end) as lo from q join d using (user_id)),
m as (select s.user_id, t, x, x >= hi as seed, x >= lo and not cut as grow, x >= hi and cut as cs from s join h using (user_id)),
r as (select *, grow <> lag(grow, 1, not grow) over w as ch, grow and (seed or coalesce(lag(cs) over w, false) or coalesce(lead(cs) over w,
false)) as touch from m window w as (partition by user_id order by t)), g as (select *, sum(ch::int) over (partition by user_id order by t)
as run from r),
v as (select user_id, t, x, seed or (grow and max(touch::int) over (partition by user_id, run) = 1) as f from g), b as (select *, f <>
lag(f, 1, not f) over (partition by user_id order by t) as ch, row_number() over (partition by user_id order by t) as i, count(*) over
(partition by user_id) as n from v),
c as (select *, sum(ch::int) over (partition by user_id order by t) as isl from b), e as (select *, min(i) over (partition by user_id, isl)
as a, max(i) over (partition by user_id, isl) as z from c),
l as (select user_id, t, x, f or (a > 1 and z < n and (z - a + 1 <= 15 or (z - a + 1 < 30 and i - a >= z - a + 1 - 15))) as f from e), o as
(select *, f <> lag(f, 1, not f) over (partition by user_id order by t) as ch from l), u as (select *, sum(ch::int) over (partition by
user_id order by t) as isl from o),
w as (select user_id, min(t) as first, max(t) as last, max(x) as peak from u where f group by user_id, isl), k as (select user_id, min(t) as
t0 from a group by 1)
select user_id, round(greatest(first - 0.6, t0), 6) as start, round(last + 0.8, 6) as stop, round(peak, 6) as peak from w join k using
(user_id) where last - first + 0.2 between 0.4 - 1e-9 and 18 + 1e-9
""")
def motion_windows(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    samples = rows.select("user_id", (F.col("i") / 5.0).cast("double").alias("timestamp"), F.col("value").alias("score"), (F.col("event_type") == "error").alias("camera_cut"))
    found = actions.motion_windows(samples, ["user_id"], 5.0, least=0.4 - 1e-9, most=18.0 + 1e-9)
    return found.select("user_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("stop"), F.round("peak", 6).alias("peak"))


@query(f"""
with {EVENTS}, tr as (select user_id as play, cast(floor(t / 21600) as bigint) as frame_id, case when event_type <> 'error' then event_type
end as player_id, value as x, k::double as y, value / 10 as speed,
 case when event_id % 29 = 0 then 'BALL_SNAP' when event_id % 31 = 0 then 'pass_forward' when event_id % 37 = 0 then 'handoff' when event_id
% 5 = 0 then '' end as event from ev),
b as (select play, min(frame_id) filter (lower(event) = 'ball_snap') as s, max(frame_id) as z, list_sort(list(distinct lower(event)) filter
(event <> '')) as events from tr group by 1), p as (select tr.*, s, z from tr join b using (play) where s is not null and frame_id >= s and
player_id is not null),
c as (select play, len(list_filter(range(1, 8), lambda i: s + (z + 1e-6 - s) * (i::double / 8) <= frame_id)) as bin, median(speed) as v from
p group by all), g as (select play, bin from (select play from b where s is not null), range(8) x(bin)), f as (select g.play, g.bin, c.v
from g left join c using (play, bin)),
n as (select *, last_value(case when v is not null then bin end ignore nulls) over lo as b0, last_value(v ignore nulls) over lo as v0,
first_value(case when v is not null then bin end ignore nulls) over hi as b1, first_value(v ignore nulls) over hi as v1 from f
 window lo as (partition by play order by bin rows between unbounded preceding and current row), hi as (partition by play order by bin rows
between current row and unbounded following)),
o as (select play, string_agg(printf('%.4f', coalesce(v, v0 + (v1 - v0) * coalesce((bin - b0) / nullif(b1 - b0, 0), 0), v0, v1, 0) +
0.0000001), ',' order by bin) as profile from n group by 1),
m as (select play, median(x) as mx, median(y) as my from p where frame_id = s group by 1), d as (select p.play, list_sort(list(sqrt((x - mx)
** 2 + (y - my) ** 2))) as far from p join m using (play) where frame_id = s group by 1)
select b.play as user_id, greatest(0.1, (z - s) / 10) as duration, array_to_string(events, ',') as events, case when list_contains(events,
'pass_forward') then 'pass' when list_contains(events, 'handoff') then 'run' else 'unknown' end as category, profile,
 coalesce(array_to_string(list_transform(far, lambda x: printf('%.2f', round_even(x, 3) + 0.00001)), ','), '') as formation from b join o
using (play) left join d using (play)
""")
def play_signature(spark, sf_dir):
    """Users as plays of an answer key: six hours as a frame, kinds of events as players, errors as the ball."""
    e = events(spark, sf_dir)
    event = F.when(F.col("event_id") % 29 == 0, "BALL_SNAP").when(F.col("event_id") % 31 == 0, "pass_forward").when(F.col("event_id") % 37 == 0, "handoff").when(F.col("event_id") % 5 == 0, "")
    truth = e.select("user_id", F.floor(F.col("t") / 21600).alias("frame_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("player_id"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"), (F.col("value") / 10).alias("speed"), event.alias("event"))
    text = lambda c, n: F.concat_ws(",", F.transform(c, lambda v: F.format_string(f"%.{n}f", v + 10.0 ** -(2 * n - 1 if n == 4 else 5))))
    found = actions.play_signatures(truth, ["user_id"])
    return found.select("user_id", "duration", F.concat_ws(",", "events").alias("events"), "category", text("speed_profile", 4).alias("profile"), text("formation", 2).alias("formation"))


@query()
def discovered_actions(spark, sf_dir):
    rows = detections(spark, sf_dir).select("clip_id", F.col("label").alias("track_id"), "video_timestamp", "field_x", "field_y", (F.col("value") / 10).alias("speed"))
    clips = rows.groupBy("clip_id").agg(F.min("video_timestamp").alias("start_s"), F.max("video_timestamp").alias("end_s"))
    return actions.discovered(rows, clips, actions.ActivityOptions(tracks=2, least_s=0.2))


@query()
def reconstructed_artifacts(spark, sf_dir):
    """Detections of all clips to tracks, and the entry that each clip's tracks have in the ledger after that of their projection."""
    d = detections(spark, sf_dir).drop("team", "label").withColumns({"on_field": F.col("detection_id") % 17 != 0, "calibration_valid": F.col("detection_id") % 19 != 0})
    colour = F.when(F.floor("field_x") % 2 == 0, 60.0).otherwise(150.0)
    projection = d.withColumns({"lab_l": colour, "lab_a": F.lit(10.0), "lab_b": F.lit(10.0), "hsv_s": colour / 3}).drop("value")
    clips = d.groupBy("clip_id").agg(F.lit("sideline").alias("angle"), F.min("video_timestamp").alias("start_s"), F.max("video_timestamp").alias("end_s"))
    keyframes = clips.select("clip_id", (F.length("clip_id") + 1).alias("revision"))
    book = ledger.appended(spark.createDataFrame([], schemas.schema("artifacts")), ledger.projection_entries(projection, keyframes, "projection"))
    options = TrackerOptions()
    tracks = reconstruction.reconstructed(projection, clips, options)
    found = ledger.track_entries(tracks, book, ledger.tracking_config(options), "tracks")
    return found.select("clip_id", "kind", *[F.get_json_object("metadata_json", f"$.{c}").cast("long").alias(c) for c in ("rows", "tracks", "reliable_tracks", "roster_tracks")], "config_hash", "input_revision")


@query()
def aligned_actions(spark, sf_dir):
    """All orders, a game for each customer: those that 3 divides have no play, those that only 5 divides no unit."""
    o = table(spark, sf_dir, "orders").withColumn("game_id", F.concat(F.lit("g"), "o_custkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "run").when(F.col("o_orderstatus") == "O", "pass").otherwise("punt")
    plays = o.filter("o_orderkey % 3 <> 0").select("game_id", F.col("o_orderkey").alias("ordinal"), kind.alias("kind"))
    units = o.filter("o_orderkey % 5 <> 0 or o_orderkey % 3 = 0").select("game_id", F.col("o_orderkey").alias("unit_no"), kind.alias("category"), (F.col("o_totalprice") % 10).alias("duration"), F.lit(0.8).alias("confidence"))
    return catalog.align_actions(plays, units, F.col("kind"))


@query()
def paired_actions(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    s = e.select(
        F.col("user_id").alias("game_id"), "position", F.col("event_id").alias("action_id"), F.col("event_type").alias("clip_id"), F.when(F.col("event_id") % 2 == 0, "sideline").otherwise("endzone").alias("angle"), (F.col("value") / 10).alias("duration"), F.col("k").cast("double").alias("displacement"),
        F.array(F.lit(11.0), F.lit(11.0)).alias("team_counts"), F.array(F.col("value"), F.col("k").cast("double")).alias("profile"),
    )
    return actions.paired_actions(s)
