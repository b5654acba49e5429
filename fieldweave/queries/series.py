"""Queries over ordered rows: rolling statistics, runs, sessions, as-of and gap joins on events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregate, folds, joins, sample
from ..operators import sequence as seq
from ..plans.actions import ActivityOptions, activity
from .registry import EVENTS, events, query


@query(f"""
with {EVENTS}, hourly as (select 0 as g, cast(floor(t / 3600) as bigint) as h, avg(case when value > 40 then 1.0 else 0.0 end) as activity,
median(value) as middle, count(distinct user_id) as tracks from ev group by 2),
sm as (select *, avg(activity) over w as smooth, median(middle) over w as pace from hourly window w as (order by h rows between 2 preceding
and 2 following)),
fl as (select *, smooth >= 0.45 and pace >= 35 and tracks >= 2 as active from sm),
i1 as (select *, active <> lag(active, 1, not active) over (order by h) as ch from fl), i2 as (select *, sum(cast(ch as int)) over (order by
h) as isl from i1),
i3 as (select *, min(h) over (partition by isl) as a, max(h) over (partition by isl) as b, min(h) over () as lo, max(h) over () as hi from
i2),
br as (select h, smooth, active or (a > lo and b < hi and b - a <= 2) as active from i3),
j1 as (select *, active <> lag(active, 1, not active) over (order by h) as ch from br), j2 as (select *, sum(cast(ch as int)) over (order by
h) as isl from j1)
select min(h) as first, max(h) as last, count(*) as n, round(avg(smooth), 6) as mean from j2 where active group by isl having max(h) -
min(h) >= 3
""")
def activity_windows(spark, sf_dir):
    """Windows of activity over hours: a smoothed timeline, runs of active hours, short pauses bridged."""
    rows = events(spark, sf_dir).withColumn("g", F.lit(0)).withColumn("h", F.floor(F.col("t") / 3600))
    line = activity(rows, ["g"], "h", "value", "user_id", 5, ActivityOptions(moving=40, share=0.45, speed=35, tracks=2))
    bridged = seq.bridged_by_time(line, ["g"], "h", "active", 2)
    return seq.runs(bridged, ["g"], "h", "active", mean=F.round(F.avg("smooth"), 6)).filter("last - first >= 3").drop("g")


@query(f"""
with {EVENTS} select event_id, round(avg(value) over w, 6) as mean5, round(median(value) over w, 6) as median5, round(avg(value) over v, 6)
as mean4
from ev window w as (partition by user_id order by event_id rows between 2 preceding and 2 following), v as (partition by user_id order by
event_id rows between 2 preceding and 1 following)
""")
def centred_rolling(spark, sf_dir):
    k, o = ["user_id"], "event_id"
    return events(spark, sf_dir).select("event_id", F.round(seq.rolling_mean("value", k, o, 5), 6).alias("mean5"), F.round(seq.rolling_median("value", k, o, 5), 6).alias("median5"), F.round(seq.rolling_mean("value", k, o, 4), 6).alias("mean4"))


@query(f"""
with {EVENTS} select event_id, round(sum(value) over (partition by user_id order by event_id rows between 2 preceding and 2 following) / 5,
6) as box from ev
""")
def box_convolution(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(seq.box_mean("value", ["user_id"], "event_id"), 6).alias("box"))


@query(f"""
with {EVENTS}, d as (select event_id, value - lag(value) over w as dx, k - lag(k) over w as dy, t - lag(t) over w as dt from ev window w as
(partition by user_id order by t))
select event_id, round(sqrt(dx * dx + dy * dy) / nullif(dt, 0), 6) as speed from d
""")
def track_speed(spark, sf_dir):
    return seq.with_speed(events(spark, sf_dir), ["user_id"], "t", "value", "k").select("event_id", F.round("speed", 6).alias("speed"))


@query(f"""
with {EVENTS}, s as (select user_id, t - lag(t) over (partition by user_id order by t) as d from ev) select user_id, round(median(d), 6) as
step from s group by 1
""")
def median_step(spark, sf_dir):
    return seq.median_step(events(spark, sf_dir), ["user_id"], "t").select("user_id", F.round("step", 6).alias("step"))


@query(f"""
with {EVENTS}, m as (select *, value >= 60 as seed, value >= 15 and event_type <> 'error' as grow, value >= 60 and event_type = 'error' as
cs from ev),
r as (select *, grow <> lag(grow, 1, not grow) over w as ch, grow and (seed or coalesce(lag(cs) over w, false) or coalesce(lead(cs) over w,
false)) as touch from m window w as (partition by user_id order by event_id)),
s as (select *, sum(cast(ch as int)) over (partition by user_id order by event_id) as run from r),
a as (select *, seed or (grow and max(cast(touch as int)) over (partition by user_id, run) = 1) as active from s),
j as (select *, active <> lag(active, 1, not active) over (partition by user_id order by event_id) as c2 from a), k2 as (select *,
sum(cast(c2 as int)) over (partition by user_id order by event_id) as isl from j)
select user_id, min(event_id) as first, max(event_id) as last, count(*) as n, max(value) as peak from k2 where active group by user_id, isl
""")
def hysteresis_runs(spark, sf_dir):
    v = F.col("value")
    marked = seq.hysteresis(events(spark, sf_dir), ["user_id"], "event_id", v >= 60, v >= 15, F.col("event_type") == "error")
    return seq.runs(marked, ["user_id"], "event_id", "active", peak=F.max("value"))


@query(f"""
with {EVENTS}, m as (select user_id, event_id, value >= 25 as f, row_number() over (partition by user_id order by event_id) as i, count(*)
over (partition by user_id) as n from ev),
r as (select *, sum(cast(f <> p as int)) over (partition by user_id order by event_id) as isl from (select *, lag(f, 1, not f) over
(partition by user_id order by event_id) as p from m)),
g as (select *, min(i) over (partition by user_id, isl) as a, max(i) over (partition by user_id, isl) as b from r)
select event_id, f or (a > 1 and b < n and (b - a + 1 <= 2 or (b - a + 1 < 4 and i - a >= b - a + 1 - 2))) as active from g
""")
def count_bridge(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("active", F.col("value") >= 25)
    return seq.bridged_by_count(rows, ["user_id"], "event_id", "active", 2).select("event_id", "active")


@query(f"""
with {EVENTS}, f as (select * from ev where event_type in ('signup', 'click', 'purchase')), s as (select *, sum(cast(event_type = 'signup'
as int)) over (partition by user_id order by event_id) as group_no from f)
select event_id, user_id, group_no, row_number() over (partition by user_id, group_no order by event_id) - 1 as group_order from s where
group_no > 0
""")
def session_groups(spark, sf_dir):
    kind = F.col("event_type")
    return seq.session_groups(events(spark, sf_dir), ["user_id"], "event_id", kind == "signup", kind.isin("click", "purchase")).select("event_id", "user_id", "group_no", "group_order")


@query(f"""
with {EVENTS} select user_id, event_type, event_id, value from ev qualify row_number() over (partition by user_id, event_type order by
event_id desc) = 1
""")
def latest_per_kind(spark, sf_dir):
    return seq.latest(events(spark, sf_dir), ["user_id", "event_type"], F.col("event_id").desc()).select("user_id", "event_type", "event_id", "value")


@query(f"""
with {EVENTS}, c as (select user_id, t as start, lead(t) over (partition by user_id order by t) as stop from ev where event_type = 'error')
select user_id, round(start, 6) as start, round(stop, 6) as stop, row_number() over (partition by user_id order by start) as number from c
where stop - start >= 3600
""")
def boundary_pairs(spark, sf_dir):
    cuts = events(spark, sf_dir).filter("event_type = 'error'").select("user_id", "t")
    return seq.between_cuts(cuts, ["user_id"], "t", 3600).select("user_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("stop"), "number")


@query(f"""
with recursive {EVENTS}, p as (select user_id, event_id, t from ev where event_type = 'purchase'), r as (
select user_id, min(t) as t from p group by 1 union all select r.user_id, (select min(t) from p where p.user_id = r.user_id and p.t - r.t >=
86400) as t from r where r.t is not null)
select p.event_id, p.user_id from p join r on p.user_id = r.user_id and p.t = r.t
""")
def min_separation(spark, sf_dir):
    rows = events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", "event_id", "t")
    return folds.min_separation(rows, ["user_id"], "t", 86400.0).select("event_id", "user_id")


@query(f"""
with {EVENTS}, p as (select * from ev where event_type = 'purchase'), v as (select * from ev where event_type = 'view'),
j as (select p.event_id, v.event_id as near, abs(p.t - v.t) as d, row_number() over (partition by p.event_id order by abs(p.t - v.t), v.t)
as n from p left join v using (user_id))
select event_id, near as near_event, round(d, 6) as distance, coalesce(d <= 7200, false) as valid from j where n = 1
""")
def nearest_asof(spark, sf_dir):
    rows = events(spark, sf_dir)
    p = rows.filter("event_type = 'purchase'").select("user_id", "event_id", "t")
    v = rows.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("near_event"), F.col("t").alias("at"))
    found = joins.nearest_in_time(p, v, ["user_id"], "t", "at", ["near_event"], valid_within=7200.0)
    return found.select("event_id", "near_event", F.round("distance", 6).alias("distance"), "valid")


@query(f"""
with {EVENTS}, s as (select user_id, t - lag(t) over (partition by user_id order by t) as d from ev where event_type = 'view') select
user_id, round(greatest(0.075, 0.75 * coalesce(median(d), 0.1)), 6) as reach from s group by 1
""")
def validity_reach(spark, sf_dir):
    return joins.validity_reach(events(spark, sf_dir).filter("event_type = 'view'"), ["user_id"], "t").select("user_id", F.round("reach", 6).alias("reach"))


@query(f"""
with {EVENTS}, g as (select *, abs(value - 50) as gap from ev), m as (select *, min(gap) over (partition by user_id) as least from g) select
event_id from m where gap <= least + 0.5
""")
def nearest_with_tolerance(spark, sf_dir):
    return joins.rows_nearest_to(events(spark, sf_dir), ["user_id"], "value", F.lit(50.0), 0.5).select("event_id")


@query(f"""
with {EVENTS}, e as (select user_id, event_id, t, value from ev where value > 20)
select l.event_id as a, r.event_id as b, round(r.t - l.t, 6) as gap, round(abs(ln(r.value / l.value)), 6) as shape from e l join e r on
l.user_id = r.user_id and r.t - l.t > 0 and r.t - l.t <= 43200
""")
def gap_links(spark, sf_dir):
    from ..functions.geometry import shape_change

    rows = events(spark, sf_dir).filter("value > 20").select("user_id", "event_id", "t", "value")
    found = joins.following_within(rows, rows, ["user_id"], "t", "t", 43200.0)
    return found.select(F.col("l_event_id").alias("a"), F.col("r_event_id").alias("b"), F.round("gap", 6).alias("gap"), F.round(shape_change(F.col("r_value"), F.col("l_value")), 6).alias("shape"))


@query(f"""
with {EVENTS}, o as (select *, row_number() over (partition by user_id order by event_id) as i from ev)
select a.event_id as a, b.event_id as b, b.i - a.i as step, round(abs(a.value - b.value) / greatest(a.value, b.value, 1), 6) as cost from o
a join o b on a.user_id = b.user_id and b.i between a.i + 1 and a.i + 4 where a.event_type <> b.event_type
""")
def lookahead_pairs(spark, sf_dir):
    found = joins.looking_ahead(events(spark, sf_dir).select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id", 4).filter("event_type <> other_event_type")
    cost = F.abs(F.col("value") - F.col("other_value")) / F.greatest("value", "other_value", F.lit(1.0))
    return found.select(F.col("event_id").alias("a"), F.col("other_event_id").alias("b"), F.col("step").cast("long").alias("step"), F.round(cost, 6).alias("cost"))


@query(f"""
with recursive {EVENTS}, w as (select user_id, cast(floor(t / 21600) as bigint) as bin, event_type, event_id, value from ev where event_type
in ('view', 'click')),
s as (select *, row_number() over (partition by user_id, bin, event_type order by event_id) as n from w), v as (select * from s where
event_type = 'view'), c as (select * from s where event_type = 'click'),
g as (select user_id, bin, v.nv, c.nc from (select user_id, bin, count(*) as nv from v group by 1, 2) v join (select user_id, bin, count(*)
as nc from c group by 1, 2) c using (user_id, bin)),
o as (select user_id, bin, n, value from c union all select user_id, bin, 0, null from g),
r as (select user_id, bin, 0::bigint as i, 0::bigint as used, 0::bigint as k, 0::double as cost from g union all
 select r.user_id, r.bin, r.i + 1, case when o.n = 0 then r.used else r.used | (1::bigint << (o.n - 1)) end, r.k + (o.n > 0)::bigint, r.cost
+ coalesce(abs(v.value - o.value), 0)
 from r join v on v.user_id = r.user_id and v.bin = r.bin and v.n = r.i + 1 join o on o.user_id = r.user_id and o.bin = r.bin where o.n = 0
or r.used & (1::bigint << (o.n - 1)) = 0)
select g.user_id, g.bin, least(nv, nc) as pairs, round(min(cost), 6) as total from g join r on g.user_id = r.user_id and g.bin = r.bin and
r.i = nv and r.k = least(nv, nc) group by 1, 2, 3
""")
def optimal_match_small(spark, sf_dir):
    """A cheapest matching of all views and clicks of a user and time bin. The SQL tries all matchings."""
    from ..operators.match import optimal_pairs

    rows = events(spark, sf_dir).filter("event_type in ('view', 'click')").withColumn("bin", F.floor(F.col("t") / 21600))
    v = rows.filter("event_type = 'view'").select("user_id", "bin", F.col("event_id").alias("a"), F.col("value").alias("x"))
    c = rows.filter("event_type = 'click'").select("user_id", "bin", F.col("event_id").alias("b"), F.col("value").alias("y"))
    pairs = v.join(c, ["user_id", "bin"]).withColumn("cost", F.abs(F.col("x") - F.col("y")))
    return optimal_pairs(pairs, ["user_id"], ["bin"], "a", "b", "cost").groupBy("user_id", "bin").agg(F.count("*").alias("pairs"), F.round(F.sum("cost"), 6).alias("total"))


@query(f"""
with recursive {EVENTS}, z as (select user_id, coalesce(list(value order by event_id) filter (event_type = 'view'), []) as v,
coalesce(list(value order by event_id) filter (event_type = 'click'), []) as c from ev where event_type in ('view', 'click') group by 1),
p as (select user_id, v, c, 0::bigint as i, list_transform(range(0, len(c) + 1), lambda j: 0.9::double * j) as d from z union all
 select user_id, v, c, i + 1, list_transform(range(0, len(c) + 1), lambda j: 0.9::double * j + list_min(list_transform(range(0, j + 1),
lambda k: b[k + 1] - 0.9::double * k))) as d from
 (select *, list_transform(range(0, len(c) + 1), lambda j: case when j = 0 then d[1] + 1.1::double else least(d[j + 1] + 1.1::double, d[j] +
abs(v[i + 1] - c[j]) / 20) end) as b from p where i < len(v)))
select user_id, round(d[len(c) + 1], 6) as total from p where i = len(v)
""")
def dp_align_cost(spark, sf_dir):
    """The cost of a cheapest monotone alignment of all views and clicks of each user. The SQL goes view by view, over the costs up to each click."""
    from ..operators.match import aligned_cost

    rows = events(spark, sf_dir).filter("event_type in ('view', 'click')")
    return aligned_cost(rows, ["user_id"], "event_id", F.col("event_type") == "view", "value", 20.0, 1.1, 0.9).select("user_id", F.round("total", 6).alias("total"))


@query(f"""
with {EVENTS}, r as (select user_id, min(t) as a, max(t) as b from ev group by 1), e as (select user_id, t, value, case when a = b then 0
else len(list_filter(range(1, 8), lambda i: a + (b - a) * (cast(i as double) / 8) <= t)) end as bin from ev join r using (user_id)),
c as (select user_id, bin, median(value) as v from e group by 1, 2), g as (select user_id, bin from r, range(8) x(bin)), f as (select
g.user_id, g.bin, c.v from g left join c using (user_id, bin)),
n as (select *, last_value(case when v is not null then bin end ignore nulls) over lo as b0, last_value(v ignore nulls) over lo as v0,
first_value(case when v is not null then bin end ignore nulls) over hi as b1, first_value(v ignore nulls) over hi as v1 from f
 window lo as (partition by user_id order by bin rows between unbounded preceding and current row), hi as (partition by user_id order by bin
rows between current row and unbounded following)),
o as (select user_id, bin, coalesce(v, v0 + (v1 - v0) * coalesce((bin - b0) / nullif(b1 - b0, 0), 0), v0, v1, 0) as v from n)
select user_id, string_agg(printf('%.4f', v + 0.0000001), ',' order by bin) as profile from o group by 1
""")
def speed_profile8(spark, sf_dir):
    p = aggregate.binned_profile(events(spark, sf_dir), ["user_id"], "t", "value")
    return p.select("user_id", F.concat_ws(",", F.transform("profile", lambda v: F.format_string("%.4f", v + 0.0000001))).alias("profile"))


@query(f"""
with {EVENTS}, c as (select user_id, event_type, cast(floor(k / 10) as int) as label, event_id from ev), n as (select user_id, event_type,
label, count(*) as n from c group by all), m as (select user_id, event_type, max(n) as best, sum(n) as total from n group by 1, 2),
p as (select user_id, sum(best) / sum(total) as purity from m group by 1), f as (select user_id, avg(n) as fragments from (select user_id,
label, count(distinct event_type) as n from c group by 1, 2) group by 1),
s as (select user_id, sum(cast(ch as int)) as switches from (select user_id, coalesce(event_type <> lag(event_type) over (partition by
user_id order by event_id), false) as ch from c) group by 1)
select p.user_id, round(purity, 6) as purity, round(fragments, 6) as fragments, switches from p join f using (user_id) join s using
(user_id)
""")
def purity_switches_fragments(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("label", F.floor(F.col("k") / 10).cast("int"))
    p, f = aggregate.purity(rows, ["user_id"], "event_type", "label"), aggregate.fragments(rows, ["user_id"], "event_type", "label")
    return p.join(f, "user_id").join(seq.switches(rows, ["user_id"], "event_id", "event_type"), "user_id").select("user_id", F.round("purity", 6).alias("purity"), F.round("fragments", 6).alias("fragments"), "switches")


@query(f"""
with {EVENTS}, n as (select user_id, event_type, count(*) as n, sum(value) as w from ev group by 1, 2), m as (select user_id, event_type
from n qualify row_number() over (partition by user_id order by n desc, event_type) = 1),
v as (select user_id, event_type as winner, w / sum(w) over (partition by user_id) as share from n qualify row_number() over (partition by
user_id order by w desc, event_type) = 1)
select user_id, m.event_type as modal, winner, round(share, 6) as share from m join v using (user_id)
""")
def mode_vote(spark, sf_dir):
    rows = events(spark, sf_dir)
    m = rows.groupBy("user_id").agg(aggregate.mode("event_type").alias("modal"))
    return m.join(aggregate.vote(rows, ["user_id"], "event_type", F.col("value")), "user_id").select("user_id", "modal", "winner", F.round("share", 6).alias("share"))


@query(f"""
with {EVENTS}, r as (select user_id, event_id, event_type, sum(cast(event_type is distinct from p as int)) over (partition by user_id order
by event_id) as run from (select *, lag(event_type) over (partition by user_id order by event_id) as p from ev)),
c as (select user_id, run, min(event_id) as "at", any_value(event_type) as state from r group by 1, 2 having count(*) >= 2), l as (select *,
lag(state) over (partition by user_id order by "at") as was from c)
select user_id, "at", was, state from l where was is not null and was <> state
""")
def state_changes(spark, sf_dir):
    return seq.state_changes(events(spark, sf_dir), ["user_id"], "event_id", "event_type", 2)


@query(f"""
with {EVENTS}, g as (select user_id, value as b, lead(value) over (partition by user_id order by value) as a from ev) select user_id,
round(a - b, 6) as gap, round((a + b) / 2, 6) as split from g where a is not null qualify row_number() over (partition by user_id order by a
- b desc, b) = 1
""")
def largest_gap(spark, sf_dir):
    return seq.largest_gap(events(spark, sf_dir), ["user_id"], "value").select("user_id", F.round("gap", 6).alias("gap"), F.round("split", 6).alias("split"))


@query(f"""
with {EVENTS} select event_id, value from ev qualify (dense_rank() over (partition by user_id order by cast(floor(t / 3600) as bigint)) - 1)
% 3 = 0
""")
def every_third_hour(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("h", F.floor(F.col("t") / 3600))
    return sample.every_nth_time(rows, ["user_id"], "h", 3).select("event_id", "value")


@query(f"""
with {EVENTS}, a as (select *, max(cast(event_type = 'purchase' and value > 60 as int)) over (partition by user_id) as x from ev) select
event_id from a where x = 0 or (event_type = 'purchase' and value > 60)
""")
def reliable_or_all(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("good", (F.col("event_type") == "purchase") & (F.col("value") > 60))
    return sample.reliable_or_all(rows, ["user_id"], "good").select("event_id")


@query(f"""
with {EVENTS}, n as (select user_id, cast(floor(t / 86400) as bigint) as d from ev), o as (select user_id, d, count(*) as observations from
n group by 1, 2), z as (select d, count(distinct user_id) as users from n group by 1)
select user_id, d as day, observations, round(least(1.0, observations / users), 6) as coverage, least(1.0, observations / users) >= 0.05 as
reliable from o join z using (d)
""")
def track_coverage(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400)).withColumn("at", F.col("user_id"))
    return aggregate.track_coverage(rows, ["day"], "user_id", "at", 0.05).select("user_id", "day", "observations", F.round("coverage", 6).alias("coverage"), "reliable")


@query(f"""
with {EVENTS}, c as (select user_id, event_type, arg_min(value, t) as v0, arg_max(value, t) as v1, arg_min(k, t) as k0, arg_max(k, t) as k1
from ev group by 1, 2) select user_id, round(median(sqrt((v1 - v0) * (v1 - v0) + (k1 - k0) * (k1 - k0))), 6) as displacement from c group by
1
""")
def median_displacement(spark, sf_dir):
    return aggregate.displacement(events(spark, sf_dir), ["user_id"], "event_type", "t", "value", "k").select("user_id", F.round("displacement", 6).alias("displacement"))


@query(f"""
with {EVENTS}, m as (select *, value - median(value) over (partition by event_type) as d from ev)
select event_type, round(quantile_cont(value, 0.35), 6) as p35, round(quantile_cont(value, 0.42), 6) as p42, round(quantile_cont(value,
0.67), 6) as p67, round(case when median(abs(d)) = 0 then 1.0 else median(abs(d)) end, 6) as mad from m group by 1
""")
def robust_scale(spark, sf_dir):
    found = aggregate.robust_scale(events(spark, sf_dir), ["event_type"], "value", (0.35, 0.42, 0.67))
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("p35", "p42", "p67", "mad")])


@query(f"""
with {EVENTS} select event_type, cast(least(greatest(floor((value - 0) / 10), 0), 9) as int) as bin, count(*) as n from ev group by 1, 2
""")
def value_histogram(spark, sf_dir):
    return aggregate.histogram(events(spark, sf_dir), ["event_type"], "value", 0.0, 100.0, 10)


@query(f"""
with {EVENTS} select user_id, event_id, last_value(nullif(case when event_type = 'signup' then k else 0 end, 0) ignore nulls) over
(partition by user_id order by event_id rows between unbounded preceding and current row) as carried from ev
""")
def forward_fill(spark, sf_dir):
    c = F.when(F.col("event_type") == "signup", F.col("k")).otherwise(0)
    return events(spark, sf_dir).select("user_id", "event_id", seq.filled_forward(c, ["user_id"], "event_id").alias("carried"))


@query(f"""
with {EVENTS}, s as (select user_id, event_id, t, event_type, k, 100 + cast(round_even((t - min(t) over (partition by user_id)) * 0.01, 0)
as bigint) as frame from ev) select event_id, frame from s
""")
def frame_clock(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("t0", F.min("t").over(Window.partitionBy("user_id")))
    return joins.at_frame(rows, "frame", F.lit(100), F.col("t"), F.col("t0"), F.lit(0.0), 0.01).select("event_id", "frame")


@query(f"""
with {EVENTS}, r as (select *, row_number() over w as i, count(*) over (partition by user_id) as n from ev window w as (partition by user_id
order by event_id) qualify n >= 20),
b as (select user_id, value, median(value) over (partition by user_id) as m from r where i <= greatest(10, n // 4)), d as (select user_id,
max(m) as m, median(abs(value - m)) as a from b group by 1),
h as (select user_id, m + greatest(1, 4 * case when a = 0 then 0.1 else a end) as threshold from d), q as (select r.user_id, event_id,
value, i, n, value > threshold as x, threshold from r join h using (user_id)),
w as (select *, min(x::int) over (partition by user_id order by i rows between current row and 2 following) as onset, max(x::int) over
(partition by user_id order by i rows between current row and 7 following) as busy from q),
s as (select user_id, min(i) as i from w where i >= 3 and n - i + 1 >= 4 and onset = 1 group by 1), e as (select s.user_id, min(w.i) as i
from s join w on s.user_id = w.user_id and w.i >= s.i + 20 and n - w.i + 1 >= 9 and busy = 0 group by 1)
select s.user_id, a.event_id as start, z.event_id as rest, round(least(1, greatest(0, (a.value - a.threshold) / greatest(a.threshold, 1))),
6) as confidence from s join w a on s.user_id = a.user_id and s.i = a.i left join e on s.user_id = e.user_id join w z on s.user_id =
z.user_id and z.i = coalesce(e.i, z.n)
""")
def motion_bounds(spark, sf_dir):
    """When each user's values first stay high, and when they then rest, at one sample a second."""
    from ..plans.actions import motion_bounds as bounds

    found = bounds(events(spark, sf_dir), ["user_id"], 1.0, at="event_id", score="value")
    return found.select("user_id", "start", F.col("end").alias("rest"), F.round("confidence", 6).alias("confidence"))
