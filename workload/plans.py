"""Finished plans: sequence, totals, validation, advice, edits and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import timectx as C
from trailgrid.operators import context
from trailgrid.operators import metrics as M
from trailgrid.operators import search as S
from trailgrid.operators import sequence as Q
from trailgrid.operators import travel as V
from trailgrid.plans import requests as R
from trailgrid.plans import revise
from trailgrid.plans import validate as P
from trailgrid.sources import feeds, keyed
from workload import sqltext as X
from workload.base import query
from workload.timectx import (
    COASTAL, HOURS, MEAL_STATE, MERGED, NO_SEA, REASON, SEA, TRIP_DAYS, WET, coastal_days, sea_days, sunset_sql, today, weather, wet_stops, dated_stops,
)
from workload.travel import ESTIMATE

W = "(PARTITION BY plan_id, day ORDER BY ord"
UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
NO_STRINGS = "array<string>"


@query("agg_1", """
SELECT 'total' AS measure, count(*) AS rows FROM sites_fx UNION ALL SELECT 'active', count(*) FILTER (is_active) FROM sites_fx
UNION ALL SELECT 'duplicates', count(*) FILTER (rejected_reason = 'duplicado') FROM sites_fx
UNION ALL SELECT 'category:' || category, count(*) FROM sites_fx WHERE is_active GROUP BY category""")
def agg_1(fx):
    return M.catalogue_stats(fx.sites)


@query("agg_2", """
SELECT 'kept' AS section, category AS "group", count(*) AS rows, round(avg(quality), 2) AS quality FROM sites_fx WHERE is_active GROUP BY category
UNION ALL SELECT 'rejected', coalesce(rejected_reason, '(sin motivo)'), count(*), NULL FROM sites_fx WHERE NOT is_active GROUP BY rejected_reason""")
def agg_2(fx):
    return M.load_report(fx.sites)


@query("agg_22", """
SELECT count(*) AS rows, round(avg(CASE WHEN rejected_reason <> 'duplicado' THEN 1e0 ELSE 0e0 END), 4) AS rejected,
round(avg(CASE WHEN rejected_reason = 'duplicado' THEN 1e0 ELSE 0e0 END), 4) AS merged FROM sites_fx""")
def agg_22(fx):
    return M.loss_rates(fx.sites)


@query("agg_5", """
WITH b AS (SELECT round(lon, 1) AS band, min(lat) AS south FROM sites_fx GROUP BY 1 HAVING count(*) >= 3)
SELECT band, round(min(south) OVER (ORDER BY band ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS south FROM b""")
def agg_5(fx):
    return M.coast_outline(fx.sites)


@query("agg_10", """
SELECT plan_id, day, floor((sum(CAST(round(leg_km*1000) AS BIGINT)) + 5)/10)/100 AS travel_km, arg_min(arrival, ord) AS start, arg_max(departure, ord) AS stop, count(*) AS stops,
arg_max(departure, ord) - arg_min(arrival, ord) AS duration FROM timed_fx GROUP BY plan_id, day""")
def agg_10(fx):
    return Q.day_totals(fx.timed)


ANCHORED = "SELECT *, CASE WHEN plan_id % 3 = 0 THEN NULL ELSE first_value(place_id) OVER (PARTITION BY plan_id ORDER BY day, ord) END AS anchor_id FROM timed_fx"


def _anchored(fx):
    first = F.first("place_id").over(Window.partitionBy("plan_id").orderBy("day", "ord"))
    return fx.timed.withColumn("anchor_id", F.when(F.col("plan_id") % 3 != 0, first))


@query("agg_11", f"SELECT plan_id, day, count(*) FILTER (anchor_id IS NULL OR place_id <> anchor_id) AS visits FROM ({ANCHORED}) GROUP BY plan_id, day")
def agg_11(fx):
    return Q.visits(_anchored(fx), ["plan_id", "day"])


@query("agg_13", "SELECT category, arg_min(dwell, r) AS median FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY dwell) AS r, count(*) OVER (PARTITION BY category) AS n FROM days_fx) WHERE r = n//2 + 1 GROUP BY category")
def agg_13(fx):
    return M.upper_median(fx.days, ["category"], "dwell")


@query("agg_16", f"""
WITH s AS (SELECT *, category = lag(category) OVER {W}) AS same, subcategory = lag(subcategory) OVER {W}) AS sub FROM days_fx),
r AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER {W} {UP}) AS run FROM s),
g AS (SELECT plan_id, day, run, count(*) AS n FROM r GROUP BY plan_id, day, run)
SELECT plan_id, day, count(*) AS stops, CAST(count(DISTINCT category) AS INTEGER) AS categories, (SELECT max(n) FROM g WHERE g.plan_id = r.plan_id AND g.day = r.day) AS longest_run,
count(*) FILTER (same) AS same_category, count(*) FILTER (sub) AS same_subcategory FROM r GROUP BY plan_id, day HAVING count(*) >= 3""")
def agg_16(fx):
    return M.variety(fx.days, ["plan_id", "day"])


@query("agg_16_summary", f"""
WITH s AS (SELECT *, category = lag(category) OVER {W}) AS same, subcategory = lag(subcategory) OVER {W}) AS sub FROM days_fx),
r AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER {W} {UP}) AS run FROM s),
g AS (SELECT plan_id, day, run, count(*) AS n FROM r GROUP BY plan_id, day, run),
d AS (SELECT plan_id, day, count(*) AS stops, count(DISTINCT category) AS categories, count(*) FILTER (same) AS same, count(*) FILTER (sub) AS sub FROM r GROUP BY plan_id, day HAVING count(*) >= 3),
l AS (SELECT plan_id, day, max(n) AS longest FROM g GROUP BY plan_id, day)
SELECT count(*) AS days, round(avg(categories), 2) AS mean_categories, CAST(min(categories) AS INTEGER) AS fewest, count(*) FILTER (longest >= 3) AS days_with_runs, round(count(*) FILTER (longest >= 3)/count(*), 4) AS run_share,
count(*) FILTER (categories = 1) AS single_days, round(count(*) FILTER (categories = 1)/count(*), 4) AS single_share, round(sum(same)/sum(stops - 1), 4) AS category_repeats, round(sum(sub)/sum(stops - 1), 4) AS subcategory_repeats FROM d JOIN l USING (plan_id, day)""")
def agg_16_summary(fx):
    return M.variety_summary(M.variety(fx.days, ["plan_id", "day"]))


CONTROLS = X.values([(name, lat, lon, int(coastal)) for name, lat, lon, coastal in K.COAST_CONTROLS], "k(name, klat, klon, expected)")


@query("agg_5_control", f"""
WITH b AS (SELECT round(lon, 1) AS band, min(lat) AS south FROM sites_fx GROUP BY 1 HAVING count(*) >= 3),
o AS (SELECT band, round(min(south) OVER (ORDER BY band ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS south FROM b),
m AS (SELECT name, expected, round(min({X.hav_km('klat', 'klon', 'south', 'band')}), 3) AS km FROM {CONTROLS}, o GROUP BY name, expected)
SELECT name, km, km <= 12 AS coastal, (km <= 12) = (expected = 1) AS "right" FROM m""")
def agg_5_control(fx):
    return M.coast_controls(M.coast_outline(fx.sites))


def _leg_sql(a: str, b: str) -> str:
    """Estimated km between two aliased points, with the zone factor."""
    mid = f"({a}lat + {b}lat)/2", f"({a}lon + {b}lon)/2"
    near = X.hav_km(*mid, "d.zlat", "d.zlon")
    return f"round_even({X.hav_km(a + 'lat', a + 'lon', b + 'lat', b + 'lon')}*coalesce((SELECT arg_min(d.factor, {near}) FROM {X.DETOURS} WHERE {near} <= d.zkm), 1.53e0), 3)"


MARGINS = f"""n AS (SELECT plan_id, day, ord, lat, lon, lag(lat) OVER {W}) AS plat, lag(lon) OVER {W}) AS plon, lead(lat) OVER {W}) AS nlat, lead(lon) OVER {W}) AS nlon, count(*) OVER (PARTITION BY plan_id, day) AS k FROM days_fx),
e AS (SELECT *, {_leg_sql('n.p', 'n.')} AS into_, {_leg_sql('n.', 'n.n')} AS out_, {_leg_sql('n.p', 'n.n')} AS skip FROM n WHERE k >= 4),
m AS (SELECT plan_id, day, round(max(into_ + out_ - skip)/sum(into_), 4) AS share FROM e GROUP BY plan_id, day HAVING sum(into_) > 0)"""


@query("agg_15", f"WITH {MARGINS} SELECT count(*) AS days, round(median(share), 4) AS median, max(share) AS worst, count(*) FILTER (share >= 0.30) AS dear_days FROM m")
def agg_15(fx):
    return M.marginal_summary(M.marginal_cost(fx.days, ["plan_id", "day"]))


@query("agg_17_metrics", f"""
WITH {HOURS}, {MERGED}, {MEAL_STATE}, {MARGINS},
vs AS (SELECT *, category = lag(category) OVER {W}) AS same FROM timed_fx), vr AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER {W} {UP}) AS run FROM vs),
vg AS (SELECT plan_id, day, max(n) AS longest FROM (SELECT plan_id, day, run, count(*) AS n FROM vr GROUP BY plan_id, day, run) GROUP BY plan_id, day),
vd AS (SELECT plan_id, day, count(DISTINCT category) AS categories FROM timed_fx GROUP BY plan_id, day HAVING count(*) >= 3),
dd AS (SELECT s.plan_id, s.day, t.area_id AS zone, CAST(isodow(t.start_date + CAST(s.day - 1 AS INT)) - 1 AS INTEGER) AS weekday, count(*) AS n, sum(CAST(round_even(s.leg_km*1000, 0) AS BIGINT)) AS metres
FROM timed_fx s JOIN plans_fx t USING (plan_id) GROUP BY ALL),
de AS (SELECT plan_id, day, count(*) AS n, count(*) FILTER (state = 'abierto') AS o, count(*) FILTER (state = 'desconocido') AS u, count(*) FILTER (state = 'cerrado') AS c FROM ate GROUP BY plan_id, day)
SELECT zone, weekday, GROUPING(zone, weekday) AS level, count(*) AS days, CAST(sum(dd.n) AS BIGINT) AS stops, round(sum(metres)/1000, 3) AS km, CAST(coalesce(sum(de.n), 0) AS BIGINT) AS meals,
CAST(coalesce(sum(o), 0) AS BIGINT) AS abierto, CAST(coalesce(sum(u), 0) AS BIGINT) AS desconocido, CAST(coalesce(sum(c), 0) AS BIGINT) AS cerrado,
count(categories) AS varied_days, round(avg(categories), 2) AS mean_categories, count(*) FILTER (categories IS NOT NULL AND longest >= 3) AS days_with_runs, count(*) FILTER (categories = 1) AS single_days,
count(share) AS measured_days, round(median(share), 5) AS median_share, max(share) AS worst_share, count(*) FILTER (share >= 0.30) AS dear_days
FROM dd LEFT JOIN de USING (plan_id, day) LEFT JOIN vd USING (plan_id, day) LEFT JOIN vg USING (plan_id, day) LEFT JOIN m USING (plan_id, day) GROUP BY CUBE (zone, weekday)""")
def agg_17_metrics(fx):
    states = context.visit_states(dated_stops(fx))
    return M.plan_metrics(states.withColumn("state", F.when(F.col("meal").isNotNull(), F.col("state"))))


@query("agg_18", """
WITH c AS (SELECT conv_id, CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS BIGINT) AS i, CAST(coalesce(sum(length(text)) FILTER (role <> 'user'), 0) AS BIGINT) AS o FROM conversations GROUP BY conv_id)
SELECT count(*) AS calls, round(avg(i), 3) AS mean_in, round(avg(o), 3) AS mean_out, round(avg(i + o), 3) AS mean_total, median(i + o) AS median_total, max(i + o) AS worst,
round((avg(i)*1.0e0 + avg(o)*5.0e0)/1000000, 9) AS cost_usd, CAST(floor(1/((avg(i)*1.0e0 + avg(o)*5.0e0)/1000000)) AS BIGINT) AS per_dollar FROM c""")
def agg_18(fx):
    user = F.col("role") == "user"
    calls = fx.conversations.groupBy("conv_id").agg(
        F.sum(F.when(user, F.length("text")).otherwise(0)).alias("units_in"),
        F.sum(F.when(~user, F.length("text")).otherwise(0)).alias("units_out"),
    )
    return M.usage_cost(calls, 1.0, 5.0)


DATED = "SELECT s.*, t.start_date + CAST(s.day - 1 AS INT) AS date FROM timed_fx s JOIN plans_fx t USING (plan_id)"


def _dated(fx):
    return fx.timed.join(fx.plans.select("plan_id", "start_date"), "plan_id").withColumn(
        "date", R.date_of_day(F.col("start_date"), F.col("day"))
    )


MONTHS = "[" + ", ".join(X.text(m) for m in K.MONTHS_ES) + "]"


@query("agg_19", f"""
WITH d AS (SELECT plan_id, day, count(*) AS n, sum(leg_km) AS km, min(date) AS date, string_agg(category, '-' ORDER BY ord) AS strip FROM ({DATED}) GROUP BY plan_id, day),
p AS (SELECT plan_id, count(*) AS days, CAST(sum(n) AS BIGINT) AS stops, CAST(floor(round(sum(km), 6) + 0.5e0) AS BIGINT) AS km, string_agg(strip, '|' ORDER BY day) AS strips,
day(min(date)) || ' ' || substr({MONTHS}[month(min(date))], 1, 3) AS a, day(max(date)) || ' ' || substr({MONTHS}[month(max(date))], 1, 3) AS b FROM d GROUP BY plan_id)
SELECT plan_id, days, stops, km, CASE WHEN a <> b THEN a || ' – ' || b ELSE a END AS dates, strips FROM p""")
def agg_19(fx):
    return M.trip_cards(_dated(fx))


HHMM = "printf('%02d:%02d', {0}//60, {0} % 60)"


@query("agg_20", f"""
WITH l AS (SELECT DISTINCT plan_id, day, 0 AS ord, 'DÍA ' || day AS line FROM timed_fx
UNION ALL SELECT plan_id, day, ord, '  ' || printf('%02d:%02d', arrival//60, arrival % 60) || '  ' || name || ' (' || coalesce(meal, category) || ')' ||
 CASE WHEN leg_km > 0 THEN ' · ' || printf('%.1f', round_even(leg_km, 1)) || ' km · ' || leg_min || ' min' ELSE '' END FROM timed_fx
UNION ALL SELECT plan_id, day, 1000, '  * ' || count(*) || ' paradas' FROM timed_fx GROUP BY plan_id, day)
SELECT plan_id, string_agg(line, chr(10) ORDER BY day, ord, line) AS text FROM l GROUP BY plan_id""")
def agg_20(fx):
    return M.plan_text(fx.timed.withColumn("leg_km", F.bround("leg_km", 1)), F.concat(F.count(F.lit(1)), F.lit(" paradas")))


@query("win_3", f"""
WITH {ESTIMATE}, tr AS (SELECT g.origin, g.destination, coalesce(e.km, g.km) AS km, coalesce(e.minutes + 8, g.minutes) AS minutes FROM guess g LEFT JOIN edges_fx e ON e.origin = g.origin AND e.destination = g.destination AND e.source <> 'estimated'),
s AS (SELECT plan_id, day, ord, place_id, lag(place_id) OVER {W}) AS origin FROM days_fx)
SELECT s.plan_id, s.day, s.ord, coalesce(t.km, 0) AS leg_km, CAST(coalesce(t.minutes, 0) AS INTEGER) AS leg_min, floor((sum(CAST(round(coalesce(t.km, 0)*1000) AS BIGINT)) OVER (PARTITION BY s.plan_id, s.day ORDER BY s.ord {UP}) + 5)/10)/100 AS route_km
FROM s LEFT JOIN tr t ON t.origin = s.origin AND t.destination = s.place_id""")
def win_3(fx):
    table = V.travel(fx.legs, fx.edges, fx.places)
    return Q.day_legs(fx.days.select("plan_id", "day", "ord", "place_id"), table).select(
        "plan_id", "day", "ord", "leg_km", "leg_min", "route_km"
    )


@query("win_4", "SELECT plan_id, day, ord, arrival, departure FROM timed_fx")
def win_4(fx):
    return Q.schedule(fx.stops_of_plans("earliest")).select("plan_id", "day", "ord", "arrival", "departure")


def _share_sql(source: str, passes: int = 3) -> str:
    """The water-fill of each meal in turn, as CTEs."""
    parts = [f"p0 AS (SELECT *, CASE WHEN meal IS NOT NULL THEN count(meal) OVER {W} {UP}) END AS mn, row_number() OVER {W}) AS n FROM {source})"]
    for k in range(1, passes + 1):
        parts.append(f"""a{k} AS (SELECT *, CASE WHEN mn = {k} AND n > 1 THEN arrival - lag(departure) OVER {W}) - leg_min END AS idle FROM p{k - 1}),
b{k} AS (SELECT *, greatest(coalesce(max(idle) OVER (PARTITION BY plan_id, day), 0), 0) AS wait, max(CASE WHEN mn = {k} AND n > 1 THEN n END) OVER (PARTITION BY plan_id, day) AS at_ FROM a{k}),
c{k} AS (SELECT *, CASE WHEN n < at_ AND meal IS NULL THEN greatest(leave_by - departure, 0) ELSE 0 END AS room FROM b{k}),
d{k} AS (SELECT *, least(room, greatest(wait - coalesce(sum(room) OVER {W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 0)) AS take FROM c{k}),
p{k} AS (SELECT * EXCLUDE (idle, wait, at_, room, take, arrival, departure), CAST(CASE WHEN n < at_ THEN arrival + coalesce(sum(take) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE arrival END AS INTEGER) AS arrival,
CAST(CASE WHEN n < at_ THEN departure + sum(take) OVER {W} {UP}) ELSE departure END AS INTEGER) AS departure FROM d{k})""")
    return ", ".join(parts)


LEAVE = "CASE WHEN s.category IN ('nature', 'viewpoint') THEN 1095 WHEN s.category IN ('culture', 'attraction') THEN 1080 ELSE t.latest END"


@query("win_5", f"WITH {_share_sql(f'(SELECT s.*, {LEAVE} AS leave_by FROM timed_fx s JOIN plans_fx t USING (plan_id))')} SELECT plan_id, day, ord, arrival, departure FROM p3")
def win_5(fx):
    leave = R.leaving_limit(F.col("category"), F.lit(K.DUSK_MIN), F.col("latest"))
    stops = fx.clocked("latest").withColumn("leave_by", leave)
    return Q.share_waits(stops).select("plan_id", "day", "ord", "arrival", "departure")


@query("win_6", f"""
WITH s AS (SELECT *, first_value(place_id) OVER {W}) AS aid, first_value(lat) OVER {W}) AS alat, first_value(lon) OVER {W}) AS alon, row_number() OVER (PARTITION BY plan_id, day ORDER BY ord DESC) AS back FROM days_fx)
SELECT plan_id, day, ord, place_id, leg_km FROM s UNION ALL SELECT plan_id, day, ord + 1, aid, {_leg_sql('s.', 's.a')} FROM s WHERE back = 1 AND plan_id % 2 = 0 AND place_id <> aid""")
def win_6(fx):
    w = Window.partitionBy("plan_id", "day").orderBy("ord")
    stops = fx.days.withColumns({
        "anchor_id": F.first("place_id").over(w), "anchor_lat": F.first("lat").over(w),
        "anchor_lon": F.first("lon").over(w), "returns": F.col("plan_id") % 2 == 0,
    })
    return Q.with_return(stops).select("plan_id", "day", "ord", "place_id", "leg_km")


BROKEN = "SELECT * REPLACE (CASE WHEN place_id % 17 = 0 THEN arrival + 300 WHEN place_id % 13 = 0 THEN arrival - 60 ELSE arrival END AS arrival) FROM timed_fx"


def _broken(fx):
    at = F.col("arrival")
    late = F.when(F.col("place_id") % 17 == 0, at + 300).when(F.col("place_id") % 13 == 0, at - 60).otherwise(at)
    return fx.timed.withColumn("arrival", late)


ORDER_FAILS = f"""prev AS (SELECT *, lag(departure) OVER {W}) AS before FROM brk),
ordf AS (SELECT plan_id, day, ord, place_id, 'chronology' AS "check" FROM prev WHERE arrival > departure UNION ALL SELECT plan_id, day, ord, place_id, 'overlap' FROM prev WHERE arrival < before)"""


@query("win_7", f"WITH brk AS ({BROKEN}), {ORDER_FAILS} SELECT * FROM ordf")
def win_7(fx):
    return Q.order_failures(_broken(fx))


@query("win_14", f"""
WITH c AS (SELECT plan_id, day, ord, place_id, lat, lon, ord = min(ord) OVER p AS is_first, round(atan2(round(lat - avg(lat) OVER p, 9) + 0e0, round(lon - avg(lon) OVER p, 9) + 0e0), 9) AS angle FROM days_fx WINDOW p AS (PARTITION BY plan_id, day)),
a AS (SELECT *, round(angle - max(CASE WHEN is_first THEN angle END) OVER (PARTITION BY plan_id, day), 6) AS apart FROM c),
t AS (SELECT *, CASE WHEN is_first THEN -1e0 WHEN apart < 0 THEN apart + 6.283185e0 ELSE apart END AS turn FROM a)
SELECT plan_id, day, ord, CAST(row_number() OVER (PARTITION BY plan_id, day ORDER BY turn, place_id, ord) AS INTEGER) AS visit FROM t""")
def win_14(fx):
    return Q.sweep_order(fx.days).select("plan_id", "day", "ord", "visit")


@query("win_20", """
WITH l AS (SELECT user_id, event_type || '-' || (event_id % 7) AS code, max(ts) AS ts FROM events GROUP BY 1, 2)
SELECT user_id, code, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, code) AS position FROM l) WHERE position <= 5""")
def win_20(fx):
    opened = fx.events.select("user_id", "ts", F.concat("event_type", F.lit("-"), F.col("event_id") % 7).alias("code"))
    return Q.recent_plans(opened).select("user_id", "code", "position")


@query("top_6", "SELECT origin, arg_min(destination, (km, destination)) AS nearest, min(km) AS km FROM edges_fx GROUP BY origin")
def top_6(fx):
    best = F.min(F.struct("km", "destination"))
    return fx.edges.groupBy("origin").agg(best.alias("b")).select("origin", F.col("b.destination").alias("nearest"), "b.km")


GEOMETRY = "SELECT origin, destination, CAST(2 + (origin + destination) % 5 AS INTEGER) AS vertices FROM edges_fx WHERE source = 'ors'"


@query("join_21", f"""
WITH s AS (SELECT plan_id, day, ord, place_id, lag(place_id) OVER {W}) AS origin FROM days_fx)
SELECT s.plan_id, s.day, s.ord, g.vertices FROM s LEFT JOIN ({GEOMETRY}) g ON g.origin = s.origin AND g.destination = s.place_id""")
def join_21(fx):
    ends = fx.places.select("id", "lat", "lon")
    legs = fx.edges.where("source = 'ors'").join(ends.withColumnsRenamed({"id": "origin", "lat": "alat", "lon": "alon"}), "origin").join(
        ends.withColumnsRenamed({"id": "destination", "lat": "blat", "lon": "blon"}), "destination")
    n = (1 + (F.col("origin") + F.col("destination")) % 5).cast("int")
    line = F.transform(F.sequence(F.lit(0), n), lambda i: F.array(
        F.col("alon") + (F.col("blon") - F.col("alon")) * i / n, F.col("alat") + (F.col("blat") - F.col("alat")) * i / n))
    paths = legs.select("origin", F.col("destination").alias("place_id"), feeds.vertices(line).alias("path"))
    previous = F.lag("place_id").over(Window.partitionBy("plan_id", "day").orderBy("ord"))
    stops = fx.days.select("plan_id", "day", "ord", "place_id").withColumn("origin", previous)
    joined = stops.join(paths, ["origin", "place_id"], "left")
    return joined.select("plan_id", "day", "ord", F.when(F.col("path").isNotNull(), F.size("path")).alias("vertices"))


@query("join_22", "SELECT plan_id, ord, place_id FROM stops_fx WHERE place_id NOT IN (SELECT id FROM places_fx WHERE is_active)")
def join_22(fx):
    return P.invented(fx.stops, fx.places).select("plan_id", "ord", "place_id")


@query("join_23", "SELECT plan_id, day, ord, place_id, first_day FROM (SELECT *, row_number() OVER p AS n, first_value(day) OVER p AS first_day FROM days_fx WINDOW p AS (PARTITION BY plan_id, place_id ORDER BY day, ord)) WHERE n > 1")
def join_23(fx):
    return P.repeated(fx.days).select("plan_id", "day", "ord", "place_id", "first_day")


@query("join_24", """
WITH c AS (SELECT DISTINCT plan_id, day, place_id + 7*k AS id FROM days_fx, (VALUES (0), (1), (2), (3)) t(k))
SELECT plan_id, day, id FROM c WHERE id IN (SELECT id FROM places_fx) AND NOT EXISTS (SELECT 1 FROM days_fx d WHERE d.plan_id = c.plan_id AND d.place_id = c.id AND d.day <> c.day)
AND NOT EXISTS (SELECT 1 FROM edits_fx e WHERE e.plan_id = c.plan_id AND e.place_id = c.id AND e.op = 'remove')""")
def join_24(fx):
    from trailgrid.plans.build import free_candidates

    days = fx.days.select("plan_id", "day", "place_id")
    offered = days.select("plan_id", "day", F.explode(F.array(*[F.col("place_id") + 7 * k for k in range(4)])).alias("id"))
    known = offered.distinct().join(fx.places.select("id"), "id", "left_semi")
    other = days.select("plan_id", F.col("day").alias("other"), F.col("place_id").alias("id")).distinct()
    used = days.select("plan_id", "day").distinct().join(other, "plan_id").where("day <> other").select("plan_id", "day", "id")
    out = days.select("plan_id", "day").distinct().join(
        fx.edits.where("op = 'remove'").select("plan_id", F.col("place_id").alias("id")), "plan_id"
    )
    return free_candidates(known, used, out, "plan_id", "day").select("plan_id", "day", "id")


EDITED = """known AS (SELECT * FROM edits_fx WHERE place_id IN (SELECT id FROM places_fx WHERE is_active)),
gone AS (SELECT DISTINCT plan_id, day, place_id FROM known WHERE op IN ('remove', 'move')),
kept AS (SELECT m.plan_id, m.day, m.ord, m.place_id, m.meal FROM meals_fx m WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.plan_id = m.plan_id AND g.day = m.day AND g.place_id = m.place_id)),
arr AS (SELECT k.plan_id, k.to_day AS day, 1000 AS ord, k.place_id, min(m.meal) AS meal FROM known k JOIN meals_fx m ON m.plan_id = k.plan_id AND m.day = k.day AND m.place_id = k.place_id WHERE k.op = 'move' GROUP BY ALL
 UNION ALL SELECT DISTINCT plan_id, day, 1000, place_id, NULL FROM known WHERE op = 'add'),
edited AS (SELECT plan_id, day, CAST(row_number() OVER (PARTITION BY plan_id, day ORDER BY ord, place_id) AS INTEGER) AS ord, place_id, meal FROM (SELECT * FROM kept UNION ALL SELECT * FROM arr))"""


@query("plan_7", f"WITH {EDITED} SELECT plan_id, day, ord, place_id, meal FROM edited")
def plan_7(fx):
    return P.apply_edits(fx.meals, fx.edits, fx.places)


DWELL = f"coalesce({X.lookup(K.SUBCATEGORY_MINUTES, 'subcategory')}, {X.lookup(K.CATEGORY_MINUTES, 'category')}, 60)"
NEAR_ZONE = X.hav_km('(plat + lat)/2', '(plon + lon)/2', 'd.zlat', 'd.zlon')


@query("plan_7_clock", f"""
WITH {EDITED}, tch AS (SELECT plan_id, day FROM known UNION SELECT plan_id, to_day FROM known WHERE op = 'move'),
sr AS (SELECT e.*, p.category, p.subcategory, p.lat, p.lon, t.earliest, t.mode FROM edited e JOIN tch USING (plan_id, day) JOIN places_fx p ON p.id = e.place_id AND p.is_active JOIN plans_fx t USING (plan_id)),
lk AS (SELECT *, row_number() OVER {W}) AS n, lag(lat) OVER {W}) AS plat, lag(lon) OVER {W}) AS plon,
CAST(CASE WHEN meal = 'breakfast' THEN {K.BREAKFAST_MINUTES} WHEN meal IS NOT NULL THEN {K.MEAL_MINUTES} ELSE {DWELL} END AS INT) AS dwell FROM sr),
ls AS (SELECT *, {X.hav_km('plat', 'plon', 'lat', 'lon')} AS straight, coalesce((SELECT arg_min(d.factor, {NEAR_ZONE}) FROM {X.DETOURS} WHERE {NEAR_ZONE} <= d.zkm), 1.53e0) AS factor FROM lk),
lm AS (SELECT *, CASE WHEN n = 1 THEN 0e0 ELSE round_even(straight*factor, 3) END AS leg_km, CAST(CASE WHEN n = 1 THEN 0 WHEN mode = 'walking' THEN greatest(1, round_even(straight*factor/5e0*60, 0)) + 2 ELSE
greatest(1, round_even(straight*factor/(CASE WHEN straight < 2 THEN 35e0 WHEN straight < 10 THEN 41e0 WHEN straight < 50 THEN 56e0 ELSE 62e0 END)*60, 0)) + 8 END AS INT) AS leg_min FROM ls),
l0 AS (SELECT *, earliest + sum(leg_min) OVER u + sum(dwell) OVER u - dwell AS s0 FROM lm WINDOW u AS (PARTITION BY plan_id, day ORDER BY n)),
l1 AS (SELECT *, s0 + greatest(coalesce(max(CASE meal WHEN 'breakfast' THEN 390 WHEN 'lunch' THEN 690 WHEN 'dinner' THEN 1080 END - s0) OVER (PARTITION BY plan_id, day ORDER BY n), 0), 0) AS arrival FROM l0)
SELECT plan_id, day, CAST(n AS INT) AS ord, place_id, meal, CAST(arrival AS INT) AS arrival, CAST(arrival + dwell AS INT) AS departure, leg_km, leg_min, true AS touched FROM l1
UNION ALL SELECT plan_id, day, ord, place_id, meal, arrival, departure, leg_km, leg_min, false FROM timed_fx s WHERE NOT EXISTS (SELECT 1 FROM tch WHERE tch.plan_id = s.plan_id AND tch.day = s.day)""")
def plan_7_clock(fx):
    """Plans after their edits: touched days with new legs and hours, the others as they were."""
    return revise.rescheduled(fx.timed, fx.edits, fx.places, fx.plans)


@query("plan_7_missing", "SELECT DISTINCT plan_id, place_id FROM edits_fx WHERE place_id NOT IN (SELECT id FROM places_fx WHERE is_active)")
def plan_7_missing(fx):
    return P.missing_ids(fx.edits, fx.places)


@query("join_25", f"""
WITH {EDITED}, o AS (SELECT plan_id, place_id, min(day) AS old_day FROM meals_fx GROUP BY 1, 2), n AS (SELECT plan_id, place_id, min(day) AS new_day FROM edited GROUP BY 1, 2)
SELECT plan_id, place_id, old_day, new_day, CASE WHEN old_day IS NULL THEN 'entered' WHEN new_day IS NULL THEN 'left' ELSE 'moved' END AS change
FROM o FULL JOIN n USING (plan_id, place_id) WHERE old_day IS DISTINCT FROM new_day""")
def join_25(fx):
    return P.plan_diff(fx.meals, P.apply_edits(fx.meals, fx.edits, fx.places))


def _limits(fx):
    """Plan requests with arrays of what was asked, for validation."""
    empty = F.array().cast(NO_STRINGS)
    return fx.plans.join(fx.areas, "area_id").select(
        "plan_id", "earliest", "latest", "max_km", "max_stops", "include_meals", "alat", "alon", "radius_m", "mode",
        R.km_budget(F.col("max_km"), F.col("mode"), F.col("mode")).alias("budget"),
        F.when(F.col("plan_id") % 4 == 0, F.array(F.lit("lodging"))).otherwise(empty).alias("avoided"),
        F.when(F.col("plan_id") % 3 == 0, F.array(F.lit("nature"))).otherwise(empty).alias("required"),
        F.when(F.col("plan_id") % 5 == 0, F.array(F.lit("beach"), F.lit("peak"))).otherwise(empty).alias("required_subs"),
        (1 + F.col("plan_id") % 3).cast("int").alias("days_asked"),
    )


LIMITS = """lim AS (SELECT t.*, a.alat, a.alon, a.radius_m, coalesce(t.max_km, CASE t.mode WHEN 'walking' THEN 25e0 ELSE 60e0 END) AS budget,
CASE WHEN plan_id % 4 = 0 THEN ['lodging'] ELSE [] END AS avoided, CASE WHEN plan_id % 3 = 0 THEN ['nature'] ELSE [] END AS required,
CASE WHEN plan_id % 5 = 0 THEN ['beach', 'peak'] ELSE [] END AS subs, CAST(1 + plan_id % 3 AS INT) AS days_asked FROM plans_fx t JOIN areas_fx a USING (area_id)),
tot AS (SELECT plan_id, day, floor((sum(CAST(round(leg_km*1000) AS BIGINT)) + 5)/10)/100 AS km, arg_min(arrival, ord) AS start, arg_max(departure, ord) AS stop, count(*) AS stops, list(DISTINCT meal) FILTER (meal IS NOT NULL) AS meals FROM timed_fx GROUP BY plan_id, day),
vis AS (SELECT plan_id, count(DISTINCT day) AS made, list(DISTINCT category) AS cats, list(DISTINCT subcategory) AS sbs FROM timed_fx GROUP BY plan_id)"""
ANCH = f"anch AS (SELECT plan_id, day, count(*) FILTER (anchor_id IS NULL OR place_id <> anchor_id) AS visits FROM ({ANCHORED}) GROUP BY plan_id, day)"


@query("plan_3", f"""
WITH {LIMITS}, {ANCH}
SELECT plan_id, CAST(day AS INTEGER) AS day, 'earliest_start' AS "check", CAST(earliest - start AS DOUBLE) AS value FROM tot JOIN lim USING (plan_id) WHERE start < earliest
UNION ALL SELECT plan_id, day, 'latest_end', stop - latest FROM tot JOIN lim USING (plan_id) WHERE stop > latest
UNION ALL SELECT plan_id, day, 'max_travel_km_per_day', round(km - budget, 2) FROM tot JOIN lim USING (plan_id) WHERE km > budget
UNION ALL SELECT plan_id, day, 'max_stops_per_day', visits - max_stops FROM anch JOIN lim USING (plan_id) WHERE visits > max_stops
UNION ALL SELECT plan_id, day, 'avoided_categories', 1 FROM timed_fx JOIN lim USING (plan_id) WHERE list_contains(avoided, category)
UNION ALL SELECT plan_id, NULL, 'days', days_asked - coalesce(made, 0) FROM lim LEFT JOIN vis USING (plan_id) WHERE coalesce(made, 0) < days_asked
UNION ALL SELECT plan_id, NULL, 'must_include_categories', 1 FROM (SELECT plan_id, unnest(required) AS w, cats FROM lim LEFT JOIN vis USING (plan_id)) WHERE NOT coalesce(list_contains(cats, w), false)
UNION ALL SELECT plan_id, NULL, 'must_include_subcategories', 1 FROM (SELECT plan_id, unnest(subs) AS w, sbs FROM lim LEFT JOIN vis USING (plan_id)) WHERE NOT coalesce(list_contains(sbs, w), false)
UNION ALL SELECT DISTINCT plan_id, NULL, 'must_include_places', 1 FROM edits_fx e WHERE op = 'add' AND NOT EXISTS (SELECT 1 FROM timed_fx s WHERE s.plan_id = e.plan_id AND s.place_id = e.place_id)""")
def plan_3(fx):
    asked = fx.edits.where("op = 'add'").select("plan_id", "place_id").distinct()
    missing = asked.join(fx.timed.select("plan_id", "place_id"), ["plan_id", "place_id"], "left_anti").select("plan_id").distinct()
    return P.violations(_limits(fx), _anchored(fx), missing.withColumn("day", F.lit(None)))


CHECKS = f"""brk AS ({BROKEN}), {ORDER_FAILS}, {LIMITS.replace('FROM timed_fx', 'FROM brk')},
checks AS (SELECT plan_id, NULL::INTEGER AS day, 'days' AS "check" FROM lim LEFT JOIN vis USING (plan_id) WHERE coalesce(made, 0) < days_asked
UNION ALL SELECT plan_id, day, 'repeated_place' FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, place_id ORDER BY day, ord) AS n FROM brk) WHERE n > 1
UNION ALL SELECT plan_id, day, 'invented_place' FROM brk WHERE place_id NOT IN (SELECT id FROM places_fx WHERE is_active)
UNION ALL SELECT plan_id, day, 'earliest_start' FROM tot JOIN lim USING (plan_id) WHERE start < earliest
UNION ALL SELECT plan_id, day, 'latest_end' FROM tot JOIN lim USING (plan_id) WHERE stop > latest
UNION ALL SELECT plan_id, day, "check" FROM ordf
UNION ALL SELECT plan_id, day, 'max_stops_per_day' FROM tot JOIN lim USING (plan_id) WHERE stops > max_stops
UNION ALL SELECT plan_id, day, 'max_travel_km_per_day' FROM tot JOIN lim USING (plan_id) WHERE km > max_km + 0.01e0
UNION ALL SELECT plan_id, day, 'fuera_de_hora' FROM brk WHERE meal IS NULL AND ((category IN ('nature', 'viewpoint') AND departure > 1095) OR (category IN ('culture', 'attraction') AND arrival >= 1080))
UNION ALL SELECT plan_id, day, 'avoided_categories' FROM brk JOIN lim USING (plan_id) WHERE list_contains(avoided, category)
UNION ALL SELECT s.plan_id, day, 'radius' FROM brk s JOIN lim l USING (plan_id) WHERE {X.hav_km('l.alat', 'l.alon', 's.lat', 's.lon')} > radius_m/1000e0 + 0.5e0
UNION ALL SELECT plan_id, day, 'include_meals' FROM tot JOIN lim USING (plan_id) WHERE include_meals AND start <= 870 AND stop >= 690 AND NOT coalesce(list_contains(meals, 'lunch'), false)
UNION ALL SELECT plan_id, day, 'include_meals' FROM tot JOIN lim USING (plan_id) WHERE include_meals AND stop >= 1080 AND NOT coalesce(list_contains(meals, 'dinner'), false))"""


@query("plan_4", f"WITH {CHECKS} SELECT * FROM checks")
def plan_4(fx):
    return P.independent_checks(_limits(fx), _broken(fx), fx.places)


@query("set_5", f'WITH {CHECKS} SELECT "check", count(*) AS failures, count(DISTINCT plan_id) AS plans FROM checks GROUP BY "check"')
def set_5(fx):
    failures = P.independent_checks(_limits(fx), _broken(fx), fx.places)
    return failures.groupBy("check").agg(F.count(F.lit(1)).alias("failures"), F.countDistinct("plan_id").alias("plans"))


@query("agg_14", f"""
WITH {CHECKS}, bad AS (SELECT DISTINCT plan_id FROM checks WHERE "check" NOT IN ('include_meals', 'fuera_de_hora')),
c AS (SELECT count(*)::DOUBLE AS cases, count(*) FILTER (b.plan_id IS NULL)::DOUBLE AS met FROM lim LEFT JOIN bad b USING (plan_id))
SELECT 'cases' AS metric, cases AS value FROM c UNION ALL SELECT 'met', met FROM c UNION ALL SELECT 'met_share', round(met/cases, 4) FROM c
UNION ALL SELECT CASE WHEN "check" IN ('include_meals', 'fuera_de_hora') THEN 'soft:' ELSE 'hard:' END || "check", count(*)::DOUBLE FROM checks GROUP BY "check"
UNION ALL SELECT 'stops', count(*)::DOUBLE FROM brk""")
def agg_14(fx):
    limits, stops = _limits(fx), _broken(fx)
    return M.compliance(limits, P.independent_checks(limits, stops, fx.places), stops)


@query("plan_5", f"""
WITH {WET}, stops AS (SELECT plan_id, place_id, any_value(name) AS name, min(ord) AS ord FROM wet GROUP BY plan_id, place_id),
nm AS (SELECT plan_id, list(name ORDER BY ord) AS l FROM stops GROUP BY plan_id),
hr AS (SELECT plan_id, hour, hour - row_number() OVER (PARTITION BY plan_id ORDER BY hour) AS g FROM (SELECT DISTINCT plan_id, hour FROM wet)),
ru AS (SELECT plan_id, min(hour) AS a, max(hour) AS b FROM hr GROUP BY plan_id, g),
hw AS (SELECT plan_id, list(CASE WHEN a = b THEN printf('a las %02d:00', a) WHEN b >= 23 THEN printf('desde las %02d:00', a) ELSE printf('de %02d:00 a %02d:00', a, b + 1) END ORDER BY a) AS h FROM ru GROUP BY plan_id)
SELECT plan_id, 1 AS day, CAST(len(l) AS INTEGER) AS places, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' y ' || l[len(l)] END AS named,
CASE WHEN len(h) = 1 THEN h[1] ELSE array_to_string(h[1:len(h) - 1], ', ') || ' y ' || h[len(h)] END AS hours FROM nm JOIN hw USING (plan_id)""")
def plan_5(fx):
    return P.rain_advice(wet_stops(fx).withColumn("day", F.lit(1)))


@query("plan_8", f"""
SELECT s.plan_id, s.day, s.ord, s.place_id, s.name AS shown, s.category, s.subcategory, printf('%02d:%02d', s.arrival % 1440//60, s.arrival % 60) AS arrives,
printf('%02d:%02d', s.departure % 1440//60, s.departure % 60) AS leaves, s.leg_min, s.leg_km, s.meal, l.label AS cuisine, l.elevation_m, l.phone, l.website,
s.category IN ('nature', 'viewpoint') AND EXISTS (SELECT 1 FROM hourly_fx h WHERE h.date = DATE '2024-01-01' + CAST(s.plan_id % 30 AS INT) AND h.mm >= 1 AND h.hour BETWEEN s.arrival//60 AND s.departure//60) AS rained_on FROM timed_fx s JOIN (
SELECT id, {X.lookup(K.CUISINES, "coalesce(list_filter(p, lambda x: x NOT IN ('regional', 'local') AND x IN " + X.in_list(K.CUISINES) + ")[1], list_filter(p, lambda x: x IN ('regional', 'local'))[1])")} AS label,
CASE WHEN m BETWEEN 0 AND 2800 THEN CAST(m AS INTEGER) END AS elevation_m, nullif(trim(string_split(replace(coalesce(nullif(phone, ''), nullif(contact_phone, '')), ',', ';'), ';')[1]), '') AS phone, nullif(trim(string_split(website, ';')[1]), '') AS website
FROM (SELECT *, list_transform(string_split(replace(cuisine, ',', ';'), ';'), lambda q: replace(lower(trim(q)), ' ', '_')) AS p, round_even(TRY_CAST(replace(trim(regexp_replace(lower(trim(ele)), 'm$', '')), ',', '.') AS DOUBLE), 0) AS m FROM tags_fx)) l ON l.id = s.place_id""")
def plan_8(fx):
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("plan_id") % 30).cast("int"))
    stops = context.wet_stops(fx.timed.withColumns({"date": date, "cell": F.lit(0)}), weather(fx), ["cell"])
    return P.output_stops(stops, fx.tags)


HM = "printf('%02d:%02d', {0} % 1440//60, {0} % 60)"
NO_WEATHER = REASON.format(h=15, gone="w.n IS NULL")


@query("plan_8_days", f"""
WITH t AS ({TRIP_DAYS}), d AS (SELECT s.plan_id, s.day, floor((sum(CAST(round(leg_km*1000) AS BIGINT)) + 5)/10)/100 AS travel_km, arg_min(arrival, ord) AS start, arg_max(departure, ord) AS stop, count(*) AS visits FROM timed_fx s GROUP BY ALL),
w AS (SELECT date, count(*) AS n FROM hourly_fx GROUP BY date),
f AS (SELECT d.plan_id, d.day, CAST(round_even(max(temp), 0) AS INTEGER) AS temp_max, CAST(round_even(min(temp), 0) AS INTEGER) AS temp_min, round(sum(mm), 1) AS rain_mm, coalesce(max(code) FILTER (mm >= 1), max(code) FILTER (code < 51), min(code)) AS code
 FROM d JOIN t USING (plan_id, day) JOIN hourly_fx h ON h.date = t.date AND h.hour BETWEEN d.start//60 AND d.stop//60 GROUP BY ALL),
b AS (SELECT t.*, d.* EXCLUDE (plan_id, day), {NO_WEATHER} AS no_weather, {sunset_sql('t.date', 'a.alat', 'a.alon')} AS sun FROM t JOIN d USING (plan_id, day) JOIN areas_fx a USING (area_id) LEFT JOIN w ON w.date = t.date),
z AS (SELECT t.plan_id, t.day, {NO_SEA} AS no_sea, CASE WHEN {NO_SEA} IS NULL THEN w.wave_m END AS wave_m FROM t JOIN {COASTAL} c USING (area_id) LEFT JOIN {SEA} w ON w.date = t.date)
SELECT b.plan_id, b.day, b.date, {HM.format('start')} AS starts, {HM.format('stop')} AS ends, travel_km, visits, CASE WHEN sun IS NOT NULL THEN {HM.format('sun')} END AS sunset, no_weather,
CASE WHEN no_weather IS NULL THEN temp_max END AS temp_max, CASE WHEN no_weather IS NULL THEN temp_min END AS temp_min, CASE WHEN no_weather IS NULL THEN rain_mm END AS rain_mm,
CASE WHEN no_weather IS NULL AND f.plan_id IS NOT NULL THEN {X.lookup(K.WMO, 'code', X.text('sin datos'))} END AS words, no_sea, wave_m FROM b JOIN z USING (plan_id, day) LEFT JOIN f USING (plan_id, day)""")
def plan_8_days(fx):
    days = coastal_days(fx).join(fx.areas.select("area_id", "alat", "alon"), "area_id")
    stops = fx.timed.withColumn("anchor_id", F.lit(None).cast("long"))
    return P.output_days(stops, days, weather(fx), sea_days(fx), today())


@query("src_13", f"""
SELECT {X.SHARE_CODE} || '-d' || day || '-p' || (ord - 1) || '@trailgrid' AS uid, strftime(CAST(date AS TIMESTAMP) + to_minutes(CAST(arrival AS BIGINT)), '%Y%m%dT%H%M%S') AS starts,
strftime(CAST(date AS TIMESTAMP) + to_minutes(CAST(departure AS BIGINT)), '%Y%m%dT%H%M%S') AS ends, name AS summary FROM ({DATED}) WHERE plan_id % 6 <> 0""")
def src_13(fx):
    rows = _dated(fx).withColumns({
        "date": F.when(F.col("plan_id") % 6 != 0, F.col("date")), "code": keyed.share_code(F.col("plan_id")),
    })
    return keyed.calendar_events(rows).select("uid", "starts", "ends", "summary")


@query("geo_6", """
WITH RECURSIVE p AS (SELECT plan_id, day, ord, round((lon + 180)/360*1048576, 3) AS x, round((0.5e0 - ln((1 + sin(radians(lat)))/(1 - sin(radians(lat))))/(4*3.141592653589793e0))*1048576, 3) AS y FROM days_fx),
e AS (SELECT a.plan_id, a.day, a.ord AS u, b.ord AS v FROM p a JOIN p b ON a.plan_id = b.plan_id AND a.day = b.day AND a.ord <> b.ord AND sqrt((a.x - b.x)*(a.x - b.x) + (a.y - b.y)*(a.y - b.y)) < 26),
r AS (SELECT plan_id, day, u, v FROM e UNION SELECT r.plan_id, r.day, r.u, e.v FROM r JOIN e ON e.plan_id = r.plan_id AND e.day = r.day AND e.u = r.v),
g AS (SELECT plan_id, day, u AS ord, least(u, min(v)) AS c FROM r GROUP BY plan_id, day, u),
m AS (SELECT p.*, count(*) OVER w AS n, avg(x) OVER w AS cx, avg(y) OVER w AS cy, row_number() OVER (PARTITION BY p.plan_id, p.day, g.c ORDER BY p.ord) - 1 AS i FROM p JOIN g ON g.plan_id = p.plan_id AND g.day = p.day AND g.ord = p.ord WINDOW w AS (PARTITION BY p.plan_id, p.day, g.c))
SELECT plan_id, day, ord, CAST(n AS INTEGER) AS group_size, round(cx + 26/(2*sin(3.141592653589793e0/n))*cos(-3.141592653589793e0/2 + 2*3.141592653589793e0*i/n) - x, 2) AS dx,
round(cy + 26/(2*sin(3.141592653589793e0/n))*sin(-3.141592653589793e0/2 + 2*3.141592653589793e0*i/n) - y, 2) AS dy FROM m""")
def geo_6(fx):
    return M.pin_spread(fx.days, ["plan_id", "day"])


@query("flt_12", "SELECT plan_id, day, ord FROM days_fx d JOIN (SELECT plan_id AS pid, CASE WHEN plan_id % 4 = 0 THEN ['lodging'] ELSE ['food', 'culture'] END AS avoided FROM plans_fx) t ON t.pid = d.plan_id WHERE NOT list_contains(avoided, category)")
def flt_12(fx):
    from trailgrid.plans.build import without_avoided

    avoided = F.when(F.col("plan_id") % 4 == 0, F.array(F.lit("lodging"))).otherwise(F.array(F.lit("food"), F.lit("culture")))
    return without_avoided(fx.days.withColumn("avoided", avoided)).select("plan_id", "day", "ord")


RAW = """SELECT plan_id, CAST(plan_id % 10 AS INT) AS days, CAST(plan_id % 15 AS INT) AS max_stops, CAST(plan_id % 300 AS INT) AS meal_minutes,
CASE WHEN plan_id % 6 = 0 THEN NULL ELSE (plan_id % 700)*1e0 END AS max_km, CASE plan_id % 4 WHEN 0 THEN ' Walking' WHEN 1 THEN 'boat' WHEN 2 THEN NULL ELSE 'driving' END AS mode,
CASE plan_id % 5 WHEN 0 THEN '8:30' WHEN 1 THEN 'temprano' WHEN 2 THEN '25:61' WHEN 3 THEN NULL ELSE '21:00' END AS earliest_text,
CASE plan_id % 4 WHEN 0 THEN '18:15' WHEN 1 THEN NULL WHEN 2 THEN 'x:y' ELSE '23:00:10' END AS latest_text,
CASE plan_id % 3 WHEN 0 THEN 'Nature ,moon,nature' WHEN 1 THEN 'culture, FOOD' ELSE NULL END AS preferred,
CASE plan_id % 4 WHEN 0 THEN 'food' WHEN 1 THEN 'Lodging,sky' ELSE NULL END AS avoided,
CASE plan_id % 5 WHEN 0 THEN 'beach,volcano' WHEN 1 THEN 'peak' WHEN 2 THEN 'park, Beach' ELSE NULL END AS required_subcategories,
CASE plan_id % 3 WHEN 0 THEN 'LUNCH,tea' WHEN 1 THEN 'dinner, breakfast,dinner' ELSE NULL END AS must_include_meals,
CASE plan_id % 4 WHEN 0 THEN '1=walking,2=boat' WHEN 1 THEN '3=driving' WHEN 2 THEN 'first=walking' ELSE NULL END AS day_modes,
CASE plan_id % 3 WHEN 0 THEN concat('nature=', CAST(plan_id % 600 AS VARCHAR(9)), ',stars=30') WHEN 1 THEN 'food=45,culture=long' ELSE NULL END AS category_minutes,
CASE WHEN plan_id % 7 = 0 THEN NULL ELSE concat('17=', CAST(plan_id % 700 AS VARCHAR(9))) END AS place_minutes,
CASE plan_id % 5 WHEN 0 THEN 'lunch=Ice Cream,dinner=breakfast' WHEN 1 THEN 'tea=pizza,any=martian' WHEN 2 THEN 'any= Pizza' WHEN 3 THEN 'dinner=breakfast' ELSE NULL END AS meal_cuisines,
CASE plan_id % 4 WHEN 0 THEN 'pronto' WHEN 1 THEN '2023-12-31' WHEN 2 THEN CAST(start_date AS VARCHAR(10)) ELSE '2026-01-01' END AS start_text, start_date FROM {plans_fx}"""


def _raw_requests(fx):
    raw = fx.sql(RAW)
    lists = {c: F.split(c, ",") for c in ("preferred", "avoided", "required_subcategories", "must_include_meals")}
    texts = {c: F.expr(f"str_to_map({c}, ',', '=')") for c in ("day_modes", "meal_cuisines")}
    numbers = {c: F.expr(f"transform_values(str_to_map({c}, ',', '='), (k, v) -> try_cast(v AS int))") for c in ("category_minutes", "place_minutes")}
    return raw.withColumns({**lists, **texts, **numbers})


def _words_sql(column: str, allowed) -> tuple[str, str]:
    """(kept words joined, whether one was dropped) of a comma list."""
    words = f"list_transform(string_split({column}, ','), lambda v: lower(trim(v)))"
    known = f"list_filter({words}, lambda v: v IN {X.in_list(allowed)})"
    kept = f"array_to_string(list_filter({known}, lambda v, i: list_position({known}, v) = i), ',')"
    return f"CASE WHEN {column} IS NOT NULL THEN {kept} END", f"CAST(coalesce(len({words}) > len({known}), false) AS INT)"


def _pairs_sql(column: str, allowed: str, value: str = "string_split(p, '=')[2]", silent: str = "false") -> tuple[str, str]:
    """(kept pairs joined, whether one was dropped) of a list of key=value; ``k`` and ``v`` are p's halves."""
    put = lambda test: test.replace("$k", "string_split(p, '=')[1]").replace("$v", f"({value})")
    pairs = f"list_filter(string_split({column}, ','), lambda p: NOT ({put(silent)}))"
    kept = f"list_filter({pairs}, lambda p: coalesce({put(allowed)}, false))"
    said = f"array_to_string(list_transform({kept}, lambda p: string_split(p, '=')[1] || '=' || ({value})), ',')"
    return f"CASE WHEN {column} IS NOT NULL THEN {said} END", f"CAST(coalesce(len({pairs}) > len({kept}), false) AS INT)"


def _flt_13() -> str:
    meals = X.in_list((*K.MEAL_WINDOWS, "any"))
    number = "TRY_CAST(string_split(p, '=')[2] AS INT)"
    spelt = "replace(lower(trim(string_split(p, '=')[2])), ' ', '_')"
    fields = {
        "preferred": _words_sql("preferred", K.CATEGORIES), "avoided": _words_sql("avoided", K.CATEGORIES),
        "subs": _words_sql("required_subcategories", K.REQUIRABLE_SUBCATEGORIES), "meals": _words_sql("must_include_meals", K.MEAL_WINDOWS),
        "modes": _pairs_sql("day_modes", "regexp_matches($k, '^\\s*\\d+\\s*$') AND $v IN ('driving', 'walking')"),
        "minutes": _pairs_sql("category_minutes", f"$k IN {X.in_list(K.CATEGORIES)} AND $v BETWEEN 10 AND 480", number),
        "places": _pairs_sql("place_minutes", "$v BETWEEN 10 AND 480", number),
        "cuisines": _pairs_sql("meal_cuisines", f"$k IN {meals} AND $v IN {X.in_list(K.CUISINES)}", spelt, f"$k IN {meals} AND $v IN {X.in_list(K.CUISINES_THAT_ARE_MEALS)}"),
    }
    clock = "'^\\s*(\\d+)\\s*:\\s*(\\d+)\\s*(:.*)?$'"
    minute = lambda c: f"(TRY_CAST(regexp_extract({c}, {clock}, 1) AS INT) % 24)*60 + TRY_CAST(regexp_extract({c}, {clock}, 2) AS INT) % 60"
    date = "try_cast(start_text AS DATE)"
    notes = " + ".join([
        "CAST(days < 1 OR days > 7 AS INT)", "CAST(max_stops < 1 OR max_stops > 12 AS INT)", "CAST(meal_minutes < 20 OR meal_minutes > 240 AS INT)",
        "CAST(coalesce(max_km < 1 OR max_km > 500, false) AS INT)", "CAST(earliest_text IS NOT NULL AND e IS NULL AS INT)", "CAST(latest_text IS NOT NULL AND l IS NULL AS INT)",
        "CAST(coalesce(e, 540) >= coalesce(l, 1200) AS INT)", f"CAST({date} IS NULL OR {date} < DATE '2024-01-05' OR {date} > DATE '2025-01-04' AS INT)",
        *[note for _, note in fields.values()],
    ])
    said = ", ".join(f"{kept} AS {name}" for name, (kept, _) in fields.items())
    return f"""WITH r AS (SELECT *, {minute('earliest_text')} AS e, {minute('latest_text')} AS l FROM ({RAW.replace('{', '').replace('}', '')}))
SELECT plan_id, CAST(least(greatest(days, 1), 7) AS INTEGER) AS days, CAST(least(greatest(max_stops, 1), 12) AS INTEGER) AS max_stops, CAST(least(greatest(meal_minutes, 20), 240) AS INTEGER) AS meal_minutes,
CASE WHEN max_km IS NOT NULL THEN least(greatest(max_km, 1e0), 500e0) END AS max_km, CASE WHEN lower(trim(mode)) = 'walking' THEN 'walking' ELSE 'driving' END AS mode,
CAST(CASE WHEN coalesce(e, 540) >= coalesce(l, 1200) THEN 540 ELSE coalesce(e, 540) END AS INTEGER) AS earliest, CAST(CASE WHEN coalesce(e, 540) >= coalesce(l, 1200) THEN 1200 ELSE coalesce(l, 1200) END AS INTEGER) AS latest,
{said}, CAST({notes} AS INTEGER) AS notes FROM r"""


@query("flt_13", _flt_13())
def flt_13(fx):
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    clean = R.clean_requests(_raw_requests(fx), F.lit("2024-01-05").cast("date"))
    return clean.select(
        "plan_id", "days", "max_stops", "meal_minutes", "max_km", "mode", "earliest", "latest",
        F.array_join("preferred", ",").alias("preferred"), F.array_join("avoided", ",").alias("avoided"),
        F.array_join("required_subcategories", ",").alias("subs"), F.array_join("must_include_meals", ",").alias("meals"),
        flat("day_modes").alias("modes"), flat("category_minutes").alias("minutes"), flat("place_minutes").alias("places"),
        flat("meal_cuisines").alias("cuisines"), F.size("notes").alias("notes"),
    )


@query("flt_14", """
SELECT plan_id, CASE WHEN plan_id % 4 = 2 AND start_date >= DATE '2024-01-05' THEN start_date END AS start_date,
CASE plan_id % 4 WHEN 0 THEN 'fecha ilegible' WHEN 1 THEN 'fecha pasada' WHEN 3 THEN 'fecha lejana' ELSE CASE WHEN start_date < DATE '2024-01-05' THEN 'fecha pasada' END END AS note FROM plans_fx""")
def flt_14(fx):
    date, note = R.clean_date(F.col("start_text"), F.lit("2024-01-05").cast("date"))
    return _raw_requests(fx).select("plan_id", date.alias("start_date"), note.alias("note"))


@query("flt_15", """
SELECT plan_id, CASE WHEN earliest >= latest - 420 THEN 'horario' WHEN plan_id % 3 = 0 THEN 'preferidas y evitadas' WHEN plan_id % 5 = 0 THEN 'exigidas y evitadas' END AS reason FROM plans_fx""")
def flt_15(fx):
    k = F.col("plan_id")
    kind = lambda n: F.when(k % n == 0, F.array(F.lit("food"), F.lit("nature"))).otherwise(F.array(F.lit("viewpoint")))
    reason = R.incoherence(F.col("earliest"), F.col("latest") - 420, kind(3), F.array(F.lit("food")), kind(5))
    return fx.plans.select("plan_id", reason.alias("reason"))


def _dwell_maps():
    k = F.col("plan_id")
    return {
        "place_minutes": F.when(k % 3 == 0, F.create_map((k % 7 + F.col("place_id") - k % 7).cast("string"), F.lit(33))),
        "category_minutes": F.when(k % 3 == 1, F.create_map(F.lit("nature"), F.lit(77))),
    }


@query("time_6", f"""
SELECT d.plan_id, d.day, d.ord, CAST(CASE WHEN d.meal = 'breakfast' THEN CASE WHEN d.plan_id % 2 = 0 THEN 45 ELSE 60 END WHEN d.meal IS NOT NULL THEN CASE WHEN d.plan_id % 2 = 0 THEN 90 ELSE 60 END
WHEN d.ord = 1 AND d.day = 1 AND d.plan_id % 4 = 0 THEN 0 WHEN d.plan_id % 3 = 0 THEN 33 WHEN d.plan_id % 3 = 1 AND d.category = 'nature' THEN 77
ELSE coalesce({X.lookup(K.SUBCATEGORY_MINUTES, 'd.subcategory')}, {X.lookup(K.CATEGORY_MINUTES, 'd.category')}, 60) END AS INTEGER) AS dwell FROM days_fx d""")
def time_6(fx):
    maps = _dwell_maps()
    minutes = R.dwell_minutes(
        meal=F.col("meal"), meal_minutes=F.when(F.col("plan_id") % 2 == 0, K.MEAL_MINUTES).otherwise(60),
        is_anchor=(F.col("ord") == 1) & (F.col("day") == 1) & (F.col("plan_id") % 4 == 0),
        place_minutes=maps["place_minutes"], place=F.col("place_id"), category_minutes=maps["category_minutes"],
        category=F.col("category"), subcategory=F.col("subcategory"),
    )
    return fx.days.select("plan_id", "day", "ord", minutes.cast("int").alias("dwell"))


TRIP3 = "(SELECT t.*, n AS day, CASE WHEN plan_id % 4 = 1 AND n = 2 THEN 'walking' ELSE mode END AS day_mode FROM plans_fx t, (VALUES (1), (2), (3)) v(n))"


def _trip3(fx):
    modes = F.when(F.col("plan_id") % 4 == 1, F.create_map(F.lit("2"), F.lit("walking")))
    days = fx.plans.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return days.withColumn("day_mode", R.mode_for(modes, F.col("mode"), F.col("day")))


@query("time_7", f"""SELECT plan_id, day, CASE WHEN max_km IS NULL THEN CASE day_mode WHEN 'walking' THEN 25e0 ELSE 60e0 END WHEN day_mode = mode THEN max_km WHEN day_mode = 'walking' THEN 8e0 ELSE 25e0 END AS budget FROM {TRIP3}""")
def time_7(fx):
    return _trip3(fx).select("plan_id", "day", R.km_budget(F.col("max_km"), F.col("mode"), F.col("day_mode")).alias("budget"))


@query("time_8", """
SELECT plan_id, array_to_string(list_filter([CASE WHEN plan_id % 2 = 0 AND earliest <= 570 THEN 'breakfast' END, CASE WHEN latest >= 690 AND earliest <= 870 THEN 'lunch' END, CASE WHEN latest >= 1080 THEN 'dinner' END], lambda x: x IS NOT NULL AND include_meals), ',') AS meals,
CAST(CASE WHEN NOT include_meals THEN 0 WHEN earliest + coalesce(max_stops, 12)*102 >= 1080 AND latest >= 1080 THEN 2 ELSE 1 END AS INTEGER) AS fit FROM plans_fx""")
def time_8(fx):
    named = F.when(F.col("plan_id") % 2 == 0, F.array(F.lit("breakfast"))).otherwise(F.array().cast(NO_STRINGS))
    windows = R.meal_windows(F.col("earliest"), F.col("latest"), F.col("include_meals"), named)
    cap = R.stop_cap(F.col("max_stops"))
    return fx.plans.select(
        "plan_id", F.array_join(F.transform(windows, lambda w: w["meal"]), ",").alias("meals"),
        R.meals_that_fit(F.col("earliest"), F.col("latest"), cap, F.col("include_meals"), F.lit(K.TYPICAL_VISIT_MIN)).alias("fit"),
    )


@query("time_9", f"""
SELECT s.plan_id, s.day, s.ord, CASE WHEN category IN ('nature', 'viewpoint') THEN arrival + dwell > {sunset_sql('s.date', 's.lat', 's.lon')} WHEN category IN ('culture', 'attraction') THEN arrival >= 1080 ELSE false END AS late FROM ({DATED}) s""")
def time_9(fx):
    light = C.sunset_minute("date", "lat", "lon")
    rows = _dated(fx).withColumn("light", light)
    return rows.select("plan_id", "day", "ord", R.too_late(F.col("category"), F.col("arrival"), F.col("dwell"), F.col("light")).alias("late"))


@query("arr_1", f"""SELECT t.plan_id, t.day, t.day_mode AS mode, CASE WHEN t.plan_id % 2 = 0 THEN 'pizza' ELSE 'sushi' END AS lunch, CASE WHEN t.plan_id % 2 = 0 THEN 'pizza' END AS dinner FROM {TRIP3} t""")
def arr_1(fx):
    even = F.col("plan_id") % 2 == 0
    cuisines = F.when(even, F.create_map(F.lit("any"), F.lit("pizza"))).otherwise(F.create_map(F.lit("lunch"), F.lit("sushi")))
    return _trip3(fx).select(
        "plan_id", "day", F.col("day_mode").alias("mode"), R.cuisine_for(cuisines, F.lit("lunch")).alias("lunch"),
        R.cuisine_for(cuisines, F.lit("dinner")).alias("dinner"),
    )


@query("set_3", "SELECT id, CASE WHEN category = 'food' THEN 'food' ELSE 'destination' END AS side FROM places_fx WHERE is_active")
def set_3(fx):
    from trailgrid.plans.build import split_food

    food, other = split_food(S.usable(fx.places))
    return food.select("id", F.lit("food").alias("side")).unionByName(other.select("id", F.lit("destination").alias("side")))
