"""Sun, weather, sea and opening hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import geo as G
from trailgrid.functions import hours as H
from trailgrid.functions import text as T
from trailgrid.functions import timectx as C
from trailgrid.operators import context as W
from trailgrid.plans import requests as R
from workload import sqltext as X
from workload.base import query

TODAY = "2024-01-05"


def today():
    return F.lit(TODAY).cast("date")


def sunset_sql(date: str, lat: str, lon: str) -> str:
    """Sunset minute from tables of series terms, summed by a query."""
    def series(terms) -> str:
        rows = ", ".join(f"({n}, {c}e0, {s}e0)" for n, (c, s) in enumerate(((terms[0], 0.0), *terms[1:])))
        return f"(SELECT sum(c*cos(n*w.g) + s*sin(n*w.g) ORDER BY n) FROM (VALUES {rows}) t(n, c, s))"

    return f"""(SELECT CASE WHEN abs(h) <= 1 THEN CAST((round_even(720 - 360 - 4*lo + 4*degrees(acos(greatest(-1, least(1, h)))) - eq, 0) % 1440 + 1440) % 1440 AS INTEGER) END FROM (
SELECT lo, eq, cos(radians(90.833e0))/(cos(la)*cos(de)) - tan(la)*tan(de) AS h FROM (
SELECT radians({lat}) AS la, {lon} AS lo, {series(K.DECLINATION)} AS de, {series(K.TIME_EQUATION)} AS eq FROM (
SELECT (dayofyear({date}) - 1 + 0.5e0)*2*pi()/365 AS g) w)))"""


@query("time_1", f"SELECT s.plan_id, s.ord, {sunset_sql('s.day', 'p.lat', 'p.lon')} AS sunset FROM stops_fx s JOIN places_fx p ON p.id = s.place_id")
def time_1(fx):
    stops = fx.stops.join(fx.places.select(F.col("id").alias("place_id"), "lat", "lon"), "place_id")
    return stops.select("plan_id", "ord", C.sunset_minute("day", "lat", "lon").alias("sunset"))


@query("time_2", f"SELECT t.plan_id, coalesce(CASE WHEN t.plan_id % 4 <> 0 THEN {sunset_sql('t.start_date', 'a.alat', 'a.alon')} END, 1095) AS light FROM plans_fx t JOIN areas_fx a USING (area_id)")
def time_2(fx):
    plans = fx.plans.join(fx.areas, "area_id")
    date = F.when(F.col("plan_id") % 4 != 0, F.col("start_date"))
    return plans.select("plan_id", R.light_limit(date, F.col("alat"), F.col("alon")).alias("light"))


@query("time_3", "SELECT event_id, CAST((isodow(ts) - 1)*1440 + hour(ts)*60 + minute(ts) AS INTEGER) AS minute FROM requests_fx")
def time_3(fx):
    return fx.requests.select(
        "event_id", C.minute_of_week(F.col("ts").cast("date"), F.hour("ts") * 60 + F.minute("ts")).alias("minute")
    )


DAY_RE = "(mo|tu|we|th|fr|sa|su)"
HOURS = f"""txt AS (SELECT DISTINCT opening_hours FROM tags_fx WHERE opening_hours IS NOT NULL),
cl AS (SELECT opening_hours, trim(lower(translate(opening_hours, {X.text(K.DASHES)}, '-----'))) AS c FROM txt),
ru AS (SELECT opening_hours, c, i, trim(list_extract(l, i)) AS rule FROM (SELECT opening_hours, c, string_split(regexp_replace(c, ',(\\s*{DAY_RE}\\b)', ';\\1', 'g'), ';') AS l FROM cl), unnest(range(1, len(l) + 1)) u(i)),
pa AS (SELECT *, regexp_extract(rule, '^(.*?)(\\d{{1,2}}:\\d{{2}}.*)$', 1) AS head, regexp_extract(rule, '^(.*?)(\\d{{1,2}}:\\d{{2}}.*)$', 2) AS tail FROM ru WHERE rule <> ''),
dw AS (SELECT *, CASE WHEN tail <> '' THEN regexp_replace(trim(head), '[,\\s]+$', '') WHEN regexp_matches(rule, '(off|closed)$') THEN trim(regexp_replace(rule, '(\\s\\S*|^\\S*)$', '')) END AS dtext FROM pa),
dl AS (SELECT *, CASE WHEN dtext IS NOT NULL THEN list_filter(regexp_split_to_array(regexp_replace(dtext, '\\s*-\\s*', '-', 'g'), '[,\\s]+'), lambda w: w <> '') END AS w FROM dw),
dk AS (SELECT *, len(list_filter(w, lambda x: NOT regexp_full_match(x, '{DAY_RE}(-{DAY_RE})?'))) = 0 AS known,
list_filter(list_transform(string_split(tail, ','), lambda p: trim(p)), lambda p: regexp_full_match(p, '\\d{{1,2}}:\\d{{2}}\\s*-\\s*\\d{{1,2}}:\\d{{2}}')) AS sp FROM dl WHERE w IS NOT NULL),
rd AS (SELECT DISTINCT opening_hours, i, sp, tail, d FROM dk, unnest(range(0, 7)) t(d) WHERE known AND (tail = '' OR len(sp) > 0) AND (len(w) = 0 OR
 len(list_filter(w, lambda x: ((d - CAST((instr('mo tu we th fr sa su', substr(x, 1, 2)) - 1)/3 AS INT)) % 7 + 7) % 7 <= ((CAST((instr('mo tu we th fr sa su', right(x, 2)) - 1)/3 AS INT) - CAST((instr('mo tu we th fr sa su', substr(x, 1, 2)) - 1)/3 AS INT)) % 7 + 7) % 7)) > 0)),
lr AS (SELECT opening_hours, d, arg_max({{'s': sp}}, i).s AS sp FROM rd GROUP BY opening_hours, d),
sl AS (SELECT opening_hours, d, CAST(regexp_extract(s, '^(\\d+):(\\d+)\\s*-\\s*(\\d+):(\\d+)$', 1) AS INT)*60 + CAST(regexp_extract(s, '^(\\d+):(\\d+)\\s*-\\s*(\\d+):(\\d+)$', 2) AS INT) AS o,
CAST(regexp_extract(s, '^(\\d+):(\\d+)\\s*-\\s*(\\d+):(\\d+)$', 3) AS INT)*60 + CAST(regexp_extract(s, '^(\\d+):(\\d+)\\s*-\\s*(\\d+):(\\d+)$', 4) AS INT) AS c FROM lr, unnest(sp) u(s)),
iv AS (SELECT opening_hours, CAST(d*1440 + o AS INTEGER) AS opens, CAST(d*1440 + c + CASE WHEN c < o THEN 1440 ELSE 0 END AS INTEGER) AS closes FROM sl WHERE o <> c AND opening_hours NOT IN ('24/7')
UNION SELECT opening_hours, 0, 10080 FROM txt WHERE opening_hours = '24/7'),
known AS (SELECT DISTINCT opening_hours FROM rd UNION SELECT opening_hours FROM txt WHERE opening_hours = '24/7')"""


@query("time_4", f"WITH {HOURS} SELECT t.opening_hours, k.opening_hours IS NOT NULL AS known, iv.opens, iv.closes FROM txt t LEFT JOIN known k USING (opening_hours) LEFT JOIN iv USING (opening_hours)")
def time_4(fx):
    parsed = H.parse_hours(fx.tags)
    return parsed.select("opening_hours", F.col("open").isNotNull().alias("known"), F.explode_outer("open").alias("s")).select(
        "opening_hours", "known", "s.opens", "s.closes"
    )


VISITS = """SELECT plan_id, ord, place_id, date, arrival, arrival + dwell AS departure FROM (SELECT s.plan_id, s.ord, s.place_id, s.day AS date, CAST(420 + (s.place_id*7 + s.ord*131) % 900 AS INT) AS arrival, CAST(s.dwell_min AS INT) AS dwell FROM stops_fx s) t"""
MINUTE = "(isodow(v.date) - 1)*1440 + v.arrival"
MERGED = """wk AS (SELECT opening_hours, opens, closes FROM iv UNION ALL SELECT opening_hours, opens + 10080, closes + 10080 FROM iv UNION ALL SELECT opening_hours, 0, closes - 10080 FROM iv WHERE closes > 10080),
mk AS (SELECT *, max(closes) OVER (PARTITION BY opening_hours ORDER BY opens, closes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM wk),
gr AS (SELECT *, sum(CASE WHEN before >= opens THEN 0 ELSE 1 END) OVER (PARTITION BY opening_hours ORDER BY opens, closes) AS g FROM mk),
mg AS (SELECT opening_hours, min(opens) AS opens, max(closes) AS closes FROM gr GROUP BY opening_hours, g)"""
STATE = f"""states AS (SELECT v.*, t.opening_hours, CASE WHEN k.opening_hours IS NULL THEN 'desconocido'
WHEN EXISTS (SELECT 1 FROM mg WHERE mg.opening_hours = t.opening_hours AND mg.opens <= {MINUTE} AND mg.closes >= {MINUTE} + v.departure - v.arrival) THEN 'abierto' ELSE 'cerrado' END AS state
FROM ({VISITS}) v JOIN tags_fx t ON t.id = v.place_id LEFT JOIN known k ON k.opening_hours = t.opening_hours)"""


def _visits(fx):
    visits = fx.sql(VISITS.replace("FROM stops_fx", "FROM {stops_fx}"))
    return visits.join(fx.tags.select(F.col("id").alias("place_id"), "opening_hours"), "place_id")


@query("join_20", f"WITH {HOURS}, {MERGED}, {STATE} SELECT plan_id, ord, state FROM states")
def join_20(fx):
    return W.visit_states(_visits(fx)).select("plan_id", "ord", "state")


MEAL_STATE = f"""v AS (SELECT s.plan_id, s.day, s.leg_km, s.place_id, t.area_id AS zone, t.start_date + CAST(s.day - 1 AS INT) AS date, s.arrival, s.departure FROM timed_fx s JOIN plans_fx t USING (plan_id) WHERE s.meal IS NOT NULL),
ate AS (SELECT v.*, CASE WHEN k.opening_hours IS NULL THEN 'desconocido'
WHEN EXISTS (SELECT 1 FROM mg WHERE mg.opening_hours = t.opening_hours AND mg.opens <= {MINUTE} AND mg.closes >= {MINUTE} + v.departure - v.arrival) THEN 'abierto' ELSE 'cerrado' END AS state
FROM v LEFT JOIN tags_fx t ON t.id = v.place_id LEFT JOIN known k ON k.opening_hours = t.opening_hours)"""


def dated_stops(fx):
    """Finished stops with their zone, date and the hours known of the place, read once per text of the catalogue."""
    days = fx.plans.select("plan_id", F.col("area_id").alias("zone"), "start_date")
    dated = fx.timed.join(days, "plan_id").withColumn("date", R.date_of_day(F.col("start_date"), F.col("day")))
    known = H.with_hours(fx.tags.select(F.col("id").alias("place_id"), "opening_hours"), runs=True).drop("opening_hours")
    return dated.join(known, "place_id", "left")


@query("agg_17", f"""WITH {HOURS}, {MERGED}, {MEAL_STATE} SELECT zone, CAST(isodow(date) - 1 AS INTEGER) AS weekday, state, GROUPING(zone, isodow(date), state) AS level, count(*) AS meals,
round(sum(CAST(round_even(leg_km*1000, 0) AS BIGINT))/1000, 3) AS km FROM ate GROUP BY CUBE (zone, isodow(date), state)""")
def agg_17(fx):
    return W.meal_hours_audit(dated_stops(fx).where("meal IS NOT NULL"))


@query("time_5", "SELECT plan_id, ord, ((arrival + 900) % 1440) AS wrapped, 900 - arrival AS apart, printf('%02d:%02d', ((arrival + 900) % 1440)//60, (arrival + 900) % 60) AS clock FROM (" + VISITS + ")")
def time_5(fx):
    later = F.col("arrival") + 900
    return _visits(fx).select(
        "plan_id", "ord", C.add_minutes("arrival", F.lit(900)).alias("wrapped"), (900 - F.col("arrival")).alias("apart"),
        C.clock(later).alias("clock"),
    )


@query("time_10", f"SELECT date, hour, mm >= 1 AS rain, {X.lookup(K.WMO, 'code', X.text('sin datos'))} AS words FROM hourly_fx")
def time_10(fx):
    return fx.hourly.select("date", "hour", C.is_rain("mm").alias("rain"), C.weather_words("code").alias("words"))


COMPASS = "[" + ", ".join(X.text(w) for w in K.COMPASS) + "]"


@query("time_11", f"""SELECT event_id, {COMPASS}[CAST(floor((event_id*37 % 360 + 22.5e0)/45) AS INT) % 8 + 1] AS heading,
CASE WHEN value >= 13 THEN 'marejada de fondo' WHEN value >= 10 THEN 'marejada' ELSE 'mar de viento' END AS swell FROM events""")
def time_11(fx):
    return fx.events.select(
        "event_id", C.compass(F.col("event_id") * 37 - 720).alias("heading"), C.swell("value").alias("swell")
    )


LIGHT_CASES = f"SELECT plan_id, ord, arrival AS a, departure AS b, 1020 + CAST(place_id % 90 AS INT) AS s FROM ({VISITS})"


@query("time_12", f"SELECT plan_id, ord, round(CASE WHEN s >= b THEN 1e0 WHEN s <= a THEN 0e0 ELSE (s - a)/(b - a)::DOUBLE END, 6) AS light FROM ({LIGHT_CASES})")
def time_12(fx):
    visits = _visits(fx).withColumn("s", (1020 + F.col("place_id") % 90).cast("int"))
    return visits.select("plan_id", "ord", F.round(C.light_share("arrival", "departure", "s"), 6).alias("light"))


RAIN_DAYS = "rain AS (SELECT day(date) AS dd, date, hour FROM hourly_fx WHERE mm >= 1)"


@query("time_13", f"""
WITH {RAIN_DAYS}, v AS (SELECT plan_id, ord, arrival AS a, departure + 200 AS b, DATE '2024-01-01' + CAST(plan_id % 30 AS INT) AS d FROM ({VISITS})),
h AS (SELECT v.*, r.hour, r.hour - row_number() OVER (PARTITION BY plan_id, ord ORDER BY r.hour) AS g FROM v JOIN rain r ON r.date = v.d AND r.hour*60 < b AND r.hour*60 + 60 > a)
SELECT plan_id, ord, round((greatest(min(hour)*60, any_value(a)) - any_value(a))::DOUBLE/(any_value(b) - any_value(a)), 6) AS begins,
round((least(max(hour)*60 + 60, any_value(b)) - any_value(a))::DOUBLE/(any_value(b) - any_value(a)), 6) AS ends FROM h GROUP BY plan_id, ord, g""")
def time_13(fx):
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("plan_id") % 30).cast("int"))
    visits = _visits(fx).select("plan_id", "ord", "arrival", (F.col("departure") + 200).alias("departure"), start.alias("date"))
    runs = W.rain_stretches(visits, fx.hourly.where(C.is_rain("mm")), [])
    return runs.select("plan_id", "ord", F.round("begins", 6).alias("begins"), F.round("ends", 6).alias("ends"))


@query("txt_22", """
WITH h AS (SELECT date, hour, hour - row_number() OVER (PARTITION BY date ORDER BY hour) AS g FROM hourly_fx WHERE mm >= 1),
r AS (SELECT date, min(hour) AS a, max(hour) AS b FROM h GROUP BY date, g),
w AS (SELECT date, list(CASE WHEN a = b THEN printf('a las %02d:00', a) WHEN b >= 23 THEN printf('desde las %02d:00', a) ELSE printf('de %02d:00 a %02d:00', a, b + 1) END ORDER BY a) AS l FROM r GROUP BY date)
SELECT date, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' y ' || l[len(l)] END AS said FROM w""")
def txt_22(fx):
    rain = fx.hourly.where(C.is_rain("mm")).groupBy("date").agg(F.collect_set("hour").alias("rainy"))
    runs = rain.withColumn("runs", C.hour_runs(F.col("rainy")))
    return runs.select("date", T.hour_phrases(F.col("runs")).alias("said"))


@query("win_8", "WITH h AS (SELECT date, hour, hour - row_number() OVER (PARTITION BY date ORDER BY hour) AS g FROM hourly_fx WHERE mm >= 1) SELECT date, min(hour) AS first, max(hour) AS last FROM h GROUP BY date, g")
def win_8(fx):
    rain = fx.hourly.where(C.is_rain("mm")).groupBy("date").agg(F.collect_set("hour").alias("rainy"))
    return rain.select("date", F.inline(C.hour_runs(F.col("rainy"))))


WEEKDAYS = "[" + ", ".join(X.text(w) for w in K.WEEKDAYS_ES) + "]"
MONTHS = "[" + ", ".join(X.text(w) for w in K.MONTHS_ES) + "]"


@query("txt_23", f"SELECT o_orderkey, {WEEKDAYS}[isodow(o_orderdate)] || ' ' || day(o_orderdate) || ' de ' || {MONTHS}[month(o_orderdate)] AS said FROM orders")
def txt_23(fx):
    return fx.orders.select("o_orderkey", T.date_words(F.col("o_orderdate").cast("date")).alias("said"))


TRIP_DAYS = "SELECT plan_id, area_id, CASE WHEN plan_id % 9 = 0 THEN NULL ELSE start_date END AS start_date, n AS day, CASE WHEN plan_id % 9 = 0 THEN NULL ELSE start_date + CAST(n - 1 AS INT) END AS date FROM plans_fx, (VALUES (1), (2), (3)) t(n)"
REASON = f"CASE WHEN start_date IS NULL THEN 'sin_fecha' WHEN start_date > DATE '{TODAY}' + {{h}} OR t.date > DATE '{TODAY}' + {{h}} THEN 'fuera_de_pronostico' WHEN {{gone}} THEN 'sin_servicio' END"


def _trip_days(fx):
    dated = F.when(F.col("plan_id") % 9 != 0, F.col("start_date"))
    days = fx.plans.select("plan_id", "area_id", dated.alias("start_date"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("day"))
    return days.withColumns({"date": R.date_of_day(F.col("start_date"), F.col("day")), "cell": F.lit(0)})


def weather(fx):
    return W.weather_days(fx.hourly.withColumn("cell", F.lit(0)), ["cell"])


@query("join_18", f"""
SELECT t.plan_id, t.day, {REASON.format(h=15, gone='w.n IS NULL')} AS reason,
CASE WHEN {REASON.format(h=15, gone='w.n IS NULL')} IS NULL THEN w.n END AS hours FROM ({TRIP_DAYS}) t LEFT JOIN (SELECT date, CAST(count(*) AS INTEGER) AS n FROM hourly_fx GROUP BY date) w ON w.date = t.date""")
def join_18(fx):
    days = W.forecast_for(_trip_days(fx), weather(fx), ["cell"], today())
    return days.select("plan_id", "day", "reason", F.when(F.col("hours").isNotNull(), F.size("hours")).alias("hours"))


@query("agg_12", """
WITH d AS (SELECT t.plan_id, t.earliest AS a, t.latest AS b, h.* FROM plans_fx t JOIN hourly_fx h ON h.date = t.start_date AND h.hour BETWEEN t.earliest//60 AND t.latest//60)
SELECT plan_id, CAST(round_even(max(temp), 0) AS INTEGER) AS temp_max, CAST(round_even(min(temp), 0) AS INTEGER) AS temp_min, round(sum(mm), 1) AS rain_mm,
coalesce(string_agg(CAST(hour AS VARCHAR), ',' ORDER BY hour) FILTER (mm >= 1), '') AS rain_hours,
coalesce(max(code) FILTER (mm >= 1), max(code) FILTER (code < 51), min(code)) AS code FROM d GROUP BY plan_id""")
def agg_12(fx):
    days = fx.plans.select("plan_id", F.col("start_date").alias("date"), F.col("earliest").alias("start"), F.col("latest").alias("stop"), F.lit(0).alias("cell"))
    summary = W.day_weather(days.join(weather(fx), ["cell", "date"]))
    return summary.select(
        "plan_id", "temp_max", "temp_min", F.round("rain_mm", 1).alias("rain_mm"),
        F.array_join(F.transform("rain_hours", lambda h: h.cast("string")), ",").alias("rain_hours"), "code",
    )


SEA = "(SELECT date, round(max(mm)/10, 2) AS wave_m FROM hourly_fx WHERE day(date) % 4 <> 0 GROUP BY date)"
COASTAL = f"(SELECT a.area_id, min({X.hav_km('a.alat', 'a.alon', 'c.clat', 'c.clon')}) <= 12 AS coastal FROM areas_fx a, {X.COAST} GROUP BY a.area_id)"
NO_SEA = f"CASE WHEN NOT c.coastal THEN 'tierra_adentro' ELSE {REASON.format(h=6, gone='w.wave_m IS NULL')} END"


def sea_days(fx):
    return fx.hourly.where("day(date) % 4 <> 0").groupBy("date").agg(F.round(F.max("mm") / 10, 2).alias("wave_m")).withColumn("cell", F.lit(0))


def coastal_days(fx):
    return _trip_days(fx).join(fx.areas.select("area_id", G.is_coastal("alat", "alon").alias("coastal")), "area_id")


@query("join_18_sea", f"""
SELECT t.plan_id, t.day, {NO_SEA} AS reason, CASE WHEN {NO_SEA} IS NULL THEN w.wave_m END AS wave_m
FROM ({TRIP_DAYS}) t JOIN {COASTAL} c USING (area_id) LEFT JOIN {SEA} w ON w.date = t.date""")
def join_18_sea(fx):
    return W.sea_for(coastal_days(fx), sea_days(fx), ["cell"], today()).select("plan_id", "day", "reason", "wave_m")


WET = f"""wet AS (SELECT v.plan_id, v.ord, v.place_id, p.name, DATE '2024-01-01' + CAST(v.plan_id % 30 AS INT) AS date, h.hour FROM ({VISITS}) v JOIN places_fx p ON p.id = v.place_id AND p.category IN ('nature', 'viewpoint')
JOIN hourly_fx h ON h.date = DATE '2024-01-01' + CAST(v.plan_id % 30 AS INT) AND h.mm >= 1 AND h.hour BETWEEN v.arrival//60 AND v.departure//60)"""


def wet_stops(fx):
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("plan_id") % 30).cast("int"))
    stops = _visits(fx).drop("date").withColumns({"date": date, "cell": F.lit(0)}).join(
        fx.places.select(F.col("id").alias("place_id"), "category", "name"), "place_id"
    )
    return W.wet_stops(stops, weather(fx), ["cell"])


@query("join_19", f"WITH {WET} SELECT v.plan_id, v.ord, w.n IS NOT NULL AS wet, coalesce(w.n, 0) AS hours FROM ({VISITS}) v LEFT JOIN (SELECT plan_id, ord, CAST(count(*) AS INTEGER) AS n FROM wet GROUP BY plan_id, ord) w USING (plan_id, ord)")
def join_19(fx):
    return wet_stops(fx).select("plan_id", "ord", "wet", F.when(F.col("wet"), F.size("rain_hours")).otherwise(0).alias("hours"))
