"""Bulk planning over the trips table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.operators import context
from trailgrid.operators import metrics as M
from trailgrid.operators import sequence as Q
from trailgrid.plans import build as B
from trailgrid.plans import corpus, revise
from trailgrid.plans import validate as P
from workload import sqltext as X
from workload.base import query


def trips(fx):
    listed = lambda *cs: F.filter(F.array(*map(F.expr, cs)), lambda v: v.isNotNull())
    return fx.trips.select(
        "*", listed("req_category").alias("required"), listed("req_sub").alias("required_subs"),
        listed("pref_category").alias("preferred"), listed("avoid_category").alias("avoided"),
        listed("CASE WHEN named_breakfast THEN 'breakfast' END", "CASE WHEN named_lunch THEN 'lunch' END", "CASE WHEN named_dinner THEN 'dinner' END").alias("named"),
        F.expr("map_filter(map('lunch', lunch_cuisine, 'dinner', dinner_cuisine), (m, c) -> c IS NOT NULL)").alias("cuisines"),
        listed("ask_first", "ask_second").alias("requested"),
    )


def candidates(fx):
    return B.select_candidates(trips(fx), fx.places)


def scored(fx):
    return B.score(candidates(fx), trips(fx))


def _est(a: str, b: str) -> str:
    """Road km between points (prefixes of lat and lon columns)."""
    mid = f"({a}lat + {b}lat)/2", f"({a}lon + {b}lon)/2"
    near = X.hav_km(*mid, "d.zlat", "d.zlon")
    return f"({X.hav_km(a + 'lat', a + 'lon', b + 'lat', b + 'lon')}*coalesce((SELECT arg_min(d.factor, {near}) FROM {X.DETOURS} WHERE {near} <= d.zkm), 1.53e0))"


AT = X.hav_m("t.alat", "t.alon", "p.lat", "p.lon")
APPEAL = X.lookup(K.APPEAL, "subcategory", "0.25e0")
SERV = f"(SELECT CAST(count(*) AS INTEGER) FROM places_fx v WHERE v.is_active AND v.category IN ('food','lodging') AND {X.hav_m('v.lat', 'v.lon', 'k.lat', 'k.lon')} <= 2000)"
CANDS = f"""near AS (SELECT t.plan_id, p.*, {AT} AS dist FROM trips_fx t JOIN places_fx p ON p.is_active AND {AT} <= t.radius_m),
top AS (SELECT * FROM (SELECT n.*, t.avoid_category, t.req_sub, row_number() OVER (PARTITION BY n.plan_id, category ORDER BY quality DESC, round(dist, 1), id) AS r
 FROM near n JOIN trips_fx t USING (plan_id) WHERE n.quality >= t.min_quality AND category <> 'lodging') WHERE r <= 25 AND category IS DISTINCT FROM avoid_category AND (category = 'food' OR {APPEAL} >= 0.45e0)),
bl AS (SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY n.plan_id ORDER BY quality DESC, round(dist, 1), id) AS r FROM near n JOIN trips_fx t USING (plan_id) WHERE t.req_sub = 'beach' AND n.category = 'lodging'
 AND EXISTS (SELECT 1 FROM places_fx x WHERE x.is_active AND x.subcategory = 'beach' AND {X.hav_m('x.lat', 'x.lon', 'n.lat', 'n.lon')} <= 2500)) WHERE r <= 12),
cand AS (SELECT k.plan_id, k.id, k.name, k.category, k.subcategory, k.lat, k.lon, k.quality, CASE WHEN k.subcategory = k.req_sub THEN {SERV} ELSE 0 END AS services, false AS beach_side FROM top k
 UNION ALL SELECT k.plan_id, k.id, k.name, k.category, k.subcategory, k.lat, k.lon, k.quality, {SERV}, true FROM bl k)"""
SCORED = f"""{CANDS}, sc AS (SELECT c.*, t.req_category, t.req_sub, t.pref_category, t.days, round({APPEAL}*2 + quality + CASE WHEN c.subcategory = t.req_sub OR (beach_side AND t.req_sub = 'beach') THEN 3e0 + least(services, 120)/120e0 ELSE 0e0 END
+ CASE WHEN category = pref_category THEN 0.6e0 ELSE 0e0 END, 6) AS score FROM cand c JOIN trips_fx t USING (plan_id))"""
POOL = f"""{SCORED}, wish AS (SELECT plan_id, id, min(n) AS asked FROM (SELECT plan_id, ask_first AS id, 0 AS n FROM trips_fx UNION ALL SELECT plan_id, ask_second, 1 FROM trips_fx) WHERE id IS NOT NULL GROUP BY plan_id, id),
sq AS (SELECT sc.*, w.asked FROM sc LEFT JOIN wish w USING (plan_id, id) UNION ALL
SELECT w.plan_id, p.id, p.name, p.category, p.subcategory, p.lat, p.lon, p.quality, 0, false, t.req_category, t.req_sub, t.pref_category, t.days, round({APPEAL}*2 + quality + CASE WHEN subcategory = req_sub THEN 3e0 ELSE 0e0 END
+ CASE WHEN category = pref_category THEN 0.6e0 ELSE 0e0 END - CASE WHEN category = avoid_category THEN 2e0 ELSE 0e0 END, 6), w.asked
FROM wish w JOIN places_fx p ON p.id = w.id AND p.is_active JOIN trips_fx t USING (plan_id) WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.plan_id = w.plan_id AND sc.id = w.id)),
p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, lower(name) ORDER BY asked NULLS LAST, score DESC, id) AS n1 FROM sq WHERE category <> 'food' OR asked IS NOT NULL) WHERE n1 = 1 OR asked IS NOT NULL),
p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, CASE WHEN subcategory = 'mall' THEN 'mall' ELSE CAST(id AS VARCHAR) END ORDER BY asked NULLS LAST, score DESC, id) AS n2 FROM p1) WHERE n2 = 1 OR asked IS NOT NULL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, CASE WHEN beach_side THEN 'beach' ELSE CAST(id AS VARCHAR) END ORDER BY asked NULLS LAST, score DESC, id) AS n3 FROM p2) WHERE n3 = 1 OR asked IS NOT NULL)"""
SEEDS = f"""{POOL}, kd AS (SELECT *, category = req_category AND row_number() OVER (PARTITION BY plan_id, category ORDER BY asked NULLS LAST, score DESC, id) = 1 AS due FROM pool),
seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY asked NULLS LAST, coalesce(due, false) DESC, score DESC, id) AS day FROM kd) WHERE day <= days)"""
FILL = f"""{SEEDS}, rest AS (SELECT * FROM pool p WHERE category <> 'food' AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.plan_id = p.plan_id AND s.id = p.id)),
met AS (SELECT r.*, s.day, s.category AS sc_, s.subcategory AS ss_, round_even({_est('s.', 'r.')}, 3) AS km FROM rest r JOIN seeds s USING (plan_id)),
nr AS (SELECT *, km - CASE WHEN asked IS NULL THEN 0 ELSE 120 END AS base FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, id ORDER BY km, day) AS r FROM met) WHERE r = 1),
cov AS (SELECT plan_id, list(category) AS cats, list(subcategory) AS subs FROM seeds GROUP BY plan_id),
i1 AS (SELECT *, row_number() OVER (PARTITION BY plan_id, day, category, subcategory ORDER BY base, id) - 1 + CAST(ss_ = subcategory AS INT) AS i FROM nr),
i2 AS (SELECT *, round(base + 8*i, 6) AS inn FROM i1),
o1 AS (SELECT *, row_number() OVER (PARTITION BY plan_id, day, category ORDER BY inn, id) AS c FROM i2),
o2 AS (SELECT o1.*, round(inn + 24*CASE WHEN category = pref_category OR category = req_category THEN 0 ELSE c - 1 + CAST(sc_ = category AS INT) END
 - CASE WHEN c = 1 AND category = req_category AND NOT list_contains(cats, category) THEN 60 ELSE 0 END - CASE WHEN i = 0 AND subcategory = req_sub AND NOT list_contains(subs, subcategory) THEN 60 ELSE 0 END, 6) AS fill_cost FROM o1 JOIN cov USING (plan_id)),
fill AS (SELECT *, row_number() OVER (PARTITION BY plan_id, day ORDER BY fill_cost, id) AS fill FROM o2)"""
PARTS = "list_transform(string_split(replace(t.cuisine, ',', ';'), ';'), lambda p: replace(lower(trim(p)), ' ', '_'))"
LIMS = f"""lims AS (SELECT plan_id, coalesce(max_km, 60e0) AS budget, coalesce(max_stops, 12) AS cap, CASE WHEN NOT include_meals THEN 0 ELSE CAST(named_breakfast AND earliest <= 570 AS INT) + CAST(latest >= 690 AND earliest <= 870 AS INT) + CAST(latest >= 1080 AS INT) END AS expected,
CASE WHEN NOT include_meals THEN 0 WHEN earliest + coalesce(max_stops, 12)*102 >= 1080 AND latest >= 1080 THEN 2 ELSE 1 END AS fit, earliest, latest, include_meals, named_breakfast, named_lunch, named_dinner, lunch_cuisine, dinner_cuisine FROM trips_fx),
tables AS (SELECT f.plan_id, f.id, f.lat, f.lon, coalesce(list_contains({PARTS}, l.lunch_cuisine), false) AS lunch_like, coalesce(list_contains({PARTS}, l.dinner_cuisine), false) AS dinner_like
FROM sc f JOIN lims l USING (plan_id) JOIN tags_fx t ON t.id = f.id WHERE f.category = 'food' AND NOT EXISTS (SELECT 1 FROM wish w WHERE w.plan_id = f.plan_id AND w.id = f.id))"""
DWELL = f"coalesce({X.lookup(K.SUBCATEGORY_MINUTES, 'subcategory')}, {X.lookup(K.CATEGORY_MINUTES, 'category')}, 60)"
SPEED = lambda km: f"(CASE WHEN {km} < 2 THEN 35e0 WHEN {km} < 10 THEN 41e0 WHEN {km} < 50 THEN 56e0 ELSE 62e0 END)"


def _leg(a: str, b: str, name: str) -> str:
    """Columns ``name``_road and ``name``_straight of a leg."""
    return f"{_est(a, b)} AS {name}_road, {X.hav_km(a + 'lat', a + 'lon', b + 'lat', b + 'lon')} AS {name}_straight"


def _minutes(name: str) -> str:
    return f"greatest(1, round_even({name}_road/{SPEED(name + '_straight')}*60, 0)) + 8"


def _near(stops: str, name: str) -> str:
    """CTEs of the restaurants ``name`` that days with these stops look at."""
    return f"""{name}0 AS (SELECT c.plan_id, c.day, f.id AS food_id, f.lunch_like, f.dinner_like, min(round_even({_est('c.', 'f.')}, 3)) AS near_km FROM {stops} c JOIN tables f ON f.plan_id = c.plan_id GROUP BY ALL),
{name} AS (SELECT plan_id, day, food_id, near_km FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, day ORDER BY near_km, food_id) AS r,
row_number() OVER (PARTITION BY plan_id, day, lunch_like ORDER BY near_km, food_id) AS rl, row_number() OVER (PARTITION BY plan_id, day, dinner_like ORDER BY near_km, food_id) AS rd FROM {name}0)
WHERE r <= 8 OR (lunch_like AND rl <= 8) OR (dinner_like AND rd <= 8))"""


def _offers(x: str, k: str, seq: str, options: str, meal: str, where: str, budget: bool, wishes: bool) -> str:
    """CTEs up to {x}b{k}: the best offer for one meal on the days {seq} (plan_id, day, pos, id, category, lat, lon, dwell, leg_km, leg_min, meal)."""
    opens, closes = K.MEAL_WINDOWS[meal]
    minutes = K.BREAKFAST_MINUTES if meal == "breakfast" else K.MEAL_MINUTES
    like = f"{meal}_like" if wishes and meal != "breakfast" else "false"
    fits = lambda t: f"nat <= {closes} AND (nat >= {opens} - {t} OR (nlat IS NULL AND greatest(nat, {opens}) + {minutes} <= latest AND {opens} - {t} - nat <= slack))"
    head = f"UNION ALL SELECT plan_id, day, 0 AS pos, NULL AS lat, NULL AS lon, earliest AS departure, 0 AS slack, lat AS nlat, lon AS nlon, leg_km AS nkm, total, n, budget, cap, latest FROM {x}g{k} WHERE pos = 1" if meal == "breakfast" else ""
    named = f"named_{meal} AND {fits(K.MEAL_RESCUE_MIN)}" if wishes else "false"
    return f"""{x}s{k} AS (SELECT s.*, l.* EXCLUDE (plan_id), l.earliest + sum(s.leg_min) OVER u + sum(s.dwell) OVER u - s.dwell AS s0 FROM {seq} s JOIN lims l USING (plan_id) WHERE {where} WINDOW u AS (PARTITION BY s.plan_id, s.day ORDER BY s.pos)),
{x}t{k} AS (SELECT *, s0 + dwell + greatest(coalesce(max(CASE meal WHEN 'breakfast' THEN 390 WHEN 'lunch' THEN 690 WHEN 'dinner' THEN 1080 END - s0) OVER (PARTITION BY plan_id, day ORDER BY pos), 0), 0) AS departure FROM {x}s{k}),
{x}g{k} AS (SELECT *, sum(CASE WHEN meal IS NULL THEN greatest(least(dwell, CASE WHEN category IN ('nature', 'viewpoint') THEN 1095 WHEN category IN ('culture', 'attraction') THEN 1080 ELSE latest END - departure), 0) ELSE 0 END) OVER u AS slack,
lead(lat) OVER u AS nlat, lead(lon) OVER u AS nlon, lead(leg_km) OVER u AS nkm, sum(leg_km) OVER w AS total, count(*) OVER w AS n FROM {x}t{k} WINDOW u AS (PARTITION BY plan_id, day ORDER BY pos), w AS (PARTITION BY plan_id, day)),
{x}h{k} AS (SELECT plan_id, day, pos, lat, lon, departure, slack, nlat, nlon, nkm, total, n, budget, cap, latest FROM {x}g{k} {head}),
{x}f{k} AS (SELECT o.plan_id, o.day, f.id AS food_id, f.lat AS flat, f.lon AS flon, {like} AS likes, bool_or({like}) OVER (PARTITION BY o.plan_id, o.day) AS any_like FROM {options} o JOIN tables f ON f.plan_id = o.plan_id AND f.id = o.food_id
WHERE NOT EXISTS (SELECT 1 FROM {seq} s WHERE s.plan_id = o.plan_id AND s.day = o.day AND s.id = o.food_id)),
{x}p{k} AS (SELECT h.*, f.food_id, f.flat, f.flon, {_leg('h.', 'f.f', 'i')}, {_leg('f.f', 'h.n', 'j')} FROM {x}h{k} h JOIN {x}f{k} f USING (plan_id, day) WHERE h.n < h.cap AND (f.likes OR NOT f.any_like)),
{x}q{k} AS (SELECT *, coalesce(round_even(i_road, 3), 0e0) AS in_km, CASE WHEN pos = 0 THEN 0 ELSE {_minutes('i')} END AS in_min, round_even(j_road, 3) AS out_km, CASE WHEN nlat IS NULL THEN NULL ELSE {_minutes('j')} END AS out_min FROM {x}p{k}),
{x}r{k} AS (SELECT q.*, l.named_breakfast, l.named_lunch, l.named_dinner, round(in_km + coalesce(out_km - nkm, 0e0), 3) AS added_km, departure + in_min AS nat FROM {x}q{k} q JOIN lims l USING (plan_id)),
{x}v{k} AS (SELECT *, CASE WHEN {fits(K.MEAL_EARLY_MIN)} THEN 0 WHEN {named} THEN 1 END AS late FROM {x}r{k} {"WHERE round(total + added_km, 3) <= budget" if budget else ""}),
{x}b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, day ORDER BY late, added_km, food_id, pos) AS w FROM {x}v{k} WHERE late IS NOT NULL) WHERE w = 1)"""


def _with_meals(x: str, start: str, options: str, windows: bool, budget: bool, wishes: bool) -> str:
    """CTEs {x}b0 to {x}b2, the offers taken, and {x}3, the days after their meals."""
    steps = [f"{x}0 AS ({start})"]
    for k, meal in enumerate(K.MEAL_WINDOWS):
        due = {"breakfast": "l.named_breakfast", "lunch": "true", "dinner": "true"}[meal]
        if windows:
            due += {"breakfast": " AND earliest <= 570", "lunch": " AND latest >= 690 AND earliest <= 870", "dinner": " AND latest >= 1080"}[meal]
        steps.append(_offers(x, str(k), f"{x}{k}", options, meal, f"l.include_meals AND {due}", budget, wishes))
        steps.append(f"""{x}{k + 1} AS (SELECT s.plan_id, s.day, CASE WHEN s.pos > b.pos THEN s.pos + 1 ELSE s.pos END AS pos, s.id, s.category, s.lat, s.lon, s.dwell,
CASE WHEN s.pos = b.pos + 1 THEN b.out_km ELSE s.leg_km END AS leg_km, CASE WHEN s.pos = b.pos + 1 THEN b.out_min ELSE s.leg_min END AS leg_min, s.meal FROM {x}{k} s LEFT JOIN {x}b{k} b USING (plan_id, day)
UNION ALL SELECT plan_id, day, pos + 1, food_id, 'food', flat, flon, {K.BREAKFAST_MINUTES if meal == 'breakfast' else K.MEAL_MINUTES}, in_km, in_min, '{meal}' FROM {x}b{k})""")
    return ", ".join(steps)


RESERVE = f"""{LIMS}, {_near('seeds', 'opt')},
{_with_meals('y', f"SELECT plan_id, day, 1 AS pos, id, category, lat, lon, {DWELL} AS dwell, 0e0 AS leg_km, 0e0 AS leg_min, CAST(NULL AS VARCHAR) AS meal FROM seeds", 'opt', True, False, False)},
need AS (SELECT s.plan_id, s.day, round(coalesce(any_value(b0.added_km), 0) + coalesce(any_value(b1.added_km), 0) + coalesce(any_value(b2.added_km), 0), 3) AS need, any_value(l.budget) AS budget
FROM seeds s JOIN lims l USING (plan_id) LEFT JOIN yb0 b0 USING (plan_id, day) LEFT JOIN yb1 b1 USING (plan_id, day) LEFT JOIN yb2 b2 USING (plan_id, day) GROUP BY s.plan_id, s.day),
reserve AS (SELECT plan_id, day, CASE WHEN need > 0.30e0*budget THEN 0e0 ELSE need END AS reserve_km FROM need)"""
CUT = f"""{FILL}, {RESERVE},
chain AS (SELECT plan_id, day, id, category, subcategory, lat, lon, 0 AS fill FROM seeds UNION ALL SELECT plan_id, day, id, category, subcategory, lat, lon, fill FROM fill),
cc AS (SELECT c.*, l.* EXCLUDE (plan_id), {DWELL} AS dwell, coalesce(v.reserve_km, 0) AS held FROM chain c JOIN lims l USING (plan_id) LEFT JOIN reserve v USING (plan_id, day)),
walk AS (SELECT plan_id, day, CAST(0 AS BIGINT) AS fill, lat, lon, 0e0 AS km, CAST(earliest + dwell AS DOUBLE) AS fin, 0 AS misses, 1 AS n, true AS took, 0e0 AS leg_km, 0e0 AS leg_min FROM cc WHERE fill = 0
UNION ALL SELECT plan_id, day, fill, CASE WHEN ok THEN lat ELSE plat END, CASE WHEN ok THEN lon ELSE plon END, CASE WHEN ok THEN km + step_km ELSE km END, CASE WHEN ok THEN fin + step_min + dwell ELSE fin END,
CASE WHEN ok THEN 0 ELSE misses + 1 END, CASE WHEN ok THEN n + 1 ELSE n END, ok, step_km, step_min FROM (
SELECT *, misses < 15 AND n < greatest(cap - fit, 1) AND round(km + step_km, 3) <= budget - held AND fin + step_min + dwell + expected*90 <= latest AS ok FROM (
SELECT *, round_even(road, 3) AS step_km, greatest(1, round_even(road/(CASE WHEN straight < 2 THEN 35e0 WHEN straight < 10 THEN 41e0 WHEN straight < 50 THEN 56e0 ELSE 62e0 END)*60, 0)) + 8 AS step_min FROM (
SELECT j.*, {_est('j.p', 'j.')} AS road, {X.hav_km('j.plat', 'j.plon', 'j.lat', 'j.lon')} AS straight FROM (
SELECT c.*, w.lat AS plat, w.lon AS plon, w.km, w.fin, w.misses, w.n FROM walk w JOIN cc c ON c.plan_id = w.plan_id AND c.day = w.day AND c.fill = w.fill + 1) j)))),
cut AS (SELECT c.* EXCLUDE (fill), w.n - 1 AS fill, w.leg_km, w.leg_min FROM walk w JOIN cc c ON c.plan_id = w.plan_id AND c.day = w.day AND c.fill = w.fill WHERE took)"""


@query("plan_1", f"WITH {CANDS} SELECT plan_id, id, category, services, beach_side FROM cand")
def plan_1(fx):
    return candidates(fx).select("plan_id", "id", "category", "services", "beach_side")


@query("set_2", f"WITH {CANDS} SELECT plan_id, id, beach_side FROM cand WHERE category <> 'food'")
def set_2(fx):
    _, destinations = B.split_food(candidates(fx))
    return destinations.select("plan_id", "id", "beach_side")


@query("win_9", f"WITH {SCORED} SELECT plan_id, id, score FROM sc")
def win_9(fx):
    return scored(fx).select("plan_id", "id", "score")


def asked_for(fx):
    return B.with_requested(scored(fx), trips(fx), fx.places)


@query("win_10", f"WITH {SEEDS} SELECT plan_id, CAST(day AS INTEGER) AS day, id, score FROM seeds")
def win_10(fx):
    return B.seeds(B.one_of_each(asked_for(fx)), trips(fx)).select("plan_id", "day", "id", "score")


@query("win_11", f"WITH {FILL} SELECT plan_id, CAST(day AS INTEGER) AS day, CAST(fill AS INTEGER) AS fill, id, fill_cost FROM fill")
def win_11(fx):
    pool = B.one_of_each(asked_for(fx))
    return B.fill_order(pool, B.seeds(pool, trips(fx)), trips(fx)).select("plan_id", "day", "fill", "id", "fill_cost")


def _food(rows, fx):
    return B.tables_of(B.split_food(rows.where("asked IS NULL"))[0], fx.tags.select("id", F.lit(None).cast("string").alias("opening_hours"), "cuisine"))


@query("win_17", f"WITH {SEEDS}, {RESERVE} SELECT plan_id, CAST(day AS INTEGER) AS day, reserve_km FROM reserve")
def win_17(fx):
    rows = B.checkpointed(asked_for(fx))
    first = B.seeds(B.one_of_each(rows), trips(fx))
    return B.meal_reserve(first, _food(rows, fx), trips(fx))


def _cut(fx):
    rows = B.checkpointed(asked_for(fx))
    pool = B.one_of_each(rows)
    first = B.checkpointed(B.seeds(pool, trips(fx)))
    food = _food(rows, fx)
    filled = B.fill_order(pool, first, trips(fx))
    return B.checkpointed(B.feasible(first, filled, B.meal_reserve(first, food, trips(fx)), trips(fx))), food


@query("win_12", f"WITH RECURSIVE {CUT} SELECT plan_id, CAST(day AS INTEGER) AS day, CAST(fill AS INTEGER) AS ord, id, CAST(dwell AS INTEGER) AS dwell FROM cut")
def win_12(fx):
    return _cut(fx)[0].select("plan_id", "day", "ord", "id", "dwell")


MEALC = f"{CUT}, {_near('cut', 'options')}"


@query("win_15", f"WITH RECURSIVE {MEALC} SELECT plan_id, CAST(day AS INTEGER) AS day, food_id, near_km FROM options")
def win_15(fx):
    stops, food = _cut(fx)
    rows = stops.withColumn("meal", F.lit(None).cast("string"))
    return B.meal_candidates(rows, food, B.M.wanted_cuisines(trips(fx))).select("plan_id", "day", "food_id", "near_km")


def _scheduled(fx):
    stops, food = _cut(fx)
    limits = trips(fx).select("plan_id", "meal_minutes", "include_meals", B.R.stop_cap(F.col("max_stops")).alias("cap"))
    rows = stops.join(limits, "plan_id").withColumns({
        "meal": F.lit(None).cast("string"), "light": F.lit(K.DUSK_MIN), "date": F.lit(None).cast("date"), "ord": F.col("ord") + 1,
    })
    return B.checkpointed(Q.schedule(B.with_legs(rows))), food


def _eaten(fx):
    """Days with their meals, each apart from the others of its trip."""
    stops, food = _scheduled(fx)
    return B.checkpointed(B.M.eat(B.M.day_rows(stops, B.meal_options(stops, food, trips(fx)), trips(fx)))), food


MEALS = f"""{MEALC}, {_with_meals('m', "SELECT plan_id, day, fill + 1 AS pos, id, category, lat, lon, dwell, leg_km, leg_min, CAST(NULL AS VARCHAR) AS meal FROM cut", 'options', False, True, True)}"""


@query("win_16", f"WITH RECURSIVE {MEALS} " + " UNION ALL ".join(
    f"SELECT plan_id, CAST(day AS INTEGER) AS day, '{meal}' AS meal, food_id, CAST(pos AS INTEGER) AS after, added_km FROM mb{k}" for k, meal in enumerate(K.MEAL_WINDOWS)
))
def win_16(fx):
    """The meals each day takes: where, after how many stops, and the km they add."""
    eaten, _ = _eaten(fx)
    return eaten.select("plan_id", "day", F.explode("picked").alias("p")).select("plan_id", "day", "p.meal", "p.food_id", "p.after", "p.added_km")


PLAN_6 = ", ".join(
    _offers("z", str(k), "m3", "options", meal, f"l.include_meals AND {'l.named_breakfast' if meal == 'breakfast' else 'true'} AND NOT EXISTS (SELECT 1 FROM m3 e WHERE e.plan_id = s.plan_id AND e.day = s.day AND e.meal = '{meal}')", False, False)
    for k, meal in enumerate(K.MEAL_WINDOWS)
)


@query("plan_6", f"""
WITH RECURSIVE {MEALS}, {PLAN_6},
c0 AS (SELECT s.*, l.earliest, l.earliest + sum(s.leg_min) OVER u + sum(s.dwell) OVER u - s.dwell AS s0 FROM m3 s JOIN lims l USING (plan_id) WINDOW u AS (PARTITION BY s.plan_id, s.day ORDER BY s.pos)),
c1 AS (SELECT *, s0 + greatest(coalesce(max(CASE meal WHEN 'breakfast' THEN 390 WHEN 'lunch' THEN 690 WHEN 'dinner' THEN 1080 END - s0) OVER (PARTITION BY plan_id, day ORDER BY pos), 0), 0) AS arrival FROM c0),
dy AS (SELECT plan_id, day, arg_min(arrival, pos) AS start, max(arrival + dwell) AS stop, round(sum(leg_km), 3) AS km, count(*) AS visits, list(meal) FILTER (meal IS NOT NULL) AS had FROM c1 GROUP BY plan_id, day),
off AS (SELECT plan_id, day, 'breakfast' AS meal, added_km FROM zb0 UNION ALL SELECT plan_id, day, 'lunch', added_km FROM zb1 UNION ALL SELECT plan_id, day, 'dinner', added_km FROM zb2),
win AS (SELECT 'breakfast' AS meal, 390 AS opens, 570 AS closes UNION ALL SELECT 'lunch', 690, 870 UNION ALL SELECT 'dinner', 1080, 1260),
nf AS (SELECT d.*, w.*, l.cap, o.added_km, CASE w.meal WHEN 'breakfast' THEN named_breakfast WHEN 'lunch' THEN named_lunch ELSE named_dinner END AS named, start <= closes AND stop >= opens AS reached,
(SELECT count(*) FROM tables f WHERE f.plan_id = d.plan_id) AS food_nearby FROM dy d JOIN lims l USING (plan_id) CROSS JOIN win w LEFT JOIN off o ON o.plan_id = d.plan_id AND o.day = d.day AND o.meal = w.meal
WHERE l.include_meals AND NOT coalesce(list_contains(had, w.meal), false) AND (w.meal <> 'breakfast' OR named_breakfast)),
ca AS (SELECT *, CASE WHEN NOT reached AND named THEN 'out_of_reach' WHEN NOT reached THEN NULL WHEN food_nearby = 0 THEN 'no_food' WHEN visits >= cap THEN 'no_stop_left' WHEN added_km IS NULL THEN 'none_in_window' ELSE 'over_budget' END AS cause FROM nf)
SELECT plan_id, CAST(day AS INTEGER) AS day, meal, cause, CASE WHEN cause = 'over_budget' THEN round(km + added_km, 1) END AS km_needed FROM ca WHERE cause IS NOT NULL
UNION ALL SELECT m.plan_id, CAST(m.day AS INTEGER), m.meal, 'cuisine_not_found', NULL FROM m3 m JOIN lims l USING (plan_id) JOIN tables f ON f.plan_id = m.plan_id AND f.id = m.id
WHERE (m.meal = 'lunch' AND l.lunch_cuisine IS NOT NULL AND NOT f.lunch_like) OR (m.meal = 'dinner' AND l.dinner_cuisine IS NOT NULL AND NOT f.dinner_like)""")
def plan_6(fx):
    """Every meal that a day went without and why, and the meals of another cuisine than the one asked for."""
    eaten, food = _eaten(fx)
    tables = food.groupBy("plan_id").agg(F.count(F.lit(1)).alias("food_nearby"))
    km = F.aggregate("seq", F.lit(0.0), lambda x, s: x + s["leg_km"])
    days = eaten.where("d.include_meals").select(
        "plan_id", "day", F.get("seq", F.lit(0))["arrival"].alias("start"), F.array_max(F.col("seq.departure")).alias("stop"),
        F.round(km, 3).alias("km"), "d.budget", "d.cap", F.size("seq").alias("visits"), F.col("picked.meal").alias("meals"),
    ).join(tables, "plan_id", "left").join(trips(fx).select("plan_id", "named"), "plan_id").withColumn(
        "food_nearby", F.coalesce("food_nearby", F.lit(0))
    )
    return P.meal_advice(days, B.M.missing_offers(eaten), B.M.cuisine_missed(eaten))


@query("plan_6_fast", """
WITH d AS (SELECT plan_id, day, arg_min(arrival, ord) AS start, arg_min(arrival, ord) FILTER (meal IS NOT NULL) AS first_meal, count(*) FILTER (meal = 'breakfast') AS b FROM timed_fx GROUP BY plan_id, day)
SELECT plan_id, day, first_meal - start AS fast FROM d WHERE b = 0 AND start <= 570 AND first_meal - start >= 300""")
def plan_6_fast(fx):
    return P.long_fasts(fx.timed)


def planned(fx):
    hours = fx.tags.select("id", "opening_hours", "cuisine")
    return B.plan_trips(trips(fx), fx.places, hours)


@query("win_13")
def win_13(fx):
    stops, food = _scheduled(fx)
    tight = stops.withColumns({"latest": F.col("latest") - 60, "budget": F.col("budget") * 0.8})
    return B.trim(tight).select("plan_id", "day", "ord", "id", "arrival", "departure", "leg_km")


@query("plan_2")
def plan_2(fx):
    return planned(fx).select("plan_id", "day", "ord", "id", "meal", "arrival", "departure", "leg_km", "leg_min")


@query("plan_7_swap")
def plan_7_swap(fx):
    """Plans where every second trip gives up the first visit of its last day: that day is planned anew."""
    hours = fx.tags.select("id", "opening_hours", "cuisine")
    stops = B.checkpointed(planned(fx))
    visits = stops.where("meal IS NULL AND plan_id % 2 = 0").groupBy("plan_id", "day").agg(F.min_by("id", "ord").alias("id"))
    last = visits.groupBy("plan_id").agg(F.max("day").alias("day"))
    swapped = revise.swap_days(trips(fx), stops, visits.join(last, ["plan_id", "day"]), fx.places, hours)
    return swapped.select("plan_id", "day", "ord", "id", "meal", "arrival", "departure", "leg_km", "leg_min")


@query("plan_9_metrics")
def plan_9_metrics(fx):
    """The evaluation requests of every weekday planned on the catalogue, measured by zone and weekday."""
    stops = B.checkpointed(B.plan_trips(corpus.week(fx.spark), fx.places, fx.tags.select("id", "opening_hours")))
    named = stops.withColumn("zone", corpus.zone_of()).join(fx.tags.select("id", "opening_hours"), "id", "left")
    return M.plan_metrics(named, context.visit_states(named.where("meal IS NOT NULL")))


@query("plan_9")
def plan_9(fx):
    """The evaluation requests planned on the catalogue, one row per case with its metrics."""
    cases = corpus.cases(fx.spark)
    stops = B.plan_trips(cases, fx.places).withColumn("place_id", F.col("id"))
    limits = cases.withColumnsRenamed({"days": "days_asked"}).withColumn(
        "budget", B.R.km_budget(F.col("max_km"), F.col("mode"), F.col("mode"))
    )
    stops = B.checkpointed(stops)
    return M.compliance(limits, P.independent_checks(limits, stops, fx.places), stops)
