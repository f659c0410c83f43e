"""Travel table, estimates, calibration, geometry; geographic scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import geo as G
from trailgrid.operators import search as S
from trailgrid.operators import travel as V
from trailgrid.operators.range_join import radius_pairs
from trailgrid.session import run_folder
from workload import sqltext as X
from workload.base import query

ENDS = "JOIN places_fx a ON a.id = l.origin JOIN places_fx b ON b.id = l.destination"
PAIRS = "(SELECT DISTINCT origin, destination FROM legs_fx)"
HAV = X.hav_km("a.lat", "a.lon", "b.lat", "b.lon")
SPEED = "(CASE WHEN straight < 2 THEN 35e0 WHEN straight < 10 THEN 41e0 WHEN straight < 50 THEN 56e0 ELSE 62e0 END)"
ESTIMATE = f"""est AS (SELECT origin, destination, straight, straight*coalesce(factor, 1.53e0) AS km FROM
(SELECT l.origin, l.destination, {HAV} AS straight, (SELECT arg_min(d.factor, {X.hav_km('(a.lat + b.lat)/2', '(a.lon + b.lon)/2', 'd.zlat', 'd.zlon')})
FROM {X.DETOURS} WHERE {X.hav_km('(a.lat + b.lat)/2', '(a.lon + b.lon)/2', 'd.zlat', 'd.zlon')} <= d.zkm) AS factor FROM {PAIRS} l {ENDS})),
guess AS (SELECT origin, destination, straight, round_even(km, 3) AS km, CAST(greatest(1, round_even(km/{SPEED}*60, 0)) + 8 AS INTEGER) AS minutes,
CAST(greatest(1, round_even(km/5e0*60, 0)) + 2 AS INTEGER) AS walk FROM est)"""


def _ends(fx):
    pairs = fx.legs.select("origin", "destination").distinct()
    return V._with_ends(pairs, fx.places)


@query("geo_1", f"SELECT l.origin, l.destination, round({HAV}, 6) AS km FROM {PAIRS} l {ENDS}")
def geo_1(fx):
    return _ends(fx).select("origin", "destination", F.round(G.haversine_km("olat", "olon", "dlat", "dlon"), 6).alias("km"))


@query("geo_2", f"SELECT origin, destination, {SPEED} AS driving, 5e0 AS walking FROM (SELECT l.origin, l.destination, {HAV} AS straight FROM {PAIRS} l {ENDS})")
def geo_2(fx):
    km = G.haversine_km("olat", "olon", "dlat", "dlon")
    return _ends(fx).withColumn("km", km).select(
        "origin", "destination", G.speed_kmh("km").alias("driving"), G.speed_kmh("km", "walking").alias("walking")
    )


@query("geo_3", f"WITH {ESTIMATE} SELECT origin, destination, km, minutes, walk FROM guess")
def geo_3(fx):
    start, stop = ("olat", "olon"), ("dlat", "dlon")
    legs = G.with_estimate(G.with_estimate(_ends(fx), start, stop), start, stop, "walking", "_km", "walk")
    return legs.select("origin", "destination", "km", "minutes", "walk")


@query("geo_4", """SELECT n_nationkey, round(sqrt(pow(0.01e0*(1 + n_regionkey)*110.574e0, 2) + pow(0.02e0*(1 + n_nationkey)*111.320e0*cos(radians(13e0 + 0.005e0*(1 + n_regionkey))), 2))/2, 6) AS km FROM nation""")
def geo_4(fx):
    box = fx.nation.select(
        "n_nationkey", F.lit(13.0).alias("s"), F.lit(-89.0).alias("w"),
        (13.0 + 0.01 * (1 + F.col("n_regionkey"))).alias("n"), (-89.0 + 0.02 * (1 + F.col("n_nationkey"))).alias("e"),
    )
    return box.select("n_nationkey", F.round(G.box_radius_km("s", "w", "n", "e"), 6).alias("km"))


@query("geo_5", f"""
SELECT t.plan_id, {X.hav_m('a.alat', 'a.alon', 'p.lat', 'p.lon')} <= a.radius_m AS inside,
CAST(CASE WHEN t.plan_id % 5 = 0 OR {X.hav_m('a.alat', 'a.alon', 'p.lat', 'p.lon')} <= a.radius_m THEN 3 ELSE 1 END AS INTEGER) AS anchored_days
FROM plans_fx t JOIN areas_fx a ON a.area_id = t.area_id JOIN days_fx p ON p.plan_id = t.plan_id AND p.day = 1 AND p.ord = 1""")
def geo_5(fx):
    from trailgrid.plans.requests import anchors_day

    first = fx.days.where("day = 1 AND ord = 1").select("plan_id", "lat", "lon")
    rows = fx.plans.join(fx.areas, "area_id").join(first, "plan_id")
    inside = G.inside_area("lat", "lon", "alat", "alon", "radius_m")
    back = F.col("plan_id") % 5 == 0
    days = sum(anchors_day(F.lit(True), back, inside, F.lit(d)).cast("int") for d in (1, 2, 3))
    return rows.select("plan_id", inside.alias("inside"), days.alias("anchored_days"))


@query("join_12", """
WITH s AS (SELECT DISTINCT plan_id, place_id FROM days_fx) SELECT a.plan_id, a.place_id AS origin, b.place_id AS destination FROM s a JOIN s b USING (plan_id) WHERE a.place_id <> b.place_id""")
def join_12(fx):
    sets = fx.days.select("plan_id", F.col("place_id").alias("id")).distinct()
    return V.ordered_pairs(sets, "plan_id")


@query("join_13", "SELECT l.plan_id, l.ord, e.origin, e.destination, e.km, e.minutes FROM legs_fx l JOIN edges_fx e ON e.origin = l.origin AND e.destination = l.destination AND e.source <> 'estimated'")
def join_13(fx):
    legs = fx.legs.withColumn("profile", F.lit("driving-car"))
    return V.measured_legs(legs, fx.edges).select("plan_id", "ord", "origin", "destination", "km", "minutes")


@query("join_14", f"""
WITH {ESTIMATE} SELECT g.origin, g.destination, coalesce(e.km, g.km) AS km, CAST(coalesce(e.minutes + 8, g.minutes) AS INTEGER) AS minutes, coalesce(e.source, 'estimated') AS source
FROM guess g LEFT JOIN edges_fx e ON e.origin = g.origin AND e.destination = g.destination AND e.source <> 'estimated'""")
def join_14(fx):
    return V.travel(fx.legs, fx.edges, fx.places).drop("profile")


@query("join_15", f"SELECT l.origin, l.destination FROM {PAIRS} l WHERE NOT EXISTS (SELECT 1 FROM edges_fx e WHERE e.origin = l.origin AND e.destination = l.destination AND e.source <> 'estimated')")
def join_15(fx):
    pairs = fx.legs.select("origin", "destination", F.lit("driving-car").alias("profile"))
    return V.missing_pairs(pairs, fx.edges).select("origin", "destination")


@query("join_16", f"""
SELECT p.id, coalesce((SELECT arg_min(d.factor, {X.hav_km('p.lat', 'p.lon', 'd.zlat', 'd.zlon')}) FROM {X.DETOURS} WHERE {X.hav_km('p.lat', 'p.lon', 'd.zlat', 'd.zlon')} <= d.zkm), 1.53e0) AS factor FROM places_fx p""")
def join_16(fx):
    return fx.places.select("id", G.detour_factor("lat", "lon").alias("factor"))


@query("join_17", f"SELECT p.id, round(min({X.hav_km('p.lat', 'p.lon', 'c.clat', 'c.clon')}), 3) AS km, min({X.hav_km('p.lat', 'p.lon', 'c.clat', 'c.clon')}) <= 12 AS coastal FROM places_fx p, {X.COAST} GROUP BY p.id")
def join_17(fx):
    coast = fx.places.withColumn("km", G.km_to_coast("lat", "lon"))
    return coast.select("id", F.round("km", 3).alias("km"), (F.col("km") <= K.COASTAL_KM).alias("coastal"))


STRAIGHT = f"SELECT l.*, {HAV} AS straight FROM edges_fx l {ENDS}"


@query("flt_16", f"SELECT origin, destination, km FROM ({STRAIGHT}) WHERE km >= straight*0.98e0")
def flt_16(fx):
    return V.plausible(fx.edges, fx.places).select("origin", "destination", "km")


@query("flt_17", f"SELECT origin, destination, km, source FROM ({STRAIGHT}) WHERE NOT (km < straight*0.98e0)")
def flt_17(fx):
    return V.purge_implausible(fx.edges, fx.places).select("origin", "destination", "km", "source")


ZONED = f"(SELECT z.zone, p.id, p.lat, p.lon FROM {X.ZONES} JOIN places_fx p ON p.is_active AND {X.hav_m('z.alat', 'z.alon', 'p.lat', 'p.lon')} <= z.radius_m)"
ROADS = "(SELECT a.id AS origin, b.id AS destination FROM places_fx a, places_fx b)"


def _zone_samples(fx, size=20):
    zones = S.zone_table(fx.spark).select("zone", "alat", "alon", "radius_m")
    inside = radius_pairs(zones, fx.places.where("is_active").select("id", "lat", "lon"), "radius_m", reach_m=25_000)
    return V.zone_samples(inside.select("zone", "id", "lat", "lon"), size, [42, 1042, 2042])


def _roads(fx):
    """Measured roads between the places of each sample: a fixed wiggle on the straight line."""
    s = _zone_samples(fx).select("zone", "seed", "id", "lat", "lon")
    pairs = s.withColumnsRenamed({"id": "origin", "lat": "olat", "lon": "olon"}).join(
        s.withColumnsRenamed({"id": "destination", "lat": "dlat", "lon": "dlon"}), ["zone", "seed"]
    ).where("origin < destination")
    km = G.haversine_km("olat", "olon", "dlat", "dlon") * (1.1 + ((F.col("origin") * 3 + F.col("destination")) % 17) / 10.0)
    return pairs.select("origin", "destination", km.alias("km")).dropDuplicates(["origin", "destination"])


SAMPLES = f"""smp AS (SELECT * FROM (SELECT z.zone, z.id, z.lat, z.lon, s.seed, row_number() OVER (PARTITION BY z.zone, s.seed ORDER BY md5(concat(CAST(z.id AS VARCHAR), ':', CAST(s.seed AS VARCHAR))), z.id) AS r
FROM {ZONED} z, (VALUES (42), (1042), (2042)) s(seed)) WHERE r <= 20),
f AS (SELECT a.zone, a.seed, 1.1e0 + ((a.id*3 + b.id) % 17)/10e0 AS factor, {HAV} AS straight FROM smp a JOIN smp b ON a.zone = b.zone AND a.seed = b.seed AND a.id < b.id),
g AS (SELECT * FROM f WHERE straight >= 0.5e0),
m AS (SELECT zone, seed, count(*) AS n, median(factor) AS med FROM g GROUP BY zone, seed HAVING count(*) >= 30)"""


@query("agg_6", f"""
WITH {SAMPLES} SELECT m.zone, round(avg(med), 4) AS factor, round(max(med) - min(med), 4) AS range, any_value(t.pairs) AS pairs, any_value(t.p90) AS p90, any_value(t.worst) AS worst
FROM m JOIN (SELECT g.zone, count(*) AS pairs, round(quantile_cont(factor, 0.9), 4) AS p90, round(max(factor), 4) AS worst FROM g JOIN m USING (zone, seed) GROUP BY g.zone) t ON t.zone = m.zone GROUP BY m.zone""")
def agg_6(fx):
    return V.calibrate_detours(_zone_samples(fx), _roads(fx))


@query("agg_7", f"""
SELECT CASE WHEN straight < 2 THEN 'menos de 2 km' WHEN straight < 10 THEN '2 a 10 km' WHEN straight < 50 THEN '10 a 50 km' ELSE 'mas de 50 km' END AS band,
count(*) FILTER (k IS NOT NULL AND straight >= 0.05e0) AS pairs, round(median(k/straight) FILTER (k IS NOT NULL AND straight >= 0.05e0), 4) AS detour,
round(median(k/(minutes/60e0)) FILTER (k IS NOT NULL AND straight >= 0.05e0), 3) AS kmh, round(avg(CASE WHEN k IS NULL THEN 1e0 ELSE 0e0 END), 4) AS no_route
FROM (SELECT *, CASE WHEN source <> 'estimated' THEN km END AS k FROM ({STRAIGHT})) GROUP BY band""")
def agg_7(fx):
    routed = fx.edges.withColumn("km", F.when(F.col("source") != "estimated", F.col("km")))
    return V.by_band(routed, fx.places)


ORIGIN_OF = "CASE WHEN e.source IS NULL OR e.source = 'estimated' THEN 'estimated' WHEN e.source = 'ors' THEN 'cached' ELSE 'fetched' END"
RATIO = """coalesce(round_even((cached + fetched)::DOUBLE/nullif(cached + fetched + estimated, 0), 3), 0e0) AS real_ratio,
CASE WHEN cached + fetched = 0 THEN 'estimated' WHEN estimated > 0 THEN 'mixed' ELSE 'real' END AS label"""


def _leg_origins(fx):
    known = fx.edges.select("origin", "destination", "source")
    origin = F.when(F.coalesce("source", F.lit("estimated")) == "estimated", "estimated").when(
        F.col("source") == "ors", "cached").otherwise("fetched")
    return fx.legs.join(known, ["origin", "destination"], "left").withColumn("origin_of", origin)


@query("agg_8", f"""
WITH l AS (SELECT l.plan_id, {ORIGIN_OF} AS o FROM legs_fx l LEFT JOIN edges_fx e ON e.origin = l.origin AND e.destination = l.destination),
c AS (SELECT plan_id, count(*) FILTER (o = 'cached') AS cached, count(*) FILTER (o = 'fetched') AS fetched, count(*) FILTER (o = 'estimated') AS estimated FROM l GROUP BY plan_id)
SELECT *, {RATIO} FROM c""")
def agg_8(fx):
    return V.provenance(_leg_origins(fx), ["plan_id"])


@query("set_6", f"""
WITH l AS (SELECT l.plan_id, CASE WHEN l.ord % 2 = 0 THEN 'driving' ELSE 'walking' END AS mode, {ORIGIN_OF} AS o FROM legs_fx l LEFT JOIN edges_fx e ON e.origin = l.origin AND e.destination = l.destination),
m AS (SELECT plan_id, mode, count(*) FILTER (o = 'cached') AS cached, count(*) FILTER (o = 'fetched') AS fetched, count(*) FILTER (o = 'estimated') AS estimated FROM l GROUP BY plan_id, mode),
r AS (SELECT *, CASE WHEN cached + fetched = 0 THEN CASE mode WHEN 'driving' THEN 'no_quota' ELSE 'no_key' END END AS reason, CASE mode WHEN 'driving' THEN 0 ELSE 1 END AS position FROM m),
c AS (SELECT plan_id, CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(estimated) AS BIGINT) AS estimated, arg_min(reason, position) FILTER (reason IS NOT NULL) AS reason FROM r GROUP BY plan_id)
SELECT *, {RATIO} FROM c""")
def set_6(fx):
    legs = _leg_origins(fx).withColumn("mode", F.when(F.col("ord") % 2 == 0, "driving").otherwise("walking"))
    driving = F.col("mode") == "driving"
    per_mode = V.provenance(legs, ["plan_id", "mode"]).withColumns({
        "reason": F.when(F.col("cached") + F.col("fetched") == 0, F.when(driving, "no_quota").otherwise("no_key")),
        "position": F.when(driving, 0).otherwise(1),
    })
    return V.merge_modes(per_mode, "plan_id")


@query("agg_9", """
WITH l AS (SELECT plan_id, CASE (origin + destination) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'fetched' ELSE 'cached' END AS g FROM legs_fx),
c AS (SELECT plan_id, count(*) FILTER (g = 'cached') AS cached, count(*) FILTER (g = 'fetched') AS fetched, count(*) FILTER (g IS NULL) AS straight FROM l GROUP BY plan_id)
SELECT *, coalesce(round_even((cached + fetched)::DOUBLE/nullif(cached + fetched + straight, 0), 3), 0e0) AS real_ratio FROM c""")
def agg_9(fx):
    turn = (F.col("origin") + F.col("destination")) % 4
    legs = fx.legs.withColumn("geometry_from", F.when(turn == 1, "fetched").when(turn > 1, "cached"))
    return V.leg_provenance(legs, ["plan_id"])


@query("agg_21", f"""
WITH c AS (SELECT zone, count(DISTINCT id) AS places FROM {ZONED} GROUP BY zone)
SELECT zone, places, CAST(greatest(1, ceil(places/50e0)) AS INTEGER) AS blocks, CAST(pow(greatest(1, ceil(places/50e0)), 2) AS INTEGER) AS requests FROM c""")
def agg_21(fx):
    zones = S.zone_table(fx.spark).select("zone", "alat", "alon", "radius_m")
    inside = radius_pairs(zones, fx.places.where("is_active").select("id", "lat", "lon"), "radius_m", reach_m=25_000)
    return V.request_plan(inside, "zone")


def _paths(fx):
    """One road per plan: the stops joined by three points each, bent a little."""
    stops = fx.days.select("plan_id", (6 * (F.col("day") - 1) + F.col("ord")).alias("n"), "lat", "lon")
    packed = stops.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("n", "lat", "lon"))).alias("s"))
    inner = F.flatten(F.transform(
        F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", 2, F.size("s")).alias("b")),
        lambda p: F.transform(
            F.sequence(F.lit(0), F.lit(3)),
            lambda i: F.struct(
                (p["a"]["lat"] + (p["b"]["lat"] - p["a"]["lat"]) * i / 4).alias("lat"),
                (p["a"]["lon"] + (p["b"]["lon"] - p["a"]["lon"]) * i / 4).alias("lon"),
            ),
        ),
    ))
    last = F.element_at("s", -1)
    path = F.concat(inner, F.array(F.struct(last["lat"].alias("lat"), last["lon"].alias("lon"))))
    stops = F.transform("s", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return packed.where(F.size("s") >= 2).select("plan_id", stops.alias("stops"), path.alias("path"))


WIN_18 = """
WITH s AS (SELECT plan_id, 6*(day - 1) + ord AS n, lat, lon, count(*) OVER (PARTITION BY plan_id) AS k FROM days_fx),
v AS (SELECT a.plan_id, 4*(a.n - 1) + i + 1 AS pos, a.lat + (b.lat - a.lat)*i/4e0 AS lat, a.lon + (b.lon - a.lon)*i/4e0 AS lon
 FROM s a JOIN s b ON b.plan_id = a.plan_id AND b.n = a.n + 1, range(0, 4) t(i) UNION ALL SELECT plan_id, 4*(n - 1) + 1, lat, lon FROM s WHERE n = k AND k >= 2),
walk AS (SELECT s.plan_id, s.n, s.k, CASE WHEN s.k = 1 THEN NULL ELSE (SELECT arg_min(v.pos, ((v.lat - s.lat)*(v.lat - s.lat) + (v.lon - s.lon)*(v.lon - s.lon), v.pos)) FROM v WHERE v.plan_id = s.plan_id) END AS pos FROM s WHERE n = 1
 UNION ALL SELECT w.plan_id, s.n, w.k, CASE WHEN s.n = w.k THEN (SELECT max(v.pos) FROM v WHERE v.plan_id = s.plan_id) ELSE (SELECT arg_min(v.pos, ((v.lat - s.lat)*(v.lat - s.lat) + (v.lon - s.lon)*(v.lon - s.lon), v.pos)) FROM v WHERE v.plan_id = s.plan_id AND v.pos >= w.pos) END
 FROM walk w JOIN s ON s.plan_id = w.plan_id AND s.n = w.n + 1)
SELECT a.plan_id, CAST(a.n - 1 AS INTEGER) AS segment, CAST(CASE WHEN b.pos > a.pos THEN b.pos - a.pos + 1 ELSE 0 END AS INTEGER) AS vertices,
CASE WHEN b.pos > a.pos THEN round(f.lat, 6) END AS from_lat, CASE WHEN b.pos > a.pos THEN round(t.lat, 6) END AS to_lat
FROM walk a JOIN walk b ON b.plan_id = a.plan_id AND b.n = a.n + 1 JOIN v f ON f.plan_id = a.plan_id AND f.pos = a.pos JOIN v t ON t.plan_id = b.plan_id AND t.pos = b.pos"""


@query("win_18", WIN_18.replace("WITH s AS", "WITH RECURSIVE s AS"))
def win_18(fx):
    folder = run_folder(fx.spark, "routes")
    _paths(fx).write.parquet(folder)
    cut = V.split_by_stops(fx.spark.read.parquet(folder))
    return cut.select("plan_id", F.posexplode("segments").alias("segment", "v")).select(
        "plan_id", "segment", F.size("v").alias("vertices"),
        F.round(F.try_element_at("v", F.lit(1))["lat"], 6).alias("from_lat"),
        F.round(F.try_element_at("v", F.lit(-1))["lat"], 6).alias("to_lat"),
    )


VERTICES = """SELECT plan_id, 6*(day - 1) + ord AS position, lat + CASE WHEN ord % 2 = 0 THEN 0.00001e0 ELSE 0e0 END AS lat, lon FROM days_fx
UNION ALL SELECT plan_id, 100 + 6*(day - 1) + ord, 14.5e0 + 0.00001e0*(ord % 3), -89e0 + 0.001e0*(6*(day - 1) + ord) FROM days_fx"""


STRAY = """round(sqrt(pow((v.lon - a.lon) - t.t*(b.lon - a.lon), 2) + pow((v.lat - a.lat) - t.t*(b.lat - a.lat), 2)), 12)"""
WIN_19 = f"""WITH RECURSIVE v AS ({VERTICES}),
stretch AS (SELECT plan_id, min(position) AS lo, max(position) AS hi FROM v GROUP BY plan_id
UNION ALL SELECT plan_id, unnest([lo, m]) AS lo, unnest([m, hi]) AS hi FROM (
SELECT s.plan_id, s.lo, s.hi, v.position AS m, row_number() OVER (PARTITION BY s.plan_id, s.lo ORDER BY {STRAY} DESC, v.position) AS r, {STRAY} AS stray
FROM stretch s JOIN v a ON a.plan_id = s.plan_id AND a.position = s.lo JOIN v b ON b.plan_id = s.plan_id AND b.position = s.hi
JOIN v ON v.plan_id = s.plan_id AND v.position > s.lo AND v.position < s.hi,
LATERAL (SELECT greatest(0, least(1, coalesce(((v.lon - a.lon)*(b.lon - a.lon) + (v.lat - a.lat)*(b.lat - a.lat))/nullif((b.lon - a.lon)*(b.lon - a.lon) + (b.lat - a.lat)*(b.lat - a.lat), 0), 0))) AS t) t
) WHERE r = 1 AND stray > 0.00005e0)
SELECT plan_id, position, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v WHERE EXISTS (SELECT 1 FROM stretch s WHERE s.plan_id = v.plan_id AND v.position IN (s.lo, s.hi))"""


@query("win_19", WIN_19)
def win_19(fx):
    paths = fx.sql(VERTICES.replace("FROM days_fx", "FROM {days_fx}"))
    return V.simplify(paths, ["plan_id"]).select("plan_id", "position", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
