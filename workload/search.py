"""Catalogue search."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.operators import search as S
from workload.base import query
from workload.sqltext import ZONES, hav_m, in_list, lookup

AREA_M = hav_m("a.alat", "a.alon", "p.lat", "p.lon")
IN_AREA = f"""SELECT a.area_id, a.radius_m, p.id, p.name, p.category, p.subcategory, p.quality, p.lat, p.lon, {AREA_M} AS distance_m
FROM areas_fx a JOIN places_fx p ON p.is_active AND {AREA_M} <= a.radius_m"""
SERVICES = f"""(SELECT CAST(count(*) AS INTEGER) FROM places_fx v WHERE v.is_active AND v.category IN ('food','lodging')
AND {hav_m('v.lat', 'v.lon', 'b.lat', 'b.lon')} <= 2000)"""


@query("win_1", f"""
WITH cand AS ({IN_AREA} AND p.quality >= 0.5e0 AND p.category <> 'lodging'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY area_id, category ORDER BY quality DESC, round(distance_m, 1), id) AS rank FROM cand)
SELECT area_id, category, CAST(rank AS INTEGER) AS rank, id, name, round(quality, 3) AS quality, round(distance_m, 1) AS distance_m, {SERVICES} AS services
FROM ranked b WHERE rank <= 10""")
def win_1(fx):
    best = S.search_in_area(fx.areas, fx.places, per_category=10, min_quality=0.5)
    return best.select(
        "area_id", "category", "rank", "id", "name", F.round("quality", 3).alias("quality"),
        F.round("distance_m", 1).alias("distance_m"), "services",
    )


@query("win_2", f"""
WITH cand AS ({IN_AREA} AND p.category <> 'lodging'),
a AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY quality DESC, id) AS r1, {lookup(K.APPEAL, 'subcategory', '0.25e0')} AS appeal FROM cand),
b AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY appeal DESC, quality DESC, id) AS rank FROM a WHERE r1 <= 60)
SELECT area_id, CAST(rank AS INTEGER) AS rank, id, appeal, round(quality, 3) AS quality FROM b WHERE rank <= 20""")
def win_2(fx):
    return S.top_by_appeal(fx.areas, fx.places, 20).select(
        "area_id", "rank", "id", "appeal", F.round("quality", 3).alias("quality")
    )


@query("join_4", f"""
WITH cand AS ({IN_AREA} AND p.category <> 'lodging'),
r AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY round(distance_m, 1), id) AS rank FROM cand)
SELECT area_id, id, name, round(distance_m, 1) AS distance_m FROM r WHERE rank <= 200""")
def join_4(fx):
    return S.search_nearby(fx.areas, fx.places, limit=200).select(
        "area_id", "id", "name", F.round("distance_m", 1).alias("distance_m")
    )


@query("join_5", f"""
WITH cand AS ({IN_AREA}),
r AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY round(distance_m, 1), id) AS rank FROM cand)
SELECT area_id, CAST(rank AS INTEGER) AS rank, id, round(distance_m, 1) AS distance_m FROM r WHERE rank <= 5""")
def join_5(fx):
    near = S.search_nearby(fx.areas, fx.places, include_lodging=True, limit=5)
    return near.select("area_id", "rank", "id", F.round("distance_m", 1).alias("distance_m"))


@query("join_6", f"SELECT b.id, {SERVICES} AS services FROM places_fx b")
def join_6(fx):
    return S.catalogue_services(fx.places).select("id", "services")


@query("join_7", f"""
WITH cand AS ({IN_AREA} AND p.category = 'lodging' AND EXISTS (SELECT 1 FROM places_fx x WHERE x.is_active
 AND x.subcategory = 'beach' AND {hav_m('x.lat', 'x.lon', 'p.lat', 'p.lon')} <= 2500)),
r AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY quality DESC, round(distance_m, 1), id) AS rank FROM cand)
SELECT area_id, CAST(rank AS INTEGER) AS rank, id, round(distance_m, 1) AS distance_m, {SERVICES} AS services FROM r b WHERE rank <= 12""")
def join_7(fx):
    return S.beach_lodging(fx.areas, fx.places).select(
        "area_id", "rank", "id", F.round("distance_m", 1).alias("distance_m"), "services"
    )


@query("join_8", """
SELECT w.id, p.name, p.id IS NULL AS missing FROM (SELECT DISTINCT l_partkey + l_suppkey AS id FROM lineitem) w
LEFT JOIN places_fx p ON p.id = w.id AND p.is_active""")
def join_8(fx):
    wanted = fx.lineitem.select((F.col("l_partkey") + F.col("l_suppkey")).alias("id"))
    return S.by_ids(wanted, fx.places).select("id", "name", "missing")


@query("join_9", f"""
SELECT l.origin, l.destination, round({hav_m('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 1) AS distance_m
FROM (SELECT DISTINCT origin, destination FROM legs_fx) l JOIN places_fx a ON a.id = l.origin JOIN places_fx b ON b.id = l.destination""")
def join_9(fx):
    return S.pair_distance(fx.legs, fx.places).select(
        "origin", "destination", F.round("distance_m", 1).alias("distance_m")
    )


@query("join_10", f"""
SELECT n.name_id, n.name, count(p.id) AS destinations, count(p.id) >= 4 AS is_active,
CASE WHEN count(p.id) < 4 THEN 'pocos_destinos' END AS rejected_reason
FROM names_fx n LEFT JOIN places_fx p ON p.is_active AND p.category <> 'food' AND {hav_m('n.lat', 'n.lon', 'p.lat', 'p.lon')} <= n.radius_m
GROUP BY n.name_id, n.name""")
def join_10(fx):
    return S.names_with_destinations(fx.names, fx.places).select(
        "name_id", "name", "destinations", "is_active", "rejected_reason"
    )


@query("join_11", f"""
SELECT zone, z.radius_m, count(p.id) AS places, count(p.id) FILTER (p.category NOT IN ('food', 'lodging')) AS destinations,
count(p.id) FILTER (p.category NOT IN ('food', 'lodging')) < 8 AS review
FROM {ZONES} LEFT JOIN places_fx p ON p.is_active AND {hav_m('z.alat', 'z.alon', 'p.lat', 'p.lon')} <= z.radius_m GROUP BY zone, z.radius_m""")
def join_11(fx):
    return S.zone_coverage(fx.places)


@query("flt_8", """
SELECT id, 'default' AS asked FROM places_fx WHERE category <> 'lodging'
UNION ALL SELECT id, 'food+lodging' FROM places_fx WHERE category IN ('food', 'lodging')
UNION ALL SELECT id, 'everything' FROM places_fx""")
def flt_8(fx):
    asks = {"default": (None, False), "food+lodging": (["food", "lodging"], False), "everything": (None, True)}
    parts = [
        fx.places.where(S.category_filter(*ask)).select("id", F.lit(name).alias("asked"))
        for name, ask in asks.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("flt_9", "SELECT id, round(quality, 3) AS quality FROM places_fx WHERE is_active AND quality >= 0.6e0")
def flt_9(fx):
    return S.usable(fx.places, 0.6).select("id", F.round("quality", 3).alias("quality"))


@query("flt_10", """
SELECT o_orderkey AS request, least(greatest(CAST(round(o_totalprice) AS BIGINT), 1), 100000) AS radius_m,
least(greatest(o_custkey % 400 - 20, 1), 200) AS "limit", least(greatest(o_custkey % 90 - 10, 1), 50) AS per_category FROM orders""")
def flt_10(fx):
    asked = fx.orders.select(
        F.col("o_orderkey").alias("request"), F.round("o_totalprice").cast("long").alias("radius_m"),
        (F.col("o_custkey") % 400 - 20).alias("limit"), (F.col("o_custkey") % 90 - 10).alias("per_category"),
    )
    return S.clamp_parameters(asked)


@query("flt_11", f"""
SELECT id, category, {lookup(K.APPEAL, 'subcategory', '0.25e0')} AS appeal FROM places_fx
WHERE category = 'food' OR {lookup(K.APPEAL, 'subcategory', '0.25e0')} >= 0.45e0""")
def flt_11(fx):
    return S.appeal_floor(fx.places).select("id", "category", S.appeal_of("subcategory").alias("appeal"))


@query("flt_18", f"SELECT id, name FROM places_fx WHERE category NOT IN {in_list(K.NOT_ANCHORABLE)}")
def flt_18(fx):
    return S.anchorable(fx.places).select("id", "name")


@query("src_11", "SELECT round_even(lat, 4) AS lat, round_even(lon, 4) AS lon FROM places_fx WHERE is_active")
def src_11(fx):
    return S.coordinate_field(fx.places)
