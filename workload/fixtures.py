"""Views over the given tables, in SQL both engines read the same way.

``{name}`` stands for a given table or another view.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailgrid.operators import sequence as Q

#: Stops that a task holds, about, when it numbers, clocks or adds up the days of its plans.
STOPS_PER_PART = 200_000

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # catalogue of places
    "places_fx": """
SELECT p_partkey AS id, p_name AS name, CASE p_type WHEN 'ECONOMY' THEN 'food' WHEN 'STANDARD' THEN 'nature'
WHEN 'PROMO' THEN 'culture' WHEN 'MEDIUM' THEN 'viewpoint' WHEN 'LARGE' THEN 'attraction' ELSE 'lodging' END AS category,
CASE p_type WHEN 'STANDARD' THEN CASE p_size % 3 WHEN 0 THEN 'beach' WHEN 1 THEN 'peak' ELSE 'waterfall' END
WHEN 'PROMO' THEN CASE p_size % 2 WHEN 0 THEN 'museum' ELSE 'monument' END WHEN 'MEDIUM' THEN 'viewpoint'
WHEN 'LARGE' THEN CASE p_size % 2 WHEN 0 THEN 'zoo' ELSE 'mall' END WHEN 'ECONOMY' THEN 'restaurant' ELSE 'hotel' END AS subcategory,
13.15e0 + ((p_partkey*919) % 1000)*0.0013e0 AS lat,
-90.10e0 + ((p_partkey*729 + 37*CAST(floor(p_partkey/1000) AS BIGINT)) % 1000)*0.0024e0 AS lon,
0.4e0 + (p_size % 13)*0.05e0 AS quality, p_size <> 50 AS is_active FROM {part}""",
    # query points
    "areas_fx": """
SELECT n_nationkey AS area_id, 13.2e0 + n_nationkey*0.045e0 AS alat, -90.0e0 + n_nationkey*0.09e0 AS alon,
10000 + 1000*(n_nationkey % 16) AS radius_m FROM {nation}""",
    # finished plans: one stop per line
    "stops_fx": """
SELECT l_orderkey AS plan_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
l_extendedprice) AS ord, l_partkey AS place_id, 15*(1 + CAST(l_quantity AS BIGINT) % 8) AS dwell_min,
CAST(l_shipdate AS DATE) AS day FROM {lineitem}""",
    # hourly weather of one cell
    "hourly_fx": """
SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour, round(sum(value)/700, 1) AS mm,
round(20 + avg(value)/10, 1) AS temp, CAST(10*(count(*) % 10) AS INT) AS code
FROM {events} GROUP BY CAST(ts AS DATE), hour(ts)""",
    # request log
    "requests_fx": "SELECT event_id, user_id AS ip, ts FROM {events}",
    # gazetteer names
    "names_fx": """
SELECT s_suppkey AS name_id,
concat(CASE s_nationkey % 5 WHEN 0 THEN 'Barrio ' WHEN 1 THEN 'Colonia ' WHEN 2 THEN 'Villa ' WHEN 3 THEN 'San ' ELSE 'Puerto ' END,
CASE s_suppkey % 9 WHEN 0 THEN 'Red Widget' WHEN 1 THEN 'Blue Anvil' WHEN 2 THEN 'Old Gizmo' WHEN 3 THEN 'Cold Ring'
WHEN 4 THEN 'Hot Plate' WHEN 5 THEN 'New Gear' WHEN 6 THEN 'Small Bolt' WHEN 7 THEN 'Large Rod' ELSE 'Miraflores' END) AS name,
CASE s_nationkey % 8 WHEN 0 THEN 'neighbourhood' WHEN 1 THEN 'suburb' WHEN 2 THEN 'admin8' WHEN 3 THEN 'village'
WHEN 4 THEN 'town' WHEN 5 THEN 'city' WHEN 6 THEN 'admin6' ELSE 'admin4' END AS kind,
13.2e0 + ((s_suppkey*613) % 1000)*0.0012e0 AS lat, -90.0e0 + ((s_suppkey*409) % 1000)*0.0022e0 AS lon,
3000 + 250*(s_suppkey % 17) AS radius_m FROM {supplier}""",
    # texts people type: a name with one letter missing, the name alone, its last word, with a zone
    "queries_fx": """
SELECT 4*k + 0 AS query_id, concat(substr(name, 1, 3), substr(name, 5)) AS text FROM (SELECT min(p_partkey) AS k, p_name AS name FROM {part} GROUP BY p_name) a
UNION ALL SELECT 4*k + 1, name FROM (SELECT min(p_partkey) AS k, p_name AS name FROM {part} GROUP BY p_name) b
UNION ALL SELECT 4*k + 2, substr(name, instr(name, ' ') + 1) FROM (SELECT min(p_partkey) AS k, p_name AS name FROM {part} GROUP BY p_name) c
UNION ALL SELECT 4*k + 3, concat(name, CASE k % 3 WHEN 0 THEN ' Santa Ana' WHEN 1 THEN ' Juayúa' ELSE ' Villa Roja' END) FROM (SELECT min(p_partkey) AS k, p_name AS name FROM {part} GROUP BY p_name) d""",
    # crowded catalogue: about twenty rows within a few hundred metres, names that repeat and nest
    "sites_fx": """
SELECT p_partkey AS id,
CASE p_partkey % 3 WHEN 0 THEN concat('Parque Tova', CAST(CAST(floor(p_partkey/3) AS BIGINT) AS VARCHAR(9)))
WHEN 1 THEN concat('Parque Nacional Tova', CAST(CAST(floor(p_partkey/3) AS BIGINT) AS VARCHAR(9)))
ELSE CASE WHEN CAST(floor(p_partkey/3) AS BIGINT) % 2 = 0 THEN concat('Parque de Tova', CAST(CAST(floor(p_partkey/3) AS BIGINT) AS VARCHAR(9))) ELSE p_name END END AS name,
CASE p_type WHEN 'ECONOMY' THEN 'food' WHEN 'STANDARD' THEN 'nature' WHEN 'PROMO' THEN 'culture' WHEN 'MEDIUM' THEN 'viewpoint' WHEN 'LARGE' THEN 'attraction' ELSE 'lodging' END AS category,
13.0e0 + (CAST(floor(p_partkey/20) AS BIGINT) % 97)*0.017e0 + (p_partkey % 7)*0.0004e0 AS lat,
-90.0e0 + CAST(floor(p_partkey/1940) AS BIGINT)*0.019e0 + (p_partkey % 5)*0.0005e0 AS lon,
0.4e0 + (p_size % 13)*0.05e0 AS quality,
p_size <> 50 AND p_partkey % 31 <> 0 AS is_active,
CASE WHEN p_size = 50 THEN 'nombre_generico' WHEN p_partkey % 31 = 0 THEN 'duplicado' ELSE NULL END AS rejected_reason,
CASE WHEN p_partkey % 31 = 0 AND p_size <> 50 THEN p_partkey + 1 ELSE NULL END AS duplicate_of FROM {part}""",
    # consecutive stops of a plan
    "legs_fx": """
SELECT plan_id, ord, origin, destination FROM (SELECT plan_id, ord, place_id AS destination,
lag(place_id) OVER (PARTITION BY plan_id ORDER BY ord) AS origin FROM {stops_fx}) t
WHERE origin IS NOT NULL AND origin <> destination""",
    # measured travel
    "edges_fx": """
SELECT e.origin, e.destination, 'driving-car' AS profile,
round(12742.0176e0*asin(sqrt(power(sin(radians(b.lat - a.lat)/2), 2) + cos(radians(a.lat))*cos(radians(b.lat))*
power(sin(radians(b.lon - a.lon)/2), 2)))*(0.9e0 + ((e.origin + e.destination) % 8)/10e0), 3) AS km,
CAST(2 + (e.origin*7 + e.destination*3) % 55 AS INT) AS minutes,
CASE (e.origin + 2*e.destination) % 5 WHEN 0 THEN 'estimated' WHEN 1 THEN 'osrm' ELSE 'ors' END AS source
FROM (SELECT DISTINCT origin, destination FROM {legs_fx}) e JOIN {places_fx} a ON a.id = e.origin
JOIN {places_fx} b ON b.id = e.destination WHERE (e.origin + e.destination) % 3 <> 0""",
    # trip requests
    "plans_fx": """
SELECT o_orderkey AS plan_id,
CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 480 WHEN '2' THEN 540 WHEN '3' THEN 600 WHEN '4' THEN 390 ELSE 660 END AS earliest,
CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1080 WHEN '2' THEN 1140 WHEN '3' THEN 900 WHEN '4' THEN 1320 ELSE 1260 END AS latest,
CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE round(o_totalprice/2000) END AS max_km,
CASE WHEN o_orderstatus = 'P' THEN 'walking' ELSE 'driving' END AS mode,
date_add(DATE '2024-01-01', CAST(o_orderkey % 40 AS INT)) AS start_date,
CAST(o_custkey % 25 AS INT) AS area_id,
CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(2 + o_custkey % 8 AS INT) END AS max_stops,
o_orderkey % 7 <> 0 AS include_meals
FROM {orders}""",
    # the stops of a plan cut into days of at most six, with legs, categories and meals
    "days_fx": """
SELECT s.plan_id, CAST(1 + floor((s.ord - 1)/6) AS INT) AS day, CAST(1 + (s.ord - 1) % 6 AS INT) AS ord, s.place_id, p.name,
p.category, p.subcategory, p.lat, p.lon, CAST(s.dwell_min AS INT) AS dwell,
CASE WHEN (s.ord - 1) % 6 = 0 THEN 0e0 ELSE round(0.5e0 + ((s.place_id*37 + s.ord) % 97)/7e0, 3) END AS leg_km,
CAST(CASE WHEN (s.ord - 1) % 6 = 0 THEN 0 ELSE 5 + (s.place_id*13 + s.ord) % 40 END AS INT) AS leg_min,
CASE WHEN p.category <> 'food' THEN NULL WHEN (s.ord - 1) % 6 = 0 THEN 'breakfast' WHEN (s.ord - 1) % 6 < 4 THEN 'lunch' ELSE 'dinner' END AS meal
FROM {stops_fx} s JOIN {places_fx} p ON p.id = s.place_id""",
    # the same days with one meal of each kind at most
    "meals_fx": """
SELECT d.plan_id, d.day, d.ord, d.place_id, d.name, d.category, d.subcategory, d.lat, d.lon, d.dwell, d.leg_km, d.leg_min,
CASE WHEN d.meal IS NOT NULL AND row_number() OVER (PARTITION BY d.plan_id, d.day, d.meal ORDER BY d.ord) = 1 THEN d.meal ELSE NULL END AS meal
FROM {days_fx} d""",
    # and the clock on them: a meal waits for its window to open
    "timed_fx": """
SELECT b.plan_id, b.day, b.ord, b.place_id, b.name, b.category, b.subcategory, b.lat, b.lon, b.dwell, b.leg_km, b.leg_min, b.meal,
CAST(b.s + greatest(coalesce(max(b.opens - b.s) OVER (PARTITION BY b.plan_id, b.day ORDER BY b.ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 0) AS INT) AS arrival,
CAST(b.s + greatest(coalesce(max(b.opens - b.s) OVER (PARTITION BY b.plan_id, b.day ORDER BY b.ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 0) + b.dwell AS INT) AS departure
FROM (SELECT m.*, CASE m.meal WHEN 'breakfast' THEN 390 WHEN 'lunch' THEN 690 WHEN 'dinner' THEN 1080 ELSE NULL END AS opens,
CAST(t.earliest + sum(m.leg_min) OVER (PARTITION BY m.plan_id, m.day ORDER BY m.ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
+ coalesce(sum(m.dwell) OVER (PARTITION BY m.plan_id, m.day ORDER BY m.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
FROM {meals_fx} m JOIN {plans_fx} t ON t.plan_id = m.plan_id) b""",
    # edits asked for stored plans
    "edits_fx": """
SELECT plan_id, day, CASE (place_id + ord) % 3 WHEN 0 THEN 'remove' WHEN 1 THEN 'move' ELSE 'add' END AS op,
CASE WHEN (place_id + ord) % 3 = 2 THEN place_id + 500 ELSE place_id END AS place_id, CAST(day + 1 AS INT) AS to_day
FROM {days_fx} WHERE (place_id + plan_id) % 9 = 0""",
    # trips to plan in bulk
    "trips_fx": """
SELECT s_suppkey AS plan_id, 13.2e0 + s_nationkey*0.045e0 AS alat, -90.0e0 + s_nationkey*0.09e0 AS alon,
CAST(10000 + 1000*(s_nationkey % 16) AS INT) AS radius_m, CAST(1 + s_suppkey % 3 AS INT) AS days, CAST(480 + 30*(s_suppkey % 4) AS INT) AS earliest,
CAST(1080 + 60*(s_suppkey % 4) AS INT) AS latest, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 30e0 + s_suppkey % 60 END AS max_km, 'driving' AS mode,
CAST(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 3 + s_suppkey % 5 END AS INT) AS max_stops, s_suppkey % 5 <> 0 AS include_meals, 0.45e0 AS min_quality,
date_add(DATE '2024-01-01', CAST(s_suppkey % 40 AS INT)) AS start_date, 90 AS meal_minutes,
CASE s_suppkey % 3 WHEN 0 THEN 'culture' WHEN 1 THEN 'viewpoint' ELSE NULL END AS req_category,
CASE s_suppkey % 4 WHEN 1 THEN 'beach' WHEN 2 THEN 'peak' ELSE NULL END AS req_sub, CASE WHEN s_suppkey % 2 = 0 THEN 'nature' ELSE NULL END AS pref_category,
CASE WHEN s_suppkey % 5 = 1 THEN 'attraction' ELSE NULL END AS avoid_category,
s_suppkey % 3 = 1 AS named_breakfast, s_suppkey % 7 < 3 AS named_lunch, s_suppkey % 4 = 1 AS named_dinner,
CASE s_suppkey % 6 WHEN 0 THEN 'regional' WHEN 4 THEN 'pizza' ELSE NULL END AS lunch_cuisine,
CASE s_suppkey % 5 WHEN 2 THEN 'seafood' WHEN 3 THEN 'sushi' ELSE NULL END AS dinner_cuisine,
CASE WHEN s_suppkey % 4 = 2 THEN g.a ELSE NULL END AS ask_first, CASE WHEN s_suppkey % 8 = 2 THEN g.b ELSE NULL END AS ask_second
FROM {supplier} LEFT JOIN (SELECT CAST(round((lat - 13.2e0)/0.045e0) AS INT) AS cell, min(id) AS a, max(id) AS b FROM {places_fx}
WHERE is_active AND category <> 'lodging' AND abs(lon + 90e0 - 0.09e0*round((lat - 13.2e0)/0.045e0)) <= 0.08e0
GROUP BY CAST(round((lat - 13.2e0)/0.045e0) AS INT)) g ON g.cell = s_nationkey""",
    # the tags a place carries
    "tags_fx": """
SELECT p_partkey AS id, p_name AS name,
CASE p_partkey % 14 WHEN 0 THEN 'Mo-Fr 12:00-15:00, 17:30-22:00' WHEN 1 THEN 'Tu-Su 07:00-22:00; Mo off'
WHEN 2 THEN 'Sa 11:00-01:00' WHEN 3 THEN concat('0', CAST(6 + p_size % 4 AS VARCHAR(9)), ':00-22:00') WHEN 4 THEN '24/7'
WHEN 5 THEN 'Mo 17:00-21:00,Tu 11:30-21:00' WHEN 6 THEN 'Mo 12:00‑22:00' WHEN 7 THEN 'Tu-Sa' WHEN 8 THEN 'sunrise-sunset'
WHEN 9 THEN 'Fr-Mo 09:00-17:00; Su off' WHEN 10 THEN 'Su 20:00-02:00' WHEN 11 THEN NULL
WHEN 12 THEN concat('Mo-Su 1', CAST(p_size % 3 AS VARCHAR(9)), ':00-2', CAST(p_size % 4 AS VARCHAR(9)), ':30') ELSE 'closed' END AS opening_hours,
CASE p_partkey % 11 WHEN 0 THEN 'pupusa;regional' WHEN 1 THEN 'regional, pizza' WHEN 2 THEN 'Coffee Shop;burger'
WHEN 3 THEN 'local' WHEN 4 THEN 'fusion' WHEN 5 THEN 'steak_house' WHEN 6 THEN 'seafood;fish' WHEN 7 THEN 'martian;regional' ELSE NULL END AS cuisine,
CASE p_partkey % 5 WHEN 0 THEN concat('2121-', CAST(2000 + p_partkey % 7000 AS VARCHAR(9)), ', 2312-7228') WHEN 1 THEN '7777-0000; 7777-1111' ELSE NULL END AS phone,
CASE p_partkey % 7 WHEN 0 THEN concat('7000-', CAST(1000 + p_size AS VARCHAR(9))) ELSE NULL END AS contact_phone,
CASE p_partkey % 6 WHEN 0 THEN concat('https://a.example/', p_brand, ',x;https://b.example') ELSE NULL END AS website,
CASE p_partkey % 8 WHEN 0 THEN concat(CAST(p_partkey % 4000 AS VARCHAR(9)), ' m') WHEN 1 THEN CAST(p_size*20 AS VARCHAR(9))
WHEN 2 THEN 'alto' WHEN 3 THEN concat(CAST(p_size AS VARCHAR(9)), ',5 m') ELSE NULL END AS ele
FROM {part}""",
    # raw map elements as they are downloaded
    "elements_fx": """
SELECT CASE WHEN p_partkey % 5 = 0 THEN 'way' ELSE 'node' END AS osm_type, p_partkey AS osm_id,
CASE WHEN p_partkey % 5 = 0 OR p_partkey % 17 = 0 THEN NULL ELSE 13.15e0 + ((p_partkey*919) % 1000)*0.0013e0 END AS lat,
CASE WHEN p_partkey % 5 = 0 OR p_partkey % 17 = 0 THEN NULL ELSE -90.10e0 + ((p_partkey*729) % 1000)*0.0024e0 END AS lon,
CASE WHEN p_partkey % 5 = 0 THEN 13.15e0 + ((p_partkey*919) % 1000)*0.0013e0 ELSE NULL END AS clat,
CASE WHEN p_partkey % 5 = 0 THEN -90.10e0 + ((p_partkey*729) % 1000)*0.0024e0 ELSE NULL END AS clon,
CASE p_partkey % 23 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'ab' WHEN 3 THEN 'El Museo' WHEN 4 THEN 'Volcán'
WHEN 5 THEN concat('Letrero de ', p_name) WHEN 6 THEN concat('KM 12 ', p_name) WHEN 7 THEN 'Lunes a Viernes 800 a 1700'
WHEN 8 THEN concat(p_name, ' Sábado 0900') WHEN 9 THEN 'Miércoles y Jueves' WHEN 10 THEN concat('Cerro Santo Domingo ', p_name)
WHEN 11 THEN '123 456' WHEN 12 THEN concat('3a. Calle ', p_name) WHEN 13 THEN concat('Hotel ', p_name)
WHEN 14 THEN concat(p_name, ' 7:30') WHEN 15 THEN concat('  Café ', p_name, ', S.A. ') WHEN 16 THEN concat('Cabañas ', p_name)
ELSE p_name END AS name,
CASE p_size % 10 WHEN 0 THEN 'viewpoint' WHEN 1 THEN 'museum' WHEN 2 THEN 'attraction' WHEN 3 THEN 'information' ELSE NULL END AS tourism,
CASE p_size % 13 WHEN 4 THEN 'tomb' WHEN 5 THEN 'ruins' ELSE NULL END AS historic,
CASE p_size % 9 WHEN 4 THEN 'restaurant' WHEN 5 THEN 'cafe' WHEN 6 THEN 'theatre' WHEN 7 THEN 'bank' ELSE NULL END AS amenity,
CASE p_size % 7 WHEN 5 THEN 'beach' WHEN 6 THEN 'peak' ELSE NULL END AS natural_,
CASE p_size % 11 WHEN 8 THEN 'park' WHEN 9 THEN 'pitch' ELSE NULL END AS leisure,
CASE p_size % 12 WHEN 11 THEN 'mall' ELSE NULL END AS shop,
CASE WHEN p_partkey % 23 IN (13, 16, 17) THEN 'hotel' ELSE NULL END AS building,
CASE WHEN p_partkey % 3 = 0 THEN 'Mo-Su 08:00-18:00' ELSE NULL END AS opening_hours,
CASE WHEN p_partkey % 4 = 0 THEN 'https://x.example' ELSE NULL END AS contact_website,
CASE WHEN p_partkey % 6 = 1 THEN '2222-0000' ELSE NULL END AS phone,
CASE WHEN p_partkey % 5 = 2 THEN 'Q1' ELSE NULL END AS wikidata,
CASE WHEN p_partkey % 7 = 3 THEN 'Juayúa' ELSE NULL END AS addr_city,
CASE WHEN p_partkey % 2 = 0 THEN 'pizza' ELSE NULL END AS cuisine
FROM {part}""",
}


class Fixtures:
    """The given tables and the views above as DataFrames of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run ``text`` with every ``{name}`` bound to that table or view."""
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{name: getattr(self, name) for name in names})

    @cached_property
    def parts(self) -> int:
        """Parts of whole plans that hold about ``STOPS_PER_PART`` stops, however many there are."""
        return self.lineitem.count() // STOPS_PER_PART + 1

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.parts, "plan_id")

    def numbered(self) -> DataFrame:
        """The rows of ``stops_fx``, dealt by plan.

        Named first and numbered then: ``stops_fx`` has the names beside what they rename while its
        rows are sorted, and Spark does not know the stops as dealt by plan_id and deals them again.
        """
        lines = self.lineitem.select(
            F.col("l_orderkey").alias("plan_id"), F.col("l_partkey").alias("place_id"), "l_linenumber", "l_suppkey", "l_extendedprice",
            F.expr("15*(1 + CAST(l_quantity AS BIGINT) % 8)").alias("dwell_min"), F.expr("CAST(l_shipdate AS DATE)").alias("day"),
        )
        order = Window.partitionBy("plan_id").orderBy("l_linenumber", "place_id", "l_suppkey", "l_extendedprice")
        return self.dealt(lines).select("plan_id", F.row_number().over(order).alias("ord"), "place_id", "dwell_min", "day")

    def stops_of_plans(self, *columns: str) -> DataFrame:
        """The rows of ``meals_fx`` that have a plan, with these columns of it, dealt by plan.

        The plans join the stops where these are dealt and sorted by plan anyway, to be numbered. So
        the stops of a task are sorted once for meals and clock alike, and join no more.
        """
        joined = self.stops.join(self.dealt(self.plans.select("plan_id", *columns)), "plan_id")
        days = VIEWS["days_fx"].replace("SELECT ", "SELECT " + "".join(f"s.{c}, " for c in columns), 1)
        return Q.first_meals(self.dealt(self.spark.sql(days, stops_fx=joined, places_fx=self.places)))

    def clocked(self, *columns: str) -> DataFrame:
        """The rows of ``timed_fx`` with these columns of their plans."""
        stops = Q.schedule(self.stops_of_plans(*dict.fromkeys(["earliest", *columns])))
        return stops.select(
            "plan_id", "day", "ord", "place_id", "name", "category", "subcategory", "lat", "lon", "dwell", "leg_km", "leg_min", "meal",
            "arrival", "departure", *columns,
        )

    def __getattr__(self, name: str) -> DataFrame:
        view = name if name in VIEWS else f"{name}_fx"
        if name not in TABLES and view not in VIEWS:
            raise AttributeError(name)
        if name not in self._frames:
            build = {"stops_fx": self.numbered, "timed_fx": self.clocked}.get(view)
            self._frames[name] = self.table(name) if name in TABLES else build() if build else self.sql(VIEWS[view])
        return self._frames[name]
