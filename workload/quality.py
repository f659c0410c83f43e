"""Quality chain and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import quality as Q
from trailgrid.functions import text as T
from trailgrid.sources import feeds, keyed, osm
from workload import sqltext as X
from workload.base import query
from workload.landing import as_json_lines, elements, land_batches

COLUMN = {"natural": "natural_"}


def _rule(kind: int) -> str:
    """The first matching tag rule: its category (0) or its raw value (1)."""
    parts = []
    for key, accepted, category in K.TAG_RULES:
        column = COLUMN.get(key, key)
        if column == "waterway":
            continue
        test = f"{column} IN {X.in_list(accepted)}" if accepted else f"{column} IS NOT NULL"
        parts.append(f"WHEN {test} THEN {X.text(category) if kind == 0 else column}")
    lodging = f"building IN {X.in_list(K.BUILDING_LODGING)} AND regexp_matches(coalesce(name, ''), {X.text(K.LODGING_NAME)})"
    parts.append(f"WHEN {lodging} THEN " + ("'lodging'" if kind == 0 else "'building:' || building"))
    return "(CASE " + " ".join(parts) + " END)"


CLEAN = "trim(coalesce(name, ''))"
PLAIN = f"lower(strip_accents({CLEAN}))"
DAYS = f"len(list_distinct(regexp_extract_all({PLAIN}, {X.text(K.WEEKDAY_WORD)}, 1)))"
SCHEDULE = f"(regexp_matches({PLAIN}, {X.text(K.CLOCK_TIME)}) OR regexp_matches({PLAIN}, {X.text(K.HOUR_RANGE)}) OR {DAYS} >= 2 OR ({DAYS} >= 1 AND regexp_matches({PLAIN}, {X.text(K.BARE_HOUR)})))"
GENERIC = f"trim(regexp_replace({PLAIN}, '[^a-z0-9]+', ' ', 'g')) IN {X.in_list(K.GENERIC_NAMES)}"
NOWHERE = f"regexp_matches({CLEAN}, {X.text(K.NOT_A_DESTINATION)})"
STREET = f"regexp_matches({PLAIN}, {X.text(K.STREET_NAME)})"
REASON = f"""(CASE WHEN {CLEAN} = '' THEN 'sin_nombre' WHEN length({CLEAN}) < 4 THEN 'nombre_muy_corto' WHEN {GENERIC} THEN 'nombre_generico'
WHEN {NOWHERE} THEN 'no_es_destino' WHEN {SCHEDULE} THEN 'nombre_es_horario' WHEN NOT regexp_matches({CLEAN}, {X.text(K.NAME_LETTER)}) THEN 'nombre_sin_letras'
WHEN {STREET} THEN 'no_es_destino' WHEN {_rule(0)} IS NULL THEN 'categoria_no_soportada' END)"""
SCORE = f"""round_even(least(1e0, 0.4e0 + CASE WHEN opening_hours <> '' THEN 0.15e0 ELSE 0e0 END + CASE WHEN contact_website <> '' THEN 0.10e0 ELSE 0e0 END
+ CASE WHEN phone <> '' THEN 0.05e0 ELSE 0e0 END + CASE WHEN wikidata <> '' THEN 0.15e0 ELSE 0e0 END + CASE WHEN addr_city <> '' THEN 0.10e0 ELSE 0e0 END
+ CASE WHEN {_rule(0)} = 'food' AND cuisine <> '' THEN 0.05e0 ELSE 0e0 END), 3)"""
LOCATED = "SELECT *, coalesce(lat, clat) AS plat, coalesce(lon, clon) AS plon FROM elements_fx WHERE coalesce(lat, clat) IS NOT NULL AND coalesce(lon, clon) IS NOT NULL"
JUDGED = f"""SELECT osm_type, osm_id, plat, plon, coalesce(nullif(name, ''), '(sin nombre)') AS name, {REASON} AS rejected_reason, {REASON} IS NULL AS is_active,
CASE WHEN {REASON} IS NULL THEN {_rule(0)} ELSE 'attraction' END AS category, CASE WHEN {REASON} IS NULL THEN {_rule(1)} END AS subcategory,
CASE WHEN {REASON} IS NULL THEN {SCORE} ELSE 0e0 END AS quality FROM ({LOCATED})"""


@query("flt_1", f"SELECT osm_id, {_rule(0)} AS category, {_rule(1)} AS subcategory FROM elements_fx")
def flt_1(fx):
    return elements(fx).withColumn("kind", Q.classify(F.col("tags"))).select(
        F.col("id").alias("osm_id"), "kind.category", "kind.subcategory"
    )


@query("flt_2", f"SELECT osm_id, name, category, subcategory, quality, is_active, rejected_reason FROM ({JUDGED})")
def flt_2(fx):
    return osm.verdicts(elements(fx)).select(
        "osm_id", "name", "category", "subcategory", "quality", "is_active", "rejected_reason"
    )


@query("flt_3", f"SELECT osm_id, {SCHEDULE} AS schedule FROM elements_fx")
def flt_3(fx):
    plain = T.without_marks(Q.clean_name(F.col("tags")))
    return elements(fx).select(F.col("id").alias("osm_id"), Q.looks_like_schedule(plain).alias("schedule"))


@query("flt_4", f"SELECT osm_id, ({NOWHERE} OR {STREET}) AS rejected FROM elements_fx")
def flt_4(fx):
    name = Q.clean_name(F.col("tags"))
    return elements(fx).select(
        F.col("id").alias("osm_id"), Q.not_a_destination(name, T.without_marks(name)).alias("rejected")
    )


@query("flt_5", f"SELECT osm_id, {GENERIC} AS generic FROM elements_fx")
def flt_5(fx):
    return elements(fx).select(F.col("id").alias("osm_id"), Q.is_generic(Q.clean_name(F.col("tags"))).alias("generic"))


@query("flt_6", f"SELECT osm_id, {SCORE} AS score FROM elements_fx")
def flt_6(fx):
    kind = Q.classify(F.col("tags"))
    return elements(fx).select(
        F.col("id").alias("osm_id"),
        Q.completeness(F.col("tags"), F.coalesce(kind["category"], F.lit(""))).alias("score"),
    )


@query("flt_7", f"""SELECT osm_id, (osm_id % 4 <> 0) AND {REASON} IS NULL AS is_active,
CASE WHEN osm_id % 4 = 0 THEN 'apagado' ELSE {REASON} END AS rejected_reason FROM elements_fx""")
def flt_7(fx):
    stored = elements(fx).select(
        F.col("id").alias("osm_id"), "tags", (F.col("id") % 4 != 0).alias("is_active"),
        F.when(F.col("id") % 4 == 0, F.lit("apagado")).alias("rejected_reason"),
    )
    return osm.refilter(stored).select("osm_id", "is_active", "rejected_reason")


@query("agg_3", f"""
SELECT outcome, count(*) AS rows FROM (SELECT coalesce(rejected_reason, 'aceptados') AS outcome FROM ({JUDGED})
UNION ALL SELECT 'sin_coordenadas' FROM elements_fx WHERE coalesce(lat, clat) IS NULL) GROUP BY outcome""")
def agg_3(fx):
    return osm.verdict_counts(elements(fx))


@query("src_1", """SELECT osm_type AS type, osm_id AS id, coalesce(name, '') AS name, coalesce(tourism, '') AS tourism FROM elements_fx""")
def src_1(fx):
    rows = osm.read_elements(fx.spark, land_batches(elements(fx), "osm"))
    return rows.select(
        "type", "id", F.coalesce(Q.tag(F.col("tags"), "name"), F.lit("")).alias("name"),
        F.coalesce(Q.tag(F.col("tags"), "tourism"), F.lit("")).alias("tourism"),
    )


@query("src_2", "SELECT osm_id, round(coalesce(lat, clat), 6) AS lat, round(coalesce(lon, clon), 6) AS lon FROM elements_fx")
def src_2(fx):
    return osm.with_point(elements(fx)).select(
        F.col("id").alias("osm_id"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")
    )


GAZ = """SELECT s_suppkey AS id, s_name AS name, CASE s_nationkey % 6 WHEN 0 THEN '4' WHEN 1 THEN '6' WHEN 2 THEN '2' WHEN 3 THEN '8' ELSE NULL END AS admin_level,
CASE WHEN s_nationkey % 6 < 4 THEN NULL ELSE CASE s_suppkey % 7 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' WHEN 3 THEN 'suburb' WHEN 4 THEN 'neighbourhood' WHEN 5 THEN 'hamlet' ELSE NULL END END AS place,
13.2e0 + (s_suppkey % 97)*0.011e0 AS lat, -89.9e0 + (s_suppkey % 89)*0.017e0 AS lon, 0.01e0 + (s_suppkey % 50)*0.009e0 AS half FROM supplier"""


@query("src_3", f"""
WITH g AS (SELECT *, admin_level IS NOT NULL AS boxed FROM ({GAZ})),
r AS (SELECT *, CASE WHEN boxed THEN 'admin' || admin_level ELSE coalesce(place, '') END AS kind,
CASE WHEN boxed THEN sqrt(pow(2*half*110.574e0, 2) + pow(2*half*111.320e0*cos(radians(lat)), 2))/2
ELSE {X.lookup(K.KIND_RADIUS_KM, 'place', '5e0')} END AS km FROM g)
SELECT id AS osm_id, name, kind, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(floor(least(greatest(km, 3e0), 35e0)*1000) AS INTEGER) AS radius_m
FROM r WHERE kind <> '' AND coalesce(admin_level, '') <> '2'""")
def src_3(fx):
    raw = fx.sql(GAZ.replace("FROM supplier", "FROM {supplier}"))
    boxed = F.col("admin_level").isNotNull()
    half = F.col("half")
    batch = raw.select(
        F.when(boxed, F.lit("relation")).otherwise(F.lit("node")).alias("type"), "id",
        F.when(~boxed, F.col("lat")).alias("lat"), F.when(~boxed, F.col("lon")).alias("lon"),
        F.when(boxed, F.struct(
            (F.col("lat") - half).alias("minlat"), (F.col("lon") - half).alias("minlon"),
            (F.col("lat") + half).alias("maxlat"), (F.col("lon") + half).alias("maxlon"),
        )).alias("bounds"),
        F.map_filter(
            F.create_map(F.lit("name"), "name", F.lit("admin_level"), "admin_level", F.lit("place"), "place"),
            lambda k, v: v.isNotNull(),
        ).alias("tags"),
    )
    names = osm.gazetteer_names(osm.read_elements(fx.spark, land_batches(batch, "gazetteer")))
    return names.select("osm_id", "name", "kind", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "radius_m")


@query("src_4", """
WITH v AS (SELECT osm_type, osm_id, name, 1 AS load FROM elements_fx WHERE osm_id % 3 <> 0
UNION ALL SELECT osm_type, osm_id, concat(coalesce(name, ''), ' bis'), 2 FROM elements_fx WHERE osm_id % 2 = 0)
SELECT osm_type, osm_id, arg_max({'n': name}, load).n AS name, max(load) AS load FROM v GROUP BY osm_type, osm_id""")
def src_4(fx):
    rows = fx.elements.select("osm_type", "osm_id", "name")
    stored = rows.where("osm_id % 3 <> 0").withColumn("load", F.lit(1))
    arrived = rows.where("osm_id % 2 = 0").select(
        "osm_type", "osm_id", F.concat(F.coalesce("name", F.lit("")), F.lit(" bis")).alias("name"), F.lit(2).alias("load")
    )
    return keyed.upsert(stored, arrived, ["osm_type", "osm_id"], "load")


@query("set_1", """
WITH v AS (SELECT osm_type, osm_id, name, 1 AS load FROM elements_fx WHERE tourism IS NOT NULL
UNION ALL SELECT osm_type, osm_id, name, 2 FROM elements_fx WHERE amenity IS NOT NULL
UNION ALL SELECT osm_type, osm_id, name, 3 FROM elements_fx WHERE historic IS NOT NULL OR natural_ IS NOT NULL)
SELECT osm_type, osm_id, max(load) AS load FROM v GROUP BY osm_type, osm_id""")
def set_1(fx):
    rows = fx.elements
    groups = [
        rows.where(test).select("osm_type", "osm_id", "name", F.lit(i + 1).alias("load"))
        for i, test in enumerate(["tourism IS NOT NULL", "amenity IS NOT NULL", "historic IS NOT NULL OR natural_ IS NOT NULL"])
    ]
    return keyed.union_groups(groups, ["osm_type", "osm_id"], "load").select("osm_type", "osm_id", "load")


@query("src_5", """
WITH stored AS (SELECT origin, destination, km FROM edges_fx WHERE source <> 'ors'), fresh AS (SELECT origin, destination, km + 1 AS km FROM edges_fx WHERE origin % 2 = 0)
SELECT origin, destination, round(km, 3) AS km FROM stored UNION ALL SELECT origin, destination, round(km, 3) FROM fresh f
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.origin = f.origin AND s.destination = f.destination)""")
def src_5(fx):
    stored = fx.edges.where("source <> 'ors'").select("origin", "destination", "km")
    fresh = fx.edges.where("origin % 2 = 0").select("origin", "destination", (F.col("km") + 1).alias("km"))
    return keyed.insert_absent(stored, fresh, ["origin", "destination"]).withColumn("km", F.round("km", 3))


@query("src_6", """
WITH stored AS (SELECT id, name, is_active FROM places_fx WHERE id % 3 <> 1), dump AS (SELECT id, concat(name, '!') AS name, id % 5 <> 0 AS is_active FROM places_fx WHERE id % 2 = 0)
SELECT s.id, s.name, coalesce(d.is_active, s.is_active) AS is_active FROM stored s LEFT JOIN dump d USING (id)
UNION ALL SELECT id, name, is_active FROM dump WHERE id NOT IN (SELECT id FROM stored)""")
def src_6(fx):
    places = fx.places.select("id", "name", "is_active")
    dump = places.where("id % 2 = 0").select("id", F.concat("name", F.lit("!")).alias("name"), (F.col("id") % 5 != 0).alias("is_active"))
    return keyed.restore(places.where("id % 3 <> 1"), dump, ["id"])


@query("src_7", """
SELECT date, hour, CASE WHEN day(date) % 5 = 0 THEN 0e0 ELSE mm END AS mm, temp, code, CAST(hour*3 AS INTEGER) AS probability FROM hourly_fx WHERE NOT (hour = 5 AND day(date) % 3 = 0)""")
def src_7(fx):
    broken = (F.col("hour") == 5) & (F.dayofmonth("date") % 3 == 0)
    stamp = F.when(broken, F.concat(F.lit("x"), F.col("date").cast("string"), F.lit("T05:00"))).otherwise(
        F.concat(F.col("date").cast("string"), F.lit("T"), F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00"))
    )
    hours = fx.hourly.withColumn("time", stamp)
    daily = hours.groupBy("date").agg(
        F.array_sort(F.collect_list(F.struct("hour", "time", "mm", "temp", "code"))).alias("h")
    )
    mm = F.transform("h", lambda r: r["mm"])
    short = F.when(F.dayofmonth("date") % 5 == 0, F.slice(mm, 1, 2)).otherwise(mm)
    body = F.to_json(F.struct(F.struct(
        F.transform("h", lambda r: r["time"]).alias("time"),
        F.transform("h", lambda r: r["hour"] * 3).alias("precipitation_probability"),
        short.alias("precipitation"), F.transform("h", lambda r: r["temp"]).alias("temperature_2m"),
        F.transform("h", lambda r: r["code"]).alias("weather_code"),
    ).alias("hourly")))
    return feeds.hourly_rows(daily.select(body.alias("body"))).select("date", "hour", "mm", "temp", "code", "probability")


@query("src_8", """
WITH d AS (SELECT date, max(mm) AS h, min(temp) AS p, sum(code) AS c, max(temp) FILTER (hour = 12) AS w FROM hourly_fx GROUP BY date)
SELECT date, round_even(h, 2) AS wave_m, round_even(p, 1) AS period_s, CAST(c % 360 AS INTEGER) AS direction, round_even(w, 1) AS water_c FROM d WHERE day(date) % 4 <> 0""")
def src_8(fx):
    daily = fx.hourly.groupBy("date").agg(
        F.max("mm").alias("h"), F.min("temp").alias("p"), (F.sum("code") % 360).alias("c"),
        F.max(F.when(F.col("hour") == 12, F.col("temp"))).alias("w"),
    )
    day = F.col("date").cast("string")
    height = F.when(F.dayofmonth("date") % 4 != 0, F.col("h"))
    body = F.to_json(F.struct(
        F.struct(
            F.array(day).alias("time"), F.array(height).alias("wave_height_max"), F.array("p").alias("wave_period_max"),
            F.array("c").alias("wave_direction_dominant"),
        ).alias("daily"),
        F.struct(
            F.array(F.concat(day, F.lit("T11:00")), F.concat(day, F.lit("T12:00"))).alias("time"),
            F.array(F.lit(1.0), F.col("w")).alias("sea_surface_temperature"),
        ).alias("hourly"),
    ), {"ignoreNullFields": "false"})
    return feeds.marine_days(daily.select(body.alias("body")))


MATRIX_CELL = "((i*7 + j*3) % 5 = 0)"


@query("src_9", f"""
WITH s AS (SELECT plan_id, CAST(ord AS INT) AS i, place_id, lat, lon FROM (SELECT d.plan_id, 6*(d.day - 1) + d.ord AS ord, d.place_id, d.lat, d.lon FROM days_fx d)),
c AS (SELECT a.plan_id, a.place_id AS origin, b.place_id AS destination, {X.hav_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS straight, (a.i*11 + b.i*5) % 4 AS k, a.i, b.i AS j FROM s a JOIN s b USING (plan_id))
SELECT plan_id, origin, destination, round_even(km, 3) AS km, CAST(greatest(1, round_even(sec/60, 0)) AS INTEGER) AS minutes FROM
(SELECT *, straight*(0.9e0 + 0.1e0*k)*1000/1000e0 AS km, straight*90e0 AS sec FROM c) WHERE origin <> destination AND (i*7 + j*3) % 5 <> 0 AND km >= straight*0.98e0""")
def src_9(fx):
    stops = fx.days.select(
        "plan_id", (6 * (F.col("day") - 1) + F.col("ord")).alias("i"), F.col("place_id").alias("id"), "lat", "lon"
    )
    sets = stops.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("i", "id", "lat", "lon"))).alias("p"))
    from trailgrid.functions.geo import haversine_km

    def grid(cell):
        return F.transform("p", lambda a: F.transform("p", lambda b: cell(a, b)))

    straight = lambda a, b: haversine_km(a["lat"], a["lon"], b["lat"], b["lon"])
    known = lambda a, b: (a["i"] * 7 + b["i"] * 3) % 5 != 0
    measured = sets.withColumn("straight", grid(lambda a, b: F.when(known(a, b), straight(a, b))))

    def scaled(factor):
        return F.transform("p", lambda a, n: F.zip_with("p", F.get("straight", n), lambda b, s: factor(a, b, s)))

    answers = measured.select(
        "plan_id", F.col("p").alias("origins"), F.col("p").alias("destinations"),
        scaled(lambda a, b, s: s * (0.9 + 0.1 * ((a["i"] * 11 + b["i"] * 5) % 4)) * 1000).alias("metres"),
        F.transform("straight", lambda row: F.transform(row, lambda s: s * 90.0)).alias("seconds"),
    )
    return feeds.matrix_edges(answers, ["plan_id"])


@query("src_10", """
WITH l AS (SELECT l.plan_id, l.ord, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, CAST(l.origin % 6 AS INT) AS n
FROM legs_fx l JOIN places_fx a ON a.id = l.origin JOIN places_fx b ON b.id = l.destination)
SELECT plan_id, ord, n + 1 AS vertices, 'LINESTRING(' || array_to_string(list_transform(range(0, n + 1), lambda i:
CAST(CAST(alon + (blon - alon)*i/n AS DECIMAL(10,6)) AS VARCHAR) || ' ' || CAST(CAST(alat + (blat - alat)*i/n AS DECIMAL(10,6)) AS VARCHAR)), ', ') || ')' AS wkt FROM l WHERE n >= 1""")
def src_10(fx):
    ends = fx.places.select("id", "lat", "lon")
    legs = (
        fx.legs.join(ends.withColumnsRenamed({"id": "origin", "lat": "alat", "lon": "alon"}), "origin")
        .join(ends.withColumnsRenamed({"id": "destination", "lat": "blat", "lon": "blon"}), "destination")
        .withColumn("n", (F.col("origin") % 6).cast("int"))
    )
    along = F.transform(
        F.sequence(F.lit(0), F.col("n")),
        lambda i: F.array(
            F.coalesce(F.col("alon") + F.try_divide((F.col("blon") - F.col("alon")) * i, F.col("n")), F.col("alon")),
            F.coalesce(F.col("alat") + F.try_divide((F.col("blat") - F.col("alat")) * i, F.col("n")), F.col("alat")),
        ),
    )
    paths = legs.withColumn("v", feeds.vertices(along)).where(F.col("v").isNotNull())
    return paths.select("plan_id", "ord", F.size("v").alias("vertices"), feeds.as_wkt(F.col("v")).alias("wkt"))


@query("src_12", f"""
SELECT {X.SHARE_CODE} AS code, plan_id, count(*) AS stops, round(sum(leg_km), 3) AS km FROM days_fx WHERE plan_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY plan_id""")
def src_12(fx):
    shared = keyed.share_plans(fx.days)
    asked = fx.orders.where("o_orderstatus <> 'F'").select(keyed.share_code(F.col("o_orderkey")).alias("code"))
    plan = "plan_id bigint, stops array<struct<day:int,ord:int,place_id:bigint,leg_km:double>>"
    found = keyed.open_shared(asked, shared).where(F.col("payload").isNotNull())
    opened = found.select("code", F.from_json("payload", plan).alias("p"))
    total = F.aggregate("p.stops", F.lit(0.0), lambda t, s: t + s["leg_km"])
    return opened.select("code", "p.plan_id", F.size("p.stops").cast("long").alias("stops"), F.round(total, 3).alias("km"))


@query("src_14", """
SELECT plan_id, earliest, latest, max_km, mode, start_date, area_id, max_stops, include_meals, CAST(plan_id % 3 AS INTEGER) AS preferred, CASE WHEN plan_id % 4 = 1 THEN 'walking' END AS day_two FROM plans_fx""")
def src_14(fx):
    clock = lambda c: F.concat(F.lpad(F.floor(F.col(c) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col(c) % 60).cast("string"), 2, "0"))
    wanted = F.slice(F.array(F.lit("nature"), F.lit("culture")), 1, (F.col("plan_id") % 3).cast("int"))
    landed = fx.plans.select(
        "plan_id", "start_date", clock("earliest").alias("earliest_start"), clock("latest").alias("latest_end"),
        F.col("max_km").alias("max_travel_km_per_day"), "mode", F.col("area_id").alias("radius_m"),
        F.col("max_stops").alias("max_stops_per_day"), "include_meals", wanted.alias("preferred_categories"),
        F.when(F.col("plan_id") % 4 == 1, F.create_map(F.lit("2"), F.lit("walking"))).alias("day_modes"),
    )
    rows = keyed.read_requests(fx.spark, as_json_lines(landed, "requests"))
    minutes = lambda c: (F.substring(c, 1, 2).cast("int") * 60 + F.substring(c, 4, 2).cast("int"))
    return rows.select(
        "plan_id", minutes("earliest_start").alias("earliest"), minutes("latest_end").alias("latest"),
        F.col("max_travel_km_per_day").alias("max_km"), "mode", "start_date", F.col("radius_m").alias("area_id"),
        F.col("max_stops_per_day").alias("max_stops"), "include_meals",
        F.size("preferred_categories").alias("preferred"), F.try_element_at("day_modes", F.lit("2")).alias("day_two"),
    )


@query("arr_2", """SELECT id, opening_hours, cuisine, ele IS NOT NULL AS has_ele FROM tags_fx""")
def arr_2(fx):
    from workload.landing import tag_map

    packed = fx.tags.select("id", F.to_json(tag_map({c: c for c in ("opening_hours", "cuisine", "ele")})).alias("tags"))
    tags = packed.withColumn("t", F.from_json("tags", "map<string,string>"))
    return tags.select(
        "id", Q.tag(F.col("t"), "opening_hours").alias("opening_hours"), Q.tag(F.col("t"), "cuisine").alias("cuisine"),
        Q.tag(F.col("t"), "ele").isNotNull().alias("has_ele"),
    )


@query("arr_3", "SELECT name_id, count(l.l_orderkey) AS lines FROM names_fx n LEFT JOIN lineitem l ON l.l_suppkey = n.name_id GROUP BY name_id")
def arr_3(fx):
    records = fx.names.select(F.to_json(F.array(F.struct("name_id", "radius_m"))).alias("body"))
    rows = records.select(F.inline(F.from_json("body", "array<struct<name_id:bigint,radius_m:int>>")))
    lines = fx.lineitem.groupBy(F.col("l_suppkey").alias("name_id")).agg(F.count(F.lit(1)).alias("lines"))
    return rows.join(lines, "name_id", "left").select("name_id", F.coalesce("lines", F.lit(0)).alias("lines"))
