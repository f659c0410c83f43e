"""The evaluation requests: named cases over curated zones."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgrid import constants as K

# Name, zone key and what the case changes from two plain days.
CASES = (
    ("capital-2d", "san-salvador", {}),
    ("flores-3d", "ataco", {"days": 3}),
    ("santa-ana-2d", "santa-ana", {}),
    ("coatepeque-2d", "coatepeque", {}),
    ("cerro-verde-2d", "cerro-verde", {}),
    ("perquin-2d", "perquin", {}),
    ("costa-del-sol-3d", "costa-del-sol", {"days": 3}),
    ("metapan-2d", "metapan", {}),
    ("la-palma-2d", "la-palma", {}),
    ("alegria-2d", "alegria", {}),
    ("arranque-tarde", "ataco", {"earliest": 660}),
    ("dia-corto", "san-salvador", {"earliest": 600, "latest": 900}),
    ("dia-largo", "san-salvador", {"latest": 1260, "max_stops": 9}),
    ("poco-carro", "santa-ana", {"max_km": 10.0}),
    ("muy-poco-carro", "ataco", {"max_km": 3.0}),
    ("a-pie", "san-salvador", {"mode": "walking", "max_km": 6.0, "radius_m": 5_000}),
    ("sin-limite", "san-salvador", {"max_km": 200.0}),
    ("sin-naturaleza", "ataco", {"avoided": ["nature"]}),
    ("solo-cultura", "san-salvador", {"preferred": ["culture"]}),
    ("sin-comidas", "suchitoto", {"include_meals": False}),
    ("evitar-dos", "santa-ana", {"avoided": ["nature", "culture"], "max_km": 60.0}),
    ("dia-liviano", "ataco", {"max_stops": 2}),
    ("dia-cargado", "san-salvador", {"max_stops": 10, "latest": 1260}),
    ("semana-completa", "san-salvador", {"days": 7, "radius_m": 25_000}),
    ("una-semana-en-zona-chica", "alegria", {"days": 7}),
    ("calidad-alta", "san-salvador", {"min_quality": 0.6}),
)
SCHEMA = (
    "plan_id string, alat double, alon double, radius_m int, days int, earliest int, latest int, max_km double, "
    "mode string, max_stops int, include_meals boolean, min_quality double, start_date date, meal_minutes int, "
    "preferred array<string>, avoided array<string>, required array<string>, required_subs array<string>"
)


def cases(spark: SparkSession) -> DataFrame:
    zones = {z[0]: z for z in K.ZONES}
    rows = []
    for name, zone, changes in CASES:
        row = {
            "radius_m": zones[zone][4], "days": 2, "earliest": 540, "latest": 1200, "max_km": None, "mode": "driving",
            "max_stops": None, "include_meals": True, "min_quality": 0.0, "preferred": [], "avoided": [], **changes,
        }
        rows.append((
            name, zones[zone][2], zones[zone][3], row["radius_m"], row["days"], row["earliest"], row["latest"],
            row["max_km"], row["mode"], row["max_stops"], row["include_meals"], row["min_quality"], None,
            K.MEAL_MINUTES, row["preferred"], row["avoided"], [], [],
        ))
    return spark.createDataFrame(rows, SCHEMA)


def week(spark: SparkSession, monday: dt.date = dt.date(2024, 1, 1)) -> DataFrame:
    """The cases on each day of a week, as trips ``name/date``; closing days fall on a few weekdays only."""
    days = F.sequence(F.lit(monday), F.lit(monday + dt.timedelta(days=6)))
    dated = cases(spark).withColumn("start_date", F.explode(days))
    return dated.withColumn("plan_id", F.concat_ws("/", "plan_id", "start_date"))


def zone_of(plan_id: str = "plan_id") -> Column:
    """The zone of a trip of ``cases`` or ``week``."""
    zones = F.create_map(*[F.lit(text) for name, zone, _ in CASES for text in (name, zone)])
    return F.try_element_at(zones, F.substring_index(plan_id, "/", 1))
