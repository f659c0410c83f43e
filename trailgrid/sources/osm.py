"""Landed map elements: reading, points, verdicts, gazetteer names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import quality as Q
from trailgrid.functions.geo import box_radius_km

ELEMENT = (
    "struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,"
    "bounds:struct<minlat:double,minlon:double,maxlat:double,maxlon:double>,tags:map<string,string>>"
)
BATCH = f"elements array<{ELEMENT}>"


def read_elements(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Elements of every landed batch with the file (query group) they came from.

    Batches written one per line can be split between tasks; a whole-file document needs
    ``multi_line``.
    """
    batches = spark.read.schema(BATCH).option("multiLine", multi_line).json(path)
    return batches.select(F.input_file_name().alias("source_file"), F.inline("elements"))


def with_point(elements: DataFrame) -> DataFrame:
    """Own coordinates, else the centre; ``lat`` stays null when there is neither."""
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return elements.withColumns(
        {
            "lat": F.when(own, F.col("lat")).otherwise(F.col("center.lat")),
            "lon": F.when(own, F.col("lon")).otherwise(F.col("center.lon")),
        }
    )


def verdicts(elements: DataFrame) -> DataFrame:
    """Catalogue rows with category, score and the reason of each rejection.

    Elements without a point are dropped; rejected rows are kept and flagged.
    """
    tags = F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>"))
    located = with_point(elements).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    judged = located.withColumn("tags", tags).withColumns(
        {"rejected_reason": Q.rejection(F.col("tags")), "_kind": Q.classify(F.col("tags"))}
    )
    accepted = F.col("rejected_reason").isNull()
    return judged.select(
        F.col("type").alias("osm_type"), F.col("id").alias("osm_id"),
        F.substring(F.coalesce(F.nullif(Q.tag(F.col("tags"), "name"), F.lit("")), F.lit("(sin nombre)")), 1, 300).alias("name"),
        F.when(accepted, F.col("_kind.category")).otherwise(F.lit("attraction")).alias("category"),
        F.when(accepted, F.col("_kind.subcategory")).alias("subcategory"),
        "lat", "lon", "tags",
        F.when(accepted, Q.completeness(F.col("tags"), F.col("_kind.category"))).otherwise(F.lit(0.0)).alias("quality"),
        accepted.alias("is_active"), "rejected_reason",
    )


def verdict_counts(elements: DataFrame) -> DataFrame:
    """Rows accepted, rejected by reason, and without coordinates."""
    lost = with_point(elements).where(F.col("lat").isNull() | F.col("lon").isNull())
    outcome = verdicts(elements).select(F.coalesce("rejected_reason", F.lit("aceptados")).alias("outcome"))
    return (
        outcome.unionByName(lost.select(F.lit("sin_coordenadas").alias("outcome")))
        .groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))
    )


def refilter(places: DataFrame) -> DataFrame:
    """Active rows judged again with their stored tags; rows are only ever switched off."""
    reason = F.when(F.col("is_active"), Q.rejection(F.col("tags")))
    return places.withColumn("_reason", reason).withColumns(
        {
            "is_active": F.col("is_active") & F.col("_reason").isNull(),
            "rejected_reason": F.coalesce("_reason", "rejected_reason"),
        }
    ).drop("_reason")


def gazetteer_names(elements: DataFrame) -> DataFrame:
    """Place names with centre, kind and a search radius between 3 and 35 km."""
    tags = F.col("tags")
    name = F.regexp_replace(F.coalesce(Q.tag(tags, "name"), F.lit("")), r"^\s+|\s+$", "")
    level = Q.tag(tags, "admin_level")
    box = F.col("bounds")
    radius_of: Column = F.create_map(*[F.lit(v) for pair in K.KIND_RADIUS_KM.items() for v in pair])
    place = F.coalesce(Q.tag(tags, "place"), F.lit(""))
    boxed = box.isNotNull()
    kind = F.when(boxed, F.concat(F.lit("admin"), F.coalesce(level, F.lit("None")))).otherwise(place)
    radius = F.when(
        boxed, box_radius_km(box["minlat"], box["minlon"], box["maxlat"], box["maxlon"])
    ).otherwise(F.coalesce(F.try_element_at(radius_of, place), F.lit(K.KIND_RADIUS_DEFAULT_KM)))
    kept = F.least(F.greatest(radius, F.lit(K.RADIUS_MIN_KM)), F.lit(K.RADIUS_MAX_KM))
    lat = F.when(boxed, (box["maxlat"] + box["minlat"]) / 2).otherwise(F.coalesce("center.lat", "lat"))
    lon = F.when(boxed, (box["maxlon"] + box["minlon"]) / 2).otherwise(F.coalesce("center.lon", "lon"))
    return elements.select(
        F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), name.alias("name"), kind.alias("kind"),
        lat.alias("lat"), lon.alias("lon"), F.floor(kept * 1000).cast("int").alias("radius_m"),
        F.coalesce(level, F.lit("")).alias("_level"),
    ).where(
        (F.col("name") != "") & (F.col("_level") != "2") & (F.col("kind") != "")
        & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    ).drop("_level")
