"""Files the sources read, written by Spark from the given tables into the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrid.session import run_folder

TAG_COLUMNS = {
    "name": "name", "tourism": "tourism", "historic": "historic", "amenity": "amenity", "natural": "natural_",
    "leisure": "leisure", "shop": "shop", "building": "building", "opening_hours": "opening_hours",
    "contact:website": "contact_website", "phone": "phone", "wikidata": "wikidata", "addr:city": "addr_city",
    "cuisine": "cuisine",
}


def tag_map(columns: dict[str, str]):
    pairs = F.create_map(*[v for key, column in columns.items() for v in (F.lit(key), F.col(column))])
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def elements(fx) -> DataFrame:
    """Raw elements with nested centre and tags."""
    return fx.elements.select(
        F.col("osm_type").alias("type"), F.col("osm_id").alias("id"), "lat", "lon",
        F.when(F.col("clat").isNotNull(), F.struct(F.col("clat").alias("lat"), F.col("clon").alias("lon"))).alias("center"),
        F.lit(None).cast("struct<minlat:double,minlon:double,maxlat:double,maxlon:double>").alias("bounds"),
        tag_map(TAG_COLUMNS).alias("tags"),
    )


def as_json_lines(frame: DataFrame, name: str) -> str:
    """Write one JSON object per row; returns the folder."""
    folder = run_folder(frame.sparkSession, name)
    frame.write.json(folder)
    return folder


def land_batches(batch: DataFrame, name: str) -> str:
    """Write element rows as batches of the downloaded shape, one element per batch."""
    return as_json_lines(batch.select(F.array(F.struct(*batch.columns)).alias("elements")), name)
