"""Landed answers of weather, sea and routing services turned into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions.geo import haversine_km

HOURLY = (
    "hourly struct<time:array<string>,precipitation_probability:array<string>,precipitation:array<string>,"
    "temperature_2m:array<string>,weather_code:array<string>>"
)
MARINE = (
    "daily struct<time:array<string>,wave_height_max:array<string>,wave_period_max:array<string>,"
    "wave_direction_dominant:array<string>>, hourly struct<time:array<string>,sea_surface_temperature:array<string>>"
)


def hourly_rows(answers: DataFrame, body: str = "body") -> DataFrame:
    """One row per forecast hour; a series of the wrong length reads as zeros."""
    parsed = answers.withColumn("_h", F.from_json(body, HOURLY)["hourly"])
    times = F.col("_h.time")

    def series(name: str) -> Column:
        values = F.col(f"_h.{name}")
        return F.when(F.size(values) == F.size(times), values).otherwise(
            F.array_repeat(F.lit(None).cast("string"), F.size(times))
        )

    zipped = F.arrays_zip(
        times.alias("time"), series("precipitation_probability").alias("probability"),
        series("precipitation").alias("mm"), series("temperature_2m").alias("temp"), series("weather_code").alias("code"),
    )
    rows = parsed.select(*[c for c in answers.columns if c != body], F.explode(zipped).alias("_r"))
    clock = F.regexp_extract("_r.time", r"^(\d{4}-\d{2}-\d{2})T(\d{1,2})", 2)
    number = lambda c: F.coalesce(F.col(f"_r.{c}").try_cast("double"), F.lit(0.0))
    return rows.select(
        *[c for c in answers.columns if c != body],
        F.try_to_date(F.regexp_extract("_r.time", r"^(\d{4}-\d{2}-\d{2})T\d", 1)).alias("date"),
        clock.try_cast("int").alias("hour"), number("probability").cast("int").alias("probability"),
        number("mm").alias("mm"), number("temp").alias("temp"), number("code").cast("int").alias("code"),
    ).where(F.col("date").isNotNull() & F.col("hour").between(0, 23))


def marine_days(answers: DataFrame, body: str = "body") -> DataFrame:
    """One row per day with both wave height and period; water temperature at noon."""
    parsed = answers.withColumn("_m", F.from_json(body, f"struct<{_fields(MARINE)}>"))
    noon = F.filter(
        F.arrays_zip(F.col("_m.hourly.time").alias("time"), F.col("_m.hourly.sea_surface_temperature").alias("water")),
        lambda r: r["time"].rlike(r"T12") & r["water"].isNotNull(),
    )
    days = F.arrays_zip(
        F.col("_m.daily.time").alias("time"), F.col("_m.daily.wave_height_max").alias("height"),
        F.col("_m.daily.wave_period_max").alias("period"), F.col("_m.daily.wave_direction_dominant").alias("direction"),
    )
    keep = [c for c in answers.columns if c != body]
    rows = parsed.select(*keep, noon.alias("_noon"), F.explode(days).alias("_r"))
    water = F.try_element_at(F.filter("_noon", lambda n: F.substring(n["time"], 1, 10) == F.col("_r.time")), F.lit(1))["water"]
    number = lambda c: F.col(f"_r.{c}").try_cast("double")
    return rows.select(
        *keep, F.try_to_date("_r.time").alias("date"), F.bround(number("height"), 2).alias("wave_m"),
        F.bround(number("period"), 1).alias("period_s"),
        F.coalesce(number("direction").cast("int"), F.lit(0)).alias("direction"),
        F.bround(water.try_cast("double"), 1).alias("water_c"),
    ).where(F.col("wave_m").isNotNull() & F.col("period_s").isNotNull() & F.col("date").isNotNull())


def _fields(ddl: str) -> str:
    """Column DDL as the inside of a struct type."""
    return ddl.replace("daily struct", "daily:struct").replace("hourly struct", "hourly:struct")


def matrix_edges(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Travel rows of n×m answers: metres to km, seconds to minutes, null cells and self pairs dropped.

    Each answer holds ``origins`` and ``destinations`` (struct id, lat, lon) and two nested
    arrays, ``metres`` and ``seconds``. Cells shorter than the straight line are dropped too.
    """
    rows = answers.select(
        *keys, "destinations", F.posexplode(F.arrays_zip("origins", "metres", "seconds")).alias("_i", "_row")
    ).select(
        *keys, F.col("_row.origins").alias("_from"),
        F.explode(
            F.arrays_zip(
                F.col("destinations").alias("to"), F.col("_row.metres").alias("metres"), F.col("_row.seconds").alias("seconds")
            )
        ).alias("_cell"),
    )
    km = F.col("_cell.metres") / 1000.0
    minutes = F.greatest(F.lit(1), F.bround(F.col("_cell.seconds") / 60.0, 0).cast("int"))
    straight = haversine_km("_from.lat", "_from.lon", "_cell.to.lat", "_cell.to.lon")
    return rows.where(
        (F.col("_from.id") != F.col("_cell.to.id")) & F.col("_cell.metres").isNotNull()
        & F.col("_cell.seconds").isNotNull() & (km >= straight * K.PLAUSIBLE_SHARE)
    ).select(
        *keys, F.col("_from.id").alias("origin"), F.col("_cell.to.id").alias("destination"),
        F.bround(km, 3).alias("km"), minutes.alias("minutes"),
    )


def vertices(coordinates: Column) -> Column:
    """GeoJSON lon/lat pairs as an array of struct(lat, lon); null below two vertices."""
    points = F.transform(
        F.filter(coordinates, lambda v: F.try_element_at(v, F.lit(1)).isNotNull()),
        lambda v: F.struct(v[1].alias("lat"), v[0].alias("lon")),
    )
    return F.when(F.size(points) >= 2, points)


def as_wkt(points: Column, decimals: int = 6) -> Column:
    """Vertices as LINESTRING text."""
    number = lambda c: c.cast(f"decimal(10,{decimals})").cast("string")
    pairs = F.transform(points, lambda p: F.concat(number(p["lon"]), F.lit(" "), number(p["lat"])))
    return F.concat(F.lit("LINESTRING("), F.array_join(pairs, ", "), F.lit(")"))
