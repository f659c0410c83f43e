"""Weather, sea, light and opening hours joined to days and stops by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import hours as H
from trailgrid.functions import timectx as C


def weather_days(hourly: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell and date with its hours, at most 24, in an array.

    Many plans share a date, so they join one row instead of twenty-four.
    """
    hour = F.struct("hour", "mm", "temp", "code")
    per_hour = hourly.groupBy(*keys, "date", "hour").agg(F.min(hour).alias("h"))
    return per_hour.groupBy(*keys, "date").agg(F.array_sort(F.collect_list("h")).alias("hours"))


def forecast_for(days: DataFrame, weather: DataFrame, keys: list[str], today: Column, horizon: int = K.WEATHER_HORIZON_DAYS) -> DataFrame:
    """Days with their forecast, and why it is missing when it is.

    ``days`` holds start_date and date; the trip is asked for as a whole.
    """
    joined = days.join(weather, [*keys, "date"], "left")
    last = F.date_add(today, horizon - 1)
    reason = (
        F.when(F.col("start_date").isNull(), "sin_fecha")
        .when((F.col("start_date") > last) | (F.col("date") > last), "fuera_de_pronostico")
        .when(F.col("hours").isNull(), "sin_servicio")
    )
    return joined.withColumn("reason", reason).withColumn("hours", F.when(F.col("reason").isNull(), F.col("hours")))


def sea_for(days: DataFrame, sea: DataFrame, keys: list[str], today: Column) -> DataFrame:
    """Days with the state of the sea; inland trips and far dates have a reason instead."""
    joined = days.join(sea, [*keys, "date"], "left")
    last = F.date_add(today, K.SEA_HORIZON_DAYS - 1)
    reason = (
        F.when(~F.col("coastal"), "tierra_adentro")
        .when(F.col("start_date").isNull(), "sin_fecha")
        .when((F.col("start_date") > last) | (F.col("date") > last), "fuera_de_pronostico")
        .when(F.col("wave_m").isNull(), "sin_servicio")
    )
    return joined.withColumn("reason", reason).withColumn("wave_m", F.when(F.col("reason").isNull(), F.col("wave_m")))


def hours_between(hours: Column, start: Column, stop: Column) -> Column:
    """The forecast hours of a stretch of minutes, both end hours included."""
    return F.filter(hours, lambda h: h["hour"].between(F.floor(start / 60), F.floor(stop / 60)))


def rain_hours(hours: Column, start: Column, stop: Column) -> Column:
    return F.transform(
        F.filter(hours_between(hours, start, stop), lambda h: C.is_rain(h["mm"])), lambda h: h["hour"]
    )


def wet_stops(stops: DataFrame, weather: DataFrame, keys: list[str]) -> DataFrame:
    """Stops with the rainy hours they pass through; only outdoor stops get wet."""
    joined = stops.join(weather, [*keys, "date"], "left")
    hours = F.coalesce(rain_hours(F.col("hours"), F.col("arrival"), F.col("departure")), F.array().cast("array<int>"))
    outdoor = F.col("category").isin(*K.OUTDOOR)
    return joined.withColumn("rain_hours", hours).withColumn("wet", outdoor & (F.size("rain_hours") > 0))


def rain_stretches(legs: DataFrame, rainy: DataFrame, keys: list[str]) -> DataFrame:
    """Legs (date, arrival, departure) with every stretch of rain inside them, as fractions ``begins`` and ``ends``.

    ``rainy`` is (keys, date, hour). Its runs of hours are found once per date; a leg meets whole
    runs and cuts them to its own length, which are the runs of the hours it passes through.
    """
    hours = rainy.groupBy(*keys, "date").agg(F.collect_set("hour").alias("_hours"))
    runs = hours.select(*keys, "date", F.explode(C.hour_runs(F.col("_hours"))).alias("_run")).select(
        *keys, "date", (F.col("_run.first") * 60).alias("_from"), (F.col("_run.last") * 60 + 60).alias("_to")
    )
    start, stop = F.col("arrival"), F.col("departure")
    met = legs.join(runs, [*keys, "date"]).where((F.col("_from") < stop) & (F.col("_to") > start) & (stop > start))
    return met.withColumns({
        "begins": F.try_divide((F.greatest(F.col("_from"), start) - start).cast("double"), stop - start),
        "ends": F.try_divide((F.least(F.col("_to"), stop) - start).cast("double"), stop - start),
    }).drop("_from", "_to")


def day_weather(days: DataFrame) -> DataFrame:
    """Summary of the travelled hours: temperatures, rain, rainy hours, one code and its words."""
    inside = days.withColumn("_in", hours_between(F.col("hours"), F.col("start"), F.col("stop")))
    wet = F.filter("_in", lambda h: C.is_rain(h["mm"]))
    dry = F.filter("_in", lambda h: h["code"] < K.FIRST_RAIN_CODE)
    codes = lambda a: F.transform(a, lambda h: h["code"])
    temps = F.transform("_in", lambda h: h["temp"])
    summary = inside.where(F.size("_in") > 0).withColumns(
        {
            "temp_max": F.bround(F.array_max(temps), 0).cast("int"),
            "temp_min": F.bround(F.array_min(temps), 0).cast("int"),
            "rain_mm": F.bround(F.aggregate("_in", F.lit(0.0), lambda t, h: t + h["mm"]), 1),
            "rain_hours": F.transform(wet, lambda h: h["hour"]),
            "code": F.coalesce(F.array_max(codes(wet)), F.array_max(codes(dry)), F.array_min(codes(F.col("_in")))),
        }
    )
    return summary.withColumn("words", C.weather_words("code")).drop("_in", "hours")


def visit_states(visits: DataFrame) -> DataFrame:
    """Visits (date, arrival, departure, opening_hours) with their opening state.

    Visits that hold ``open`` and ``runs``, as ``with_hours`` tells them, are not read again.
    """
    start = C.minute_of_week("date", "arrival")
    stop = start + F.greatest(F.col("departure") - F.col("arrival"), F.lit(0))
    known = visits if "runs" in visits.columns else H.with_hours(visits, runs=True)
    return known.withColumn("state", H.visit_state(F.col("open"), start, stop, F.col("runs"))).drop("open", "runs")


def meal_hours_audit(visits: DataFrame) -> DataFrame:
    """Meals and the km to them by zone, weekday and state, and over any of these (null), as ``level`` tells."""
    km = F.sum(F.bround(F.col("leg_km") * 1000, 0).cast("long")) / 1000
    return (
        visit_states(visits).withColumn("weekday", F.weekday("date")).cube("zone", "weekday", "state")
        .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("meals"), F.round(km, 3).alias("km"))
    )
