"""Trip requests: cleaning, coherence, limits and the ladders that fill what was not said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import timectx as C
from trailgrid.functions.geo import literal_map


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def anchors_day(has_start: Column, returns: Column, inside: Column, number: Column) -> Column:
    """Whether a day leaves from the start place."""
    return has_start & (returns | (number == 1) | inside)


def mode_for(day_modes: Column, mode: Column, number: Column) -> Column:
    return F.coalesce(F.try_element_at(day_modes, number.cast("string")), mode)


def date_of_day(start_date: Column, number: Column) -> Column:
    return F.date_add(start_date, number - 1)


def _by_mode(table: dict, mode: Column, default: Column) -> Column:
    return F.when(mode == "driving", table["driving"]).when(mode == "walking", table["walking"]).otherwise(default)


def km_budget(asked: Column, mode: Column, day_mode: Column) -> Column:
    """The day's kilometres: what was asked, unless the day goes another way than the trip."""
    return (
        F.when(asked.isNull(), _by_mode(K.UNSTATED_KM, day_mode, F.lit(K.UNSTATED_KM["driving"])))
        .when(day_mode == mode, asked)
        .otherwise(_by_mode(K.STATED_KM, day_mode, asked))
    )


def stop_cap(asked: Column) -> Column:
    return F.coalesce(F.nullif(asked, F.lit(0)), F.lit(K.DAY_STOP_CAP))


def dwell_minutes(
    *, meal: Column, meal_minutes: Column, is_anchor: Column, place_minutes: Column, place: Column,
    category_minutes: Column, category: Column, subcategory: Column,
) -> Column:
    """How long a stop lasts: meal, anchor, place, category, then the tables."""
    breakfast = F.when(meal_minutes != K.MEAL_MINUTES, meal_minutes).otherwise(F.lit(K.BREAKFAST_MINUTES))
    return (
        F.when(meal == "breakfast", breakfast)
        .when(meal.isNotNull(), meal_minutes)
        .when(is_anchor, F.lit(0))
        .otherwise(
            F.coalesce(
                F.try_element_at(place_minutes, place.cast("string")), F.try_element_at(category_minutes, category),
                F.try_element_at(literal_map(K.SUBCATEGORY_MINUTES), F.coalesce(subcategory, F.lit(""))),
                F.try_element_at(literal_map(K.CATEGORY_MINUTES), category), F.lit(60),
            )
        )
    )


def meal_windows(earliest: Column, latest: Column, include_meals: Column, named: Column) -> Column:
    """The meals a day may hold, as array of struct(meal, opens, closes) in order."""
    def window(meal: str) -> Column:
        opens, closes = K.MEAL_WINDOWS[meal]
        return F.struct(F.lit(meal).alias("meal"), F.lit(opens).alias("opens"), F.lit(closes).alias("closes"))

    (_, b_close), (l_open, l_close), (d_open, _) = (K.MEAL_WINDOWS[m] for m in ("breakfast", "lunch", "dinner"))
    possible = F.array(
        F.when(F.array_contains(named, "breakfast") & (earliest <= b_close), window("breakfast")),
        F.when((latest >= l_open) & (earliest <= l_close), window("lunch")),
        F.when(latest >= d_open, window("dinner")),
    )
    return F.when(include_meals, F.filter(possible, lambda w: w.isNotNull())).otherwise(F.slice(possible, 1, 0))


def meals_that_fit(earliest: Column, latest: Column, cap: Column, include_meals: Column, visit_minutes: Column) -> Column:
    """One meal, or two when the day is long enough to reach dinner."""
    reaches = earliest + cap * (visit_minutes + K.TYPICAL_TRAVEL_MIN) >= K.MEAL_WINDOWS["dinner"][0]
    stays = latest >= K.MEAL_WINDOWS["dinner"][0]
    return F.when(~include_meals, 0).when(reaches & stays, 2).otherwise(1)


def light_limit(date: Column, lat: Column, lon: Column) -> Column:
    """Minute the light ends: the sunset of a dated day, else a fixed dusk."""
    return F.coalesce(C.sunset_minute(date, lat, lon), F.lit(K.DUSK_MIN))


def leaving_limit(category: Column, light: Column, latest: Column) -> Column:
    """The latest minute a visit may end."""
    return F.when(category.isin(*K.OUTDOOR), light).when(category.isin(*K.INDOOR), K.INDOOR_CLOSE_MIN).otherwise(latest)


def too_late(category: Column, arrival: Column, dwell: Column, light: Column) -> Column:
    """Outdoors must end in daylight, indoors must start before closing; food is exempt."""
    return (
        F.when(category.isin(*K.OUTDOOR), arrival + dwell > light)
        .when(category.isin(*K.INDOOR), arrival >= K.INDOOR_CLOSE_MIN)
        .otherwise(False)
    )


def cuisine_for(meal_cuisines: Column, meal: Column) -> Column:
    return F.coalesce(F.try_element_at(meal_cuisines, meal), F.try_element_at(meal_cuisines, F.lit("any")))


def _notes(*tests: Column) -> Column:
    return F.filter(F.array(*tests), lambda n: n.isNotNull())


def clean_number(value: Column, low: float, high: float, name: str) -> tuple[Column, Column]:
    """A number brought into its range and the note that says so; what was not said stays null."""
    note = F.when(value < low, F.concat(F.lit(name), F.lit(f" < {low}"))).when(
        value > high, F.concat(F.lit(name), F.lit(f" > {high}"))
    )
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high))), note


def clean_time(text: Column, default: int, name: str) -> tuple[Column, Column]:
    """Minute of the day of an HH:MM text, hours and minutes wrapped; the default and a note if it is none."""
    clock = r"^\s*(\d+)\s*:\s*(\d+)\s*(:.*)?$"
    hours, minutes = (F.regexp_extract(text, clock, n).try_cast("int") for n in (1, 2))
    minute = (hours % 24) * 60 + minutes % 60
    return F.coalesce(minute, F.lit(default)), F.when(text.isNotNull() & minute.isNull(), F.lit(name))


def clean_map(column: str, keep) -> tuple[Column, Column]:
    """The entries of a map that ``keep(key, value)`` allows, and a note if any was dropped."""
    kept = F.map_filter(column, lambda k, v: F.coalesce(keep(k, v), F.lit(False)))
    return kept, F.when(F.size(column) > F.size(kept), F.lit(column))


def clean_requests(raw: DataFrame, today: Column) -> DataFrame:
    """Requests within their ranges and vocabularies, with one note per field changed.

    A number out of range is brought to its end, a visit's minutes out of range are dropped, an
    unknown mode is driving, and a day that ends before it starts has the usual hours.
    """
    days, days_note = clean_number(F.coalesce("days", F.lit(1)), 1, 7, "days")
    stops, stops_note = clean_number(F.col("max_stops"), 1, K.DAY_STOP_CAP, "max_stops")
    meal, meal_note = clean_number(F.coalesce("meal_minutes", F.lit(K.MEAL_MINUTES)), 20, 240, "meal_minutes")
    km, km_note = clean_number(F.col("max_km"), *K.ASKED_KM, "max_km")
    earliest, earliest_note = clean_time(F.col("earliest_text"), K.DAY_STARTS, "earliest")
    latest, latest_note = clean_time(F.col("latest_text"), K.DAY_ENDS, "latest")
    backwards = earliest >= latest

    def vocabulary(column: str, allowed: tuple) -> tuple[Column, Column]:
        lowered = F.transform(column, lambda v: F.lower(F.trim(v)))
        kept = F.array_distinct(F.filter(lowered, lambda v: v.isin(*allowed)))
        unknown = F.filter(lowered, lambda v: ~v.isin(*allowed))
        return kept, F.when(F.size(unknown) > 0, F.concat(F.lit(f"{column}: "), F.array_join(unknown, ", ")))

    preferred, preferred_note = vocabulary("preferred", K.CATEGORIES)
    avoided, avoided_note = vocabulary("avoided", K.CATEGORIES)
    required, required_note = vocabulary("required_subcategories", K.REQUIRABLE_SUBCATEGORIES)
    meals, meals_note = vocabulary("must_include_meals", tuple(K.MEAL_WINDOWS))
    modes, modes_note = clean_map("day_modes", lambda k, v: k.rlike(r"^\s*\d+\s*$") & v.isin(*K.MODES))
    in_reason = lambda v: v.between(*K.VISIT_MINUTES)
    minutes, minutes_note = clean_map("category_minutes", lambda k, v: k.isin(*K.CATEGORIES) & in_reason(v))
    places, places_note = clean_map("place_minutes", lambda k, v: in_reason(v))
    spelt = F.transform_values("meal_cuisines", lambda k, v: F.replace(F.lower(F.trim(v)), F.lit(" "), F.lit("_")))
    meant = F.map_filter(spelt, lambda k, v: ~(k.isin(*K.MEAL_WINDOWS, "any") & v.isin(*K.CUISINES_THAT_ARE_MEALS)))
    cuisines = F.map_filter(meant, lambda k, v: k.isin(*K.MEAL_WINDOWS, "any") & v.isin(*K.CUISINES))
    cuisines_note = F.when(F.size(meant) > F.size(cuisines), F.lit("meal_cuisines"))
    start, start_note = clean_date(F.col("start_text"), today)
    return raw.select(
        "plan_id", days.cast("int").alias("days"), stops.cast("int").alias("max_stops"),
        meal.cast("int").alias("meal_minutes"), km.alias("max_km"),
        F.when(F.lower(F.trim("mode")).isin(*K.MODES), F.lower(F.trim("mode"))).otherwise("driving").alias("mode"),
        F.when(backwards, K.DAY_STARTS).otherwise(earliest).alias("earliest"), F.when(backwards, K.DAY_ENDS).otherwise(latest).alias("latest"),
        preferred.alias("preferred"), avoided.alias("avoided"),
        required.alias("required_subcategories"), meals.alias("must_include_meals"), modes.alias("day_modes"),
        minutes.alias("category_minutes"), places.alias("place_minutes"), cuisines.alias("meal_cuisines"), start.alias("start_date"),
        _notes(
            days_note, stops_note, meal_note, km_note, earliest_note, latest_note, F.when(backwards, F.lit("horario")),
            preferred_note, avoided_note, required_note, meals_note, modes_note, minutes_note, places_note, cuisines_note, start_note,
        ).alias("notes"),
    )


def clean_date(text: Column, today: Column) -> tuple[Column, Column]:
    """A date from today to a year ahead, else null and why."""
    said = F.coalesce(F.trim(text), F.lit("")) != ""
    date = F.try_to_date(F.trim(text), "yyyy-MM-dd")
    good = date.between(today, F.date_add(today, 365))
    note = (
        F.when(said & date.isNull(), F.lit("fecha ilegible"))
        .when(date < today, F.lit("fecha pasada"))
        .when(date > F.date_add(today, 365), F.lit("fecha lejana"))
    )
    return F.when(good, date), note


def incoherence(earliest: Column, latest: Column, preferred: Column, avoided: Column, required: Column) -> Column:
    """Why a request contradicts itself, or null."""
    return (
        F.when(earliest >= latest, "horario")
        .when(F.arrays_overlap(preferred, avoided), "preferidas y evitadas")
        .when(F.arrays_overlap(required, avoided), "exigidas y evitadas")
    )
