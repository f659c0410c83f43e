"""Classification, verdict and completeness of map elements from their tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import text as T


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def has(tags: Column, *keys: str) -> Column:
    """Whether any of the tags is present and not empty."""
    found = F.lit(False)
    for key in keys:
        found = found | (F.coalesce(tag(tags, key), F.lit("")) != "")
    return found


def clean_name(tags: Column) -> Column:
    return F.regexp_replace(F.coalesce(tag(tags, "name"), F.lit("")), r"^\s+|\s+$", "")


def classify(tags: Column) -> Column:
    """struct(category, subcategory) of the first rule that matches, or null."""

    def kind(category: str, subcategory: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), subcategory.alias("subcategory"))

    matches = []
    for key, accepted, category in K.TAG_RULES:
        raw = tag(tags, key)
        matches.append(F.when(raw.isin(*accepted) if accepted else raw.isNotNull(), kind(category, raw)))
    building = tag(tags, "building")
    lodging = building.isin(*K.BUILDING_LODGING) & F.coalesce(tag(tags, "name"), F.lit("")).rlike(K.LODGING_NAME)
    matches.append(F.when(lodging, kind("lodging", F.concat(F.lit("building:"), building))))
    return F.coalesce(*matches)


def looks_like_schedule(plain: Column) -> Column:
    """A clock time, an hour range, two weekdays, or a weekday with a bare hour."""
    days = F.array_distinct(F.regexp_extract_all(plain, F.lit(K.WEEKDAY_WORD), F.lit(1)))
    return (
        plain.rlike(K.CLOCK_TIME)
        | plain.rlike(K.HOUR_RANGE)
        | (F.size(days) >= 2)
        | ((F.size(days) >= 1) & plain.rlike(K.BARE_HOUR))
    )


def not_a_destination(name: Column, plain: Column) -> Column:
    """Signs, markers, landslides and accesses; numbered streets."""
    return name.rlike(K.NOT_A_DESTINATION) | plain.rlike(K.STREET_NAME)


def is_generic(name: Column) -> Column:
    return T.normalise(name).isin(*K.GENERIC_NAMES)


def completeness(tags: Column, category: Column) -> Column:
    """How much a record tells, from 0.4 to 1."""
    points = (
        F.lit(0.4)
        + F.when(has(tags, "opening_hours"), 0.15).otherwise(0.0)
        + F.when(has(tags, "website", "contact:website"), 0.10).otherwise(0.0)
        + F.when(has(tags, "phone", "contact:phone"), 0.05).otherwise(0.0)
        + F.when(has(tags, "description", "wikipedia", "wikidata"), 0.15).otherwise(0.0)
        + F.when(has(tags, "addr:city", "addr:street"), 0.10).otherwise(0.0)
        + F.when((category == "food") & has(tags, "cuisine"), 0.05).otherwise(0.0)
    )
    return F.bround(F.least(points, F.lit(1.0)), 3)


def rejection(tags: Column) -> Column:
    """The named reason a row stays out of the catalogue, or null."""
    name = clean_name(tags)
    plain = T.without_marks(name)
    return (
        F.when(name == "", "sin_nombre")
        .when(F.length(name) < K.MIN_NAME_LENGTH, "nombre_muy_corto")
        .when(is_generic(name), "nombre_generico")
        .when(name.rlike(K.NOT_A_DESTINATION), "no_es_destino")
        .when(looks_like_schedule(plain), "nombre_es_horario")
        .when(~name.rlike(K.NAME_LETTER), "nombre_sin_letras")
        .when(plain.rlike(K.STREET_NAME), "no_es_destino")
        .when(classify(tags).isNull(), "categoria_no_soportada")
    )
