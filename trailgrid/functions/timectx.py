"""Sun, weather and clock arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions.geo import literal_map


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _wave(terms, angle: Column) -> Column:
    """Sum of (cosine, sine) terms at one, two, three ... times an angle, a constant first."""
    total = F.lit(terms[0])
    for n, (cosine, sine) in enumerate(terms[1:], start=1):
        total = total + cosine * F.cos(n * angle) + sine * F.sin(n * angle)
    return total


def sunset_minute(date, lat, lon, utc_offset: float = K.UTC_OFFSET_HOURS) -> Column:
    """Local minute of the day the sun sets; null on days it does not.

    Declination and equation of time are Fourier series in the angle of the year, taken at six in
    the evening; the hour angle at which the upper rim meets the horizon gives the minute.
    """
    date, lat, lon = _c(date), F.radians(_c(lat)), _c(lon)
    year = (F.dayofyear(date) - 1 + (6 - utc_offset) / 24) * K.YEAR_ANGLE
    decline = _wave(K.DECLINATION, year)
    reach = F.cos(F.lit(K.SUNSET_ZENITH)) / (F.cos(lat) * F.cos(decline)) - F.tan(lat) * F.tan(decline)
    minute = 720 + 60 * utc_offset - 4 * lon + 4 * F.degrees(F.acos(reach)) - _wave(K.TIME_EQUATION, year)
    return F.when(F.abs(reach) <= 1, F.pmod(F.bround(minute, 0), F.lit(K.DAY_MIN)).cast("int"))


def minute_of_week(date, minute) -> Column:
    """Minutes since Monday midnight."""
    return F.weekday(_c(date)) * K.DAY_MIN + _c(minute)


def add_minutes(minute, more) -> Column:
    return F.pmod(_c(minute) + _c(more), F.lit(K.DAY_MIN))


def clock(minute) -> Column:
    """HH:MM of a minute, wrapped at midnight."""
    wrapped = F.pmod(_c(minute), F.lit(K.DAY_MIN))
    return F.concat(
        F.lpad(F.floor(wrapped / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((wrapped % 60).cast("string"), 2, "0")
    )


def is_rain(mm) -> Column:
    return _c(mm) >= K.RAIN_MM


def weather_words(code) -> Column:
    return F.coalesce(F.try_element_at(literal_map(K.WMO), _c(code)), F.lit("sin datos"))


def compass(degrees) -> Column:
    sector = F.floor((F.pmod(_c(degrees), F.lit(360)) + 22.5) / 45) % 8
    return F.element_at(F.array(*[F.lit(w) for w in K.COMPASS]), (sector + 1).cast("int"))


def swell(period_s) -> Column:
    period = _c(period_s)
    return F.when(period >= 13, "marejada de fondo").when(period >= 10, "marejada").otherwise("mar de viento")


def light_share(start, stop, sunset) -> Column:
    """Share of a leg before sunset; null without a sunset."""
    start, stop, sunset = _c(start), _c(stop), _c(sunset)
    return (
        F.when(sunset >= stop, 1.0).when(sunset <= start, 0.0)
        .otherwise(F.try_divide((sunset - start).cast("double"), stop - start))
    )


def hour_runs(hours: Column) -> Column:
    """Runs of consecutive hours of an array, as struct(first, last)."""
    ordered = F.array_sort(F.array_distinct(hours))
    starts = F.filter(ordered, lambda h: ~F.array_contains(ordered, h - 1))
    ends = F.filter(ordered, lambda h: ~F.array_contains(ordered, h + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
