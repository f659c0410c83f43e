"""Ordered stops of a day: legs, clock, waiting, return and totals.

A day holds at most a dozen stops and three meals, so a window per (plan, day) is small
whatever the number of plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions.geo import with_estimate

DAY = ["plan_id", "day"]


def _order(keys: list[str], by: str = "ord"):
    return Window.partitionBy(*keys).orderBy(by)


def km_sum(leg_km: str, over=None) -> Column:
    """Kilometres in two decimals, added as whole metres so the order of rows cannot matter."""
    metres = F.sum(F.round(F.col(leg_km) * 1000).cast("long"))
    metres = metres.over(over) if over is not None else metres
    return F.floor((metres + 5) / 10) / 100.0


def day_legs(stops: DataFrame, travel: DataFrame, keys: list[str] = DAY) -> DataFrame:
    """Each stop with the km and minutes from the previous one and the day's route km so far."""
    previous = stops.withColumn("origin", F.lag("place_id").over(_order(keys)))
    joined = previous.join(
        travel.select("origin", F.col("destination").alias("place_id"), "km", "minutes"), ["origin", "place_id"], "left"
    )
    legs = joined.withColumns({"leg_km": F.coalesce("km", F.lit(0.0)), "leg_min": F.coalesce("minutes", F.lit(0))})
    return legs.drop("km", "minutes").withColumn("route_km", km_sum("leg_km", _order(keys)))


def first_meals(stops: DataFrame, keys: list[str] = DAY) -> DataFrame:
    """Stops whose meal is the first of its kind in the day; later ones become visits.

    Kinds are counted along the day, so this needs the order that the clock needs, not one by kind.
    """
    until = _order(keys).rowsBetween(Window.unboundedPreceding, 0)
    first = [F.when((F.col("meal") == m) & (F.count(F.when(F.col("meal") == m, 1)).over(until) == 1), F.lit(m)) for m in K.MEAL_WINDOWS]
    return stops.withColumn("meal", F.coalesce(*first))


def meal_opening(meal: Column) -> Column:
    opens = F.create_map(*[v for m, (o, _) in K.MEAL_WINDOWS.items() for v in (F.lit(m), F.lit(o))])
    return F.when(meal.isNotNull(), F.try_element_at(opens, meal))


def schedule(stops: DataFrame, start: str = "earliest", keys: list[str] = DAY) -> DataFrame:
    """Arrival and departure minutes; a meal waits for its window to open.

    Without waiting a stop starts at S = start + legs so far + earlier visits. Every wait
    moves all that follows, so the delay at a stop is the largest (opening - S) among the meals
    up to it.
    """
    w = _order(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    base = stops.withColumn(
        "_s", F.col(start) + F.sum("leg_min").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("dwell").over(before), F.lit(0))
    )
    late = F.max(meal_opening(F.col("meal")) - F.col("_s")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    arrival = F.col("_s") + F.greatest(F.coalesce(late, F.lit(0)), F.lit(0))
    timed = base.withColumn("arrival", arrival.cast("int"))
    return timed.withColumn("departure", (F.col("arrival") + F.col("dwell")).cast("int")).drop("_s")


def share_waits(stops: DataFrame, limit: str = "leave_by", keys: list[str] = DAY, meals: int = 3) -> DataFrame:
    """Idle time before each meal given to earlier visits, nearest first, up to their limits.

    One pass per meal in order: a visit takes what the visits between it and the meal left
    over, and everything between it and the meal moves by what was taken.
    """
    w = _order(keys)
    whole = Window.partitionBy(*keys)
    after, until, before = (
        w.rowsBetween(1, Window.unboundedFollowing),
        w.rowsBetween(Window.unboundedPreceding, 0),
        w.rowsBetween(Window.unboundedPreceding, -1),
    )
    out = stops.withColumns({
        "_meal_no": F.when(F.col("meal").isNotNull(), F.count("meal").over(until)),
        "_n": F.row_number().over(w),
    })
    for k in range(1, meals + 1):
        is_meal = F.coalesce(F.col("_meal_no") == k, F.lit(False)) & (F.col("_n") > 1)
        idle = F.col("arrival") - F.lag("departure").over(w) - F.col("leg_min")
        out = out.withColumn("_idle", F.when(is_meal, idle)).withColumns({
            "_wait": F.greatest(F.coalesce(F.max("_idle").over(whole), F.lit(0)), F.lit(0)),
            "_at": F.max(F.when(is_meal, F.col("_n"))).over(whole),
        })
        ahead = F.coalesce(F.col("_n") < F.col("_at"), F.lit(False))
        room = F.when(ahead & F.col("meal").isNull(), F.greatest(F.col(limit) - F.col("departure"), F.lit(0))).otherwise(0)
        out = out.withColumn("_room", room)
        closer = F.coalesce(F.sum("_room").over(after), F.lit(0))
        out = out.withColumn("_take", F.least(F.col("_room"), F.greatest(F.col("_wait") - closer, F.lit(0))))
        out = out.withColumns({
            "_shift": F.coalesce(F.sum("_take").over(before), F.lit(0)),
            "_grow": F.sum("_take").over(until),
        }).withColumns({
            "arrival": F.when(ahead, F.col("arrival") + F.col("_shift")).otherwise(F.col("arrival")).cast("int"),
            "departure": F.when(ahead, F.col("departure") + F.col("_grow")).otherwise(F.col("departure")).cast("int"),
        }).drop("_idle", "_wait", "_at", "_room", "_take", "_shift", "_grow")
    return out.drop("_meal_no", "_n")


def with_return(stops: DataFrame, keys: list[str] = DAY, mode="driving") -> DataFrame:
    """The anchor appended as the last stop of the days that return to it.

    ``stops`` holds returns, anchor_id, anchor_lat, anchor_lon; a day that already ends at its
    anchor is left alone.
    """
    columns = [c for c in stops.columns if c not in keys]
    last = stops.groupBy(*keys).agg(F.max_by(F.struct(*columns), "ord").alias("_r")).select(*keys, "_r.*")
    closing = last.where(F.col("returns") & (F.col("place_id") != F.col("anchor_id")))
    timed = with_estimate(closing, ("lat", "lon"), ("anchor_lat", "anchor_lon"), mode, "leg_km", "leg_min")
    back = timed.withColumns({
        "ord": (F.col("ord") + 1).cast("int"), "place_id": F.col("anchor_id"), "lat": F.col("anchor_lat"),
        "lon": F.col("anchor_lon"), "dwell": F.lit(0), "meal": F.lit(None).cast("string"),
    })
    return stops.unionByName(back.select(*stops.columns))


def order_checks(previous: str) -> list[tuple[str, Column]]:
    """(check, condition that fails) of a stop's clock; ``previous`` is when the stop before it ends."""
    return [("chronology", F.col("arrival") > F.col("departure")), ("overlap", F.col("arrival") < F.col(previous))]


def order_failures(stops: DataFrame, keys: list[str] = DAY) -> DataFrame:
    """Stops that end before they start, or start before the previous one ends."""
    previous = F.lag("departure").over(_order(keys))
    checks = F.array(*[F.when(bad, F.lit(name)) for name, bad in order_checks("_previous")])
    named = stops.withColumn("_previous", previous).withColumn("check", F.explode(checks))
    return named.where(F.col("check").isNotNull()).select(*keys, "ord", "place_id", "check")


def day_totals(stops: DataFrame, keys: list[str] = DAY) -> DataFrame:
    """Route km, start, end, duration and stops of each day."""
    return (
        stops.groupBy(*keys).agg(
            km_sum("leg_km").alias("travel_km"), F.min_by("arrival", "ord").alias("start"),
            F.max_by("departure", "ord").alias("stop"), F.count(F.lit(1)).alias("stops"),
        ).withColumn("duration", F.col("stop") - F.col("start"))
    )


def visit_count() -> Column:
    """Stops that are not the anchor, of a group."""
    return F.count_if(F.col("anchor_id").isNull() | (F.col("place_id") != F.col("anchor_id")))


def visits(stops: DataFrame, keys: list[str]) -> DataFrame:
    """Stops that are not the anchor."""
    return stops.groupBy(*keys).agg(visit_count().alias("visits"))


def sweep_order(stops: DataFrame, keys: list[str] = DAY) -> DataFrame:
    """Visit order: the first stop, then the others by angle around the day's middle.

    The turn starts at the first stop's own angle, so the route leaves from it.
    """
    whole = Window.partitionBy(*keys)
    # rounded, so noise on a straight line cannot flip the half turn
    north, east = (F.round(F.col(a) - F.col(b), 9) + 0.0 for a, b in (("lat", "_clat"), ("lon", "_clon")))
    angle = F.atan2(north, east)
    first = F.min("ord").over(whole)
    centred = stops.withColumns({
        "_clat": F.avg("lat").over(whole), "_clon": F.avg("lon").over(whole), "_first": F.col("ord") == first,
    }).withColumn("_angle", F.round(angle, 9))
    start = F.max(F.when(F.col("_first"), F.col("_angle"))).over(whole)
    apart = F.round(F.col("_angle") - F.col("_start"), 6)
    turn = F.when(apart < 0, apart + 6.283185).otherwise(apart)
    ranked = centred.withColumn("_start", start).withColumn("_turn", F.when(F.col("_first"), -1.0).otherwise(turn))
    order = Window.partitionBy(*keys).orderBy("_turn", "place_id", "ord")
    return ranked.withColumn("visit", F.row_number().over(order)).drop("_clat", "_clon", "_first", "_angle", "_start", "_turn")


def route_km(stops: DataFrame, order: str, keys: list[str] = DAY, mode="driving") -> DataFrame:
    """Estimated km of each day's route in a given order."""
    w = Window.partitionBy(*keys).orderBy(order)
    legs = stops.withColumns({"_plat": F.lag("lat").over(w), "_plon": F.lag("lon").over(w)}).where(F.col("_plat").isNotNull())
    km = with_estimate(legs, ("_plat", "_plon"), ("lat", "lon"), mode, "_km", "_min")
    return km.groupBy(*keys).agg(km_sum("_km").alias("km"))


def recent_plans(opened: DataFrame, limit: int = 5) -> DataFrame:
    """The latest distinct codes of each user."""
    last = opened.groupBy("user_id", "code").agg(F.max("ts").alias("ts"))
    order = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "code")
    return last.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
