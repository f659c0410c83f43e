"""Changes to finished plans: edited days get a new clock, swapped days are planned anew, the others stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions.geo import with_estimate
from trailgrid.operators import sequence as Q
from trailgrid.plans import build as B
from trailgrid.plans import requests as R
from trailgrid.session import checkpointed

DAY = ["plan_id", "day"]
CLOCK = ["ord", "place_id", "meal", "arrival", "departure", "leg_km", "leg_min"]


def _asked(known: DataFrame) -> DataFrame:
    """The edits of each plan as one array; a plan has few."""
    return known.groupBy("plan_id").agg(F.collect_set(F.struct("day", "op", "place_id", "to_day")).alias("_asked"))


def _touched() -> Column:
    """Whether an edit of the plan names the day, as its own or as the one it moves a place to."""
    day = F.col("day")
    return F.coalesce(F.exists("_asked", lambda e: (e["day"] == day) | ((e["op"] == "move") & (e["to_day"] == day))), F.lit(False))


def _open_days(stops: DataFrame, known: DataFrame) -> DataFrame:
    """``validate.apply_edits`` for the touched days alone: a stop meets the edits of its plan once.

    It stays, goes, or arrives at the end of each day that it is moved to.
    """
    kinds = dict(stops.dtypes)
    mine = lambda e: (e["day"] == F.col("day")) & (e["place_id"] == F.col("place_id"))
    gone = F.coalesce(F.exists("_asked", lambda e: mine(e) & e["op"].isin("remove", "move")), F.lit(False))
    row = lambda day, ord_, moved: F.struct(
        day.cast(kinds["day"]).alias("day"), ord_.cast(kinds["ord"]).alias("ord"), F.lit(moved).alias("_moved"))
    stays = F.filter(F.array(row(F.col("day"), F.col("ord"), False)), lambda _: _touched() & ~gone)
    moves = F.transform(F.filter("_asked", lambda e: mine(e) & (e["op"] == "move")), lambda e: row(e["to_day"], F.lit(1_000), True))
    placed = stops.select(*DAY, "ord", "place_id", "meal").join(_asked(known), "plan_id").select(
        "plan_id", "place_id", "meal", F.explode(F.concat(stays, moves)).alias("_r")
    ).select("plan_id", "_r.*", "place_id", "meal")
    same = Window.partitionBy(*DAY, "place_id", "_moved").orderBy(F.col("meal").asc_nulls_last())
    once = placed.withColumn("_n", F.row_number().over(same)).where("_n = 1 OR NOT _moved").select(*DAY, "ord", "place_id", "meal")
    added = known.where("op = 'add'").select(
        "plan_id", "day", F.lit(1_000).alias("ord"), "place_id", F.lit(None).cast("string").alias("meal")).distinct()
    order = Window.partitionBy(*DAY).orderBy("ord", "place_id")
    return once.unionByName(added).withColumn("ord", F.row_number().over(order))


def rescheduled(stops: DataFrame, edits: DataFrame, places: DataFrame, plans: DataFrame) -> DataFrame:
    """Stops after the edits of ``validate.apply_edits``: touched days with new legs and clock, the rest as stored.

    ``plans`` is (plan_id, earliest, mode). Touched days lose places that left the catalogue, and are
    renumbered; how long a stop lasts is worked out again, as a stop may have changed its meal.
    Edits are worked out and checkpointed once, stops are gone through twice: for the days that stay and for the others.
    """
    active = places.where("is_active").select(F.col("id").alias("place_id"))
    known = checkpointed(edits.join(active, "place_id", "left_semi").select(*DAY, "op", "place_id", "to_day"))
    kept = stops.join(_asked(known), "plan_id", "left").where(~_touched()).select(*DAY, *CLOCK, F.lit(False).alias("touched"))
    found = places.where("is_active").select(F.col("id").alias("place_id"), "category", "subcategory", "lat", "lon")
    linked = _open_days(stops, known).join(found, "place_id").join(plans.select("plan_id", "earliest", "mode"), "plan_id")
    order = Window.partitionBy(*DAY).orderBy("ord")
    linked = linked.withColumns({
        "_plat": F.lag("lat").over(order), "_plon": F.lag("lon").over(order), "_n": F.row_number().over(order),
        "dwell": F.when(F.col("meal") == "breakfast", K.BREAKFAST_MINUTES).when(F.col("meal").isNotNull(), K.MEAL_MINUTES)
        .otherwise(B.dwell(F.col("category"), F.col("subcategory"))),
    })
    legs = with_estimate(linked, ("_plat", "_plon"), ("lat", "lon"), F.col("mode"), "leg_km", "leg_min").withColumns({
        "ord": F.col("_n").cast("int"), "leg_km": F.when(F.col("_n") == 1, 0.0).otherwise(F.col("leg_km")),
        "leg_min": F.when(F.col("_n") == 1, 0).otherwise(F.col("leg_min")),
    })
    return kept.unionByName(Q.schedule(legs).select(*DAY, *CLOCK, F.lit(True).alias("touched")))


def swap_days(trips: DataFrame, stops: DataFrame, swaps: DataFrame, places: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """Finished stops where every day of ``swaps`` (plan_id, day, id) is planned anew without the places given up.

    A swapped day is a trip of one day on its own date; it may use neither what the trip gives up
    nor what its other days visit, so those are frozen and come back as they were. Where a trip swaps
    several days, each is planned after the one before it: as many rounds as a trip has swapped days,
    every round for all trips at once.
    """
    columns = stops.columns
    turns = checkpointed(swaps.join(stops.select(*DAY, "id").hint("merge"), [*DAY, "id"], "left_semi").withColumn(
        "_turn", F.dense_rank().over(Window.partitionBy("plan_id").orderBy("day"))
    ))
    for turn in range(1, (turns.agg(F.max("_turn")).first()[0] or 0) + 1):
        target = turns.where(F.col("_turn") == turn).select(*DAY).distinct().hint("merge")
        frozen = stops.join(target, DAY, "left_anti")
        single = trips.join(target, "plan_id").withColumns({
            "start_date": R.date_of_day(F.col("start_date"), F.col("day")), "days": F.lit(1),
        }).drop("day")
        barred = frozen.select("plan_id", "id").unionByName(turns.select("plan_id", "id")).distinct()
        anew = B.plan_trips(single, places, hours, barred).drop("day").join(target, "plan_id")
        stops = checkpointed(frozen.select(*columns).unionByName(anew.select(*columns)))
    return stops
