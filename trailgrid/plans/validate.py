"""Validation of finished plans: limits, independent checks, advice and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import text as T
from trailgrid.functions import timectx as C
from trailgrid.operators import context as W
from trailgrid.operators import sequence as Q
from trailgrid.operators.metrics import outside_radius


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Every check's rows in one table."""
    return reduce(DataFrame.unionByName, parts)


def violations(plans: DataFrame, stops: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """(plan_id, day, check, value): every hard limit a plan breaks and by how much.

    ``plans`` holds earliest, latest, budget, max_stops, avoided, required, required_subs and
    days_asked; ``missing`` holds requested places no day visits. The stops are added up to days
    and these to plans, in one pass.
    """
    days = stops.groupBy("plan_id", "day").agg(
        Q.km_sum("leg_km").alias("travel_km"), F.min_by("arrival", "ord").alias("start"), F.max_by("departure", "ord").alias("stop"),
        Q.visit_count().alias("visits"), F.collect_list("category").alias("categories"), F.collect_set("subcategory").alias("subcategories"),
    )
    facts = F.struct("day", "travel_km", "start", "stop", "visits", "categories", "subcategories")
    made = days.groupBy("plan_id").agg(F.count("day").alias("_made"), F.collect_list(facts).alias("_days"))
    empty, made_days = F.array().cast("array<string>"), F.coalesce("_made", F.lit(0))

    def broken(check: str, value: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), value.cast("double").alias("value"))

    def of_day(d: Column) -> Column:
        limits = F.array_compact(F.array(
            F.when(d["start"] < F.col("earliest"), broken("earliest_start", F.col("earliest") - d["start"])),
            F.when(d["stop"] > F.col("latest"), broken("latest_end", d["stop"] - F.col("latest"))),
            F.when(d["travel_km"] > F.col("budget"), broken("max_travel_km_per_day", F.round(d["travel_km"] - F.col("budget"), 2))),
            F.when(d["visits"] > F.col("max_stops"), broken("max_stops_per_day", d["visits"] - F.col("max_stops"))),
        ))
        avoided = F.filter(d["categories"], lambda c: F.array_contains("avoided", c))
        failed = F.concat(limits, F.coalesce(F.transform(avoided, lambda _: broken("avoided_categories", F.lit(1))), F.array()))
        return F.transform(failed, lambda f: F.struct(d["day"].cast("int").alias("day"), f["check"].alias("check"), f["value"].alias("value")))

    def lacking(wanted: str, have: str, check: str) -> Column:
        missed = F.array_except(F.coalesce(wanted, empty), F.coalesce(F.flatten(F.transform("_days", lambda d: d[have])), empty))
        return F.transform(missed, lambda _: broken(check, F.lit(1)))

    short = F.array_compact(F.array(F.when(made_days < F.col("days_asked"), broken("days", F.col("days_asked") - made_days))))
    of_plan = F.transform(
        F.concat(short, lacking("required", "categories", "must_include_categories"), lacking("required_subs", "subcategories", "must_include_subcategories")),
        lambda f: F.struct(F.lit(None).cast("int").alias("day"), f["check"].alias("check"), f["value"].alias("value")),
    )
    of_days = F.coalesce(F.flatten(F.transform("_days", of_day)), F.array().cast("array<struct<day:int,check:string,value:double>>"))
    found = plans.join(made, "plan_id", "left").select("plan_id", F.explode(F.concat(of_plan, of_days)).alias("_f")).select("plan_id", "_f.*")
    if missing is None:
        return found
    return found.unionByName(missing.select(
        "plan_id", F.lit(None).cast("int").alias("day"), F.lit("must_include_places").alias("check"), F.lit(1.0).alias("value")
    ))


def invented(stops: DataFrame, places: DataFrame) -> DataFrame:
    """Stops whose place is not in the active catalogue."""
    active = places.where("is_active").select(F.col("id").alias("place_id"))
    return stops.join(active, "place_id", "left_anti")


def repeated(stops: DataFrame) -> DataFrame:
    """Stops at a place an earlier stop of the plan already visited, with the first day."""
    order = Window.partitionBy("plan_id", "place_id").orderBy("day", "ord")
    return (
        stops.withColumns({"_n": F.row_number().over(order), "first_day": F.first("day").over(order)})
        .where(F.col("_n") > 1).drop("_n")
    )


def independent_checks(plans: DataFrame, stops: DataFrame, places: DataFrame) -> DataFrame:
    """(plan_id, day, check): failures worked out again from the finished stops alone.

    Two passes over the stops: one judges each stop, the other adds up days and, from these, plans.
    """
    def failed(checks: list[tuple[str, Column]]) -> Column:
        return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))

    dark = (F.col("category").isin(*K.OUTDOOR) & (F.col("departure") > K.DUSK_MIN)) | (
        F.col("category").isin(*K.INDOOR) & (F.col("arrival") >= K.INDOOR_CLOSE_MIN)
    )
    before, order = Window.partitionBy("plan_id", "place_id").orderBy("day", "ord"), Window.partitionBy("plan_id", "day").orderBy("ord")
    known = places.where("is_active").select(F.col("id").alias("place_id"), F.lit(True).alias("_known"))
    asked = plans.select("plan_id", "avoided", "alat", "alon", "radius_m", F.lit(True).alias("_asked"))
    columns = ["plan_id", "day", "ord", "place_id", "category", "lat", "lon", "meal", "arrival", "departure"]
    seen = stops.select(*columns).withColumns({"_n": F.row_number().over(before), "_previous": F.lag("departure").over(order)})
    of_stop = failed([
        ("repeated_place", F.col("_asked") & (F.col("_n") > 1)),
        ("invented_place", F.col("_asked") & F.col("_known").isNull()),
        ("fuera_de_hora", F.col("_asked") & F.col("meal").isNull() & dark),
        ("avoided_categories", F.col("_asked") & F.array_contains("avoided", F.col("category"))),
        ("radius", F.col("_asked") & outside_radius()),
        *Q.order_checks("_previous"),
    ])
    judged = seen.join(asked, "plan_id", "left").join(known, "place_id", "left")

    days = stops.groupBy("plan_id", "day").agg(
        Q.km_sum("leg_km").alias("km"), F.min_by("arrival", "ord").alias("start"),
        F.max_by("departure", "ord").alias("stop"), F.count(F.lit(1)).alias("stops"),
        F.collect_set("meal").alias("meals"),
    )
    made = days.groupBy("plan_id").agg(F.count("day").alias("made"), F.collect_list(F.struct("day", "km", "start", "stop", "stops", "meals")).alias("_days"))
    (l_open, l_close), (d_open, _) = K.MEAL_WINDOWS["lunch"], K.MEAL_WINDOWS["dinner"]

    def of_day(d: Column) -> Column:
        no_lunch = (d["start"] <= l_close) & (d["stop"] >= l_open) & ~F.array_contains(d["meals"], "lunch")
        no_dinner = (d["stop"] >= d_open) & ~F.array_contains(d["meals"], "dinner")
        checks = failed([
            ("earliest_start", d["start"] < F.col("earliest")),
            ("latest_end", d["stop"] > F.col("latest")),
            ("max_stops_per_day", d["stops"] > F.col("max_stops")),
            ("max_travel_km_per_day", d["km"] > F.col("max_km") + 0.01),
            ("include_meals", F.col("include_meals") & no_lunch),
            ("include_meals", F.col("include_meals") & no_dinner),
        ])
        return F.transform(checks, lambda c: F.struct(d["day"].cast("int").alias("day"), c.alias("check")))

    short = F.transform(
        failed([("days", F.coalesce("made", F.lit(0)) < F.col("days_asked"))]),
        lambda c: F.struct(F.lit(None).cast("int").alias("day"), c.alias("check")),
    )
    of_plan = F.concat(short, F.coalesce(F.flatten(F.transform("_days", of_day)), F.array().cast("array<struct<day:int,check:string>>")))
    return union_all([
        judged.select("plan_id", F.col("day").cast("int").alias("day"), F.explode(of_stop).alias("check")),
        plans.join(made, "plan_id", "left").select("plan_id", F.explode(of_plan).alias("_f")).select("plan_id", "_f.*"),
    ])


def rain_advice(wet: DataFrame) -> DataFrame:
    """One row per day with its wet outdoor stops and the merged rainy hours in words."""
    rainy = wet.where("wet")
    days = rainy.groupBy("plan_id", "day").agg(
        F.array_sort(F.collect_list(F.struct("ord", "place_id", "name"))).alias("_s"),
        F.flatten(F.collect_list("rain_hours")).alias("_h"),
    )
    first = F.filter("_s", lambda s: ~F.exists("_s", lambda t: (t["place_id"] == s["place_id"]) & (t["ord"] < s["ord"])))
    names = days.withColumn("_names", F.transform(first, lambda s: T.display_name(s["name"])))
    return names.select(
        "plan_id", "day", F.size("_names").alias("places"), T.list_phrase(F.col("_names")).alias("named"),
        T.hour_phrases(C.hour_runs(F.col("_h"))).alias("hours"),
    )


def meal_advice(days: DataFrame, offers: DataFrame, unlike: DataFrame | None = None) -> DataFrame:
    """Why each missing meal is missing, and which served ones are not of the cuisine asked for.

    ``days`` holds start, stop, km, budget, visits, cap, named (meals asked for), meals
    (meals served) and food_nearby; ``offers`` the cheapest insertion without a budget per
    (plan_id, day, meal), with ``added_km``; ``unlike`` the meals (plan_id, day, meal) whose
    restaurant does not say it serves what was asked for.
    """
    asked = F.array(*[
        F.struct(F.lit(m).alias("meal"), F.lit(o).alias("opens"), F.lit(c).alias("closes"))
        for m, (o, c) in K.MEAL_WINDOWS.items()
    ])
    rows = days.withColumn("_m", F.explode(asked)).select("*", "_m.meal", "_m.opens", "_m.closes").drop("_m")
    named = F.array_contains("named", F.col("meal"))
    wanted = rows.where(~F.array_contains("meals", F.col("meal")) & ((F.col("meal") != "breakfast") | named))
    reached = (F.col("start") <= F.col("closes")) & (F.col("stop") >= F.col("opens"))
    offered = wanted.join(offers.select("plan_id", "day", "meal", "added_km"), ["plan_id", "day", "meal"], "left")
    cause = (
        F.when(~reached & named, "out_of_reach")
        .when(~reached, F.lit(None))
        .when(F.col("food_nearby") == 0, "no_food")
        .when(F.col("visits") >= F.col("cap"), "no_stop_left")
        .when(F.col("added_km").isNull(), "none_in_window")
        .otherwise("over_budget")
    )
    missing = (
        offered.withColumn("cause", cause).where(F.col("cause").isNotNull())
        .withColumn("km_needed", F.when(F.col("cause") == "over_budget", F.round(F.col("km") + F.col("added_km"), 1)))
        .select("plan_id", "day", "meal", "cause", "km_needed")
    )
    if unlike is None:
        return missing
    return missing.unionByName(unlike.select(
        "plan_id", "day", "meal", F.lit("cuisine_not_found").alias("cause"), F.lit(None).cast("double").alias("km_needed")
    ))


def long_fasts(stops: DataFrame) -> DataFrame:
    """Days whose first meal comes five hours or more after the start and is not breakfast."""
    days = stops.groupBy("plan_id", "day").agg(
        F.min_by("arrival", "ord").alias("start"), F.min(F.when(F.col("meal").isNotNull(), F.struct("ord", "arrival"))).alias("_m"),
        F.count_if(F.col("meal") == "breakfast").alias("_b"),
    )
    fast = F.col("_m.arrival") - F.col("start")
    return days.where(
        (F.col("_b") == 0) & (F.col("start") <= K.MEAL_WINDOWS["breakfast"][1]) & (fast >= K.LONG_FAST_MIN)
    ).select("plan_id", "day", fast.alias("fast"))


def plan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Places that entered, left or changed day between two versions of each plan."""
    old = before.groupBy("plan_id", "place_id").agg(F.min("day").alias("old_day"))
    new = after.groupBy("plan_id", "place_id").agg(F.min("day").alias("new_day"))
    change = (
        F.when(F.col("old_day").isNull(), "entered").when(F.col("new_day").isNull(), "left")
        .when(F.col("old_day") != F.col("new_day"), "moved")
    )
    return old.join(new, ["plan_id", "place_id"], "full_outer").withColumn("change", change).where("change IS NOT NULL")


def apply_edits(stops: DataFrame, edits: DataFrame, places: DataFrame) -> DataFrame:
    """Stops after remove, move and add edits; moves and adds go to the end of their day.

    ``edits`` is (plan_id, day, op, place_id, to_day). Places that are not in the catalogue
    any more are not edited; untouched days keep their stops as they were.
    """
    active = places.where("is_active").select(F.col("id").alias("place_id"))
    known = edits.join(active, "place_id", "left_semi")
    gone = known.where(F.col("op").isin("remove", "move")).select("plan_id", "day", "place_id").distinct()
    kept = stops.select("plan_id", "day", "ord", "place_id", "meal").join(gone, ["plan_id", "day", "place_id"], "left_anti")
    moved = (
        known.where("op = 'move'").join(stops.select("plan_id", "day", "place_id", "meal"), ["plan_id", "day", "place_id"])
        .groupBy("plan_id", F.col("to_day").alias("day"), "place_id").agg(F.min("meal").alias("meal"))
    )
    added = known.where("op = 'add'").select("plan_id", "day", "place_id", F.lit(None).cast("string").alias("meal")).distinct()
    arrivals = moved.unionByName(added).withColumn("ord", F.lit(1_000))
    order = Window.partitionBy("plan_id", "day").orderBy("ord", "place_id")
    return kept.unionByName(arrivals).withColumn("ord", F.row_number().over(order))


def missing_ids(edits: DataFrame, places: DataFrame) -> DataFrame:
    active = places.where("is_active").select(F.col("id").alias("place_id"))
    return edits.select("plan_id", "place_id").distinct().join(active, "place_id", "left_anti")


def output_stops(stops: DataFrame, tags: DataFrame) -> DataFrame:
    """Stop rows as they are shown: clock, display name, cuisine, elevation, contact and rain.

    ``stops`` holds ``wet``, as ``wet_stops`` gives it.
    """
    joined = stops.join(tags.withColumnRenamed("id", "place_id").drop("name"), "place_id", "left")
    return joined.select(
        "plan_id", "day", "ord", "place_id", T.display_name("name").alias("shown"), "category", "subcategory",
        C.clock("arrival").alias("arrives"), C.clock("departure").alias("leaves"), "leg_min", "leg_km", "meal",
        T.cuisine_label("cuisine").alias("cuisine"), T.elevation_m("ele").alias("elevation_m"),
        T.contact("phone", "contact_phone", phone=True).alias("phone"),
        T.contact("website", F.lit(None).cast("string"), phone=False).alias("website"), F.col("wet").alias("rained_on"),
    )


def output_days(stops: DataFrame, days: DataFrame, weather: DataFrame, sea: DataFrame, today: Column) -> DataFrame:
    """Day rows as they are shown: clock, km, visits, sunset, and weather and sea or why there is none.

    ``days`` holds plan_id, day, start_date, date, cell, alat, alon and coastal.
    """
    totals = Q.day_totals(stops).join(Q.visits(stops, ["plan_id", "day"]), ["plan_id", "day"])
    dated = W.forecast_for(totals.join(days, ["plan_id", "day"]), weather, ["cell"], today).withColumnRenamed("reason", "no_weather")
    summed = W.day_weather(dated).select("plan_id", "day", "temp_max", "temp_min", F.round("rain_mm", 1).alias("rain_mm"), "words")
    at_sea = W.sea_for(days, sea, ["cell"], today).select("plan_id", "day", F.col("reason").alias("no_sea"), "wave_m")
    return dated.join(summed, ["plan_id", "day"], "left").join(at_sea, ["plan_id", "day"]).select(
        "plan_id", "day", "date", C.clock("start").alias("starts"), C.clock("stop").alias("ends"), "travel_km", "visits",
        C.clock(C.sunset_minute("date", "alat", "alon")).alias("sunset"),
        "no_weather", "temp_max", "temp_min", "rain_mm", "words", "no_sea", "wave_m",
    )
