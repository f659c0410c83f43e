"""Catalogue reports and plan metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions.geo import haversine_km, with_estimate
from trailgrid.operators.components import connected_components
from trailgrid.operators.skew import middle


def catalogue_stats(places: DataFrame) -> DataFrame:
    """Total, active and duplicate rows, and active rows per category, as (measure, rows)."""
    totals = places.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"),
        F.count_if(F.col("rejected_reason") == "duplicado").alias("duplicates"),
    ).unpivot([], ["total", "active", "duplicates"], "measure", "rows")
    kinds = places.where("is_active").groupBy(F.concat(F.lit("category:"), "category").alias("measure")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return totals.unionByName(kinds)


def load_report(places: DataFrame) -> DataFrame:
    """Active rows and mean quality per category, rejected rows per reason."""
    kept = places.where("is_active").groupBy(F.col("category").alias("group")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("quality"), 2).alias("quality")
    )
    lost = places.where(~F.col("is_active")).groupBy(F.coalesce("rejected_reason", F.lit("(sin motivo)")).alias("group")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(None).cast("double").alias("quality")
    )
    return kept.withColumn("section", F.lit("kept")).unionByName(lost.withColumn("section", F.lit("rejected")))


def loss_rates(places: DataFrame) -> DataFrame:
    """Share of rows the quality filter and the duplicate merge take out."""
    merged = F.coalesce(F.col("rejected_reason") == "duplicado", F.lit(False))
    refused = F.col("rejected_reason").isNotNull() & ~merged
    return places.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(F.when(refused, 1.0).otherwise(0.0)), 4).alias("rejected"),
        F.round(F.avg(F.when(merged, 1.0).otherwise(0.0)), 4).alias("merged"),
    )


def coast_outline(places: DataFrame) -> DataFrame:
    """The southernmost latitude per 0.1° of longitude, smoothed over three bands.

    Bands are at most 3 600, so the window without a key runs on a small table.
    """
    bands = (
        places.groupBy(F.round("lon", 1).alias("band")).agg(F.min("lat").alias("south"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= K.COAST_BAND_MIN)
    )
    around = Window.orderBy("band").rowsBetween(-1, 1)
    return bands.select("band", F.round(F.min("south").over(around), 6).alias("south"))


def coast_controls(outline: DataFrame) -> DataFrame:
    """(name, km, coastal, right): known places against an outline, at most 3 600 points in one row."""
    points = outline.agg(F.collect_list(F.struct("band", "south")).alias("_line"))
    known = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"), F.lit(coastal).alias("expected"))
        for name, lat, lon, coastal in K.COAST_CONTROLS
    ])
    far = F.array_min(F.transform("_line", lambda p: haversine_km(F.col("c.lat"), F.col("c.lon"), p["south"], p["band"])))
    measured = points.select("_line", F.explode(known).alias("c")).select("c.name", "c.expected", F.round(far, 3).alias("km"))
    coastal = F.coalesce(F.col("km") <= K.COASTAL_KM, F.lit(False))
    return measured.select("name", "km", coastal.alias("coastal"), (coastal == F.col("expected")).alias("right"))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The upper median per key, from counts per distinct value rather than whole lists."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumns({
        "_upto": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_all": F.sum("_n").over(Window.partitionBy(*keys)),
    })
    return ranked.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


PLANS_PER_PART = 100_000


def compliance(plans: DataFrame, failures: DataFrame, stops: DataFrame) -> DataFrame:
    """Share of plans that meet every hard limit, failures per check and stops, as (metric, value).

    Failures are worked out and dealt once: a plan meets its own in a part that holds about
    ``PLANS_PER_PART`` plans, however many there are. A row without a check stands for the plan itself.
    """
    soft = F.col("check").isin(*K.SOFT_CHECKS)
    cases = plans.select("plan_id", F.lit(None).cast("string").alias("check")).distinct()
    dealt = cases.unionByName(failures.select("plan_id", "check")).repartition(plans.count() // PLANS_PER_PART + 1, "plan_id")
    counted = dealt.groupBy("plan_id", "check").agg(F.count(F.lit(1)).alias("_n"))
    hard = F.col("check").isNotNull() & ~soft
    judged = counted.withColumn("_broken", F.max(F.coalesce(hard, F.lit(False))).over(Window.partitionBy("plan_id")))
    per_check = judged.groupBy("check").agg(F.sum("_n").alias("_n"), F.count_if(~F.col("_broken")).alias("_met"))
    plan = F.col("check").isNull()
    number = lambda c: F.coalesce(F.max(F.when(plan, F.col(c))), F.lit(0)).cast("double")
    named = F.struct(F.concat(F.when(soft, "soft:").otherwise("hard:"), F.col("check")).alias("metric"), F.col("_n").cast("double").alias("value"))
    row = per_check.agg(number("_n").alias("cases"), number("_met").alias("met"), F.collect_list(F.when(~plan, named)).alias("checks"))
    metric = lambda name, value: F.struct(F.lit(name).alias("metric"), value.alias("value"))
    share = F.round(F.try_divide(F.col("met"), F.col("cases")), 4)
    told = F.concat(F.array(metric("cases", F.col("cases")), metric("met", F.col("met")), metric("met_share", share)), F.col("checks"))
    total = stops.agg(F.lit("stops").alias("metric"), F.count(F.lit(1)).cast("double").alias("value"))
    return row.select(F.explode(told).alias("_m")).select("_m.*").unionByName(total)


def _with_margins(stops: DataFrame, keys: list[str], min_stops: int) -> DataFrame:
    """``stops`` with ``into``, the km to each, and ``_saved``, the km its day saves without it; null in shorter days.

    The way out of a stop is the way into the next one, so it is measured once.
    """
    w = Window.partitionBy(*keys).orderBy("ord")
    long = F.col("_stops") >= min_stops
    around = stops.withColumn("_stops", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumns({
        "plat": F.when(long, F.lag("lat").over(w)), "plon": F.when(long, F.lag("lon").over(w)),
        "nlat": F.when(long, F.lead("lat").over(w)), "nlon": F.when(long, F.lead("lon").over(w)),
    })
    legs = with_estimate(around, ("plat", "plon"), ("lat", "lon"), km="into", minutes="_m1")
    legs = with_estimate(legs, ("plat", "plon"), ("nlat", "nlon"), km="skip", minutes="_m2")
    saved = F.col("into") + F.lead("into").over(w) - F.col("skip")
    return legs.withColumn("_saved", saved).drop("plat", "plon", "nlat", "nlon", "skip", "_m1", "_m2")


def _share(total: str, saved: str) -> Column:
    return F.when(F.col(total) > 0, F.round(F.col(saved) / F.col(total), 4))


def marginal_cost(stops: DataFrame, keys: list[str], min_stops: int = 4) -> DataFrame:
    """Per day of four stops or more: the largest share of the route one inner stop costs."""
    legs = _with_margins(stops, keys, min_stops).where(F.col("_stops") >= min_stops)
    return (
        legs.groupBy(*keys).agg(F.sum("into").alias("_total"), F.max("_saved").alias("_dearest"))
        .where(F.col("_total") > 0).select(*keys, _share("_total", "_dearest").alias("share"))
    )


def marginal_summary(shares: DataFrame) -> DataFrame:
    return shares.agg(
        F.count(F.lit(1)).alias("days"), F.round(F.median("share"), 4).alias("median"), F.max("share").alias("worst"),
        F.count_if(F.col("share") >= 0.30).alias("dear_days"),
    )


def variety(stops: DataFrame, keys: list[str], min_stops: int = 3) -> DataFrame:
    """Per day of three stops or more: distinct categories, longest equal run, repeated steps."""
    w = Window.partitionBy(*keys).orderBy("ord")
    turn = stops.withColumns({
        "_same": F.col("category") == F.lag("category").over(w),
        "_same_sub": F.col("subcategory") == F.lag("subcategory").over(w),
    }).withColumn(
        "_run", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    runs = turn.groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("category").alias("c"),
        F.count_if("_same").alias("same"), F.count_if("_same_sub").alias("same_sub"),
    )
    return runs.groupBy(*keys).agg(
        F.sum("n").alias("stops"), F.size(F.array_distinct(F.flatten(F.collect_list("c")))).alias("categories"),
        F.max("n").alias("longest_run"), F.sum("same").alias("same_category"), F.sum("same_sub").alias("same_subcategory"),
    ).where(F.col("stops") >= min_stops)


def variety_summary(days: DataFrame) -> DataFrame:
    """The days of ``variety`` in one row: means, days in a rut, and the shares of steps that repeat."""
    share = lambda n, of: F.round(F.try_divide(n, of), 4)
    steps, measured = F.sum(F.col("stops") - 1), F.count(F.lit(1))
    runs, single = F.count_if(F.col("longest_run") >= 3), F.count_if(F.col("categories") == 1)
    return days.agg(
        measured.alias("days"), F.round(F.avg("categories"), 2).alias("mean_categories"), F.min("categories").alias("fewest"),
        runs.alias("days_with_runs"), share(runs, measured).alias("run_share"),
        single.alias("single_days"), share(single, measured).alias("single_share"),
        share(F.sum("same_category"), steps).alias("category_repeats"), share(F.sum("same_subcategory"), steps).alias("subcategory_repeats"),
    )


def plan_metrics(stops: DataFrame, meals: DataFrame | None = None) -> DataFrame:
    """Finished days measured side by side, by zone and weekday and over either (null), as ``level`` tells.

    ``stops`` holds plan_id, day, ord, zone, date, place and leg_km; ``meals`` is (plan_id, day, state) of their
    meals, or ``stops`` itself holds ``state``, null where a stop is no meal. Days, stops, km, meals by state, variety
    of days of three stops or more, and what the dearest inner stop costs on days of four or more. All facts of a
    day come from one pass over its stops; shares have four digits, so their median counts few distinct values.
    """
    keys = ["plan_id", "day"]
    w = Window.partitionBy(*keys).orderBy("ord")
    fields = [*keys, "ord", "zone", "date", "category", "lat", "lon", "leg_km", *(["state"] if meals is None else [])]
    turn = _with_margins(stops.select(*fields), keys, 4).withColumns({
        "_i": F.row_number().over(w), "_same": F.col("category") == F.lag("category").over(w),
    })
    begun = F.max(F.when(F.col("_same"), None).otherwise(F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    km = F.sum(F.bround(F.col("leg_km") * 1000, 0).cast("long"))
    eaten = [F.count("state").alias("_meals"), *[F.count_if(F.col("state") == s).alias(f"_{s}") for s in K.OPEN_STATES]]
    days = turn.withColumn("_run", F.col("_i") - begun + 1).groupBy(*keys, "zone", F.weekday("date").alias("weekday")).agg(
        F.count(F.lit(1)).alias("_stops"), km.alias("_metres"), F.size(F.collect_set("category")).alias("_kinds"),
        F.max("_run").alias("_longest"), F.sum("into").alias("_total"), F.max("_saved").alias("_dearest"), *(eaten if meals is None else []),
    )
    varied = F.col("_stops") >= 3
    facts = days.withColumns({
        "categories": F.when(varied, F.col("_kinds")), "longest_run": F.when(varied, F.col("_longest")), "share": _share("_total", "_dearest"),
    })
    if meals is not None:
        facts = facts.join(meals.groupBy(*keys).agg(*eaten), keys, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c[1:])
    return facts.cube("zone", "weekday").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("days"), total("_stops"), F.round(F.sum("_metres") / 1000, 3).alias("km"),
        total("_meals"), *[total(f"_{s}") for s in K.OPEN_STATES],
        F.count("categories").alias("varied_days"), F.round(F.avg("categories"), 2).alias("mean_categories"),
        F.count_if(F.col("longest_run") >= 3).alias("days_with_runs"), F.count_if(F.col("categories") == 1).alias("single_days"),
        F.count("share").alias("measured_days"), F.round(F.median("share"), 5).alias("median_share"), F.max("share").alias("worst_share"),
        F.count_if(F.col("share") >= 0.30).alias("dear_days"),
    )


def usage_cost(calls: DataFrame, usd_in: float, usd_out: float) -> DataFrame:
    """Mean units in and out, mean, median and largest total, mean cost and calls per dollar."""
    total = F.col("units_in") + F.col("units_out")
    cost = (F.avg("units_in") * usd_in + F.avg("units_out") * usd_out) / 1_000_000
    halfway = middle(calls.withColumn("_total", total), [], "_total", [], "median_total")
    return calls.agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.avg("units_in"), 3).alias("mean_in"),
        F.round(F.avg("units_out"), 3).alias("mean_out"), F.round(F.avg(total), 3).alias("mean_total"),
        F.max(total).alias("worst"),
        F.round(cost, 9).alias("cost_usd"), F.floor(F.try_divide(F.lit(1.0), cost)).alias("per_dollar"),
    ).join(halfway, F.lit(True), "left")


def pin_spread(stops: DataFrame, keys: list[str], zoom: int = 12, diameter: float = 26.0) -> DataFrame:
    """Pins closer than a diameter on the screen, grouped transitively and fanned on a ring.

    Pins are compared inside one day only, which holds a dozen at most.
    """
    world = 256.0 * 2**zoom
    sine = F.sin(F.radians("lat"))
    pins = stops.withColumns({
        "x": F.round((F.col("lon") + 180) / 360 * world, 3),
        "y": F.round((0.5 - F.log((1 + sine) / (1 - sine)) / (4 * 3.141592653589793)) * world, 3),
        "pin": F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.lpad(F.col("ord").cast("string"), 3, "0")),
    })
    a = pins.select(*keys, F.col("pin").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = pins.select(*keys, F.col("pin").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = a.join(b, keys).where(
        (F.col("a") < F.col("b")) & (F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) < diameter)
    )
    groups = connected_components(near, "a", "b").withColumnRenamed("node", "pin")
    members = pins.join(groups, "pin")
    order = Window.partitionBy("component").orderBy("ord")
    whole = Window.partitionBy("component")
    ring = members.withColumns({
        "n": F.count(F.lit(1)).over(whole), "i": F.row_number().over(order) - 1,
        "cx": F.avg("x").over(whole), "cy": F.avg("y").over(whole),
    })
    pi = 3.141592653589793
    radius = diameter / (2 * F.sin(pi / F.col("n")))
    angle = -pi / 2 + 2 * pi * F.col("i") / F.col("n")
    return ring.select(
        *keys, "ord", F.col("n").cast("int").alias("group_size"),
        F.round(F.col("cx") + radius * F.cos(angle) - F.col("x"), 2).alias("dx"),
        F.round(F.col("cy") + radius * F.sin(angle) - F.col("y"), 2).alias("dy"),
    )


def trip_cards(stops: DataFrame) -> DataFrame:
    """Per plan: days, stops, whole km, date range and the categories of each day."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "category")))
    days = stops.groupBy("plan_id", "day").agg(
        F.count(F.lit(1)).alias("stops"), F.sum("leg_km").alias("km"), F.min("date").alias("date"),
        F.array_join(F.transform(ordered, lambda s: s["category"]), "-").alias("strip"),
    )
    strips = F.array_sort(F.collect_list(F.struct("day", "strip")))
    month = lambda d: F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), F.substring(F.element_at(F.array(*[F.lit(m) for m in K.MONTHS_ES]), F.month(d)), 1, 3))
    first, last = month(F.min("date")), month(F.max("date"))
    return days.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("days"), F.sum("stops").alias("stops"), F.floor(F.round(F.sum("km"), 6) + 0.5).alias("km"),
        F.when(first != last, F.concat(first, F.lit(" – "), last)).otherwise(first).alias("dates"),
        F.array_join(F.transform(strips, lambda s: s["strip"]), "|").alias("strips"),
    )


def plan_text(stops: DataFrame, notes: DataFrame | Column) -> DataFrame:
    """Each plan as one text: a heading per day, its stops and legs, then its notes.

    ``notes`` is (plan_id, day, detail), or a column that adds up a day's stops to its one note. A day's lines
    are gathered in one pass over the stops; only lines and days go on from there.
    """
    keys = ["plan_id", "day"]
    clock = lambda c: F.concat(F.lpad(F.floor(F.col(c) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col(c) % 60).cast("string"), 2, "0"))
    visit = F.concat(F.lit("  "), clock("arrival"), F.lit("  "), F.col("name"), F.lit(" ("), F.coalesce("meal", "category"), F.lit(")"))
    leg = F.when(F.col("leg_km") > 0, F.concat(F.lit(" · "), F.format_number("leg_km", 1), F.lit(" km · "), F.col("leg_min"), F.lit(" min"))).otherwise("")
    note = lambda c: F.concat(F.lit("  * "), c)
    ordered = F.sort_array(F.collect_list(F.struct("ord", F.concat(visit, leg).alias("line"))))
    lines = F.concat(F.array(F.concat(F.lit("DÍA "), F.col("day"))), F.transform(ordered, lambda r: r["line"]))
    if isinstance(notes, Column):
        days = stops.groupBy(*keys).agg(F.concat(lines, F.array(note(notes))).alias("lines"))
    else:
        told = notes.groupBy(*keys).agg(F.sort_array(F.collect_list(note(F.col("detail")))).alias("_notes"))
        none = F.array().cast("array<string>")
        days = stops.groupBy(*keys).agg(lines.alias("lines")).join(told, keys, "full_outer").select(
            *keys, F.concat(F.coalesce("lines", none), F.coalesce("_notes", none)).alias("lines")
        )
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("day", "lines"))), lambda d: d["lines"]))
    return days.groupBy("plan_id").agg(F.array_join(whole, "\n").alias("text"))


def outside_radius(slack_km: float = 0.5) -> Column:
    """True for a stop (lat, lon) beyond radius_m of its plan's centre (alat, alon)."""
    return haversine_km("alat", "alon", "lat", "lon") > F.col("radius_m") / 1000.0 + slack_km
