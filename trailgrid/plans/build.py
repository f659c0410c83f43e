"""Bulk planning: candidates, seeds, fill, order, meals and trim for every trip at once.

Every step is keyed by the trip or its day. A trip never has more than 25 candidates per
category, and a day never more than a dozen stops, so each group stays small however many
trips there are. Long chains are cut by a reliable checkpoint between phases. Where a side of a
join has a row for each trip or place it carries a merge hint: Spark takes the size of the files
for that of the rows, and would send them through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import hours as H
from trailgrid.functions import text as T
from trailgrid.functions.geo import leg_sql, with_estimate
from trailgrid.operators import search as S
from trailgrid.operators import sequence as Q
from trailgrid.operators.skew import split_join
from trailgrid.plans import meals as M
from trailgrid.plans import requests as R
from trailgrid.session import checkpointed

DAY = ["plan_id", "day"]
#: Trips of one circle that a task joins with the winners of its search, about.
TRIPS_PER_PART = 2_000


def free_candidates(candidates: DataFrame, used: DataFrame, excluded: DataFrame, *keys: str) -> DataFrame:
    """Candidates no other day uses and nobody excluded."""
    return candidates.join(used.unionByName(excluded).distinct(), [*keys, "id"], "left_anti")


def without_avoided(candidates: DataFrame) -> DataFrame:
    return candidates.where(~F.array_contains("avoided", F.col("category")))


def split_food(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places to eat, and everything else."""
    return places.where("category = 'food'"), places.where("category <> 'food'")


def select_candidates(trips: DataFrame, places: DataFrame) -> DataFrame:
    """What each trip may visit or eat at: the best of every category, plus beach lodging if a beach is required.

    ``trips`` holds plan_id, alat, alon, radius_m, min_quality, avoided and required_subs. Trips with
    the same circle and quality share one search; its few winners are then dealt out to them.
    """
    circle = ["alat", "alon", "radius_m", "min_quality"]
    wishes = trips.select("plan_id", *circle, "avoided", "required_subs")
    areas = trips.groupBy(*circle).agg(F.min("plan_id").alias("circle"))
    places_of = ["id", "name", "category", "subcategory", "lat", "lon", "quality"]
    columns = ["plan_id", *places_of]
    best = checkpointed(
        S.appeal_floor(S.best_per_category(areas, places, per_category=K.CANDIDATES_PER_CATEGORY, key="circle", both_large=True)).select(*circle, *places_of)
    )
    dealt = lambda trips, found: split_join(trips, found, circle, ["plan_id"], hot_rows=TRIPS_PER_PART, both_large=True)
    kept = checkpointed(without_avoided(dealt(wishes, best)).drop(*circle, "avoided"))
    beach_trips = wishes.where(F.array_contains("required_subs", "beach"))
    beach_areas = areas.join(beach_trips.select(*circle).distinct().hint("merge"), circle, "left_semi")
    by_beach = checkpointed(S.beach_lodging(beach_areas.drop("min_quality"), places, key="circle", both_large=True).select("circle", *places_of, "services"))
    beach = dealt(beach_trips, by_beach.join(areas.hint("merge"), "circle")).select(*columns, "services")
    fresh = beach.join(kept.select("plan_id", "id"), ["plan_id", "id"], "left_anti")
    asked = kept.where(F.array_contains("required_subs", F.col("subcategory"))).select("lat", "lon").distinct()
    rows = kept.join(S.with_services(asked, places), ["lat", "lon"], "left")
    services = F.when(F.array_contains("required_subs", F.col("subcategory")), F.col("services"))
    return rows.select(*columns, F.coalesce(services, F.lit(0)).alias("services"), F.lit(False).alias("beach_side")).unionByName(
        fresh.withColumn("beach_side", F.lit(True))
    )


def score(candidates: DataFrame, trips: DataFrame) -> DataFrame:
    """How well each candidate fits its trip."""
    wishes = trips.select("plan_id", "preferred", "avoided", "required", "required_subs")
    wanted = F.array_contains("required_subs", F.col("subcategory")) | (
        F.col("beach_side") & F.array_contains("required_subs", "beach")
    )
    points = (
        S.appeal_of("subcategory") * 2 + F.col("quality")
        - F.when(T.is_vague_name("name"), K.VAGUE_SCORE).otherwise(0.0)
        + F.when(wanted, 3.0 + F.least(F.col("services"), F.lit(120)) / 120.0).otherwise(0.0)
        + F.when(F.array_contains("preferred", F.col("category")), 0.6).otherwise(0.0)
        - F.when(F.array_contains("avoided", F.col("category")), 2.0).otherwise(0.0)
    )
    return candidates.join(wishes.hint("merge"), "plan_id").withColumn("score", F.round(points, 6))


def asked_places(trips: DataFrame, places: DataFrame) -> DataFrame:
    """The catalogue rows of the places each trip asks for by id (``requested``), with their turn ``asked``.

    A place asked for twice counts once; ids that the catalogue does not hold any more are left out.
    """
    named = trips.select("plan_id", F.posexplode(F.col("requested").cast("array<bigint>")).alias("asked", "id"))
    first = named.groupBy("plan_id", "id").agg(F.min("asked").alias("asked"))
    known = places.where("is_active").select("id", "name", "category", "subcategory", "lat", "lon", "quality")
    return first.join(known.hint("merge"), "id")


def with_requested(scored: DataFrame, trips: DataFrame, places: DataFrame) -> DataFrame:
    """Scored candidates and the places asked for, wherever they lie; ``asked`` is null for the others."""
    if "requested" not in trips.columns:
        return scored.withColumn("asked", F.lit(None).cast("int"))
    asked = checkpointed(asked_places(trips, places))
    marked = scored.join(asked.select("plan_id", "id", "asked"), ["plan_id", "id"], "left")
    fresh = asked.join(scored.select("plan_id", "id"), ["plan_id", "id"], "left_anti")
    return marked.unionByName(score(fresh.withColumns({"services": F.lit(0), "beach_side": F.lit(False)}), trips))


def missing_requested(trips: DataFrame, stops: DataFrame) -> DataFrame:
    """(plan_id, id) of places asked for that no day of the finished plan visits."""
    asked = trips.select("plan_id", F.explode(F.col("requested").cast("array<bigint>")).alias("id")).distinct()
    return asked.join(stops.select("plan_id", "id"), ["plan_id", "id"], "left_anti")


def one_of_each(scored: DataFrame) -> DataFrame:
    """Destinations without repeated names, malls or beach lodgings beyond their cap.

    A place asked for always stays, whatever its category, and takes its name and a turn of its cap.
    """
    asked = F.col("asked").isNotNull()
    best = [F.col("asked").asc_nulls_last(), F.col("score").desc(), F.col("id")]
    key = T.same_site_key("name", F.lit(None))
    named = scored.where((F.col("category") != "food") | asked).withColumn(
        "_n", F.row_number().over(Window.partitionBy("plan_id", key).orderBy(*best))
    ).where((F.col("_n") == 1) | asked)
    for tag, cap in K.SUBCATEGORY_CAP.items():
        group = F.when(F.col("subcategory") == tag, F.lit(tag)).otherwise(F.col("id").cast("string"))
        named = named.withColumn("_n", F.row_number().over(Window.partitionBy("plan_id", group).orderBy(*best))).where((F.col("_n") <= cap) | asked)
    group = F.when(F.col("beach_side"), F.lit("beach")).otherwise(F.col("id").cast("string"))
    capped = named.withColumn("_n", F.row_number().over(Window.partitionBy("plan_id", group).orderBy(*best)))
    return capped.where((F.col("_n") <= K.BEACH_LODGING_CAP) | asked).drop("_n")


def seeds(pool: DataFrame, trips: DataFrame) -> DataFrame:
    """The first stop of each day: the places asked for in their order, the best of each required category, then the best."""
    turn = F.col("asked").asc_nulls_last()
    first_of_kind = F.row_number().over(Window.partitionBy("plan_id", "category").orderBy(turn, F.col("score").desc(), "id"))
    due = F.array_contains("required", F.col("category")) & (F.col("_kind") == 1)
    order = Window.partitionBy("plan_id").orderBy(turn, F.col("_due").desc(), F.col("score").desc(), "id")
    ranked = pool.withColumn("_kind", first_of_kind).withColumn("_due", due).withColumn("day", F.row_number().over(order))
    return ranked.join(trips.select("plan_id", "days").hint("merge"), "plan_id").where(F.col("day") <= F.col("days")).drop("_kind", "_due", "days")


def fill_order(pool: DataFrame, day_seeds: DataFrame, trips: DataFrame) -> DataFrame:
    """Every other destination under its cheapest seed, in the order a day would take them.

    A repeat of a subcategory costs 8 km more each time and a repeat of a category 24, so the
    order of a greedy fill is two nested ranks. A place asked for that opens no day costs 120 km less.
    """
    seed = day_seeds.select(
        "plan_id", "day", F.col("id").alias("seed_id"), F.col("category").alias("seed_category"),
        F.col("subcategory").alias("seed_sub"), F.col("lat").alias("slat"), F.col("lon").alias("slon"),
    )
    rest = pool.where("category <> 'food'").join(day_seeds.select("plan_id", "id"), ["plan_id", "id"], "left_anti")
    met = with_estimate(rest.join(seed, "plan_id"), ("slat", "slon"), ("lat", "lon"), km="_km", minutes="_min")
    closest = Window.partitionBy("plan_id", "id").orderBy("_km", "day")
    near = met.withColumn("_r", F.row_number().over(closest)).where(F.col("_r") == 1)
    covered = day_seeds.groupBy("plan_id").agg(
        F.collect_set("category").alias("_cats"), F.collect_set("subcategory").alias("_subs")
    )
    costed = near.join(covered, "plan_id").withColumn(
        "_base", F.col("_km") + F.when(T.is_vague_name("name"), K.VAGUE_KM).otherwise(0.0)
        - F.when(F.col("asked").isNotNull(), K.REQUESTED_KM).otherwise(0.0)
    )
    by_sub = Window.partitionBy(*DAY, "category", "subcategory").orderBy("_base", "id")
    inner = costed.withColumn("_i", F.row_number().over(by_sub) - 1 + (F.col("seed_sub") == F.col("subcategory")).cast("int"))
    inner = inner.withColumn("_inner", F.round(F.col("_base") + K.SUBCATEGORY_REPEAT_KM * F.col("_i"), 6))
    by_category = Window.partitionBy(*DAY, "category").orderBy("_inner", "id")
    outer = inner.withColumn("_c", F.row_number().over(by_category))
    repeats = F.when(
        F.array_contains("preferred", F.col("category")) | F.array_contains("required", F.col("category")), 0
    ).otherwise(F.col("_c") - 1 + (F.col("seed_category") == F.col("category")).cast("int"))
    owed_kind = (F.col("_c") == 1) & F.array_contains("required", F.col("category")) & ~F.array_contains("_cats", F.col("category"))
    owed_sub = (F.col("_i") == 0) & F.array_contains("required_subs", F.col("subcategory")) & ~F.array_contains("_subs", F.col("subcategory"))
    cost = (
        F.col("_inner") + K.CATEGORY_REPEAT_KM * repeats
        - F.when(owed_kind, K.REQUIRED_KM).otherwise(0.0) - F.when(owed_sub, K.REQUIRED_KM).otherwise(0.0)
    )
    order = Window.partitionBy(*DAY).orderBy("fill_cost", "id")
    return outer.withColumn("fill_cost", F.round(cost, 6)).withColumn("fill", F.row_number().over(order)).select(
        *pool.columns, "day", "fill_cost", "fill"
    )


def expected_windows() -> Column:
    """The meals a day of the trip may hold."""
    return R.meal_windows(F.col("earliest"), F.col("latest"), F.col("include_meals"), F.col("named"))


def meal_reserve(day_seeds: DataFrame, food: DataFrame, trips: DataFrame) -> DataFrame:
    """Km each day keeps for its meals: what inserting them into its tour costs, none when out of reach.

    ``day_seeds`` is the tour, (plan_id, day, id, name, category, subcategory, lat, lon) and ord if a
    day has several stops; days without a restaurant in the area are left out.
    """
    wishes = M.with_wishes(trips)
    limits = wishes.select(
        "plan_id", "earliest", "latest", "meal_minutes", "include_meals", R.stop_cap(F.col("max_stops")).alias("cap"),
        R.km_budget(F.col("max_km"), F.col("mode"), F.col("mode")).alias("budget"),
        F.lit(None).cast("date").alias("date"), F.lit(K.DUSK_MIN).alias("light"), F.lit(None).cast("string").alias("meal"),
    )
    columns = [*DAY, "id", "name", "category", "subcategory", "lat", "lon"]
    tour = day_seeds.select(*columns, F.col("ord") if "ord" in day_seeds.columns else F.lit(1).alias("ord"))
    timed = tour.withColumn("dwell", dwell(F.col("category"), F.col("subcategory"))).join(limits.hint("merge"), "plan_id")
    stops = Q.schedule(with_legs(timed))
    options = meal_candidates(stops, food, M.wanted_cuisines(wishes) if "cuisine" in food.columns else None)
    return M.reserve_km(M.day_rows(stops, options, wishes, expected_windows()))


def dwell(category: Column, subcategory: Column) -> Column:
    none = F.lit(None).cast("map<string,int>")
    return R.dwell_minutes(
        meal=F.lit(None).cast("string"), meal_minutes=F.lit(K.MEAL_MINUTES), is_anchor=F.lit(False), place_minutes=none,
        place=F.lit("0"), category_minutes=none, category=category, subcategory=subcategory,
    ).cast("int")


FILL_TRIES = 15


def _walk() -> str:
    """SQL fold over a day's candidates in fill order: what the day takes, and where it stands after.

    A candidate is taken if the day has a stop, kilometres and minutes left for it from the last
    stop taken; one that does not fit is passed by, until ``FILL_TRIES`` in a row did not.
    """
    leg = f"array({leg_sql('s', 'c')})"
    fits = (
        f"s.misses < {FILL_TRIES} AND size(s.taken) < cap AND round(s.km + l.km, 3) <= budget - coalesce(reserve_km, 0D) "
        "AND s.fin + l.minutes + c.dwell + expected*meal_minutes <= latest"
    )
    took = "named_struct('lat', c.lat, 'lon', c.lon, 'km', s.km + l.km, 'fin', s.fin + l.minutes + c.dwell, 'misses', 0, 'taken', concat(s.taken, array(c.fill)))"
    passed = "named_struct('lat', s.lat, 'lon', s.lon, 'km', s.km, 'fin', s.fin, 'misses', s.misses + 1, 'taken', s.taken)"
    start = "named_struct('lat', chain[0].lat, 'lon', chain[0].lon, 'km', 0D, 'fin', earliest + chain[0].dwell, 'misses', 0, 'taken', array(chain[0].fill))"
    return f"aggregate(slice(chain, 2, size(chain)), {start}, (s, c) -> element_at(transform({leg}, l -> if({fits}, {took}, {passed})), 1)).taken"


def feasible(day_seeds: DataFrame, filled: DataFrame, reserve: DataFrame, trips: DataFrame) -> DataFrame:
    """The stops each day takes, its seed first: a fold over the day's candidates, as ``_walk`` says.

    A trip has at most 25 candidates a category, so a day's array is short.
    """
    columns = ["id", "name", "category", "subcategory", "lat", "lon"]
    rows = day_seeds.select(*DAY, *columns, F.lit(0).alias("fill")).unionByName(filled.select(*DAY, *columns, F.col("fill").cast("int")))
    cap = R.stop_cap(F.col("max_stops"))
    fitting = R.meals_that_fit(F.col("earliest"), F.col("latest"), cap, F.col("include_meals"), F.lit(K.TYPICAL_VISIT_MIN))
    limits = M.with_wishes(trips).select(
        "plan_id", "earliest", "latest", "meal_minutes", F.size(expected_windows()).alias("expected"),
        R.km_budget(F.col("max_km"), F.col("mode"), F.col("mode")).alias("budget"),
        F.greatest(cap - fitting, F.lit(1)).alias("cap"),
    )
    timed = rows.withColumn("dwell", dwell(F.col("category"), F.col("subcategory")))
    days = timed.groupBy(*DAY).agg(F.sort_array(F.collect_list(F.struct("fill", *columns, "dwell"))).alias("chain"))
    walked = days.join(reserve, DAY, "left").join(limits.hint("merge"), "plan_id").withColumn("taken", F.expr(_walk()))
    stops = walked.select(*DAY, "earliest", "latest", "budget", F.posexplode(F.expr("filter(chain, c -> array_contains(taken, c.fill))")).alias("ord", "c"))
    return stops.select(*DAY, *[F.col(f"c.{c}").alias(c) for c in columns], "ord", "c.dwell", "earliest", "latest", "budget")


def visit_order(stops: DataFrame) -> DataFrame:
    """The shorter of the sweep around the day and the fill order, so a day that fits still fits."""
    swept = Q.sweep_order(stops.withColumn("place_id", F.col("id"))).drop("place_id")
    lengths = Q.route_km(swept, "visit").withColumnRenamed("km", "_swept").join(
        Q.route_km(swept, "ord").withColumnRenamed("km", "_filled"), DAY
    )
    chosen = swept.join(lengths, DAY, "left").withColumn(
        "ord", F.when(F.col("_swept") < F.col("_filled"), F.col("visit")).otherwise(F.col("ord") + 1).cast("int")
    )
    return chosen.drop("visit", "_swept", "_filled")


def with_legs(stops: DataFrame) -> DataFrame:
    """Leg km and minutes from the previous stop, and places renumbered from 1."""
    order = Window.partitionBy(*DAY).orderBy("ord", "id")
    linked = stops.drop("leg_km", "leg_min").withColumns({
        "_n": F.row_number().over(order), "_plat": F.lag("lat").over(order), "_plon": F.lag("lon").over(order),
    })
    legs = with_estimate(linked, ("_plat", "_plon"), ("lat", "lon"), km="leg_km", minutes="leg_min")
    return legs.withColumns({
        "ord": F.col("_n").cast("int"), "leg_km": F.coalesce("leg_km", F.lit(0.0)),
        "leg_min": F.when(F.col("_plat").isNull(), 0).otherwise(F.col("leg_min")).cast("int"),
    }).drop("_n", "_plat", "_plon")


def meal_candidates(stops: DataFrame, food: DataFrame, wanted: DataFrame | None = None, limit: int | Column = K.MEAL_CANDIDATES) -> DataFrame:
    """The restaurants nearest to any stop of the day, and the nearest with a wanted cuisine.

    ``wanted`` is (plan_id, cuisine); ``food`` then holds its cuisine tag.
    """
    tables = food.withColumnsRenamed({"id": "food_id", "name": "food_name", "lat": "flat", "lon": "flon"})
    visits = stops.where(F.col("meal").isNull()).select(*DAY, "lat", "lon")
    met = with_estimate(visits.join(tables, "plan_id"), ("lat", "lon"), ("flat", "flon"), km="_km", minutes="_min")
    keep = [c for c in tables.columns if c != "plan_id"]
    nearest = met.groupBy(*DAY, *keep).agg(F.min("_km").alias("near_km"))
    order = Window.partitionBy(*DAY).orderBy("near_km", "food_id")
    closest = nearest.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")
    if wanted is None:
        return closest
    tasty = nearest.join(wanted.hint("merge"), "plan_id").where(T.serves_cuisine("cuisine", F.col("wanted_cuisine")))
    by_taste = Window.partitionBy(*DAY, "wanted_cuisine").orderBy("near_km", "food_id")
    liked = tasty.withColumn("_r", F.row_number().over(by_taste)).where(F.col("_r") <= limit).drop("_r", "wanted_cuisine")
    return closest.unionByName(liked).dropDuplicates([*DAY, "food_id"])


def meal_options(stops: DataFrame, food: DataFrame, trips: DataFrame) -> DataFrame:
    """What each day may eat at: enough of the nearest that earlier days of the trip cannot use them up.

    ``food`` may hold cuisine and open.
    """
    wishes = M.with_wishes(trips)
    reach = F.lit(K.MEAL_CANDIDATES) + len(K.MEAL_WINDOWS) * (F.col("days") - 1)
    tables = food.join(wishes.select("plan_id", reach.alias("reach")).hint("merge"), "plan_id")
    wanted = M.wanted_cuisines(wishes) if "cuisine" in food.columns else None
    return meal_candidates(stops, tables, wanted, F.col("reach")).drop("reach")


def trim(stops: DataFrame) -> DataFrame:
    """Drop visits until each day fits: one in the dark first, else the one that saves most km.

    Every round takes one visit from each day that does not fit yet, so there are at most as many
    rounds as a day has stops, and a round works only on the days that are still changing. Meals
    stay; a day of meals alone is left as it is.
    """
    whole, order = Window.partitionBy(*DAY), Window.partitionBy(*DAY).orderBy("ord")
    worst = Window.partitionBy(*DAY).orderBy(F.col("_dark").desc(), F.col("_saved").desc_nulls_last(), "ord")
    settled = None
    while True:
        marked = stops.withColumns({
            "_plat": F.lag("lat").over(order), "_plon": F.lag("lon").over(order),
            "_nlat": F.lead("lat").over(order), "_nlon": F.lead("lon").over(order), "_nkm": F.lead("leg_km").over(order),
            "_dark": F.col("meal").isNull() & R.too_late(F.col("category"), F.col("arrival"), F.col("dwell"), F.col("light")),
            "_over": (F.round(F.sum("leg_km").over(whole), 3) > F.col("budget")) | (F.max("departure").over(whole) > F.col("latest")),
        })
        skip = with_estimate(marked, ("_plat", "_plon"), ("_nlat", "_nlon"), km="_skip", minutes="_m")
        saved = F.round(F.col("leg_km") + F.coalesce("_nkm", F.lit(0.0)) - F.coalesce("_skip", F.lit(0.0)), 3)
        ranked = skip.withColumn("_saved", F.when(F.col("meal").isNull(), saved)).withColumn("_r", F.row_number().over(worst))
        goes = (F.col("_r") == 1) & F.col("meal").isNull() & (F.col("_dark") | F.col("_over"))
        judged = checkpointed(ranked.withColumn("_goes", goes).withColumn("_open", F.max("_goes").over(whole)).select(*stops.columns, "_goes", "_open"))
        fits = judged.where(~F.col("_open")).select(*stops.columns)
        settled = fits if settled is None else settled.unionByName(fits)
        changing = judged.where("_open AND NOT _goes").select(*stops.columns)
        if changing.isEmpty():
            return settled
        stops = Q.schedule(with_legs(changing))


def tables_of(food: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Restaurants of each trip, with cuisine and ``runs`` of open time where ``known`` (id, opening_hours, cuisine) tells them."""
    tables = food.select("plan_id", "id", "name", "lat", "lon")
    if known is None:
        return tables
    tags = known.select("id", "opening_hours", *[c for c in ("cuisine",) if c in known.columns])
    told = H.with_hours(tags.join(tables.select("id").distinct().hint("merge"), "id", "left_semi"), runs=True).drop("opening_hours", "open")
    return tables.join(told.hint("merge"), "id", "left")


def plan_trips(trips: DataFrame, places: DataFrame, hours: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Finished stops of every trip: candidates, days, meals, clock, trim and shared waits.

    ``hours`` is (id, opening_hours) of the restaurants and their cuisine, if known; ``trips`` may hold
    the meals asked for by name (``named``), a cuisine per meal (``cuisines``) and places asked for
    (``requested``, an array of ids). ``excluded`` is (plan_id, id) of places a trip may not use.
    """
    scored = with_requested(score(select_candidates(trips, places), trips), trips, places)
    if excluded is not None:
        scored = scored.join(excluded.select("plan_id", "id").hint("merge"), ["plan_id", "id"], "left_anti")
    scored = checkpointed(scored)
    food = checkpointed(tables_of(split_food(scored.where("asked IS NULL"))[0], hours))
    pool = one_of_each(scored)
    first = checkpointed(seeds(pool, trips))
    filled = fill_order(pool, first, trips)
    kept = checkpointed(feasible(first, filled, meal_reserve(first, food, trips), trips))
    limits = trips.select(
        "plan_id", "meal_minutes", "include_meals", R.stop_cap(F.col("max_stops")).alias("cap"), "start_date", "alat", "alon"
    )
    dated = visit_order(kept).join(limits.hint("merge"), "plan_id").withColumn("date", R.date_of_day(F.col("start_date"), F.col("day")))
    lit = dated.withColumn("light", R.light_limit(F.col("date"), F.col("alat"), F.col("alon"))).drop("alat", "alon", "start_date")
    stops = checkpointed(Q.schedule(with_legs(lit.withColumn("meal", F.lit(None).cast("string")))))
    done = trim(checkpointed(M.stop_rows(M.eat_in_order(M.day_rows(stops, meal_options(stops, food, trips), trips)), stops.columns)))
    leave = R.leaving_limit(F.col("category"), F.col("light"), F.col("latest"))
    return Q.share_waits(done.withColumn("leave_by", leave)).drop("leave_by")
