"""Breakfast, lunch and dinner as one fold over the stops of a day.

A day is one row: its stops in order, the restaurants it may eat at and the meals it is owed. The
fold tries every restaurant in every gap, takes the cheapest, and goes on from the new clock and
kilometres; over a trip it also carries what earlier days used. A day holds at most a dozen stops
and three meals, a trip a few days, so rows stay short; nothing is shuffled between meals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import hours as H
from trailgrid.functions import text as T
from trailgrid.functions.geo import leg_sql, let_sql
from trailgrid.plans import requests as R

DAY = ["plan_id", "day"]
STOP = {
    "id": "bigint", "name": "string", "category": "string", "subcategory": "string", "lat": "double", "lon": "double",
    "dwell": "int", "leg_km": "double", "leg_min": "int", "meal": "string", "opens": "int", "leave": "int",
    "arrival": "int", "departure": "int",
}
PICK = {"meal": "string", "food_id": "bigint", "after": "int", "added_km": "double", "price": "double"}
#: What every stop of a day has in common.
SHARED = ["earliest", "latest", "budget", "cap", "meal_minutes", "include_meals", "date", "light"]


def _type(fields: dict[str, str]) -> str:
    return f"struct<{','.join(f'{name}:{kind}' for name, kind in fields.items())}>"


def _stop(values: dict[str, str], base: str | None = None) -> str:
    """SQL of a stop: ``values`` over the fields of the stop ``base``."""
    fields = ", ".join(f"'{f}', {values.get(f, f'{base}.{f}' if base else 'null')}" for f in STOP)
    return f"cast(named_struct({fields}) AS {_type(STOP)})"


def with_wishes(trips: DataFrame) -> DataFrame:
    """``trips`` with the meals asked for by name and a cuisine per meal; none where it has no such columns."""
    absent = {"named": "array<string>", "cuisines": "map<string,string>"}
    empty = {"named": F.array(), "cuisines": F.create_map()}
    kept = {c: F.coalesce(F.col(c), empty[c].cast(t)) if c in trips.columns else empty[c].cast(t) for c, t in absent.items()}
    return trips.withColumns(kept)


def wanted_cuisines(trips: DataFrame) -> DataFrame:
    """(plan_id, wanted_cuisine) of every trip."""
    return trips.select("plan_id", F.explode(F.map_values("cuisines")).alias("wanted_cuisine")).where(
        F.col("wanted_cuisine").isNotNull()
    ).distinct()


def owed(meals: Column | None = None) -> Column:
    """The meals of a trip in order, as the fold wants them: breakfast only if named.

    ``meals`` restricts them to those of an array of structs with a field ``meal``.
    """
    def one(meal: str) -> Column:
        opens, closes = K.MEAL_WINDOWS[meal]
        minutes = F.lit(K.BREAKFAST_MINUTES) if meal == "breakfast" else F.col("meal_minutes")
        return F.struct(
            F.lit(meal).alias("meal"), F.lit(opens).alias("opens"), F.lit(closes).alias("closes"), minutes.cast("int").alias("minutes"),
            F.array_contains("named", meal).alias("named"), F.try_element_at("cuisines", F.lit(meal)).alias("cuisine"),
        )

    rows = F.array(*[one(m) for m in K.MEAL_WINDOWS])
    due = F.filter(rows, lambda m: F.col("include_meals") & ((m["meal"] != "breakfast") | m["named"]))
    return due if meals is None else F.filter(due, lambda m: F.exists(meals, lambda w: w["meal"] == m["meal"]))


def day_rows(stops: DataFrame, options: DataFrame, trips: DataFrame, meals: Column | None = None) -> DataFrame:
    """One row (plan_id, day, d) per day: its stops, restaurants from near to far, meals owed and limits.

    ``stops`` is scheduled and has the columns of ``SHARED``; ``options`` is (plan_id, day, food_id,
    food_name, flat, flon, near_km) with ``cuisine`` and ``runs`` or ``open`` if known. A day starts at its anchor if
    ``stops`` says ``anchored``.
    """
    opening = F.try_element_at(F.create_map(*[F.lit(v) for m, (o, _) in K.MEAL_WINDOWS.items() for v in (m, o)]), F.col("meal"))
    timed = stops.withColumns({
        "opens": F.when(F.col("meal").isNotNull(), opening),
        "leave": R.leaving_limit(F.col("category"), F.col("light"), F.col("latest")),
    })
    fields = [F.col(f).cast(t).alias(f) for f, t in STOP.items()]
    anchored = F.bool_or("anchored") if "anchored" in stops.columns else F.lit(False)
    days = timed.groupBy(*DAY).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(*fields).alias("stop")))), lambda s: s["stop"]).alias("seq"),
        anchored.alias("anchored"), *[F.first(c).alias(c) for c in SHARED],
    )
    known = options.columns
    table = F.struct(
        F.col("near_km"), F.col("food_id").cast("bigint").alias("food_id"), F.col("food_name"), F.col("flat").alias("lat"), F.col("flon").alias("lon"),
        (T._cuisine_parts("cuisine") if "cuisine" in known else F.lit(None).cast("array<string>")).alias("parts"),
        (F.col("runs") if "runs" in known else H.merge_runs(F.col("open")) if "open" in known
         else F.lit(None).cast("array<struct<opens:int,closes:int>>")).alias("runs"),
    )
    tables = options.groupBy(*DAY).agg(F.sort_array(F.collect_list(table)).alias("options"))
    wishes = with_wishes(trips).select("plan_id", "named", "cuisines")
    whole = days.join(tables, DAY, "left").join(wishes.hint("merge"), "plan_id").withColumns({
        "options": F.coalesce("options", F.expr("array()")),
        "midnight": F.weekday("date") * K.DAY_MIN,
    })
    limits = whole.withColumn("meals", owed(meals)).withColumn("liked", F.array_distinct(F.map_values("cuisines")))
    return limits.select(*DAY, F.struct("day", "seq", "options", "meals", "liked", "anchored", "midnight", *SHARED).alias("d"))


def _within_reach(used: str) -> str:
    """Restaurants a day looks at: the nearest ones no earlier day used, and the nearest of each cuisine asked for."""
    liked = f"flatten(transform(d.liked, c -> slice(filter(f, o -> array_contains(o.parts, c)), 1, {K.MEAL_CANDIDATES})))"
    free = f"filter(d.options, o -> NOT array_contains({used}, o.food_id))"
    return let_sql(free, "f", f"concat(slice(f, 1, {K.MEAL_CANDIDATES}), {liked})")


def _offer(enforce_budget: bool) -> str:
    """SQL of restaurant ``o`` in gap ``p`` of the stops ``s.seq``, with ``l`` its legs to each stop.

    ``late`` is 0 if it fits, 1 if only by the longer patience of a meal asked for by name, else null.
    """
    slack = (
        "aggregate(slice(s.seq, 1, p), 0, (x, v) -> x + if(v.meal IS NULL, greatest(least(v.dwell, v.leave - v.departure), 0), 0))"
    )
    fits = (
        "g.natural <= m.closes AND (m.opens - {t} <= g.natural OR (p = size(s.seq) AND g.at + m.minutes <= d.latest "
        "AND m.opens - {t} - g.natural <= " + slack + "))"
    )
    budget = "AND round(aggregate(s.seq, 0D, (x, v) -> x + v.leg_km) + g.added_km, 3) <= d.budget" if enforce_budget else ""
    late = (
        f"CASE WHEN g.state < 0 OR NOT (true {budget}) THEN null WHEN {fits.format(t=K.MEAL_EARLY_MIN)} THEN 0 "
        f"WHEN m.named AND {fits.format(t=K.MEAL_RESCUE_MIN)} THEN 1 END"
    )
    legs = (
        "named_struct('in_km', coalesce(get(l, p - 1).km, 0D), 'in_min', coalesce(get(l, p - 1).minutes, 0), "
        "'out_km', get(l, p).km, 'out_min', get(l, p).minutes, "
        "'natural', coalesce(get(s.seq, p - 1).departure + get(l, p - 1).minutes, d.earliest))"
    )
    open_ = (
        "CASE WHEN o.runs IS NULL OR d.midnight IS NULL THEN 0 WHEN exists(o.runs, r -> r.opens <= d.midnight + greatest(h.natural, m.opens) "
        "AND r.closes >= d.midnight + greatest(h.natural, m.opens) + m.minutes) THEN 1 ELSE -1 END"
    )
    told = (
        "named_struct('natural', h.natural, 'at', greatest(h.natural, m.opens), 'added_km', "
        f"round(h.in_km + coalesce(h.out_km - get(s.seq, p).leg_km, 0D), 3), 'state', {open_})"
    )
    price = f"round(g.added_km - if(g.state > 0, {K.MEAL_OPEN_BONUS_KM}D, 0D), 3)"
    offer = (
        f"named_struct('late', {late}, 'price', {price}, 'food_id', o.food_id, 'after', p, 'added_km', g.added_km, 'in_km', h.in_km, 'in_min', h.in_min, "
        "'out_km', h.out_km, 'out_min', h.out_min, 'name', o.food_name, 'lat', o.lat, 'lon', o.lon, 'parts', o.parts)"
    )
    return let_sql(legs, "h", let_sql(told, "g", offer))


def _best(enforce_budget: bool) -> str:
    """SQL of the cheapest offer for meal ``m`` among the restaurants ``c``, null if none fits.

    A cuisine asked for rules out the others where any restaurant in reach serves it.
    """
    unused = "filter(c, o -> NOT exists(s.picked, k -> k.food_id = o.food_id))"
    liked = "filter(u, o -> m.cuisine IS NOT NULL AND array_contains(o.parts, m.cuisine))"
    tables = let_sql(unused, "u", let_sql(liked, "w", "if(size(w) > 0, w, u)"))
    gaps = "sequence(if(m.meal = 'breakfast' AND NOT d.anchored, 0, 1), size(s.seq))"
    legs = f"transform(s.seq, v -> {leg_sql('o', 'v')})"
    offers = f"flatten(transform({tables}, o -> {let_sql(legs, 'l', f'transform({gaps}, p -> {_offer(enforce_budget)})')}))"
    return f"if(size(s.seq) >= d.cap OR exists(s.seq, v -> v.meal = m.meal), null, array_min(filter({offers}, x -> x.late IS NOT NULL)))"


def _timed(seq: str) -> str:
    """SQL of the stops with their clock worked out again; a meal waits for its window."""
    stop = _stop({"arrival": "a", "departure": "a + v.dwell"}, "v")
    step = let_sql("greatest(k.clock + v.leg_min, coalesce(v.opens, 0))", "a", f"named_struct('clock', a + v.dwell, 'out', concat(k.out, array({stop})))")
    start = f"named_struct('clock', d.earliest, 'out', cast(array() AS array<{_type(STOP)}>))"
    return f"aggregate({seq}, {start}, (k, v) -> {step}).out"


def _inserted() -> str:
    """SQL of ``s`` after offer ``b`` is taken for meal ``m``."""
    table = _stop({
        "id": "b.food_id", "name": "b.name", "category": "'food'", "subcategory": "'restaurant'", "lat": "b.lat", "lon": "b.lon",
        "dwell": "m.minutes", "leg_km": "b.in_km", "leg_min": "b.in_min", "meal": "m.meal", "opens": "m.opens", "leave": "d.latest",
    })
    following = f"transform(slice(s.seq, b.after + 1, 1), v -> {_stop({'leg_km': 'b.out_km', 'leg_min': 'b.out_min'}, 'v')})"
    seq = f"concat(slice(s.seq, 1, b.after), array({table}), {following}, slice(s.seq, b.after + 2, size(s.seq)))"
    pick = f"cast(named_struct('meal', m.meal, 'food_id', b.food_id, 'after', b.after, 'added_km', b.added_km, 'price', b.price) AS {_type(PICK)})"
    return f"named_struct('seq', {_timed(seq)}, 'picked', concat(s.picked, array({pick})))"


#: SQL of the meals of a day as if none had been asked for by name or cuisine.
PLAIN = (
    "transform(d.meals, m -> named_struct('meal', m.meal, 'opens', m.opens, 'closes', m.closes, 'minutes', m.minutes, "
    "'named', false, 'cuisine', cast(null AS string)))"
)


def _eaten(used: str, enforce_budget: bool, meals: str = "d.meals") -> str:
    """SQL of the struct (seq, picked) of day ``d`` after its meals."""
    start = f"named_struct('seq', d.seq, 'picked', cast(array() AS array<{_type(PICK)}>))"
    step = let_sql(_best(enforce_budget), "b", f"if(b IS NULL, s, {_inserted()})")
    return let_sql(_within_reach(used), "c", f"aggregate({meals}, {start}, (s, m) -> {step})")


def eat(days: DataFrame, *, enforce_budget: bool = True) -> DataFrame:
    """Each day of ``day_rows`` with its meals, apart from the other days: (plan_id, day, d, seq, picked)."""
    eaten = days.withColumn("_e", F.expr(_eaten("cast(array() AS array<bigint>)", enforce_budget)))
    return eaten.select(*DAY, "d", "_e.seq", "_e.picked")


def eat_in_order(days: DataFrame) -> DataFrame:
    """The days of each trip with their meals, first day first; no restaurant twice in a trip."""
    trips = days.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("day", "d"))).alias("days"))
    kind = f"struct<day:int,seq:array<{_type(STOP)}>,picked:array<{_type(PICK)}>>"
    start = f"named_struct('used', cast(array() AS array<bigint>), 'days', cast(array() AS array<{kind}>))"
    one = f"cast(named_struct('day', d.day, 'seq', e.seq, 'picked', e.picked) AS {kind})"
    step = let_sql(_eaten("t.used", True), "e", f"named_struct('used', concat(t.used, transform(e.picked, k -> k.food_id)), 'days', concat(t.days, array({one})))")
    done = trips.select("plan_id", "days", F.expr(f"aggregate(transform(days, y -> y.d), {start}, (t, d) -> {step}).days").alias("done"))
    each = done.select("plan_id", F.explode(F.arrays_zip(F.col("days.d").alias("d"), F.col("done").alias("e"))).alias("z"))
    return each.select("plan_id", "z.e.day", "z.d", "z.e.seq", "z.e.picked")


def stop_rows(eaten: DataFrame, columns: list[str]) -> DataFrame:
    """The stops of days that have eaten, one row each, with ``columns``."""
    rows = eaten.select(*DAY, *[F.col(f"d.{c}").alias(c) for c in SHARED], F.posexplode("seq").alias("_p", "_s"))
    flat = rows.select(*DAY, *SHARED, (F.col("_p") + 1).alias("ord"), "_s.*").drop("opens", "leave")
    return flat.select(*columns)


def reserve_km(days: DataFrame) -> DataFrame:
    """Km each day keeps for its meals: what inserting them costs without a budget.

    Nothing is kept where that is over 30 % of the day's budget: such meals are out of reach.
    """
    eaten = days.withColumn("picked", F.expr(f"{_eaten('cast(array() AS array<bigint>)', False, PLAIN)}.picked"))
    need = F.round(F.aggregate("picked", F.lit(0.0), lambda x, p: x + p["added_km"]), 3)
    return eaten.select(
        *DAY, F.when(need > K.MEAL_KM_SHARE * F.col("d.budget"), 0.0).otherwise(need).alias("reserve_km")
    )


def missing_offers(eaten: DataFrame) -> DataFrame:
    """The cheapest insertion without a budget for each meal that a day went without: (plan_id, day, meal, added_km).

    Each meal is judged alone against the finished day, whatever cuisine was asked for.
    """
    state = "named_struct('seq', seq, 'picked', picked)"
    reach = _within_reach("cast(array() AS array<bigint>)")
    offer = f"named_struct('meal', m.meal, 'best', {_best(False)})"
    offers = let_sql(state, "s", let_sql(reach, "c", f"transform(filter({PLAIN}, m -> NOT exists(picked, k -> k.meal = m.meal)), m -> {offer})"))
    rows = eaten.select(*DAY, F.explode(F.expr(offers)).alias("o"))
    return rows.where(F.col("o.best").isNotNull()).select(*DAY, "o.meal", "o.best.added_km")


def cuisine_missed(eaten: DataFrame) -> DataFrame:
    """Meals served by a restaurant that does not say it serves the cuisine asked for: (plan_id, day, meal)."""
    wished = "element_at(filter(d.meals, m -> m.meal = k.meal), 1).cuisine"
    serves = f"exists(d.options, o -> o.food_id = k.food_id AND coalesce(array_contains(o.parts, {wished}), false))"
    missed = F.expr(f"filter(picked, k -> {wished} IS NOT NULL AND NOT {serves})")
    return eaten.select(*DAY, F.explode(missed).alias("k")).select(*DAY, "k.meal")
