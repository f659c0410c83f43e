"""The meal fold against a sequential search over every restaurant and every gap."""

import random

import pytest
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions.geo import with_estimate
from trailgrid.operators import sequence as Q
from trailgrid.plans import build as B
from trailgrid.plans import meals as M
from trailgrid.session import checkpointed

TRIP = (
    "plan_id int, days int, earliest int, latest int, max_km double, include_meals boolean, meal_minutes int, cap int, "
    "named array<string>, cuisines map<string,string>"
)
CUISINES = ["pizza", "seafood", "regional"]


def _world(rng, plans):
    """Trips of one to three days with up to four stops, and a dozen restaurants each."""
    trips, stops, food = [], [], []
    for plan in range(plans):
        days = rng.randrange(1, 4)
        named = [m for m in K.MEAL_WINDOWS if rng.random() < 0.4]
        cuisines = {m: rng.choice([*CUISINES, "martian"]) for m in K.MEAL_WINDOWS if rng.random() < 0.3}
        cap = rng.choice([3, 6, 12])
        trips.append((plan, days, rng.choice([330, 390, 480, 540, 640]), rng.choice([900, 1080, 1200, 1320]), rng.choice([15.0, 40.0, 90.0]),
                      rng.random() < 0.85, 90, cap, named, cuisines))
        spot = lambda: (round(13.5 + rng.random() * 0.2, 4), round(-89.3 + rng.random() * 0.2, 4))
        for day in range(1, days + 1):
            for ord_ in range(1, rng.randrange(1, 5) + 1):
                kind = rng.choice(["nature", "culture", "attraction"])
                stops.append((plan, day, ord_, plan * 100 + day * 10 + ord_, f"stop {ord_}", kind, "none", *spot(), rng.choice([60, 90, 150, 240])))
        for n in range(rng.choice([0, 2, 12, 18])):
            open_ = rng.choice([None, None, [(d * 1440 + 660, d * 1440 + 1320) for d in range(7)], [(d * 1440 + 1000, d * 1440 + 1380) for d in range(7)]])
            food.append((plan, 100_000 + plan * 100 + n, f"table {n}", *spot(), rng.choice([None, "pizza;regional", "seafood", "regional"]), open_))
    return trips, stops, food


@pytest.fixture(scope="module")
def world(spark):
    trips, stops, food = _world(random.Random(5), 40)
    wishes = spark.createDataFrame(trips, TRIP)
    limits = wishes.select("plan_id", "earliest", "latest", F.col("max_km").alias("budget"), "cap", "meal_minutes", "include_meals").withColumns(
        {"date": F.expr("DATE '2024-01-03'"), "light": F.lit(K.DUSK_MIN)}
    )
    rows = spark.createDataFrame(
        stops, "plan_id int, day int, ord int, id long, name string, category string, subcategory string, lat double, lon double, dwell int"
    ).join(limits, "plan_id").withColumn("meal", F.lit(None).cast("string"))
    days = checkpointed(Q.schedule(B.with_legs(rows)))
    tables = spark.createDataFrame(
        food, "plan_id int, id long, name string, lat double, lon double, cuisine string, open array<struct<opens:int,closes:int>>"
    )
    return wishes, days, tables, (trips, stops, food)


def _legs(spark, stops, food):
    points = [(s[0], s[3], s[7], s[8]) for s in stops] + [(f[0], f[1], f[3], f[4]) for f in food]
    a = spark.createDataFrame(points, "p int, a long, alat double, alon double")
    b = spark.createDataFrame(points, "q int, b long, blat double, blon double")
    rows = with_estimate(a.join(b, F.expr("p = q")), ("alat", "alon"), ("blat", "blon"))
    return {(r.a, r.b): (r.km, r.minutes) for r in rows.collect()}


class Day:
    """A day worked out step by step."""

    def __init__(self, trip, stops, legs):
        _, _, self.earliest, self.latest, self.budget, self.include, self.meal_minutes, self.cap, self.named, self.cuisines = trip
        self.legs = legs
        self.seq = [(s[3], s[5], s[9], None) for s in stops]

    def clock(self, seq):
        now, out = self.earliest, []
        for i, (place, _, dwell, meal) in enumerate(seq):
            now += self.legs[seq[i - 1][0], place][1] if i else 0
            now = max(now, K.MEAL_WINDOWS[meal][0]) if meal else now
            out.append((now, now + dwell))
            now += dwell
        return out

    def km(self, seq):
        return sum(self.legs[a[0], b[0]][0] for a, b in zip(seq, seq[1:]))

    def leave(self, kind):
        return K.DUSK_MIN if kind in K.OUTDOOR else K.INDOOR_CLOSE_MIN if kind in K.INDOOR else self.latest

    def best(self, tables, meal, patience, budget, midnight=2 * 1440):
        if len(self.seq) >= self.cap or any(s[3] == meal for s in self.seq):
            return None
        opens, closes = K.MEAL_WINDOWS[meal]
        minutes = K.BREAKFAST_MINUTES if meal == "breakfast" else self.meal_minutes
        found, now = [], self.clock(self.seq)
        for table in tables:
            for gap in range(0 if meal == "breakfast" else 1, len(self.seq) + 1):
                tried = [*self.seq[:gap], (table[1], "food", minutes, meal), *self.seq[gap:]]
                natural = now[gap - 1][1] + self.legs[self.seq[gap - 1][0], table[1]][1] if gap else self.earliest
                at = max(natural, opens)
                slack = sum(max(0, min(s[2], self.leave(s[1]) - t[1])) for s, t in zip(self.seq[:gap], now) if s[3] is None)
                if natural > closes:
                    continue
                if natural < opens - patience and not (
                    gap == len(self.seq) and at + minutes <= self.latest and opens - patience - natural <= slack
                ):
                    continue
                open_ = table[6] is not None and any(o <= midnight + at and c >= midnight + at + minutes for o, c in table[6])
                if table[6] is not None and not open_:
                    continue
                if budget and round(self.km(tried), 3) > self.budget:
                    continue
                added = round(self.km(tried) - self.km(self.seq), 3)
                found.append((round(added - (K.MEAL_OPEN_BONUS_KM if open_ else 0), 3), table[1], gap, added, tried))
        return min(found) if found else None

    def reach(self, food, used):
        free = sorted((min(self.legs[s[0], f[1]][0] for s in self.seq), f[1], f) for f in food if f[1] not in used)
        serves = lambda f, c: f[5] is not None and c in f[5].split(";")
        near = [f for _, _, f in free]
        kept = near[:K.MEAL_CANDIDATES]
        for cuisine in set(self.cuisines.values()):
            kept += [f for f in near if serves(f, cuisine)][:K.MEAL_CANDIDATES]
        return [f for n, f in enumerate(kept) if f not in kept[:n]], serves

    def eat(self, food, used=(), budget=True, wishes=True):
        picks, (tables, serves) = [], self.reach(food, used)
        for meal in K.MEAL_WINDOWS:
            if not self.include or meal == "breakfast" and meal not in self.named:
                continue
            left = [f for f in tables if f[1] not in [p[1] for p in picks]]
            liked = [f for f in left if wishes and serves(f, self.cuisines.get(meal))]
            best = self.best(liked or left, meal, K.MEAL_EARLY_MIN, budget)
            if best is None and wishes and meal in self.named:
                best = self.best(liked or left, meal, K.MEAL_RESCUE_MIN, budget)
            if best:
                picks.append((meal, best[1], best[2], best[3]))
                self.seq = best[4]
        return picks


def _days(spark, world):
    wishes, days, tables, (trips, stops, food) = world
    options = B.meal_options(days, tables, wishes)
    legs = _legs(spark, stops, food)
    by_day = {}
    for s in stops:
        by_day.setdefault((s[0], s[1]), []).append(s)
    plain = {k: (Day(trips[k[0]], sorted(v, key=lambda s: s[2]), legs), [f for f in food if f[0] == k[0]]) for k, v in sorted(by_day.items())}
    return options, plain


def _picked(rows):
    return {(r.plan_id, r.day): [(p.meal, p.food_id, p.after, p.added_km) for p in r.picked] for r in rows}


def test_meals_of_a_day_match_a_search_over_all_gaps(spark, world):
    wishes, days, _, _ = world
    options, plain = _days(spark, world)
    eaten = M.eat(M.day_rows(days, options, wishes)).collect()
    expected = {k: d.eat(f) for k, (d, f) in plain.items()}
    assert _picked(eaten) == expected
    assert {m for picks in expected.values() for m, *_ in picks} == set(K.MEAL_WINDOWS)
    for r in eaten:
        day = plain[r.plan_id, r.day][0]
        assert [(s.id, s.meal) for s in r.seq] == [(s[0], s[3]) for s in day.seq]
        assert [(s.arrival, s.departure) for s in r.seq] == day.clock(day.seq)


def test_no_restaurant_twice_in_a_trip(spark, world):
    wishes, days, _, _ = world
    options, plain = _days(spark, world)
    expected, used = {}, {}
    for (plan, day), (d, f) in plain.items():
        picks = d.eat(f, used.setdefault(plan, set()))
        used[plan] |= {p[1] for p in picks}
        expected[plan, day] = picks
    assert _picked(M.eat_in_order(M.day_rows(days, options, wishes)).collect()) == expected


def test_reserve_is_the_cost_of_the_cheapest_insertions(spark, world):
    wishes, days, _, _ = world
    options, plain = _days(spark, world)
    got = {(r.plan_id, r.day): r.reserve_km for r in M.reserve_km(M.day_rows(days, options, wishes)).collect()}
    expected = {}
    for key, (day, food) in plain.items():
        need = round(sum(p[3] for p in day.eat(food, budget=False, wishes=False)), 3)
        expected[key] = 0.0 if need > K.MEAL_KM_SHARE * day.budget else need
    assert got == pytest.approx(expected) and any(expected.values())


def test_offers_for_missing_meals_and_missed_cuisines(spark, world):
    wishes, days, _, _ = world
    options, plain = _days(spark, world)
    eaten = checkpointed(M.eat(M.day_rows(days, options, wishes)))
    got = {(r.plan_id, r.day, r.meal): r.added_km for r in M.missing_offers(eaten).collect()}
    missed = {(r.plan_id, r.day, r.meal) for r in M.cuisine_missed(eaten).collect()}
    expected, unlike = {}, set()
    for (plan, number), (day, food) in plain.items():
        first, serves = day.reach(food, ())
        picks = day.eat(food)
        for meal, table, *_ in picks:
            wanted = day.cuisines.get(meal)
            if wanted and not any(f[1] == table and serves(f, wanted) for f in food):
                unlike.add((plan, number, meal))
        left = [f for f in first if f[1] not in [p[1] for p in picks]]
        for meal in K.MEAL_WINDOWS:
            if not day.include or meal == "breakfast" and meal not in day.named or meal in [p[0] for p in picks]:
                continue
            if best := day.best(left, meal, K.MEAL_EARLY_MIN, False):
                expected[plan, number, meal] = best[3]
    assert got == expected and missed == unlike and missed


def test_days_without_restaurants_or_wishes(spark, world):
    wishes, days, tables, _ = world
    bare = wishes.drop("named", "cuisines")
    none = B.meal_options(days, tables.limit(0), bare)
    rows = M.eat(M.day_rows(days, none, bare)).collect()
    assert rows and all(r.picked == [] for r in rows)
    empty = M.day_rows(days.limit(0), none, wishes)
    assert M.eat(empty).count() == M.eat_in_order(empty).count() == 0
