import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from trailgrid.functions.geo import with_estimate
from trailgrid.operators import metrics as M
from trailgrid.plans import build as B
from trailgrid.plans import corpus, revise
from workload.fixtures import Fixtures
from workload.planning import trips

SF = "/root/testdata/sf0.01"


def test_only_touched_days_get_a_new_clock(spark):
    places = spark.createDataFrame(
        [(i, "culture", "museum", 13.7 + i / 200, -89.2, i != 9) for i in range(1, 12)],
        "id long, category string, subcategory string, lat double, lon double, is_active boolean",
    )
    plans = spark.createDataFrame([(1, 480, "driving"), (2, 540, "walking")], "plan_id long, earliest int, mode string")
    rows = [
        (1, 1, 1, 1, None, 999, 1050, 0.0, 0), (1, 1, 2, 2, "lunch", 1060, 1150, 3.3, 7),
        (1, 2, 1, 3, None, 1, 2, 7.7, 7), (1, 2, 2, 9, None, 3, 4, 7.7, 7), (1, 3, 1, 4, None, 5, 6, 8.8, 8),
        (2, 1, 1, 5, None, 7, 8, 9.9, 9),
    ]
    stops = spark.createDataFrame(rows, "plan_id long, day int, ord int, place_id long, meal string, arrival int, departure int, leg_km double, leg_min int")
    edits = spark.createDataFrame(
        [(1, 1, "move", 2, 2), (2, 1, "add", 6, 0), (1, 3, "remove", 9, 0)],
        "plan_id long, day int, op string, place_id long, to_day int",
    )
    got = {(r.plan_id, r.day, r.ord): r for r in revise.rescheduled(stops, edits, places, plans).collect()}
    assert [(k, got[k].place_id, got[k].touched) for k in sorted(got)] == [
        ((1, 1, 1), 1, True), ((1, 2, 1), 3, True), ((1, 2, 2), 2, True), ((1, 3, 1), 4, False), ((2, 1, 1), 5, True), ((2, 1, 2), 6, True),
    ]
    assert tuple(got[1, 3, 1])[2:-1] == rows[4][2:]
    first, meal, added = got[1, 2, 1], got[1, 2, 2], got[2, 1, 2]
    leg = lambda a, b, mode: with_estimate(
        spark.createDataFrame([(13.7 + a / 200, -89.2, 13.7 + b / 200, -89.2)], "a double, b double, c double, d double"), ("a", "b"), ("c", "d"), mode
    ).first()
    assert got[1, 1, 1].arrival == first.arrival == 480 and first.leg_km == 0.0
    assert (meal.leg_km, meal.leg_min) == tuple(leg(3, 2, "driving"))[-2:] and meal.arrival == 690 and meal.departure == 780
    walk = leg(5, 6, "walking")
    assert added.arrival == got[2, 1, 1].departure + walk.minutes and added.leg_km == walk.km


def test_swapped_days_are_planned_anew_and_the_others_frozen(spark):
    fx = Fixtures(spark, SF)
    some = trips(fx).where("plan_id < 9")
    hours = fx.tags.select("id", "opening_hours", "cuisine")
    stops = B.checkpointed(B.plan_trips(some, fx.places, hours))
    visits = stops.where("meal IS NULL")
    swaps = visits.where("plan_id % 2 = 0").groupBy("plan_id", "day").agg(F.min_by("id", "ord").alias("id"))
    swaps = swaps.unionByName(spark.createDataFrame([(1, 1, -5)], "plan_id long, day int, id long"))
    after = B.checkpointed(revise.swap_days(some, stops, swaps, fx.places, hours))
    columns = ["plan_id", "day", "ord", "id", "meal", "arrival", "departure", "leg_km", "leg_min"]
    rows = lambda frame, days: sorted(map(str, frame.where(days).select(columns).collect()))
    assert rows(after, "plan_id % 2 = 1") == rows(stops, "plan_id % 2 = 1") != []
    given = {(r.plan_id, r.id) for r in swaps.collect()}
    kept = [(r.plan_id, r.id) for r in after.collect()]
    assert not given & set(kept) and len(kept) == len(set(kept))
    assert rows(after, "plan_id % 2 = 0") and rows(after, "plan_id % 2 = 0") != rows(stops, "plan_id % 2 = 0")
    dated = lambda frame: {(r.plan_id, r.day): r.date for r in frame.collect()}
    assert dated(after).items() <= dated(stops).items()
    for d in after.groupBy("plan_id", "day").agg(F.sum("leg_km").alias("km"), F.max("departure").alias("stop"), F.first("budget").alias("budget"), F.first("latest").alias("latest")).collect():
        assert d.km <= d.budget + 1e-6 and d.stop <= d.latest


def test_plan_metrics_against_plain_counts(spark):
    kinds = ["culture", "culture", "culture", "nature", "nature"]
    rows = [(p, d, i + 1, "a" if p % 2 else "b", dt.date(2024, 1, d), kinds[(i + p) % 5 if p else 0], "x", 13.5 + i * 0.01 * (d + p), -89.2 + 0.02 * (i % 2), i * 0.125)
            for p in range(3) for d in (1, 2, 8) for i in range(2 + d % 4)]
    stops = spark.createDataFrame(rows, "plan_id long, day int, ord int, zone string, date date, category string, subcategory string, lat double, lon double, leg_km double")
    meals = spark.createDataFrame([(0, 1, "cerrado"), (0, 1, "abierto"), (1, 8, "desconocido")], "plan_id long, day int, state string")
    shares = {(r.plan_id, r.day): r.share for r in M.marginal_cost(stops, ["plan_id", "day"]).collect()}
    got = {(r.zone, r.weekday): r for r in M.plan_metrics(stops, meals).collect()}
    assert len(got) == 2 * 2 + 2 + 2 + 1
    for (zone, weekday), r in got.items():
        days = {}
        for row in rows:
            if zone in (None, row[3]) and weekday in (None, row[4].weekday()):
                days.setdefault(row[:2], []).append(row)
        varied = [len({s[5] for s in v}) for v in days.values() if len(v) >= 3]
        known = [shares[k] for k in days if k in shares]
        assert (r.days, r.stops, r.varied_days, r.measured_days) == (len(days), sum(map(len, days.values())), len(varied), len(known))
        assert r.km == pytest.approx(sum(s[-1] for v in days.values() for s in v)) and r.single_days == varied.count(1)
        assert r.median_share == pytest.approx(statistics.median(known), abs=1e-4) if known else r.median_share is None
        assert r.level == 2 * (zone is None) + (weekday is None)
    total = got[None, None]
    assert (total.meals, total.abierto, total.desconocido, total.cerrado) == (3, 1, 1, 1)


def test_a_week_of_cases(spark):
    rows = corpus.week(spark).withColumn("zone", corpus.zone_of()).collect()
    assert len(rows) == 7 * len(corpus.CASES) == len({r.plan_id for r in rows})
    assert {r.start_date.weekday() for r in rows} == set(range(7)) and all(r.zone for r in rows)
