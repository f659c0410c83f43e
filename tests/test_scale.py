"""Work that must not grow faster than its input: what a step hands on, not how long it takes."""

from __future__ import annotations

import json
import math
import random
import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import geo as G
from trailgrid.operators import context as X
from trailgrid.operators import dedupe as D
from trailgrid.operators import metrics as M
from trailgrid.operators import range_join as R
from trailgrid.operators import search as S
from trailgrid.operators import sequence as Q
from trailgrid.operators import travel as V
from trailgrid.plans import build as B
from trailgrid.plans import revise
from trailgrid.plans import validate as P
from trailgrid.streaming import limits as L
from workload import fixtures
from workload.registry import QUERIES


def test_trips_of_one_circle_share_a_search(spark, monkeypatch):
    trips = spark.createDataFrame(
        [(n, 13.2, -90.0, 10_000, 0.45, ["nature"] if n == 2 else [], ["beach"] if n != 3 else []) for n in range(1, 6)]
        + [(9, 13.2, -90.0, 10_000, 0.6, [], ["beach"])],
        "plan_id long, alat double, alon double, radius_m int, min_quality double, avoided array<string>, required_subs array<string>",
    )
    places = spark.createDataFrame(
        [(1, "a", "nature", "beach", 13.2, -90.0, 0.5, True), (2, "b", "lodging", "hotel", 13.201, -90.0, 0.5, True),
         (3, "c", "food", "restaurant", 13.202, -90.0, 0.7, True)],
        "id long, name string, category string, subcategory string, lat double, lon double, quality double, is_active boolean",
    )
    searched, search, lodging = [], S.best_per_category, S.beach_lodging
    monkeypatch.setattr(S, "best_per_category", lambda areas, *a, **k: searched.append(areas.count()) or search(areas, *a, **k))
    monkeypatch.setattr(S, "beach_lodging", lambda areas, *a, **k: searched.append(areas.count()) or lodging(areas, *a, **k))
    rows = {(r.plan_id, r.id, r.services, r.beach_side) for r in B.select_candidates(trips, places).collect()}
    assert searched == [2, 2]
    near = {(n, 1, 2, False) for n in (1, 4, 5)} | {(3, 1, 0, False)}
    assert rows == near | {(n, 3, 0, False) for n in (1, 2, 3, 4, 5, 9)} | {(n, 2, 2, True) for n in (1, 2, 4, 5, 9)}


def test_same_site_broadcasts_no_rows_of_the_catalogue(spark):
    rows = [(n, f"Parque Tova{n // 3}" if n % 3 else f"Parque Nacional Tova{n // 3}", 13.0 + n // 3 * 0.02, -90.0, 0.5, True) for n in range(60)]
    places = spark.createDataFrame(rows, "id long, name string, lat double, lon double, quality double, is_active boolean")
    pairs = D.same_site_pairs(places)
    for frame in (pairs, D.same_site_groups(places)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        # what may be broadcast: the one row of the count, and hot keys, which are counted and few
        data = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "LeftOuter" not in line]
        assert not data and "SortMergeJoin" in plan
    assert {tuple(r) for r in pairs.collect()} == {(n + 1, n) for n in range(0, 60, 3)}


def test_trips_and_places_stay_off_the_driver(spark, tmp_path):
    """What a join guesses from small files has a row for each trip or place."""
    def stored(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    circle = "alat double, alon double, radius_m int, min_quality double"
    trips = stored("trips", [(n, 13.2, -90.0, 10_000, 0.4, 2, [], [], [], [], [n, 40]) for n in range(1, 6)],
                   f"plan_id long, {circle}, days int, preferred array<string>, avoided array<string>, required array<string>, required_subs array<string>, requested array<long>")
    places = stored("places", [(n, f"p{n}", "food" if n % 2 else "nature", "restaurant" if n % 2 else "beach", 13.2, -90.0, 0.5, n != 4) for n in range(1, 9)],
                    "id long, name string, category string, subcategory string, lat double, lon double, quality double, is_active boolean")
    tags = stored("tags", [(n, "24/7" if n < 5 else None, "pizza") for n in range(1, 9)], "id long, opening_hours string, cuisine string")
    candidates = stored("candidates", [(n % 5 + 1, n, f"p{n}", "food", "restaurant", 13.2, -90.0, 0.5, 0, False) for n in range(1, 9)],
                        "plan_id long, id long, name string, category string, subcategory string, lat double, lon double, quality double, services int, beach_side boolean")
    scored = B.score(candidates, trips)
    tables = B.tables_of(candidates, tags)
    frames = {"asked": B.asked_places(trips, places), "scored": scored, "tables": tables, "seeds": B.seeds(scored.withColumn("asked", F.lit(None).cast("int")), trips)}
    for name, frame in frames.items():
        plan = frame._jdf.queryExecution().executedPlan().toString()
        # what may be broadcast: the distinct texts of opening hours
        rows = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "opening_hours" not in line]
        assert not rows and "SortMergeJoin" in plan, name
    assert {(r.plan_id, r.id) for r in frames["asked"].collect()} == {(n, n) for n in (1, 2, 3, 5)}
    assert {r.id: bool(r.runs) for r in tables.collect()} == {n: n < 5 for n in range(1, 9)}
    assert tables.columns == ["id", "plan_id", "name", "lat", "lon", "cuisine", "runs"]


def test_trailing_count_steps_once_per_row(spark):
    times = [0, 0, 5, 9_999_999, 10_000_000, 10_000_004, 10_000_005, 19_999_999, 20_000_000, 45_000_000, -1, -3, None, None]
    rows = spark.createDataFrame([(k, t) for k in ("a", None) for t in times], "key string, _at long")
    counted = L.trailing_count(rows, "key", 10, "n")
    brute = lambda t: sum(u is None for u in times) if t is None else sum(u is not None and t - 10_000_000 < u <= t for u in times)
    assert sorted(map(str, counted.collect())) == sorted(str(Row(key=k, _at=t, n=brute(t))) for k in ("a", None) for t in times)
    # a frame that moves at both ends is added up anew for every row
    assert "specifiedwindowframe(RangeFrame, -" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_sums_of_one_circle_are_measured_once_on_a_grid_of_its_width(spark, monkeypatch):
    draw = random.Random(7)
    radii = [150, 700, 2_500, 6_000, 24_000, 40_000]
    probes = [(n, 13.0 + n % 6 * 0.01, -90.0, radii[n % 6]) for n in range(60)]
    points = [(13.0 + draw.random() * 0.3, -90.1 + draw.random() * 0.3) for _ in range(500)]
    met, join = [], R.split_join
    monkeypatch.setattr(R, "split_join", lambda large, small, *a, **k: met.append((small.select("alat", "alon", "radius_m").distinct().count(), small)) or join(large, small, *a, **k))
    counted = R.radius_sums(
        spark.createDataFrame(probes, "id long, alat double, alon double, radius_m int"), spark.createDataFrame(points, "lat double, lon double"),
        "radius_m", {"n": F.lit(1)}, reach_m=25_000,
    )
    far = lambda a, b, c, d: 2 * K.EARTH_RADIUS_KM * 1000 * math.asin(math.sqrt(
        math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2))
    assert {tuple(r) for r in counted.collect()} == {(*p, sum(far(p[1], p[2], *q) <= p[3] for q in points)) for p in probes}
    assert met[0][0] == 6 and met[0][1].groupBy("radius_m").count().agg(F.max("count")).first()[0] < 2_000
    assert met[0][1].where("radius_m = 150").select("_grid").distinct().collect()[0][0] == 4


def _nearest_after(stops, path):
    """Vertices, from 1, by a plain loop."""
    at = []
    for lat, lon in stops[:-1]:
        start = at[-1] - 1 if at else 0
        at.append(min(range(start, len(path)), key=lambda i: ((path[i][0] - lat) ** 2 + (path[i][1] - lon) ** 2, i)) + 1)
    return [*at, len(path)]


def test_stops_are_looked_for_in_whole_batches(spark):
    draw = random.Random(3)
    point = lambda: (draw.randrange(6) / 4, draw.randrange(6) / 4)
    routes = [(n, [point() for _ in range(draw.randrange(5))], [point() for _ in range(draw.randrange(9))]) for n in range(200)]
    rows = spark.createDataFrame(routes, "id int, stops array<struct<lat:double,lon:double>>, path array<struct<lat:double,lon:double>>").coalesce(1)
    cut = V.split_by_stops(rows)
    want = {}
    for n, stops, path in routes:
        if len(stops) >= 2 and len(path) >= 2:
            at = _nearest_after(stops, path)
            want[n] = [path[a - 1:b] if b > a else [] for a, b in zip(at, at[1:])]
    assert {r.id: [[tuple(v) for v in s] for s in r.segments] for r in cut.collect()} == want
    # no lambda steps through the vertices of a route for each of its stops
    assert "sequence(" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_paths_are_dealt_once_however_often_they_are_cut(spark):
    draw = random.Random(5)
    paths = {n: [(draw.randrange(40) / 1000, draw.randrange(40) / 1000) for _ in range(draw.choice([1, 2, 3, 9, 60]))] for n in range(40)}

    def brute(points, lo, hi):
        (ay, ax), (by, bx) = points[lo], points[hi]
        dx, dy, best = bx - ax, by - ay, (0.0, 0)
        for i in range(lo + 1, hi):
            px, py = points[i][1] - ax, points[i][0] - ay
            t = min(max((px * dx + py * dy) / (dx * dx + dy * dy), 0.0), 1.0) if dx or dy else 0.0
            best = max(best, (round(math.hypot(px - t * dx, py - t * dy), 12), -i))
        return brute(points, lo, -best[1]) | brute(points, -best[1], hi) if best[0] > 0.004 else {lo, hi}

    rows = spark.createDataFrame([(k, n, *p) for k, ps in paths.items() for n, p in enumerate(ps)], "k int, position int, lat double, lon double")
    default = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        thin = V.simplify(rows.repartition(3), ["k"], 0.004)
        assert {(r.k, r.position) for r in thin.collect()} == {(k, n) for k, ps in paths.items() for n in brute(ps, 0, len(ps) - 1)}
        plan = thin._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", default)
    # before, every level of cuts dealt all vertices out anew
    assert "MapInArrow" in plan


def test_runs_of_rain_are_found_once_per_date(spark):
    draw = random.Random(11)
    rain = {d: {h for h in range(24) if draw.random() < 0.5} for d in range(1, 5)}
    legs = [(n, d, a, a + draw.choice([-5, 0, 1, 59, 60, 61, 400])) for n, (d, a) in enumerate((draw.randint(1, 5), draw.randrange(1440)) for _ in range(300))]
    want = set()
    for n, d, a, b in legs:
        inside = sorted(h for h in rain.get(d, ()) if h * 60 < b and h * 60 + 60 > a) if b > a else []
        for h in inside:
            if h - 1 not in inside:
                last = next(e for e in range(h, 25) if e + 1 not in inside)
                want.add((n, (max(h * 60, a) - a) / (b - a), (min(last * 60 + 60, b) - a) / (b - a)))
    rows = spark.createDataFrame(legs, "n int, date int, arrival int, departure int")
    hours = spark.createDataFrame([(d, h) for d, hs in rain.items() for h in hs], "date int, hour int")
    wet = X.rain_stretches(rows, hours, [])
    assert {(r.n, r.begins, r.ends) for r in wet.collect()} == want


def test_matrix_answers_measure_a_pair_once(spark):
    plan = QUERIES["src_9"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # once for the answer, once for the operator that judges it; before, the answer took it twice
    assert plan.count("ASIN(") == 2


def test_a_point_meets_only_the_zones_of_its_cell(spark):
    draw = random.Random(13)
    points = [(12.9 + draw.random() * 2, -90.4 + draw.random() * 2.6) for _ in range(3_000)]
    points += [(lat + x, lon + y) for lat, lon, _, _ in K.DETOUR_BY_ZONE for x in (0.0, 0.1) for y in (0.0, -0.1)]
    points += [(None, -89.0), (13.7, None), (float("nan"), -89.2), (91.0, 400.0)]

    def brute(lat, lon):
        if lat is None or lon is None or math.isnan(lat):
            return K.DETOUR_NATIONAL
        far = lambda a, b: math.sin(math.radians(a - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(a)) * math.sin(math.radians(b - lon) / 2) ** 2
        near = [(far(a, b), factor) for a, b, km, factor in K.DETOUR_BY_ZONE if far(a, b) <= math.sin(km / (2 * K.EARTH_RADIUS_KM)) ** 2]
        return min(near)[1] if near else K.DETOUR_NATIONAL

    rows = spark.createDataFrame([(n, *p) for n, p in enumerate(points)], "n int, lat double, lon double")
    factors = rows.withColumn("f", G.detour_factor("lat", "lon"))
    assert {r.n: r.f for r in factors.collect()} == {n: brute(*p) for n, p in enumerate(points)}
    # before, every zone was held against every point
    south, west, height, width, cells = G._zone_cells()
    lists = json.loads(cells)
    assert len(lists) == height * width and max(map(len, lists)) < len(K.DETOUR_BY_ZONE) / 2
    assert "from_json" not in factors._jdf.queryExecution().optimizedPlan().toString()


def _passes(name, spark):
    """How often the plan of a query works out the stops, which are read from lineitem."""
    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")


def test_plan_text_reads_its_stops_once(spark):
    # before, headings and notes each worked the stops out again
    assert _passes("agg_20", spark) == 1
    stops = spark.createDataFrame(
        [(1, 1, 2, 600, "b", None, "food", 1.5, 9), (1, 1, 1, 540, "a", None, "nature", 0.0, 0), (1, 2, 1, 480, "c", "lunch", "food", 0.0, 0)],
        "plan_id long, day int, ord int, arrival int, name string, meal string, category string, leg_km double, leg_min int")
    notes = spark.createDataFrame([(1, 1, "y"), (1, 1, "x"), (2, 1, "z")], "plan_id long, day int, detail string")
    told = {r.plan_id: r.text for r in M.plan_text(stops, notes).collect()}
    assert told == {
        1: "DÍA 1\n  09:00  a (nature)\n  10:00  b (food) · 1.5 km · 9 min\n  * x\n  * y\nDÍA 2\n  08:00  c (lunch)", 2: "  * z",
    }
    counted = {r.plan_id: r.text for r in M.plan_text(stops, F.concat(F.count(F.lit(1)), F.lit(" stops"))).collect()}
    assert counted[1].splitlines()[3] == "  * 2 stops" and counted[1].endswith("  * 1 stops")


def test_checks_read_their_stops_twice_and_metrics_once(spark):
    # before: four times for the checks, nine for the share of plans that meet them, and seven for the metrics
    assert [_passes(name, spark) for name in ("plan_4", "agg_14", "agg_17_metrics")] == [2, 3, 1]


def test_compliance_of_no_plans_and_of_plans_without_failures(spark):
    kinds = ("plan_id long", "plan_id long, day int, check string", "plan_id long")
    measure = lambda plans, failures, stops: {
        r.metric: r.value for r in M.compliance(*(spark.createDataFrame(rows, kind) for rows, kind in zip((plans, failures, stops), kinds))).collect()
    }
    assert measure([], [], []) == {"cases": 0, "met": 0, "met_share": None, "stops": 0}
    failures = [(1, 1, "days"), (1, None, "days"), (2, 1, "include_meals"), (9, 1, "radius")]
    assert measure([(1,), (2,), (3,)], failures, [(1,), (2,)]) == {
        "cases": 3, "met": 2, "met_share": 0.6667, "hard:days": 2, "hard:radius": 1, "soft:include_meals": 1, "stops": 2,
    }


def test_stops_of_plans_are_sorted_twice_and_dealt_in_parts_of_a_size(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "STOPS_PER_PART", 1_000)
    for name in ("win_4", "win_5", "win_7", "plan_6_fast", "agg_11"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        # once to number them, once for the days; before also by kind of meal, and again after plans had joined (these are broadcast here)
        assert len(re.findall(r"\bSort \[", plan)) == 2
        # about 6,000 stops; before, as many parts as the session's shuffles have
        assert len(re.findall(r"Exchange hashpartitioning\(plan_id#\d+L, 7\), REPARTITION_BY_NUM", plan)) == 2
        assert "ENSURE_REQUIREMENTS" not in plan


def test_stops_and_clock_are_those_of_their_views(spark):
    fx = fixtures.Fixtures(spark, "/root/testdata/sf0.001")
    for view in ("stops_fx", "timed_fx"):
        told, asked = getattr(fx, view), fx.sql(fixtures.VIEWS[view])
        assert [(f.name, f.dataType) for f in told.schema] == [(f.name, f.dataType) for f in asked.schema]
        assert told.exceptAll(asked).isEmpty() and asked.exceptAll(told).isEmpty()
    meals = fx.stops_of_plans("latest").join(fx.plans.select("plan_id", F.col("latest").alias("_latest")), "plan_id")
    assert meals.where("latest <> _latest").isEmpty()
    assert meals.select(*fx.meals.columns).exceptAll(fx.meals).isEmpty() and meals.count() == fx.meals.count()


def test_first_meals_of_a_day(spark):
    rows = [(1, 1, 1, "lunch"), (1, 1, 2, None), (1, 1, 3, "dinner"), (1, 1, 4, "lunch"), (1, 1, 5, "dinner"), (1, 2, 1, "lunch"), (2, 1, 9, "breakfast")]
    kept = Q.first_meals(spark.createDataFrame(rows, "plan_id long, day int, ord int, meal string"))
    assert {tuple(r) for r in kept.collect()} == {(*r[:3], None if r[:3] in ((1, 1, 4), (1, 1, 5)) else r[3]) for r in rows}


def test_edited_plans_go_through_their_stops_twice(spark):
    # the edits are checkpointed; before, fourteen passes over lineitem for stops and edits
    assert _passes("plan_7_clock", spark) <= 2


def test_open_days_are_those_of_all_edits(spark):
    draw = random.Random(7)
    stops = [(p, d, o, draw.randint(1, 6), draw.choice([None, "lunch"]))
             for p in range(30) for d in (1, 2, 3) for o in range(1, draw.randint(1, 4))]
    edits = [(draw.randint(0, 31), draw.randint(1, 3), draw.choice(["move", "remove", "add"]), draw.randint(1, 7), draw.randint(1, 4)) for _ in range(90)]
    stops = spark.createDataFrame(stops, "plan_id long, day int, ord int, place_id long, meal string")
    edits = spark.createDataFrame(edits, "plan_id long, day int, op string, place_id long, to_day int")
    places = spark.createDataFrame([(i, True) for i in range(1, 8)], "id long, is_active boolean")
    rows = lambda frame: sorted(map(str, frame.select("plan_id", "day", "ord", "place_id").collect()))
    touched = edits.select("plan_id", "day").union(edits.where("op = 'move'").select("plan_id", "to_day")).distinct()
    asked = P.apply_edits(stops, edits, places).join(touched, ["plan_id", "day"], "left_semi")
    assert rows(revise._open_days(stops, edits)) == rows(asked) != []


def test_violations_go_through_their_stops_once(spark):
    # the stops, the edits and the stops that edits ask for; before, the stops were worked out three times more
    assert _passes("plan_3", spark) <= 3
