import datetime as dt
import random

from pyspark.sql import functions as F

from trailgrid.operators import sequence as Q
from trailgrid.operators import travel as V
from trailgrid.streaming import limits as L

OPENS = {"breakfast": 390, "lunch": 690, "dinner": 1080}


def _days(rng, n):
    days = []
    for plan in range(n):
        kinds = [None] * rng.randrange(1, 8)
        for meal in ("breakfast", "lunch", "dinner"):
            if rng.random() < 0.6 and len(kinds) > 1:
                kinds[rng.randrange(len(kinds))] = meal
        stops = []
        for i, meal in enumerate(kinds):
            stops.append((plan, 1, i + 1, i, rng.randrange(10, 120), 0 if i == 0 else rng.randrange(3, 40), meal, 500, rng.choice([700, 1080, 1200, 1300])))
        days.append(stops)
    return days


def _fold(stops):
    now, out = 500, []
    for _, _, _, _, dwell, leg, meal, _, _ in stops:
        now += leg
        if meal:
            now = max(now, OPENS[meal])
        out.append([now, now + dwell])
        now += dwell
    return out


def _share(stops, times):
    times = [list(t) for t in times]
    for i, stop in enumerate(stops):
        if stop[6] is None or i == 0:
            continue
        wait = times[i][0] - times[i - 1][1] - stop[5]
        for j in range(i - 1, -1, -1):
            if wait <= 0:
                break
            if stops[j][6] is not None:
                continue
            take = max(0, min(wait, stops[j][8] - times[j][1]))
            times[j][1] += take
            for k in range(j + 1, i):
                times[k][0] += take
                times[k][1] += take
            wait -= take
    return times


def test_schedule_and_shared_waits_match_a_sequential_fold(spark):
    days = _days(random.Random(2), 200)
    rows = [s for d in days for s in d]
    schema = "plan_id int, day int, ord int, place_id int, dwell int, leg_min int, meal string, earliest int, leave_by int"
    timed = Q.schedule(spark.createDataFrame(rows, schema))
    first = {(r.plan_id, r.ord): (r.arrival, r.departure) for r in timed.collect()}
    shared = {(r.plan_id, r.ord): (r.arrival, r.departure) for r in Q.share_waits(timed).collect()}
    for stops in days:
        times = _fold(stops)
        moved = _share(stops, times)
        for stop, a, b in zip(stops, times, moved):
            assert first[stop[0], stop[2]] == tuple(a)
            assert shared[stop[0], stop[2]] == tuple(b)


def test_limiter_counts_only_accepted_requests(spark):
    rng = random.Random(4)
    rows, at = [], {}
    for i in range(600):
        ip = rng.choice([1, 1, 1, 2, 3])
        at[ip] = at.get(ip, 1_700_000_000.0) + rng.random() * 20
        rows.append((i, ip, at[ip]))
    log = spark.createDataFrame(rows, "event_id long, ip long, at double").select("event_id", "ip", F.col("at").cast("timestamp").alias("ts"))
    limits = ((4, 60), (40, 86_400))
    expected, marks = {}, {}
    for i, ip, now in rows:
        mine = marks.setdefault(ip, [])
        full = any(sum(1 for m in mine if m > now - s) >= n for n, s in limits)
        if not full:
            mine.append(now)
        expected[i] = not full
    found = {r.event_id: r.accepted for r in L.limit_requests(log, limits).collect()}
    assert found == expected
    bound = {r.event_id for r in L.attempts_in_window(log, limits).where("surely_accepted").collect()}
    assert all(expected[i] for i in bound)


def test_path_is_cut_at_the_stops(spark):
    path = [(13.0, -89.0), (13.1, -89.0), (13.2, -89.0), (13.1, -89.0), (13.0, -89.0)]
    stops = [(13.0, -89.0), (13.2, -89.0), (13.0, -89.0)]
    pair = "array<struct<lat:double,lon:double>>"
    rows = spark.createDataFrame([(path, stops), (path[:1], stops)], f"path {pair}, stops {pair}")
    cut = V.split_by_stops(rows).collect()
    assert [len(s) for s in cut[0].segments] == [3, 3] and len(cut) == 1


def test_edge_shorter_than_the_straight_line_is_refused(spark):
    places = spark.createDataFrame([(1, 13.0, -89.0), (2, 13.1, -89.0)], "id long, lat double, lon double")
    edges = spark.createDataFrame(
        [(1, 2, "driving-car", 5.0, 9, "ors"), (2, 1, "driving-car", 14.0, 20, "osrm")],
        "origin long, destination long, profile string, km double, minutes int, source string",
    )
    assert [r.origin for r in V.plausible(edges, places).collect()] == [2]
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "origin long, destination long")
    table = {r.origin: r.source for r in V.travel(pairs, V.purge_implausible(edges, places), places).collect()}
    assert table == {1: "estimated", 2: "osrm"}


def test_bulk_plans_keep_every_hard_limit(spark):
    from trailgrid.plans import build as B
    from workload.fixtures import Fixtures
    from workload.planning import trips

    fx = Fixtures(spark, "/root/testdata/sf0.01")
    some = trips(fx).where("plan_id < 12")
    stops = B.checkpointed(B.plan_trips(some, fx.places, fx.tags.select("id", "opening_hours")))
    days = stops.groupBy("plan_id", "day").agg(
        F.sum("leg_km").alias("km"), F.max("departure").alias("stop"), F.min("arrival").alias("start"),
        F.count(F.lit(1)).alias("n"), F.first("budget").alias("budget"), F.first("latest").alias("latest"),
        F.first("earliest").alias("earliest"), F.first("cap").alias("cap"),
    ).collect()
    assert days
    for d in days:
        assert d.km <= d.budget + 1e-6 and d.stop <= d.latest and d.start >= d.earliest and d.n <= d.cap
    active = fx.places.where("is_active").select("id")
    assert stops.join(active, "id", "left_anti").count() == 0
    assert stops.groupBy("plan_id", "id").count().where("count > 1").count() == 0
    late = Q.order_failures(stops.withColumn("place_id", F.col("id")))
    assert late.count() == 0


def test_stream_limiter_on_unordered_rows(spark, tmp_path):
    """Rows in hashed file order, more of a key than an Arrow chunk holds, in one and in many batches."""
    from trailgrid.streaming import flows as S

    events = spark.range(3000).select(
        F.col("id").alias("event_id"), (F.col("id") % 3).alias("ip"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 7_300_000 + F.pmod(F.xxhash64("id"), F.lit(5_000_000))).alias("ts"),
    )
    events.orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(str(tmp_path / "a" / "log.parquet"))
    log = spark.read.parquet(str(tmp_path / "a" / "log.parquet"))
    limits = ((4, 60), (40, 86_400))
    expected = {r.event_id: (r.accepted, r.retry_after) for r in L.limit_requests(log, limits).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "a" / "log.parquet"))
        got = S.drain(L.limit_stream(stream, limits, "10 seconds"), "limited").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    newest = log.agg(F.max(F.unix_millis("ts"))).first()[0]
    settled = {r.event_id for r in log.where(F.unix_micros("ts") < (newest - 10_000) * 1_000).collect()}
    assert {r.event_id: (r.accepted, r.retry_after) for r in got} == {k: v for k, v in expected.items() if k in settled}


def test_question_is_answered_again_an_hour_after_the_last_answer(spark):
    from trailgrid.streaming import flows as S

    minutes = [0, 30, 59, 60, 61, 119, 121, 300]
    rows = [(n, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m), 13.701, -89.2, dt.date(2025, 1, 1), None) for n, m in enumerate(minutes)]
    asked = spark.createDataFrame(rows, "event_id long, ts timestamp, lat double, lon double, from_day date, to_day date")
    assert sorted(r.event_id for r in S.answered_once(asked).collect()) == [0, 3, 6, 7]


def test_catalogue_load_goes_on_after_a_restart(spark, tmp_path):
    from trailgrid.streaming import flows as S

    landing, store = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()

    def land(name, ids):
        elements = ",".join('{"type":"node","id":%d,"lat":13.7,"lon":-89.2,"tags":{"name":"Lugar %d","tourism":"museum"}}' % (i, i) for i in ids)
        (landing / name).write_text('{"elements":[%s]}' % elements)

    land("a.json", range(10))
    assert S.load_incrementally(spark, str(landing), store, buckets=4).count() == 10
    assert S.load_incrementally(spark, str(landing), store, buckets=4).count() == 10
    land("b.json", range(8, 15))
    assert S.load_incrementally(spark, str(landing), store, buckets=4).count() == 15
    assert S.load_incrementally(spark, str(landing), store, buckets=4).select("osm_id").distinct().count() == 15


def test_share_codes_are_drawn_again_on_a_clash(spark):
    from trailgrid.sources import keyed

    codes = {r.plan_id: r.code for r in keyed.share_codes(spark.range(12).withColumnRenamed("id", "plan_id"), length=1).collect()}
    assert len(codes) == 12 and len(set(codes.values())) == 12


def test_ranks_and_medians_over_many_parts(spark):
    from trailgrid.operators import skew

    rng = random.Random(12)
    rows = [(n, "crowd" if n % 4 else rng.choice(["a", "b", None]), rng.choice([1.5, 2.5, 7.0]) + rng.random()) for n in range(900)]
    frame = spark.createDataFrame(rows, "id long, k string, v double")
    got = {r.id: r.place for r in skew.ranked(frame, ["k"], ["v", "id"], "place", per_part=100).collect()}
    for key in ("crowd", "a", "b", None):
        own = sorted((v, n) for n, k, v in rows if k == key)
        assert [got[n] for _, n in own] == list(range(1, len(own) + 1))
    medians = {r.k: r.m for r in skew.middle(frame, ["k"], "v", ["id"], "m").collect()}
    exact = {r.k: r.m for r in frame.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert medians == exact


def test_opens_survive_a_restart(spark, tmp_path):
    from trailgrid.streaming import flows as S

    folder, store = str(tmp_path / "log"), str(tmp_path / "opens")
    run = lambda: S.fold_by_key(
        spark.readStream.schema("code string").parquet(folder), store, ["code"], lambda batch, _: S.opens(batch), S.fold_opens, buckets=3)
    spark.createDataFrame([("a",), ("a",), ("b",)], "code string").write.parquet(folder)
    assert {(r.code, r.opened) for r in run().collect()} == {("a", 2), ("b", 1)}
    spark.createDataFrame([("b",), ("c",)], "code string").write.mode("append").parquet(folder)
    assert {(r.code, r.opened) for r in run().collect()} == {("a", 2), ("b", 2), ("c", 1)}
    assert {(r.code, r.opened) for r in run().collect()} == {("a", 2), ("b", 2), ("c", 1)}


def test_places_asked_for_open_days_or_cost_less(spark):
    from trailgrid.plans import build as B

    trips = spark.createDataFrame(
        [(1, 2, [7, 99, 5, 7, 3], [], [], ["culture"], [])],
        "plan_id long, days int, requested array<bigint>, preferred array<string>, avoided array<string>, required array<string>, required_subs array<string>",
    )
    places = spark.createDataFrame(
        [(i, f"Place {'x' if i in (1, 3) else i}", "food" if i == 5 else "culture", "museum", 13.7 + i / 100, -89.2, 0.5, True) for i in range(1, 10)],
        "id long, name string, category string, subcategory string, lat double, lon double, quality double, is_active boolean",
    )
    known = places.where("id IN (1, 2, 4, 7)").select(F.lit(1).alias("plan_id"), *places.columns[:-1], F.lit(0).alias("services"), F.lit(False).alias("beach_side"))
    scored = B.with_requested(B.score(known.withColumn("plan_id", F.lit(1).cast("long")), trips), trips, places)
    assert {r.id: r.asked for r in scored.collect()} == {1: None, 2: None, 3: 4, 4: None, 5: 2, 7: 0}
    pool = B.one_of_each(scored)
    assert {r.id for r in pool.collect()} == {2, 3, 4, 5, 7}
    first = B.seeds(pool, trips)
    assert [(r.day, r.id) for r in first.orderBy("day").collect()] == [(1, 7), (2, 5)]
    costs = {r.id: r.fill_cost for r in B.fill_order(pool, first, trips).collect()}
    assert set(costs) == {2, 3, 4} and costs[3] < -100 < 0 < min(costs[2], costs[4])
    stops = spark.createDataFrame([(1, 7), (1, 3)], "plan_id long, id long")
    assert sorted(r.id for r in B.missing_requested(trips, stops).collect()) == [5, 99]
