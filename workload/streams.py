"""Streams over the given tables, each with a batch twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailgrid.session import run_folder
from trailgrid.streaming import flows as S
from trailgrid.streaming import limits as L
from trailgrid.streaming import rollup as R
from workload.base import query
from workload.landing import elements, land_batches


def events(fx):
    rows = S.read_table_stream(fx.spark, fx.folder, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("str_1")
def str_1(fx):
    return L.limit_requests(fx.requests)


@query("str_1_stream")
def str_1_stream(fx):
    log = events(fx).select("event_id", F.col("user_id").alias("ip"), "ts")
    return S.drain(L.limit_stream(log), "limiter")


MICROS = "epoch_us(ts)"


@query("str_1_bound", f"""
SELECT event_id, count(*) OVER a AS last_60, count(*) OVER b AS last_86400, count(*) OVER a <= 4 AND count(*) OVER b <= 40 AS surely_accepted FROM requests_fx
WINDOW a AS (PARTITION BY ip ORDER BY {MICROS} RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), b AS (PARTITION BY ip ORDER BY {MICROS} RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""")
def str_1_bound(fx):
    return L.attempts_in_window(fx.requests).drop("ip", "ts")


CALLS = "SELECT event_id, event_type AS endpoint, ts, CASE WHEN event_id % 9 = 4 THEN CAST(100 + event_id % 50 AS BIGINT) ELSE NULL END AS server_remaining FROM events"


@query("str_2", f"""
WITH c AS ({CALLS}), n AS (SELECT *, greatest(60 - count(*) OVER (PARTITION BY endpoint ORDER BY {MICROS} RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), 0) AS own_remaining, row_number() OVER (PARTITION BY endpoint ORDER BY ts, event_id) AS n FROM c),
r AS (SELECT *, last_value(CASE WHEN server_remaining IS NOT NULL THEN n END IGNORE NULLS) OVER u AS rn, last_value(server_remaining IGNORE NULLS) OVER u AS rs FROM n WINDOW u AS (PARTITION BY endpoint ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, endpoint, own_remaining, CASE WHEN rn IS NOT NULL THEN least(own_remaining, greatest(rs - (n - rn), 0)) END AS remaining FROM r""")
def str_2(fx):
    calls = fx.sql(CALLS.replace("FROM events", "FROM {events}"))
    return L.quota_ledger(calls, 60).select("event_id", "endpoint", "own_remaining", "remaining")


ASKED = """SELECT event_id, ts, user_id % 20 AS cell, CAST(ts AS DATE) AS from_day FROM events"""
ANSWERED = f"""WITH RECURSIVE q AS (SELECT *, round_even(13.0e0 + cell/300e0, 2) AS lat, round_even(-89.0e0 + cell/300e0, 2) AS lon, epoch_us(ts) AS tick FROM ({ASKED})),
g AS (SELECT lat, lon, from_day, tick, min(event_id) AS event_id FROM q GROUP BY lat, lon, from_day, tick),
n AS (SELECT *, min(tick) OVER (PARTITION BY lat, lon, from_day ORDER BY tick RANGE BETWEEN 3600000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM g),
a AS (SELECT n.* FROM n JOIN (SELECT lat, lon, from_day, min(tick) AS tick FROM n GROUP BY lat, lon, from_day) f USING (lat, lon, from_day, tick)
UNION ALL SELECT n.* FROM a JOIN n ON n.lat = a.lat AND n.lon = a.lon AND n.from_day = a.from_day AND n.tick = a.later)
SELECT event_id FROM a"""


def asked(rows):
    cell = F.col("user_id") % 20
    day = F.col("ts").cast("date")
    return rows.select("event_id", "ts", (13.0 + cell / 300).alias("lat"), (-89.0 + cell / 300).alias("lon"), day.alias("from_day"), F.date_add(day, 2).alias("to_day"))


@query("str_3", ANSWERED)
def str_3(fx):
    return S.answered_once(asked(fx.events)).select("event_id")


@query("str_3_stream", f"SELECT event_id FROM ({ANSWERED}) JOIN events USING (event_id) WHERE epoch_us(ts) < epoch_ms((SELECT max(ts) FROM events))*1000 - 600000000")
def str_3_stream(fx):
    return S.drain(S.answers(asked(events(fx))), "answered").select("event_id")


PHASES = "SELECT event_id, CAST(floor(event_id/3) AS BIGINT) AS request_id, CASE event_id % 3 WHEN 0 THEN 'candidates' WHEN 1 THEN 'draft' ELSE 'plan' END AS phase, ts FROM events WHERE event_id % 13 <> 5"


@query("str_4", f"""
WITH p AS ({PHASES}) SELECT request_id, (epoch_us(min(ts) FILTER (phase = 'draft')) - epoch_us(min(ts) FILTER (phase = 'candidates')))/1e6 AS to_draft,
(epoch_us(min(ts) FILTER (phase = 'plan')) - epoch_us(min(ts) FILTER (phase = 'draft')))/1e6 AS to_plan, arg_max(phase, (ts, event_id)) AS last_phase, count(*) AS events FROM p GROUP BY request_id""")
def str_4(fx):
    phase = F.when(F.col("event_id") % 3 == 0, "candidates").when(F.col("event_id") % 3 == 1, "draft").otherwise("plan")
    log = events(fx).where("event_id % 13 <> 5").select(
        "event_id", F.floor(F.col("event_id") / 3).alias("request_id"), phase.alias("phase"), "ts"
    )
    marks = S.fold_by_key(log, run_folder(fx.spark, "phases"), ["request_id"], lambda batch, _: S.phase_marks(batch), S.fold_marks)
    return S.phase_log(marks)


@query("str_5", "SELECT concat('c', CAST(user_id AS VARCHAR)) AS code, count(*) AS opened FROM events WHERE event_type = 'click' GROUP BY user_id")
def str_5(fx):
    log = events(fx).where("event_type = 'click'").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("code"))
    return S.fold_by_key(log, run_folder(fx.spark, "opens"), ["code"], lambda batch, _: S.opens(batch), S.fold_opens).select("code", "opened")


@query("str_5_cleanup", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' AND NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'click' AND user_id = o_custkey)")
def str_5_cleanup(fx):
    code = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    shared = fx.orders.select("o_orderkey", code("o_custkey").alias("code"), F.col("o_orderdate").alias("created_at"))
    log = fx.events.where("event_type = 'click'").select(code("user_id").alias("code"))
    return S.never_opened(shared, log, F.lit("1999-01-01").cast("timestamp_ntz")).select("o_orderkey")


from workload.quality import JUDGED  # noqa: E402


@query("str_6", f"SELECT osm_type, osm_id, name, category, quality, is_active, rejected_reason FROM ({JUDGED})")
def str_6(fx):
    landing = land_batches(elements(fx), "arrivals")
    rows = S.load_incrementally(fx.spark, landing, run_folder(fx.spark, "catalogue"))
    return rows.select("osm_type", "osm_id", "name", "category", "quality", "is_active", "rejected_reason")


def hourly_stream(fx):
    """Hourly rain rows as they arrive: each event carries its share of the hour."""
    return events(fx).select("ts", (F.col("value") / 100).alias("mm"))


@query("str_7", """
SELECT CAST(ts AS DATE) AS date, count(*) AS hours, round(sum(value/100), 4) AS mm FROM events GROUP BY 1
HAVING CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR""")
def str_7(fx):
    return S.drain(S.daily_rain(hourly_stream(fx)), "daily")


@query("str_7_sliding", """
WITH h AS (SELECT date_trunc('hour', ts) - to_hours(k) AS starts, value/100 AS mm FROM events, range(0, 6) t(k))
SELECT starts, round(sum(mm), 4) AS mm FROM h GROUP BY starts HAVING starts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR""")
def str_7_sliding(fx):
    return S.drain(S.sliding_rain(hourly_stream(fx)), "sliding").withColumn("starts", F.col("starts").cast("timestamp_ntz"))


@query("str_7_late", f"""
WITH r AS (SELECT user_id % 20 AS cell, event_id AS id, ts AS seen, CASE WHEN event_id % 10 = 3 THEN ts - INTERVAL 5 HOUR ELSE ts END AS ts, value/100 AS mm FROM events),
j AS (SELECT *, max(ts) OVER (PARTITION BY cell ORDER BY seen, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM r
WHERE epoch_ms(seen) < epoch_ms((SELECT max(ts) FROM events)) - {R.DELAY_SECONDS * 1000}),
d AS (SELECT cell, CAST(ts AS DATE) AS date, coalesce(ts >= newest - INTERVAL 3 HOUR, true) AS kept, count(*) AS hours, round(sum(mm), 4) AS mm FROM j GROUP BY 1, 2, 3),
n AS (SELECT cell, max(ts) AS newest FROM j GROUP BY cell)
SELECT cell, date, kept, hours, mm FROM d JOIN n USING (cell) WHERE NOT kept OR date + INTERVAL 1 DAY <= newest - INTERVAL 3 HOUR""")
def str_7_late(fx):
    """Files of rows in no order, some five hours behind the hour they arrived in."""
    behind = F.when(F.col("event_id") % 10 == 3, F.expr("ts - INTERVAL 5 HOURS")).otherwise(F.col("ts"))
    landed = fx.events.withColumn("ts", F.col("ts").cast("timestamp")).select(
        (F.col("user_id") % 20).alias("cell"), F.col("event_id").alias("id"), F.col("ts").alias("seen"), behind.alias("ts"), (F.col("value") / 100).alias("mm"))
    folder = run_folder(fx.spark, "hourly")
    landed.repartition("id").write.parquet(folder)
    told = R.drain_days(R.daily_stream(fx.spark.readStream.schema(landed.schema).parquet(folder)))
    return told.withColumn("mm", F.round("mm", 4))
