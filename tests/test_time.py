import datetime as dt

import pytest
from pyspark.sql import functions as F

from trailgrid.functions import hours as H
from trailgrid.functions import timectx as C

MONDAY = dt.date(2025, 9, 1)


@pytest.mark.parametrize("date,clock", [
    (dt.date(2025, 6, 21), "18:26"), (dt.date(2025, 12, 21), "17:34"), (dt.date(2025, 11, 15), "17:26"), (dt.date(2025, 3, 20), "18:07"),
])
def test_sunset_within_minutes(spark, date, clock):
    minute = spark.createDataFrame([(date,)], "d date").select(C.sunset_minute("d", F.lit(13.70), F.lit(-89.22))).first()[0]
    expected = int(clock[:2]) * 60 + int(clock[3:])
    assert abs(minute - expected) <= 5


def test_polar_night_has_no_sunset(spark):
    row = spark.createDataFrame([(dt.date(2025, 6, 21),)], "d date").select(C.sunset_minute("d", F.lit(80.0), F.lit(0.0))).first()
    assert row[0] is None


@pytest.mark.parametrize("text,offset,start,stop,state", [
    ("Mo-We 08:30-11:45, 13:15-18:00", 1, 800, 900, "abierto"),
    ("Mo-We 08:30-11:45, 13:15-18:00", 1, 690, 720, "cerrado"),
    ("Mo-We 08:30-11:45, 13:15-18:00", 4, 800, 900, "cerrado"),
    ("Mo-Sa 06:00-14:00; We off", 2, 400, 500, "cerrado"),
    ("Mo-Sa 06:00-14:00; We 10:00-12:00", 2, 610, 700, "abierto"),
    ("Mo-Sa 06:00-14:00; We 10:00-12:00", 2, 400, 500, "cerrado"),
    ("Th 22:30-03:15", 3, 1400, 1500, "abierto"),
    ("Su 21:00-04:00", 0, 60, 200, "abierto"),
    ("Sa-Tu 10:00-16:00", 6, 620, 800, "abierto"),
    ("Sa-Tu 10:00-16:00", 2, 620, 800, "cerrado"),
    ("We 09:00\u201112:00", 2, 540, 720, "abierto"),
    ("Fr 05:00-06:00,Sa 09:00-10:00", 5, 545, 595, "abierto"),
    ("07:15-19:45", 5, 500, 1100, "abierto"),
    ("24/7", 3, 0, 1439, "abierto"),
    ("closed", 4, 600, 610, "cerrado"),
    ("We-Fr", 3, 600, 610, "desconocido"),
    ("by appointment 09:00-10:00", 3, 550, 560, "desconocido"),
    ("09:00-26:00", 3, 550, 560, "desconocido"),
    (None, 3, 600, 610, "desconocido"),
])
def test_opening_state(spark, text, offset, start, stop, state):
    rows = spark.createDataFrame([(text, MONDAY + dt.timedelta(days=offset), start, stop)], "opening_hours string, date date, a int, b int")
    start_of_week = C.minute_of_week("date", "a")
    row = H.with_hours(rows).select(H.visit_state(F.col("open"), start_of_week, start_of_week + F.col("b") - F.col("a"))).first()
    assert row[0] == state


def test_hour_runs_and_words(spark):
    from trailgrid.functions import text as T

    frame = spark.createDataFrame([([14, 16, 15, 19],), ([22, 23],)], "h array<int>").withColumn("r", C.hour_runs(F.col("h")))
    rows = frame.select("r", T.hour_phrases(F.col("r")).alias("w")).collect()
    assert [tuple(x) for x in rows[0].r] == [(14, 16), (19, 19)]
    assert [r.w for r in rows] == ["de 14:00 a 17:00 y a las 19:00", "desde las 22:00"]


def test_light_share(spark):
    rows = spark.createDataFrame([(600, 700, 650), (600, 700, 800), (600, 700, 500), (600, 700, None)], "a int, b int, s int")
    assert [r[0] for r in rows.select(C.light_share("a", "b", "s")).collect()] == [0.5, 1.0, 0.0, None]
