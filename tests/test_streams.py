"""The rollup with late rows and the keyed store, against plain Python, in one and in many batches."""

import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trailgrid.streaming import flows as S
from trailgrid.streaming import rollup as R
from trailgrid.streaming.store import KeyStore

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ALLOWED, DELAY = 3 * 3600, 6 * 3600


def arrivals(n=1500):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        seen = START + dt.timedelta(minutes=6 * i)
        rows.append((0 if i % 3 else i % 5, i, seen, seen - dt.timedelta(hours=rng.choice((0, 0, 0, 1, 2, 4, 30))), float(i % 7)))
    return rows


def judged(rows):
    top = max(r[2] for r in rows) - dt.timedelta(seconds=DELAY)
    newest, days = {}, {}
    for cell, _, seen, ts, mm in sorted(rows, key=lambda r: (r[2], r[1])):
        if seen >= top:
            continue
        kept = cell not in newest or ts >= newest[cell] - dt.timedelta(seconds=ALLOWED)
        hours, total = days.get((cell, ts.date(), kept), (0, 0.0))
        days[cell, ts.date(), kept] = (hours + 1, total + mm)
        newest[cell] = max(newest.get(cell, ts), ts)
    end = lambda d: dt.datetime.combine(d, dt.time(), dt.timezone.utc) + dt.timedelta(days=1)
    return sorted((*k, *v) for k, v in days.items() if not k[2] or end(k[1]) <= newest[k[0]] - dt.timedelta(seconds=ALLOWED))


@pytest.mark.parametrize("batches", [1, 50])
def test_late_rows_do_not_depend_on_batches(spark, tmp_path, batches):
    rows, rng = arrivals(), random.Random(5)
    parts = [rows[k * len(rows) // batches:(k + 1) * len(rows) // batches] for k in range(batches)]
    for k in range(0, batches - 1, 2):
        both = parts[k] + parts[k + 1]
        rng.shuffle(both)
        parts[k], parts[k + 1] = both[:len(parts[k])], both[len(parts[k]):]
    schema = "cell long, id long, seen timestamp, ts timestamp, mm double"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "one" / str(k)))
        (made,) = [f for f in os.listdir(tmp_path / "one" / str(k)) if f.endswith(".parquet")]
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.link(tmp_path / "one" / str(k) / made, tmp_path / "in" / f"{k:03d}.parquet")
        os.utime(tmp_path / "in" / f"{k:03d}.parquet", (10 ** 9 + k, 10 ** 9 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = R.drain_days(R.daily_stream(stream, ALLOWED, DELAY))
    want = judged(rows)
    assert {r[2] for r in want} == {True, False} and sorted(map(tuple, got.collect())) == want


def counts(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "code string").groupBy("code").agg(F.count(F.lit(1)).alias("opened"))


def size(folder):
    return sum(os.path.getsize(os.path.join(f, n)) for f, _, names in os.walk(folder) for n in names)


def test_store_merges_runs_and_its_buckets_grow(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path), ["code"], S.fold_opens, fan=3, bucket_rows=40)
    rng, want, bits = random.Random(2), Counter(), []
    for batch in range(14):
        rows = [f"c{rng.randrange(40 * (batch + 1))}" for _ in range(60)]
        want.update(rows)
        store.append(counts(spark, rows), batch)
        bits.append(max(r.bits for r in store.runs()))
        assert len(store.runs()) <= 2 * 4
    assert {(r.code, r.opened) for r in store.read().collect()} == set(want.items())
    assert bits[0] <= 1 and bits[-1] >= 3 and bits == sorted(bits)
    assert [(r.level, r.first, r.last) for r in store.runs()] == [(2, 0, 8), (1, 9, 11), (0, 12, 12), (0, 13, 13)]
    asked = spark.createDataFrame([("c1",), ("c77",), ("none",)], "code string")
    assert {(r.code, r.opened) for r in store.look_up(asked).collect()} == {(c, n) for c, n in want.items() if c in ("c1", "c77")}


def test_store_takes_a_batch_once_and_survives_half_written_runs(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path), ["code"], S.fold_opens, fan=2)
    store.append(counts(spark, ["a", "b"]), 0)
    store.append(counts(spark, ["a", "b"]), 0)
    store.append(counts(spark, ["b"]), 1)
    store.append(counts(spark, ["a", "b"]), 0)
    store.append(counts(spark, []), 2)
    half = tmp_path / "runs" / "run_1_0_5_0"
    os.makedirs(half / "bucket=0")
    assert {(r.code, r.opened) for r in store.read().collect()} == {("a", 1), ("b", 2)}
    assert [(r.level, r.first, r.last) for r in store.runs()] == [(1, 0, 1)]
    again = KeyStore(spark, str(tmp_path), ["code"], S.fold_opens, fan=2)
    again.append(counts(spark, ["c"]), 3)
    assert {(r.code, r.opened) for r in again.read().collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert [r.path.split("/")[-1] for r in again.written()] == ["run_1_0_1_0", "run_0_3_3_0"]


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path), ["code"], S.fold_opens, fan=4)
    store.append(counts(spark, [f"c{i}" for i in range(40_000)]), 0)
    whole = size(tmp_path)
    store.append(counts(spark, ["c1", "new"]), 1)
    assert size(tmp_path) - whole < whole / 20


def test_empty_store(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path), ["code"], S.fold_opens)
    assert store.read() is None and store.look_up(counts(spark, ["a"])) is None
