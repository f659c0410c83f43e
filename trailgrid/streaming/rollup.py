"""Daily totals and late rows from one stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trailgrid.session import run_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY = 86_400_000_000
ALLOWED_SECONDS = 3 * 3600
DELAY_SECONDS = 600
OUT = T.StructType([
    T.StructField("cell", T.LongType()), T.StructField("day", T.LongType()), T.StructField("kept", T.BooleanType()),
    T.StructField("hours", T.LongType()), T.StructField("mm", T.DoubleType()),
])


def day_book(allowed: int):
    """The processor of one cell's rows, made inside so that workers get it by value.

    Rows wait until the watermark of their arrival time has passed them and are then judged in order
    of arrival, so how they fall into micro-batches changes nothing. A row more than ``allowed``
    microseconds behind the newest judged before it is late; the others add to their day. A day is
    told, and forgotten, once the newest row is ``allowed`` past its end: no row can reach it any more.
    """

    class DayBook(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.newest = handle.getValueState("newest", "ts long")
            self.waiting = handle.getListState("waiting", "seen long, id long, ts long, mm double")
            self.days = handle.getMapState("days", "day long", "hours long, mm double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            first = None
            for part in rows:
                self.waiting.appendList(list(part[["seen", "id", "ts", "mm"]].itertuples(index=False, name=None)))
                first = min(int(part["seen"].min()), first if first is not None else 1 << 62)
            if first is not None:
                self.handle.registerTimer(first // 1000 + 1)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            mark = timerValues.getCurrentWatermarkInMs()
            held = list(self.waiting.get())
            due = sorted(r for r in map(tuple, held) if r[0] // 1000 < mark)
            rest = [tuple(r) for r in held if r[0] // 1000 >= mark]
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(rest)[0] // 1000 + 1)
            newest = self.newest.get()[0] if self.newest.exists() else None
            late: dict[int, tuple[int, float]] = {}
            fresh: dict[int, tuple[int, float]] = {}
            for _, _, ts, mm in due:
                day, behind = ts // DAY, newest is not None and ts < newest - allowed
                book = late if behind else fresh
                if not behind and day not in fresh and self.days.containsKey((day,)):
                    fresh[day] = tuple(self.days.getValue((day,)))
                hours, total = book.get(day, (0, 0.0))
                book[day] = (hours + 1, total + mm)
                newest = ts if newest is None else max(newest, ts)
            for day, value in fresh.items():
                self.days.updateValue((day,), value)
            told = [(key[0], day, False, *value) for day, value in late.items()]
            if newest is not None:
                self.newest.update((newest,))
                for (day,), value in list(self.days.iterator()):
                    if (day + 1) * DAY <= newest - allowed:
                        told.append((key[0], day, True, *value))
                        self.days.removeKey((day,))
            if told:
                yield pd.DataFrame(told, columns=OUT.names)

        def close(self) -> None:
            pass

    return DayBook()


def daily_stream(rows: DataFrame, allowed: int = ALLOWED_SECONDS, delay: int = DELAY_SECONDS) -> DataFrame:
    """(cell, day, kept, hours, mm) of a stream of (cell, id, seen, ts, mm), ``seen`` being when a row arrived.

    Kept rows are a cell's finished days, one row each; the others count the late rows of a day that
    a judgement met. Files may come in any order within ``delay`` seconds of arrival time.
    """
    marked = rows.withWatermark("seen", f"{delay} seconds")
    # the arrival time goes on as a number, so that no row is dropped ahead of the state
    plain = marked.select(
        F.col("cell").cast("long").alias("cell"), F.col("id").cast("long").alias("id"), F.unix_micros("seen").alias("seen"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("mm").cast("double").alias("mm"),
    )
    return plain.groupBy("cell").transformWithStateInPandas(day_book(allowed * 1_000_000), OUT, "Append", "EventTime")


def drain_days(stream: DataFrame, name: str = "days") -> DataFrame:
    """Run a stream of :func:`daily_stream` over what has arrived; (cell, date, kept, hours, mm), a late day once."""
    spark = stream.sparkSession
    folder = run_folder(spark, name)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer.outputMode("append").format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    told = spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))
    return told.groupBy("cell", date.alias("date"), "kept").agg(F.sum("hours").alias("hours"), F.sum("mm").alias("mm"))
