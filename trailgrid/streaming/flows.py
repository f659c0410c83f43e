"""Stream jobs that end in a table: dedupe, phases, counters, incremental loads, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.session import run_folder
from trailgrid.sources import keyed, osm
from trailgrid.streaming import limits
from trailgrid.streaming.store import BUCKET_ROWS, FAN, KeyStore


def read_table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The files of a landed parquet table as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run an appending stream over what has arrived and read back what it wrote."""
    spark = stream.sparkSession
    folder = run_folder(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.outputMode("append").format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def fold_by_key(batches: DataFrame, store: str, keys: list[str], arrive, fold, buckets: int = 1, fan: int = FAN, bucket_rows: int = BUCKET_ROWS) -> DataFrame | None:
    """Fold what has arrived into a :class:`KeyStore`; returns its rows, or None where it is empty.

    ``arrive(batch, batch_id)`` gives rows with ``keys``, ``fold(rows)`` makes one row per key of any
    rows, in whatever steps. There is no stream state, and a batch reads nothing of the store but the
    runs it merges. A job that is stopped goes on from there, and a batch that is run again changes nothing.
    """
    kept = KeyStore(batches.sparkSession, store, keys, fold, fan=fan, buckets=buckets, bucket_rows=bucket_rows)
    writer = batches.writeStream.option("checkpointLocation", f"{store}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, batch_id: kept.append(arrive(batch, batch_id), batch_id)).start().awaitTermination()
    return kept.read()


def _questions(requests: DataFrame, decimals: int) -> DataFrame:
    """Requests with rounded points, and their question as one text."""
    asked = requests.withColumns({"lat": F.bround("lat", decimals), "lon": F.bround("lon", decimals)})
    return asked.withColumn("ip", F.to_json(F.struct("lat", "lon", "from_day", "to_day"), {"ignoreNullFields": "false"}))


def answered_once(requests: DataFrame, decimals: int = K.KEY_DECIMALS, seconds: int = K.ANSWER_SECONDS) -> DataFrame:
    """The questions (rounded point and dates) that are answered anew: none within an hour of the last answer.

    The hour counts from the last answer, not from the last question, so this is a limit of one
    accepted request per hour and question.
    """
    asked = _questions(requests, decimals)
    answered = limits.limit_requests(asked, ((1, seconds),)).where("accepted").select("event_id")
    return asked.drop("ip").join(answered, "event_id", "left_semi")


def answers(requests: DataFrame, decimals: int = K.KEY_DECIMALS, seconds: int = K.ANSWER_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """The same on a stream: (event_id, ts) of the answered questions, in event time, once the watermark has passed them."""
    return limits.limit_stream(_questions(requests, decimals), ((1, seconds),), delay).where("accepted").select("event_id", "ts")


PHASES = ("candidates", "draft", "plan")


def phase_marks(events: DataFrame) -> DataFrame:
    """(request_id, first time of each phase, last, events): rows that ``fold_marks`` can add up."""
    at = [F.min(F.when(F.col("phase") == phase, F.col("ts"))).alias(phase) for phase in PHASES]
    last = F.max(F.struct("ts", "event_id", "phase")).alias("last")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("request_id").agg(*at, last, F.count(F.lit(1)).alias("events"))


def fold_marks(marks: DataFrame) -> DataFrame:
    firsts = [F.min(phase).alias(phase) for phase in PHASES]
    return marks.groupBy("request_id").agg(*firsts, F.max("last").alias("last"), F.sum("events").alias("events"))


def phase_log(marks: DataFrame) -> DataFrame:
    """Seconds from candidates to draft and to plan per request, and its last phase."""
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    return marks.select(
        "request_id", seconds("candidates", "draft").alias("to_draft"), seconds("draft", "plan").alias("to_plan"),
        F.col("last.phase").alias("last_phase"), "events",
    )


def opens(log: DataFrame) -> DataFrame:
    """Times each shared code was opened."""
    return log.groupBy("code").agg(F.count(F.lit(1)).alias("opened"))


def fold_opens(counts: DataFrame) -> DataFrame:
    return counts.groupBy("code").agg(F.sum("opened").alias("opened"))


def never_opened(shared: DataFrame, log: DataFrame, before: Column) -> DataFrame:
    """Old shared plans nobody opened, for cleanup."""
    return shared.where(F.col("created_at") < before).join(log.select("code").distinct(), "code", "left_anti")


def load_incrementally(spark: SparkSession, landing: str, store: str, buckets: int = 1) -> DataFrame:
    """Judge the element files that arrived and upsert them batch by batch; returns the catalogue."""
    key = ["osm_type", "osm_id"]

    def judge(batch: DataFrame, batch_id: int) -> DataFrame:
        rows = osm.verdicts(batch.select(F.inline("elements")))
        return rows.withColumns({"load": F.lit(batch_id), "tags": F.to_json("tags")})

    found = fold_by_key(
        spark.readStream.schema(osm.BATCH).json(landing), store, key, judge, lambda rows: keyed.upsert(rows.limit(0), rows, key, "load"), buckets
    )
    return judge(spark.createDataFrame([], osm.BATCH), 0) if found is None else found


def daily_rain(rows: DataFrame) -> DataFrame:
    """Rain per day from arriving hourly rows; rows over three hours late are dropped."""
    return (
        rows.withWatermark("ts", "3 hours").groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("hours"), F.round(F.sum("mm"), 4).alias("mm"))
        .select(F.col("w.start").cast("date").alias("date"), "hours", "mm")
    )


def sliding_rain(rows: DataFrame, hours: int = 6) -> DataFrame:
    """Rain over a sliding window that moves every hour."""
    return (
        rows.withWatermark("ts", "3 hours").groupBy(F.window("ts", f"{hours} hours", "1 hour").alias("w"))
        .agg(F.round(F.sum("mm"), 4).alias("mm")).select(F.col("w.start").alias("starts"), "mm")
    )
