"""Keyed tables: upserts, additive inserts, snapshots, shared plans, calendar rows, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.session import checkpointed

REQUEST = (
    "plan_id bigint, days int, start_date date, center_lat double, center_lon double, radius_m int, "
    "earliest_start string, latest_end string, max_travel_km_per_day double, mode string, "
    "preferred_categories array<string>, avoided_categories array<string>, "
    "must_include_categories array<string>, must_include_subcategories array<string>, "
    "day_modes map<string,string>, include_meals boolean, must_include_meals array<string>, "
    "meal_cuisines map<string,string>, meal_minutes int, category_minutes map<string,int>, "
    "max_stops_per_day int, min_quality double, start_place bigint, return_to_start boolean, "
    "must_include_places array<bigint>, place_minutes map<string,int>"
)


def upsert(stored: DataFrame, arrived: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the newest version; the pick is combined before the shuffle."""
    columns = [c for c in stored.columns if c not in keys]
    newest = F.max_by(F.struct(*columns), F.struct(version, F.xxhash64(*columns)))
    rows = stored.unionByName(arrived)
    return rows.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*stored.columns)


def union_groups(groups: list[DataFrame], keys: list[str], version: str) -> DataFrame:
    """All groups appended, then one row per key."""
    first, *others = groups
    for group in others[:-1]:
        first = first.unionByName(group)
    return upsert(first, others[-1] if others else first.limit(0), keys, version)


def insert_absent(stored: DataFrame, arrived: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` plus the arrived rows whose key it does not hold yet."""
    fresh = arrived.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def restore(stored: DataFrame, dump: DataFrame, keys: list[str], flag: str = "is_active") -> DataFrame:
    """Rows the dump adds are inserted and the dump's flag wins; nothing is deleted."""
    added = dump.join(stored.select(*keys), keys, "left_anti").select(*stored.columns)
    flags = dump.select(*keys, F.col(flag).alias("_flag"))
    synced = (
        stored.join(flags, keys, "left").withColumn(flag, F.coalesce("_flag", flag)).select(*stored.columns)
    )
    return synced.unionByName(added)


def share_code(seed: Column, length: int = K.SHARE_LENGTH) -> Column:
    """``length`` characters of the share alphabet, each drawn by 16 bits of a hash of the seed."""
    digest = F.sha2(seed.cast("string").cast("binary"), 256)
    drawn = [F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int") % len(K.SHARE_ALPHABET) for i in range(length)]
    return F.concat(*[F.substr(F.lit(K.SHARE_ALPHABET), n + 1, F.lit(1)) for n in drawn])


def share_codes(plans: DataFrame, length: int = K.SHARE_LENGTH) -> DataFrame:
    """(plan_id, code), one code for each plan: the smallest plan keeps a code, others draw again.

    A round groups all codes once; after the first only the few that clashed draw.
    """
    drawing = checkpointed(plans.select("plan_id").distinct().withColumn("code", share_code(F.col("plan_id"), length)))
    settled, attempt = drawing.limit(0), 0
    while True:
        pool = settled.withColumn("_new", F.lit(False)).unionByName(drawing.withColumn("_new", F.lit(True)))
        first = pool.groupBy("code").agg(F.min(F.struct("_new", "plan_id"))["plan_id"].alias("plan_id"))
        kept = checkpointed(first.select("plan_id", "code"))
        attempt += 1
        again = F.concat_ws(":", F.col("plan_id").cast("string"), F.lit(str(attempt)))
        drawing = checkpointed(drawing.join(kept, ["plan_id", "code"], "left_anti").select("plan_id", share_code(again, length).alias("code")))
        settled = kept
        if drawing.isEmpty():
            return settled


def share_plans(stops: DataFrame, length: int = K.SHARE_LENGTH) -> DataFrame:
    """(code, plan_id, payload): each plan as one JSON document under its code."""
    ordered = F.array_sort(F.collect_list(F.struct("day", "ord", "place_id", "leg_km")))
    plans = stops.groupBy("plan_id").agg(ordered.alias("stops"))
    return plans.join(share_codes(stops, length), "plan_id").select("code", "plan_id", F.to_json(F.struct("plan_id", "stops")).alias("payload"))


def open_shared(codes: DataFrame, shared: DataFrame) -> DataFrame:
    """The stored plans of the asked codes; unknown codes have no payload."""
    return codes.select("code").distinct().join(shared, "code", "left")


def calendar_events(stops: DataFrame) -> DataFrame:
    """One calendar row per stop of a dated day."""

    def stamp(minute: Column) -> Column:
        at = F.expr("timestampadd(MINUTE, 0, cast(date as timestamp_ntz))") + F.make_dt_interval(mins=minute)
        return F.date_format(at, "yyyyMMdd'T'HHmmss")

    label = F.when(F.col("leg_km") > 0, F.concat(F.col("category"), F.lit(" · "), F.format_number("leg_km", 1), F.lit(" km")))
    return stops.where(F.col("date").isNotNull()).select(
        F.concat(F.coalesce("code", F.col("date").cast("string")), F.lit("-d"), F.col("day"), F.lit("-p"), F.col("ord") - 1, F.lit("@trailgrid")).alias("uid"),
        stamp(F.col("arrival")).alias("starts"), stamp(F.col("departure")).alias("ends"),
        F.col("name").alias("summary"), F.coalesce(label, F.col("category")).alias("description"), "lat", "lon",
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Trip requests, one JSON object per line; an absent field stays null."""
    return spark.read.schema(REQUEST).json(path)
