"""The travel table: measured edges, estimates, calibration and road geometry."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.operators.skew import middle
from trailgrid.functions.geo import arrival_overhead, haversine_km, with_estimate

PROFILES = {"driving": "driving-car", "walking": "foot-walking"}


def ordered_pairs(members: DataFrame, key: str) -> DataFrame:
    """Directed pairs of distinct places of each set; sets are bounded planning shortlists."""
    a = members.select(key, F.col("id").alias("origin"))
    b = members.select(key, F.col("id").alias("destination"))
    return a.join(b, key).where("origin <> destination")


def profile_of(mode: Column) -> Column:
    return F.when(mode == "walking", PROFILES["walking"]).otherwise(PROFILES["driving"])


def measured(edges: DataFrame) -> DataFrame:
    """Edges somebody measured, whoever it was."""
    return edges.where(F.col("source") != "estimated")


def measured_legs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The measured edge of each directed pair and profile."""
    return pairs.join(measured(edges), ["origin", "destination", "profile"])


def missing_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return pairs.distinct().join(measured(edges), ["origin", "destination", "profile"], "left_anti")


def _with_ends(pairs: DataFrame, places: DataFrame) -> DataFrame:
    ends = places.select("id", "lat", "lon")
    a = ends.select(F.col("id").alias("origin"), F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    b = ends.select(F.col("id").alias("destination"), F.col("lat").alias("dlat"), F.col("lon").alias("dlon"))
    return pairs.join(a, "origin").join(b, "destination")


def travel(pairs: DataFrame, edges: DataFrame, places: DataFrame, mode: str = "driving") -> DataFrame:
    """km and minutes of every distinct pair: the measured edge, else the estimate.

    The arrival overhead is added here, so the stored edges stay pure travel time.
    """
    wanted = pairs.select("origin", "destination").distinct().withColumn("profile", F.lit(PROFILES[mode]))
    known = measured(edges).select("origin", "destination", "profile", "km", "minutes", "source")
    joined = _with_ends(wanted, places).join(known, ["origin", "destination", "profile"], "left")
    guessed = with_estimate(joined, ("olat", "olon"), ("dlat", "dlon"), mode, "_km", "_minutes")
    return guessed.select(
        "origin", "destination", "profile",
        F.coalesce("km", "_km").alias("km"),
        F.coalesce(F.col("minutes") + arrival_overhead(mode), "_minutes").cast("int").alias("minutes"),
        F.coalesce("source", F.lit("estimated")).alias("source"),
    )


def plausible(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges no shorter than the straight line, within a small margin."""
    straight = haversine_km("olat", "olon", "dlat", "dlon")
    return _with_ends(edges, places).where(F.col("km") >= straight * K.PLAUSIBLE_SHARE).select(*edges.columns)


def purge_implausible(edges: DataFrame, places: DataFrame) -> DataFrame:
    """The edge table less the rows that measure less than the straight line."""
    keys = ["origin", "destination", "profile"]
    straight = haversine_km("olat", "olon", "dlat", "dlon")
    bad = _with_ends(edges, places).where(F.col("km") < straight * K.PLAUSIBLE_SHARE)
    return edges.join(bad.select(*keys), keys, "left_anti")


def provenance(legs: DataFrame, keys: list[str]) -> DataFrame:
    """Where each plan's travel figures come from, with one label and a reason."""
    cached = F.count_if(F.col("origin_of") == "cached")
    fetched = F.count_if(F.col("origin_of") == "fetched")
    guessed = F.count_if(F.col("origin_of") == "estimated")
    counted = legs.groupBy(*keys).agg(cached.alias("cached"), fetched.alias("fetched"), guessed.alias("estimated"))
    return label_provenance(counted)


def label_provenance(counted: DataFrame) -> DataFrame:
    real = F.col("cached") + F.col("fetched")
    total = real + F.col("estimated")
    return counted.withColumns(
        {
            "real_ratio": F.coalesce(F.bround(F.try_divide(real.cast("double"), total), 3), F.lit(0.0)),
            "label": F.when(real == 0, "estimated").when(F.col("estimated") > 0, "mixed").otherwise("real"),
        }
    )


def merge_modes(per_mode: DataFrame, key: str) -> DataFrame:
    """One provenance row per plan out of one per travel mode."""
    merged = per_mode.groupBy(key).agg(
        F.sum("cached").alias("cached"), F.sum("fetched").alias("fetched"), F.sum("estimated").alias("estimated"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("position"))).alias("reason"),
    )
    return label_provenance(merged)


def leg_provenance(legs: DataFrame, keys: list[str]) -> DataFrame:
    """Legs with stored, fresh or no road geometry."""
    counted = legs.groupBy(*keys).agg(
        F.count_if(F.col("geometry_from") == "cached").alias("cached"),
        F.count_if(F.col("geometry_from") == "fetched").alias("fetched"),
        F.count_if(F.col("geometry_from").isNull()).alias("straight"),
    )
    real = F.col("cached") + F.col("fetched")
    return counted.withColumn(
        "real_ratio", F.coalesce(F.bround(F.try_divide(real.cast("double"), real + F.col("straight")), 3), F.lit(0.0))
    )


def band_of(straight_km: Column) -> Column:
    label = F.lit(K.BANDS[-1][0])
    for name, limit in reversed(K.BANDS[:-1]):
        label = F.when(straight_km < limit, F.lit(name)).otherwise(label)
    return label


def by_band(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Detour and speed medians by straight-line distance, and pairs without a route."""
    measured_pairs = _with_ends(edges, places).withColumn("straight", haversine_km("olat", "olon", "dlat", "dlon"))
    routed = F.col("km").isNotNull() & F.col("minutes").isNotNull() & (F.col("minutes") > 0)
    usable = routed & (F.col("straight") >= 0.05)
    banded = measured_pairs.withColumns({
        "band": band_of(F.col("straight")), "detour": F.when(usable, F.col("km") / F.col("straight")),
        "kmh": F.when(usable, F.col("km") / (F.col("minutes") / 60.0)),
    })
    counts = banded.groupBy("band").agg(
        F.count_if(usable).alias("pairs"), F.round(F.avg(F.when(routed, 0.0).otherwise(1.0)), 4).alias("no_route")
    )
    detours = middle(banded, ["band"], "detour", ["origin", "destination"], "detour_")
    speeds = middle(banded, ["band"], "kmh", ["origin", "destination"], "kmh_")
    return counts.join(detours, "band", "left").join(speeds, "band", "left").select(
        "band", "pairs", F.round("detour_", 4).alias("detour"), F.round("kmh_", 3).alias("kmh"), "no_route"
    )


def zone_samples(in_zone: DataFrame, size: int, seeds: list[int]) -> DataFrame:
    """``size`` places per (zone, seed), drawn by a hash so runs agree."""
    order = Window.partitionBy("zone", "seed").orderBy("_draw", "id")
    return (
        in_zone.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
        .withColumn("_draw", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("seed").cast("string"))))
        .withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size).drop("_draw", "_r")
    )


def calibrate_detours(samples: DataFrame, edges: DataFrame) -> DataFrame:
    """Per zone: mean and range of the sample medians of road over straight line, p90 and worst.

    Samples are bounded by their size, so their pairs are too.
    """
    pairs = sample_factors(samples, edges)
    medians = (
        pairs.groupBy("zone", "seed")
        .agg(F.count(F.lit(1)).alias("n"), F.median("factor").alias("median"))
        .where(F.col("n") >= K.CALIBRATION_MIN_PAIRS)
    )
    kept = pairs.join(medians.select("zone", "seed"), ["zone", "seed"], "left_semi")
    tails = kept.groupBy("zone").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.percentile("factor", F.lit(0.9)), 4).alias("p90"),
        F.round(F.max("factor"), 4).alias("worst"),
    )
    return medians.groupBy("zone").agg(
        F.round(F.avg("median"), 4).alias("factor"), F.round(F.max("median") - F.min("median"), 4).alias("range")
    ).join(tails, "zone")


def sample_factors(samples: DataFrame, edges: DataFrame) -> DataFrame:
    """Road over straight line of the measured pairs inside each sample."""
    a = samples.select("zone", "seed", F.col("id").alias("origin"), F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    b = samples.select("zone", "seed", F.col("id").alias("destination"), F.col("lat").alias("dlat"), F.col("lon").alias("dlon"))
    straight = haversine_km("olat", "olon", "dlat", "dlon")
    return (
        a.join(edges.select("origin", "destination", "km"), "origin")
        .join(b, ["zone", "seed", "destination"])
        .withColumn("straight", straight).where(F.col("straight") >= K.CALIBRATION_MIN_KM)
        .withColumn("factor", F.col("km") / F.col("straight"))
    )


def request_plan(members: DataFrame, key: str, block: int = K.MATRIX_BLOCK) -> DataFrame:
    """Matrix requests each set costs when asked in blocks."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("places") / block))
    return (
        members.groupBy(key).agg(F.countDistinct("id").alias("places"))
        .withColumns({"blocks": blocks.cast("int"), "requests": (blocks * blocks).cast("int")})
    )


def _points(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, lat, lon) of a column of arrays of struct(lat, lon); a missing coordinate is NaN."""
    at = lists.offsets.to_numpy().astype(np.int64)
    lat, lon = (lists.values.field(n).cast(pa.float64()) for n in ("lat", "lon"))
    return at[:-1], np.diff(at), lat.to_numpy(zero_copy_only=False), lon.to_numpy(zero_copy_only=False)


def _vertices_of_stops(path: pa.Array, stops: pa.Array) -> pa.Array:
    """The vertex, from 1, that each stop of a route takes, as ``split_by_stops`` says."""
    start, size, lat, lon = _points(path)
    first, count, stop_lat, stop_lon = _points(stops)
    ends = np.cumsum(count)
    taken, here = np.empty(count.sum(), np.int32), np.zeros(len(start), np.int64)
    taken[ends - 1] = size
    for turn in range(count.max(initial=0) - 1):
        rows = np.flatnonzero(count > turn + 1)
        left = size[rows] - here[rows]
        begin = np.cumsum(left) - left
        vertex = np.repeat(start[rows] + here[rows] - begin, left) + np.arange(left.sum())
        dlat = lat[vertex] - np.repeat(stop_lat[first[rows] + turn], left)
        dlon = lon[vertex] - np.repeat(stop_lon[first[rows] + turn], left)
        away = dlat * dlat + dlon * dlon
        away[np.isnan(away)] = -np.inf
        nearest = np.flatnonzero(away == np.repeat(np.minimum.reduceat(away, begin), left))
        here[rows] += nearest[np.searchsorted(nearest, begin)] - begin
        taken[ends[rows] - count[rows] + turn] = here[rows] + 1
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(taken))


def split_by_stops(routes: DataFrame, path: str = "path", stops: str = "stops") -> DataFrame:
    """``segments``: the path cut at each stop, one segment per leg.

    Both columns are arrays of struct(lat, lon). A stop takes the nearest vertex at or after
    the previous stop's, the last stop takes the end, and neighbours share a vertex; a leg
    without length is empty. Each stop is looked for in all routes of a batch at once.
    """
    places = F.arrow_udf(_vertices_of_stops, "array<int>")
    bounds = F.arrays_zip(
        F.slice("_at", 1, F.size("_at") - 1).alias("a"), F.slice("_at", 2, F.size("_at")).alias("b")
    )
    cut = F.transform(
        bounds,
        lambda s: F.when(s["b"] > s["a"], F.slice(path, s["a"], s["b"] - s["a"] + 1)).otherwise(F.slice(path, 1, 0)),
    )
    whole = routes.where((F.size(stops) >= 2) & (F.size(path) >= 2))
    return whole.withColumn("_at", places(path, stops)).withColumn("segments", cut).drop("_at")


def simplify(paths: DataFrame, keys: list[str], tolerance: float = K.SIMPLIFY_TOLERANCE_DEG) -> DataFrame:
    """The vertices that keep every dropped one within ``tolerance`` of the line that is left.

    ``paths`` is (keys, position, lat, lon). A stretch between two kept vertices is cut at the
    vertex farthest from its chord (the first of equals) as long as that strays more than the
    tolerance. A task reads its paths in order and cuts the whole ones of a batch together, so
    paths are dealt and sorted once however many cuts they need.
    """
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("position")
    ends = (F.col("position") == F.min("position").over(whole)) | (F.col("position") == F.max("position").over(whole))
    rows = paths.select(*keys, "position", "lat", "lon").withColumns({
        "_kept": F.coalesce(ends, F.lit(False)), "_opens": F.row_number().over(order) == 1,
    })
    schema = paths.select(*keys, "position", "lat", "lon").schema

    def work(batches):
        waiting = []
        for batch in batches:
            opens = np.flatnonzero(batch.column("_opens").to_numpy(zero_copy_only=False))
            if not len(opens):
                waiting.append(batch)
                continue
            yield from _simplified([*waiting, batch.slice(0, opens[-1])], tolerance)
            waiting = [batch.slice(opens[-1])]
        yield from _simplified(waiting, tolerance)

    return rows.mapInArrow(work, schema)


def _simplified(batches: list[pa.RecordBatch], tolerance: float):
    """The kept rows of whole paths."""
    if not sum(b.num_rows for b in batches):
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    read = lambda c: rows.column(c).to_numpy()
    kept = _cut(read("_kept").astype(bool), np.cumsum(read("_opens")), read("lat").astype(float), read("lon").astype(float), tolerance)
    yield from rows.filter(pa.array(kept)).drop_columns(["_kept", "_opens"]).to_batches()


def _cut(kept: np.ndarray, path: np.ndarray, lat: np.ndarray, lon: np.ndarray, tolerance: float) -> np.ndarray:
    """``kept`` and the vertices at which stretches are cut; only stretches that were cut are looked at again."""
    kept = kept.copy()
    open_rows = np.flatnonzero(~kept)
    while len(open_rows):
        corners, stretch = np.flatnonzero(kept), (np.cumsum(kept) - 1)[open_rows]
        inside = (stretch >= 0) & (stretch < len(corners) - 1)
        open_rows, stretch = open_rows[inside], stretch[inside]
        a, b = corners[stretch], corners[stretch + 1]
        between = (path[a] == path[open_rows]) & (path[b] == path[open_rows])
        open_rows, stretch, a, b = (x[between] for x in (open_rows, stretch, a, b))
        if not len(open_rows):
            break
        dx, dy, px, py = lon[b] - lon[a], lat[b] - lat[a], lon[open_rows] - lon[a], lat[open_rows] - lat[a]
        length = dx * dx + dy * dy
        along = np.clip(np.divide(px * dx + py * dy, length, out=np.zeros(len(length)), where=length != 0), 0.0, 1.0)
        stray = np.floor(np.sqrt((px - along * dx) ** 2 + (py - along * dy) ** 2) * 1e12 + 0.5) / 1e12
        stray[np.isnan(stray)] = -1.0
        begin = np.flatnonzero(np.diff(stretch, prepend=-1))
        farthest, size = np.maximum.reduceat(stray, begin), np.diff(begin, append=len(stray))
        at = np.flatnonzero(stray == np.repeat(farthest, size))
        first = at[np.searchsorted(at, begin)]
        kept[open_rows[first[farthest > tolerance]]] = True
        open_rows = open_rows[np.repeat(farthest > tolerance, size)]
        open_rows = open_rows[~kept[open_rows]]
    return kept
