"""Spatial search over a catalogue for a whole table of query points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions.geo import Grid, GridOfRow, haversine_m, literal_map
from trailgrid.operators.range_join import covering_cells, radius_sums
from trailgrid.operators.skew import split_join


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def clamp_parameters(requests: DataFrame) -> DataFrame:
    """Radius, limit and quota of each search request brought into their ranges."""
    return requests.withColumns(
        {
            "radius_m": clamp(F.col("radius_m"), 1, K.MAX_RADIUS_M),
            "limit": clamp(F.col("limit"), 1, K.MAX_LIMIT),
            "per_category": clamp(F.col("per_category"), 1, K.MAX_PER_CATEGORY),
        }
    )


def category_filter(categories: list[str] | None = None, include_lodging: bool = False) -> Column:
    """An explicit list wins; otherwise lodging stays out unless asked for."""
    if categories:
        return F.col("category").isin(categories)
    if include_lodging:
        return F.lit(True)
    return ~F.col("category").isin(*K.DEFAULT_EXCLUDED)


def usable(places: DataFrame, min_quality: float = 0.0) -> DataFrame:
    return places.where(F.col("is_active") & (F.col("quality") >= min_quality))


def search_nearby(
    areas: DataFrame,
    places: DataFrame,
    *,
    categories: list[str] | None = None,
    include_lodging: bool = False,
    min_quality: float = 0.0,
    limit: int = 20,
    reach_m: float = 25_000,
) -> DataFrame:
    """Places within each area's radius, nearest first, at most ``limit`` per area."""
    found = usable(places, min_quality).where(category_filter(categories, include_lodging))
    k = min(max(limit, 1), K.MAX_LIMIT)
    return k_nearest(near_pairs(areas, found, k, reach_m=reach_m), ["area_id"], k)


#: Rings of a search: each is half as wide as the one before; grids for every second one.
RINGS = 8
RING_GRIDS = 4


def ring_reach(areas: DataFrame, points: DataFrame, k: int, reach_m: float) -> DataFrame:
    """(alat, alon, radius_m, _ring_m): the narrowest ring around each area that surely holds ``k`` points.

    Points are counted by fine cell once and added up for the wider rings; a ring holds at least what
    lies in cells whole inside it. Areas without such a ring have no row.
    """
    spots = areas.select("alat", "alon", "radius_m").distinct()
    fine = Grid.for_radius(reach_m / 2**RINGS / 4)
    cells = points.groupBy(fine.row("lat").alias("_row"), fine.column("lon").alias("_column")).agg(F.count(F.lit(1)).alias("_n"))
    grids = [Grid.for_radius(reach_m / 2**ring / 4) for ring in range(1, RINGS + 1)]
    wider = [grid.key(F.shiftright("_row", fine.bits - grid.bits), F.shiftright("_column", fine.bits - grid.bits)) for grid in grids]
    counts = cells.select("_n", F.posexplode(F.array(*wider)).alias("_ring", "_cell")).groupBy("_ring", "_cell").agg(F.sum("_n").alias("_n"))
    rings = F.posexplode(F.array(*[F.struct(F.lit(reach_m / 2 ** (n + 1)).alias("m"), GridOfRow.named(grid).alias("grid")) for n, grid in enumerate(grids)])).alias("_ring", "_r")
    around = spots.select("*", rings).where(F.col("radius_m") > F.col("_r.m"))
    cover = covering_cells(around, GridOfRow(F.col("_r.grid")), "alat", "alon", F.col("_r.m")).where("_whole")
    inside = cover.withColumn("_ring_m", F.col("_r.m")).drop("_r")
    held = inside.join(counts, ["_ring", "_cell"]).groupBy("alat", "alon", "radius_m", "_ring_m").agg(F.sum("_n").alias("_n"))
    return held.where(F.col("_n") >= k).groupBy("alat", "alon", "radius_m").agg(F.min("_ring_m").alias("_ring_m"))


def near_pairs(areas: DataFrame, points: DataFrame, k: int, *, reach_m: float, hot_rows: int | None = None) -> DataFrame:
    """Pairs among which each area's ``k`` nearest are: those within its narrowest ring, not all within its radius.

    A ring goes on for the tenth of a metre that distances are rounded to. Of the points on one spot
    only the ``k`` with the smallest ids can be among the nearest. An area meets points through a
    grid of about its ring's width, so a crowded place costs a small multiple of ``k``.
    """
    rings = ring_reach(areas, points, k, reach_m)
    reach = F.least(F.col("radius_m").cast("double"), F.coalesce(F.col("_ring_m") + 0.1, F.col("radius_m").cast("double")))
    around = areas.join(rings, ["alat", "alon", "radius_m"], "left").withColumn("_near_m", reach).drop("_ring_m")
    radii = [reach_m / 4**n for n in range(RING_GRIDS)]
    grids = [Grid.for_radius(radius) for radius in radii]
    grid_of = reduce(lambda n, r: F.when(F.col("_near_m") <= r[1], r[0]).otherwise(n), enumerate(radii), F.lit(0))
    dealt = around.withColumn("_grid", grid_of).withColumn("_g", F.element_at(F.array(*map(GridOfRow.named, grids)), F.col("_grid") + 1))
    cover = covering_cells(dealt, GridOfRow(F.col("_g")), "alat", "alon", F.col("_near_m")).drop("_whole", "_g")
    on_spot = Window.partitionBy("lat", "lon").orderBy("id")
    first = points.withColumn("_nth", F.row_number().over(on_spot)).where(F.col("_nth") <= k).drop("_nth")
    keyed = first.select("*", F.posexplode(F.array(*[grid.cell("lat", "lon") for grid in grids])).alias("_grid", "_cell"))
    pairs = split_join(keyed, cover, ["_grid", "_cell"], ["lat", "lon"], hot_rows=hot_rows).drop("_grid", "_cell")
    return pairs.withColumn("distance_m", haversine_m("alat", "alon", "lat", "lon")).where(F.col("distance_m") <= F.col("_near_m")).drop("_near_m")


def k_nearest(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` closest rows per key; the rank filter is applied before the shuffle too."""
    order = Window.partitionBy(*keys).orderBy(F.round("distance_m", 1), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_services(rows: DataFrame, catalogue: DataFrame, radius_m: float = K.SERVICES_RADIUS_M) -> DataFrame:
    """``rows`` with the number of active food and lodging places around each."""
    services = catalogue.where(F.col("is_active") & F.col("category").isin(*K.SERVICES))
    counted = radius_sums(
        rows, services, radius_m, {"services": F.lit(1)}, reach_m=radius_m, probe_lat="lat", probe_lon="lon"
    )
    return counted.withColumn("services", F.col("services").cast("int"))


def catalogue_services(places: DataFrame) -> DataFrame:
    """Services around every place; places on the same spot are counted once."""
    spots = with_services(places.select("lat", "lon").distinct(), places)
    return places.join(spots, ["lat", "lon"], "left")


def contending_pairs(
    areas: DataFrame, found: DataFrame, keep: int, groups: tuple[str, ...] = (), *, reach_m: float, hot_rows: int | None = None,
    both_large: bool = False,
) -> DataFrame:
    """Pairs among which the ``keep`` best by quality of each group inside every area are.

    A cell that lies whole inside a circle only sends the qualities that fewer than ``keep`` of its
    rows beat, so most of a crowded cell never reaches the join; the cells on the rim send every row.
    With ``both_large`` there may be as many areas as places, and neither is broadcast.
    """
    grid = Grid.for_radius(reach_m / 4)
    keyed = found.withColumn("_cell", grid.cell("lat", "lon"))
    better = Window.partitionBy("_cell", *groups).orderBy(F.col("quality").desc())
    floors = (
        keyed.groupBy("_cell", *groups, "quality")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_ahead", F.sum("_n").over(better.rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.coalesce(F.col("_ahead"), F.lit(0)) < keep)
        .groupBy("_cell", *groups)
        .agg(F.min("quality").alias("_floor"))
    )
    both, rim = F.array(F.lit(True), F.lit(False)), F.array(F.lit(False))
    offered = (
        keyed.join(floors, ["_cell", *groups])
        .withColumn("_whole", F.explode(F.when(F.col("quality") >= F.col("_floor"), both).otherwise(rim)))
        .drop("_floor")
    )
    cover = covering_cells(areas, grid, "alat", "alon", "radius_m")
    return (
        split_join(offered, cover, ["_cell", "_whole"], ["id"], hot_rows=hot_rows, both_large=both_large)
        .drop("_cell", "_whole")
        .withColumn("distance_m", haversine_m("alat", "alon", "lat", "lon"))
        .where(F.col("distance_m") <= F.col("radius_m"))
    )


def best_per_category(
    areas: DataFrame,
    places: DataFrame,
    *,
    per_category: int = 10,
    categories: list[str] | None = None,
    include_lodging: bool = False,
    min_quality: float = 0.0,
    reach_m: float = 25_000,
    key: str = "area_id",
    hot_rows: int | None = None,
    both_large: bool = False,
) -> DataFrame:
    """The best ``per_category`` places of every category inside each area.

    Areas may carry a ``min_quality`` of their own.
    """
    keep = min(max(per_category, 1), K.MAX_PER_CATEGORY)
    found = usable(places, min_quality).where(category_filter(categories, include_lodging))
    pairs = contending_pairs(areas, found, keep, ("category",), reach_m=reach_m, hot_rows=hot_rows, both_large=both_large)
    if "min_quality" in areas.columns:
        pairs = pairs.where(F.col("quality") >= F.col("min_quality"))
    order = Window.partitionBy(key, "category").orderBy(
        F.col("quality").desc(), F.round("distance_m", 1), "id"
    )
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def search_in_area(areas: DataFrame, places: DataFrame, **options) -> DataFrame:
    """``best_per_category`` with the services around each winner, counted on the winners alone."""
    return with_services(best_per_category(areas, places, **options), places)


def near_a_beach(lodgings: DataFrame, places: DataFrame) -> DataFrame:
    """Lodgings with at least one active beach close by."""
    beaches = places.where(F.col("is_active") & (F.col("subcategory") == "beach"))
    counted = radius_sums(
        lodgings, beaches, K.BEACH_RADIUS_M, {"_beaches": F.lit(1)},
        reach_m=K.BEACH_RADIUS_M, probe_lat="lat", probe_lon="lon",
    )
    return counted.where(F.col("_beaches") > 0).drop("_beaches")


def beach_lodging(areas: DataFrame, places: DataFrame, *, limit: int = 12, reach_m: float = 25_000, key: str = "area_id", both_large: bool = False) -> DataFrame:
    """Lodgings by a beach inside each area, best first, with their services count."""
    lodgings = places.where(F.col("is_active") & (F.col("category") == "lodging"))
    keep = min(max(limit, 1), K.BEACH_LIMIT)
    pairs = contending_pairs(areas, near_a_beach(lodgings, places), keep, reach_m=reach_m, both_large=both_large)
    order = Window.partitionBy(key).orderBy(F.col("quality").desc(), F.round("distance_m", 1), "id")
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return with_services(best, places)


def by_ids(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """Distinct requested ids with their active row; ``missing`` when there is none."""
    active = places.where("is_active").withColumn("_here", F.lit(True))
    return (
        wanted.select("id").distinct().join(active, "id", "left")
        .withColumn("missing", F.col("_here").isNull())
        .drop("_here")
    )


def pair_distance(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Straight-line metres of each distinct (origin, destination)."""
    ends = places.select("id", "lat", "lon")
    start = ends.select(F.col("id").alias("origin"), F.col("lat").alias("_olat"), F.col("lon").alias("_olon"))
    stop = ends.select(F.col("id").alias("destination"), F.col("lat").alias("_dlat"), F.col("lon").alias("_dlon"))
    return (
        pairs.select("origin", "destination").distinct()
        .join(start, "origin").join(stop, "destination")
        .select("origin", "destination", haversine_m("_olat", "_olon", "_dlat", "_dlon").alias("distance_m"))
    )


def names_with_destinations(names: DataFrame, places: DataFrame, *, reach_m: float = K.RADIUS_MAX_KM * 1000) -> DataFrame:
    """Destinations inside each gazetteer name's own radius; too few deactivate the name."""
    destinations = places.where(F.col("is_active") & (F.col("category") != "food"))
    counted = radius_sums(
        names, destinations, "radius_m", {"destinations": F.lit(1)},
        reach_m=reach_m, probe_lat="lat", probe_lon="lon",
    )
    poor = F.col("destinations") < K.NAME_MIN_DESTINATIONS
    return counted.withColumns(
        {"is_active": ~poor, "rejected_reason": F.when(poor, F.lit("pocos_destinos"))}
    )


def zone_table(spark) -> DataFrame:
    rows = [(i, key, name, lat, lon, radius) for i, (key, name, lat, lon, radius, _, _) in enumerate(K.ZONES)]
    return spark.createDataFrame(
        rows, "zone_order int, zone string, zone_name string, alat double, alon double, radius_m int"
    )


def zone_coverage(places: DataFrame) -> DataFrame:
    """Places and destinations inside every curated zone; zones with few are flagged."""
    zones = zone_table(places.sparkSession)
    counted = radius_sums(
        zones, places.where("is_active"), "radius_m",
        {
            "places": F.lit(1),
            "destinations": F.when(F.col("category").isin(*K.SERVICES), 0).otherwise(1),
        },
        reach_m=25_000,
    )
    return counted.select(
        "zone", "radius_m", "places", "destinations",
        (F.col("destinations") < K.ZONE_MIN_DESTINATIONS).alias("review"),
    )


def appeal_of(subcategory) -> Column:
    """How worth a visit a subcategory is."""
    column = F.col(subcategory) if isinstance(subcategory, str) else subcategory
    return F.coalesce(F.try_element_at(literal_map(K.APPEAL), F.coalesce(column, F.lit(""))), F.lit(K.APPEAL_DEFAULT))


def top_by_appeal(areas: DataFrame, places: DataFrame, n: int = 20, *, key: str = "area_id", reach_m: float = 25_000) -> DataFrame:
    """Per area: the 3n best by quality, then the n best of those by appeal."""
    found = places.where("is_active").where(category_filter())
    pairs = contending_pairs(areas, found, 3 * n, reach_m=reach_m)
    first = Window.partitionBy(key).orderBy(F.col("quality").desc(), "id")
    second = Window.partitionBy(key).orderBy(F.col("appeal").desc(), F.col("quality").desc(), "id")
    return (
        pairs.withColumn("_first", F.row_number().over(first)).where(F.col("_first") <= 3 * n)
        .withColumn("appeal", appeal_of("subcategory"))
        .withColumn("rank", F.row_number().over(second)).where(F.col("rank") <= n)
        .drop("_first")
    )


def appeal_floor(places: DataFrame) -> DataFrame:
    """Food stays; other places need a minimum appeal."""
    return places.where((F.col("category") == "food") | (appeal_of("subcategory") >= K.APPEAL_FLOOR))


def anchorable(places: DataFrame) -> DataFrame:
    """Rows that may be the centre of an area."""
    return places.where(~F.col("category").isin(*K.NOT_ANCHORABLE))


def coordinate_field(places: DataFrame) -> DataFrame:
    """Every active point in four decimals."""
    return places.where("is_active").select(F.bround("lat", 4).alias("lat"), F.bround("lon", 4).alias("lon"))
