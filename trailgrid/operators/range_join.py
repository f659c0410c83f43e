"""Joins and counts by distance, turned into equi-joins on grid cells.

The probe side is exploded to the cells its circle touches; the point side carries exactly
one cell, so a pair meets once. Counts use whole cells where the circle covers them and
exact distances only on the rim.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid.functions.geo import EARTH_M, Grid, GridOfRow, _col, haversine_m
from trailgrid.operators.skew import split_join

#: Grids of ``radius_sums`` for circles of their own radius: each for circles this much narrower, and the cells in one.
SUM_GRIDS, SUM_STEP, SUM_CELLS = 5, 2, 8


def covering_cells(probes: DataFrame, grid: Grid, lat: str, lon: str, radius_m) -> DataFrame:
    """One row per probe and cell its circle may touch; ``_whole`` when it covers the cell."""
    angle = _col(radius_m) / EARTH_M
    half_lat = F.degrees(angle)
    half_lon = F.degrees(
        F.asin(F.least(F.lit(1.0), F.sin(angle) / F.greatest(F.cos(F.radians(_col(lat))), F.lit(1e-9))))
    )
    slack = 1e-9
    rows = F.sequence(grid.row(_col(lat) - half_lat - slack), grid.row(_col(lat) + half_lat + slack))
    columns = F.sequence(
        grid.column(_col(lon) - half_lon - slack), grid.column(_col(lon) + half_lon + slack)
    )
    cells = (
        probes.withColumn("_row", F.explode(rows))
        .withColumn("_column", F.explode(columns))
        .withColumn("_cell", grid.key(F.col("_row"), F.col("_column")))
    )
    south = F.col("_row") * grid.step - 90.0
    west = F.col("_column") * grid.step - 180.0
    corners = [
        haversine_m(lat, lon, south + dy, west + dx) for dy in (0.0, grid.step) for dx in (0.0, grid.step)
    ]
    limit = _col(radius_m) * (1.0 - 1e-9)
    return cells.withColumn("_whole", F.greatest(*corners) <= limit).drop("_row", "_column")


def radius_pairs(
    probes: DataFrame,
    points: DataFrame,
    radius_m,
    *,
    reach_m: float,
    probe_lat: str = "alat",
    probe_lon: str = "alon",
    lat: str = "lat",
    lon: str = "lon",
    spread: list[str] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Every (probe, point) pair at most ``radius_m`` apart, with ``distance_m``.

    ``radius_m`` is a number or a probe column, ``reach_m`` the radius the grid is sized for.
    Column names of both sides must differ.
    """
    grid = Grid.for_radius(reach_m)
    cover = covering_cells(probes, grid, probe_lat, probe_lon, radius_m).drop("_whole")
    keyed = points.withColumn("_cell", grid.cell(lat, lon))
    pairs = split_join(keyed, cover, ["_cell"], spread or [lat, lon], hot_rows=hot_rows).drop("_cell")
    distance = haversine_m(probe_lat, probe_lon, lat, lon)
    return pairs.withColumn("distance_m", distance).where(F.col("distance_m") <= _col(radius_m))


def radius_sums(
    probes: DataFrame,
    points: DataFrame,
    radius_m,
    measures: dict[str, Column],
    *,
    reach_m: float,
    probe_lat: str = "alat",
    probe_lon: str = "alon",
    lat: str = "lat",
    lon: str = "lon",
    hot_rows: int | None = None,
) -> DataFrame:
    """The probe rows, each with the sum of every measure over the points within its radius.

    Points are summed per coordinate and per cell before the join, so a pile of rows on one
    spot, or a crowded cell inside the circle, is one row. Probes of the same circle are measured
    once. Where the radius is a column, a circle meets points through a grid of about its own
    width, so a small one doesn't look at all that the widest could reach. Neither side is broadcast:
    the work then lies with the cells, not with the few tasks that read the probes.
    """
    own = not isinstance(radius_m, (int, float))
    radii = [reach_m / SUM_STEP**n for n in range(SUM_GRIDS if own else 1)]
    grids = [Grid.for_radius(radius / SUM_CELLS if own else radius / 4) for radius in radii]
    names = list(measures)
    totals = [F.sum(n).alias(n) for n in names]
    circle = [probe_lat, probe_lon, *([radius_m] if isinstance(radius_m, str) else [])]
    circles = probes.withColumn("_radius_m", _col(radius_m)).select(*circle, "_radius_m").distinct()
    spots = (
        points.select(
            _col(lat).alias("_plat"), _col(lon).alias("_plon"), *[c.alias(n) for n, c in measures.items()]
        )
        .groupBy("_plat", "_plon")
        .agg(*totals)
        .select("*", F.posexplode(F.array(*[grid.cell("_plat", "_plon") for grid in grids])).alias("_grid", "_cell"))
    )
    cells = spots.groupBy("_grid", "_cell").agg(*totals)
    nowhere = F.lit(None).cast("double")
    sums = spots.withColumn("_whole", F.lit(False)).unionByName(
        cells.withColumns({"_whole": F.lit(True), "_plat": nowhere, "_plon": nowhere})
    )
    grid_of = reduce(lambda n, r: F.when(F.col("_radius_m") <= r[1], r[0]).otherwise(n), enumerate(radii), F.lit(0))
    dealt = circles.withColumn("_grid", grid_of).withColumn("_g", F.element_at(F.array(*map(GridOfRow.named, grids)), F.col("_grid") + 1))
    cover = covering_cells(dealt, GridOfRow(F.col("_g")), probe_lat, probe_lon, "_radius_m").drop("_g")
    reached = F.col("_whole") | (
        haversine_m(probe_lat, probe_lon, "_plat", "_plon") <= F.col("_radius_m")
    )
    matched = split_join(
        sums, cover, ["_grid", "_cell", "_whole"], ["_plat", "_plon"], how="left", condition=reached, hot_rows=hot_rows,
        both_large=True,
    )
    counted = matched.groupBy(*circle, "_radius_m").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    rows = probes.withColumn("_radius_m", _col(radius_m)).join(counted.hint("merge"), [*circle, "_radius_m"])
    return rows.select(*probes.columns, *names)
