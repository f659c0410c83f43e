"""Distances, travel estimates and grid cells as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid import constants as K

EARTH_M = K.EARTH_RADIUS_KM * 1000.0


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on the mean-radius sphere; null when an end is missing."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * K.EARTH_RADIUS_KM) * F.asin(F.sqrt(F.when(chord > 1.0, 1.0).otherwise(chord)))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000.0


def _half_chord(lat1: str, lon1: str, lat2: float, lon2: float) -> str:
    """SQL of the squared half chord on the unit sphere: grows with the distance."""
    return (
        f"(power(sin(radians({lat2}D - {lat1})/2), 2) + cos(radians({lat1}))*cos(radians({lat2}D))"
        f"*power(sin(radians({lon2}D - {lon1})/2), 2))"
    )


def _zones() -> str:
    """The detour zones as one constant array."""
    rows = [
        f"named_struct('lat', {lat}D, 'lon', {lon}D, 'reach', {math.sin(km / (2 * K.EARTH_RADIUS_KM)) ** 2!r}D, 'factor', {factor}D)"
        for lat, lon, km, factor in K.DETOUR_BY_ZONE
    ]
    return f"array({', '.join(rows)})"


#: Degrees of a cell that knows which zones may cover a point in it.
ZONE_CELL = 0.1


def _zone_cells() -> tuple[float, float, int, int, str]:
    """South and west edge, rows, columns and, row by row, the numbers of the zones that reach into each cell.

    A zone's box is a little wider than the zone, and the outermost cells are empty.
    """
    boxes = []
    for lat, lon, km, _ in K.DETOUR_BY_ZONE:
        tall = math.degrees(km / K.EARTH_RADIUS_KM) * 1.01 + 0.001
        wide = tall / math.cos(math.radians(abs(lat) + tall)) * 1.01
        boxes.append((lat - tall, lat + tall, lon - wide, lon + wide))
    south, west = (round(math.floor(min(b[i] for b in boxes) / ZONE_CELL - 1) * ZONE_CELL, 9) for i in (0, 2))
    rows, columns = (math.ceil((max(b[i] for b in boxes) - edge) / ZONE_CELL) + 1 for i, edge in ((1, south), (3, west)))
    met = lambda at, lo, hi: at <= hi and at + ZONE_CELL >= lo
    cells = [
        [n for n, b in enumerate(boxes) if met(south + r * ZONE_CELL, b[0], b[1]) and met(west + c * ZONE_CELL, b[2], b[3])]
        for r in range(rows) for c in range(columns)
    ]
    return south, west, rows, columns, str(cells).replace(" ", "")


def detour_sql(lat: str, lon: str) -> str:
    """SQL of the road over straight line: the closest zone that covers the point, else the country's.

    A point's cell names the few zones that may cover it, mostly none, so the others cost nothing; the
    table of cells is one constant, so that generated code stays small however often this is used.
    """
    south, west, rows, columns, cells = _zone_cells()
    inside = f"{lat} >= {south}D AND {lat} < {south + rows * ZONE_CELL!r}D AND {lon} >= {west}D AND {lon} < {west + columns * ZONE_CELL!r}D"
    cell = f"cast(floor(({lat} - {south}D)/{ZONE_CELL}D)*{columns} + floor(({lon} - {west}D)/{ZONE_CELL}D) AS int)"
    apart = (
        f"power(sin(radians(z.lat - {lat})/2), 2) + cos(radians({lat}))*cos(radians(z.lat))*power(sin(radians(z.lon - {lon})/2), 2)"
    )
    known = f"get(from_json('{cells}', 'array<array<int>>'), CASE WHEN {inside} THEN {cell} END)"
    near = f"transform({known}, k -> {let_sql(f'get({_zones()}, k)', 'z', f"named_struct('apart', {apart}, 'reach', z.reach, 'factor', z.factor)")})"
    return f"coalesce(array_min(filter({near}, q -> q.apart <= q.reach)).factor, {K.DETOUR_NATIONAL}D)"


def detour_factor(lat: str, lon: str) -> Column:
    return F.expr(detour_sql(lat, lon))


def straight_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL of ``haversine_km``."""
    chord = (
        f"power(sin(radians({lat2} - {lat1})/2), 2) + cos(radians({lat1}))*cos(radians({lat2}))*power(sin(radians({lon2} - {lon1})/2), 2)"
    )
    return f"{2 * K.EARTH_RADIUS_KM}D*asin(sqrt(least(1D, {chord})))"


def let_sql(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def leg_sql(start: str, stop: str) -> str:
    """SQL of the driven struct (km, minutes) between two structs with lat and lon, as ``with_estimate`` gives it."""
    speed = " ".join(f"WHEN g.straight < {limit}D THEN {kmh}D" for limit, kmh in K.SPEED_BANDS[:-1])
    driven = f"cast(greatest(1, bround(g.straight*g.factor/CASE {speed} ELSE {K.SPEED_BANDS[-1][1]}D END*60, 0)) AS int)"
    apart = straight_sql(f"{start}.lat", f"{start}.lon", f"{stop}.lat", f"{stop}.lon")
    factor = detour_sql(f"({start}.lat + {stop}.lat)/2", f"({start}.lon + {stop}.lon)/2")
    leg = f"named_struct('km', bround(g.straight*g.factor, 3), 'minutes', {driven} + {K.ARRIVAL_OVERHEAD_MIN['driving']})"
    return let_sql(f"named_struct('straight', {apart}, 'factor', {factor})", "g", leg)


def speed_kmh(straight_km, mode="driving") -> Column:
    straight_km = _col(straight_km)
    mode = F.lit(mode) if isinstance(mode, str) else mode
    driving = F.lit(K.SPEED_BANDS[-1][1])
    for limit, kmh in reversed(K.SPEED_BANDS[:-1]):
        driving = F.when(straight_km < limit, F.lit(kmh)).otherwise(driving)
    return F.when(mode == "walking", F.lit(K.WALKING_KMH)).otherwise(driving)


def arrival_overhead(mode="driving") -> Column:
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return (
        F.when(mode == "driving", K.ARRIVAL_OVERHEAD_MIN["driving"])
        .when(mode == "walking", K.ARRIVAL_OVERHEAD_MIN["walking"])
        .otherwise(0)
    )


def with_estimate(rows: DataFrame, start: tuple[str, str], stop: tuple[str, str], mode="driving", km: str = "km", minutes: str = "minutes") -> DataFrame:
    """``rows`` with the road km and minutes of a leg nobody measured.

    Minutes include the arrival overhead. The factor is a column of its own, so it is worked
    out once per row.
    """
    (lat1, lon1), (lat2, lon2) = start, stop
    measured = (
        rows.withColumns({
            "_straight": haversine_km(lat1, lon1, lat2, lon2),
            "_mlat": F.expr(f"({lat1} + {lat2}) / 2"), "_mlon": F.expr(f"({lon1} + {lon2}) / 2"),
        })
        .withColumn("_factor", detour_factor("_mlat", "_mlon"))
        .withColumn("_road", F.col("_straight") * F.col("_factor"))
    )
    driven = F.greatest(F.lit(1), F.bround(F.col("_road") / speed_kmh("_straight", mode) * 60, 0).cast("int"))
    return measured.withColumns(
        {km: F.bround("_road", 3), minutes: (driven + arrival_overhead(mode)).cast("int")}
    ).drop("_straight", "_mlat", "_mlon", "_factor", "_road")


def km_to_coast(lat: str, lon: str) -> Column:
    nearest = ", ".join(_half_chord(lat, lon, clat, clon) for clon, clat in K.COAST)
    return F.expr(f"{2 * K.EARTH_RADIUS_KM}D * asin(sqrt(least({nearest})))")


def is_coastal(lat: str, lon: str) -> Column:
    return km_to_coast(lat, lon) <= K.COASTAL_KM


def box_radius_km(minlat, minlon, maxlat, maxlon) -> Column:
    """Half the diagonal of a bounding box."""
    minlat, minlon, maxlat, maxlon = map(_col, (minlat, minlon, maxlat, maxlon))
    height = (maxlat - minlat) * K.KM_PER_DEG_LAT
    width = (maxlon - minlon) * K.KM_PER_DEG_LON * F.cos(F.radians((maxlat + minlat) / 2))
    return F.hypot(height, width) / 2


def inside_area(lat, lon, centre_lat, centre_lon, radius_m) -> Column:
    return haversine_m(lat, lon, centre_lat, centre_lon) <= _col(radius_m)


def literal_map(table: dict) -> Column:
    """A constant table as a map column."""

    def literal(value) -> str:
        if isinstance(value, str):
            return "'" + value.replace("'", "\\'") + "'"
        return f"{value}D" if isinstance(value, float) else str(value)

    return F.expr("map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items()) + ")")


class Grid:
    """A fixed latitude/longitude grid of 2**bits columns around the globe."""

    def __init__(self, bits: int):
        self.bits = bits
        self.columns = 1 << bits
        self.step = 360.0 / self.columns

    @classmethod
    def for_radius(cls, radius_m: float) -> "Grid":
        """The finest grid whose cells are still at least as tall as the radius."""
        bits = 1
        while bits < 22 and 360.0 / (1 << (bits + 1)) * 111_195.0 >= radius_m:
            bits += 1
        return cls(bits)

    def row(self, lat) -> Column:
        return F.floor((_col(lat) + 90.0) / self.step)

    def column(self, lon) -> Column:
        return F.floor((_col(lon) + 180.0) / self.step)

    def key(self, row: Column, column: Column) -> Column:
        return (row * self.columns + F.pmod(column, F.lit(self.columns).cast("long"))).cast("long")

    def cell(self, lat, lon) -> Column:
        return self.key(self.row(lat), self.column(lon))


class GridOfRow(Grid):
    """A grid that each row names itself, by the step and the number of columns it carries."""

    def __init__(self, named: Column):
        self.step, self.columns = named["step"], named["columns"]

    @staticmethod
    def named(grid: Grid) -> Column:
        return F.struct(F.lit(grid.step).alias("step"), F.lit(grid.columns).cast("long").alias("columns"))
