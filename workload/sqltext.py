"""Pieces of DuckDB SQL shared by the twins."""

from __future__ import annotations

from trailgrid import constants as K


def hav_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"({2 * K.EARTH_RADIUS_KM}e0*asin(sqrt((sin(radians({lat2} - {lat1})/2)*sin(radians({lat2} - {lat1})/2)"
        f" + cos(radians({lat1}))*cos(radians({lat2}))*sin(radians({lon2} - {lon1})/2)*sin(radians({lon2} - {lon1})/2)))))"
    )


def hav_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"({hav_km(lat1, lon1, lat2, lon2)}*1000)"


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows, alias: str) -> str:
    """A VALUES relation: ``(VALUES ...) alias(cols)``."""
    def one(v):
        return text(v) if isinstance(v, str) or v is None else f"{v}e0" if isinstance(v, float) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows) + f") {alias}"


def lookup(table: dict, column: str, default: str = "NULL") -> str:
    """A CASE that maps ``column`` through a constant table."""
    def one(v):
        return text(v) if isinstance(v, str) else f"{v}e0" if isinstance(v, float) else str(v)

    whens = " ".join(f"WHEN {one(k)} THEN {one(v)}" for k, v in table.items())
    return f"(CASE {column} {whens} ELSE {default} END)"


ZONES = values(
    [(i, key, name, lat, lon, radius) for i, (key, name, lat, lon, radius, _, _) in enumerate(K.ZONES)],
    "z(zone_order, zone, zone_name, alat, alon, radius_m)",
)
DETOURS = values([tuple(float(v) for v in row) for row in K.DETOUR_BY_ZONE], "d(zlat, zlon, zkm, factor)")
COAST = values([(float(lat), float(lon)) for lon, lat in K.COAST], "c(clat, clon)")


SHARE_CODE = f"list_aggregate(list_transform(range(0, 10), lambda i: substr({text(K.SHARE_ALPHABET)}, CAST(CAST('0x' || substr(sha256(CAST(plan_id AS VARCHAR)), 4*i + 1, 4) AS INT) % {len(K.SHARE_ALPHABET)} AS INT) + 1, 1)), 'string_agg', '')"


def in_list(items) -> str:
    return "(" + ", ".join(text(i) for i in items) + ")"


def trigrams(expr: str) -> str:
    """Ordered trigrams, repeats kept, of the words of ``expr``."""
    return (
        f"flatten(list_transform(regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}]+'), "
        f"lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"
    )


def jaccard(a: str, b: str) -> str:
    """Jaccard of two trigram lists, 0 when either is empty."""
    inter = f"len(list_intersect({a}, {b}))"
    return (
        f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE {inter}::DOUBLE / "
        f"(len(list_distinct({a})) + len(list_distinct({b})) - {inter}) END)"
    )


def fold(expr: str) -> str:
    return f"translate(lower({expr}), {text(K.ACCENTED)}, {text(K.UNACCENTED)})"


def fit(q: str, t: str) -> str:
    """Best Jaccard of list ``q`` with any contiguous run of list ``t``, by trying every run."""
    run = f"{t}[i:j]"
    return (
        f"coalesce(list_max(list_transform(range(1, len({t}) + 1), lambda i: list_max(list_transform(range(i, len({t}) + 1), "
        f"lambda j: len(list_intersect({q}, {run}))::DOUBLE / (len(list_distinct({q})) + len(list_distinct({run})) - "
        f"len(list_intersect({q}, {run}))))))), 0e0)"
    )


def plain(expr: str) -> str:
    """Lower case without diacritics."""
    return f"lower(strip_accents({expr}))"


def words(expr: str) -> str:
    """Significant words of a name."""
    empty = ", ".join(text(w) for w in K.EMPTY_WORDS)
    return (
        f"list_distinct(list_filter(regexp_extract_all({plain(expr)}, '[\\p{{L}}\\p{{N}}]+'), "
        f"lambda w: NOT list_contains([{empty}], w)))"
    )


ZONE_ALIASES = values(
    [
        (order, key, name, alias, flag)
        for order, (key, name, _, _, _, aliases, whole) in enumerate(K.ZONES)
        for flag, alias in (
            [(1, a) for a in whole] + [(0, a) for a in dict.fromkeys((name.lower(), key.replace("-", " "), *aliases))]
        )
    ],
    "za(zone_order, zone, zone_name, alias, whole)",
)
