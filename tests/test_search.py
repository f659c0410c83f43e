import math
import random

from pyspark.sql import functions as F

from trailgrid.constants import APPEAL as G_APPEAL
from trailgrid.functions import geo as G
from trailgrid.operators import search as S
from trailgrid.operators.range_join import radius_pairs, radius_sums

PLACES = "id long, name string, category string, subcategory string, lat double, lon double, quality double, is_active boolean"
SEED = [
    (1, "Museo", "culture", "museum", 13.6929, -89.2182, 0.8, True),
    (2, "Parque", "nature", "park", 13.6950, -89.2182, 0.7, True),
    (3, "Mirador", "viewpoint", "viewpoint", 13.7000, -89.2182, 0.9, True),
    (4, "Hotel", "lodging", "hotel", 13.6930, -89.2182, 0.9, True),
    (5, "Lejos", "nature", "volcano", 14.1900, -89.2182, 0.9, True),
    (6, "Otro museo", "culture", "museum", 13.6940, -89.2182, 0.6, True),
    (7, "Apagado", "culture", "museum", 13.6929, -89.2182, 1.0, False),
]


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def _areas(spark, radius=5_000):
    return spark.createDataFrame([(1, 13.6929, -89.2182, radius)], "area_id int, alat double, alon double, radius_m int")


def test_radius_order_and_lodging(spark):
    places = spark.createDataFrame(SEED, PLACES)
    rows = S.search_nearby(_areas(spark), places).orderBy("rank").collect()
    assert [r.id for r in rows] == [1, 6, 2, 3]
    everything = S.search_nearby(_areas(spark), places, include_lodging=True).collect()
    assert 4 in {r.id for r in everything} and 5 not in {r.id for r in everything}


def test_quota_per_category(spark):
    places = spark.createDataFrame(SEED, PLACES)
    rows = S.search_in_area(_areas(spark), places, per_category=1).collect()
    assert {r.id for r in rows} == {1, 2, 3}
    assert {r.services for r in rows} == {1}


def test_counts_and_pairs_match_brute_force_with_split_cells(spark):
    rng = random.Random(7)
    points = [(i, 13.5 + rng.random() * 0.1, -89.2 + rng.random() * 0.1) for i in range(400)]
    points += [(1000 + i, 13.55, -89.15) for i in range(200)]  # a third on one spot
    probes = [(i, 13.5 + rng.random() * 0.1, -89.2 + rng.random() * 0.1, 500 + rng.random() * 4000) for i in range(30)]
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    q = spark.createDataFrame(probes, "probe long, alat double, alon double, radius double")
    expected = {}
    for probe, a, b, r in probes:
        expected[probe] = {i for i, c, d in points if km(a, b, c, d) * 1000 <= r}
    for hot in (None, 10):
        sums = radius_sums(q, p, "radius", {"n": F.lit(1)}, reach_m=5_000, hot_rows=hot).collect()
        assert {r.probe: r.n for r in sums} == {k: len(v) for k, v in expected.items()}
        pairs = radius_pairs(q, p, "radius", reach_m=5_000, spread=["id"], hot_rows=hot).collect()
        found = {k: set() for k in expected}
        for r in pairs:
            assert r.id not in found[r.probe]
            found[r.probe].add(r.id)
        assert found == expected


def test_best_per_category_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [
        (i, f"p{i}", rng.choice(["nature", "culture"]), "x", 13.6 + rng.random() * 0.2, -89.3 + rng.random() * 0.2,
         round(0.4 + 0.1 * rng.randrange(5), 1), True)
        for i in range(500)
    ]
    areas = [(k, 13.6 + rng.random() * 0.2, -89.3 + rng.random() * 0.2, 4_000 + 1_000 * k) for k in range(6)]
    a = spark.createDataFrame(areas, "area_id int, alat double, alon double, radius_m int")
    places = spark.createDataFrame(rows, PLACES)
    expected = set()
    for area, la, lo, r in areas:
        for c in ("nature", "culture"):
            inside = [(-x[6], round(km(la, lo, x[4], x[5]) * 1000, 1), x[0]) for x in rows if x[2] == c and km(la, lo, x[4], x[5]) * 1000 <= r]
            expected |= {(area, i) for _, _, i in sorted(inside)[:3]}
    for hot in (None, 5):
        best = S.best_per_category(a, places, per_category=3, reach_m=10_000, hot_rows=hot).collect()
        assert {(r.area_id, r.id) for r in best} == expected


def test_detour_of_zone_country_and_floor(spark):
    rows = spark.createDataFrame([(13.6929, -89.2182), (13.0, -87.0), (14.3167, -89.1667)], "lat double, lon double")
    factors = [r.f for r in rows.select(G.detour_factor("lat", "lon").alias("f")).collect()]
    assert factors == [1.36, 1.53, 2.19]


def test_missing_end_has_no_distance(spark):
    row = spark.sql("SELECT 13.0D AS a, -89.0D AS b, CAST(NULL AS DOUBLE) AS c").select(G.haversine_km("a", "b", "c", "b").alias("km")).first()
    assert row.km is None


def test_k_nearest_meets_few_points_of_a_crowd(spark):
    rng = random.Random(21)
    places = [(i, 13.4 + rng.random() * 0.4, -89.4 + rng.random() * 0.4) for i in range(600)]
    places += [(1000 + i, 13.6 + rng.random() * 0.002, -89.2 + rng.random() * 0.002) for i in range(1500)]
    places += [(5000 - i, 13.61, -89.21) for i in range(900)]
    places += [(6000 + i, 13.61 + 1e-7 * i, -89.21) for i in range(20)]
    areas = [(1, 13.6005, -89.1995, 25_000), (2, 13.61, -89.21, 20_000), (3, 13.45, -89.35, 9_000), (4, 13.45, -89.35, 300), (5, 10.0, -80.0, 25_000), (6, 13.6005, -89.1995, 30)]
    points = spark.createDataFrame([(i, "x", "nature", "park", a, b, 0.9, True) for i, a, b in places], PLACES)
    asked = spark.createDataFrame(areas, "area_id int, alat double, alon double, radius_m int")
    k, want, everything = 7, {}, 0
    for n, a, b, r in areas:
        near = sorted((round(km(a, b, c, d) * 1000, 1), i) for i, c, d in places if km(a, b, c, d) * 1000 <= r)
        everything += len(near)
        want[n] = [i for _, i in near[:k]]
    for hot in (None, 50):
        met = S.near_pairs(asked, points, k, reach_m=25_000, hot_rows=hot)
        assert met.count() < 25 * k * len(areas) < everything / 4
    got = {}
    for r in S.search_nearby(asked, points, limit=k).orderBy("area_id", "rank").collect():
        got.setdefault(r.area_id, []).append(r.id)
    assert got == {n: ids for n, ids in want.items() if ids}


def test_a_crowded_cell_sends_only_what_can_win(spark):
    rng = random.Random(23)
    places = [(i, "x", "lodging" if i % 3 else "nature", "beach" if i % 3 == 0 else "hotel", 13.6 + rng.random() * 0.01, -89.2 + rng.random() * 0.01, round(rng.random(), 2), True) for i in range(1200)]
    places += [(2000 + i, "y", "lodging", "hotel", 13.3 + rng.random() * 0.6, -89.5 + rng.random() * 0.6, round(rng.random(), 2), True) for i in range(200)]
    areas = [(1, 13.61, -89.19, 20_000), (2, 13.6, -89.2, 900), (3, 13.9, -89.6, 25_000), (4, 13.605, -89.195, 12_000)]
    points, asked = spark.createDataFrame(places, PLACES), spark.createDataFrame(areas, "area_id int, alat double, alon double, radius_m int")
    inside = {n: [p for p in places if km(a, b, p[4], p[5]) * 1000 <= r] for n, a, b, r in areas}
    pairs = S.contending_pairs(asked, points, 6, reach_m=25_000)
    assert pairs.count() < sum(map(len, inside.values())) / 2
    best = {n: sorted((p for p in held if p[2] != "lodging"), key=lambda p: (-p[6], p[0]))[:6] for n, held in inside.items()}
    want = {n: {p[0] for p in sorted(held, key=lambda p: (-G_APPEAL.get(p[3], 0.25), -p[6], p[0]))[:2]} for n, held in best.items()}
    got = {n: set() for n in want}
    for r in S.top_by_appeal(asked, points, n=2).collect():
        got[r.area_id].add(r.id)
    assert got == want
    beaches = [p for p in places if p[3] == "beach"]
    by_beach = {p[0] for p in places if p[2] == "lodging" and any(km(p[4], p[5], q[4], q[5]) <= 2.5 for q in beaches)}
    for n, a, b, _ in areas:
        near = sorted((p for p in inside[n] if p[0] in by_beach), key=lambda p: (-p[6], round(km(a, b, p[4], p[5]) * 1000, 1), p[0]))[:5]
        best[n] = [p[0] for p in near]
    met = {n: [] for n in best}
    for r in S.beach_lodging(asked, points, limit=5).orderBy("area_id", "rank").collect():
        met[r.area_id].append(r.id)
    assert met == best
