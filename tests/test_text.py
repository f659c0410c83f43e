import random

import pytest
from pyspark.sql import functions as F

from trailgrid.functions import quality as Q
from trailgrid.functions import text as T
from trailgrid.operators import dedupe as D
from trailgrid.operators import names as N
from trailgrid.operators.components import connected_components

PLACES = "id long, name string, category string, lat double, lon double, quality double, is_active boolean, rejected_reason string, duplicate_of long"


@pytest.mark.parametrize("a,b,similarity,fit", [
    ("Multiplaza", "Centro Comercial Multiplaza", None, 1.0),
    ("Las Cascadas", "7 cascadas", 0.64, 0.75),
    ("Las Cascadas", "Centro Comercial Las Cascadas", 0.44, 1.0),
    ("Volcan de Sant Ana", "Volcan de Santa Ana", 0.86, None),
    ("Parque El Imposible", "Parque Nacional El Imposible", 0.69, None),
])
def test_published_scores(spark, a, b, similarity, fit):
    row = T.with_scores(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b", with_fit=True).first()
    if similarity is not None:
        assert round(row.similarity, 2) == similarity
    if fit is not None:
        assert round(row.fit, 2) == fit


@pytest.mark.parametrize("raw,shown", [
    ("COMIDA A LA VISTA Y PUPUSERIA.", "Comida a La Vista y Pupuseria"),
    ("ISEADE-FEPADE", "ISEADE-FEPADE"),
    ("CANAL  SV DON", "Canal SV Don"),
    ("Café, ", "Café"),
])
def test_display_name(spark, raw, shown):
    assert spark.createDataFrame([(raw,)], "n string").select(T.display_name("n")).first()[0] == shown


@pytest.mark.parametrize("phrase,zone", [
    ("la playa", "la-libertad"), ("quiero ir a Suchitoto", "suchitoto"), ("playa el tunco", "el-tunco"),
    ("la playa de El Cuco", None), ("Ruta de las Flores", "ataco"), ("Juayúa", "juayua"),
])
def test_zone(spark, phrase, zone):
    row = spark.createDataFrame([(phrase,)], "t string").select(T.plain_phrase("t").alias("p")).select(T.zone_of("p").alias("z")).first()
    assert (row.z.zone if row.z else None) == zone


@pytest.mark.parametrize("tags,reason", [
    ({"name": "", "tourism": "museum"}, "sin_nombre"), ({"name": "ab", "tourism": "museum"}, "nombre_muy_corto"),
    ({"name": "Mirador", "tourism": "viewpoint"}, "nombre_generico"), ({"name": "Letrero de Sonsonate"}, "no_es_destino"),
    ({"name": "Lunes a Viernes 800 a 1700", "amenity": "cafe"}, "nombre_es_horario"),
    ({"name": "Cerro Santo Domingo", "natural": "peak"}, None), ({"name": "1234567", "amenity": "cafe"}, "nombre_sin_letras"),
    ({"name": "3a Calle Poniente", "amenity": "cafe"}, "no_es_destino"), ({"name": "Banco Central", "amenity": "bank"}, "categoria_no_soportada"),
    ({"name": "Hotel Plaza", "building": "hotel"}, None), ({"name": "Edificio Plaza", "building": "hotel"}, "categoria_no_soportada"),
])
def test_verdict(spark, tags, reason):
    frame = spark.createDataFrame([(tags,)], "tags map<string,string>")
    assert frame.select(Q.rejection(F.col("tags"))).first()[0] == reason


def _places(spark, rows):
    return spark.createDataFrame([(*r, True, None, None) for r in rows], PLACES)


DEDUPE = [
    (1, "Cascadas de Huizucar", "nature", 13.6000, -89.2000, 0.5),
    (2, "Cascadas de Huizúcar", "nature", 13.6020, -89.2000, 0.7),
    (3, "Cascadas de Huizucar", "nature", 13.9000, -89.2000, 0.6),
    (4, "Café Central", "food", 13.7000, -89.1000, 0.5),
    (5, "Café Central", "food", 13.7020, -89.1000, 0.9),
    (6, "Tienda Uno", "food", 13.7100, -89.1000, 0.5),
    (7, "Tienda Uno", "food", 13.7108, -89.1000, 0.6),
    (8, "Tienda Uno", "food", 13.7116, -89.1000, 0.7),
]


@pytest.mark.parametrize("crowded", [None, 1])
def test_duplicates(spark, crowded):
    pairs = {r.id: r.duplicate_of for r in D.duplicate_pairs(_places(spark, DEDUPE), crowded).collect()}
    # outdoors merges at 220 m and 180 m apart in a town does not; a chain leaves its best row
    assert pairs == {1: 2, 6: 7, 7: 8}


def test_dedupe_is_idempotent(spark):
    once = D.deduplicate(_places(spark, DEDUPE))
    again = D.deduplicate(once.select(*PLACES.replace(" long", "").replace(" string", "").replace(" double", "").replace(" boolean", "").split(", ")))
    key = lambda f: sorted((r.id, r.is_active, r.duplicate_of) for r in f.collect())
    assert key(once) == key(again)


@pytest.mark.parametrize("crowded", [None, 3])
def test_copies_are_compared_once(spark, crowded):
    rng = random.Random(5)
    rows = [(i, "Pupuseria Lety", "food", 13.7, -89.2, 0.5) for i in range(60)]
    rows += [(100 + i, rng.choice(["Pupuseria Lety", "Pupuseria Letty", "Cafe"]), "food", 13.7 + rng.random() * 0.003, -89.2, 0.4 + 0.1 * rng.randrange(4)) for i in range(30)]
    pairs = D.duplicate_pairs(_places(spark, rows), crowded).collect()
    plain = D.duplicate_pairs(_places(spark, rows)).collect()
    assert sorted(map(tuple, pairs)) == sorted(map(tuple, plain)) and len(pairs) >= 59


def test_same_site_needs_containment_and_a_rare_word(spark):
    rows = [
        (1, "Parque El Imposible", "nature", 13.83, -89.99, 0.5), (2, "Parque Nacional El Imposible", "nature", 13.831, -89.99, 0.8),
        (3, "Bahia Dorada", "nature", 13.2, -88.9, 0.5), (4, "Bahia Del Sol", "nature", 13.2005, -88.9, 0.5),
        (5, "Cerro Nubes", "nature", 14.0, -89.0, 0.5), (6, "Cerro de Nubes", "nature", 14.0, -89.0, 0.6),
    ]
    groups = {r.id: r.same_place_as for r in D.same_site_groups(_places(spark, rows)).collect()}
    assert groups == {1: 2, 2: 2}


def test_components_match_union_find(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(500, 500 + k) for k in range(1, 40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: root(x) for x in parent}


def test_name_decision(spark):
    names = ["Centro Comercial Multiplaza", "Museo de Arte", "Museo del Ferrocarril", "Volcán de Santa Ana", "Galerias", "Galerias Express Pollo"]
    places = spark.createDataFrame(
        [(i, n, "attraction", 0.5, True) for i, n in enumerate(names)], "id long, name string, category string, quality double, is_active boolean"
    )
    asked = ["Multiplaza", "Museo", "Volcan de Sant Ana", "zzzz"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    picked = {r.query_id: r.place_id for r in N.decide(N.search_candidates(queries, places)).collect()}
    assert picked == {0: 0, 1: None, 2: 3}
