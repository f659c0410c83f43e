"""Text functions, name search, duplicates and same-site groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import text as T
from trailgrid.operators import dedupe as D
from trailgrid.operators import names as N
from trailgrid.operators import search as S
from trailgrid.operators.skew import ranked
from workload import sqltext as Q
from workload.base import query

LEG_NAMES = """SELECT DISTINCT a.name AS a, b.name AS b FROM legs_fx l JOIN places_fx a ON a.id = l.origin JOIN places_fx b ON b.id = l.destination"""
BOTH = f"SELECT a, b, {Q.trigrams('a')} AS ga, {Q.trigrams('b')} AS gb FROM ({LEG_NAMES})"


def _leg_names(fx):
    ends = fx.places.select("id", "name")
    return (
        fx.legs.join(ends.withColumnsRenamed({"id": "origin", "name": "a"}), "origin")
        .join(ends.withColumnsRenamed({"id": "destination", "name": "b"}), "destination")
        .select("a", "b").distinct()
    )


@query("txt_1", f"SELECT a, b, round({Q.jaccard('ga', 'gb')}, 6) AS similarity FROM ({BOTH})")
def txt_1(fx):
    return T.with_scores(_leg_names(fx), "a", "b", with_fit=False)


@query("txt_2", f"""
SELECT a, b, round({Q.fit('ga', 'gb')}, 6) AS fit FROM
(SELECT a, b, {Q.trigrams(Q.fold('a'))} AS ga, {Q.trigrams(Q.fold('b'))} AS gb FROM
 (SELECT DISTINCT substr(a, 3) AS a, concat('Centro ', b, ' Viejo') AS b FROM ({LEG_NAMES})))""")
def txt_2(fx):
    pairs = _leg_names(fx).select(
        F.expr("substr(a, 3)").alias("a"), F.concat(F.lit("Centro "), "b", F.lit(" Viejo")).alias("b")
    ).distinct()
    folded = pairs.withColumns({"fa": T.fold("a"), "fb": T.fold("b")})
    return T.with_scores(folded, "fa", "fb", with_fit=True).select("a", "b", "fit")


def _scored(asked: str, name: str, threshold: float, with_fit: bool) -> str:
    """CTEs pairs(asked, name, similarity[, fit]) over every pair of distinct texts."""
    fit_column = f", round({Q.fit('qa.g', 'nb.g')}, 6) AS fit" if with_fit else ""
    keep = f"similarity >= {threshold}" + (f" OR fit >= {threshold}" if with_fit else "")
    return f"""qa AS (SELECT asked, {Q.trigrams('asked')} AS g FROM (SELECT DISTINCT {asked} AS asked FROM queries_fx WHERE {asked} IS NOT NULL)),
nb AS (SELECT name, {Q.trigrams('name')} AS g FROM (SELECT DISTINCT {name} AS name FROM places_fx WHERE is_active)),
pairs AS (SELECT * FROM (SELECT qa.asked, nb.name, round({Q.jaccard('qa.g', 'nb.g')}, 6) AS similarity{fit_column} FROM qa, nb) WHERE {keep})"""


FOLDED = _scored(Q.fold("text"), Q.fold("name"), 0.6, True)
CANDIDATES = f"""{FOLDED},
cand AS (SELECT * FROM (SELECT q.query_id, q.text, p.id, p.name, p.category, similarity, fit,
row_number() OVER (PARTITION BY q.query_id ORDER BY fit DESC, similarity DESC, p.quality DESC, p.id) AS rank
FROM queries_fx q JOIN pairs s ON s.asked = {Q.fold('q.text')} JOIN places_fx p ON p.is_active AND {Q.fold('p.name')} = s.name) WHERE rank <= 8)"""
DECIDED = """decided AS (SELECT query_id, CASE WHEN max(similarity) >= 0.85 THEN arg_max(id, (similarity, -rank))
WHEN max(fit) FILTER (rank = 1) >= 0.95 AND (max(fit) FILTER (rank = 2) IS NULL OR round(max(fit) FILTER (rank = 1) - max(fit) FILTER (rank = 2), 6) >= 0.10)
THEN max(id) FILTER (rank = 1) END AS place_id FROM cand GROUP BY query_id)"""


@query("txt_3", f"WITH {CANDIDATES} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, similarity, fit FROM cand")
def txt_3(fx):
    return N.search_candidates(fx.queries, fx.places).select("query_id", "id", "rank", "similarity", "fit")


@query("txt_4", f"WITH {CANDIDATES}, {DECIDED} SELECT query_id, place_id FROM decided")
def txt_4(fx):
    return N.decide(N.search_candidates(fx.queries, fx.places))


@query("top_3", f"""
WITH {CANDIDATES} SELECT query_id, id, fit, CAST(position AS INTEGER) AS position FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM cand WHERE fit >= 0.80) WHERE position <= 3""")
def top_3(fx):
    return N.suggestions(N.search_candidates(fx.queries, fx.places)).select("query_id", "id", "fit", "position")


RAW = _scored("lower(text)", "lower(name)", 0.3, False)


def _named(limit: int, least: float) -> str:
    return f"""hits AS (SELECT * FROM (SELECT q.query_id, q.text, p.id, p.name, p.category, p.lat, p.lon, similarity,
row_number() OVER (PARTITION BY q.query_id ORDER BY similarity DESC, p.quality DESC, p.id) AS rank
FROM queries_fx q JOIN pairs s ON s.asked = lower(q.text) AND similarity >= {least} JOIN places_fx p ON p.is_active AND lower(p.name) = s.name) WHERE rank <= {limit})"""


@query("top_2", f"WITH {RAW}, {_named(10, 0.3)} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, similarity FROM hits")
def top_2(fx):
    return N.search_by_name(fx.queries, fx.places).select("query_id", "id", "rank", "similarity")


@query("txt_5", f"SELECT doc_id, md5({Q.fold('text')}) AS folded FROM documents")
def txt_5(fx):
    return fx.documents.select("doc_id", F.md5(T.fold("text")).alias("folded"))


@query("txt_6", f"""SELECT doc_id, md5(trim(regexp_replace({Q.plain('text')}, '[^a-z0-9]+', ' ', 'g'))) AS normal FROM documents""")
def txt_6(fx):
    return fx.documents.select("doc_id", F.md5(T.normalise("text")).alias("normal"))


@query("txt_7", f"""SELECT doc_id, len(w) AS words, md5(array_to_string(list_sort(w), ' ')) AS listed FROM (SELECT doc_id, {Q.words('text')} AS w FROM documents)""")
def txt_7(fx):
    words = fx.documents.select("doc_id", T.significant_words("text").alias("w"))
    return words.select(
        "doc_id", F.size("w").cast("long").alias("words"), F.md5(F.array_join(F.array_sort("w"), " ")).alias("listed")
    )


PHRASE = f"trim(regexp_replace({Q.plain('text')}, '\\s+', ' ', 'g'))"
ZONED = f"""zoned AS (SELECT query_id, zone_order, zone, zone_name FROM (SELECT q.query_id, za.*,
row_number() OVER (PARTITION BY query_id ORDER BY whole DESC, length(alias) DESC, zone_order) AS r
FROM queries_fx q JOIN {Q.ZONE_ALIASES} ON CASE whole WHEN 1 THEN {PHRASE} = alias ELSE contains({PHRASE}, alias) END) WHERE r = 1)"""


@query("txt_8", f"WITH {ZONED} SELECT q.query_id, z.zone, z.zone_name FROM queries_fx q LEFT JOIN zoned z USING (query_id)")
def txt_8(fx):
    phrased = fx.queries.withColumn("phrase", T.plain_phrase("text"))
    return phrased.withColumn("z", T.zone_of("phrase")).select("query_id", "z.zone", "z.zone_name")


STRIPPED = f"""stripped AS (SELECT query_id, arg_min(rest, (-length(zn), zone_order)) AS rest FROM (
SELECT query_id, lower(zone_name) AS zn, zone_order, {Q.plain('text')} AS base,
trim(trim(regexp_replace(replace({Q.plain('text')}, lower(zone_name), ' '), '\\s+', ' ', 'g')), ' ,.-') AS rest FROM queries_fx, {Q.ZONES})
WHERE contains(base, zn) AND length(base) > length(zn) + 2 AND length(rest) >= 4 GROUP BY query_id)"""


@query("txt_9", f"WITH {STRIPPED} SELECT q.query_id, s.rest FROM queries_fx q LEFT JOIN stripped s USING (query_id)")
def txt_9(fx):
    base = fx.queries.withColumn("base", T.without_marks("text"))
    return base.select("query_id", T.without_zone("base").alias("rest"))


AREAS_ASKED = """SELECT s_suppkey AS query_id, CASE s_suppkey % 6 WHEN 0 THEN name WHEN 1 THEN concat(substr(name, 1, 5), substr(name, 7)) WHEN 2 THEN 'La Playa'
WHEN 3 THEN concat('quiero ir a Suchitoto y ', name) WHEN 4 THEN 'red widgett' ELSE concat('zzz ', s_name) END AS text FROM (SELECT s.s_suppkey, s.s_name, n.name FROM supplier s JOIN names_fx n ON n.name_id = s.s_suppkey) t"""
NAMES_LIVE = f"""live AS (SELECT n.*, count(p.id) AS destinations FROM names_fx n LEFT JOIN places_fx p ON p.is_active AND p.category <> 'food' AND {Q.hav_m('n.lat', 'n.lon', 'p.lat', 'p.lon')} <= n.radius_m GROUP BY ALL HAVING count(p.id) >= 4)"""
KIND_RANK = Q.lookup({k: i for i, k in enumerate(K.GAZETTEER_ORDER)}, "n.kind", "99")
ASKED = f"asked AS ({AREAS_ASKED})"
GAZETTEER = f"""{ASKED}, {NAMES_LIVE},
ng AS (SELECT name, {Q.trigrams('name')} AS g FROM (SELECT DISTINCT lower(name) AS name FROM live)),
ag AS (SELECT asked, {Q.trigrams('asked')} AS g FROM (SELECT DISTINCT lower(text) AS asked FROM asked)),
gz AS (SELECT * FROM (SELECT a.query_id, n.name_id, n.name, n.lat, n.lon, n.radius_m, round({Q.jaccard('ag.g', 'ng.g')}, 6) AS similarity,
row_number() OVER (PARTITION BY a.query_id ORDER BY round({Q.jaccard('ag.g', 'ng.g')}, 6) DESC, {KIND_RANK}, n.destinations DESC, n.name_id) AS r
FROM asked a JOIN ag ON ag.asked = lower(a.text) JOIN ng ON round({Q.jaccard('ag.g', 'ng.g')}, 6) >= 0.5 JOIN live n ON lower(n.name) = ng.name) WHERE r = 1)"""


def _areas_asked(fx):
    return fx.sql(
        AREAS_ASKED.replace("JOIN names_fx n", "JOIN {names_fx} n").replace("FROM supplier s", "FROM {supplier} s")
    )


def _live_names(fx):
    return S.names_with_destinations(fx.names, fx.places)


@query("txt_10", f"WITH {GAZETTEER} SELECT query_id, name_id, name, similarity FROM gz")
def txt_10(fx):
    return N.gazetteer_lookup(_areas_asked(fx), _live_names(fx)).select("query_id", "name_id", "name", "similarity")


@query("top_4", f"""WITH {GAZETTEER} SELECT name_id, name, count(*) AS picked FROM gz GROUP BY name_id, name""")
def top_4(fx):
    picks = N.gazetteer_lookup(_areas_asked(fx), _live_names(fx))
    return picks.groupBy("name_id", "name").agg(F.count(F.lit(1)).alias("picked"))


AZONED = ZONED.replace("queries_fx", "asked").replace("zoned AS", "azoned AS")


@query("txt_11", f"""
WITH {GAZETTEER}, {AZONED},
pg AS (SELECT name, {Q.trigrams('name')} AS g FROM (SELECT DISTINCT lower(name) AS name FROM places_fx WHERE is_active)),
hits AS (SELECT * FROM (SELECT a.query_id, p.name, p.category, p.lat, p.lon, row_number() OVER (PARTITION BY a.query_id ORDER BY round({Q.jaccard('ag.g', 'pg.g')}, 6) DESC, p.quality DESC, p.id) AS r
 FROM asked a JOIN ag ON ag.asked = lower(a.text) JOIN pg ON round({Q.jaccard('ag.g', 'pg.g')}, 6) >= 0.45 JOIN places_fx p ON p.is_active AND lower(p.name) = pg.name) WHERE r <= 8),
cat AS (SELECT query_id, arg_min(name, r) AS name, arg_min(lat, r) AS lat, arg_min(lon, r) AS lon FROM hits WHERE category NOT IN ('food', 'lodging') GROUP BY query_id)
SELECT a.query_id, coalesce(z.zone_name, g.name, c.name) AS area, round(coalesce(zs.alat, g.lat, c.lat), 6) AS lat, round(coalesce(zs.alon, g.lon, c.lon), 6) AS lon,
CAST(CASE WHEN z.zone IS NOT NULL THEN zs.radius_m WHEN g.name IS NOT NULL THEN g.radius_m WHEN c.name IS NOT NULL THEN 15000 END AS INTEGER) AS radius_m,
CASE WHEN z.zone IS NOT NULL THEN 'zone' WHEN g.name IS NOT NULL THEN 'gazetteer' WHEN c.name IS NOT NULL THEN 'catalog' ELSE 'none' END AS source
FROM asked a LEFT JOIN azoned z USING (query_id) LEFT JOIN (SELECT zone, alat, alon, radius_m FROM {Q.ZONES}) zs ON zs.zone = z.zone
LEFT JOIN gz g ON g.query_id = a.query_id AND z.zone IS NULL LEFT JOIN cat c ON c.query_id = a.query_id AND z.zone IS NULL AND g.name IS NULL""")
def txt_11(fx):
    found = N.resolve_areas(_areas_asked(fx), _live_names(fx), fx.places)
    return found.select("query_id", "area", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "radius_m", "source")


TRIM_PASS = CANDIDATES.replace("queries_fx", "trimq").replace("qa AS", "tqa AS").replace("nb AS", "tnb AS").replace("pairs AS", "tpairs AS").replace(
    "cand AS", "tcand AS").replace("FROM qa, nb", "FROM tqa qa, tnb nb").replace("JOIN pairs s", "JOIN tpairs s")


@query("txt_12", f"""
WITH {STRIPPED}, {CANDIDATES}, {DECIDED}, sure AS (SELECT * FROM decided WHERE place_id IS NOT NULL),
trimq AS (SELECT query_id, rest AS text FROM stripped WHERE query_id NOT IN (SELECT query_id FROM sure)),
{TRIM_PASS}, {DECIDED.replace('decided AS', 'tdecided AS').replace('FROM cand', 'FROM tcand')},
tsure AS (SELECT * FROM tdecided WHERE place_id IS NOT NULL),
passes AS (SELECT 0 AS pass, query_id, id, rank, fit FROM tcand UNION ALL SELECT 1, query_id, id, rank, fit FROM cand),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY pass, rank) AS seen FROM passes) WHERE seen = 1
 AND query_id NOT IN (SELECT query_id FROM sure) AND query_id NOT IN (SELECT query_id FROM tsure)),
offer AS (SELECT query_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pass, rank) AS suggested FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pass, rank) AS position FROM firsts WHERE fit >= 0.80) WHERE position <= 3 GROUP BY query_id)
SELECT q.query_id, coalesce(s.place_id, t.place_id) AS place_id, CASE WHEN s.place_id IS NOT NULL THEN 'whole' WHEN t.place_id IS NOT NULL THEN 'trimmed'
WHEN o.suggested IS NOT NULL THEN 'suggestions' ELSE 'none' END AS found_by, o.suggested
FROM queries_fx q LEFT JOIN sure s USING (query_id) LEFT JOIN tsure t USING (query_id) LEFT JOIN offer o USING (query_id)""")
def txt_12(fx):
    return N.resolve_places(fx.queries, fx.places).select(
        "query_id", "place_id", "found_by",
        F.array_join(F.transform("suggested", lambda i: i.cast("string")), ",").alias("suggested"),
    )


@query("set_4", f"""
WITH {STRIPPED}, {CANDIDATES}, trimq AS (SELECT query_id, rest AS text FROM stripped), {TRIM_PASS},
passes AS (SELECT 0 AS pass, query_id, id, rank FROM tcand UNION ALL SELECT 1, query_id, id, rank FROM cand)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pass, rank) AS INTEGER) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY pass, rank) AS seen FROM passes) WHERE seen = 1""")
def set_4(fx):
    trimmed = N.search_trimmed(fx.queries, fx.places).withColumn("pass", F.lit(0))
    whole = N.search_candidates(fx.queries, fx.places).withColumn("pass", F.lit(1))
    return N.first_of_each(trimmed.unionByName(whole)).select("query_id", "id", "rank")


@query("txt_13", f"""
WITH {RAW}, {_named(5, 0.3)}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM hits WHERE contains(lower(name), lower(trim(text))))
SELECT query_id, max(id) FILTER (n = 1) AS place_id, coalesce(string_agg(name, ', ' ORDER BY n) FILTER (n BETWEEN 2 AND 3), '') AS others FROM kept GROUP BY query_id""")
def txt_13(fx):
    return N.strict_pick(fx.queries, fx.places)


STOP_ASKED = "SELECT plan_id, CASE plan_id % 3 WHEN 0 THEN name WHEN 1 THEN substr(name, 1, 4) ELSE 'RED' END AS text FROM days_fx WHERE day = 1 AND ord = 1"


@query("txt_14", f"""
SELECT a.plan_id, a.text, coalesce(max(s.name) FILTER (lower(trim(s.name)) = lower(trim(a.text))),
CASE WHEN count(DISTINCT s.name) FILTER (contains(lower(trim(s.name)), lower(trim(a.text)))) = 1 THEN max(s.name) FILTER (contains(lower(trim(s.name)), lower(trim(a.text)))) END) AS stop
FROM ({STOP_ASKED}) a JOIN days_fx s USING (plan_id) GROUP BY a.plan_id, a.text""")
def txt_14(fx):
    asked = fx.sql(STOP_ASKED.replace("days_fx", "{days_fx}"))
    return N.match_stop(asked, fx.days.select("plan_id", "name"), ["plan_id"])


SHOWN = "SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN upper(name) WHEN 1 THEN concat('  ', name, '  II.,') WHEN 2 THEN concat(upper(name), ' DE LA SV TV') WHEN 3 THEN 'ISEADE-FEPADE' WHEN 4 THEN '...' ELSE concat('LOS ', upper(name), '   Y DON X2;:') END AS name FROM (SELECT name_id AS s_suppkey, name FROM names_fx) t"


@query("txt_15", f"""
WITH raw AS ({SHOWN}), clean AS (SELECT id, name, regexp_replace(trim(regexp_replace(name, '\\s+', ' ', 'g')), '[.,;:]+$', '') AS c FROM raw)
SELECT id, coalesce(nullif(CASE WHEN len(string_split(c, ' ')) > 1 AND c = upper(c) THEN array_to_string(list_transform(string_split(c, ' '), lambda w, i:
CASE WHEN i > 1 AND list_contains([{', '.join(Q.text(w) for w in K.CONNECTORS)}], lower(w)) THEN lower(w)
WHEN i > 1 AND regexp_full_match(w, '[\\p{{L}}]{{2,3}}') AND NOT regexp_matches(w, '[AEIOU]') THEN w
ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') ELSE c END, ''), name) AS shown FROM clean""")
def txt_15(fx):
    raw = fx.sql(SHOWN.replace("names_fx", "{names_fx}"))
    return raw.select("id", T.display_name("name").alias("shown"))


VAGUE = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN concat('Mirador ', CAST(p_size AS VARCHAR(9))) WHEN 1 THEN concat('Cerro ', p_name) WHEN 2 THEN concat('PEÑA  ', CAST(p_size*11 AS VARCHAR(9))) WHEN 3 THEN 'Plaza' ELSE p_name END AS name FROM part"


@query("txt_16", f"""
WITH v AS (SELECT id, string_split(lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))), ' ') AS w FROM ({VAGUE}))
SELECT id, coalesce(len(w) = 2 AND list_contains([{', '.join(Q.text(w) for w in K.GENERIC_HEADS)}], w[1]) AND regexp_full_match(w[2], '\\d{{1,2}}'), false) AS vague FROM v""")
def txt_16(fx):
    return fx.sql(VAGUE.replace("FROM part", "FROM {part}")).select("id", T.is_vague_name("name").alias("vague"))


@query("txt_17", """
SELECT id, CASE WHEN id % 3 = 0 THEN concat('grupo:', CAST(id % 50 AS VARCHAR)) ELSE lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) END AS key FROM places_fx""")
def txt_17(fx):
    grouped = fx.places.withColumn("same_place_as", F.when(F.col("id") % 3 == 0, F.col("id") % 50))
    return grouped.select("id", T.same_site_key("name", "same_place_as").alias("key"))


PARTS = "list_transform(string_split(replace(cuisine, ',', ';'), ';'), lambda p: replace(lower(trim(p)), ' ', '_'))"
SPECIFIC = "[" + ", ".join(Q.text(c) for c in K.CUISINES if c not in K.GENERIC_CUISINES) + "]"


@query("txt_18", f"""
WITH t AS (SELECT id, {PARTS} AS p, CASE id % 3 WHEN 0 THEN 'burger' WHEN 1 THEN 'regional' END AS preferred FROM tags_fx)
SELECT id, {Q.lookup(K.CUISINES, "(coalesce(CASE WHEN list_contains(p, preferred) THEN preferred END, list_filter(p, lambda x: list_contains(" + SPECIFIC + ", x))[1], list_filter(p, lambda x: x IN ('regional', 'local'))[1]))")} AS label FROM t""")
def txt_18(fx):
    preferred = F.when(F.col("id") % 3 == 0, F.lit("burger")).when(F.col("id") % 3 == 1, F.lit("regional"))
    return fx.tags.select("id", T.cuisine_label("cuisine", preferred).alias("label"))


@query("txt_19", f"SELECT id, coalesce(list_contains({PARTS}, 'regional'), false) AS regional, coalesce(list_contains({PARTS}, 'coffee_shop'), false) AS coffee FROM tags_fx")
def txt_19(fx):
    return fx.tags.select(
        "id", T.serves_cuisine("cuisine", F.lit("regional")).alias("regional"),
        T.serves_cuisine("cuisine", F.lit("coffee_shop")).alias("coffee"),
    )


@query("txt_20", """
SELECT id, nullif(trim(string_split(replace(coalesce(nullif(phone, ''), nullif(contact_phone, '')), ',', ';'), ';')[1]), '') AS phone,
nullif(trim(string_split(coalesce(nullif(website, ''), NULL), ';')[1]), '') AS website FROM tags_fx""")
def txt_20(fx):
    return fx.tags.select(
        "id", T.contact("phone", "contact_phone", phone=True).alias("phone"),
        T.contact("website", F.lit(None).cast("string"), phone=False).alias("website"),
    )


@query("txt_21", """
WITH t AS (SELECT id, round_even(TRY_CAST(replace(trim(regexp_replace(lower(trim(ele)), 'm$', '')), ',', '.') AS DOUBLE), 0) AS m FROM tags_fx)
SELECT id, CASE WHEN m BETWEEN 0 AND 2800 THEN CAST(m AS INTEGER) END AS elevation_m FROM t""")
def txt_21(fx):
    return fx.tags.select("id", T.elevation_m("ele").alias("elevation_m"))


@query("join_1", f"""
WITH c AS (SELECT id, name, lower(name) AS lname, category, lat, lon, quality, CASE WHEN rejected_reason = 'duplicado' OR rejected_reason IS NULL THEN true ELSE false END AS live FROM sites_fx),
n AS (SELECT lname, {Q.trigrams('lname')} AS g FROM (SELECT DISTINCT lname FROM c WHERE live)),
cl AS (SELECT c.*, n.g FROM c JOIN n USING (lname) WHERE live),
lost AS (SELECT a.id, arg_max(b.id, (b.quality, b.id)) AS duplicate_of FROM cl a JOIN cl b ON (b.quality, b.id) > (a.quality, a.id)
 AND abs(a.lat - b.lat) < 0.01e0 AND abs(a.lon - b.lon) < 0.01e0
 AND {Q.hav_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= CASE WHEN a.category IN ('nature', 'viewpoint') THEN 500 ELSE 150 END
 AND round({Q.jaccard('a.g', 'b.g')}, 6) >= 0.55 GROUP BY a.id)
SELECT s.id, c.live AND l.id IS NULL AS is_active, CASE WHEN l.id IS NOT NULL THEN 'duplicado' WHEN s.rejected_reason <> 'duplicado' THEN s.rejected_reason END AS rejected_reason, l.duplicate_of
FROM sites_fx s JOIN c USING (id) LEFT JOIN lost l ON l.id = s.id""")
def join_1(fx):
    return D.deduplicate(fx.sites).select("id", "is_active", "rejected_reason", "duplicate_of")


SITE_WORDS = f"""w AS (SELECT id, quality, lat, lon, {Q.words('name')} AS ws FROM sites_fx WHERE is_active),
df AS (SELECT word, count(*) AS names FROM (SELECT unnest(ws) AS word FROM w) GROUP BY word),
rare AS (SELECT word FROM df WHERE names <= greatest(3, round_even((SELECT count(*) FROM w)*0.001e0, 0))),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM w a JOIN w b ON len(a.ws) < len(b.ws) AND abs(a.lat - b.lat) < 0.03e0 AND abs(a.lon - b.lon) < 0.03e0
 AND len(list_intersect(a.ws, b.ws)) = len(a.ws) AND {Q.hav_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 1500
 AND len(list_intersect(a.ws, (SELECT list(word) FROM rare))) > 0)"""


@query("join_2", f"WITH {SITE_WORDS} SELECT na.node AS a, nb.node AS b FROM pairs p JOIN (SELECT id, min(id) OVER (PARTITION BY list_sort(ws), lat, lon) AS node FROM w) na ON na.id = p.a JOIN (SELECT id, min(id) OVER (PARTITION BY list_sort(ws), lat, lon) AS node FROM w) nb ON nb.id = p.b GROUP BY 1, 2")
def join_2(fx):
    return D.same_site_pairs(fx.sites)


@query("join_3", f"""
WITH RECURSIVE {SITE_WORDS}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y)
SELECT r.x AS id, arg_max(w.id, (w.quality, w.id)) AS same_place_as FROM (SELECT x, y FROM reach UNION SELECT x, x FROM e) r JOIN w ON w.id = r.y GROUP BY r.x""")
def join_3(fx):
    return D.same_site_groups(fx.sites)


@query("top_5", f"""
WITH RECURSIVE {SITE_WORDS}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
g AS (SELECT r.x AS id, arg_max(w.id, (w.quality, w.id)) AS head FROM (SELECT x, y FROM reach UNION SELECT x, x FROM e) r JOIN w ON w.id = r.y GROUP BY r.x)
SELECT head, count(*) AS members FROM g GROUP BY head""")
def top_5(fx):
    groups = D.same_site_groups(fx.sites)
    return groups.groupBy(F.col("same_place_as").alias("head")).agg(F.count(F.lit(1)).alias("members"))


@query("agg_4", f"SELECT word, count(*) AS names FROM (SELECT unnest({Q.words('text')}) AS word FROM documents) GROUP BY word")
def agg_4(fx):
    return D.word_frequency(fx.documents, "text")


@query("top_1", "SELECT id, CAST(row_number() OVER (PARTITION BY category ORDER BY quality DESC, CAST(id AS VARCHAR)) AS INTEGER) AS position FROM places_fx WHERE is_active")
def top_1(fx):
    rows = S.usable(fx.places).select("id", "category", F.col("quality").alias("q"), F.col("id").cast("string").alias("key"))
    return ranked(rows, ["category"], [F.col("q").desc(), "key"], "position").select("id", F.col("position").cast("int").alias("position"))
