"""Typo-tolerant name search for whole tables of queries.

Scores are computed once per pair of distinct texts. A query only meets the names that hold
one of its rarest trigrams; since a match shares a known share of the query's trigrams, that
loses no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import text as T
from trailgrid.operators.skew import split_join
from trailgrid.session import checkpointed


def rarest_grams(asked: DataFrame, spread: DataFrame, threshold: float) -> DataFrame:
    """(asked, gram): the rarest trigrams of each text, as many as any match must hit once.

    ``spread`` is (gram, _names); trigrams no name has need no row.
    """
    wanted = (
        asked.select("asked").distinct()
        .withColumn("_grams", F.array_distinct(T.trigrams("asked")))
        .select("asked", F.size("_grams").alias("_n"), F.explode("_grams").alias("gram"))
        .join(spread, "gram", "left")
    )
    rarest = Window.partitionBy("asked").orderBy(F.coalesce("_names", F.lit(0)), "gram")
    enough = F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9) + 1
    return (
        wanted.withColumn("_rank", F.row_number().over(rarest))
        .where((F.col("_rank") <= enough) & F.col("_names").isNotNull())
        .select("asked", "gram")
    )


def name_grams(names: DataFrame) -> DataFrame:
    return names.select("name").distinct().select("name", F.explode(F.array_distinct(T.trigrams("name"))).alias("gram"))


def gram_spread(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_names"))


def trigram_pairs(asked: DataFrame, names: DataFrame, threshold: float, *, with_fit: bool) -> DataFrame:
    """(asked, name, similarity[, fit]) of every pair that reaches ``threshold`` on either score.

    ``asked`` and ``names`` hold one text column of that name.
    """
    grams = name_grams(names)
    probes = rarest_grams(asked, gram_spread(grams), threshold)
    pairs = split_join(grams, probes, ["gram"], ["name"]).select("asked", "name").distinct()
    scored = T.with_scores(pairs, "asked", "name", with_fit=with_fit, at_least=threshold)
    reached = F.col("similarity") >= threshold
    if with_fit:
        reached = reached | (F.col("fit") >= threshold)
    return scored.where(reached)


def _best_rows_per_name(places: DataFrame, name: Column, keep: int) -> DataFrame:
    """Namesakes beyond the limit of a result list can never be listed."""
    order = Window.partitionBy("_name").orderBy(F.col("quality").desc(), "id")
    return (
        places.withColumn("_name", name)
        .withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= keep).drop("_row")
    )


def _ranked(queries: DataFrame, asked: Column, places: DataFrame, name: Column, threshold: float, limit: int, with_fit: bool) -> DataFrame:
    asked_rows = queries.withColumn("_asked", asked).where(F.col("_asked").isNotNull())
    rows = _best_rows_per_name(places.where("is_active"), name, limit)
    pairs = trigram_pairs(
        asked_rows.select(F.col("_asked").alias("asked")), rows.select(F.col("_name").alias("name")),
        threshold, with_fit=with_fit,
    ).withColumnsRenamed({"asked": "_asked", "name": "_name"})
    scores = ["fit", "similarity"] if with_fit else ["similarity"]
    order = Window.partitionBy("_asked").orderBy(*[F.col(s).desc() for s in scores], F.col("quality").desc(), "id")
    top = (
        pairs.join(rows, "_name")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        .drop("_name")
    )
    return asked_rows.join(top, "_asked").drop("_asked")


def search_by_name(queries: DataFrame, places: DataFrame, *, limit: int = 10, min_similarity: float = K.NAME_SIMILARITY) -> DataFrame:
    """The most similar names per query; accents count."""
    limit = min(max(limit, 1), K.MAX_LIMIT)
    return _ranked(queries, F.lower("text"), places, F.lower("name"), min_similarity, limit, False)


def search_candidates(queries: DataFrame, places: DataFrame, *, text: Column | None = None, limit: int = K.CANDIDATE_LIMIT) -> DataFrame:
    """The places a query may mean, by whole-name similarity or by fit inside the name."""
    asked = T.fold(text if text is not None else F.col("text"))
    return _ranked(queries, asked, places, T.fold("name"), K.CANDIDATE_SIMILARITY, limit, True)


def search_trimmed(queries: DataFrame, places: DataFrame) -> DataFrame:
    """Candidates of the queries that name a zone, searched without that name."""
    base = queries.withColumn("_base", T.without_marks("text"))
    trimmed = base.withColumn("_rest", T.without_zone("_base")).where(F.col("_rest").isNotNull())
    return search_candidates(trimmed, places, text=F.col("_rest")).drop("_base", "_rest")


def decide(candidates: DataFrame) -> DataFrame:
    """(query_id, place_id): a nearly equal name wins; else the best fit if clearly ahead."""
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    summary = candidates.groupBy("query_id").agg(
        F.max("similarity").alias("_sim"),
        F.max_by("id", F.struct("similarity", -F.col("rank"))).alias("_nearest"),
        at(1, "id").alias("_first"), at(1, "fit").alias("_fit1"), at(2, "fit").alias("_fit2"),
    )
    ahead = F.col("_fit2").isNull() | (F.round(F.col("_fit1") - F.col("_fit2"), 6) >= K.FIT_LEAD)
    picked = F.when(F.col("_sim") >= K.NEARLY_EXACT, F.col("_nearest")).when(
        (F.col("_fit1") >= K.FIT_MIN) & ahead, F.col("_first")
    )
    return summary.select("query_id", picked.alias("place_id"))


def suggestions(candidates: DataFrame, limit: int = 3) -> DataFrame:
    """The first candidates that fit well enough to be offered."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        candidates.where(F.col("fit") >= K.FIT_SUGGEST)
        .withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    )


def first_of_each(passes: DataFrame) -> DataFrame:
    """Candidates of several passes in order, every place once per query."""
    seen = Window.partitionBy("query_id", "id").orderBy("pass", "rank")
    return (
        passes.withColumn("_seen", F.row_number().over(seen)).where(F.col("_seen") == 1).drop("_seen")
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pass", "rank")))
    )


def resolve_places(queries: DataFrame, places: DataFrame) -> DataFrame:
    """Per query: the place it means, else the same without its zone name, else suggestions."""
    whole = checkpointed(search_candidates(queries, places))
    sure = decide(whole).where(F.col("place_id").isNotNull())
    open_ = queries.join(sure, "query_id", "left_anti")
    trimmed = checkpointed(search_trimmed(open_, places))
    second = decide(trimmed).where(F.col("place_id").isNotNull())
    settled = sure.withColumn("found_by", F.lit("whole")).unionByName(second.withColumn("found_by", F.lit("trimmed")))
    passes = trimmed.withColumn("pass", F.lit(0)).unionByName(whole.withColumn("pass", F.lit(1)))
    offered = suggestions(first_of_each(passes.join(settled, "query_id", "left_anti")))
    lists = offered.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda s: s["id"]).alias("suggested")
    )
    return (
        queries.join(settled, "query_id", "left").join(lists, "query_id", "left")
        .withColumn("found_by", F.coalesce("found_by", F.when(F.col("suggested").isNotNull(), F.lit("suggestions")), F.lit("none")))
    )


def gazetteer_lookup(queries: DataFrame, names: DataFrame) -> DataFrame:
    """The active gazetteer name each query means: similarity, then the more specific kind."""
    rank = F.create_map(*[F.lit(v) for i, kind in enumerate(K.GAZETTEER_ORDER) for v in (kind, i)])
    active = names.where("is_active").withColumn("_specific", F.coalesce(F.try_element_at(rank, "kind"), F.lit(99)))
    per_name = Window.partitionBy("_name").orderBy("_specific", F.col("destinations").desc(), "name_id")
    rows = (
        active.withColumn("_name", F.lower("name"))
        .withColumn("_row", F.row_number().over(per_name)).where(F.col("_row") == 1).drop("_row")
    )
    asked = queries.withColumn("_asked", F.lower("text"))
    pairs = trigram_pairs(
        asked.select(F.col("_asked").alias("asked")), rows.select(F.col("_name").alias("name")),
        K.GAZETTEER_SIMILARITY, with_fit=False,
    ).withColumnsRenamed({"asked": "_asked", "name": "_name"})
    order = Window.partitionBy("_asked").orderBy(
        F.col("similarity").desc(), "_specific", F.col("destinations").desc(), "name_id"
    )
    top = pairs.join(rows, "_name").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1)
    return asked.join(top.drop("_rank", "_name", "_specific"), "_asked").drop("_asked")


def resolve_areas(queries: DataFrame, names: DataFrame, places: DataFrame) -> DataFrame:
    """Where each phrase points: a curated zone, a gazetteer name, a catalogue place, or nowhere."""
    phrased = queries.withColumn("_phrase", T.plain_phrase("text"))
    by_zone = phrased.withColumn("_zone", T.zone_of("_phrase")).drop("_phrase")
    centres = F.create_map(
        *[
            v for key, _, lat, lon, radius, _, _ in K.ZONES
            for v in (F.lit(key), F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"), F.lit(radius).alias("radius_m")))
        ]
    )
    centre = F.try_element_at(centres, F.coalesce(F.col("_zone.zone"), F.lit("")))
    zoned = by_zone.where(F.col("_zone").isNotNull()).select(
        "query_id", "text", F.col("_zone.zone_name").alias("area"), centre["lat"].alias("lat"),
        centre["lon"].alias("lon"), centre["radius_m"].alias("radius_m"), F.lit("zone").alias("source"),
    )
    rest = by_zone.where(F.col("_zone").isNull()).drop("_zone")
    named = checkpointed(gazetteer_lookup(rest, names)).select(
        "query_id", "text", F.col("name").alias("area"), "lat", "lon",
        F.col("radius_m").cast("int").alias("radius_m"), F.lit("gazetteer").alias("source"),
    )
    left = rest.join(named, "query_id", "left_anti")
    hits = search_by_name(left, places, limit=8, min_similarity=K.ANCHOR_SIMILARITY).where(
        ~F.col("category").isin(*K.NOT_ANCHORABLE)
    )
    first = Window.partitionBy("query_id").orderBy("rank")
    placed = hits.withColumn("_first", F.row_number().over(first)).where(F.col("_first") == 1).select(
        "query_id", "text", F.col("name").alias("area"), "lat", "lon",
        F.lit(K.DEFAULT_AREA_RADIUS_M).alias("radius_m"), F.lit("catalog").alias("source"),
    )
    found = zoned.unionByName(named).unionByName(placed)
    return queries.select("query_id", "text").join(found.drop("text"), "query_id", "left").withColumn(
        "source", F.coalesce("source", F.lit("none"))
    )


def strict_pick(queries: DataFrame, places: DataFrame) -> DataFrame:
    """The best similar place whose name contains the text; up to two others as a note."""
    hits = search_by_name(queries, places, limit=5).where(
        F.contains(F.lower("name"), F.lower(F.trim("text")))
    )
    order = Window.partitionBy("query_id").orderBy("rank")
    ranked = hits.withColumn("_n", F.row_number().over(order))
    return ranked.groupBy("query_id").agg(
        F.max(F.when(F.col("_n") == 1, F.col("id"))).alias("place_id"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("_n").between(2, 3), F.struct("_n", "name")))),
                lambda s: s["name"],
            ), ", ",
        ).alias("others"),
    )


def match_stop(asked: DataFrame, stops: DataFrame, keys: list[str]) -> DataFrame:
    """The stop of the same plan a text names: the exact name, else the only one that contains it."""
    pairs = asked.join(stops, keys)
    key, name = F.lower(F.trim("text")), F.lower(F.trim("name"))
    exact = F.max(F.when(name == key, F.col("name")))
    holds = F.contains(name, key)
    named = F.countDistinct(F.when(holds, name))
    return pairs.groupBy(*keys, "text").agg(
        F.coalesce(exact, F.when(named == 1, F.max(F.when(holds, F.col("name"))))).alias("stop")
    )
