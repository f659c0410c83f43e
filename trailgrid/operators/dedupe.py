"""Duplicates and groups of rows that are the same site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrid import constants as K
from trailgrid.functions import text as T
from trailgrid.functions.geo import Grid, haversine_m
from trailgrid.operators.components import connected_components
from trailgrid.operators.names import gram_spread, name_grams, rarest_grams
from trailgrid.operators.range_join import covering_cells
from trailgrid.operators.skew import hot_keys, split_join


def reset_duplicates(places: DataFrame) -> DataFrame:
    """Undo earlier duplicate marks; rows the quality filter rejected stay out."""
    marked = F.col("duplicate_of").isNotNull() | (F.col("rejected_reason") == "duplicado")
    quality_ok = F.col("rejected_reason").isNull() | (F.col("rejected_reason") == "duplicado")
    marked = F.coalesce(marked, F.lit(False))
    return places.withColumns(
        {
            "is_active": F.when(marked, quality_ok).otherwise(F.col("is_active")),
            "rejected_reason": F.when(marked, F.nullif(F.col("rejected_reason"), F.lit("duplicado"))).otherwise(
                F.col("rejected_reason")
            ),
            "duplicate_of": F.lit(None).cast(places.schema["duplicate_of"].dataType),
        }
    )


CROWDED = 2_000


def duplicate_pairs(places: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(id, duplicate_of): each active row that a better row with a similar name nearby beats.

    Copies share one node per (name, point), which knows the best row on it, so a pile of
    copies is compared once. Nodes meet in a grid cell; in a cell with more than ``crowded``
    nodes they also need one of the loser's rarest trigrams in common. The radius is the
    loser's: wider outdoors.
    """
    active = places.where("is_active").select(
        "id", "quality", "lat", "lon", F.lower("name").alias("name"),
        F.when(F.col("category").isin(*K.OUTDOOR), K.DEDUPE_OUTDOOR_M).otherwise(K.DEDUPE_URBAN_M).alias("radius_m"),
    )
    grid = Grid.for_radius(K.DEDUPE_OUTDOOR_M)
    winners = (
        active.groupBy("name", "lat", "lon").agg(F.max(F.struct("quality", "id")).alias("best"))
        .select(
            F.col("name").alias("other"), F.col("lat").alias("wlat"), F.col("lon").alias("wlon"), "best",
            grid.cell("lat", "lon").alias("_cell"), F.array_distinct(T.trigrams("name")).alias("wgrams"),
        )
    )
    # the least row of a node decides whether any row of it can lose to a given winner
    losers = active.groupBy("name", "lat", "lon", "radius_m").agg(F.min(F.struct("quality", "id")).alias("worst"))
    cover = (
        covering_cells(losers, grid, "lat", "lon", "radius_m").drop("_whole")
        .withColumn("grams", F.array_distinct(T.trigrams("name")))
    )
    winners, cover = _split_crowded(winners, cover, crowded)
    first_meeting = (F.col("gram") == "") | (F.col("gram") == F.array_min(F.array_intersect("rare", "wgrams")))
    met = (
        split_join(winners, cover, ["_cell", "gram"], ["wlat", "wlon"])
        .where((F.col("best") > F.col("worst")) & (haversine_m("lat", "lon", "wlat", "wlon") <= F.col("radius_m")))
        .where(first_meeting)
        .where(F.round(T.similarity(F.col("grams"), F.col("wgrams")), 6) >= K.DEDUPE_SIMILARITY)
    )
    beaten = met.groupBy("name", "lat", "lon", "radius_m").agg(F.max("best").alias("best"))
    return (
        active.join(beaten, ["name", "lat", "lon", "radius_m"])
        .where(F.col("best") > F.struct("quality", "id"))
        .select("id", F.col("best.id").alias("duplicate_of"))
    )


def _split_crowded(winners: DataFrame, cover: DataFrame, crowded: int) -> tuple[DataFrame, DataFrame]:
    """Give both sides a ``gram`` key: empty in ordinary cells, a trigram in crowded ones."""
    crowds = hot_keys(winners, ["_cell"], crowded).select("_cell", F.lit(True).alias("_crowd"))
    names = winners.select(F.col("other").alias("name"))
    rare = (
        rarest_grams(names.withColumnRenamed("name", "asked"), gram_spread(name_grams(names)), K.DEDUPE_SIMILARITY)
        .groupBy("asked").agg(F.collect_set("gram").alias("rare")).withColumnRenamed("asked", "name")
    )
    ordinary = F.array(F.lit(""))
    crowd = F.coalesce(F.col("_crowd"), F.lit(False))
    split_winners = winners.join(crowds, "_cell", "left").withColumn(
        "gram", F.explode(F.when(crowd, F.col("wgrams")).otherwise(ordinary))
    )
    split_cover = (
        cover.join(crowds, "_cell", "left").join(rare, "name", "left")
        .withColumn("gram", F.explode(F.when(crowd, F.col("rare")).otherwise(ordinary)))
    )
    return split_winners.drop("_crowd"), split_cover.drop("_crowd")


def deduplicate(places: DataFrame) -> DataFrame:
    """The catalogue with duplicates switched off and pointing at their winner."""
    clean = reset_duplicates(places).drop("duplicate_of")
    lost = F.col("duplicate_of").isNotNull()
    return (
        clean.join(duplicate_pairs(clean), "id", "left")
        .withColumn("is_active", F.col("is_active") & ~lost)
        .withColumn("rejected_reason", F.when(lost, F.lit("duplicado")).otherwise(F.col("rejected_reason")))
    )


def word_frequency(names: DataFrame, column: str = "name") -> DataFrame:
    """(word, names): in how many rows each significant word appears."""
    return (
        names.select(F.explode(T.significant_words(column)).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("names"))
    )


def rare_words(names: DataFrame, column: str = "name") -> DataFrame:
    """Words in at most max(3, 0.1 %) of the rows."""
    rows = names.agg(F.count(F.lit(1)).alias("_rows"))
    limit = F.greatest(F.lit(K.RARE_WORD_MIN), F.bround(F.col("_rows") * K.RARE_WORD_SHARE, 0))
    return word_frequency(names, column).join(F.broadcast(rows), F.col("names") <= limit).select("word", "names")


def same_site_nodes(places: DataFrame) -> DataFrame:
    """One node per word set and point, named by its smallest id."""
    words = F.array_sort(T.significant_words("name"))
    return (
        places.where("is_active").withColumn("words", words).where(F.size("words") > 0)
        .groupBy("words", "lat", "lon").agg(F.min("id").alias("node"))
    )


def same_site_pairs(places: DataFrame) -> DataFrame:
    """(a, b) node pairs nearby where one name holds all words of the other and a rare one.

    The rare word belongs to the shorter name, hence to both: it is the join key next to the
    cell, ahead of any distance.
    """
    active = places.where("is_active")
    nodes = same_site_nodes(places)
    rare = rare_words(active).select("word")
    keyed = split_join(nodes.withColumn("word", F.explode("words")), rare, ["word"], ["node"], both_large=True)
    grid = Grid.for_radius(K.SAME_SITE_M)
    short = covering_cells(
        keyed.select("word", F.col("node").alias("a"), F.col("words").alias("few"), F.col("lat").alias("alat"), F.col("lon").alias("alon")),
        grid, "alat", "alon", F.lit(K.SAME_SITE_M),
    ).drop("_whole")
    long = keyed.withColumn("_cell", grid.cell("lat", "lon")).withColumnRenamed("node", "b")
    return (
        split_join(long, short, ["_cell", "word"], ["lat", "lon"], both_large=True)
        .where(
            (F.size("few") < F.size("words")) & (F.size(F.array_except("few", "words")) == 0)
            & (haversine_m("alat", "alon", "lat", "lon") <= K.SAME_SITE_M)
        )
        .select("a", "b").distinct()
    )


def same_site_groups(places: DataFrame) -> DataFrame:
    """(id, same_place_as) for every row of a group; the best row represents it."""
    active = places.where("is_active")
    groups = connected_components(same_site_pairs(places))
    words = F.array_sort(T.significant_words("name"))
    nodes = same_site_nodes(places).withColumnsRenamed({"lat": "_lat", "lon": "_lon", "words": "_words"})
    # a catalogue that compresses well looks small enough to broadcast: neither side is
    members = (
        active.withColumn("words", words)
        .join(nodes.hint("merge"), (F.col("words") == F.col("_words")) & (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")))
        .join(groups.hint("merge"), "node").select("id", "quality", "component")
    )
    heads = members.groupBy("component").agg(F.max(F.struct("quality", "id"))["id"].alias("same_place_as"))
    return members.join(heads.hint("merge"), "component").select("id", "same_place_as")
