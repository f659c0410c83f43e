"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrid.session import checkpointed


EDGES_PER_PART = 100_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest node of each component as its name.

    Alternates two star steps until no edge changes: every node first hands its larger, then
    its smaller neighbours to the smallest node it knows. Each step is one minimum per node
    (combined before the shuffle) and one join, and a hub's neighbours are never gathered in
    one row. Every round is checkpointed to the shared folder, in as many parts as the edges
    need, so that rounds over few edges don't write many empty files.
    """
    current = checkpointed(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    signature = _signature(current)
    parts = signature[0] // EDGES_PER_PART + 1
    current = current.coalesce(parts)
    while signature[0]:
        large = _star(current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v"))), "v > u").coalesce(parts)
        current = checkpointed(_star(large, None).coalesce(parts))
        before, signature = signature, _signature(current)
        if signature == before:
            break
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = members.select(F.col("component").alias("node"), "component")
    return members.unionByName(roots).distinct()


def _star(edges: DataFrame, keep: str | None) -> DataFrame:
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = edges.join(least, "u")
    moved = (joined.where(keep) if keep else joined).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep is None:
        moved = moved.unionByName(joined.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.shiftright(F.xxhash64("v", "u"), 32)).alias("s"),
    ).first()
    return tuple(row)
