"""Joins, ranks and medians that stay spread over many tasks whatever the keys hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailgrid.session import checkpointed

HOT_ROWS = 500_000


def hot_keys(frame: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of parts to cut them into.

    The count is partial before the shuffle, so a hot key costs one row per map task.
    """
    return (
        frame.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    )


def split_join(
    large: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread: list[str],
    *,
    how: str = "inner",
    condition=None,
    hot_rows: int | None = HOT_ROWS,
    both_large: bool = False,
) -> DataFrame:
    """Join ``small`` to ``large``, cutting the hot keys of ``large`` by a hash of ``spread``.

    Rows of ``small`` are repeated once per part, only for hot keys; with ``how="left"`` every
    row of ``small`` is kept (once per part). The plan is the same at every size. No side carries
    a broadcast hint: Spark broadcasts only below its own size threshold. It guesses sizes from those
    of the files, which compress well; with ``both_large`` neither side is broadcast.
    """
    hot = hot_keys(large, keys, hot_rows or HOT_ROWS)
    part = F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int")
    cut = large.join(hot, keys, "left").withColumn("_part", F.coalesce(part, F.lit(0))).drop("_parts")
    repeated = (
        small.join(hot, keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .drop("_parts")
    )
    return _keyed_join(repeated, cut.hint("merge") if both_large else cut, [*keys, "_part"], how, condition).drop("_part")


RANK_ROWS = 1_000_000


def ranked(rows: DataFrame, groups: list[str], order: list, name: str, per_part: int = RANK_ROWS) -> DataFrame:
    """``rows`` with their place from 1 within ``groups``, however few or large the groups are.

    Rows are sorted by range into parts of about ``per_part``; a row's place is its place in its
    part plus the rows of its group in the parts before, which is one small row per part and
    group. ``order`` must leave no ties.
    """
    parts = rows.count() // per_part + 1
    spread = checkpointed(rows.repartitionByRange(parts, *groups, *order).withColumn("_p", F.spark_partition_id()))
    here = Window.partitionBy("_p", *groups)
    before = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("_p", *groups).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    matched = reduce(lambda on, c: on & F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")), groups, F.col("r._p") == F.col("o._p"))
    placed = spread.withColumn("_i", F.row_number().over(here.orderBy(*order))).alias("r").join(offsets.alias("o"), matched)
    return placed.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("_i") + F.col("_o")).alias(name))


def middle(rows: DataFrame, groups: list[str], value: str, tie: list[str], name: str) -> DataFrame:
    """(groups, name): the exact median of ``value`` in each group, nulls left out."""
    known = rows.where(F.col(value).isNotNull())
    place = ranked(known.select(*groups, value, *tie), groups, [value, *tie], "_place")
    sizes = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    matched = reduce(lambda on, c: on & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")), groups, F.lit(True))
    both = place.alias("r").join(sizes.alias("s"), matched).where(F.col("_place").isin(F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)))
    return both.groupBy(*[F.col(f"r.{c}") for c in groups]).agg(F.avg(value).alias(name))


def _keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, condition) -> DataFrame:
    if condition is None:
        return left.join(right, keys, how)
    renamed = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    on = condition
    for k in keys:
        on = on & (F.col(k) == F.col(f"{k}_r"))
    return left.join(renamed, on, how).drop(*[f"{k}_r" for k in keys])
