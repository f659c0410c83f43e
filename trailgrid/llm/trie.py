"""Prefix trie of conversations: equal ones collapse to weighted sequences, whose prefixes are the nodes."""

from __future__ import annotations

import hashlib
from itertools import groupby
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgrid.operators.skew import split_join
from trailgrid.session import checkpointed

PART_ROWS = 200_000
NODE = ["depth", "ka", "kb"]
GROUP = 5
HEADS = 9


def scanned(rows: DataFrame, group: str, order: list[str], totals: dict[str, tuple[Column, str]], part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with running totals from the first row of each ``group`` to the own one.

    ``totals`` gives a column and "sum" or "bit_xor" by name. Rows are sorted by range into parts of
    about ``part_rows``, a group may span many of them: what lies in the parts before is one small
    row per part and group. Rows that tie in ``order`` must be alike.
    """
    make = {"sum": F.sum, "bit_xor": F.bit_xor}
    parts = rows.count() // part_rows + 1
    spread = checkpointed(rows.repartitionByRange(parts, group, *order).withColumn("_p", F.spark_partition_id()))
    here = Window.partitionBy("_p", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("_p", group).agg(*[make[how](c).alias(f"_{n}") for n, (c, how) in totals.items()])
    before = sizes.select(
        F.col("_p").alias("_q"), F.col(group).alias("_g"), F.count(F.lit(1)).over(earlier).alias("_parts"),
        *[make[how](f"_{n}").over(earlier).alias(f"_{n}") for n, (_, how) in totals.items()],
    ).where("_parts > 0").drop("_parts")
    local = spread.select("*", *[make[how](c).over(here).alias(n) for n, (c, how) in totals.items()])
    joined = local.join(before, (F.col("_p") == F.col("_q")) & (F.col(group) == F.col("_g")), "left")
    add = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    whole = {n: add[how](F.col(n), F.coalesce(F.col(f"_{n}"), F.lit(0))) for n, (_, how) in totals.items()}
    return joined.withColumns(whole).select(*rows.columns, *totals)


def turn_rows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, role, digest, size) of every turn, places from 0; texts are hashed where they lie.

    A null turn comes first; turns of equal number go by role, then by the text's SHA-256. Null role
    and text are empty. Rows without a conversation belong to none and are left out.
    """
    told = F.coalesce(F.col(text), F.lit(""))
    light = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.unhex(F.sha2(told.cast("binary"), 256)).alias("digest"), F.octet_length(told).cast("long").alias("size"),
    )
    placed = scanned(light, "conv", ["turn", "role", "digest"], {"pos": (F.lit(1).cast("long"), "sum")})
    return placed.select("conv", (F.col("pos") - 1).alias("pos"), "role", "digest", "size")


def branched(rows: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) once every conversation starts like the first of its group.

    Conversation c takes the first h turns of c - c % ``group`` (all if fewer, none if absent), then
    its own after its first h; h is the CRC-32 of its decimal number modulo ``heads``. ``turns`` is
    as from :func:`turn_rows`; a conversation that comes out turnless is in the first table only.
    """
    share = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(heads))
    first = rows.where((F.col("conv") % group == 0) & (F.col("pos") < heads - 1))
    taken = first.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "digest", "size"))).alias("head"))
    known = rows.where("pos = 0").select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), share(F.col("conv")).alias("h"))
    known = known.join(taken, "base", "left").select("conv", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array()).alias("head"))
    known = checkpointed(known)
    lead = known.select("conv", F.inline("head"))
    own = rows.where(F.col("pos") >= share(F.col("conv")))
    shift = known.select("conv", (F.size("head") - F.col("h")).alias("shift"))
    tail = split_join(own, shift, ["conv"], ["pos"]).select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "role", "digest", "size")
    return known.select("conv"), lead.unionByName(tail)


def prefix_keys(turns: DataFrame) -> DataFrame:
    """(conv, depth, ka, kb, pa, pb, size): each turn with the 128-bit key of the prefix it ends and of its parent.

    A prefix's key is the XOR of 128 bits of every (place, role, text digest), so a long
    conversation is keyed in parts, and a turn tells its parent's key by itself.
    """
    a, b = F.xxhash64("pos", "role", "digest"), F.xxhash64(F.lit("b"), "digest", "role", "pos")
    hashed = turns.select("conv", "pos", "size", a.alias("a"), b.alias("b"))
    keyed = scanned(hashed, "conv", ["pos"], {"ka": (F.col("a"), "bit_xor"), "kb": (F.col("b"), "bit_xor")})
    return keyed.select(
        "conv", (F.col("pos") + 1).alias("depth"), "ka", "kb",
        F.col("ka").bitwiseXOR(F.col("a")).alias("pa"), F.col("kb").bitwiseXOR(F.col("b")).alias("pb"), "size",
    )


def end_lists(ends: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ascending, comma-joined numbers of the conversations that end there.

    Numbers are sorted by range and joined to pieces of one Arrow batch at most; a node's digest is
    then fed piece by piece, so neither a row nor a task's memory holds a long list.
    """
    parts = ends.count() // part_rows + 1
    listed = ends.select(*NODE, "conv").repartitionByRange(parts, *NODE, "conv").sortWithinPartitions(*NODE, "conv")

    def pieces(batches):
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns])
            out = [(*node, members[0], ",".join(map(str, members))) for node, members in ((n, [r[3] for r in g]) for n, g in groupby(rows, lambda r: r[:3]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(zip(*out))] if out else [pa.array([], pa.string() if i == 4 else pa.int64()) for i in range(5)], names=[*NODE, "first", "listed"])

    def digests(batches):
        at, sha = None, None
        for batch in batches:
            done = []
            for *node, _, text in zip(*[c.to_pylist() for c in batch.columns]):
                if node == at:
                    sha.update(b"," + text.encode())
                    continue
                if at:
                    done.append((*at, sha.hexdigest()))
                at, sha = node, hashlib.sha256(text.encode())
            yield from told(done)
        if at:
            yield from told([(*at, sha.hexdigest())])

    def told(done):
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*NODE, "ends_sha256"])

    chunks = listed.mapInArrow(pieces, "depth long, ka long, kb long, first long, listed string")
    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return ordered.mapInArrow(digests, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` lists the conversations, ``turns`` is (conv, pos, role, digest, size). Equal
    conversations collapse to one sequence with a weight; sequences that are a proper prefix of
    another go by an anti-join, the others are the leaves; the weighted prefixes add up to nodes.
    A node belongs to the smallest conversation through it. What a sequence owns is the end of its
    path, so a subtree's sum is that of the sequences through its top, less what the owner has
    above it: no pair of node and ancestor is formed, however deep the trie. The root (depth 0) has
    a null parent; without any conversation there is no row at all.
    """
    paths = checkpointed(prefix_keys(turns))
    last = paths.groupBy("conv").agg(F.max(F.struct(*NODE)).alias("end"))
    ended = convs.join(last, "conv", "left").select("conv", *[F.coalesce(F.col("end")[c], F.lit(0).cast("long")).alias(c) for c in NODE])
    ends = checkpointed(ended)
    sequences = checkpointed(ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("conv").alias("seq")))
    weights = sequences.select(F.col("seq").alias("conv"), F.col("depth").alias("length"), "weight")
    zero = F.lit(0).cast("long")
    root = sequences.select(F.col("seq").alias("conv"), zero.alias("depth"), zero.alias("ka"), zero.alias("kb"),
                            F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("size"), F.col("depth").alias("length"), "weight")
    prefixes = checkpointed(split_join(paths, weights, ["conv"], ["depth"]).unionByName(root))
    inner = prefixes.where("depth < length").select(*NODE).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").select("seq", F.lit(1).cast("long").alias("leaf"))
    nodes = prefixes.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("size").alias("size"),
    ).withColumn("own", (F.col("n_convs") - 1) * F.col("size"))
    owned = checkpointed(scanned(nodes, "conv_id", ["depth"], {"upto": (F.col("own"), "sum")}))
    worth = owned.groupBy(F.col("conv_id").alias("seq")).agg(F.sum("own").alias("worth")).where("worth > 0")
    each = sequences.select("seq").join(worth, "seq", "left").join(leaves, "seq", "left").where("worth is not null or leaf is not null")
    told = split_join(prefixes.select(F.col("conv").alias("seq"), *NODE), each, ["seq"], ["depth"])
    under = told.groupBy(*NODE).agg(F.sum(F.coalesce("worth", F.lit(0))).alias("under"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))
    above = owned.select(F.col("depth").alias("pd"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    below = owned.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count(F.lit(1)).alias("n_children"))
    listed = end_lists(ends)
    full = reduce(lambda f, t: f.join(t, NODE, "left"), (under, below, listed), owned).withColumn("pd", F.col("depth") - 1)
    placed = split_join(full.where("depth > 0"), above, ["pd", "pa", "pb"], NODE).unionByName(full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return placed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.col("n_leaves"),
        (F.coalesce("under", zero) - F.col("upto") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, group: int = GROUP, heads: int = HEADS, **names) -> DataFrame:
    """:func:`prefix_trie` of the conversations that :func:`branched` rebuilds."""
    convs, rebuilt = branched(turn_rows(turns, **names), group, heads)
    return prefix_trie(convs, rebuilt)
