"""Exact copies by a minimal perfect hash over the digests of earlier documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgrid.llm.common import ascii_lower, free_name
from trailgrid.session import checkpointed

DIGEST = 32
KEYS_PER_BUCKET = 3
LEAST_SHARDS = 512
SHARD_DIGESTS = 8192
NO_ID = -(2 ** 63)
TRIES = 64


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digests.reshape(-1, DIGEST).view("<u8")
    return words[:, 0], words[:, 1]


def _slots(base: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return _mix(base ^ (pilot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)


def build_shard(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pilots, slot of each digest) of a perfect hash onto 0 .. n-1 for n distinct digests.

    Digests fall into buckets; from the fullest bucket on, the first pilot that sends all of a
    bucket's digests to free slots is kept.
    """
    n = len(digests) // DIGEST
    first, base = _halves(digests)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    of = (_mix(first) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=buckets)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    pilots, slots, taken = np.zeros(buckets, dtype="<u4"), np.empty(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for bucket in np.argsort(-sizes, kind="stable"):
        members = order[begin[bucket]:begin[bucket + 1]]
        if not len(members):
            break
        start = 0
        while True:
            pilot = np.arange(start, start + TRIES, dtype=np.uint64)
            at = _slots(base[members][None, :], pilot[:, None], n).astype(np.int64)
            good = ~taken[at].any(axis=1)
            if len(members) > 1:
                ordered = np.sort(at, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                which = int(np.argmax(good))
                pilots[bucket], slots[members] = start + which, at[which]
                taken[at[which]] = True
                break
            start += TRIES
    return pilots, slots


def look_up(digests: np.ndarray, pilots: np.ndarray, slot_digests: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 where the slot's bytes are another digest's."""
    n = len(slot_digests) // DIGEST
    if not n or not len(digests):
        return np.full(len(digests) // DIGEST, -1)
    first, base = _halves(digests)
    at = _slots(base, pilots[(_mix(first) % np.uint64(len(pilots))).astype(np.int64)], n).astype(np.int64)
    same = (slot_digests.reshape(-1, DIGEST)[at] == digests.reshape(-1, DIGEST)).all(axis=1)
    return np.where(same, at, -1)


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest): SHA-256 of the text with A-Z lower-cased; a null text counts as empty."""
    return docs.select(F.col(key).alias("key"), F.unhex(F.sha2(ascii_lower(F.col(text)).cast("binary"), 256)).alias("digest"))


def groups_of(rows: DataFrame) -> DataFrame:
    """(digest, winner, size), counted before the shuffle: the largest key of each digest wins."""
    return rows.groupBy("digest").agg(
        F.coalesce(F.max("key"), F.lit(NO_ID)).alias("winner"), F.count(F.lit(1)).alias("size")
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard: pilots, and by slot the full digest, the winner's key and the copies.

    ``history`` is the output of ``groups_of``. Digests are spread by a hash, so a shard holds
    its share whatever the texts are.
    """
    def build(part: pd.DataFrame) -> pd.DataFrame:
        raw = _bytes(part["digest"])
        pilots, slots = build_shard(raw)
        back = np.empty(len(slots), dtype=np.int64)
        back[slots] = np.arange(len(slots))
        return pd.DataFrame({
            "shard": [part["shard"].iloc[0]], "pilots": [pilots.tobytes()],
            "slots": [raw.reshape(-1, DIGEST)[back].tobytes()],
            "winners": [part["winner"].to_numpy(dtype="<i8")[back].tobytes()],
            "sizes": [part["size"].to_numpy(dtype="<i8")[back].tobytes()],
        })

    placed = history.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return placed.groupBy("shard").applyInPandas(build, "shard long, pilots binary, slots binary, winners binary, sizes binary")


def merge(arrivals: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Groups of history and arrivals together.

    Each arriving digest is looked up in its shard's perfect hash and the slot's 32 bytes are
    compared; a member joins the slot's group, a nonmember keeps its own. Arrivals were grouped
    before, so a text with any number of copies is one row here.
    """
    def join(part: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if len(shard):
            pilots, slots, winners, sizes = (np.frombuffer(shard[c].iloc[0], dtype=d) for c, d in (("pilots", "<u4"), ("slots", np.uint8), ("winners", "<i8"), ("sizes", "<i8")))
        else:
            pilots, slots, winners, sizes = np.zeros(1, "<u4"), np.zeros(0, np.uint8), np.zeros(0, "<i8"), np.zeros(0, "<i8")
        winners, sizes = winners.copy(), sizes.copy()
        at = look_up(_bytes(part["digest"]), pilots, slots)
        member = at >= 0
        arrived, count = part["winner"].to_numpy(dtype=np.int64), part["size"].to_numpy(dtype=np.int64)
        winners[at[member]] = np.maximum(winners[at[member]], arrived[member])
        sizes[at[member]] += count[member]
        known = slots.tobytes()
        return pd.DataFrame({
            "digest": [known[i:i + DIGEST] for i in range(0, len(known), DIGEST)] + list(part["digest"][~member]),
            "winner": np.concatenate([winners, arrived[~member]]), "size": np.concatenate([sizes, count[~member]]),
        })

    placed = arrivals.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return placed.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(join, "digest binary, winner long, size long")


def copy_groups(rows: DataFrame) -> DataFrame:
    """(digest, winner, size) of ``rows`` (the output of ``digests``), a null winner where all keys are null.

    The rows up to the middle of the key range are the history that the index is built on; the
    others arrive and are looked up. The shards grow with the rows, so none outgrows a task.
    """
    seen = rows.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).first()
    shards = max(LEAST_SHARDS, seen["n"] // SHARD_DIGESTS)
    middle = (seen["low"] + seen["high"]) // 2 if seen["low"] is not None else 0
    old = F.coalesce(F.col("key") <= middle, F.lit(False))
    merged = merge(groups_of(rows.where(~old)), build_index(groups_of(rows.where(old)), shards), shards)
    return merged.withColumn("winner", F.when(F.col("winner") != NO_ID, F.col("winner")))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of
    equal texts the row with the largest key stays; rows that repeat one key share its answer. A
    row without a key stays only where the whole group has none. Texts are read once; only
    32-byte digests move, and the last join can be split where one text has very many copies.
    Empty table: empty result. Keys are whole numbers.
    """
    rows = checkpointed(digests(docs, key, text))
    found = rows.join(copy_groups(rows), "digest")
    return found.select(
        F.col("key").alias(key), F.col("winner").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("key").eqNullSafe(F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops, all columns as they were.

    Rows that repeat a kept key and its text stay once.
    """
    rows = checkpointed(digests(docs, key, text))
    winners = checkpointed(copy_groups(rows).select("digest", "winner"))
    own = rows.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = checkpointed(own.join(winners, (F.col("key").eqNullSafe(F.col("winner"))) & (own["digest"] == winners["digest"]), "left_semi").select("key", "digest"))
    own_digest = free_name(docs, "_digest")
    marked = docs.withColumn(own_digest, F.unhex(F.sha2(ascii_lower(F.col(text)).cast("binary"), 256)))
    kept = marked.join(winners, (marked[own_digest] == winners["digest"]) & marked[key].eqNullSafe(winners["winner"]), "left_semi")
    if repeated.isEmpty():
        return kept.drop(own_digest)
    same = (kept[own_digest] == repeated["digest"]) & kept[key].eqNullSafe(repeated["key"])
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates([key, own_digest])).drop(own_digest)
