"""Near-duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailgrid.llm.common import free_name, keyed_texts
from trailgrid.operators.components import connected_components
from trailgrid.session import checkpointed

SHINGLE = 3
SEED = 42
DISTANCE = 3
HALF = 32


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, as an unsigned number.

    A-Z are lower-cased, words are what lies between ASCII white space, a text of fewer words
    than a shingle is one shingle, a text of none has fingerprint 0. A bit is 1 if it is set in
    over half of the shingles' XXH64 hashes, repeats counted.
    """
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp) of every row; ``fp`` holds the 64 bits as a signed long. Null text counts as empty."""
    rows = keyed_texts(docs, key, text)
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("fp", T.LongType())])

    def hash_all(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"))], names=["key", "fp"])

    return rows.mapInArrow(hash_all, schema)


def _raised(bits: Column, value: Column, width: int) -> Column:
    """``value`` and every number got from it by setting one of its clear bits."""
    flipped = F.transform(bits, lambda i: value.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.array_distinct(F.concat(F.array(value), flipped))


def _balls(width: int) -> Column:
    return F.sequence(F.lit(0), F.lit(width - 1))


def near_stars(prints: DataFrame) -> DataFrame:
    """Edges (a, b) within two bits, a star for every number that prints reach by setting one bit.

    All that reach one number are within two bits of each other, so its least member may stand
    for it: edges stay in proportion to the prints however many lie close together.
    """
    reached = prints.select("fp", F.explode(_raised(_balls(64), F.col("fp"), 64)).alias("point"))
    hubs = reached.groupBy("point").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most")
    return reached.join(hubs.select("point", "least"), "point").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def segment_links(labelled: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between labels: prints of two labels that differ in ``distance`` bits or fewer.

    Of the two halves of a print, one differs from its partner's in at most one bit. Every print
    is in the tables of both halves, and probes them with its half as it is and with one clear
    bit set; a pair that differs there meets from the side that has the bit clear. Probes whose
    bucket holds only their own label stop there, so a dense group never meets itself; the others
    fetch the bucket's prints and the whole distance is counted.
    """
    if distance > 3:
        raise ValueError("two halves and balls of one bit cover up to 3 differing bits")
    low = F.col("fp").bitwiseAND(F.lit(2 ** HALF - 1))
    high = F.shiftrightunsigned("fp", HALF)
    halves = labelled.select("fp", "label", F.explode(F.array(
        F.struct(F.lit(0).alias("segment"), low.alias("value")), F.struct(F.lit(1).alias("segment"), high.alias("value"))
    )).alias("half")).select("fp", "label", "half.*")
    table = halves.select("segment", "value", "fp", "label")
    buckets = table.groupBy("segment", "value").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    probes = halves.select(F.col("fp").alias("probe"), F.col("label").alias("own"), "segment", F.explode(_raised(_balls(HALF), F.col("value"), HALF)).alias("value"))
    live = probes.join(buckets, ["segment", "value"]).where("low <> own or high <> own").select("segment", "value", "probe", "own")
    met = live.join(table, ["segment", "value"]).where((F.col("own") != F.col("label")) & (F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= distance))
    return met.select(F.greatest("own", "label").alias("a"), F.least("own", "label").alias("b")).distinct()


def print_components(prints: DataFrame) -> DataFrame:
    """(fp, component): connected components of distinct prints that link at ``DISTANCE`` bits.

    Close prints are joined into stars first, then the multi-index search looks only between
    their components, which loses no connection. ``component`` is one of its prints.
    """
    near = connected_components(checkpointed(near_stars(prints))).withColumnRenamed("component", "label")
    labelled = checkpointed(prints.join(near, prints["fp"] == near["node"], "left").select("fp", F.coalesce("label", "fp").alias("label")))
    links = connected_components(checkpointed(segment_links(labelled)))
    return labelled.join(links, labelled["label"] == links["node"], "left").select("fp", F.coalesce("component", "label").alias("component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of every row: the smallest key that links reach, its own included.

    Documents whose fingerprints differ in at most three bits link. Only distinct fingerprints are
    searched, so exact copies cost one. A null key takes part in links and is never the smallest
    unless all are null; repeated rows share an answer; an empty table gives an empty table.
    """
    rows = checkpointed(fingerprints(docs, key, text))
    classes = checkpointed(rows.groupBy("fp").agg(F.min("key").alias("first")))
    found = checkpointed(print_components(classes.select("fp")))
    least = classes.join(found, "fp").groupBy("component").agg(F.min("first").alias("component_id"))
    named = found.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with only the document of the smallest key of each component, columns as they were.

    Rows that share a key are one document and stay or go together; a row without a key stays
    only where no row of its component has one.
    """
    found = near_duplicates(docs, key, text)
    stays = free_name(docs, "_stays")
    stay = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias(stays)).distinct()
    return docs.join(stay, docs[key].eqNullSafe(F.col(stays)), "left_semi")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
