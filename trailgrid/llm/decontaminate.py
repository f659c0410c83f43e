"""Benchmark passages in training text, found by spaced seeds and checked word by word."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trailgrid.llm.common import bare_words, keyed_texts

#: A mask's words are hashed where it has a 1; a word under a 0 may be any. Wherever two of 13
#: words in a row differ, one of the masks still fits between the differences.
MASKS = ("11110101", "101100111")
WINDOW = 13
SHARE = 0.8
LEAST_WORDS = 1
BLOCK_WORDS = 2_000_000
GAP = max(map(len, MASKS))
TABLE_BITS = 22
RUN = 200_000

#: Thai, Lao, Burmese, Khmer, kana and Han are written without spaces: each character is a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_WIDE_MARKS = re.compile("[\u3000-\u303f\uff01-\uff0f\uff1a-\uff20]")


def passage_words(text: str) -> list[bytes]:
    """``bare_words``, with a word for each character of a script without spaces; its marks part words."""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", _WIDE_MARKS.sub(" ", text))
    return bare_words(text)


@dataclass
class Seeds:
    """One block of test passages: word numbers, and for each mask the hashes of every position."""

    numbers: dict[bytes, int]
    words: np.ndarray
    begin: np.ndarray
    items: list
    masks: list[tuple[np.ndarray, int]]
    hashes: list[np.ndarray]
    places: list[np.ndarray]
    present: list[np.ndarray]


def hash_at(words: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) under a mask, wherever all words that it hashes are known (not 0)."""
    room = len(words) - span + 1
    if room <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    some = words > 0
    known = some[offsets[0]:offsets[0] + room].copy()
    for o in offsets[1:]:
        known &= some[o:o + room]
    at = np.flatnonzero(known)
    hashes = np.zeros(len(at), np.uint64)
    for o in offsets:
        hashes = (hashes ^ words[at + o].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return at, hashes


def short_mask(length: int, share: float) -> str:
    """For a test shorter than the window: one of equal runs, more of them than words may differ."""
    return "1" * (length // (length - math.ceil(share * length - 1e-9) + 1))


def build_seeds(tests: list[tuple[object, str]], window: int = WINDOW, share: float = SHARE, least_words: int = LEAST_WORDS) -> Seeds:
    """Tables of a block of tests; those of fewer than ``least_words`` words are left out."""
    numbers: dict[bytes, int] = {}
    rows, items = [], []
    for item, text in tests:
        words = passage_words(text or "")
        if len(words) >= max(least_words, 1):
            items.append(item)
            rows.append([numbers.setdefault(w, len(numbers) + 1) for w in words])
    flat, begin = [0] * GAP, []
    for row in rows:
        begin.append(len(flat))
        flat += row + [0] * GAP
    words = np.array(flat, dtype=np.int64)
    starts = np.array([*begin, len(flat)], dtype=np.int64)
    of_row = [MASKS if len(row) >= window else (short_mask(len(row), share),) for row in rows]
    masks, hashes, places, present = [], [], [], []
    for shape in dict.fromkeys(mask for own in of_row for mask in own):
        offsets = np.flatnonzero(np.array(list(shape)) == "1")
        at, h = hash_at(words, offsets, len(shape))
        own = np.array([shape in o for o in of_row], dtype=bool)[np.searchsorted(starts, at, "right") - 1]
        at, h = at[own], h[own]
        order = np.argsort(h, kind="stable")
        masks.append((offsets, len(shape)))
        hashes.append(h[order])
        places.append(at[order])
        table = np.zeros(1 << TABLE_BITS, dtype=bool)
        table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        present.append(table)
    return Seeds(numbers, words, starts, items, masks, hashes, places, present)


def candidates(words: np.ndarray, seeds: Seeds) -> np.ndarray:
    """Distinct (item, shift, a position) of all seed hits; shift is the text's position less the table's."""
    found = []
    for (offsets, span), hashes, places, present in zip(seeds.masks, seeds.hashes, seeds.places, seeds.present):
        at, h = hash_at(words, offsets, span)
        near = present[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        at, h = at[near], h[near]
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        count = high - low
        if not count.sum():
            continue
        text_at = np.repeat(at, count)
        table_at = places[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        item = np.searchsorted(seeds.begin, table_at, "right") - 1
        found.append(np.stack([item, text_at - table_at, text_at], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def verified(words: np.ndarray, seeds: Seeds, item: int, shift: int, window: int, share: float):
    """(text from, text to, test from, test to, equal words) of an overlap on one diagonal, or None.

    The overlap is all windows of ``window`` words (the whole test if it has fewer) of which at
    least ``share`` are equal, from the first such window to the end of the last.
    """
    begin = int(seeds.begin[item])
    length = int(seeds.begin[item + 1]) - begin - GAP
    first, last = max(0, -shift - begin), min(length, len(words) - shift - begin)
    size = min(window, length)
    if last - first < size:
        return None
    test = seeds.words[begin + first:begin + last]
    equal = (words[begin + first + shift:begin + last + shift] == test) & (test > 0)
    sums = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(sums[size:] - sums[:-size] >= math.ceil(share * size - 1e-9))
    if not len(good):
        return None
    start, end = int(good[0]), int(good[-1]) + size
    while not equal[start]:
        start += 1
    while not equal[end - 1]:
        end -= 1
    at = begin + first + shift
    return at + start, at + end, first + start, first + end, int(sums[end] - sums[start])


def batch_overlaps(texts: list[str], seeds: Seeds, window: int, share: float) -> list[tuple]:
    """(row, test, text from, text to, test from, test to, equal words) over a batch of texts.

    Per text and test the overlap with the most equal words, then the earliest. Texts are hashed
    in runs of about ``RUN`` words, parted by gaps that no mask bridges.
    """
    number = seeds.numbers.get
    out, run, begin, size = [], [], [], GAP

    def flush():
        words = np.array([n for row in run for n in (*([0] * GAP), *row)] + [0] * GAP, dtype=np.int64)
        starts = np.array(begin, dtype=np.int64)
        best: dict[tuple[int, int], tuple] = {}
        hits = candidates(words, seeds)
        owner = np.searchsorted(starts, hits[:, 2], "right") - 1
        for at, item, shift in np.unique(np.stack([owner, hits[:, 0], hits[:, 1]], axis=1), axis=0).tolist():
            start = int(starts[at])
            text = words[start:start + len(run[at])]
            got = verified(text, seeds, item, shift - start, window, share)
            key = (rows[at], item)
            if got and (key not in best or (-got[4], got[0]) < (-best[key][4], best[key][0])):
                best[key] = got
        out.extend((*key, *got) for key, got in sorted(best.items()))

    rows = []
    for i, text in enumerate(texts):
        numbers = [number(w, 0) for w in passage_words(text)]
        rows.append(i)
        begin.append(size)
        run.append(numbers)
        size += len(numbers) + GAP
        if size >= RUN:
            flush()
            run, begin, rows, size = [], [], [], GAP
    if run:
        flush()
    return out


def _blocks(tests: DataFrame, key: str, text: str, block_words: int):
    """The tests a block at a time: each holds at most ``block_words`` words (one test at least)."""
    rows = tests.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    block, size = [], 0
    for row in rows.orderBy("key", "text").toLocalIterator():
        words = len(passage_words(row["text"]))
        if block and size + words > block_words:
            yield block
            block, size = [], 0
        block.append((row["key"], row["text"]))
        size += words
    if block:
        yield block


def overlaps(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", *, item: str = "item_id", item_text: str = "text",
             window: int = WINDOW, share: float = SHARE, block_words: int = BLOCK_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, item, word_start, word_end, item_start, item_end, matched) of every overlap of a text with a test.

    Words are lower-cased and parted by white space and ASCII marks; in scripts without spaces each
    character is a word, and places count it so. Every position of every text and test is
    hashed under fixed masks that skip some words, equal hashes are met, and the texts are laid
    over each other there: an overlap needs ``window`` words in a row (or the whole test, if
    shorter) of which ``share`` agree. One row per text and test: the overlap with most equal
    words. A test of under five words is found where all of it stands in a row; ``least_words`` leaves out
    shorter ones, a test without words is never found. Tests are a stated query set: they are sent
    out in blocks of at most ``block_words`` words, each against all texts, and texts are not
    shuffled. Null texts count as empty; null keys and items are carried; repeated rows give
    repeated rows; empty tables give an empty result.
    """
    rows = keyed_texts(docs, key, text)
    spark = docs.sparkSession
    schema = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("item", tests.schema[item].dataType),
        *[T.StructField(n, T.LongType()) for n in ("word_start", "word_end", "item_start", "item_end", "matched")],
    ])
    parts = []
    for block in _blocks(tests, item, item_text, block_words):
        sent = spark.sparkContext.broadcast(block)

        def scan(batches, sent=sent):
            seeds = build_seeds(sent.value, window, share, least_words)
            for batch in batches:
                keys = batch.column(0).to_pylist()
                out = [(keys[row], seeds.items[i], *got) for row, i, *got in batch_overlaps(batch.column(1).to_pylist(), seeds, window, share)]
                columns = list(zip(*out)) if out else [[] for _ in schema]
                kinds = [batch.schema.field(0).type, *[to_arrow_type(f.dataType) for f in schema[1:]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.names)

        parts.append(rows.mapInArrow(scan, schema))
    if not parts:
        parts.append(spark.createDataFrame([], schema))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.withColumnsRenamed({"key": key, "item": item})


def without_tests(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", *, item: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, share: float = SHARE, block_words: int = BLOCK_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the rows whose text overlaps any test (see :func:`overlaps`), all columns as they were. No shuffle.

    Rows with a null or empty text stay, repeated rows go or stay together, and without tests all stay.
    """
    spark = docs.sparkSession
    kept = docs
    for block in _blocks(tests, item, item_text, block_words):
        clean = F.pandas_udf(_clean(spark.sparkContext.broadcast(block), window, share, least_words), "boolean")
        kept = kept.where(clean(F.coalesce(F.col(text), F.lit(""))))
    return kept


def _clean(sent, window: int, share: float, least_words: int):
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seeds = build_seeds(sent.value, window, share, least_words)
        for texts in parts:
            kept = np.ones(len(texts), dtype=bool)
            kept[[row for row, *_ in batch_overlaps(texts.tolist(), seeds, window, share)]] = False
            yield pd.Series(kept)

    return clean
