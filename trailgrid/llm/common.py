"""Small helpers that the text operators share."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = string.ascii_uppercase, string.ascii_lowercase
FOLDS = 5


class Memo(dict):
    """A function's answers by argument, forgotten as a whole when there are too many.

    One worker keeps one, so its size is bounded whatever the corpus holds.
    """

    def __init__(self, answer, most: int = 400_000):
        super().__init__()
        self.answer, self.most = answer, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.answer(key)
        return value


#: Every ASCII character that is neither letter nor digit, as a space.
_MARKS_AS_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def bare_words(text: str) -> list[bytes]:
    """Lower-cased words of a text in UTF-8; ASCII marks part words like white space."""
    return text.lower().encode().translate(_MARKS_AS_SPACE).split()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of runs laid end to end: each from its start, as long as its length."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def keyed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with null text as empty; other columns, whatever their names, are left behind."""
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def free_name(frame: DataFrame, name: str) -> str:
    """``name`` with as many underscores ahead as it takes to be no column of ``frame``, whatever its case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(key: Column) -> Column:
    """True for the fold that is never learnt from; a null id is never learnt from either."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of at most ``most`` labelled rows outside the held-out fold.

    The rows with the lowest hash of their id are taken, so the choice follows the ids alone.
    Their ids are at most ``most`` and are broadcast; the texts are never shuffled. Repeated
    labels of one document count once; where they differ, the larger one holds.
    """
    chosen = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .where(F.col("key").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("key")))
        .groupBy("key").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key").limit(most)
    )
    return keyed_texts(docs, key, text).join(F.broadcast(chosen), "key")
