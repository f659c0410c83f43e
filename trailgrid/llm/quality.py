"""Document quality: histogram gradient-boosted trees over statistics of a text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid.llm.common import labelled_sample

SAMPLE = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
LEAST_ROWS = 8
RIDGE = 1.0

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "space", "other_ascii", "not_ascii",
    "distinct_words", "top_word", "repeated_next", "line_words", "repeated_lines", "sentence_words", "ends_in_mark",
    "bare_marks", "pipes", "exclaims", "capital_words", "entropy", "longest_word", "short_lines", "comma_rate",
)
_UPPER, _DIGIT = slice(65, 91), slice(48, 58)
_SPACE = [9, 10, 11, 12, 13, 32]
_PROSE_MARKS = [ord(c) for c in ".,;:'\"()-"]


def statistics(text: str) -> np.ndarray:
    """``STATISTICS`` of a whole text. Shares of nothing are 0, so an empty text is all zeros."""
    out = np.zeros(len(STATISTICS))
    raw = text.encode()
    words = raw.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, number = len(raw), len(words)
    lengths = np.fromiter(map(len, words), np.int64, number)
    letters = counts[65:91].sum() + counts[97:123].sum()
    ascii_other = counts[:128].sum() - letters - counts[_DIGIT].sum() - counts[_SPACE].sum()
    tally = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    sentences = counts[[46, 33, 63]].sum() + 1
    share = counts[counts > 0] / size
    out[:] = (
        np.log1p(size), np.log1p(number), lengths.mean(), lengths.std(), counts[_UPPER].sum() / size, counts[_DIGIT].sum() / size,
        counts[_SPACE].sum() / size, (ascii_other - counts[_PROSE_MARKS].sum()) / size, counts[128:].sum() / size,
        len(tally) / number, max(tally.values()) / number, sum(map(bytes.__eq__, words, words[1:])) / number,
        number / len(lines), 1 - len(set(lines)) / len(lines), number / sentences,
        sum(n for w, n in tally.items() if w[-1] in b"!#$%&*+=@^~|") / number,
        sum(n for w, n in tally.items() if not w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) / number,
        counts[124] / number, counts[33] / number, sum(n for w, n in tally.items() if 65 <= w[0] <= 90) / number,
        -(share * np.log2(share)).sum(), lengths.max(), sum(len(line) < 20 for line in lines) / len(lines), counts[44] / number,
    )
    return out


@dataclass
class Forest:
    """Complete trees of one depth in arrays: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all rows walk all trees together, a level at a time."""
        trees, inner = self.feature.shape
        at = np.zeros((len(rows), trees), dtype=np.int64)
        tree = np.arange(trees)[None, :]
        row = np.arange(len(rows))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (rows[row, self.feature[tree, at]] > self.cut[tree, at])
        return self.base + self.leaf[tree, at - inner].sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(rows), -40, 40)))


def fit(rows: np.ndarray, label: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boosted trees for log loss, split on histograms of quantile bins.

    A node that no cut improves sends everything left. Ties go to the first statistic and cut.
    """
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], rows[:, j], "left") for j in range(width)], axis=1)
    inner = 2 ** depth - 1
    share = np.clip(label.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    feature, cut = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    for t in range(trees):
        chance = 1.0 / (1.0 + np.exp(-score))
        slope, bend = chance - label, chance * (1 - chance)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width_at = 2 ** level - 1, 2 ** level
            cell = ((node - first)[:, None] * width + np.arange(width)[None, :]) * bins + binned
            shape = (width_at, width, bins)
            flat = cell.ravel()
            g = np.bincount(flat, np.repeat(slope, width), np.prod(shape)).reshape(shape).cumsum(axis=2)
            h = np.bincount(flat, np.repeat(bend, width), np.prod(shape)).reshape(shape).cumsum(axis=2)
            c = np.bincount(flat, minlength=np.prod(shape)).reshape(shape).cumsum(axis=2)
            all_g, all_h, all_c = g[:, :1, -1:], h[:, :1, -1:], c[:, :1, -1:]
            gain = g ** 2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g ** 2 / (all_h + RIDGE)
            gain[(c < LEAST_ROWS) | (all_c - c < LEAST_ROWS)] = 0
            best = gain.reshape(width_at, -1).argmax(axis=1)
            for i, b in enumerate(best):
                j, k = divmod(int(b), bins)
                if gain[i, j, k] > 1e-9 and k < len(edges[j]):
                    feature[t, first + i], cut[t, first + i] = j, edges[j][k]
            node = 2 * node + 1 + (rows[np.arange(n), feature[t, node]] > cut[t, node])
        place = node - inner
        value = -np.bincount(place, slope, inner + 1) / (np.bincount(place, bend, inner + 1) + RIDGE)
        leaf[t] = rate * value
        score += leaf[t, place]
    return Forest(feature, cut, leaf, base)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE) -> Forest | None:
    """Learn from at most ``most`` labelled documents outside the held-out fold; None without any.

    Statistics are worked out where the texts lie; only their numbers come to the driver.
    """
    sample = labelled_sample(docs, labels, label, most, key, text)

    def measure(batches):
        for batch in batches:
            rows = [statistics(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["key", "label", "x"])

    kind = sample.schema["key"].dataType.simpleString()
    rows = sample.select("key", "text", "label").mapInArrow(measure, f"key {kind}, label int, x array<double>").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values("key", kind="stable")
    return fit(np.array(rows["x"].tolist()), (rows["label"] > 0).to_numpy(dtype=float))


def score_column(forest: Forest | None, text: Column) -> Column:
    """Chance of label 1 of a text column, whole texts; null counts as empty; 1 where nothing was learnt."""
    if forest is None:
        return F.lit(1.0)

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            rows = np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))
            scores = [forest.score(rows[at:at + 2048]) for at in range(0, len(rows), 2048)]
            yield pd.Series(np.concatenate(scores) if scores else np.zeros(0))

    return F.pandas_udf(score, "double")(F.coalesce(text, F.lit("")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``docs`` that score ``threshold`` or more, all columns as they were.

    Repeated rows score alike; an empty table stays empty; without labels everything stays.
    """
    forest = train(docs, labels, key, text, label)
    return docs if forest is None else docs.where(score_column(forest, F.col(text)) >= threshold)
