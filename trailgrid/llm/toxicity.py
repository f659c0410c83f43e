"""Toxicity by weak supervision: many voters, a label model over them, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid.llm.common import bare_words, labelled_sample

#: A starting lexicon of insults, each language one voter; users pass their own.
LEXICONS = {
    "en": ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown"),
    "de": ("idiot", "dumm", "trottel", "abschaum", "versager", "widerlich"),
    "fr": ("idiot", "imbécile", "débile", "ordure", "minable", "dégueulasse"),
    "es": ("idiota", "imbécil", "estúpido", "basura", "escoria", "asqueroso"),
}
#: Pattern voters over the lower-cased text.
PATTERNS = {
    "masked": r"\b[a-z]\*{2,}[a-z]*\b",
    "addressed": r"\byou(?:'re| are)? (?:an? )?(?:idiot|moron|loser|clown|stupid|pathetic|worthless)",
    "shout": r"!{3,}",
}
SAMPLE = 12_000
UNITS = 1_500
VOTERS = 160
LEAST_DOCS = 3
DOUBT = 3.0
MOST_UNITS = 200_000
LABEL_ACCURACY = 0.95
PREFIXES = (4, 5, 6)
ROUNDS = 40


def text_units(text: str) -> list[set[bytes]]:
    """Distinct words of a whole text, then the first 4, 5 and 6 bytes of the longer ones."""
    words = set(bare_words(text))
    return [words, *({w[:n] for w in words if len(w) > n} for n in PREFIXES)]


def named(units: list[set[bytes]]) -> list[str]:
    """Units as strings, ``=word`` and ``^first``; bytes that are no whole characters are escaped."""
    return [mark + u.decode("utf-8", "backslashreplace") for mark, found in zip(("=", *"^" * len(PREFIXES)), units) for u in found]


def by_kind(units: list[str]) -> list[dict[bytes, int]]:
    """Number of each unit, one table for words and one for every length of first bytes."""
    tables: list[dict[bytes, int]] = [{} for _ in range(1 + len(PREFIXES))]
    for i, unit in enumerate(units):
        raw = re.sub(rb"\\x([0-9a-f]{2})", lambda m: bytes([int(m[1], 16)]), unit[1:].encode())
        tables[0 if unit[0] == "=" else 1 + PREFIXES.index(len(raw))][raw] = i
    return tables


def hits(text: str, tables: list[dict[bytes, int]]) -> list[int]:
    """Numbers of the units that a text holds, in order."""
    return sorted(table[u] for table, found in zip(tables, text_units(text)) for u in table.keys() & found)


@dataclass
class Model:
    """Unit numbers, the linear weights (bias last) and the log-odds scale learnt from posteriors."""

    units: list[str]
    weights: np.ndarray
    voters: list[str]
    accuracies: np.ndarray
    influence: np.ndarray


def unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, pos, neg): documents of either label that hold a unit, counted in each task first."""
    def count(batches):
        counts = (Counter(), Counter())

        def out():
            units = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(units, pa.string()), *[pa.array([c[u] for u in units], pa.int64()) for c in counts[::-1]]], names=["unit", "pos", "neg"])
            for c in counts:
                c.clear()
            return batch

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[label > 0].update(named(text_units(text.as_py())))
                if len(counts[0]) + len(counts[1]) > MOST_UNITS:
                    yield out()
        yield out()

    return sample.select("text", "label").mapInArrow(count, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def telling_units(counts: DataFrame, positives: int, negatives: int, most: int = UNITS) -> list[str]:
    """Units whose share of documents differs between the labels beyond chance, at most ``most``.

    The likelihood ratio of a unit must beat ``DOUBT`` over the number of units tried, so that
    hardly one unit in all gets in by luck. The strongest come first.
    """
    a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
    p, q = a / (positives + 1.0), b / (negatives + 1.0)
    mean = (a + b) / (positives + negatives + 2.0)
    tried = counts.where(F.col("pos") + F.col("neg") >= LEAST_DOCS).withColumn("gain", a * F.log(p / mean) + b * F.log(q / mean)).persist()
    try:
        bar = math.log(max(tried.count(), 1) / DOUBT)
        return [r["unit"] for r in tried.where(F.col("gain") > bar).orderBy(F.desc("gain"), "unit").limit(most).collect()]
    finally:
        tried.unpersist()


def sample_rows(sample: DataFrame, units: list[str]) -> pd.DataFrame:
    """(key, label, units, patterns) of the sampled documents, at most ``SAMPLE`` small rows."""
    tables = by_kind(units)
    patterns = [re.compile(p) for p in PATTERNS.values()]
    lexicons = [frozenset(w.encode() for w in words) for words in LEXICONS.values()]

    def read(batches):
        for batch in batches:
            found, flags = [], []
            for text in batch.column(1):
                lower = text.as_py().lower()
                words = set(bare_words(lower))
                found.append(hits(lower, tables))
                flags.append([int(bool(words & listed)) for listed in lexicons] + [int(bool(p.search(lower))) for p in patterns])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32())), pa.array(flags, pa.list_(pa.int32()))], names=["key", "label", "hits", "flags"])

    kind = sample.schema["key"].dataType.simpleString()
    return sample.select("key", "text", "label").mapInArrow(read, f"key {kind}, label int, hits array<int>, flags array<int>").toPandas().sort_values("key", kind="stable").reset_index(drop=True)


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = ROUNDS, sure: float = LABEL_ACCURACY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of label 1, accuracies, influence) of a generative model of the votes.

    A hidden label makes each voter vote 1, vote 0 or abstain (1, 0, -1) with its own odds, and
    makes the given label right with chance ``sure``, which keeps the hidden label from drifting
    to some other trait. Voters that repeat each other beyond what the label explains are
    correlated: a voter's influence is one over the sum of its squared correlations with all,
    given the label, so a clique of copies counts about once. Expectation and maximisation
    alternate until the posterior rests.
    """
    fired, against = (votes == 1).astype(np.float64), (votes == 0).astype(np.float64)
    told = np.where(given > 0, 1.0, -1.0) * math.log(sure / (1 - sure))
    posterior = np.where(given > 0, sure, 1 - sure)
    for _ in range(rounds):
        mass = np.array([(1 - posterior).sum(), posterior.sum()])
        rate = np.array([[(1 - posterior) @ x, posterior @ x] for x in (fired, against)])  # vote, label, voter
        rate = (rate + 0.1) / (mass[None, :, None] + 0.3)
        rest = fired - ((1 - posterior)[:, None] * rate[0, 0] + posterior[:, None] * rate[0, 1])
        norm = np.sqrt((rest ** 2).sum(axis=0)) + 1e-9
        correlation = (rest.T @ rest) / norm[:, None] / norm[None, :]
        influence = 1.0 / np.maximum((correlation ** 2).sum(axis=1), 1.0)
        weigh = influence * np.log(rate[:, 1] / rate[:, 0])
        logit = np.log((mass[1] + 1) / (mass[0] + 1)) + told + fired @ weigh[0] + against @ weigh[1]
        moved = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
        change = np.abs(moved - posterior).max()
        posterior = moved
        if change < 1e-6:
            break
    hit, miss = posterior @ fired + (1 - posterior) @ against, (1 - posterior) @ fired + posterior @ against
    return posterior, (hit + 1) / (hit + miss + 2), influence


def linear(rows: list[np.ndarray], width: int, target: np.ndarray, ridge: float = 1e-5, steps: int = 500) -> np.ndarray:
    """Weights (bias last) of a logistic regression on 0/1 features, target in 0 .. 1."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    balance = np.where(target >= 0.5, 0.5 / max(target.sum(), 1.0), 0.5 / max((1 - target).sum(), 1.0))
    weights, mean, spread = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        logit = weights[-1] + np.bincount(owner, weights[flat], len(rows))
        error = (1.0 / (1.0 + np.exp(-logit)) - target) * balance
        slope = np.append(np.bincount(flat, error[owner], width) + ridge * weights[:-1], error.sum())
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope ** 2
        weights -= 0.1 * (mean / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-8)
    return weights


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> Model | None:
    """Learn from at most ``most`` labelled documents outside the held-out fold; None without any.

    Lexicon voters are the given word lists and the words and stems that tell the labels of the
    sample apart; pattern voters are regular expressions; the last voter votes against where no
    other votes for. The label model turns their votes into posteriors, with the given labels as a
    voter of fixed accuracy, and the classifier learns the posteriors from the same units.
    """
    sample = labelled_sample(docs, labels, label, most, key, text).persist()
    try:
        totals = sample.groupBy("label").count().toPandas().set_index("label")["count"].to_dict()
        positives, negatives = totals.get(1, 0), totals.get(0, 0)
        if not positives or not negatives:
            return None
        units = telling_units(unit_counts(sample), positives, negatives)
        rows = sample_rows(sample, units)
    finally:
        sample.unpersist()
    truth = rows["label"].to_numpy(dtype=float)
    found = [np.asarray(h, dtype=np.int64) for h in rows["hits"]]
    voters = units[:VOTERS]
    lexicon = np.zeros((len(rows), len(voters)), dtype=bool)
    for i, h in enumerate(found):
        lexicon[i, h[h < len(voters)]] = True
    side = [truth[lexicon[:, j]].mean() > truth.mean() if lexicon[:, j].any() else True for j in range(len(voters))]
    columns = [np.where(lexicon[:, j], 1 if side[j] else 0, -1) for j in range(len(voters))]
    given = np.array(rows["flags"].tolist()).reshape(len(rows), -1)
    columns += [np.where(given[:, j] > 0, 1, -1) for j in range(given.shape[1])]
    votes = np.stack(columns, axis=1)
    votes = np.hstack([votes, np.where((votes == 1).any(axis=1), -1, 0)[:, None]])
    posterior, accuracies, influence = label_model(votes, truth)
    names = [*voters, *LEXICONS, *PATTERNS, "no vote for"]
    return Model(units, linear(found, len(units), posterior), names, accuracies, influence)


def score_column(model: Model | None, text: Column) -> Column:
    """Score from 0 to 1 of a text column; 0 where there was nothing to learn from."""
    if model is None:
        return F.lit(0.0)
    tables, weights = by_kind(model.units), model.weights

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            scores = np.array([weights[-1] + weights[hits(t, tables)].sum() for t in texts])
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(scores, -40, 40))))

    return F.pandas_udf(score, "double")(F.coalesce(text, F.lit("")))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` whose score is below ``threshold``, all columns as they were. Texts are not shuffled.

    Null and empty texts score like any other text without a known word; repeated rows score
    alike; an empty table stays empty; without labels everything stays.
    """
    model = train(docs, labels, key, text, label)
    return docs if model is None else docs.where(score_column(model, F.col(text)) < threshold)
