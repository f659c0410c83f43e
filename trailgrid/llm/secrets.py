"""Secrets in text: three fixed patterns, and strings that look random to character models."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailgrid.llm.common import keyed_texts
from trailgrid.llm.markov import START, FixedOrder, fixed_order

#: The patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KEYWORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
LEAST_RANDOM = 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
EVIDENCE = 12.0
MEAN_EVIDENCE = 0.5
MOST_WORDS = 200_000
PIECE = 64


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself), in order; start and end in code points, end exclusive."""
    found = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if longest(text) >= LEAST_HEX:
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def longest(text: str) -> int:
    """Length of the longest run without white space; no span that runs on is longer."""
    return max(map(len, text.split()), default=0)


@dataclass
class Model:
    """Character models of random strings and of ordinary words."""

    random: FixedOrder
    ordinary: FixedOrder

    def evidence(self, text: str) -> float:
        return self.random.score(text) - self.ordinary.score(text)


def uncovered(start: int, end: int, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """What the base spans, in order, leave of a run."""
    left = []
    for s, _, e, _ in base:
        if s < end and start < e:
            left.append((start, s))
            start = max(start, e)
    return [(s, e) for s, e in [*left, (start, end)] if e - s >= LEAST_RANDOM]


def random_spans(text: str, base: list[tuple[int, int, int, int]], model: Model | None) -> list[tuple[int, int, int, int]]:
    """Runs of key characters outside the base spans that the random model explains far better.

    What a base span leaves of a run is a run of its own. Digits alone are a number, not a key.
    """
    if model is None or longest(text) < LEAST_RANDOM:
        return []
    found = []
    for m in CANDIDATE.finditer(text):
        for start, end in uncovered(*m.span(), base):
            run = text[start:end]
            if run.isdigit():
                continue
            evidence = model.evidence(run)
            if evidence >= EVIDENCE and evidence >= MEAN_EVIDENCE * (end - start):
                found.append((start, 3, end, start))
    return found


def samples(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(string, label, n): labelled strings of all texts, counted in each task and added up.

    Label 1 has what the patterns take for secrets, label 0 the distinct words of everything else,
    each once, so common words don't drown the others; a long one counts as pieces of ``PIECE``.
    What is long enough to be judged later is left out, lest a model learn what it is to find.
    """
    def gather(batches):
        words: set[str] = set()
        secrets: Counter = Counter()

        def rows():
            out = [(w, 0, 1) for w in words] + [(s, 1, n) for s, n in secrets.items()]
            words.clear()
            secrets.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64())], names=["string", "label", "n"])

        for batch in batches:
            for t in batch.column(1):
                value = t.as_py()
                spans = base_spans(value)
                at, rest = 0, []
                for start, _, end, secret in spans:
                    secrets[value[secret:end]] += 1
                    rest.append(value[at:max(at, start)])
                    at = max(at, end)
                rest.append(value[at:])
                plain = {w for part in rest for w in part.split() if len(w) < LEAST_RANDOM or not CANDIDATE.search(w)}
                words.update(w[i:i + PIECE] for w in plain for i in range(0, len(w), PIECE))
                if len(words) + len(secrets) > MOST_WORDS:
                    yield rows()
        yield rows()

    counted = keyed_texts(docs, key, text).mapInArrow(gather, "string string, label int, n long")
    once = F.when(F.col("label") == 0, F.lit(1)).otherwise(F.sum("n")).cast("long")
    return counted.groupBy("string", "label").agg(once.alias("n"))


def transitions(labelled: DataFrame) -> DataFrame:
    """(label, a, b, c, n): how often character c follows a and b; as many rows as the alphabet allows."""
    other = "\x03"
    known = set(ALPHABET)

    def count(batches):
        totals: Counter = Counter()
        for batch in batches:
            for string, label, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                chars = START * 2 + "".join(c if c in known else other for c in string)
                for three in zip(chars, chars[1:], chars[2:]):
                    totals[(label, *three)] += n
        items = list(totals.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k, _ in items], pa.int32() if i == 0 else pa.string()) for i in range(4)] + [pa.array([n for _, n in items], pa.int64())],
            names=["label", "a", "b", "c", "n"])

    return labelled.mapInArrow(count, "label int, a string, b string, c string, n long").groupBy("label", "a", "b", "c").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame) -> Model | None:
    """Models from (string, label, n) rows; None where either label has no string.

    What comes to the driver is bounded by the alphabet, not by the rows.
    """
    rows = transitions(labelled).collect()
    by_label = {label: [tuple(r)[1:] for r in sorted(rows) if r["label"] == label] for label in (0, 1)}
    if not by_label[0] or not by_label[1]:
        return None
    return Model(fixed_order(by_label[1], ALPHABET), fixed_order(by_label[0], ALPHABET))


def scan(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base, spans) of every row, whole texts, no shuffle.

    ``base`` and ``spans`` list kind:start:end by start and then kind; ``base`` has the patterns'
    spans alone, ``spans`` the model's as well. Null and empty texts have none; repeated rows
    give repeated rows.
    """
    rows = keyed_texts(docs, key, text)
    schema = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), *[T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")],
        T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()),
    ])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def line(spans):
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)

    def search(batches):
        model = sent.value
        for batch in batches:
            out = []
            for t in batch.column(1):
                value = t.as_py()
                base = base_spans(value)
                kinds = [k for _, k, _, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), line(base), line(sorted(base + random_spans(value, base, model)))))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=schema.names)

    return rows.mapInArrow(search, schema).withColumnRenamed("key", key)
