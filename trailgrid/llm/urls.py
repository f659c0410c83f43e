"""URL filter: host and path rules first, then a ratio of character language models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid.llm.common import ASCII_LOWER, ASCII_UPPER, Memo
from trailgrid.llm.markov import START, VariableOrder, variable_order

#: Fixed values: (verdict, rule) as the contract lists them.
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
#: Host words that mark a labelled example as rejected: the sample that the models learn from.
REJECTED_WORDS = (
    "casino", "poker", "bets", "betting", "gamble", "lottery", "jackpot", "adult", "porn", "xxx", "sex", "escort",
    "spam", "viagra", "pharma", "pills", "replica", "malware", "warez", "torrent", "phishing", "clickbait",
)
ORDER = 4
LEAST_SEEN = 2
QUANTILE = 0.995


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def fits(host: Column, path: Column, rule: str) -> Column:
    """True where the host is the rule's or below it and the path starts with the rule's."""
    own, slash, rest = rule.partition("/")
    return ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        hit = fits(host, path, text)
        rule, verdict = F.when(hit, F.lit(text)).otherwise(rule), F.when(hit, F.lit(said)).otherwise(verdict)
    return rule, verdict


def labelled(parts: DataFrame, words=REJECTED_WORDS) -> DataFrame:
    """(host, path, rejected, n): each distinct labelled address once; hosts with a listed word are rejected."""
    rejected = F.rlike("host", F.lit("|".join(words)))
    return parts.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).select("host", "path", rejected.alias("rejected"), "n")


@dataclass
class Model:
    """Models of rejected and accepted addresses, and the score from which an address is rejected."""

    rejected: VariableOrder
    accepted: VariableOrder
    threshold: float = 0.0

    def score(self, address: str) -> float:
        """Log-likelihood of rejected less accepted, per character."""
        return (self.rejected.score(address) - self.accepted.score(address)) / max(1, len(address))


def address(host: Column, path: Column) -> Column:
    """What the models read: host and path with every digit as 0, so that numbers tell nothing."""
    return F.regexp_replace(F.concat(host, path), "[0-9]", "0")


def context_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(rejected, context, char, n) for contexts of 0 to ``order`` characters, counted in each task first."""
    def count(batches):
        totals: Counter = Counter()

        def out():
            items = list(totals.items())
            totals.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([k[0] for k, _ in items], pa.bool_()), pa.array([k[1] for k, _ in items], pa.string()),
                pa.array([k[2] for k, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64()),
            ], names=["rejected", "context", "char", "n"])

        for batch in batches:
            for text, rejected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                padded = START * order + text
                for i in range(order, len(padded)):
                    for n in range(order + 1):
                        totals[(rejected, padded[i - n:i], padded[i])] += 1
            if len(totals) > 500_000:
                yield out()
        yield out()

    return rows.mapInArrow(count, "rejected boolean, context string, char string, n long").groupBy("rejected", "context", "char").agg(F.sum("n").alias("n"))


def train(sample: DataFrame, order: int = ORDER, least: int = LEAST_SEEN, quantile: float = QUANTILE) -> Model | None:
    """Models from (address, rejected) rows; None where either label has none.

    Contexts of two and more characters need ``least`` sightings, so the model is as large as the
    repeated contexts of bounded length, not as the rows. The threshold lies between the labels'
    scores: halfway from the accepted ones' upper to the rejected ones' lower quantile, or at the
    former if they overlap.
    """
    rows = context_counts(sample.select("address", "rejected"), order).where((F.length("context") < 2) | (F.col("n") >= least)).collect()
    by = {label: [(r["context"], r["char"], r["n"]) for r in rows if r["rejected"] == label] for label in (True, False)}
    if not by[True] or not by[False]:
        return None
    model = Model(variable_order(by[True], order), variable_order(by[False], order))
    scored = sample.select("rejected", score_column(model, F.col("address")).alias("score"))
    ends = {r["rejected"]: r for r in scored.groupBy("rejected").agg(
        F.percentile_approx("score", quantile, 10_000).alias("upper"), F.percentile_approx("score", 1 - quantile, 10_000).alias("lower")).collect()}
    upper, lower = ends[False]["upper"], ends[True]["lower"]
    model.threshold = (upper + lower) / 2 if lower > upper else upper
    return model


def score_column(model: Model, text: Column) -> Column:
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Memo(model.score, 100_000)
        for texts in parts:
            yield texts.map(known.__getitem__).astype("float64")

    return F.pandas_udf(score, "double")(text)


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, words=REJECTED_WORDS) -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row.

    The longest fitting rule decides; else the models' score against the threshold. An address
    without host is allowed, as the models have nothing to read; so is all that no rule fits where
    the sample lacks one of the labels. Null urls have empty host and path; repeated rows repeat.
    """
    parts = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    sample = labelled(parts, words).withColumn("address", address(F.col("host"), F.col("path")))
    model = train(sample)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    text = address(F.col("host"), F.col("path"))
    score = F.when(F.col("host") != "", score_column(model, text)) if model else F.lit(None).cast("double")
    scored = parts.select("key", "host", "path", rule.alias("rule"), verdict.alias("said"), score.alias("score"))
    blocked = F.coalesce(F.col("score") > (model.threshold if model else 0.0), F.lit(False))
    return scored.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("said", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "score")
