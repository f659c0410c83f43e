"""The language model at the values that its query registers."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_ops import VOCAB
from trailgrid.llm import lm


def test_every_word_is_a_target(spark):
    texts = ["one", "one two", "", "a b c d e f g h i j k l m n o p q r s t", "x y z", "one two three four"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    vocab = lm.vocabulary(lm.word_counts(docs))
    seen = lm.local_models(docs, vocab).where("chunk = 0").agg(F.sum("positions")).first()[0]
    assert seen == sum(len(t.split()) for t in texts)


def test_registered_training_learns_an_order(spark):
    rng = random.Random(3)
    chain = {w: rng.choice(VOCAB) for w in VOCAB}
    rows = []
    for n in range(60):
        line = [rng.choice(VOCAB)]
        while len(line) < 200:
            line.append(chain[line[-1]] if rng.random() < 0.9 else rng.choice(VOCAB))
        rows.append((n, " ".join(line)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    scorer = lm.train(docs)
    shuffled = spark.createDataFrame([(n, " ".join(rng.sample(t.split(), 200))) for n, t in rows], "doc_id long, text string")
    mean = lambda frame: frame.agg(F.avg("mean_pll")).first()[0]
    assert mean(lm.scores(docs, scorer)) > mean(lm.scores(shuffled, scorer)) + 0.2


def test_scores_do_not_depend_on_the_layout(spark):
    rng = random.Random(5)
    rows = [(n, None if n == 7 else " ".join(rng.choices(VOCAB, k=rng.choice([0, 1, 40, 3000])))) for n in range(120)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    seen = [sorted(map(tuple, lm.corpus_scores(docs.repartition(n)).collect())) for n in (1, 13)]
    assert seen[0] == seen[1] and len(seen[0]) == 125


def test_vocabulary_grows_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_WORDS", 4)
    known = []
    for size in (100, 10_000):
        docs = spark.createDataFrame([(n, " ".join(f"w{n * 10 + i}" for i in range(10))) for n in range(size // 10)], "doc_id long, text string")
        known.append(len(lm.vocabulary(lm.word_counts(docs)).words))
    assert known == [20, 200]


def test_rare_words_are_spelled_from_all_rare_words(spark):
    docs = spark.createDataFrame([(0, "the " * 9 + "qq qz qy"), (1, None), (2, "")], "doc_id long, text string")
    letters = lm.letter_counts(lm.word_counts(docs).where("n = 1"))
    assert letters[ord("q")] == 5 and letters[32] == 4 and letters[ord("t")] == 1


def test_words_part_at_ascii_white_space_only():
    rng = random.Random(9)
    texts = ["", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", "A b c", "　", "x" * 70_000, "é \U0001f600 中文"]
    texts += ["".join(rng.choices("aB \t\n\r\x0b\x0cé ", k=rng.randrange(40))) for _ in range(300)]
    found, counts = lm.split_words(pa.array(texts))
    plain = [t.lower().encode().split() for t in texts]
    assert counts.tolist() == [len(p) for p in plain]
    assert [w.encode() for w in found.to_pylist()] == [w for p in plain for w in p]


def test_reading_in_portions_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "the cat sat on the mat"), (1, None), (2, "rare zebra"), (3, "the " * 500)], "doc_id long, text string").coalesce(1)
    vocab = lm.vocabulary(lm.word_counts(docs), words=3)
    texts = pa.array([r.text or "" for r in docs.orderBy("doc_id").collect()])
    whole = vocab.read_all(texts)
    monkeypatch.setattr(lm, "PORTION", 8)
    parts = [(begin, vocab.read_all(piece)) for begin, piece in lm.portions(texts)]
    assert [b for b, _ in parts][0] == 0 and len(parts) > 1
    for i in range(3):
        assert np.array_equal(np.concatenate([p[i] for _, p in parts]), whole[i])
    assert set(whole[0].tolist()) <= set(range(1, vocab.size))
