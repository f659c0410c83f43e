"""Masked pseudo-likelihood: a small bidirectional window network, trained in numpy, scores documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailgrid.llm.common import keyed_texts
from trailgrid.session import checkpointed

LEAST_WORDS, MOST_WORDS = 4096, 64_000
TAILS = 64
CLASSES = 48
TAIL_CLASSES = 4
OFFSETS = (-2, -1, 1, 2)
HIDDEN = 16
EVERY = 1
RATE = 0.15
STEP = 1024
CHUNK = 16_384
FAN_IN = (1024, 32, 1)
BLOCK = 8192
WAITING_WORDS = 200_000
PORTION = 4 << 20
READINGS = 200


def portions(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(start, texts) in runs of about ``PORTION`` bytes; a longer text is a run of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PORTION, prepend=-1))
    for begin, end in zip(starts, np.append(starts[1:], len(texts))):
        yield int(begin), texts.slice(int(begin), int(end - begin))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts end to end, number of words of each): lower-cased, parted at ASCII white space."""
    bare = pc.ascii_trim_whitespace(pc.utf8_lower(texts.cast(pa.string())))
    lists = pc.ascii_split_whitespace(bare)
    words, counts = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(bare, "").to_numpy(zero_copy_only=False)
    if blank.any():
        words, counts = words.filter(pc.not_equal(words, "")), np.where(blank, 0, counts)
    return words, counts


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, where each begins and the last ends) of an array that owns its buffers."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8), ends


@dataclass
class Vocabulary:
    """Known words, the output class of each number and the log-probability of a word within its class.

    Number 0 stands beyond either end of a text, then come the words and then the tails: a rare
    word is read as the hash of its last two letters, and is spelled out in byte log-probabilities
    on top of its class. ``total`` counts the corpus's words.
    """

    words: pa.Array
    of_class: np.ndarray
    within: np.ndarray
    spelling: np.ndarray
    total: int

    @property
    def size(self) -> int:
        return len(self.of_class)

    def read_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers of all texts, how many each has, log-probability of each text's words given their classes)."""
        words, counts = split_words(texts)
        found = pc.index_in(words, value_set=self.words)
        numbers = pc.add(pc.fill_null(found, -1), 1).to_numpy(zero_copy_only=False).astype(np.uint16)
        text_of = np.repeat(np.arange(len(counts)), counts)
        rare = np.flatnonzero(numbers == 0)
        spelt = 0.0
        if len(rare):
            data, ends = _bytes_of(words.take(pa.array(rare)))
            last, ahead = ends[1:] - 1, np.maximum(ends[1:] - 2, ends[:-1])
            numbers[rare] = 1 + len(self.words) + (data[last] * np.int64(131) + data[ahead]) % TAILS
            letters = np.add.reduceat(self.spelling[data[:ends[-1]]], ends[:-1]) + self.spelling[32]
            spelt = np.bincount(text_of[rare], letters, minlength=len(counts))
        return numbers, counts, np.bincount(text_of, self.within[numbers], minlength=len(counts)) + spelt

    def read(self, text: str) -> tuple[np.ndarray, float]:
        """(word numbers of a text, log-probability of its words given their classes)."""
        numbers, _, known = self.read_all(pa.array([text]))
        return numbers, float(known[0])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over the words of all texts, counted in each task first."""
    def count(batches):
        totals: Counter = Counter()

        def out():
            items = [pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())]
            totals.clear()
            return pa.RecordBatch.from_arrays(items, names=["word", "n"])

        for batch in batches:
            for _, texts in portions(batch.column(0)):
                found = pc.value_counts(split_words(texts)[0])
                totals.update(dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist())))
                if len(totals) > WAITING_WORDS:
                    yield out()
        yield out()

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(counts: DataFrame) -> np.ndarray:
    """How often each byte occurs in the words of (word, n), a blank behind each word."""
    def letters(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            if batch.num_rows:
                n = batch.column(1).to_numpy()
                data, ends = _bytes_of(pa.concat_arrays([batch.column(0).cast(pa.string())]))
                of_word = np.repeat(np.arange(len(n)), np.diff(ends))
                total += np.bincount(data[ends[0]:ends[-1]], n[of_word], minlength=256).astype(np.int64)
                total[32] += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], names=["letter", "n"])

    found = np.ones(256)
    for r in counts.select("word", "n").mapInArrow(letters, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():
        found[r["letter"]] += r["n"]
    return found


def vocabulary(counts: DataFrame, words: int | None = None) -> Vocabulary | None:
    """The ``words`` most frequent words of ``counts``, in classes of about equal mass; None without any.

    By default twice the square root of the corpus's words are known, as a corpus's distinct words
    grow with about its root; at least ``LEAST_WORDS``, and at most ``MOST_WORDS`` so that a network
    (256 bytes a word) fits in every task. All other words are told apart by spelling, from the
    bytes of all of them. A table of words by power of two of their count tells from which power on
    enough words are left, so that only those are ranked; it and the chosen words come to the driver.
    """
    counts = checkpointed(counts)
    power = F.floor(F.log2("n"))
    by_power = sorted(counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect(), reverse=True)
    if not by_power:
        return None
    total, least, found = sum(r["n"] for r in by_power), by_power[0]["power"], 0
    words = words or min(max(LEAST_WORDS, 2 * math.isqrt(total)), MOST_WORDS)
    for r in by_power:
        if found < words:
            least, found = r["power"], found + r["words"]
    rows = counts.where(power >= least).orderBy(F.desc("n"), "word").limit(words).collect()
    mass = np.sqrt(np.array([r["n"] for r in rows], dtype=float))
    place = np.cumsum(mass) / mass.sum()
    size = 1 + len(rows) + TAILS
    of_class = np.zeros(size, dtype=np.int64)
    of_class[1:1 + len(rows)] = np.minimum((place * (CLASSES - TAIL_CLASSES)).astype(np.int64), CLASSES - TAIL_CLASSES - 1)
    of_class[1 + len(rows):] = CLASSES - TAIL_CLASSES + np.arange(TAILS) % TAIL_CLASSES
    weight = np.full(size, 1.0)
    weight[1:1 + len(rows)] = [r["n"] for r in rows]
    weight[0] = 0
    rest = max(1.0, total - weight[1:1 + len(rows)].sum())
    weight[1 + len(rows):] = rest / TAILS
    mass = np.bincount(of_class, weight, CLASSES)
    weight[0] = 1
    within = np.log(weight / np.maximum(mass[of_class], 1.0))
    last = rows[-1]
    letters = letter_counts(counts.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > last["word"]))))
    return Vocabulary(pa.array([r["word"] for r in rows], pa.string()), of_class, within, np.log(letters / letters.sum()), total)


@dataclass
class Network:
    """Embeddings for each place in the window, one hidden layer, a softmax over classes."""

    embed: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def start(size: int) -> Network:
        seed = np.random.default_rng(7)
        return Network(
            (seed.standard_normal((len(OFFSETS), size, HIDDEN)) * 0.1).astype(np.float32), np.zeros(HIDDEN, np.float32),
            (seed.standard_normal((HIDDEN, CLASSES)) * 0.1).astype(np.float32), np.zeros(CLASSES, np.float32),
        )

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.embed, self.bias, self.out, self.out_bias

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @staticmethod
    def from_flat(flat: np.ndarray, size: int) -> Network:
        shapes = [p.shape for p in Network.start(size).parts()]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return Network(*[part.reshape(s).astype(np.float32) for part, s in zip(np.split(flat, ends[:-1]), shapes)])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.embed[0, around[:, 0]] + self.bias
        for i in range(1, len(OFFSETS)):
            total += self.embed[i, around[:, i]]
        return np.tanh(total)

    def class_chances(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability of every class, hidden layer) for rows of surrounding word numbers."""
        hidden = self.hidden(around)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logits, hidden

    def learn(self, around: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step down the mean log loss of a block of positions."""
        chances, hidden = self.class_chances(around)
        slope = np.exp(chances)
        slope[np.arange(len(target)), target] -= 1
        back = (slope @ self.out.T) * (1 - hidden ** 2)
        self.out -= rate / len(target) * (hidden.T @ slope)
        self.out_bias -= rate / len(target) * slope.sum(axis=0)
        self.bias -= rate / len(target) * back.sum(axis=0)
        seen = np.zeros(self.embed.shape[1], np.float32)
        for i in range(len(OFFSETS)):
            at = around[:, i].astype(np.int64)
            np.add.at(seen, at, np.float32(1))
            step = back * (rate / np.sqrt(seen[at]))[:, None]
            seen[at] = 0
            cells = (at * HIDDEN)[:, None] + np.arange(HIDDEN)
            np.subtract.at(self.embed[i].reshape(-1), cells.ravel(), step.ravel())


def around(numbers: np.ndarray, begin: int, end: int, every: int = 1) -> np.ndarray:
    """Word numbers to both sides of every ``every``-th position from begin to end; 0 beyond the ends."""
    reach = max(OFFSETS)
    wide = np.zeros(end - begin + 2 * reach, numbers.dtype)
    low, high = max(0, begin - reach), min(len(numbers), end + reach)
    wide[low - begin + reach:high - begin + reach] = numbers[low:high]
    return np.stack([wide[reach + o:reach + o + end - begin:every] for o in OFFSETS], axis=1)


def encoded(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, ids, known): a text's word numbers in two bytes each, and ``Vocabulary.read_all``'s sum."""
    rows = keyed_texts(docs, key, text)
    schema = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("known", T.DoubleType()),
    ])
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches):
        vocab = sent.value
        for batch in batches:
            for begin, texts in portions(batch.column(1)):
                numbers, counts, known = vocab.read_all(texts)
                ends = np.concatenate(([0], np.cumsum(counts) * 2)).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(numbers)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(counts), ids, pa.array(known)], names=schema.names)

    return rows.mapInArrow(read, schema)


def shard_models(read: DataFrame, vocabulary: Vocabulary, every: int = EVERY, rate: float = RATE) -> DataFrame:
    """(part, chunk, weights, positions): a network per shard, trained on that shard's texts.

    All shards start alike. Each position of every text is predicted from both sides, so all words
    of all documents take part and the work grows with them. A shard is a hash of key and text and
    is read in the order of that hash; there are as many as the corpus's words give, ``READINGS`` for
    each word of the vocabulary. So the networks do not depend on how the rows were laid out. An
    ``every`` above 1 takes only every so many positions, from an offset that turns with the texts.
    """
    shards = max(1, math.ceil(vocabulary.total / (READINGS * vocabulary.size)))
    size, sent = vocabulary.size, read.sparkSession.sparkContext.broadcast(vocabulary.of_class)

    def train(batches):
        of_class, net = sent.value, Network.start(size)
        rows, targets, waiting, seen, turn, part = [], [], 0, 0, 0, 0

        def learn(least):
            nonlocal rows, targets, waiting, seen
            block, goal = np.concatenate(rows), np.concatenate(targets)
            end = len(block) if least == 0 else len(block) - len(block) % least
            for begin in range(0, end, STEP):
                net.learn(block[begin:begin + STEP], goal[begin:begin + STEP], rate)
            seen, waiting, rows, targets = seen + end, len(block) - end, [block[end:]], [goal[end:]]

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                numbers, part = np.frombuffer(ids.as_buffer(), np.uint16), shard
                for begin in range(turn % every, len(numbers), BLOCK * every):
                    end = min(begin + BLOCK * every, len(numbers))
                    rows.append(around(numbers, begin, end, every))
                    targets.append(of_class[numbers[begin:end:every]])
                    waiting += len(rows[-1])
                    if waiting >= STEP:
                        learn(STEP)
                turn += 1
        if waiting:
            learn(0)
        if seen:
            flat = net.flat().astype(np.float64) * seen
            pieces = [flat[i:i + CHUNK].astype(np.float32).tobytes() for i in range(0, len(flat), CHUNK)]
            columns = [pa.array([part] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary()), pa.array([seen] * len(pieces), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "weights", "positions"])

    hashed = read.where("n_words > 0").select("ids", F.xxhash64("ids", "key").alias("h"))
    dealt = hashed.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).repartitionById(shards, "shard")
    ordered = dealt.sortWithinPartitions("h", "ids").select("shard", "ids")
    return ordered.mapInArrow(train, "part int, chunk int, weights binary, positions long")


def local_models(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", every: int = EVERY, rate: float = RATE, key: str = "doc_id") -> DataFrame:
    """``shard_models`` of texts."""
    return shard_models(encoded(docs, vocabulary, key, text), vocabulary, every, rate)


def averaged(models: DataFrame) -> np.ndarray | None:
    """Mean of the networks, weighted by the positions each has seen; sums by steps, so none gathers all.

    Networks are added in an order of their own, whichever arrives first.
    """
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["positions", "weights"])
        total = np.sum([np.frombuffer(w, np.float32) for w in rows["weights"]], axis=0, dtype=np.float64).astype(np.float32)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "chunk": [rows["chunk"].iloc[0]], "weights": [total.tobytes()], "positions": [rows["positions"].sum()]})

    summed = models
    for fan in FAN_IN:
        summed = summed.select((F.col("part") % fan).alias("part"), "chunk", "weights", "positions").groupBy("part", "chunk").applyInPandas(add, "part int, chunk int, weights binary, positions long")
    rows = sorted(summed.collect(), key=lambda r: r["chunk"])
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r["weights"], np.float32) for r in rows]) / rows[0]["positions"]


@dataclass
class Scorer:
    vocabulary: Vocabulary
    network: Network

    def chances(self, numbers: np.ndarray) -> float:
        """Sum over a text's words of log P(class | both sides)."""
        total, classes = 0.0, self.vocabulary.of_class[numbers]
        for begin in range(0, len(numbers), BLOCK):
            end = min(begin + BLOCK, len(numbers))
            chances, _ = self.network.class_chances(around(numbers, begin, end))
            total += float(chances[np.arange(end - begin), classes[begin:end]].sum(dtype=np.float64))
        return total


def fitted(read: DataFrame, vocabulary: Vocabulary, every: int = EVERY) -> Scorer | None:
    """The network of texts that are word numbers already."""
    flat = averaged(shard_models(read, vocabulary, every))
    return None if flat is None else Scorer(vocabulary, Network.from_flat(flat, vocabulary.size))


def train(docs: DataFrame, text: str = "text", every: int = EVERY, key: str = "doc_id") -> Scorer | None:
    """Vocabulary and network from all texts; None where no text has a word."""
    vocab = vocabulary(word_counts(docs, text))
    return None if vocab is None else fitted(encoded(docs, vocab, key, text), vocab, every)


def scored(read: DataFrame, scorer: Scorer, key: str = "doc_id") -> DataFrame:
    """``scores`` of texts that are word numbers already."""
    schema = T.StructType([read.schema["key"], T.StructField("n_words", T.LongType()), T.StructField("pll", T.DoubleType())])
    sent = read.sparkSession.sparkContext.broadcast(scorer)

    def measure(batches):
        scorer = sent.value
        for batch in batches:
            sums = [scorer.chances(np.frombuffer(ids.as_buffer(), np.uint16)) for ids in batch.column(2)]
            pll = np.array(sums, np.float64) + batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pll)], names=schema.names)

    found = read.select("key", "n_words", "ids", "known").mapInArrow(measure, schema)
    return found.select(F.col("key").alias(key), "n_words", "pll", F.when(F.col("n_words") > 0, F.col("pll") / F.col("n_words")).alias("mean_pll"))


def scores(docs: DataFrame, scorer: Scorer | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, pll, mean_pll) of every row, whole texts.

    ``pll`` sums log P(class | both sides) + log P(word | class) over all words; ``mean_pll`` is
    that by word, null where a text has none (its ``pll`` is 0). Null counts as empty; repeated
    rows score alike. Without a scorer every row counts as having no words. Texts are not shuffled.
    """
    if scorer is None:
        none = F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("pll"), F.lit(None).cast("double").alias("mean_pll")
        return docs.select(F.col(key), *none)
    return scored(encoded(docs, scorer.vocabulary, key, text), scorer, key)


def corpus_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``scores`` of all texts by a network trained on them; words are numbered once for both."""
    vocab = vocabulary(word_counts(docs, text))
    if vocab is None:
        return scores(docs, None, key, text)
    read = checkpointed(encoded(docs, vocab, key, text))
    return scored(read, fitted(read, vocab), key)
