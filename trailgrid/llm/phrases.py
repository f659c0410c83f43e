"""Collocations: n-grams counted by rolling fingerprints, checked against the text, scored by their weakest cut."""

from __future__ import annotations

import math
import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailgrid.llm.common import ragged
from trailgrid.operators.skew import split_join
from trailgrid.session import checkpointed, run_folder

WORDS = 3
LEAST = 10
SHARE = 50
TOP = 2000
MILLION = 1_000_000
SALT_ROWS = 200_000
#: Bytes of text in a block, and bytes of text for each bucket of fingerprints.
BLOCK_BYTES = 6_000_000
BUCKET_BYTES = 4_000_000
#: Two residues make the fingerprint, a third one the check.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)
BASES = (911_382_323, 972_663_749, 1_000_000_007)
PRINT_BITS = 52
NO_LANG = "und"
STEP = 4096
#: Letters summed, and words compared, at a time.
CHUNK = 64 * STEP
#: A-Z small, tabs as spaces, everything that parts pieces as a line end.
_PLAIN = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = re.compile(rb"[ \n]")
#: What an n-gram of the corpus costs to send: fingerprint, check, distance to the one before, words, occurrences.
_ENTRY = np.dtype([("print", "<u8"), ("check", "<u4"), ("step", "<u4"), ("words", "u1"), ("count", "<u4")])


@cache
def powers(prime: int, base: int, length: int) -> np.ndarray:
    """The first ``length`` powers of ``base``."""
    out = [1]
    for _ in range(length - 1):
        out.append(out[-1] * base % prime)
    return np.array(out, np.uint64)


def power_table(prime: int, base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers by high and low digit of the exponent, up to ``length`` at least."""
    return powers(prime, pow(base, STEP, prime), 1 << (length // STEP).bit_length()), powers(prime, base, STEP)


class Grams(NamedTuple):
    """The distinct n-grams of a block: occurrences, first place in its bytes, words, fingerprint and check."""

    count: np.ndarray
    at: np.ndarray
    words: np.ndarray
    print: np.ndarray
    check: np.ndarray


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of every word of plain text."""
    inside = np.concatenate([[False], (data != 32) & (data != 10), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).astype(np.int32)
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, np.searchsorted(np.flatnonzero(data == 10).astype(np.int32), starts).astype(np.int32)


def spaced_letters(data: np.ndarray) -> np.ndarray:
    """The words of plain text with one space behind each."""
    letters = np.append(data, np.uint8(32))
    inside = (letters != 32) & (letters != 10)
    letters[~inside] = 32
    inside[1:] |= inside[:-1].copy()
    return letters[inside]


def sums_before(letters: np.ndarray, places: np.ndarray, prime: int, base: int) -> np.ndarray:
    """Prefix polynomial of ``letters`` before each of the ascending ``places``, some letters at a time."""
    high, low = power_table(prime, base, len(letters))
    out, carry = np.empty(len(places), np.uint64), np.uint64(0)
    for at in range(0, len(letters) + 1, CHUNK):
        part = letters[at:at + CHUNK]
        rows = high[at // STEP:(at + len(part)) // STEP + 1, None]
        terms = (rows * low % np.uint64(prime)).ravel()[:len(part)] * (part + np.uint64(1)) % np.uint64(prime)
        sums = np.concatenate([[carry], carry + np.cumsum(terms)])
        begin, end = np.searchsorted(places, [at, at + CHUNK])
        out[begin:end] = sums[places[begin:end] - at]
        carry = sums[-1]
    return out


def exact_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """A number for each word, in order of first occurrence: the same for words of the same bytes and no others.

    Fingerprints group the words; every word is compared with its group's first one byte by byte,
    and only where some differ are the words numbered by their bytes instead.
    """
    number, _ = pd.factorize(prints)
    lengths, of = ends - starts, first_places(number)[number]
    same = (lengths == lengths[of]).all()
    for at in range(0, len(starts) if same else 0, CHUNK):
        n, mine, first = lengths[at:at + CHUNK], starts[at:at + CHUNK], starts[of[at:at + CHUNK]]
        same = same and (data[ragged(mine, n)] == data[ragged(first, n)]).all()
    if same:
        return number
    raw, seen = data.tobytes(), {}
    return np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist())], np.int64)


def first_places(number: np.ndarray) -> np.ndarray:
    """Where each of the numbers 0, 1, ... stands first."""
    first = np.empty(int(number.max()) + 1 if len(number) else 0, np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return first


def grams(plain: bytes, limit: int, most: int = WORDS, print_bits: int = PRINT_BITS) -> tuple[Grams, int]:
    """Distinct n-grams of up to ``most`` words that start before ``limit``, and the number of words that do.

    Prefix polynomials over the words, with one space behind each, give the hash of any n-gram as a
    difference; n-grams of a block are told apart by their words' exact numbers, not by the hash.
    """
    data = np.frombuffer(plain, np.uint8)
    starts, ends, piece = word_spans(data)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Grams(none, none, none, none, none), 0
    tight_end = np.cumsum(ends - starts + 1, dtype=np.int32)
    tight = tight_end - (ends - starts + 1)
    letters, places = spaced_letters(data), np.stack([tight, tight_end - 1], axis=1).ravel()
    sums = [sums_before(letters, places, prime, base) for prime, base in zip(PRIMES, BASES)]
    backs = [power_table(prime, pow(base, -1, prime), len(letters)) for prime, base in zip(PRIMES, BASES)]
    del letters, places

    def hashed(which: int, first: np.ndarray, n: int) -> np.ndarray:
        prime, (high, low) = np.uint64(PRIMES[which]), backs[which]
        back = high[tight[first] // STEP] * low[tight[first] % STEP] % prime
        return (sums[which][2 * (first + n) - 1] - sums[which][2 * first]) % prime * back % prime

    def prints(first: np.ndarray, n: int) -> np.ndarray:
        return (hashed(0, first, n) << np.uint64(31) | hashed(1, first, n)) % np.uint64(1 << print_bits)

    number = exact_numbers(data, starts, ends, prints(np.arange(len(starts)), 1))
    distinct, own, found = int(number.max()) + 1, int(np.searchsorted(starts, limit)), []
    exact, here = number, np.arange(len(starts))
    for n in range(1, most + 1):
        if n > 1:
            longer = here[:np.searchsorted(here, len(starts) - n + 1)]
            longer = longer[piece[longer] == piece[longer + n - 1]]
            exact, here = pd.factorize(exact[np.searchsorted(here, longer)] * distinct + number[longer + n - 1])[0], longer
        mine = int(np.searchsorted(here, own))
        at = here[first_places(exact[:mine])]
        found.append(Grams(np.bincount(exact[:mine]).astype(np.uint32), starts[at], np.full(len(at), n, np.uint8), prints(at, n), hashed(2, at, n).astype(np.uint32)))
    del sums, backs, exact, here, number, tight, tight_end, piece
    order = np.argsort(np.concatenate([g.at for g in found]), kind="stable")
    return Grams(*[np.concatenate(c)[order] for c in zip(*found)]), own


def phrase_at(plain: bytes, at: int, words: int) -> str:
    """The n-gram that starts at a place of plain text, its words one space apart."""
    end = at
    for _ in range(words):
        while plain[end:end + 1] == b" ":
            end += 1
        found = _END.search(plain, end)
        end = found.start() if found else len(plain)
    return b" ".join(plain[at:end].split()).decode()


def slices(plain: bytes, size: int, most: int):
    """(text, limit): a text in slices of about ``size`` bytes; each goes on for the n-grams that start before its limit."""
    tail, at = re.compile(rb"(?:[ \n]+[^ \n]+){0,%d}" % (most - 1)), 0
    while len(plain) - at > size and (end := _END.search(plain, at + size)):
        yield plain[at:tail.match(plain, end.start()).end()], end.start() - at
        at = end.start()
    yield plain[at:], len(plain) - at


def text_blocks(docs: DataFrame, lang: str, text: str, most: int, block_bytes: int) -> DataFrame:
    """(block, lang, limit, size, plain): the texts of each language in blocks, small letters, pieces by line, compressed."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pack(batches):
        import zstandard
        from pyspark import TaskContext

        block, held, sizes = TaskContext.get().partitionId() << 32, {}, {}

        def told(lang, plain, limit):
            nonlocal block
            block += 1
            row = (block, lang, limit, limit, zstandard.compress(plain, 3))
            return pa.RecordBatch.from_pylist([dict(zip(("block", "lang", "limit", "size", "plain"), row))])

        def flush(lang):
            plain = b"\n".join(held.pop(lang))
            sizes.pop(lang)
            return told(lang, plain, len(plain))

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                plain = t.as_py().encode().translate(_PLAIN)
                if len(plain) > block_bytes:
                    for part, limit in slices(plain, block_bytes, most):
                        yield told(name, part, limit)
                elif plain:
                    held.setdefault(name, []).append(plain)
                    sizes[name] = sizes.get(name, 0) + len(plain) + 1
                    if sizes[name] >= block_bytes:
                        yield flush(name)
                    elif sum(sizes.values()) >= 4 * block_bytes:
                        yield flush(max(sizes, key=sizes.get))
        for name in list(held):
            yield flush(name)

    return rows.mapInArrow(pack, "block long, lang string, limit long, size long, plain binary")


def sent_grams(blocks: DataFrame, most: int, bucket_bits: int, print_bits: int) -> DataFrame:
    """(lang, bucket, block, total, entries): each block's distinct n-grams, dealt by the high bits of their fingerprints.

    An entry is the rest of the fingerprint, the check, the place as a distance to the entry before,
    the number of words and the occurrences. Bucket -1 has the number of words in the block.
    """
    def spread(batches):
        import zstandard

        for batch in batches:
            for block, lang, limit, plain in zip(*[batch.column(i) for i in range(4)]):
                found, total = grams(zstandard.decompress(plain.as_py()), limit.as_py(), most, print_bits)
                bucket = (found.print >> np.uint64(print_bits - bucket_bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                names, sizes = np.unique(bucket[order], return_counts=True)
                cuts = np.cumsum(sizes)
                entries = np.zeros(len(order), _ENTRY)
                entries["print"] = found.print[order] & np.uint64((1 << (print_bits - bucket_bits)) - 1)
                entries["check"], entries["words"], entries["count"] = found.check[order], found.words[order], found.count[order]
                place = found.at[order]
                out = [(lang.as_py(), -1, block.as_py(), total, None)]
                for name, begin, end in zip(names.tolist(), [0, *cuts[:-1].tolist()], cuts.tolist()):
                    part = entries[begin:end]
                    part["step"] = np.diff(place[begin:end], prepend=0)
                    planes = part.view(np.uint8).reshape(-1, _ENTRY.itemsize).T.tobytes()
                    out.append((lang.as_py(), name, block.as_py(), 0, zstandard.compress(planes, 1)))
                types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["lang", "bucket", "block", "total", "entries"])

    schema = "lang string, bucket int, block long, total long, entries binary"
    return blocks.select("block", "lang", "limit", "plain").mapInArrow(spread, schema)


def frequent_places(sent: DataFrame, least: int) -> DataFrame:
    """(lang, words, block, at, n): where to read each n-gram that may occur ``least`` times or more, and how often it does.

    Fingerprints of a bucket are added up in one task's arrays. One whose checks all agree is a
    single row, with its first place; where checks differ, different n-grams share the fingerprint,
    and each block's own count and place is a row, to be added up by the text. Rows without a place
    hold a language's number of words.
    """
    def gather(batches):
        import zstandard

        at, held, names, total = None, [], [], 0

        def told():
            if at[1] < 0:
                columns = [[at[0]], [0], [None], [None], [total]]
            else:
                entries, block = np.concatenate(held), np.repeat(names, [len(h) for h in held])
                place = np.concatenate([np.cumsum(h["step"], dtype=np.int64) for h in held])
                order = np.lexsort((block, entries["print"]))
                entries, block, place = entries[order], block[order], place[order]
                first = np.flatnonzero(np.concatenate([[True], entries["print"][1:] != entries["print"][:-1]]))
                sums = np.add.reduceat(entries["count"], first, dtype=np.int64)
                alike = np.ones(len(first), bool)
                for field in ("check", "words"):
                    alike &= np.minimum.reduceat(entries[field], first) == np.maximum.reduceat(entries[field], first)
                plain = first[alike & (sums >= least)]
                mixed = np.flatnonzero(np.repeat(~alike & (sums >= least), np.diff(first, append=len(entries))))
                rows = np.concatenate([plain, mixed])
                counts = np.concatenate([sums[alike & (sums >= least)], entries["count"][mixed].astype(np.int64)])
                columns = [[at[0]] * len(rows), entries["words"][rows], block[rows], place[rows], counts]
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "words", "block", "at", "n"])

        for batch in batches:
            for lang, bucket, block, words, entries in zip(*[batch.column(i) for i in range(5)]):
                key = (lang.as_py(), bucket.as_py())
                if key != at:
                    if at:
                        yield told()
                    at, held, names, total = key, [], [], 0
                total += words.as_py()
                if key[1] >= 0:
                    planes = np.frombuffer(zstandard.decompress(entries.as_py()), np.uint8)
                    held.append(planes.reshape(_ENTRY.itemsize, -1).T.copy().view(_ENTRY).ravel())
                    names.append(block.as_py())
        if at:
            yield told()

    ordered = sent.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", "block")
    return ordered.mapInArrow(gather, "lang string, words int, block long, at long, n long")


def read_phrases(places: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lang, words, phrase, n) of the n-grams at ``places``, read from the text and added up by it."""
    def read(found: pa.Table, texts: pa.Table) -> pa.Table:
        import zstandard

        plain = zstandard.decompress(texts.column("plain")[0].as_py()) if found.num_rows else b""
        told = [phrase_at(plain, at, n) for at, n in zip(found.column("at").to_pylist(), found.column("words").to_pylist())]
        return pa.table({"lang": found.column("lang"), "words": found.column("words"), "phrase": pa.array(told, pa.string()), "n": found.column("n")})

    here = places.where("words > 0").select("block", "lang", "words", "at", "n").groupBy("block")
    told = here.cogroup(blocks.select("block", "plain").groupBy("block")).applyInArrow(read, "lang string, words int, phrase string, n long")
    return told.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", *, most: int = WORDS, least: int = LEAST, block_bytes: int = BLOCK_BYTES,
                  bucket_bytes: int = BUCKET_BYTES, print_bits: int = PRINT_BITS) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): every n-gram of up to ``most`` words with n >= ``least`` in its language, and each language's words.

    Texts are cut at ``[.,;:!?]`` and line ends into pieces, those at spaces and tabs into words; A-Z
    count as a-z. A null language is ``und``, a null text empty. What moves is fingerprints with
    counts and places, and once the compressed text, to read the frequent ones.
    """
    spark = docs.sparkSession
    out = run_folder(spark, "phrases")
    text_blocks(docs, lang, text, most, block_bytes).write.parquet(out)
    blocks = spark.read.parquet(out)
    size = blocks.agg(F.sum("size")).first()[0] or 1
    bits = min(max(0, math.ceil(math.log2(size / bucket_bytes))), print_bits)
    places = checkpointed(frequent_places(sent_grams(blocks, most, bits, print_bits), least))
    totals = places.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return read_phrases(places, blocks).where(F.col("n") >= least), totals


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of two words or more, by their weakest cut.

    A cut into a first and a rest that occur l and r times scores floor(1000000 a a / (l r)), worked
    out in whole numbers of 38 digits; the least counts, of equals the one after fewest words.
    """
    part = lambda begin, n: F.array_join(F.slice("parts", begin, n), " ")
    longer = phrases.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("parts"))
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        known = phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
        cuts = split_join(cuts, known, ["lang", side], ["phrase"])
    whole = "cast({0} as decimal(15,0))".format
    cuts = cuts.withColumn("score", F.expr(f"{MILLION} * {whole('a')} * {whole('a')} div ({whole('l')} * {whole('r')})"))
    least = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def within_longer(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, most): the most frequent longer phrase around each phrase of two words or more."""
    longer = phrases.where("words >= 3").select("lang", "words", "n", F.split("phrase", " ").alias("parts"))
    spans = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = spans.select("lang", F.array_join(F.slice("parts", F.col("begin"), F.col("size")), " ").alias("phrase"), "n")
    return inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", *, share: int = SHARE, top: int = TOP, **counting) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by score, then a, then bytes.

    A phrase that lies within a longer frequent one goes where that one occurs ``share`` percent as
    often or more. Ranks are taken in salted parts first, so no language is one task's sort. An
    empty table, or one without frequent phrases, gives no row.
    """
    counted, totals = phrase_counts(docs, lang, text, **counting)
    phrases = checkpointed(counted)
    kept = scored(phrases).join(within_longer(phrases), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True)))
    parts = phrases.count() // SALT_ROWS + 1
    salted = kept.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
