"""SentencePiece ids by a table of distinct marked words, and texts back from ids."""

from __future__ import annotations

import math
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailgrid.llm.common import keyed_texts, ragged

MARK = "▁"
#: Characters of text in a block of rows, and bytes of text for each part of the table of words.
BLOCK_CHARS = 8_000_000
PART_BYTES = 16_000_000
#: A run of markers and what follows it up to the next marker.
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def model(path: str):
    """One per worker process."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def words_apart(path: str) -> bool:
    """True if words may be segmented alone: no piece holds a marker behind another character.

    Then nothing merges across the start of a marked word, so the segments of a text are those of
    its words. It also asks that the normaliser changes nothing but spaces, writes a marker in
    front, and that a lone marker is a piece.
    """
    m = model(path)
    plain = " a  éﬁ　\ttwo \nB "
    marked = m.piece_to_id(MARK)
    pieces = map(m.id_to_piece, range(m.get_piece_size()))
    return (
        not m.is_unknown(marked) and m.encode(MARK + "a") == m.encode(" a") and m.normalize(plain) == MARK + plain.replace(" ", MARK)
        and all(MARK not in p.lstrip(MARK) for p in pieces)
    )


def marked_words(text: str) -> list[str]:
    """Marked words of a text in order, each without its first marker.

    A space or a marker in the text is a marker; one more stands in front of a text that is not
    empty. A word is a run of markers with what follows it.
    """
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text:
        return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def word_ids(m, words: list[str]) -> list[list[int]]:
    """Ids of marked words; the library writes the first marker itself, but not for an empty text."""
    lone = [m.piece_to_id(MARK)]
    return [ids or lone for ids in m.encode(words, num_threads=1)]


class _Numbers(dict):
    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte place, compressed."""
    import zstandard

    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _packed_words(words: list[str]) -> tuple[bytes, bytes]:
    """(letters, lengths) of words, compressed."""
    import zstandard

    letters = [w.encode() for w in words]
    return zstandard.compress(b"".join(letters), 3), _packed(np.array([len(w) for w in letters]))


def _unpacked_words(letters: bytes, lengths: bytes) -> list[str]:
    import zstandard

    ends = np.cumsum(_unpacked(lengths))
    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype("<i4").tobytes())
    return pa.StringArray.from_buffers(len(ends), offsets, pa.py_buffer(zstandard.decompress(letters))).to_pylist()


def _blocks(batches, apart: bool, block_chars: int):
    """(block, keys, words for each key, words by number, all words as numbers) of one task's rows; a very common word has a small number.

    A block is named by its words, so whoever cuts the same rows names it alike.
    """
    import xxhash

    number, keys, counts, listed, chars = _Numbers(), [], [], [], 0

    def told():
        found = np.concatenate(listed)
        order = np.argsort(-np.bincount(found, minlength=len(number)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        spelt = list(number)
        words = [spelt[n] for n in order.tolist()]
        name = xxhash.xxh64_intdigest(repr((keys, counts)).encode() + "\0".join(words).encode()) >> 1
        return name, keys, np.array(counts), words, place[found] if len(found) else found

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            words = marked_words(text) if apart else [text] * bool(text)
            keys.append(key)
            counts.append(len(words))
            listed.append(np.fromiter((number[w] for w in words), np.int64, len(words)))
            chars += len(text) + 16
            if chars >= block_chars:
                yield told()
                number, keys, counts, listed, chars = _Numbers(), [], [], [], 0
    if keys:
        yield told()


def _part(word: str, parts: int) -> int:
    return zlib.crc32(word.encode()) % parts


def text_rows(rows: DataFrame, parts: int, apart: bool, block_chars: int) -> DataFrame:
    """(block, numbers, counts, parts, keys): a block's keys, its texts as word numbers, and each word's part of the table."""
    kind = rows.schema["key"].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("numbers", T.BinaryType()), T.StructField("counts", T.BinaryType()),
        T.StructField("parts", T.BinaryType()), T.StructField("keys", T.ArrayType(kind)),
    ])

    def work(batches):
        batches = iter(batches)
        for first in batches:
            key_type = first.schema.field(0).type
            for block, keys, counts, words, numbers in _blocks(chain([first], batches), apart, block_chars):
                row = (block, _packed(numbers), _packed(counts), _packed(np.array([_part(w, parts) for w in words], np.int64)), keys)
                types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(key_type))
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types)], names=schema.names)

    return rows.mapInArrow(work, schema)


def word_rows(rows: DataFrame, parts: int, apart: bool, block_chars: int) -> DataFrame:
    """(block, part, words, sizes): a block's distinct words, dealt over the ``parts`` of the table.

    A word is once in a block however often it occurs, so a very common one is one entry for each block.
    """
    def work(batches):
        for block, _, _, words, _ in _blocks(batches, apart, block_chars):
            dealt: dict[int, list[str]] = {}
            for word in words:
                dealt.setdefault(_part(word, parts), []).append(word)
            out = [(block, part, *_packed_words(members)) for part, members in dealt.items()]
            if out:
                types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["block", "part", "words", "sizes"])

    return rows.mapInArrow(work, "block long, part int, words binary, sizes binary")


def answered(words: DataFrame, path: str, apart: bool) -> DataFrame:
    """(block, part, lengths, ids): the ids of each block's words, in the order of the asking row.

    The table of distinct words lies in parts of a bounded size: a task fills one part at a time,
    segments a word when its first block asks for it, and answers every block from the table.
    """
    def look_up(batches):
        m = model(path)
        table, at = {}, None
        for batch in batches:
            out = []
            for block, part, letters, sizes in zip(*[c.to_pylist() for c in batch.columns]):
                if part != at:
                    table, at = {}, part
                asked = _unpacked_words(letters, sizes)
                new = [w for w in asked if w not in table]
                table.update(zip(new, word_ids(m, new) if apart else m.encode(new, num_threads=1)))
                found = [table[w] for w in asked]
                flat = np.fromiter(chain.from_iterable(found), np.int64)
                out.append((block, part, _packed(np.fromiter(map(len, found), np.int64, len(found))), _packed(flat)))
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["block", "part", "lengths", "ids"])

    asked = words.repartition("part").sortWithinPartitions("part", "block")
    return asked.mapInArrow(look_up, "block long, part int, lengths binary, ids binary")


def joined(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, ids) of every row, put together from its block's words by position."""
    kind = texts.schema["keys"].dataType.elementType

    def put(rows: pa.Table, found: pa.Table) -> pa.Table:
        told = {p: (_unpacked(n), _unpacked(i)) for p, n, i in zip(*[found.column(c).to_pylist() for c in ("part", "lengths", "ids")])}
        keys, ids, sizes = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for numbers, counts, parts, key in zip(*[rows.column(c) for c in ("numbers", "counts", "parts", "keys")]):
            parts = _unpacked(parts.as_py())
            size, start, flat, filled = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), [np.zeros(0, np.int64)], 0
            for part, (lengths, part_ids) in told.items():
                mine = np.flatnonzero(parts == part)
                size[mine], start[mine] = lengths, filled + np.cumsum(lengths) - lengths
                flat.append(part_ids)
                filled += len(part_ids)
            if (size == 0).any():
                raise RuntimeError("the rows of a partition changed between two readings: write the table first")
            words, counts = _unpacked(numbers.as_py()), _unpacked(counts.as_py())
            ids.append(np.concatenate(flat)[ragged(start[words], size[words])])
            ends, last = np.concatenate([[0], np.cumsum(size[words])]), np.cumsum(counts)
            sizes.append(ends[last] - ends[last - counts])
            keys.append(key.values)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        return pa.table({"key": pa.concat_arrays(keys), "ids": lists})

    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(put, schema)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", *, path: str | None = None,
           block_chars: int = BLOCK_CHARS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, ids) of every row: the ids of its whole text, without begin or end.

    Texts are cut into marked words where the vocabulary allows it (:func:`words_apart`; else a
    whole text is one word). Each distinct word is segmented once, in the part of the table that its
    hash names, and ids come back by position. Null and empty texts have no ids; keys may be null or
    repeat, an empty table gives an empty one. A block of rows is as long as its longest text at least.
    Texts are read and cut twice instead of being stored: rows are sorted within a partition, so a
    task that is run again cuts the same blocks, and blocks that differ all the same raise an error.
    """
    path = path or model_path()
    apart = words_apart(path)
    rows = keyed_texts(docs, key, text)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows, parts = rows.sortWithinPartitions("key", "text"), max(1, math.ceil(total / part_bytes))
    answers = answered(word_rows(rows, parts, apart, block_chars), path, apart)
    return joined(text_rows(rows, parts, apart, block_chars), answers).withColumnRenamed("key", key)


def id_lists(column: pa.ListArray):
    """The lists of a column of ids, one after the other, read from one array: an Arrow scalar for each id costs more than decoding."""
    ends = column.offsets.to_numpy()
    ids = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False)
    for start, stop in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist()):
        yield ids[start:stop].tolist()


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", *, path: str | None = None) -> DataFrame:
    """``key``, ``ids`` and the ``text`` that the ids stand for; null ids count as none."""
    path = path or model_path()
    rows = encoded.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def back(batches):
        m = model(path)
        for batch in batches:
            texts = [m.decode(x) for x in id_lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["key", "ids", "text"])

    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())])
    return rows.mapInArrow(back, schema).select(F.col("key").alias(key), F.col("ids").alias(ids), "text")
