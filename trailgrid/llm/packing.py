"""Best-fit packing of tokenised documents under several capacities at once."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailgrid.llm.common import keyed_texts
from trailgrid.session import checkpointed

MAX_TOKENS = 4096
END_ID = 1
SHARD_ROWS = 4096
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Below this character no text rule looks at a letter's neighbours, and small letters stay below it too.
LATIN_END = "\u0180"
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


#: Byte-level vocabularies write a printable byte as itself and the n-th of the others as character 256 + n.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTE_NAMES = [chr(b) if b in _SHOWN else chr(256 + _HIDDEN.index(b)) for b in range(256)]


def _latin(kind: str) -> str:
    return "".join(chr(c) for c in range(ord(LATIN_END)) if unicodedata.category(chr(c))[0] == kind)


BEYOND = re.compile(f"[^\0-{chr(ord(LATIN_END) - 1)}]")
#: What is a word of its own beside runs of letters: contractions, single digits, runs of marks.
PARTED = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_latin('N')}]|[^\s{_latin('L')}{_latin('N')}]+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Ranks:
    """A vocabulary's pieces as bytes, a space for a word's end, and how each is merged from two."""

    numbers: dict[bytes, int]
    left: dict[bytes, int]

    @staticmethod
    def of(path: str) -> Ranks:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte = {name: b for b, name in enumerate(BYTE_NAMES)}

        def spell(piece: str) -> bytes:
            word, last = piece.removesuffix("</w>"), piece.endswith("</w>")
            return bytes(byte[c] for c in word) + b" " * last

        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        return Ranks({spell(p): n for p, n in model["vocab"].items()}, {spell(x) + spell(y): len(spell(x)) for x, y in pairs})

    def agree(self) -> bool:
        """True if merging by the rank of the joint piece always merges as the vocabulary's pairs do.

        That holds if every piece, built alone by least rank, is built by its own pairs only: what
        lies within a piece of a text's result was merged as if it stood alone, so then each merge
        made was the pair of least rank as well.
        """
        return all(map(self._own_pairs, self.numbers))

    def _own_pairs(self, piece: bytes) -> bool:
        parts = [bytes([b]) for b in piece]
        if len(piece) > 1 and piece.endswith(b" "):
            parts[-2:] = [piece[-2:]]
        while len(parts) > 1:
            ranked = [(self.numbers[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.numbers]
            if not ranked:
                return False
            at = min(ranked)[1]
            joint = parts[at] + parts[at + 1]
            if self.left.get(joint) != len(parts[at]):
                return False
            parts[at:at + 2] = [joint]
        return True


@cache
def ranks_agree(path: str) -> bool:
    return Ranks.of(path).agree()


@cache
def text_ids(path: str, end_id: int, by_rank: bool) -> TextIds:
    """One per worker process."""
    return TextIds(path, end_id, by_rank)


class TextIds:
    """Ids of a text as little-endian unsigned 32-bit numbers, end id included.

    The vocabulary's text rules lower-case, cut at white space and part letters, single digits and
    runs of marks; nothing merges across a word's end. For Latin letters one substitution states
    these rules, and words are merged by rank, which is several times faster; it is used only for
    vocabularies whose ranks agree with their pairs. Other scripts, texts with a special token's
    name, and control characters that only Python takes for white space are encoded by the
    vocabulary's own rules.
    """

    def __init__(self, path: str, end_id: int = END_ID, by_rank: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.merge = None
        if by_rank:
            import tiktoken

            self.merge = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=Ranks.of(path).numbers, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        latin = self.merge and (text.isascii() or not BEYOND.search(text))
        if not latin or any(name in text for name in SPECIAL) or any(c in text for c in NOT_SPACE):
            return self.whole(text) + self.end
        words = PARTED.sub(r" \g<0> ", text.lower()).split()
        return np.array(self.merge(" ".join(words) + " ") if words else [], dtype="<u4").tobytes() + self.end


def tokenise(docs: DataFrame, key: str = "doc_id", text: str = "text", *, path: str | None = None,
             max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """(key, piece, start, length, ids) of every document; ``ids`` is binary, 4 bytes an id.

    Only a document of more than ``max_tokens`` ids is cut, into pieces of that length; the last
    may be shorter. A null or empty text is the end id alone; a null key is kept as null. No
    shuffle: each text is read and encoded where it lies.
    """
    path = path or vocabulary_path()
    rows = keyed_texts(docs, key, text)
    kind = rows.schema["key"].dataType
    schema = T.StructType([
        T.StructField("key", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    step, by_rank = max_tokens * 4, ranks_agree(path)

    def encode(batches):
        ids_of = text_ids(path, end_id, by_rank)
        for batch in batches:
            keys, pieces, parts = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(t.as_py())
                for n, at in enumerate(range(0, len(ids), step)):
                    keys.append(k)
                    pieces.append(n)
                    parts.append(ids[at:at + step])
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, batch.schema.field(0).type), pa.array(pieces, pa.int32()),
                pa.array([n * max_tokens for n in pieces], pa.int64()), pa.array([len(p) // 4 for p in parts], pa.int64()),
                pa.array(parts, pa.binary()),
            ], names=["key", "piece", "start", "length", "ids"])

    return rows.mapInArrow(encode, schema).withColumnRenamed("key", key)


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float],
             rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, longest first.

    An item needs its tokens, one document and its attention cost (length squared); a bin takes
    it only if all three fit. Of those, ``rule="norm"`` picks the least weighted norm of what is
    left, ``rule="dot"`` the greatest weighted product of need and room; ties go to the oldest.
    """
    need = np.stack([lengths, np.ones_like(lengths), lengths ** 2], axis=1) / np.array(capacities)
    weight = np.array(weights, dtype=float)
    room = np.empty((len(lengths), 3))
    number = np.empty(len(lengths), dtype=np.int64)
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    filled = np.zeros(len(lengths), dtype=np.int64)
    opened = made = 0
    slack = 1e-12
    order = np.argsort(-lengths, kind="stable")
    least = need[order[-1], 0] if len(order) else 0.0
    for item in order:
        n = need[item]
        left = room[:opened] - n
        fits = np.flatnonzero((left >= -slack).all(axis=1))
        if len(fits):
            worth = -((left[fits] ** 2) @ weight) if rule == "norm" else (room[fits] * n) @ weight
            at = fits[np.argmax(worth)]
            room[at] = left[at]
        else:
            at = opened
            opened += 1
            room[at], number[at] = 1.0 - n, made
            made += 1
        which = number[at]
        bins[item], offsets[item] = which, filled[which]
        filled[which] += lengths[item]
        if room[at, 0] < least - slack or room[at, 1] < -slack:
            opened -= 1
            room[at:opened], number[at:opened] = room[at + 1:opened + 1], number[at + 1:opened + 1]
    return bins, offsets


def pack(pieces: DataFrame, key: str = "doc_id", *, max_tokens: int = MAX_TOKENS, max_documents: int = MAX_TOKENS,
         max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
         rule: str = "norm", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Pieces are dealt evenly over shards of about ``shard_rows`` by a hash, and every shard packs
    its own; at most one sequence in each shard is left part empty for want of more pieces.
    Nothing but lengths and the columns of ``pieces`` moves, so leave the ids out of it. With
    the default document and attention limits only the tokens bind. A piece longer than the
    limits allow raises an error. An empty table gives an empty table.
    """
    capacities = (float(max_tokens), float(max_documents), float(max_attention or max_tokens ** 2))
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = checkpointed(pieces.select(*own))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(key, "piece", "start", "length"), F.lit(shards)))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(part: pd.DataFrame) -> pd.DataFrame:
        lengths = part["length"].to_numpy(dtype=np.int64)
        if len(lengths) and (lengths.max() > max_tokens or float(lengths.max()) ** 2 > capacities[2]):
            raise ValueError("a piece is longer than a sequence may be")
        bins, offsets = best_fit(lengths, capacities, weights, rule)
        return part.drop(columns="_shard").assign(sequence_id=int(part["_shard"].iloc[0]) * 2 ** 32 + bins, offset=offsets)

    return dealt.groupBy("_shard").applyInPandas(place, schema)


def sequences(tokens: DataFrame, packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, length, ids, pieces): the packed ids themselves, with where each piece lies.

    A sequence holds at most ``max_tokens`` ids, so its row is small.
    """
    placed = tokens.select(key, "piece", "ids").join(packed.select(key, "piece", "length", "sequence_id", "offset"), [key, "piece"])
    member = F.struct("offset", F.col(key).alias("key"), "piece", "length", "ids")
    return placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(member)).alias("m")).select(
        "sequence_id", F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"),
        F.aggregate("m", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("m", lambda x: F.struct(x["offset"].alias("offset"), x["key"].alias(key), x["piece"].alias("piece"), x["length"].alias("length"))).alias("pieces"),
    )


def packed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", *, path: str | None = None,
                     max_tokens: int = MAX_TOKENS, end_id: int = END_ID, **limits) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenise(docs, key, text, path=path, max_tokens=max_tokens, end_id=end_id)
    light = pieces.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(light, key, max_tokens=max_tokens, **limits)
