"""The prefix trie, SentencePiece by distinct words and collocations, each against a brute-force version."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_ops import SCHEMA, VOCAB, lower
from tests.oracle import normalise
from trailgrid.llm import phrases, pieces, queries, trie

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- prefix trie

def trie_brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + said[h:]
    nodes = {}
    for c, said in made.items():
        for d in range(len(said) + 1):
            nodes.setdefault(tuple(said[:d]), []).append(c)
    out = []
    children, leaves, saved = Counter(), Counter(), Counter()
    for path in nodes:
        children[path[:-1]] += bool(path)
    for path, members in nodes.items():
        worth = (len(members) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += worth
    for path, members in nodes.items():
        ends = sorted(c for c in members if len(made[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children[path], leaves[path], saved[path], sha(",".join(map(str, ends)))))
    return out


def conversation_rows():
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for turn in range(rng.randrange(1, 12)):
            rows.append((c, turn, rng.choice(("user", "assistant")), rng.choice(("ja", "nein", "é ü", "", None))))
    rows += [(100 + c, t, "user", "same") for c in range(40) for t in range(10)]
    rows += [(200, t, "user", f"long {t % 7}") for t in range(700)] + [(203, t, "user", f"long {t % 7}") for t in range(690)]
    rows += [(301, None, None, "first"), (301, 0, "a", "x"), (301, 0, "a", "x"), (301, 0, None, "y"), (301, 0, "a", None), (None, 1, "user", "lost"), (None, None, None, None)]
    return rows + [(407, 0, "user", "alone"), (2 ** 40 + 1, 0, "user", "far")]


def test_trie_matches_brute_force(spark):
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, ka string, conv int").repartition(5)
    got = trie.conversation_trie(frame)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(trie_brute(rows), key=repr)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(none).count() == 0
    only = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(only).count() == 0


def test_running_totals_span_parts(spark):
    rng = random.Random(8)
    rows = [(g, i, rng.randrange(-2 ** 60, 2 ** 60)) for g, n in ((1, 40), (2, 1), (3, 77), (4, 2)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g long, i long, v long")
    got = trie.scanned(frame, "g", ["i"], {"n": (F.lit(1).cast("long"), "sum"), "x": (F.col("v"), "bit_xor")}, part_rows=6).collect()
    want, seen = [], {}
    for g, i, v in rows:
        n, x = seen.get(g, (0, 0))
        seen[g] = (n + 1, x ^ v)
        want.append((g, i, v, *seen[g]))
    assert sorted(map(tuple, got)) == want


def test_end_lists_in_pieces(spark):
    ends = [(1, 5, 6, c) for c in range(500, 0, -1)] + [(0, 0, 0, 7)] + [(1, 5, 7, c) for c in (9, 10, 8)]
    got = trie.end_lists(spark.createDataFrame(ends, "depth long, ka long, kb long, conv long").repartition(4), part_rows=50).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0, sha("7")), (1, 5, 6, sha(",".join(map(str, range(1, 501))))), (1, 5, 7, sha("8,9,10"))]


# --- SentencePiece

def test_marked_words_are_segmented_alone():
    m, rng = pieces.model(pieces.model_path()), random.Random(1)
    assert pieces.words_apart(pieces.model_path())
    letters = [*" ▁  ab\n\t.é日𝔘\0\1<0>s/Ａ", "the ", "hello", "▁▁", "   "]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        assert [i for ids in pieces.word_ids(m, pieces.marked_words(text)) for i in ids] == m.encode(text)


@pytest.mark.parametrize("sizes", [{}, {"block_chars": 300, "part_bytes": 500}])
def test_encode_and_decode_match_the_library(spark, sizes):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.randrange(60)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " "), (53, "  two  spaces "), (54, "▁mark ▁▁ x"), (55, "日本語 𝔘\t\n</s>"), (None, "no key"), (None, None), (3, "again"), (3, "again"),
             (56, "x" * 30000), (57, "long word " * 9000)]
    frame = spark.createDataFrame([(k, t, "k", 1, 2, "d", 3, 4, 5, "s") for k, t in rows], SCHEMA).repartition(3)
    m = pieces.model(pieces.model_path())
    told = pieces.decode(pieces.encode(frame, **sizes))
    assert told.columns == ["doc_id", "ids", "text"]
    want = [(k, m.encode(t or ""), m.decode(m.encode(t or ""))) for k, t in rows]
    assert sorted(((r.doc_id, r.ids, r.text) for r in told.collect()), key=repr) == sorted(want, key=repr)
    assert pieces.decode(pieces.encode(frame.limit(0))).collect() == []
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect() == [(1, [], "")]


def test_whole_texts_where_words_do_not_stand_alone(spark, monkeypatch):
    monkeypatch.setattr(pieces, "words_apart", lambda path: False)
    frame = spark.createDataFrame([(1, "a  b c"), (2, ""), (3, "a  b c")], "doc_id long, text string")
    m = pieces.model(pieces.model_path())
    assert sorted((r.doc_id, r.ids) for r in pieces.encode(frame).collect()) == [(1, m.encode("a  b c")), (2, []), (3, m.encode("a  b c"))]


def test_sentencepiece_query(spark):
    m = pieces.model(pieces.model_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(k, len(i), sha(",".join(map(str, i))), sha(m.decode(i))) for k, i in ((r[0], m.encode(r[1] or "")) for r in docs)]
    assert sorted(map(tuple, queries.QUERIES["op12_sentencepiece"](spark, SF).collect())) == sorted(want)


# --- collocations

def split_words(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)) for w in [[x for x in re.split(r"[\x20\x09]+", p) if x]] if w]


def collocations_brute(rows, most=3, least=10, share=50, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        for ws in split_words(text):
            totals[lang or "und"] += len(ws)
            for n in range(1, most + 1):
                counts.setdefault(lang or "und", Counter()).update(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, x, y, totals[lang], -s) for n, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return out


def phrase_rows():
    rng = random.Random(4)
    said = ["new york city", "New  York", "ab\tcd ef gh", "É é", "x", "a b c"]
    rows = [(rng.choice(("en", "de", None)), " ".join(rng.choice(said + VOCAB[:9]) + rng.choice(("", "", ",", ".", "\n", "  ")) for _ in range(rng.randrange(1, 40)))) for _ in range(500)]
    return rows + [("en", None), (None, None), ("de", ""), ("en", " .,; \n"), ("en", "new york city " * 800), ("fr", "solo"), *[rows[0]] * 3]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 900, "bucket_bytes": 700}, {"block_bytes": 2000, "bucket_bytes": 4000, "print_bits": 7, "most": 4}])
def test_collocations_match_brute_force(spark, sizes):
    rows = phrase_rows()
    frame = spark.createDataFrame([(l, t, 1, "p", 2, 3) for l, t in rows], "lang string, text string, block int, phrase string, n int, words int").repartition(4)
    got = phrases.collocations(frame, **sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = collocations_brute(rows, sizes.get("most", 3))
    assert len(want) > 25 and sorted(map(tuple, got.collect())) == sorted(want)


def test_few_ranks_and_no_rows(spark):
    rows = phrase_rows()
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(frame, top=3, least=4, share=101).collect())) == sorted(collocations_brute(rows, least=4, share=101, top=3))
    assert phrases.collocations(frame.limit(0)).count() == 0 and phrases.collocations(frame.where("lang = 'fr'")).count() == 0


def test_grams_tell_words_apart_whatever_their_prints():
    rng = random.Random(6)
    plain = " ".join(rng.choice(VOCAB) for _ in range(400)).encode() + b"\n\n  " + b"ka ka  ka\nlo"
    want = Counter()
    for line in plain.split(b"\n"):
        ws = line.split()
        want.update(tuple(ws[i:i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1))
    for bits in (56, 4):
        found, total = phrases.grams(plain, len(plain), print_bits=bits)
        assert total == sum(v for k, v in want.items() if len(k) == 1)
        got = {tuple(phrases.phrase_at(plain, int(a), int(n)).encode().split()): int(c) for a, n, c in zip(found.at, found.words, found.count)}
        assert got == dict(want) and len(found.at) == len(want)
    assert (np.diff(phrases.grams(plain, len(plain))[0].at) >= 0).all()


def test_slices_lose_no_gram():
    rng = random.Random(7)
    plain = b" ".join(rng.choice(VOCAB).encode() + rng.choice((b"", b"\n", b"  ")) for _ in range(500))
    whole = phrases.grams(plain, len(plain))
    total, want, got = whole[1], Counter(), Counter()
    for a, n, c in zip(whole[0].at, whole[0].words, whole[0].count):
        want[phrases.phrase_at(plain, int(a), int(n))] += int(c)
    for part, limit in phrases.slices(plain, 100, 3):
        found, words = phrases.grams(part, limit)
        total -= words
        for a, n, c in zip(found.at, found.words, found.count):
            got[phrases.phrase_at(part, int(a), int(n))] += int(c)
    assert total == 0 and got == want


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10 ** 12 + 7
    rows = [("en", 1, "a", 3 * big), ("en", 1, "b", 5 * big + 1), ("en", 2, "a b", big)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, n long")).collect()
    assert [r.score for r in got] == [1_000_000 * big * big // (3 * big * (5 * big + 1))]


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_collocations"])
def test_queries_agree_with_their_twins(spark, name):
    from tests.oracle import connect

    frame = queries.QUERIES[name](spark, SF)
    result = connect(SF).execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert normalise(frame.columns, [tuple(r) for r in frame.collect()]) == normalise(names, result.fetchall())


def test_ids_are_read_as_one_array(spark):
    """A list column, sliced as Arrow may hand it on, gives its lists without an object for each id on the way."""
    import pyarrow as pa

    lists = [[5, 6], [], [7], [8, 9, 10], []]
    column = pa.array(lists, pa.list_(pa.int32()))
    assert list(pieces.id_lists(column)) == lists and list(pieces.id_lists(column.slice(1, 3))) == lists[1:4]
    assert list(pieces.id_lists(column.slice(2, 0))) == [] == list(pieces.id_lists(column.slice(5)))
    m = pieces.model(pieces.model_path())
    texts = ["", "one two", "", "three  fourx"]
    rows = spark.createDataFrame([(n, m.encode(t)) for n, t in enumerate(texts)] + [(9, None)], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(rows).collect()} == {n: m.decode(m.encode(t)) for n, t in enumerate(texts)} | {9: ""}
