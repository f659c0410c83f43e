"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.oracle import normalise
from trailgrid.llm import chat, decontaminate, exact, lm, markov, packing, quality, queries, secrets, simhash, toxicity, urls
from trailgrid.llm.common import held_out

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, fp int, component_id int, digest string, label int, winner int, _shard int, score string"
VOCAB = [a + b for a in ("ka", "lo", "mi", "ru", "se", "ta", "vo", "ne") for b in ("ra", "li", "no", "pe", "du", "si")]


def words(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, n) for n in (3, 8, 40, 90, 200, 15000)]
    near = base[4].split()
    near[100] = "other"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, base[2].upper()), (11, base[2]), (12, " ".join(near)), (13, ""), (14, None), (15, "  \n\t"), (16, "É é ÉCLAIR"), (17, "é é ÉCLAIR"), (None, base[1]), (None, None)]
    return rows + [rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "k", 1, 2, "d", 3, 4, 5, "s") for k, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- exact copies

def exact_brute(texts):
    groups = {}
    for key, text in texts:
        groups.setdefault(lower(text), []).append(key)
    out = []
    for key, text in texts:
        keys = groups[lower(text)]
        known = [k for k in keys if k is not None]
        keep = max(known) if known else None
        out.append((key, keep, len(keys), key == keep, hashlib.sha256(lower(text).encode()).hexdigest()))
    return out


def test_exact_duplicates(docs, texts):
    got = [tuple(r) for r in exact.exact_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(exact_brute(texts), key=repr)


def test_exact_keep_one(docs, texts):
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    want = {(k, t and lower(t)) for (k, t), row in zip(texts, exact_brute(texts)) if row[3]}
    got = [(r.doc_id, r.text and lower(r.text)) for r in kept.collect()]
    assert len(got) == len({lower(t) for _, t in texts}) and set(got) <= {(k, t) for k, t in want} | {(14, None), (15, "  \n\t")}


def test_perfect_hash_is_minimal_and_checks_bytes():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 500, 3000):
        keys = rng.integers(0, 256, n * 32).astype(np.uint8)
        pilots, slots = exact.build_shard(keys)
        assert sorted(slots.tolist()) == list(range(n))
        table = np.empty((n, 32), np.uint8)
        table[slots] = keys.reshape(-1, 32)
        assert (exact.look_up(keys, pilots, table.ravel()) == slots).all()
        assert (exact.look_up(rng.integers(0, 256, 640).astype(np.uint8), pilots, table.ravel()) == -1).all()


# --- near copies

def print_brute(text):
    parts = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    if not parts:
        return 0
    shingles = [" ".join(parts[i:i + 3]) for i in range(len(parts) - 2)] or [" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(prints):
    name = {p: p for p in prints}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x
    listed = sorted(prints)
    for i, a in enumerate(listed):
        for b in listed[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                name[find(b)] = find(a)
    return {p: find(p) for p in prints}


def test_fingerprints_match_spark_and_brute_force(spark, docs, texts):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("f"), "component_id").collect()
    prints = [(k, print_brute(t)) for k, t in texts]
    assert sorted(((r.doc_id, r.f) for r in got), key=repr) == sorted(((k, f"{p:016x}") for k, p in prints), key=repr)
    roots = components_brute({p for _, p in prints})
    least = {}
    for k, p in prints:
        if k is not None:
            least[roots[p]] = min(least.get(roots[p], k), k)
    assert all(r.component_id == least[roots[int(r.f, 16)]] for r in got)
    one = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first().h
    assert one % 2 ** 64 == simhash.fingerprint("One  two\nTHREE")


def test_links_of_dense_and_sparse_prints(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(25)]
    prints = set(centres)
    for c in centres:
        for _ in range(30):
            p = c
            for _ in range(rng.randrange(1, 9)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = [(p - 2 ** 64 if p >= 2 ** 63 else p,) for p in prints]
    found = {r.fp % 2 ** 64: r.component for r in simhash.print_components(spark.createDataFrame(signed, "fp long")).collect()}
    expected = components_brute(prints)
    assert found.keys() == prints
    groups = lambda of: sorted(sorted(p for p in prints if of[p] == c) for c in set(of.values()))
    assert groups(found) == groups(expected)


def test_near_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert 11 not in ids and 12 not in ids and 2 in ids and 4 in ids and ids.count(3) == 3


# --- packing

def test_token_ids_are_the_tokenizers(texts):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    plain, fast = Tokenizer.from_file(path), packing.TextIds(path)
    odd = ["".join(map(chr, range(1, 0x250))), " ".join(chr(c) + "a" + chr(c) for c in range(33, 0x250)), "it's IT'S we'LL 'tis '' 12½²", "<|endoftext|>a", "a\x1cb", "漢字 Σας ΟΔΟΣ", "İSTANBUL ẞ", "\x85a\xa0b"]
    for text in [t or "" for _, t in texts] + odd:
        assert fast(text) == np.array([*plain.encode(text, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
    assert packing.ranks_agree(path)


def check_packed(rows, most=4096):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return bins


def test_packed_documents(docs, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary_path())
    want = []
    for k, t in texts:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], dtype="<u4")
            want.append((k, n, at, len(part), zlib.crc32(part.tobytes())))
    rows = packing.packed_documents(docs).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    bins = check_packed(rows)
    assert len(bins) == -(-sum(w[3] for w in want) // 4096)


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, words(random.Random(i), 5 + i)) for i in range(40)], "doc_id long, text string")
    pieces = packing.tokenise(docs, max_tokens=64)
    packed = packing.pack(pieces.drop("ids"), max_tokens=64)
    ids = {(r.doc_id, r.piece): bytes(r.ids) for r in pieces.collect()}
    for r in packing.sequences(pieces, packed).collect():
        assert bytes(r.ids) == b"".join(ids[p.doc_id, p.piece] for p in r.pieces) and r.length * 4 == len(r.ids) <= 256


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_limit(rule):
    lengths = np.array(random.Random(1).choices(range(1, 50), k=300))
    bins, offsets = packing.best_fit(lengths, (64.0, 5.0, 2500.0), (1.0, 0.5, 0.5), rule)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 64 and len(own) <= 5 and (own ** 2).sum() <= 2500
        assert sorted(offsets[bins == b].tolist()) == sorted((np.cumsum(own[np.argsort(offsets[bins == b])]) - own[np.argsort(offsets[bins == b])]).tolist())
    assert len(set(bins.tolist())) >= -(-lengths.sum() // 64)


# --- decontamination

def overlaps_brute(text, test, window=13, share=0.8):
    a = [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", text.lower()) if w]
    b = [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", test.lower()) if w]
    size = min(window, len(b))
    if not b:
        return False
    return any(
        sum(x == y for x, y in zip(a[i:i + size], b[j:j + size])) >= share * size
        for i in range(len(a) - size + 1) for j in range(len(b) - size + 1)
    )


def test_overlaps_with_substitutions(spark):
    rng = random.Random(2)
    tests = [(i, words(rng, n)) for i, n in enumerate((30, 45, 14, 8, 6, 4))] + [(6, None), (7, "")]
    rows = []
    for n in range(60):
        _, passage = tests[n % 6]
        parts = passage.split()
        for _ in range(n // 20):
            parts[rng.randrange(len(parts))] = "changed"
        host = words(rng, 300).split()
        host[n:n] = [w.upper() + "," if n % 3 == 0 else w for w in parts]
        rows.append((n, " ".join(host)))
    rows += [(100, words(rng, 500)), (101, None), (102, "")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, benchmark).collect()}
    want = {(d, i) for d, t in rows if t for i, p in tests if p and overlaps_brute(t, p)}
    assert got == want and len(want) > 30
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, benchmark, block_words=20).collect()} == got
    left = {r.doc_id for r in decontaminate.without_tests(docs, benchmark).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in got}


def test_short_tests_and_scripts_without_spaces(spark):
    long = "今天天气很好我们一起去公园散步然后回家吃饭看书睡觉"
    tests = [(0, "the answer is forty"), (1, long), (2, "ตอบ คือ สี่สิบ"), (3, "。、"), (4, None)]
    changed = long.replace("公园", "海边")
    rows = [
        (0, "We know: The ANSWER is forty, always."), (1, "the answer is not forty"), (2, f"前言。{long}！后记"), (3, f"x {changed} y"),
        (4, long[:9]), (5, "คำตอบคือสี่สิบนะ"), (6, "ตอบ คือ สี่สิบ"), (7, ""), (8, None),
    ]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, benchmark).collect()}
    assert got == {(0, 0), (2, 1), (3, 1), (5, 2), (6, 2)}
    assert {r.doc_id for r in decontaminate.without_tests(docs, benchmark).collect()} == {1, 4, 7, 8}
    assert {r.item_id for r in decontaminate.overlaps(docs, benchmark, least_words=5).collect()} == {1, 2}


# --- secrets

def spans_brute(text):
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_base_spans_and_random_strings(spark):
    rng = random.Random(4)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    base62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows = []
    for n in range(150):
        lines = [words(rng, 20), f"PassWord = '{draw(base62, 24)}'", words(rng, 5), f"é api_key:{draw(base62, 30)} token: secret: abcdefghi", draw("0123456789abcdef", 40), "AKIA" + draw("ABCDEFGHIJ234567", 16)]
        rows.append((n, "\n".join(rng.sample(lines, len(lines)))))
    hidden = draw(base62, 40)
    rows += [(500, f"plain {hidden} words {'kalomiruseta' * 3} here 4845168114407329"), (501, None), (502, ""), (503, "to\u212aen=abcdefghij \u017fecret=abcdefghij AKIA" + "A" * 11)]
    docs = spark.createDataFrame(rows + [rows[0]], "doc_id long, text string")
    model = secrets.train(secrets.samples(docs))
    got = {}
    for r in secrets.scan(docs, model).collect():
        assert r.base == spans_brute(dict(rows)[r.doc_id] or "")
        kinds = [s.split(":")[0] for s in r.base.split(",") if s]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in secrets.KINDS[:3])
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))
        got[r.doc_id] = r.spans
    after = spark.createDataFrame([(1, f"id AKIA{'B7' * 8}/{draw(base62, 47)} end")], "doc_id long, text string")
    assert secrets.scan(after, model).first().spans == "access:3:23,random:23:71"
    counted = [sorted(map(tuple, secrets.samples(docs.repartition(n)).collect())) for n in (1, 9)]
    assert counted[0] == counted[1] and all(len(s) <= secrets.PIECE for s, label, _ in counted[0] if label == 0)
    assert got[500] == f"random:6:{6 + len(hidden)}" and got[501] == got[502] == got[503] == ""


# --- urls

def judge_brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = lower(re.split(r"[/?#]", rest, maxsplit=1)[0])
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    best = None
    for verdict, rule in urls.RULES:
        own, _, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


def test_urls_follow_rules_and_models(spark):
    rng = random.Random(6)
    rows = [f"http://{rng.choice(['www.', '', 'm.'])}{rng.choice(VOCAB)}{rng.choice(VOCAB)}.example.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(999)}{rng.choice(['', '?a=/x', '#t', '/'])}" for _ in range(400)]
    rows += [f"https://{rng.choice(['casino', 'poker-adult', 'spam'])}{rng.choice(['-win', '-x', '-farm'])}.example.net/en/{n}" for n in range(60)]
    rows += ["https://cassino-winn.example.net/en/5", None, "", "no scheme/org/", "http://EXAMPLE.org/es/1", "x://example.org", "http://notexample.org/es/", "http://a.com/de/é", "http://org/", "ftp://b.org?x://c.com/de/", "http://u@H.Com:80/fr/"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judged(pages).collect()}
    for n, url in enumerate(rows):
        host, path, rule, verdict = judge_brute(url)
        assert (got[n].host, got[n].path, got[n].rule) == (host, path, rule)
        assert got[n].verdict == verdict if verdict else got[n].verdict in ("allow", "block")
    free = [got[n] for n in range(len(rows)) if got[n].rule is None and got[n].host]
    bad = [r for r in free if re.search("cass?ino|poker|spam", r.host)]
    assert all(r.verdict == "block" for r in bad) and bad
    assert sum(r.verdict == "block" for r in free if r not in bad) <= 0.03 * len(free)


def test_masks_fit_between_any_two_differences():
    import itertools

    placed = [{at + i for i, c in enumerate(mask) if c == "1"} for mask in decontaminate.MASKS for at in range(14 - len(mask))]
    assert all(any(not spots & set(pair) for spots in placed) for pair in itertools.combinations(range(13), 2))
    for length in range(decontaminate.LEAST_WORDS, 13):
        run = len(decontaminate.short_mask(length, 0.8))
        differ = length - -(-8 * length // 10)
        assert run * (differ + 1) <= length


def test_variable_order_chances_sum_to_one():
    model = markov.variable_order([("", "a", 3), ("", "b", 1), ("a", "b", 2), ("\x02", "a", 1)], order=2, size=4)
    for context in ("", "a", "b", "\x02a", "zz"):
        assert sum(model.chance(context, c) for c in "abcd") == pytest.approx(1.0)


# --- quality, toxicity

def test_forest_walk_equals_node_by_node():
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(900, 5))
    label = ((rows[:, 1] > 0.3) ^ (rows[:, 3] > 0)).astype(float)
    forest = quality.fit(rows, label, trees=25, depth=3)

    def walk(row):
        total = forest.base
        for t in range(25):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.cut[t, node])
            total += forest.leaf[t, node - 7]
        return total
    assert np.allclose(forest.raw(rows[:50]), [walk(r) for r in rows[:50]])
    assert ((forest.score(rows) > 0.5) == label).mean() > 0.95


def ranked(score, label):
    """Area under the curve."""
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    pos = label.sum()
    return (order[label > 0].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))


def labelled_scores(spark, name, label):
    folder = "/root/testdata/sf0.01"
    scored = queries.QUERIES[name](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().drop_duplicates("doc_id")
    assert len(scored) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert (scored.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in scored.doc_id]).all()
    assert scored.score.between(0, 1).all()
    joined = scored.merge(labels, on="doc_id")
    return joined, joined[joined.held_out][["score", label]].to_numpy(dtype=float)


def test_quality_on_held_out_rows(spark):
    rows, held = labelled_scores(spark, "op6_quality", "quality")
    assert ranked(held[:, 0], held[:, 1]) > 0.9
    assert (rows.predicted == (rows.score >= 0.3)).all()


def test_toxicity_on_held_out_rows(spark):
    rows, held = labelled_scores(spark, "op8_toxicity", "toxic")
    assert ranked(held[:, 0], held[:, 1]) > 0.8
    assert ((rows.score >= 0.5) == (rows.toxic == 1)).mean() > 0.9


def test_label_model_counts_copies_once():
    rng = np.random.default_rng(1)
    truth = (rng.random(2000) < 0.3).astype(int)
    wrong = lambda rate: np.where(rng.random(2000) < rate, 1 - truth, truth)
    copied = wrong(0.3)
    votes = np.stack([wrong(0.1), wrong(0.1), copied, copied, copied, copied], axis=1)
    posterior, accuracy, influence = toxicity.label_model(votes, wrong(0.15), sure=0.85)
    assert ((posterior > 0.5) == truth).mean() > 0.93
    assert accuracy[0] > accuracy[2] and influence[2] < 0.35 < influence[0]


def test_classifiers_on_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(18)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for keep in (toxicity.without_toxic, quality.keep_good):
        assert keep(docs, none).count() == docs.count()
        assert keep(empty, some).count() == 0
        kept = keep(docs, some)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
    row = spark.createDataFrame([(7,), (None,)], "doc_id long").select(held_out(F.col("doc_id")).alias("h")).collect()
    assert [r.h for r in row] == [zlib.crc32(b"7") % 5 == 0, True]


# --- language model

def test_scores_sum_over_every_word(spark, docs, texts):
    scorer = lm.train(docs, every=2)
    rows = {(r.doc_id, r.n_words): r for r in lm.scores(docs, scorer).collect()}
    for key, text in texts:
        parts = (text or "").lower().split()
        numbers, known = scorer.vocabulary.read(text or "")
        total = known
        for i in range(min(len(parts), 50) if len(parts) < 300 else 0):
            window = [numbers[i + o] if 0 <= i + o < len(numbers) else 0 for o in lm.OFFSETS]
            hidden = np.tanh(scorer.network.bias + sum(scorer.network.embed[j, n] for j, n in enumerate(window)))
            logits = hidden @ scorer.network.out + scorer.network.out_bias
            total += logits[scorer.vocabulary.of_class[numbers[i]]] - np.log(np.exp(logits).sum())
        row = rows[key, len(parts)]
        if len(parts) <= 50:
            assert row.pll == pytest.approx(total, rel=1e-3, abs=1e-3)
        assert (row.mean_pll is None) == (not parts)


def test_training_learns_an_order(spark):
    rng = random.Random(3)
    chain = {w: rng.choice(VOCAB) for w in VOCAB}
    rows = []
    for n in range(60):
        line = [rng.choice(VOCAB)]
        while len(line) < 200:
            line.append(chain[line[-1]] if rng.random() < 0.9 else rng.choice(VOCAB))
        rows.append((n, " ".join(line)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    scorer = lm.train(docs, every=2)
    shuffled = spark.createDataFrame([(n, " ".join(rng.sample(t.split(), 200))) for n, t in rows], "doc_id long, text string")
    mean = lambda frame: frame.agg(F.avg("mean_pll")).first()[0]
    assert mean(lm.scores(docs, scorer)) > mean(lm.scores(shuffled, scorer)) + 0.2


# --- chat

def test_chat_windows(spark):
    rng = random.Random(11)
    bits = ["<|im_start|>", "<|im_end|>\n", "\\", "\\b", "<|", "</s>", "[INST]", "[/INST]", "<s>", "\n", "<", "|", "é", "ok"]
    rows = []
    for conv in range(30):
        turns = rng.randrange(1, 40)
        for t in range(turns):
            role = "system" if t == 0 and conv % 3 == 0 else rng.choice(["user", "assistant"])
            rows.append((conv, t, role, " ".join(rng.choice(bits) if rng.random() < 0.3 else rng.choice(VOCAB) for _ in range(rng.randrange(0, 60)))))
    rows += [(50, 0, "system", "only"), (51, 0, "assistant", None), (52, 1, "we\\ird\nrole", "a"), (52, None, None, "b"), (53, 0, "assistant", "x"), (53, 0, "assistant", "x"), (None, 0, "user", words(rng, 400))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    budget, history = 120, 30
    made = chat.windows(turns, budget=budget, history=history).cache()
    by_conv = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)) + chat.TURN_TOKENS
    read = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert read.keys() == by_conv.keys()
    for conv, own in by_conv.items():
        want = [(r[2] or "", r[3] or "") for r in sorted(own, key=order)]
        assert [tuple(t) for t in read[conv].turns] == want
        assert read[conv].learnt == "".join(t for role, t in want if role == "assistant")
    for w in made.collect():
        turns_in = [p for p in w.formatted.split("<|im_start|>") if p]
        own = by_conv[w.conv_id]
        first = sorted(own, key=order)[0]
        if first[2] == "system":
            assert turns_in[0].startswith("system\n")
        texts_in = []
        for p in turns_in:
            assert p.endswith("<|im_end|>\n")
            body = p.split("\n", 1)[1][:-len(chat.END)]
            for plain, code in reversed(chat.ESCAPES):
                body = body.replace(code, plain)
            texts_in.append(body)
        alone = len(turns_in) - w.repeated == 1
        assert sum(map(size, texts_in)) <= budget or alone


def test_oracle_twins(spark):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLE.items():
        frame = queries.QUERIES[name](spark, SF)
        twin = con.execute(sql)
        assert normalise(frame.columns, [tuple(r) for r in frame.collect()]) == normalise([d[0] for d in twin.description], twin.fetchall()), name


def test_control_case(spark):
    row = queries.op10_chat(spark, SF).where("conv_id = -7").first()
    case = queries.CONTROL_CASE
    assert row.n_turns == 2 and row.loss_chars == len(case) and row.loss_sha256 == hashlib.sha256(case.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{case}\nassistant\n{case}\n".encode()).hexdigest()


def test_empty_tables(spark, empty):
    tests = spark.createDataFrame([(1, words(random.Random(1), 20))], "item_id long, text string")
    assert exact.exact_duplicates(empty).count() == exact.keep_one(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0
    assert packing.packed_documents(empty).count() == 0
    assert decontaminate.overlaps(empty, tests).count() == decontaminate.without_tests(empty, tests).count() == 0
    assert secrets.scan(empty, secrets.train(secrets.samples(empty))).count() == 0
    assert lm.scores(empty, lm.train(empty)).count() == 0
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_no_tests_means_nothing_goes(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs, none).count() == 0
    assert decontaminate.without_tests(docs, none).count() == docs.count()
