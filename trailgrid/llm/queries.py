"""The operators as queries over the given tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgrid.llm import chat, decontaminate, exact, lm, packing, phrases, pieces, quality, secrets, simhash, toxicity, trie, urls
from trailgrid.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query("op2_secrets")
def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secrets.scan(docs, secrets.train(secrets.samples(docs)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query("op3_urls")
def op3_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op4_packing")
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"))


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_quality")
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    forest = quality.train(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.score_column(forest, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op7_lm_scores")
def op7_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return lm.corpus_scores(docs)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op9_exact_dedup", """
    WITH d AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents
    ), g AS (
        SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
    )
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
    FROM d JOIN g USING (text_sha256)
""")
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


CONTROL_CASE = "</s>[INST] ok [/INST]"


def with_control_case(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -7, whose texts are another template's control strings."""
    case = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CASE).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(case)


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped_sql(column: str, escapes) -> str:
    for plain, code in escapes:
        column = f"replace({column}, {_lit(plain)}, {_lit(code)})"
    return column.replace(_lit("\n"), "chr(10)")


#: The same windows as running sums: only lengths are needed, as the texts are read back whole.
CHAT_SQL = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', {_lit(CONTROL_CASE)}), (-7, 1, 'assistant', {_lit(CONTROL_CASE)})
), p AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
        len(regexp_extract_all(text, '{chat.WORD}')) + {chat.TURN_TOKENS} AS tokens,
        {len(chat.BEGIN) + 1 + len(chat.END)} + length({_escaped_sql("role", chat.ROLE_ESCAPES)}) + length({_escaped_sql("text", chat.ESCAPES)}) AS chars
    FROM t
), h AS (
    SELECT *, pos = 1 AND role = '{chat.SYSTEM}' AS head,
        coalesce(sum(CASE WHEN pos = 1 AND role = '{chat.SYSTEM}' THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
        greatest({chat.BUDGET} - {chat.HISTORY} - sum(CASE WHEN pos = 1 AND role = '{chat.SYSTEM}' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id), 1) AS room
    FROM p
), w AS (
    SELECT *, CASE WHEN NOT head THEN 2*(b // room) + CASE WHEN b + tokens > (b // room + 1)*room THEN 1 ELSE 0 END END AS own FROM h
), o AS (
    SELECT *, coalesce(own, min(own) OVER (PARTITION BY conv_id), 0) AS win FROM w
), f AS (
    SELECT conv_id, win, arg_min(b, pos) AS b, bool_or(head) AS headed FROM o GROUP BY conv_id, win
), r AS (
    SELECT f.conv_id, sum(o.chars) AS chars FROM f JOIN o ON o.conv_id = f.conv_id AND NOT f.headed AND (o.head OR o.b BETWEEN f.b - {chat.HISTORY} AND f.b - 1)
    GROUP BY f.conv_id
), s AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS told,
        coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = '{chat.TARGET}'), '') AS learnt, sum(chars) AS chars
    FROM o GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
    CAST(s.chars + coalesce(r.chars, 0) AS BIGINT) AS formatted_chars
FROM s LEFT JOIN r USING (conv_id)
"""


@query("op10_chat", CHAT_SQL)
def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = with_control_case(spark, table(spark, folder, "conversations"))
    read = chat.read_back(chat.windows(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )


#: Prefixes are lists of turn digests, and a subtree is every longer list that starts alike.
TRIE_SQL = f"""
WITH t AS (
    SELECT conv_id, sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS said, octet_length(encode(coalesce(text, ''))) AS size,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, conv_id - conv_id % {trie.GROUP} AS base, CAST(conv_id AS VARCHAR) AS s, count(*) AS own FROM t GROUP BY conv_id
), h AS (
    SELECT conv_id, base, own, xor(list_reduce([4294967295::BIGINT] || [CASE WHEN i % 8 = 0 THEN ascii(substr(s, (i // 8 + 1)::BIGINT, 1))::BIGINT ELSE 0 END FOR i IN range(8 * length(s))],
        lambda r, e: xor(xor(r, e) >> 1, 3988292384 * (xor(r, e) & 1))), 4294967295) % {trie.HEADS} AS h
    FROM c
), n AS (
    SELECT h.*, least(h.h, coalesce(b.own, 0)) AS taken FROM h LEFT JOIN c b ON b.conv_id = h.base
), r AS (
    SELECT n.conv_id, t.pos, t.said, t.size FROM n JOIN t ON t.conv_id = n.base AND t.pos < n.taken
    UNION ALL SELECT n.conv_id, n.taken + t.pos - n.h, t.said, t.size FROM n JOIN t ON t.conv_id = n.conv_id AND t.pos >= n.h
), m AS (
    SELECT conv_id, list(said) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path, size FROM r
    UNION ALL SELECT conv_id, [], 0 FROM n
), e AS (
    SELECT conv_id, max(len(path)) AS depth FROM m GROUP BY conv_id
), g AS (
    SELECT path, min(conv_id) AS conv_id, len(path) AS depth, count(*) AS n_convs, max(size) AS size,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len(path)), '')) AS ends_sha256
    FROM m JOIN e USING (conv_id) GROUP BY path
), u AS (
    SELECT a.path, count(*) FILTER (d.depth = a.depth + 1) AS n_children, sum((d.n_convs - 1) * d.size) AS saved
    FROM g a JOIN g d ON d.depth >= a.depth AND d.path[:a.depth] = a.path GROUP BY a.path
), l AS (
    SELECT a.path, count(*) AS n_leaves FROM g a JOIN g d ON d.depth >= a.depth AND d.path[:a.depth] = a.path
    JOIN u ON u.path = d.path AND u.n_children = 0 GROUP BY a.path
)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, g.n_convs, u.n_children, l.n_leaves,
    CAST(u.saved AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN u USING (path) JOIN l USING (path) LEFT JOIN g p ON p.path = g.path[:-2] AND g.depth > 0
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.conversation_trie(table(spark, folder, "conversations"))


@query("op12_sentencepiece")
def op12_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    told = pieces.decode(pieces.encode(table(spark, folder, "documents")))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return told.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


#: Every n-gram as a string; HUGEINT holds the products.
PHRASES_SQL = f"""
WITH d AS (
    SELECT coalesce(lang, '{phrases.NO_LANG}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
    SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d
), w AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
    SELECT lang, s.words, unnest([array_to_string(ws[i:i + s.words - 1], ' ') FOR i IN range(1, len(ws) - s.words + 2)]) AS phrase
    FROM w, (SELECT unnest(range(1, {phrases.WORDS} + 1)) AS words) s
), f AS (
    SELECT lang, words, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= {phrases.LEAST}
), n AS (
    SELECT lang, count(*) AS n FROM g WHERE words = 1 GROUP BY lang
), c AS (
    SELECT lang, phrase, words, n AS a, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS ws FROM f WHERE words > 1
), s AS (
    SELECT c.lang, c.phrase, c.words, c.a, c.k, x.n AS l, y.n AS r,
        CAST(({phrases.MILLION}::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
    FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[:c.k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:], ' ')
), b AS (
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), k AS (
    SELECT * FROM b WHERE NOT EXISTS (
        SELECT 1 FROM f WHERE f.lang = b.lang AND f.words > b.words AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * f.n >= {phrases.SHARE} * b.a)
), r AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM k
)
SELECT r.lang, rank, phrase, a, l, r, n.n, score FROM r JOIN n USING (lang) WHERE rank <= {phrases.TOP}
"""


@query("op13_collocations", PHRASES_SQL)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))
