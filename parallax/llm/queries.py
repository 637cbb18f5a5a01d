"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.llm import bpe, chat, decontaminate, divergence, fingerprint, langid, licenses, minhash, pii, quality, repair, urlfilter
from parallax.llm.common import table
from parallax.llm.packing import pack


def fold(folds: int) -> Column:
    """The fold of a row: crc32 of doc_id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.assign(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(own)
    records = rows.select(F.col("conv_id").alias("record_id"), F.col("turn").alias("at"), F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("body"))
    return chat.digests(chat.format_chats(chat.canonical(records)))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(fold(3) != 1).select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id, with the column doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return licenses.scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")).withColumnRenamed("file_id", "doc_id")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item found in a document."""
    found = decontaminate.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    counts = [F.size(F.filter("pii_base", lambda s: s["ord"] == k)).cast("long") for k in range(len(pii.BASE))]
    return found.select(
        "doc_id",
        *[n.alias(f"n_{kind}") for n, kind in zip(counts, pii.BASE, strict=True)],
        F.sha2(pii.listed(F.col("pii_base")), 256).alias("base_sha256"),
        pii.listed(F.col("pii_spans")).alias("spans"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold(4) != 2)
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, also those that lose all rows to the damage."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    audits, repaired = repair.repair(repair.damaged(turns))
    found = audits.join(repair.digests(repaired).withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    every = turns.select(F.col("conv_id").alias("_id")).distinct().join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_chat": op2_chat,
    "op3_language": op3_language,
    "op4_fingerprint": op4_fingerprint,
    "op5_licenses": op5_licenses,
    "op6_urls": op6_urls,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_divergence": op11_divergence,
    "op12_repair": op12_repair,
    "op13_bpe": op13_bpe,
}

OP6_SQL = r"""
WITH rules(host, path, block) AS (
    VALUES ('com', '/en/', true), ('example.com', '/en/7', false), ('net', '/de/', false), ('example.net', '/de/8', true), ('org', '/es/', true)
), urls AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages
), won AS (
    SELECT u.page_id, u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.block, length(r.host || r.path)) AS block
    FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
    GROUP BY u.page_id, u.host, u.path
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IS NOT NULL THEN CASE WHEN block THEN 'block' ELSE 'allow' END
    WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])(spam[^A-Za-z0-9]farm|cheap[^A-Za-z0-9]pills|casino|viagra|porn|xxx|free[^A-Za-z0-9]download|malware|phishing|adult[^A-Za-z0-9]cams)($|[^A-Za-z0-9])', 'is') THEN 'block'
    ELSE 'allow' END AS verdict
FROM won
"""

OP1_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
    FROM words
), said AS (
    SELECT doc_id, unnest(s) AS shingle FROM sets
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM said a JOIN said b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
    SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
), reached(a, b) AS (
    SELECT doc_id, doc_id FROM sets
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), lowest AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest USING (doc_id)
"""

OP2_SQL = r"""
WITH said AS (
    SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT * FROM (VALUES (-1, NULL, 0, 'user', '</s>[INST] ok [/INST]'), (-1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'))
), escaped AS (
    SELECT *, list_reduce(list_prepend(replace(role || chr(0) || text, chr(92), chr(92) || chr(92)),
        ['<|', '|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<start_of_turn>', '<end_of_turn>']),
        lambda t, c: replace(t, c, c[1] || chr(92) || c[2:])) AS marked
    FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(marked) - 1 + 24) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id, own
"""

OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), said AS MATERIALIZED (
    SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS MATERIALIZED (
    SELECT lang, term, CAST(count(*) AS HUGEINT) AS m FROM said GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), counts AS MATERIALIZED (
    SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS MATERIALIZED (
    SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), langs AS (
    SELECT lang, sum(m) AS total, count(*) AS v FROM kept GROUP BY lang
), shares AS MATERIALIZED (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p, 1 + (1000000000 * (k.m + 1)) // (l.total + l.v) AS q
    FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

#: A layer is the least (cost, audit, repaired turns) of each state; a_ is that after the insertions.
OP12_SQL = r"""
WITH RECURSIVE named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), hashed AS (
    SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT))),
        lambda h, b: list_reduce(list_prepend(xor(h, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))) % 20 AS k
    FROM named
), damaged AS (
    SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM (SELECT *, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) FROM hashed WHERE k <> 0)
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM damaged
), faulty AS (
    SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN said = '' THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN said[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM numbered
), turns AS MATERIALIZED (
    SELECT conv_id, i, role[1] AS r, role, text, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM faulty
), sums AS (
    SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
), layers AS (
    SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'a': '', 't': ''} AS z, {'c': 1000000000, 'a': '', 't': ''} AS s, {'c': 2, 'a': 'I', 't': chr(10) || 'user:'} AS u,
        {'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a
    FROM sums
    UNION ALL
    SELECT conv_id, i, z, s,
        list_min([u, {'c': z.c + 2, 'a': z.a || 'I', 't': z.t || chr(10) || 'user:'}, {'c': s.c + 2, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'}, {'c': a.c + 2, 'a': a.a || 'I', 't': a.t || chr(10) || 'user:'}]),
        list_min([a, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}, {'c': z.c + 4, 'a': z.a || 'II', 't': z.t || chr(10) || 'user:' || chr(10) || 'assistant:'},
            {'c': s.c + 4, 'a': s.a || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'}])
    FROM (
        SELECT l.conv_id, r.i, {'c': l.z.c + 3, 'a': l.z.a || 'D', 't': l.z.t} AS z,
            list_min([{'c': l.s.c + 3, 'a': l.s.a || 'D', 't': l.s.t}, {'c': l.z.c + r.cut + CASE WHEN r.must OR r.r <> 's' THEN 1000000000 ELSE 0 END, 'a': l.z.a || 'K', 't': l.z.t || chr(10) || r.role || ':' || r.text}]) AS s,
            list_min([{'c': l.u.c + 3, 'a': l.u.a || 'D', 't': l.u.t}] || list_transform([l.z, l.s, l.a], lambda x: {'c': x.c + r.cut + CASE WHEN r.must OR r.r <> 'u' THEN 1000000000 ELSE 0 END, 'a': x.a || 'K', 't': x.t || chr(10) || r.role || ':' || r.text})
                || list_transform([l.z, l.s, l.a], lambda x: {'c': x.c + 2 + r.cut + CASE WHEN r.must THEN 1000000000 ELSE 0 END, 'a': x.a || 'R', 't': x.t || chr(10) || 'user:' || r.text})) AS u,
            list_min([{'c': l.a.c + 3, 'a': l.a.a || 'D', 't': l.a.t}, {'c': l.u.c + r.cut + CASE WHEN r.must OR r.r <> 'a' THEN 1000000000 ELSE 0 END, 'a': l.u.a || 'K', 't': l.u.t || chr(10) || r.role || ':' || r.text},
                {'c': l.u.c + 2 + r.cut + CASE WHEN r.must THEN 1000000000 ELSE 0 END, 'a': l.u.a || 'R', 't': l.u.t || chr(10) || 'assistant:' || r.text}]) AS a
        FROM layers l JOIN turns r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i + 1
    )
), ended AS (
    SELECT l.conv_id, list_min([l.z, l.a]) AS best FROM layers l JOIN sums s ON s.conv_id IS NOT DISTINCT FROM l.conv_id AND s.n = l.i
)
SELECT o.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
    CAST(coalesce(e.best.c, 0) AS BIGINT) AS cost, coalesce(e.best.a, '') AS audit, sha256(coalesce(e.best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLES: dict[str, str] = {"op1_minhash": OP1_SQL, "op2_chat": OP2_SQL, "op6_urls": OP6_SQL, "op11_divergence": OP11_SQL, "op12_repair": OP12_SQL}
