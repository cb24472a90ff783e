"""``opN_<name>`` queries over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, line_dedup, lm_scoring, ngram_join, packing, quality_knn, quality_rules, secret_scan, warc
from .common import table

WS = "[^\\x20\\x09-\\x0D]"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents")).drop("rejected_by")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.fit_and_score(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema))
    return chat_format.digest(chat_format.format_turns(turns)).drop("n_attachments", "attachment_tokens")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_removed", "emptied")


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages"))).drop("record")


SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WS}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WS}')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, t, ws, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        5 * n_symbols > n_words OR 2 * len(regexp_extract_all(t, '\p{{Lu}}')) > len(regexp_extract_all(t, '\p{{L}}'))
        OR 2 * len(regexp_extract_all(t, '!')) > n_words OR 100 * n_dup_lines > 40 * len(ls)
        OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))
        OR 4 * len(list_filter(range(2, n_words + 1), lambda i: ws[i] = ws[i - 1])) > n_words AS bad FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM v
""",
    "op3_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
""",
    # items of 8 tokens or more with a literal in every window, as all of ``benchmark`` are
    "op6_decontaminate": rf"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
tok AS (SELECT side, id, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[!-/:-@\[-`{{-~]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS c FROM texts),
low AS (SELECT side, id, c, list_transform(c, lambda x: lower(x)) AS t FROM tok WHERE len(c) >= 8),
kinds AS (SELECT side, id, t, list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i] >= '0' AND t[i] < ':' THEN 'num'
        WHEN i > 1 AND t[i - 1] >= '0' AND t[i - 1] < ':' AND list_contains([{", ".join(f"'{u}'" for u in decontaminate.UNITS)}], t[i]) THEN 'unit' END) AS f,
        list_transform(range(1, len(t) + 1), lambda i: c[i] <> t[i] AND NOT list_contains([{", ".join(f"'{u}'" for u in decontaminate.COMMON)}], t[i])) AS cap FROM low),
form AS (SELECT side, id, t, list_transform(range(1, len(t) + 1), lambda i: coalesce(f[i], CASE WHEN cap[i] THEN 'name' END)) AS k,
        list_transform(range(1, len(t) + 1), lambda i: coalesce(chr(2) || f[i], t[i])) AS p,
        list_transform(range(1, len(t) + 1), lambda i: coalesce(chr(2) || f[i], CASE WHEN cap[i] THEN chr(2) || 'name' END, t[i])) AS n FROM kinds),
spots AS (SELECT *, unnest(range(1, len(t) - 6)) AS i FROM form),
win AS (SELECT side, id, i AS pos, array_to_string(p[i:i+7], ' ') AS h FROM spots UNION SELECT side, id, i, array_to_string(n[i:i+7], ' ') FROM spots),
items AS (SELECT id, len(t) - 7 AS n_windows FROM form WHERE side = 'b'),
hit AS (SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.pos - b.pos AS diag, b.pos AS ipos FROM win d JOIN win b ON d.h = b.h WHERE d.side = 'd' AND b.side = 'b'),
cell AS (SELECT DISTINCT doc_id, item_id, diag, ipos + k AS x FROM hit, (SELECT unnest(range(0, 8)) AS k)),
pair AS (SELECT DISTINCT c.doc_id, c.item_id, c.diag, b.k[c.x] AS kind, b.t[c.x] AS a, d.t[c.x + c.diag] AS y FROM cell c
        JOIN form b ON b.side = 'b' AND b.id = c.item_id JOIN form d ON d.side = 'd' AND d.id = c.doc_id WHERE b.k[c.x] IS NOT NULL),
slot AS (SELECT doc_id, item_id, diag, count(*) AS n, count(DISTINCT kind || ' ' || a) AS m, bool_or(a <> y) AS other FROM pair GROUP BY 1, 2, 3)
SELECT h.doc_id, h.item_id, i.n_windows, count(DISTINCT h.ipos) AS n_hits, coalesce(max(s.n), 0) AS n_slots, coalesce(bool_or(s.other), false) AS reparameterised
FROM hit h JOIN items i ON i.id = h.item_id LEFT JOIN slot s ON s.doc_id = h.doc_id AND s.item_id = h.item_id AND s.diag = h.diag WHERE s.n IS NULL OR s.n = s.m
GROUP BY 1, 2, 3 HAVING count(DISTINCT h.ipos) >= 0.3 * i.n_windows
""",
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]', '', 'g'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 10 * c >= 8 * (x.n + y.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a),
k AS (SELECT doc_id, min(c) AS class_id FROM r GROUP BY 1)
SELECT d.doc_id, k.class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM documents d JOIN k ON k.doc_id = d.doc_id
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
