"""The numbered queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, counttree, decontaminate, html_text, lm, neardup, packing, passages, quality, ranked, secrets, suffixes, turnrepair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # workers started from another folder find this package too; a cluster ships it with the job
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = """
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, p, list_slice(w, p, p + 4) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM w)),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest(range(p, p + 5)) AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN r USING (doc_id)),
s AS (SELECT *, word_chars * 100 // n_words AS word_length, n_symbols * 1000 // n_words AS symbols, n_dup_lines * 1000 // n_lines AS dup_lines FROM m WHERE n_words > 0),
x AS (SELECT lang, source, unnest(['word_length', 'symbols', 'dup_lines']) AS signal, unnest([word_length, symbols, dup_lines]) AS v FROM s),
b AS (SELECT lang, source, signal, CASE WHEN v < 64 THEN v ELSE greatest(length(bin(v)) - 6, 0) * 32 + (v >> greatest(length(bin(v)) - 6, 0)::INT) END AS bucket FROM x),
k AS (SELECT 1 AS wide, lang, source, signal, bucket FROM b UNION ALL SELECT 2, lang, NULL, signal, bucket FROM b UNION ALL SELECT 3, NULL, NULL, signal, bucket FROM b),
c AS (SELECT wide, lang, source, signal, bucket, count(*) AS n FROM k GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY wide, lang, source, signal ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY wide, lang, source, signal) AS docs FROM c),
e AS (SELECT wide, lang, source, signal, max(docs) AS docs, min(bucket) FILTER (upto * 4 >= docs) AS b1, min(bucket) FILTER (upto * 4 >= docs * 3) AS b3 FROM u GROUP BY ALL),
q AS (SELECT wide, lang, source, signal, docs, CASE WHEN b1 < 64 THEN b1 ELSE (b1 - greatest((b1 >> 5) - 1, 0) * 32) << greatest((b1 >> 5) - 1, 0)::INT END AS q1,
    CASE WHEN b3 < 64 THEN b3 ELSE (b3 - greatest((b3 >> 5) - 1, 0) * 32) << greatest((b3 >> 5) - 1, 0)::INT END AS q3 FROM e),
f AS (SELECT wide, lang, source, max(docs) AS docs,
    max(CASE WHEN signal = 'word_length' THEN q1 - greatest((q3 - q1) * 10, 100) END) AS wl_low, max(CASE WHEN signal = 'word_length' THEN q3 + greatest((q3 - q1) * 10, 100) END) AS wl_high,
    max(CASE WHEN signal = 'symbols' THEN q3 + greatest((q3 - q1) * 6, 100) END) AS sy_high, max(CASE WHEN signal = 'dup_lines' THEN q3 + greatest((q3 - q1) * 6, 400) END) AS dl_high
    FROM q GROUP BY wide, lang, source),
h AS (SELECT DISTINCT lang, source FROM s),
p AS (SELECT h.lang, h.source, CASE WHEN o.docs >= 200 THEN 1 WHEN l.docs >= 200 THEN 2 ELSE 3 END AS wide FROM h
    LEFT JOIN f o ON o.wide = 1 AND o.lang IS NOT DISTINCT FROM h.lang AND o.source IS NOT DISTINCT FROM h.source LEFT JOIN f l ON l.wide = 2 AND l.lang IS NOT DISTINCT FROM h.lang),
z AS (SELECT p.lang, p.source, f.wl_low, f.wl_high, f.sy_high, f.dl_high FROM p JOIN f ON f.wide = p.wide AND (p.wide = 3 OR f.lang IS NOT DISTINCT FROM p.lang) AND (p.wide > 1 OR f.source IS NOT DISTINCT FROM p.source)),
v AS (SELECT m.*, s.word_length < z.wl_low OR s.word_length > z.wl_high AS bad_w, s.symbols > z.sy_high AS bad_s, s.dup_lines > z.dl_high AS bad_d,
    m.n_words < 10 OR 100 * m.n_repeat_words > 20 * m.n_words AS base_failed
    FROM m LEFT JOIN s USING (doc_id) LEFT JOIN z ON z.lang IS NOT DISTINCT FROM m.lang AND z.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(bad_w, FALSE) AND NOT coalesce(bad_s, FALSE) AND NOT coalesce(bad_d, FALSE) AS kept,
    concat_ws(',', CASE WHEN bad_w THEN 'word_length' END, CASE WHEN bad_s THEN 'symbols' END, CASE WHEN bad_d THEN 'dup_lines' END) AS failed_rules
FROM v
"""


@query("op1_quality_rules", OP1_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.judge(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_digests(table(spark, sf_dir, "documents"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.byte_digests(table(spark, sf_dir, "documents"))


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


@query("op3_minhash_neardup")
def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


OP7_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, n, list_slice(w, p, p + n - 1) AS k FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.p, x.n, k.item_id FROM x JOIN k ON x.n = k.n AND x.k = k.k),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@query("op7_benchmark_decontamination", OP7_SQL)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hit_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_secret_scans")
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(table(spark, sf_dir, "documents"))


@query("op4_chat_formatting")
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(table(spark, sf_dir, "conversations"))


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


# states of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a; an edit string leads from one to another
OP12_SQL = """
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) AS t(i))),
r0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
    lambda x: unicode(x)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM conversations, crc),
r1 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM r0 WHERE kind <> 0),
r2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM r1),
r3 AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS init, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM r2),
ins(p, q, app, more, lead) AS (VALUES (0, 0, '', 0, []), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 5, ['user:']), (1, 2, 'I', 5, ['user:']), (3, 2, 'I', 5, ['user:']), (2, 3, 'I', 5, ['assistant:']),
    (0, 3, 'II', 10, ['user:', 'assistant:']), (1, 3, 'II', 10, ['user:', 'assistant:'])),
step(p, term, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
edit AS (SELECT r3.conv_id, r3.i, ins.p, ins.q, ins.app || 'D' AS app, ins.more + 2 AS more, ins.lead AS lead FROM r3, ins
    UNION ALL SELECT r3.conv_id, r3.i, ins.p, step.q, ins.app || 'K', ins.more + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, list_append(ins.lead, role || ':' || text) FROM r3, ins, step
        WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate') AND step.p = ins.q AND step.term = r3.init
    UNION ALL SELECT r3.conv_id, r3.i, ins.p, step.q, ins.app || 'R', ins.more + 1 + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, list_append(ins.lead, CASE step.term WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text) FROM r3, ins, step
        WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate') AND step.p = ins.q AND step.term IN ('u', 'a')),
f AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'rows': []::VARCHAR[]} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL SELECT f.conv_id, f.i + 1, edit.q, min({'cost': (f.best.cost + edit.more)::BIGINT, 'audit': f.best.audit || edit.app, 'rows': list_concat(f.best.rows, edit.lead)}) FROM f JOIN edit
        ON edit.conv_id IS NOT DISTINCT FROM f.conv_id AND edit.i = f.i + 1 AND edit.p = f.q GROUP BY f.conv_id, f.i, edit.q),
n AS (SELECT conv_id, count(r3.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || init NOT IN ('su', 'ua', 'au')) AS illegal FROM r3 GROUP BY conv_id),
a AS (SELECT c.conv_id, coalesce(n.n, 0) AS n, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id),
e AS (SELECT f.conv_id, min({'cost': (f.best.cost + ins.more)::BIGINT, 'audit': f.best.audit || ins.app, 'rows': list_concat(f.best.rows, ins.lead)}) AS best FROM f JOIN ins ON ins.p = f.q JOIN a ON a.conv_id IS NOT DISTINCT FROM f.conv_id
    WHERE f.i = a.n AND (ins.q = 3 OR (ins.q = 0 AND ins.app = '')) GROUP BY f.conv_id)
SELECT a.conv_id, gaps, blank, duplicate, truncated, illegal, e.best.cost AS cost, e.best.audit AS audit, sha256(array_to_string(e.best.rows, chr(10))) AS repaired_sha256 FROM a JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query("op12_conversation_repair", OP12_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnrepair.repair_digests(table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH d0 AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_words FROM d0 WHERE len(w) > 0),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * n_docs) // n_words AS m FROM d0, s WHERE len(w) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d0) GROUP BY r, term),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
i AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
x AS (SELECT i.item_id, i.text, m.r, m.doc_id, sum(f.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * m.m)))::BIGINT AS score FROM i JOIN f USING (term) JOIN t USING (term) JOIN m ON m.r = t.r GROUP BY i.item_id, i.text, m.r, m.doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0) WHERE rank <= 50
"""


@query("op13_ranked_search", OP13_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, list_slice(w, p, p + 4) AS k FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS (SELECT x, y FROM (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.r <> b.r GROUP BY a.r, b.r) JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
c AS (SELECT r AS x, r AS y FROM d UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y),
m AS (SELECT c.x AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.y GROUP BY c.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN n USING (r) JOIN m USING (r)
"""


@query("op11_jaccard_join", OP11_SQL)
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counttree.linked(table(spark, sf_dir, "documents"), size=5, percent=80)
