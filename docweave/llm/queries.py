"""The thin queries of the corpus operators, with production settings, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.op1_langid import identify
from docweave.llm.op2_toxicity import toxicity
from docweave.llm.op3_packing import PackSettings, pack
from docweave.llm.op4_quality import quality_rules
from docweave.llm.op5_warc import derivatives, responses
from docweave.llm.op6_minhash import MinMaxSettings, near_duplicates
from docweave.llm.op7_mixing import mixing_plan
from docweave.llm.op8_linededup import deduplicate
from docweave.llm.op9_sharding import hilbert_shards
from docweave.llm.op10_fingerprint import fingerprints
from docweave.llm.shared import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), PackSettings(public_tokenizers.path("word_bpe_49k.json")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derivatives(responses(table(spark, sf_dir, "pages")))
    return made.withColumns({"block_md5": F.md5(F.col("block").cast("binary")), "headers_md5": F.md5(F.col("source_headers").cast("binary"))}).drop("block", "source_headers")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), MinMaxSettings(shingle=2))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_plan(table(spark, sf_dir, "documents"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = deduplicate(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_lines", "lines_left", F.array_join("removed", ",").alias("removed"), F.length("text").cast("long").alias("chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"), 40)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_langid, op2_toxicity, op3_packing, op4_quality, op5_warc, op6_minhash, op7_mixing, op8_linededup, op9_sharding, op10_fingerprint)
}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _distinct(words: str) -> str:
    """List without repeats, in order."""
    return f"list_filter({words}, lambda x, i: list_position({words}, x) = i)"


#: Entities that the test pages hold, and the other common ones; `&amp;` comes last.
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
_BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"


def _warc_sql() -> str:
    text = r"regexp_replace(body, '(?s)<!--.*?-->', '', 'g')"
    text = rf"regexp_replace({text}, '(?is)<(script|style|noscript|template)\b[^>]*>.*?</(script|style|noscript|template)\s*>', '', 'g')"
    text = rf"regexp_replace({text}, '[\t\n\x0B\f\r ]+', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?i)</?({_BLOCKS})\b[^>]*>', chr(10), 'g')"
    text = f"regexp_replace({text}, '</?[A-Za-z!?][^>]*>', '', 'g')"
    for name, value in _ENTITIES:
        text = f"replace({text}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    text = rf"regexp_replace({text}, ' *\n[ \n]*', chr(10), 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '[ ]+', ' ', 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    urn = lambda h: f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"
    return rf"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body FROM pages),
h AS (SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) AS head,
  sha1(concat_ws(chr(10), 'response', coalesce(page_id::VARCHAR, 'null'), url, 'sha1:' || sha1(body))) AS rh,
  list_transform(regexp_extract_all(body, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"''>]*)["'']', 1), lambda x: replace(replace(x, chr(13), '%0D'), chr(10), '%0A')) AS found, trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '[\t\n\x0B\f\r ]+', ' ', 'g')) AS title FROM p),
r AS (SELECT *, {urn("rh")} AS rid, {_distinct("found")} AS links FROM h),
b AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, 'fetchStatus: 200' || chr(13) || chr(10) || 'charset: utf-8' || chr(13) || chr(10) || 'title: ' || title || chr(13) || chr(10) || 'sourcePayloadDigest: sha1:' || sha1(body) || chr(13) || chr(10)
  || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || chr(13) || chr(10)), ''), '') AS block FROM r UNION ALL SELECT *, 'conversion', 'text/plain', {text} FROM r),
i AS (SELECT *, sha1(record_type || chr(10) || rid) AS ih FROM b)
SELECT page_id, record_type, {urn("ih")} AS record_id, rid AS refers_to, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type, strlen(block)::BIGINT AS content_length, 'sha1:' || sha1(block) AS block_digest,
  'sha1:' || sha1(body) AS source_payload_digest, 'sha1:' || sha1(head || body) AS source_block_digest, len(links)::BIGINT AS n_outlinks, md5(block) AS block_md5, md5(head) AS headers_md5 FROM i"""


SQL: dict[str, str] = {
    "op5_warc": _warc_sql(),
    "op6_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op7_mixing": f"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight, 3 * source_size AS top FROM t),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level FROM w
  WINDOW o AS (ORDER BY top::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, coalesce(least(top::DOUBLE, weight * (SELECT arg_min(level, top::DOUBLE / weight) FROM l WHERE top > weight * level)), top::DOUBLE) AS target FROM l),
c AS (SELECT s.doc_id, s.source, s.size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
n AS (SELECT *, ('0x' || substr(md5('mix-' || number || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496 AS u FROM c, range(32) AS r(number)),
k AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM n),
t1 AS (SELECT source, number, target, sum(size * copies)::BIGINT AS taken FROM k WHERE size > 0 GROUP BY ALL),
best AS (SELECT source, (list_sort(list({{'d': abs(taken - target), 'n': number}})))[1].n AS number FROM t1 GROUP BY source)
SELECT doc_id, k.source, size, source_size, target, copies, size * copies AS taken FROM k LEFT JOIN best ON k.source IS NOT DISTINCT FROM best.source WHERE k.number = coalesce(best.number, 0)""",
    "op8_linededup": f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
u AS (SELECT doc_id, line_no, s, len(s) AS n FROM (SELECT doc_id, line_no, list_distinct(regexp_extract_all(line, '{_WORD}')) AS s FROM l) WHERE len(s) >= 1),
x AS (SELECT doc_id, line_no, n, unnest(s) AS w FROM u), f AS (SELECT w, count(*) AS f FROM x GROUP BY w),
p AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY f, w) AS r FROM x JOIN f USING (w)) WHERE r <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS ad, a.line_no AS al, b.doc_id AS bd, b.line_no AS bl FROM p a JOIN p b ON a.w = b.w AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.line_no < a.line_no) AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
h AS (SELECT DISTINCT ad, al FROM c JOIN u a ON a.doc_id = ad AND a.line_no = al JOIN u b ON b.doc_id = bd AND b.line_no = bl WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
m AS (SELECT l.*, ad IS NOT NULL AS gone FROM l LEFT JOIN h ON ad = doc_id AND al = line_no),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT gone) AS lines_left, coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (WHERE gone), '') AS removed, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS t FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(lines_left, 0) AS lines_left, coalesce(removed, '') AS removed, length(t)::BIGINT AS chars_left, md5(t) AS text_md5 FROM documents d LEFT JOIN g USING (doc_id)""",
}
