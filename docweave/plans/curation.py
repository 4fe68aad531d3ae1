"""Registered queries of stores, evaluation, tables, the search surface, sections, weights, geometry and resumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import chunking, docstore, evaluation, geometry, lexical, resume, sections, store, tables, weights
from docweave.plans.retrieval import WS, lex_sql, read, sql_strip
from docweave.sources import splitters
from docweave.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- stores


@query("""SELECT o_custkey, min(o_orderkey) AS seq, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS total FROM orders GROUP BY o_custkey""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    return store.upsert(log, "o_custkey", "version", "seq")


@query("""SELECT doc_id::VARCHAR AS id, doc_id AS seq, md5(text) AS text_md5 FROM documents
UNION ALL SELECT conv_id || '/' || turn, (SELECT max(doc_id) FROM documents) + conv_id * 1000 + turn + 1, md5(text) FROM conversations""")
def append_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    md5 = F.md5(F.col("text").cast("binary")).alias("text_md5")
    base = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), md5)
    batch = read(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), md5)
    return store.append(base, batch)


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "labels").where("toxic = 1")
    return store.delete(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), gone, "doc_id")


@query("SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS found FROM documents d")
def has_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.exists(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("""WITH batch AS (SELECT d.doc_id, upper(lang) AS lang, n_chars FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM batch) UNION ALL SELECT * FROM batch""")
def idempotent_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    batch = docs.join(read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("lang", F.upper("lang"))
    return store.replace(store.replace(docs, batch, "doc_id"), batch, "doc_id")


# ---------------------------------------------------------------- evaluation

ANSWERED = """turns AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
words AS (SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM turns WHERE role = 'user'),
cases AS (SELECT conv_id || '/' || turn AS case_id, ['qa', 'extract', 'compare'][conv_id % 3 + 1] AS intent, CASE WHEN turn % 4 = 0 THEN '' ELSE 'turn' END AS sub_intent, coalesce(answer, '') AS rag_answer,
  CASE WHEN conv_id % 7 = 0 THEN [] ELSE list_filter(ws, lambda x, i: list_position(ws, x) = i) END AS answer_keywords, (conv_id % 11)::DOUBLE / 10 AS llm_accuracy FROM words)"""
GRADED = f"""{ANSWERED},
m AS (SELECT *, regexp_replace(lower(rag_answer), '{WS}+', '', 'g') AS flat FROM cases),
k AS (SELECT *, CASE WHEN len(answer_keywords) = 0 THEN NULL ELSE len(list_filter(answer_keywords, lambda w: regexp_replace(lower(w), '{WS}+', '', 'g') <> '' AND contains(flat, regexp_replace(lower(w), '{WS}+', '', 'g'))))::DOUBLE / len(answer_keywords) END AS keyword_coverage FROM m),
graded AS (SELECT *, CASE WHEN keyword_coverage IS NULL THEN llm_accuracy ELSE 0.7::DOUBLE * llm_accuracy + (1.0::DOUBLE - 0.7::DOUBLE) * keyword_coverage END AS final_accuracy FROM k)"""


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases made of user turns and the turns that follow them."""
    turns = read(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("role = 'user'")
    words = F.array_distinct(F.filter(F.split("text", " "), lambda w: w != ""))
    return turns.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"),
        F.element_at(F.array(F.lit("qa"), F.lit("extract"), F.lit("compare")), (F.col("conv_id") % 3 + 1).cast("int")).alias("intent"),
        F.when(F.col("turn") % 4 == 0, "").otherwise("turn").alias("sub_intent"),
        F.coalesce("answer", F.lit("")).alias("rag_answer"),
        F.when(F.col("conv_id") % 7 == 0, F.array().cast("array<string>")).otherwise(words).alias("answer_keywords"),
        ((F.col("conv_id") % 11).cast("double") / 10).alias("llm_accuracy"),
    )


@query(f"WITH {GRADED} SELECT case_id, len(answer_keywords)::BIGINT AS n_keywords, round(keyword_coverage, 6) AS keyword_coverage FROM graded")
def eval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.graded(answered(spark, sf_dir)).select("case_id", F.size("answer_keywords").cast("long").alias("n_keywords"), F.round("keyword_coverage", 6).alias("keyword_coverage"))


@query(f"WITH {GRADED} SELECT case_id, intent, round(final_accuracy, 6) AS final_accuracy FROM graded")
def eval_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.graded(answered(spark, sf_dir)).select("case_id", "intent", F.round("final_accuracy", 6).alias("final_accuracy"))


@query(f"""WITH {GRADED}, n AS (SELECT *, CASE WHEN sub_intent = '' THEN 'unknown' ELSE sub_intent END AS sub FROM graded)
SELECT CASE grouping(intent, sub) WHEN 3 THEN 'total' WHEN 1 THEN 'intent' ELSE 'sub_intent' END AS level, intent, sub AS sub_intent, count(*) AS cases, round(avg(final_accuracy), 6) AS final_accuracy,
  round(avg(keyword_coverage), 6) AS keyword_coverage, count(keyword_coverage) AS keyword_cases, round(avg(llm_accuracy), 6) AS llm_accuracy FROM n GROUP BY GROUPING SETS ((), (intent), (intent, sub))""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evaluation.summary(evaluation.graded(answered(spark, sf_dir)))
    return made.withColumns({c: F.round(c, 6) for c in ("final_accuracy", "keyword_coverage", "llm_accuracy")})


@query(f"WITH {GRADED} SELECT case_id, intent, round(final_accuracy, 6) AS final_accuracy FROM graded WHERE final_accuracy < 0.4")
def eval_low_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.graded(answered(spark, sf_dir)).where("final_accuracy < 0.4").select("case_id", "intent", F.round("final_accuracy", 6).alias("final_accuracy"))


RUNS = "runs AS (SELECT user_id AS case_id, event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END AS error, CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS score FROM events)"


@query(f"""WITH {RUNS}, ok AS (SELECT * FROM runs WHERE error = '' AND score IS NOT NULL), best AS (SELECT case_id, max(event_id) AS event_id, arg_max(score, event_id) AS score FROM ok GROUP BY case_id)
SELECT case_id, event_id, score, 'done' AS state FROM best UNION ALL SELECT DISTINCT case_id, NULL::BIGINT, NULL::DOUBLE, 'pending' FROM runs WHERE case_id NOT IN (SELECT case_id FROM best)""")
def eval_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run records: what is done with its last success, and what is still to do."""
    runs = read(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "event_id", F.when(F.col("event_type") == "error", "failed").otherwise("").alias("error"), F.when(F.col("event_type") != "signup", F.col("value")).alias("score"))
    done = store.latest_success(runs, "case_id", "event_id", "error", "score").select("case_id", "event_id", "score", F.lit("done").alias("state"))
    rest = store.pending(runs.select("case_id").distinct(), done, "case_id")
    return done.unionByName(rest.select("case_id", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("score"), F.lit("pending").alias("state")))


@query(f"""WITH {lex_sql("documents", "doc_id", "benchmark", "item_id")}, h AS (SELECT item_id, rank, printf('[%d] %s score=%.4f', rank, d.doc_id || '.txt', score) || chr(10) || {sql_strip("d.text")} AS piece FROM lex_ranked JOIN documents d USING (doc_id) WHERE rank <= 5),
b AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT item_id, md5(string_agg(substr(piece, 1, (5000 - before)::BIGINT), chr(10) || chr(10) ORDER BY rank)) AS context_md5, sum(length(substr(piece, 1, (5000 - before)::BIGINT)))::BIGINT AS chars FROM b WHERE before < 5000 GROUP BY item_id""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    hits = lexical.search(docs, "doc_id", read(spark, sf_dir, "benchmark"), "item_id", 5)
    texts = docs.select("doc_id", "text", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"))
    made = evaluation.context(F.broadcast(hits).join(texts, "doc_id"), "item_id", 5000)  # hits: five rows a query
    return made.select("item_id", F.md5(F.col("context").cast("binary")).alias("context_md5"), "chars")


@query(f"""WITH p AS (SELECT conv_id, 0 AS i, '[文档信息]' || chr(10) || '文件名：' || conv_id || '.txt' AS piece FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL
SELECT conv_id, turn + 1, '[chunk ' || (turn + 1) || ']' || chr(10) || {sql_strip("text")} || chr(10) FROM conversations WHERE {sql_strip("text")} <> ''),
b AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT conv_id, md5(string_agg(substr(piece, 1, (2000 - before)::BIGINT), chr(10) ORDER BY i)) AS context_md5 FROM b WHERE before < 2000 GROUP BY conv_id""")
def qa_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = read(spark, sf_dir, "conversations")
    name = F.col("conv_id").cast("string")
    heads = talks.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("i"), F.concat(F.lit("[文档信息]\n文件名："), name, F.lit(".txt")).alias("piece"))
    body = talks.where(T.strip(F.col("text")) != "").select("conv_id", (F.col("turn") + 1).alias("i"), F.concat(F.lit("[chunk "), (F.col("turn") + 1).cast("string"), F.lit("]\n"), T.strip(F.col("text")), F.lit("\n")).alias("piece"))
    cut = chunking.budget_pieces(heads.unionByName(body), ["conv_id"], ["i"], "piece", 2000)
    packed = cut.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "piece"))).alias("p"))
    return packed.select("conv_id", F.md5(F.array_join(F.transform("p", lambda x: x["piece"]), "\n").cast("binary")).alias("context_md5"))


# ---------------------------------------------------------------- tables

PIECES = ("<table><tr><td>%s</td></tr>", "<tr><td>%s</td></tr>", "<tr><td>%s</td></tr></table>", "plain %s", "<table><tr><th>%s</th></tr></table>")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a stream of table pieces and plain chunks."""
    kind = F.get(F.array(*[F.lit(p) for p in PIECES]), (F.col("o_orderkey") % len(PIECES)).cast("int"))
    return read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), F.replace(kind, F.lit("%s"), F.col("o_orderkey").cast("string")).alias("text"))


@query(f"""WITH p AS (SELECT o_custkey, o_orderkey AS seq, replace([{", ".join(f"'{p}'" for p in PIECES)}][o_orderkey % 5 + 1], '%s', o_orderkey::VARCHAR) AS text FROM orders),
f AS (SELECT *, regexp_matches(text, '(?i)<\\s*(table|tr|td|th|caption)\\b') AS t, contains(lower(text), '</table') AS c FROM p),
o AS (SELECT *, CASE WHEN t AND coalesce(lag(t AND NOT c) OVER (PARTITION BY o_custkey ORDER BY seq), false) THEN 0 ELSE 1 END AS opens FROM f),
r AS (SELECT *, sum(opens) OVER (PARTITION BY o_custkey ORDER BY seq) AS run FROM o)
SELECT o_custkey, min(seq) AS seq, string_agg(text, chr(10) ORDER BY seq) AS text, bool_or(t) AS is_table, count(*) AS pieces FROM r GROUP BY o_custkey, run""")
def table_fragments_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.merge_fragments(pieces(spark, sf_dir), ["o_custkey"])


NATION_HTML = ("<p>intro &amp; more</p><table><caption>Nations of ", "</caption><tr><th>类别</th><th>name</th><th></th></tr>", "</table> tail")


def nation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An HTML page for each region with a table of its nations; the first column is filled in its first row only."""
    nations = read(spark, sf_dir, "nation").withColumn("r", F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")))
    row = F.concat(F.lit("<tr><td>"), F.when(F.col("r") == 1, F.concat(F.lit("group "), F.col("n_regionkey").cast("string"))).otherwise(F.lit("")), F.lit("</td><td>"), "n_name", F.lit(" &lt;x&gt;</td><td> "), F.col("n_nationkey").cast("string"), F.lit("</td></tr>"))
    body = nations.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", row.alias("h")))), lambda x: x["h"]), "").alias("rows"))
    return body.select("n_regionkey", F.concat(F.lit(NATION_HTML[0]), F.col("n_regionkey").cast("string"), F.lit(NATION_HTML[1]), "rows", F.lit(NATION_HTML[2])).alias("html"))


NATIONS = "n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)"


@query(f"""WITH {NATIONS} SELECT n_regionkey, 0 AS table_no, 'Nations of ' || n_regionkey AS caption, r::INT AS row_no, c::INT AS col_no,
  CASE c WHEN 0 THEN CASE WHEN r = 1 THEN 'group ' || n_regionkey ELSE '' END WHEN 1 THEN n_name || ' <x>' ELSE n_nationkey::VARCHAR END AS cell FROM n, range(3) t(c)
UNION ALL SELECT DISTINCT n_regionkey, 0, 'Nations of ' || n_regionkey, 0, c::INT, ['类别', 'name', ''][c + 1] FROM nation, range(3) t(c)""")
def html_table_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells(nation_pages(spark, sf_dir), "n_regionkey", "html")


@query(f"""WITH {NATIONS} SELECT n_regionkey, 0 AS table_no, r::INT AS row_no, c::INT AS col_no, ['类别', 'name', '列3'][c + 1] AS name,
  CASE c WHEN 0 THEN 'group ' || n_regionkey WHEN 1 THEN n_name || ' <x>' ELSE n_nationkey::VARCHAR END AS value FROM n, range(3) t(c)""")
def table_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = tables.cells(nation_pages(spark, sf_dir), "n_regionkey", "html")
    return tables.structured(cell, "n_regionkey").select("n_regionkey", "table_no", "row_no", "col_no", "name", "value")


@query(f"""WITH {NATIONS} SELECT n_regionkey, 0 AS table_no, '[结构化表格] Nations of ' || n_regionkey || chr(10) || '表头：类别 | name | ' || chr(10) ||
  string_agg('- 类别=group ' || n_regionkey || '；name=' || n_name || ' <x>；列3=' || n_nationkey, chr(10) ORDER BY r) AS text FROM n GROUP BY n_regionkey""")
def table_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.as_text(tables.cells(nation_pages(spark, sf_dir), "n_regionkey", "html"), "n_regionkey")


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A four-column table for each customer; each third one has a second row that continues the first name."""
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("row_no"), F.array(F.lit(" 文档 编号："), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("cells")),
                F.struct(F.lit(1).alias("row_no"), F.array(F.when(F.col("c_custkey") % 3 == 0, "").otherwise("nation"), F.concat(F.lit(" "), F.col("c_nationkey").cast("string")), F.lit(""), F.lit("")).alias("cells")),
            )
        ).alias("x"),
    )
    return rows.select("c_custkey", F.lit(0).alias("table_no"), F.col("x.row_no").alias("row_no"), F.posexplode("x.cells").alias("col_no", "cell"))


@query("""SELECT c_custkey, 0 AS table_no, '文档编号' AS name, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 0, 'segment', CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || c_nationkey ELSE c_mktsegment END FROM customer
UNION ALL SELECT c_custkey, 0, 'nation', c_nationkey::VARCHAR FROM customer WHERE c_custkey % 3 <> 0""")
def kv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.key_values(customer_cells(spark, sf_dir), "c_custkey")


@query("""WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, o_orderstatus, o_orderpriority, o_orderkey FROM orders)
SELECT o_custkey, 0 AS table_no, r::INT AS row_no, r::VARCHAR AS number, o_orderstatus AS version, o_orderpriority AS author FROM o WHERE o_orderkey % 5 <> 0""")
def revision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as revision rows; each fifth has only its number, so it goes."""
    rows = read(spark, sf_dir, "orders").withColumn("r", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    said = lambda c: F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(F.col(c).cast("string"))
    body = rows.select("o_custkey", F.lit(0).alias("table_no"), F.col("r").alias("row_no"), F.posexplode(F.array(F.col("r").cast("string"), said("o_orderstatus"), said("o_orderpriority"), F.lit(""))).alias("col_no", "cell"))
    head = rows.select("o_custkey").distinct().select("o_custkey", F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), F.posexplode(F.array(F.lit("序 号"), F.lit("版本："), F.lit("作者"), F.lit("修改时间"))).alias("col_no", "cell"))
    made = tables.revisions(head.unionByName(body), "o_custkey")
    return made.select("o_custkey", "table_no", "row_no", F.col("revision")["序号"].alias("number"), F.col("revision")["版本"].alias("version"), F.col("revision")["作者"].alias("author"))


_UNESCAPE = "regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')"
for _name, _value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&apos;", "''"), ("&amp;", "&")):
    _UNESCAPE = f"replace({_UNESCAPE}, '{_name}', '{_value}')"


@query(f"SELECT page_id, md5(regexp_replace(regexp_replace({_UNESCAPE}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')) AS text_md5 FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.md5(tables.strip_tags(F.col("html")).cast("binary")).alias("text_md5"))


# ---------------------------------------------------------------- search surface


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '5-LOW' AND NOT (coalesce((o_custkey % 3)::INT, 1) < 1)")
def store_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumn("available_int", (F.col("o_custkey") % 3).cast("int"))
    return rows.where(docstore.matches({"o_orderstatus": ["F", "P"], "o_orderpriority": "5-LOW", "o_clerk": "", "available_int": 1})).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 128 OFFSET 256")
def store_sort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return docstore.page(rows, docstore.OrderBy().desc("o_orderdate").asc("missing").asc("o_orderkey").columns(rows), 256, 128)


@query("SELECT w AS key, count(*) AS doc_count FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w IS NOT NULL GROUP BY w")
def store_terms_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docstore.terms(read(spark, sf_dir, "part").select(F.split("p_name", " ").alias("words")), "words")


HIT = r"""(^|[ .?/''"\(\)!,:;-])(the|of|der|les)([ .?/''"\(\)!,:;-]|$)"""


@query(f"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(text, '[.?!;\\n]'), lambda x: regexp_matches(x, '(?i){HIT}')) AS hits FROM documents)
SELECT doc_id, len(hits)::BIGINT AS sentences, md5(array_to_string(hits, '...')) AS text_md5 FROM s WHERE len(hits) > 0""")
def store_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = read(spark, sf_dir, "documents").select("doc_id", docstore.highlight(F.col("text"), ["the", "of", "der", "les"]).alias("h")).where("h IS NOT NULL")
    plain = F.regexp_replace("h", "</?em>", "")
    return marked.select("doc_id", F.size(F.split("h", r"\.\.\.")).cast("long").alias("sentences"), F.md5(plain.cast("binary")).alias("text_md5"))


PARTS_TAGS = "uses AS (SELECT p_brand AS grp, unnest(string_split(p_name, ' ')) AS tag FROM part)"


def tag_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.explode(F.split("p_name", " ")).alias("tag"))


@query(f"""WITH {PARTS_TAGS}, prior AS (SELECT tag, (count(*) + 1) / ((SELECT count(*) FROM uses) + 1000)::DOUBLE AS prior FROM uses GROUP BY tag),
c AS (SELECT grp, tag, count(*) AS c FROM uses GROUP BY ALL), s AS (SELECT grp, sum(c) AS cnt FROM c GROUP BY grp),
w AS (SELECT grp, tag, round_even(0.1::DOUBLE * (c + 1) / (cnt + 1000)::DOUBLE / greatest(prior, 1e-6), 0)::INT AS weight FROM c JOIN s USING (grp) JOIN prior USING (tag)),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY weight DESC, tag) AS r FROM w) SELECT grp, tag, weight FROM r WHERE r <= 3""")
def tag_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = tag_uses(spark, sf_dir)
    return docstore.top_tags(uses, docstore.tag_prior(uses), "grp")


@query(f"""WITH {PARTS_TAGS}, d AS (SELECT grp, tag, count(*)::DOUBLE AS weight FROM uses GROUP BY ALL), q AS (SELECT r_name AS region, ['red', 'small', 'widget', 'ring', 'blue'][i] AS tag, ((r_regionkey + i) % 4 + 1)::DOUBLE AS weight FROM region, range(1, 6) t(i)),
ql AS (SELECT region, sqrt(sum(weight * weight)) AS l FROM q GROUP BY region), dl AS (SELECT grp, sqrt(sum(weight * weight)) AS l FROM d GROUP BY grp)
SELECT q.region, d.grp, round(10.0 * sum(q.weight * d.weight) / greatest(any_value(ql.l) * any_value(dl.l), 1e-12), 6) AS rank_feature FROM q JOIN d USING (tag) JOIN ql USING (region) JOIN dl USING (grp) GROUP BY q.region, d.grp""")
def rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tag_uses(spark, sf_dir).groupBy("grp", "tag").agg(F.count("*").cast("double").alias("weight"))
    words = F.posexplode(F.array(*[F.lit(w) for w in ("red", "small", "widget", "ring", "blue")])).alias("i", "tag")
    asked = read(spark, sf_dir, "region").select(F.col("r_name").alias("region"), "r_regionkey", words).select("region", "tag", ((F.col("r_regionkey") + F.col("i") + 1) % 4 + 1).cast("double").alias("weight"))
    return docstore.tag_likeness(asked, docs, "region", "grp").withColumn("rank_feature", F.round("rank_feature", 6))


@query(f"""WITH {lex_sql("documents", "doc_id", "benchmark", "item_id")} SELECT item_id, source AS document, count(*) AS count FROM lex_ranked JOIN documents USING (doc_id) WHERE rank <= 20 GROUP BY ALL""")
def doc_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    hits = lexical.search(docs, "doc_id", read(spark, sf_dir, "benchmark"), "item_id", 20)
    return docstore.document_counts(F.broadcast(hits).join(docs.select("doc_id", F.col("source").alias("document")), "doc_id"), "item_id", "document")


@query("""SELECT doc_id, (len(c) + 2 * len(t) + 5 + 6 * len(q))::BIGINT AS bag_size, md5(array_to_string(c, '|') || '|' || array_to_string(list_concat(t, t), '|') || '|' || array_to_string([lang, lang, lang, lang, lang], '|') || '|' || array_to_string(flatten([q, q, q, q, q, q]), '|')) AS bag_md5
FROM (SELECT doc_id, lang, string_split(text, ' ') AS c, string_split(text, chr(10)) AS t, [source, lang] AS q FROM documents)""")
def rerank_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = docstore.token_bag(F.split("text", " "), F.split("text", "\n"), F.array("lang"), F.array("source", "lang"))
    return read(spark, sf_dir, "documents").select("doc_id", bag.alias("b")).select("doc_id", F.size("b").cast("long").alias("bag_size"), F.md5(F.array_join("b", "|").cast("binary")).alias("bag_md5"))


# ---------------------------------------------------------------- sections, weights

NUMBERS = ("%d. ", "第%d章 ", "%d.%d ", "Section %d ", "", "(%d) ", "0%d ", "%d.%d.%d ")


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents under numbering of several styles."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    style = F.get(F.array(*[F.lit(n) for n in NUMBERS]), ((F.col("doc_id") + F.when(F.col("i") % 5 == 0, F.col("i")).otherwise(0)) % len(NUMBERS)).cast("int"))
    return lines.select("doc_id", "i", F.concat(F.replace(style, F.lit("%d"), F.col("i").cast("string")), "raw").alias("line"))


LINES = f"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
lines AS (SELECT doc_id, i, replace([{", ".join(f"'{n}'" for n in NUMBERS)}][((doc_id + CASE WHEN i % 5 = 0 THEN i ELSE 0 END) % {len(NUMBERS)} + 1)::INT], '%d', i::VARCHAR) || raw AS line FROM raw)"""


def _sql_bullet(family: int) -> str:
    return f"(regexp_matches(line, '^(?:{'|'.join(f'(?:{p})' for p in sections.FAMILIES[family])})') AND NOT regexp_matches(line, '{sections.NOT_BULLET}'))"


@query(f"""WITH {LINES}, v AS (SELECT doc_id, {", ".join(f"sum({_sql_bullet(i)}::INT)::BIGINT AS votes_{i}" for i in range(4))} FROM lines GROUP BY doc_id)
SELECT *, CASE WHEN greatest(votes_0, votes_1, votes_2, votes_3) = 0 THEN -1 WHEN votes_0 = greatest(votes_0, votes_1, votes_2, votes_3) THEN 0 WHEN votes_1 = greatest(votes_0, votes_1, votes_2, votes_3) THEN 1 WHEN votes_2 = greatest(votes_0, votes_1, votes_2, votes_3) THEN 2 ELSE 3 END AS family FROM v""")
def bullets_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.family_votes(numbered_lines(spark, sf_dir), "doc_id")


def _sql_level(family: int) -> str:
    cases = " ".join(f"WHEN regexp_matches({sql_strip('line')}, '^(?:{p})') AND NOT regexp_matches(line, '{sections.NOT_BULLET}') THEN {j}" for j, p in enumerate(sections.FAMILIES[family]))
    return f"CASE {cases} ELSE {len(sections.FAMILIES[family]) + 1} END"


LEVELS = f"{LINES}, levels AS (SELECT doc_id, i, {_sql_level(1)} AS level FROM lines), counted AS (SELECT doc_id, level, count(*) AS c, min(i) AS first FROM levels GROUP BY ALL), common AS (SELECT doc_id, coalesce(arg_min(level, (-c, first)) FILTER (WHERE level <= 6), 7)::INT AS most_level FROM counted GROUP BY doc_id)"


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_lines(spark, sf_dir).select("doc_id", "i", sections.title_level(F.col("line"), F.lit(""), 1).alias("level"))


@query(f"WITH {LEVELS} SELECT * FROM common")
def title_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.common_level(levels(spark, sf_dir), "doc_id", "i", 1)


@query(f"""WITH {LEVELS}, o AS (SELECT doc_id, i, level, CASE WHEN level <= most_level AND level <> coalesce(lag(level) OVER (PARTITION BY doc_id ORDER BY i), level) THEN 1 ELSE 0 END AS opens FROM levels JOIN common USING (doc_id))
SELECT doc_id, i::INT AS i, level::INT AS level, sum(opens) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS section FROM o""")
def section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = levels(spark, sf_dir)
    common = sections.common_level(rows, "doc_id", "i", 1)
    return sections.section_ids(rows.join(common, "doc_id"), "doc_id", "i").drop("most_level")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, len(list_filter(ls, lambda x: regexp_matches(trim(x), '^[ `a-zA-Z.,'':;/"?<>!\\(\\)-]'))) > 0.8 * len(ls) AS english FROM l""")
def is_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", sections.is_english(F.split("text", "\n")).alias("english"))


CELLS = "cells AS (SELECT p_partkey, unnest([p_name, p_brand, p_type, p_size::VARCHAR, p_retailprice::VARCHAR, '1998-0' || (p_size % 9 + 1) || '-12 ', 'x', p_name || ' ' || p_type || ' of ' || p_brand || ' und mehr']) AS cell, unnest(range(8)) AS i FROM part)"


@query(f"""WITH {CELLS}, t AS (SELECT *, {sql_strip("cell")} AS c FROM cells), w AS (SELECT *, len(list_filter(string_split_regex(cell, '\\s+'), lambda x: length(x) > 1)) AS n FROM t)
SELECT p_partkey, i::INT AS i, CASE WHEN regexp_matches(c, '^(20|19)[0-9]{{2}}[年/-][0-9]{{1,2}}[月/-][0-9]{{1,2}}日*$') OR regexp_matches(c, '^(20|19)[0-9]{{2}}年$') OR regexp_matches(c, '^(20|19)[0-9]{{2}}[年-][0-9]{{1,2}}月*$')
  OR regexp_matches(c, '^[0-9]{{1,2}}[月-][0-9]{{1,2}}日*$') OR regexp_matches(c, '^第*[一二三四1-4]季度$') OR regexp_matches(c, '^(20|19)[0-9]{{2}}年*[一二三四1-4]季度$') OR regexp_matches(c, '^(20|19)[0-9]{{2}}[ABCDE]$') THEN 'Dt'
  WHEN regexp_matches(c, '^[0-9.,+%/ -]+$') THEN 'Nu' WHEN regexp_matches(c, '^[0-9A-Z/\\._~-]+$') THEN 'Ca' WHEN regexp_matches(c, '^[A-Z]*[a-z'' -]+$') THEN 'En'
  WHEN regexp_matches(c, '^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()'' -]+$') THEN 'NE' WHEN length(c) = 1 THEN 'Sg' WHEN n BETWEEN 4 AND 11 THEN 'Tx' WHEN n > 3 THEN 'Lx' ELSE 'Ot' END AS kind FROM w""")
def block_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    cells = F.array(s("p_name"), s("p_brand"), s("p_type"), s("p_size"), s("p_retailprice"), F.concat(F.lit("1998-0"), (F.col("p_size") % 9 + 1).cast("string"), F.lit("-12 ")), F.lit("x"), F.concat_ws(" ", "p_name", "p_type", F.lit("of"), "p_brand", F.lit("und mehr")))
    return read(spark, sf_dir, "part").select("p_partkey", F.posexplode(cells).alias("i", "cell")).select("p_partkey", "i", sections.block_kind(F.col("cell")).alias("kind"))


_F = "CASE WHEN regexp_matches(token, '^[0-9. -]{2,}$') THEN 3.0::DOUBLE WHEN regexp_matches(token, '^[a-z. -]+$') THEN 300.0::DOUBLE ELSE 10.0::DOUBLE END"
_D = "CASE WHEN regexp_matches(token, '^[0-9. -]{2,}$') THEN 5.0::DOUBLE WHEN regexp_matches(token, '^[a-z. -]+$') THEN 300.0::DOUBLE ELSE 3.0::DOUBLE END"
_N = "CASE WHEN regexp_matches(token, '^[0-9,.]{2,}$') THEN 2.0::DOUBLE WHEN regexp_matches(token, '^[a-z]{1,2}$') THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN regexp_matches(token, '^[0-9-]+') THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
WEIGHED = f"""tok AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
raw AS (SELECT item_id, token, (0.3::DOUBLE * log10(10 + (1e7 - {_F} + 0.5) / ({_F} + 0.5)) + 0.7::DOUBLE * log10(10 + (1e9 - {_D} + 0.5) / ({_D} + 0.5))) * {_N} AS w FROM tok),
summed AS (SELECT item_id, token, sum(w) AS w FROM raw GROUP BY ALL), weighed AS (SELECT item_id, token, w / sum(w) OVER (PARTITION BY item_id) AS weight FROM summed)"""


def weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    return weights.weighted_tokens(tokens, "item_id")


@query(f"WITH {WEIGHED} SELECT item_id, token, round(weight, 9) AS weight FROM weighed")
def token_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighed(spark, sf_dir).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {WEIGHED}, {lex_sql("documents", "doc_id", "benchmark", "item_id")}, pairs AS (SELECT item_id, doc_id FROM lex_ranked WHERE rank <= 10),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents WHERE doc_id IN (SELECT doc_id FROM pairs)),
s AS (SELECT p.item_id, p.doc_id, sum(weight) AS s FROM pairs p JOIN weighed w ON w.item_id = p.item_id JOIN d ON d.doc_id = p.doc_id AND d.token = w.token GROUP BY ALL), a AS (SELECT item_id, sum(weight) AS a FROM weighed GROUP BY item_id)
SELECT p.item_id, p.doc_id, round((coalesce(s, 0) + 1e-9) / (a + 1e-9), 6) AS likeness FROM pairs p LEFT JOIN s ON s.item_id = p.item_id AND s.doc_id = p.doc_id LEFT JOIN a ON a.item_id = p.item_id""")
def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    pairs = lexical.search(docs, "doc_id", read(spark, sf_dir, "benchmark"), "item_id", 10).select("item_id", "doc_id")
    near = docs.join(F.broadcast(pairs.select("doc_id").distinct()), "doc_id", "left_semi")  # ten ids a query
    tokens = near.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    return weights.token_likeness(weighed(spark, sf_dir), tokens, pairs, "item_id", "doc_id").withColumn("likeness", F.round("likeness", 6))


# ---------------------------------------------------------------- geometry

BOXES = "boxes AS (SELECT p_partkey AS id, p_partkey // 20 AS page, (p_size * 7 % 90)::DOUBLE AS x0, (p_size * 7 % 90 + p_partkey % 9 * 4 + 10)::DOUBLE AS x1, (p_partkey % 20 * 10)::DOUBLE AS top, (p_partkey % 20 * 10 + p_size % 15 + 8)::DOUBLE AS bottom FROM part)"
AREA = "((greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0)) * (greatest(least(a.bottom, b.bottom) - greatest(a.top, b.top), 0)))"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as boxes, twenty on a page."""
    d = lambda e: F.expr(e).cast("double")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.expr("p_partkey div 20").alias("page"), d("p_size * 7 % 90").alias("x0"), d("p_size * 7 % 90 + p_partkey % 9 * 4 + 10").alias("x1"), d("p_partkey % 20 * 10").alias("top"), d("p_partkey % 20 * 10 + p_size % 15 + 8").alias("bottom")
    )


@query(f"""WITH {BOXES}, p AS (SELECT a.page, a.id, b.id AS other, {AREA} / ((a.x1 - a.x0) * (a.bottom - a.top)) AS ratio FROM boxes a JOIN boxes b ON a.page = b.page AND a.id % 2 = 0 AND b.id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ratio DESC, other) AS r FROM p WHERE ratio > 0.1) SELECT page, id, other, round(ratio, 6) AS ratio FROM r WHERE r = 1""")
def box_overlap_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    return geometry.best_overlap(rows.where("id % 2 = 0"), rows.where("id % 2 = 1").withColumnRenamed("id", "other"), ["page"], "id", "other", 0.1).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {BOXES}, p AS (SELECT a.page, a.id, b.id AS other, pow((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2, 2) + pow((a.top + a.bottom) / 2 - (b.top + b.bottom) / 2, 2) AS distance FROM boxes a JOIN boxes b ON a.page = b.page AND a.id % 5 = 0 AND b.id % 5 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS r FROM p) SELECT page, id, other, round(distance, 6) AS distance FROM r WHERE r = 1""")
def caption_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    return geometry.nearest(rows.where("id % 5 = 0"), rows.where("id % 5 <> 0").withColumnRenamed("id", "other"), ["page"], "id", "other").withColumn("distance", F.round("distance", 6))


@query(f"""WITH {BOXES}, l AS (SELECT *, id % 3 AS label FROM boxes), s AS (SELECT page, label, count(*) > 4 AS many, median(top) AS mt, avg(top) AS ma, median(bottom) AS mb, avg(bottom) AS mc FROM l GROUP BY ALL)
SELECT id, page, label, round(CASE WHEN many THEN mt ELSE ma END, 6) AS top, round(CASE WHEN many THEN mb ELSE mc END, 6) AS bottom FROM l JOIN s USING (page, label)""")
def column_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometry.align_columns(boxes(spark, sf_dir).withColumn("label", F.col("id") % 3), ["page"])
    return rows.select("id", "page", "label", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


@query("""WITH s AS (SELECT user_id, event_id AS pos, ((event_id * 7 // 10 + user_id) % 27)::INT AS idx, (event_id % 10)::DOUBLE / 10 AS prob FROM events), k AS (SELECT *, lag(idx) OVER (PARTITION BY user_id ORDER BY pos) AS b FROM s)
SELECT user_id, string_agg(substr('abcdefghijklmnopqrstuvwxyz', idx, 1), '' ORDER BY pos) AS text, round(avg(prob), 6) AS confidence FROM k WHERE idx <> 0 AND coalesce(b, -1) <> idx GROUP BY user_id""")
def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = ((F.expr("event_id * 7 div 10") + F.col("user_id")) % 27).cast("int")
    steps = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), idx.alias("idx"), ((F.col("event_id") % 10).cast("double") / 10).alias("prob"))
    return geometry.decode_steps(steps, "user_id", "abcdefghijklmnopqrstuvwxyz").withColumn("confidence", F.round("confidence", 6))


# ---------------------------------------------------------------- resumes, hierarchies


@query("""WITH RECURSIVE n AS (SELECT 's' || s_suppkey AS key, s_name AS name, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, NULL FROM region),
p AS (SELECT key, name AS path, parent FROM n UNION ALL SELECT p.key, p.path || ' < ' || n.name, n.parent FROM p JOIN n ON n.key = p.parent) SELECT key, path FROM p WHERE parent IS NULL""")
def hierarchy_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = read(spark, sf_dir, "supplier").select(tag("s", "s_suppkey").alias("key"), F.col("s_name").alias("name"), tag("n", "s_nationkey").alias("parent"))
    nodes = nodes.unionByName(read(spark, sf_dir, "nation").select(tag("n", "n_nationkey").alias("key"), F.col("n_name").alias("name"), tag("r", "n_regionkey").alias("parent")))
    nodes = nodes.unionByName(read(spark, sf_dir, "region").select(tag("r", "r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent")))
    return resume.hierarchy_paths(nodes, "key", "name", "parent").select("key", F.array_join("path", " < ").alias("path"))


_DEGREES = ("高中", "大专", "本科", "硕士", "博士", "MBA", "进修")


@query(f"""WITH d(degree, rank) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in resume.DEGREE_RANKS.items())}), s AS (SELECT o_custkey, [{", ".join(f"'{d}'" for d in _DEGREES)}][o_orderkey % 7 + 1] AS degree FROM orders)
SELECT o_custkey, arg_min(s.degree, (-coalesce(rank, 0), s.degree)) AS degree, max(coalesce(rank, 0))::INT AS rank FROM s LEFT JOIN d ON d.degree = s.degree GROUP BY o_custkey""")
def highest_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = read(spark, sf_dir, "orders").select("o_custkey", F.get(F.array(*[F.lit(d) for d in _DEGREES]), (F.col("o_orderkey") % 7).cast("int")).alias("degree"))
    return resume.highest_degree(studies, "o_custkey", "degree")


@query("""WITH j AS (SELECT o_custkey, o_orderdate::DATE AS s, o_orderdate::DATE + (o_orderkey % 400)::INT AS e FROM orders)
SELECT o_custkey, count(*) AS jobs, min(s)::VARCHAR AS first_start, max(e)::VARCHAR AS last_end, round(avg(e - s), 6) AS mean_days, sum(e - s)::BIGINT AS total_days FROM j GROUP BY o_custkey""")
def work_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    jobs = read(spark, sf_dir, "orders").select("o_custkey", start.alias("s"), F.date_add(start, (F.col("o_orderkey") % 400).cast("int")).alias("e"))
    made = resume.tenures(jobs, "o_custkey", "s", "e")
    return made.withColumns({c: F.col(c).cast("string") for c in ("first_start", "last_end")})


# ---------------------------------------------------------------- splitters, stream


@query()
def json_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON documents, split into objects of bounded size."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), F.split(t["text"], "\n").alias("lines")))
    docs = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("turns"))).alias("json"))
    return splitters.json_chunks(docs, "conv_id", "json")


@query("SELECT doc_id, 1::BIGINT AS n_tables, md5(text || chr(10)) AS rest_md5 FROM documents WHERE NOT contains(text, '|') UNION ALL SELECT doc_id, 0::BIGINT, '' FROM documents WHERE contains(text, '|')")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipe table under each document is found and taken out; documents with pipes of their own are left out of the search."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit("|")).alias("own"), F.concat("text", F.lit("\n| a | b |\n|---|:-:|\n| 1 | 2 |\n")).alias("text"))
    made = splitters.markdown_tables(docs.where("NOT own"), "doc_id", "text").select("doc_id", F.size("tables").cast("long").alias("n_tables"), F.md5(F.col("remainder").cast("binary")).alias("rest_md5"))
    return made.unionByName(docs.where("own").select("doc_id", F.lit(0).cast("long").alias("n_tables"), F.lit("").alias("rest_md5")))


@query()
def txt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts at each mark, merged to chunks of more than 400 characters."""
    parts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.split_keeping("text")).alias("o", "text")).withColumn("n", F.length("text"))
    return chunking.greedy_merge(parts, ["doc_id"], "o", "text", "n", 400)


@query()
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.streamed_chunks(spark, sf_dir).select("chunk_id", "idx", F.length("text").alias("n_chars"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming windows run over the whole table as a batch."""
    made = ingest.windowed_counts(read(spark, sf_dir, "events"), "1 hour")
    return made.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
