"""Registered queries of chunking, embedding, search, fusion and questions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import scores as S
from docweave.functions import text as T
from docweave.operators import embedding, fusion, lexical, questions, vector
from docweave.operators.chunking import chunk_documents
from docweave.sources.workspace import written

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: What Python strips at the ends, for DuckDB's regular expressions.
WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return chunk_documents(docs.withColumn("path", F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))))


CHUNKS = f"""
t0 AS (SELECT doc_id AS d, concat('/corpus/', source, '/', doc_id, '.txt') AS path, {sql_strip("text")} AS t FROM documents),
t1 AS (SELECT *, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 800 THEN 1 ELSE ceil((length(t) - 800) / 680.0)::INT + 1 END AS n FROM t0),
t2 AS (SELECT d, path, t, unnest(range(n)) AS i FROM t1),
t3 AS (SELECT d, path, i, {sql_strip("substr(t, (i * 680 + 1)::BIGINT, 800)")} AS text FROM t2),
chunks AS (SELECT sha1(path) AS doc_id, concat(d, '.txt') AS doc_name, (row_number() OVER (PARTITION BY d ORDER BY i) - 1)::INT AS idx, text FROM t3 WHERE text <> ''),
records AS (SELECT *, sha1(concat_ws(':', doc_id, idx::VARCHAR, substr(text, 1, 128))) AS chunk_id FROM chunks)
"""


def sql_hash(source: str, keys: str, out: str) -> str:
    """CTEs that turn rows (keys, text) into unit vectors by slot."""
    first = keys.split(",")[0].strip()
    return f"""
{out}_k AS (SELECT {keys}, CASE WHEN len(regexp_extract_all(lower(text), '[A-Za-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]')) > 0
  THEN regexp_extract_all(lower(text), '[A-Za-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]') ELSE list_filter(string_split(text, ''), lambda c: c <> '') END AS ts FROM {source}),
{out}_t AS (SELECT {keys}, md5(unnest(ts)) AS h FROM {out}_k),
{out}_s AS (SELECT {keys}, (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT % 384)::INT AS slot,
  sum(CASE WHEN ('0x' || substr(h, 10, 1))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {out}_t GROUP BY ALL),
{out} AS (SELECT {keys}, slot, v / sqrt(sum(v * v) OVER (PARTITION BY {first})) AS value FROM {out}_s WHERE v <> 0)
"""


@query(f"WITH {CHUNKS} SELECT doc_name, idx, length(text) AS n_chars, md5(text) AS text_md5 FROM records")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_name", "idx", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {CHUNKS} SELECT doc_id, idx, chunk_id FROM records")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", "idx", "chunk_id")


@query(f"WITH {sql_hash('documents', 'doc_id', 'v').split('v_t AS')[0].rstrip().rstrip(',')} SELECT doc_id, len(ts)::BIGINT AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM v_k")
def hash_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.hash_tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(f"WITH {sql_hash('documents', 'doc_id', 'v')} SELECT doc_id, slot, round(value, 9) AS value FROM v")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.hash_components(read(spark, sf_dir, "documents"), ["doc_id"]).withColumn("value", F.round("value", 9))


@query("SELECT vec_id, label, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings")
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(S.norm(F.col("embedding")), 6).alias("length"))


HASH_SCORES = f"""
WITH {CHUNKS}, asked AS (SELECT item_id, text FROM benchmark), {sql_hash("records", "chunk_id", "dv")}, {sql_hash("asked", "item_id", "qv")},
scored AS (SELECT item_id, chunk_id, round(sum(qv.value * dv.value), 6) AS score FROM qv JOIN dv USING (slot) GROUP BY ALL),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id))::INT AS rank FROM scored)
"""


def hash_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    asked = embedding.hash_vectors(read(spark, sf_dir, "benchmark"), "item_id")
    return vector.top_k(embedding.hash_vectors(records(spark, sf_dir), "chunk_id"), "chunk_id", asked, "item_id", k)


@query(f"{HASH_SCORES} SELECT item_id, chunk_id, score, rank FROM ranked WHERE rank <= 5")
def hash_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: exact vector search of all chunks for every benchmark passage."""
    return hash_hits(spark, sf_dir, 5).select("item_id", "chunk_id", "score", "rank")


def dense_hits(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    base = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    asked = base.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return vector.top_k(base, "vec_id", asked, "query_id", **more)


def dense_sql(score: str, where: str = "TRUE", k: int = 10) -> str:
    return f"""
WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, b.vec_id, round({score}, 6) AS score FROM b, b AS q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s WHERE {where})
SELECT * FROM r WHERE rank <= {k}"""


@query(dense_sql("list_inner_product(q.e, b.e)"))
def dense_topk_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_hits(spark, sf_dir, k=10)


@query(dense_sql("list_cosine_similarity(q.e, b.e)"))
def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_hits(spark, sf_dir, k=10, cosine=True)


@query(dense_sql("list_cosine_similarity(q.e, b.e)", "score > 0.3", 100))
def dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_hits(spark, sf_dir, k=100, cosine=True, least=0.3)


@query(f"""SELECT query_id, vec_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
  ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS scaled FROM ({dense_sql("list_inner_product(q.e, b.e)")}) WINDOW w AS (PARTITION BY query_id)""")
def minmax_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_hits(spark, sf_dir, k=10).select("query_id", "vec_id", F.round(S.min_max(F.col("score"), ["query_id"]), 6).alias("scaled"))


TERMS = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[A-Za-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]'), lambda t: t NOT IN ('的','了','是','和','与','及','在','有','吗','么','什么','如何')))"


@query(f"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
k AS (SELECT *, {TERMS.format("coalesce(before, '')")} AS terms FROM t)
SELECT conv_id, turn, len(terms)::BIGINT AS n_terms, CASE WHEN len(terms) = 0 OR coalesce(text, '') = '' THEN 0.0
  ELSE round(len(list_filter(terms, lambda x: contains(lower(text), x)))::DOUBLE / len(terms), 6) END AS share FROM k""")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a turn's words the next turn takes up."""
    from pyspark.sql import Window as W

    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, sf_dir, "conversations").withColumn("terms", T.keywords(before))
    return rows.select("conv_id", "turn", F.size("terms").cast("long").alias("n_terms"), F.round(T.keyword_share(F.col("terms"), F.col("text")), 6).alias("share"))


@query(f"""{HASH_SCORES}, c AS (SELECT r.*, b.text AS q, d.text AS t, {TERMS.format("b.text")} AS terms FROM ranked r JOIN benchmark b USING (item_id) JOIN (SELECT DISTINCT chunk_id, text FROM records) d USING (chunk_id) WHERE r.rank <= 30),
m AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS scaled,
  CASE WHEN len(terms) = 0 THEN 0.0 ELSE len(list_filter(terms, lambda x: contains(lower(t), x)))::DOUBLE / len(terms) END AS term_score FROM c WINDOW w AS (PARTITION BY item_id)),
f AS (SELECT *, round(CASE WHEN len(terms) > 0 THEN 0.7 * scaled + (1.0 - 0.7) * term_score ELSE score END, 6) AS final_score FROM m),
o AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY final_score DESC, rank))::INT AS final_rank FROM f)
SELECT item_id, chunk_id, score AS vector_score, round(term_score, 6) AS term_score, final_score, final_rank FROM o WHERE final_rank <= 5""")
def keyword_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = written(hash_hits(spark, sf_dir, 30).select("item_id", "chunk_id", "score", "rank"), "hits")  # read twice below
    texts = records(spark, sf_dir).select("chunk_id", "text").join(F.broadcast(hits.select("chunk_id").distinct()), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])  # 30 ids a query
    asked = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query_text"))
    rows = hits.join(texts, "chunk_id").join(asked, "item_id")
    return fusion.keyword_rerank(rows, "item_id", "chunk_id", 5).withColumn("term_score", F.round("term_score", 6))


LEX = r"list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9_./%*-]+'), lambda w: regexp_matches(w, '[A-Za-z0-9]'))"


@query(f"SELECT doc_id, len({LEX})::BIGINT AS n_tokens, md5(array_to_string({LEX}, ' ')) AS tokens_md5 FROM documents")
def bm25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.tokenized(read(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", F.col("length").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({LEX}) AS term FROM documents) GROUP BY term")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_stats(lexical.postings(lexical.tokenized(read(spark, sf_dir, "documents"), "doc_id"), "doc_id"))


def lex_sql(base: str, key: str, asked: str, query_key: str) -> str:
    """CTEs that end in lex_ranked: query_key, key, score, rank."""
    return f"""
lex_d AS (SELECT {key}, {LEX} AS ts FROM {base}), lex_l AS (SELECT {key}, len(ts) AS length FROM lex_d),
lex_p AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(ts) AS term FROM lex_d) GROUP BY ALL),
lex_f AS (SELECT term, count(*) AS df FROM lex_p GROUP BY term), lex_n AS (SELECT count(*) AS n, avg(length) AS mean_length FROM lex_l),
lex_q AS (SELECT {query_key}, term, count(*) AS qtf FROM (SELECT {query_key}, unnest({LEX}) AS term FROM {asked}) GROUP BY ALL),
lex_s AS (SELECT {query_key}, {key}, round(sum(qtf * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1.0 - 0.75 + 0.75 * length / greatest(mean_length, 1.0)))), 6) AS score
  FROM lex_q JOIN lex_p USING (term) JOIN lex_f USING (term) JOIN lex_l USING ({key}), lex_n GROUP BY ALL),
lex_ranked AS (SELECT *, (row_number() OVER (PARTITION BY {query_key} ORDER BY score DESC, {key}))::INT AS rank FROM lex_s WHERE score > 0)
"""


@query(f"WITH {lex_sql('documents', 'doc_id', 'benchmark', 'item_id')} SELECT item_id, doc_id, score, rank FROM lex_ranked WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), "doc_id", read(spark, sf_dir, "benchmark"), "item_id", 5).select("item_id", "doc_id", "score", "rank")


def once(rows: DataFrame) -> DataFrame:
    """One row a chunk: equal windows of one document can't occur, so this only guards repeated input."""
    return rows.dropDuplicates(["chunk_id"])


@query(f"""{HASH_SCORES}, {lex_sql("records", "chunk_id", "benchmark", "item_id")},
v AS (SELECT item_id, chunk_id, score, rank, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS scaled FROM ranked WHERE rank <= 20 WINDOW w AS (PARTITION BY item_id)),
t AS (SELECT item_id, chunk_id, score, rank, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS scaled FROM lex_ranked WHERE rank <= 20 WINDOW w AS (PARTITION BY item_id)),
f AS (SELECT coalesce(v.item_id, t.item_id) AS item_id, coalesce(v.chunk_id, t.chunk_id) AS chunk_id, round(0.7 * coalesce(v.scaled, 0.0) + (1.0 - 0.7) * coalesce(t.scaled, 0.0), 6) AS score,
  coalesce(v.score, 0.0) AS vector_score, coalesce(t.score, 0.0) AS term_score, coalesce(v.rank, 1048576 + t.rank) AS tie FROM v FULL OUTER JOIN t ON v.item_id = t.item_id AND v.chunk_id = t.chunk_id),
o AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, tie))::INT AS rank FROM f)
SELECT item_id, chunk_id, score, vector_score, term_score, rank FROM o WHERE rank <= 5""")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = records(spark, sf_dir), read(spark, sf_dir, "benchmark")
    return fusion.hybrid(hash_hits(spark, sf_dir, 20), lexical.search(rows, "chunk_id", asked, "item_id", 20), "item_id", "chunk_id", 5)


#: Question frames around the texts of conversations; the placeholder is the text.
FRAMES = (
    "根据产品文档，{}，支持哪些字段？", "请对比这个PRD的接口和参数，{}并且列出区别；还有风险是什么？", "总结一下 {}", "为什么 {}？怎么做？", "抽取字段：{}", "继续，刚才 {} 是什么意思", "{}",
    "如何实现 {}，以及步骤,建议", "查询 {} 的手机号和密码", "   ", "你好，谢谢 {}。另外 {}", "依据需求文件，{}，同时梳理摘要",
)


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.get(F.array(*[F.lit(f) for f in FRAMES]), ((F.col("conv_id") * 7 + F.col("turn")) % len(FRAMES)).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace(frame, F.lit("{}"), F.col("text")).alias("q"))


FRAMED = f"framed AS (SELECT conv_id, turn, replace([{', '.join(chr(39) + f + chr(39) for f in FRAMES)}][(conv_id * 7 + turn) % {len(FRAMES)} + 1], '{{}}', text) AS q FROM conversations)"
PEEL = "regexp_replace({0}, '^[ ，,]+|[ ，,]+$', '', 'g')"
RULES = f"""
r0 AS (SELECT conv_id, turn, {sql_strip("q")} AS q FROM framed),
r1 AS (SELECT *, regexp_extract(q, '{questions.CONTEXT}', 1) AS ctx, CASE WHEN regexp_matches(q, '{questions.CONTEXT}') THEN regexp_extract(q, '{questions.CONTEXT}', 2) ELSE q END AS body FROM r0),
r2 AS (SELECT conv_id, turn, q, ctx, list_filter(list_transform(string_split_regex(body, '{questions.PART_MARKS}{WS}*'), lambda p: {PEEL.format("p")}), lambda p: p <> '') AS pieces FROM r1),
r3 AS (SELECT conv_id, turn, q, ctx, p, i FROM (SELECT conv_id, turn, q, ctx, unnest(pieces) AS p, generate_subscripts(pieces, 1) AS i FROM r2)),
r4 AS (SELECT *, string_split_regex(p, '{questions.JOINERS}') AS subs, CASE WHEN regexp_matches(p, '{questions.TOPIC}') THEN regexp_extract(p, '{questions.TOPIC}', 1) WHEN contains(p, '，') THEN string_split(p, '，')[1] ELSE '' END AS topic FROM r3),
r5 AS (SELECT conv_id, turn, q, i, CASE WHEN len(subs) = 1 THEN [p] ELSE list_transform(list_filter(list_transform(subs, lambda s: {PEEL.format("s")}), lambda s: s <> ''),
  lambda s: CASE WHEN ctx <> '' THEN ctx || s WHEN topic <> '' AND NOT starts_with(s, topic) AND length(s) < 16 THEN topic || s ELSE s END) END AS parts FROM r4),
rules AS (SELECT conv_id, turn, flatten(list(parts ORDER BY i)) AS parts FROM r5 GROUP BY conv_id, turn)
"""


@query(f"WITH {FRAMED}, {RULES} SELECT f.conv_id, f.turn, len(coalesce(parts, []))::BIGINT AS n_parts, md5(array_to_string(coalesce(parts, []), '|')) AS parts_md5 FROM framed f LEFT JOIN rules USING (conv_id, turn)")
def decompose_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = questions.rule_parts(T.strip(F.col("q")))
    return framed(spark, sf_dir).select("conv_id", "turn", parts.alias("p")).select("conv_id", "turn", F.size("p").cast("long").alias("n_parts"), F.md5(F.array_join("p", "|").cast("binary")).alias("parts_md5"))


CLEAN = f"""
c0 AS (SELECT f.conv_id, f.turn, {sql_strip("f.q")} AS q, list_filter(list_transform(coalesce(parts, []), lambda p: regexp_replace(regexp_replace(p, '{WS}+', ' ', 'g'), '^[ ，,。？?]+|[ ，,。？?]+$', '', 'g')), lambda p: p <> '') AS l FROM framed f LEFT JOIN rules USING (conv_id, turn)),
c1 AS (SELECT conv_id, turn, q, list_filter(l, lambda x, i: list_position(l, x) = i)[1:4] AS l FROM c0),
cleaned AS (SELECT conv_id, turn, CASE WHEN q = '' THEN [] WHEN len(l) > 0 THEN l ELSE [q] END AS parts FROM c1)
"""


@query(f"WITH {FRAMED}, {RULES}, {CLEAN} SELECT conv_id, turn, len(parts)::BIGINT AS n_parts, md5(array_to_string(parts, '|')) AS parts_md5 FROM cleaned")
def clean_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = questions.decompose(F.col("q"))
    return framed(spark, sf_dir).select("conv_id", "turn", parts.alias("p")).select("conv_id", "turn", F.size("p").cast("long").alias("n_parts"), F.md5(F.array_join("p", "|").cast("binary")).alias("parts_md5"))


def _sql_intents() -> str:
    rows = []
    for p in questions.INTENTS:
        score = " + ".join([f"contains(low, '{k}')::INT" for k in p.keywords] + [f"CASE WHEN regexp_matches(low, '{pat}') THEN {n} ELSE 0 END" for name, pat, n in questions.BONUSES if name == p.name])
        rows.append(f"{{'s': -({score}), 'n': '{p.name}'}}")
    return f"l AS (SELECT conv_id, turn, {sql_strip('q')} AS t, lower({sql_strip('q')}) AS low FROM framed), x AS (SELECT *, list_sort(list_filter([{', '.join(rows)}], lambda r: r.s < 0)) AS rs FROM l), found AS (SELECT conv_id, turn, CASE WHEN t = '' THEN 'clarification' ELSE rs[1].n END AS intent FROM x)"


@query(f"WITH {FRAMED}, {_sql_intents()} SELECT * FROM found")
def intent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framed(spark, sf_dir).select("conv_id", "turn", questions.rule_intent(F.col("q")).alias("intent"))


_PROFILES = ", ".join(f"('{p.name}', {p.temperature}::DOUBLE, '{p.dependency}')" for p in questions.INTENTS)


@query(f"WITH {FRAMED}, {_sql_intents()}, p(intent, intent_temperature, document_dependency) AS (VALUES {_PROFILES}) SELECT conv_id, turn, coalesce(f.intent, 'qa') AS intent, intent_temperature, document_dependency FROM found f JOIN p ON p.intent = coalesce(f.intent, 'qa')")
def intent_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framed(spark, sf_dir).select("conv_id", "turn", F.coalesce(questions.rule_intent(F.col("q")), F.lit(questions.DEFAULT_INTENT)).alias("intent"))
    return rows.withColumns(questions.profile_columns(F.col("intent")))


def _part_id(query_key: str, part: str) -> Column:
    return F.concat_ws("#", F.col(query_key).cast("string"), F.col(part).cast("string"))


MULTI = RULES.replace("framed", "asked_q").replace("conv_id, turn", "item_id").replace("conv_id", "item_id").replace("(item_id)", "(item_id)")


@query(f"""WITH asked_q AS (SELECT item_id, text AS q FROM benchmark), {MULTI},
c0 AS (SELECT f.item_id, f.q AS asked, {sql_strip("f.q")} AS q, list_filter(list_transform(coalesce(parts, []), lambda p: regexp_replace(regexp_replace(p, '{WS}+', ' ', 'g'), '^[ ，,。？?]+|[ ，,。？?]+$', '', 'g')), lambda p: p <> '') AS l FROM asked_q f LEFT JOIN rules USING (item_id)),
c1 AS (SELECT item_id, asked, q, list_filter(l, lambda x, i: list_position(l, x) = i)[1:4] AS l FROM c0),
c2 AS (SELECT item_id, greatest(len(l), 1) AS n_parts, CASE WHEN len(l) <= 1 THEN [asked] ELSE l END AS ps FROM c1),
parts AS (SELECT item_id, n_parts, i AS part, p AS text, concat_ws('#', item_id, i) AS part_id FROM (SELECT item_id, n_parts, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM c2)),
{lex_sql("documents", "doc_id", "parts", "part_id")},
h AS (SELECT item_id, doc_id, part, n_parts, rank, score FROM lex_ranked JOIN parts USING (part_id) WHERE rank <= 5),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY part, rank) AS seen FROM h),
w AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY part, rank))::INT AS place FROM o WHERE seen = 1)
SELECT item_id, doc_id, part::INT AS part, score, place FROM w WHERE place <= greatest(5, n_parts)""")
def multi_subquery_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of a passage is searched; first sights are merged."""
    parts = questions.exploded_parts(read(spark, sf_dir, "benchmark"), "item_id").withColumn("part_id", _part_id("item_id", "part"))
    asked = parts.select("part_id", F.col("part_text").alias("text"))
    hits = lexical.search(read(spark, sf_dir, "documents"), "doc_id", asked, "part_id", 5).join(parts.drop("part_text"), "part_id")
    return fusion.first_seen(hits, "item_id", "doc_id", 5).select("item_id", "doc_id", "part", "score", "place")


@query(f"""WITH q AS (SELECT conv_id, turn, text, role, CASE WHEN turn % 3 = 0 THEN 'generated_qa' ELSE 'chunk' END AS record_type, CASE WHEN conv_id % 4 = 0 THEN '' ELSE role || '?' END AS qa_question, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS qa_answer FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN record_type = 'generated_qa' AND qa_question <> '' AND qa_answer <> '' THEN '{fusion.QA_PREFIX}' || chr(10) || '命中的预生成问题：' || qa_question || chr(10) || '可加入上下文的答案：' || qa_answer ELSE text END) AS text_md5 FROM q""")
def qa_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.when(F.col("turn") % 3 == 0, "generated_qa").otherwise("chunk").alias("record_type"), F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.concat("role", F.lit("?"))).alias("qa_question"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit("")).alias("qa_answer"),
    )
    return fusion.format_answers(rows).select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""SELECT doc_id, md5(translate('Ａ１　' || text || '！', 'Ａ１　！', 'A1 !')) AS folded_md5 FROM documents""")
def width_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.concat(F.lit("Ａ１　"), "text", F.lit("！"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_width(wide).cast("binary")).alias("folded_md5"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(substr(text, 1, 300), '')) AS c, generate_subscripts(string_split(substr(text, 1, 300), ''), 1) AS i FROM documents),
s AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM c), k AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS t FROM s WHERE b <= 256 GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(t, '')) AS cut_md5, strlen(coalesce(t, ''))::BIGINT AS bytes FROM documents d LEFT JOIN k USING (doc_id)""")
def utf8_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = read(spark, sf_dir, "documents").select("doc_id", T.truncate_utf8(F.col("text"), 256).alias("t"))
    return cut.select("doc_id", F.md5(F.col("t").cast("binary")).alias("cut_md5"), F.octet_length("t").cast("long").alias("bytes"))
