"""Registered queries of question texts, cases, records, page parts and page layouts, each with its SQL.

The SQL states fixed values literally, so that it doesn't repeat a mistake of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions import scores as S
from docweave.functions import text as T
from docweave.operators import docstore, evaluation, fields, fulltext, fusion, geometry, grids, layout, lexical, questions, resume, sections, tables, weights
from docweave.plans import curation, retrieval
from docweave.plans.curation import BOXES, boxes
from docweave.plans.retrieval import FRAMED, WS, framed, read, sql_strip
from docweave.sources.workspace import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def md5(column: str):
    return F.md5(F.col(column).cast("binary"))


def joined_md5(column: str):
    return F.md5(F.array_join(column, "|").cast("binary"))


# ---------------------------------------------------------------- fusion at the edges of its weight

_BLEND = "round(0.7 * coalesce(v.scaled, 0.0) + (1.0 - 0.7) * coalesce(t.scaled, 0.0), 6)"


def _hybrid(weight: str) -> str:
    sql = retrieval.SQL["hybrid_fusion"]
    assert _BLEND in sql
    return sql.replace(_BLEND, f"round({weight} * coalesce(v.scaled, 0.0) + (1.0 - {weight}) * coalesce(t.scaled, 0.0), 6)")


@query(f"SELECT -3.0::DOUBLE AS weight, * FROM ({_hybrid('0.0')}) UNION ALL SELECT 1.7::DOUBLE, * FROM ({_hybrid('1.0')})")
def hybrid_weight_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights beyond 0 and 1 count as 0 and 1."""
    vectors = written(retrieval.hash_hits(spark, sf_dir, 20), "vector-hits")
    words = written(lexical.search(retrieval.records(spark, sf_dir), "chunk_id", read(spark, sf_dir, "benchmark"), "item_id", 20), "word-hits")
    both = [fusion.hybrid(vectors, words, "item_id", "chunk_id", 5, w).select(F.lit(w).alias("weight"), "*") for w in (-3.0, 1.7)]
    return both[0].unionByName(both[1])


# ---------------------------------------------------------------- question texts

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = ("".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ").replace("'", "''")
_ASKED = r"""cl AS (SELECT conv_id, turn, trim(regexp_replace(translate(lower(q), '{full}', '{half}'), '[ :|\r\n\t,，。？?/`!！&^%()\[\]{{}}<>]+', ' ', 'g')) AS clean FROM framed),
a1 AS (SELECT *, regexp_replace(clean, '(?i)是*(什么样的|哪家|一下|那家|请问|啥样|咋样了|什么时候|何时|何地|何人|是否|是不是|多少|哪里|怎么|哪儿|怎么样|如何|哪些|是啥|啥是|啊|吗|呢|吧|咋|什么|有没有|呀|谁|哪位|哪个)是*', '', 'g') AS b1 FROM cl),
a2 AS (SELECT *, regexp_replace(b1, '(?i)(^| )(what|who|how|which|where|why)(''re|''s)? ', ' ', 'g') AS b2 FROM a1)""".format(full=_FULL, half=_HALF)


@query(rf"""WITH {FRAMED}, {_ASKED}, w AS (SELECT *, string_split_regex(b2, '[ \t]+') AS ws FROM a2)
SELECT conv_id, turn, md5(clean) AS clean_md5, md5(b2) AS bare_md5, len(ws) <= 3 OR len(list_filter(ws, lambda x: NOT regexp_matches(x, '^[a-zA-Z]+$')))::DOUBLE / len(ws) >= 0.7 AS not_latin,
  md5(trim(regexp_replace(clean, '([:{{}}/\[\]\-*"()|+~^])', '\\\1', 'g'))) AS escaped_md5 FROM w""")
def question_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned questions, without the first two kinds of asking words, their language gate and their escaped form."""
    rows = framed(spark, sf_dir).withColumn("clean", fulltext.clean_question(F.col("q")))
    bare = F.col("clean")
    for pattern, instead in fulltext.ASKING[:2]:
        bare = F.regexp_replace(bare, pattern, instead)
    rows = rows.withColumn("bare", bare).withColumn("escaped", fulltext.escaped(F.col("clean")))
    return rows.select("conv_id", "turn", md5("clean").alias("clean_md5"), md5("bare").alias("bare_md5"), fulltext.mostly_not_latin(F.col("bare")).alias("not_latin"), md5("escaped").alias("escaped_md5"))


_TOKENS = r"""tk AS (SELECT conv_id, turn, list_filter(string_split(clean || ' 7 42 ·x the', ' '), lambda t: t <> ''
  AND t NOT IN ('请问','您','你','我','他','是','的','就','有','于','及','即','在','为','最','从','以','了','将','与','吗','吧','中','#','什么','怎么','哪个','哪些','啥','相关')
  AND NOT regexp_matches(t, '^[~—\t @#%!<>,.?":;''{}\[\]_=()|，。？》•●○↓《；‘’：“”【¥ 】…￥！、·（）×`&\\/「」]') AND NOT regexp_matches(t, '^[0-9]$')) AS ts FROM cl)"""


@query(f"WITH {FRAMED}, {_ASKED}, {_TOKENS} SELECT conv_id, turn, len(ts)::BIGINT AS n_tokens, md5(array_to_string(ts, '|')) AS tokens_md5 FROM tk")
def question_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _question_tokens(spark, sf_dir).select("conv_id", "turn", F.size("ts").cast("long").alias("n_tokens"), joined_md5("ts").alias("tokens_md5"))


def _question_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.concat(fulltext.clean_question(F.col("q")), F.lit(" 7 42 ·x the")), " ")
    return framed(spark, sf_dir).select("conv_id", "turn", fulltext.worth_weighing(words).alias("ts"))


@query(f"""WITH {FRAMED}, {_ASKED}, {_TOKENS}, u AS (SELECT conv_id, turn, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM tk),
s AS (SELECT *, regexp_matches(t, '[a-zA-Z]$') AS latin, coalesce(lag(regexp_matches(t, '[a-zA-Z]$')) OVER (PARTITION BY conv_id, turn ORDER BY i), false) AS before FROM u),
g AS (SELECT *, sum(CASE WHEN latin AND before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM s),
p AS (SELECT conv_id, turn, g, string_agg(t, ' ' ORDER BY i) AS phrase FROM g GROUP BY ALL)
SELECT conv_id, turn, count(*) AS n_phrases, md5(string_agg(phrase, '|' ORDER BY g)) AS phrases_md5 FROM p GROUP BY ALL""")
def question_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _question_tokens(spark, sf_dir).select("conv_id", "turn", fulltext.phrases(F.col("ts")).alias("ps")).where(F.size("ps") > 0)
    return rows.select("conv_id", "turn", F.size("ps").cast("long").alias("n_phrases"), joined_md5("ps").alias("phrases_md5"))


@query(rf"""WITH {FRAMED}, x AS (SELECT conv_id, turn, regexp_replace(q || ' 中 文 a b', '(?i)([^a-z0-9.,\)>]) +([^ ])', '\1\2', 'g') AS t FROM framed)
SELECT conv_id, turn, md5(regexp_replace(t, '(?i)([^ ]) +([^a-z0-9.,\(<])', '\1\2', 'g')) AS text_md5 FROM x""")
def spaceless_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framed(spark, sf_dir).select("conv_id", "turn", F.md5(T.spaceless_cjk(F.concat("q", F.lit(" 中 文 a b"))).cast("binary")).alias("text_md5"))


@query(f"WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents) SELECT doc_id, md5(CASE WHEN length(t) <= 220 THEN t ELSE substr(t, 1, 220) || '...' END) AS preview_md5 FROM p")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.preview(F.col("text")).cast("binary")).alias("preview_md5"))


@query("SELECT conv_id, turn, 2::BIGINT AS n, md5(role || '|' || text) AS parts_md5 FROM conversations")
def answer_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays that stand between a model's other words."""
    said = F.concat(F.lit("Sure, here:\n"), F.to_json(F.array("role", "text")), F.lit("\nAnything else?"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.json_array_of(said, "string").alias("p"))
    return rows.select("conv_id", "turn", F.size("p").cast("long").alias("n"), joined_md5("p").alias("parts_md5"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]') AS ws FROM documents), d AS (SELECT doc_id, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS ws FROM w)
SELECT doc_id, len(ws)::BIGINT AS n, md5(array_to_string(ws, '|')) AS words_md5 FROM d""")
def plain_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords without a list of words to drop."""
    return read(spark, sf_dir, "documents").select("doc_id", T.keywords(F.col("text"), ()).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), joined_md5("w").alias("words_md5"))


@query("SELECT doc_id, md5(translate(text, 'aeoß', '東門學書')) AS text_md5 FROM documents")
def character_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(fields.simplified(F.col("text"), dict(zip("aeoß", "東門學書", strict=True))).cast("binary")).alias("text_md5"))


# ---------------------------------------------------------------- cases, terms, fields


@query(f"""WITH r AS (SELECT conv_id * 100 + turn AS seq, CASE WHEN turn % 3 = 0 THEN '' ELSE 'q' || conv_id || '-' || turn END AS id, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS query, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE role END AS q2, ' a, ' || role || '；b c;;d|e，' AS keywords FROM conversations),
c AS (SELECT CASE WHEN id <> '' THEN id ELSE printf('case_%04d', seq) END AS case_id, CASE WHEN query <> '' THEN query ELSE coalesce(q2, '') END AS question, list_filter(list_transform(string_split_regex(keywords, '[,，;；|]'), lambda k: {sql_strip("k")}), lambda k: k <> '') AS ks FROM r)
SELECT case_id, md5(question) AS question_md5, array_to_string(ks, '|') AS keywords, 'unknown' AS intent, '' AS standard_answer FROM c WHERE question <> ''""")
def case_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under the aliases that cases come with; blank values fall through to the next alias."""
    rows = read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("q"), F.col("conv_id"), F.lit("-"), F.col("turn"))).alias("id"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("query"),
        F.when(F.col("conv_id") % 5 != 0, F.col("role")).alias("问题"),
        F.concat(F.lit(" a, "), "role", F.lit("；b c;;d|e，")).alias("keywords"),
    )
    made = evaluation.normalize_cases(rows)
    return made.select("case_id", md5("question").alias("question_md5"), F.array_join("answer_keywords", "|").alias("keywords"), "intent", "standard_answer")


@query(f"WITH {curation.WEIGHED}, r AS (SELECT item_id, token, weight, (row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, token))::INT AS rank FROM weighed) SELECT item_id, token, round(weight, 9) AS weight, rank FROM r WHERE rank <= 30")
def paragraph_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty heaviest terms of each passage."""
    return fulltext.top_terms(curation.weighed(spark, sf_dir), "item_id").select("item_id", "token", F.round("weight", 9).alias("weight"), "rank")


@query("""WITH f AS (SELECT p_partkey, unnest(['title_tks', 'content_ltks', 'important_kwd']) AS field, unnest([p_name, p_type, p_brand]) AS t FROM part), tk AS (SELECT p_partkey, field, lower(unnest(string_split(t, ' '))) AS term FROM f),
l AS (SELECT p_partkey, field, count(*) AS length FROM tk GROUP BY ALL), h AS (SELECT p_partkey, field, term, count(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM h GROUP BY ALL),
n AS (SELECT field, count(*) AS n, avg(length) AS mean FROM l GROUP BY field), c(q, term, weight) AS (VALUES (1, 'green', 1.0::DOUBLE), (1, 'steel', 2.0::DOUBLE), (2, 'brand#12', 1.0::DOUBLE), (2, 'red', 0.5::DOUBLE), (2, 'tin', 1.0::DOUBLE)),
s AS (SELECT q, p_partkey, field, sum(CASE field WHEN 'title_tks' THEN 10.0 WHEN 'important_kwd' THEN 30.0 ELSE 2.0 END::DOUBLE * weight * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1.0 - 0.75 + 0.75 * length / greatest(mean, 1.0)))) AS s FROM h JOIN c USING (term) JOIN df USING (field, term) JOIN n USING (field) JOIN l USING (p_partkey, field) GROUP BY ALL),
m AS (SELECT q, p_partkey, count(DISTINCT term) AS met FROM h JOIN c USING (term) GROUP BY ALL), b AS (SELECT q, p_partkey, round(max(s), 6) AS score FROM s GROUP BY ALL), a AS (SELECT q, count(*) AS asked FROM c GROUP BY q),
r AS (SELECT q, p_partkey, score, (row_number() OVER (PARTITION BY q ORDER BY score DESC, p_partkey))::INT AS rank FROM b JOIN m USING (q, p_partkey) JOIN a USING (q) WHERE met >= ceil(0.3 * asked)) SELECT * FROM r WHERE rank <= 10""")
def best_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the best of their fields, each with its boost."""
    part = read(spark, sf_dir, "part")
    stated = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("t")) for f, c in (("title_tks", "p_name"), ("content_ltks", "p_type"), ("important_kwd", "p_brand"))]))
    tokens = part.select("p_partkey", stated).select("p_partkey", "field", F.split(F.lower("t"), " ").alias("ts"))
    hits = tokens.select("p_partkey", "field", F.size("ts").alias("length"), F.explode("ts").alias("term")).groupBy("p_partkey", "field", "length", "term").agg(F.count("*").alias("tf"))
    clauses = spark.createDataFrame([(1, "green", 1.0), (1, "steel", 2.0), (2, "brand#12", 1.0), (2, "red", 0.5), (2, "tin", 1.0)], "q int, term string, weight double")
    return fulltext.best_fields(hits, clauses, "q", "p_partkey", 10, 0.3)


@query("""WITH t AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i::BIGINT, 2))) AS ga, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i::BIGINT, 2))) AS gb FROM t WHERE b IS NOT NULL)
SELECT conv_id, turn, round(len(list_intersect(ga, gb))::DOUBLE / greatest(len(ga), len(gb), 1), 6) AS likeness FROM g""")
def outline_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared character pairs of a turn and the next."""
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, sf_dir, "conversations").withColumn("b", after).where("b IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(sections.pair_likeness(F.col("text"), F.col("b")), 6).alias("likeness"))


# ---------------------------------------------------------------- records

_JOBS = "j AS (SELECT o_custkey AS k, o_orderkey AS o, substr(o_orderdate::VARCHAR, 1, 10) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)"


@query(f"""WITH {_JOBS}, e AS (SELECT k, arg_min(s, (s, i)) AS first_start, arg_max(o, (s, i)) AS last, max(CASE WHEN o % 5 = 0 THEN 'Y' ELSE 'N' END) AS managed, count(*) AS n FROM j GROUP BY k)
SELECT k, first_start AS work_start_time, managed AS management_experience, 'C' || last AS corporation_name, '0' AS annual_salary, '' AS scale, CASE WHEN k % 2 = 0 THEN 'S' || k ELSE '' END AS school_name, CASE WHEN k % 3 = 0 THEN '9' ELSE '' END AS salary_month,
  'N' || k AS contact_name, n AS jobs, 'C' || (SELECT o FROM j WHERE j.k = e.k AND j.i = 0) AS first_entry, 'kept' AS other, 0 AS dropped FROM e""")
def resume_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of raw records; entries come as a list."""
    job = F.struct(F.col("o_orderkey").alias("o"), F.struct(F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("start_time"), F.concat(F.lit("C"), "o_orderkey").alias("corporation_name"), F.when(F.col("o_orderkey") % 5 == 0, "Y").otherwise("N").alias("management_experience"), F.lit(1).alias("external")).alias("e"))
    people = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    school = F.when(F.col("k") % 2 == 0, F.struct(F.struct(F.lit("1999").alias("start_time"), F.concat(F.lit("S"), "k").alias("school_name")).alias("0")))
    basic = F.struct(F.concat(F.lit("N"), "k").alias("name"), F.lit("p").alias("photo2"), F.when(F.col("k") % 3 == 0, F.lit(9)).alias("basic_salary_month"))
    cv = F.to_json(F.struct(basic.alias("basic"), F.transform("jobs", lambda j: j["e"]).alias("work"), school.alias("education"), F.lit("x").alias("raw_txt"), F.lit("kept").alias("source"), F.lit("bad").alias("skill")))
    made = resume.clean_records(people.select("k", cv.alias("cv")), "cv", "2024-01-01")
    of = lambda m, n: F.coalesce(F.col(m)[n], F.lit(""))
    names = ("work_start_time", "management_experience", "corporation_name", "annual_salary", "scale", "school_name", "salary_month")
    gone = F.map_contains_key("basic", "photo2").cast("int") + F.map_contains_key("rest", "raw_txt").cast("int") + F.col("skill").isNotNull().cast("int") + F.map_contains_key(F.col("work")["0"], "external").cast("int")
    return made.select("k", *[of("basic", n).alias(n) for n in names], F.col("contact")["name"].alias("contact_name"), F.size("work").cast("long").alias("jobs"), F.col("work")["0"]["corporation_name"].alias("first_entry"), F.col("rest")["source"].alias("other"), gone.alias("dropped"))


@query("""SELECT c_custkey::VARCHAR AS tob_resume_id, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN '男' WHEN 1 THEN '女' ELSE '' END AS gender, CASE c_custkey % 4 WHEN 0 THEN '是' WHEN 1 THEN '否' ELSE '' END AS is_oversea,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '555' END AS phone, CASE c_custkey % 5 WHEN 0 THEN '本科' WHEN 1 THEN '博士' WHEN 2 THEN 'MBA' ELSE '' END AS degree, 'line\\n two' AS self_remark, 'day ' || c_custkey AS updated_at, '' AS wechat, 51::BIGINT AS columns FROM customer""")
def resume_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n, *of: F.get(F.array(*[F.lit(x) for x in of]), (F.col("c_custkey") % n).cast("int"))
    basic = F.struct(pick(3, "M", "F", "").alias("gender"), pick(4, "Y", "N", "", "?").alias("is_oversea"), pick(5, "1", "3", "6", "0", "x").alias("degree"), F.lit("line\r\n\ttwo").alias("self_remark"))
    contact = F.struct(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).otherwise("").alias("phone"), F.lit(" 555 ").alias("tel"))
    raw = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tob_resume_id"), F.concat(F.lit("day "), "c_custkey").alias("updated_at"), F.to_json(F.struct(basic.alias("basic"), contact.alias("contact"))).alias("resume_content"))
    flat = resume.flat_records(raw)
    return flat.select("tob_resume_id", "name", "gender", "is_oversea", "phone", "degree", "self_remark", "updated_at", "wechat", F.lit(len(flat.columns)).cast("long").alias("columns"))


@query("""WITH p AS (SELECT ps AS k, i, 'd' || i AS u, CASE WHEN i % 4 = 0 THEN '' ELSE 'P' || i END AS n, trim('<b>did</b> ' || i || CASE WHEN i % 3 = 0 THEN '' ELSE ' r' || i END) AS t FROM (SELECT o_custkey AS ps, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i < 10)
SELECT k, coalesce(arg_max(n, u) FILTER (WHERE n <> ''), NULL) AS name, md5(string_agg(regexp_replace(t, '<[^>]+>', '', 'g'), ' ' ORDER BY u DESC)) AS text_md5 FROM p GROUP BY k""")
def resume_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), number.alias("i")).where("i < 10")
    i = F.col("i").cast("string")
    projects = rows.select("k", F.concat(F.lit("d"), i).alias("updated_at"), F.when(F.col("i") % 4 == 0, "").otherwise(F.concat(F.lit("P"), i)).alias("name"), F.concat(F.lit("<b>did</b> "), i).alias("describe"), F.when(F.col("i") % 3 == 0, "").otherwise(F.concat(F.lit("r"), i)).alias("responsibilities"))
    return resume.project_texts(projects, "k").select("k", "name", md5("text").alias("text_md5"))


_DATES = "d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN substr(o_orderdate::VARCHAR, 1, 10) WHEN 1 THEN substr(o_orderdate::VARCHAR, 1, 4) || '年' || (o_orderkey % 15) || '月' WHEN 2 THEN ' 19 95. 3' WHEN 3 THEN '至今' ELSE '2001/12/45' END AS t, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 1000 WHEN o_orderkey % 3 = 1 THEN 1000000000000 + o_orderkey ELSE NULL END AS n FROM orders)"
_PART = r"nullif(regexp_extract(c, '([0-9]{{4}})[^0-9]?([0-9]{{1,2}})?[^0-9]?([0-9]{{1,2}})?', {0}), '')::INT"


@query(f"""WITH {_DATES}, c AS (SELECT *, regexp_replace(t, '\\s+', '', 'g') AS c FROM d) SELECT o_orderkey, coalesce({_PART.format(1)}, -1) AS year, CASE WHEN {_PART.format(2)} IS NOT NULL THEN least(greatest({_PART.format(2)}, 1), 12) ELSE -1 END AS month,
  CASE WHEN {_PART.format(3)} IS NOT NULL THEN least(greatest({_PART.format(3)}, 1), 31) ELSE -1 END AS day, coalesce(CASE WHEN n > 99999999999 THEN n // 1000 ELSE n END, -1) AS seconds FROM c""")
def record_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, months and days as people write them, and times as seconds or milliseconds."""
    k, stated = F.col("o_orderkey"), F.col("o_orderdate").cast("string")
    t = F.when(k % 5 == 0, F.substring(stated, 1, 10)).when(k % 5 == 1, F.concat(F.substring(stated, 1, 4), F.lit("年"), (k % 15).cast("string"), F.lit("月"))).when(k % 5 == 2, " 19 95. 3").when(k % 5 == 3, "至今").otherwise("2001/12/45")
    n = F.when(k % 3 == 0, k * 1000).when(k % 3 == 1, F.lit(1000000000000) + k)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"), n.cast("string").alias("n"))
    return rows.select("o_orderkey", *[F.coalesce(c, F.lit(-1)).alias(name) for name, c in resume.year_month_day(F.col("t")).items()], F.coalesce(F.unix_timestamp(resume.from_epoch(F.col("n"))), F.lit(-1)).alias("seconds"))


@query(r"""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN ' ' || s_name || ' (East) Co.Ltd.' WHEN 1 THEN upper(s_name) || '集团股份有限公司' WHEN 2 THEN s_name || '（上海）公司' ELSE s_name || ' Inc' END AS n FROM supplier),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(n, '[\(（][^()（）]*[\)）]', '', 'g')), '[\t &（）()"'':：;；,，]+', '', 'g'), '(集团)?(股份)?(有限)?(责任)?(公司|集团|co\.?ltd\.?|inc\.?|corp\.?)$', '') AS c FROM s)
SELECT s_suppkey, c AS company, contains(c, 'supplier#00000000' || 1) OR contains(c, '0000007') AS is_good FROM c""")
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.col("s_name")
    n = F.when(k % 4 == 0, F.concat(F.lit(" "), name, F.lit(" (East) Co.Ltd."))).when(k % 4 == 1, F.concat(F.upper(name), F.lit("集团股份有限公司"))).when(k % 4 == 2, F.concat(name, F.lit("（上海）公司"))).otherwise(F.concat(name, F.lit(" Inc")))
    good = spark.createDataFrame([("Supplier#00000000 1 Corp.",), ("0000007 (West)",), ("集团",)], "name string")
    rows = resume.good_companies(read(spark, sf_dir, "supplier").select("s_suppkey", n.alias("n")), "n", good)
    return rows.select("s_suppkey", resume.normal_company(F.col("n")).alias("company"), "is_good")


@query("""WITH s AS (SELECT c_custkey, c_nationkey, c_custkey % 4 AS m FROM customer) SELECT c_custkey, CASE WHEN m = 3 THEN -1 ELSE c_nationkey END AS school_id FROM s""")
def school_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools by name, foreign name or alias, blanks and brackets aside."""
    nation = read(spark, sf_dir, "nation")
    schools = nation.select(F.col("n_nationkey").alias("school_id"), F.col("n_name").alias("name_cn"), F.concat(F.lit("University of "), "n_name").alias("name_en"), F.array(F.concat(F.lit("U"), F.col("n_nationkey").cast("string"))).alias("aliases"))
    m, key = F.col("c_custkey") % 4, F.col("c_nationkey")
    stated = F.when(m == 0, F.concat("n_name", F.lit("(north)"))).when(m == 1, F.concat(F.lit("university  OF"), F.lower("n_name"))).when(m == 2, F.concat(F.lit("u "), key.cast("string"))).otherwise("nowhere")
    studies = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", stated.alias("stated"))
    return resume.matched_schools(studies, schools, "stated").select("c_custkey", F.coalesce("school_id", F.lit(-1)).alias("school_id"))


@query("""WITH d(i, n, t) AS (VALUES (0, '本科', '1'), (1, '博士后', '10'), (2, 'EMBA', '94'), (3, '职高', '87'), (4, '', '')) SELECT p_partkey, n AS name, t AS number FROM part JOIN d ON i = p_partkey % 5""")
def degree_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = (F.col("p_partkey") % 5).cast("int")
    number, name = F.get(F.array(*[F.lit(x) for x in ("1", "10", "94", "87", "none")]), i), F.get(F.array(*[F.lit(x) for x in ("本科", " 博士后", "emba", "职高", "none")]), i)
    return read(spark, sf_dir, "part").select("p_partkey", resume.degree_name(number).alias("name"), resume.degree_number(name).alias("number"))


@query("""SELECT c_custkey, round((1 + (c_acctbal > 0)::INT + (c_custkey % 2)::INT) / 4.0 * CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE 1.0 END * CASE WHEN c_acctbal < 0 THEN 0.8 ELSE 1.0 END, 6)::DOUBLE AS score FROM customer""")
def record_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, balance = F.col("c_custkey"), F.col("c_acctbal")
    score = resume.completeness([F.col("c_name"), F.when(balance > 0, balance), F.when(k % 2 == 1, "x").otherwise(""), F.lit(None)], [(k % 3 == 0, 0.5), (balance < 0, 0.8)])
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(score, 6).alias("score"))


@query("""SELECT s_suppkey, s_suppkey % 3 <> 2 AS is_region FROM supplier""")
def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as regions, with an ending or none."""
    nation = read(spark, sf_dir, "nation")
    k = F.col("s_suppkey") % 3
    stated = F.when(k == 0, F.concat("n_name", F.lit("省"))).when(k == 1, F.col("n_name")).otherwise(F.concat(F.lit("x"), "n_name"))
    rows = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", stated.alias("t"))
    return resume.regions_named(rows, "t", nation.select(F.concat("n_name", F.lit("市")).alias("name"))).select("s_suppkey", "is_region")


# ---------------------------------------------------------------- page layouts


@query(f"WITH {BOXES} SELECT id, printf('@@%d\t%.1f\t%.1f\t%.1f\t%.1f##', page, x0, x1, top, bottom) AS tag, 'before after' AS bare FROM boxes")
def position_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).withColumn("tag", geometry.position_tag())
    return rows.select("id", "tag", geometry.without_tags(F.concat(F.lit("before"), "tag", F.lit(" after"), "tag")).alias("bare"))


_CAPTIONS = ("图 12", "表1: x", "  图表：： y", "图一", "plain", "表")


@query("WITH l AS (SELECT p_partkey, ['图 12', '表1: x', '  图表：： y', '图一', 'plain', '表'][p_partkey % 6 + 1] AS t, CASE WHEN p_partkey % 7 = 0 THEN 'figure caption' ELSE 'text' END AS k FROM part) SELECT p_partkey, regexp_matches(ltrim(t), '^[图表]+[ 0-9:：]{2,}') OR contains(k, 'caption') AS caption FROM l")
def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*[F.lit(c) for c in _CAPTIONS]), (F.col("p_partkey") % 6).cast("int"))
    kind = F.when(F.col("p_partkey") % 7 == 0, "figure caption").otherwise("text")
    return read(spark, sf_dir, "part").select("p_partkey", layout.is_caption(text, kind).alias("caption"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), d AS (SELECT doc_id, i, i // 5 AS page, CASE WHEN (doc_id + i // 5) % 3 = 0 THEN t || ' ...... 3' ELSE t END AS t FROM l),
b AS (SELECT doc_id, page FROM d GROUP BY ALL HAVING count(*) FILTER (WHERE regexp_matches(t, '(\\.{6,}|·{3,}|…{2,})')) > 3) SELECT doc_id, i::INT AS i FROM d WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM b)""")
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages of five lines; every third page has dot leaders."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).withColumn("page", F.expr("i div 5"))
    dotted = F.when((F.col("doc_id") + F.col("page")) % 3 == 0, F.concat("t", F.lit(" ...... 3"))).otherwise(F.col("t"))
    return geometry.contents_pages(lines.withColumn("t", dotted), "doc_id", "page", "t").select("doc_id", "i")


@query("""WITH b AS (SELECT p_partkey, p_partkey // 50 AS doc, p_brand AS t, ['text', 'header', 'footer'][p_partkey % 3 + 1] AS k FROM part), o AS (SELECT doc, t FROM b WHERE k <> 'text' GROUP BY ALL HAVING count(*) > 1)
SELECT p_partkey FROM b WHERE k = 'text' OR (doc, t) NOT IN (SELECT (doc, t) FROM o)""")
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr("p_partkey div 50").alias("doc"), F.col("p_brand").alias("text"), F.get(F.array(F.lit("text"), F.lit("header"), F.lit("footer")), (F.col("p_partkey") % 3).cast("int")).alias("layout_type"))
    return geometry.repeated_texts(rows, "doc").select("p_partkey")


@query("WITH p AS (SELECT p_partkey // 30 AS doc, p_partkey AS page, p_size::DOUBLE AS h FROM part) SELECT doc, page, coalesce(sum(h) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS offset_h FROM p")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.expr("p_partkey div 30").alias("doc"), F.col("p_partkey").alias("page"), F.col("p_size").cast("double").alias("h"))
    return geometry.page_offsets(rows, "doc", "page", "h").select("doc", "page", F.col("offset").alias("offset_h"))


_COVER = "((greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0)) * (greatest(least(a.bottom, b.bottom) - greatest(a.top, b.top), 0))) / ((a.x1 - a.x0) * (a.bottom - a.top))"


@query(f"""WITH {BOXES}, parts AS (SELECT page, id AS part, ['table row', 'table column', 'table column header', 'table spanning cell'][id // 2 % 4 + 1] AS label, x0 - 5 AS x0, x1 + 5 AS x1, top - 12 AS top, bottom + 12 AS bottom FROM boxes WHERE id % 2 = 1),
c AS (SELECT a.id, b.part, b.label, {_COVER} AS r FROM boxes a JOIN parts b ON a.page = b.page), w AS (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY r DESC, part) AS n FROM c WHERE r > 0.3)
SELECT boxes.id, coalesce(max(part) FILTER (WHERE label = 'table row'), -1) AS r, coalesce(max(part) FILTER (WHERE label = 'table column'), -1) AS c, coalesce(max(part) FILTER (WHERE label = 'table column header'), -1) AS h, coalesce(max(part) FILTER (WHERE label = 'table spanning cell'), -1) AS sp FROM boxes LEFT JOIN w ON w.id = boxes.id AND n = 1 GROUP BY boxes.id""")
def component_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, columns, headers and spans that cover each box best."""
    rows = boxes(spark, sf_dir)
    label = F.get(F.array(F.lit("table row"), F.lit("table column"), F.lit("table column header"), F.lit("table spanning cell")), F.expr("id div 2 % 4").cast("int"))
    parts = rows.where("id % 2 = 1").select("page", F.col("id").alias("part_id"), label.alias("label"), (F.col("x0") - 5).alias("x0"), (F.col("x1") + 5).alias("x1"), (F.col("top") - 12).alias("top"), (F.col("bottom") + 12).alias("bottom"))
    tagged = layout.component_tags(rows.withColumnRenamed("id", "box_id"), parts, ["page"])
    return tagged.select(F.col("box_id").alias("id"), *[F.coalesce(n, F.lit(-1)).alias(n.lower()) for n in ("R", "C", "H", "SP")])


_HEADS = ("第一章 总则", "第二条 范围", "三、说明", "（四）细则", "1、要点", "1.2 节", "1.2.3 小节", "1.2.3.4 段", "问题如下：", "5）其他", "(6)附注", "五是检查", "• item", "ab", "12.5", "plain text")


@query("SELECT p_partkey, [1, 2, 3, 4, 5, 6, 6, 6, 9, 10, 11, 12, 12, 0, 0, 0][p_partkey % 16 + 1] AS level FROM part")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*[F.lit(h) for h in _HEADS]), (F.col("p_partkey") % 16).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", layout.heading_level(text).alias("level"))


@query(f"""WITH RECURSIVE {BOXES}, s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top, x0, id) AS n FROM boxes),
w(page, n, line, start) AS (SELECT page, 1::BIGINT, 0, top FROM s WHERE n = 1 UNION ALL SELECT s.page, s.n, CASE WHEN s.top - w.start > 25 THEN w.line + 1 ELSE w.line END, CASE WHEN s.top - w.start > 25 THEN s.top ELSE w.start END FROM w JOIN s ON s.page = w.page AND s.n = w.n + 1)
SELECT id, (row_number() OVER (PARTITION BY page ORDER BY line, x0, n) - 1)::INT AS place FROM w JOIN s USING (page, n)""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from top to bottom, those of one row from left to right."""
    return geometry.reading_order(boxes(spark, sf_dir).orderBy("id"), ["page"], 25.0).select("id", "place")


@query("""SELECT doc_id, md5(text) AS content_md5, md5(array_to_string(string_split(lower(text), ' '), ' ')) AS tokens_md5, md5(array_to_string(string_split(text, chr(10)), ' ')) AS fine_md5, (doc_id % 7 + 1)::INT AS page_num, (doc_id % 90)::INT AS top,
  (doc_id % 7 + 1) || ',' || (doc_id % 5) || ',9,' || (doc_id % 90) || ',99' AS position FROM documents""")
def store_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a search store."""
    k = F.col("doc_id")
    place = F.array(F.struct((k % 7).alias("page"), (k % 5 + 0.4).alias("left"), F.lit(9.9).alias("right"), (k % 90 + 0.7).alias("top"), F.lit(99.5).alias("bottom")))
    chunks = read(spark, sf_dir, "documents").select("doc_id", "text", F.split(F.lower("text"), " ").alias("tokens"), F.split("text", "\n").alias("fine_tokens"), place.alias("boxes"))
    made = fields.store_fields(chunks, positions="boxes")
    return made.select(
        "doc_id", md5("content_with_weight").alias("content_md5"), md5("content_ltks").alias("tokens_md5"), md5("content_sm_ltks").alias("fine_md5"), F.get("page_num_int", F.lit(0)).alias("page_num"),
        F.get("top_int", F.lit(0)).alias("top"), F.array_join(F.get("position_int", F.lit(0)).cast("array<string>"), ",").alias("position"),
    )


@query("""WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, n_nationkey FROM nation) SELECT n_regionkey, (i // 2)::INT AS batch, string_agg(n_name, '；' ORDER BY n_nationkey) AS n_name FROM n GROUP BY ALL""".replace("'；'", "'； '"))
def row_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.row_batches(read(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", "n_name", False, 2)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) // 2 AS h FROM embeddings), p AS (SELECT vec_id, e[1:h] AS a, e[h + 1:2 * h] AS b FROM v), q AS (SELECT vec_id, a, b, lead(a) OVER (ORDER BY vec_id) AS c, lead(b) OVER (ORDER BY vec_id) AS d FROM p)
SELECT vec_id, round(greatest(list_inner_product(a, c), list_inner_product(a, d)) + greatest(list_inner_product(b, c), list_inner_product(b, d)), 6) AS score FROM q WHERE c IS NOT NULL""")
def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of each vector against those of the next, by id."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    half = F.expr("size(embedding) div 2")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.array(F.slice(e, F.lit(1), half), F.slice(e, half + 1, half)).alias("vs"))
    # ids are whole numbers in a row, so the next one is found by equality, not in one sorted partition
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vs").alias("ws"))
    return rows.join(after, "vec_id").select("vec_id", F.round(docstore.late_interaction(F.col("vs"), F.col("ws")), 6).alias("score"))


@query(f"""WITH {retrieval.lex_sql("documents", "doc_id", "benchmark", "item_id")}, f AS (SELECT * FROM lex_ranked WHERE rank <= 5 AND score > 60) SELECT item_id, doc_id, score, rank FROM f
UNION ALL SELECT item_id, doc_id, score, rank FROM lex_ranked WHERE rank <= 3 AND item_id NOT IN (SELECT item_id FROM f)""")
def relaxed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict search, and a looser one for questions that it leaves without a hit."""
    hits = written(lexical.search(read(spark, sf_dir, "documents"), "doc_id", read(spark, sf_dir, "benchmark"), "item_id", 5), "relaxed-hits")
    return docstore.relaxed(hits.where("score > 60"), hits.where("rank <= 3"), "item_id").select("item_id", "doc_id", "score", "rank")


_DENSE = """dense AS (SELECT p_partkey AS box_id, p_partkey // 20 AS page, ['t', 'u'][p_partkey % 2 + 1] AS type, (p_size * 7 % 30)::DOUBLE AS x0, (p_size * 7 % 30 + 25 + p_partkey % 9)::DOUBLE AS x1, (p_partkey % 20 // 5 * 12)::DOUBLE AS top, (p_partkey % 20 // 5 * 12 + 10 + p_size % 5)::DOUBLE AS bottom,
  ((p_partkey * 37 % 101) / 100.0)::DOUBLE AS score FROM part)"""
_STRUCT = "STRUCT(id BIGINT, type VARCHAR, x0 DOUBLE, x1 DOUBLE, t DOUBLE, b DOUBLE)"
_BOTH = "greatest(least(k.x1, s.x1) - greatest(k.x0, s.x0), 0) * greatest(least(k.b, s.bottom) - greatest(k.t, s.top), 0)"
_SIZES = "(k.x1 - k.x0) * (k.b - k.t)", "(s.x1 - s.x0) * (s.bottom - s.top)"


def _kept_boxes(order: str, clash: str) -> str:
    """SQL of a walk over each page's boxes that keeps those which clash with none kept before."""
    return f"""WITH RECURSIVE {_DENSE}, s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {order}) AS n FROM dense),
w(page, n, kept) AS (SELECT DISTINCT page, 0::BIGINT, []::{_STRUCT}[] FROM s UNION ALL SELECT s.page, s.n, CASE WHEN len(list_filter(w.kept, lambda k: {clash})) = 0
  THEN list_append(w.kept, {{'id': s.box_id, 'type': s.type, 'x0': s.x0, 'x1': s.x1, 't': s.top, 'b': s.bottom}}::{_STRUCT}) ELSE w.kept END FROM w JOIN s ON s.page = w.page AND s.n = w.n + 1),
l AS (SELECT page, arg_max(kept, n) AS kept FROM w GROUP BY page) SELECT page, unnest(kept).id AS box_id FROM l"""


def dense_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scored boxes that lie over each other, twenty on a page."""
    d = lambda e: F.expr(e).cast("double")
    kind = F.get(F.array(F.lit("t"), F.lit("u")), (F.col("p_partkey") % 2).cast("int"))
    row = "(p_partkey % 20 div 5 * 12)"
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("box_id"), F.expr("p_partkey div 20").alias("page"), kind.alias("type"), d("p_size * 7 % 30").alias("x0"), d("p_size * 7 % 30 + 25 + p_partkey % 9").alias("x1"), d(row).alias("top"),
        d(f"{row} + 10 + p_size % 5").alias("bottom"), d("(p_partkey * 37 % 101) / 100.0").alias("score"),
    )


@query(_kept_boxes("score DESC, box_id", f"{_BOTH} / greatest({_SIZES[0]} + {_SIZES[1]} - {_BOTH}, 1e-9) > 0.45"))
def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of boxes that share much of their area the best scored stay."""
    return geometry.suppress(dense_boxes(spark, sf_dir), ["page"]).select("page", "box_id")


@query(_kept_boxes(f"score DESC, {_SIZES[1].replace('s.', '')} DESC, box_id", f"k.type = s.type AND {_BOTH} >= 0.7 * greatest(least({_SIZES[0]}, {_SIZES[1]}), 1e-9)"))
def layout_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of boxes of one type of which one covers the other the best scored stay."""
    return grids.clean_layouts(dense_boxes(spark, sf_dir), ["page"]).select("page", "box_id")


def _bands(name: str, low: str, high: str) -> str:
    """CTEs that number the bands of boxes along one axis."""
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {low}) AS n FROM shifted),
{name}(page, n, id, band, reach) AS (SELECT page, n, id, 0, {high} FROM {name}_o WHERE n = 1 UNION ALL SELECT o.page, o.n, o.id, CASE WHEN w.reach - o.{low} < 0.5 * greatest(o.{high} - o.{low}, 1e-9) THEN w.band + 1 ELSE w.band END,
  CASE WHEN w.reach - o.{low} < 0.5 * greatest(o.{high} - o.{low}, 1e-9) THEN o.{high} ELSE greatest(w.reach, o.{high}) END FROM {name} w JOIN {name}_o o ON o.page = w.page AND o.n = w.n + 1)"""


@query(f"""WITH RECURSIVE {BOXES}, shifted AS (SELECT id, page, x0 + id / 1024.0::DOUBLE AS x0, x1 + id / 1024.0::DOUBLE AS x1, top, bottom FROM boxes), {_bands("r", "top", "bottom")}, {_bands("c", "x0", "x1")}
SELECT id, r.band::INT AS row, c.band::INT AS col FROM r JOIN c USING (id)""")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of the boxes of each page; the shift parts equal edges."""
    shift = F.col("id") / 1024.0
    return grids.grid(boxes(spark, sf_dir).withColumns({"x0": F.col("x0") + shift, "x1": F.col("x1") + shift}), ["page"]).select("id", "row", "col")


# ---------------------------------------------------------------- answers, overlaps, synonyms, metadata


@query("SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'qa' WHEN 1 THEN 'compare' WHEN 5 THEN 'summary' ELSE 'none' END AS intent FROM conversations")
def intent_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents in models' answers: plain JSON, JSON among words, unknown labels, none, labels with blanks."""
    said = F.array(F.lit('{"intent": "qa"}'), F.concat(F.lit("It says: "), "text", F.lit('\n{"intent": "compare",\n "why": 1} ok')), F.lit('{"intent": "dance"}'), F.lit("no object"), F.lit('{"label": "qa"}'), F.lit('{"intent": " summary "}'))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(said, (F.col("conv_id") % 6).cast("int")).alias("answer"))
    return rows.select("conv_id", "turn", F.coalesce(questions.said_intent(F.col("answer")), F.lit("none")).alias("intent"))


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]|[A-Za-z0-9]+') AS q, regexp_extract_all(lower(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')), '[\x{4e00}-\x{9fff}]|[A-Za-z0-9]+') AS d FROM conversations)
SELECT conv_id, turn, CASE WHEN len(q) = 0 THEN 0.0 ELSE round(len(list_filter(q, lambda w: list_contains(d, w)))::DOUBLE / len(q), 6) END AS share FROM t""")
def overlap_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return read(spark, sf_dir, "conversations").withColumn("d", after).select("conv_id", "turn", F.round(T.overlap_share(F.col("text"), F.col("d")), 6).alias("share"))


@query("""WITH t AS (SELECT p_partkey, lower(string_split(p_name, ' ')[1]) AS a, 'Size  ' || p_size AS b FROM part), u AS (SELECT p_partkey, a AS token FROM t UNION ALL SELECT p_partkey, b FROM t)
SELECT p_partkey, token, CASE WHEN token LIKE 'Size%' THEN CASE WHEN (split_part(token, '  ', 2)::INT) % 2 = 0 THEN 'even|n' || split_part(token, '  ', 2) ELSE '' END WHEN substr(token, 1, 1) < 'm' THEN token || ' kind' ELSE '' END AS synonyms FROM u""")
def synonym_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by a table of lemmas, other tokens by a dictionary whose names have single blanks."""
    part = read(spark, sf_dir, "part")
    word = F.lower(F.get(F.split("p_name", " "), 0))
    tokens = part.select("p_partkey", F.explode(F.array(word, F.concat(F.lit("Size  "), F.col("p_size").cast("string")))).alias("token"))
    lemmas = part.select(word.alias("name")).distinct().where("substring(name, 1, 1) < 'm'").select("name", F.array(F.concat("name", F.lit("_kind")), F.col("name")).alias("others"))
    sizes = part.select("p_size").distinct().where("p_size % 2 = 0").select(F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("name"), F.array(F.lit("even"), F.concat(F.lit("n"), F.col("p_size").cast("string"))).alias("others"))
    return weights.synonyms(tokens, "token", sizes, lemmas).select("p_partkey", "token", F.array_join("synonyms", "|").alias("synonyms"))


@query("""SELECT r_regionkey, '文档编号：' || r_name || chr(10) || '修订记录：' || chr(10) || string_agg('  - 作者=' || n_name || '；版本=' || n_nationkey, chr(10) ORDER BY n_nationkey) AS text FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def metadata_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    items = F.transform("ns", lambda n: F.create_map(F.lit("作者"), n["n_name"], F.lit("版本"), n["n_nationkey"].cast("string")))
    entry = lambda name, value, items: F.struct(F.lit(name).alias("name"), value.alias("value"), items.alias("items"))
    none = F.lit(None).cast("array<map<string,string>>")
    rows = read(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select("r_regionkey", tables.metadata_text(F.array(entry("文档编号", F.col("r_name"), none), entry("修订记录", F.lit(None).cast("string"), items))).alias("text"))


@query("WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) AS n FROM embeddings) SELECT vec_id, round(e[1] / n, 6) AS first, round(e[len(e)] / n, 6) AS last, len(e)::BIGINT AS dims FROM n")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", S.unit(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"), F.size("u").cast("long").alias("dims"))


# ---------------------------------------------------------------- splitters and streams that had no SQL

SPLIT = r"""WITH RECURSIVE u AS (SELECT doc_id, regexp_extract_all(text, '[\n!?;。；！？]|[^\n!?;。；！？]+') AS ps FROM documents),
p AS (SELECT doc_id, i, t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS upto FROM (SELECT doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) AS i FROM u)),
r(doc_id, idx, base) AS (SELECT DISTINCT doc_id, 0, 0::BIGINT FROM p UNION ALL SELECT r.doc_id, r.idx + 1, min(p.upto) FROM r JOIN p ON p.doc_id = r.doc_id AND p.upto > r.base + 400 GROUP BY r.doc_id, r.idx),
c AS (SELECT doc_id, idx, base, coalesce(lead(base) OVER (PARTITION BY doc_id ORDER BY idx), 1000000000000) AS top FROM r)
SELECT c.doc_id, c.idx, string_agg(t, '' ORDER BY i) AS text, sum(length(t))::BIGINT AS n FROM c JOIN p ON p.doc_id = c.doc_id AND p.upto > c.base AND p.upto <= c.top GROUP BY c.doc_id, c.idx"""

#: SQL of queries of the other modules.
MORE_SQL = {
    "txt_split": SPLIT,
    "stream_ingest": f"WITH {retrieval.CHUNKS} SELECT chunk_id, idx, length(text)::INT AS n_chars FROM records",
}
