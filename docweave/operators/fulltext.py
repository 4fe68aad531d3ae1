"""Full-text questions: cleaning, language, question words, and search over fields with boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions import scores as S
from docweave.functions import text as T
from docweave.sources.workspace import written

#: How much a hit in each field counts.
FIELD_BOOSTS = {"title_tks": 10.0, "title_sm_tks": 5.0, "important_kwd": 30.0, "important_tks": 20.0, "question_tks": 20.0, "content_ltks": 2.0, "content_sm_ltks": 1.0}
#: Most (query, term) rows that are broadcast; beyond it terms join by shuffle.
HELD_CLAUSES = 20_000
#: Words that ask but don't say what about.
ASKING = (
    ("(?i)是*(什么样的|哪家|一下|那家|请问|啥样|咋样了|什么时候|何时|何地|何人|是否|是不是|多少|哪里|怎么|哪儿|怎么样|如何|哪些|是啥|啥是|啊|吗|呢|吧|咋|什么|有没有|呀|谁|哪位|哪个)是*", ""),
    ("(?i)(^| )(what|who|how|which|where|why)('re|'s)? ", " "),
    (
        "(?i)(^| )('s|'re|is|are|were|was|do|does|did|don't|doesn't|didn't|has|have|be|there|you|me|your|my|mine|just|please|may|i|should|would|wouldn't|will|won't|done|go|for|with|so|the|a|an|by|i'm|it's|he's|she's|they|they're|you're|as|by|on|in|at|up|out|down|of|to|or|and|if) ",
        " ",
    ),
)
#: Tokens that carry no weight in a question.
STOPWORDS = ("请问", "您", "你", "我", "他", "是", "的", "就", "有", "于", "及", "即", "在", "为", "最", "从", "以", "了", "将", "与", "吗", "吧", "中", "#", "什么", "怎么", "哪个", "哪些", "啥", "相关")


def clean_question(text: Column) -> Column:
    """Lower case, half width, marks to spaces."""
    return F.trim(F.regexp_replace(T.fold_width(F.lower(text)), r"[ :|\r\n\t,，。？?/`!！&^%()\[\]{}<>]+", " "))


def without_asking(text: Column) -> Column:
    for pattern, instead in ASKING:
        text = F.regexp_replace(text, pattern, instead)
    return text


def mostly_not_latin(text: Column) -> Column:
    """Three words or fewer, or at least seven of ten words that aren't Latin letters only."""
    words = F.split(text, "[ \t]+")
    other = F.size(F.filter(words, lambda w: ~w.rlike("^[a-zA-Z]+$")))
    return (F.size(words) <= 3) | (other / F.size(words).cast("double") >= 0.7)


def escaped(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"([:{}/\[\]\-*\"()|+~^])", r"\\$1"))


def worth_weighing(tokens: Column, numbers: bool = False) -> Column:
    """Tokens without stop words, marks and (unless asked for) single digits."""
    drop = F.array(*[F.lit(w) for w in STOPWORDS])
    marks = "^[~—\\t @#%!<>,.?\":;'{}\\[\\]_=()|，。？》•●○↓《；‘’：“”【¥ 】…￥！、·（）×`&\\\\/「」]"
    kept = F.filter(tokens, lambda t: (t != "") & ~F.array_contains(drop, t) & ~t.rlike(marks))
    return kept if numbers else F.filter(kept, lambda t: ~t.rlike("^[0-9]$"))


def phrases(tokens: Column) -> Column:
    """Neighbouring Latin words join to phrases, a fold over the tokens in order."""
    latin = lambda t: t.rlike("[a-zA-Z]$")

    def step(acc, t):
        last = F.element_at(acc, -1)
        together = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), t)))
        return F.when((F.size(acc) > 0) & latin(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))) & latin(t), together).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(tokens, F.array().cast("array<string>"), step)


def best_fields(hits: DataFrame, clauses: DataFrame, query_key: str, key: str, k: int, min_match: float = 0.0) -> DataFrame:
    """query_key, key, score, rank of rows by their best field.

    hits: key, field, term, tf, length (postings by field); clauses: query_key, term, weight. A field scores its
    boosted BM25; the best field counts; rows must match the asked share of a query's terms.

    Postings of asked terms are written once, then grouped once by query and row. They meet tables of a bounded size, or
    join by a merge: a size that Spark estimates from compressed shuffles must not make it broadcast a table of rows.
    """
    beside = F.broadcast if clauses.limit(HELD_CLAUSES + 1).count() <= HELD_CLAUSES else lambda df: df.hint("merge")
    boost = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FIELD_BOOSTS.items() for x in kv]), F.col("field")), F.lit(1.0))
    sizes = hits.select("field", key, "length").distinct().groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    asked = clauses.groupBy(query_key).agg(F.countDistinct("term").alias("asked"))
    found = written(hits.join(beside(clauses.select("term").distinct()), "term", "left_semi"), "field-hits")
    df = found.groupBy("field", "term").agg(F.count("*").alias("df"))
    met = found.join(beside(clauses), "term").join(beside(df), ["field", "term"]).join(F.broadcast(sizes), "field")  # sizes: a row a field
    value = boost * S.bm25(F.col("tf"), F.col("weight"), S.inverse_frequency(F.col("n"), F.col("df")), F.col("length"), F.col("mean_length"))
    rows = met.groupBy(query_key, key).agg(F.array_sort(F.collect_list(F.struct("field", "term", value.alias("value")))).alias("met"))
    of = lambda f: F.aggregate(F.filter("met", lambda x: x["field"] == f), F.lit(0.0), lambda s, x: s + x["value"])
    score = F.round(F.array_max(F.transform(F.array_distinct(F.col("met.field")), of)), 6)
    best = rows.select(query_key, key, score.alias("score"), F.size(F.array_distinct(F.col("met.term"))).alias("met")).join(beside(asked), query_key)
    kept = best.where(F.col("met") >= F.ceil(F.lit(min_match) * F.col("asked")))
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), key))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select(query_key, key, "score", "rank")


def top_terms(weighted: DataFrame, key: str, k: int = 30) -> DataFrame:
    """The k heaviest terms of each paragraph. weighted: key, token, weight."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("weight"), "token"))
    return weighted.withColumn("rank", rank).where(F.col("rank") <= k)


def near_phrases(positions: DataFrame, key: str, first: str, second: str, slop: int = 2) -> DataFrame:
    """Keys where two terms stand within so many places. positions: key, term, pos."""
    a = positions.where(F.col("term") == first).select(key, F.col("pos").alias("p1"))
    b = positions.where(F.col("term") == second).select(key, F.col("pos").alias("p2"))
    return a.join(b, key).where(F.abs(F.col("p1") - F.col("p2")) <= slop).select(key).distinct()
