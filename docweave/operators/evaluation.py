"""Grading of answers: keyword coverage, blended scores and grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions import scores as S
from docweave.functions import text as T

#: Column names under which evaluation cases come.
ALIASES = {
    "case_id": ("case_id", "id", "编号"),
    "question": ("question", "query", "问题", "用户问题"),
    "standard_answer": ("standard_answer", "answer", "expected_answer", "标准答案"),
    "answer_keywords": ("answer_keywords", "keywords", "expected_keywords", "标准答案关键词", "答案关键词"),
    "intent": ("intent", "意图", "category", "类别"),
    "sub_intent": ("sub_intent", "子意图", "sub_category"),
}


def first_present(df: DataFrame, names: tuple[str, ...], default: Column) -> Column:
    """The first of the named columns that exists and is neither null nor empty."""
    there = [F.when(F.col(n).cast("string") != "", F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*there, default) if there else default


def normalize_cases(rows: DataFrame, declared: tuple[str, ...] = (), seq: str = "seq") -> DataFrame:
    """Cases with canonical columns; names that a schema declares win over the common ones. Rows without a question go."""
    order = {k: tuple(n for n in v if n in declared) + tuple(n for n in v if n not in declared) for k, v in ALIASES.items()}
    text = lambda k, d: first_present(rows, order[k], F.lit(d)).cast("string").alias(k)
    there = [n for n in order["answer_keywords"] if n in rows.columns]
    words = F.array().cast("array<string>")
    if there:
        listed = [T.parse_keywords(F.col(n)) if rows.schema[n].dataType.typeName() == "string" else F.filter(F.transform(n, lambda x: T.strip(x.cast("string"))), lambda x: x != "") for n in there]
        words = F.coalesce(*[F.when(F.size(w) > 0, w) for w in listed], words)
    case_id = first_present(rows, order["case_id"], F.format_string("case_%04d", F.col(seq))).cast("string").alias("case_id")
    out = rows.select(case_id, text("question", ""), text("standard_answer", ""), words.alias("answer_keywords"), text("intent", "unknown"), text("sub_intent", ""))
    return out.where("question <> ''")


def matched_keywords(answer: Column, words: Column) -> Column:
    return T.bound(T.squeeze(answer), lambda flat: F.filter(words, lambda w: T.bound(T.squeeze(w), lambda low: (low != "") & F.contains(flat, low))))


def coverage(answer: Column, words: Column) -> Column:
    """Share of keywords found in the answer; null without keywords."""
    n = F.size(F.coalesce(words, F.array().cast("array<string>")))
    return F.when(n > 0, F.size(matched_keywords(answer, words)).cast("double") / n)


def graded(cases: DataFrame, weight: float = 0.7) -> DataFrame:
    """Adds keyword_coverage and final_accuracy. cases: rag_answer, answer_keywords, llm_accuracy."""
    rows = cases.withColumn("keyword_coverage", coverage(F.col("rag_answer"), F.col("answer_keywords")))
    return rows.withColumn("final_accuracy", S.blend(S.clamp(F.col("llm_accuracy")), F.col("keyword_coverage"), weight))


def summary(results: DataFrame) -> DataFrame:
    """level (total, intent, sub_intent), intent, sub_intent and the means, in one pass over the results."""
    named = results.withColumn("sub_intent", F.when(F.coalesce("sub_intent", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("sub_intent")))
    sets = named.groupingSets([[], ["intent"], ["intent", "sub_intent"]], "intent", "sub_intent").agg(
        F.grouping_id().alias("_g"),
        F.count("*").alias("cases"),
        F.coalesce(F.round(F.avg("final_accuracy"), 9), F.lit(0.0)).alias("final_accuracy"),
        F.round(F.avg("keyword_coverage"), 9).alias("keyword_coverage"),
        F.count("keyword_coverage").alias("keyword_cases"),
        F.coalesce(F.round(F.avg("llm_accuracy"), 9), F.lit(0.0)).alias("llm_accuracy"),
    )
    level = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "intent").otherwise("sub_intent")
    return sets.withColumn("level", level).drop("_g")


def context(hits: DataFrame, query_key: str, most: int = 6000) -> DataFrame:
    """query_key, context: ranked hits under headers, cut to a character budget; chars: what counts towards it, so without joints.

    hits: rank, file_name, score, text.
    """
    head = F.format_string("[%d] %s score=%s\n", F.col("rank"), F.col("file_name"), S.fixed(F.col("score").cast("double")))
    pieces = hits.select(query_key, "rank", F.concat(head, T.strip(F.coalesce("text", F.lit("")))).alias("piece"))
    before = F.coalesce(F.sum(F.length("piece")).over(W.partitionBy(query_key).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = pieces.withColumn("_b", before).where(F.col("_b") < most).withColumn("piece", F.substring("piece", F.lit(1), (most - F.col("_b")).cast("int")))
    packed = cut.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct("rank", "piece"))).alias("_p"))
    chars = F.aggregate("_p", F.lit(0).cast("long"), lambda n, p: n + F.length(p["piece"]))
    return packed.select(query_key, F.array_join(F.transform("_p", lambda p: p["piece"]), "\n\n").alias("context"), chars.alias("chars"))
