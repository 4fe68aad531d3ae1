"""Fusing and re-ranking candidate lists; every list is bounded by its candidate count for each query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions import scores as S
from docweave.functions import text as T


def hybrid(vector: DataFrame, lexical: DataFrame, query_key: str, key: str, k: int, weight: float = 0.7) -> DataFrame:
    """Full outer join of two candidate lists (query_key, key, score, rank), each scaled over its own list."""
    weight = min(max(weight, 0.0), 1.0)

    def arm(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(query_key, key, F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"), S.min_max(F.col("score"), [query_key]).alias(f"{name}_scaled"))

    both = arm(vector, "v").join(arm(lexical, "t"), [query_key, key], "full_outer")
    zero = F.lit(0.0)
    score = F.round(weight * F.coalesce("v_scaled", zero) + (1.0 - weight) * F.coalesce("t_scaled", zero), 6)
    scored = both.select(query_key, key, score.alias("score"), F.coalesce("v_score", zero).alias("vector_score"), F.coalesce("t_score", zero).alias("term_score"), F.coalesce("v_rank", F.lit(1 << 20) + F.col("t_rank")).alias("_tie"))
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), "_tie"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).drop("_tie")


def keyword_rerank(candidates: DataFrame, query_key: str, key: str, k: int, weight: float = 0.7) -> DataFrame:
    """Blend scaled vector scores with keyword shares. candidates: query_key, key, score, rank, query_text, text."""
    weight = min(max(weight, 0.0), 1.0)
    terms = T.keywords(F.col("query_text"))
    rows = candidates.withColumns({"_terms": terms, "scaled": S.min_max(F.col("score"), [query_key])})
    rows = rows.withColumn("term_score", T.keyword_share(F.col("_terms"), F.col("text")))
    final = F.when(F.size("_terms") > 0, weight * F.col("scaled") + (1.0 - weight) * F.col("term_score")).otherwise(F.col("score"))
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("final_score"), "rank"))
    return rows.withColumn("final_score", F.round(final, 6)).withColumn("final_rank", rank).where(F.col("final_rank") <= k).select(query_key, key, F.col("score").alias("vector_score"), "term_score", "final_score", "final_rank")


#: Fixed value: how stored question-answer texts begin.
QA_PREFIX = "【预生成QA】"


def format_answers(results: DataFrame) -> DataFrame:
    """Rows that hold a stored answer get a text that states question and answer."""
    is_qa = (F.coalesce(F.col("record_type"), F.lit("")) == "generated_qa") | F.coalesce(F.startswith(F.col("text"), F.lit(QA_PREFIX)), F.lit(False))
    ready = is_qa & (F.coalesce(F.col("qa_question"), F.lit("")) != "") & (F.coalesce(F.col("qa_answer"), F.lit("")) != "")
    said = F.concat(F.lit(f"{QA_PREFIX}\n命中的预生成问题："), "qa_question", F.lit("\n可加入上下文的答案："), "qa_answer")
    return results.withColumn("text", F.when(ready, said).otherwise(F.col("text")))


def first_seen(hits: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """Merge the lists of a query's parts: first sight of a key wins, order by part then rank, cut to max(k, parts)."""
    seen = F.row_number().over(W.partitionBy(query_key, key).orderBy("part", "rank"))
    once = hits.withColumn("_seen", seen).where("_seen = 1").drop("_seen")
    place = F.row_number().over(W.partitionBy(query_key).orderBy("part", "rank"))
    return once.withColumn("place", place).where(F.col("place") <= F.greatest(F.lit(k), F.col("n_parts"))).drop("n_parts")
