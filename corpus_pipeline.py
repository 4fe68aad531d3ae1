"""A training-corpus pipeline: quality rules, line dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet
and reread as the next stage's docs. All stages but the last return the columns of documents.

Every stage has its operator's results for nulls, empty and very long texts, ties, repeated rows and further columns: null and empty
texts fail the quality rules, so later stages meet none of them unless they are run alone, where null text has no lines, no shingles, size
0 and one separator token. Repeated rows: quality keeps or drops them alike, lines leaves the lines of one, near dedup keeps all
rows of the kept id, mixing repeats them alike, packing cuts each. A tie between near copies goes to the least doc_id. Further columns
pass through all stages but packing. An empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.op3_packing import PackSettings, pack
from docweave.llm.op4_quality import keep_good
from docweave.llm.op6_minhash import MinMaxSettings, keep_one
from docweave.llm.op7_mixing import mix_documents
from docweave.llm.op8_linededup import deduplicate
from docweave.llm.shared import delete_path, discarding, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the classifier keep."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rid of lines that match an earlier line; one that loses every line goes."""
    left = deduplicate(docs).where("lines_left > 0 OR n_lines = 0")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8 or more."""
    return keep_one(docs, MinMaxSettings(shingle=5))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their target weights."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, PackSettings(public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]

#: Models and hashes of the stages are beyond SQL; tests compare with plain code instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/docweave/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with discarding(spark):  # what the stage wrote on its way goes once its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before is not None:
            delete_path(spark, before)
        before = f"{base}/{name}"
    return docs
