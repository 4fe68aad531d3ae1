"""Record stores as DataFrames: append, upsert, delete, existence, replacement, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows go to the end; a key may then occur twice."""
    last = store.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last"))  # one row
    moved = batch.crossJoin(F.broadcast(last)).withColumn("seq", F.col("seq") + F.col("_last") + 1).drop("_last")
    return store.unionByName(moved, allowMissingColumns=True)


def upsert(log: DataFrame, key: str, version: str, seq: str) -> DataFrame:
    """The last version of each key, at the place where the key was first seen. One partial aggregation."""
    rest = [c for c in log.columns if c not in (key, version, seq)]
    last = log.groupBy(key).agg(F.max(F.struct(version, seq, *rest)).alias("_r"), F.min(seq).alias("_first"))
    return last.select(key, F.col("_first").alias(seq), F.col(f"_r.{version}").alias(version), *[F.col(f"_r.{c}").alias(c) for c in rest])


def delete(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return store.join(gone.select(key).distinct(), key, "left_anti")


def exists(asked: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """asked with a column `found`."""
    seen = store.select(F.col(key).alias("_k")).distinct().withColumn("_in", F.lit(True))
    return asked.join(seen, asked[key] == seen["_k"], "left").withColumn("found", F.coalesce("_in", F.lit(False))).drop("_k", "_in")


def replace(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch's documents take the place of what the store held of them; a second run changes nothing."""
    return delete(store, batch, key).unionByName(batch, allowMissingColumns=True)


def latest_success(log: DataFrame, case: str, order: str, error: str, score: str) -> DataFrame:
    """The last row of each case that has a score and no error."""
    ok = log.where((F.coalesce(F.col(error), F.lit("")) == "") & F.col(score).isNotNull() & (F.coalesce(F.col(case).cast("string"), F.lit("")) != ""))
    rest = [c for c in log.columns if c not in (case, order)]
    best = ok.groupBy(case).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return best.select(case, F.col(f"_r.{order}").alias(order), *[F.col(f"_r.{c}").alias(c) for c in rest])


def pending(cases: DataFrame, done: DataFrame, case: str) -> DataFrame:
    return cases.join(done.select(case).distinct(), case, "left_anti")
