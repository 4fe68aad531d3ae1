"""Mixing sources to target weights.

Words are counted per source, each source gets a target share of all words, and the repetition rate
target / size says how often its documents appear: floor(rate) times, plus one more if a number
hashed from the id and a seed falls below the fraction. Every source takes the one of `seeds` seeds whose draws bring its words
nearest to the target; all are tried in one aggregation over ids and sizes, a partial sum for each source and seed. A target stops at `most_repeats` times the
source's size and the excess is shared again by weight until no source is above; that end state is
the level L with sum(min(most_repeats * size, weight * L)) = total, found by one ordered pass over
the sources (a row a source), not over documents.

Defined results: null and empty texts have size 0; sources order by code point with null last, and
null is a source of its own; a source of size 0 has target 0 and its documents appear at the
overall floor of 0 times; of seeds that come equally near the least is taken; a null doc_id hashes as the text `null`; repeated
rows each count and get the same decision; an empty table gives no rows. A text is only split to count it, so memory follows the longest one. Other
columns, whatever their names, are kept by `mix_documents` and ignored by `mixing_plan`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.llm.shared import ascii_words, discarding, materialize


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[int, ...] = (5, 2, 1)
    most_repeats: int = 3
    seed: str = "mix"
    seeds: int = 32
    broadcast_sources: int = 20_000


def source_targets(sized: DataFrame, settings: MixSettings) -> DataFrame:
    """source, source_size, target; windows run over the table of sources only."""
    s = settings
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in s.weights])
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(weights, (F.row_number().over(by_name) - 1) % len(s.weights) + 1).cast("long"))
        .withColumn("top", F.col("source_size") * s.most_repeats)
    )
    order = W.orderBy((F.col("top") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    level = (F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    stated = (
        sources.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("open", F.col("top") > F.col("weight") * F.col("level"))
        .withColumn("end_level", F.min(F.when(F.col("open"), F.struct(F.col("top") / F.col("weight"), F.col("level")))).over(everything)["level"])
    )
    target = F.coalesce(F.least(F.col("top").cast("double"), F.col("weight") * F.col("end_level")), F.col("top").cast("double"))
    return stated.select("source", "source_size", target.alias("target"))


def chance(doc_id: Column, seed: Column) -> Column:
    """A number in [0, 1) hashed from the id; 52 bits, so exact as a double."""
    digest = F.md5(F.concat(seed, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _bounded(sources: DataFrame, settings: MixSettings) -> DataFrame:
    """Broadcast if there are few sources; else joins shuffle, and adaptive execution splits a hot source."""
    return F.broadcast(sources) if sources.count() <= settings.broadcast_sources else sources


def _copies(doc_id: Column, settings: MixSettings, number: str) -> Column:
    """Copies of a document, given its source's rate and the number of a seed."""
    extra = chance(doc_id, F.concat(F.lit(f"{settings.seed}-"), F.col(number).cast("string"))) < F.col("rate") - F.floor("rate")
    return F.floor("rate") + extra.cast("long")


def source_rates(sized: DataFrame, settings: MixSettings) -> DataFrame:
    """_source, source_size, target, rate and the number of the seed that comes nearest; sized: doc_id, source and size of each document."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = materialize(source_targets(sized, settings).withColumnRenamed("source", "_source").withColumn("rate", rate), "mix-targets")
    drawn = sized.where("size > 0").join(_bounded(targets, settings), F.col("source").eqNullSafe(F.col("_source")))
    tried = drawn.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(settings.seeds - 1))))
    sums = tried.groupBy("_source", "number", "target").agg(F.sum(F.col("size") * _copies(F.col("doc_id"), settings, "number")).alias("taken"))
    best = sums.groupBy(F.col("_source").alias("_best")).agg(F.min(F.struct(F.abs(F.col("taken") - F.col("target")), "number"))["number"].alias("number"))
    found = targets.join(best, F.col("_source").eqNullSafe(F.col("_best")), "left").drop("_best")
    return materialize(found.withColumn("number", F.coalesce("number", F.lit(0))), "mix-rates")


def mixing_plan(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken. Texts are read once."""
    with discarding(docs.sparkSession) as keep:
        sized = keep(materialize(docs.select("doc_id", "source", F.size(ascii_words(F.col("text"))).cast("long").alias("size")), "mix-sizes"))
        rates = keep(source_rates(sized, settings))
    plan = sized.join(_bounded(rates, settings), F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", _copies(F.col("doc_id"), settings, "number"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """The mix itself: each document as often as the plan says, with the input's columns."""
    with discarding(docs.sparkSession) as keep:
        sized = materialize(docs.select("doc_id", "source", F.size(ascii_words(F.col("text"))).cast("long").alias("size")), "mix-sizes")
        rates = keep(source_rates(sized, settings))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    plan = rows.join(_bounded(rates, settings), F.col("row.source").eqNullSafe(F.col("_source"))).withColumn("copies", _copies(F.col("row.doc_id"), settings, "number"))
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("time")
    return plan.where("copies > 0").select("row", times).select("row.*")
