"""A search surface over stored rows: filters, ordering, paging, aggregations, highlights, rank features, tags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MatchText:
    fields: tuple[str, ...]
    text: str
    topn: int = 10
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class MatchDense:
    column: str
    vector: tuple[float, ...]
    distance: str = "cosine"
    topn: int = 10
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class MatchSparse:
    column: str
    weights: dict[int, float]
    topn: int = 10


@dataclass(frozen=True)
class MatchTensor:
    column: str
    vectors: tuple[tuple[float, ...], ...]
    topn: int = 10


@dataclass(frozen=True)
class Fusion:
    method: str
    topn: int
    params: dict = field(default_factory=dict)


@dataclass
class OrderBy:
    """Fields in order, each with True for ascending."""

    fields: list[tuple[str, bool]] = field(default_factory=list)

    def asc(self, name: str) -> OrderBy:
        self.fields.append((name, True))
        return self

    def desc(self, name: str) -> OrderBy:
        self.fields.append((name, False))
        return self

    def columns(self, df: DataFrame) -> list[Column]:
        """Missing fields are skipped, nulls come last, several values count as their mean."""
        out = []
        for name, up in self.fields:
            if name not in df.columns:
                continue
            c = F.col(name)
            if df.schema[name].dataType.typeName() == "array":
                c = F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(c)
            out.append(c.asc_nulls_last() if up else c.desc_nulls_last())
        return out


def matches(conditions: dict) -> Column:
    """Lists mean any of, scalars equal; empty values are skipped; available_int keeps null and 1 unless 0 is asked."""
    kept = F.lit(True)
    for name, value in conditions.items():
        if name == "available_int":
            below = F.coalesce(F.col(name), F.lit(1)) < 1
            kept = kept & (below if value == 0 else ~below)
        elif not value:
            continue
        elif isinstance(value, list | tuple):
            kept = kept & F.col(name).isin(list(value))
        elif isinstance(value, str | int):
            kept = kept & (F.col(name) == value)
        else:
            raise ValueError(f"a condition on {name} must be a list, a string or a whole number")
    return kept


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def terms(df: DataFrame, name: str) -> DataFrame:
    """Buckets of a field; several values count each."""
    value = F.explode(name) if df.schema[name].dataType.typeName() == "array" else F.col(name)
    return df.select(value.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("doc_count"))


def highlight(text: Column, words: list[str]) -> Column:
    """Sentences with one of the words, each word wrapped in <em>, joined by dots; null if none has one."""
    escaped = "|".join(sorted(map(_quoted, words), key=lambda w: (-len(w), w)))
    sentences = F.split(text, r"[.?!;\n]")
    pattern = rf"(?i)(^|[ .?/'\"\(\)!,:;-])({escaped})(?=$|[ .?/'\"\(\)!,:;-])"
    marked = F.transform(sentences, lambda s: F.regexp_replace(s, pattern, "$1<em>$2</em>"))
    hits = F.filter(marked, lambda s: F.contains(s, F.lit("<em>")))
    return F.when(F.size(hits) > 0, F.array_join(hits, "..."))


def _quoted(word: str) -> str:
    return "".join(f"\\{c}" if c in r".^$*+?{}[]\|()-" else c for c in word)


def token_bag(content: Column, title: Column, important: Column, question: Column) -> Column:
    """Content tokens once, title tokens twice, important words five times, question tokens six times."""
    times = lambda tokens, n: F.flatten(F.array_repeat(tokens, n))
    return F.concat(content, times(title, 2), times(important, 5), times(question, 6))


def tag_likeness(query_tags: DataFrame, doc_tags: DataFrame, query_key: str, key: str, page_rank: Column | None = None) -> DataFrame:
    """query_key, key, rank_feature: ten times the cosine of tag weights, plus the document's page rank.

    Both inputs are rows of (key, tag, weight); only documents that share a tag with the query come out.
    """
    length = lambda df, k, name: df.groupBy(k).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(name))
    shared = query_tags.withColumnRenamed("weight", "qw").join(doc_tags, "tag").groupBy(query_key, key).agg(F.sum(F.col("qw") * F.col("weight")).alias("_dot"))
    both = shared.join(length(query_tags, query_key, "_ql"), query_key).join(length(doc_tags, key, "_dl"), key)
    score = 10.0 * F.col("_dot") / F.greatest(F.col("_ql") * F.col("_dl"), F.lit(1e-12))
    return both.select(query_key, key, (score + (page_rank if page_rank is not None else F.lit(0.0))).alias("rank_feature"))


def tag_prior(tags: DataFrame, smooth: int = 1000) -> DataFrame:
    """tag, count, prior: the smoothed share of each tag. tags: a row for each use."""
    counts = tags.groupBy("tag").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("tag", "n", ((F.col("n") + 1) / (F.col("_all") + smooth).cast("double")).alias("prior"))


def top_tags(uses: DataFrame, prior: DataFrame, group: str, k: int = 3, smooth: int = 1000) -> DataFrame:
    """group, tag, weight: the tags that a group uses most beyond their prior. uses: (group, tag) rows."""
    counts = uses.groupBy(group, "tag").agg(F.count("*").alias("c"))
    size = counts.groupBy(group).agg(F.sum("c").alias("cnt"))
    scored = counts.join(size, group).join(prior.select("tag", "prior"), "tag")
    weight = F.bround(0.1 * (F.col("c") + 1) / (F.col("cnt") + smooth).cast("double") / F.greatest("prior", F.lit(1e-6)), 0).cast("int")
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("weight"), "tag"))
    return scored.withColumn("weight", weight).withColumn("_r", rank).where(F.col("_r") <= k).select(group, "tag", "weight")


def document_counts(hits: DataFrame, query_key: str, name: str) -> DataFrame:
    """How many of a query's hits each document has."""
    return hits.groupBy(query_key, name).agg(F.count("*").alias("count"))


def relaxed(first: DataFrame, second: DataFrame, query_key: str) -> DataFrame:
    """The first search's rows, and the second's for queries that the first left without any."""
    return first.unionByName(second.join(first.select(query_key).distinct(), query_key, "left_anti"))


def late_interaction(query: Column, doc: Column) -> Column:
    """Sum over the query's vectors of the best inner product with one of the document's."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)
