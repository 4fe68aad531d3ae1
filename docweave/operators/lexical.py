"""BM25 over chunk records: postings, statistics and batch search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docweave.functions import scores as S
from docweave.functions import text as T
from docweave.sources.workspace import written

#: Most (query, term) rows that are held by every worker; beyond it terms join by shuffle.
BROADCAST_TERMS = 200_000
#: Most scores that a worker holds at once.
GRID = 1 << 22


def tokenized(records: DataFrame, key: str, text: str = "text", segments: str | None = None) -> DataFrame:
    """key, tokens, length; segments: a column with the words that a segmenter found."""
    tokens = T.lexical_tokens(F.col(text), None if segments is None else F.col(segments))
    return records.select(key, tokens.alias("tokens")).withColumn("length", F.size("tokens"))


def postings(tokens: DataFrame, key: str) -> DataFrame:
    return tokens.select(key, "length", F.explode("tokens").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def term_stats(posting: DataFrame) -> DataFrame:
    return posting.groupBy("term").agg(F.count("*").alias("df"))


def _ranked(scored: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key)))
    return scored.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)


def joined_search(tokens: DataFrame, key: str, asked: DataFrame, query_key: str, k: int, k1: float, b: float, digits: int) -> DataFrame:
    """The search as joins, for more query terms than a worker can hold. tokens: key, tokens, length; asked: query_key, term, qtf."""
    hit = tokens.select(key, "length", F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    posting = hit.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    total = tokens.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    weighed = asked.join(term_stats(posting), "term").crossJoin(F.broadcast(total))  # one row of totals
    weighed = weighed.withColumn("idf", S.inverse_frequency(F.col("n"), F.col("df")))
    scored = posting.join(weighed, "term").groupBy(query_key, key).agg(F.round(F.sum(S.bm25(F.col("tf"), F.col("qtf"), F.col("idf"), F.col("length"), F.col("mean_length"), k1, b)), digits).alias("score"))
    return _ranked(scored, query_key, key, k)


def _counted(tokens: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """key, length, and which of the terms a record has how often. No shuffle: a record is counted where it is read."""
    place = tokens.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.value
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().dictionary_encode()
            number = np.array([known.get(w, -1) for w in flat.dictionary.to_pylist()], np.int64)
            found = number[flat.indices.to_numpy()] if len(flat) else np.empty(0, np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)[found >= 0]
            pair, tf = np.unique(row * len(known) + found[found >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(known)).astype(np.int32))
            numbers, counts = (pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair % len(known), tf))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), numbers, counts], [key, "length", "terms", "tfs"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(key, "tokens").mapInArrow(work, f"{key} {kind}, length int, terms array<int>, tfs array<int>")


def search(
    records: DataFrame, key: str, queries: DataFrame, query_key: str, k: int, k1: float = 1.5, b: float = 0.75, digits: int = 6, segments: str | None = None, query_segments: str | None = None
) -> DataFrame:
    """query_key, key, score, rank of each query's best k records.

    Records are tokenised once: what is written of them is how often they have the terms that some query asks for. Each batch
    of records then meets all queries and gives up its best k for each, so no pair of query and record is shuffled. segments
    and query_segments name columns with a segmenter's words.
    """
    tokens = tokenized(records, key, segments=segments)
    words = T.lexical_tokens(F.col("text"), None if query_segments is None else F.col(query_segments))
    asked = queries.select(query_key, F.explode(words).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    held = asked.limit(BROADCAST_TERMS + 1).collect()
    if len(held) > BROADCAST_TERMS:
        return joined_search(tokens, key, asked, query_key, k, k1, b, digits)
    kinds = {c: d.schema[c].dataType for c, d in ((query_key, queries), (key, records))}
    schema = f"{query_key} {kinds[query_key].simpleString()}, {key} {kinds[key].simpleString()}, score double"
    if not held:
        return _ranked(records.sparkSession.createDataFrame([], schema), query_key, key, k)
    terms = sorted({r["term"] for r in held})
    counted = written(_counted(tokens, key, terms), "term-counts")
    n, mean = counted.agg(F.count("*"), F.avg("length")).first()
    df = np.zeros(len(terms))
    for term, found in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a query term
        df[term] = found
    idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
    place, ids = {t: i for i, t in enumerate(terms)}, sorted({r[query_key] for r in held}, key=str)
    row_of = {q: i for i, q in enumerate(ids)}
    wanted = sorted((place[r["term"]], row_of[r[query_key]], r["qtf"]) for r in held)
    of_term, of_query, qtf = (np.array(x) for x in zip(*wanted, strict=True))
    model = records.sparkSession.sparkContext.broadcast((ids, idf, max(mean or 0.0, 1.0), of_query, qtf.astype(np.float64), np.searchsorted(of_term, np.arange(len(terms) + 1))))
    id_type = to_arrow_type(kinds[query_key])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, mean_length, queries_of, times, ends = model.value
        rows = max(1, GRID // len(names))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                sizes = np.diff(part.column(2).offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), sizes)
                term, tf = (part.column(i).flatten().to_numpy() for i in (2, 3))
                length = part.column(1).to_numpy()[doc]
                value = weight[term] * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / mean_length))
                order = np.argsort(term, kind="stable")
                doc, term, value = doc[order], term[order], value[order]
                score = np.zeros((len(names), part.num_rows))
                own, begin = np.unique(term, return_index=True)
                for t, low, high in zip(own, begin, np.append(begin, len(term))[1:], strict=True):
                    of = slice(ends[t], ends[t + 1])
                    score[queries_of[of, None], doc[None, low:high]] += times[of, None] * value[None, low:high]
                score = np.round(score, digits)
                keys = np.array(part.column(0).to_pylist(), dtype=object)
                by_key = np.argsort(keys, kind="stable")
                keys, score = keys[by_key], score[:, by_key]
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                top = np.take_along_axis(score, best, axis=1)
                query, rank = np.nonzero(top > 0)
                yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in query], id_type), pa.array(keys[best[query, rank]].tolist(), part.column(0).type), pa.array(top[query, rank])], [query_key, key, "score"])

    return _ranked(counted.mapInArrow(work, schema), query_key, key, k)
