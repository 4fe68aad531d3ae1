"""Exact inner-product search of many queries at once.

Each Arrow batch of vectors meets a block of queries as one matrix product and gives up only its best k for
each query, so what is shuffled is k rows a batch and query. Queries go out in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docweave.sources.workspace import written

#: Most bytes of query vectors that one broadcast holds.
QUERY_BLOCK_BYTES = 64 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _blocks(queries: DataFrame, query_key: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    ids, rows, held = [], [], 0
    for r in queries.select(query_key, vector).toLocalIterator():
        v = np.asarray(r[1], np.float64)
        ids.append(r[0])
        rows.append(v)
        held += v.nbytes
        if held >= QUERY_BLOCK_BYTES:
            yield ids, np.stack(rows)
            ids, rows, held = [], [], 0
    if ids:
        yield ids, np.stack(rows)


def top_k(base: DataFrame, key: str, queries: DataFrame, query_key: str, k: int, vector: str = "vector", digits: int = 6, least: float | None = None, cosine: bool = False) -> DataFrame:
    """query_key, key, score, rank: the best k of each query, by score to `digits` places, then by key.

    least: only scores above it; cosine: both sides scaled to length 1 first.
    """
    kinds = {c: queries.schema[c].dataType.simpleString() for c in (query_key,)} | {key: base.schema[key].dataType.simpleString()}
    schema = f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, score double"
    spark = base.sparkSession
    query_type = to_arrow_type(queries.schema[query_key].dataType)

    def scaled(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12) if cosine else m

    def search(ids: list, grid: np.ndarray) -> DataFrame:
        held = spark.sparkContext.broadcast((ids, scaled(grid)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    own = np.array(part.column(0).to_pylist(), dtype=object)
                    score = np.round(scaled(_matrix(part.column(1))) @ q.T, digits) + 0.0
                    order = np.argsort(own, kind="stable")
                    own, score = own[order], score[order]
                    best = np.argsort(-score, axis=0, kind="stable")[:k]
                    which = np.repeat(np.arange(len(names))[None, :], len(best), 0)
                    s, keep = score[best, which], slice(None)
                    if least is not None:
                        keep = s > least
                    rows, cols = best[keep].ravel(), which[keep].ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([names[c] for c in cols], query_type), pa.array(own[rows].tolist(), part.column(0).type), pa.array(s[keep].ravel())], [query_key, key, "score"])

        return base.select(key, vector).mapInArrow(work, schema)

    blocks = _blocks(queries, query_key, vector)
    parts = [search(*b) for b in islice(blocks, 1)]
    more = next(blocks, None)
    if more is not None:  # several blocks read the base again and again, so its vectors are made once
        base = written(base.select(key, vector), "base-vectors")
        parts = [search(ids, grid) for ids, grid in _blocks(queries, query_key, vector)]
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key)))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(F.col("rank") <= k)
