"""Signed feature hashing of texts, in two forms that give the same numbers.

`hash_components` is relational (token rows, one aggregation) and suits queries over slots;
`hash_vectors` maps Arrow batches to dense vectors without a shuffle and is what search uses.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions import text as T

WORDS = re.compile(r"[A-Za-z0-9_]+|[一-鿿]")


def hash_components(rows: DataFrame, key: list[str], text: str = "text", dim: int = 384) -> DataFrame:
    """key, slot, value: the unit vector of each text; slots whose signs cancel stay out."""
    tokens = rows.select(*key, F.explode(T.hash_tokens(F.col(text))).alias("token"))
    sums = tokens.groupBy(*key, T.hash_slot(F.col("token"), dim).alias("slot")).agg(F.sum(T.hash_sign(F.col("token"))).cast("double").alias("v")).where("v <> 0")
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy(*key)))
    return sums.withColumn("value", F.col("v") / length).drop("v")


@lru_cache(maxsize=200_000)
def _place(token: str, dim: int) -> tuple[int, float]:
    d = hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(d[:4], "little") % dim, 1.0 if d[4] % 2 == 0 else -1.0


def embed(text: str, dim: int = 384) -> np.ndarray:
    v = np.zeros(dim)
    for token in WORDS.findall(text.lower()) or list(text):
        slot, sign = _place(token, dim)
        v[slot] += sign
    n = np.sqrt(v @ v)
    return v / n if n > 1e-12 else v


def embed_all(texts: list[str | None], dim: int = 384) -> np.ndarray:
    """The unit vectors of several texts; each distinct token is hashed once."""
    low = [(t or "").lower() for t in texts]
    found = [WORDS.findall(x) or list(t or "") for x, t in zip(low, texts, strict=True)]
    number: defaultdict[str, int] = defaultdict(count().__next__)
    flat = np.fromiter((number[w] for words in found for w in words), np.int64)
    grid = np.zeros((len(texts), dim))
    if len(flat):
        slot, sign = (np.array(x) for x in zip(*(_place(w, dim) for w in number), strict=True))
        row = np.repeat(np.arange(len(texts)), [len(words) for words in found])
        grid = np.bincount(row * dim + slot[flat], sign[flat], len(texts) * dim).reshape(len(texts), dim)
    length = np.sqrt((grid * grid).sum(1, keepdims=True))
    return np.divide(grid, length, out=grid, where=length > 1e-12)


def hash_vectors(rows: DataFrame, key: str, text: str = "text", dim: int = 384) -> DataFrame:
    """key, vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                grid = embed_all(part.column(1).to_pylist(), dim)
                offsets = pa.array(np.arange(0, (len(grid) + 1) * dim, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(grid.ravel()))], [key, "vector"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(work, f"{key} {kind}, vector array<double>")
