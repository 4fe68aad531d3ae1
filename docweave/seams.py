"""Interfaces to models and services that live outside Spark, with stand-ins that always answer alike."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Chat(Protocol):
    def answer(self, messages: list[dict[str, str]], temperature: float = 0.0) -> str: ...


class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


class Detector(Protocol):
    def boxes(self, image: bytes) -> list[dict]: ...


@dataclass
class StubEmbedder:
    dim: int = 16

    def embed(self, texts: list[str]) -> np.ndarray:
        grid = np.stack([np.frombuffer(hashlib.sha512(t.encode()).digest()[: self.dim], np.uint8).astype(float) - 127.5 for t in texts])
        return grid / np.maximum(np.linalg.norm(grid, axis=1, keepdims=True), 1e-12)


@dataclass
class StubChat:
    """Says what it was set up to say, else repeats the last message."""

    said: str | None = None

    def answer(self, messages: list[dict[str, str]], temperature: float = 0.0) -> str:
        return self.said if self.said is not None else messages[-1]["content"]


@dataclass
class StubReranker:
    def scores(self, query: str, texts: list[str]) -> list[float]:
        asked = set(query.lower().split())
        return [len(asked & set(t.lower().split())) / max(len(asked), 1) for t in texts]


@dataclass
class Retrying:
    """Calls again after a growing pause when a call fails."""

    call: Callable
    tries: int = 3
    pause: float = 0.0

    def __call__(self, *args, **kwargs):
        for i in range(self.tries):
            try:
                return self.call(*args, **kwargs)
            except Exception:
                if i + 1 == self.tries:
                    raise
                time.sleep(self.pause * (i + 1))


def embed_texts(docs: DataFrame, key: str, text: str, make: Callable[[], Embedder], batch: int = 64) -> DataFrame:
    """key, vector by a model that each Python worker makes once."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                grid = np.asarray(model.embed([t or "" for t in part.column(1).to_pylist()]), np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(grid), pa.list_(pa.float64()))], [key, "vector"])

    return docs.select(key, text).mapInArrow(work, f"{key} {kind}, vector array<double>")


def rerank(hits: DataFrame, query_key: str, key: str, make: Callable[[], Reranker]) -> DataFrame:
    """query_key, key, model_score; scores stay with their texts by key. hits: query_key, key, query_text, text."""
    kinds = [hits.schema[c].dataType.simpleString() for c in (query_key, key)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            q, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
            scores = [0.0] * len(q)
            for asked in dict.fromkeys(q):
                at = [i for i, x in enumerate(q) if x == asked]
                for i, s in zip(at, model.scores(asked, [texts[i] for i in at]), strict=True):
                    scores[i] = float(s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], [query_key, key, "model_score"])

    return hits.select(query_key, key, "query_text", "text").mapInArrow(work, f"{query_key} {kinds[0]}, {key} {kinds[1]}, model_score double")


def detect(images: DataFrame, key: str, content: str, make: Callable[[], Detector], schema: str) -> DataFrame:
    """key and the fields of schema, a row for each box that the model finds."""
    kind = images.schema[key].dataType.simpleString()
    names = [f.strip().split()[0] for f in schema.split(",")]

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        model = make()
        for pdf in frames:
            rows = [{key: k, **{n: box.get(n) for n in names}} for k, c in zip(pdf[key], pdf[content], strict=True) for box in model.boxes(bytes(c))]
            yield pd.DataFrame(rows, columns=[key, *names])

    return images.select(key, content).mapInPandas(work, f"{key} {kind}, {schema}")
