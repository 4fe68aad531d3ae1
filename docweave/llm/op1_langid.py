"""Language identification by error-correcting output codes.

Every language gets a codeword. One binary classifier per code bit, logistic over hashed byte
n-grams of the lower-cased text, predicts that bit; decoding takes the codeword with the least
loss-weighted disagreement, where each bit weighs as much as its classifier was right on held-back
rows, and flags the text as ambiguous if the runner-up is close. Up to seven languages use the
exhaustive code (every way to split them in two); more use seeded random codewords with the
largest least distance.

Only text and lang of rows outside the held-out part (crc32 of the id modulo 4 is 2) are learned
from. Defined results: null text and text without a letter (Unicode category L) give `und` with score 0; with no
language to learn, as with an empty table, every row is `und`; a null doc_id gives a row with held_out false; repeated
rows each give a row; of codewords at equal loss the first language by name wins, flagged as ambiguous. Long texts are
hashed in blocks (see bit_margins). Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import ngrams
from docweave.llm.shared import crc_mod, in_slices, labelled_sample, small_batches

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, runner_up string"


@dataclass(frozen=True)
class LangSettings:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    sample_per_lang: int = 400
    sample_rows: int = 2400
    sample_chars: int = 12_000_000
    epochs: int = 5
    ambiguous_below: float = 0.2
    seed: int = 11


def code_matrix(n: int, seed: int) -> np.ndarray:
    """n codewords of +1 and -1, one row a language."""
    if n == 1:
        return np.ones((1, 1), np.float32)
    if n <= 7:
        splits = [[1] + [1 if i >> j & 1 else -1 for j in range(n - 1)] for i in range((1 << (n - 1)) - 1)]
        return np.array(splits, np.float32).T
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1.0
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.float32), (n, width))
        if (np.abs(m.sum(0)) == n).any():
            continue
        d = (width - m @ m.T) / 2
        least = d[np.triu_indices(n, 1)].min()
        if least > apart:
            best, apart = m, least
    return best


@dataclass
class LangModel:
    langs: list[str]
    code: np.ndarray
    bit_weight: np.ndarray
    weights: np.ndarray
    bits: int
    orders: tuple[int, ...]


def has_letter(text: str) -> bool:
    """Any character of Unicode category L; numbers such as fractions and Roman numerals are none."""
    return any(map(str.isalpha, text))


def slots_of(text: str, orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    data = text.lower().encode("utf-8", "surrogatepass")
    grams = ((k, ngrams.byte_ngrams(data, n)) for k, n in enumerate(orders))
    return [ngrams.fold(g, k, bits) for k, g in grams if len(g)]


def bit_margins(weights: np.ndarray, text: str, orders: tuple[int, ...], bits: int, block: int = 1 << 15) -> np.ndarray:
    """A margin for each code bit: the mean weights of the text's n-grams, order by order. Its n-grams are hashed and summed in blocks, so memory beyond the text's own bytes doesn't follow its length."""
    data = text.lower().encode("utf-8", "surrogatepass")
    z = weights[-1].astype(np.float64)
    for k, n in enumerate(orders):
        count = len(data) - n + 1
        if count > 0:
            grams = (ngrams.byte_ngrams(data[i : i + block + n - 1], n) for i in range(0, count, block))
            z = z + sum(weights[ngrams.fold(g, k, bits)].sum(0, dtype=np.float64) for g in grams) / count
    return z


def fit(docs: DataFrame, settings: LangSettings) -> LangModel | None:
    s = settings
    seen = docs.where(crc_mod(F.col("doc_id"), 4) != 2)
    sample = labelled_sample(seen, "lang", s.sample_per_lang, s.sample_rows, s.sample_chars)
    sample = [(t, k) for t, k in sample if has_letter(t)]
    langs = sorted({k for _, k in sample})
    if not langs:
        return None
    code = code_matrix(len(langs), s.seed)
    place = {k: i for i, k in enumerate(langs)}
    rows = []
    for text, k in sample:
        slots = slots_of(text, s.orders, s.bits)
        idx = np.concatenate(slots)
        share = np.concatenate([np.full(len(x), 1.0 / len(x), np.float32) for x in slots])
        u, at = np.unique(idx, return_inverse=True)
        rows.append((u, np.bincount(at, share, len(u)).astype(np.float32), place[k]))
    w = np.zeros(((1 << s.bits) + 1, code.shape[1]), np.float32)
    g2 = np.full_like(w, 1e-8)
    back = [r for i, r in enumerate(rows) if i % 6 == 5]
    train = [r for i, r in enumerate(rows) if i % 6 != 5]
    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in rng.permutation(len(train)):
            u, x, k = train[i]
            y = code[k]
            d = -y / (1 + np.exp(np.clip(y * (x @ w[u] + w[-1]), -40, 40)))
            g = x[:, None] * d
            g2[u] += g * g
            w[u] -= 0.2 * g / np.sqrt(g2[u])
            g2[-1] += d * d
            w[-1] -= 0.02 * d / np.sqrt(g2[-1])
    right = np.full(code.shape[1], 0.9)
    if back:
        right = np.mean([np.sign(x @ w[u] + w[-1]) == code[k] for u, x, k in back], axis=0)
    edge = np.clip(2 * right - 1, 0.02, 1)
    return LangModel(langs, code, edge / edge.sum(), w, s.bits, s.orders)


def decode(model: LangModel, z: np.ndarray) -> tuple[int, int, float, float]:
    """Best and second codeword, the confidence of the best, and the gap between their losses."""
    loss = np.log1p(np.exp(-np.clip(model.code * z, -30, 30))) @ model.bit_weight
    order = np.argsort(loss, kind="stable")
    p = np.exp(-4 * (loss - loss[order[0]]))
    second = order[1] if len(order) > 1 else order[0]
    return int(order[0]), int(second), float(1 / p.sum()), float(loss[second] - loss[order[0]])


def identify(docs: DataFrame, settings: LangSettings = LangSettings()) -> DataFrame:
    """One row per document: the predicted language, how sure, and whether the runner-up is close."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, settings))  # 2**bits x code bits floats

    def one(text: str | None) -> tuple[str, float, bool, str | None]:
        m = model.value
        if m is None or not text or not has_letter(text):
            return "und", 0.0, True, None
        best, second, score, gap = decode(m, bit_margins(m.weights, text, m.orders, m.bits))
        return m.langs[best], score, best != second and gap < settings.ambiguous_below, m.langs[second] if second != best else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in in_slices(batches):
            pred, sure, unclear, other = zip(*map(one, batch.column(2).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(pred, pa.string()), pa.array(sure, pa.float64()), pa.array(unclear, pa.bool_()), pa.array(other, pa.string())],
                names,
            )

    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(score, SCHEMA)
