"""Quality rules: hashed word and character n-gram logistic regression, calibrated, against fixed thresholds.

Two layers decide. The base rules are exact counts over the whole text (too few words, too much of
the text inside repeated three-word windows). The model is a logistic regression over hashed word
unigrams and bigrams and byte trigrams, fitted in numpy on a bounded sample of labelled rows and
calibrated (Platt) on rows held back from the fit; a row is kept if no base rule fails and its
calibrated probability of good quality reaches `keep_at`.

Defined results: null or empty text has no words, so it fails the base rules; a null doc_id gives a
row with a null doc_id; repeated rows each give a row; with no labelled rows (or one class of them only) the model is constant
and the base rules decide alone; an empty table gives no rows. A probability equal to the threshold keeps. Texts are measured one at a
time, in arrays of some forty bytes a byte of text. Other columns of the input are ignored by `quality_rules` and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import ngrams
from docweave.llm.shared import in_slices, labelled_sample, release_memory, small_batches

#: Characters that count as symbols, and ASCII white space.
SYMBOLS = b"#*$%&|<>"
SPACE = b"\t\n\x0b\x0c\r "

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, probability double, kept boolean"
)


@dataclass(frozen=True)
class QualitySettings:
    """Fixed thresholds and the bounds of the fit."""

    min_words: int = 50
    most_repeat_percent: int = 50
    keep_at: float = 0.5
    bits: int = 18
    sample_per_class: int = 1500
    sample_rows: int = 3000
    sample_chars: int = 16_000_000
    epochs: int = 6


@dataclass
class QualityModel:
    """Weights over hashed slots, and the calibration that maps a margin to a probability."""

    weights: np.ndarray
    slope: float
    offset: float
    bits: int

    def probability(self, margin: float) -> float:
        return float(ngrams.sigmoid(np.float64(self.slope * margin + self.offset)))


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words that lie in a three-word window found twice or more; exact, as windows are compared by word numbers."""
    if len(ids) < 3:
        return 0
    if n_distinct < 1 << 21:
        window = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, pair = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)
        window = pair[:-1] * np.int64(n_distinct) + ids[2:]
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : len(ids) - 2 + i] |= twice
    return int(covered.sum())


def families(data: bytes, ids: np.ndarray, distinct: list[bytes], bits: int) -> list[np.ndarray]:
    """Slots of the three n-gram families of a text."""
    h = ngrams.word_hashes(distinct)[ids] if len(ids) else np.empty(0, np.uint32)
    grams = (h, ngrams.word_bigrams(h), ngrams.byte_ngrams(data, 3))
    return [ngrams.fold(g, k, bits) for k, g in enumerate(grams) if len(g)]


def margin(weights: np.ndarray, slots: list[np.ndarray]) -> float:
    return float(weights[-1] + sum(weights[s].mean(dtype=np.float64) for s in slots))


def fit_margin(rows: list[tuple[list[np.ndarray], int]], bits: int, epochs: int) -> np.ndarray:
    """AdaGrad on the log loss; a text's features are the shares of its n-grams in each family."""
    size = (1 << bits) + 1
    w, g2 = np.zeros(size, np.float32), np.full(size, 1e-8, np.float32)
    packed = []
    for slots, y in rows:
        idx = np.concatenate(slots) if slots else np.empty(0, np.uint32)
        share = np.concatenate([np.full(len(s), 1.0 / len(s), np.float32) for s in slots]) if slots else np.empty(0, np.float32)
        u, at = np.unique(idx, return_inverse=True)
        packed.append((u, np.bincount(at, share, len(u)).astype(np.float32), y))
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(packed)):
            u, x, y = packed[i]
            p = ngrams.sigmoid(np.float64(w[-1] + w[u] @ x))
            d = np.float32(p - y)
            g = d * x
            g2[u] += g * g
            w[u] -= 0.3 * g / np.sqrt(g2[u])
            g2[-1] += d * d
            w[-1] -= 0.1 * d / np.sqrt(g2[-1])
    return w


def calibrate(margins: np.ndarray, y: np.ndarray, weight_of_0: float = 1.0) -> tuple[float, float]:
    """Platt scaling: slope and offset of the margin, by damped Newton steps on smoothed targets and standardised margins."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    mean, spread = margins.mean(), max(margins.std(), 1e-9)
    x, t = (margins - mean) / spread, np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.where(y == 1, 1.0, weight_of_0)

    def loss(c: np.ndarray) -> float:
        z = np.clip(c[0] * x + c[1], -500, 500)
        return float((w * (np.logaddexp(0, z) - t * z)).sum() + 0.01 * c[0] ** 2)

    c = np.array([1.0, 0.0])
    for _ in range(100):
        p = ngrams.sigmoid(c[0] * x + c[1])
        v = w * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(w * (p - t) * x).sum() + 0.02 * c[0], (w * (p - t)).sum()])
        h = np.array([[(v * x * x).sum() + 0.02, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(c - size * step) > loss(c):
            size /= 2
        c = c - size * step
        if size <= 1e-6 or np.abs(size * step).max() < 1e-7:
            break
    if c[0] <= 0:
        return 1.0, 0.0
    return float(c[0] / spread), float(c[1] - c[0] * mean / spread)


def fit(docs: DataFrame, labels: DataFrame, settings: QualitySettings) -> QualityModel:
    """Learn from labelled rows; every fifth is held back for the calibration."""
    s = settings
    sample = labelled_sample(docs, "quality", s.sample_per_class, s.sample_rows, s.sample_chars, labels)
    if len({y for _, y in sample}) < 2:
        return QualityModel(np.zeros((1 << s.bits) + 1, np.float32), 1.0, 20.0, s.bits)
    rows = []
    for text, y in sample:
        data = text.encode("utf-8", "surrogatepass")
        rows.append((families(data, *ngrams.number_words(data.split()), s.bits), int(y == 1)))
    back = [r for i, r in enumerate(rows) if i % 5 == 4]
    w = fit_margin([r for i, r in enumerate(rows) if i % 5 != 4], s.bits, s.epochs)
    slope, offset = calibrate(np.array([margin(w, f) for f, _ in back]), np.array([y for _, y in back]))
    del sample, rows, back
    release_memory()
    return QualityModel(w, slope, offset, s.bits)


def measure(text: str | None, model: QualityModel, settings: QualitySettings) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    ids, distinct = ngrams.number_words(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat = repeated_words(ids, len(distinct))
    n = len(words)
    failed = n < settings.min_words or 100 * repeat > settings.most_repeat_percent * n
    p = model.probability(margin(model.weights, families(data, ids, distinct, model.bits)))
    space = len(data) - len(data.translate(None, SPACE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return n, len(text or "") - space, symbols, len(lines) - len(set(lines)), repeat, failed, p, not failed and p >= settings.keep_at


def quality_rules(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """One row per document: the base counts, the calibrated probability and the verdict."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, settings))  # 2**bits floats: 1 MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in in_slices(batches):
            rows = [measure(t, model.value, settings) for t in batch.column(1).to_pylist()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], names)

    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """The documents that are kept, with the input's columns. Each row is judged where it is read; nothing is joined."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, settings))

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        return pa.array([measure(t.as_py(), model.value, settings)[-1] for t in text], pa.bool_())

    return docs.where(good("text"))
