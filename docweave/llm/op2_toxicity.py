"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

The network (see gru.py) scores every overlapping window of 16 words, one word apart; a document scores as its worst
window. Labels are of documents, so training alternates: the current network picks each toxic text's worst window as a
positive and the worst and a random window of each clean text as negatives, then takes gradient steps on them. Scores
are calibrated (Platt) on texts held back from the steps, weighted to the share of toxic rows among the labels.

Labels of rows whose crc32 of the id modulo 3 is 1 are never learned from. Defined results: null text and text without
words score 0; with fewer than two labels to learn from, as with an empty table, every score is 0; a null doc_id gives a
row with held_out false; repeated rows each give a row with the same score; of equal windows the first is the worst.
Segments go through the network in blocks, so the network's memory doesn't follow a text's length; the text's own words do,
at some 30 bytes a word. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import ngrams
from docweave.llm.gru import Adam, GruShape, Net, Vocabulary, around, log_odds, pooled, segments, split_words
from docweave.llm.op4_quality import calibrate
from docweave.llm.shared import crc_mod, in_slices, labelled_sample, small_batches

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, worst_start long, n_windows long"


@dataclass(frozen=True)
class ToxicSettings:
    shape: GruShape = field(default_factory=GruShape)
    threshold: float = 0.7
    sample_per_class: int = 1200
    sample_rows: int = 2400
    sample_chars: int = 9_000_000
    rounds: int = 5
    batch: int = 64
    segments_at_once: int = 1024
    seed: int = 4


@dataclass
class ToxicModel:
    net: Net
    slope: float
    offset: float


def score_windows(net: Net, gates: dict[str, np.ndarray], texts: list[np.ndarray], at_once: int) -> list[np.ndarray]:
    """Logits of all windows of each text of word numbers."""
    shape, pad = net.shape, len(gates["f"]) - 1
    grids = [segments(t, pad, shape) for t in texts]
    sizes = [len(g) for g in grids]
    if not sum(sizes):
        return [np.empty(0, np.float64) for _ in texts]
    rows = np.concatenate(grids)
    found = [net.word_scores(gates, rows[i : i + at_once], pad) for i in range(0, len(rows), at_once)]
    scores, values = (np.concatenate([f[j] for f in found]) for j in range(2))
    ends = np.cumsum(sizes)
    out = []
    for t, n, end in zip(texts, sizes, ends, strict=True):
        of = slice(end - n, end)
        out.append(pooled(scores[of].ravel()[: len(t)], values[of].ravel()[: len(t)], shape.window) if n else np.empty(0, np.float64))
    return out


def numbered(texts: list[str | None], bits: int) -> tuple[list[np.ndarray], Vocabulary]:
    """Word numbers of each text, and the vocabulary of all of them."""
    words = [split_words(t) for t in texts]
    ids, distinct = ngrams.number_words([w for ws in words for w in ws])
    return np.split(ids, np.cumsum([len(ws) for ws in words])[:-1]), Vocabulary(distinct, bits)


def train(sample: list[tuple[str, int]], s: ToxicSettings, toxic_share: float) -> ToxicModel:
    """toxic_share: of the rows that the sample was drawn from, by class."""
    y = np.array([k for _, k in sample])
    texts, vocab = numbered([t for t, _ in sample], s.shape.bits)
    net = Net(s.shape, s.seed)
    back = np.arange(len(sample)) % 5 == 4
    fitted = np.flatnonzero(~back)
    grams_of = np.split(vocab.gram, np.cumsum(vocab.counts)[:-1]) if len(vocab.counts) else []
    size = 1 << s.shape.bits
    net.words[:, 0] = 0.5 * log_odds([vocab.word[texts[i]] for i in fitted], y[fitted], size)
    char_slots = [np.concatenate([grams_of[w] for w in np.unique(texts[i])]) if len(texts[i]) else np.empty(0, np.uint32) for i in fitted]
    net.chars[:, 0] = 0.5 * log_odds(char_slots, y[fitted], size)
    del char_slots
    rng = np.random.default_rng(s.seed)
    adam, g2w, g2c = Adam(0.01), np.full_like(net.words, 1e-3), np.full_like(net.chars, 1e-3)
    use = [i for i in fitted if len(texts[i])]
    for turn in range(s.rounds):
        vectors = vocab.vectors(net.words, net.chars)
        if turn:
            scored = score_windows(net, net.gates(vectors), [texts[i] for i in use], s.segments_at_once)
        else:  # by the log-odds alone: the mean of each window's words
            plain = vectors[:, 0] + vectors[:, s.shape.word_dim]
            scored = [pooled(2 * plain[texts[i]], plain[texts[i]], s.shape.window) for i in use]
        picked = []
        for i, z in zip(use, scored, strict=True):
            picked += [(i, int(c)) for c in ([z.argmax()] if y[i] else [z.argmax(), rng.integers(len(z))])]
        pad = len(vectors)
        for _ in range(2):
            order = rng.permutation(len(picked))
            for at in range(0, len(order), s.batch):
                some = [picked[j] for j in order[at : at + s.batch]]
                ids = np.stack([around(texts[i], b, pad, s.shape) for i, b in some])
                label = np.array([y[i] for i, _ in some], np.float32)
                mask = (ids != pad).astype(np.float32)
                inside = mask.copy()
                inside[:, : s.shape.warm] = inside[:, -s.shape.warm :] = 0
                own, place = np.unique(ids, return_inverse=True)
                own = own[own != pad]
                part = vocab_part(vocab, grams_of, own)
                x = np.concatenate([part.vectors(net.words, net.chars), np.zeros((1, s.shape.word_dim + s.shape.char_dim), np.float32)])
                place = np.minimum(place.reshape(ids.shape), len(own))
                g, dx, _ = net.gradients(x[place], mask, inside, label, np.where(label > 0, 1.0, 0.7).astype(np.float32))
                adam.step(net.p, g)
                dword = np.zeros_like(x)
                np.add.at(dword, place, dx)
                dword = dword[:-1]
                step_table(net.words, g2w, part.word, dword[:, : s.shape.word_dim])
                if len(part.gram):
                    step_table(net.chars, g2c, part.gram, (dword[:, s.shape.word_dim :] * part.scale[:, None])[part.gram_word])
    vectors = vocab.vectors(net.words, net.chars)
    held = [i for i in np.flatnonzero(back) if len(texts[i])]
    top = np.array([z.max() for z in score_windows(net, net.gates(vectors), [texts[i] for i in held], s.segments_at_once)])
    toxic = y[held].sum()
    weight = (1 - toxic_share) / toxic_share * toxic / max(len(held) - toxic, 1)  # of a clean text, so that the held-back ones stand for all
    slope, offset = calibrate(top.astype(np.float64), y[held], weight) if held else (1.0, 0.0)
    return ToxicModel(net, slope, offset)


class vocab_part:
    """Some words of a vocabulary, numbered anew."""

    def __init__(self, vocab: Vocabulary, grams_of: list[np.ndarray], own: np.ndarray):
        self.word = vocab.word[own]
        self.counts = vocab.counts[own]
        self.scale = vocab.scale[own]
        self.gram = np.concatenate([grams_of[w] for w in own]) if len(own) else np.empty(0, np.uint32)
        self.gram_word = np.repeat(np.arange(len(own)), self.counts)

    vectors = Vocabulary.vectors


def step_table(values: np.ndarray, g2: np.ndarray, slots: np.ndarray, grads: np.ndarray, rate: float = 0.05) -> None:
    own, at = np.unique(slots, return_inverse=True)
    g = np.zeros((len(own), values.shape[1]), np.float32)
    np.add.at(g, at, grads)
    g2[own] += g * g
    values[own] -= rate * g / np.sqrt(g2[own])


def fit(docs: DataFrame, labels: DataFrame, s: ToxicSettings) -> ToxicModel | None:
    seen = labels.where((crc_mod(F.col("doc_id"), 3) != 1) & F.col("toxic").isin(0, 1))
    sample = labelled_sample(docs, "toxic", s.sample_per_class, s.sample_rows, s.sample_chars, seen)
    share = seen.agg(F.avg("toxic")).first()[0]
    return train(sample, s, share) if len({k for _, k in sample}) == 2 else None


def toxicity(docs: DataFrame, labels: DataFrame, s: ToxicSettings = ToxicSettings()) -> DataFrame:
    """One row per document: its score, the verdict at the threshold, and where its worst window starts."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, s))  # two tables of 2**bits small rows: 3 MB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        m = model.value
        for batch in in_slices(batches, 512, 1 << 20):
            n = batch.num_rows
            score, worst, count = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            if m is not None:
                texts, vocab = numbered(batch.column(2).to_pylist(), m.net.shape.bits)
                gates = m.net.gates(vocab.vectors(m.net.words, m.net.chars))
                for i, z in enumerate(score_windows(m.net, gates, texts, s.segments_at_once)):
                    if len(z):
                        score[i] = ngrams.sigmoid(m.slope * np.float64(z.max()) + m.offset)
                        worst[i], count[i] = int(z.argmax()), len(z)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(score), pa.array((score >= s.threshold).astype(np.int32)), pa.array(worst), pa.array(count)], names
            )

    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(work, SCHEMA)
