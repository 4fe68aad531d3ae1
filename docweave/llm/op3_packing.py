"""Harmonic packing of token pieces into sequences of a fixed capacity.

A length in (C/(k+1), C/k] is of class k, and a sequence of class k takes exactly k pieces, so a
sequence's content follows from piece counts alone and no worker needs another's bins. Documents
may be cut: full sequences come off first, then a rest that would waste more than `tolerance`
tokens of its share C/k gives up a piece of floor(C/(k+1)) tokens, which fits class k+1 exactly,
until what is left fits its class (a few cuts at most, as the rest shrinks each time).

Workers number the pieces of each class on their own; one count per worker and class (added up in
front of it) turns those numbers into numbers of the whole table. Only the last sequence of each
class is not full. What those hold, fewer than k pieces for each class whatever the input's size, is
packed once more, first fit by decreasing length.

Tokens: a text's ids followed by the separator id. White space never reaches a token of this
vocabulary, so texts are tokenised by their white-space-separated parts, each distinct part once
per worker while a bounded cache holds it; ids equal those of the whole text. The vocabulary never joins
letters with marks either, so of a new part that is a run of Latin letters between marks only the runs
not yet known are tokenised, whatever marks and capitals they came with before.

Defined results: null and empty text are one separator token; a null doc_id gives pieces with a
null doc_id; repeated rows each give their own pieces; pieces of equal length and class keep the workers' order, which a written
table fixes; an empty table gives no rows. A very long text is cut like any, its ids held at once (4 bytes a token). Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.llm.shared import discarding, in_slices, materialize, small_batches

#: What the vocabulary does to a text before it looks for tokens.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: In lines of one word: letters whose small forms are one letter each and that NFC leaves alone, perhaps between ASCII marks (no
#: apostrophe, nor what special tokens hold); or any word.
_MARKS = r"([!-&(-/:;=?@\[-`{}~]*)"
WORDS = re.compile(rf"^(?:{_MARKS}([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+){_MARKS}|.*)$", re.MULTILINE)

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long"


@dataclass(frozen=True)
class PackSettings:
    tokenizer: str  # path of a tokenizers JSON file, readable on every executor
    capacity: int = 2048
    separator: int = 1
    tolerance: int = 8
    cache_words: int = 600_000


def word_class(length: int, capacity: int) -> int:
    return capacity // length


def cut(tokens: int, capacity: int, tolerance: int) -> list[int]:
    """Piece lengths of a document, in order."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest
        if capacity // k - rest <= tolerance:
            out.append(rest)
            break
        piece = capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


def split_parts(text: str) -> list[str]:
    """Parts between white space as the vocabulary sees it: Python's, but for the four ASCII separators."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return re.split("[ \\t\\n\\r]+", text)
    return text.split()


def gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of values, one after the other."""
    ends = np.cumsum(size)
    return values[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class WordTokenizer:
    """Ids of texts by distinct white-space-separated parts, with a cache of bounded size."""

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.between = self.special[-1] if self.special else None
        self.mark = self.inner.token_to_id(self.between) if self.between else -1
        self.most = most
        self.ends_run = self._ends_run()
        self.clear()

    def clear(self) -> None:
        self.place: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i]: where the ids of word i - 1 end
        self.hits = np.zeros(0, np.int64)
        self.met: list[np.ndarray] = []  # places not yet counted in hits
        self.known = 0

    def _count_hits(self) -> None:
        hits = np.bincount(np.concatenate(self.met), minlength=self.known) if self.met else np.zeros(self.known, np.int64)
        hits[: len(self.hits)] += self.hits
        self.hits, self.met = hits, []

    def _forget(self) -> None:
        """Keep the words met most often, half a cache of them at most."""
        self._count_hits()
        keep = np.flatnonzero(self.hits > max(1, np.partition(self.hits, -(self.most // 2))[-(self.most // 2)]))
        first, size = self.ends[keep], self.ends[keep + 1] - self.ends[keep]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        words, hits = list(self.place), self.hits[keep]
        self.clear()
        for i in keep.tolist():
            self.place[words[i]]
        if len(keep):
            self.ids, self.hits, self.known = ids, hits, len(keep)
            self.ends = np.concatenate([[0], ends, np.zeros(len(keep) + 1, np.int64)])

    def _ends_run(self) -> np.ndarray | None:
        """For each id whether it ends a run of letters or of marks; None unless this tokenizer parts words into such runs."""
        made = json.loads(self.inner.to_str())
        suffix = made["model"].get("end_of_word_suffix")
        if not suffix or made["normalizer"] != NORMALIZER or made["pre_tokenizer"] != PRE_TOKENIZER or any(WORDS.match(t)[2] for t in self.special):
            return None
        ends = np.zeros(self.inner.get_vocab_size(), bool)
        ends[[i for t, i in self.inner.get_vocab().items() if t.endswith(suffix)]] = True
        return ends

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids of runs, and how many each has: up to the one that carries the end-of-word suffix."""
        encoded = self.inner.encode_batch_fast([" ".join(runs[i : i + 64]) for i in range(0, len(runs), 64)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.uint32)
        ends = np.flatnonzero(self.ends_run[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(runs) and ends[-1] == len(ids) else None

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of any words, and how many each has; 64 at a time share one call, parted by a special token that none of them holds."""
        groups = [words[i : i + 64] for i in range(0, len(words), 64)]
        texts = [(self.between or " ").join(g) for g in groups]
        encoded = self.inner.encode_batch_fast(texts, add_special_tokens=False)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for g, text, enc in zip(groups, texts, encoded, strict=True):
            got = np.array(enc.ids, np.uint32)
            at = np.flatnonzero(got == self.mark)
            alone = self.between and text.count(self.between) == len(at) == len(g) - 1 and not any(t in text for t in self.special[:-1])
            if alone:
                ids.append(np.delete(got, at))
                sizes.append(np.diff(np.concatenate([[-1], at, [len(got)]])) - 1)
            else:
                parts = [np.array(self.inner.encode(w, add_special_tokens=False).ids, np.uint32) for w in g]
                ids += parts
                sizes.append(np.array([len(x) for x in parts], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _reserve(self, ids: int, words: int) -> None:
        if ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), ids - len(self.ids)), np.uint32)])
        if words >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), words + 1 - len(self.ends)), np.int64)])

    def _unlearnt(self) -> list[str]:
        """The words that have places but no ids yet; found from the end, as the cache is long."""
        return list(islice(reversed(self.place), len(self.place) - self.known))[::-1]

    def _learn(self) -> None:
        """Ids of the words that have places but no ids yet, and of the runs in them that have no places."""
        words = self._unlearnt()
        pieces = np.full((len(words), 3), -1, np.int64)  # places of a word's runs, if it has several
        runs = None
        if self.ends_run is not None:
            front, letters, back = zip(*WORDS.findall("\n".join(words)), strict=True)
            small = "\n".join(letters).lower().split("\n")
            is_plain = np.fromiter(map(bool, letters), bool, len(words))
            places = np.array([np.fromiter(map(self.place.__getitem__, part), np.int64, len(words)) for part in (front, small, back)]).T
            words = self._unlearnt()
            new = len(words)
            direct = np.zeros(new, bool)
            asked = places[is_plain].ravel() - self.known
            direct[asked[asked >= 0]] = True
            if (none := self.place[""]) >= self.known:  # no marks before or after; not a run
                direct[none - self.known] = False
            chosen = np.flatnonzero(direct)
            runs = self._runs([words[i] for i in chosen.tolist()]) if len(chosen) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            pieces = np.concatenate([np.where((is_plain & ~direct[: len(is_plain)])[:, None], places, -1), np.full((new - len(is_plain), 3), -1, np.int64)])
        if runs is None:  # another tokenizer, or one that parts runs in a way not known here
            chosen, runs = np.zeros(0, np.int64), (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            pieces = np.full((len(words), 3), -1, np.int64)
        whole = pieces[:, 1] < 0
        whole[chosen] = False
        other = np.flatnonzero(whole)
        more = self._whole([words[i] for i in other.tolist()])
        # runs and whole words are put where the new words' ids will be, and the words made of those and of known ones
        begin, made = self.ends[self.known], np.concatenate([runs[0], more[0]])
        self._reserve(begin + len(made), self.known + len(words))
        self.ids[begin : begin + len(made)] = made
        size = np.zeros(len(words), np.int64)
        took = np.concatenate([chosen, other])
        size[took] = np.concatenate([runs[1], more[1]])
        first = np.zeros(len(words), np.int64)
        first[took] = begin + np.cumsum(size[took]) - size[took]
        composed = pieces[:, 1] >= 0
        pieces[~composed, 0] = np.flatnonzero(~composed) + self.known
        old, fresh = np.clip(pieces, 0, max(self.known - 1, 0)), np.clip(pieces - self.known, 0, None)
        sizes = np.where(pieces < 0, 0, np.where(pieces < self.known, self.ends[old + 1] - self.ends[old], size[fresh]))
        new = gather(self.ids, np.where(pieces < self.known, self.ends[old], first[fresh]).ravel(), sizes.ravel())
        self._reserve(begin + len(new), self.known + len(words))
        self.ids[begin : begin + len(new)] = new
        self.ends[self.known + 1 : self.known + 1 + len(words)] = begin + np.cumsum(sizes.sum(1))
        self.known += len(words)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [split_parts(t or "") for t in texts]
        if self.known > self.most:
            self._forget()
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        if len(self.place) > self.known:
            self._learn()
        self.met.append(at)
        if sum(map(len, self.met)) > 1 << 20:
            self._count_hits()
        first, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        flat = gather(self.ids, first, size)
        upto = np.concatenate([[0], np.cumsum(size)])[np.cumsum([len(w) for w in words])]
        return np.split(flat, upto[:-1])


_tokenizers: dict[tuple[str, int], WordTokenizer] = {}


def worker_tokenizer(path: str, most: int) -> WordTokenizer:
    """One for each Python worker, which serves many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, most) not in _tokenizers:
        _tokenizers[path, most] = WordTokenizer(path, most)
    return _tokenizers[path, most]


def piece_rows(doc_id: int | None, ids: np.ndarray, s: PackSettings) -> Iterator[tuple]:
    data = np.append(ids, np.uint32(s.separator)).astype("<u4")
    start = 0
    for n in cut(len(data), s.capacity, s.tolerance):
        yield doc_id, start, n, zlib.crc32(data[start : start + n].tobytes()), len(data), word_class(n, s.capacity)
        start += n


def cut_documents(docs: DataFrame, settings: PackSettings) -> DataFrame:
    """All pieces of all documents, each with its class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(settings.tokenizer, settings.cache_words)
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in in_slices(batches, 256, 1 << 20):
            texts = tokenizer.encode(batch.column(1).to_pylist())
            rows = [r for d, ids in zip(batch.column(0).to_pylist(), texts, strict=True) for r in piece_rows(d, ids, settings)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(work, PIECES)


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each length, the lengths being in decreasing order."""
    room: list[int] = []
    out = []
    for n in lengths:
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= n
        out.append(at)
    return out


def pack(docs: DataFrame, settings: PackSettings) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    c = settings.capacity
    with discarding(docs.sparkSession) as keep:
        numbered = cut_documents(docs, settings).withColumn("_id", F.monotonically_increasing_id())
        pieces = materialize(numbered, "pieces")  # fixes which worker numbered what
        part = F.shiftright("_id", 33)
        local = W.partitionBy("_part", "class").orderBy("_id")
        pieces = pieces.withColumn("_part", part)
        counts = pieces.groupBy("_part", "class").agg(F.count("*").alias("_n"))
        totals = counts.groupBy("class").agg(F.sum("_n").alias("_all"))
        in_front = F.coalesce(F.sum("_n").over(W.partitionBy("class").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        offsets = counts.select("_part", "class", in_front.alias("_before"))
        placed = (
            pieces.withColumn("_local", F.row_number().over(local) - 1)
            .join(offsets, ["_part", "class"])
            .join(F.broadcast(totals), "class")  # one row for each of at most `capacity` classes
            .withColumn("_rank", F.col("_before") + F.col("_local"))
            .withColumn("_bin", F.expr("_rank div class"))
        )
        full = F.col("_bin") < F.expr("_all div class")
        placed = keep(materialize(placed.select("_id", *[x.split()[0] for x in PIECES.split(", ")], "_bin", full.alias("_full")), "placed"))

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_id"], ascending=[False, True])
        rows["_bin"] = first_fit(rows["length"].tolist(), c)
        return rows[["_id", "_bin"]]

    # fewer than k pieces of each class k: at most capacity * ln(capacity) rows, for any input
    rest = placed.where(~F.col("_full"))
    repacked = rest.groupBy(F.lit(1).alias("_one")).applyInPandas(lambda g: again(g.drop(columns="_one", errors="ignore")), "_id long, _bin long")
    shown = ["_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    wide = 1 << 40  # sequence_id = class * 2**40 + number in the class; class 0 holds the rests
    ends = placed.where("_full").select(*shown, (F.col("class") * wide + F.col("_bin")).alias("sequence_id")).unionByName(
        rest.drop("_bin").join(repacked, "_id").select(*shown, F.col("_bin").alias("sequence_id"))
    )
    inside = W.partitionBy("sequence_id").orderBy("_id")
    before = F.coalesce(F.sum("length").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ends.withColumn("offset", before).drop("_id")
