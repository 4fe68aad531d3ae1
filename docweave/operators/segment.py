"""Dictionary segmentation of text without spaces.

Longest matches from the left and from the right propose cuts. Where both agree, their tokens
stand; between, the best split counts: 30 / tokens + share of tokens of two characters or more + sum of
log frequencies. The best splits are found by dynamic programming over (position, tokens), so a
long span costs no more than its length squared.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most dictionary rows that are sent to every worker.
MOST_WORDS = 2_000_000
CJK = re.compile("[一-鿿]")
PIECES = re.compile(r"[一-鿿]+|[a-zA-Z_.+#-]+|[0-9,.]+|[^\W]", re.UNICODE)
UNKNOWN = -12.0


@dataclass
class Book:
    """Words with log frequency and word class, and every prefix of a word."""

    words: dict[str, tuple[float, str]]
    prefixes: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.prefixes = {w[:i] for w in self.words for i in range(1, len(w) + 1)}
        self.longest = max(map(len, self.words), default=1)
        self.reversed = {w[::-1][:i] for w in self.words for i in range(1, len(w) + 1)}

    def frequency(self, word: str) -> int:
        return int(math.exp(self.words[word][0]) * 1_000_000 + 0.5) if word in self.words else 0

    def tag(self, word: str) -> str:
        return self.words[word][1] if word in self.words else ""


def load_book(rows: DataFrame) -> Book:
    """rows: word, freq (a count), tag. Log frequencies are those of counts over a million, as the scores expect."""
    n = rows.count()
    if n > MOST_WORDS:
        raise ValueError(f"a dictionary of {n} words is too large to send to every worker")
    return Book({r[0].lower(): (math.log(max(r[1], 1) / 1_000_000), r[2] or "") for r in rows.select("word", "freq", "tag").collect()})


def from_left(text: str, book: Book) -> list[str]:
    out, at = [], 0
    while at < len(text):
        end = next((e for e in range(min(len(text), at + book.longest), at + 1, -1) if text[at:e] in book.words), at + 1)
        out.append(text[at:end])
        at = end
    return out


def from_right(text: str, book: Book) -> list[str]:
    out, end = [], len(text)
    while end:
        at = next((s for s in range(max(0, end - book.longest), end - 1) if text[s:end] in book.words), end - 1)
        out.append(text[at:end])
        end = at
    return out[::-1]


def best_splits(text: str, book: Book, k: int) -> list[list[str]]:
    """The k best splits of a span into dictionary words and single characters, best first."""
    n = len(text)
    steps: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
    for s in range(n):
        for e in range(s + 1, min(n, s + book.longest) + 1):
            word = text[s:e]
            if word in book.words or e == s + 1:
                steps[e].append((s, book.words.get(word, (UNKNOWN, ""))[0], int(e - s > 1)))
    found: list[tuple[float, list[str]]] = []
    for tokens in range(1, n + 1):
        table: list[list[list[tuple[float, tuple[int, ...]]]]] = [[[] for _ in range(n + 1)] for _ in range(tokens + 1)]
        table[0][0] = [(0.0, ())]
        for t in range(1, tokens + 1):
            for e in range(t, n + 1):
                options = [(v + f + long / tokens, (*cuts, e)) for s, f, long in steps[e] for v, cuts in table[t - 1][s]]
                table[t][e] = sorted(options, key=lambda o: (-o[0], o[1]))[:k]
        for v, cuts in table[tokens][n]:
            found.append((30 / tokens + v, [text[a:b] for a, b in zip((0, *cuts), cuts)]))
    return [words for _, words in sorted(found, key=lambda o: (-o[0], o[1]))[:k]]


def segment(text: str, book: Book) -> list[str]:
    """Tokens of a run of characters: agreed cuts stand, disputed spans get their best split."""
    left, right = from_left(text, book), from_right(text, book)

    def ends(words: list[str]) -> list[int]:
        out, at = [], 0
        for w in words:
            at += len(w)
            out.append(at)
        return out

    shared = sorted(set(ends(left)) & set(ends(right)))
    out, begin = [], 0
    cuts_l, cuts_r = set(ends(left)), set(ends(right))
    for end in shared:
        inner = range(begin + 1, end)
        agreed = not any(i in cuts_l or i in cuts_r for i in inner)
        out += [text[begin:end]] if agreed else best_splits(text[begin:end], book, 1)[0]
        begin = end
    return out


def tokenize(text: str, book: Book, stem: Callable[[str], str] = str) -> list[str]:
    """Lower-case tokens of mixed text: runs of CJK are segmented, Latin words stemmed by what is passed, numbers kept."""
    text = "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else " " if c == "　" else c for c in text or "").lower()
    out = []
    for piece in PIECES.findall(text):
        if CJK.match(piece):
            out += segment(piece, book)
        else:
            out.append(stem(piece) if piece[0].isalpha() else piece)
    return joined(out, book)


def joined(tokens: list[str], book: Book) -> list[str]:
    """Up to five neighbours become one token if their join is a word of letters or digits and other characters."""
    out, at = [], 0
    while at < len(tokens):
        end = at + 1
        for e in range(at + 2, min(len(tokens), at + 5) + 1):
            word = "".join(tokens[at:e])
            if re.search(r"[a-z0-9.+#-]", word) and word in book.words:
                end = e
        out.append("".join(tokens[at:end]))
        at = end
    return out


def fine(tokens: list[str], book: Book) -> list[str]:
    """Each longer token split by its second-best split; Latin text splits at slashes only."""
    if sum(bool(CJK.match(t)) for t in tokens) < 0.2 * len(tokens):
        return [p for t in tokens for p in t.split("/") if p]
    out = []
    for t in tokens:
        if len(t) < 3 or len(t) > 10 or re.match(r"[0-9,.-]+$", t):
            out.append(t)
            continue
        splits = best_splits(t, book, 2)
        second = splits[1] if len(splits) > 1 else [t]
        if len(second) == len(t) or (re.match(r"[a-z.-]+$", t) and any(len(p) < 3 for p in second)):
            second = [t]
        out += second
    return out


def segmented(docs: DataFrame, key: str, text: str, dictionary: DataFrame, fine_too: bool = False) -> DataFrame:
    """key, tokens (and fine_tokens). The dictionary goes to each worker once, behind a check of its size."""
    book = docs.sparkSession.sparkContext.broadcast(load_book(dictionary))
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coarse = [tokenize(t, book.value) for t in b.column(1).to_pylist()]
            cols, names = [b.column(0), pa.array(coarse, pa.list_(pa.string()))], [key, "tokens"]
            if fine_too:
                cols.append(pa.array([fine(t, book.value) for t in coarse], pa.list_(pa.string())))
                names.append("fine_tokens")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(key, F.coalesce(text, F.lit("")).alias(text)).mapInArrow(work, f"{key} {kind}, tokens array<string>" + ", fine_tokens array<string>" * fine_too)


def short_runs(tokens: list[str], stop: frozenset[str] = frozenset()) -> list[str]:
    """Neighbouring one-character or very short tokens become one term: two to four together, longer runs in pairs."""
    short = lambda t: len(t) == 1 or re.match(r"[0-9a-z]{1,2}$", t)
    out, at = [], 0
    if len(tokens) > 1 and short(tokens[0]) and len(tokens[1]) > 1 and not re.match("[0-9a-zA-Z]", tokens[1]):
        out, at = [" ".join(tokens[:2])], 2
    while at < len(tokens):
        end = at
        while end < len(tokens) and tokens[end] and tokens[end] not in stop and short(tokens[end]):
            end += 1
        size = end - at
        take = 1 if size < 2 else size if size < 5 else 2
        out.append(" ".join(tokens[at : at + take]))
        at += take
    return [t for t in out if t]
