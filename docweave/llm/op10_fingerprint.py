"""Context-triggered piecewise hashing of documents.

A rolling hash over the last seven bytes ends a chunk wherever it hits the block size's residue;
each chunk gives one letter, a base-64 digit of its hash, and the letters of block size b and 2b make the
fingerprint `b:letters:letters2`. The block size is the least 3 * 2**i that should give about 64
letters and is halved while the letters are fewer than 32, so it depends on the text alone and equal
texts have equal fingerprints. Two fingerprints compare where they share a block size: the
likeness is 1 - edits / (letters of both), by insertions and deletions, the higher of the shared
sizes; it is 0 if no block size is shared and 1 if the fingerprints are equal.

Letters beyond the 64th share the last letter (its chunk runs to the end of the text), so a
fingerprint is bounded and still covers the whole text.

Defined results: null text counts as empty, whose fingerprint is `3::`; documents follow each other by
descending doc_id, then text, null ids last; a table of one row is its own next document;
repeated rows each give a row; an empty table gives none. A very long text is hashed whole, in arrays of some ten times its bytes,
and travels once, with its neighbour. Rows of one repeated id lie in one range, texts included. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import in_slices, small_batches

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LEAST_BLOCK = 3
MOST = 64
WINDOW = 7
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_MASKS = tuple(np.uint32(m) for m in (2654435761, 2246822519, 3266489917, 668265263, 374761393, 3644798167, 1640531513))


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the seven bytes that end at each position (fewer at the start), as a sum of mixed bytes."""
    wide = data.astype(np.uint32)
    wide += np.uint32(1)
    h = wide * _MASKS[0]
    for i in range(1, min(WINDOW, len(data))):
        h[i:] += wide[:-i] * _MASKS[i]
    h ^= h >> np.uint32(15)
    h *= _MASKS[1]
    h ^= h >> np.uint32(13)
    return h


def _letters(data: bytes, ends: np.ndarray) -> str:
    cuts = ends[: MOST - 1].tolist()
    if not cuts or cuts[-1] != len(data):
        cuts.append(len(data))
    out, begin = [], 0
    for end in cuts:
        out.append(LETTERS[zlib.crc32(data[begin:end]) & 63])
        begin = end
    return "".join(out)


def fingerprint(text: str | None) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return f"{LEAST_BLOCK}::"
    h = rolling(np.frombuffer(data, np.uint8))
    block = LEAST_BLOCK
    while block * MOST < len(data):
        block *= 2
    # a boundary of block size 2b is one of b; candidates are sought once, at the smallest size in reach
    while True:
        low = np.flatnonzero(h % np.uint32(block) == block - 1) + 1
        first = _letters(data, low)
        if len(first) >= MOST // 2 or block == LEAST_BLOCK:
            break
        block //= 2
    high = low[h[low - 1] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{first}:{_letters(data, high)}"


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Longest common subsequence of each pair of strings of at most 64 letters, bit-parallel over all pairs."""
    n = len(a)
    code = np.full(128, 255, np.uint8)
    code[[ord(x) for x in LETTERS]] = np.arange(64)
    match = np.zeros((n, 65), np.uint64)
    b_codes = np.full((n, MOST), 64, np.uint8)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        cx = code[np.frombuffer(x.encode(), np.uint8)]
        np.bitwise_or.at(match[i], cx, np.uint64(1) << np.arange(len(cx), dtype=np.uint64))
        b_codes[i, : len(y)] = code[np.frombuffer(y.encode(), np.uint8)]
    v = np.full(n, ~np.uint64(0))
    rows = np.arange(n)
    for j in range(max(map(len, b), default=0)):
        m = match[rows, b_codes[:, j]]
        u = v & m
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def _parts(fp: str) -> tuple[int, str, str]:
    block, one, two = fp.split(":")
    return int(block), one, two


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """Likeness of each pair of fingerprints, from 0 to 1."""
    out = [1.0 if x == y else 0.0 for x, y in pairs]
    left, right, of = [], [], []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            continue
        (bx, x1, x2), (by, y1, y2) = _parts(x), _parts(y)
        same = [(x1, y1), (x2, y2)] if bx == by else [(x2, y1)] if 2 * bx == by else [(x1, y2)] if bx == 2 * by else []
        for p, q in same:
            left.append(p)
            right.append(q)
            of.append(i)
    if left:
        # insertions and deletions to turn one into the other: len + len - 2 lcs
        for i, common, p, q in zip(of, lcs_lengths(left, right).tolist(), left, right, strict=True):
            if p or q:
                out[i] = max(out[i], 2 * common / (len(p) + len(q)))
    return out


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first characters of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and the likenesses.

    Documents are dealt out by ranges of doc_id and sorted there, which moves each text once. The
    first document of a range also goes to the range before it, as that range's last neighbour.
    """
    spark = docs.sparkSession
    small_batches(spark)
    least = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("_key"))
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("_key", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))  # at most `ranges` numbers
    where = F.lit(0)
    if bounds:
        # how many bounds lie below: whole runs of bounds by their last one, then those of the run that the key falls into
        run = math.isqrt(len(bounds)) + 1
        lasts, every = (F.filter(F.split(F.lit(",".join(map(str, x))), ","), lambda b: b != "").cast("array<bigint>") for x in (bounds[run - 1 :: run], bounds))
        rows = rows.withColumn("_run", F.size(F.filter(lasts, lambda b: b < F.col("_key"))) * run)
        where = F.col("_run") + F.size(F.filter(F.slice(every, F.col("_run") + 1, F.lit(run)), lambda b: b < F.col("_key")))
    rows = rows.withColumn("_range", -where).drop("_run")  # the order is descending, so ranges count from the highest ids
    tops = {r[0]: r[1] for r in rows.groupBy("_range").agg(F.max("_key")).collect()}  # a row for each range
    if not tops:
        return spark.createDataFrame([], SCHEMA)
    order = sorted(tops)
    after = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    first_of = {tops[after[r]]: r for r in order}
    heads = rows.where(F.col("_key").isin(list(first_of))).groupBy("_key").agg(F.min("text").alias("text"))
    to = F.element_at(F.create_map(*[F.lit(x) for kv in first_of.items() for x in kv]), F.col("_key"))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", "_key", to.alias("_range"), F.lit(1).alias("_head"))
    dealt = rows.withColumn("_head", F.lit(0)).unionByName(heads).repartitionByRange(ranges, "_range")
    ordered = dealt.sortWithinPartitions("_range", "_head", F.desc("_key"), "text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(doc_id, text, next text) of each row that isn't a head."""
        last = None
        for batch in in_slices(batches, 256):
            for doc_id, text, where, head in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last is not None and last[2] == where:
                    yield last[0], last[1], text
                last = None if head else (doc_id, text, where)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        held: list[tuple] = []
        known: tuple[str, str] | None = None
        for doc_id, text, following in pairs(batches):
            own = known[1] if known and known[0] == text else fingerprint(text)
            known = (following, fingerprint(following))
            new = edited(text, following)
            held.append((doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, fingerprint(new), known[1]))
            if len(held) == 1024:
                yield finish(held, names)
                held = []
        if held:
            yield finish(held, names)

    def finish(held: list[tuple], names: list[str]) -> pa.RecordBatch:
        ids, n, sha, own, other, following = zip(*held, strict=True)
        near = likeness([*zip(own, other, strict=True), *zip(own, following, strict=True)])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array(own), pa.array(other), pa.array(near[: len(held)], pa.float64()), pa.array(near[len(held) :], pa.float64())],
            names,
        )

    return ordered.select("doc_id", "text", "_range", "_head").mapInArrow(work, SCHEMA)
