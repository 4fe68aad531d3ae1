"""Near-duplicate detection by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so
half the hash evaluations give the same number of values. Bands of five values (minima with minima,
maxima with maxima) find candidates; every link is confirmed on the full shingle sets. With 80
permutations and 32 bands a pair at the threshold of 0.8 is missed with probability 3e-6.

Steps, none of which gathers a group in one place:
1. one pass over the texts gives each document its set size, a digest of its set and its band keys;
2. documents with equal sets form a class, of which the least doc_id stands for all;
3. in each bucket every member is compared with the bucket's least member (a star, not all pairs);
4. components of the confirmed links; in buckets that still hold several components, members
   outside the bucket's largest component are compared with all members of other components, which
   leaves no candidate pair between components untested; lengths and parity bitmaps, which refuse no
   similar pair, thin them before the sets are read; components again;
5. documents get their class's component.

Defined results: null or blank text has an empty set and stands alone; a text with fewer words than
a shingle has one shingle, the whole sequence; a null doc_id is linked with nothing, has a null
component and is kept; rows that share a doc_id count as texts of one document; an empty table
gives no rows; of a group the least doc_id stays. A very long text is hashed in blocks; its distinct shingles are held at once, 8 bytes
each. Other columns are ignored by `near_duplicates` and kept by `keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import ngrams
from docweave.llm.components import connected_components
from docweave.llm.shared import discarding, fresh, in_slices, materialize, small_batches

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PARITY_LONGS = 16
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class MinMaxSettings:
    shingle: int = 5
    percent: int = 80
    permutations: int = 80
    rows: int = 5
    seed: int = 20
    broadcast_ids: int = 500_000

    @property
    def bands(self) -> int:
        return 2 * (self.permutations // self.rows)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _K2
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word k-grams of the text."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    ids, distinct = ngrams.number_words(words)
    of = np.fromiter(map(xxh3_64_intdigest, distinct), np.uint64, len(distinct))[ids]
    n = max(len(of) - k + 1, 1)
    h = np.full(n, len(of) if len(of) < k else k, np.uint64)
    for i in range(min(k, len(of))):
        h = _mix(h * _K1 + of[i : i + n] + _K3)
    return np.unique(h)


def permutation_table(s: MinMaxSettings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    return rng.integers(0, 1 << 32, s.permutations, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, s.permutations, np.uint32)


def min_max(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum under each permutation; long sets in blocks."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    for i in range(0, len(x), 4096):
        h = a[:, None] * x[i : i + 4096] + b[:, None]
        h ^= h >> np.uint32(16)
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band; bands of different places never share a key on purpose."""
    both = np.concatenate([low.reshape(-1, rows), high.reshape(-1, rows)]).astype(np.uint64)
    h = np.arange(1, len(both) + 1, dtype=np.uint64) * _K3
    for i in range(rows):
        h = _mix(h * _K1 + both[:, i])
    return h.view(np.int64)


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """PARITY_LONGS * 64 bits, each the parity of the shingles that hash to it.

    Two maps differ in at most as many bits as shingles are in one set only.
    """
    n = np.bincount((shingles & np.uint64(PARITY_LONGS * 64 - 1)).astype(np.int64), minlength=PARITY_LONGS * 64)
    return np.packbits(n & 1, bitorder="little").view(np.int64)


def signatures(docs: DataFrame, s: MinMaxSettings) -> DataFrame:
    a, b = permutation_table(s)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sizes, digests, bands, maps = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, s.shingle)
                sizes.append(len(found))
                maps.append(parity_map(found))
                if len(found):
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(*min_max(found, a, b), s.rows))
                else:
                    digests.append(None)
                    bands.append(np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands)))
            even = pa.array(np.arange(0, PARITY_LONGS * len(maps) + 1, PARITY_LONGS, dtype=np.int32))
            parity = pa.ListArray.from_arrays(even, pa.array(np.concatenate(maps)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), keys, parity], ["doc_id", "n_shingles", "digest", "bands", "parity"]
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_shingles long, digest binary, bands array<long>, parity array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, s: MinMaxSettings) -> DataFrame:
    """The full shingle sets of the documents named in ids."""
    named = F.broadcast(ids) if ids.count() <= s.broadcast_ids else ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [shingle_set(t, s.shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], ["id", "set"])

    return docs.select("doc_id", "text").join(named, docs["doc_id"] == named["id"], "left_semi").mapInArrow(work, "id long, set array<long>")


def confirmed(docs: DataFrame, pairs: DataFrame, s: MinMaxSettings) -> DataFrame:
    """Of the candidate pairs (u, v) those whose full sets reach the threshold."""
    pairs = materialize(pairs, "pairs")
    ids = materialize(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "pair-ids")
    sets = materialize(sets_of(docs, ids, s), "pair-sets")
    left = sets.select(F.col("id").alias("u"), F.col("set").alias("su"))
    right = sets.select(F.col("id").alias("v"), F.col("set").alias("sv"))
    shared = F.size(F.array_intersect("su", "sv"))
    both = F.size("su") + F.size("sv") - shared
    linked = pairs.join(left, "u").join(right, "v").where(100 * shared >= s.percent * both).select("u", "v")
    return materialize(linked, "links")


def near_duplicates(docs: DataFrame, s: MinMaxSettings = MinMaxSettings()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    with discarding(docs.sparkSession) as keep:
        signed = materialize(signatures(docs, s), "signatures")
        named = keep(class_components(docs, signed, s))
        # of the signatures only this small part is read later
        kept = keep(materialize(signed.withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest"))).select("doc_id", "n_shingles", "digest"), "set-sizes"))
    component = F.coalesce("component", "doc_id")
    out = kept.join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def class_components(docs: DataFrame, signed: DataFrame, s: MinMaxSettings) -> DataFrame:
    """digest and component of every class of equal sets."""
    usable = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")), "classes")
    heads = classes.select("digest", F.col("rep").alias("doc_id"))
    members = usable.join(heads, ["digest", "doc_id"]).select(F.col("doc_id").alias("id"), "n_shingles", F.explode("bands").alias("key"))
    least = members.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    members = materialize(members.join(least, "key"), "members")  # only of buckets with two documents or more
    star = members.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct()
    links = confirmed(docs, star, s)
    found = materialize(connected_components(links), "components")

    placed = members.join(found, members["id"] == found["node"], "left").select("key", "id", "n_shingles", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("key")
    words = [F.get("parity", i).alias(f"p{i}") for i in range(PARITY_LONGS)]
    maps = usable.select(F.col("doc_id").alias("id"), *words)
    open_members = materialize(placed.join(mixed, "key").join(maps, "id"), "open-members")
    sizes = open_members.groupBy("key", "c").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "c")).alias("m")).select("key", F.col("m.c").alias("main"))
    marked = open_members.join(main, "key")
    a, b = marked.where("c <> main").alias("a"), marked.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.c") != F.col("b.c")) & ((F.col("b.c") == F.col("b.main")) | (F.col("a.id") < F.col("b.id")))
    near &= 100 * F.least("a.n_shingles", "b.n_shingles") >= s.percent * F.greatest("a.n_shingles", "b.n_shingles")
    apart = sum((F.bit_count(F.col(f"a.p{i}").bitwiseXOR(F.col(f"b.p{i}"))) for i in range(1, PARITY_LONGS)), F.bit_count(F.col("a.p0").bitwiseXOR(F.col("b.p0"))))
    near &= (100 + s.percent) * apart <= (100 - s.percent) * (F.col("a.n_shingles") + F.col("b.n_shingles"))
    rest = a.join(b, near).select(F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")).distinct()
    rest = materialize(rest.join(star, ["u", "v"], "left_anti"), "rest")
    if rest.limit(1).count():
        more = confirmed(docs, rest, s)
        if more.limit(1).count():
            found = materialize(connected_components(links.unionByName(more)), "components")

    named = classes.join(found, classes["rep"] == found["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return materialize(named, "class-components")


def keep_one(docs: DataFrame, s: MinMaxSettings = MinMaxSettings()) -> DataFrame:
    """The documents with one of each near-duplicate group: the one with the least doc_id."""
    name = fresh(docs, "gone")
    with discarding(docs.sparkSession) as keep:
        gone = keep(materialize(near_duplicates(docs, s).where("NOT kept").select(F.col("doc_id").alias(name)).distinct(), "gone-ids"))
    if gone.count() <= s.broadcast_ids:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
