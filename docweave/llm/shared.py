"""Helpers that the corpus operators share: durable intermediate tables, Arrow batches, labelled samples."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the five ASCII controls from tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: dict[str, str] = {}
#: Paths written in each open `discarding`, the innermost last.
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. Only a local session may fall back to a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = f"file://{tempfile.mkdtemp(prefix='docweave-')}"
    return _own_folder[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps survive lost executors and see one version."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docweave/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")  # once the table is written, nothing reads this plan's shuffles
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
        if _scopes:
            _scopes[-1].append(path)  # a write that fails leaves files too
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        delete_path(df.sparkSession, df.written_to)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete, at the end or on failure, all tables that are materialized inside but for those given to the yielded function.

    Those are what a lazy result reads; they pass to the scope around this one, if there is one, and else stay.
    """
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, "written_to", ""))
        return df

    _scopes.append(made)
    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _scopes.remove(made)
        for path in made:
            if path not in kept:
                delete_path(spark, path)
        if _scopes:
            _scopes[-1].extend(path for path in made if path in kept)


def small_batches(spark: SparkSession, most_rows: int = 1000) -> None:
    """Hold Arrow batches to so many rows in this session: whole texts are long, and memory is shared with the JVM."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most_rows:
        spark.conf.set(name, str(most_rows))


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that Python works on about most_bytes at once (or one row), whatever the batch size is."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = min(rows, batch.num_rows - at)
            while step > 1 and batch.slice(at, step).nbytes > most_bytes:
                step //= 2
            yield batch.slice(at, step)
            at += step
    pa.default_memory_pool().release_unused()  # the worker lives on for other tasks


def release_memory() -> None:
    """Hand what this process has freed back to the system. glibc keeps it for later, but beside the JVM a driver may have no later need of it."""
    with suppress(AttributeError, OSError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def ascii_words(text: Column) -> Column:
    """Array of words; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), lambda w: w != "")


def labelled_sample(docs: DataFrame, key: str, per_key: int, most_rows: int, most_chars: int, labels: DataFrame | None = None) -> list[tuple[str, object]]:
    """(text, key) pairs on the driver: at most per_key a key value, and in all most_rows (or one a key value) and most_chars.

    docs: doc_id, text and, unless labels (doc_id and key) are given, key. Ids hash into per_key slots for each key value and
    the smallest hash of a slot stays, so choosing is one partial aggregation, a hot key or id costs no more than any other,
    and what reaches the driver is per_key numbers a key value. Only lengths are joined with labels, and repeated labels
    count once. Keys take turns, so that most_rows and most_chars cut all alike and no key value is lost to most_rows. Of the rows that
    share an id the shortest text counts. Null ids, texts and keys aren't sampled.
    """
    own = [key] if labels is None else []
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", *own, "text", F.length("text").alias("_n"))
    sized = rows.drop("text") if labels is None else rows.drop("text").join(labels.where(F.col("doc_id").isNotNull()).select("doc_id", key).distinct(), "doc_id")
    mixed = F.xxhash64(F.col("doc_id"), F.lit(17))
    slots = sized.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), F.pmod(mixed, F.lit(per_key)).alias("_slot"))
    picked = slots.agg(F.min(F.struct(mixed.alias("h"), "doc_id", "_n")).alias("m")).select("_key", "m.doc_id", "m._n").collect()
    by_key: dict[object, list[tuple[int, int]]] = {}
    for k, doc_id, n in sorted(picked, key=lambda r: (str(r[0]), r[1])):
        by_key.setdefault(k, []).append((doc_id, n))
    chosen: dict[int, object] = {}
    total = 0
    for _, _, k, doc_id, n in sorted((i, str(k), k, d, n) for k, ds in by_key.items() for i, (d, n) in enumerate(ds)):
        if len(chosen) >= max(most_rows, len(by_key)):
            break
        if doc_id not in chosen and total + n <= most_chars:
            chosen[doc_id] = k
            total += n
    if not chosen:
        return []
    wanted = rows.where(F.col("doc_id").isin(list(chosen))).groupBy("doc_id", *own).agg(F.min(F.struct("_n", "text"))["text"].alias("text")).collect()
    texts = {r["doc_id"]: r["text"] for r in wanted if not own or r[key] == chosen[r["doc_id"]]}
    return [(texts[d], k) for d, k in chosen.items()]
