"""Incremental ingest: a file stream whose batches are upserted into a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.chunking import chunk_documents
from docweave.operators.store import upsert
from docweave.sources.workspace import workspace


def ingest_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "doc_id", text: str = "text", file_glob: str = "*.parquet") -> None:
    """Take in all files that have come since the last run.

    Each batch appends its rows with the batch's number, so a batch that is run again after a failure overwrites its
    own folder and nothing else; `current` keeps the last version of each key.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(source)

    def take(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str, key: str = "doc_id") -> DataFrame:
    """The last version of each document."""
    log = spark.read.parquet(f"{target}/batch=*").withColumn("seq", F.col(key))
    return upsert(log, key, "version", "seq").drop("seq")


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by tumbling window and type; late events count until the watermark passes."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def streamed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents table after it was taken in as a stream."""
    target, checkpoint = workspace(spark, "stream"), workspace(spark, "stream-state")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    folder = f"{sf_dir}/documents.parquet"
    glob = "*.parquet"
    path = folder if _is_folder(spark, folder) else sf_dir
    ingest_stream(spark, path, schema, target, checkpoint, file_glob=glob if path == folder else "documents.parquet")
    docs = current(spark, target).withColumn("path", F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return chunk_documents(docs)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
