"""Documents to chunk records, without a shuffle: one row in, its windows out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as T


def chunk_documents(docs: DataFrame, size: int = 800, overlap: int = 120, path: str = "path", text: str = "text") -> DataFrame:
    """doc_id, doc_name, idx, chunk_id, text of each window; path names the document."""
    doc_id = F.sha1(F.col(path).cast("binary"))
    cut = docs.select(doc_id.alias("doc_id"), F.element_at(F.split(path, "/"), -1).alias("doc_name"), F.posexplode(T.windows(F.col(text), size, overlap)).alias("idx", "text"))
    chunk_id = F.sha1(F.concat_ws(":", "doc_id", F.col("idx").cast("string"), F.substring("text", 1, 128)).cast("binary"))
    return cut.select("doc_id", "doc_name", "idx", chunk_id.alias("chunk_id"), "text")


def budget_pieces(rows: DataFrame, by: list[str], order: list[str], piece: str, most: int) -> DataFrame:
    """Cut pieces, taken in order, to what is left of a character budget; pieces beyond it go."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum(F.length(piece)).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = F.substring(F.col(piece), F.lit(1), F.greatest(F.lit(0), most - F.col("_before")).cast("int"))
    return rows.withColumn("_before", before).where((F.col("_before") < most) & (F.length(piece) > 0)).withColumn(piece, cut).drop("_before")


def greedy_merge(parts: DataFrame, by: list[str], order: str, text: str, size: str, budget: int) -> DataFrame:
    """Append each part to the running chunk while that chunk is not over budget (so it may overshoot once).

    A fold over the ordered parts of one group; groups are single documents.
    """
    packed = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("n"), F.col(text).alias("t")))).alias("parts"))
    empty = F.from_json(F.lit('[{"n":0,"t":""}]'), "array<struct<n:bigint,t:string>>")

    def step(acc, p):
        last = F.element_at(acc, -1)
        opened = F.concat(acc, F.array(F.struct(p["n"].alias("n"), p["t"].alias("t"))))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((last["n"] + p["n"]).alias("n"), F.concat(last["t"], p["t"]).alias("t"))))
        return F.when(last["n"] > budget, opened).otherwise(grown)

    folded = packed.withColumn("chunks", F.aggregate("parts", empty, step))
    return folded.select(*by, F.posexplode("chunks").alias("idx", "chunk")).select(*by, "idx", F.col("chunk.t").alias(text), F.col("chunk.n").alias(size))


def split_keeping(text: str, separators: str = "\n!?;。；！？"):
    """Array of a text's parts, each separator character being a part of its own."""
    marks = "".join("\\n" if c == "\n" else f"\\{c}" if c in "?!" else c for c in separators)
    return F.filter(F.split(text, f"(?<=[{marks}])|(?=[{marks}])"), lambda p: p != "")
