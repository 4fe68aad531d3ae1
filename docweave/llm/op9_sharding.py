"""Hilbert-curve ordering: shards whose files hold narrow ranges of several metadata dimensions.

Each dimension is quantised to 2**bits cells of equal shares of the rows: sizes by sixteenths of octaves in their order,
labels in the order of their names. A row's cells give its place on the Hilbert curve (the reversible transpose form: Gray decoding after undoing the
rotations, as bit operations on columns), rows are ordered by that place, and runs of the order become shards. A reader
that filters on any of the dimensions can skip most shards by their min and max.

Law `bytes`: the order is cut where its bytes reach k / shards of all, moved to the nearer end of the group of equal texts
that lies there. So equal texts share a shard, and a shard's bytes differ from the mean by at most one such group. Equal texts lie
together: where their metadata differ, their place is that of their least doc_id on a curve of its own, whose (negative) places
come first, so that such groups widen the ranges of the first shards only.

The order is a distributed sort: range partitioning on (place, text, doc_id), which splits a hot group, a sort inside each
partition, and offsets from one count per partition. The cuts are found from those counts and from the rows of
the partitions they fall into; a row's shard is how many cuts lie before its rank.

Defined results: null and empty metadata have cells of their own place in the order of names, null first; null text has size 16 and the
crc32 of nothing, 0; a null doc_id sorts first among ties; repeated rows each take a slot; an empty table gives no rows; a
text of any length is hashed and never split. Other columns are ignored by `hilbert_shards` and written by `write_shards`, but for a
column named like the shard folder.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.llm.shared import discarding, fresh, materialize

#: Most bytes of a table that is broadcast; its rows have a known width.
BROADCAST_BYTES = 16 << 20


def hilbert_index(df: DataFrame, cells: Sequence[str], bits: int, name: str) -> DataFrame:
    """Add the place on the Hilbert curve of the given integer columns, each in [0, 2**bits)."""
    n = len(cells)
    x = [f"_x{i}" for i in range(n)]
    df = df.withColumns({x[i]: F.col(c).cast("long") for i, c in enumerate(cells)})
    first = F.col(x[0])
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            on = F.col(x[i]).bitwiseAND(q) != 0
            swap = first.bitwiseXOR(F.col(x[i])).bitwiseAND(p)
            new_first = F.when(on, first.bitwiseXOR(F.lit(p))).otherwise(first.bitwiseXOR(swap))
            new = {x[0]: new_first}
            if i:
                new[x[i]] = F.when(on, F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(swap))
            df = df.withColumns(new)
    for i in range(1, n):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn = F.lit(0).cast("long")
    for b in range(bits - 1, 0, -1):
        turn = F.when(F.col(x[n - 1]).bitwiseAND(1 << b) != 0, turn.bitwiseXOR(F.lit((1 << b) - 1))).otherwise(turn)
    df = df.withColumn("_t", turn)
    df = df.withColumns({c: F.col(c).bitwiseXOR(F.col("_t")) for c in x})
    place = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in x:
            place = F.shiftleft(place, 1).bitwiseOR(F.shiftright(F.col(c), b).bitwiseAND(1))
    return df.withColumn(name, place).drop(*x, "_t")


def _few(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def label_cells(rows: DataFrame, label: str, cell: str, bits: int) -> DataFrame:
    """Quantise a label: values in the order of their names, each in the cell where the middle of its rows lies. The window runs over the table of values."""
    values = rows.groupBy(F.col(label).alias("_v")).agg(F.count("*").alias("_n"))
    order = W.orderBy(F.col("_v").asc_nulls_first())
    middle = F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n") / 2
    total = F.sum("_n").over(W.partitionBy(F.lit(1)))
    cells = materialize(values.withColumn(cell, F.floor(middle * (1 << bits) / total).cast("long")).select("_v", cell), "label-cells")
    return rows.join(_few(cells, 64), F.col(label).eqNullSafe(F.col("_v"))).drop("_v")


def _cuts(ordered: DataFrame, shards: int) -> tuple[DataFrame, list[int]]:
    """The rows with their `_rank`, and the ranks where shards begin, but for the first."""
    part = F.shiftright("_id", 33)
    parts = sorted(ordered.groupBy(part.alias("p")).agg(F.count("*"), F.sum("size")).collect())  # a row for each partition of the sort
    at, rows, size = {}, 0, 0
    for p, n, b in parts:
        at[p] = (rows, size, b)
        rows, size = rows + n, size + b
    if not rows:
        return ordered.withColumn("_rank", F.lit(0).cast("long")), []
    listed = json.dumps([{"_part": p, "_before": r, "_bytes": b} for p, (r, b, _) in at.items()])
    offsets = ordered.sparkSession.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<_part:bigint,_before:bigint,_bytes:bigint>>")))
    ranked = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1))
    goals = [size * k // shards for k in range(1, shards)]
    hit = sorted({p for g in goals for p, (_, b, own) in at.items() if b <= g < b + own})
    running = F.col("_bytes") + F.sum("size").over(W.partitionBy("_part").orderBy("_id").rowsBetween(W.unboundedPreceding, 0))
    near = ranked.where(F.col("_part").isin(hit)).withColumn("end", running)
    spans = F.array(*[F.lit(g).cast("long") for g in goals])
    own = near.withColumn("goal", F.explode(F.filter(spans, lambda g: (g >= F.col("end") - F.col("size")) & (g < F.col("end")))))
    found = own.select("goal", "_rank", "end", "size", "_th", "text_crc32").collect()  # one row a cut
    keys = {(r["_th"], r["text_crc32"], r["size"]) for r in found}
    same = ranked.where(F.col("_th").isin([k[0] for k in keys])).groupBy("_th", "text_crc32", "size").agg(F.min("_rank"), F.count("*"))
    group = {tuple(r)[:3]: (r[3], r[4]) for r in same.collect()}  # a row for each group that a cut falls into
    cuts = []
    for r in found:
        first, n = group[r["_th"], r["text_crc32"], r["size"]]
        begin = r["end"] - r["size"] * (r["_rank"] - first + 1)
        cuts.append(first if r["goal"] - begin <= begin + n * r["size"] - r["goal"] else first + n)
    return ranked, sorted(cuts)


def _placed(docs: DataFrame, shards: int, bits: int, rows_per_partition: int, payload: bool) -> DataFrame:
    """Every row with its shard and slot; payload: the row itself goes along, as struct `row`."""
    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    more = [F.struct(*docs.columns).alias("row")] if payload else []
    rows = docs.select(
        "doc_id", F.col("source").alias("_source"), F.col("lang").alias("_lang"), (F.octet_length(binary) + 16).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"), F.xxhash64(binary).alias("_th"), *more
    )
    sized = materialize(rows, "shard-rows")
    celled = sized.withColumn("_size", F.floor(16 * F.log2("size")).cast("int"))  # sixteenths of octaves, at most 500 values
    for i, label in enumerate(("_size", "_source", "_lang")):
        celled = label_cells(celled, label, f"_c{i}", bits)
    keyed = hilbert_index(celled, ["_c0", "_c1", "_c2"], bits, "place").drop("_c0", "_c1", "_c2", "_size", "_source", "_lang")
    text = ["_th", "text_crc32", "size"]
    groups = keyed.groupBy(*text).agg(F.min(F.struct("doc_id", "place"))["place"].alias("_first"), F.min("place").alias("_a"), F.max("place").alias("_b"))
    moved = materialize(groups.where("_a <> _b").drop("_a", "_b"), "shard-moved")  # equal texts whose metadata differ
    keyed = keyed.join(_few(moved, 64), text, "left").withColumn("place", F.coalesce(F.col("_first") - (1 << (3 * bits)), "place")).drop("_first")
    n = sized.count()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows_per_partition))
    keys = ["place", *text, "doc_id"]
    ordered = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    ordered = materialize(ordered, "shard-order")  # fixes partition numbers and places inside them
    ranked, cuts = _cuts(ordered, shards)
    begins = F.array(*[F.lit(c).cast("long") for c in [0, *cuts]])
    shard = F.size(F.filter(begins, lambda c: c <= F.col("_rank"))) - 1
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - F.element_at(begins, F.col("shard") + 1))


def hilbert_shards(docs: DataFrame, shards: int = 40, bits: int = 6, rows_per_partition: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve place of every document."""
    with discarding(docs.sparkSession) as keep:
        placed = _placed(docs, shards, bits, rows_per_partition, False).select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "place"
        )
        return keep(materialize(placed, "shards"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, bits: int = 6, rows_per_partition: int = 200_000, folder: str = "shard") -> None:
    """Write documents into shard folders, each sorted by the curve, so that readers prune by file statistics."""
    rest = [c for c in docs.columns if c.lower() != folder.lower()]
    with discarding(docs.sparkSession):
        placed = _placed(docs, shards, bits, rows_per_partition, True)
        flat = placed.select(*[F.col("row")[c].alias(c) for c in rest], F.col("shard").alias(folder), F.col("slot").alias(fresh(docs, "_slot")))
        slot = flat.columns[-1]
        # a shard's rows may lie in several tasks, as many files, so that no task holds a shard
        flat.repartitionByRange(folder, slot).sortWithinPartitions(folder, slot).drop(slot).write.partitionBy(folder).parquet(path)
