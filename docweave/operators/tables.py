"""HTML tables in chunk streams: detection, fragment merging, parsing, structuring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TABLE_TAG = r"(?i)<\s*(table|tr|td|th|caption)\b"
#: Columns whose empty cells repeat the cell above.
FILL_DOWN = ("缺陷部位", "类别", "分类", "部位", "对象", "设备类", "章节")


def has_table(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(TABLE_TAG)


def merge_fragments(chunks: DataFrame, by: list[str], seq: str = "seq", text: str = "text") -> DataFrame:
    """Consecutive pieces of one table become one chunk, up to the piece that closes the table.

    by, seq (of the first piece), text, is_table, pieces. A running count of boundaries numbers the
    runs; by is a document, so windows and groups stay within one.
    """
    order = W.partitionBy(*by).orderBy(seq)
    flagged = chunks.withColumns({"_t": has_table(F.col(text)), "_closed": F.contains(F.lower(text), F.lit("</table"))})
    before = F.lag(F.col("_t") & ~F.col("_closed")).over(order)
    opens = (~(F.col("_t") & F.coalesce(before, F.lit(False)))).cast("int")
    runs = flagged.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order))
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    piece = F.when(F.col("_t"), trimmed).otherwise(F.col(text))
    merged = runs.groupBy(*by, "_run").agg(
        F.min(seq).alias(seq), F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), piece.alias("p"), F.col(text).alias("raw")))).alias("_p"), F.first("_t").alias("is_table"), F.count("*").alias("pieces")
    )
    joined = F.array_join(F.filter(F.transform("_p", lambda p: p["p"]), lambda x: x != ""), "\n")
    return merged.select(*by, seq, F.when(F.col("pieces") == 1, F.get("_p", 0)["raw"]).otherwise(joined).alias(text), "is_table", "pieces")


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", html.unescape(text)).strip()


class _Reader(HTMLParser):
    """Collects (caption, rows) of flat tables; cells take all text inside them, rows need a filled cell."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, list[list[str]]]] = []
        self.caption, self.rows, self.row, self.parts = "", None, None, None
        self.in_caption = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.caption, self.rows = "", []
        elif self.rows is not None:
            if tag == "caption":
                self.in_caption, self.parts = True, []
            elif tag == "tr":
                self.row = []
            elif tag in ("td", "th"):
                self.parts = []

    def handle_endtag(self, tag):
        if tag == "caption" and self.in_caption:
            self.caption, self.in_caption, self.parts = _clean("".join(self.parts or [])), False, None
        elif tag in ("td", "th") and self.parts is not None and not self.in_caption:
            if self.row is not None:
                self.row.append(_clean("".join(self.parts)))
            self.parts = None
        elif tag == "tr" and self.row is not None and self.rows is not None:
            if any(self.row):
                self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.rows is not None:
            if self.rows:
                self.found.append((self.caption, self.rows))
            self.rows = None

    def handle_data(self, data):
        if self.parts is not None:
            self.parts.append(data)


CAPTION = re.compile(r"<\s*caption[^>]*>(.*?)<\s*/\s*caption\s*>", re.I | re.S)


def read_tables(text: str) -> list[tuple[str, list[list[str]]]]:
    reader = _Reader()
    reader.feed(text or "")
    spare = [_clean(c) for c in CAPTION.findall(text or "")]
    return [(c or (spare[i] if i < len(spare) else ""), rows) for i, (c, rows) in enumerate(reader.found)]


def cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, table_no, caption, row_no, col_no, cell of every table; short rows are padded with empty cells."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "table_no", "caption", "row_no", "col_no", "cell"]
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, (caption, rows) in enumerate(read_tables(t)):
                    width = max(map(len, rows))
                    out += [(k, i, caption, r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row + [""] * (width - len(row)))]
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [batch.column(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return docs.select(key, text).mapInArrow(work, f"{key} {kind}, table_no int, caption string, row_no int, col_no int, cell string")


def structured(cell: DataFrame, key: str) -> DataFrame:
    """Cells below the header row with their column names, empty cells filled down where the column asks for it."""
    table = [key, "table_no"]
    head = cell.where("row_no = 0").select(*table, "col_no", F.when(F.col("cell") != "", F.col("cell")).otherwise(F.concat(F.lit("列"), (F.col("col_no") + 1).cast("string"))).alias("name"))
    body = cell.where("row_no > 0").join(head, [*table, "col_no"])
    down = W.partitionBy(*table, "col_no").orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)
    above = F.last(F.when(F.col("cell") != "", F.col("cell")), ignorenulls=True).over(down)
    value = F.when((F.col("cell") == "") & F.col("name").isin(*FILL_DOWN), F.coalesce(above, F.lit(""))).otherwise(F.col("cell"))
    filled = body.withColumn("value", value)
    any_value = F.max((F.col("value") != "").cast("int")).over(W.partitionBy(*table, "row_no"))
    return filled.withColumn("_any", any_value).where("_any = 1").drop("_any", "cell")


def as_text(cell: DataFrame, key: str) -> DataFrame:
    """key, table_no, text: caption line, header line, a line of name=value for each record."""
    table = [key, "table_no"]
    heads = cell.where("row_no = 0").groupBy(*table).agg(F.first("caption").alias("caption"), F.array_sort(F.collect_list(F.struct("col_no", "cell"))).alias("_h"))
    fields = structured(cell, key).where("value <> ''")
    lines = fields.groupBy(*table, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "name", "value"))).alias("_f"))
    lines = lines.withColumn("line", F.concat(F.lit("- "), F.array_join(F.transform("_f", lambda f: F.concat(f["name"], F.lit("="), f["value"])), "；")))
    body = lines.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("_l"))
    caption = F.when(F.col("caption") != "", F.col("caption")).otherwise(F.concat(F.lit("表格"), (F.col("table_no") + 1).cast("string")))
    said = F.concat(F.array(F.concat(F.lit("[结构化表格] "), caption), F.concat(F.lit("表头："), F.array_join(F.transform("_h", lambda h: h["cell"]), " | "))), F.coalesce(F.transform("_l", lambda x: x["line"]), F.array().cast("array<string>")))
    return heads.join(body, table, "left").select(*table, F.array_join(said, "\n").alias("text"))


def strip_tags(text: Column) -> Column:
    """Tags become spaces, the five XML entities and the blank are resolved, white space collapses."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), "^ | $", "")


def key_values(cell: DataFrame, key: str) -> DataFrame:
    """key, name, value of tables whose cells alternate between names and values.

    An empty name continues the last one, over rows too; the values of a name are joined in order.
    """
    table = [key, "table_no"]
    squeezed = F.regexp_replace(F.regexp_replace("cell", r"(?U)\s+", ""), "^[：:]+|[：:]+$", "")
    names = cell.where("col_no % 2 = 0").select(*table, "row_no", (F.col("col_no") / 2).cast("int").alias("pair"), squeezed.alias("name"))
    values = cell.where("col_no % 2 = 1").select(*table, "row_no", ((F.col("col_no") - 1) / 2).cast("int").alias("pair"), F.regexp_replace("cell", r"(?U)^\s+|\s+$", "").alias("value"))
    pairs = names.join(values, [*table, "row_no", "pair"], "left").withColumn("value", F.coalesce("value", F.lit("")))
    order = W.partitionBy(*table).orderBy("row_no", "pair").rowsBetween(W.unboundedPreceding, 0)
    named = pairs.withColumn("name", F.last(F.when(F.col("name") != "", F.col("name")), ignorenulls=True).over(order))
    kept = named.where("name IS NOT NULL AND value <> ''")
    packed = kept.groupBy(*table, "name").agg(F.array_sort(F.collect_list(F.struct("row_no", "pair", "value"))).alias("_v"))
    return packed.select(*table, "name", F.array_join(F.transform("_v", lambda v: v["value"]), "").alias("value"))


def metadata_text(entries: Column) -> Column:
    """Lines of a document's metadata. entries: array of (name, value, items); items, if any, are maps and stand below the name."""
    item = lambda m: F.concat(F.lit("  - "), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "；"))
    single = lambda e: F.concat(e["name"], F.lit("："), F.coalesce(e["value"], F.lit("")))
    several = lambda e: F.array_join(F.concat(F.array(F.concat(e["name"], F.lit("："))), F.transform(e["items"], item)), "\n")
    return F.array_join(F.transform(entries, lambda e: F.when(e["items"].isNull(), single(e)).otherwise(several(e))), "\n")


def revisions(cell: DataFrame, key: str) -> DataFrame:
    """Rows of revision tables as name-value maps; a row that has only a number goes."""
    table = [key, "table_no"]
    squeezed = F.regexp_replace(F.regexp_replace("cell", r"(?U)\s+", ""), "^[：:]+|[：:]+$", "")
    head = cell.where("row_no = 0").select(*table, "col_no", squeezed.alias("name"))
    #: The columns a revision table must have.
    needed = ["序号", "版本", "作者", "修改时间"]
    fit = head.groupBy(*table).agg(F.collect_set("name").alias("_n")).where(F.size(F.array_except(F.array(*[F.lit(n) for n in needed]), "_n")) == 0).select(*table)
    body = cell.where("row_no > 0").join(fit, table).join(head.where("name <> ''"), [*table, "col_no"])
    full = body.withColumn("value", F.regexp_replace("cell", r"(?U)^\s+|\s+$", "")).where("value <> ''")
    packed = full.groupBy(*table, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "name", "value"))).alias("_f"), F.max((F.col("name") != "序号").cast("int")).alias("_more"))
    return packed.where("_more = 1").select(*table, "row_no", F.map_from_entries(F.transform("_f", lambda f: F.struct(f["name"], f["value"]))).alias("revision"))
