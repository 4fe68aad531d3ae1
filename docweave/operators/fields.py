"""Chunks as rows of a search store: fields named by what they hold, positions, batches of table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Endings of field names and what they hold.
SUFFIXES = {"_kwd": "array<string>", "_ltks": "string", "_sm_tks": "string", "_tks": "string", "_int": "int", "_flt": "double", "_dt": "timestamp", "_feas": "map<string,double>", "_fea": "double", "_vec": "array<float>"}
TABLE_TAGS = r"</?(table|td|caption|tr|th)( [^<>]{0,12})?>"


def field_type(name: str) -> str:
    """The type that a field's ending stands for; text if it has none."""
    return next((kind for end, kind in SUFFIXES.items() if name.endswith(end)), "string")


def schema_of(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(field_type(n))) for n in names])


def store_fields(chunks: DataFrame, text: str = "text", tokens: str = "tokens", fine: str = "fine_tokens", positions: str | None = None) -> DataFrame:
    """Adds content fields and, from boxes (page from 0, left, right, top, bottom), positions with pages from 1."""
    made = {"content_with_weight": F.col(text), "content_ltks": F.array_join(tokens, " "), "content_sm_ltks": F.array_join(fine, " ")}
    if positions:
        whole = lambda c: c.cast("int")
        place = lambda p: F.array(whole(p["page"]) + 1, whole(p["left"]), whole(p["right"]), whole(p["top"]), whole(p["bottom"]))
        made |= {"page_num_int": F.transform(positions, lambda p: whole(p["page"]) + 1), "top_int": F.transform(positions, lambda p: whole(p["top"])), "position_int": F.transform(positions, place)}
    return chunks.withColumns(made)


def without_table_tags(text: Column) -> Column:
    return F.regexp_replace(text, TABLE_TAGS, " ")


def row_batches(rows: DataFrame, table: list[str], order: str, text: str, english: bool, size: int = 10) -> DataFrame:
    """Rows of a table joined ten at a time, by a semicolon of the language."""
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy(*table).orderBy(order)) - 1
    packed = rows.withColumn("batch", F.floor(number / size).cast("int")).groupBy(*table, "batch").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_r"))
    return packed.select(*table, "batch", F.array_join(F.transform("_r", lambda r: r[text]), "; " if english else "； ").alias(text))


def simplified(text: Column, mapping: dict[str, str]) -> Column:
    """Characters replaced by a table of single characters, such as traditional to simplified ones."""
    return F.translate(text, "".join(mapping), "".join(mapping.values()))
