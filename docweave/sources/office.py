"""Office files (DOCX, XLSX, PPTX) as rows, read from their zipped XML with the standard library.

Each file is read once, where it lies, and gives rows (`mapInArrow` over `binaryFile`); everything
after that is relational.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as X

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Namespaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _part(z: zipfile.ZipFile, name: str) -> X.Element | None:
    return X.fromstring(z.read(name)) if name in z.namelist() else None


# ------------------------------------------------------------------ DOCX


def _text(node: X.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag in (f"{W}tab",):
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr") and x.get(f"{W}type") != "page":
            out.append("\n")
    return "".join(out)


def _styles(z: zipfile.ZipFile) -> dict[str, str]:
    root = _part(z, "word/styles.xml")
    return {} if root is None else {s.get(f"{W}styleId"): s.find(f"{W}name").get(f"{W}val") for s in root.iter(f"{W}style") if s.find(f"{W}name") is not None}


def docx_blocks(blob: bytes) -> list[tuple[str, str, int, list[list[str]]]]:
    """(kind, text, level, cells) of the body's paragraphs and tables in order; level is the heading's, else 0."""
    out = []
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        names = _styles(z)
        body = _part(z, "word/document.xml").find(f"{W}body")
        for node in body:
            if node.tag == f"{W}p":
                style = node.find(f"{W}pPr/{W}pStyle")
                name = names.get(style.get(f"{W}val"), style.get(f"{W}val")) if style is not None else ""
                found = re.match(r"(?i)heading ?(\d+)$", name or "")
                out.append(("paragraph", _text(node), int(found.group(1)) if found else 0, []))
            elif node.tag == f"{W}tbl":
                rows = []
                for tr in node.iter(f"{W}tr"):
                    row = []
                    for tc in tr.findall(f"{W}tc"):
                        span = tc.find(f"{W}tcPr/{W}gridSpan")
                        row += ["\n".join(_text(p) for p in tc.findall(f"{W}p"))] * (int(span.get(f"{W}val")) if span is not None else 1)
                    rows.append(row)
                out.append(("table", "", 0, rows))
    return out


def outline_chunks(blocks: list[tuple[str, str, int, list[list[str]]]]) -> list[str]:
    """Text under each heading, with the headings above it in front; headings of levels 1 to 6 count."""
    out, above, body = [], [], ""

    def close() -> None:
        if body and above:
            out.append("\n".join(t for _, t in above) + "\n" + body)

    for kind, text, level, _ in blocks:
        if kind != "paragraph":
            continue
        text = text.replace("　", " ").strip()
        if 0 < level <= 6 and text:
            close()
            body = ""
            while above and above[-1][0] >= level:
                above.pop()
            above.append((level, text))
        else:
            body += "\n" + text
    close()
    return out


def rows_as_html(rows: list[list[str]]) -> str:
    """A table whose equal neighbours in a row are one spanning cell."""
    html = []
    for row in rows:
        cells, at = [], 0
        while at < len(row):
            end = at + 1
            while end < len(row) and row[end] == row[at]:
                end += 1
            cells.append(f"<td>{row[at]}</td>" if end == at + 1 else f"<td colspan='{end - at}'>{row[at]}</td>")
            at = end
        html.append("<tr>" + "".join(cells) + "</tr>")
    return "<table>" + "".join(html) + "</table>"


# ------------------------------------------------------------------ XLSX


def xlsx_cells(blob: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of filled cells, from 0."""
    out = []
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        shared = _part(z, "xl/sharedStrings.xml")
        strings = [] if shared is None else ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in shared.findall(f"{S}si")]
        links = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in _part(z, "xl/_rels/workbook.xml.rels")}
        for sheet in _part(z, "xl/workbook.xml").iter(f"{S}sheet"):
            root = _part(z, "xl/" + links[sheet.get(f"{R}id")])
            for i, row in enumerate(root.iter(f"{S}row")):
                r = int(row.get("r", i + 1)) - 1
                for j, c in enumerate(row.findall(f"{S}c")):
                    ref = re.match("[A-Z]+", c.get("r", ""))
                    column = j
                    if ref:
                        column = 0
                        for letter in ref.group():
                            column = column * 26 + ord(letter) - 64
                        column -= 1
                    raw, kind = c.find(f"{S}v"), c.get("t")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{S}t"))
                    elif raw is None or raw.text is None:
                        continue
                    else:
                        value = strings[int(raw.text)] if kind == "s" else {"1": "True", "0": "False"}.get(raw.text, raw.text) if kind == "b" else raw.text
                    out.append((sheet.get("name"), r, column, value))
    return out


def sheet_tables(cells: DataFrame, key: str, rows_each: int = 256) -> DataFrame:
    """key, sheet, part, html: tables of so many data rows under the sheet's first row as header.

    A sheet of n data rows has n div rows_each + 1 parts, so an exact multiple ends with a part that is only a header.
    """
    place = [key, "sheet"]
    size = cells.groupBy(*place).agg((F.max("row") - F.min("row")).alias("n"), F.min("row").alias("top"), F.max("col").alias("wide"))
    grid = size.select(*place, "top", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("r"), F.sequence(F.lit(0), F.col("wide").cast("int")).alias("cols"))
    grid = grid.select(*place, "top", "n", "r", F.explode("cols").alias("col"))
    own = cells.withColumnRenamed("row", "_row").select(*place, "_row", "col", "value")
    full = grid.join(own.join(size.select(*place, "top"), place).withColumn("r", F.col("_row") - F.col("top")).drop("top", "_row"), [*place, "r", "col"], "left")
    tag = F.when(F.col("r") == 0, "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), F.coalesce("value", F.when(F.col("r") == 0, F.lit("None")).otherwise(F.lit(""))), F.lit("</"), tag, F.lit(">"))
    lines = full.groupBy(*place, "n", "r").agg(F.array_sort(F.collect_list(F.struct("col", cell.alias("h")))).alias("c"))
    lines = lines.select(*place, "n", "r", F.concat(F.lit("<tr>"), F.array_join(F.transform("c", lambda x: x["h"]), ""), F.lit("</tr>")).alias("line"))
    heads = lines.where("r = 0").select(*place, F.col("line").alias("head"), F.explode(F.sequence(F.lit(0), F.expr(f"n div {rows_each}").cast("int"))).alias("part"))
    body = lines.where("r > 0").groupBy(*place, F.expr(f"(r - 1) div {rows_each}").cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("b"))
    inner = F.coalesce(F.array_join(F.transform("b", lambda x: x["line"]), ""), F.lit(""))
    return heads.join(body, [*place, "part"], "left").select(*place, "part", F.concat(F.lit("<table><caption>"), "sheet", F.lit("</caption>"), "head", inner, F.lit("</table>\n")).alias("html"))


def sheet_lines(cells: DataFrame, key: str) -> DataFrame:
    """key, sheet, row, line: `header：value` of filled cells; the sheet's name ends the line unless it says nothing."""
    place = [key, "sheet"]
    top = cells.groupBy(*place).agg(F.min("row").alias("top"))
    rows = cells.join(top, place)
    head = rows.where("row = top").select(*place, "col", F.col("value").alias("name"))
    filled = rows.where((F.col("row") > F.col("top")) & ~F.col("value").isin("", "0", "0.0", "False"))
    field = F.concat(F.coalesce(F.concat("name", F.lit("：")), F.lit("")), "value")
    packed = filled.join(head, [*place, "col"], "left").groupBy(*place, "row").agg(F.array_sort(F.collect_list(F.struct("col", field.alias("f")))).alias("x"))
    tail = F.when(F.contains(F.lower("sheet"), F.lit("sheet")), F.lit("")).otherwise(F.concat(F.lit(" ——"), "sheet"))
    return packed.select(*place, "row", F.concat(F.array_join(F.transform("x", lambda f: f["f"]), "; "), tail).alias("line"))


# ------------------------------------------------------------------ PPTX


def _at(shape: X.Element) -> tuple[int, int]:
    off = shape.find(f".//{A}off")
    return (int(off.get("y")) // 10, int(off.get("x"))) if off is not None else (0, 0)


def _paragraphs(body: X.Element) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in body.iter(f"{A}p"))


def _shape_text(shape: X.Element) -> str:
    table = shape.find(f".//{A}tbl")
    if shape.tag == f"{P}grpSp":
        return "\n".join(t for t in map(_shape_text, sorted(_shapes(shape), key=_at)) if t)
    if table is not None:
        rows = [[_paragraphs(tc) for tc in tr.findall(f"{A}tc")] for tr in table.findall(f"{A}tr")]
        return "\n".join("; ".join(f"{h}: {v}" for h, v in zip(rows[0], row)) for row in rows[1:])
    body = shape.find(f"{P}txBody")
    return _paragraphs(body) if body is not None else ""


def _shapes(tree: X.Element) -> list[X.Element]:
    return [x for x in tree if x.tag in (f"{P}sp", f"{P}grpSp", f"{P}graphicFrame")]


def pptx_slides(blob: bytes) -> list[str]:
    """Text of each slide, shapes from top to bottom and left to right."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        links = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("ppt/") for r in _part(z, "ppt/_rels/presentation.xml.rels")}
        order = [links[s.get(f"{R}id")] for s in _part(z, "ppt/presentation.xml").iter(f"{P}sldId")]
        trees = [_part(z, f"ppt/{name}").find(f"{P}cSld/{P}spTree") for name in order]
        return ["\n".join(t for t in map(_shape_text, sorted(_shapes(tree), key=_at)) if t) for tree in trees]


# ------------------------------------------------------------------ rows


def _rows(spark: SparkSession, path: str, glob: str, read: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    kinds = {"string": pa.string(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [(p, *r) for r in read(blob)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*found), fields, strict=True)], [n for n, _ in fields])

    return files.select("path", "content").mapInArrow(work, schema)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, "*.xlsx", xlsx_cells, "path string, sheet string, row int, col int, value string")


def read_slides(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, "*.pptx", lambda b: list(enumerate(pptx_slides(b))), "path string, slide int, text string")


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, "*.docx", lambda b: list(enumerate(outline_chunks(docx_blocks(b)))), "path string, idx int, text string")


def read_docx_tables(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, "*.docx", lambda b: list(enumerate(rows_as_html(r) for k, _, _, r in docx_blocks(b) if k == "table")), "path string, idx int, html string")
