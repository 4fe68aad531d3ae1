"""Reading of document files, evaluation cases and knowledge-base tables."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of text files that are read as they are.
TEXT_EXTENSIONS = ("txt", "md", "markdown", "py", "sql", "csv")
ENCODINGS = ("utf-8", "utf-8-sig", "gbk")


def decode(blob: bytes) -> str:
    """UTF-8, else GBK, else UTF-8 without what doesn't fit; line ends become \\n."""
    for encoding in ENCODINGS:
        try:
            text = blob.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        text = blob.decode("utf-8", "ignore")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def pretty_json(text: str) -> str:
    return json.dumps(json.loads(text), ensure_ascii=False, indent=2)


class _Readable(HTMLParser):
    SKIP = ("script", "style", "nav", "header", "footer", "aside", "noscript", "template")

    def __init__(self) -> None:
        super().__init__()
        self.title, self.parts, self.off, self.in_title = "", [], 0, False

    def handle_starttag(self, tag, attrs):
        self.in_title = tag == "title"
        self.off += tag in self.SKIP
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.in_title = False
        self.off -= tag in self.SKIP and self.off > 0

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.off:
            self.parts.append(data)


def html_lines(text: str) -> list[str]:
    """Title and main content by lines; page furniture (navigation, scripts, headers and footers) is left out."""
    r = _Readable()
    r.feed(text)
    lines = [re.sub(r"\s+", " ", x).strip() for x in "".join(r.parts).split("\n")]
    return [x for x in [r.title.strip(), *lines] if x]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text of all text-like files under a path; other extensions raise an error when their row is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.when(ext.isin("json", "html", "htm", *TEXT_EXTENSIONS), ext).otherwise(F.raise_error(F.concat(F.lit("no text reader for "), F.col("path"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for ext_, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                t = decode(blob)
                texts.append(pretty_json(t) if ext_ == "json" else "\n".join(html_lines(t)) if ext_.startswith("htm") else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["path", "text"])

    return files.select("path", known.alias("ext"), "content").mapInArrow(work, "path string, text string")


def case_rows(text: str, suffix: str) -> tuple[list[dict], tuple[str, ...]]:
    """Rows of a case file and the names its schema declares."""
    text = text.removeprefix("﻿")
    if suffix == "jsonl":
        rows = [json.loads(x) for x in text.splitlines() if x.strip()]
        return [r for r in rows if isinstance(r, dict)], ()
    if suffix == "csv":
        return list(csv.DictReader(io.StringIO(text))), ()
    if suffix != "json":
        raise ValueError(f"no case reader for .{suffix}")
    data = json.loads(text)
    rows = data if isinstance(data, list) else next((data[k] for k in ("cases", "data", "items", "testcases") if data.get(k)), []) if isinstance(data, dict) else []
    schema = data.get("schema") if isinstance(data, dict) else None
    if isinstance(schema, dict):
        inner = schema.get("properties")
        names = tuple(inner if isinstance(inner, dict) else schema)
    else:
        names = tuple(x if isinstance(x, str) else x.get("name") or x.get("key") or x.get("field") for x in schema or [] if isinstance(x, str | dict))
    return [r for r in rows if isinstance(r, dict)], tuple(n for n in names if n)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Canonical evaluation cases of JSON, JSONL or CSV files, in the order of their paths (small files, read one after the other on the driver)."""
    from docweave.operators.evaluation import ALIASES, normalize_cases

    rows: list[dict] = []
    declared: dict[str, None] = {}
    for file, blob in spark.read.format("binaryFile").load(path).select("path", "content").orderBy("path").toLocalIterator():
        more, names = case_rows(blob.decode("utf-8-sig"), file.rsplit(".", 1)[-1].lower())
        rows += more
        declared |= dict.fromkeys(names)
    known = {a for v in ALIASES.values() for a in v}
    said = lambda v: None if v is None else "|".join(map(str, v)) if isinstance(v, list) else str(v)
    flat = [(i, {k: said(v) for k, v in r.items() if k in known}) for i, r in enumerate(rows, 1)]
    names = sorted({k for _, r in flat for k in r})
    df = spark.createDataFrame(flat, "seq long, m map<string,string>").select("seq", *[F.col("m")[n].alias(n) for n in names])
    return normalize_cases(df, tuple(declared))


def latest_run(spark: SparkSession, folder: str, prefix: str = "eval_details_", suffix: str = ".jsonl") -> str | None:
    """The run id in the name of the newest detail file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{suffix}").load(folder)
    newest = files.agg(F.max_by("path", "modificationTime")).first()[0]
    return newest and newest.rsplit("/", 1)[-1].removeprefix(prefix).removesuffix(suffix)


def greatest_number(lines: DataFrame, column: str = "value") -> DataFrame:
    """The greatest whole number in a column of lines; blanks and `nan` are skipped."""
    text = F.trim(F.col(column))
    return lines.where((text != "") & (F.lower(text) != "nan")).agg(F.max(text.try_cast("bigint")).alias("greatest"))
