"""Format-aware splitters: JSON objects, Markdown tables, marks in plain text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _size(value: object) -> int:
    return len(json.dumps(value, ensure_ascii=False))


def _as_objects(value: object) -> object:
    if isinstance(value, list):
        return {str(i): _as_objects(v) for i, v in enumerate(value)}
    if isinstance(value, dict):
        return {k: _as_objects(v) for k, v in value.items()}
    return value


def split_json(value: object, most: int = 2000) -> list[dict]:
    """Objects of at most twice `most` characters that keep the paths of what they hold; lists become objects by index.

    A leaf goes into the running chunk while it fits; otherwise a chunk of some size is closed first.
    """
    limit, least = 2 * most, max(2 * most - 200, 50)
    chunks: list[dict] = [{}]

    def put(path: tuple[str, ...], leaf: object) -> None:
        at = chunks[-1]
        for k in path[:-1]:
            at = at.setdefault(k, {})
        at[path[-1]] = leaf

    def walk(node: object, path: tuple[str, ...]) -> None:
        if not isinstance(node, dict):
            put(path, node) if path else chunks[-1].update({"": node})
            return
        for k, v in node.items():
            used, size = _size(chunks[-1]), _size({k: v})
            if size < limit - used:
                put((*path, k), v)
            else:
                if used >= least:
                    chunks.append({})
                walk(v, (*path, k))

    walk(_as_objects(value), ())
    return chunks if chunks[-1] else chunks[:-1]


def json_chunks(docs: DataFrame, key: str, text: str, most: int = 2000) -> DataFrame:
    """key, idx, chunk of JSON texts."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, json.dumps(c, ensure_ascii=False)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(split_json(json.loads(t), most))]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], [key, "idx", "chunk"])

    return docs.select(key, text).mapInArrow(work, f"{key} {kind}, idx int, chunk string")


#: A pipe table: a row of cells, a rule, rows of cells, with pipes at the edges or only between cells.
BORDERED = r"(?m)^[ \t]*\|[^\n]*\|[ \t]*\n[ \t]*\|(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*(?:\n|$)(?:[ \t]*\|[^\n]*\|[ \t]*(?:\n|$))*"
BORDERLESS = r"(?m)^[ \t]*[^\n|]+\|[^\n]*\n[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+(?:\n|$)(?:[ \t]*[^\n|]+\|[^\n]*(?:\n|$))*"


def markdown_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, tables, remainder: pipe tables of a Markdown text, bordered ones first, and the text without them."""
    first = F.regexp_extract_all(F.col(text), F.lit(BORDERED), F.lit(0))
    rest = F.regexp_replace(text, BORDERED, "")
    second = F.regexp_extract_all(rest, F.lit(BORDERLESS), F.lit(0))
    return docs.select(key, F.concat(first, second).alias("tables"), F.regexp_replace(rest, BORDERLESS, "").alias("remainder"))


def text_chunks(text: str, budget: int, count, separators: str = "\n!?;。；！？") -> list[str]:
    """Parts at each separator, which stays in the text, merged while the running chunk is within budget."""
    out, used = [""], 0
    for part in re.split(f"([{re.escape(separators)}])", text):
        if not part:
            continue
        n = count(part)
        if used > budget:
            out.append(part)
            used = n
        else:
            out[-1] += part
            used += n
    return [c for c in out if c]
