"""Tables from recognised boxes, and tables as sentences. Each works on one table or document at a time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def bands(starts: np.ndarray, ends: np.ndarray, slack: float = 0.5) -> np.ndarray:
    """Number of the row (or column) of each box: boxes that overlap a band by half their size belong to it."""
    order = np.argsort(starts, kind="stable")
    out, bottom, band = np.zeros(len(starts), int), -np.inf, -1
    for i in order:
        if bottom - starts[i] < slack * max(ends[i] - starts[i], 1e-9):
            band += 1
            bottom = ends[i]
        else:
            bottom = max(bottom, ends[i])
        out[i] = band
    return out


def grid(boxes: DataFrame, table: list[str]) -> DataFrame:
    """Adds row and col, from the boxes' tops and left edges."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(row=bands(pdf["top"].to_numpy(), pdf["bottom"].to_numpy()), col=bands(pdf["x0"].to_numpy(), pdf["x1"].to_numpy()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema)
    return boxes.groupBy(*table).applyInPandas(place, f"{fields}, row int, col int")


def header_rows(kinds: list[list[str]]) -> list[int]:
    """Row 0, and where most cells of a table are numbers every row that mostly isn't."""
    body = Counter(k for row in kinds[1:] for k in row)
    main = body.most_common(1)[0][0] if body else ""
    if main != "Nu":
        return [0]
    return [0] + [r for r in range(1, len(kinds)) if kinds[r] and Counter(kinds[r]).most_common(1)[0][0] != main]


def sentences(rows: list[list[str]], kind: Callable[[str], str]) -> list[str]:
    """Each data row as `header: value;...`, the headers being the block of header rows nearest above; narrow tables as one text."""
    if len(rows) < 2:
        return []
    heads = header_rows([[kind(c) for c in row] for row in rows])
    out = []
    for i, row in enumerate(rows):
        if i in heads:
            continue
        above = [h for h in heads if h < i]
        while len(above) > 1 and above[-1] - above[0] >= len(above):
            above = above[1:]
        cells = []
        for j, value in enumerate(row):
            if value:
                names = list(dict.fromkeys(rows[h][j].strip() for h in above if j < len(rows[h])))
                name = ",".join(names)
                cells.append((f"{name}: " if name else "") + value)
        out.append(";".join(cells))
    return out if len(rows[0]) > 3 else ["\n".join(out)]


def merge_lines(boxes: DataFrame, page: list[str], line_height: str) -> DataFrame:
    """Boxes of one layout part on one line become one box, texts in order; a line's boxes lie within a third of its height."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["layoutno", "top", "x0"], kind="stable")
        out: list[dict] = []
        for b in pdf.to_dict("records"):
            last = out[-1] if out else None
            if last and last["layoutno"] == b["layoutno"] and abs((last["top"] + last["bottom"] - b["top"] - b["bottom"]) / 2) < b[line_height] / 3 and b["x0"] >= last["x0"]:
                last |= {"x1": max(last["x1"], b["x1"]), "top": min(last["top"], b["top"]), "bottom": max(last["bottom"], b["bottom"]), "text": last["text"] + b["text"]}
            else:
                out.append(b)
        return pd.DataFrame(out, columns=pdf.columns)

    return boxes.groupBy(*page).applyInPandas(fold, boxes.schema)


def clean_layouts(boxes: DataFrame, page: list[str], threshold: float = 0.7) -> DataFrame:
    """Of two boxes of one type of which one covers most of the other, the better scored stays (ties: the larger)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        size = lambda b: max(b["x1"] - b["x0"], 0) * max(b["bottom"] - b["top"], 0)
        for b in sorted(pdf.to_dict("records"), key=lambda b: (-b["score"], -size(b))):
            clash = False
            for k in kept:
                wide, high = min(b["x1"], k["x1"]) - max(b["x0"], k["x0"]), min(b["bottom"], k["bottom"]) - max(b["top"], k["top"])
                shared = max(wide, 0) * max(high, 0)
                clash = clash or b["type"] == k["type"] and shared >= threshold * max(min(size(b), size(k)), 1e-9)
            if not clash:
                kept.append(b)
        return pd.DataFrame(kept, columns=pdf.columns).sort_values(["top", "x0"], kind="stable")

    return boxes.groupBy(*page).applyInPandas(fold, boxes.schema)
