"""Text boxes of pages: characters to boxes, captions, headings, vertical runs, scraps, spans, HTML of grids."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.operators import geometry

#: How numbered headings and labels start, with their level.
HEADINGS = (
    ("第[零一二三四五六七八九十百]+章", 1),
    ("第[零一二三四五六七八九十百]+[条节]", 2),
    ("[零一二三四五六七八九十百]+[、 　]", 3),
    (r"[\(（][零一二三四五六七八九十百]+[）\)]", 4),
    (r"[0-9]+(、|\.[　 ]|\.[^0-9])", 5),
    (r"[0-9]+\.[0-9]+(、|[. 　]|[^0-9])", 6),
    (r"[0-9]+\.[0-9]+\.[0-9]+(、|[ 　]|[^0-9])", 7),
    (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(、|[ 　]|[^0-9])", 8),
    (".{0,48}[：:?？]$", 9),
    ("[0-9]+）", 10),
    (r"[\(（][0-9]+[）\)]", 11),
    ("[零一二三四五六七八九十百]+是", 12),
    ("[⚫•➢✓]", 12),
)


def heading_level(text: Column) -> Column:
    """Level of a numbered heading, 0 for other texts; one or two characters and plain numbers are none."""
    level = F.when((F.length(text) <= 2) | text.rlike(r"^[0-9 ().,%+/-]+$"), F.lit(0))
    for pattern, n in HEADINGS:
        level = level.when(text.rlike(f"^(?:{pattern})"), F.lit(n))
    return level.otherwise(F.lit(0))


def is_caption(text: Column, layout: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "").rlike("^[图表]+[ 0-9:：]{2,}") | F.contains(F.coalesce(layout, F.lit("")), F.lit("caption"))


def text_of_boxes(chars: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """Adds text to boxes: the characters that lie mostly in each and are about as tall, in reading order.

    chars: page, char_id, text, box columns; boxes: page, box_id, box columns. Characters and boxes meet by page.
    """
    best = geometry.best_overlap(chars, boxes, page, "char_id", "box_id")
    tall = (F.col("c_bottom") - F.col("c_top")).cast("double")
    high = (F.col("bottom") - F.col("top")).cast("double")
    own = chars.select(*page, "char_id", F.col("text").alias("c"), F.col("top").alias("c_top"), F.col("bottom").alias("c_bottom"), F.col("x0").alias("c_x0"))
    joined = best.join(own, [*page, "char_id"]).join(boxes, [*page, "box_id"])
    fits = joined.where((F.abs(tall - high) / F.greatest(tall, high) < 0.7) | (F.col("c") == " "))
    packed = fits.groupBy(*page, "box_id").agg(F.array_sort(F.collect_list(F.struct("c_x0", "char_id", "c"))).alias("_c"))
    text = F.regexp_replace(F.array_join(F.transform("_c", lambda x: x["c"]), ""), r"(?<![0-9a-zA-Zа-яА-Я,.?;:!%]) +", "")
    return boxes.join(packed.select(*page, "box_id", text.alias("text")), [*page, "box_id"], "left")


def component_tags(boxes: DataFrame, parts: DataFrame, page: list[str]) -> DataFrame:
    """box_id with the rows, columns, headers and spans of recognised table parts that cover it best.

    parts: page, part_id, label, box columns; a part counts if it covers more than three tenths of a box.
    """
    out = boxes
    for label, name in (("table row", "R"), ("table column", "C"), ("table column header", "H"), ("table spanning cell", "SP")):
        tagged = geometry.best_overlap(boxes, parts.where(F.col("label") == label), page, "box_id", "part_id", 0.3).select(*page, "box_id", F.col("part_id").alias(name))
        out = out.join(tagged, [*page, "box_id"], "left")
    return out


def vertical_runs(boxes: DataFrame, doc: list[str]) -> DataFrame:
    """Boxes that continue each other downwards become one.

    Sentence ends, other layout parts, wide gaps and boxes side by side part them; an open end or a start with closing
    marks joins them. boxes: doc, page, layoutno, x0, x1, top, bottom, text, line_height, line_width.
    """
    last, first = F.substring(F.rtrim("text"), -1, 1), F.substring(F.ltrim("text"), 1, 1)
    order = W.partitionBy(*doc).orderBy("page", "top", "x0")
    before = lambda c: F.lag(c).over(order)
    rows = boxes.where(F.trim("text") != "").withColumns({"_end": last, "_begin": first})
    open_end = before(F.col("_end")).isin(*",;:'\"，、‘“；：-") | F.col("_begin").isin(*"。；？！?”）),，、：")
    same_page = before(F.col("page")) == F.col("page")
    parted = (before(F.col("layoutno")) != F.col("layoutno")) | before(F.col("_end")).isin(*"。？！?")
    parted |= same_page & (F.col("top") - before(F.col("bottom")) > 1.5 * F.col("line_height"))
    parted |= ~same_page & (F.abs(before(F.col("x0")) - F.col("x0")) > 4 * F.col("line_width"))
    beside = (before(F.col("x1")) < F.col("x0")) | (before(F.col("x0")) > F.col("x1"))
    starts = F.coalesce((parted & ~open_end) | beside, F.lit(True)).cast("int")
    runs = rows.withColumn("_s", starts).withColumn("_run", F.sum("_s").over(order))
    packed = runs.groupBy(*doc, "_run").agg(
        F.min("page").alias("page"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min(F.struct("page", "top"))["top"].alias("top"), F.max(F.struct("page", "bottom"))["bottom"].alias("bottom"),
        F.array_sort(F.collect_list(F.struct("page", "top", "x0", "text"))).alias("_t"),
    )
    return packed.withColumn("text", F.array_join(F.transform("_t", lambda t: t["text"]), "")).drop("_t", "_run")


def without_scraps(groups: DataFrame, page_width: str) -> DataFrame:
    """Line groups that are headed, on average a third of the page or 200 wide. groups: texts, widths, headed."""
    mean = F.aggregate("widths", F.lit(0.0), lambda s, w: s + w) / F.size("widths")
    return groups.where(F.col("headed") | (mean / F.col(page_width) >= 0.35) | (mean > 200))


def spans(cells: pd.DataFrame) -> pd.DataFrame:
    """Adds rowspan and colspan to cells that a spanning area covers: rows and columns whose middle lies in it.

    cells: row, col, x0, x1, top, bottom and h_left, h_right, h_top, h_bottom (null without a spanning area).
    """
    rows = cells.groupby("row").agg(low=("top", "mean"), high=("bottom", "mean"))
    cols = cells.groupby("col").agg(low=("x0", "mean"), high=("x1", "mean"))

    def reach(bands: pd.DataFrame, own: int, low: float, high: float) -> tuple[int, int]:
        mid = (bands.low + bands.high) / 2
        hit = sorted({own, *bands.index[(mid >= low) & (mid <= high)]})
        return hit[0], hit[-1] - hit[0] + 1

    out = cells.copy()
    for i, c in cells.iterrows():
        first_row, down, first_col, wide = c.row, 1, c.col, 1
        if pd.notna(c.h_left):
            first_row, down = reach(rows, c.row, c.h_top, c.h_bottom)
            first_col, wide = reach(cols, c.col, c.h_left, c.h_right)
        out.loc[i, ["row", "col", "rowspan", "colspan"]] = first_row, first_col, down, wide
    return out.astype({"row": int, "col": int, "rowspan": int, "colspan": int})


def grid_html(cells: pd.DataFrame, headers: set[int], caption: str = "") -> str:
    """HTML of a grid; cells that a span covers are left out, their texts join the spanning cell's."""
    wide, high = int((cells.col + cells.colspan).max()), int((cells.row + cells.rowspan).max())
    owner: dict[tuple[int, int], tuple[int, int]] = {}
    text: dict[tuple[int, int], list[str]] = {}
    size: dict[tuple[int, int], tuple[int, int]] = {}
    for c in cells.sort_values(["rowspan", "colspan"], ascending=False, kind="stable").itertuples():
        at = owner.get((c.row, c.col), (c.row, c.col))
        size.setdefault(at, (c.rowspan, c.colspan))
        if c.text not in text.setdefault(at, []):
            text[at].append(c.text)
        for r in range(size[at][0]):
            for k in range(size[at][1]):
                owner.setdefault((at[0] + r, at[1] + k), at)
    lines = [f"<caption>{html.escape(caption)}</caption>"] if caption else []
    for r in range(high):
        tag, parts = "th" if r in headers else "td", []
        for k in range(wide):
            at = owner.get((r, k), (r, k))
            if at == (r, k):
                down, across = size.get(at, (1, 1))
                more = (f' colspan="{across}"' if across > 1 else "") + (f' rowspan="{down}"' if down > 1 else "")
                parts.append(f"<{tag}{more}>{html.escape(' '.join(text.get(at, [])))}</{tag}>")
        lines.append("<tr>" + "".join(parts) + "</tr>")
    return "<table>" + "".join(lines) + "</table>"


def plain_lines(text: str) -> list[str]:
    """Lines of a page's text without blanks, for files that are read as text only."""
    return [x.strip() for x in re.split(r"\n+", text) if x.strip()]
