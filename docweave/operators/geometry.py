"""Boxes on pages: overlaps, best fits, nearest captions, alignment, suppression, decoding of recognised text.

Joins are equi-joins on the page (or document and page), so a group is what one page holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOX = ("x0", "x1", "top", "bottom")


def overlap_area(a: str, b: str) -> Column:
    """Area that two boxes share; a and b are column prefixes."""
    wide = F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0"))
    high = F.least(F.col(f"{a}bottom"), F.col(f"{b}bottom")) - F.greatest(F.col(f"{a}top"), F.col(f"{b}top"))
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(F.lit(0.0)).cast("double")


def area(a: str) -> Column:
    return ((F.col(f"{a}x1") - F.col(f"{a}x0")) * (F.col(f"{a}bottom") - F.col(f"{a}top"))).cast("double")


def overlap_ratio(a: str, b: str) -> Column:
    return F.when(area(a) > 0, overlap_area(a, b) / area(a)).otherwise(F.lit(0.0))


def iou(a: str, b: str) -> Column:
    both = area(a) + area(b) - overlap_area(a, b)
    return F.when(both > 0, overlap_area(a, b) / both).otherwise(F.lit(0.0))


def _sided(df: DataFrame, page: list[str], side: str) -> DataFrame:
    return df.select(*page, *[F.col(c).alias(f"{side}{c}") for c in df.columns if c not in page])


def best_overlap(boxes: DataFrame, others: DataFrame, page: list[str], key: str, other_key: str, least: float = 0.0) -> DataFrame:
    """For each box the box of others that covers most of it (ties: the least key), if it covers more than `least`."""
    pairs = _sided(boxes, page, "a_").join(_sided(others, page, "b_"), page).withColumn("ratio", overlap_ratio("a_", "b_"))
    best = pairs.where(F.col("ratio") > least).groupBy(*page, F.col(f"a_{key}").alias(key)).agg(F.min(F.struct((-F.col("ratio")).alias("r"), F.col(f"b_{other_key}").alias("k"))).alias("m"))
    return best.select(*page, key, F.col("m.k").alias(other_key), (-F.col("m.r")).alias("ratio"))


def nearest(captions: DataFrame, figures: DataFrame, page: list[str], key: str, other_key: str) -> DataFrame:
    """For each caption the figure with the least squared distance between centres (ties: the least key)."""
    mid = lambda s: ((F.col(f"{s}x0") + F.col(f"{s}x1")) / 2.0, (F.col(f"{s}top") + F.col(f"{s}bottom")) / 2.0)
    (ax, ay), (bx, by) = mid("a_"), mid("b_")
    pairs = _sided(captions, page, "a_").join(_sided(figures, page, "b_"), page).withColumn("d", (ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    best = pairs.groupBy(*page, F.col(f"a_{key}").alias(key)).agg(F.min(F.struct("d", F.col(f"b_{other_key}").alias("k"))).alias("m"))
    return best.select(*page, key, F.col("m.k").alias(other_key), F.col("m.d").alias("distance"))


def align_columns(cells: DataFrame, table: list[str]) -> DataFrame:
    """Columns of a table snap to the median edges where a table has more than four of them, else to the mean."""
    w = W.partitionBy(*table, "label")
    many = F.count("*").over(w) > 4
    snapped = lambda c: F.when(many, F.percentile(c, F.lit(0.5)).over(w)).otherwise(F.avg(c).over(w))
    return cells.withColumns({"top": snapped("top"), "bottom": snapped("bottom")})


def page_offsets(pages: DataFrame, doc: str, page: str, height: str) -> DataFrame:
    """Adds the height of all pages before each."""
    before = W.partitionBy(doc).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum(height).over(before), F.lit(0.0)))


def suppress(boxes: DataFrame, group: list[str], threshold: float = 0.45) -> DataFrame:
    """Greedy non-maximum suppression by score within a group (a page and class); ties go to the earlier box."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "box_id"], ascending=[False, True])
        b = pdf[list(BOX)].to_numpy(float)
        size = (b[:, 1] - b[:, 0]) * (b[:, 3] - b[:, 2])
        left, kept = np.arange(len(b)), []
        while len(left):
            i, left = left[0], left[1:]
            kept.append(i)
            wide = np.minimum(b[i, 1], b[left, 1]) - np.maximum(b[i, 0], b[left, 0])
            high = np.minimum(b[i, 3], b[left, 3]) - np.maximum(b[i, 2], b[left, 2])
            shared = np.maximum(wide, 0) * np.maximum(high, 0)
            left = left[shared / np.maximum(size[i] + size[left] - shared, 1e-9) <= threshold]
        return pdf.iloc[kept]

    return boxes.groupBy(*group).applyInPandas(keep, boxes.schema)


def reading_order(boxes: DataFrame, page: list[str], tolerance: float) -> DataFrame:
    """Adds place: rows from top to bottom, boxes of one row (tops within the tolerance of its first) from left to right."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["top", "x0"], kind="stable")
        row, start, rows = -1, None, []
        for top in pdf["top"]:
            if start is None or top - start > tolerance:
                row, start = row + 1, top
            rows.append(row)
        pdf = pdf.assign(_row=rows).sort_values(["_row", "x0"], kind="stable")
        return pdf.drop(columns="_row").assign(place=range(len(pdf)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema)
    return boxes.groupBy(*page).applyInPandas(order, f"{fields}, place int")


def decode_steps(steps: DataFrame, key: str, charset: str) -> DataFrame:
    """Greedy CTC decoding: drop repeats, then blanks (index 0). steps: key, pos, idx, prob. Gives text and mean confidence."""
    before = F.lag("idx").over(W.partitionBy(key).orderBy("pos"))
    kept = steps.withColumn("_b", before).where((F.col("idx") != 0) & (F.coalesce(F.col("_b"), F.lit(-1)) != F.col("idx")))
    letters = F.substring(F.lit(charset), F.col("idx").cast("int"), F.lit(1))
    read = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", letters.alias("c")))).alias("_c"), F.avg("prob").alias("confidence"))
    return read.select(key, F.array_join(F.transform("_c", lambda c: c["c"]), "").alias("text"), "confidence")


def repeated_texts(boxes: DataFrame, doc: str, kinds: tuple[str, ...] = ("header", "footer", "reference")) -> DataFrame:
    """Boxes without those of page furniture whose text occurs more than once in the document."""
    often = boxes.where(F.col("layout_type").isin(*kinds)).groupBy(doc, "text").agg(F.count("*").alias("n")).where("n > 1").select(doc, "text")
    marked = boxes.where(F.col("layout_type").isin(*kinds)).join(often, [doc, "text"], "left_anti")
    return boxes.where(~F.col("layout_type").isin(*kinds)).unionByName(marked)


def contents_pages(lines: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Lines of pages that aren't tables of contents: no more than three dot leaders on a page."""
    dotted = F.col(text).rlike(r"(\.{6,}|·{3,}|…{2,})")
    toc = lines.groupBy(doc, page).agg(F.sum(dotted.cast("int")).alias("n")).where("n > 3").select(doc, page)
    return lines.join(toc, [doc, page], "left_anti")


def position_tag(prefix: str = "") -> Column:
    return F.format_string("@@%d\t%.1f\t%.1f\t%.1f\t%.1f##", *[F.col(f"{prefix}{c}") for c in ("page", "x0", "x1", "top", "bottom")])


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"@@[\t0-9.-]+?##", "")


def order_points(points: np.ndarray) -> np.ndarray:
    """Four corner points clockwise from the top left."""
    s, d = points.sum(1), points[:, 1] - points[:, 0]
    return points[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]]


def batches_by_ratio(sizes: list[tuple[int, int]], most: int = 16) -> Iterator[list[int]]:
    """Places of images in batches of similar aspect ratio, so that padding stays small."""
    order = sorted(range(len(sizes)), key=lambda i: sizes[i][0] / max(sizes[i][1], 1))
    for at in range(0, len(order), most):
        yield order[at : at + most]
