"""Citing chunks in answers: sentences, their likeness to chunks, marks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The first threshold, its factor when nothing reaches it, and the least.
FIRST, FACTOR, LEAST = 0.63, 0.8, 0.3
MARK = re.compile(r"[^|][；。？!！\n]|[a-z][.?;!][ \n]")


def sentences(answer: str) -> list[str]:
    """Parts of an answer that join to it again; a fenced block is one part."""
    out: list[str] = []
    for i, part in enumerate(re.split(r"(```.*?(?:```|$))", answer, flags=re.S)):
        if i % 2:
            out.append(part)
            continue
        begin = 0
        for m in MARK.finditer(part):
            end = m.end() - (len(m.group()) == 3)  # the blank after a mark opens the next part
            out.append(part[begin:end])
            begin = end
        if begin < len(part):
            out.append(part[begin:])
    return [p for p in out if p]


def thresholds() -> list[float]:
    out, t = [], FIRST
    while t > LEAST:
        out.append(t)
        t *= FACTOR
    return out


def cite(likeness: DataFrame, answer: str, sentence: str, chunk: str, most: int = 4) -> DataFrame:
    """answer, sentence, chunk: which chunks each sentence cites.

    likeness: answer, sentence, chunk, sim. The highest threshold that any sentence of the answer reaches
    counts; a sentence cites chunks within one hundredth of its best, at most four; each chunk once, where first.
    """
    best = W.partitionBy(answer, sentence)
    rows = likeness.withColumn("_top", F.max("sim").over(best) * 0.99)
    levels = F.array(*[F.lit(t) for t in thresholds()])
    reached = F.array_max(F.filter(levels, lambda t: F.col("_best") >= t))
    bar = rows.groupBy(answer).agg(F.max("_top").alias("_best")).withColumn("_bar", reached).where("_bar IS NOT NULL").select(answer, "_bar")
    near = rows.join(bar, answer).where((F.col("_top") >= F.col("_bar")) & (F.col("sim") > F.col("_top")))
    few = near.withColumn("_r", F.row_number().over(best.orderBy(F.desc("sim"), chunk))).where(F.col("_r") <= most)
    first = F.row_number().over(W.partitionBy(answer, chunk).orderBy(sentence))
    return few.withColumn("_f", first).where("_f = 1").select(answer, sentence, chunk)


def marked(parts: DataFrame, cites: DataFrame, answer: str, sentence: str, chunk: str, text: str) -> DataFrame:
    """answer, text: the sentences in order, each followed by the marks of what it cites."""
    marks = cites.groupBy(answer, sentence).agg(F.array_join(F.transform(F.array_sort(F.collect_list(chunk)), lambda c: F.concat(F.lit(" ##"), c.cast("string"), F.lit("$$"))), "").alias("_m"))
    rows = parts.join(marks, [answer, sentence], "left").select(answer, sentence, F.concat(text, F.coalesce("_m", F.lit(""))).alias("_t"))
    packed = rows.groupBy(answer).agg(F.array_sort(F.collect_list(F.struct(sentence, "_t"))).alias("_p"))
    return packed.select(answer, F.array_join(F.transform("_p", lambda p: p["_t"]), "").alias("text"))
