"""Numbering styles, title levels and section runs of the lines of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Families of numbering, each from the highest level to the lowest.
FAMILIES = (
    (
        r"第[零一二三四五六七八九十百0-9]+(分?编|部分)",
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"第[零一二三四五六七八九十百0-9]+条",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
    ),
    (
        r"第[0-9]+章",
        r"第[0-9]+节",
        r"[0-9]{0,2}[\. 、]",
        r"[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-]",
        r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}",
        r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}",
    ),
    (
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"[零一二三四五六七八九十百]+[ 、]",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
        r"[\(（][0-9]{0,2}[\)）]",
    ),
    (
        r"PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)",
        r"Chapter (I+V?|VI*|XI|IX|X)",
        r"Section [0-9]+",
        r"Article [0-9]+",
    ),
)
#: Beginnings of lines that look numbered but aren't.
NOT_BULLETS = (r"0", r"[0-9]+ +[0-9~个只-]", r"[0-9]+\.{2,}")
NOT_BULLET = "^(?:" + "|".join(NOT_BULLETS) + ")"
#: Fixed value: an article is a title whatever its length.
ARTICLE = r"第[零一二三四五六七八九十百0-9]+条"


def _starts(line: Column, pattern: str) -> Column:
    return line.rlike(f"^(?:{pattern})")


def is_bullet(line: Column, family: int) -> Column:
    any_of = "|".join(f"(?:{p})" for p in FAMILIES[family])
    return _starts(line, any_of) & ~line.rlike(NOT_BULLET)


def family_votes(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """key, family: the family with most numbered lines, the first of equals; -1 if no line is numbered."""
    sums = [F.sum(is_bullet(F.col(line), i).cast("int")).alias(f"_{i}") for i in range(len(FAMILIES))]
    voted = lines.groupBy(key).agg(*sums)
    best = F.array_max(F.array(*[F.struct(F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("n"), F.lit(-i).alias("i")) for i in range(len(FAMILIES))]))
    return voted.select(key, F.when(best["n"] > 0, -best["i"]).otherwise(F.lit(-1)).alias("family"), *[F.col(f"_{i}").alias(f"votes_{i}") for i in range(len(FAMILIES))])


def not_title(text: Column) -> Column:
    long = (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) > 12) | (~F.contains(text, F.lit(" ")) & (F.length(text) >= 32))
    return ~_starts(text, ARTICLE) & (long | text.rlike("[,;，。；！!]"))


def title_level(line: Column, layout: Column, family: int) -> Column:
    """Level within the family (0 the highest), the family's size for other titles, one more for the rest."""
    trimmed = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    size = len(FAMILIES[family])
    level = F.when(F.lit(False), F.lit(0))
    for j, p in enumerate(FAMILIES[family]):
        level = level.when(_starts(trimmed, p) & ~line.rlike(NOT_BULLET), F.lit(j))
    headed = layout.rlike("(title|head)") & ~not_title(F.get(F.split(line, "@"), 0))
    return level.when(headed, F.lit(size)).otherwise(F.lit(size + 1))


def common_level(levels: DataFrame, key: str, order: str, family: int) -> DataFrame:
    """key, most_level: the most frequent title level, the first seen of equals; size + 1 if there is no title."""
    size = len(FAMILIES[family])
    counted = levels.groupBy(key, "level").agg(F.count("*").alias("c"), F.min(order).alias("first"))
    best = F.min(F.when(F.col("level") <= size, F.struct((-F.col("c")).alias("c"), "first", "level")))
    return counted.groupBy(key).agg(F.coalesce(best["level"], F.lit(size + 1)).alias("most_level"))


def section_ids(levels: DataFrame, key: str, order: str, most: str = "most_level") -> DataFrame:
    """Adds section: it goes up where a line's level is no deeper than the common one and differs from the line before."""
    w = W.partitionBy(key).orderBy(order)
    opens = (F.col("level") <= F.col(most)) & (F.col("level") != F.coalesce(F.lag("level").over(w), F.col("level")))
    return levels.withColumn("_o", opens.cast("int")).withColumn("section", F.sum("_o").over(w)).drop("_o")


def pair_likeness(a: Column, b: Column) -> Column:
    """Shared character pairs over the larger number of pairs."""
    pairs = lambda t: F.array_distinct(F.when(F.length(t) > 1, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))
    return F.size(F.array_intersect(pairs(a), pairs(b))) / F.greatest(F.size(pairs(a)), F.size(pairs(b)), F.lit(1)).cast("double")


def is_english(texts: Column) -> Column:
    """More than four of five texts start with a Latin letter or common mark."""
    latin = F.filter(texts, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "").rlike(r"""^[ `a-zA-Z.,':;/"?<>!\(\)-]"""))
    return F.when(F.size(texts) > 0, F.size(latin) > 0.8 * F.size(texts)).otherwise(F.lit(False))


#: Kinds of cell contents, in order of precedence.
BLOCK_KINDS = (
    ("^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$", "Dt"),
    (r"^(20|19)[0-9]{2}年$", "Dt"),
    (r"^(20|19)[0-9]{2}[年-][0-9]{1,2}月*$", "Dt"),
    ("^[0-9]{1,2}[月-][0-9]{1,2}日*$", "Dt"),
    (r"^第*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}年*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}[ABCDE]$", "Dt"),
    ("^[0-9.,+%/ -]+$", "Nu"),
    (r"^[0-9A-Z/\._~-]+$", "Ca"),
    (r"^[A-Z]*[a-z' -]+$", "En"),
    (r"^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()' -]+$", "NE"),
    (r"^.{1}$", "Sg"),
)


def block_kind(text: Column, tokens: Column | None = None, tag: Column | None = None) -> Column:
    """Kind of a cell: a matched class of its trimmed text, else by its number of words: short or long text, or a lone person's name.

    tokens: a segmenter's words, if there are any; tag: the word class of the cell's only word of more than one character.
    """
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    kind = F.when(F.lit(False), F.lit(""))
    for pattern, name in BLOCK_KINDS:
        kind = kind.when(trimmed.rlike(pattern), F.lit(name))
    words = F.size(F.filter(F.split(text, r"\s+") if tokens is None else tokens, lambda w: F.length(w) > 1))
    kind = kind.when((words > 3) & (words < 12), F.lit("Tx")).when(words > 3, F.lit("Lx"))
    return (kind if tag is None else kind.when((words == 1) & (tag == "nr"), F.lit("Nr"))).otherwise(F.lit("Ot"))
