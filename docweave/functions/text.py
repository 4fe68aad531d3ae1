"""Column functions on text. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip removes at the ends, as a Java regular expression class.
BLANK = r"[\s\x1c-\x1f]"
CJK = "\\u4e00-\\u9fff"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row, however often and in whatever inner lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return strip(F.regexp_replace(text, rf"(?U){BLANK}+", " "))


def squeeze(text: Column) -> Column:
    """No white space at all, lower case: the form in which answers and keywords are compared."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U){BLANK}+", ""))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def stable_id(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("::", *parts).cast("binary"))


def n_windows(length: Column, size: int, step: int) -> Column:
    """How many windows of `size` a text needs, one starting every `step`, the last reaching the end."""
    return F.when(length == 0, F.lit(0)).when(length <= size, F.lit(1)).otherwise(F.ceil((length - size) / F.lit(float(step))).cast("int") + 1)


def windows(text: Column, size: int = 800, overlap: int = 120) -> Column:
    """Array of the text's sliding character windows, trimmed, without empty ones.

    The text is cut into blocks of one step first, so a window costs its own length wherever it lies.
    """
    size = max(1, size)
    step = size - max(0, min(overlap, size - 1))
    blocks = -(-size // step)

    def cut(v: Column) -> Column:
        n = n_windows(v["n"], size, step)
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, lambda i: strip(F.substring(F.array_join(F.slice(v["b"], i, F.lit(blocks)), ""), 1, size))), lambda w: w != "")

    parts = lambda t: F.struct(F.length(t).alias("n"), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("b"))
    return bound(bound(strip(F.coalesce(text, F.lit(""))), parts), cut)


def latin_or_cjk(text: Column) -> Column:
    """Lower-case words of ASCII letters, digits and underscores, and single CJK characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[A-Za-z0-9_]+|[{CJK}]"), F.lit(0))


def hash_tokens(text: Column) -> Column:
    """Tokens for feature hashing: words and CJK characters, else every character."""
    found = latin_or_cjk(text)
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(F.size(found) > 0, found).otherwise(characters)


def hash_slot(token: Column, dim: int) -> Column:
    """First four bytes of the token's md5 as a little-endian number, modulo dim."""
    h = F.md5(token.cast("binary"))
    swapped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.pmod(F.conv(swapped, 16, 10).cast("long"), F.lit(dim)).cast("int")


def hash_sign(token: Column) -> Column:
    """Plus one if the fifth byte of the md5 is even, else minus one."""
    low = F.conv(F.substring(F.md5(token.cast("binary")), 10, 1), 16, 10).cast("int")
    return F.when(low % 2 == 0, F.lit(1)).otherwise(F.lit(-1))


#: Tokens the lexical index drops.
LEXICAL_STOPWORDS = ("的", "了", "和", "或", "及", "以及", "与", "在", "是", "为", "下", "中", "上", "对", "按", "把", "请", "根据", "这个", "本次")
#: Tokens the keyword re-rank drops.
KEYWORD_STOPWORDS = ("的", "了", "是", "和", "与", "及", "在", "有", "吗", "么", "什么", "如何")


def cjk_bigrams(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))
    return F.flatten(pairs)


def lexical_tokens(text: Column, segments: Column | None = None) -> Column:
    """Multiset of index tokens: technical words, the segmenter's words if given, and CJK character pairs."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(F.lower(t), F.lit(r"[A-Za-z0-9_./%*-]+"), F.lit(0))
    parts = [words] + ([segments] if segments is not None else []) + [cjk_bigrams(t)]
    keep = F.array(*[F.lit(w) for w in LEXICAL_STOPWORDS])
    return F.filter(F.concat(*parts), lambda w: w.rlike(f"[A-Za-z0-9{CJK}]") & ~F.array_contains(keep, w))


def keywords(text: Column, drop: tuple[str, ...] = KEYWORD_STOPWORDS) -> Column:
    """Distinct query terms for substring matching."""
    found = F.array_distinct(latin_or_cjk(F.coalesce(text, F.lit(""))))
    return F.array_except(found, F.array(*[F.lit(w) for w in drop])) if drop else found


def keyword_share(terms: Column, text: Column) -> Column:
    """Share of the terms found in the lower-cased text as substrings; 0 without terms or text."""
    hits = bound(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t))))
    return F.when((F.size(terms) == 0) | (F.coalesce(text, F.lit("")) == ""), F.lit(0.0)).otherwise(hits.cast("double") / F.size(terms))


def overlap_share(query: Column, text: Column) -> Column:
    """Share of a query's words (repeats counted) that the text has too; 0 without words."""
    words = lambda t: F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(f"[{CJK}]|[A-Za-z0-9]+"), F.lit(0))

    def share(v: Column) -> Column:
        met = F.size(F.filter(v["q"], lambda w: F.array_contains(v["t"], w)))
        return F.when(F.size(v["q"]) == 0, F.lit(0.0)).otherwise(met.cast("double") / F.size(v["q"]))

    return bound(F.struct(words(query).alias("q"), F.array_distinct(words(text)).alias("t")), share)


def fold_width(text: Column) -> Column:
    """Full-width forms to ASCII, the ideographic space to a space."""
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(text, full, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ")


def truncate_utf8(text: Column, most: int) -> Column:
    """At most so many bytes of UTF-8, never half a character."""
    t = F.coalesce(text, F.lit(""))
    cut = F.substring(t.cast("binary"), 1, most)
    whole = F.try_validate_utf8(cut)
    shorter = F.coalesce(*[F.try_validate_utf8(F.substring(t.cast("binary"), 1, most - i)) for i in range(1, 4) if most >= i] or [F.lit("")])
    return F.when(F.octet_length(t) <= most, t).otherwise(F.coalesce(whole, shorter, F.lit("")))


def parse_keywords(text: Column) -> Column:
    """Keywords from a string parted by commas, semicolons or bars."""
    return F.filter(F.transform(F.split(text, "[,，;；|]"), strip), lambda k: k != "")


def json_array_of(text: Column, element: str) -> Column:
    """The JSON array in a model's answer: the whole text, else what lies between the first [ and the last ]."""
    schema = f"array<{element}>"
    inner = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.from_json(text, schema), F.from_json(inner, schema))


def spaceless_cjk(text: Column) -> Column:
    """Drop spaces that touch a character which is neither an ASCII letter nor digit."""
    t = F.regexp_replace(text, r"(?i)([^a-z0-9.,\)>]) +([^ ])", "$1$2")
    return F.regexp_replace(t, r"(?i)([^ ]) +([^a-z0-9.,\(<])", "$1$2")


def preview(text: Column, most: int = 220) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit("...")))
