"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its white-space-separated tokens; a blank line has none and always stays. A line goes if an
earlier line (by doc_id, then line number, whether or not that one goes as well) has a Jaccard similarity of at least
`percent` hundredths.

1. Token counts of the whole table, in 2**18 hashed classes, give the order of rarity. Any one order is correct; the
   classes only make the table of counts bounded, so that it can be one value: that of a scalar subquery, as a literal of
   so many numbers would be spelt out in each of the driver's plan descriptions.
2. Each line keeps its prefix: its rarest tokens, so many that two similar lines must share one.
3. Lines of equal sets fall together by their keys, pre-aggregated before the shuffle; the earliest of each set goes on.
4. Prefixes join by token. A pair is met at the rarest token that both share, where nothing before it is shared; so the
   positional filter asks whether what follows in both lines can still hold enough. With it go the length filter and a
   parity filter (two sets' parity bitmaps differ in at most as many of 128 bits as tokens are in one set only). A line
   that passes them with its token's earliest line, and looks like it, is compared with that one only; a group of near
   copies thus gives a pair for each member, not for each two.
5. Pairs are verified on the whole token sets. Lines whose comparison with an earliest line failed, and that nothing else
   matched, meet all their candidates in a second join.
6. What goes of each document is joined to it by its number: broadcast while it is small, else in a shuffle that moves
   each text once.

Tokens are compared by 64-bit hashes throughout, equal sets by 64 hashed bits, the parity bitmap and the size.

Defined results: null text has no lines and stays null; documents that lose every line keep an empty text in
`deduplicate` (and `lines_left` 0); a null doc_id sorts before all others; rows that share a doc_id, null or not, are
documents of their own, ordered by a hash of their texts, equal ones in any order (so of a repeated row one copy keeps
its lines); an empty table gives no rows. Memory and time grow in proportion to a line's and a document's length; a very
long text is split once to compare and once to cut. Further columns are passed through, but for those named like the
three that are added.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.llm.shared import SPACE_PATTERN, discard, discarding, materialize

CLASS_BITS = 18
NO_ID = -(1 << 63)
#: Bitmaps of unrelated long lines differ in about 64 of 128 bits; at most so many count as looking alike.
NEAR_BITS = 36


@dataclass(frozen=True)
class LineSettings:
    percent: int = 80
    passes: int = 2  # the join runs over one share of the tokens after the other, so its shuffle takes that share of the disk
    broadcast_bytes: int = 16 << 20


def _words(line: Column) -> Column:
    """Tokens, and perhaps empty strings; the regular expression is needed only where other blanks than spaces are."""
    odd = reduce(lambda a, b: a | b, [F.contains(line, F.lit(c)) for c in "\t\x0b\f\r"])
    return F.when(odd, F.split(line, SPACE_PATTERN)).otherwise(F.split(line, " "))


def _hashes(line: Column) -> Column:
    """Hashes of the distinct tokens of a line."""
    return F.array_remove(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _class(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - CLASS_BITS).cast("int")


def rarity(docs: DataFrame) -> tuple[DataFrame, Callable[[Column, Column], Column], int]:
    """A written table of one row and column, the ranks; a function from those and a token's hash to its order; the order of the empty string.

    The class of a token is the top bits of its hash; classes are ranked by their counts over the whole table, and the
    order is the hash with its class replaced by the class's rank. That is one to one, so no two hashes meet. Only the
    empty string's class is ranked where half of the table's tokens are behind it, so that its order parts the rarer ones from the commoner.
    """
    n = 1 << CLASS_BITS
    tokens = _lines(docs).select(F.explode(_words(F.col("line"))).alias("t")).where("t <> ''")
    counts = [0] * n
    # four classes a group, so that the groups of a task fit the small map that aggregations try first
    four = tokens.select(_class(F.xxhash64("t")).alias("c")).groupBy(F.shiftright("c", 2).alias("g")).agg(*[F.count(F.when(F.col("c").bitwiseAND(3) == j, 1)).alias(f"n{j}") for j in range(4)])
    for g, *k in four.collect():  # at most 2**(CLASS_BITS - 2) rows
        counts[4 * g : 4 * g + 4] = k
    swap = [0] * n
    empty = docs.sparkSession.sql("SELECT xxhash64('')").first()[0]
    own = (empty >> (64 - CLASS_BITS)) & (n - 1)
    ranked = sorted((c for c in range(n) if c != own), key=counts.__getitem__)
    half, upto = (sum(counts) - counts[own]) / 2, [0, *accumulate(counts[c] for c in ranked)]
    ranked.insert(bisect_left(upto, half), own)
    for rank, c in enumerate(ranked):
        flipped = rank ^ (n >> 1)  # the flipped top bit makes signed order the order of ranks
        swap[c] = flipped ^ c
    middle = empty ^ (swap[own] - (n if swap[own] >= n >> 1 else 0)) << (64 - CLASS_BITS)
    held = pa.table({"ranks": pa.array([swap], pa.list_(pa.int32()))})  # from Arrow no Python worker makes the row
    ranks = materialize(docs.sparkSession.createDataFrame(held), "token-ranks")
    # never null, so that arrays of orders sort as plain numbers; in ANSI mode the optimizer sees that and drops the coalesce
    return ranks, lambda table, h: h.bitwiseXOR(F.call_function("shiftleft", F.coalesce(table[F.shiftrightunsigned(h, 64 - CLASS_BITS)], F.lit(0)).cast("long"), F.lit(64 - CLASS_BITS))), middle


@dataclass(frozen=True)
class Places:
    """How a line's position, by which lines are ordered, is made of a document and a line number, and taken apart."""

    doc: Column
    pos: Column
    doc_of: Callable[[Column], Column]
    line_of: Callable[[Column], Column]


def places(docs: DataFrame) -> tuple[DataFrame, Places]:
    """Positions of lines. Ids that are unique make one number with the line; else rows get numbers in a written table."""
    known = F.when(F.col("_doc") != NO_ID, F.col("_doc"))
    low, high, most = docs.groupBy("_doc").agg(F.count("*").alias("k")).agg(F.min(known), F.max(known), F.max("k")).first()
    low, high, bits = low or 0, high or 0, 31  # a line number is a positive int
    if (high - low + 2) << bits >= 1 << 62:
        bits = (docs.agg(F.max(F.octet_length("text"))).first()[0] or 1).bit_length()
    if (most or 0) <= 1 and (high - low + 2) << bits < 1 << 62:
        doc = F.when(F.col("_doc") == NO_ID, F.lit(0).cast("long")).otherwise(F.col("_doc") - low + 1)
        return docs, Places(doc, F.shiftleft(doc, bits).bitwiseOR(F.col("line_no").cast("long")), lambda p: F.shiftright(p, bits), lambda p: p.bitwiseAND((1 << bits) - 1).cast("int"))
    docs = materialize(docs.withColumns({"_text_hash": F.xxhash64("text"), "_copy": F.monotonically_increasing_id()}), "line-documents")
    parts = ["_doc", "_text_hash", "_copy"]
    return docs, Places(F.struct(*parts), F.struct(*parts, "line_no"), lambda p: F.struct(*[p[c].alias(c) for c in parts]), lambda p: p["line_no"])


def _lines(docs: DataFrame) -> DataFrame:
    """Every line beside its document's key columns."""
    keys = [c for c in ("_doc", "_text_hash", "_copy") if c in docs.columns]
    return docs.where("text IS NOT NULL").select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def keyed_lines(docs: DataFrame, at: Places, s: LineSettings) -> DataFrame:
    """Every line's position, set size, set key, parity bitmap (64 bits each for the rarer and the commoner tokens) and prefix."""
    ranks, order, middle = rarity(docs)
    # the blank makes an empty string one of each line's words; sorted in among the tokens, it shows where the commoner ones begin
    words = _words(F.concat("line", F.lit(" ")))
    ordered = F.sort_array(F.array_distinct(F.transform(words, lambda w: order(F.col("_ranks"), F.xxhash64(w)))))
    # used once, so the optimizer puts the subquery in the column's place and no row holds the ranks
    lines = _lines(docs).withColumn("_ranks", ranks.scalar()).select(at.pos.alias("pos"), ordered.alias("_o"))
    size, middle = F.size("_o") - 1, F.array_position("_o", F.lit(middle).cast("long")).cast("int")
    lines = lines.select("pos", "_o", size.alias("n"), F.slice("_o", F.lit(1), middle - 1).alias("_rare"), F.slice("_o", middle + 1, size - middle + 1).alias("_often"))
    needed = F.col("n") - F.expr(f"({s.percent} * n + 99) div 100").cast("int") + 1
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int"))
    parity = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(bit(t)))
    return lines.select("pos", "n", F.xxhash64("_o").alias("k"), parity("_rare").alias("b1"), parity("_often").alias("b2"), F.slice(F.concat("_rare", "_often"), F.lit(1), needed).alias("prefix"))


def _n(side: str) -> Column:
    return F.shiftright(F.col(f"{side}ni"), 32)


def _apart(a: str, b: str) -> Column:
    """In how many bits two parity bitmaps differ."""
    return F.bit_count(F.col(f"{a}b1").bitwiseXOR(F.col(f"{b}b1"))) + F.bit_count(F.col(f"{a}b2").bitwiseXOR(F.col(f"{b}b2")))


def _may_match(a: str, b: str, percent: int) -> Column:
    """Positional, length and parity filters; none refuses a similar pair at the rarest token that it shares."""
    both = _n(a) + _n(b)
    behind = F.least(_n(a) - F.col(f"{a}ni").bitwiseAND(0xFFFFFFFF), _n(b) - F.col(f"{b}ni").bitwiseAND(0xFFFFFFFF))
    return ((100 + percent) * behind >= percent * both) & (100 * F.least(_n(a), _n(b)) >= percent * F.greatest(_n(a), _n(b))) & ((100 + percent) * _apart(a, b) <= (100 - percent) * both)


def _few(df: DataFrame, row_bytes: int, s: LineSettings) -> DataFrame:
    """Marked for broadcast if its rows, of at most so many bytes, fit the bound; else joins shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= s.broadcast_bytes else df


def verified(docs: DataFrame, at: Places, pairs: DataFrame, s: LineSettings) -> DataFrame:
    """The later lines of those pairs (later, earlier) whose token sets are similar."""
    named = materialize(pairs.select(F.explode(F.array("later", "earlier")).alias("pos")).distinct(), "line-positions")
    ids = _few(materialize(named.select(at.doc_of(F.col("pos")).alias("_in")).distinct(), "line-docs"), 16, s)
    docs = docs.withColumn("_in", at.doc).join(ids, "_in", "left_semi").drop("_in")  # only documents that hold a named line are split
    lines = _lines(docs).select(at.pos.alias("pos"), "line").join(_few(named, 16, s), "pos", "left_semi")
    sets = materialize(lines.select("pos", _hashes(F.col("line")).alias("set")), "line-sets")
    a, b = sets.select(F.col("pos").alias("later"), F.col("set").alias("sa")), sets.select(F.col("pos").alias("earlier"), F.col("set").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(a, "later").join(b, "earlier").select("later", shared.alias("shared"), (F.size("sa") + F.size("sb")).alias("both"))
    return both.where(f"100 * shared >= {s.percent} * (both - shared)").select("later").distinct()


def later_matches(docs: DataFrame, at: Places, first: DataFrame, s: LineSettings) -> DataFrame:
    """Positions of first lines of a set that match an earlier first line of another."""
    postings = first.select("pos", "n", "b1", "b2", F.posexplode("prefix").alias("i", "token"))
    # a posting: token, position, set size and place in the order (one number), parity bitmap
    postings = postings.select("token", "pos", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long")).alias("ni"), "b1", "b2")
    # said here, as the join below would say it of one side only, and the two sides would not share their shuffle
    postings = postings.where(" AND ".join(f"{c} IS NOT NULL" for c in postings.columns))
    group = W.partitionBy("token").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # its first row is found once

    def candidates(share: DataFrame) -> DataFrame:
        led = share.withColumns({f"l_{c}": F.first(c).over(group) for c in ("pos", "ni", "b1", "b2")})
        # only where the join below makes the pair with the first line, whose failing then shows
        like = (F.col("pos") > F.col("l_pos")) & _may_match("", "l_", s.percent) & (_apart("", "l_") <= NEAR_BITS)
        # a token's first line is later than none
        led = led.withColumn("like_first", like).where("pos > l_pos").drop("l_ni", "l_b1", "l_b2")
        # aliases rather than new names keep the two sides' plans equal below the shuffle, which they share
        a, b = led.alias("a"), share.alias("b")
        meet = (F.col("b.pos") < F.col("a.pos")) & (~F.col("a.like_first") | (F.col("b.pos") == F.col("a.l_pos"))) & _may_match("a.", "b.", s.percent)
        return a.join(b, (F.col("a.token") == F.col("b.token")) & meet).select(F.col("a.pos").alias("later"), F.col("b.pos").alias("earlier"), F.col("a.like_first").alias("like_first"))

    shares = [materialize(candidates(postings.where(F.pmod("token", F.lit(s.passes)) == i)), f"line-candidates-{i}") for i in range(s.passes)]
    pairs = reduce(DataFrame.unionByName, shares).groupBy("later", "earlier").agg(F.max("like_first").alias("like_first"))
    pairs = materialize(pairs, "line-pairs")
    discard(*shares)
    found = materialize(verified(docs, at, pairs, s), "line-matches")
    unsure = materialize(pairs.where("like_first").select("later").distinct().join(found, "later", "left_anti"), "line-unsure")
    if not unsure.limit(1).count():
        return found
    own = materialize(postings.join(_few(unsure.select(F.col("later").alias("pos")), 16, s), "pos", "left_semi"), "unsure-postings")
    a, b = _few(own, 64, s).alias("a"), postings.alias("b")
    meet = (F.col("b.pos") < F.col("a.pos")) & _may_match("a.", "b.", s.percent)
    rest = b.join(a, (F.col("a.token") == F.col("b.token")) & meet).select(F.col("a.pos").alias("later"), F.col("b.pos").alias("earlier")).distinct()
    rest = materialize(rest.join(pairs, ["later", "earlier"], "left_anti"), "line-rest")
    return found.unionByName(verified(docs, at, rest, s)).distinct()


def removed_lines(docs: DataFrame, at: Places, s: LineSettings) -> DataFrame:
    """`_in` (the document's number) and the sorted numbers of the lines that go, for documents that lose one."""
    lines = materialize(keyed_lines(docs, at, s), "lines").where("n > 0")  # above the scan, else the filter would make each set twice
    keys = ["k", "b1", "b2", "n"]
    earliest = lines.groupBy(*keys).agg(F.count("*").alias("copies"), F.min(F.struct("pos", "prefix")).alias("m"))
    first = materialize(earliest.select(*keys, "copies", F.col("m.pos").alias("pos"), F.col("m.prefix").alias("prefix")), "first-lines")
    gone = later_matches(docs, at, first, s).select(F.col("later").alias("pos"))
    repeated = _few(materialize(first.where("copies > 1").select(*keys, F.col("pos").alias("first")), "repeated-lines"), 80, s)
    again = lines.select("pos", *keys).join(repeated, keys).where("pos <> first").select("pos")
    every = gone.unionByName(again)  # of a line no row is in both
    return every.groupBy(at.doc_of(F.col("pos")).alias("_in")).agg(F.sort_array(F.collect_list(at.line_of(F.col("pos")))).alias("removed"))


def _without(lines: Column, removed: Column) -> Column:
    """The runs of lines between those that go, joined. The array of one row binds what the inner steps use, so nothing is split twice."""

    def cut(v: Column) -> Column:
        begins, ends = F.concat(F.array(F.lit(-1)), v["r"]), F.concat(v["r"], F.array(F.size(v["l"])))
        return F.array_join(F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(v["l"], a + 2, b - a - 1))), "\n")

    return F.get(F.transform(F.array(F.struct(lines.alias("l"), removed.alias("r"))), cut), F.lit(0))


def deduplicate(docs: DataFrame, s: LineSettings = LineSettings()) -> DataFrame:
    """The documents with text rid of later matches, and n_lines, removed (line numbers from 0) and lines_left."""
    made = ("n_lines", "removed", "lines_left")
    rest = [c for c in docs.columns if c != "text" and c not in made]
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"), "text", F.struct(*rest).alias("row"))
    with discarding(docs.sparkSession) as keep:
        keyed, at = places(keyed)
        keep(keyed)
        gone = keep(materialize(removed_lines(keyed.drop("row"), at, s), "removed-lines"))
    size = gone.agg(F.count("*"), F.sum(F.size("removed"))).first()
    if 32 * size[0] + 8 * (size[1] or 0) <= s.broadcast_bytes:
        gone = F.broadcast(gone)  # then no text moves; beyond that both sides shuffle by document
    out = keyed.withColumn("_in", at.doc).join(gone, "_in", "left")
    old, removed = F.col("text"), F.coalesce("removed", F.array().cast("array<int>"))
    out = out.select("row", "text", removed.alias("removed"))
    n_lines = F.when(old.isNull(), F.lit(0)).otherwise(F.octet_length(old) - F.octet_length(F.replace(old, F.lit("\n"), F.lit(""))) + 1).cast("long")
    text = F.when(F.size("removed") == 0, old).otherwise(_without(F.split(old, "\n"), F.col("removed")))
    columns = [text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in made]
    return out.select(*columns, n_lines.alias("n_lines"), "removed", (n_lines - F.size("removed")).alias("lines_left"))
