"""Line dedup where a line's first candidate isn't its match, rows share an id, or lines are short."""

import random
import re

from docweave.llm.op8_linededup import LineSettings, deduplicate, keyed_lines, places, rarity
from docweave.llm.shared import discarding
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def similar_earlier(rows, percent=80):
    """(doc_id, line number) of the lines that an earlier one matches; all pairs."""
    lines = [((d, i), set(WORD.findall(x))) for d, t in rows for i, x in enumerate(t.split("\n"))]
    return {at for at, s in lines if s and any(p < at and o and 100 * len(s & o) >= percent * len(s | o) for p, o in lines)}


def removed(spark, rows, s=LineSettings()):
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), s)
    return {(r.doc_id, i) for r in got.collect() for i in r.removed}


def test_lines_unlike_their_tokens_first_line(spark):
    """F = template + common words, M = template, L = template + rare words: L is like M, not like F."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(24)]
    groups = []
    for g in range(12):
        template = [f"g{g}t{i}" for i in range(96)]
        c, r = 2 + g % 4, 24 - g % 3
        groups.append([template + common[:c], template, template + [f"g{g}r{i}" for i in range(r)]])
    texts = [" ".join(rng.sample(line, len(line))) for k in range(3) for line in (group[k] for group in groups)]
    rows = list(enumerate(texts)) + [(100 + i, "\n".join(f"{c} z{i}" for c in common)) for i in range(10)]
    want = similar_earlier(rows)
    assert {(24 + g, 0) for g in range(12)} <= want
    assert removed(spark, rows) == want


def test_short_lines(spark):
    """Every line with a token counts; blank lines have none and stay."""
    rows = [(i, "Read more\n \n\na b c d\n" + ("a b c d e" if i % 2 else " \t \nd c b a")) for i in range(6)] + [(9, "Read"), (10, "more Read Read")]
    want = similar_earlier(rows)
    lines = {(d, i): x for d, t in rows for i, x in enumerate(t.split("\n"))}
    want = {at for at in want if lines[at].strip()}
    assert (5, 0) in want and (10, 0) in want and (1, 4) in want
    assert removed(spark, rows) == want


def test_lines_of_rows_that_share_an_id(spark):
    """Each row loses its own lines only, whether ids are null or repeated; no line is lost twice over."""
    text = lambda name, n: [f"{name}{i} is a line of its own{name}{i}" for i in range(n)]
    for shared, first in ((None, None), (7, -1)):
        short, long = ["head of the short text here"], text("a", 4) + ["one two three four five six"] + text("b", 2)
        third = ["one two three four five six"] + text("c", 3)
        rows = [(first, "\n".join(third)), (shared, "\n".join(short)), (shared, "\n".join(long)), (shared, None), (8, "\n".join(text("c", 1) + text("d", 2)))]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = [r for r in deduplicate(df).collect()]
        assert len(got) == len(rows)
        kept = [x for r in got if r.text is not None for x in r.text.split("\n")]
        want = set(short + long + third + text("d", 2))
        assert sorted(kept) == sorted(want)
        for r in got:
            assert r.lines_left == (0 if r.text is None else len(r.text.split("\n"))) == r.n_lines - len(r.removed)


def test_words_are_hashed_and_ordered_in_one_step(spark):
    """Each word meets one lambda; an empty string in every line parts the rarer half of the table's tokens from the commoner."""
    rows = [(i, f"the a  of r{i} the\n\t\n  s{i}\x0bthe a ") for i in range(40)] + [(50, ""), (51, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").alias("_doc"), "text")
    with discarding(spark):
        docs, at = places(docs)
        made = keyed_lines(docs, at, LineSettings())
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("transform(") == 1 and "array_append" not in plan
        assert sorted(r.n for r in made.collect()) == [0] * 41 + [3] * 40 + [4] * 40
        ranks, order, middle = rarity(docs)
        tokens = [w for _, t in rows for w in WORD.findall(t or "")]
        words = spark.createDataFrame([(w,) for w in [*tokens, ""]], "w string").withColumn("t", ranks.scalar()).select("w", order(F.col("t"), F.xxhash64("w")).alias("o")).collect()
    behind = [r.w for r in words if r.o < middle]
    assert {r.o for r in words if r.w == ""} == {middle}
    assert {w for w in tokens if w[0] in "rs"} <= set(behind) and "the" not in behind
