"""Text functions against plain Python on awkward inputs."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import embedding, questions
from docweave.sources import splitters

ODD = ["", " ", "　 a b　", "﻿x", "...", "é", "a" * 800, "b" * 801, "中文abc_1 \U0001f600 dé", "x" * 3000, "\x1c a \x1f", "Foo_1 bar 中文é", "\n\n", " word " * 400]


def run(spark, column, texts=ODD):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("v"))
    return [r.v for r in sorted(df.collect(), key=lambda r: r.i)]


def plain_windows(text, size, overlap):
    text = text.strip()
    size, overlap = max(1, size), max(0, min(overlap, max(1, size) - 1))
    out, start = [], 0
    while start < len(text):
        out.append(text[start : start + size].strip())
        if start + size >= len(text):
            break
        start += size - overlap
    return [w for w in out if w]


@pytest.mark.parametrize("size,overlap", [(800, 120), (10, 3), (1, 0), (7, 50)])
def test_windows(spark, size, overlap):
    assert run(spark, lambda t: T.windows(t, size, overlap)) == [plain_windows(t, size, overlap) for t in ODD]


def test_strip_and_squeeze(spark):
    assert run(spark, T.strip) == [t.strip() for t in ODD]
    assert run(spark, T.squeeze) == [re.sub(r"\s+", "", t).lower() for t in ODD]
    assert run(spark, T.collapse) == [re.sub(r"\s+", " ", t).strip() for t in ODD]


def test_hash_tokens_and_seeds(spark):
    plain = lambda t: re.findall(r"[A-Za-z0-9_]+|[一-鿿]", t.lower()) or list(t)
    assert run(spark, T.hash_tokens) == [plain(t) for t in ODD]
    row = spark.range(1).select(T.hash_slot(F.lit("rag"), 384), T.hash_sign(F.lit("rag")), T.stable_id(F.lit("a"), F.lit("b"))).first()
    assert tuple(row) == (373, -1, hashlib.sha1(b"a::b").hexdigest())


def test_two_forms_of_hash_vectors(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, text string")
    dense = {r.i: np.array(r.vector) for r in embedding.hash_vectors(df, "i").collect()}
    sparse = {i: np.zeros(384) for i in dense}
    for r in embedding.hash_components(df, ["i"]).collect():
        sparse[r.i][r.slot] = r.value
    for i, v in dense.items():
        assert np.allclose(v, sparse[i]) and (abs(np.linalg.norm(v) - 1) < 1e-9 or not v.any())


def test_lexical_tokens(spark):
    got = run(spark, T.lexical_tokens, ["The a/b v1.2 的 中文字 ---", "", "字", "以及 x"])
    assert got == [["the", "a/b", "v1.2", "中文", "文字"], [], [], ["x"]]
    with_words = run(spark, lambda t: T.lexical_tokens(t, F.split(t, " ")), ["ab 的 cd"])
    assert with_words == [["ab", "cd", "ab", "cd"]]


@pytest.mark.parametrize("most", [1, 2, 3, 4, 7, 128])
def test_truncate(spark, most):
    assert run(spark, lambda t: T.truncate_utf8(t, most)) == [t.encode()[:most].decode("utf-8", "ignore") for t in ODD]


def test_fold_and_keywords(spark):
    assert run(spark, T.fold_width, ["ＡＢ１　！～"]) == ["AB1 !~"]
    assert run(spark, T.parse_keywords, ["a, b；c|d ;;，e "]) == [["a", "b", "c", "d", "e"]]
    assert run(spark, T.keywords, ["The 的 the cat 吗"]) == [["the", "cat"]]


def test_json_salvage(spark):
    got = run(spark, lambda t: T.json_array_of(t, "struct<question:string,answer:string>"), ['[{"question":"q","answer":"a"}]', 'Sure: [{"question":"q"}] done', "none"])
    assert [[tuple(x) for x in g] if g else g for g in got] == [[("q", "a")], [("q", None)], None]


def plain_parts(query):
    """An independent reading of the rules for questions."""
    query = query.strip()
    m = re.match(r"^((?:根据|依据).{1,30}?[，,])(.+)$", query)
    context, body = (m.group(1), m.group(2)) if m else ("", query)
    out = []
    for piece in filter(None, (p.strip(" ，,") for p in re.split(r"[？?；;。]\s*", body))):
        subs = re.split("，|,|并且|以及|同时|另外|还有", piece)
        if len(subs) == 1:
            out.append(piece)
            continue
        m = re.match(r"(.{1,30}?(?:这个|该|本|根据|依据)?(?:PRD|文档|需求|文件))", piece, re.I)
        topic = m.group(1) if m else piece.split("，", 1)[0] if "，" in piece else ""
        for s in filter(None, (s.strip(" ，,") for s in subs)):
            out.append(context + s if context else topic + s if topic and not s.startswith(topic) and len(s) < 16 else s)
    cleaned = [c for c in (re.sub(r"\s+", " ", o).strip(" ，,。？?") for o in out) if c]
    return (list(dict.fromkeys(cleaned))[:4] or [query]) if query else []


QUESTIONS = ["", "  ", "简单问题？", "根据产品文档，支持什么，以及限制？", "这个PRD的接口，参数？还有字段;风险", "a, b and c, d, e, f", "依据需求，同时", "，，？", "x。y。x", "长" * 40 + "，短"]


def test_questions(spark):
    assert run(spark, questions.decompose, QUESTIONS) == [plain_parts(q) for q in QUESTIONS]


def test_intents(spark):
    got = run(spark, questions.rule_intent, ["", "总结这个文档", "请对比A和B的区别", "hello", "密码是多少", "继续", "列出字段：名称"])
    assert got == ["clarification", "summary", "compare", None, "privacy_rejection", "context_followup", "extract"]


@settings(max_examples=40, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(max_size=60), lambda c: st.lists(c, max_size=6) | st.dictionaries(st.text(min_size=1, max_size=8), c, max_size=6), max_leaves=60))
def test_json_split_keeps_leaves(value):
    if not isinstance(value, dict):
        value = {"v": value}

    def leaves(v, path=()):
        if isinstance(v, list):
            v = {str(i): x for i, x in enumerate(v)}
        if isinstance(v, dict):
            return [x for k, y in v.items() for x in leaves(y, (*path, k))]
        return [(path, v)]

    got = sorted((x for c in splitters.split_json(value, 60) for x in leaves(c)), key=str)
    assert got == sorted(leaves(value), key=str)


def test_markdown(spark):
    text = "before\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n\nx | y\n--- | ---\n3 | 4\nend"
    df = spark.createDataFrame([(1, text)], "i int, t string")
    row = splitters.markdown_tables(df, "i", "t").first()
    assert len(row.tables) == 2 and "before" in row.remainder and "end" in row.remainder and "|" not in row.remainder


def test_text_chunks():
    parts = splitters.text_chunks("aa!bb;cc.dd?ee", 3, len)
    assert "".join(parts) == "aa!bb;cc.dd?ee" and len(parts) > 1
