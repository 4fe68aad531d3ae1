"""Operators on hand-made tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.config import Settings
from docweave.functions import scores as S
from docweave.operators import docstore, evaluation, fusion, geometry, lexical, resume, sections, store, tables, vector, weights
from docweave.sources import readers
from docweave import seams


def test_fragments(spark):
    texts = ["plain", "<table><tr><td>a</td></tr>", "<tr><td>b</td></tr></table>", "<table><tr><td>c</td></tr></table>", "<tr><td>d</td></tr>", "</table> tail"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, seq int, text string")
    got = [(r.seq, r.pieces, r.is_table) for r in sorted(tables.merge_fragments(df, ["doc"]).collect(), key=lambda r: r.seq)]
    assert got == [(0, 1, False), (1, 2, True), (3, 1, True), (4, 1, True), (5, 1, False)]


def test_malformed_tables():
    html = "<caption>spare</caption><table><tr><th>类别</th><th></th></tr><tr><td>x &amp; y</td></tr><tr><td> </td></tr><tr><td></td><td>2</td></tr></table><table><tr><td>open"
    found = tables.read_tables(html)
    assert found == [("spare", [["类别", ""], ["x & y"], ["", "2"]])]


def test_structured_tables(spark):
    html = "<table><caption>c</caption><tr><th>类别</th><th></th><th>n</th></tr><tr><td>k</td><td>1</td><td>5</td></tr><tr><td></td><td>2</td><td></td></tr></table> lost"
    cell = tables.cells(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html")
    assert tables.as_text(cell, "id").first().text == "[结构化表格] c\n表头：类别 |  | n\n- 类别=k；列2=1；n=5\n- 类别=k；列2=2"


def test_vector_search_is_exact(spark):
    rng = np.random.default_rng(1)
    base, asked = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id int, vector array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "q int, vector array<double>")
    got = vector.top_k(b, "id", q, "q", 5).collect()
    for i in range(7):
        want = sorted(range(300), key=lambda j: (-round(float(base[j] @ asked[i]), 6), j))[:5]
        assert [r.id for r in sorted((r for r in got if r.q == i), key=lambda r: r["rank"])] == want
    assert vector.top_k(b, "id", q.limit(0), "q", 5).count() == 0


def test_lexical_search(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "red red dog"), (3, ""), (4, None)], "id int, text string")
    asked = spark.createDataFrame([(9, "red dog"), (8, ""), (7, "absent")], "q int, text string")
    got = lexical.search(docs, "id", asked, "q", 5).collect()
    assert {r.q for r in got} == {9} and [r.id for r in sorted(got, key=lambda r: r["rank"])] == [2, 1]


def test_hybrid(spark):
    v = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.5, 2)], "q int, id string, score double, rank int")
    t = spark.createDataFrame([(1, "b", 7.0, 1), (1, "c", 3.0, 2)], "q int, id string, score double, rank int")
    got = sorted(fusion.hybrid(v, t, "q", "id", 3, 0.7).collect(), key=lambda r: r["rank"])
    assert [(r.id, r.score) for r in got] == [("a", 0.7), ("b", 0.3), ("c", 0.0)]
    assert [r.id for r in sorted(fusion.hybrid(v, t, "q", "id", 3, 9.0).collect(), key=lambda r: r["rank"])] == ["a", "b", "c"]


def test_store(spark):
    log = spark.createDataFrame([("a", 1, 0, "x"), ("b", 1, 1, "y"), ("a", 2, 5, "z")], "k string, v int, seq int, t string")
    got = {r.k: (r.seq, r.v, r.t) for r in store.upsert(log, "k", "v", "seq").collect()}
    assert got == {"a": (0, 2, "z"), "b": (1, 1, "y")}
    once = store.replace(log, log.where("k = 'a'"), "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, store.replace(once, log.where("k = 'a'"), "k").collect()))


def test_cases(spark, tmp_path):
    rows = {"schema": {"properties": {"问题": {}}}, "cases": [{"id": 1, "问题": "q1", "keywords": "a, b；c", "意图": "x"}, {"question": "q2", "answer_keywords": ["d", " "]}, {"id": 3}]}
    path = tmp_path / "c.json"
    path.write_text("﻿" + json.dumps(rows, ensure_ascii=False), "utf-8")
    got = {r.case_id: r for r in readers.read_cases(spark, f"file://{path}").collect()}
    assert got["1"].question == "q1" and got["1"].answer_keywords == ["a", "b", "c"] and got["1"].intent == "x"
    assert got["case_0002"].answer_keywords == ["d"] and got["case_0002"].intent == "unknown" and len(got) == 2


def test_grades(spark):
    df = spark.createDataFrame([("Hello  World", ["helloworld", "x", " "], 0.5), ("a", [], 0.4), (None, ["a"], 2.0)], "rag_answer string, answer_keywords array<string>, llm_accuracy double")
    got = [(r.keyword_coverage, round(r.final_accuracy, 6)) for r in evaluation.graded(df).collect()]
    assert got == [(pytest.approx(1 / 3), 0.45), (None, 0.4), (0.0, 0.7)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文\r\nx".encode("gbk"))
    (tmp_path / "b.json").write_text('{"k":[1,"é"]}', "utf-8")
    (tmp_path / "c.html").write_text("<title>T</title><nav>menu</nav><p>One</p><p>Two</p>", "utf-8")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in readers.read_documents(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": "中文\nx", "b.json": '{\n  "k": [\n    1,\n    "é"\n  ]\n}', "c.html": "T\nOne\nTwo"}
    (tmp_path / "d.exe").write_text("no")
    with pytest.raises(Exception, match="no text reader"):
        readers.read_documents(spark, f"file://{tmp_path}").collect()


def test_numbers_and_runs(spark, tmp_path):
    df = spark.createDataFrame([("5",), ("nan",), ("",), ("12",), ("x",)], "value string")
    assert readers.greatest_number(df).first()[0] == 12
    (tmp_path / "eval_details_r1.jsonl").write_text("{}")
    assert readers.latest_run(spark, f"file://{tmp_path}") == "r1"


def test_filters():
    with pytest.raises(ValueError):
        docstore.matches({"a": 1.5})


def test_highlight(spark):
    row = spark.range(1).select(docstore.highlight(F.lit("A cat sat. No hit here! The CAT, again"), ["cat"])).first()
    assert row[0] == "A <em>cat</em> sat... The <em>CAT</em>, again"


def test_suppression_and_order(spark):
    rows = [(1, 0, 0.0, 10.0, 0.0, 10.0, 0.9), (1, 1, 1.0, 10.0, 0.0, 10.0, 0.8), (1, 2, 50.0, 60.0, 2.0, 9.0, 0.7)]
    df = spark.createDataFrame(rows, "page int, box_id int, x0 double, x1 double, top double, bottom double, score double")
    assert sorted(r.box_id for r in geometry.suppress(df, ["page"]).collect()) == [0, 2]
    assert [r.box_id for r in sorted(geometry.reading_order(df, ["page"], 3.0).collect(), key=lambda r: r.place)] == [0, 1, 2]


def test_page_furniture_and_contents(spark):
    df = spark.createDataFrame([("d", "header", "H"), ("d", "header", "H"), ("d", "text", "H"), ("d", "footer", "once")], "doc string, layout_type string, text string")
    assert geometry.repeated_texts(df, "doc").count() == 2
    lines = spark.createDataFrame([("d", 1, f"x ........ {i}") for i in range(5)] + [("d", 2, "body")], "doc string, page int, line string")
    assert [r.page for r in geometry.contents_pages(lines, "doc", "page", "line").collect()] == [2]


def test_tags(spark):
    row = spark.createDataFrame([(3, 1.0, 2.0, 3.0, 4.5)], "page int, x0 double, x1 double, top double, bottom double").select(geometry.position_tag().alias("t"))
    assert row.first().t == "@@3\t1.0\t2.0\t3.0\t4.5##"
    assert row.select(geometry.without_tags(F.concat(F.lit("a"), "t", F.lit("b")))).first()[0] == "ab"


def test_resume(spark):
    got = spark.createDataFrame([("2019年3月5日",), ("2020-13",), ("x",)], "t string").select(*[c.alias(k) for k, c in resume.year_month_day(F.col("t")).items()]).collect()
    assert [tuple(r) for r in got] == [(2019, 3, 5), (2020, 12, None), (None, None, None)]
    assert spark.range(1).select(resume.normal_company(F.lit("某某(北京)科技股份有限公司"))).first()[0] == "某某科技"
    assert spark.range(1).select(resume.completeness([F.lit("a"), F.lit(""), F.lit(None), F.lit(3)], [(F.lit(True), 0.8)])).first()[0] == pytest.approx(0.4)


def test_sections(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["第1章 a", "x", "第2章 b", "1. c", "0 no", "1.... no"])], "doc int, i int, line string")
    assert sections.family_votes(df, "doc").first().family == 1
    assert spark.range(1).select(sections.pair_likeness(F.lit("abcd"), F.lit("bcde"))).first()[0] == pytest.approx(2 / 3)


def test_weights_add_up(spark):
    df = spark.createDataFrame([(1, t) for t in ["the", "12,5", "abc", "abc", "某某"]], "id int, token string")
    book = spark.createDataFrame([("abc", 500.0, 20.0, "corp", "n")], "token string, freq double, df double, entity string, word_class string")
    for d in (None, book):
        rows = weights.weighted_tokens(df, "id", d).collect()
        assert sum(r.weight for r in rows) == pytest.approx(1)
    parts = weights.clauses(spark.createDataFrame([(1, 0, "a", 0.4), (1, 1, "b", 0.6)], "id int, o int, token string, weight double"), "id", "o").collect()
    assert sorted((r.clause, r.weight) for r in parts) == [("a", 0.4), ("a b", 1.2), ("b", 0.6)]


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("RAG_CHUNK_SIZE=500 # note\nRAG_HYBRID_ENABLED=true\nRAG_STORAGE_DIR='a # b'\n# no\nbad\nRAG_BM25_K1=2.0\n", "utf-8")
    got = Settings.load(str(env), str(tmp_path / "missing"), environ={"RAG_BM25_K1": "1.1"})
    assert (got.chunk_size, got.hybrid_enabled, got.storage_dir, got.bm25_k1, got.bm25_b) == (500, True, "a # b", 1.1, 0.75)


def test_seams(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    assert all(len(r.vector) == 16 for r in seams.embed_texts(docs, "id", "text", seams.StubEmbedder).collect())
    hits = spark.createDataFrame([(1, 5, "red fox", "a red hen"), (1, 6, "red fox", "none"), (2, 5, "hen", "a red hen")], "q int, id int, query_text string, text string")
    assert {(r.q, r.id): r.model_score for r in seams.rerank(hits, "q", "id", seams.StubReranker).collect()} == {(1, 5): 0.5, (1, 6): 0.0, (2, 5): 1.0}
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert seams.Retrying(flaky)() == "ok" and len(calls) == 3


def test_search_by_batches_equals_joins(spark):
    """Both plans of the lexical search give the same ranks, and a segmenter's words count in both."""
    import random

    from docweave.operators import lexical

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["水", "电网", "检查"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30))), [rng.choice(["seg1", "seg2"])]) for i in range(200)] + [(500, None, [])]
    docs = spark.createDataFrame(rows, "id int, text string, seg array<string>").repartition(3)
    asked = spark.createDataFrame([("a", "w1 w2 w2 电网检查", ["seg1"]), ("b", "none of these", []), ("c", "w3", ["seg2"])], "q string, text string, seg array<string>")
    fast = lexical.search(docs, "id", asked, "q", 7, segments="seg", query_segments="seg").collect()
    old, lexical.BROADCAST_TERMS = lexical.BROADCAST_TERMS, 1
    try:
        slow = lexical.search(docs, "id", asked, "q", 7, segments="seg", query_segments="seg").collect()
    finally:
        lexical.BROADCAST_TERMS = old
    key = lambda r: (r["q"], r["rank"], r["id"], round(r["score"], 6))
    assert sorted(map(key, fast)) == sorted(map(key, slow)) and len(fast) == 14


def test_windows_of_long_texts(spark):
    """Windows equal plain slices, whatever the overlap."""
    from docweave.functions import text as T

    text = "".join(chr(97 + i % 26) if i % 7 else " é中\U0001f600"[i % 5 % 4] for i in range(5000)).strip()
    for size, overlap in ((800, 120), (100, 90), (10, 0), (7, 3)):
        got = spark.createDataFrame([(text,)], "t string").select(T.windows(F.col("t"), size, overlap)).first()[0]
        step = size - overlap
        n = 1 if len(text) <= size else -(-(len(text) - size) // step) + 1
        assert got == [w for w in (text[i * step : i * step + size].strip() for i in range(n)) if w]


def test_cases_of_several_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"cases": [{"id": "1", "query": "q1"}]}))
    (tmp_path / "b.jsonl").write_text('{"id": "2", "question": "q2"}\n{"query": "q3"}\n')
    got = [(r.case_id, r.question) for r in readers.read_cases(spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == [("1", "q1"), ("2", "q2"), ("case_0003", "q3")]


def test_hierarchies_of_any_depth(spark):
    """Twenty levels down, and two nodes that are each other's parents."""
    nodes = [(f"k{i}", f"n{i}", f"k{i - 1}" if i else None) for i in range(20)] + [("a", "A", "b"), ("b", "B", "a"), ("c", "C", "gone")]
    got = {r.key: r.path for r in resume.hierarchy_paths(spark.createDataFrame(nodes, "key string, name string, parent string"), "key", "name", "parent").collect()}
    assert got["k19"] == [f"n{i}" for i in range(19, -1, -1)] and got["a"] == ["A", "B"] and got["b"] == ["B", "A"] and got["c"] == ["C"]


def test_fixed_rounds_as_python(spark):
    rng = random.Random(7)
    values = [46.21035, 102.29965, 82.69125, 0.03125, 0.09375, 0.00005, 0.00015, -46.21035, -0.00001, 0.0, 0.99995, 1e-9, 123456.78905, 4e15]
    values += [round(rng.uniform(0, 10 ** rng.randint(-3, 6)), rng.randint(3, 6)) for _ in range(3000)] + [n / 20000 for n in range(1, 2001, 2)] + [n / 32 for n in range(1, 200)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", S.fixed(F.col("v")).alias("four"), S.fixed(F.col("v"), 1).alias("one")).collect()
    assert [(r.v, r.four, r.one) for r in got] == [(v, f"{v:.4f}", f"{v:.1f}") for v in values]


@pytest.mark.parametrize("most", [5, 33, 34, 35, 42, 63])
def test_context_counts_what_it_holds(spark, most):
    """A score that lies between two texts rounds as in Python; a header that the budget cuts is still a piece."""
    hits = spark.createDataFrame([(1, "a.txt", 46.21035, "x" * 10), (2, "12.txt", 82.69125, "y")], "rank int, file_name string, score double, text string").withColumn("q", F.lit(1))
    first, second = "[1] a.txt score=46.2103\n" + "x" * 10, "[2] 12.txt score=82.6912\ny"
    pieces = [first[:most], second[: max(0, most - len(first))]]
    (got,) = evaluation.context(hits, "q", most).collect()
    assert (got.context, got.chars) == ("\n\n".join(p for p in pieces if p), min(most, len(first + second)))
