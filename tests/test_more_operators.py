"""Segmentation, full text, citations, office files, grids and resumes on hand-made inputs."""

import io
import json
import zipfile
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from docweave.operators import citations, fulltext, grids, resume, segment
from docweave.sources import office

BOOK = segment.Book({w: (f, t) for w, f, t in [("知识", -6.0, "n"), ("知识库", -7.0, "n"), ("库", -8.0, "n"), ("检索", -6.5, "v"), ("库检", -13.0, ""), ("系统", -6.0, "n"), ("c++", -7.0, "n"), ("北京", -6.0, "ns"), ("北京大学", -8.0, "nt"), ("大学", -6.0, "n")]})


def plain_best(text, k):
    out = []
    for n in range(len(text)):
        for cuts in combinations(range(1, len(text)), n):
            ends = (*cuts, len(text))
            words = [text[a:b] for a, b in zip((0, *cuts), ends)]
            if all(w in BOOK.words or len(w) == 1 for w in words):
                f = sum(BOOK.words.get(w, (segment.UNKNOWN, ""))[0] for w in words)
                out.append((-(30 / len(words) + sum(len(w) > 1 for w in words) / len(words) + f), ends, words))
    return [w for _, _, w in sorted(out)[:k]]


@pytest.mark.parametrize("text", ["知识库检索", "北京大学系统", "库检索系统知识库", "无无知识", "a"])
def test_best_splits(text):
    assert segment.best_splits(text, BOOK, 3) == plain_best(text, 3)


def test_tokens(spark):
    assert segment.tokenize("知识库检索ＡＢ C++ 12.5", BOOK) == ["知识库", "检索", "ab", "c++", "12.5"]
    assert "".join(segment.tokenize("北京大学的知识", BOOK)) == "北京大学的知识"
    assert segment.fine(["北京大学", "知识"], BOOK) == [*segment.best_splits("北京大学", BOOK, 2)[1], "知识"]
    assert segment.fine(["a/b", "c"], BOOK) == ["a", "b", "c"]
    rows = spark.createDataFrame([("知识库", 50, "n"), ("检索", 80, "v")], "word string, freq long, tag string")
    docs = spark.createDataFrame([(1, "知识库检索"), (2, None)], "id int, text string")
    got = {r.id: r.tokens for r in segment.segmented(docs, "id", "text", rows, True).collect()}
    assert got == {1: ["知识库", "检索"], 2: []}


def test_short_runs():
    assert segment.short_runs(["多", "工位", "a", "b", "c", "长词"]) == ["多 工位", "a b c", "长词"]
    assert segment.short_runs(list("abcdef")) == ["a b", "c d e f"]


def test_questions_as_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(fulltext.clean_question(F.lit("What is， ＡＢＣ?"))) == "what is abc"
    once = fulltext.without_asking(F.lit("what is the price of tea"))
    assert one(once).split() == ["the", "price", "tea"] and one(fulltext.without_asking(once)).split() == ["price", "tea"]  # a match takes the space before the next word
    assert one(fulltext.without_asking(F.lit("请问价格是多少"))) == "价格"
    assert one(fulltext.mostly_not_latin(F.lit("a b c"))) and not one(fulltext.mostly_not_latin(F.lit("a b c d e")))
    assert one(fulltext.phrases(F.array(*[F.lit(x) for x in ("big", "data", "数据", "lake")]))) == ["big data", "数据", "lake"]
    assert one(fulltext.worth_weighing(F.array(*[F.lit(x) for x in ("的", "5", "(", "价格", "")]))) == ["价格"]
    assert one(fulltext.escaped(F.lit("a+b:c"))) == "a\\+b\\:c"


def test_best_fields(spark):
    hits = spark.createDataFrame([(1, "title_tks", "tea", 1, 2), (1, "content_ltks", "tea", 3, 9), (2, "content_ltks", "tea", 1, 9), (2, "content_ltks", "pot", 1, 9)], "id int, field string, term string, tf long, length int")
    clauses = spark.createDataFrame([(7, "tea", 1.0), (7, "pot", 1.0)], "q int, term string, weight double")
    got = fulltext.best_fields(hits, clauses, "q", "id", 5).collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == [1, 2]
    assert [r.id for r in fulltext.best_fields(hits, clauses, "q", "id", 5, 0.9).collect()] == [2]
    pos = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (2, "a", 0), (2, "b", 9)], "id int, term string, pos int")
    assert [r.id for r in fulltext.near_phrases(pos, "id", "a", "b").collect()] == [1]


def broadcast_rows(plan):
    """Rows of each table that an executed plan has broadcast."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return broadcast_rows(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return broadcast_rows(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if plan.nodeName() == "BroadcastExchange" else []
    return own + [n for i in range(plan.children().size()) for n in broadcast_rows(plan.children().apply(i))]


@pytest.mark.parametrize("held", [fulltext.HELD_CLAUSES, 0])
def test_best_fields_broadcasts_no_rows(spark, monkeypatch, held):
    """Three thousand rows that match are never broadcast, however small their shuffles are; many clauses join by a merge."""
    monkeypatch.setattr(fulltext, "HELD_CLAUSES", held)
    hits = spark.range(3000).select("id", F.lit("title_tks").alias("field"), F.explode(F.array(F.lit("tea"), F.when(F.col("id") % 3 == 0, "pot").otherwise("cup"))).alias("term"), (F.col("id") % 2 + 1).alias("tf"), F.lit(2).alias("length"))
    clauses = spark.createDataFrame([(7, "tea", 1.0), (7, "pot", 1.0)], "q int, term string, weight double")
    found = fulltext.best_fields(hits, clauses, "q", "id", 5, 0.9)
    assert [r.id for r in sorted(found.collect(), key=lambda r: r["rank"])] == [3, 9, 15, 21, 27]
    assert max(broadcast_rows(found._jdf.queryExecution().executedPlan())) <= 4


def test_citations(spark):
    answer = "First part is here. Second 部分在此。```code. x```tail"
    parts = citations.sentences(answer)
    assert "".join(parts) == answer and "```code. x```" in parts and len(parts) >= 4
    sims = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.895), (1, 1, 0, 0.8), (1, 1, 2, 0.2), (2, 0, 0, 0.45), (3, 0, 0, 0.1)], "a int, s int, c int, sim double")
    cites = citations.cite(sims, "a", "s", "c")
    assert sorted(map(tuple, cites.collect())) == [(1, 0, 0), (1, 0, 1), (2, 0, 0)]
    text = spark.createDataFrame([(1, 0, "A."), (1, 1, "B.")], "a int, s int, t string")
    assert citations.marked(text, cites, "a", "s", "c", "t").first().text == "A. ##0$$ ##1$$B."


def pack(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t, n=1: f'<w:tc><w:tcPr><w:gridSpan w:val="{n}"/></w:tcPr>{para(t)}</w:tc>'
    body = para("One", "H1") + para("text a") + para("Two", "H2") + para("text b") + para("Next", "H1") + para("text c") + f"<w:tbl><w:tr>{cell('x', 2)}{cell('y')}</w:tr></w:tbl>"
    styles = f'<w:styles {w}>' + "".join(f'<w:style w:styleId="H{i}"><w:name w:val="heading {i}"/></w:style>' for i in (1, 2)) + "</w:styles>"
    (tmp_path / "a.docx").write_bytes(pack({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles}))
    got = [r.text for r in sorted(office.read_outlines(spark, f"file://{tmp_path}").collect(), key=lambda r: r.idx)]
    assert got == ["One\n\ntext a", "One\nTwo\n\ntext b", "Next\n\ntext c"]
    assert office.read_docx_tables(spark, f"file://{tmp_path}").first().html == "<table><tr><td colspan='2'>x</td><td>y</td></tr></table>"


def test_xlsx(spark, tmp_path):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row>' + "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>1</v></c><c r="B{i}"><v>{i % 2}</v></c></row>' for i in range(2, 6))
    blob = pack(
        {
            "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="Prices" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si><si><t>tea</t></si></sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>",
        }
    )
    (tmp_path / "a.xlsx").write_bytes(blob)
    cells = office.read_sheets(spark, f"file://{tmp_path}")
    assert cells.count() == 10
    lines = [r.line for r in sorted(office.sheet_lines(cells, "path").collect(), key=lambda r: r.row)]
    assert lines == ["name：tea ——Prices", "name：tea; n：1 ——Prices", "name：tea ——Prices", "name：tea; n：1 ——Prices"]
    parts = {r.part: r.html for r in office.sheet_tables(cells, "path", 2).collect()}
    assert sorted(parts) == [0, 1, 2]
    assert parts[2] == "<table><caption>Prices</caption><tr><th>name</th><th>n</th></tr></table>\n"
    assert parts[0] == "<table><caption>Prices</caption><tr><th>name</th><th>n</th></tr><tr><td>tea</td><td>0</td></tr><tr><td>tea</td><td>1</td></tr></table>\n"


def test_pptx(spark, tmp_path):
    a, p, r = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    ns = f'xmlns:a="{a}" xmlns:p="{p}" xmlns:r="{r}"'
    shape = lambda t, y: f'<p:sp><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = f'<p:graphicFrame><p:xfrm><a:off x="0" y="900"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr>{cell("h")}{cell("k")}</a:tr><a:tr>{cell("1")}{cell("2")}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    slide = f"<p:sld {ns}><p:cSld><p:spTree>{table}{shape('low', 500)}{shape('top', 10)}</p:spTree></p:cSld></p:sld>"
    blob = pack(
        {
            "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="r7"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r7" Target="slides/slide1.xml"/></Relationships>',
            "ppt/slides/slide1.xml": slide,
        }
    )
    (tmp_path / "a.pptx").write_bytes(blob)
    assert office.read_slides(spark, f"file://{tmp_path}").first().text == "top\nlow\nh: 1; k: 2"


def test_grids(spark):
    boxes = spark.createDataFrame([(1, "a", 0.0, 9.0, 0.0, 9.0), (1, "b", 20.0, 29.0, 1.0, 9.0), (1, "c", 0.0, 9.0, 12.0, 20.0)], "t int, text string, x0 double, x1 double, top double, bottom double")
    got = {r.text: (r.row, r.col) for r in grids.grid(boxes, ["t"]).collect()}
    assert got == {"a": (0, 0), "b": (0, 1), "c": (1, 0)}
    kind = lambda x: "Nu" if x.replace(".", "").isdigit() else "En"
    rows = [["year", "a", "b", "c"], ["1", "2", "3", "4"], ["q", "d", "e", "f"], ["5", "6", "", "8"]]
    assert grids.sentences(rows, kind) == ["year: 1;a: 2;b: 3;c: 4", "q: 5;d: 6;f: 8"]
    lines = spark.createDataFrame([(1, "l", 0.0, 5.0, 0.0, 9.0, "A", 9.0), (1, "l", 6.0, 9.0, 1.0, 9.0, "B", 9.0), (1, "l", 0.0, 5.0, 20.0, 29.0, "C", 9.0)], "page int, layoutno string, x0 double, x1 double, top double, bottom double, text string, h double")
    assert [r.text for r in grids.merge_lines(lines, ["page"], "h").collect()] == ["AB", "C"]
    both = spark.createDataFrame([(1, "t", 0.0, 9.0, 0.0, 9.0, 0.9), (1, "t", 1.0, 9.0, 0.0, 9.0, 0.5), (1, "u", 0.0, 9.0, 0.0, 9.0, 0.1)], "page int, type string, x0 double, x1 double, top double, bottom double, score double")
    assert sorted((r.type, r.score) for r in grids.clean_layouts(both, ["page"]).collect()) == [("t", 0.9), ("u", 0.1)]


def test_resume_records(spark):
    cv = {"raw_txt": "x", "basic": {"photo2": 1, "name": "n", "basic_salary_month": 5}, "work": [{"start_time": "2", "corporation_name": "B", "external": 1}, {"start_time": "1", "management_experience": "Y"}], "education": {"a": {"start_time": "1", "school_name": "S"}}, "skill": "bad"}
    got = resume.clean_records(spark.createDataFrame([(1, json.dumps(cv, ensure_ascii=False)), (2, "{}")], "id int, cv string"), "cv", "now").orderBy("id").collect()
    assert got[1].basic == {"updated_at": "now"} and got[1].work is None and got[1].contact == {"name": ""}
    got = got[0]
    assert got["basic"]["corporation_name"] == "B" and got["basic"]["work_start_time"] == "1" and got["basic"]["management_experience"] == "Y"
    assert got["basic"]["school_name"] == "S" and got["basic"]["salary_month"] == "5" and got["contact"]["name"] == "n"
    assert got["basic"]["updated_at"] == "now" and not {"photo2", "basic_salary_month"} & set(got["basic"]) and got["is_deleted"] == 0
    assert got["skill"] is None and "raw_txt" not in got["rest"] and got["work"]["0"] == {"start_time": "2", "corporation_name": "B"}
    schools = spark.createDataFrame([(1, "北京大学", "Peking University", ["北大"])], "school_id int, name_cn string, name_en string, aliases array<string>")
    studies = spark.createDataFrame([("北大",), ("peking  university",), ("北京大学(医学部)",), ("other",)], "s string")
    assert [r.school_id for r in resume.matched_schools(studies, schools, "s").orderBy("s").collect()].count(1) == 3
