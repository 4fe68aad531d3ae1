import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docweave.operators import images, layout, resume


def test_headings_and_captions(spark):
    texts = ["第一章 总则", "1. a", "1.2 b", "3.14", "ab", "问题：", "plain text", "（三）x", "• x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", layout.heading_level(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == [1, 5, 6, 0, 0, 9, 0, 4, 12]
    assert [r[0] for r in spark.createDataFrame([(" 图1: x", None), ("x", "figure caption"), ("x", None)], "t string, l string").select(layout.is_caption(F.col("t"), F.col("l"))).collect()] == [True, True, False]


def test_characters_to_boxes(spark):
    boxes = spark.createDataFrame([(1, 7, 0.0, 100.0, 0.0, 10.0)], "page int, box_id int, x0 double, x1 double, top double, bottom double")
    chars = spark.createDataFrame([(1, i, c, 10.0 * i, 10.0 * i + 8, 1.0, 1.5 if c == "!" else 9.0) for i, c in enumerate("ab 中 c!")], "page int, char_id int, text string, x0 double, x1 double, top double, bottom double")
    assert layout.text_of_boxes(chars, boxes, ["page"]).first().text == "ab 中c"
    parts = spark.createDataFrame([(1, 3, "table row", 0.0, 100.0, 0.0, 9.0), (1, 4, "table row", 0.0, 100.0, 9.0, 20.0)], "page int, part_id int, label string, x0 double, x1 double, top double, bottom double")
    row = layout.component_tags(boxes, parts, ["page"]).first()
    assert row.R == 3 and row.C is None


def test_vertical_runs(spark):
    rows = [(1, 1, "l", 0.0, 90.0, 0.0, 10.0, "Open,"), (1, 1, "l", 0.0, 90.0, 11.0, 20.0, "end。"), (1, 1, "l", 0.0, 90.0, 21.0, 30.0, "new"), (1, 1, "l", 0.0, 90.0, 80.0, 90.0, "far"), (1, 1, "l", 0.0, 90.0, 91.0, 99.0, "  ")]
    df = spark.createDataFrame(rows, "doc int, page int, layoutno string, x0 double, x1 double, top double, bottom double, text string").withColumns({"line_height": F.lit(10.0), "line_width": F.lit(8.0)})
    assert sorted(r.text for r in layout.vertical_runs(df, ["doc"]).collect()) == ["Open,end。", "far", "new"]
    groups = spark.createDataFrame([(1, [10.0, 20.0], False, 500.0), (2, [10.0], True, 500.0), (3, [220.0], False, 900.0)], "id int, widths array<double>, headed boolean, pw double")
    assert sorted(r.id for r in layout.without_scraps(groups, "pw").collect()) == [2, 3]


def test_spans():
    none = [np.nan] * 4
    cells = pd.DataFrame([(0, 0, 0, 10, 0, 5, "head", 0, 21, 0, 5), (1, 0, 0, 10, 6, 10, "a", *none), (1, 1, 11, 20, 6, 10, "b<", *none), (0, 1, 11, 20, 0, 5, "er", *none)], columns=["row", "col", "x0", "x1", "top", "bottom", "text", "h_left", "h_right", "h_top", "h_bottom"])
    made = layout.spans(cells)
    assert made.loc[0, ["rowspan", "colspan"]].tolist() == [1, 2]
    assert layout.grid_html(made, {0}, "c") == '<table><caption>c</caption><tr><th colspan="2">head er</th></tr><tr><td>a</td><td>b&lt;</td></tr></table>'


def test_flat_records(spark):
    content = '{"basic": {"degree": 2, "gender": "M", "is_house": "Y", "industry_ids": "1,2", "address": "9", "name": "x", "responsibilities": "a\\nb"}, "contact": {"tel": " 5 ", "name": "n"}, "work": {"0": {"p": 1}}}'
    raw = spark.createDataFrame([("r1", "2020", content), ("r2", None, "broken")], "tob_resume_id string, updated_at string, resume_content string")
    industries = spark.createDataFrame([("1", ["sub", "root"]), ("2", ["other"])], "id string, path array<string>")
    regions = spark.createDataFrame([("9", ["city", "land"])], "id string, path array<string>")
    got = {r.tob_resume_id: r for r in resume.flat_records(raw, industries=industries, regions=regions).collect()}
    r = got["r1"]
    assert len(r) == 51 and (r.degree, r.gender, r.is_house, r.phone, r.name, r.address, r.industry_names, r.work_obj, r.responsibilities) == ("硕士", "男", "是", "5", "n", "city land", "sub root other", '{"0":{"p":1}}', "a\\nb")
    assert got["r2"].degree == "" and got["r2"].skill_obj == "{}"
    assert spark.range(1).select(resume.degree_number(F.lit(" mba "))).first()[0] == "6"
    projects = spark.createDataFrame([(1, "1", "old", "<b>d</b>", ""), (1, "2", "new", "", "r")], "p int, updated_at string, name string, describe string, responsibilities string")
    assert tuple(resume.project_texts(projects, "p").first()) == (1, "new", "r d")


def test_images():
    rng = np.random.default_rng(0)
    im = rng.integers(0, 255, (10, 14, 3), np.uint8)
    assert images.pad_to(im).shape == (32, 32, 3) and (images.resize(im, 10, 14) == im).all()
    assert images.resize(im, 5, 7).shape == (5, 7, 3) and images.channels_first(im).shape == (3, 10, 14) and images.gray(im, True).shape == (10, 14, 1)
    assert images.detector_size(2000, 1000) == (960, 480) and images.detector_size(10, 10, 32, "min") == (32, 32)
    assert images.line_image(im, 8, 4.0).shape == (3, 8, 32)
    score = np.zeros((40, 60))
    score[5:15, 10:40] = 0.9
    score[30:32, 3:5] = 0.9
    ((points, mean),) = images.boxes_of(score, original=(80, 120))
    assert abs(mean - 0.9) < 1e-9 and points[0, 0] < 20 and points[2, 0] > 80 and points.min() >= 0
    assert [len(r) for r in images.regions(np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [0, 1, 0]]))] == [5, 1]
