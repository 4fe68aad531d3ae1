from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import docstore, fields


def test_store_fields(spark):
    df = spark.createDataFrame([("t", ["a", "b"], ["a"], [(0, 1.6, 2.0, 3.0, 4.0)])], "text string, tokens array<string>, fine_tokens array<string>, pos array<struct<page:int,left:double,right:double,top:double,bottom:double>>")
    r = fields.store_fields(df, positions="pos").first()
    assert (r.content_ltks, r.content_sm_ltks, r.page_num_int, r.top_int, r.position_int) == ("a b", "a", [1], [3], [[1, 1, 2, 3, 4]])
    assert fields.field_type("q_384_vec") == "array<float>" and fields.field_type("title_sm_tks") == "string" and fields.field_type("x") == "string"
    assert [f.dataType.simpleString() for f in fields.schema_of(["a_int", "b_kwd"])] == ["int", "array<string>"]


def test_row_batches(spark):
    df = spark.createDataFrame([(1, i, f"r{i}") for i in range(23)], "t int, o int, text string")
    got = {r.batch: r.text for r in fields.row_batches(df, ["t"], "o", "text", True).collect()}
    assert len(got) == 3 and got[2] == "r20; r21; r22" and got[0].startswith("r0; r1; ")


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(fields.without_table_tags(F.lit('<table border="1"><tr>a</tr>'))).strip() == "a"
    assert one(fields.simplified(F.lit("漢字a"), {"漢": "汉"})) == "汉字a"
    assert one(T.preview(F.lit("a  b\n" * 200), 10)) == "a b a b a ..."
    assert one(T.spaceless_cjk(F.lit("中 文 and b"))) == "中文 and b"  # one pass: a match takes the character after the blank
    vectors = lambda rows: F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    assert one(docstore.late_interaction(vectors([[1.0, 0.0], [0.0, 1.0]]), vectors([[0.5, 0.2], [0.1, 0.9]]))) == 0.5 + 0.9


def test_relaxed(spark):
    a = spark.createDataFrame([(1, "x")], "q int, id string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "q int, id string")
    assert sorted(map(tuple, docstore.relaxed(a, b, "q").collect())) == [(1, "x"), (2, "z")]
