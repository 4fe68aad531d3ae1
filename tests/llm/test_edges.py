"""Edge cases that all corpus operators and stages share: clashing names, shared and null ids, empty tables, very long texts."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docweave.llm.op1_langid import identify
from docweave.llm.op2_toxicity import toxicity
from docweave.llm.op3_packing import PackSettings, pack
from docweave.llm.op4_quality import quality_rules
from docweave.llm.op5_warc import derivatives, responses
from docweave.llm.op10_fingerprint import fingerprints

PACK = PackSettings(public_tokenizers.path("word_bpe_49k.json"))


def rows_of(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_clashing_names_change_nothing(docs, clashing, labels):
    """The clashing columns are named like the operators' own; results are those of the plain table."""
    for operator in (identify, lambda d: toxicity(d, labels), lambda d: quality_rules(d, labels), fingerprints):
        assert rows_of(operator(clashing)) == rows_of(operator(docs))
    more = docs.withColumns({c: F.lit("own") for c in ("_id", "class", "start", "length", "sequence_id", "_part", "_rank")})
    pieces = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert rows_of(pack(more, PACK).select(*pieces)) == rows_of(pack(docs, PACK).select(*pieces))


def test_clashing_names_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (None, None, None)], "page_id long, url string, html string")
    more = pages.withColumns({c: F.lit("own") for c in ("record_id", "body", "block", "_text", "r", "warc_date")})
    assert rows_of(derivatives(responses(more))) == rows_of(derivatives(responses(pages)))


def test_packing_of_shared_and_null_ids(spark):
    """Rows of one id, null or repeated, are documents of their own: every token of each lies in exactly one piece."""
    texts = ["one two three " * 900, "four five", "one two three " * 900, None, ""]
    docs = spark.createDataFrame([(d, t) for d in (None, 7) for t in texts], "doc_id long, text string").repartition(3)
    got = pack(docs, PACK).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    for _, pieces in got.groupby(got.doc_id.isna()):
        whole = pieces[pieces.start == 0].doc_tokens
        assert len(whole) == 5 and whole.sum() == pieces.length.sum() and (whole == 1).sum() == 2


def test_a_very_long_text_is_read_whole(spark):
    """The only toxic word stands at the end of 200,000 words."""
    calm = "ta na re to mi ru so na la ru "
    rows = [(i, calm * (2 + i % 5) + ("grobb " if i % 4 == 0 else "") + calm) for i in range(240)] + [(1000, calm * 20_000 + "grobb ta"), (1001, calm * 20_000)]
    truth = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(spark.createDataFrame(rows, "doc_id long, text string"), truth).where("doc_id >= 1000").collect()}
    assert got[1000].score > got[1001].score
    assert got[1000].n_windows == 200_002 - 15 and got[1000].worst_start >= 200_002 - 16 - 16


@pytest.fixture(scope="module")
def nothing(empty, labels, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    empty.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_of_an_empty_table(spark, empty, nothing):
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, empty, nothing)
        assert made.count() == 0
        if name != "packing":
            assert made.columns == empty.columns
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_stages_keep_further_columns(spark, clashing, labels, nothing):
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, nothing)
        assert set(clashing.columns) - {"removed"} <= set(docs.columns), name
    assert {r[0] for r in docs.select("score").distinct().collect()} == {"own score"}
