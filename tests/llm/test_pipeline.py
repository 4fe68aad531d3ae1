import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stored(docs, labels, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_in_turn(spark, docs, stored):
    kept = spark.read.parquet(f"{stored}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_copies", "mixing", "packing"]
    before = kept
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, stored).cache()
        assert after.columns == docs.columns
        if name == "quality":
            assert after.where("doc_id between 120 and 140").count() == 0
        if name == "lines":
            assert after.where(F.col("n_chars") != F.length("text")).count() == 0
        if name != "mixing":
            ids = {r[0] for r in after.select("doc_id").collect()}
            assert ids <= {r[0] for r in before.select("doc_id").collect()}
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, stored).toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_run(spark, stored):
    made = corpus_pipeline.run(spark, stored)
    assert made.count() > 0 and "sequence_id" in made.columns
