"""What the pipeline leaves in the driver's memory."""

import psutil
from docweave.llm.op8_linededup import NO_ID, LineSettings, keyed_lines, places
from docweave.llm.shared import discarding, release_memory
from pyspark.sql import functions as F


def test_ranks_stay_out_of_plan_descriptions(spark, docs):
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), "text")
    with discarding(spark):
        keyed, at = places(keyed)
        plans = keyed_lines(keyed, at, LineSettings())._jdf.queryExecution()
        assert len(plans.toString()) < 200_000  # millions with a literal of 2**18 ranks
        assert "_ranks" not in plans.optimizedPlan().toString()  # and no row holds them


def test_freed_memory_goes_back():
    held = [bytes(2000) for _ in range(40_000)]  # glibc's heap shrinks by itself only from its end
    held = held[::100]
    before = psutil.Process().memory_info().rss
    release_memory()
    assert before - psutil.Process().memory_info().rss > 40 << 20
    assert len(held) == 400
