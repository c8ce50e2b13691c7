"""What keeps an executor's memory low: workers give freed memory back, and whole texts are not shuffled to drop a few rows."""

import psutil
import pytest
from pyspark.sql import functions as F

from tessitura.llm import memory
from tessitura.llm.common import text_key, without_rows


@pytest.mark.skipif(memory._trim is None, reason="no glibc")
def test_a_step_gives_freed_memory_back():
    left = []

    def run(batches):
        for n in batches:
            held = [bytes(2000) for _ in range(n)]
            left.extend(held[::1000])  # what stays in between keeps the heap as long as it was
            yield len(held)

    before = psutil.Process().memory_info().rss
    assert list(memory.lean(run)([100_000])) == [100_000] and len(left) == 100
    assert psutil.Process().memory_info().rss - before < 60e6  # of 200 MB


def test_texts_of_rows_that_stay_are_not_shuffled(spark):
    docs = spark.range(14_000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 9000).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7001).alias("text"), F.lit(1).alias("ROW_MARK"))
    gone = docs.where("doc_id is null or doc_id % 4 > 0").where("length(text) > 2").select("doc_id", text_key().alias("text_key"))
    assert gone.distinct().count() > 10_000
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stay = without_rows(docs, gone)
        plan = stay._jdf.queryExecution().executedPlan().toString()
        want = docs.join(gone.distinct(), docs["doc_id"].eqNullSafe(gone["doc_id"]) & (text_key() == gone["text_key"]), "left_anti").collect()
        assert sorted(map(str, stay.collect())) == sorted(map(str, want)) and stay.columns == docs.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("MapInArrow") == 2 and "Union" in plan  # one branch goes past the join
