"""Texts dealt to all tasks, copies side by side, with bounded results in Python."""

import gc
import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import catalogue
from lodestone.functions import arrow

SF_DIR = "/root/testdata/sf0.001"


def test_copies_meet_and_a_frequent_text_is_dealt(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "often").otherwise(F.concat(F.lit("t"), F.col("id") % 100)).alias("text")).coalesce(1)
    dealt = arrow.gathered(rows, "text").select("*", F.spark_partition_id().alias("p")).collect()
    assert len(dealt) == 4000 and len({r.p for r in dealt if r.text == "often"}) > 1
    for p in {r.p for r in dealt}:
        texts = [r.text for r in dealt if r.p == p]
        assert texts == sorted(texts)


def test_few_results_are_held_as_python_objects():
    class Result(dict):
        pass

    made, most = [], [0]

    def results():
        for i in range(5000):
            one = Result(n=i)
            made.append(weakref.ref(one))
            if i % 100 == 0:
                gc.collect()
                most[0] = max(most[0], sum(r() is not None for r in made))
            yield one

    got = arrow._in_slices(results(), pa.struct([("n", pa.int64())]))
    assert got.field("n").to_pylist() == list(range(5000)) and most[0] <= 2 * arrow.SLICE + 2


@pytest.mark.parametrize("name", ["template_histogram", "second_pass_report", "glued_walls", "dictionary_words", "unified_extract"])
def test_texts_go_to_all_tasks(spark, name):
    frame = catalogue.queries()[name](spark, SF_DIR)
    assert "rangepartitioning(" in frame._jdf.queryExecution().toString()


def test_pressures_are_coded_by_description(spark):
    assert "hashpartitioning(description" in catalogue.queries()["pressure_spans"](spark, SF_DIR)._jdf.queryExecution().toString()
