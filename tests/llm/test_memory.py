"""What executors and their workers hold of whole texts at once is bounded by bytes."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lumisweep.llm import langid, neardup, substring, words
from lumisweep.llm.common import BATCH_BYTES, bound_batches

CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def spark_limit(spark):
    before = spark.conf.get(CONF)
    spark.conf.set(CONF, "64m")
    yield spark
    spark.conf.set(CONF, before)


@pytest.mark.parametrize("operator", [
    lambda docs: langid.predict(docs, [], np.zeros((0, 0)), ""), substring.without_repeats,
    neardup.near_duplicates])
def test_batches_of_texts_are_bounded(spark_limit, documents, operator):
    operator(documents([(1, "a b c")]))

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])],
                                  names=["n", "size"])

    long = spark_limit.range(0, 3000, 1, 1).selectExpr("id", "repeat('word ', 1000) text")
    found = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 3000
    assert max(r["size"] for r in found) <= 1.1 * BATCH_BYTES


def test_smaller_batches_stay(spark_limit):
    spark_limit.conf.set(CONF, "1000b")
    bound_batches(spark_limit)
    assert spark_limit.conf.get(CONF) == "1000b"


def test_a_text_that_goes_along_is_sent_once(spark, documents):
    docs = documents([(1, "a b"), (2, None), (3, "1 2")])
    model = langid.predict(docs, [], np.zeros((0, 0)), "", carry=["source", "text"])
    assert "_text" not in model._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in model.orderBy("doc_id").select("text", "lang_pred", "source")
            .collect()] == [("a b", "und", "s"), (None, "und", "s"), ("1 2", "und", "s")]


def test_blocks_of_texts_take_little_memory():
    texts = pa.array(["some words of a text " * 500] * 800)
    tracemalloc.start()
    n = sum(len(block.hashes) for block in words.text_blocks(texts, lower=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 800 * 500 * 5
    assert peak < 32 << 20
