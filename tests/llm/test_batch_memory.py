"""Arrow batches and slices of texts stay small, whatever the rows of a batch hold."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from entitlekit.llm import common, decontamination

SF_DIR = "/root/testdata/sf0.001"
TEXT_BYTES = 10_000


@pytest.fixture
def free_bound(spark):
    """The session without a bound of its own, before and after."""
    spark.conf.unset(common.BATCH_BYTES)
    yield
    spark.conf.unset(common.BATCH_BYTES)


def _batch_sizes(spark) -> list[tuple]:
    """(rows, bytes) of the batches in which a worker gets 30 MB of texts."""
    docs = spark.range(3000, numPartitions=1).selectExpr("id as doc_id", f"repeat(char(97 + id % 26), {TEXT_BYTES}) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    return [tuple(r) for r in docs.mapInArrow(sizes, "n long, size long").collect()]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_bound_the_batches(spark, free_bound, name):
    docs = spark.createDataFrame([(1, "some words of a text"), (2, None)], "doc_id long, text string")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF_DIR).count() >= 2
    sizes = _batch_sizes(spark)
    assert sum(n for n, _ in sizes) == 3000
    assert max(size for _, size in sizes) <= common.SLICE_BYTES + 2 * TEXT_BYTES


def test_a_given_bound_stays(spark, free_bound):
    spark.conf.set(common.BATCH_BYTES, str(1 << 20))
    common.small_batches(spark)
    assert spark.conf.get(common.BATCH_BYTES).startswith(str(1 << 20))
    assert max(size for _, size in _batch_sizes(spark)) <= (1 << 20) + 2 * TEXT_BYTES


def test_matching_holds_little_beside_a_batch():
    rng = np.random.default_rng(1)
    some = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 5000, n))
    block = decontamination.block_of([{"item_id": str(i), "text": some(40)} for i in range(50)])
    plan = decontamination.plan_of(block, np.ones(len(block.terms), np.int64))
    text = some(3500)
    n = (24 << 20) // len(text)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([text] * n)], names=["doc_id", "text"])
    tracemalloc.start()
    kept = sum(part.num_rows for part in decontamination.clean_batches(iter([batch]), block, plan))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept == n and peak < 140 << 20
