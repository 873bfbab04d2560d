"""Finding 2, pipeline: what Python workers get at a time, and keep."""

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lcspark.llm import common, packing, queries

CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_long_texts_are_small(spark):
    """8,000 texts of 4 KB come in batches of about 4 MB, not as one of 32."""
    common.ship_package(spark)
    df = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("abcd"), 1024).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64()), "size": pa.array([batch.nbytes], pa.int64())})
    found = df.mapInArrow(run, "n bigint, size bigint").collect()
    assert sum(r["n"] for r in found) == 8000 and max(r["size"] for r in found) < 1.1 * common.BATCH_BYTES


def test_a_limit_of_the_session_stays(spark):
    other = spark.newSession()
    other.conf.set(CONF, "123456")
    common.limit_batches(other)
    assert other.conf.get(CONF) == "123456b" or other.conf.get(CONF) == "123456"


def test_arrow_gives_memory_back_after_a_task(monkeypatch):
    given = []

    class Pool:
        def release_unused(self):
            given.append(len(seen))
    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (3, 0, 1200)]
    seen = []
    for part in common.parts(iter(batches)):
        seen.append(part.num_rows)
    assert seen == [3, 500, 500, 200] and given == [4]


def test_lengths_come_without_workers_of_another_kind(spark, monkeypatch):
    """The list of lengths is an Arrow table, so no task makes rows of it in
    Python workers that differ from those of the texts."""
    given, create = [], SparkSession.createDataFrame
    docs = spark.createDataFrame([(1, "one two"), (2, None), (2, None)], "doc_id bigint, text string")
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, data, *a, **b: given.append(type(data)) or create(self, data, *a, **b))
    got = packing.pack_documents(docs, queries.word_tokenizer())
    assert sorted((r["id"], r["length"]) for r in got.collect())[1:] == [(2, 1), (2, 1)]
    assert packing.pack_documents(docs.limit(0), queries.word_tokenizer()).count() == 0
    assert set(given) == {pa.Table}
