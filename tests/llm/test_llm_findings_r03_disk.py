"""Findings 1 and 2, pipeline and op4_minhash_near_dedup: what near dedup leaves on disk while it runs."""

import os
import time

import corpus_pipeline
import pytest
from hard_rows import make_docs
from pyspark.sql import functions as F

from lcspark.llm import common, neardup


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f"{d}/{f}" for top in dirs for d, _, files in os.walk(top) for f in files if f.startswith("shuffle_") and f.endswith(".data")}


def left_after(spark, before, rows_of=1):
    """Shuffle files, of ``rows_of`` bytes or more, that stay; Spark removes them a moment after a query has ended."""
    for _ in range(40):
        left = [f for f in shuffle_files(spark) - before if os.path.exists(f) and os.path.getsize(f) >= rows_of]
        if not left:
            break
        time.sleep(0.1)
    return left


def test_a_stored_stage_leaves_no_shuffle_files(spark):
    grouped = spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 100).alias("k")).count()
    before = shuffle_files(spark)
    out = common.staged(grouped.join(spark.range(100).withColumnRenamed("id", "k").hint("merge"), "k"), "no-shuffles")
    assert not left_after(spark, before)
    assert out.count() == 100 and {r["count"] for r in out.collect()} == {50}
    assert grouped.count() == 100                    # the frame itself may still be read


@pytest.mark.parametrize("own", [None, "true", "false"])
def test_the_setting_of_the_session_stays(spark, own):
    other = spark.newSession()
    if own is not None:
        other.conf.set(common._CLEANUP_CONF, own)
    with pytest.raises(ZeroDivisionError), common.shuffles_removed(other):
        assert other.conf.get(common._CLEANUP_CONF) == "true"
        1 / 0
    assert other.conf.get(common._CLEANUP_CONF, None) == own


def test_bands_are_dealt_out_once(spark):
    keys = {1: [128, 257, 386], 2: [128, 1025, 386], 3: [1152, 1025, 642], 4: [9 * 128, 129, 130]}
    reps = common.staged(spark.createDataFrame([(n, k) for n, k in keys.items()], "node bigint, bands array<bigint>"), "test-reps")
    got = neardup.band_members(reps)
    assert {tuple(r) for r in got.collect()} == {
        (128, 0, 1, 1), (128, 0, 2, 2), (386, 2, 1, 1), (386, 2, 2, 2), (1025, 1, 2, 2), (1025, 1, 3, 3), (1152, 0, 3, 3), (1152, 0, 4, 4)}
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ReusedExchange") == 1      # named once more where it is reused


def test_a_key_holds_its_band(spark):
    texts = [" ".join(f"w{i}" for i in range(n, n + 60)) for n in range(3)]
    keys = neardup.band_keys(neardup.registers(neardup.shingle_sets(texts)))
    assert (keys % (1 << neardup.BAND_BITS) == list(range(neardup.BANDS))).all() and neardup.BANDS <= 1 << neardup.BAND_BITS


def test_whole_registers_are_made_of_the_texts_that_need_them(spark):
    texts = ["one two three four five six", "A b", "", None, " ".join(map(str, range(3000)))]
    docs = make_docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    assert "whole" not in neardup.signatures(docs).columns
    want = [x.tolist() for x in neardup.whole_registers(neardup.shingle_sets([t or "" for t in texts]))]
    got = {r["node"]: r["whole"] for r in neardup.whole_of(docs.select(F.col("doc_id").alias("node"), "text")).collect()}
    assert got == dict(enumerate(want)) and len(got[4]) > 1000


def test_near_dedup_keeps_little_on_disk(spark):
    """Shuffle files that stay: a count's (one row of 60 bytes a task), and none of the stored stages'."""
    rows = [(i, " ".join(f"w{(i // 2) * 100 + j}" for j in range(60 - i % 2)), None, None, None) for i in range(200)]
    docs = make_docs(spark, rows)
    before = shuffle_files(spark)
    out = neardup.near_duplicates(docs)
    assert not left_after(spark, before, 100)
    assert {(r["id"], r["component_id"]) for r in out.collect()} == {(i, i - i % 2) for i in range(200)}


def test_the_pipeline_stage_keeps_little_on_disk(spark):
    rows = [(i, " ".join(f"w{(i // 2) * 100 + j}" for j in range(60 - i % 2)), None, None, None) for i in range(200)]
    before = shuffle_files(spark)
    out = corpus_pipeline.drop_near_copies(spark, make_docs(spark, rows), "")
    assert not left_after(spark, before, 100)
    assert {r["doc_id"] for r in out.collect()} == set(range(0, 200, 2))
