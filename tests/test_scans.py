"""Ranges by literal bounds, segmented scans, and the copies of hot objects."""

import pytest
from pyspark.sql import functions as F

from lcspark.operators import aggregate as A
from lcspark.operators import augment as G
from lcspark.operators import ranges
from lcspark.operators import skew
from lcspark.operators import vectors as V
from lcspark.operators import window as W
from lcspark.plans import bindings as B

SF = "/root/testdata/sf0.001"


@pytest.fixture
def numbers(spark):
    rows = [(None if i % 17 == 0 else (i * 37) % 101, float("nan") if i % 13 == 0 else float(i % 7), i) for i in range(400)]
    return spark.createDataFrame(rows, "k bigint, v double, i int").repartition(5)


@pytest.mark.parametrize("n", [1, 4, 17])
def test_global_rank_does_not_depend_on_the_ranges(spark, numbers, n):
    """Nulls first and NaN last, as a plain sort; neighbours cross the ranges."""
    got = W.global_rank(numbers, ["k", "v", "i"], "at", num_partitions=n, neighbours=["i"]).orderBy("at").collect()
    want = [r["i"] for r in numbers.orderBy("k", "v", "i").collect()]
    assert [r["i"] for r in got] == want and [r["at"] for r in got] == list(range(1, 401))
    assert [r["_prev_i"] for r in got] == [None, *want[:-1]] and [r["_next_i"] for r in got] == [*want[1:], None]


def test_bounds_occur_and_cut_evenly(spark):
    df = spark.range(10_000).withColumn("k", (F.col("id") * 7919) % 10_000)
    bounds = ranges.range_bounds(df, ["k"], 8)
    assert len(bounds) == 7
    counts = [r["count"] for r in df.groupBy(ranges.range_of(df, ["k"], bounds).alias("r")).count().collect()]
    assert len(counts) == 8 and max(counts) < 3 * 10_000 / 8
    assert ranges.range_bounds(df.limit(0), ["k"], 8) == [] and ranges.range_bounds(df, ["k"], 1) == []


def test_global_rank_runs_only_the_bounds(spark, monkeypatch):
    df = spark.range(1000)
    bounds = ranges.range_bounds(df, ["id"], 4)
    monkeypatch.setattr(ranges, "range_bounds", lambda *a: bounds)
    sc = spark.sparkContext
    sc.setJobGroup("planned", "planned")
    ranked = W.global_rank(df, ["id"], "at", num_partitions=4)
    jobs = sc.statusTracker().getJobIdsForGroup("planned")
    sc.setJobGroup("other", "other")
    assert not jobs and ranked.where("at = id + 1").count() == 1000


def test_segmented_scan_carries_over_empty_segments(spark):
    rows = [("a", i, float(i * i)) for i in (0, 1, 2, 9, 40, 41)] + [("b", 5, 1.0)]
    df = spark.createDataFrame(rows, "g string, i int, t double").withColumn("s", F.floor(F.col("i") / 3))
    got = ranges.segmented_scan(df, ["g"], "s", ["i"], "n", ["t"]).orderBy("g", "i").collect()
    assert [r["n"] for r in got] == [1, 2, 3, 4, 5, 6, 1]
    assert [r["_prev_t"] for r in got] == [None, 0.0, 1.0, 4.0, 81.0, 1600.0, None]
    assert [r["_next_t"] for r in got] == [1.0, 4.0, 81.0, 1600.0, 1681.0, None, None]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("by_obs", [True, False])
def test_copies_of_hot_objects_equal_the_normal_ones(spark, monkeypatch, by_obs):
    o, m, tie = B.obs_supp(spark, SF), B.meta_supp(spark, SF), B.TIE["obs_supp"]
    monkeypatch.setattr(A, "MAX_ARRAY_LEN", 64)
    samples = V.samples_baseline(o, m, tie, max_len=64)
    ref = rows(G.augment(samples, 2, 5, obs=o, hot_threshold=1 << 40))
    hot = G.augment(samples, 2, 5, obs=o if by_obs else None, hot_threshold=100)
    assert rows(hot) == ref and len(ref) > 10
    plan = hot._jdf.queryExecution().executedPlan().toString()
    assert "_segment" in plan                              # the windows of hot objects are cut by it


def test_a_segment_holds_at_most_the_threshold(spark, monkeypatch):
    o, m, tie = B.obs_supp(spark, SF), B.meta_supp(spark, SF), B.TIE["obs_supp"]
    most = []
    scan = G.segmented_scan

    def counted(df, groups, segment, *rest):
        most.append(df.groupBy(*groups, segment).count().agg(F.max("count")).first()[0])
        return scan(df, groups, segment, *rest)
    monkeypatch.setattr(G, "segmented_scan", counted)
    G.augment(V.samples_baseline(o, m, tie), 2, 5, obs=o, hot_threshold=50).collect()
    assert most and max(most) <= 50


def test_augmented_vectors_of_hot_objects_equal_the_normal_ones(spark):
    o, m, tie = B.obs_supp(spark, SF), B.meta_supp(spark, SF), B.TIE["obs_supp"]
    ref = rows(G.augmented_vectors(o, m, tie, 2, 5, hot_threshold=1 << 40))
    assert skew.hot_object_counts(o, 100)
    assert rows(G.augmented_vectors(o, m, tie, 2, 5, hot_threshold=100)) == ref


def test_hot_copies_without_an_id(spark):
    rows_ = [(k, float(i * 7 % 13), i % 6, float(i), 1.0, i % 2, i) for k, n in ((None, 60), (1, 50), (2, 5)) for i in range(n)]
    o = spark.createDataFrame(rows_, "object_id bigint, mjd double, passband int, flux double, flux_err double, detected int, e int")
    hist = F.array(*[F.col(c).cast("float") for c in ("mjd", "flux", "flux_err", "detected", "mjd", "mjd", "flux", "flux")])
    s = o.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("mjd", "e", "passband", hist.alias("h")))).alias("s")).select(
        "object_id", F.lit(0).alias("chunk"), F.lit(3).alias("target"), F.array(*[F.lit(0.5)] * 10).alias("meta"),
        F.lit(0.1).alias("specz"), F.col("s.passband").alias("band"), F.col("s.h").alias("hist"))
    ref = rows(G.augment(s, 2, 1, obs=o, hot_threshold=1 << 40))
    assert len(ref) == 6 and rows(G.augment(s, 2, 1, obs=o, hot_threshold=20)) == ref


def test_many_copies_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(G, "COPIES_PER_TASK", 4)
    df = spark.createDataFrame([(1, 50), (2, 3), (3, 0), (4, -5), (5, None), (6, 17)], "object_id bigint, n int")
    for most in (None, 50):
        got = G.replicate(df, F.col("n"), most=most)
        assert sorted((r["object_id"], r["replica"]) for r in got.collect()) == \
            [(k, i) for k, n in ((1, 50), (2, 3), (6, 17)) for i in range(1, n + 1)]
        # the last explode of a task makes at most that many copies of a row
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION" in plan
    assert sorted(r["replica"] for r in G.replicate(df.limit(1), 9, start=0).collect()) == list(range(9))
    assert "Exchange" not in G.replicate(df, F.col("n"), most=4)._jdf.queryExecution().executedPlan().toString()


def test_a_rare_class_is_balanced_whole(spark, monkeypatch):
    monkeypatch.setattr(G, "COPIES_PER_TASK", 8)
    df = spark.createDataFrame([(i, 0 if i else 1) for i in range(100)], "object_id bigint, target int")
    got = {r["target"]: r["count"] for r in G.balance_classes(df, 1, augmentate=False).groupBy("target").count().collect()}
    extras = {r["class_index"]: r["extra"] for r in G.balance_counts(df).collect()}
    assert extras[1] == 299 and got == {0: 99 * (1 + extras[0]), 1: 300}
