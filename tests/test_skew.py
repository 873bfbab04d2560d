"""Hot objects: the split paths give exactly the rows of the normal paths."""

import pytest
from pyspark.sql import functions as F

from lcspark.operators import aggregate as A
from lcspark.operators import skew
from lcspark.operators import vectors as V
from lcspark.operators import window as W
from lcspark.plans import bindings as B

SF = "/root/testdata/sf0.001"


@pytest.fixture
def hot_threshold(monkeypatch):
    def set_(n):
        monkeypatch.setattr(skew, "HOT_OBJECT_ROWS", n)
    return set_


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_hot_detection_is_bounded(spark):
    o = B.obs_supp(spark, SF)
    hot = skew.hot_object_counts(o, 500)
    n = o.count()
    assert len(hot) <= n // 500 and all(c > 500 for _, c in hot)


@pytest.mark.parametrize("binding,threshold", [("obs_supp", 400), ("obs_part", 5)])
def test_hot_series_chunks_equal_normal(spark, hot_threshold, binding, threshold):
    o, m, tie = B.OBS[binding](spark, SF), B.META[binding](spark, SF), B.TIE[binding]
    hot_threshold(1 << 40)
    ref = V.samples_baseline(o, m, tie, max_len=64)
    ref_arr = A.collect_arrays(o, tie, max_len=64)
    hot_threshold(threshold)
    assert skew.hot_object_counts(o) != []
    got = V.samples_baseline(o, m, tie, max_len=64)
    got_arr = A.collect_arrays(o, tie, max_len=64)
    assert rows(got) == rows(ref)
    assert rows(got_arr) == rows(ref_arr)


@pytest.mark.parametrize("binding,threshold,length", [("obs_supp", 400, 256), ("obs_part", 5, 32),
                                                      ("obs_supp", 100, 700)])
def test_hot_last_series_equal_normal(spark, hot_threshold, binding, threshold, length):
    o, m, tie = B.OBS[binding](spark, SF), B.META[binding](spark, SF), B.TIE[binding]
    hot_threshold(1 << 40)
    ref = rows(V.vectors_padded(o, m, tie, length, augment=True, seed=3))
    ref_net = rows(V.network_input_from_obs(o, m, tie, length))
    hot_threshold(threshold)
    assert rows(V.vectors_padded(o, m, tie, length, augment=True, seed=3)) == ref
    assert rows(V.network_input_from_obs(o, m, tie, length)) == ref_net


def test_hot_plan_spreads_the_object(spark, hot_threshold):
    hot_threshold(400)
    o, tie = B.obs_supp(spark, SF), B.TIE["obs_supp"]
    df = A.collect_arrays(o, tie, max_len=64)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # hot rows are numbered in ranges, and their chunks are hashed by (object_id, chunk)
    assert "hashpartitioning(_range" in plan
    assert "hashpartitioning(object_id" in plan and "chunk" in plan


@pytest.mark.parametrize("binding,threshold", [("obs_supp", 400), ("obs_part", 5)])
def test_hot_window_operators_equal_normal(spark, hot_threshold, binding, threshold):
    from lcspark.operators import window as W
    o, tie = B.OBS[binding](spark, SF), B.TIE[binding]

    def all_ops():
        return {
            "asc": W.rank_asc(o, tie), "desc": W.rank_desc(o, tie),
            "elapsed": W.elapsed_time(o, tie, scale=100.0),
            "delta": W.delta_time(o, tie), "lead": W.lead_time(o, tie),
            "aligned": W.reverse_elapsed(o, tie, "aligned"), "mirrored": W.reverse_elapsed(o, tie, "mirrored"),
            "intervals": W.interval_features(o, tie), "last": W.keep_last(o, tie, 50),
        }
    hot_threshold(1 << 40)
    ref = {k: rows(v) for k, v in all_ops().items()}
    hot_threshold(threshold)
    assert skew.hot_object_counts(o) != []
    got = {k: rows(v) for k, v in all_ops().items()}
    for k in ref:
        assert got[k] == ref[k], k


def test_sampled_detection_finds_large_objects(spark):
    # 30 objects of 20 rows and one of 60,000: with threshold 20,000 the
    # detection samples 10% and still finds only the large one
    df = spark.range(60600).select(
        F.when(F.col("id") < 60000, F.lit(999)).otherwise(F.col("id") % 30).cast("bigint").alias("object_id"))
    hot = skew.hot_object_counts(df, 20000)
    assert [h[0] for h in hot] == [999] and 50000 < hot[0][1] < 70000


# ----------------------------------------------------- objects without an id

OPERATORS = {
    "rank_asc": lambda o, t: W.rank_asc(o, t), "rank_desc": lambda o, t: W.rank_desc(o, t),
    "elapsed": lambda o, t: W.elapsed_time(o, t), "delta": lambda o, t: W.delta_time(o, t), "lead": lambda o, t: W.lead_time(o, t),
    "reverse": lambda o, t: W.reverse_elapsed(o, t), "interval": lambda o, t: W.interval_features(o, t),
    "keep_last": lambda o, t: W.keep_last(o, t, 7), "normalise": lambda o, t: W.range_normalise(o),
    "arrays": lambda o, t: A.collect_arrays(o, t), "nested": lambda o, t: A.nested_arrays(o, t),
    "hist": lambda o, t: A.hist_struct(o, t, {"flux": ("flux", "double")}),
    "pad": lambda o, t: V.pad_observations(o, t, 9), "raw": lambda o, t: V.vectors_raw(o, t),
    "pivot": lambda o, t: A.pivot_feature(o, "flux", tie=t)}


@pytest.mark.parametrize("null_is_hot", [True, False])
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_without_object_id_are_kept(spark, hot_threshold, name, null_is_hot):
    """Null ids are an object like any other, hot or not, beside hot and normal objects."""
    n_null = 60 if null_is_hot else 6
    rows_ = [(k, float(i * 7 % 13), i % 6, float(i), 1.0, i % 2, i)
             for k, n in ((None, n_null), (1, 50), (2, 5), (3, 1)) for i in range(n)]
    o = spark.createDataFrame(rows_, "object_id bigint, mjd double, passband int, flux double, flux_err double, detected int, e int")
    hot_threshold(1 << 40)
    ref = sorted(map(repr, OPERATORS[name](o, ["e"]).collect()))
    hot_threshold(20)
    assert {k for k, _ in skew.hot_object_counts(o)} == ({None, 1} if null_is_hot else {1})
    assert sorted(map(repr, OPERATORS[name](o, ["e"]).collect())) == ref


def test_group_limit_before_the_shuffle(spark):
    o, tie = B.obs_supp(spark, SF), B.TIE["obs_supp"]
    plan = W.keep_last(o, tie, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_one_detection_per_source(spark, monkeypatch):
    from lcspark.plans.registry import QUERIES
    from lcspark.plans import queries  # noqa: F401
    calls = []
    detect = skew.detect_hot_objects
    monkeypatch.setattr(skew, "detect_hot_objects", lambda *a: calls.append(1) or detect(*a))
    skew._CACHE.clear()
    QUERIES["drop_observations"](spark, SF).collect()
    assert len(calls) == 1
