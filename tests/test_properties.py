"""Property tests: array functions against plain Python/numpy definitions
on random inputs (one Spark job per generated batch)."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lcspark.functions import arrays as FA

finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False, width=32)
batches = st.lists(st.lists(finite, max_size=12), min_size=1, max_size=20)


def run(spark, data, *cols):
    df = spark.createDataFrame([(i, [float(x) for x in a]) for i, a in enumerate(data)], "i int, x array<double>")
    return [tuple(r[1:]) for r in sorted(df.select("i", *cols).collect())]


def pre_pad(a, n):
    return ([0.0] * max(0, n - len(a)) + list(a))[-n:] if n else []


@settings(max_examples=15, deadline=None)
@given(batches, st.integers(min_value=1, max_value=16))
def test_pad_array_is_pre_pad_pre_truncate(spark, data, n):
    got = run(spark, data, FA.pad_array("x", n, 0, "double").alias("p"))
    assert [g[0] for g in got] == [pre_pad(a, n) for a in data]


@settings(max_examples=15, deadline=None)
@given(batches)
def test_diffs_match_ediff1d(spark, data):
    got = run(spark, data, FA.forward_diff("x").alias("f"), FA.backward_diff("x").alias("b"))
    for (f, b), a in zip(got, data):
        if not a:
            assert f == [] and b == []
            continue
        x = np.array(a, dtype=float)
        assert np.allclose(f, np.ediff1d(x, to_begin=[0])) and np.allclose(b, np.ediff1d(x, to_end=[0]))


@settings(max_examples=15, deadline=None)
@given(batches)
def test_hist_matrix_is_transpose(spark, data):
    got = run(spark, data, FA.hist_matrix([F.col("x"), F.transform("x", lambda v: v * 2)]).alias("m"))
    for (m,), a in zip(got, data):
        assert m == [[v, v * 2] for v in a]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=14), min_size=1, max_size=30), st.integers(0, 1))
def test_one_hot_and_argmax(spark, idx, offset):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(idx)], "i int, k int")
    rows = sorted(df.select("i", FA.one_hot("k", 15, offset).alias("v")).collect())
    for (i, v), k in zip(rows, idx):
        exp = [1.0 if j + offset == k else 0.0 for j in range(15)]
        assert v == exp
    arg = sorted(df.select("i", FA.argmax(FA.one_hot("k", 15, 0)).alias("a")).collect())
    assert [r.a for r in arg] == idx
