"""Column and array functions on hand-made fixtures (FIXTURES section 2)."""

import math

import pytest
from pyspark.sql import functions as F

from lcspark.functions import arrays as FA
from lcspark.functions import expr as X
from lcspark.functions.rng import keyed_normal, keyed_uniform


def one(spark, col, schema="x array<double>", data=None):
    df = spark.createDataFrame(data or [([1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0],)], schema)
    return df.select(col.alias("r")).collect()[0]["r"]


def test_forward_backward_diff_tiny_obs(spark):
    # the series 1, 2, 4, ..., 64 of object 615
    assert one(spark, FA.forward_diff("x")) == [0, 1, 2, 4, 8, 16, 32]
    assert one(spark, FA.backward_diff("x")) == [1, 2, 4, 8, 16, 32, 0]


def test_diff_edge_lengths(spark):
    assert one(spark, FA.forward_diff("x"), data=[([],)]) == []
    assert one(spark, FA.forward_diff("x"), data=[([5.0],)]) == [0]
    assert one(spark, FA.backward_diff("x"), data=[([5.0],)]) == [0]


def test_pad_array_front_pad_and_keep_last(spark):
    assert one(spark, FA.pad_array("x", 10)) == [0, 0, 0, 1, 2, 4, 8, 16, 32, 64]
    assert one(spark, FA.pad_array("x", 3)) == [16, 32, 64]
    assert one(spark, FA.pad_array("x", 7)) == [1, 2, 4, 8, 16, 32, 64]


def test_one_hot_offsets(spark):
    df = spark.createDataFrame([(0,), (3,), (14,)], "t int")
    rows = df.select(FA.one_hot("t", 15, 0).alias("a"), FA.one_hot("t", 15, 1).alias("b")).collect()
    assert [r["a"].index(1.0) for r in rows] == [0, 3, 14]
    assert sum(rows[0]["b"]) == 0.0          # index 0 is all zeros with offset 1
    assert rows[1]["b"].index(1.0) == 2


def test_map_target_unknown_and_null(spark):
    df = spark.createDataFrame([(6,), (15,), (99,), (17,), (None,)], "t int")
    got = [r[0] for r in df.select(X.map_target("t")).collect()]
    assert got == [0, 1, 14, 14, 14]


def test_wavelengths(spark):
    df = spark.createDataFrame([(0, 0.0), (5, 1.0), (9, 0.5), (2, -1.0)], "p int, z double")
    rows = df.select(X.received_wavelength("p"), X.source_wavelength("p", "z"),
                     X.received_frequency("p")).collect()
    assert rows[0][0] == pytest.approx(0.357) and rows[0][1] == pytest.approx(0.357)
    assert rows[1][1] == pytest.approx(1004 / 2 / 1000)
    assert rows[2][0] == pytest.approx(1.004)          # out of range -> last band
    assert rows[3][1] is None                          # z = -1 guarded
    assert rows[0][2] == pytest.approx(300000 / 357)


def test_photoz_positive_and_band(spark):
    df = spark.createDataFrame([(0.0, 0), (0.3, 5)], "z double, p int")
    rows = df.select(X.photoz_positive("z"), X.band_index("p")).collect()
    assert [tuple(r) for r in rows] == [(0, 1), (1, 6)]


def test_log2_pow_zero_range_is_null(spark):
    df = spark.createDataFrame([(0.0,), (8.0,)], "r double")
    assert [r[0] for r in df.select(X.log2_pow("r")).collect()] == [None, pytest.approx(8.0)]


def test_clip_and_argmax(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.5],)], "p array<double>")
    r = df.select(F.transform("p", lambda x: X.clip(x, 1e-15, 1 - 1e-15)).alias("c"),
                  FA.argmax("p").alias("a")).collect()[0]
    assert r["c"][0] == 1e-15 and r["c"][1] == 1 - 1e-15 and r["a"] == 1


def test_hist_matrix_and_slice(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert one(spark, FA.hist_matrix([F.col("a"), F.col("b")]), "a array<double>, b array<double>",
               [([1.0, 2.0], [3.0, 4.0])]) == [[1.0, 3.0], [2.0, 4.0]]
    flat = list(range(10)) + [7, 8] + list(range(100, 116))
    s = one(spark, FA.slice_features("x", 10, 2, 8), "x array<double>", [([float(v) for v in flat],)])
    assert s["meta"] == list(range(10)) and s["band"] == [7, 8]
    assert s["hist"][0] == [100, 102, 104, 106, 108, 110, 112, 114]


def test_vector_round_trip(spark):
    r = one(spark, FA.vector_array(FA.to_dense(FA.to_vector("x"))))
    assert r == [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]


def test_keyed_uniform_is_pure_and_in_range(spark):
    df = spark.range(1000).select(F.col("id"))
    a = df.select(keyed_uniform(1, "t", "id").alias("u")).collect()
    b = df.repartition(7).select("id", keyed_uniform(1, "t", "id").alias("u")).orderBy("id").collect()
    assert [r.u for r in a] == [r.u for r in b]
    assert all(0.0 <= r.u < 1.0 for r in a)
    assert 0.4 < sum(r.u for r in a) / 1000 < 0.6


def test_keyed_uniform_matches_formula(spark):
    import hashlib
    u = spark.range(1).select(keyed_uniform(7, "flux", F.lit(615), F.lit(3))).collect()[0][0]
    h = hashlib.md5(b"615|3|flux|7").hexdigest()
    assert u == int(h[:8], 16) / 2 ** 32


def test_keyed_normal_moments(spark):
    rows = spark.range(20000).select(keyed_normal(3, "n", "id").alias("z")).collect()
    zs = [r.z for r in rows]
    mean = sum(zs) / len(zs)
    var = sum((z - mean) ** 2 for z in zs) / len(zs)
    assert abs(mean) < 0.05 and abs(math.sqrt(var) - 1) < 0.05


def test_round6_is_identical_in_spark_and_duckdb(spark):
    import duckdb

    from lcspark.plans.registry import r6
    from lcspark.plans.sql import r6 as r6s
    vals = [51871.4158355, 0.0000005, -0.0000005, 1.2345665, 2.5e-7, 123456.7890125, -3.1415925, 0.1 + 0.2]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double").select(r6("x")).collect()]
    con = duckdb.connect()
    exp = [con.execute(f"SELECT {r6s('x')} FROM (SELECT CAST(? AS DOUBLE) AS x)", [v]).fetchone()[0] for v in vals]
    assert got == exp
