"""Operators on the hand-made fixtures of FIXTURES section 2, plus the
properties of section 5 (padded length, deltas, pivot round trip, replicas,
splits)."""

import pytest
from pyspark.sql import functions as F

from lcspark.operators import aggregate as A
from lcspark.operators import augment as G
from lcspark.operators import ml as M
from lcspark.operators import project as C
from lcspark.operators import vectors as V
from lcspark.operators import window as W
from lcspark.schema import OBSERVATION_SCHEMA

OBS = "object_id bigint, mjd double, passband int, flux double, flux_err double, detected int, k int"
META = ("object_id bigint, ra double, decl double, gal_l double, gal_b double, ddf int, hostgal_specz double, "
        "hostgal_photoz double, hostgal_photoz_err double, distmod double, mwebv double, target int")
TIE = ["k"]


def obs(spark, rows):
    return spark.createDataFrame(rows, OBS)


def meta_row(oid, photoz=0.5, target=92, specz=0.0):
    return (oid, 0.0, 0.0, 0.0, 0.0, 1, specz, photoz, photoz / 10, None if photoz == 0 else 40 + photoz,
            0.02, target)


@pytest.fixture
def ragged(spark):
    rows = []
    for oid, n in ((1, 1), (2, 3), (3, 300)):
        rows += [(oid, 59000.0 + i, i % 6, 10.0 * i - 5, 1.0, i % 2, i) for i in range(n)]
    return obs(spark, rows)


def test_padding_lengths_and_front_pad(spark, ragged):
    p = {r.object_id: r for r in V.pad_observations(ragged, TIE, 256).collect()}
    assert all(len(r.mjd) == 256 for r in p.values())
    assert p[1].mjd[:255] == [0.0] * 255 and p[1].mjd[255] == 59000.0
    assert p[2].flux[-3:] == [-5.0, 5.0, 15.0]
    assert p[3].mjd[0] == 59000.0 + 44 and p[3].mjd[-1] == 59000.0 + 299   # latest 256 kept


def test_padding_relational_equals_array(spark, ragged):
    arr = V.pad_observations(ragged, TIE, 256).select(
        "object_id", F.posexplode(F.arrays_zip("mjd", "flux")).alias("pos", "z")).select(
        "object_id", "pos", "z.mjd", "z.flux")
    rel = V.pad_observations_relational(ragged, TIE, 256).select("object_id", "pos", "mjd", "flux")
    assert sorted(arr.collect()) == sorted(rel.collect())


def test_flat_flux_gives_null_but_keeps_length(spark):
    o = obs(spark, [(7, 59000.0 + i, 0, 3.0, 1.0, 0, i) for i in range(5)])
    m = A.flux_modifiers(o).collect()[0]
    assert m.flux_pow is None and m.hist_modifier is None
    meta = spark.createDataFrame([meta_row(7)], META)
    v = V.vectors_calculated(o, meta, TIE).collect()[0]
    assert len(v.hist[0].flux) == 5 and all(x is None for x in v.hist[0].flux)
    assert len(v.band) == 5


def test_tie_break_orders_equal_times(spark):
    o = obs(spark, [(1, 5.0, 0, 1.0, 1.0, 0, 2), (1, 5.0, 1, 2.0, 1.0, 0, 1), (1, 4.0, 2, 3.0, 1.0, 0, 3)])
    r = sorted(W.rank_asc(o, TIE).collect(), key=lambda r: r.rownum)
    assert [x.k for x in r] == [3, 1, 2]
    d = {x.k: x.rownum_desc for x in W.rank_desc(o, TIE).collect()}
    assert d == {2: 1, 1: 2, 3: 3}
    arr = A.collect_arrays(o, TIE).collect()[0]
    assert arr.passband == [2, 1, 0]


def test_missing_channel_keeps_alignment(spark):
    o = obs(spark, [(1, 1.0, 0, 1.0, 1.0, 0, 1), (1, 2.0, 1, None, 1.0, 1, 2), (1, 3.0, 2, 5.0, 1.0, 0, 3)])
    arr = A.collect_arrays(o, TIE).collect()[0]
    assert arr.flux == [1.0, None, 5.0] and arr.passband == [0, 1, 2]


def test_galactic_filters(spark):
    o = obs(spark, [(1, 1.0, 0, 1.0, 1.0, 0, 1), (2, 1.0, 0, 1.0, 1.0, 0, 1)])
    meta = spark.createDataFrame([meta_row(1, photoz=0.0), meta_row(2, photoz=0.4)], META)
    assert [r.object_id for r in C.galactic_filter(o, meta, True).collect()] == [2]
    assert [r.object_id for r in C.galactic_filter(o, meta, False).collect()] == [1]
    assert C.galactic_filter(o, meta, None).count() == 2
    assert C.use_specz(meta).filter("hostgal_photoz_err != 0").count() == 0


def test_class_shares_by_class(spark):
    df = spark.createDataFrame([(0,), (0,), (2,), (5,)], "target int")   # classes 1, 3, 4 absent
    s = {r.class_index: r.share for r in A.class_shares(df).collect()}
    assert s[0] == 0.5 and s[2] == 0.25 and s[5] == 0.25
    assert s[1] == 1.0 and s[3] == 1.0 and s[14] == 1.0 and len(s) == 15


def test_weighted_log_loss_clips(spark):
    probs = [[1.0] + [0.0] * 14, [0.0] * 15, [1 / 15] * 15, [0.0, 1.0] + [0.0] * 13]
    df = spark.createDataFrame([(0, probs[0]), (0, probs[1]), (1, probs[2]), (1, probs[3])],
                               "label int, probs array<double>")
    shares = A.class_shares(df, "label")
    loss = M.weighted_log_loss(df, shares).collect()[0][0]
    import math
    eps = 1e-15
    # class 0 (code 6, w 1, share .5): ln(1-eps) + ln(eps); class 1 (code 15, w 2, share .5): ln(1/15) + ln(1-eps)
    expect = -((math.log(1 - eps) + math.log(eps)) * 1 / 0.5 + (math.log(1 / 15) + math.log(1 - eps)) * 2 / 0.5) / 17 / 4
    assert loss == pytest.approx(expect)
    assert math.isfinite(M.training_loss(df, shares).collect()[0][0])


def test_sum_of_deltas_is_last_elapsed(spark, ragged):
    f = W.interval_features(ragged, TIE)
    g = f.groupBy("object_id").agg(F.sum("delta_mjd").alias("s"), F.max("interval").alias("m")).collect()
    assert all(r.s == pytest.approx(r.m) for r in g)


def test_pivot_unpivot_round_trip(spark, ragged):
    small = ragged.filter("object_id < 3")
    wide = A.pivot_feature(small, "flux", 8, TIE)
    back = A.unpivot_feature(wide, "flux", 8).collect()
    ranked = W.rank_asc(small, TIE).select("object_id", "rownum", "flux").collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, ranked))


def test_mirrored_reverse_interval(spark, ragged):
    small = ragged.filter("object_id = 2")   # mjd 59000, 59001, 59002
    got = {r.k: r.rval for r in W.reverse_elapsed(small, TIE, "mirrored").collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0}     # row k gets the value of row n+1-k
    al = {r.k: r.rval for r in W.reverse_elapsed(small, TIE, "aligned").collect()}
    assert al == {0: 2.0, 1: 1.0, 2: 0.0}


def test_replicas_and_splits(spark):
    df = spark.range(100).select(F.col("id").alias("object_id"), (F.col("id") % 3).alias("n"))
    assert G.replicate(df, 3).count() == 300
    assert G.replicate(df, F.col("n")).count() == sum(i % 3 for i in range(100))
    s = G.split(G.replicate(df, 4), [0.8, 0.1, 0.1], 42)
    per = s.groupBy("object_id").agg(F.countDistinct("split").alias("k")).collect()
    assert all(r.k == 1 for r in per) and len(per) == 100


def test_global_rank_is_dense_and_ordered(spark, ragged):
    g = W.global_rank(ragged, ["object_id", "mjd", "k"], num_partitions=5).select(
        "object_id", "mjd", "k", "global_rownum").collect()
    g = sorted(g, key=lambda r: r.global_rownum)
    assert [r.global_rownum for r in g] == list(range(1, 305))
    assert [(r.object_id, r.mjd, r.k) for r in g] == sorted((r.object_id, r.mjd, r.k) for r in g)


def test_augment_drop_rate_and_clamp(spark):
    o = obs(spark, [(1, 59000.0 + i, i % 6, 10.0 * i, 1.0, 0, i) for i in range(400)])
    meta = spark.createDataFrame([meta_row(1, photoz=4.9)], META)
    s = V.samples_baseline(o, meta, TIE)
    a = G.augment(s, 5, 1).collect()
    assert len(a) == 5
    for r in a:
        assert 0.55 < len(r.hist) / 400 < 0.85
        assert 0.0 <= r.meta[5] <= 5.0
        assert len(r.band) == len(r.hist)


def test_baseline_samples_values(spark):
    o = obs(spark, [(9, 59000.0 + 100 * i, i, 2.0 ** i, 1.0, 1, i) for i in range(3)])
    meta = spark.createDataFrame([meta_row(9, photoz=1.0, target=15)], META)
    s = V.samples_baseline(o, meta, TIE).collect()[0]
    assert s.target == 1 and s.band == [1, 2, 3]
    h = s.hist
    assert [row[0] for row in h] == [0.0, 0.5, 1.0]           # (mjd - first) / 100 / (1 + z)
    assert [row[4] for row in h] == [0.0, 0.5, 0.5]           # forward intervals
    assert [row[5] for row in h] == [0.5, 0.5, 0.0]           # backward intervals
    assert h[0][1] == pytest.approx(1 / 3)                    # flux / (max - min)
    assert h[0][6] == pytest.approx(357 / 2 / 1000) and h[0][7] == pytest.approx(0.357)
    assert s.meta[5] == 1.0 and s.meta[8] == 1.0


def test_network_input_shapes(spark, ragged):
    meta = spark.createDataFrame([meta_row(i) for i in (1, 2, 3)], META)
    n = V.network_input(V.samples_baseline(ragged, meta, TIE), 256).collect()
    for r in n:
        assert len(r.band) == 256 and len(r.hist) == 256 and len(r.target_onehot) == 15
        assert all(row[0] == 0 and row[3] == 0 and row[7] == 0 for row in r.hist)


def test_vectors_padded_shapes(spark, ragged):
    meta = spark.createDataFrame([meta_row(i) for i in (1, 2, 3)], META)
    for aug in (False, True):
        v = V.vectors_padded(ragged, meta, TIE, 256, augment=aug, seed=3).collect()
        for r in v:
            h = r.hist[0]
            assert len(r.band) == 256 and all(len(h[c]) == 256 for c in h.asDict())
            assert h.interval[0] == 0.0 and all(x >= 0 for x in h.deltaMjd)


def test_balance_counts(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2 + [(2,)], "target int")
    got = {r.class_index: r.extra for r in G.balance_counts(df).collect()}
    # shares 6/9, 2/9, 1/9 and 1 for absent classes, so max share = 1:
    # extra copies = int(3 * max / share) - 1
    ex = {c: int(3.0 * 1.0 / sh) - 1 for c, sh in ((0, 6 / 9), (1, 2 / 9), (2, 1 / 9), (5, 1.0))}
    assert got[0] == ex[0] == 3 and got[1] == ex[1] == 12 and got[2] == ex[2] and got[5] == 2
    b = G.balance_classes(df.withColumn("object_id", F.monotonically_increasing_id()), 1, augmentate=False)
    assert b.count() == 6 * (1 + ex[0]) + 2 * (1 + ex[1]) + 1 * (1 + ex[2])


def test_schema_constants():
    assert [f.name for f in OBSERVATION_SCHEMA.fields] == ["object_id", "mjd", "passband", "flux", "flux_err",
                                                           "detected"]


def _exploded(df, cols, chunked=True):
    from lcspark.plans.registry import explode_arrays
    return sorted(map(tuple, explode_arrays(df, ["object_id"], {c: F.col(c) for c in cols}).collect()))


def test_chunked_arrays_are_whole_and_ordered(spark, ragged):
    from lcspark.operators.aggregate import MAX_ARRAY_LEN
    small = A.collect_arrays(ragged, TIE, max_len=7)
    assert small.filter("object_id = 3").count() == -(-300 // 7)        # 43 chunks, none dropped
    assert max(len(r.mjd) for r in small.collect()) <= 7
    big = A.collect_arrays(ragged, TIE)
    # same rows once (chunk, pos) is turned into the position in the object
    rows_small = [(o, p % MAX_ARRAY_LEN + (p // MAX_ARRAY_LEN) * 7, m) for o, p, m in _exploded(small, ["mjd"])]
    assert sorted(rows_small) == _exploded(big, ["mjd"])


def test_chunked_baseline_intervals_match_unchunked(spark, ragged):
    meta = spark.createDataFrame([meta_row(i) for i in (1, 2, 3)], META)
    big = V.samples_baseline(ragged, meta, TIE).filter("object_id = 3").collect()[0]
    parts = sorted(V.samples_baseline(ragged, meta, TIE, max_len=16).filter("object_id = 3").collect(),
                   key=lambda r: r.chunk)
    rows = [row for p in parts for row in p.hist]
    assert len(parts) == 19 and rows == big.hist          # intervals cross chunk borders correctly


def test_bounded_network_input_equals_full(spark, ragged):
    meta = spark.createDataFrame([meta_row(i) for i in (1, 2, 3)], META)
    full = {r.object_id: r for r in V.network_input(V.samples_baseline(ragged, meta, TIE), 64).collect()}
    bounded = {r.object_id: r for r in V.network_input_from_obs(ragged, meta, TIE, 64).collect()}
    assert full.keys() == bounded.keys()
    for k in full:
        assert full[k].hist == bounded[k].hist and full[k].band == bounded[k].band


def test_baseline_limit_counts_after_filter(spark, ragged):
    meta = spark.createDataFrame([meta_row(1, photoz=0.0), meta_row(2), meta_row(3)], META)
    got = [r.object_id for r in V.samples_baseline(ragged, meta, TIE, extragalactic=True, limit=1).collect()]
    assert got == [2]


def test_scale_conf_sizes_partitions():
    from lcspark.session import scale_conf
    c = scale_conf(100 * 1024 ** 4, 4000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_conf(1, 8)["spark.sql.shuffle.partitions"]) == 16


@pytest.mark.parametrize("binding", ["obs_part", "obs_supp", "obs_event"])
def test_relational_equals_array_on_every_binding(spark, binding):
    from lcspark.plans import bindings as B
    sf = "/root/testdata/sf0.001"
    o, m, tie = B.OBS[binding](spark, sf), B.META[binding](spark, sf), B.TIE[binding]
    length = 32
    arr = V.pad_observations(o, tie, length).select(
        "object_id", F.posexplode(F.arrays_zip(*V.CHANNELS)).alias("pos", "z")).select(
        "object_id", "pos", *[F.col(f"z.{c}").alias(c) for c in V.CHANNELS])
    rel = V.pad_observations_relational(o, tie, length).select("object_id", "pos", *V.CHANNELS)
    assert sorted(map(tuple, arr.collect())) == sorted(map(tuple, rel.collect()))
    for aug in (False, True):
        a = V.vectors_padded(o, m, tie, length, augment=aug, seed=5)
        r = V.vectors_padded_relational(o, m, tie, length, augment=aug, seed=5)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, r.select(*a.columns).collect()))


def test_pivot_width_comes_from_the_data(spark):
    rows_ = [(k, float(i), 0, float(i), 1.0, 0) for k, n in ((1, 90), (2, 3)) for i in range(n)]
    o = spark.createDataFrame(rows_, "object_id bigint, mjd double, passband int, flux double, flux_err double, detected int")
    wide = A.pivot_feature(o, "flux")
    assert len(wide.columns) == 91
    assert A.unpivot_feature(wide, "flux", 90).count() == 93
    assert A.pivot_feature(o, "flux", 120).columns[-1] == "flux120"
    with pytest.raises(Exception, match="pivot width 64 is too small"):
        A.pivot_feature(o, "flux", 64).collect()


def test_aligned_pivots_read_their_columns_and_shuffle_nothing(spark):
    from lcspark.operators import join as J
    rows_ = [(k, float(i), 0, float(i), 1.0, 0) for k in range(20) for i in range(5)]
    o = spark.createDataFrame(rows_, "object_id bigint, mjd double, passband int, flux double, flux_err double, detected int")
    aligned = J.align_pivots(A.pivot_all_features(o))
    plan = aligned._jdf.queryExecution().executedPlan().toString()
    assert aligned.count() == 100 and "Exchange hashpartitioning" not in plan


def test_groups_of_different_metadata_stay_apart(spark):
    df = spark.createDataFrame([(1, [1.0], 5), (1, [1.0], 6), (1, [2.0], 7)], "object_id bigint, meta array<double>, v int")
    got = A.group_by_meta(df, ["object_id", "meta"], [F.count("v").alias("n")]).collect()
    assert sorted((r["object_id"], r["meta"], r["n"]) for r in got) == [(1, [1.0], 2), (1, [2.0], 1)]


@pytest.mark.parametrize("name", ["forward_diff", "backward_diff", "hist_matrix"])
def test_array_functions_do_not_index_inside_lambdas(spark, name):
    """An array expression, not a column, is still passed over a fixed number of times."""
    import time
    from lcspark.functions import arrays as FA
    seconds = []
    for n in (20_000, 80_000):
        a = F.transform(F.sequence(F.lit(1), F.col("n")), lambda x: x.cast("double") * 2)
        made = FA.hist_matrix([a, a]) if name == "hist_matrix" else getattr(FA, name)(a)
        df = spark.range(1).select(F.lit(n).alias("n")).select(F.size(made).alias("s"))
        df.collect()
        t0 = time.perf_counter()
        assert df.first()["s"] == n
        seconds.append(time.perf_counter() - t0)
    assert seconds[1] < 8 * seconds[0] + 2
