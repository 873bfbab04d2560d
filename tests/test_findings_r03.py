"""What a task holds of copies, and whole rows of the assembled vectors."""

from pyspark.sql import functions as F

from lcspark.operators import augment as G
from lcspark.operators import vectors as V
from lcspark.plans import bindings as B

OBS_SCHEMA = "object_id bigint, mjd double, passband int, flux double, flux_err double, detected int, k bigint"
META_SCHEMA = ("object_id bigint, ddf int, hostgal_specz double, hostgal_photoz double, hostgal_photoz_err double, "
               "mwebv double, distmod double, target int")


def small(spark, objects=40, rows=6):
    o = spark.createDataFrame([(i, 100.0 + (7 * j) % 5, j % 6, float(i + j * j), 0.5, j % 2, j) for i in range(objects) for j in range(rows)], OBS_SCHEMA)
    m = spark.createDataFrame([(i, i % 2, 0.3, 0.1 * (i % 4), 0.01, 0.2, 40.0, 90) for i in range(objects)], META_SCHEMA)
    return o, m


def rows(df):
    return sorted(map(str, df.collect()))


def test_copies_are_dealt_to_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    o, m = small(spark)
    s = V.samples_baseline(o, m, ["k"])
    ref = rows(G.augment(s, 5, 3, obs=o))
    monkeypatch.setattr(G, "COPIED_ROWS_PER_TASK", 100)
    for given in (o, None):
        a = G.augment(s, 5, 3, obs=given)
        assert a.rdd.getNumPartitions() >= 12                    # 240 rows, 5 copies
        assert rows(a) == ref


def test_one_row_objects_are_copied_without_a_sort_of_rows(spark, monkeypatch):
    """Long, repeated and plain objects give the rows that the row path gives."""
    o, m = small(spark)
    m = m.unionByName(m.where("object_id = 7").withColumn("hostgal_photoz", F.lit(0.9)))      # an object with two rows
    ref = rows(G.augmented_vectors(o, m, ["k"], 2, 9))
    lone, others = G._lone_rows(V._with_meta(o.select("object_id").distinct(), m))
    assert others.count() == 2 and lone.count() == 39
    monkeypatch.setattr(G, "_lone_rows", lambda df: (df.where("false"), df))                 # all by rows
    assert rows(G.augmented_vectors(o, m, ["k"], 2, 9)) == ref


def test_every_slot_of_the_assembled_vectors_is_returned(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    objects = B.obs_part(spark, sf).select("object_id").distinct().count()
    for name, per_object in (("assemble_features", 10 + 9 * 256), ("standard_scale_groups", 10 + 9 * 256), ("slice_features", 256)):
        assert entry.queries()[name](spark, sf).count() == objects * per_object


def test_differences_before_padding_are_those_of_the_padded_series(spark):
    """Series shorter than, as long as and longer than the padded length."""
    from lcspark.functions import arrays as FA
    from lcspark.plans.programs import feature_frame
    o, m = small(spark, 3, 5)
    flat = V.vectors_flat(o, m, ["k"])
    for length in (3, 5, 8):
        pad = lambda c: FA.pad_array(c, length, 0, "float").cast("array<double>")
        got = feature_frame(flat, length).select("object_id", FA.vector_array("features").alias("v"))
        both = flat.select("object_id", pad("fwd_int").alias("a"), pad("bwd_int").alias("b")).select(
            "object_id", FA.forward_diff("a").alias("f"), FA.backward_diff("b").alias("b")).join(got, "object_id")
        for r in both.collect():
            assert r["v"][10 + 5 * length:10 + 6 * length] == r["f"] and r["v"][10 + 6 * length:10 + 7 * length] == r["b"]


def test_stored_features_are_sparse_where_that_is_smaller(spark):
    from pyspark.ml.linalg import DenseVector, SparseVector
    from pyspark.ml.linalg import Vectors

    from lcspark.operators import ml as M
    df = spark.createDataFrame([(1, Vectors.dense([0.0] * 20 + [2.0])), (2, Vectors.dense([1.0] * 21))], ["object_id", "features"])
    got = {r["object_id"]: r["features"] for r in M.compressed(df, "features", 21).collect()}
    assert isinstance(got[1], SparseVector) and list(got[1].toArray()) == [0.0] * 20 + [2.0]
    assert isinstance(got[2], DenseVector)


def test_buckets_of_the_pivots_grow_with_the_rows(spark, monkeypatch):
    from lcspark.operators import aggregate as A
    from lcspark.operators.join import align_pivots
    o, _ = small(spark)
    ref = rows(align_pivots(A.pivot_all_features(o, tie=["k"])))
    monkeypatch.setattr(A, "BUCKET_BYTES", 480)                  # 40 objects of 6 times 5 values
    pivots = A.pivot_all_features(o, tie=["k"])
    found = {f.rsplit("_", 1)[1].split(".")[0] for f in pivots["mjd"].inputFiles()}              # bucket numbers
    assert 8 < len(found) <= 20 and rows(align_pivots(pivots)) == ref


def test_rows_read_with_rejects_are_not_sorted(spark, tmp_path):
    import os

    from lcspark.schema import OBSERVATION_SCHEMA
    from lcspark.sources import io as S
    (tmp_path / "in.csv").write_text("1,1.0,0,2.0,0.1,1\n2,?,0,2.0,0.1,1\n3,1.0\n")
    good = S.read_with_rejects(spark, str(tmp_path / "in.csv"), OBSERVATION_SCHEMA, {"header": "false"}, str(tmp_path / "bad"))
    assert [r[0] for r in good.collect()] == [1] and spark.read.parquet(str(tmp_path / "bad")).count() == 2
    assert not any("_good=" in f for f in good.inputFiles()) and os.path.isdir(tmp_path / "bad")
