"""The three end-to-end programs on the smallest tables."""

from pyspark.sql import functions as F

from lcspark.plans import bindings as B
from lcspark.plans.programs import baseline_program, distributed_training, fifth_model_table, flat_tables
from lcspark.sources import io as S

SF = "/root/testdata/sf0.001"


def test_fifth_model_table_appends(spark):
    obs, meta = B.obs_part(spark, SF), B.meta_part(spark, SF)
    path = S.scratch_dir(spark, "t5")
    fifth_model_table(spark, obs, meta, B.TIE["obs_part"], path, length=32, augment=False)
    fifth_model_table(spark, obs, meta, B.TIE["obs_part"], path, length=32, augment=True, seed=1)
    t = S.read_table(spark, path)
    n_obj = obs.select("object_id").distinct().count()
    assert t.count() == 2 * n_obj
    assert t.filter(F.size("band") != 32).count() == 0


def test_flat_tables_and_training(spark):
    obs, meta = B.obs_part(spark, SF), B.meta_part(spark, SF)
    tobs, tmeta = B.obs_event(spark, SF), B.meta_event(spark, SF)
    tr, te = S.scratch_dir(spark, "train"), S.scratch_dir(spark, "test")
    flat_tables(spark, obs, meta, tobs, tmeta, B.TIE["obs_part"], tr, te, n_copies=2, seed=3,
                test_tie=B.TIE["obs_event"])
    n_obj = obs.select("object_id").distinct().count()
    assert S.read_table(spark, tr).count() == 3 * n_obj
    assert S.read_table(spark, te).filter("target != 0").count() == 0
    runs = S.scratch_dir(spark, "runs")
    p = distributed_training(spark, tr, runs_table=runs, length=32, max_iter=5).collect()[0][0]
    assert 0.0 <= p <= 1.0
    assert S.read_table(spark, runs).count() == 1


def test_baseline_program(spark):
    obs, meta = B.obs_part(spark, SF), B.meta_part(spark, SF)
    out = S.scratch_dir(spark, "base")
    paths = baseline_program(spark, obs, meta, B.TIE["obs_part"], out, length=32, augment_count=2, seed=5)
    samples = S.read_table(spark, paths["samples"])
    n_train = samples.filter("split = 'train'").count()
    assert S.read_table(spark, paths["train_input"]).count() == 3 * n_train
    v = S.read_table(spark, paths["valid_input"])
    assert v.count() == samples.count() - n_train
    assert v.filter(F.size("hist") != 32).count() == 0


def test_compact_files_merges_small_files(spark):
    import os
    src, dst = S.scratch_dir(spark, "small"), S.scratch_dir(spark, "big")
    obs = B.obs_part(spark, SF).select("object_id", "mjd", "flux")
    obs.repartition(24).write.option("header", False).csv(src)
    parts = lambda d: [f for f in os.listdir(d.replace("file:", "")) if f.startswith("part-")]
    assert len(parts(src)) == 24
    S.compact_files(spark, src, dst, target_bytes=64 << 20)
    out = parts(dst)
    assert len(out) < 24 and all(f.endswith(".gz") for f in out)
    assert spark.read.text(dst).count() == obs.count()
