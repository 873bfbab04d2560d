"""The reference's three entry points as Spark jobs.

Each stage ends in a written table, so a later stage reads files instead
of re-running the lineage (and survives executor loss); stage timings go
to the run log (S7).  Nothing is collected to the driver except the
one-row metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lcspark.functions import arrays as FA
from lcspark.operators import aggregate as A
from lcspark.operators import augment as G
from lcspark.operators import ml as M
from lcspark.operators import vectors as V
from lcspark.schema import AUGMENT_COUNT, SEQUENCE_LEN
from lcspark.sources import io as S


def fifth_model_table(spark: SparkSession, obs: DataFrame, meta: DataFrame, tie, table: str,
                      length: int = SEQUENCE_LEN, augment: bool = True, seed: int = 0,
                      replica: int = 0, mode: str = "append") -> str:
    """Entry 1: the padded (optionally augmented) vector table, appended
    to a Parquet table as the notebook does."""
    v = V.vectors_padded(obs, meta, tie, length, augment=augment, seed=seed, replica=replica)
    S.write_table(v, table, mode=mode)
    return table


def flat_tables(spark: SparkSession, train_obs: DataFrame, train_meta: DataFrame,
                test_obs: DataFrame, test_meta: DataFrame, tie, train_table: str, test_table: str,
                n_copies: int = 10, seed: int = 0, test_tie=None) -> tuple[str, str]:
    """Entry 2a: the flat-array test table (class 0) and the training table
    with the originals and ``n_copies`` jittered copies, in one job each."""
    test = V.vectors_flat(test_obs, test_meta.drop("target") if "target" in test_meta.columns
                          else test_meta, test_tie or tie, train=False)
    S.write_table(test, test_table, mode="overwrite")
    train = G.augmented_vectors(train_obs, train_meta, tie, n_copies, seed)
    S.write_table(train, train_table, mode="overwrite")
    return train_table, test_table


def feature_frame(flat: DataFrame, length: int = SEQUENCE_LEN) -> DataFrame:
    """Padded arrays, forward / backward intervals after padding, and the
    assembled dense feature vector (meta, band, 8 channels)."""
    pad_f = lambda c: FA.pad_array(c, length, 0, "float")

    def before_padding(c):
        # one 0 of the padding, if there is any, and the kept values: all that isn't 0 in the padded differences
        return FA.keep_last_elements(F.concat(F.array(F.lit(0.0)), F.col(c).cast("array<float>").cast("array<double>")), length)
    df = flat.withColumns({"_fwd": before_padding("fwd_int"), "_bwd": before_padding("bwd_int")})
    parts = [F.col("meta"), FA.pad_array("band", length, 0, "int"), pad_f("mjd"), pad_f("flux"),
             pad_f("flux_err"), FA.pad_array("detected", length, 0, "int"),
             FA.pad_array(FA.forward_diff("_fwd"), length, 0, "double"), FA.pad_array(FA.backward_diff("_bwd"), length, 0, "double"),
             pad_f("source_wavelength"), pad_f("received_wavelength")]
    return df.select("object_id", F.col("target").alias("label"),
                     FA.to_vector(FA.concat_features(*parts)).alias("features"))


def distributed_training(spark: SparkSession, train_table: str, runs_table: str | None = None,
                         length: int = SEQUENCE_LEN, weights=(0.7, 0.2, 0.1), seed: int = 42,
                         max_iter: int = 20, model_table: str | None = None) -> DataFrame:
    """Entry 2b: read the flat training table, assemble features, split by
    object, fit a class-weighted classifier and store it (``model_table``;
    default: a scratch folder), score the held-out split with the stored
    model and report precision (and the run log).  Every timed stage ends in
    something written, so its time is that of its work."""
    timer = S.StageTimer()
    with timer.stage("total"):
        with timer.stage("dataframe"):
            flat = S.read_table(spark, train_table)
            flat.limit(1).count()                      # files listed and a first row read
        with timer.stage("train_vectors"):
            feats = feature_frame(flat, length)
            shares = A.class_shares(feats, "label")
            feats = M.class_weight_column(feats, shares, "label", "weight")
            feats = G.split(feats, list(weights), seed)
            path = S.scratch_dir(spark, "features")
            S.write_table(feats, path)                 # cut lineage before the iterative fit
            feats = S.read_table(spark, path)
        with timer.stage("train_model"):
            model = M.fit_classifier(feats.filter(F.col("split") == "train"), max_iter=max_iter)
        with timer.stage("build_model"):
            stored = model_table or S.scratch_dir(spark, "model")
            M.save_model(model, spark, stored)
            model = M.load_model(spark, stored)
        with timer.stage("predict"):
            names = G.SPLIT_NAMES[len(weights)]
            held = feats.filter(F.col("split") == names[-1])
            predicted = S.scratch_dir(spark, "predicted")
            S.write_table(M.score(model, held).select("object_id", "label", "prediction"), predicted)
            result = M.precision(S.read_table(spark, predicted))
    if runs_table:
        S.log_run(spark, {"program": "distributed_training", "model": "logistic_regression",
                          "data_source": train_table, **timer.metrics}, runs_table)
    return result


def baseline_program(spark: SparkSession, obs: DataFrame, meta: DataFrame, tie, out_dir: str,
                     length: int = SEQUENCE_LEN, augment_count: int = AUGMENT_COUNT, seed: int = 0,
                     weights=(0.8, 0.2), extragalactic=None, use_specz: bool = False,
                     runs_table: str | None = None) -> dict:
    """Entry 3: samples per object, split by object, ``augment_count``
    copies of each training sample (25 in the reference), and the padded
    network input of the training and validation sets, written as tables."""
    timer = S.StageTimer()
    with timer.stage("total"):
        with timer.stage("samples"):
            samples = V.samples_baseline(obs, meta, tie, extragalactic=extragalactic, use_specz=use_specz)
            samples = G.split(samples, list(weights), seed)
            S.write_table(samples, f"{out_dir}/samples")
            samples = S.read_table(spark, f"{out_dir}/samples")
        train = samples.filter(F.col("split") == "train").drop("split")
        valid = samples.filter(F.col("split") != "train").drop("split")
        with timer.stage("augment"):
            copies = G.augment(train, augment_count, seed)
            S.write_table(train.withColumn("replica", F.lit(0)).unionByName(copies.select(
                *train.withColumn("replica", F.lit(0)).columns)), f"{out_dir}/train_samples")
            train_all = S.read_table(spark, f"{out_dir}/train_samples")
        with timer.stage("train_vectors"):
            S.write_table(V.network_input(train_all, length), f"{out_dir}/train_input")
        with timer.stage("validation_vectors"):
            S.write_table(V.network_input(valid, length), f"{out_dir}/valid_input")
    if runs_table:
        S.log_run(spark, {"program": "baseline", "model": "network_input", "data_source": out_dir,
                          **timer.metrics}, runs_table)
    return {"samples": f"{out_dir}/samples", "train_input": f"{out_dir}/train_input",
            "valid_input": f"{out_dir}/valid_input"}
