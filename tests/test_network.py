"""The weighted network: gradient, weights in place of copies, a stored model, and models that must fail."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lcspark.operators import ml as M
from lcspark.operators import network as N
from lcspark.sources import io as S

LAYERS = [3, 5, 15]


def points(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + 2 * (x[:, 2] > 0.8)
    return x, y


def frame(spark, n, seed=1, weights=None):
    x, y = points(n, seed)
    w = [1.0] * n if weights is None else weights
    rows = [(i, Vectors.dense(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, ["object_id", "features", "label", "weight"]).repartition(3)


def test_gradient_is_the_slope_of_the_loss():
    x, y = points(40, 2)
    w, rng = np.linspace(0.5, 3, 40), np.random.default_rng(3)
    theta = rng.normal(size=sum((a + 1) * b for a, b in zip(LAYERS[:-1], LAYERS[1:])))
    _, gradient = N.loss_and_gradient(x, y, w, theta, LAYERS)
    for i in rng.choice(len(theta), 15, replace=False):
        near = []
        for step in (1e-5, -1e-5):
            moved = theta.copy()
            moved[i] += step
            near.append(N.loss_and_gradient(x, y, w, moved, LAYERS)[0])
        assert abs((near[0] - near[1]) / 2e-5 - gradient[i]) < 1e-4


def test_weights_act_as_copies(spark):
    times = [1 + i % 4 for i in range(120)]
    weighted = frame(spark, 120, weights=times)
    copied = weighted.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).withColumn("weight", F.lit(1.0))
    a, b = (N.fit(df, LAYERS, weight="weight", max_iter=6) for df in (weighted, copied))
    assert abs(a.losses[-1] - b.losses[-1]) < 1e-6 and np.abs(a.theta - b.theta).max() < 1e-4
    held = frame(spark, 60, seed=9)
    losses = [M.model_and_constant_loss(M.score(m, held)).first()["model_loss"] for m in (a, b)]
    assert abs(losses[0] - losses[1]) < 1e-4


def test_distributed_loss_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    df = frame(spark, 50, weights=[0.5 + i % 3 for i in range(50)])
    theta = np.random.default_rng(4).normal(size=sum((a + 1) * b for a, b in zip(LAYERS[:-1], LAYERS[1:])))
    rows = df.select(N._as_array(df, "features").alias("x"), F.col("label").cast("bigint").alias("y"), F.col("weight").alias("w"))
    loss, gradient = N._evaluate(rows, theta, LAYERS)
    local = df.orderBy("object_id").collect()
    x, y, w = np.array([r["features"].toArray() for r in local]), np.array([r["label"] for r in local]), np.array([r["weight"] for r in local])
    plain, slope = N.loss_and_gradient(x, y, w, theta, LAYERS)
    assert abs(loss - plain / w.sum()) < 1e-9 and np.abs(gradient - slope / w.sum()).max() < 1e-9


@pytest.mark.parametrize("kind", ["network", "classifier"])
def test_stored_model_scores_held_out_rows(spark, kind):
    """Better than the best constant by a fifth of its loss on held-out rows; a constant model isn't."""
    train, held = frame(spark, 600), frame(spark, 200, seed=8)
    if kind == "network":
        model = M.fit_network(train, 3, hidden=(12,), weight="weight", max_iter=40)
    else:
        model = M.fit_classifier(train)
    path = S.scratch_dir(spark, "model")
    M.save_model(model, spark, path)
    scored = M.score(M.load_model(spark, path, kind), held)
    own = {r["object_id"]: r["prediction"] for r in M.score(model, held).collect()}
    assert {r["object_id"]: r["prediction"] for r in scored.collect()} == own
    losses = M.model_and_constant_loss(scored).first()
    assert losses["model_loss"] < (0.8 if kind == "network" else 0.95) * losses["constant_loss"]
    shares = [held.where(F.col("label") == c).count() / 200 for c in range(15)]
    constant = held.withColumn("probability", F.array(*map(F.lit, shares)))
    flat = M.model_and_constant_loss(constant).first()
    assert flat["model_loss"] >= flat["constant_loss"] - 1e-9


def test_rows_without_label_or_weight_say_nothing(spark):
    df = frame(spark, 40)
    extra = df.withColumn("label", F.lit(None).cast("long")).unionByName(df.withColumn("weight", F.lit(0.0)))
    a, b = (N.fit(d, LAYERS, weight="weight", max_iter=2) for d in (df, df.unionByName(extra)))
    assert np.allclose(a.theta, b.theta)
    nothing = N.fit(df.limit(0), LAYERS, weight="weight", max_iter=2)
    assert nothing.losses == [] and M.score(nothing, df).count() == 40


def test_scaling_of_groups_in_one_pass(spark):
    rows = [(Vectors.dense([float(i), 5.0]), Vectors.dense([float(i * i)])) for i in range(10)]
    df = spark.createDataFrame(rows, ["a", "b"])
    got = M.standard_scale_groups(df, {"a": "a_s", "b": "b_s"}).collect()
    a, b = np.arange(10.0), np.arange(10.0) ** 2
    assert np.allclose([r["a_s"][0] for r in got], (a - a.mean()) / a.std(ddof=1)) and all(r["a_s"][1] == 0 for r in got)
    assert np.allclose([r["b_s"][0] for r in got], (b - b.mean()) / b.std(ddof=1))
