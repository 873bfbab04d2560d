"""A feed-forward network with row weights, fitted by Spark jobs (M4).

Layers are affine maps with a sigmoid between them and a softmax at the end,
as in Spark ML's multilayer perceptron, which takes no weights.  The loss is
the weighted mean of the rows' cross-entropies, so a class weight acts as
that many copies of a row without making them.  One evaluation of loss and
gradient is one job: each task goes over its rows in batches and emits its
sums in blocks, blocks are added up in ``BRANCHES`` groups each, and the
driver adds those.  What reaches the driver grows with the network, not with
the rows.  The driver's part is L-BFGS on the parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lcspark.functions.arrays import argmax

BLOCK, BRANCHES = 4096, 8
MEMORY, HALVINGS = 10, 20


def _as_array(df: DataFrame, name: str) -> Column:
    return vector_to_array(name) if isinstance(df.schema[name].dataType, VectorUDT) else F.col(name).cast("array<double>")


def _matrices(theta: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    """[inputs + 1, outputs] matrix of each layer; the last row is the offset."""
    out, at = [], 0
    for a, b in zip(layers[:-1], layers[1:]):
        out.append(theta[at:at + (a + 1) * b].reshape(a + 1, b))
        at += (a + 1) * b
    return out


def _forward(x: np.ndarray, matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Each layer's values; the last are log probabilities."""
    values = [x]
    for i, m in enumerate(matrices):
        z = values[-1] @ m[:-1] + m[-1]
        if i < len(matrices) - 1:
            values.append(0.5 * (1 + np.tanh(0.5 * z)))
        else:
            z -= z.max(axis=1, keepdims=True)
            values.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
    return values


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray, layers: list[int]) -> tuple[float, np.ndarray]:
    """Weighted sum of the rows' cross-entropies, and its gradient."""
    matrices = _matrices(theta, layers)
    values = _forward(x, matrices)
    rows = np.arange(len(y))
    delta = np.exp(values[-1])
    delta[rows, y] -= 1
    delta *= w[:, None]
    gradient = []
    for i in reversed(range(len(matrices))):
        gradient.append(np.concatenate([values[i].T @ delta, delta.sum(axis=0, keepdims=True)]).ravel())
        if i:
            delta = (delta @ matrices[i][:-1].T) * values[i] * (1 - values[i])
    return -float(w @ values[-1][rows, y]), np.concatenate(gradient[::-1])


def _evaluate(rows: DataFrame, theta: np.ndarray, layers: list[int]) -> tuple[float, np.ndarray]:
    """Weighted mean loss and its gradient over all rows (x, y, w)."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(theta)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + 2)                    # gradient, loss, weight
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                y, w = b.column("y").to_numpy(), b.column("w").to_numpy()
                loss, gradient = loss_and_gradient(x, y, w, shared.value, layers)
                total += np.concatenate([gradient, [loss, w.sum()]])
        cuts = [total[at:at + BLOCK] for at in range(0, len(total), BLOCK)]
        branch = TaskContext.get().partitionId() % BRANCHES
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([branch] * len(cuts), pa.int32()),
                                          pa.array(cuts, pa.list_(pa.float64()))], ["block", "branch", "sums"])

    def added(table: pa.Table) -> pa.Table:
        sums = table.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"block": table.column("block").slice(0, 1), "branch": table.column("branch").slice(0, 1),
                         "sums": pa.array([sums], pa.list_(pa.float64()))})
    schema = "block int, branch int, sums array<double>"
    made = rows.mapInArrow(partial, schema).groupBy("block", "branch").applyInArrow(added, schema).toArrow()
    total = np.zeros(len(theta) + 2)
    for block, sums in zip(made.column("block").to_pylist(), made.column("sums").to_pylist()):
        total[block * BLOCK:block * BLOCK + len(sums)] += sums
    shared.destroy()
    return float(total[-2] / total[-1]), total[:-2] / total[-1]


def _direction(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction of the last steps (s, y), newest last."""
    q, factors = gradient.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (s @ y)
        q -= a * y
        factors.append(a)
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    else:
        q /= max(1.0, float(np.linalg.norm(q)))
    for (s, y), a in zip(steps, reversed(factors)):
        q += (a - (y @ q) / (s @ y)) * s
    return -q


class NetworkModel(NamedTuple):
    """A fitted network: ``layers`` sizes, parameters, and the loss after
    each accepted step."""
    layers: list[int]
    theta: np.ndarray
    losses: list[float]
    features: str

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (array) and ``prediction``."""
        layers, shared = self.layers, df.sparkSession.sparkContext.broadcast(self.theta)

        @F.pandas_udf("array<double>")
        def probabilities(features):
            x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, layers[0]))
            return pd.Series(list(np.exp(_forward(x, _matrices(shared.value, layers))[-1])))
        scored = df.withColumn("probability", probabilities(_as_array(df, self.features)))
        return scored.withColumn("prediction", argmax("probability").cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.layers, self.theta.tolist(), self.losses, self.features)
        spark.createDataFrame([row], "layers array<int>, theta array<double>, losses array<double>, features string") \
            .coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> NetworkModel:
    r = spark.read.parquet(path).first()
    return NetworkModel(list(r["layers"]), np.array(r["theta"]), list(r["losses"]), r["features"])


def fit(train: DataFrame, layers: list[int], features: str = "features", label: str = "label", weight: str | None = None,
        max_iter: int = 50, seed: int = 42, tolerance: float = 1e-6) -> NetworkModel:
    """Fit by at most ``max_iter`` L-BFGS steps.  ``train`` is read once per
    evaluation, so it should be a stored table; rows without a label or a
    weight (or with weight 0) say nothing and are left out.  An empty
    training set leaves the starting values."""
    rows = (train.select(_as_array(train, features).alias("x"), F.col(label).cast("bigint").alias("y"),
                         (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
            .where("y IS NOT NULL AND w > 0 AND x IS NOT NULL"))
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(layers[:-1], layers[1:]):
        parts += [rng.uniform(-1, 1, a * b) * (6 / (a + b)) ** 0.5, np.zeros(b)]
    theta = np.concatenate(parts)
    if rows.isEmpty():
        return NetworkModel(list(layers), theta, [], features)
    loss, gradient = _evaluate(rows, theta, layers)
    losses, steps = [loss], []
    for _ in range(max_iter):
        direction = _direction(gradient, steps)
        slope = float(gradient @ direction)
        if slope >= 0:
            steps, direction = [], -gradient / max(1.0, float(np.linalg.norm(gradient)))
            slope = float(gradient @ direction)
        size = 1.0
        for _ in range(HALVINGS):
            new = theta + size * direction
            new_loss, new_gradient = _evaluate(rows, new, layers)
            if new_loss <= loss + 1e-4 * size * slope:
                break
            size *= 0.5
        else:
            break
        s, y = new - theta, new_gradient - gradient
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
        done = loss - new_loss <= tolerance * abs(loss)
        theta, loss, gradient = new, new_loss, new_gradient
        losses.append(loss)
        if done:
            break
    return NetworkModel(list(layers), theta, losses, features)
