"""ML preparation, scoring and evaluation (M1-M8) with Spark ML.

The evaluation metrics are aggregations over (label, probabilities): one
pass with partial aggregation per class, then a 15-row combine with the
constant class table; nothing is collected to the driver.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lcspark.functions.arrays import argmax
from lcspark.functions.expr import clip
from lcspark.operators import network
from lcspark.operators.network import NetworkModel
from lcspark.schema import CLASS_CODES, CLASS_WEIGHTS, CLIP_EPS, N_CLASSES


def standard_scale(df: DataFrame, input_col: str, output_col: str, with_mean: bool = True,
                   with_std: bool = True):
    """M1: StandardScaler (sample standard deviation; a constant slot
    becomes 0).  Returns (scaled DataFrame, fitted model)."""
    model = StandardScaler(inputCol=input_col, outputCol=output_col, withMean=with_mean,
                           withStd=with_std).fit(df)
    return model.transform(df), model


def standard_scale_groups(df: DataFrame, groups: dict, with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """M1 per group: each vector column scaled on its own (meta, band,
    history channels): input column -> output column.  The means and sample
    deviations of all groups come from one pass over ``df`` (a number per
    slot reaches the driver); a constant slot becomes 0."""
    found = df.select(*[Summarizer.metrics("mean", "std").summary(F.col(c)).alias(c) for c in groups]).first()

    def scaled(c: str) -> Column:
        pairs = [{"m": m, "s": s} for m, s in zip(found[c]["mean"].toArray().tolist(), found[c]["std"].toArray().tolist())]
        numbers = F.from_json(F.lit(json.dumps(pairs)), "array<struct<m:double,s:double>>")      # folded into a literal

        def value(x, n):
            x = x - n["m"] if with_mean else x
            return F.when(n["s"] > 0, x / n["s"]).otherwise(0.0) if with_std else x
        return array_to_vector(F.zip_with(vector_to_array(c), numbers, value))
    return df.withColumns({o: scaled(c) for c, o in groups.items()})


def index_labels(df: DataFrame, input_col: str = "target", output_col: str = "label_index") -> DataFrame:
    """M2: StringIndexer, most frequent label first (ties alphabetical)."""
    src = df.withColumn("_label_str", F.col(input_col).cast("string"))
    model = StringIndexer(inputCol="_label_str", outputCol=output_col,
                          stringOrderType="frequencyDesc").fit(src)
    return model.transform(src).drop("_label_str")


def encode_labels(df: DataFrame, input_col: str = "target", output_col: str = "target_vec",
                  drop_last: bool = True) -> DataFrame:
    """M3: OneHotEncoder on a numeric class index (Spark ML's default drops
    the last category)."""
    src = df.withColumn("_idx", F.col(input_col).cast("double"))
    model = OneHotEncoder(inputCols=["_idx"], outputCols=[output_col], dropLast=drop_last).fit(src)
    return model.transform(src).drop("_idx")


def class_weight_column(df: DataFrame, shares: DataFrame, label: str = "label",
                        name: str = "weight") -> DataFrame:
    """Per-row weight w_c / share_c for a class-weighted fit; the share table
    has 15 rows (broadcast)."""
    spark = df.sparkSession
    w = spark.createDataFrame([(i, float(CLASS_WEIGHTS[c])) for i, c in enumerate(CLASS_CODES)],
                              "class_index int, w double")
    tab = F.broadcast(shares.join(w, "class_index").select(
        F.col("class_index").alias("_ci"), (F.col("w") / F.col("share")).alias(name)))
    return df.join(tab, df[label] == tab["_ci"], "left").drop("_ci")


def compressed(df: DataFrame, features: str, size: int) -> DataFrame:
    """``df`` with the vectors of ``features`` (``size`` slots) stored sparse
    where that is smaller, as the assembler leaves them: a padded series is
    mostly zeros, and each pass of a fit reads all of it."""
    hinted = VectorSizeHint(inputCol="_dense", size=size, handleInvalid="optimistic").transform(df.withColumnRenamed(features, "_dense"))
    return VectorAssembler(inputCols=["_dense"], outputCol=features).transform(hinted).select(*df.columns)


# Tasks a core of a step whose tasks are long: with few of even size, one
# more than there are cores doubles the step's time.
TASKS_A_CORE = 4


def even_tasks(spark: SparkSession) -> int:
    """Number of tasks for a long step: several a core, and no fewer than
    the session's shuffles have."""
    return max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fit_classifier(train: DataFrame, features: str = "features", label: str = "label",
                   weight: str | None = "weight", max_iter: int = 20, reg: float = 0.0):
    """M4: distributed fit of a Pipeline with a multinomial logistic
    regression (the reference's Keras-on-Spark estimator re-aimed to Spark
    ML; class weights through ``weightCol``).  Each of its passes goes over
    the same partitions, so the rows are dealt out evenly before the first."""
    lr = LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter,
                            regParam=reg, family="multinomial")
    if weight:
        lr = lr.setWeightCol(weight)
    used = train.select(features, label, *([weight] if weight else []))
    return Pipeline(stages=[lr]).fit(used.repartition(even_tasks(train.sparkSession), F.monotonically_increasing_id()))


def fit_network(train: DataFrame, n_features: int, hidden=(64, 32), features: str = "features",
                label: str = "label", weight: str | None = None, max_iter: int = 50, seed: int = 42) -> NetworkModel:
    """M4, network form: a feed-forward network (softmax over the 15
    classes) fitted in a distributed way on weighted rows (``network``):
    class weights act in the loss, so no rows are copied."""
    layers = [int(n_features), *[int(h) for h in hidden], N_CLASSES]
    return network.fit(train, layers, features, label, weight, max_iter, seed)


def save_model(model, spark: SparkSession, path: str) -> None:
    """M5: store a fitted pipeline or network below ``path``."""
    if isinstance(model, NetworkModel):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str, kind: str = "classifier"):
    """M5: a stored ``classifier`` (pipeline) or ``network``."""
    return network.load_network(spark, path) if kind == "network" else PipelineModel.load(path)


def score(model, df: DataFrame) -> DataFrame:
    """M5: predictions of a fitted model (``prediction``, ``probability``)."""
    return model.transform(df)


def model_and_constant_loss(pred: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """One row: the weighted mean log loss of the predictions
    (``model_loss``) and of the best constant prediction, the classes'
    shares of the weight (``constant_loss``)."""
    raw = pred.schema["probability"].dataType
    probs = vector_to_array("probability") if isinstance(raw, VectorUDT) else F.col("probability")
    p = clip(F.element_at(probs, (F.col(label) + F.lit(1)).cast("int")), CLIP_EPS, 1.0 - CLIP_EPS)
    per = pred.groupBy(label).agg(F.sum(F.col(weight) * F.log(p)).alias("_l"), F.sum(weight).alias("_w"))
    share = F.col("_w") / F.sum("_w").over(Window.partitionBy())                # over the classes
    return per.withColumn("_c", F.col("_w") * F.log(share)).agg(
        (-F.sum("_l") / F.sum("_w")).alias("model_loss"), (-F.sum("_c") / F.sum("_w")).alias("constant_loss"))


def precision(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M6: share of rows whose predicted class equals the label (over all
    classes this equals accuracy, as the reference's computation)."""
    hit = F.when(F.col(label).cast("double") == F.col(prediction).cast("double"), 1.0).otherwise(0.0)
    return pred.agg(F.avg(hit).alias("precision"))


def with_argmax(pred: DataFrame, probs: str = "probs", name: str = "prediction") -> DataFrame:
    return pred.withColumn(name, argmax(probs))


def _class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, float(CLASS_WEIGHTS[c])) for i, c in enumerate(CLASS_CODES)], "class_index int, w double")


def _per_class(pred: DataFrame, shares: DataFrame | None, label: str, probs: str) -> DataFrame:
    """One row per class: sum over its rows of ln(clip(p[label])), their
    count, the class weight and share.  Without ``shares`` they are those of
    the rows themselves, from the same aggregation (one scan, one shuffle of
    at most 15 rows a task)."""
    p = clip(F.element_at(F.col(probs), F.col(label) + F.lit(1)), CLIP_EPS, 1.0 - CLIP_EPS)
    per = pred.groupBy(F.col(label).alias("class_index")).agg(
        F.sum(F.log(p)).alias("log_sum"), F.count(F.lit(1)).alias("n"))
    table = _class_table(pred.sparkSession)
    if shares is None:
        total = F.sum("n").over(Window.partitionBy())            # over the 15 rows
        share = F.when(F.col("n").isNull(), F.lit(1.0)).otherwise(F.col("n").cast("double") / total)
        joined = F.broadcast(table).join(per, "class_index", "left").withColumn("share", share)
    else:
        joined = F.broadcast(table.join(shares.select("class_index", "share"), "class_index")).join(per, "class_index", "left")
    return joined.fillna({"log_sum": 0.0, "n": 0})


def weighted_log_loss(pred: DataFrame, shares: DataFrame | None = None, label: str = "label",
                      probs: str = "probs") -> DataFrame:
    """M7: -sum_c(w_c / share_c * sum_i y_ic ln clip(p_ic)) / sum_c w_c / N,
    with w = 2 for classes 15 and 64 and 1 otherwise, and the class shares
    of the training labels (absent classes have share 1), by default those
    of ``pred``."""
    return _per_class(pred, shares, label, probs).agg(
        (-F.sum(F.col("log_sum") * F.col("w") / F.col("share")) / F.sum("w")
         / F.sum("n").cast("double")).alias("weighted_log_loss"))


def training_loss(pred: DataFrame, shares: DataFrame | None = None, label: str = "label",
                  probs: str = "probs") -> DataFrame:
    """M8: -mean_c(mean_i(y_ic ln clip(p_ic)) / share_c), the loss the
    network trains with."""
    total = F.sum("n").cast("double")
    return _per_class(pred, shares, label, probs).agg(
        (-F.sum(F.col("log_sum") / F.col("share")) / total / F.lit(float(N_CLASSES))).alias("training_loss"))
