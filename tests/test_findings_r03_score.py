"""F8 score: rows built once and dealt out evenly before long steps."""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from lcspark.operators import aggregate as A
from lcspark.operators import ml as M
from lcspark.plans import q_more


def test_classes_are_counted_on_the_stored_rows(spark, monkeypatch):
    """The frame's rows are not built a second time for the classes' shares."""
    read = []
    shares = A.class_shares
    monkeypatch.setattr(A, "class_shares", lambda df, target="target": read.extend(df.inputFiles()) or shares(df, target))
    df = q_more._training_frame(spark, "/root/testdata/sf0.001")
    assert read and not [f for f in read if f.endswith("lineitem.parquet")]
    expected = {r["class_index"]: r["share"] for r in shares(df, "label").collect()}
    for row in df.groupBy("label").agg(F.min("weight").alias("low"), F.max("weight").alias("high")).collect():
        weight = float(M.CLASS_WEIGHTS[M.CLASS_CODES[row["label"]]]) / expected[row["label"]]
        assert row["low"] == row["high"] == weight


def test_a_fit_goes_over_even_partitions(spark, monkeypatch):
    """All rows in one partition, and copies of one row, are dealt out."""
    df = (spark.range(4000).repartition(1)
          .select(F.col("id").alias("object_id"), M.array_to_vector(F.array(F.lit(1.0), (F.col("id") % 3).cast("double"))).alias("features"),
                  (F.col("id") % 2).cast("int").alias("label"), F.lit(1.0).alias("weight")))
    given = []
    fit = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, rows, *a: given.append(rows) or fit(self, rows, *a))
    model = M.fit_classifier(df, max_iter=3)
    sizes = given[0].rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 4000 and len(sizes) >= M.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert max(sizes) < 2 * 4000 / len(sizes)
    assert M.score(model, df).count() == 4000
