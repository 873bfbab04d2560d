"""Copies of objects that are one row each: made on that row, without a shuffle of the samples."""

import pytest
from pyspark.sql import functions as F

from lcspark.functions.rng import keyed_at_least, keyed_uniform
from lcspark.operators import aggregate as A
from lcspark.operators import augment as G
from lcspark.operators import vectors as V

OBS_SCHEMA = "object_id bigint, mjd double, passband int, flux double, flux_err double, detected int, k bigint"
META_SCHEMA = ("object_id bigint, ddf int, hostgal_specz double, hostgal_photoz double, hostgal_photoz_err double, "
               "mwebv double, distmod double, target int")


def tables(spark, objects=12):
    """Objects of 1 to 6 observations, some values null, 7 with two rows of metadata."""
    o = [(i, None if (i, j) == (5, 2) else 100.0 + (7 * j) % 5, j % 6, None if (i, j) == (4, 1) else float(i + j * j), 0.5, j % 2, j)
         for i in range(objects) for j in range(1 + i % 6)]
    m = [(i, i % 2, 0.3, None if i == 9 else 0.1 * (i % 4), 0.01, 0.2, 40.0, (90, 15, 1234)[i % 3]) for i in range(objects)]
    m += [(7, 0, 0.3, 0.9, 0.01, 0.2, 40.0, 42), (objects + 1, 0, 0.3, 0.9, 0.01, 0.2, 40.0, 90)]
    return spark.createDataFrame(o, OBS_SCHEMA), spark.createDataFrame(m, META_SCHEMA)


def rows(df):
    return sorted(map(str, df.collect()))


def by_rows(monkeypatch, make):
    """The rows when no object is taken as one row."""
    with monkeypatch.context() as m:
        m.setattr(G, "_lone_rows", lambda df, fits=None: (df.where("false"), df))
        return rows(make())


def test_copies_on_the_row_are_those_of_the_row_path(spark, monkeypatch):
    o, m = tables(spark)
    s = V.samples_baseline(o, m, ["k"], tasks=5)
    s = s.unionByName(s.where("object_id = 3").withColumn("object_id", F.lit(None).cast("bigint")))
    s = s.unionByName(s.where("object_id = 2").withColumns({"object_id": F.lit(100).cast("bigint"), "chunk": F.lit(3)})).localCheckpoint()
    count = F.when(F.col("object_id") % 5 != 1, F.col("object_id") % 4)           # 0 to 3 copies, or null
    whole = s.where("object_id is null or object_id <> 7").drop("chunk")
    for make in (lambda: G.augment(s, 4, 3), lambda: G.augment(s, 4, 3, rate=0.9), lambda: G.augment(s, count, 3, most=3),
                 lambda: G.augment(s, count, 3), lambda: G.augment(s, 4, 3, dealt=True), lambda: G.augment(whole, 4, 3)):
        ref = by_rows(monkeypatch, make)
        assert ref and rows(make()) == ref
    with monkeypatch.context() as p:
        p.setattr(A, "MAX_ARRAY_LEN", 4)
        for make in (lambda: G.augment(s, 4, 3), lambda: G.augment(whole, 4, 3), lambda: G.augment(V.samples_baseline(o, m, ["k"]), 4, 3)):
            assert rows(make()) == by_rows(monkeypatch, make)


def test_samples_of_one_row_are_not_dealt_out_for_their_copies(spark, monkeypatch):
    """Only objects of several rows are shuffled as arrays: here 7, of two rows of metadata."""
    o, m = tables(spark)
    dealt = []
    spread = G._spread
    monkeypatch.setattr(G, "_spread", lambda samples, *rest: (dealt.append(samples), spread(samples, *rest))[1])
    G.balance_classes(V.samples_baseline(o, m, ["k"], tasks=4), 3, obs=o, dealt=True).collect()
    assert [r[0] for r in dealt.pop().select("object_id").collect()] == [7, 7] and not dealt


def test_classes_are_counted_without_the_samples(spark):
    o, m = tables(spark)
    s, t = V.samples_baseline(o, m, ["k"]), V.sample_targets(o, m)
    assert rows(t) == rows(s.where("chunk = 0").select("object_id", "target")) and t.count() == 13
    assert rows(G.balance_counts(t)) == rows(G.balance_counts(s))
    one = F.col("object_id") != 7                                # which of its two rows a copy of 7 shows is open
    assert rows(G.balance_classes(s, 3, obs=o, objects=t).where(one)) == rows(G.balance_classes(s, 3, obs=o).where(one))
    assert "mjd" not in t._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    for kept in (True, False):
        assert rows(V.sample_targets(o, m, kept)) == rows(V.samples_baseline(o, m, ["k"], kept).select("object_id", "target"))


def test_samples_to_copy_are_dealt_to_several_tasks_a_core(spark):
    o, m = tables(spark)
    n = G.copying_tasks(spark)
    assert n >= 4 * spark.sparkContext.defaultParallelism
    s = V.samples_baseline(o, m, ["k"], tasks=n)
    assert "hashpartitioning(object_id" in s._jdf.queryExecution().executedPlan().toString() and \
        f", {n}), REPARTITION_BY_NUM" in s._jdf.queryExecution().executedPlan().toString()
    assert rows(s) == rows(V.samples_baseline(o, m, ["k"]))


@pytest.mark.parametrize("rate", [0.3, 0.0, -1.0, 1.0, 0.5, 2.0 ** -33, 1 - 2.0 ** -33, None])
def test_a_draw_is_compared_as_text(spark, rate):
    df = spark.range(500)
    if rate is None:                                             # a value that is drawn
        rate = df.where("id = 77").select(keyed_uniform(3, "drop", "id", F.lit(2))).first()[0]
    got = df.select(keyed_at_least(rate, 3, "drop", "id", F.lit(2)).alias("a"), (keyed_uniform(3, "drop", "id", F.lit(2)) >= F.lit(rate)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)
