"""Stored layouts and sinks: bucketed tables, look-ups, runs, rejects, claims, and swaps that broke off."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from lcspark.operators import aggregate as A
from lcspark.operators import join as J
from lcspark.operators import project as C
from lcspark.schema import OBSERVATION_SCHEMA
from lcspark.sources import io as S

SCHEMA = "object_id bigint, mjd double, passband int, flux double, flux_err double, detected int"


def observations(spark, counts):
    rows = [(k, float(i), 0, float(i), 1.0, 0) for k, n in counts for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def tables(spark):
    return {t.name for t in spark.catalog.listTables()}


def test_pivots_share_one_write_and_leave_no_table(spark):
    before = tables(spark)
    o = observations(spark, [(None, 4), (1, 3), (2, 5), (7, 1)])
    aligned = J.align_pivots(A.pivot_all_features(o))
    assert tables(spark) == before
    plan = aligned._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    got = sorted((r["object_id"] or 0, r["rownum"], r["mjd"]) for r in aligned.collect())
    assert got == sorted((k or 0, i + 1, float(i)) for k, n in ((None, 4), (1, 3), (2, 5), (7, 1)) for i in range(n))


def test_pivots_of_an_empty_table(spark):
    pivots = A.pivot_all_features(observations(spark, []))
    assert J.align_pivots(pivots).collect() == [] and A.pivot_width(observations(spark, [])) == 1
    assert J.align_pivots(pivots).columns == ["object_id", "rownum", *A.FEATURES]


def test_lookup_reads_one_bucket(spark):
    stored = C.store_for_lookup(observations(spark, [(k, 3) for k in range(50)]), S.scratch_dir(spark, "lookup"), buckets=8)
    # a lone filter is planned without the buckets' partitioning; its files are pruned all the same, which only the other plan shows
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        found = C.object_lookup(stored, 7)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of 8" in plan and found.count() == 3
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


@pytest.mark.parametrize("kind", ["path", "table"])
def test_append_run_is_idempotent(spark, kind):
    name = S.scratch_dir(spark, "runs") if kind == "path" else "append_run_test"
    try:
        for run, n in (("a", 3), ("b", 2), ("b", 4), ("a", 3)):
            S.append_run(observations(spark, [(1, n)]), name, run)
        got = {r["run_id"]: r["count"] for r in S.read_table(spark, name).groupBy("run_id").count().collect()}
        assert got == {"a": 3, "b": 4}
    finally:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_one_of_two_callers_creates(spark):
    path = S.scratch_dir(spark, "ctas")
    made = []
    calls = [threading.Thread(target=lambda n=n: made.append((S.create_if_absent(observations(spark, [(n, n)]), path), n))) for n in (3, 4)]
    for c in calls:
        c.start()
    for c in calls:
        c.join()
    winners = [n for won, n in made if won]
    assert len(winners) == 1 and S.read_table(spark, path).count() == winners[0]
    assert not S.create_if_absent(observations(spark, [(9, 9)]), path)
    assert not os.path.exists(path.replace("file:", "") + ".claim")
    assert S.create_if_absent(observations(spark, [(1, 2)]), "ctas_test") and not S.create_if_absent(observations(spark, []), "ctas_test")
    spark.sql("DROP TABLE ctas_test")


def test_one_of_many_callers_gets_a_claim(spark):
    path = S.scratch_dir(spark, "claims")
    fs, at = S._file_system(spark, path)
    for i in range(40):
        got, ready = [], threading.Barrier(8)

        def call(i=i, got=got, ready=ready):
            ready.wait()
            got.append(S._claimed(spark, fs, at(f"{path}/{i}.claim")))
        calls = [threading.Thread(target=call) for _ in range(8)]
        for c in calls:
            c.start()
        for c in calls:
            c.join()
        assert sorted(got) == [False] * 7 + [True]


def test_rejected_rows_and_read_rows_are_all_rows(spark, tmp_path):
    lines = ["1,2.5,0,1.0,0.1,1", "1,x,0,1.0,0.1,1", "2,2.5,0", "", "3,2.5,0,1.0,0.1,1,9", "4,,,,,", "5,1e3,1,2,3,0"]
    path = tmp_path / "obs.csv"
    path.write_text("\n".join(lines) + "\n")
    rejects = S.scratch_dir(spark, "rejects")
    good = S.read_with_rejects(spark, str(path), OBSERVATION_SCHEMA, {"header": "false"}, rejects)
    assert sorted(r["object_id"] for r in good.collect()) == [1, 4, 5]
    assert good.select("flux").count() == 3                # whatever columns are selected
    aside = S.read_table(spark, rejects).collect()
    assert sorted(r["record"] for r in aside) == sorted([lines[1], lines[2], lines[4]]) and all("obs.csv" in r["file"] for r in aside)
    with pytest.raises(Exception):
        S.read_delimited(spark, str(path), OBSERVATION_SCHEMA, sep=",").collect()
    assert S.read_delimited(spark, str(path), OBSERVATION_SCHEMA, sep=",", rejects=rejects).count() == 3
    assert S.read_table(spark, rejects).count() == 6


class Broken(Exception):
    pass


@pytest.mark.parametrize("renames", [0, 1, 2, 3])
def test_a_swap_that_broke_off_is_finished(spark, monkeypatch, renames):
    src, dst = S.scratch_dir(spark, "small"), S.scratch_dir(spark, "big")
    observations(spark, [(k, 3) for k in range(9)]).repartition(6).write.csv(src)
    recover = S.recover_compaction
    left = [renames]

    def step():
        left[0] -= 1
        if left[0] == 0:
            raise Broken

    def broken(spark, src):
        exists = S._file_system(spark, src)[0].exists(spark._jvm.org.apache.hadoop.fs.Path(S._swap_marker(src)))
        if exists and renames == 0:
            raise Broken
        return recover(spark, src, step)
    monkeypatch.setattr(S, "recover_compaction", broken)
    with pytest.raises(Broken):
        S.compact_files(spark, src, dst, swap=True)
    monkeypatch.setattr(S, "recover_compaction", recover)
    assert recover(spark, src) and not recover(spark, src)
    assert spark.read.csv(src).count() == 27 and spark.read.csv(dst).count() == 27
    files = [f for f in os.listdir(src.replace("file:", "")) if f.startswith("part-")]
    assert len(files) == 1 and files[0].endswith(".gz")
    assert not os.path.exists(dst.replace("file:", "") + ".old")
