"""Plan shape: one shuffle of the observations per vector build, no Python
UDF anywhere, filters and projections pushed into the Parquet scan."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)"
                      r"\(([^)]*)", plan)


@pytest.mark.parametrize("name", ["vectors_padded", "vectors_padded_supp", "vectors_padded_augmented",
                                  "vectors_calculated", "vectors_flat_train", "vectors_meta",
                                  "samples_baseline", "network_input", "pad_observations",
                                  "collect_arrays", "augmented_vectors"])
def test_vector_builds_shuffle_observations_once(spark, name):
    plan = executed(entry.queries()[name](spark, SF))
    ex = shuffles(plan)
    # one hash exchange on the object key for the observations; the metadata
    # side is broadcast by AQE from its measured size or shuffled once.
    assert len(ex) <= 2, ex
    assert all(kind == "hashpartitioning" for kind, _ in ex), ex
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_python_in_any_plan(spark):
    for name, q in entry.queries().items():
        if name in ("fit_classifier", "fit_network", "score", "log_run"):
            continue
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_lookup_filter_reaches_scan(spark):
    plan = entry.queries()["object_lookup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_partkey), EqualTo(l_partkey,7)]" in plan


def test_projection_reaches_scan(spark):
    plan = entry.queries()["scan_projection"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>", plan)
    plan = entry.queries()["scan_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan


def test_global_rank_has_no_single_partition_window(spark):
    plan = executed(entry.queries()["global_rank"](spark, SF))
    kinds = [k for k, _ in shuffles(plan)]
    # rows are numbered within their range; the only one-partition exchange is over the ranges' counts
    assert "hashpartitioning(_range" in plan and "ExistingRDD" not in plan
    assert kinds.count("SinglePartition") <= 1
    assert all("_range#" in w for w in re.findall(r"row_number\(\) windowspecdefinition\(([^,]*),", plan))


def test_relational_padded_needs_many_more_shuffles(spark):
    fast = shuffles(executed(entry.queries()["vectors_padded"](spark, SF)))
    slow = shuffles(executed(entry.queries()["vectors_padded_relational"](spark, SF)))
    assert len(fast) <= 2 and len(slow) >= 4 * len(fast)


@pytest.mark.parametrize("name", ["vectors_calculated", "vectors_padded_supp", "samples_baseline", "network_input"])
def test_large_metadata_is_shuffled_once_without_reshuffling_observations(spark, name):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        plan = executed(entry.queries()[name](spark, SF))
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    ex = shuffles(plan)
    assert len(ex) == 2 and all(k == "hashpartitioning" and a.startswith("object_id") for k, a in ex), ex
    assert "Broadcast" not in plan


def test_every_scan_reads_only_needed_columns(spark):
    unused = ["l_tax", "l_discount", "l_linestatus", "props", "p_name", "p_brand", "p_type", "s_name", "c_name",
              "c_mktsegment", "s_acctbal", "c_acctbal"]
    for name, q in entry.queries().items():
        if name in ("fit_classifier", "fit_network", "score", "log_run", "read_observations_csv", "read_metadata_csv",
                    "read_delimited", "read_with_rejects", "write_table", "append_run", "create_if_absent", "compact_files",
                    "object_lookup_stored"):
            continue
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        schemas = re.findall(r"ReadSchema: (struct<[^\n]*)", plan)
        assert schemas, name
        for sch in schemas:
            assert not any(f"{c}:" in sch for c in unused), (name, sch)
