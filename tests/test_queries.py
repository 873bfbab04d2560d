"""Every registered query against its DuckDB oracle at sf0.001 (the driver
does the same at sf0.01), and results independent of the number of shuffle
partitions."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, rows_of

from lcspark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)
WITH_ORACLE = sorted(ORACLES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(NAMES) == set(WITH_ORACLE)


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF).toPandas()
    odf = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert len(sdf) == len(odf)
    assert rows_of(sdf) == rows_of(odf)


CHUNKED = ["collect_arrays", "nested_arrays", "vectors_raw", "vectors_meta", "vectors_calculated", "vectors_flat_train", "hist_struct",
           "samples_baseline", "network_input", "augment", "augmented_vectors", "balance_classes", "class_shares", "pad_array",
           "forward_diff", "backward_diff", "to_vector", "hist_channel", "assemble_features", "standard_scale_groups", "score"]


@pytest.mark.parametrize("name", CHUNKED)
def test_results_do_not_depend_on_the_stored_array_length(spark, con, monkeypatch, name):
    from lcspark.operators import aggregate
    monkeypatch.setattr(aggregate, "MAX_ARRAY_LEN", 16)
    sdf, odf = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert rows_of(sdf) == rows_of(odf)


def test_entry_has_every_query():
    assert set(NAMES) <= set(entry.queries())
    assert set(WITH_ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "object_id" in df.columns


@pytest.mark.parametrize("name", ["vectors_padded_augmented", "augment", "augmented_vectors",
                                  "global_rank", "split_811", "vectors_calculated", "samples_baseline",
                                  "network_input", "pivot_all_features", "limit_objects"])
def test_same_result_for_any_partition_count(spark, name):
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            results.append(rows_of(entry.queries()[name](spark, SF).toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("name", ["rank_asc_event", "typed_features", "vectors_flat_test", "source_wavelength"])
def test_session_time_zone_does_not_matter(spark, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = []
        for tz in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got.append(rows_of(entry.queries()[name](spark, SF).toPandas()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got[0] == got[1] == got[2]


def test_inventory_covers_every_survey_line_and_query():
    import importlib

    from lcspark.plans.inventory import INVENTORY
    expected = ([f"S{i}" for i in range(1, 8)] + [f"C{i}" for i in range(1, 18)] + [f"J{i}" for i in range(1, 9)]
                + [f"A{i}" for i in range(1, 14)] + [f"W{i}" for i in range(1, 11)] + ["O1", "O2", "O3"]
                + [f"F{i}" for i in range(1, 13)] + [f"V{i}" for i in range(1, 9)] + [f"G{i}" for i in range(1, 10)]
                + [f"M{i}" for i in range(1, 9)])
    assert sorted(INVENTORY) == sorted(expected)
    registered = set(NAMES)
    for op, (fn, qs) in INVENTORY.items():
        assert qs and set(qs) <= registered, op
        mod, _, names = fn.partition(".")
        module_path, _, first = fn.split(" ")[0].rpartition(".")
        m = importlib.import_module(f"lcspark.{module_path}")
        assert hasattr(m, first), fn
    covered = {q for _, qs in INVENTORY.values() for q in qs}
    # every registered query maps to an inventory line, except the three
    # relational-padding helpers' building blocks already listed
    assert registered - covered == set(), registered - covered
