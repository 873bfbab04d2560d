"""Sorts, limits and set operations (O1-O3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcspark.operators.window import order_keys


def order_observations(obs: DataFrame, tie, desc: bool = False,
                       num_partitions: int | None = None) -> DataFrame:
    """O1: rows of an object together and in time order: range partitions
    on (object_id, time, tie) with a sort inside each partition.  Unlike a
    hash partitioning on object_id, a range partitioning splits an object
    with very many rows over consecutive partitions (each in order), so no
    task sorts a whole hot object."""
    parts = [num_partitions] if num_partitions else []
    keys = [F.col("object_id")] + order_keys(tie, desc)
    return obs.repartitionByRange(*parts, *keys).sortWithinPartitions(*keys)


def preview(df: DataFrame, n: int, order_cols) -> DataFrame:
    """O2: the first n rows in a defined order (a top-n: each task keeps
    at most n rows)."""
    return df.orderBy(*order_cols).limit(n)


def append_replicas(base: DataFrame, *replicas: DataFrame) -> DataFrame:
    """O3: originals and augmented copies as one table (by column name)."""
    out = base
    for r in replicas:
        out = out.unionByName(r)
    return out
