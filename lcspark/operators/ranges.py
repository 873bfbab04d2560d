"""Ranges of a total order, and scans across them.

``range_bounds`` cuts a table's order into ranges of about equal size; the
bounds are keys that occur in the data, taken from a sample, and become a
literal of the plan.  Rows find their range by a binary search in it, so the
layout is the same whenever it is computed again (after a lost executor, or
by a second reader) and needs no checkpoint.  The bounds only settle how the
work is dealt; results do not depend on them.

``segmented_scan`` numbers rows and looks at their neighbours within long
groups that are cut into segments: each segment is one window partition of
bounded size, and what a segment needs from those before and after it (the
rows before it, the last row of the previous one, the first of the next) is
carried by a table with one row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

# Sampled keys per range.
SAMPLED_KEYS = 32


def range_bounds(df: DataFrame, order_cols, ranges: int) -> list[str]:
    """At most ``ranges`` - 1 keys of ``df``, ascending, as JSON: a count and
    a sorted sample of about ``SAMPLED_KEYS`` keys a range."""
    if ranges <= 1:
        return []
    keys = df.select(*order_cols)
    rows, wanted = keys.count(), SAMPLED_KEYS * ranges
    if rows > wanted:
        keys = keys.sample(withReplacement=False, fraction=wanted / rows, seed=17)
    found = [r[0] for r in keys.orderBy(*order_cols).select(F.to_json(F.struct(*order_cols))).collect()]
    return list(dict.fromkeys(found[len(found) * i // ranges] for i in range(1, ranges) if found))


def range_of(df: DataFrame, order_cols, bounds: list[str]) -> Column:
    """The number of bounds that are not after a row's key."""
    if not bounds:
        return F.lit(0)
    fields = [StructField(c, df.schema[c].dataType) for c in order_cols]
    known = F.from_json(F.lit(f"[{','.join(bounds)}]"), ArrayType(StructType(fields)))   # folded into a literal
    key = F.struct(*order_cols)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0),
                       lambda at, step: F.when(F.get(known, at + step - 1) <= key, at + step).otherwise(at))


def segmented_scan(rows: DataFrame, groups, segment: str, order_cols, place: str, neighbours=(),
                   few_segments: bool = False) -> DataFrame:
    """``rows`` with ``place`` (1, 2, ... in each group, in the order of
    ``order_cols``) and, for each column c of ``neighbours``, ``_prev_c`` and
    ``_next_c``: its value in the rows before and after.  The segments of a
    group follow its order; ``groups`` hold no nulls.  ``few_segments``: the
    caller knows that the carries are small enough to broadcast."""
    inner = Window.partitionBy(*groups, segment).orderBy(*order_cols)
    seen = {"_inner": F.row_number().over(inner)}
    for c in neighbours:
        seen[f"_lag_{c}"] = F.lag(F.struct(c)).over(inner)
        seen[f"_lead_{c}"] = F.lead(F.struct(c)).over(inner)
    key = F.struct(*order_cols)
    ends = rows.groupBy(*groups, segment).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.min_by(F.struct(c), key).alias(f"_first_{c}") for c in neighbours],
        *[F.max_by(F.struct(c), key).alias(f"_last_{c}") for c in neighbours])
    over = Window.partitionBy(*groups).orderBy(segment)
    carries = ends.select(
        *groups, segment, F.coalesce(F.sum("_rows").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        *[F.lag(f"_last_{c}").over(over).alias(f"_before_{c}") for c in neighbours],
        *[F.lead(f"_first_{c}").over(over).alias(f"_after_{c}") for c in neighbours])
    joined = rows.withColumns(seen).join(F.broadcast(carries) if few_segments else carries, [*groups, segment])
    out = {place: F.col("_before") + F.col("_inner")}
    for c in neighbours:
        out[f"_prev_{c}"] = F.coalesce(f"_lag_{c}", f"_before_{c}")[c]
        out[f"_next_{c}"] = F.coalesce(f"_lead_{c}", f"_after_{c}")[c]
    return joined.withColumns(out).drop("_inner", "_before", *[f"_{p}_{c}" for p in ("lag", "lead", "before", "after") for c in neighbours])


def ranged_scan(df: DataFrame, order_cols, place: str, ranges: int, neighbours=()) -> DataFrame:
    """``segmented_scan`` of the whole table, cut by its own bounds: ``df``
    is read once for its row number and once more for each of sample, counts
    and rows, so it must give the same rows each time."""
    bounds = range_bounds(df, order_cols, ranges)
    ranged = df.withColumn("_range", range_of(df, order_cols, bounds))
    return segmented_scan(ranged, [], "_range", order_cols, place, neighbours, few_segments=True).drop("_range")
