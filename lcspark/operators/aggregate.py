"""Aggregations and pivots.

Per-object arrays are built with one hash shuffle on ``object_id``:
``array_sort(collect_list(struct(mjd, *tie, ...)))`` gives a defined time
order whatever order the shuffle delivers rows in, and collecting structs
(not separate columns) keeps the channel arrays aligned when a value is
null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lcspark.functions.arrays import sorted_struct_array
from lcspark.functions.expr import flux_pow as _flux_pow
from lcspark.functions.expr import log2_pow
from lcspark.operators.window import rank_asc
from lcspark.schema import N_CLASSES

FEATURES = ["mjd", "passband", "flux", "flux_err", "detected"]
FEATURE_TYPES = {"mjd": "float", "passband": "int", "flux": "float",
                 "flux_err": "float", "detected": "int"}


def observation_counts(obs: DataFrame) -> DataFrame:
    """A1: observations per object."""
    return obs.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_obs"))


def max_observation_count(obs: DataFrame) -> DataFrame:
    """A2: the longest object (the pivot width).  Partial aggregation on
    both levels; the second level sees one row per object."""
    return observation_counts(obs).agg(F.max("n_obs").alias("max_n_obs"))


def flux_modifiers(obs: DataFrame) -> DataFrame:
    """A3: flux_pow = log2(max - min), hist_modifier = pow(2, flux_pow),
    meta_val = flux_pow / 10, per object (null when the range is zero)."""
    agg = obs.groupBy("object_id").agg(F.max("flux").alias("_fmax"), F.min("flux").alias("_fmin"))
    return modifiers_from_range(agg, "_fmax", "_fmin").drop("_fmax", "_fmin")


def modifiers_from_range(df: DataFrame, fmax: str, fmin: str) -> DataFrame:
    fp = _flux_pow(fmax, fmin)
    return df.withColumns({
        "flux_pow": fp,
        "hist_modifier": log2_pow(F.col(fmax) - F.col(fmin)),
        "meta_val": fp / F.lit(10.0),
    })


def pivot_width(obs: DataFrame) -> int:
    """The pivot's width from the data: the longest object (A2), one number;
    1 for an empty table, so that its pivots have their columns."""
    return max(1, int(max_observation_count(obs).first()["max_n_obs"] or 0))


def _pivot(obs: DataFrame, width: int, tie, features) -> DataFrame:
    """One wide row per object, columns <rank>_<feature>; an object longer
    than ``width`` raises instead of losing observations."""
    fits = F.when(F.col("rownum") <= F.lit(width), F.col("rownum")).otherwise(F.raise_error(F.concat(
        F.lit(f"pivot width {width} is too small: an object has an observation of rank "), F.col("rownum").cast("string"))).cast("int"))
    ranked = rank_asc(obs, tie, "rownum").withColumn("rownum", fits)
    # the extra feature keeps the names <rank>_<feature> for a single one
    return ranked.groupBy("object_id").pivot("rownum", list(range(1, width + 1))).agg(
        *[F.max(f).alias(f) for f in features], F.count(F.lit(1)).alias("_n"))


def pivot_feature(obs: DataFrame, feature: str, width: int | None = None, tie=()) -> DataFrame:
    """A4: wide table object_id, <feature>1..<feature>width: the value at
    ascending rank i (null after the last observation).  ``width`` defaults
    to the longest object; the pivot values are passed explicitly."""
    width = pivot_width(obs) if width is None else width
    wide = _pivot(obs, width, tie, [feature])
    return wide.select("object_id", *[F.col(f"{i}_{feature}").alias(f"{feature}{i}") for i in range(1, width + 1)])


# Wide rows in one bucket of the stored pivots; Spark's own limit of buckets.
BUCKET_BYTES, MAX_BUCKETS = 32 << 20, 100_000


def pivot_all_features(obs: DataFrame, width: int | None = None, tie=(), features=FEATURES,
                       path: str | None = None) -> dict:
    """A5: the five pivots of one ranked input, a table per feature.  The
    observations are shuffled once: the pivot's groups lie hashed by
    object_id, and are written as they lie, bucketed and sorted by
    object_id, in so many buckets that each holds about ``BUCKET_BYTES`` of
    wide rows (a task ranks, pivots and sorts one bucket).  Each feature's table is its own columns of that one stored
    table (below ``path``; default: a scratch folder), so joins of them (J8)
    read only what they need and shuffle nothing."""
    from lcspark.sources.io import bucketed, scratch_dir
    spark = obs.sparkSession
    found = observation_counts(obs).agg(F.max("n_obs").alias("longest"), F.count(F.lit(1)).alias("objects")).first()
    width = max(1, int(found["longest"] or 0)) if width is None else width
    size = found["objects"] * width * len(features) * 8
    buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    wide = bucketed(_pivot(obs.repartition(buckets, "object_id"), width, tie, features), path or scratch_dir(spark, "pivots"), ["object_id"], buckets)
    return {f: wide.select("object_id", *[F.col(f"{i}_{f}").alias(f"{f}{i}") for i in range(1, width + 1)]) for f in features}


def pivot_all_wide(obs: DataFrame, width: int | None = None, tie=(), features=FEATURES) -> DataFrame:
    """A5 as one wide table with all five feature blocks (one shuffle)."""
    width = pivot_width(obs) if width is None else width
    wide = _pivot(obs, width, tie, features)
    return wide.select("object_id", *[F.col(f"{i}_{f}").alias(f"{f}{i}")
                                      for f in features for i in range(1, width + 1)])


def unpivot_feature(wide: DataFrame, feature: str, width: int) -> DataFrame:
    """Wide back to long (object_id, rownum, value) without the nulls."""
    long = wide.unpivot("object_id", [f"{feature}{i}" for i in range(1, width + 1)],
                        "col", feature)
    return (long.filter(F.col(feature).isNotNull())
            .select("object_id",
                    F.substring(F.col("col"), len(feature) + 1, 10).cast("int").alias("rownum"),
                    feature))


def tie_fields(tie):
    """Tie-break columns as private struct fields (a tie column may also be
    a channel, e.g. flux)."""
    return [F.col(c).alias(f"_k{i}") for i, c in enumerate(tie)]


# Longest array a row may hold.  An object with more observations is
# stored as several rows (``chunk`` 0, 1, ...), so no task ever collects an
# unbounded group; every light curve of a survey fits in chunk 0.
MAX_ARRAY_LEN = 1 << 16


def series_chunks(obs: DataFrame, tie, payload, max_len: int | None = None,
                  stats: bool = False, neighbours: bool = False, carry=(),
                  hot_threshold=None, tasks: int | None = None) -> DataFrame:
    """Per (object_id, chunk): ``s`` = time-sorted array of structs
    (mjd, tie..., payload...) of at most ``max_len`` observations.

    Object-level values are computed on rows, before the collect, with
    windows over one sort per object (streaming or spillable, never an
    in-memory group): the rank, and with ``stats`` the first time and the
    flux max / min over the whole object; with ``neighbours`` each row's
    previous and next time.  The collect then groups by (object_id, chunk),
    which the window's hash partitioning on object_id already satisfies, so
    the observations are shuffled once.  ``carry`` are per-object columns
    (functionally dependent on the object).  ``tasks``: number of tasks that
    the objects are dealt to, where what follows in them is long (else Spark
    makes about as many as there are cores).

    Hot objects (see ``skew``) are numbered by the distributed global rank
    instead of a per-object window, so their work is split across tasks."""
    from lcspark.operators import skew
    max_len = max_len or MAX_ARRAY_LEN
    if hot_threshold is not False:
        normal, hot, counts = skew.split_hot(obs, hot_threshold)
        if hot is not None:
            cold = series_chunks(normal, tie, payload, max_len, stats, neighbours, carry, False, tasks)
            heavy = skew.hot_series_chunks(hot, counts, tie, [p for p in payload if p != "mjd"],
                                           max_len, stats, neighbours, list(carry), hot_threshold)
            return cold.unionByName(heavy.select(*cold.columns))
    if tasks:
        obs = obs.repartition(tasks, "object_id")
    w = object_window_asc(tie)
    w_obj = Window.partitionBy("object_id")
    payload = [p for p in payload if p != "mjd"]
    base = list(dict.fromkeys(["object_id", "mjd", *tie, *payload, *carry]))
    extra = [F.row_number().over(w).alias("_rn")]
    if stats:
        extra += [F.first("mjd").over(w).alias("_first"),
                  F.max("flux").over(w_obj).alias("_fmax"), F.min("flux").over(w_obj).alias("_fmin")]
    if neighbours:
        extra += [F.lag("mjd").over(w).alias("_prev"), F.lead("mjd").over(w).alias("_next")]
    ranked = obs.select(*base, *extra).withColumn(
        "chunk", F.floor((F.col("_rn") - F.lit(1)) / F.lit(max_len)).cast("int"))
    fields = [F.col("mjd")] + tie_fields(tie) + [F.col(c) for c in payload]
    if neighbours:
        fields += [F.col("_prev"), F.col("_next")]
    aggs = [sorted_struct_array(*fields).alias("s")]
    if stats:
        aggs += [F.min("_first").alias("first_mjd"), F.max("_fmax").alias("fmax"),
                 F.min("_fmin").alias("fmin")]
    aggs += [F.any_value(c).alias(c) for c in carry]
    return ranked.groupBy("object_id", "chunk").agg(*aggs)


def object_window_asc(tie):
    from lcspark.operators.window import object_window
    return object_window(tie)


def collect_arrays(obs: DataFrame, tie, features=FEATURES, types=FEATURE_TYPES,
                   max_len: int | None = None) -> DataFrame:
    """Flat arrays per object (per chunk) in time order."""
    agg = series_chunks(obs, tie, features, max_len)
    return agg.select("object_id", "chunk", *[
        F.col(f"s.{f}").cast(f"array<{types[f]}>").alias(f) for f in features])


def nested_arrays(obs: DataFrame, tie, features=FEATURES, types=FEATURE_TYPES,
                  max_len: int | None = None) -> DataFrame:
    """array<array<...>> per feature (one inner array per object)."""
    flat = collect_arrays(obs, tie, features, types, max_len)
    return flat.select("object_id", "chunk", *[F.array(F.col(f)).alias(f) for f in features])


def hist_struct(obs: DataFrame, tie, fields: dict, carry=(), max_len: int | None = None) -> DataFrame:
    """Array of one struct of channel arrays, ``fields`` maps the
    channel name to (column, element type).  ``carry`` are per-object
    columns kept with ``any_value`` (they are functionally dependent on the
    object, so the shuffle key stays object_id alone)."""
    payload = {name: spec[0] for name, spec in fields.items()}
    tmp = obs.withColumns({f"_c_{n}": c if not isinstance(c, str) else F.col(c)
                           for n, c in payload.items()})
    agg = series_chunks(tmp, tie, [f"_c_{n}" for n in payload], max_len, carry=carry)
    hist = F.array(F.struct(*[F.col(f"s._c_{n}").cast(f"array<{fields[n][1]}>").alias(n)
                              for n in fields]))
    return agg.select("object_id", "chunk", *carry, hist.alias("hist"))


def distinct_objects(obs: DataFrame, pads: dict | None = None) -> DataFrame:
    """A10: one row per object with constant pad columns."""
    pads = pads if pads is not None else {"pad_mjd": 0, "pad_passband": 0, "pad_flux": 0,
                                          "pad_flux_err": 0, "pad_detected": 0}
    return obs.select("object_id").distinct().withColumns(
        {k: F.lit(v) for k, v in pads.items()})


def group_by_meta(df: DataFrame, keys, aggs) -> DataFrame:
    """Grouping on all of the keys, scalars and arrays alike (as the
    reference groups by object_id, meta array, target, specz): rows of one
    object with different metadata are different groups.  Input that is
    hashed by object_id already (after a join on it) is not shuffled again."""
    return df.groupBy(*keys).agg(*aggs)


def class_shares(df: DataFrame, target: str = "target") -> DataFrame:
    """Share of rows per class index 0..14; absent classes get 1.
    Placed by class (not by position among present classes).  The total is
    a window over the per-class counts (at most 15 rows), so no row of the
    input meets a single task."""
    spark = df.sparkSession
    if "chunk" in df.columns:
        df = df.filter(F.col("chunk") == F.lit(0))     # an object counts once, in however many chunks it is stored
    counts = df.groupBy(F.col(target).alias("class_index")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    classes = spark.range(N_CLASSES).select(F.col("id").cast("int").alias("class_index"))
    joined = F.broadcast(classes).join(counts, "class_index", "left")
    share = F.when(F.col("_n").isNull(), F.lit(1.0)).otherwise(
        F.col("_n").cast("double") / F.col("_total").cast("double"))
    return joined.select("class_index", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("n"),
                         share.alias("share"))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
