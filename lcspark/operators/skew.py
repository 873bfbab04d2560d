"""Hot objects: split an object with very many observations across tasks.

An object is *hot* when it has more than ``HOT_OBJECT_ROWS`` observations.
Finding them is one partial aggregation (count per object) whose filtered
result has at most (rows / HOT_OBJECT_ROWS) ids, so the list is bounded and
may come to the driver and be broadcast.  Normal objects keep the
one-shuffle path (hash on object_id, sort, windows); hot objects take a path
whose work is spread by time ranges or salts, so no task sorts or buffers
more than about ``HOT_OBJECT_ROWS`` rows of one object.  When no object is
hot (every survey light curve), the plan is the normal path alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows above which one object is split across tasks.
HOT_OBJECT_ROWS = 1 << 22
# Sampled rows a hot object contributes on average to the detection.
_DETECT_ROWS = 2000


_CACHE: dict = {}
_CACHE_MAX = 256


def hot_object_counts(obs: DataFrame, threshold: int | None = None) -> list[tuple[int, int]]:
    """Cached ``detect_hot_objects`` per input plan (semantic hash) and
    threshold.  The list only picks between two paths that give the same
    rows, so a stale entry (the data under a path changed) can cost speed,
    never correctness."""
    threshold = HOT_OBJECT_ROWS if threshold is None else threshold
    key = (obs.semanticHash(), threshold)
    if key not in _CACHE:
        if len(_CACHE) >= _CACHE_MAX:
            _CACHE.pop(next(iter(_CACHE)))
        _CACHE[key] = detect_hot_objects(obs, threshold)
    return _CACHE[key]


def detect_hot_objects(obs: DataFrame, threshold: int | None = None) -> list[tuple[int, int]]:
    """(object_id, estimated rows) of the hot objects.  A bounded list: at
    most rows(obs) / threshold entries.

    The decision only picks which (equivalent) path an object takes, so it
    counts a Bernoulli sample of fraction min(1, 2000 / threshold): a hot
    object still shows about 2000 sampled rows, and the shuffle carries the
    sample instead of one row per object.  Small thresholds count exactly."""
    threshold = HOT_OBJECT_ROWS if threshold is None else threshold
    fraction = min(1.0, _DETECT_ROWS / float(threshold))
    src = obs.select("object_id")
    if fraction < 1.0:
        src = src.sample(withReplacement=False, fraction=fraction, seed=17)
    rows = (src.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > F.lit(threshold * fraction)).collect())
    return [(r["object_id"], int(round(r["n"] / fraction))) for r in rows]


def join_object(df: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Join a bounded per-object table (one row per hot object, broadcast) on
    ``object_id``; a null id matches a null id."""
    keyed = F.broadcast(small.withColumnRenamed("object_id", "_joined_id"))
    out = df.join(keyed, F.col("object_id").eqNullSafe(F.col("_joined_id")), how)
    return out if how in ("left_semi", "left_anti") else out.drop("_joined_id")


def split_hot(obs: DataFrame, threshold: int | None = None):
    """(normal rows, hot rows or None, hot counts).  Rows without an object
    id are an object like any other: every row is in exactly one branch."""
    hot = hot_object_counts(obs, threshold)
    if not hot:
        return obs, None, []
    ids = obs.sparkSession.createDataFrame([(h[0],) for h in hot], "object_id bigint")
    return join_object(obs, ids, "left_anti"), join_object(obs, ids, "left_semi"), hot


def _counts_df(spark, hot, threshold):
    return spark.createDataFrame(
        [(oid, n, max(1, math.ceil(n / threshold))) for oid, n in hot],
        "object_id bigint, _n bigint, _salts int")


def hot_series_chunks(hot: DataFrame, hot_counts, tie, payload, max_len: int, stats: bool,
                      neighbours: bool, carry, threshold: int | None = None) -> DataFrame:
    """``series_chunks`` for hot objects.  The rows are numbered by the
    distributed global rank over (object_id, time, tie) (ranges of about
    ``threshold`` rows each split a hot object by time), the rank in the
    object is that number minus the rows of the objects before it (partial
    aggregates, broadcast: one row per hot object), neighbours come with the
    rank, and the chunks of one object are hashed to different tasks by
    (object_id, chunk)."""
    from lcspark.operators.aggregate import sorted_struct_array, tie_fields
    threshold = HOT_OBJECT_ROWS if threshold is None else threshold
    base = list(dict.fromkeys(["object_id", "mjd", *tie, *payload, *carry, "flux"]))
    per = [F.min("mjd").alias("_first"), F.max("flux").alias("_fmax"), F.min("flux").alias("_fmin"),
           *[F.any_value(c).alias(f"_c_{c}") for c in carry]]
    ranked = _hot_numbers(hot.select(*base), hot_counts, tie, neighbours, threshold, per, drop=carry).withColumn(
        "chunk", F.floor((F.col("_rank") - F.lit(1)) / F.lit(max_len)).cast("int"))
    fields = [F.col("mjd")] + tie_fields(tie) + [F.col(c) for c in payload]
    if neighbours:
        fields += [F.col("_prev"), F.col("_next")]
    aggs = [sorted_struct_array(*fields).alias("s")]
    if stats:
        aggs += [F.min("_first").alias("first_mjd"), F.max("_fmax").alias("fmax"),
                 F.min("_fmin").alias("fmin")]
    aggs += [F.any_value(f"_c_{c}").alias(c) for c in carry]
    return ranked.groupBy("object_id", "chunk").agg(*aggs)


def salted_last(hot: DataFrame, hot_counts, tie, keep: int, threshold: int | None = None) -> DataFrame:
    """The latest ``keep`` rows of each (object, salt), about ``threshold``
    rows to a salt: at most salts x ``keep`` rows of an object remain."""
    from lcspark.operators.window import order_keys
    threshold = HOT_OBJECT_ROWS if threshold is None else threshold
    salts = _counts_df(hot.sparkSession, hot_counts, threshold).select("object_id", "_salts")
    salt = F.pmod(F.xxhash64("object_id", "mjd", *tie), F.col("_salts").cast("long"))
    w = Window.partitionBy("object_id", "_salt").orderBy(*order_keys(tie, desc=True))
    return (join_object(hot, salts).withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w))
            .filter(F.col("_r1") <= F.lit(keep)).drop("_salts", "_salt", "_r1"))


def hot_last_series(hot: DataFrame, hot_counts, tie, channels, length: int, neighbours: bool,
                    threshold: int | None = None) -> DataFrame:
    """``collect_last_series`` for hot objects: an exact two-stage top-L.
    Stage 1 keeps the latest rows of each (object, salt) with about
    ``threshold`` rows per salt; stage 2 the latest of the object (at most
    salts x L rows).  One more row than L is kept to give the oldest kept
    observation its previous time.  Flux range and first time are partial
    aggregates over all rows, broadcast (one row per hot object)."""
    from lcspark.operators.aggregate import sorted_struct_array, tie_fields
    from lcspark.operators.window import object_window
    keep = length + 1
    cols = list(dict.fromkeys(["object_id", "mjd", *tie, *channels]))
    stage1 = salted_last(hot.select(*cols), hot_counts, tie, keep, threshold)
    stage2 = stage1.withColumn("_rd", F.row_number().over(object_window(tie, desc=True))) \
        .filter(F.col("_rd") <= F.lit(keep))
    fields = [F.col("mjd"), *tie_fields(tie), *[F.col(c) for c in channels if c != "mjd"]]
    arr = stage2.groupBy("object_id").agg(sorted_struct_array(*fields).alias("_a"))
    stats = hot.groupBy("object_id").agg(F.max("flux").alias("fmax"), F.min("flux").alias("fmin"),
                                         F.min("mjd").alias("first_mjd"))
    df = join_object(arr, stats)
    a = F.col("_a")
    # when the object has more than L rows the oldest element is the extra
    # one: it only supplies the previous time of the oldest kept row
    off = F.greatest(F.size(a) - F.lit(length), F.lit(0))
    s = F.slice(a, off + F.lit(1), F.lit(length))
    if neighbours:
        s = F.transform(s, lambda x, i: x.withField(
            "_prev", F.when(i + off >= F.lit(1), a[i + off - F.lit(1)]["mjd"])).withField(
            "_next", F.when(i + off + F.lit(1) < F.size(a), a[i + off + F.lit(1)]["mjd"])))
    return df.select("object_id", s.alias("s"), "fmax", "fmin", "first_mjd")


def object_ranks(obs: DataFrame, tie, neighbours: bool = False, threshold: int | None = None,
                 flux_range: bool = False) -> DataFrame:
    """Rows of ``obs`` with their place in the object: ``_rank`` (1..n in
    (time, tie) order), ``_n`` (rows in the object), ``_first`` and
    ``_last`` (first and last time) and, with ``neighbours``, ``_prev`` and
    ``_next`` (the previous and next time, null at the ends), and with
    ``flux_range`` ``_fmax`` and ``_fmin``.

    Normal objects: one window pass (one sort per object).  Hot objects:
    the distributed global rank minus the rows of the objects before;
    counts and first/last times are partial aggregates broadcast per hot
    object; neighbours come with the rank.  ``threshold`` False: the caller
    knows that no object is hot (``obs`` derives from rows in which none
    is), so none is looked for."""
    from lcspark.operators.window import object_window
    normal, hot, counts = (obs, None, []) if threshold is False else split_hot(obs, threshold)
    w = object_window(tie)
    w_obj = Window.partitionBy("object_id")
    cols = {"_rank": F.row_number().over(w), "_n": F.count(F.lit(1)).over(w_obj),
            "_first": F.min("mjd").over(w_obj), "_last": F.max("mjd").over(w_obj)}
    if neighbours:
        cols.update({"_prev": F.lag("mjd").over(w), "_next": F.lead("mjd").over(w)})
    if flux_range:
        cols.update({"_fmax": F.max("flux").over(w_obj), "_fmin": F.min("flux").over(w_obj)})
    out = normal.withColumns(cols)
    if hot is None:
        return out
    return out.unionByName(hot_ranks(hot, counts, tie, neighbours, threshold, flux_range).select(*out.columns))


def hot_ranks(hot: DataFrame, counts, tie, neighbours: bool = False, threshold: int | None = None,
              flux_range: bool = False) -> DataFrame:
    """``object_ranks`` of hot objects."""
    per = [F.min("mjd").alias("_first"), F.max("mjd").alias("_last")]
    if flux_range:
        per += [F.max("flux").alias("_fmax"), F.min("flux").alias("_fmin")]
    return _hot_numbers(hot, counts, tie, neighbours, HOT_OBJECT_ROWS if threshold is None else threshold, per)


def _hot_numbers(hot: DataFrame, counts, tie, neighbours: bool, threshold: int, per, drop=()) -> DataFrame:
    """Hot rows with ``_rank`` and ``_n``, with ``neighbours`` ``_prev`` and
    ``_next``, and the per-object aggregates ``per``.  The objects' numbers
    of rows and their aggregates are broadcast: one row per hot object."""
    from lcspark.operators.window import global_rank
    parts = max(1, math.ceil(sum(n for _, n in counts) / threshold))
    near = ("object_id", "mjd") if neighbours else ()
    g = global_rank(hot, ["object_id", "mjd", *tie], "_g", num_partitions=parts, neighbours=near)
    before = Window.orderBy("object_id").rowsBetween(Window.unboundedPreceding, -1)     # a bounded list of objects
    facts = hot.groupBy("object_id").agg(F.count(F.lit(1)).alias("_n"), *per).withColumn(
        "_g0", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rows = join_object(g.drop(*drop), facts).withColumn("_rank", F.col("_g") - F.col("_g0")).drop("_g", "_g0")
    if not neighbours:
        return rows

    def own(side):
        # the neighbour's time if it is of the same object (null ids are one)
        return F.when(F.col(f"_{side}_mjd").isNotNull() & F.col(f"_{side}_object_id").eqNullSafe(F.col("object_id")), F.col(f"_{side}_mjd"))
    return rows.withColumns({"_prev": own("prev"), "_next": own("next")})
