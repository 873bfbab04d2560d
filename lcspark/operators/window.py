"""Windows and time features.

All per-object order is ``(mjd, *tie)``; the descending order is the exact
reverse, so the descending rank of a row is ``n + 1 -`` its ascending rank.
The operators take a row's place in its object (rank, count, first and
last time, neighbours) from ``skew.object_ranks``: one window pass over one
sort per object for normal objects, the distributed global rank for hot
objects, so no task orders a very large object alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lcspark.functions.expr import col_of, log2_pow
from lcspark.operators.ranges import ranged_scan


def order_keys(tie, desc: bool = False, time: str = "mjd"):
    cols = [F.col(time)] + [F.col(c) for c in tie]
    return [c.desc() for c in cols] if desc else [c.asc() for c in cols]


def object_window(tie, desc: bool = False, time: str = "mjd", key: str = "object_id"):
    return Window.partitionBy(key).orderBy(*order_keys(tie, desc, time))


def _ranks(obs: DataFrame, tie, neighbours: bool = False, hot_threshold=None) -> DataFrame:
    from lcspark.operators.skew import object_ranks
    return object_ranks(obs, tie, neighbours, hot_threshold)


_PLACE = ["_rank", "_n", "_first", "_last", "_prev", "_next"]


def _drop_place(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in _PLACE if c in df.columns])


def rank_asc(obs: DataFrame, tie, name: str = "rownum") -> DataFrame:
    """row_number per object by ascending time."""
    return _drop_place(_ranks(obs, tie).withColumn(name, F.col("_rank")))


def rank_desc(obs: DataFrame, tie, name: str = "rownum_desc") -> DataFrame:
    """row_number per object by descending time (n + 1 - ascending
    rank: descending order is the exact reverse)."""
    r = _ranks(obs, tie)
    return _drop_place(r.withColumn(name, F.col("_n") - F.col("_rank") + F.lit(1)))


def global_rank(df: DataFrame, order_cols, name: str = "global_rownum",
                num_partitions: int | None = None, neighbours=()) -> DataFrame:
    """Row number over the whole table without a one-partition window.

    The (total) order is cut into ranges by literal bounds (``ranges``); a
    row's number is the rows of the earlier ranges (a running sum over one
    row per range, broadcast) plus its number in its own.  Only the bounds
    are computed while the plan is built.  For the columns in ``neighbours``
    the values of the rows before and after are added, as ``_prev_<column>``
    and ``_next_<column>``.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranged_scan(df, order_cols, name, n, neighbours)


def elapsed_time(obs: DataFrame, tie, name: str = "elapsed", scale: float = 1.0,
                 redshift: str | None = None) -> DataFrame:
    """Time since the first observation, optionally divided by
    ``scale`` (100 in the baseline) and by (1 + z)."""
    t = F.col("mjd") - F.col("_first")
    if scale != 1.0:
        t = t / F.lit(float(scale))
    if redshift is not None:
        t = F.try_divide(t, col_of(redshift) + F.lit(1.0))
    return _drop_place(_ranks(obs, tie).withColumn(name, t))


def delta_time(obs: DataFrame, tie, name: str = "delta_mjd", hot_threshold=None) -> DataFrame:
    """Mjd - previous mjd, 0 for the first observation."""
    r = _ranks(obs, tie, neighbours=True, hot_threshold=hot_threshold)
    return _drop_place(r.withColumn(name, F.coalesce(F.col("mjd") - F.col("_prev"), F.lit(0.0))))


def lead_time(obs: DataFrame, tie, name: str = "lead_mjd", hot_threshold=None) -> DataFrame:
    """Next mjd - mjd, 0 for the last observation."""
    r = _ranks(obs, tie, neighbours=True, hot_threshold=hot_threshold)
    return _drop_place(r.withColumn(name, F.coalesce(F.col("_next") - F.col("mjd"), F.lit(0.0))))


def reverse_elapsed(obs: DataFrame, tie, mode: str = "aligned", name: str = "rval") -> DataFrame:
    """Time to the last observation.

    ``aligned``: each row gets last(mjd) - its own mjd.
    ``mirrored``: the value is numbered by descending time and joined to
    ascending numbers on equal rank, so row k gets the value of row n+1-k
    (the relational form of the padded-table query; see ``rank_join``).
    """
    r = _ranks(obs, tie)
    if mode == "aligned":
        return _drop_place(r.withColumn(name, F.col("_last") - F.col("mjd")))
    if mode == "mirrored":
        from lcspark.operators.join import rank_join
        desc = r.select("object_id", (F.col("_last") - F.col("mjd")).alias(name),
                        (F.col("_n") - F.col("_rank") + F.lit(1)).alias("rownum"))
        asc = _drop_place(r.withColumn("rownum", F.col("_rank")))
        return rank_join(asc, desc).drop("rownum")
    raise ValueError(f"unknown mode {mode!r}")


def interval_features(obs: DataFrame, tie) -> DataFrame:
    """Interval since first, delta to previous and the row number
    from one pass over the object's rows (one sort)."""
    r = _ranks(obs, tie, neighbours=True)
    return _drop_place(r.withColumns({
        "interval": F.col("mjd") - F.col("_first"),
        "delta_mjd": F.coalesce(F.col("mjd") - F.col("_prev"), F.lit(0.0)),
        "rownum": F.col("_rank"),
    }))


def keep_last(obs: DataFrame, tie, length: int, name: str = "rownum_desc", hot_threshold=None) -> DataFrame:
    """The latest ``length`` observations of each object, with their
    descending rank.  The rank is a plain descending row number under a
    limit, so Spark cuts each object to ``length`` rows in every task before
    the shuffle; a hot object is cut per salt first."""
    from lcspark.operators.skew import salted_last, split_hot
    normal, hot, counts = (obs, None, []) if hot_threshold is False else split_hot(obs, hot_threshold)
    w = object_window(tie, desc=True)
    out = normal.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= F.lit(length))
    if hot is None:
        return out
    few = salted_last(hot, counts, tie, length, hot_threshold)
    return out.unionByName(few.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= F.lit(length)))


def range_normalise(obs: DataFrame, cols=("flux", "flux_err"), hot_threshold=None) -> DataFrame:
    """Divide flux and flux_err by pow(2, log2(max(flux) - min(flux)))
    of the object, computed over the object's partition (no join).  A zero
    range gives null.  A hot object's range is a partial aggregate, joined
    by broadcast (one row per hot object), so its rows stay where they are."""
    from lcspark.operators.skew import join_object, split_hot
    normal, hot, _ = (obs, None, []) if hot_threshold is False else split_hot(obs, hot_threshold)
    w = Window.partitionBy("object_id")

    def divided(df):
        return df.withColumns({c: F.col(c) / F.col("_hm") for c in cols}).drop("_hm")
    out = divided(normal.withColumn("_hm", log2_pow(F.max("flux").over(w) - F.min("flux").over(w))))
    if hot is None:
        return out
    ranges = hot.groupBy("object_id").agg(log2_pow(F.max("flux") - F.min("flux")).alias("_hm"))
    return out.unionByName(divided(join_object(hot, ranges)))
