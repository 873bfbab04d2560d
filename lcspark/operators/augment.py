"""Augmentation, class balancing and splits.

Every random number is a keyed draw (``functions.rng``): a pure function
of (seed, tag, object_id, position, replica).  Copies are made at object
level (one row per object and replica, arrays inside), so a replica costs
one row, not one row per observation, until the caller explodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lcspark.functions.arrays import sorted_struct_array
from lcspark.functions.expr import clip, map_target, photoz_positive, log2_pow
from lcspark.functions.rng import keyed_at_least, keyed_normal, keyed_uniform
from lcspark.operators import aggregate, skew
from lcspark.operators.aggregate import class_shares
from lcspark.operators.ranges import ranged_scan, segmented_scan
from lcspark.operators.vectors import _with_meta, nm_of
from lcspark.schema import DROP_RATE, Z_MAX, Z_MIN


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def uniform_jitter(x, e, u) -> Column:
    """u * ((x + e) - (x - e) / 1.5) + (x - e) / 1.5 (the 1.5 divisor on the
    lower bound only, as written in the reference)."""
    x, e = _col(x), _col(e)
    lo = (x - e) / F.lit(1.5)
    return u * ((x + e) - lo) + lo


def normal_jitter(x, e, n) -> Column:
    """x + n * e / 1.5: a Gaussian with mean x and sigma e / 1.5."""
    return _col(x) + n * (_col(e) / F.lit(1.5))


# ------------------------------------------------------------------ G1 ---

# Copies that one input row makes in one task.
COPIES_PER_TASK = 1 << 12
# Rows of copies (about 0.3 kB each) that ``augment`` sorts in one task.
COPIED_ROWS_PER_TASK = 1 << 20
# Tasks for each core, of objects that are copied on their rows.
TASKS_PER_CORE = 4


def replicate(df: DataFrame, n, name: str = "replica", start: int = 1, most: int | None = None,
              key: str = "object_id") -> DataFrame:
    """G1: ``n`` copies of every row numbered start..start+n-1; ``n`` may be
    a column (per-row copy counts) that is at most ``most`` (None: unknown).
    Rows with n <= 0 produce no copy.

    Where a row may have more than ``COPIES_PER_TASK`` copies, it first
    makes one row per range of that many numbers, the ranges are dealt to
    all tasks, and each makes its own copies there (of the ranges in turn,
    should there be too many of them for one task)."""
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    most = (None if isinstance(n, Column) else int(n)) if most is None else most
    first = F.lit(start)
    if most is not None and most <= COPIES_PER_TASK:
        return df.withColumn(name, F.explode(_numbers(first, n_col.cast("bigint") + first - 1).cast("array<int>")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = F.greatest(n_col.cast("bigint"), F.lit(0))
    out, size = df.withColumn("_copies", F.struct(F.lit(0).cast("bigint").alias("from"), total.alias("to"))), COPIES_PER_TASK
    while size < (2 ** 31 if most is None else most):
        size *= COPIES_PER_TASK
    while size > COPIES_PER_TASK:
        size //= COPIES_PER_TASK
        at = F.explode(_numbers(F.col("_copies.from"), F.col("_copies.to") - 1, size))
        out = (out.withColumn("_at", at)
               .withColumn("_copies", F.struct(F.col("_at").alias("from"), F.least(F.col("_at") + size, "_copies.to").alias("to")))
               .drop("_at").repartition(parts, key, F.col("_copies.from")))
    own = _numbers(F.col("_copies.from") + first, F.col("_copies.to") + first - 1)
    return out.withColumn(name, F.explode(own.cast("array<int>"))).drop("_copies")


def _numbers(first: Column, last: Column, step: int = 1) -> Column:
    """first, first + step, ... up to last; null if last is before first."""
    return F.when(last >= first, F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint")))


# ------------------------------------------------------------- G2 - G5 ---

def jitter_flux(obs: DataFrame, seed: int, keys, dist: str = "uniform",
                flux: str = "flux", flux_err: str = "flux_err") -> DataFrame:
    """New flux per observation: ``uniform`` as the SQL model, or
    ``normal`` (mean flux, sigma flux_err / 1.5) as the baseline program.
    ``keys`` are integer columns naming the observation (and replica)."""
    if dist == "uniform":
        new = uniform_jitter(flux, flux_err, keyed_uniform(seed, "flux", *keys))
    elif dist == "normal":
        new = normal_jitter(flux, flux_err, keyed_normal(seed, "flux", *keys))
    else:
        raise ValueError(dist)
    return obs.withColumn(flux, new)


def dilate_time(obs: DataFrame, seed: int, keys, dist: str = "uniform", z: str = "hostgal_photoz",
                z_err: str = "hostgal_photoz_err", scale_cols=("mjd",)) -> DataFrame:
    """Redshift augmentation.  A new z' is drawn (``uniform`` as the SQL
    model, or ``normal`` with sigma z_err / 1.5 clamped to [0, 5] as the
    baseline), dt = (1 + z) / (1 + z'), and the time columns are multiplied
    by dt.  ``keys`` set the scope: (object_id, rank[, replica]) draws per
    observation, (object_id[, replica]) per object.  Adds ``new_z`` and
    ``dt``."""
    if dist == "uniform":
        zn = uniform_jitter(z, z_err, keyed_uniform(seed, "dt", *keys))
    elif dist == "normal":
        zn = clip(normal_jitter(z, z_err, keyed_normal(seed, "z", *keys)), Z_MIN, Z_MAX)
    else:
        raise ValueError(dist)
    out = obs.withColumn("new_z", zn).withColumn(
        "dt", (F.lit(1.0) + F.col(z)) / (F.lit(1.0) + F.col("new_z")))
    return out.withColumns({c: F.col(c) * F.col("dt") for c in scale_cols})


def jitter_metadata(meta: DataFrame, seed: int, replica: int | Column = 0) -> DataFrame:
    """A new photometric redshift per object (uniform, as the SQL
    model), keyed by (object_id, replica)."""
    rep = replica if isinstance(replica, Column) else F.lit(replica)
    u = keyed_uniform(seed, "photoz", F.col("object_id"), rep)
    return meta.withColumn("hostgal_photoz",
                           uniform_jitter("hostgal_photoz", "hostgal_photoz_err", u))


def drop_observations(obs: DataFrame, seed: int, keys, rate: float = DROP_RATE) -> DataFrame:
    """Keep each observation with probability 1 - rate (a keyed draw
    >= rate).  Recompute intervals afterwards with ``delta_time`` /
    ``lead_time``."""
    return obs.filter(keyed_uniform(seed, "drop", *keys) >= F.lit(rate))


# ------------------------------------------------------------------ G6 ---

def _hot_objects(samples: DataFrame, obs: DataFrame | None, threshold: int) -> list:
    """Ids of objects with more than ``threshold`` observations (at most
    rows / threshold): from the observations, whose list is shared with the
    other operators on them, or from the number of chunks of stored samples."""
    if obs is not None:
        return [h[0] for h in skew.hot_object_counts(obs, threshold)]
    if "chunk" not in samples.columns:
        return []                                   # one array holds the object
    last = threshold // aggregate.MAX_ARRAY_LEN
    return [r[0] for r in samples.where((F.col("chunk") >= last) & (F.col("chunk") > 0)).select("object_id").distinct().collect()]


def augment(samples: DataFrame, n, seed: int, rate: float = DROP_RATE, replica: str = "replica",
            obs: DataFrame | None = None, most: int | None = None, hot_threshold: int | None = None,
            dealt: bool = False) -> DataFrame:
    """The baseline program's copies of the baseline samples
    (``vectors.samples_baseline``): per copy, drop observations (keep if
    draw >= rate), recompute forward and backward intervals of the kept
    times, draw z' ~ N(z, z_err / 1.5) clamped to [0, 5], dt = (1 + z) /
    (1 + z'), flux ~ N(flux, flux_err / 1.5), and multiply time, intervals
    and source wavelength by dt; meta slot 5 becomes z'.  ``n`` may be a
    column (e.g. by galactic flag), at most ``most``.  Keys: (object_id,
    original position, replica) and (object_id, replica).  A copy that keeps
    no observation has no row.

    An object that is one row (one chunk, one row of metadata) is copied on
    it: drop, intervals and draws are array functions, so no copy is sorted,
    grouped or spilled as rows.  The others' arrays are taken apart into
    rows, so drop and intervals are a filter and a window over (object,
    replica) in the whole object, however many chunks it is stored in.  The
    rows of all their copies of a task are sorted there, so the samples
    (arrays yet, before they are copied) are first dealt by object_id to as
    many tasks as their copies need (``COPIED_ROWS_PER_TASK``): what a task
    sorts grows neither with the input nor with the copies, and stays in
    memory.  ``dealt``: the samples lie in tasks enough already (those of
    ``copying_tasks``); then only objects of several rows are dealt out.
    Copies of hot objects (``obs`` gives the observations that the samples
    come from, if at hand) are cut into segments of ``hot_threshold``
    positions, each a window of its own; the number of kept observations and
    the last and first kept times are carried from segment to segment."""
    threshold = skew.HOT_OBJECT_ROWS if hot_threshold is None else hot_threshold
    hot = _hot_objects(samples, obs, threshold)
    ids = samples.sparkSession.createDataFrame([(h,) for h in hot], "object_id bigint") if hot else None
    rest = skew.join_object(samples, ids, "left_anti") if hot else samples
    rest = rest if dealt else _spread(rest, n, most, obs)
    lone, others = _lone_rows(rest, F.greatest(F.size("band"), F.size("hist")) <= F.lit(aggregate.MAX_ARRAY_LEN))
    others = _spread(others, n, most, obs) if dealt else others
    out = _copied_arrays(lone, n, seed, rate, replica, most).unionByName(_copied(others, n, seed, rate, replica, most, None))
    if not hot:
        return out
    return out.unionByName(_copied(skew.join_object(samples, ids, "left_semi"), n, seed, rate, replica, most, threshold))


def copying_tasks(spark: SparkSession) -> int:
    """Tasks for the samples that ``augment`` copies on their rows: no fewer
    than the session's shuffle partitions, and some for each core.  The
    copies are many times the samples, by whose size alone Spark would join
    them into about a task a core, of which the longest is waited for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def _spread(samples: DataFrame, n, most: int | None, obs: DataFrame | None) -> DataFrame:
    """The samples dealt by object_id to so many tasks that each makes about
    COPIED_ROWS_PER_TASK rows of copies; as they are if the number of an
    object's copies isn't known (``replicate`` deals those itself)."""
    most = (None if isinstance(n, Column) else int(n)) if most is None else most
    if most is None or not 0 < most <= COPIES_PER_TASK:
        return samples
    rows = obs.count() if obs is not None else samples.agg(F.sum(F.size("band"))).first()[0] or 0
    tasks = -(-rows * most // COPIED_ROWS_PER_TASK)
    return samples.repartition(tasks, "object_id") if tasks > 1 else samples


def _lone_rows(df: DataFrame, fits: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose object has no other row, and which fit; the others)."""
    marked = df.withColumn("_own", F.count(F.lit(1)).over(Window.partitionBy("object_id")))
    alone = F.col("_own") == F.lit(1)
    alone = alone if fits is None else alone & fits
    return marked.where(alone).drop("_own"), marked.where(~alone).drop("_own")


def _with_new_z(df: DataFrame, seed: int, replica: str) -> DataFrame:
    """Copies with their z' (``_zn``) and dt (``_dt``)."""
    z, ze = F.col("meta")[5].cast("double"), F.col("meta")[6].cast("double")
    zn = clip(normal_jitter(z, ze, keyed_normal(seed, "z", F.col("object_id"), F.col(replica))), Z_MIN, Z_MAX)
    return df.withColumn("_zn", zn).withColumn("_dt", (F.lit(1.0) + z) / (F.lit(1.0) + F.col("_zn")))


def _new_meta() -> Column:
    return F.transform(F.col("meta"), lambda x, i: F.when(i == 5, F.col("_zn").cast("float")).otherwise(x))


def _copied_arrays(lone: DataFrame, n, seed: int, rate: float, replica: str, most: int | None) -> DataFrame:
    """Copies of objects that are one row each, made on that row.  The keys
    of the draws are joined to strings ahead, per observation and per copy:
    a draw in an array is interpreted, and each string it makes adds up."""
    has_chunk = "chunk" in lone.columns
    base = (F.col("chunk") * F.lit(aggregate.MAX_ARRAY_LEN) if has_chunk else F.lit(0)).cast("bigint")
    zipped = F.arrays_zip(F.col("band").alias("b"), F.col("hist").alias("h"))
    placed = F.transform(zipped, lambda x, i: F.struct(
        F.concat_ws("|", F.col("object_id").cast("string"), (base + i).cast("string")).alias("key"), x["b"].alias("b"), x["h"][0].cast("double").alias("t"),
        *[x["h"][k].cast("double").alias(f"h{k}") for k in (1, 2, 3, 6, 7)]))
    df = _with_new_z(replicate(lone.withColumn("_s", placed).drop("band", "hist"), n, replica, most=most), seed, replica)
    df = df.withColumn("_r", F.col(replica).cast("string"))
    rep, dt = F.col("_r"), F.col("_dt")
    kept = F.filter("_s", lambda x: keyed_at_least(rate, seed, "drop", x["key"], rep))
    # the explode leaves copies without observations out, and makes the kept
    # ones a column of its own: no later expression draws them again
    df = df.withColumn("_k", F.explode(F.filter(F.array(kept), lambda a: F.size(a) > F.lit(0))))
    k = F.col("_k")

    def moved(x, j):
        fwd = F.when(j == 0, F.lit(0.0)).otherwise(x["t"] - F.get(k, j - F.lit(1))["t"])
        bwd = F.when(j == F.size(k) - F.lit(1), F.lit(0.0)).otherwise(F.get(k, j + F.lit(1))["t"] - x["t"])
        flux = normal_jitter(x["h1"], x["h2"], keyed_normal(seed, "flux", x["key"], rep))
        return F.array(*[v.cast("float") for v in (x["t"] * dt, flux, x["h2"], x["h3"], fwd * dt, bwd * dt, x["h6"] * dt, x["h7"])])
    chunk = [F.lit(0).alias("chunk")] if has_chunk else []
    return df.select("object_id", *chunk, replica, "target", _new_meta().alias("meta"), "specz",
                     F.col("_k.b").alias("band"), F.transform(k, moved).alias("hist"))


def _copied(samples: DataFrame, n, seed: int, rate: float, replica: str, most: int | None, segment_rows: int | None) -> DataFrame:
    has_chunk = "chunk" in samples.columns
    df = _with_new_z(replicate(samples, n, replica, most=most), seed, replica)
    oid, rep = F.col("object_id"), F.col(replica)
    # position in the whole object (a chunk counts MAX_ARRAY_LEN positions)
    base = (F.col("chunk") * F.lit(aggregate.MAX_ARRAY_LEN)) if has_chunk else F.lit(0)
    rows = (df.select("object_id", replica, F.struct("target", _new_meta().alias("meta"), "specz").alias("_object"), "_dt",
                      base.cast("bigint").alias("_base"),
                      F.arrays_zip(F.col("band").alias("b"), F.col("hist").alias("h")).alias("_rows"))
            .select("object_id", replica, "_object", "_dt", "_base", F.posexplode("_rows").alias("_p", "_x"))
            .select("object_id", replica, "_object", "_dt", (F.col("_base") + F.col("_p")).alias("_i"),
                    F.col("_x.b").alias("_b"), F.col("_x.h").alias("_h")))
    kept = (rows.filter(keyed_uniform(seed, "drop", oid, F.col("_i"), rep) >= F.lit(rate))
            .withColumn("_t", F.col("_h")[0].cast("double")))
    if segment_rows is None:
        w = Window.partitionBy("object_id", replica).orderBy("_i")
        placed = kept.withColumns({"_n": F.row_number().over(w), "_prev__t": F.lag("_t").over(w), "_next__t": F.lead("_t").over(w),
                                   "_next__i": F.lead("_i").over(w)})
    else:
        cut = kept.withColumns({"_id": F.coalesce("object_id", F.lit(0)), "_none": F.col("object_id").isNull(),
                                "_segment": F.floor(F.col("_i") / F.lit(segment_rows))})
        placed = segmented_scan(cut, ["_id", "_none", replica], "_segment", ["_i"], "_n", ["_t", "_i"])
    placed = placed.withColumns({
        "_fwd": F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.col("_t") - F.col("_prev__t")),
        "_bwd": F.when(F.col("_next__i").isNull(), F.lit(0.0)).otherwise(F.col("_next__t") - F.col("_t"))})
    h, dt = F.col("_h"), F.col("_dt")
    flux = normal_jitter(h[1].cast("double"), h[2].cast("double"), keyed_normal(seed, "flux", oid, F.col("_i"), rep))
    row = F.array(*[v.cast("float") for v in (
        F.col("_t") * dt, flux, h[2].cast("double"), h[3].cast("double"), F.col("_fwd") * dt, F.col("_bwd") * dt,
        h[6].cast("double") * dt, h[7].cast("double"))])
    keys = ["object_id", *(["chunk"] if has_chunk else []), replica]
    chunk = F.floor((F.col("_n") - F.lit(1)) / F.lit(aggregate.MAX_ARRAY_LEN)).cast("int")
    grouped = (placed.withColumn("chunk", chunk).withColumn("_row", row)
               .groupBy(*keys).agg(sorted_struct_array(F.col("_i"), F.col("_b").alias("b"), F.col("_row").alias("h")).alias("_s"),
                                   F.any_value("_object").alias("_object")))
    return grouped.select(*keys, "_object.target", "_object.meta", "_object.specz",
                          F.col("_s.b").alias("band"), F.col("_s.h").alias("hist"))


# ------------------------------------------------------------------ G7 ---

def augmented_vectors(obs: DataFrame, meta: DataFrame, tie, n: int, seed: int, hot_threshold: int | None = None) -> DataFrame:
    """The flat-array training table (V6) for the original data
    (replica 0) and ``n`` jittered copies (replicas 1..n), as the
    reference's loop of temporary tables but in one job with no driver
    loop.  A copy draws a new photoz per object for its metadata, a new
    flux per observation (uniform), and a per-observation time dilation
    against the original photoz; the flux is still divided by the range of
    the *original* flux (as the reference does).

    One exchange on object_id serves it all.  Each object's observations
    are collected in time order, and an object of one row (one chunk, one
    row of metadata) is copied on it: draws and the new order are array
    functions, so no copy is sorted, grouped or spilled as rows.  The others
    are taken apart into rows, for draws and the re-ordering by the new time
    over the whole object; an object longer than MAX_ARRAY_LEN is stored as
    several chunks afterwards.  Copies of hot objects are ordered by the
    distributed global rank, in ranges of ``hot_threshold`` rows."""
    threshold = skew.HOT_OBJECT_ROWS if hot_threshold is None else hot_threshold
    obs = obs.select(*dict.fromkeys(["object_id", "mjd", *tie, "passband", "flux", "flux_err"]))
    normal, hot, counts = skew.split_hot(obs, threshold)
    series = aggregate.series_chunks(normal, tie, ["passband", "flux", "flux_err"], stats=True, hot_threshold=False)
    lone, others = _lone_rows(_with_meta(series.withColumnsRenamed({"fmax": "_fmax", "fmin": "_fmin"}).drop("first_mjd"), meta))
    base = F.col("chunk").cast("bigint") * F.lit(aggregate.MAX_ARRAY_LEN)
    ranked = (others.select("*", F.posexplode("s").alias("_p", "_x")).withColumn("_rank", base + F.col("_p") + F.lit(1))
              .select("*", "_x.mjd", "_x.passband", "_x.flux", "_x.flux_err").drop("s", "chunk", "_p", "_x"))
    out = _copied_series(lone, n, seed).unionByName(_collected_copies(_placed_copies(ranked, n, seed, None)))
    if hot is None:
        return out
    rows = sum(c for _, c in counts) * (n + 1)
    ranked = skew.hot_ranks(hot, counts, tie, threshold=threshold, flux_range=True)
    return out.unionByName(_collected_copies(_placed_copies(_with_meta(ranked, meta), n, seed, -(-rows // threshold))))


def _object_copies(df: DataFrame, n: int, seed: int) -> DataFrame:
    """The original and the copies, each with its photoz ``_zm`` and flux divisor ``_hm``."""
    df = replicate(df, n + 1, start=0)
    oid, rep = F.col("object_id"), F.col("replica")
    z, ze = F.col("hostgal_photoz"), F.col("hostgal_photoz_err")
    zm = F.when(rep == F.lit(0), z).otherwise(uniform_jitter(z, ze, keyed_uniform(seed, "photoz", oid, rep)))
    return df.withColumns({"_zm": zm, "_hm": log2_pow(F.col("_fmax") - F.col("_fmin"))})


def _new_values(seed: int, rank, mjd, flux, flux_err) -> tuple[Column, Column]:
    """An observation's time and flux in its copy."""
    oid, rep = F.col("object_id"), F.col("replica")
    z, ze = F.col("hostgal_photoz"), F.col("hostgal_photoz_err")
    orig = rep == F.lit(0)
    zn = uniform_jitter(z, ze, keyed_uniform(seed, "dt", oid, rank, rep))
    return (F.when(orig, mjd).otherwise(mjd * ((F.lit(1.0) + z) / (F.lit(1.0) + zn))),
            F.when(orig, flux).otherwise(uniform_jitter(flux, flux_err, keyed_uniform(seed, "flux", oid, rank, rep))))


def _copies_meta() -> Column:
    fp = F.log2(F.col("_fmax") - F.col("_fmin"))
    return F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("ddf").cast("double"),
                   F.col("hostgal_specz").cast("double"), F.col("_zm").cast("double"),
                   F.col("mwebv").cast("double"), photoz_positive("_zm").cast("double"),
                   fp / F.lit(10.0))


def _copied_series(lone: DataFrame, n: int, seed: int) -> DataFrame:
    """Copies of objects that are one row each, their observations in ``s`` by rank."""
    df = _object_copies(lone, n, seed).withColumn("_z1", F.col("_zm") + F.lit(1.0))
    hm, z1 = F.col("_hm"), F.col("_z1")

    def moved(x, i):
        rank = i + F.lit(1)
        mjd, flux = _new_values(seed, rank, x["mjd"], x["flux"], x["flux_err"])
        return F.struct(mjd.alias("mjd"), rank.alias("rank"), x["passband"].cast("int").alias("band"),
                        (flux / hm).cast("float").alias("flux"), (x["flux_err"] / hm).cast("float").alias("flux_err"))
    df = df.withColumn("_q", F.sort_array(F.transform("s", moved))).withColumn("_t0", F.col("_q")[0]["mjd"])
    since = F.transform("_q", lambda x: F.try_divide(x["mjd"] - F.col("_t0"), z1).cast("float"))
    source = F.transform("_q", lambda x: (F.try_divide(nm_of(x["band"]), z1) / F.lit(1000.0)).cast("float"))
    zeros = F.transform("_q", lambda x: F.lit(0.0).cast("float"))
    df = df.withColumn("_since", since)
    return df.select(
        "replica", "object_id", F.lit(0).alias("chunk"), map_target("target").cast("int").alias("target"),
        _copies_meta().alias("meta"), F.col("_q.band").alias("band"), zeros.alias("mjd"), F.col("_q.flux").alias("flux"),
        F.col("_q.flux_err").alias("flux_err"), F.transform("_q", lambda x: F.lit(0)).alias("detected"),
        F.col("_since").alias("fwd_int"), F.col("_since").alias("bwd_int"), source.alias("source_wavelength"),
        zeros.alias("received_wavelength"))


def _placed_copies(ranked: DataFrame, n: int, seed: int, ranges: int | None) -> DataFrame:
    """Rows of the copies with their new values, place ``_n`` and first time ``_t0``."""
    df = _object_copies(ranked, n, seed)
    oid, rep = F.col("object_id"), F.col("replica")
    mjd, flux = _new_values(seed, F.col("_rank"), F.col("mjd"), F.col("flux"), F.col("flux_err"))
    df = df.withColumns({"_mjd": mjd, "_flux": flux})
    if ranges is None:
        w = Window.partitionBy("object_id", "replica").orderBy("_mjd", "_rank")
        return df.withColumns({"_n": F.row_number().over(w), "_t0": F.first("_mjd").over(w)})
    order = ["object_id", "replica", "_mjd", "_rank"]
    numbered = ranged_scan(df, order, "_g", ranges)
    # one row per copy of a hot object
    firsts = (numbered.groupBy(oid.alias("_of"), rep.alias("_copy"))
              .agg(F.min("_g").alias("_g0"), F.min_by("_mjd", "_g").alias("_t0")))
    return (numbered.join(F.broadcast(firsts), oid.eqNullSafe(F.col("_of")) & (rep == F.col("_copy")))
            .withColumn("_n", F.col("_g") - F.col("_g0") + F.lit(1)).drop("_of", "_copy", "_g", "_g0"))


def _collected_copies(placed: DataFrame) -> DataFrame:
    z1 = F.col("_zm") + F.lit(1.0)
    rows = placed.select(
        "replica", "object_id", F.floor((F.col("_n") - F.lit(1)) / F.lit(aggregate.MAX_ARRAY_LEN)).cast("int").alias("chunk"),
        F.struct(map_target("target").cast("int").alias("target"), _copies_meta().alias("meta")).alias("_object"),
        F.struct(F.col("_n"), F.col("passband").cast("int").alias("band"),
                 (F.col("_flux") / F.col("_hm")).cast("float").alias("flux"),
                 (F.col("flux_err") / F.col("_hm")).cast("float").alias("flux_err"),
                 F.try_divide(F.col("_mjd") - F.col("_t0"), z1).cast("float").alias("since"),
                 (F.try_divide(nm_of(F.col("passband")), z1) / F.lit(1000.0)).cast("float").alias("source")).alias("_x"))
    grouped = rows.groupBy("replica", "object_id", "chunk").agg(
        F.sort_array(F.collect_list("_x")).alias("s"), F.any_value("_object").alias("_object"))
    zeros = F.transform("s", lambda x: F.lit(0.0).cast("float"))
    return grouped.select(
        "replica", "object_id", "chunk", "_object.target", "_object.meta", F.col("s.band").alias("band"),
        zeros.alias("mjd"), F.col("s.flux").alias("flux"), F.col("s.flux_err").alias("flux_err"),
        F.transform("s", lambda x: F.lit(0)).alias("detected"), F.col("s.since").alias("fwd_int"),
        F.col("s.since").alias("bwd_int"), F.col("s.source").alias("source_wavelength"),
        zeros.alias("received_wavelength"))


# ------------------------------------------------------------------ G8 ---

def balance_counts(df: DataFrame, target: str = "target") -> DataFrame:
    """Extra copies per class index: int(3 * max(share) / share) - 1 (15
    rows; absent classes have share 1)."""
    shares = class_shares(df, target)
    mx = F.max("share").over(Window.partitionBy())
    return shares.select("class_index", (F.floor(F.lit(3.0) * mx / F.col("share")) - F.lit(1))
                         .cast("int").alias("extra"))


def balance_classes(samples: DataFrame, seed: int, augmentate: bool = True, target: str = "target",
                    obs: DataFrame | None = None, objects: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Originals plus int(3 * max share / share) - 1 extra copies per
    object of each class (augmented copies by ``augment`` or plain copies).
    The counts of the 15 classes are computed once, and become literals of
    the plan; a rare class's many copies are made by many tasks.
    ``objects`` (``vectors.sample_targets``): the samples' objects and
    targets, where they can be had without making the samples, whose
    observations would be shuffled once more only to be counted; ``dealt``
    as in ``augment``."""
    extras = {r["class_index"]: r["extra"] for r in balance_counts(samples if objects is None else objects, target).collect()}     # 15 rows
    extra = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in extras.items() for x in kv]), F.col(target)), F.lit(0))
    most = max(0, *extras.values())
    originals = samples.withColumn("replica", F.lit(0))
    if augmentate:
        copies = augment(samples, extra, seed, obs=obs, most=most, dealt=dealt)     # by the object's own count
    else:
        copies = replicate(samples, extra, most=most)
    return originals.unionByName(copies.select(*originals.columns))


# ------------------------------------------------------------------ G9 ---

SPLIT_NAMES = {2: ["train", "test"], 3: ["train", "test", "validation"]}


def split(df: DataFrame, weights, seed: int, names=None, key: str = "object_id",
          name: str = "split") -> DataFrame:
    """Deterministic split by a keyed draw per object: copies of an
    object stay in one split, and the result does not depend on
    partitioning (unlike ``randomSplit``)."""
    names = names or SPLIT_NAMES.get(len(weights)) or [f"part{i}" for i in range(len(weights))]
    total = float(sum(weights))
    u = keyed_uniform(seed, "split", F.col(key))
    bounds, acc = [], 0.0
    for w in weights[:-1]:
        acc += w / total
        bounds.append(acc)
    expr = F.lit(names[-1])
    for b, nm in reversed(list(zip(bounds, names[:-1]))):
        expr = F.when(u < F.lit(b), F.lit(nm)).otherwise(expr)
    return df.withColumn(name, expr)
