"""Projections, filters and conditionals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcspark.functions.expr import col_of, photoz_positive
from lcspark.schema import HIST_CHANNELS, ZEROED_CHANNELS


def typed_features(obs: DataFrame, keep=()) -> DataFrame:
    """Explicit casts of the stored table: float features, int codes."""
    return obs.select(
        F.col("object_id").cast("bigint").alias("object_id"),
        F.col("mjd").cast("float").alias("mjd"),
        F.col("passband").cast("int").alias("passband"),
        F.col("flux").cast("float").alias("flux"),
        F.col("flux_err").cast("float").alias("flux_err"),
        F.col("detected").cast("int").alias("detected"),
        *[F.col(c) for c in keep],
    )


def default_target(meta: DataFrame, value: int = 0, name: str = "target") -> DataFrame:
    """A table without classes gets a constant class (0 for the flat
    test set, 14 for the baseline program)."""
    return meta.withColumn(name, F.lit(value))


def pad_fill(df: DataFrame, values: dict) -> DataFrame:
    """Null replaced by the pad value, per column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def galactic_meta(meta: DataFrame, extragalactic: bool | None) -> DataFrame:
    """C9 on the metadata: None keeps all, True drops photoz = 0, False
    drops photoz > 0."""
    if extragalactic is None:
        return meta
    if extragalactic:
        return meta.filter(F.col("hostgal_photoz") != 0)
    return meta.filter(~(F.col("hostgal_photoz") > 0))


def galactic_filter(obs: DataFrame, meta: DataFrame, extragalactic: bool | None) -> DataFrame:
    """Observations of the objects that pass the galactic test.  A semi
    join, so Spark picks broadcast or shuffle from the measured size of the
    metadata side."""
    keep = galactic_meta(meta, extragalactic).select("object_id")
    return obs.join(keep, "object_id", "left_semi")


def use_specz(meta: DataFrame) -> DataFrame:
    """Take the spectroscopic redshift as the photometric one."""
    return meta.withColumns({"hostgal_photoz": F.col("hostgal_specz"),
                             "hostgal_photoz_err": F.lit(0.0)})


def limit_objects(obs: DataFrame, n: int) -> DataFrame:
    """C11: observations of the first n objects by id (n is 1,000,000 in the
    reference).  The distinct ids are numbered by the distributed global
    rank (range partitions + per-partition offsets), so no single task
    merges n ids per input partition as a top-n would; then a semi join."""
    from lcspark.operators.window import global_rank
    ids = global_rank(obs.select("object_id").distinct(), ["object_id"], "_id_rank")
    first_ids = ids.filter(F.col("_id_rank") <= F.lit(n)).select("object_id")
    return obs.join(first_ids, "object_id", "left_semi")


def object_lookup(obs: DataFrame, object_id: int) -> DataFrame:
    """One object's rows; the equality filter reaches the Parquet
    scan as a pushed filter."""
    return obs.filter(F.col("object_id") == F.lit(object_id))


def store_for_lookup(obs: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """The observations as a table for C12: bucketed and sorted by
    object_id, with a bloom filter of the ids in each file, so looking up an
    object opens one bucket and skips its files and row groups without it."""
    from lcspark.sources.io import bucketed
    buckets = buckets or int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(obs.repartition(buckets, "object_id"), path, ["object_id"], buckets,
                    {"parquet.bloom.filter.enabled#object_id": "true"})


def hist_channel(vectors: DataFrame, name: str, hist: str = "hist") -> DataFrame:
    """One channel out of array<struct<channel arrays>>: ``hist.flux``
    gives an array of arrays, element 0 is the channel array."""
    chunk = [c for c in ("chunk",) if c in vectors.columns]
    return vectors.select("object_id", *chunk, F.col(f"{hist}.{name}")[0].alias(name))


def zero_channels_matrix(hist, channels=ZEROED_CHANNELS):
    """C14 on an n x 8 matrix (array<array<float>>): zero the given
    channel positions in every time row."""
    zeroed = set(channels)
    h = col_of(hist)
    return F.transform(h, lambda row: F.array(*[
        (F.lit(0.0).cast("float") if c in zeroed else row[c]) for c in range(len(HIST_CHANNELS))]))


def kv_observation(obs: DataFrame, keep=()) -> DataFrame:
    """Each observation as a string -> double map (all values widen
    to double, as a SQL MAP of mixed numbers does)."""
    kv = F.create_map(
        F.lit("mjd"), F.col("mjd").cast("double"),
        F.lit("passband"), F.col("passband").cast("double"),
        F.lit("flux"), F.col("flux").cast("double"),
        F.lit("flux_err"), F.col("flux_err").cast("double"),
        F.lit("detected"), F.col("detected").cast("double"),
    )
    return obs.select("object_id", *keep, kv.alias("kv"))


def kv_get(kv, key: str):
    return F.element_at(col_of(kv), F.lit(key))


def meta_vector(layout: str = "sql", meta_val: str = "meta_val"):
    """C17: metadata as an array<double> in one of the named layouts.

    - ``baseline``: [0,0,0,0, ddf, photoz, photoz_err, mwebv, photoz>0, metaVal]
    - ``sql``:      [0,0,0,0, ddf, specz, photoz, mwebv, photoz>0, metaVal]
    - ``raw5``:     [ddf, specz, photoz, photoz_err, mwebv]
    - ``raw6``:     [ddf, specz, photoz, photoz_err, mwebv, distmod]
    """
    d = lambda c: F.col(c).cast("double")
    zero = F.lit(0.0)
    if layout == "baseline":
        items = [zero, zero, zero, zero, d("ddf"), d("hostgal_photoz"),
                 d("hostgal_photoz_err"), d("mwebv"),
                 photoz_positive("hostgal_photoz").cast("double"), d(meta_val)]
    elif layout == "sql":
        items = [zero, zero, zero, zero, d("ddf"), d("hostgal_specz"),
                 d("hostgal_photoz"), d("mwebv"),
                 photoz_positive("hostgal_photoz").cast("double"), d(meta_val)]
    elif layout == "raw5":
        items = [d("ddf"), d("hostgal_specz"), d("hostgal_photoz"),
                 d("hostgal_photoz_err"), d("mwebv")]
    elif layout == "raw6":
        items = [d("ddf"), d("hostgal_specz"), d("hostgal_photoz"),
                 d("hostgal_photoz_err"), d("mwebv"), d("distmod")]
    else:
        raise ValueError(f"unknown meta layout {layout!r}")
    return F.array(*items)
