"""Per-object vector tables (V1-V8): the reference's five data models.

Fast path: one hash shuffle on ``object_id`` collects each object's
observations as a time-sorted array of structs; everything after that
(truncation, padding, intervals, normalisation, wavelengths, the
mirrored reverse interval) is array functions on that one row, inside the
same stage.  The metadata joins the per-object rows on ``object_id``; the
aggregated side is already hash-partitioned on that key, so only the
metadata moves (or it is broadcast when AQE measures it small).

The relational forms (grid x rank left join, windows, rank joins) are kept
in ``pad_observations_relational`` and in the SQL oracles; tests assert
both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lcspark.functions.arrays import (forward_diff, hist_matrix,
                                      keep_last_elements, pad_array, sorted_struct_array)
from lcspark.functions.expr import (band_index, log2_pow, map_target, photoz_positive)
from lcspark.functions.rng import keyed_uniform
from lcspark.operators import aggregate
from lcspark.operators.aggregate import series_chunks, tie_fields
from lcspark.operators.join import grid_left_join, padding_grid
from lcspark.operators.project import meta_vector
from lcspark.operators.window import keep_last, object_window
from lcspark.schema import PASSBAND_NM, UNKNOWN_CLASS_INDEX

CHANNELS = ["mjd", "passband", "flux", "flux_err", "detected"]
PAD = {"mjd": 0.0, "passband": 0, "flux": 0.0, "flux_err": 0.0, "detected": 0}
CHANNEL_TYPES = {"mjd": "double", "passband": "int", "flux": "double",
                 "flux_err": "double", "detected": "int"}


def nm_array():
    return F.array(*[F.lit(float(nm)) for nm in PASSBAND_NM])


def nm_of(pb):
    """Passband -> nm as an element lookup; out-of-range bands take the
    last band (as the CASE chain of the reference)."""
    idx = F.when((pb >= 0) & (pb < len(PASSBAND_NM) - 1), pb + 1).otherwise(F.lit(len(PASSBAND_NM)))
    return F.element_at(nm_array(), idx.cast("int"))


def collect_series(obs: DataFrame, tie, max_len: int | None = None,
                   neighbours: bool = False, tasks: int | None = None) -> DataFrame:
    """One row per object (per chunk of ``max_len`` observations): ``s`` =
    time-sorted array of observation structs, with the object's first time
    and flux max / min over all its observations (see ``series_chunks``)."""
    return series_chunks(obs, tie, CHANNELS, max_len, stats=True, neighbours=neighbours, tasks=tasks)


def collect_last_series(obs: DataFrame, tie, length: int, neighbours: bool = False,
                        hot_threshold=None, tasks: int | None = None) -> DataFrame:
    """Like ``collect_series`` but bounded: one row per object with the
    latest ``length`` observations (time-sorted), the flux max / min and the
    first time over *all* observations, and with ``neighbours`` each kept
    observation's previous and next time in the whole object.

    Plan: one hash exchange on object_id, one sort (object, time desc),
    window aggregates over the object (a spillable buffer), a streaming
    row_number, a filter, then ``collect_list`` of at most ``length``
    structs.  A very long object therefore never sits in an aggregation
    buffer; the collected array is bounded by ``length``.  Hot objects (see
    ``skew``) take an exact salted two-stage top-L instead.  ``tasks``:
    number of tasks that the objects are dealt to, where what follows in
    them is long (else Spark makes about as many as there are cores, and one
    more takes as long as twice as many)."""
    from lcspark.operators import skew
    if hot_threshold is not False:
        normal, hot, counts = skew.split_hot(obs, hot_threshold)
        if hot is not None:
            cold = collect_last_series(normal, tie, length, neighbours, False, tasks)
            heavy = skew.hot_last_series(hot, counts, tie, CHANNELS, length, neighbours, hot_threshold)
            return cold.unionByName(heavy.select(*cold.columns))
    if tasks:
        obs = obs.repartition(tasks, "object_id")
    w_obj = Window.partitionBy("object_id")
    w_desc = object_window(tie, desc=True)
    extra = []
    if neighbours:
        # descending order: lead is the previous time, lag the next one
        extra = [F.lead("mjd").over(w_desc).alias("_prev"), F.lag("mjd").over(w_desc).alias("_next")]
    ranked = obs.select(
        "object_id", "mjd", *[F.col(c) for c in tie if c not in CHANNELS],
        *[c for c in CHANNELS if c != "mjd"],
        F.row_number().over(w_desc).alias("_rd"),
        F.max("flux").over(w_obj).alias("_fmax"),
        F.min("flux").over(w_obj).alias("_fmin"),
        F.min("mjd").over(w_obj).alias("_first"),
        *extra,
    ).filter(F.col("_rd") <= F.lit(length))
    fields = [F.col("mjd"), *tie_fields(tie), *[F.col(c) for c in CHANNELS if c != "mjd"]]
    if neighbours:
        fields += [F.col("_prev"), F.col("_next")]
    return ranked.groupBy("object_id").agg(
        sorted_struct_array(*fields).alias("s"), F.max("_fmax").alias("fmax"),
        F.min("_fmin").alias("fmin"), F.min("_first").alias("first_mjd"))


def _fill(value):
    return lambda x: F.coalesce(x, F.lit(value))


def _padded_channels(kept, length):
    return {c: pad_array(F.transform(kept.getField(c), _fill(PAD[c])), length, PAD[c], CHANNEL_TYPES[c])
            for c in CHANNELS}


# ------------------------------------------------------------------ V1 ---

def pad_observations(obs: DataFrame, tie, length: int) -> DataFrame:
    """V1 (array path): exactly ``length`` rows per object as channel
    arrays, zeros in front, the latest ``length`` observations kept.
    Missing values inside a kept observation take the pad value, as the
    relational CASE WHEN ... IS NULL does."""
    series = collect_last_series(obs, tie, length)
    kept = keep_last_elements(F.col("s"), length)
    ch = _padded_channels(kept, length)
    return series.select("object_id", *[ch[c].alias(c) for c in CHANNELS])


def pad_observations_relational(obs: DataFrame, tie, length: int) -> DataFrame:
    """V1 (relational path): keep_last (W9) + grid (J4) + left join with
    pad values (J5, C8).  Long rows with ``pos`` = ascending position."""
    ranked = keep_last(obs, tie, length).select("object_id", "rownum_desc", *CHANNELS)
    objects = obs.select("object_id").distinct()
    padded = grid_left_join(padding_grid(objects, length), ranked, pads=PAD)
    return padded.select("object_id", (F.lit(length) - F.col("rownum")).alias("pos"), *CHANNELS)


# ------------------------------------------------------------------ V2 ---

def vectors_raw(obs: DataFrame, tie, max_len: int | None = None) -> DataFrame:
    """V2 (second model): array<array<>> per feature, time-sorted."""
    series = collect_series(obs, tie, max_len)
    types = {"mjd": "float", "passband": "int", "flux": "float", "flux_err": "float",
             "detected": "int"}
    return series.select("object_id", "chunk", *[
        F.array(F.col(f"s.{c}").cast(f"array<{types[c]}>")).alias(c) for c in CHANNELS])


# ------------------------------------------------------------------ V3 ---

META_COLS = ["ddf", "hostgal_specz", "hostgal_photoz", "hostgal_photoz_err", "mwebv",
             "distmod", "target"]


def _with_meta(series: DataFrame, meta: DataFrame, cols=META_COLS) -> DataFrame:
    cols = [c for c in cols if c in meta.columns]
    return series.join(meta.select("object_id", *cols), "object_id", "inner")


def vectors_meta(obs: DataFrame, meta: DataFrame, tie, max_len: int | None = None) -> DataFrame:
    """V3 (third model): raw target, 5-field meta, specz, band and a
    4-channel history struct (mjd, flux, flux_err, detected as floats)."""
    df = _with_meta(collect_series(obs, tie, max_len), meta)
    hist = F.array(F.struct(*[F.col(f"s.{c}").cast("array<float>").alias(c)
                              for c in ("mjd", "flux", "flux_err", "detected")]))
    return df.select("object_id", "chunk", F.col("target"), meta_vector("raw5").alias("meta"),
                     F.col("hostgal_specz").cast("double").alias("specz"),
                     F.col("s.passband").cast("array<int>").alias("band"), hist.alias("hist"))


# -------------------------------------------------------------- V4 / V6 ---

FLAT_CHANNELS = ["mjd", "flux", "flux_err", "detected", "fwd_int", "bwd_int",
                 "source_wavelength", "received_wavelength"]


def _calculated_arrays(obs: DataFrame, meta: DataFrame, tie, train: bool = True,
                       default_target: int = 0, max_len: int | None = None, last: int | None = None,
                       tasks: int | None = None) -> DataFrame:
    """Fourth-model / flat-table channels: mjd, detected and received
    wavelength zeroed; flux and flux_err divided by the range modifier;
    fwd_int = bwd_int = time since first / (1 + z); source wavelength.
    With ``last`` one bounded row per object with the latest observations;
    the first time and the flux range are still the whole object's."""
    series = (collect_last_series(obs, tie, last, tasks=tasks).withColumn("chunk", F.lit(0)) if last
              else collect_series(obs, tie, max_len))
    df = _with_meta(series, meta).withColumns({
        "_hm": log2_pow(F.col("fmax") - F.col("fmin")),
        "_z1": F.col("hostgal_photoz") + F.lit(1.0),
    })
    fp = F.log2(F.col("fmax") - F.col("fmin"))
    hm, z1, first = F.col("_hm"), F.col("_z1"), F.col("first_mjd")
    s = F.col("s")
    zeros = F.transform(s, lambda x: F.lit(0.0))
    since = F.transform(s, lambda x: F.try_divide(x["mjd"] - first, z1))
    target = map_target("target") if (train and "target" in meta.columns) else F.lit(default_target)
    return df.select(
        "object_id", "chunk",
        target.cast("int").alias("target"),
        F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("ddf").cast("double"),
                F.col("hostgal_specz").cast("double"), F.col("hostgal_photoz").cast("double"),
                F.col("mwebv").cast("double"), photoz_positive().cast("double"),
                (fp / F.lit(10.0))).alias("meta"),
        F.col("hostgal_specz").cast("double").alias("specz"),
        F.col("s.passband").cast("array<int>").alias("band"),
        zeros.cast("array<float>").alias("mjd"),
        F.transform(s, lambda x: x["flux"] / hm).cast("array<float>").alias("flux"),
        F.transform(s, lambda x: x["flux_err"] / hm).cast("array<float>").alias("flux_err"),
        F.transform(s, lambda x: F.lit(0)).cast("array<int>").alias("detected"),
        since.cast("array<float>").alias("fwd_int"),
        since.cast("array<float>").alias("bwd_int"),
        F.transform(s, lambda x: F.try_divide(nm_of(x["passband"]), z1) / F.lit(1000.0))
        .cast("array<float>").alias("source_wavelength"),
        zeros.cast("array<float>").alias("received_wavelength"),
    )


def vectors_calculated(obs: DataFrame, meta: DataFrame, tie, max_len: int | None = None) -> DataFrame:
    """V4 (fourth model): target, 10-slot meta, band and an 8-channel
    history struct."""
    flat = _calculated_arrays(obs, meta, tie, max_len=max_len)
    return flat.select("object_id", "chunk", "target", "meta", "band",
                       F.array(F.struct(*[F.col(c) for c in FLAT_CHANNELS])).alias("hist"))


def vectors_flat(obs: DataFrame, meta: DataFrame, tie, train: bool = True,
                 max_len: int | None = None, last: int | None = None, tasks: int | None = None) -> DataFrame:
    """V6 (flat-array table, train or test set): the same channels as V4
    as eight flat array columns.  The test set has class 0.  With ``last``
    only the latest observations, one row per object (to be padded), in
    ``tasks`` tasks if given."""
    flat = _calculated_arrays(obs, meta, tie, train=train, max_len=max_len, last=last, tasks=tasks)
    return flat.select("object_id", "chunk", "target", "meta", "band", *FLAT_CHANNELS)


# ------------------------------------------------------------------ V5 ---

def _uniform_jitter(x, e, u):
    """u * ((x + e) - (x - e) / 1.5) + (x - e) / 1.5, as written: the 1.5
    divisor sits on the lower bound only."""
    lo = (x - e) / F.lit(1.5)
    return u * ((x + e) - lo) + lo


def vectors_padded(obs: DataFrame, meta: DataFrame, tie, length: int = 256,
                   augment: bool = False, seed: int = 0, replica: int = 0,
                   scope: str = "obs", rval_mode: str = "mirrored") -> DataFrame:
    """V5 (fifth model): padded to ``length`` (latest kept, zeros in front),
    flux normalised by the range of all the object's observations, then
    optionally augmented (uniform flux jitter, time dilation drawn per
    observation or per object, a separate photoz draw for the metadata),
    then re-ordered by the new time; intervals, deltas, the reverse interval
    (``mirrored`` as the reference's rank join, or ``aligned``), wavelengths
    with the new photoz, and the 10-slot meta.

    Random draws are keyed by (object_id, descending grid rank, replica),
    so pads are keyed too and nothing depends on partitioning."""
    L = length
    df = _with_meta(collect_last_series(obs, tie, L), meta)
    kept = keep_last_elements(F.col("s"), L)
    df = df.withColumns({f"_p_{c}": e for c, e in _padded_channels(kept, L).items()})
    df = df.withColumn("_hm", log2_pow(F.col("fmax") - F.col("fmin")))
    ch = {c: F.col(f"_p_{c}") for c in CHANNELS}
    hm = F.col("_hm")
    z, ze = F.col("hostgal_photoz"), F.col("hostgal_photoz_err")
    oid = F.col("object_id")
    rep = F.lit(replica)

    # per-position struct: (mjd, p, passband, flux, flux_err, detected)
    def elem(x, i):
        mjd = x["mjd"]
        flux = x["flux"] / hm
        ferr = x["flux_err"] / hm
        if augment:
            r = F.lit(L) - i
            flux = _uniform_jitter(flux, ferr, keyed_uniform(seed, "flux", oid, r, rep))
            ukey = (oid, r, rep) if scope == "obs" else (oid, rep)
            zn = _uniform_jitter(z, ze, keyed_uniform(seed, "dt", *ukey))
            mjd = mjd * ((F.lit(1.0) + z) / (F.lit(1.0) + zn))
        return F.struct(mjd.alias("mjd"), i.alias("p"), x["passband"].alias("passband"),
                        flux.alias("flux"), ferr.alias("flux_err"), x["detected"].alias("detected"))

    padded = F.arrays_zip(*[ch[c].alias(c) for c in CHANNELS])
    df = df.withColumn("_q", F.sort_array(F.transform(padded, elem)))
    if augment:
        photoz = _uniform_jitter(z, ze, keyed_uniform(seed, "photoz", oid, rep))
    else:
        photoz = z
    df = df.withColumn("_z", photoz)
    q = F.col("_q")
    first = q.getItem(0).getField("mjd")
    last = q.getItem(L - 1).getField("mjd")
    df = df.withColumns({"_z1": F.col("_z") + F.lit(1.0), "_first": first, "_last": last})
    z1, first, last = F.col("_z1"), F.col("_first"), F.col("_last")
    rval = F.transform(F.reverse(q) if rval_mode == "mirrored" else q, lambda x: last - x["mjd"])
    hist = F.struct(
        F.transform(q, lambda x: x["mjd"] - first).cast("array<float>").alias("interval"),
        forward_diff(F.col("_q.mjd")).cast("array<float>").alias("deltaMjd"),
        rval.cast("array<float>").alias("rval"),
        F.col("_q.flux").cast("array<float>").alias("flux"),
        F.col("_q.flux_err").cast("array<float>").alias("flux_err"),
        F.col("_q.detected").cast("array<int>").alias("detected"),
        F.transform(q, lambda x: F.try_divide(nm_of(x["passband"]), z1) / F.lit(1000.0))
        .cast("array<float>").alias("source_wavelength"),
        F.transform(q, lambda x: nm_of(x["passband"]) / F.lit(1000.0))
        .cast("array<float>").alias("received_wavelength"),
    )
    fp = F.log2(F.col("fmax") - F.col("fmin"))
    meta_arr = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0),
                       F.col("ddf").cast("double"), F.col("hostgal_specz").cast("double"),
                       F.col("_z").cast("double"), F.col("mwebv").cast("double"),
                       photoz_positive("hostgal_photoz").cast("double"), fp / F.lit(10.0))
    return df.select(
        "object_id",
        meta_arr.alias("meta"),
        map_target("target").cast("int").alias("target") if "target" in df.columns
        else F.lit(UNKNOWN_CLASS_INDEX).alias("target"),
        F.col("hostgal_specz").cast("double").alias("specz"),
        F.col("_q.passband").cast("array<int>").alias("band"),
        F.array(hist).alias("hist"),
    )


# ------------------------------------------------------------------ V7 ---

def samples_baseline(obs: DataFrame, meta: DataFrame, tie, extragalactic=None,
                     use_specz: bool = False, scale: float = 100.0,
                     last: int | None = None, max_len: int | None = None,
                     limit: int | None = None, tasks: int | None = None) -> DataFrame:
    """V7: the baseline program's per-object samples as one set operation.

    Per object: target index (14 without a class column), 10-slot meta in
    the baseline layout (photoz>0 flag from the photometric redshift, slot 5
    and 6 from specz when ``use_specz``), specz, band = passband + 1, and
    an n x 8 history: time since first / scale / (1 + z), flux and flux_err
    divided by pow(2, log2(range)), detected, forward and backward
    intervals of the scaled time, source and received wavelength / 1000.

    With ``last`` only the latest ``last`` observations are kept (bounded,
    for the network input); the first time, flux range and intervals still
    come from the whole object.

    ``limit`` keeps the first ``limit`` objects by id among those that pass
    the galactic filter (1,000,000 in the reference).

    ``tasks``: number of tasks that the objects are dealt to, where what
    follows in them is long (``augment.copying_tasks``)."""
    from lcspark.operators.project import galactic_meta, limit_objects
    m = galactic_meta(meta, extragalactic)
    if limit or extragalactic is not None:
        # before the shuffle: rows of objects that are not wanted go no further
        obs = obs.join(m.select("object_id"), "object_id", "left_semi")
    if limit:
        obs = limit_objects(obs, limit)
    if last:
        series = collect_last_series(obs, tie, last, neighbours=True, tasks=tasks).withColumn("chunk", F.lit(0))
    else:
        series = collect_series(obs, tie, max_len, neighbours=True, tasks=tasks)
    df = _with_meta(series, m)
    z = F.col("hostgal_specz") if use_specz else F.col("hostgal_photoz")
    zerr = F.lit(0.0) if use_specz else F.col("hostgal_photoz_err")
    fp = F.log2(F.col("fmax") - F.col("fmin"))
    df = df.withColumns({"_hm": log2_pow(F.col("fmax") - F.col("fmin")),
                         "_z1": z + F.lit(1.0)})
    hm, first, z1 = F.col("_hm"), F.col("first_mjd"), F.col("_z1")
    s = F.col("s")

    def scaled(m):
        return F.try_divide((m - first) / F.lit(float(scale)), z1)

    # intervals use each observation's neighbours in the whole object (taken
    # on rows before the collect), so they are right in every chunk
    df = df.withColumns({
        "_t": F.transform(s, lambda x: scaled(x["mjd"])),
        "_fwd": F.transform(s, lambda x: F.when(x["_prev"].isNull(), F.lit(0.0))
                            .otherwise(scaled(x["mjd"]) - scaled(x["_prev"]))),
        "_bwd": F.transform(s, lambda x: F.when(x["_next"].isNull(), F.lit(0.0))
                            .otherwise(scaled(x["_next"]) - scaled(x["mjd"]))),
    })
    tt = F.col("_t")
    channels = [
        tt,
        F.transform(s, lambda x: x["flux"] / hm),
        F.transform(s, lambda x: x["flux_err"] / hm),
        F.transform(s, lambda x: x["detected"].cast("double")),
        F.col("_fwd"),
        F.col("_bwd"),
        F.transform(s, lambda x: F.try_divide(nm_of(x["passband"]), z1) / F.lit(1000.0)),
        F.transform(s, lambda x: nm_of(x["passband"]) / F.lit(1000.0)),
    ]
    df = df.withColumns({f"_h{k}": F.transform(c, lambda x: x.cast("float")) for k, c in enumerate(channels)})
    hist = hist_matrix([F.col(f"_h{k}") for k in range(len(channels))])
    meta_arr = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0),
                       F.col("ddf").cast("double"), z.cast("double"), zerr.cast("double"),
                       F.col("mwebv").cast("double"), photoz_positive("hostgal_photoz").cast("double"),
                       fp / F.lit(10.0)).cast("array<float>")
    return df.select(
        "object_id", "chunk", _target_index(df), meta_arr.alias("meta"),
        F.col("hostgal_specz").cast("double").alias("specz"),
        F.transform(F.col("s.passband"), lambda x: band_index(x)).cast("array<int>").alias("band"),
        hist.alias("hist"),
    )


def _target_index(df: DataFrame):
    target = map_target("target") if "target" in df.columns else F.lit(UNKNOWN_CLASS_INDEX)
    return target.cast("int").alias("target")


def sample_targets(obs: DataFrame, meta: DataFrame, extragalactic=None) -> DataFrame:
    """object_id and target of the samples that ``samples_baseline`` makes of
    the same tables, a row for each with chunk 0 (one per object and row of
    its metadata): only ids are shuffled, once per task that reads them."""
    from lcspark.operators.project import galactic_meta
    df = _with_meta(obs.select("object_id").distinct(), galactic_meta(meta, extragalactic), ["target"])
    return df.select("object_id", _target_index(df))


# ------------------------------------------------------------------ V8 ---

def last_observations(vectors: DataFrame, keys, arrays, length: int) -> DataFrame:
    """One row per key from rows of chunks: ``arrays`` hold the latest
    ``length`` observations, other columns are the key's own.  All chunks but
    the last are full, so only the last ones that can hold the latest
    ``length`` are gathered."""
    others = [c for c in vectors.columns if c not in (*keys, *arrays, "chunk")]
    needed = -(-length // aggregate.MAX_ARRAY_LEN)
    top = F.max("chunk").over(Window.partitionBy(*keys))
    late = vectors.withColumn("_top", top).filter(F.col("chunk") >= F.col("_top") - F.lit(needed))
    tails = F.struct("chunk", *[keep_last_elements(F.col(a), length).alias(a) for a in arrays])
    rows = late.groupBy(*keys).agg(F.sort_array(F.collect_list(tails)).alias("_t"), *[F.any_value(c).alias(c) for c in others])
    return rows.select(*keys, *others, *[keep_last_elements(F.flatten(F.col(f"_t.{a}")), length).alias(a) for a in arrays])


def network_input(samples: DataFrame, length: int = 256, zeroed=(0, 3, 7),
                  n_classes: int = 15, offset: int = 0) -> DataFrame:
    """V8: per object, the network's input: meta, band padded / truncated
    to ``length`` (front), history padded the same way with channels 0, 3
    and 7 zeroed, and the one-hot class; one row per object (and replica).
    Samples stored in chunks are first cut to their latest ``length``
    observations; ``samples_baseline(..., last=length)`` without ``chunk``
    is that already and is taken row by row."""
    from lcspark.functions.arrays import one_hot
    if "chunk" in samples.columns:
        keys = [k for k in ("object_id", "replica") if k in samples.columns]
        samples = last_observations(samples, keys, ["band", "hist"], length)
    zero_row = F.array_repeat(F.lit(0.0).cast("float"), F.lit(8))
    h = F.col("hist")
    padded_hist = F.slice(F.concat(F.array_repeat(zero_row, F.lit(length)), h), -length, length)
    zs = set(zeroed)
    cleaned = F.transform(padded_hist, lambda row: F.array(*[
        F.lit(0.0).cast("float") if c in zs else row[c] for c in range(8)]))
    return samples.select(
        "object_id", "meta",
        pad_array("band", length, 0, "int").alias("band"),
        cleaned.alias("hist"),
        one_hot("target", n_classes, offset).alias("target_onehot"),
    )


def network_input_from_obs(obs: DataFrame, meta: DataFrame, tie, length: int = 256, **kw) -> DataFrame:
    """V8 from the observations with a bounded collect (latest ``length``
    observations per object)."""
    return network_input(samples_baseline(obs, meta, tie, last=length).drop("chunk"), length, **kw)


def vectors_padded_relational(obs: DataFrame, meta: DataFrame, tie, length: int = 256,
                              augment: bool = False, seed: int = 0, replica: int = 0,
                              scope: str = "obs") -> DataFrame:
    """V5 in relational form, step by step as the fifth-model SQL: flux
    modifiers (A3), latest-L ranks (W9), grid x rank left join with pad
    values (J4, J5, C8), normalisation, augmentation per row, the ascending
    and descending interval windows (W8, W7) joined on equal rank (J6),
    the jittered metadata, then one collect per object.  Same rows as
    ``vectors_padded``; kept as the readable definition and for plan
    comparison (it needs several shuffles where the array path needs one)."""
    from lcspark.operators.aggregate import flux_modifiers
    from lcspark.operators.join import grid_left_join, padding_grid
    L = length
    mods = flux_modifiers(obs)
    ranked = keep_last(obs, tie, L).select("object_id", "rownum_desc", *CHANNELS)
    objects = obs.select("object_id").distinct()
    padded = grid_left_join(padding_grid(objects, L, "r"), ranked, "rownum_desc", "r", PAD)
    padded = padded.join(mods.select("object_id", "hist_modifier"), "object_id").withColumns({
        "flux": F.col("flux") / F.col("hist_modifier"),
        "flux_err": F.col("flux_err") / F.col("hist_modifier")})
    m = meta.select("object_id", "hostgal_photoz", "hostgal_photoz_err")
    rows = padded.join(m, "object_id")
    z, ze, oid, rep = (F.col("hostgal_photoz"), F.col("hostgal_photoz_err"), F.col("object_id"),
                       F.lit(replica))
    if augment:
        ukey = (oid, F.col("r"), rep) if scope == "obs" else (oid, rep)
        zn = _uniform_jitter(z, ze, keyed_uniform(seed, "dt", *ukey))
        rows = rows.withColumns({
            "mjd": F.col("mjd") * ((F.lit(1.0) + z) / (F.lit(1.0) + zn)),
            "flux": _uniform_jitter(F.col("flux"), F.col("flux_err"),
                                    keyed_uniform(seed, "flux", oid, F.col("r"), rep))})
    w = Window.partitionBy("object_id").orderBy(F.col("mjd").asc(), F.col("r").desc())
    wd = Window.partitionBy("object_id").orderBy(F.col("mjd").desc(), F.col("r").asc())
    c1 = rows.select("object_id", "mjd", "passband", "flux", "flux_err", "detected",
                     (F.col("mjd") - F.first("mjd").over(w)).alias("interval"),
                     F.coalesce(F.col("mjd") - F.lag("mjd").over(w), F.lit(0.0)).alias("deltaMjd"),
                     F.row_number().over(w).alias("rownum"))
    c2 = rows.select("object_id", (F.first("mjd").over(wd) - F.col("mjd")).alias("rval"),
                     F.row_number().over(wd).alias("rownum"))
    j = c1.join(c2, ["object_id", "rownum"])
    mm = meta.join(mods.select("object_id", "meta_val"), "object_id")
    if augment:
        mm = mm.withColumn("_z", _uniform_jitter(z, ze, keyed_uniform(seed, "photoz", oid, rep)))
    else:
        mm = mm.withColumn("_z", z)
    mm = mm.select("object_id", "_z", "ddf", "hostgal_specz", "hostgal_photoz", "mwebv", "meta_val",
                   *[c for c in ("target",) if c in meta.columns])
    j = j.join(mm, "object_id").withColumns({
        "source_wavelength": F.try_divide(nm_of(F.col("passband")), F.col("_z") + F.lit(1.0)) / F.lit(1000.0),
        "received_wavelength": nm_of(F.col("passband")) / F.lit(1000.0)})
    chans = ["interval", "deltaMjd", "rval", "flux", "flux_err", "detected", "source_wavelength",
             "received_wavelength"]
    s = sorted_struct_array(F.col("rownum"), F.col("passband"), *[F.col(c) for c in chans])
    meta_arr = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("ddf").cast("double"),
                       F.col("hostgal_specz").cast("double"), F.col("_z").cast("double"),
                       F.col("mwebv").cast("double"), photoz_positive("hostgal_photoz").cast("double"),
                       F.col("meta_val"))
    target = (map_target("target") if "target" in meta.columns else F.lit(UNKNOWN_CLASS_INDEX)).cast("int")
    g = j.groupBy("object_id").agg(
        s.alias("s"), F.any_value(meta_arr).alias("meta"), F.any_value(target).alias("target"),
        F.any_value(F.col("hostgal_specz").cast("double")).alias("specz"))
    hist = F.struct(*[F.col(f"s.{c}").cast("array<int>" if c == "detected" else "array<float>").alias(c)
                      for c in chans])
    return g.select("object_id", "meta", "target", "specz",
                    F.col("s.passband").cast("array<int>").alias("band"), F.array(hist).alias("hist"))
