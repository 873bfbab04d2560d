"""Queries for pivots, arrays, array functions and vector tables
(A4-A11, C13, C14, F2-F5, F10, V1-V8).  Arrays are exploded with their
position so that the oracle can be a plain relational query."""

from __future__ import annotations

from pyspark.sql import functions as F

from lcspark.functions import arrays as FA
from lcspark.operators import aggregate as A
from lcspark.operators import join as J
from lcspark.operators import project as C
from lcspark.operators import vectors as V
from lcspark.plans.q_basic import TIE, P, meta, obs, order_desc_sql, order_sql
from lcspark.plans.q_basic import _MODS_SQL
from lcspark.plans.registry import explode_arrays, f6, i64, r6, register
from lcspark.plans.sql import f6 as f6s, map_target_sql, r6 as r6s, wavelength_nm_sql, with_binding
from lcspark.plans.sql import keyed_uniform_sql

FEATS = ["mjd", "passband", "flux", "flux_err", "detected"]
INT_FEATS = {"passband", "detected"}


def _ranked_cte(b, name="ranked"):
    return (f"{name} AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_sql(b)}) AS rn,"
            f" row_number() OVER (PARTITION BY object_id ORDER BY {order_desc_sql(b)}) AS rnd,"
            f" count(*) OVER (PARTITION BY object_id) AS n FROM obs)")


def _feat_out_spark(f, c=None):
    c = c if c is not None else F.col(f)
    return (i64(c) if f in INT_FEATS else c.cast("double")).alias(f)


def _feat_out_sql(f, e=None):
    e = e or f
    return f"CAST({e} AS BIGINT) AS {f}" if f in INT_FEATS else f"CAST({e} AS DOUBLE) AS {f}"


# ------------------------------------------------------------- pivots ---

# The width of a pivot comes from the data, so wide rows are compared cell by
# cell, the null tails included.

_CELLS = f"""
    FROM (SELECT o.object_id, i.i FROM (SELECT DISTINCT object_id FROM obs) o,
                 range(1, CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM obs GROUP BY object_id) c) AS BIGINT) + 1) i(i)) g
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_sql(P)}) AS rn FROM obs) t
      ON t.object_id = g.object_id AND t.rn = g.i"""


def _cells(wide, feats):
    width = (len(wide.columns) - 1) // len(feats)
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("rownum"), *[F.col(f"{f}{i}").alias(f) for f in feats])
                     for i in range(1, width + 1)])
    return wide.select("object_id", F.inline(rows))


@register("pivot_feature", with_binding(P, f"SELECT g.object_id, CAST(g.i AS BIGINT) AS rownum, t.mjd {_CELLS}"))
def q_pivot_feature(spark, sf):
    return _cells(A.pivot_feature(obs(spark, sf), "mjd", tie=TIE[P]), ["mjd"])


@register("pivot_all_features", with_binding(P, f"""
    SELECT g.object_id, CAST(g.i AS BIGINT) AS rownum, {', '.join(_feat_out_sql(f, 't.' + f) for f in FEATS)} {_CELLS}"""))
def q_pivot_all_features(spark, sf):
    cells = _cells(A.pivot_all_wide(obs(spark, sf), tie=TIE[P]), FEATS)
    return cells.select("object_id", "rownum", *[_feat_out_spark(f) for f in FEATS])


@register("unpivot_feature", with_binding(P, f"""
    SELECT object_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY {order_sql(P)}) AS BIGINT) AS rownum,
           flux FROM obs"""))
def q_unpivot_feature(spark, sf):
    wide = A.pivot_feature(obs(spark, sf), "flux", tie=TIE[P])
    long = A.unpivot_feature(wide, "flux", len(wide.columns) - 1)
    return long.select("object_id", i64("rownum").alias("rownum"), "flux")


@register("align_pivots", with_binding(P, f"""
    SELECT object_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY {order_sql(P)}) AS BIGINT) AS rownum,
           {', '.join(_feat_out_sql(f) for f in FEATS)} FROM obs"""))
def q_align_pivots(spark, sf):
    pivots = A.pivot_all_features(obs(spark, sf), tie=TIE[P])
    aligned = J.align_pivots(pivots)
    return aligned.select("object_id", i64("rownum").alias("rownum"), *[_feat_out_spark(f) for f in FEATS])


# ----------------------------------------------------- arrays (A7-A11) ---

_ARR_TYPES = {"mjd": "float", "passband": "int", "flux": "float", "flux_err": "float", "detected": "int"}


def _float_or_int_sql(f, e=None):
    e = e or f
    return f"CAST({e} AS BIGINT) AS {f}" if f in INT_FEATS else f"{f6s(e)} AS {f}"


def _float_or_int_spark(f):
    return i64(f).alias(f) if f in INT_FEATS else f6(f).alias(f)


_ROWS_AS_ARRAYS_SQL = with_binding(P, f"""
    SELECT object_id, CAST(rn - 1 AS BIGINT) AS pos, {', '.join(_float_or_int_sql(f) for f in FEATS)}
    FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_sql(P)}) AS rn FROM obs) t""")


@register("collect_arrays", _ROWS_AS_ARRAYS_SQL)
def q_collect_arrays(spark, sf):
    arr = A.collect_arrays(obs(spark, sf), TIE[P], types=_ARR_TYPES)
    ex = explode_arrays(arr, ["object_id"], {f: F.col(f) for f in FEATS})
    return ex.select("object_id", "pos", *[_float_or_int_spark(f) for f in FEATS])


@register("nested_arrays", _ROWS_AS_ARRAYS_SQL)
def q_nested_arrays(spark, sf):
    arr = A.nested_arrays(obs(spark, sf), TIE[P], types=_ARR_TYPES)
    ex = explode_arrays(arr, ["object_id"], {f: F.flatten(F.col(f)) for f in FEATS})
    return ex.select("object_id", "pos", *[_float_or_int_spark(f) for f in FEATS])


@register("vectors_raw", _ROWS_AS_ARRAYS_SQL)
def q_vectors_raw(spark, sf):
    arr = V.vectors_raw(obs(spark, sf), TIE[P])
    ex = explode_arrays(arr, ["object_id"], {f: F.col(f)[0] for f in FEATS})
    return ex.select("object_id", "pos", *[_float_or_int_spark(f) for f in FEATS])


@register("hist_struct", with_binding(P, f"""
    SELECT o.object_id, CAST(m.target AS BIGINT) AS target, CAST(o.rn - 1 AS BIGINT) AS pos,
           {f6s('o.mjd')} AS mjd, {f6s('o.flux')} AS flux, {f6s('o.flux_err')} AS flux_err,
           {f6s('o.detected')} AS detected
    FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_sql(P)}) AS rn FROM obs) o
    JOIN meta m ON o.object_id = m.object_id""", meta=True))
def q_hist_struct(spark, sf):
    o = J.join_metadata(obs(spark, sf), meta(spark, sf).select("object_id", "target"))
    fields = {"mjd": ("mjd", "float"), "flux": ("flux", "float"),
              "flux_err": ("flux_err", "float"), "detected": ("detected", "float")}
    h = A.hist_struct(o, TIE[P], fields, carry=["target"])
    ex = explode_arrays(h, ["object_id", "target"], {n: F.col("hist")[0][n] for n in fields})
    return ex.select("object_id", i64("target").alias("target"), "pos", *[f6(n).alias(n) for n in fields])


@register("distinct_objects", with_binding(P, """
    SELECT DISTINCT object_id, CAST(0 AS BIGINT) AS pad_mjd, CAST(0 AS BIGINT) AS pad_passband,
           CAST(0 AS BIGINT) AS pad_flux, CAST(0 AS BIGINT) AS pad_flux_err, CAST(0 AS BIGINT) AS pad_detected
    FROM obs"""))
def q_distinct_objects(spark, sf):
    d = A.distinct_objects(obs(spark, sf))
    return d.select("object_id", *[i64(c).alias(c) for c in d.columns if c != "object_id"])


@register("group_by_meta", with_binding(P, f"""
    SELECT o.object_id, CAST(m.target AS BIGINT) AS target, {r6s('m.hostgal_specz')} AS specz,
           CAST(count(*) AS BIGINT) AS n_obs, {r6s('sum(o.flux)')} AS flux_sum
    FROM obs o JOIN meta m ON o.object_id = m.object_id
    GROUP BY o.object_id, m.target, m.hostgal_specz""", meta=True))
def q_group_by_meta(spark, sf):
    o = J.join_metadata(obs(spark, sf), meta(spark, sf).select(
        "object_id", "target", F.col("hostgal_specz").alias("specz")))
    g = A.group_by_meta(o, ["object_id", "target", "specz"],
                        [F.count(F.lit(1)).alias("n_obs"), F.sum("flux").alias("flux_sum")])
    return g.select("object_id", i64("target").alias("target"), r6("specz").alias("specz"),
                    i64("n_obs").alias("n_obs"), r6("flux_sum").alias("flux_sum"))


# ------------------------------------------------------- array functions ---

@register("pad_array", with_binding(P, f"""
    SELECT g.object_id, CAST(g.pos AS BIGINT) AS pos, {f6s('COALESCE(t.flux, 0.0)')} AS flux
    FROM (SELECT o.object_id, p.pos FROM (SELECT DISTINCT object_id FROM obs) o, range(0, 32) p(pos)) g
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_desc_sql(P)}) AS rnd FROM obs) t
      ON t.object_id = g.object_id AND t.rnd = 32 - g.pos"""))
def q_pad_array(spark, sf):
    arr = V.collect_last_series(obs(spark, sf), TIE[P], 32)
    p = arr.select("object_id", FA.pad_array(F.col("s.flux"), 32, 0, "float").alias("flux"))
    ex = explode_arrays(p, ["object_id"], {"flux": F.col("flux")})
    return ex.select("object_id", "pos", f6("flux").alias("flux"))


@register("forward_diff", with_binding(P, f"""
    SELECT object_id, CAST(row_number() OVER w - 1 AS BIGINT) AS pos,
           {r6s('COALESCE(mjd - lag(mjd) OVER w, 0.0)')} AS fwd
    FROM obs WINDOW w AS (PARTITION BY object_id ORDER BY {order_sql(P)})"""))
def q_forward_diff(spark, sf):
    arr = V.collect_series(obs(spark, sf), TIE[P], neighbours=True)
    arr = arr.select("object_id", "chunk", FA.forward_diff(F.col("s.mjd"), before=F.col("s")[0]["_prev"]).alias("fwd"))
    ex = explode_arrays(arr, ["object_id"], {"fwd": F.col("fwd")})
    return ex.select("object_id", "pos", r6("fwd").alias("fwd"))


@register("backward_diff", with_binding(P, f"""
    SELECT object_id, CAST(row_number() OVER w - 1 AS BIGINT) AS pos,
           {r6s('COALESCE(lead(mjd) OVER w - mjd, 0.0)')} AS bwd
    FROM obs WINDOW w AS (PARTITION BY object_id ORDER BY {order_sql(P)})"""))
def q_backward_diff(spark, sf):
    arr = V.collect_series(obs(spark, sf), TIE[P], neighbours=True)
    arr = arr.select("object_id", "chunk",
                     FA.backward_diff(F.col("s.mjd"), after=F.element_at("s", -1)["_next"]).alias("bwd"))
    ex = explode_arrays(arr, ["object_id"], {"bwd": F.col("bwd")})
    return ex.select("object_id", "pos", r6("bwd").alias("bwd"))


def _one_hot_query(offset):
    sql = with_binding(P, f"""
        SELECT m.object_id, CAST(c.i AS BIGINT) AS pos,
               CASE WHEN c.i + {offset} = {map_target_sql('m.target')} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS value
        FROM meta m, range(0, 15) c(i)""", meta=True)

    @register(f"one_hot_offset{offset}", sql)
    def q(spark, sf):
        from lcspark.functions.expr import map_target
        m = meta(spark, sf).select("object_id", FA.one_hot(map_target("target"), 15, offset).alias("v"))
        return explode_arrays(m, ["object_id"], {"value": F.col("v")})
    return q


for _off in (0, 1):
    _one_hot_query(_off)


# ------------------------------------------------------------ V1 (pad) ---

def _pad_rel_sql(b, length):
    return with_binding(b, f"""
        SELECT g.object_id, CAST({length} - g.r AS BIGINT) AS pos,
               {', '.join(_float_or_int_sql(f, f'COALESCE(t.{f}, 0)') for f in FEATS)}
        FROM (SELECT o.object_id, r.r FROM (SELECT DISTINCT object_id FROM obs) o, range(1, {length + 1}) r(r)) g
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_desc_sql(b)}) AS rnd FROM obs) t
          ON t.object_id = g.object_id AND t.rnd = g.r""")


def _pad_query(name, b, length, relational):
    @register(name, _pad_rel_sql(b, length))
    def q(spark, sf):
        o = obs(spark, sf, b)
        if relational:
            out = V.pad_observations_relational(o, TIE[b], length)
        else:
            arr = V.pad_observations(o, TIE[b], length)
            out = explode_arrays(arr, ["object_id"], {f: F.col(f) for f in FEATS})
        return out.select("object_id", i64("pos").alias("pos"), *[_float_or_int_spark(f) for f in FEATS])
    return q


_pad_query("pad_observations", P, 32, False)
_pad_query("pad_observations_relational", P, 32, True)
_pad_query("pad_observations_supp", "obs_supp", 256, False)


@register("join_pivot_metadata", with_binding(P, f"""
    SELECT o.object_id, CAST(m.target AS BIGINT) AS target,
           {r6s('m.ddf')} AS m0, {r6s('m.hostgal_specz')} AS m1, {r6s('m.hostgal_photoz')} AS m2,
           {r6s('m.hostgal_photoz_err')} AS m3, {r6s('m.mwebv')} AS m4, {r6s('m.distmod')} AS m5,
           CAST(o.rn - 1 AS BIGINT) AS pos, {', '.join(_float_or_int_sql(f, 'o.' + f) for f in FEATS)}
    FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_sql(P)}) AS rn FROM obs) o
    JOIN meta m ON o.object_id = m.object_id""", meta=True))
def q_join_pivot_metadata(spark, sf):
    arr = V.vectors_raw(obs(spark, sf), TIE[P])
    m = meta(spark, sf).select("object_id", "target", C.meta_vector("raw6").alias("meta"))
    j = J.join_pivot_metadata(arr, m, ["target", "meta"])
    j = j.select("object_id", "chunk", "target", *[F.col("meta")[i].alias(f"m{i}") for i in range(6)],
                 *[F.col(f)[0].alias(f) for f in FEATS])
    ex = explode_arrays(j, ["object_id", "target"] + [f"m{i}" for i in range(6)], {f: F.col(f) for f in FEATS})
    return ex.select("object_id", i64("target").alias("target"), *[r6(f"m{i}").alias(f"m{i}") for i in range(6)],
                     "pos", *[_float_or_int_spark(f) for f in FEATS])


# ---------------------------------------------------------- V3 / V4 / V6 ---

@register("vectors_meta", with_binding(P, f"""
    SELECT o.object_id, CAST(m.target AS BIGINT) AS target, {r6s('m.hostgal_specz')} AS specz,
           {r6s('m.ddf')} AS m0, {r6s('m.hostgal_specz')} AS m1, {r6s('m.hostgal_photoz')} AS m2,
           {r6s('m.hostgal_photoz_err')} AS m3, {r6s('m.mwebv')} AS m4,
           CAST(o.rn - 1 AS BIGINT) AS pos, CAST(o.passband AS BIGINT) AS band,
           {f6s('o.mjd')} AS mjd, {f6s('o.flux')} AS flux, {f6s('o.flux_err')} AS flux_err,
           {f6s('o.detected')} AS detected
    FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_sql(P)}) AS rn FROM obs) o
    JOIN meta m ON o.object_id = m.object_id""", meta=True))
def q_vectors_meta(spark, sf):
    v = V.vectors_meta(obs(spark, sf), meta(spark, sf), TIE[P])
    h = F.col("hist")[0]
    v = v.select("object_id", "chunk", "target", "specz", "band", "hist",
                 *[F.col("meta")[i].alias(f"m{i}") for i in range(5)])
    ex = explode_arrays(v, ["object_id", "target", "specz"] + [f"m{i}" for i in range(5)],
                        {"band": F.col("band"), "mjd": h["mjd"], "flux": h["flux"],
                         "flux_err": h["flux_err"], "detected": h["detected"]})
    return ex.select("object_id", i64("target").alias("target"), r6("specz").alias("specz"),
                     *[r6(f"m{i}").alias(f"m{i}") for i in range(5)], "pos", i64("band").alias("band"),
                     *[f6(c).alias(c) for c in ("mjd", "flux", "flux_err", "detected")])


def _calc_sql(b, train=True):
    target = f"CAST({map_target_sql('m.target')} AS BIGINT)" if train else "CAST(0 AS BIGINT)"
    return with_binding(b, f"""
        SELECT o.object_id, {target} AS target,
               {r6s('m.ddf')} AS m4, {r6s('m.hostgal_specz')} AS m5, {r6s('m.hostgal_photoz')} AS m6,
               {r6s('m.mwebv')} AS m7, {r6s('CASE WHEN m.hostgal_photoz > 0 THEN 1.0 ELSE 0.0 END')} AS m8,
               {r6s('d.meta_val')} AS m9,
               CAST(o.rn - 1 AS BIGINT) AS pos, CAST(o.passband AS BIGINT) AS band,
               CAST(0.0 AS DOUBLE) AS mjd, {f6s('o.flux / d.hist_modifier')} AS flux,
               {f6s('o.flux_err / d.hist_modifier')} AS flux_err, CAST(0 AS BIGINT) AS detected,
               {f6s('(o.mjd - first_value(o.mjd) OVER (PARTITION BY o.object_id ORDER BY o.rn)) / (m.hostgal_photoz + 1.0)')} AS fwd_int,
               {f6s('(o.mjd - first_value(o.mjd) OVER (PARTITION BY o.object_id ORDER BY o.rn)) / (m.hostgal_photoz + 1.0)')} AS bwd_int,
               {f6s(wavelength_nm_sql('o.passband') + ' / (m.hostgal_photoz + 1.0) / 1000.0')} AS source_wavelength,
               CAST(0.0 AS DOUBLE) AS received_wavelength
        FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_sql(b)}) AS rn FROM obs) o
        JOIN meta m ON o.object_id = m.object_id
        JOIN mods d ON o.object_id = d.object_id""", meta=True, extra=_MODS_SQL)


_CALC_OUT = ["mjd", "flux", "flux_err", "detected", "fwd_int", "bwd_int", "source_wavelength",
             "received_wavelength"]


def _calc_explode(v, channels):
    v = v.select("object_id", "chunk", "target", "band",
                 *[F.col("meta")[i].alias(f"m{i}") for i in range(4, 10)],
                 *[channels[c].alias(c) for c in _CALC_OUT])
    ex = explode_arrays(v, ["object_id", "target"] + [f"m{i}" for i in range(4, 10)],
                        {"band": F.col("band"), **{c: F.col(c) for c in _CALC_OUT}})
    return ex.select("object_id", i64("target").alias("target"),
                     *[r6(f"m{i}").alias(f"m{i}") for i in range(4, 10)], "pos", i64("band").alias("band"),
                     *[(i64(c) if c == "detected" else f6(c)).alias(c) for c in _CALC_OUT])


@register("vectors_calculated", _calc_sql(P))
def q_vectors_calculated(spark, sf):
    v = V.vectors_calculated(obs(spark, sf), meta(spark, sf), TIE[P])
    h = F.col("hist")[0]
    return _calc_explode(v, {c: h[c] for c in _CALC_OUT})


@register("vectors_flat_train", _calc_sql(P))
def q_vectors_flat_train(spark, sf):
    v = V.vectors_flat(obs(spark, sf), meta(spark, sf), TIE[P])
    return _calc_explode(v, {c: F.col(c) for c in _CALC_OUT})


@register("vectors_flat_test", _calc_sql("obs_event", train=False))
def q_vectors_flat_test(spark, sf):
    m = meta(spark, sf, "obs_event").drop("target")
    v = V.vectors_flat(obs(spark, sf, "obs_event"), m, TIE["obs_event"], train=False)
    return _calc_explode(v, {c: F.col(c) for c in _CALC_OUT})


@register("hist_channel", with_binding(P, f"""
    SELECT object_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY {order_sql(P)}) - 1 AS BIGINT) AS pos,
           {f6s('flux / d.hist_modifier')} AS flux
    FROM obs JOIN mods d USING (object_id)""", extra=_MODS_SQL))
def q_hist_channel(spark, sf):
    v = V.vectors_calculated(obs(spark, sf), meta(spark, sf), TIE[P])
    ch = C.hist_channel(v, "flux")
    ex = explode_arrays(ch, ["object_id"], {"flux": F.col("flux")})
    return ex.select("object_id", "pos", f6("flux").alias("flux"))


# ------------------------------------------------------------------ V5 ---

def _v5_sql(b, length, augment=False, scope="obs", seed=0, replica=0):
    L = length
    if augment:
        uf = keyed_uniform_sql(seed, "flux", "p.object_id", "p.r", str(replica))
        udt = (keyed_uniform_sql(seed, "dt", "p.object_id", "p.r", str(replica)) if scope == "obs"
               else keyed_uniform_sql(seed, "dt", "p.object_id", str(replica)))
        uz = keyed_uniform_sql(seed, "photoz", "m.object_id", str(replica))
        z, e = "m.hostgal_photoz", "m.hostgal_photoz_err"
        mjd = f"p.mjd * ((1.0 + {z}) / (1.0 + ({udt} * (({z} + {e}) - (({z} - {e}) / 1.5)) + (({z} - {e}) / 1.5))))"
        flux = f"{uf} * ((p.flux + p.flux_err) - ((p.flux - p.flux_err) / 1.5)) + ((p.flux - p.flux_err) / 1.5)"
        zj = f"{uz} * (({z} + {e}) - (({z} - {e}) / 1.5)) + (({z} - {e}) / 1.5)"
    else:
        mjd, flux, zj = "p.mjd", "p.flux", "m.hostgal_photoz"
    nm = wavelength_nm_sql("c1.passband")
    return with_binding(b, f"""
        SELECT c1.object_id, CAST(c1.rownum - 1 AS BIGINT) AS pos, CAST(c1.passband AS BIGINT) AS band,
               {f6s('c1.interval')} AS interval, {f6s('c1.delta')} AS delta_mjd, {f6s('c2.rval')} AS rval,
               {f6s('c1.flux')} AS flux, {f6s('c1.flux_err')} AS flux_err,
               CAST(c1.detected AS BIGINT) AS detected,
               {f6s(nm + ' / (mm.zj + 1.0) / 1000.0')} AS source_wavelength,
               {f6s(nm + ' / 1000.0')} AS received_wavelength,
               CAST({map_target_sql('mm.target')} AS BIGINT) AS target, {r6s('mm.hostgal_specz')} AS specz,
               {r6s('mm.ddf')} AS m4, {r6s('mm.hostgal_specz')} AS m5, {r6s('mm.zj')} AS m6,
               {r6s('mm.mwebv')} AS m7, {r6s('CASE WHEN mm.hostgal_photoz > 0 THEN 1.0 ELSE 0.0 END')} AS m8,
               {r6s('mm.meta_val')} AS m9
        FROM c1 JOIN c2 ON c1.object_id = c2.object_id AND c1.rownum = c2.rownum
        JOIN mm ON mm.object_id = c1.object_id""", meta=True, extra=f"""{_MODS_SQL},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_desc_sql(b)}) AS rnd FROM obs),
        padded AS (
            SELECT g.object_id, g.r, COALESCE(t.mjd, 0.0) AS mjd, COALESCE(t.passband, 0) AS passband,
                   COALESCE(t.flux, 0.0) / d.hist_modifier AS flux,
                   COALESCE(t.flux_err, 0.0) / d.hist_modifier AS flux_err,
                   COALESCE(t.detected, 0) AS detected
            FROM (SELECT o.object_id, r.r FROM (SELECT DISTINCT object_id FROM obs) o, range(1, {L + 1}) r(r)) g
            LEFT JOIN ranked t ON t.object_id = g.object_id AND t.rnd = g.r
            JOIN mods d ON d.object_id = g.object_id),
        aug AS (
            SELECT p.object_id, p.r, {mjd} AS mjd, p.passband, {flux} AS flux, p.flux_err, p.detected
            FROM padded p JOIN meta m ON m.object_id = p.object_id),
        c1 AS (
            SELECT *, mjd - first_value(mjd) OVER w AS interval,
                   COALESCE(mjd - lag(mjd) OVER w, 0.0) AS delta, row_number() OVER w AS rownum
            FROM aug WINDOW w AS (PARTITION BY object_id ORDER BY mjd, r DESC)),
        c2 AS (
            SELECT object_id, first_value(mjd) OVER x - mjd AS rval, row_number() OVER x AS rownum
            FROM aug WINDOW x AS (PARTITION BY object_id ORDER BY mjd DESC, r ASC)),
        mm AS (SELECT m.*, {zj} AS zj, d.meta_val FROM meta m JOIN mods d ON m.object_id = d.object_id)""")


_V5_OUT = ["interval", "deltaMjd", "rval", "flux", "flux_err", "detected", "source_wavelength",
           "received_wavelength"]


def _v5_explode(v):
    h = F.col("hist")[0]
    v = v.select("object_id", "target", "specz", "band", "hist",
                 *[F.col("meta")[i].alias(f"m{i}") for i in range(4, 10)])
    ex = explode_arrays(v, ["object_id", "target", "specz"] + [f"m{i}" for i in range(4, 10)],
                        {"band": F.col("band"), **{c: h[c] for c in _V5_OUT}})
    return ex.select("object_id", "pos", i64("band").alias("band"),
                     f6("interval").alias("interval"), f6("deltaMjd").alias("delta_mjd"),
                     f6("rval").alias("rval"), f6("flux").alias("flux"), f6("flux_err").alias("flux_err"),
                     i64("detected").alias("detected"), f6("source_wavelength").alias("source_wavelength"),
                     f6("received_wavelength").alias("received_wavelength"),
                     i64("target").alias("target"), r6("specz").alias("specz"),
                     *[r6(f"m{i}").alias(f"m{i}") for i in range(4, 10)])


def _v5_query(name, b, length, augment=False, scope="obs", seed=0):
    @register(name, _v5_sql(b, length, augment, scope, seed))
    def q(spark, sf):
        v = V.vectors_padded(obs(spark, sf, b), meta(spark, sf, b), TIE[b], length,
                             augment=augment, seed=seed, scope=scope)
        return _v5_explode(v)
    return q


_v5_query("vectors_padded", P, 32)


@register("vectors_padded_relational", _v5_sql(P, 32))
def q_vectors_padded_relational(spark, sf):
    return _v5_explode(V.vectors_padded_relational(obs(spark, sf), meta(spark, sf), TIE[P], 32))


@register("vectors_padded_augmented_relational", _v5_sql(P, 32, True, "obs", 7))
def q_vectors_padded_augmented_relational(spark, sf):
    return _v5_explode(V.vectors_padded_relational(obs(spark, sf), meta(spark, sf), TIE[P], 32,
                                                   augment=True, seed=7))
_v5_query("vectors_padded_supp", "obs_supp", 256)
_v5_query("vectors_padded_augmented", P, 32, augment=True, scope="obs", seed=7)
_v5_query("vectors_padded_augmented_object", P, 32, augment=True, scope="object", seed=7)


# -------------------------------------------------------------- V7 / V8 ---

def _v7_rows_cte(b, extragalactic=None, use_specz=False):
    nm = wavelength_nm_sql("passband")
    z = "m.hostgal_specz" if use_specz else "m.hostgal_photoz"
    zerr = "0.0" if use_specz else "m.hostgal_photoz_err"
    cond = {None: "TRUE", True: "m.hostgal_photoz <> 0", False: "NOT (m.hostgal_photoz > 0)"}[extragalactic]
    return f"""{_MODS_SQL},
        base AS (
            SELECT o.*, {z} AS z, CAST({zerr} AS DOUBLE) AS zerr, m.ddf, m.mwebv, m.hostgal_specz,
                   m.hostgal_photoz AS photoz, m.target, d.hist_modifier, d.meta_val,
                   row_number() OVER (PARTITION BY o.object_id ORDER BY {order_sql(b).replace('mjd', 'o.mjd')}) AS rn,
                   count(*) OVER (PARTITION BY o.object_id) AS n
            FROM obs o JOIN meta m ON o.object_id = m.object_id JOIN mods d ON o.object_id = d.object_id
            WHERE {cond}),
        timed AS (
            SELECT *, (mjd - first_value(mjd) OVER (PARTITION BY object_id ORDER BY rn)) / 100.0 / (z + 1.0) AS t
            FROM base),
        samples AS (
            SELECT object_id, rn, n, passband + 1 AS band, z, zerr, photoz, ddf, mwebv, hostgal_specz, target, meta_val,
                   t AS h0, flux / hist_modifier AS h1, flux_err / hist_modifier AS h2,
                   CAST(detected AS DOUBLE) AS h3,
                   COALESCE(t - lag(t) OVER w, 0.0) AS h4, COALESCE(lead(t) OVER w - t, 0.0) AS h5,
                   {nm} / (z + 1.0) / 1000.0 AS h6, {nm} / 1000.0 AS h7
            FROM timed WINDOW w AS (PARTITION BY object_id ORDER BY rn))"""


def _v7_out_sql():
    return f"""
    SELECT object_id, CAST(rn - 1 AS BIGINT) AS pos, CAST(band AS BIGINT) AS band,
           {', '.join(f'{f6s(f"h{i}")} AS h{i}' for i in range(8))},
           CAST({map_target_sql('target')} AS BIGINT) AS target, {r6s('hostgal_specz')} AS specz,
           {f6s('ddf')} AS m4, {f6s('z')} AS m5, {f6s('zerr')} AS m6, {f6s('mwebv')} AS m7,
           {f6s('CASE WHEN photoz > 0 THEN 1.0 ELSE 0.0 END')} AS m8, {f6s('meta_val')} AS m9
    FROM samples"""


def _v7_explode(s):
    s = s.select("object_id", "chunk", "target", "specz", "band", "hist",
                 *[F.col("meta")[i].alias(f"m{i}") for i in range(4, 10)])
    ex = explode_arrays(s, ["object_id", "target", "specz"] + [f"m{i}" for i in range(4, 10)],
                        {"band": F.col("band"), "row": F.col("hist")})
    return ex.select("object_id", "pos", i64("band").alias("band"),
                     *[f6(F.col("row")[i]).alias(f"h{i}") for i in range(8)],
                     i64("target").alias("target"), r6("specz").alias("specz"),
                     *[f6(f"m{i}").alias(f"m{i}") for i in range(4, 10)])


@register("samples_baseline_specz_extragalactic",
          with_binding(P, _v7_out_sql(), meta=True, extra=_v7_rows_cte(P, extragalactic=True, use_specz=True)))
def q_samples_baseline_specz(spark, sf):
    s = V.samples_baseline(obs(spark, sf), meta(spark, sf), TIE[P], extragalactic=True, use_specz=True)
    return _v7_explode(s)


@register("samples_baseline_galactic",
          with_binding(P, _v7_out_sql(), meta=True, extra=_v7_rows_cte(P, extragalactic=False)))
def q_samples_baseline_galactic(spark, sf):
    s = V.samples_baseline(obs(spark, sf), meta(spark, sf), TIE[P], extragalactic=False)
    return _v7_explode(s)


@register("samples_baseline", with_binding(P, _v7_out_sql(), meta=True, extra=_v7_rows_cte(P)))
def q_samples_baseline(spark, sf):
    return _v7_explode(V.samples_baseline(obs(spark, sf), meta(spark, sf), TIE[P]))


def _v8_sql_simple(b, length):
    L = length
    h = ", ".join(
        (f"{f6s('COALESCE(s.h' + str(i) + ', 0.0)')} AS h{i}" if i not in (0, 3, 7) else f"CAST(0.0 AS DOUBLE) AS h{i}")
        for i in range(8))
    return with_binding(b, f"""
        SELECT g.object_id, CAST(g.pos AS BIGINT) AS pos, CAST(COALESCE(s.band, 0) AS BIGINT) AS band, {h},
               CAST({map_target_sql('g.target')} AS BIGINT) AS onehot_index
        FROM (SELECT o.object_id, o.target, o.n, p.pos
              FROM (SELECT DISTINCT object_id, target, n FROM samples) o, range(0, {L}) p(pos)) g
        LEFT JOIN samples s ON s.object_id = g.object_id AND s.rn = g.pos + g.n - {L} + 1""",
                        meta=True, extra=_v7_rows_cte(b))


@register("network_input", _v8_sql_simple(P, 32))
def q_network_input(spark, sf):
    n = V.network_input_from_obs(obs(spark, sf), meta(spark, sf), TIE[P], 32)
    n = n.select("object_id", "band", "hist",
                 (F.array_position("target_onehot", F.lit(1.0)) - F.lit(1)).alias("onehot_index"))
    ex = explode_arrays(n, ["object_id", "onehot_index"], {"band": F.col("band"), "row": F.col("hist")})
    return ex.select("object_id", "pos", i64("band").alias("band"),
                     *[f6(F.col("row")[i]).alias(f"h{i}") for i in range(8)],
                     i64("onehot_index").alias("onehot_index"))


@register("zero_channels", with_binding(P, f"""
    SELECT object_id, CAST(rn - 1 AS BIGINT) AS pos,
           {', '.join((f'{f6s(f"h{i}")} AS h{i}' if i not in (0, 3, 7) else f'CAST(0.0 AS DOUBLE) AS h{i}') for i in range(8))}
    FROM samples""", meta=True, extra=_v7_rows_cte(P)))
def q_zero_channels(spark, sf):
    s = V.samples_baseline(obs(spark, sf), meta(spark, sf), TIE[P])
    z = s.select("object_id", "chunk", C.zero_channels_matrix("hist").alias("hist"))
    ex = explode_arrays(z, ["object_id"], {"row": F.col("hist")})
    return ex.select("object_id", "pos", *[f6(F.col("row")[i]).alias(f"h{i}") for i in range(8)])


@register("hist_matrix", _calc_sql(P))
def q_hist_matrix(spark, sf):
    v = V.vectors_calculated(obs(spark, sf), meta(spark, sf), TIE[P])
    h = F.col("hist")[0]
    m = v.select("object_id", "chunk", "target", "band", "meta",
                 FA.hist_matrix([h[c].cast("array<double>") for c in _CALC_OUT]).alias("mx"))
    return _calc_explode(m, {c: F.transform("mx", _nth(i)) for i, c in enumerate(_CALC_OUT)})


def _nth(i):
    return lambda r: r[i]
