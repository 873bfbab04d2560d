"""Queries for augmentation and splits (G), ML and evaluation (M), vector
functions (F6-F12), ordering (O) and sources / sinks (S)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.sql import Window
from pyspark.sql import functions as F

from lcspark.functions import arrays as FA
from lcspark.functions.expr import clip, map_target
from lcspark.operators import aggregate as A
from lcspark.operators import augment as G
from lcspark.operators import ml as M
from lcspark.operators import join as J
from lcspark.operators import skew
from lcspark.operators import vectors as V
from lcspark.operators import window as W
from lcspark.operators.order import append_replicas, order_observations, preview
from lcspark.plans import bindings as B
from lcspark.plans.q_basic import TIE, P, keys, keys_sql, meta, obs, order_sql, _MODS_SQL
from lcspark.plans.q_vectors import _v7_rows_cte
from lcspark.plans.registry import ORACLES, explode_arrays, f6, i64, r6, register
from lcspark.plans.sql import (f6 as f6s, keyed_normal_sql, keyed_uniform_sql,
                               map_target_sql, r6 as r6s, wavelength_nm_sql, with_binding)
from lcspark.schema import CLASS_CODES, CLASS_WEIGHTS, OBSERVATION_SCHEMA, SEQUENCE_LEN
from lcspark.sources import io as S

_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_sql(P)}) AS rn FROM obs)"


def ranked(spark, sf, b=P):
    return W.rank_asc(obs(spark, sf, b), TIE[b], "rownum")


# ------------------------------------------------------------------ G1 ---

@register("replicate", with_binding(P, """
    SELECT object_id, CAST(r AS BIGINT) AS replica FROM meta, range(1, 4) t(r)""", meta=True))
def q_replicate(spark, sf):
    return G.replicate(meta(spark, sf).select("object_id"), 3).select("object_id", i64("replica").alias("replica"))


# ------------------------------------------------------------- G2 - G5 ---

def _uni_sql(x, e, u):
    return f"{u} * (({x} + {e}) - (({x} - {e}) / 1.5)) + (({x} - {e}) / 1.5)"


@register("jitter_flux_uniform", with_binding(P, f"""
    SELECT object_id, CAST(rn AS BIGINT) AS rownum,
           {r6s(_uni_sql('flux', 'flux_err', keyed_uniform_sql(11, 'flux', 'object_id', 'rn')))} AS flux
    FROM ranked""", extra=_RANKED))
def q_jitter_flux_uniform(spark, sf):
    j = G.jitter_flux(ranked(spark, sf), 11, [F.col("object_id"), F.col("rownum")], "uniform")
    return j.select("object_id", i64("rownum").alias("rownum"), r6("flux").alias("flux"))


@register("jitter_flux_normal", with_binding(P, f"""
    SELECT object_id, CAST(rn AS BIGINT) AS rownum,
           {r6s('flux + ' + keyed_normal_sql(11, 'flux', 'object_id', 'rn') + ' * (flux_err / 1.5)')} AS flux
    FROM ranked""", extra=_RANKED))
def q_jitter_flux_normal(spark, sf):
    j = G.jitter_flux(ranked(spark, sf), 11, [F.col("object_id"), F.col("rownum")], "normal")
    return j.select("object_id", i64("rownum").alias("rownum"), r6("flux").alias("flux"))


def _dilate_sql(keys_, dist):
    z, e = "m.hostgal_photoz", "m.hostgal_photoz_err"
    if dist == "uniform":
        zn = _uni_sql(z, e, keyed_uniform_sql(13, "dt", *keys_))
    else:
        zn = f"LEAST(GREATEST({z} + {keyed_normal_sql(13, 'z', *keys_)} * ({e} / 1.5), 0.0), 5.0)"
    return with_binding(P, f"""
        SELECT object_id, rownum, {r6s('mjd * ((1.0 + z) / (1.0 + new_z))')} AS mjd, {r6s('new_z')} AS new_z
        FROM (SELECT o.object_id, CAST(o.rn AS BIGINT) AS rownum, o.mjd, {z} AS z, {zn} AS new_z
              FROM ranked o JOIN meta m ON o.object_id = m.object_id) t""", meta=True, extra=_RANKED)


def _dilate_query(name, scope, dist):
    keys_sql_ = ["o.object_id", "o.rn"] if scope == "obs" else ["o.object_id"]

    @register(name, _dilate_sql(keys_sql_, dist))
    def q(spark, sf):
        o = J.join_metadata(ranked(spark, sf), meta(spark, sf))
        k = [F.col("object_id"), F.col("rownum")] if scope == "obs" else [F.col("object_id")]
        d = G.dilate_time(o, 13, k, dist)
        return d.select("object_id", i64("rownum").alias("rownum"), r6("mjd").alias("mjd"),
                        r6("new_z").alias("new_z"))
    return q


_dilate_query("dilate_time_obs", "obs", "uniform")
_dilate_query("dilate_time_object", "object", "uniform")
_dilate_query("dilate_time_normal", "object", "normal")


@register("jitter_metadata", with_binding(P, f"""
    SELECT object_id, {r6s(_uni_sql('hostgal_photoz', 'hostgal_photoz_err', keyed_uniform_sql(5, 'photoz', 'object_id', '1')))} AS hostgal_photoz
    FROM meta""", meta=True))
def q_jitter_metadata(spark, sf):
    m = G.jitter_metadata(meta(spark, sf), 5, 1)
    return m.select("object_id", r6("hostgal_photoz").alias("hostgal_photoz"))


@register("drop_observations", with_binding(P, f"""
    SELECT object_id, CAST(rn AS BIGINT) AS rownum,
           {r6s('COALESCE(mjd - lag(mjd) OVER w, 0.0)')} AS delta_mjd,
           {r6s('COALESCE(lead(mjd) OVER w - mjd, 0.0)')} AS lead_mjd
    FROM (SELECT * FROM ranked WHERE {keyed_uniform_sql(17, 'drop', 'object_id', 'rn')} >= 0.3) k
    WINDOW w AS (PARTITION BY object_id ORDER BY rn)""", extra=_RANKED))
def q_drop_observations(spark, sf):
    o = obs(spark, sf)
    k = G.drop_observations(W.rank_asc(o, TIE[P], "rownum"), 17, [F.col("object_id"), F.col("rownum")])
    none_hot = False if not skew.hot_object_counts(o) else None      # then none is hot among the rows kept
    k = W.lead_time(W.delta_time(k, TIE[P], hot_threshold=none_hot), TIE[P], hot_threshold=none_hot)
    return k.select("object_id", i64("rownum").alias("rownum"), r6("delta_mjd").alias("delta_mjd"),
                    r6("lead_mjd").alias("lead_mjd"))


# ------------------------------------------------------------------ G6 ---

def _ff(c):
    return f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"


_G6_SEED, _G6_N = 3, 2


def _g6_rows_sql(counts):
    """Rows of the copies; ``counts`` (object_id, n) says how many of each object."""
    return f"""
    SELECT object_id, CAST(r AS BIGINT) AS replica, CAST(kpos AS BIGINT) AS pos, CAST(band AS BIGINT) AS band,
           {f6s('t * dt')} AS h0,
           {f6s('hf1 + ' + keyed_normal_sql(_G6_SEED, 'flux', 'object_id', 'i', 'r') + ' * (hf2 / 1.5)')} AS h1,
           {f6s('hf2')} AS h2, {f6s('hf3')} AS h3, {f6s('fwd * dt')} AS h4, {f6s('bwd * dt')} AS h5,
           {f6s('hf6 * dt')} AS h6, {f6s('hf7')} AS h7, {f6s('zn')} AS m5
    FROM (
        SELECT *, COALESCE(t - lag(t) OVER w, 0.0) AS fwd, COALESCE(lead(t) OVER w - t, 0.0) AS bwd,
               row_number() OVER w - 1 AS kpos, (1.0 + zf) / (1.0 + zn) AS dt
        FROM (
            SELECT *, LEAST(GREATEST(zf + {keyed_normal_sql(_G6_SEED, 'z', 'object_id', 'r')} * (zef / 1.5), 0.0), 5.0) AS zn
            FROM (
                SELECT s.object_id, s.rn - 1 AS i, s.rn, s.band, rr.r,
                       {_ff('s.h0')} AS t, {_ff('s.h1')} AS hf1, {_ff('s.h2')} AS hf2, {_ff('s.h3')} AS hf3,
                       {_ff('s.h6')} AS hf6, {_ff('s.h7')} AS hf7, {_ff('s.z')} AS zf, {_ff('s.zerr')} AS zef
                FROM samples s JOIN (SELECT object_id, UNNEST(range(1, n + 1)) AS r FROM {counts} nn) rr
                  ON s.object_id = rr.object_id) x
            WHERE {keyed_uniform_sql(_G6_SEED, 'drop', 'object_id', 'i', 'r')} >= 0.3) y
        WINDOW w AS (PARTITION BY object_id, r ORDER BY rn)) z"""


@register("augment", with_binding(P, _g6_rows_sql(f"(SELECT object_id, {_G6_N} AS n FROM meta)"), meta=True,
                                  extra=_v7_rows_cte(P)))
def q_augment(spark, sf):
    o = obs(spark, sf)
    return _copy_rows(G.augment(V.samples_baseline(o, meta(spark, sf), TIE[P]), _G6_N, _G6_SEED, obs=o))


# ------------------------------------------------------------------ G7 ---

_G7_SEED, _G7_N = 9, 2


def _g7_sql():
    z, e = "z", "ze"
    zm = f"CASE WHEN k = 0 THEN {z} ELSE {_uni_sql(z, e, keyed_uniform_sql(_G7_SEED, 'photoz', 'object_id', 'k'))} END"
    flux = f"CASE WHEN k = 0 THEN flux ELSE {_uni_sql('flux', 'flux_err', keyed_uniform_sql(_G7_SEED, 'flux', 'object_id', 'rn', 'k'))} END"
    zn = _uni_sql(z, e, keyed_uniform_sql(_G7_SEED, 'dt', 'object_id', 'rn', 'k'))
    mjd = f"CASE WHEN k = 0 THEN mjd ELSE mjd * ((1.0 + {z}) / (1.0 + {zn})) END"
    nm = wavelength_nm_sql("passband")
    return with_binding(P, f"""
        SELECT CAST(k AS BIGINT) AS replica, object_id, CAST({map_target_sql('target')} AS BIGINT) AS target,
               {r6s('ddf')} AS m4, {r6s('specz')} AS m5, {r6s('zm')} AS m6, {r6s('mwebv')} AS m7,
               {r6s('CASE WHEN zm > 0 THEN 1.0 ELSE 0.0 END')} AS m8, {r6s('meta_val')} AS m9,
               CAST(p - 1 AS BIGINT) AS pos, CAST(passband AS BIGINT) AS band,
               CAST(0.0 AS DOUBLE) AS mjd, {f6s('fluxj / hm')} AS flux, {f6s('flux_err / hm')} AS flux_err,
               CAST(0 AS BIGINT) AS detected,
               {f6s('(mjdj - first_value(mjdj) OVER w) / (zm + 1.0)')} AS fwd_int,
               {f6s('(mjdj - first_value(mjdj) OVER w) / (zm + 1.0)')} AS bwd_int,
               {f6s(nm + ' / (zm + 1.0) / 1000.0')} AS source_wavelength, CAST(0.0 AS DOUBLE) AS received_wavelength
        FROM (
            SELECT *, row_number() OVER (PARTITION BY object_id, k ORDER BY mjdj, rn) AS p
            FROM (
                SELECT *, {zm} AS zm, {flux} AS fluxj, {mjd} AS mjdj
                FROM (SELECT r.*, m.hostgal_photoz AS z, m.hostgal_photoz_err AS ze, m.ddf, m.mwebv,
                             m.hostgal_specz AS specz, m.target, d.hist_modifier AS hm, d.meta_val, kk.k
                      FROM ranked r JOIN meta m ON r.object_id = m.object_id
                      JOIN mods d ON r.object_id = d.object_id, range(0, {_G7_N + 1}) kk(k)) a) b) c
        WINDOW w AS (PARTITION BY object_id, k ORDER BY p)""", meta=True, extra=f"{_MODS_SQL}, {_RANKED}")


_FLAT = V.FLAT_CHANNELS


@register("augmented_vectors", _g7_sql())
def q_augmented_vectors(spark, sf):
    v = G.augmented_vectors(obs(spark, sf), meta(spark, sf), TIE[P], _G7_N, _G7_SEED)
    v = v.select("replica", "object_id", "chunk", "target", "band", *_FLAT,
                 *[F.col("meta")[i].alias(f"m{i}") for i in range(4, 10)])
    ex = explode_arrays(v, ["replica", "object_id", "target"] + [f"m{i}" for i in range(4, 10)],
                        {"band": F.col("band"), **{c: F.col(c) for c in _FLAT}})
    return ex.select(i64("replica").alias("replica"), "object_id", i64("target").alias("target"),
                     *[r6(f"m{i}").alias(f"m{i}") for i in range(4, 10)], "pos", i64("band").alias("band"),
                     *[(i64(c) if c == "detected" else f6(c)).alias(c) for c in _FLAT])


# -------------------------------------------------------------- G8 / A12 ---

def _shares_sql(src, label):
    return f"""
        cnt AS (SELECT {label} AS ci, count(*) AS n FROM {src} GROUP BY 1),
        tot AS (SELECT count(*) AS total FROM {src}),
        shares AS (SELECT CAST(c.i AS INTEGER) AS class_index, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n,
                          CASE WHEN cnt.n IS NULL THEN 1.0 ELSE CAST(cnt.n AS DOUBLE) / CAST(tot.total AS DOUBLE) END AS share
                   FROM range(0, 15) c(i) LEFT JOIN cnt ON cnt.ci = c.i CROSS JOIN tot)"""


@register("balance_classes", with_binding(P, f"""
    SELECT object_id, CAST(UNNEST(range(0, extra + 1)) AS BIGINT) AS replica
    FROM (SELECT t.object_id, e.extra FROM tgt t JOIN
          (SELECT class_index, CAST(floor(3.0 * max(share) OVER () / share) - 1 AS INTEGER) AS extra FROM shares) e
          ON t.ti = e.class_index) x""", meta=True,
    extra=f"""tgt AS (SELECT DISTINCT o.object_id, {map_target_sql('m.target')} AS ti
                      FROM obs o JOIN meta m ON o.object_id = m.object_id),
              {_shares_sql('tgt', 'ti')}"""))
def q_balance_classes(spark, sf):
    s = V.samples_baseline(obs(spark, sf), meta(spark, sf), TIE[P])
    b = G.balance_classes(s, 1, augmentate=False).filter(F.col("chunk") == 0)     # one row of each copy
    return b.select("object_id", i64("replica").alias("replica"))


# The G6 rows of copies 1..extra of each object's class, as the oracle of G6 with that count per object.
_BALANCED_SQL = f"""
    SELECT object_id, CAST(0 AS BIGINT) AS replica, CAST(rn - 1 AS BIGINT) AS pos, CAST(band AS BIGINT) AS band,
           {', '.join(f"{f6s(f'h{i}')} AS h{i}" for i in range(8))}, {f6s(_ff('z'))} AS m5 FROM samples
    UNION ALL """ + _g6_rows_sql("(SELECT t.object_id, e.extra AS n FROM tgt t JOIN (SELECT class_index, "
                                "CAST(floor(3.0 * max(share) OVER () / share) - 1 AS INTEGER) AS extra FROM shares) e ON t.ti = e.class_index)")


def _copy_rows(a):
    a = a.select("object_id", "chunk", "replica", "band", "hist", F.col("meta")[5].alias("m5"))
    ex = explode_arrays(a, ["object_id", "replica", "m5"], {"band": F.col("band"), "row": F.col("hist")})
    return ex.select("object_id", i64("replica").alias("replica"), "pos", i64("band").alias("band"),
                     *[f6(F.col("row")[i]).alias(f"h{i}") for i in range(8)], f6("m5").alias("m5"))


@register("balance_classes_augmented", with_binding(P, _BALANCED_SQL, meta=True,
    extra=f"""{_v7_rows_cte(P)}, tgt AS (SELECT DISTINCT o.object_id, {map_target_sql('m.target')} AS ti
                      FROM obs o JOIN meta m ON o.object_id = m.object_id), {_shares_sql('tgt', 'ti')}"""))
def q_balance_classes_augmented(spark, sf):
    o, m = obs(spark, sf), meta(spark, sf)
    s = V.samples_baseline(o, m, TIE[P], tasks=G.copying_tasks(spark))
    return _copy_rows(G.balance_classes(s, _G6_SEED, obs=o, objects=V.sample_targets(o, m), dealt=True))


@register("augment_by_galactic", with_binding(P, _g6_rows_sql(
    "(SELECT object_id, CASE WHEN hostgal_photoz > 0 THEN 1 ELSE 3 END AS n FROM meta)"), meta=True, extra=_v7_rows_cte(P)))
def q_augment_by_galactic(spark, sf):
    """Copy counts by the galactic flag: three of a galactic object, one of an extragalactic one."""
    o = obs(spark, sf)
    s = V.samples_baseline(o, meta(spark, sf), TIE[P])
    n = F.when(F.col("meta")[8] > 0, 1).otherwise(3)
    return _copy_rows(G.augment(s.withColumn("copies", n), F.col("copies"), _G6_SEED, obs=o, most=3))


@register("class_shares", with_binding(P, f"""
    SELECT CAST(class_index AS BIGINT) AS class_index, n, {r6s('share')} AS share FROM shares""", meta=True,
    extra=f"""tgt AS (SELECT DISTINCT o.object_id, {map_target_sql('m.target')} AS ti
                      FROM obs o JOIN meta m ON o.object_id = m.object_id),
              {_shares_sql('tgt', 'ti')}"""))
def q_class_shares(spark, sf):
    classes = J.join_metadata(A.distinct_objects(obs(spark, sf), {}), meta(spark, sf).select("object_id", "target"))
    s = A.class_shares(classes.withColumn("target", map_target("target")), "target")
    return s.select(i64("class_index").alias("class_index"), "n", r6("share").alias("share"))


# ------------------------------------------------------------------ G9 ---

def _split_sql(weights, seed, names):
    total = float(sum(weights))
    acc, bounds = 0.0, []
    for w in weights[:-1]:
        acc += w / total
        bounds.append(acc)
    u = keyed_uniform_sql(seed, "split", "object_id")
    cases = " ".join(f"WHEN {u} < CAST('{b!r}' AS DOUBLE) THEN '{n}'" for b, n in zip(bounds, names))
    return f"CASE {cases} ELSE '{names[-1]}' END"


SPLITS = {"split_811": [0.8, 0.1, 0.1], "split_721": [0.7, 0.2, 0.1],
          "split_631": [0.6, 0.3, 0.1], "split_91": [0.9, 0.1]}


def _split_query(name, weights):
    names = G.SPLIT_NAMES[len(weights)]

    @register(name, with_binding(P, f"SELECT object_id, {_split_sql(weights, 42, names)} AS split FROM meta",
                                 meta=True))
    def q(spark, sf):
        return G.split(meta(spark, sf).select("object_id"), weights, 42)
    return q


for _n, _w in SPLITS.items():
    _split_query(_n, _w)


@register("split_counts", with_binding(P, f"""
    SELECT split, CAST(count(*) AS BIGINT) AS n FROM
    (SELECT object_id, {_split_sql([0.8, 0.1, 0.1], 42, G.SPLIT_NAMES[3])} AS split FROM meta) t GROUP BY split""",
    meta=True))
def q_split_counts(spark, sf):
    s = G.split(meta(spark, sf).select("object_id"), [0.8, 0.1, 0.1], 42)
    return A.split_counts(s).select("split", i64("n").alias("n"))


# ------------------------------------------------------------ preds / M ---

def _preds_sql():
    raws = [f"({keyed_uniform_sql(0, 'pred', 'object_id', str(c))} + 0.001)" for c in range(15)]
    total = " + ".join(raws)
    probs = ", ".join(f"{r} / ({total})" for r in raws)
    return f"""preds AS (SELECT object_id, {map_target_sql('target')} AS label, [{probs}] AS probs FROM meta)"""


def _preds_with(body, extra=""):
    ex = _preds_sql() + (", " + extra if extra else "")
    return with_binding(P, body, meta=True, extra=ex)


@register("clip", _preds_with(f"""
    SELECT object_id, CAST(pos - 1 AS BIGINT) AS pos, {r6s('LEAST(GREATEST(p, 1e-15), 1.0 - 1e-15)')} AS p
    FROM (SELECT object_id, UNNEST(probs) AS p, generate_subscripts(probs, 1) AS pos FROM preds) t"""))
def q_clip(spark, sf):
    p = B.preds_synth(spark, sf)
    c = p.select("object_id", F.transform("probs", lambda x: clip(x, 1e-15, 1.0 - 1e-15)).alias("p"))
    ex = explode_arrays(c, ["object_id"], {"p": F.col("p")})
    return ex.select("object_id", "pos", r6("p").alias("p"))


@register("argmax", _preds_with("""
    SELECT object_id, CAST(list_position(probs, list_max(probs)) - 1 AS BIGINT) AS prediction FROM preds"""))
def q_argmax(spark, sf):
    p = B.preds_synth(spark, sf)
    return p.select("object_id", i64(FA.argmax("probs")).alias("prediction"))


@register("precision", _preds_with(f"""
    SELECT {r6s('avg(CASE WHEN label = list_position(probs, list_max(probs)) - 1 THEN 1.0 ELSE 0.0 END)')} AS precision
    FROM preds"""))
def q_precision(spark, sf):
    p = M.with_argmax(B.preds_synth(spark, sf))
    return M.precision(p).select(r6("precision").alias("precision"))


_W_SQL = "cw AS (SELECT i - 1 AS class_index, w FROM (SELECT UNNEST([" + ", ".join(
    f"{float(CLASS_WEIGHTS[c])}" for c in CLASS_CODES) + "]) AS w, generate_subscripts([" + ", ".join(
    f"{float(CLASS_WEIGHTS[c])}" for c in CLASS_CODES) + "], 1) AS i) t)"

_PER_CLASS = """per AS (SELECT label AS ci, sum(ln(LEAST(GREATEST(probs[label + 1], 1e-15), 1.0 - 1e-15))) AS log_sum,
                        count(*) AS n FROM preds GROUP BY label)"""


@register("weighted_log_loss", _preds_with(f"""
    SELECT {r6s('-sum(COALESCE(per.log_sum, 0.0) * cw.w / shares.share) / sum(cw.w) / sum(COALESCE(per.n, 0))')} AS weighted_log_loss
    FROM shares JOIN cw ON cw.class_index = shares.class_index LEFT JOIN per ON per.ci = shares.class_index""",
    extra=f"{_shares_sql('preds', 'label')}, {_W_SQL}, {_PER_CLASS}"))
def q_weighted_log_loss(spark, sf):
    p = B.preds_synth(spark, sf)
    return M.weighted_log_loss(p).select(r6("weighted_log_loss").alias("weighted_log_loss"))


@register("training_loss", _preds_with(f"""
    SELECT {r6s('-sum(COALESCE(per.log_sum, 0.0) / shares.share) / sum(COALESCE(per.n, 0)) / 15.0')} AS training_loss
    FROM shares LEFT JOIN per ON per.ci = shares.class_index""",
    extra=f"{_shares_sql('preds', 'label')}, {_PER_CLASS}"))
def q_training_loss(spark, sf):
    p = B.preds_synth(spark, sf)
    return M.training_loss(p).select(r6("training_loss").alias("training_loss"))


def _meta_slots(spark, sf):
    from lcspark.operators.project import meta_vector
    return J.enrich_metadata(meta(spark, sf), A.flux_modifiers(obs(spark, sf))).select("object_id", meta_vector("sql").alias("meta"))


@register("standard_scale", with_binding(P, f"""
    SELECT object_id, CAST(pos AS BIGINT) AS pos,
           {r6s('CASE WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (v - mu) / sd END')} AS value
    FROM (SELECT object_id, pos, v, avg(v) OVER (PARTITION BY pos) AS mu, stddev_samp(v) OVER (PARTITION BY pos) AS sd
          FROM (SELECT m.object_id, UNNEST([0.0, 0.0, 0.0, 0.0, CAST(m.ddf AS DOUBLE), m.hostgal_specz, m.hostgal_photoz,
                                            m.mwebv, CASE WHEN m.hostgal_photoz > 0 THEN 1.0 ELSE 0.0 END, d.meta_val]) AS v,
                       generate_subscripts([0, 0, 0, 0, 0, 0, 0, 0, 0, 0], 1) - 1 AS pos
                FROM meta m JOIN mods d ON m.object_id = d.object_id
                WHERE m.object_id IN (SELECT object_id FROM obs)) a) b""", meta=True, extra=_MODS_SQL))
def q_standard_scale(spark, sf):
    v = _meta_slots(spark, sf).withColumn("mv", FA.to_vector("meta"))
    scaled, _ = M.standard_scale(v, "mv", "scaled")
    a = scaled.select("object_id", FA.vector_array("scaled").alias("s"))
    ex = explode_arrays(a, ["object_id"], {"value": F.col("s")})
    return ex.select("object_id", "pos", r6("value").alias("value"))


@register("index_labels", with_binding(P, """
    SELECT m.object_id, CAST(ix.idx AS BIGINT) AS label_index FROM meta m JOIN
      (SELECT label, row_number() OVER (ORDER BY n DESC, label ASC) - 1 AS idx
       FROM (SELECT CAST(target AS VARCHAR) AS label, count(*) AS n FROM meta GROUP BY 1) c) ix
      ON CAST(m.target AS VARCHAR) = ix.label""", meta=True))
def q_index_labels(spark, sf):
    i = M.index_labels(meta(spark, sf).select("object_id", "target"))
    return i.select("object_id", i64("label_index").alias("label_index"))


@register("encode_labels", with_binding(P, f"""
    SELECT m.object_id, CAST(p.pos AS BIGINT) AS pos,
           CASE WHEN {map_target_sql('m.target')} = p.pos THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS value
    FROM meta m, (SELECT UNNEST(range(0, (SELECT max({map_target_sql('target')}) FROM meta))) AS pos) p""",
    meta=True))
def q_encode_labels(spark, sf):
    m = meta(spark, sf).select("object_id", map_target("target").alias("t"))
    e = M.encode_labels(m, "t", "vec").select("object_id", FA.vector_array("vec").alias("v"))
    ex = explode_arrays(e, ["object_id"], {"value": F.col("v")})
    return ex.select("object_id", "pos", r6("value").alias("value"))


_SCORED_SQL = """
    SELECT object_id, CAST(label AS BIGINT) AS label, true AS better_than_constant, true AS as_stored
    FROM (SELECT m.object_id, {label} AS label, {split} AS split FROM meta m
          WHERE m.object_id IN (SELECT object_id FROM obs)) t WHERE split = '{part}'"""


def _scored_sql(part):
    """Ids and labels of a split; the two flags say that the model is worth
    its name and that the stored model gives the same predictions."""
    return with_binding(P, _SCORED_SQL.format(label=map_target_sql("m.target"), part=part,
                                              split=_split_sql([0.8, 0.1, 0.1], 42, G.SPLIT_NAMES[3]).replace("object_id", "m.object_id")),
                        meta=True)


def _training_frame(spark, sf):
    """The whole feature vector of the reference (10 metadata slots, band and
    eight channels of 256), stored once for the iterative fit; label = class
    index; weight = w_c / share_c; split by object."""
    from lcspark.plans.programs import feature_frame
    flat = V.vectors_flat(obs(spark, sf), meta(spark, sf), TIE[P], last=SEQUENCE_LEN, tasks=M.even_tasks(spark))
    path = S.scratch_dir(spark, "features")
    S.write_table(G.split(M.compressed(feature_frame(flat), "features", 10 + 9 * SEQUENCE_LEN), [0.8, 0.1, 0.1], 42), path)
    df = S.read_table(spark, path)
    # counted on the stored rows; 15 rows, so a pass over the frame doesn't count again
    shares = A.class_shares(df, "label")
    return M.class_weight_column(df, spark.createDataFrame(shares.collect(), shares.schema), "label", "weight")


def _scored(spark, model, kind, train, rows):
    """``rows`` scored by the model as it is read back from where it was
    stored.  ``better_than_constant``: its weighted log loss on the training
    rows is below that of the best constant prediction; ``as_stored``: the
    model in memory predicts the same."""
    path = S.scratch_dir(spark, "model")
    M.save_model(model, spark, path)
    stored = M.load_model(spark, path, kind)
    losses = M.model_and_constant_loss(M.score(stored, train)).first()
    back = M.score(stored, rows).select("object_id", "label", F.col("prediction").alias("stored"))
    own = M.score(model, rows).select("object_id", "prediction")
    return back.join(own, "object_id").select(
        "object_id", i64("label").alias("label"), F.lit(bool(losses["model_loss"] < losses["constant_loss"])).alias("better_than_constant"),
        F.col("prediction").eqNullSafe(F.col("stored")).alias("as_stored"))


@register("fit_classifier", _scored_sql("train"))
def q_fit_classifier(spark, sf):
    train = _training_frame(spark, sf).filter(F.col("split") == "train")
    return _scored(spark, M.fit_classifier(train), "classifier", train, train)


@register("fit_network", _scored_sql("train"))
def q_fit_network(spark, sf):
    train = _training_frame(spark, sf).filter(F.col("split") == "train")
    model = M.fit_network(train, n_features=10 + 9 * SEQUENCE_LEN, weight="weight", max_iter=20)
    return _scored(spark, model, "network", train, train)


@register("score", _scored_sql("validation"))
def q_score(spark, sf):
    df = _training_frame(spark, sf)
    train = df.filter(F.col("split") == "train")
    return _scored(spark, M.fit_classifier(train), "classifier", train, df.filter(F.col("split") == "validation"))


# ------------------------------------------------------------- F6 - F10 ---

@register("to_vector", ORACLES["hist_channel"])
def q_to_vector(spark, sf):
    v = V.vectors_flat(obs(spark, sf), meta(spark, sf), TIE[P])
    a = v.select("object_id", "chunk", FA.vector_array(FA.to_vector("flux")).alias("flux"))
    ex = explode_arrays(a, ["object_id"], {"flux": F.col("flux")})
    return ex.select("object_id", "pos", f6("flux").alias("flux"))


@register("to_dense", ORACLES["meta_vector_sql"])
def q_to_dense(spark, sf):
    m = J.enrich_metadata(meta(spark, sf), A.flux_modifiers(obs(spark, sf)))
    from lcspark.operators.project import meta_vector
    m = m.select("object_id", meta_vector("sql").alias("mv"))
    m = m.select("object_id", *[F.col("mv")[i].alias(f"s{i}") for i in range(10)])
    asm = VectorAssembler(inputCols=[f"s{i}" for i in range(10)], outputCol="vec", handleInvalid="keep")
    d = asm.transform(m).select("object_id", FA.vector_array(FA.to_dense("vec")).alias("v"))
    ex = explode_arrays(d, ["object_id"], {"value": F.col("v")})
    return ex.select("object_id", "pos", r6("value").alias("value"))


_L8 = SEQUENCE_LEN


def _assembled_rows_sql(final, more):
    """Padded flat-table rows for the assembled feature vector, as further tables make of them."""
    nm = wavelength_nm_sql("c.passband")
    return with_binding(P, final, meta=True, extra=f"""{_MODS_SQL},
        calc AS (
            SELECT o.object_id, o.rn, o.n, o.passband,
                   {_ff('o.flux / d.hist_modifier')} AS flux, {_ff('o.flux_err / d.hist_modifier')} AS flux_err,
                   {_ff('(o.mjd - first_value(o.mjd) OVER (PARTITION BY o.object_id ORDER BY o.rn)) / (m.hostgal_photoz + 1.0)')} AS since,
                   {_ff(wavelength_nm_sql('o.passband') + ' / (m.hostgal_photoz + 1.0) / 1000.0')} AS src
            FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_sql(P)}) AS rn,
                         count(*) OVER (PARTITION BY object_id) AS n FROM obs) o
            JOIN meta m ON o.object_id = m.object_id JOIN mods d ON o.object_id = d.object_id),
        padded AS (
            SELECT g.object_id, g.j, CAST(COALESCE(c.passband, 0) AS DOUBLE) AS band,
                   COALESCE(c.flux, 0.0) AS flux, COALESCE(c.flux_err, 0.0) AS flux_err,
                   COALESCE(c.since, 0.0) AS since, COALESCE(c.src, 0.0) AS src
            FROM (SELECT o.object_id, o.n, j.j FROM (SELECT DISTINCT object_id, n FROM calc) o, range(0, {_L8}) j(j)) g
            LEFT JOIN calc c ON c.object_id = g.object_id AND c.rn = g.j + g.n - {_L8} + 1),
        hrows AS (
            SELECT object_id, j, band, 0.0 AS h0, flux AS h1, flux_err AS h2, 0.0 AS h3,
                   CASE WHEN j = 0 THEN 0.0 ELSE since - lag(since) OVER w END AS h4,
                   CASE WHEN j = {_L8 - 1} THEN 0.0 ELSE lead(since) OVER w - since END AS h5,
                   src AS h6, 0.0 AS h7
            FROM padded WINDOW w AS (PARTITION BY object_id ORDER BY j)), {more}""")


def _assembled(spark, sf):
    from lcspark.plans.programs import feature_frame
    return feature_frame(V.vectors_flat(obs(spark, sf), meta(spark, sf), TIE[P], last=_L8), _L8).select("object_id", "features")


_META_ROWS = f"""
    SELECT m.object_id, CAST(pos - 1 AS BIGINT) AS pos, v AS value
    FROM (SELECT m.object_id, UNNEST([0.0, 0.0, 0.0, 0.0, CAST(m.ddf AS DOUBLE), m.hostgal_specz, m.hostgal_photoz,
                                      m.mwebv, CASE WHEN m.hostgal_photoz > 0 THEN 1.0 ELSE 0.0 END, d.meta_val]) AS v,
                 generate_subscripts([0, 0, 0, 0, 0, 0, 0, 0, 0, 0], 1) AS pos
          FROM meta m JOIN mods d ON m.object_id = d.object_id
          WHERE m.object_id IN (SELECT object_id FROM obs)) m"""


def _slots_sql():
    """Every slot of the whole vector: metadata, band and the eight channels."""
    return (f"SELECT object_id, 'meta' AS grp, pos, value, pos AS slot FROM ({_META_ROWS}) mr"
            f" UNION ALL SELECT object_id, 'band', CAST(j AS BIGINT), band, CAST(10 + j AS BIGINT) FROM hrows"
            + "".join(f" UNION ALL SELECT object_id, 'hist', CAST({_L8 * c} + j AS BIGINT), h{c}, CAST({10 + _L8 * (c + 1)} + j AS BIGINT) FROM hrows"
                      for c in range(8)))


_SLOTS_SQL = f"slots AS ({_slots_sql()})"


@register("assemble_features", _assembled_rows_sql(f"SELECT object_id, slot AS pos, {r6s('value')} AS value FROM slots", _SLOTS_SQL))
def q_assemble_features(spark, sf):
    a = _assembled(spark, sf).select("object_id", FA.vector_array("features").alias("v"))
    return a.select("object_id", F.posexplode("v").alias("pos", "value")).select("object_id", i64("pos").alias("pos"), r6("value").alias("value"))


_GROUPS = {"meta": (0, 10), "band": (10, _L8), "hist": (10 + _L8, 8 * _L8)}


@register("standard_scale_groups", _assembled_rows_sql(f"""
    SELECT object_id, grp, pos, {r6s('CASE WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (value - mu) / sd END')} AS value
    FROM (SELECT object_id, grp, pos, value, avg(value) OVER (PARTITION BY grp, pos) AS mu,
                 stddev_samp(value) OVER (PARTITION BY grp, pos) AS sd FROM slots) b""", _SLOTS_SQL))
def q_standard_scale_groups(spark, sf):
    """The reference's three groups, each scaled by itself, then assembled again."""
    v = _assembled(spark, sf).select("object_id", FA.vector_array("features").alias("v"))
    parts = {g: FA.to_vector(F.slice("v", first + 1, n)).alias(g) for g, (first, n) in _GROUPS.items()}
    scaled = M.standard_scale_groups(v.select("object_id", *parts.values()), {g: f"{g}_s" for g in _GROUPS})
    for g, (_, n) in _GROUPS.items():                # known sizes: the assembler computes no row to learn them
        scaled = VectorSizeHint(inputCol=f"{g}_s", size=n, handleInvalid="optimistic").transform(scaled)
    whole = VectorAssembler(inputCols=[f"{g}_s" for g in _GROUPS], outputCol="scaled").transform(scaled)
    a = whole.select("object_id", FA.vector_array("scaled").alias("v"))
    ex = a.select("object_id", F.posexplode("v").alias("pos", "value"))
    group, first = F.lit("hist"), F.lit(10 + _L8)
    for g in ("band", "meta"):
        inside = F.col("pos") < _GROUPS[g][0] + _GROUPS[g][1]
        group, first = F.when(inside, g).otherwise(group), F.when(inside, _GROUPS[g][0]).otherwise(first)
    return ex.select("object_id", group.alias("grp"), i64(F.col("pos") - first).alias("pos"), r6("value").alias("value"))


@register("slice_features", _assembled_rows_sql(f"""
    SELECT h.object_id, CAST(h.j AS BIGINT) AS pos, {r6s('m.value')} AS meta, {r6s('h.band')} AS band,
           {', '.join(f"{r6s(f'h.h{c}')} AS h{c}" for c in range(8))}
    FROM hrows h LEFT JOIN (SELECT object_id, pos, value FROM slots WHERE grp = 'meta') m
      ON m.object_id = h.object_id AND m.pos = h.j""", _SLOTS_SQL))
def q_slice_features(spark, sf):
    """Every slot of the three parts: a row per place of the sequence, the
    first ten with the metadata's."""
    a = _assembled(spark, sf).select("object_id", FA.vector_array("features").alias("v"))
    s = a.select("object_id", FA.slice_features("v", 10, _L8, 8).alias("parts"))
    rows = F.arrays_zip(F.col("parts.meta").alias("meta"), F.col("parts.band").alias("band"), F.col("parts.hist").alias("row"))
    ex = s.select("object_id", F.posexplode(rows).alias("pos", "x"))
    return ex.select("object_id", i64("pos").alias("pos"), r6("x.meta").alias("meta"), r6("x.band").alias("band"),
                     *[r6(F.col("x.row")[c]).alias(f"h{c}") for c in range(8)])


# ------------------------------------------------------------------- O ---

@register("order_observations", with_binding(P, f"""
    SELECT {keys_sql()}, mjd, row_number() OVER (PARTITION BY object_id ORDER BY {order_sql(P)}) AS position FROM obs"""))
def q_order_observations(spark, sf):
    """The place a row has in the output: its number as the ordered
    partitions deliver it, counted from the object's first."""
    placed = order_observations(obs(spark, sf), TIE[P]).withColumn("_at", F.monotonically_increasing_id())
    w = Window.partitionBy("object_id").orderBy("_at")
    return placed.select(*keys(), "mjd", i64(F.row_number().over(w)).alias("position"))


@register("preview", with_binding(P, f"""
    SELECT {keys_sql()}, mjd, flux FROM obs ORDER BY object_id, {order_sql(P)} LIMIT 20"""))
def q_preview(spark, sf):
    p = preview(obs(spark, sf), 20, ["object_id", "mjd"] + TIE[P])
    return p.select(*keys(), "mjd", "flux")


@register("append_replicas", with_binding(P, f"""
    SELECT object_id, CAST(rn AS BIGINT) AS rownum, CAST(0 AS BIGINT) AS replica, {r6s('flux')} AS flux FROM ranked
    UNION ALL
    SELECT object_id, CAST(rn AS BIGINT), CAST(1 AS BIGINT),
           {r6s(_uni_sql('flux', 'flux_err', keyed_uniform_sql(11, 'flux', 'object_id', 'rn')))} FROM ranked""",
    extra=_RANKED))
def q_append_replicas(spark, sf):
    r = ranked(spark, sf).select("object_id", "rownum", "flux", "flux_err")
    base = r.withColumn("replica", F.lit(0))
    rep = G.jitter_flux(r, 11, [F.col("object_id"), F.col("rownum")]).withColumn("replica", F.lit(1))
    u = append_replicas(base, rep)
    return u.select("object_id", i64("rownum").alias("rownum"), i64("replica").alias("replica"),
                    r6("flux").alias("flux"))


# ------------------------------------------------------------------- S ---

_OBS_ROWS = ["object_id", "mjd", "passband", "flux", "flux_err", "detected"]


def _obs_rows_sql(b, times=1):
    body = (f"SELECT object_id, {r6s('mjd')} AS mjd, CAST(passband AS BIGINT) AS passband, "
            f"{r6s('flux')} AS flux, {r6s('flux_err')} AS flux_err, CAST(detected AS BIGINT) AS detected FROM obs")
    return with_binding(b, " UNION ALL ".join([body] * times))


def _obs_rows(df):
    return df.select(i64("object_id").alias("object_id"), r6("mjd").alias("mjd"), i64("passband").alias("passband"),
                     r6("flux").alias("flux"), r6("flux_err").alias("flux_err"), i64("detected").alias("detected"))


@register("read_observations_csv", _obs_rows_sql("obs_event"))
def q_read_observations_csv(spark, sf):
    path = S.scratch_dir(spark, "csv")
    S.write_csv(obs(spark, sf, "obs_event").select(*_OBS_ROWS), path)
    return _obs_rows(S.read_observations_csv(spark, path))


_META_OUT = ["object_id", "ra", "decl", "gal_l", "gal_b", "ddf", "hostgal_specz", "hostgal_photoz",
             "hostgal_photoz_err", "distmod", "mwebv", "target"]


@register("read_metadata_csv", with_binding(P, "SELECT " + ", ".join(
    (f"CAST({c} AS BIGINT) AS {c}" if c in ("object_id", "ddf", "target") else f"{r6s(c)} AS {c}")
    for c in _META_OUT) + " FROM meta", meta=True))
def q_read_metadata_csv(spark, sf):
    path = S.scratch_dir(spark, "metacsv")
    S.write_csv(meta(spark, sf), path, null_text="nan")
    m = S.read_metadata_csv(spark, path)
    return m.select(*[(i64(c) if c in ("object_id", "ddf", "target") else r6(c)).alias(c) for c in _META_OUT])


@register("read_delimited", _obs_rows_sql(P))
def q_read_delimited(spark, sf):
    path = S.scratch_dir(spark, "hive")
    S.write_delimited(obs(spark, sf).select(*_OBS_ROWS), path)
    return _obs_rows(S.read_delimited(spark, path, OBSERVATION_SCHEMA))


@register("write_table", _obs_rows_sql(P, times=2))
def q_write_table(spark, sf):
    path = S.scratch_dir(spark, "table")
    o = obs(spark, sf).select(*_OBS_ROWS)
    S.write_table(o, path, mode="overwrite")
    S.write_table(o, path, mode="append")
    return _obs_rows(S.read_table(spark, path))


@register("append_run", _obs_rows_sql(P, times=2))
def q_append_run(spark, sf):
    """Two runs, the second written twice."""
    path = S.scratch_dir(spark, "runs-table")
    o = obs(spark, sf).select(*_OBS_ROWS)
    for run in ("first", "second", "second"):
        S.append_run(o, path, run)
    return _obs_rows(S.read_table(spark, path))


@register("read_with_rejects", with_binding(P, f"""
    SELECT object_id, {r6s('mjd')} AS mjd, {r6s('flux')} AS flux, false AS rejected FROM obs WHERE l_linenumber < 6
    UNION ALL SELECT object_id, NULL, NULL, true FROM obs WHERE l_linenumber >= 6"""))
def q_read_with_rejects(spark, sf):
    """A file whose lines from number 6 on are broken (text for a number, a
    field too few): rows read and rows set aside, by their object."""
    path, rejects = S.scratch_dir(spark, "broken"), S.scratch_dir(spark, "rejects")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _OBS_ROWS]
    whole = F.concat_ws(",", *fields)
    broken = F.when(F.col("l_linenumber") < 6, whole).when(F.col("l_linenumber") == 6, F.concat_ws(",", fields[0], F.lit("?"), *fields[2:]))
    obs(spark, sf).select(broken.otherwise(F.concat_ws(",", *fields[:3])).alias("value")).write.text(path)
    good = S.read_with_rejects(spark, path, OBSERVATION_SCHEMA, {"header": "false"}, rejects)
    aside = S.read_table(spark, rejects).select(i64(F.substring_index("record", ",", 1)).alias("object_id"))
    return (good.select("object_id", r6("mjd").alias("mjd"), r6("flux").alias("flux"), F.lit(False).alias("rejected"))
            .unionByName(aside.withColumn("rejected", F.lit(True)), allowMissingColumns=True))


@register("create_if_absent", _obs_rows_sql(P))
def q_create_if_absent(spark, sf):
    path = S.scratch_dir(spark, "ctas")
    o = obs(spark, sf).select(*_OBS_ROWS)
    S.create_if_absent(o, path)
    S.create_if_absent(o.limit(0), path)
    return _obs_rows(S.read_table(spark, path))


@register("compact_files", _obs_rows_sql(P))
def q_compact_files(spark, sf):
    src, dst = S.scratch_dir(spark, "small"), S.scratch_dir(spark, "compact")
    obs(spark, sf).select(*_OBS_ROWS).repartition(16).write.option("header", False).csv(src)
    back = spark.read.schema(OBSERVATION_SCHEMA).csv(S.compact_files(spark, src, dst, target_bytes=1 << 20, swap=True))
    return _obs_rows(back)


@register("log_run", with_binding(P, """
    SELECT 'lcspark' AS program, model, 'objects=' || n AS run_id, 32 AS columns_, true AS settings, true AS timed
    FROM (SELECT count(DISTINCT object_id) AS n FROM obs) c, (VALUES ('vectors_padded'), ('vectors_flat')) m(model)"""))
def q_log_run(spark, sf):
    """Two runs are logged with real stage times; what is stable in the log
    is compared: its shape, the settings that any session has, and that a
    timed stage took time."""
    path = S.scratch_dir(spark, "runs")
    timer = S.StageTimer()
    with timer.stage("total"), timer.stage("dataframe"):
        n_objects = obs(spark, sf).select("object_id").distinct().count()
    for model in ("vectors_padded", "vectors_flat"):
        S.log_run(spark, {"program": "lcspark", "model": model, "data_source": sf, "run_id": f"objects={n_objects}",
                          **timer.metrics}, path)
    log = S.read_table(spark, path)
    settings = [F.col(c).isNotNull() for c in ("app_id", "app_name", "spark_master", "driver_memory", "driver_cores",
                                               "deploy_mode", "executor_instances", "default_parallelism")]
    timed = (F.col("dataframe_elapsed") > 0) & (F.col("total_elapsed") >= F.col("dataframe_elapsed"))
    return log.select("program", "model", "run_id", F.lit(len(log.columns)).alias("columns_"),
                      reduce(lambda a, b: a & b, settings).alias("settings"), timed.alias("timed"))
