"""Queries for projections, joins, aggregates and windows (C, J, A1-A3, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lcspark.functions import expr as X
from lcspark.operators import aggregate as A
from lcspark.operators import join as J
from lcspark.operators import project as C
from lcspark.operators import window as W
from lcspark.plans import bindings as B
from lcspark.plans.registry import i64, r6, register
from lcspark.plans.sql import (TIE_SQL, f6 as f6s, map_target_sql, r6 as r6s,
                               wavelength_nm_sql, with_binding)
from lcspark.sources import io as S

KEYS = {
    "obs_part": ["object_id", "l_orderkey", "l_linenumber", "l_suppkey"],
    "obs_supp": ["object_id", "l_orderkey", "l_linenumber", "l_partkey"],
    "obs_event": ["object_id", "event_id"],
}


def keys(b="obs_part"):
    return [i64(c).alias(c) for c in KEYS[b]]


def keys_sql(b="obs_part", prefix=""):
    return ", ".join(f"CAST({prefix}{c} AS BIGINT) AS {c}" for c in KEYS[b])


def obs(spark, sf, b="obs_part"):
    return B.OBS[b](spark, sf)


def meta(spark, sf, b="obs_part"):
    return B.META[b](spark, sf)


TIE = B.TIE
P = "obs_part"
ORDER_P = f"mjd, {TIE_SQL[P]}"
ORDER_P_DESC = ", ".join(f"{c.strip()} DESC" for c in ORDER_P.split(","))


def order_sql(b):
    return f"mjd, {TIE_SQL[b]}"


def order_desc_sql(b):
    return ", ".join(f"{c.strip()} DESC" for c in order_sql(b).split(","))


# ---------------------------------------------------------------- S1 / C ---

@register("scan_projection", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def q_scan_projection(spark, sf):
    return S.read_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"])


@register("scan_filter", """
    SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 10""")
def q_scan_filter(spark, sf):
    """A scan with a predicate, which reaches the Parquet reader."""
    return q_scan_projection(spark, sf).filter(F.col("l_quantity") > 10)


@register("typed_features", with_binding("obs_event", f"""
    SELECT {keys_sql('obs_event')}, {f6s('mjd')} AS mjd, CAST(passband AS BIGINT) AS passband,
           {f6s('flux')} AS flux, {f6s('flux_err')} AS flux_err, CAST(detected AS BIGINT) AS detected
    FROM obs"""))
def q_typed_features(spark, sf):
    t = C.typed_features(obs(spark, sf, "obs_event"), keep=["event_id"])
    return t.select(*keys("obs_event"), r6("mjd").alias("mjd"), i64("passband").alias("passband"),
                    r6("flux").alias("flux"), r6("flux_err").alias("flux_err"),
                    i64("detected").alias("detected"))


@register("map_target", with_binding(P, f"""
    SELECT object_id, CAST(target AS BIGINT) AS target,
           CAST({map_target_sql('target')} AS BIGINT) AS mapped_target FROM meta""", meta=True))
def q_map_target(spark, sf):
    m = meta(spark, sf)
    return m.select("object_id", i64("target").alias("target"),
                    i64(X.map_target("target")).alias("mapped_target"))


@register("default_target", with_binding("obs_event", """
    SELECT object_id, CAST(0 AS BIGINT) AS target FROM meta""", meta=True))
def q_default_target(spark, sf):
    m = meta(spark, sf, "obs_event").drop("target")
    return C.default_target(m, 0).select("object_id", i64("target").alias("target"))


@register("received_wavelength", with_binding(P, f"""
    SELECT {keys_sql()}, CAST(passband AS BIGINT) AS passband,
           {r6s(wavelength_nm_sql('passband') + ' / 1000.0')} AS received_wavelength FROM obs"""))
def q_received_wavelength(spark, sf):
    o = obs(spark, sf)
    return o.select(*keys(), i64("passband").alias("passband"),
                    r6(X.received_wavelength()).alias("received_wavelength"))


@register("source_wavelength", with_binding(P, f"""
    SELECT {keys_sql(prefix='o.')}, CAST(o.passband AS BIGINT) AS passband,
           {r6s(wavelength_nm_sql('o.passband') + ' / (m.hostgal_photoz + 1.0) / 1000.0')} AS source_wavelength
    FROM obs o JOIN meta m ON o.object_id = m.object_id""", meta=True))
def q_source_wavelength(spark, sf):
    o = J.join_metadata(obs(spark, sf), meta(spark, sf).select("object_id", "hostgal_photoz"))
    return o.select(*keys(), i64("passband").alias("passband"),
                    r6(X.source_wavelength()).alias("source_wavelength"))


@register("received_frequency", with_binding(P, f"""
    SELECT {keys_sql()}, {r6s('300000.0 / ' + wavelength_nm_sql('passband'))} AS received_frequency
    FROM obs"""))
def q_received_frequency(spark, sf):
    return obs(spark, sf).select(*keys(), r6(X.received_frequency()).alias("received_frequency"))


@register("photoz_positive", with_binding(P, """
    SELECT object_id, CAST(CASE WHEN hostgal_photoz > 0 THEN 1 ELSE 0 END AS BIGINT) AS photoz_positive
    FROM meta""", meta=True))
def q_photoz_positive(spark, sf):
    return meta(spark, sf).select("object_id", i64(X.photoz_positive()).alias("photoz_positive"))


@register("pad_fill", with_binding(P, f"""
    SELECT object_id, {r6s('COALESCE(distmod, 0.0)')} AS distmod FROM meta""", meta=True))
def q_pad_fill(spark, sf):
    return C.pad_fill(meta(spark, sf), {"distmod": 0.0}).select("object_id", r6("distmod").alias("distmod"))


def _galactic_sql(cond):
    return with_binding(P, f"""
        SELECT {keys_sql(prefix='o.')}, o.mjd FROM obs o
        WHERE o.object_id IN (SELECT object_id FROM meta WHERE {cond})""", meta=True)


@register("galactic_filter_extragalactic", _galactic_sql("hostgal_photoz <> 0"))
def q_galactic_extra(spark, sf):
    return C.galactic_filter(obs(spark, sf), meta(spark, sf), True).select(*keys(), "mjd")


@register("galactic_filter_galactic", _galactic_sql("NOT (hostgal_photoz > 0)"))
def q_galactic_gal(spark, sf):
    return C.galactic_filter(obs(spark, sf), meta(spark, sf), False).select(*keys(), "mjd")


@register("use_specz", with_binding(P, f"""
    SELECT object_id, {r6s('hostgal_specz')} AS hostgal_photoz, CAST(0.0 AS DOUBLE) AS hostgal_photoz_err
    FROM meta""", meta=True))
def q_use_specz(spark, sf):
    m = C.use_specz(meta(spark, sf))
    return m.select("object_id", r6("hostgal_photoz").alias("hostgal_photoz"),
                    r6("hostgal_photoz_err").alias("hostgal_photoz_err"))


@register("limit_objects", with_binding(P, f"""
    SELECT {keys_sql()}, mjd FROM obs
    WHERE object_id IN (SELECT DISTINCT object_id FROM obs ORDER BY object_id LIMIT 1000)"""))
def q_limit_objects(spark, sf):
    return C.limit_objects(obs(spark, sf), 1000).select(*keys(), "mjd")


@register("object_lookup", with_binding(P, f"""
    SELECT {keys_sql()}, mjd, flux FROM obs WHERE object_id = 7"""))
def q_object_lookup(spark, sf):
    return C.object_lookup(obs(spark, sf), 7).select(*keys(), "mjd", "flux")


@register("object_lookup_stored", with_binding(P, f"""
    SELECT {keys_sql()}, mjd, flux FROM obs WHERE object_id = 7"""))
def q_object_lookup_stored(spark, sf):
    stored = C.store_for_lookup(obs(spark, sf), S.scratch_dir(spark, "lookup"))
    return C.object_lookup(stored, 7).select(*keys(), "mjd", "flux")


@register("band_index", with_binding(P, f"""
    SELECT {keys_sql()}, CAST(passband + 1 AS BIGINT) AS band FROM obs"""))
def q_band_index(spark, sf):
    return obs(spark, sf).select(*keys(), i64(X.band_index()).alias("band"))


@register("kv_observation", with_binding(P, f"""
    SELECT {keys_sql()}, CAST(mjd AS DOUBLE) AS kv_mjd, CAST(passband AS DOUBLE) AS kv_passband,
           CAST(flux AS DOUBLE) AS kv_flux, CAST(flux_err AS DOUBLE) AS kv_flux_err,
           CAST(detected AS DOUBLE) AS kv_detected FROM obs"""))
def q_kv_observation(spark, sf):
    kv = C.kv_observation(obs(spark, sf), keep=KEYS[P][1:])
    return kv.select(*keys(), *[C.kv_get("kv", k).alias(f"kv_{k}")
                                for k in ("mjd", "passband", "flux", "flux_err", "detected")])


_MODS_SQL = """mods AS (
    SELECT object_id, log2(nullif(max(flux) - min(flux), 0)) AS flux_pow,
           pow(2.0, log2(nullif(max(flux) - min(flux), 0))) AS hist_modifier,
           log2(nullif(max(flux) - min(flux), 0)) / 10.0 AS meta_val
    FROM obs GROUP BY object_id)"""

_META_LAYOUT_SQL = {
    "baseline": "[0.0, 0.0, 0.0, 0.0, CAST(m.ddf AS DOUBLE), m.hostgal_photoz, m.hostgal_photoz_err, "
                "m.mwebv, CASE WHEN m.hostgal_photoz > 0 THEN 1.0 ELSE 0.0 END, d.meta_val]",
    "sql": "[0.0, 0.0, 0.0, 0.0, CAST(m.ddf AS DOUBLE), m.hostgal_specz, m.hostgal_photoz, "
           "m.mwebv, CASE WHEN m.hostgal_photoz > 0 THEN 1.0 ELSE 0.0 END, d.meta_val]",
    "raw5": "[CAST(m.ddf AS DOUBLE), m.hostgal_specz, m.hostgal_photoz, m.hostgal_photoz_err, m.mwebv]",
    "raw6": "[CAST(m.ddf AS DOUBLE), m.hostgal_specz, m.hostgal_photoz, m.hostgal_photoz_err, "
            "m.mwebv, m.distmod]",
}


def _meta_vector_query(layout):
    sql = with_binding(P, f"""
        SELECT object_id, CAST(pos - 1 AS BIGINT) AS pos, {r6s('v')} AS value
        FROM (SELECT m.object_id, UNNEST({_META_LAYOUT_SQL[layout]}) AS v,
                     generate_subscripts({_META_LAYOUT_SQL[layout]}, 1) AS pos
              FROM meta m JOIN mods d ON m.object_id = d.object_id) t""", meta=True, extra=_MODS_SQL)

    @register(f"meta_vector_{layout}", sql)
    def q(spark, sf):
        m = J.enrich_metadata(meta(spark, sf), A.flux_modifiers(obs(spark, sf)))
        v = m.select("object_id", C.meta_vector(layout).alias("meta"))
        return v.select("object_id", F.posexplode("meta").alias("pos", "value")).select(
            "object_id", i64("pos").alias("pos"), r6("value").alias("value"))
    return q


for _layout in ("baseline", "sql", "raw5", "raw6"):
    _meta_vector_query(_layout)


# ------------------------------------------------------------------ J ---

@register("join_metadata", with_binding(P, f"""
    SELECT {keys_sql(prefix='o.')}, o.mjd, {r6s('m.hostgal_photoz')} AS hostgal_photoz,
           CAST(m.target AS BIGINT) AS target
    FROM obs o JOIN meta m ON o.object_id = m.object_id""", meta=True))
def q_join_metadata(spark, sf):
    o = J.join_metadata(obs(spark, sf), meta(spark, sf))
    return o.select(*keys(), "mjd", r6("hostgal_photoz").alias("hostgal_photoz"),
                    i64("target").alias("target"))


@register("join_modifiers", with_binding(P, f"""
    SELECT {keys_sql(prefix='o.')}, {r6s('d.hist_modifier')} AS hist_modifier
    FROM obs o JOIN mods d ON o.object_id = d.object_id""", extra=_MODS_SQL))
def q_join_modifiers(spark, sf):
    o = obs(spark, sf)
    j = J.join_modifiers(o, A.flux_modifiers(o))
    return j.select(*keys(), r6("hist_modifier").alias("hist_modifier"))


@register("enrich_metadata", with_binding(P, f"""
    SELECT m.object_id, {r6s('m.hostgal_photoz')} AS hostgal_photoz, {r6s('d.meta_val')} AS meta_val
    FROM meta m JOIN mods d ON m.object_id = d.object_id""", meta=True, extra=_MODS_SQL))
def q_enrich_metadata(spark, sf):
    m = J.enrich_metadata(meta(spark, sf), A.flux_modifiers(obs(spark, sf)))
    return m.select("object_id", r6("hostgal_photoz").alias("hostgal_photoz"),
                    r6("meta_val").alias("meta_val"))


@register("padding_grid", with_binding(P, """
    SELECT o.object_id, CAST(g.rownum AS BIGINT) AS rownum
    FROM (SELECT DISTINCT object_id FROM obs) o, range(1, 33) g(rownum)"""))
def q_padding_grid(spark, sf):
    g = J.padding_grid(A.distinct_objects(obs(spark, sf), {}), 32)
    return g.select("object_id", i64("rownum").alias("rownum"))


def _padded_rel_sql(b, length):
    return with_binding(b, f"""
        SELECT g.object_id, CAST(g.rownum AS BIGINT) AS rownum,
               COALESCE(t.mjd, 0.0) AS mjd, CAST(COALESCE(t.passband, 0) AS BIGINT) AS passband,
               COALESCE(t.flux, 0.0) AS flux, COALESCE(t.flux_err, 0.0) AS flux_err,
               CAST(COALESCE(t.detected, 0) AS BIGINT) AS detected
        FROM (SELECT DISTINCT object_id FROM obs) o0
        CROSS JOIN range(1, {length + 1}) r(rownum)
        JOIN (SELECT o0.object_id, r.rownum) g ON TRUE
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_desc_sql(b)}) AS rn
                   FROM obs) t
          ON t.object_id = g.object_id AND t.rn = g.rownum""")


@register("grid_left_join", with_binding(P, f"""
    SELECT g.object_id, CAST(g.rownum AS BIGINT) AS rownum,
           COALESCE(t.mjd, 0.0) AS mjd, CAST(COALESCE(t.passband, 0) AS BIGINT) AS passband,
           COALESCE(t.flux, 0.0) AS flux, COALESCE(t.flux_err, 0.0) AS flux_err,
           CAST(COALESCE(t.detected, 0) AS BIGINT) AS detected
    FROM (SELECT o.object_id, r.rownum FROM (SELECT DISTINCT object_id FROM obs) o, range(1, 33) r(rownum)) g
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {ORDER_P_DESC}) AS rn FROM obs) t
      ON t.object_id = g.object_id AND t.rn = g.rownum"""))
def q_grid_left_join(spark, sf):
    o = obs(spark, sf)
    grid = J.padding_grid(A.distinct_objects(o, {}), 32)
    ranked = W.keep_last(o, TIE[P], 32).select(
        "object_id", "rownum_desc", "mjd", "passband", "flux", "flux_err", "detected")
    out = J.grid_left_join(grid, ranked)
    return out.select("object_id", i64("rownum").alias("rownum"), "mjd", i64("passband").alias("passband"),
                      "flux", "flux_err", i64("detected").alias("detected"))


_MIRROR_SQL = f"""
    SELECT {keys_sql(prefix='a.')}, CAST(a.rn AS BIGINT) AS rownum, {r6s('d.rval')} AS rval
    FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {ORDER_P}) AS rn FROM obs) a
    JOIN (SELECT object_id,
                 first_value(mjd) OVER (PARTITION BY object_id ORDER BY {ORDER_P_DESC}) - mjd AS rval,
                 row_number() OVER (PARTITION BY object_id ORDER BY {ORDER_P_DESC}) AS rn
          FROM obs) d
      ON a.object_id = d.object_id AND a.rn = d.rn"""


@register("rank_join", with_binding(P, _MIRROR_SQL))
def q_rank_join(spark, sf):
    o = obs(spark, sf)
    desc = W.rank_desc(W.reverse_elapsed(o, TIE[P], "aligned"), TIE[P], "rownum").select("object_id", "rval", "rownum")
    asc = W.rank_asc(o, TIE[P], "rownum")
    j = J.rank_join(asc, desc)
    return j.select(*keys(), i64("rownum").alias("rownum"), r6("rval").alias("rval"))


# --------------------------------------------------------------- A1-A3 ---

@register("observation_counts", with_binding(P, """
    SELECT object_id, CAST(count(*) AS BIGINT) AS n_obs FROM obs GROUP BY object_id"""))
def q_observation_counts(spark, sf):
    return A.observation_counts(obs(spark, sf)).select("object_id", i64("n_obs").alias("n_obs"))


@register("max_observation_count", with_binding("obs_supp", """
    SELECT CAST(max(n) AS BIGINT) AS max_n_obs FROM (SELECT object_id, count(*) AS n FROM obs GROUP BY object_id) c"""))
def q_max_observation_count(spark, sf):
    return A.max_observation_count(obs(spark, sf, "obs_supp")).select(i64("max_n_obs").alias("max_n_obs"))


@register("flux_modifiers", with_binding(P, f"""
    SELECT object_id, {r6s('flux_pow')} AS flux_pow, {r6s('hist_modifier')} AS hist_modifier,
           {r6s('meta_val')} AS meta_val FROM mods""", extra=_MODS_SQL))
def q_flux_modifiers(spark, sf):
    m = A.flux_modifiers(obs(spark, sf))
    return m.select("object_id", r6("flux_pow").alias("flux_pow"),
                    r6("hist_modifier").alias("hist_modifier"), r6("meta_val").alias("meta_val"))


# ------------------------------------------------------------------ W ---

def _rank_sql(b, desc=False, name="rownum"):
    order = order_desc_sql(b) if desc else order_sql(b)
    return with_binding(b, f"""
        SELECT {keys_sql(b)}, CAST(row_number() OVER (PARTITION BY object_id ORDER BY {order}) AS BIGINT) AS {name}
        FROM obs""")


@register("rank_asc", _rank_sql(P))
def q_rank_asc(spark, sf):
    return W.rank_asc(obs(spark, sf), TIE[P]).select(*keys(), i64("rownum").alias("rownum"))


@register("rank_desc", _rank_sql(P, True, "rownum_desc"))
def q_rank_desc(spark, sf):
    return W.rank_desc(obs(spark, sf), TIE[P]).select(*keys(), i64("rownum_desc").alias("rownum_desc"))


@register("rank_asc_event", _rank_sql("obs_event"))
def q_rank_asc_event(spark, sf):
    return W.rank_asc(obs(spark, sf, "obs_event"), TIE["obs_event"]).select(
        *keys("obs_event"), i64("rownum").alias("rownum"))


@register("global_rank", with_binding(P, f"""
    SELECT {keys_sql()}, CAST(row_number() OVER (ORDER BY object_id, {ORDER_P}) AS BIGINT) AS global_rownum
    FROM obs"""))
def q_global_rank(spark, sf):
    g = W.global_rank(obs(spark, sf), ["object_id", "mjd"] + TIE[P])
    return g.select(*keys(), i64("global_rownum").alias("global_rownum"))


@register("elapsed_time", with_binding(P, f"""
    SELECT {keys_sql()}, {r6s('mjd - first_value(mjd) OVER (PARTITION BY object_id ORDER BY ' + ORDER_P + ')')} AS elapsed
    FROM obs"""))
def q_elapsed_time(spark, sf):
    return W.elapsed_time(obs(spark, sf), TIE[P]).select(*keys(), r6("elapsed").alias("elapsed"))


@register("elapsed_time_scaled", with_binding(P, f"""
    SELECT {keys_sql(prefix='o.')},
           {r6s('(o.mjd - first_value(o.mjd) OVER (PARTITION BY o.object_id ORDER BY o.mjd, o.l_orderkey, o.l_linenumber, o.l_suppkey, o.flux)) / 100.0 / (m.hostgal_photoz + 1.0)')} AS elapsed
    FROM obs o JOIN meta m ON o.object_id = m.object_id""", meta=True))
def q_elapsed_time_scaled(spark, sf):
    o = J.join_metadata(obs(spark, sf), meta(spark, sf).select("object_id", "hostgal_photoz"))
    e = W.elapsed_time(o, TIE[P], scale=100.0, redshift="hostgal_photoz")
    return e.select(*keys(), r6("elapsed").alias("elapsed"))


@register("delta_time", with_binding(P, f"""
    SELECT {keys_sql()},
           {r6s('COALESCE(mjd - lag(mjd) OVER (PARTITION BY object_id ORDER BY ' + ORDER_P + '), 0.0)')} AS delta_mjd
    FROM obs"""))
def q_delta_time(spark, sf):
    return W.delta_time(obs(spark, sf), TIE[P]).select(*keys(), r6("delta_mjd").alias("delta_mjd"))


@register("lead_time", with_binding(P, f"""
    SELECT {keys_sql()},
           {r6s('COALESCE(lead(mjd) OVER (PARTITION BY object_id ORDER BY ' + ORDER_P + ') - mjd, 0.0)')} AS lead_mjd
    FROM obs"""))
def q_lead_time(spark, sf):
    return W.lead_time(obs(spark, sf), TIE[P]).select(*keys(), r6("lead_mjd").alias("lead_mjd"))


@register("reverse_elapsed_aligned", with_binding(P, f"""
    SELECT {keys_sql()}, {r6s('max(mjd) OVER (PARTITION BY object_id) - mjd')} AS rval FROM obs"""))
def q_reverse_aligned(spark, sf):
    return W.reverse_elapsed(obs(spark, sf), TIE[P], "aligned").select(*keys(), r6("rval").alias("rval"))


@register("reverse_elapsed_mirrored", with_binding(P, f"""
    SELECT object_id, l_orderkey, l_linenumber, l_suppkey, rval FROM ({_MIRROR_SQL}) x"""))
def q_reverse_mirrored(spark, sf):
    return W.reverse_elapsed(obs(spark, sf), TIE[P], "mirrored").select(*keys(), r6("rval").alias("rval"))


@register("interval_features", with_binding(P, f"""
    SELECT {keys_sql()},
           {r6s('mjd - first_value(mjd) OVER w')} AS interval,
           {r6s('COALESCE(mjd - lag(mjd) OVER w, 0.0)')} AS delta_mjd,
           CAST(row_number() OVER w AS BIGINT) AS rownum
    FROM obs WINDOW w AS (PARTITION BY object_id ORDER BY {ORDER_P})"""))
def q_interval_features(spark, sf):
    f = W.interval_features(obs(spark, sf), TIE[P])
    return f.select(*keys(), r6("interval").alias("interval"), r6("delta_mjd").alias("delta_mjd"),
                    i64("rownum").alias("rownum"))


def _keep_last_sql(b, length):
    return with_binding(b, f"""
        SELECT {keys_sql(b)}, CAST(rn AS BIGINT) AS rownum_desc, mjd FROM (
            SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {order_desc_sql(b)}) AS rn FROM obs) t
        WHERE rn <= {length}""")


@register("keep_last", _keep_last_sql(P, 32))
def q_keep_last(spark, sf):
    k = W.keep_last(obs(spark, sf), TIE[P], 32)
    return k.select(*keys(), i64("rownum_desc").alias("rownum_desc"), "mjd")


@register("keep_last_supp", _keep_last_sql("obs_supp", 256))
def q_keep_last_supp(spark, sf):
    k = W.keep_last(obs(spark, sf, "obs_supp"), TIE["obs_supp"], 256)
    return k.select(*keys("obs_supp"), i64("rownum_desc").alias("rownum_desc"), "mjd")


@register("range_normalise", with_binding(P, f"""
    SELECT {keys_sql(prefix='o.')}, {r6s('o.flux / d.hist_modifier')} AS flux,
           {r6s('o.flux_err / d.hist_modifier')} AS flux_err
    FROM obs o JOIN mods d ON o.object_id = d.object_id""", extra=_MODS_SQL))
def q_range_normalise(spark, sf):
    n = W.range_normalise(obs(spark, sf))
    return n.select(*keys(), r6("flux").alias("flux"), r6("flux_err").alias("flux_err"))
