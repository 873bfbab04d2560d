"""DuckDB SQL for the bindings, and helpers to write oracle queries.

The oracles are independent relational definitions of each operator: they
use windows and joins where the Spark side uses arrays, and they derive the
keyed random numbers from md5 in the same way.
"""

from __future__ import annotations

from lcspark.schema import CLASS_CODES, PASSBAND_NM

CLASS_LIST = "[" + ", ".join(str(c) for c in CLASS_CODES) + "]"

OBS_SQL = {
    "obs_part": """
        SELECT CAST(l_partkey AS BIGINT) AS object_id,
               CAST(date_diff('day', DATE '1858-11-17', CAST(l_shipdate AS DATE)) AS DOUBLE) AS mjd,
               CAST((l_linenumber - 1) % 6 AS INTEGER) AS passband,
               CAST(l_extendedprice AS DOUBLE) AS flux,
               CAST(l_quantity AS DOUBLE) AS flux_err,
               CAST(l_returnflag = 'R' AS INTEGER) AS detected,
               l_orderkey, l_linenumber, l_suppkey
        FROM lineitem""",
    "obs_supp": """
        SELECT CAST(l_suppkey AS BIGINT) AS object_id,
               CAST(date_diff('day', DATE '1858-11-17', CAST(l_shipdate AS DATE)) AS DOUBLE) AS mjd,
               CAST((l_linenumber - 1) % 6 AS INTEGER) AS passband,
               CAST(l_extendedprice AS DOUBLE) AS flux,
               CAST(l_quantity AS DOUBLE) AS flux_err,
               CAST(l_returnflag = 'R' AS INTEGER) AS detected,
               l_orderkey, l_linenumber, l_partkey
        FROM lineitem""",
    "obs_event": """
        SELECT CAST(user_id AS BIGINT) AS object_id,
               CAST(epoch_us(ts) AS DOUBLE) / 86400e6 + 40587.0 AS mjd,
               CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INTEGER) AS passband,
               CAST(value AS DOUBLE) AS flux,
               CAST(0.1 AS DOUBLE) * value + CAST(0.01 AS DOUBLE) AS flux_err,
               CAST(event_type = 'purchase' AS INTEGER) AS detected,
               event_id
        FROM events""",
}

TIE_SQL = {
    "obs_part": "l_orderkey, l_linenumber, l_suppkey, flux",
    "obs_supp": "l_orderkey, l_linenumber, l_partkey, flux",
    "obs_event": "event_id",
}


def _meta_sql(table, key, photoz, ddf, specz_switch, mwebv, target_pos):
    return f"""
        SELECT object_id, ra, decl, gal_l, gal_b, ddf,
               CASE WHEN {specz_switch} THEN photoz ELSE 0.0 END AS hostgal_specz,
               photoz AS hostgal_photoz,
               photoz / 10.0 AS hostgal_photoz_err,
               CASE WHEN photoz = 0 THEN NULL ELSE 40.0 + photoz END AS distmod,
               mwebv, target
        FROM (
            SELECT CAST({key} AS BIGINT) AS object_id,
                   CAST(({key} * 37) % 360 AS DOUBLE) AS ra,
                   CAST(({key} % 180) - 90 AS DOUBLE) AS decl,
                   CAST(({key} * 53) % 360 AS DOUBLE) AS gal_l,
                   CAST(({key} % 90) - 45 AS DOUBLE) AS gal_b,
                   CAST({ddf} AS INTEGER) AS ddf,
                   {photoz} AS photoz,
                   {mwebv} AS mwebv,
                   CAST({CLASS_LIST}[({target_pos}) + 1] AS INTEGER) AS target,
                   *
            FROM {table}
        ) m"""


META_SQL = {
    "obs_part": _meta_sql(
        "part", "p_partkey",
        "CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE (CAST(p_retailprice AS DOUBLE) - 900.0) / 25.0 END",
        "p_size % 2", "p_size > 25", "CAST(p_size AS DOUBLE) / 100.0", "p_size % 14"),
    "obs_supp": _meta_sql(
        "supplier", "s_suppkey",
        "CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE CAST(s_nationkey + 1 AS DOUBLE) / 10.0 END",
        "s_suppkey % 2", "s_nationkey > 12", "CAST(s_nationkey AS DOUBLE) / 100.0", "s_nationkey % 14"),
    "obs_event": _meta_sql(
        "customer", "c_custkey",
        "CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE CAST(c_nationkey + 1 AS DOUBLE) / 10.0 END",
        "c_custkey % 2", "c_nationkey > 12", "CAST(c_nationkey AS DOUBLE) / 100.0", "c_nationkey % 14"),
}


def with_binding(binding: str, body: str, meta: bool = False, extra: str = "") -> str:
    """``WITH obs AS (...) [, meta AS (...)] [, extra] body``."""
    ctes = [f"obs AS ({OBS_SQL[binding]})"]
    if meta:
        ctes.append(f"meta AS ({META_SQL[binding]})")
    if extra:
        ctes.append(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + body


def keyed_uniform_sql(seed: int, tag: str, *keys: str) -> str:
    parts = [f"CAST({k} AS VARCHAR)" for k in keys] + [f"'{tag}'", f"'{seed}'"]
    return (f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)"
            f" / 4294967296.0)")


def keyed_normal_sql(seed: int, tag: str, *keys: str) -> str:
    u1 = keyed_uniform_sql(seed, f"{tag}.a", *keys)
    u2 = keyed_uniform_sql(seed, f"{tag}.b", *keys)
    return round6_sql(f"sqrt(-2.0 * ln(1.0 - {u1})) * cos(2.0 * pi() * {u2})")


def round6_sql(expr: str) -> str:
    """floor(x * 1e6 + 0.5) / 1e6 in plain double arithmetic."""
    return f"(floor(({expr}) * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e6 AS DOUBLE))"


def map_target_sql(col: str) -> str:
    return f"COALESCE(CAST(list_position({CLASS_LIST}, {col}) - 1 AS INTEGER), 14)"


def r6(expr: str) -> str:
    return round6_sql(f"CAST({expr} AS DOUBLE)")


def f6(expr: str) -> str:
    """float32 storage, read back as double and rounded."""
    return round6_sql(f"CAST(CAST({expr} AS FLOAT) AS DOUBLE)")


def wavelength_nm_sql(pb: str) -> str:
    """Passband -> nm as a CASE chain; other values take the last band."""
    whens = " ".join(f"WHEN {pb} = {i} THEN {float(nm)}" for i, nm in enumerate(PASSBAND_NM[:-1]))
    return f"(CASE {whens} ELSE {float(PASSBAND_NM[-1])} END)"
