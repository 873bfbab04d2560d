"""Bindings of the driver's tables to observation / metadata schemas.

A binding is a plain projection of one table; the operators never see the
source table's names.  Each observation binding comes with its tie-break
columns (the full order key inside an object is unique).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lcspark.functions.rng import keyed_uniform
from lcspark.schema import CLASS_CODES

# Reference day zero of the modified Julian date, and the day number of
# the Unix epoch.
MJD_EPOCH = "1858-11-17"
UNIX_EPOCH_MJD = 40587
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

TIE = {
    "obs_part": ["l_orderkey", "l_linenumber", "l_suppkey", "flux"],
    "obs_supp": ["l_orderkey", "l_linenumber", "l_partkey", "flux"],
    "obs_event": ["event_id"],
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem_obs(spark, sf_dir, key: str, tie_cols) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.col(key).cast("bigint").alias("object_id"),
        F.datediff(F.to_date("l_shipdate"), F.lit(MJD_EPOCH).cast("date")).cast("double").alias("mjd"),
        ((F.col("l_linenumber") - 1) % 6).cast("int").alias("passband"),
        F.col("l_extendedprice").cast("double").alias("flux"),
        F.col("l_quantity").cast("double").alias("flux_err"),
        (F.col("l_returnflag") == "R").cast("int").alias("detected"),
        *[F.col(c) for c in tie_cols],
    )


def obs_part(spark, sf_dir) -> DataFrame:
    """Objects = parts: 11-53 observations each (padding cases)."""
    return _lineitem_obs(spark, sf_dir, "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey"])


def obs_supp(spark, sf_dir) -> DataFrame:
    """Objects = suppliers: 527-695 observations each (truncation cases)."""
    return _lineitem_obs(spark, sf_dir, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"])


def epoch_micros(df: DataFrame, col: str):
    """Microseconds since 1970-01-01 of a timestamp column, independent of
    the session time zone: a wall-clock (NTZ) value is read as UTC from its
    date and time parts; an instant (LTZ) value is its epoch already."""
    from pyspark.sql.types import TimestampNTZType
    c = F.col(col)
    if isinstance(df.schema[col].dataType, TimestampNTZType):
        days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
        minutes = F.hour(c).cast("bigint") * F.lit(60) + F.minute(c).cast("bigint")
        micros_in_minute = (F.date_part(F.lit("SECOND"), c) * F.lit(1000000)).cast("bigint")
        return days * F.lit(86400000000) + minutes * F.lit(60000000) + micros_in_minute
    return F.unix_micros(c)


def obs_event(spark, sf_dir) -> DataFrame:
    """Objects = users of the event stream: no time ties."""
    ev = _read(spark, sf_dir, "events")
    types = F.array(*[F.lit(t) for t in EVENT_TYPES])
    return ev.select(
        F.col("user_id").cast("bigint").alias("object_id"),
        (epoch_micros(ev, "ts").cast("double") / F.lit(86400e6)
         + F.lit(float(UNIX_EPOCH_MJD))).alias("mjd"),
        (F.array_position(types, F.col("event_type")) - 1).cast("int").alias("passband"),
        F.col("value").cast("double").alias("flux"),
        (F.lit(0.1) * F.col("value") + F.lit(0.01)).alias("flux_err"),
        (F.col("event_type") == "purchase").cast("int").alias("detected"),
        F.col("event_id"),
    )


def _target_at(pos) -> F.Column:
    return F.element_at(F.array(*[F.lit(c) for c in CLASS_CODES]), pos + F.lit(1))


def _meta_common(key, photoz, ddf, specz_switch, mwebv, target_pos):
    k = F.col(key)
    return [
        k.cast("bigint").alias("object_id"),
        ((k * 37) % 360).cast("double").alias("ra"),
        ((k % 180) - 90).cast("double").alias("decl"),
        ((k * 53) % 360).cast("double").alias("gal_l"),
        ((k % 90) - 45).cast("double").alias("gal_b"),
        ddf.cast("int").alias("ddf"),
        F.when(specz_switch, photoz).otherwise(F.lit(0.0)).alias("hostgal_specz"),
        photoz.alias("hostgal_photoz"),
        (photoz / F.lit(10.0)).alias("hostgal_photoz_err"),
        F.when(photoz == 0, F.lit(None).cast("double")).otherwise(F.lit(40.0) + photoz).alias("distmod"),
        mwebv.alias("mwebv"),
        _target_at(target_pos).cast("int").alias("target"),
    ]


def meta_part(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    photoz = F.when(F.col("p_partkey") % 4 == 0, F.lit(0.0)).otherwise(
        (F.col("p_retailprice") - F.lit(900.0)) / F.lit(25.0))
    return p.select(*_meta_common("p_partkey", photoz, F.col("p_size") % 2,
                                  F.col("p_size") > 25, F.col("p_size") / F.lit(100.0),
                                  F.col("p_size") % 14))


def _meta_nation(df, key, nation):
    photoz = F.when(F.col(key) % 4 == 0, F.lit(0.0)).otherwise(
        (F.col(nation) + F.lit(1)).cast("double") / F.lit(10.0))
    return df.select(*_meta_common(key, photoz, F.col(key) % 2, F.col(nation) > 12,
                                   F.col(nation) / F.lit(100.0), F.col(nation) % 14))


def meta_supp(spark, sf_dir) -> DataFrame:
    return _meta_nation(_read(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey")


def meta_event(spark, sf_dir) -> DataFrame:
    return _meta_nation(_read(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")


def preds_synth(spark, sf_dir) -> DataFrame:
    """Synthetic predictions per part: 15 positive numbers from md5 of
    (p_partkey, class) divided by their sum; the true class is the mapped
    target of ``meta_part``."""
    from lcspark.functions.expr import map_target
    meta = meta_part(spark, sf_dir)
    raw = F.transform(F.sequence(F.lit(0), F.lit(14)),
                      lambda c: keyed_uniform(0, "pred", F.col("object_id"), c) + F.lit(1e-3))
    total = F.aggregate(F.col("_raw"), F.lit(0.0), lambda acc, x: acc + x)
    return (meta.select("object_id", map_target("target").alias("label"), raw.alias("_raw"))
            .select("object_id", "label",
                    F.transform(F.col("_raw"), lambda x: x / total).alias("probs")))


OBS = {"obs_part": obs_part, "obs_supp": obs_supp, "obs_event": obs_event}
META = {"obs_part": meta_part, "obs_supp": meta_supp, "obs_event": meta_event}
