"""The registry of named queries: a Spark callable (spark, sf_dir) ->
DataFrame and, where the operator can be said in SQL, a DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def r6(c) -> Column:
    """double rounded to 6 places by floor(x * 1e6 + 0.5) / 1e6 (oracle
    parity: the same IEEE operations in Spark and in the SQL oracle)."""
    from lcspark.functions.rng import round6
    return round6(_c(c).cast("double"))


def f6(c) -> Column:
    """float32 storage read back as double, rounded to 6 places."""
    from lcspark.functions.rng import round6
    return round6(_c(c).cast("float").cast("double"))


def i64(c) -> Column:
    return _c(c).cast("bigint")


def explode_arrays(df, keys, arrays: dict, pos: str = "pos"):
    """Exploded form of aligned arrays: keys, pos (0-based position in the
    object; a ``chunk`` column, when present, counts MAX_ARRAY_LEN
    positions), one column per array.  Used only to compare array results
    with row-wise oracles."""
    from lcspark.operators.aggregate import MAX_ARRAY_LEN
    has_chunk = "chunk" in df.columns and "chunk" not in keys
    ks = list(keys) + (["chunk"] if has_chunk else [])
    zipped = F.arrays_zip(*[_c(c).alias(n) for n, c in arrays.items()])
    out = df.select(*ks, F.posexplode(zipped).alias(pos, "_z"))
    p = (F.col("chunk").cast("bigint") * F.lit(MAX_ARRAY_LEN) + F.col(pos)) if has_chunk else F.col(pos)
    return out.select(*keys, i64(p).alias(pos), *[F.col(f"_z.{n}").alias(n) for n in arrays])
