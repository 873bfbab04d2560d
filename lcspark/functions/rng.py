"""Keyed random numbers.

A draw is a pure function of (keys, tag, seed): the first 32 bits of
``md5(concat_ws('|', keys..., tag, seed))`` divided by 2^32.  It does not
depend on partitioning, task retries or executor loss, and it can be
written the same way in any SQL engine that has md5.  Keys must be
integers or strings (doubles print differently across engines).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["keyed_uniform", "keyed_at_least", "keyed_normal", "keyed_hash_string", "round6"]


def _as_col(k) -> Column:
    return k if isinstance(k, Column) else F.col(k)


def keyed_hash_string(seed: int, tag: str, *keys) -> Column:
    parts = [_as_col(k).cast("string") for k in keys]
    parts += [F.lit(str(tag)), F.lit(str(seed))]
    return F.concat_ws("|", *parts)


def keyed_uniform(seed: int, tag: str, *keys) -> Column:
    """Uniform draw in [0, 1)."""
    h = F.md5(keyed_hash_string(seed, tag, *keys))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def keyed_at_least(least: float, seed: int, tag: str, *keys) -> Column:
    """``keyed_uniform(...) >= least`` without making the number: the hash's
    first digits are compared as text (hexadecimal digits sort as their
    values do, and ``least`` * 2^32 is exact)."""
    whole = math.ceil(least * 4294967296.0)
    if not 0 < whole < 1 << 32:
        return F.lit(whole <= 0)
    return F.md5(keyed_hash_string(seed, tag, *keys)) >= F.lit(f"{whole:08x}")


def round6(x: Column) -> Column:
    """floor(x * 1e6 + 0.5) / 1e6: rounding to 6 places by plain IEEE
    arithmetic, so every engine gets the same double (engines' own round()
    functions break ties differently)."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def keyed_normal(seed: int, tag: str, *keys) -> Column:
    """Standard normal draw by Box-Muller from two keyed uniforms, rounded
    to 6 places so that the draw is the same in every engine (the libm
    results of log, sqrt and cos may differ in the last bit)."""
    u1 = keyed_uniform(seed, f"{tag}.a", *keys)
    u2 = keyed_uniform(seed, f"{tag}.b", *keys)
    z = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return round6(z)
