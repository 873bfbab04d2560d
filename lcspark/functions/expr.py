"""Scalar column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lcspark.schema import CLASS_CODES, PASSBAND_NM, UNKNOWN_CLASS_INDEX

__all__ = ["map_target", "received_wavelength", "source_wavelength",
           "received_frequency", "photoz_positive", "band_index",
           "log2_pow", "flux_pow", "clip", "col_of"]


def col_of(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def map_target(target="target") -> Column:
    """Class code -> index 0..14; unknown codes and null -> 14."""
    lookup = F.create_map(*chain.from_iterable(
        (F.lit(code), F.lit(i)) for i, code in enumerate(CLASS_CODES)))
    return F.coalesce(F.try_element_at(lookup, col_of(target)),
                      F.lit(UNKNOWN_CLASS_INDEX))


def _wavelength_nm(passband) -> Column:
    """Wavelength in nm of passband 0..4; any other value takes the last
    band (1004 nm), as the CASE chain it replaces."""
    pb = col_of(passband)
    expr = F.lit(float(PASSBAND_NM[-1]))
    for band in range(len(PASSBAND_NM) - 2, -1, -1):
        expr = F.when(pb == band, F.lit(float(PASSBAND_NM[band]))).otherwise(expr)
    return expr


def received_wavelength(passband="passband") -> Column:
    """C4: received wavelength in micrometres (nm / 1000)."""
    return _wavelength_nm(passband) / F.lit(1000.0)


def source_wavelength(passband="passband", z="hostgal_photoz") -> Column:
    """Rest-frame wavelength nm / (z + 1) / 1000; null when z = -1."""
    return F.try_divide(_wavelength_nm(passband), col_of(z) + F.lit(1.0)) / F.lit(1000.0)


def received_frequency(passband="passband") -> Column:
    """Received frequency in THz, 300000 / nm."""
    return F.lit(300000.0) / _wavelength_nm(passband)


def photoz_positive(z="hostgal_photoz") -> Column:
    """1 when z > 0 else 0."""
    return F.when(col_of(z) > 0, F.lit(1)).otherwise(F.lit(0))


def band_index(passband="passband", shift: int = 1) -> Column:
    """Passband + shift (baseline bands start at 1; 0 is padding)."""
    return col_of(passband) + F.lit(shift)


def log2_pow(x) -> Column:
    """pow(2, log2(x)).  log2 of 0 or less is null in Spark, so a zero
    range gives null rather than an error."""
    return F.pow(F.lit(2.0), F.log2(col_of(x)))


def flux_pow(fmax, fmin) -> Column:
    """log2(max - min): null when the range is zero."""
    return F.log2(col_of(fmax) - col_of(fmin))


def clip(x, lo: float, hi: float) -> Column:
    """clamp to [lo, hi]."""
    return F.least(F.greatest(col_of(x), F.lit(lo)), F.lit(hi))
