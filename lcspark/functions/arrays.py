"""Array and vector functions.

Spark's own array functions, so no Python worker is started.  Functions with
a lambda are interpreted (they are not part of generated code), but each of
these passes over its arrays a fixed number of times: none looks an element
of another array up inside a lambda, where the optimiser may rebuild that
array for every element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lcspark.functions.expr import col_of

__all__ = ["pad_array", "forward_diff", "backward_diff", "one_hot",
           "to_vector", "to_dense", "vector_array", "concat_features",
           "slice_features", "hist_matrix", "argmax", "sorted_struct_array",
           "keep_last_elements"]


def pad_array(arr, length: int, value=0, dtype: str = "float") -> Column:
    """``pad_sequences`` with pre-padding and pre-truncation: values in
    front up to ``length``, and only the last ``length`` elements kept."""
    a = col_of(arr)
    fill = F.array_repeat(F.lit(value).cast(dtype), F.lit(length))
    return F.slice(F.concat(fill, a.cast(f"array<{dtype}>")), -length, length)


def _pairwise(a: Column) -> Column:
    """[a1-a0, a2-a1, ...], one shorter than the array."""
    n = F.greatest(F.size(a) - F.lit(1), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(2), n), F.slice(a, F.lit(1), n), lambda x, p: x - p)


def _end(element: Column, difference) -> Column:
    """One-element array (none where ``element`` is none): the difference
    across the array's end if given and not null, else 0."""
    zero = lambda x: F.coalesce(F.nullif(x, x), F.lit(0))  # noqa: E731  0 of the element's type
    return F.transform(element, zero if difference is None else lambda x: F.coalesce(difference(x), zero(x)))


def forward_diff(arr, before=None) -> Column:
    """ediff1d(to_begin=0): [0, a1-a0, a2-a1, ...].  ``before`` is the
    value before the array, if it is part of a longer series."""
    a = col_of(arr)
    return F.concat(_end(F.slice(a, 1, 1), None if before is None else lambda x: x - before), _pairwise(a))


def backward_diff(arr, after=None) -> Column:
    """ediff1d(to_end=0): [a1-a0, a2-a1, ..., 0].  ``after`` is the value
    after the array, if it is part of a longer series."""
    a = col_of(arr)
    last = F.slice(a, F.greatest(F.size(a), F.lit(1)), F.lit(1))
    return F.concat(_pairwise(a), _end(last, None if after is None else lambda x: after - x))


def one_hot(idx, n: int = 15, offset: int = 0) -> Column:
    """0/1 array of length n with 1 where i + offset == idx.
    ``offset=1`` reproduces the variant in which index 0 is all zeros."""
    k = col_of(idx)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.when(i + F.lit(offset) == k, F.lit(1.0))
                       .otherwise(F.lit(0.0)))


def to_vector(arr) -> Column:
    """array -> dense ML vector (JVM function, no Python)."""
    from pyspark.ml.functions import array_to_vector
    return array_to_vector(col_of(arr).cast("array<double>"))


def vector_array(vec) -> Column:
    """ML vector -> array<double>."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(col_of(vec))


def to_dense(vec) -> Column:
    """any (sparse or dense) ML vector -> dense vector."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    return array_to_vector(vector_to_array(col_of(vec)))


def concat_features(*arrays) -> Column:
    """Concatenate numeric arrays (cast to double) into one array."""
    return F.concat(*[col_of(a).cast("array<double>") for a in arrays])


def slice_features(arr, meta_len: int = 10, seq_len: int = 256,
                   n_channels: int = 8) -> Column:
    """split a flat feature array (meta, band, channel-major history)
    into a struct of meta, band and a seq_len x n_channels matrix."""
    a = col_of(arr)
    hist_start = meta_len + seq_len + 1
    channels = [F.slice(a, hist_start + c * seq_len, seq_len) for c in range(n_channels)]
    return F.struct(
        F.slice(a, 1, meta_len).alias("meta"),
        F.slice(a, meta_len + 1, seq_len).alias("band"),
        hist_matrix(channels).alias("hist"),
    )


def hist_matrix(channels) -> Column:
    """channel arrays (c x n) -> per-time rows (n x c), i.e. the
    reshape + permute of a channel-major block."""
    names = [f"c{k}" for k in range(len(channels))]
    zipped = F.arrays_zip(*[col_of(c).alias(n) for c, n in zip(channels, names)])
    return F.transform(zipped, lambda z: F.array(*[z[n] for n in names]))


def argmax(arr) -> Column:
    """0-based index of the (first) largest element."""
    a = col_of(arr)
    return F.array_position(a, F.array_max(a)) - F.lit(1)


def sorted_struct_array(*fields) -> Column:
    """``collect_list`` of structs sorted by their fields in order; used as
    an aggregate.  Put the order keys first (time, then tie-breaks) so the
    array has a defined order after any shuffle."""
    return F.sort_array(F.collect_list(F.struct(*fields)))


def keep_last_elements(arr, length: int) -> Column:
    """Last ``length`` elements (all when shorter)."""
    a = col_of(arr)
    return F.slice(a, F.greatest(F.size(a) - F.lit(length) + F.lit(1), F.lit(1)),
                   F.lit(length))
