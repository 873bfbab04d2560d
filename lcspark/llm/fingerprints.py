"""Document fingerprints: a bottom-k sketch holds the k smallest distinct
64-bit hashes of a document's five-word shingles.  Sketches merge (the
sketch of a union is the k smallest of both) and estimate resemblance,
containment and the number of distinct shingles.

Defined cases: a null text is empty and has an empty sketch; a text of fewer
than five words has one shingle, all its words; two empty sketches resemble
each other fully, an empty and a full one not at all; a sketch with fewer
than k hashes is the whole set and its estimates are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lcspark.llm.common import let, partitions, words

K = 256
SHINGLE = 5
# Ranges of document order per shuffle partition in ``with_next``.
RANGES_PER_PARTITION = 4
_LOWEST = -(2 ** 63)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<bigint>, ascending: the k smallest hashes of the lower-cased
    text's distinct shingles."""
    hashes = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))

    def shingles(h):
        # get() gives null beyond the end, which the hash passes over
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - shingle, F.lit(0)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)])))
    return F.slice(F.sort_array(F.array_distinct(let(hashes, shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """One sketch per key from any number of parts' sketches: hashes are
    made distinct and ranked per key, so a large group never meets whole."""
    w = Window.partitionBy(key).orderBy("_h")
    hashes = sketches.select(key, F.explode(column).alias("_h")).distinct()
    return (hashes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
            .groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(column)))


def _shared(a: Column, b: Column, of: Column) -> Column:
    return F.size(F.array_intersect(of, F.array_intersect(a, b)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's k smallest hashes that both sketches hold."""
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .otherwise(let(merge(a, b, k), lambda u: _shared(a, b, u) / F.size(u))))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k hashes, else (k - 1) / the k-th hash as a number in (0, 1)."""
    unit = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63) + 1) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((F.size(a) - 1) / unit)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has, from the resemblance and the counts;
    an empty a is contained in anything."""
    shared = (resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared))


def as_text(a: Column) -> Column:
    """The sketch as Base64 of its hashes, eight bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def _range_of(key: Column, bounds: list) -> Column:
    """Number of bounds that are at most the key, by binary search."""
    if not bounds:
        return F.lit(0)
    n, step, steps = len(bounds), 1, []
    while step <= n:
        steps.insert(0, step)
        step *= 2
    array = F.array(*[F.lit(b) for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: F.when((at + s <= n) & (F.element_at(array, F.least(at + s, F.lit(n))) <= key), at + s)
        .otherwise(at))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """id, text, sketch and the text and sketch of the next document in
    ascending order of id (then text); after the last comes the first.  A
    null id sorts first.

    Rows are dealt by ranges of id (bounds: as many approximate quantiles,
    all of them ids that occur).  The first document of each range also goes
    to the range before, where it ends the order, so one shuffle of the
    texts serves and no range needs another's rows."""
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LOWEST))
    n = RANGES_PER_PARTITION * partitions(df.sparkSession)
    quantiles = df.select(key.alias("key")).agg(
        F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n).alias("q"), F.min("key").alias("first")).first()
    first = quantiles["first"]
    bounds = sorted(b for b in set(quantiles["q"] or []) if b != first)
    last = len(bounds)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                     key.alias("key")).withColumn("range", _range_of(F.col("key"), bounds))
    starts = F.col("key").isin([*bounds, first]) if first is not None else F.lit(False)
    before = F.when(F.col("range") == 0, F.lit(last)).otherwise(F.col("range") - 1)
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost"))
    ghost = F.struct(before.alias("range"), F.lit(True).alias("ghost"))
    dealt = (rows.select("id", "text", "key", F.explode(F.when(starts, F.array(own, ghost)).otherwise(F.array(own))).alias("p"))
             .select("id", "text", "key", F.col("p.range").alias("range"), F.col("p.ghost").alias("ghost"))
             .repartition("range")
             .withColumn("sketch", sketch(F.col("text"), k)))
    order = Window.partitionBy("range").orderBy("ghost", "key", "text")
    return (dealt.withColumn("next_text", F.lead("text").over(order))
            .withColumn("next_sketch", F.lead("sketch").over(order))
            .where(~F.col("ghost")).select("id", "text", "sketch", "next_text", "next_sketch"))
