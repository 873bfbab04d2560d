"""Sharding by rendezvous hashing: each record goes to the shard with the
best weighted score of (record key, shard), so a new shard only takes
records to itself and leaves all others where they are.

Defined cases: a null key is hashed as the empty string; rows with equal
keys land in the same shard and get different slots; a null text has no
bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lcspark.llm.common import staged

# Hex digits of the key's digest that cut a shard into cells: slots are
# ranked inside a cell and shifted by the rows of the cells before.
CELL_DIGITS = 2


def uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of key and shard."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{shard}"))), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2 ** 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a key: the largest weight / -ln(uniform); the lowest
    number among equals."""
    if any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = [F.struct((F.lit(float(w)) / -F.ln(uniform(key, s))).alias("score"), F.lit(-s).alias("shard"))
              for s, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return -best["shard"]


def assign_shards(df: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot (gapless from 0 in the shard) and,
    with ``grown_weights`` (the weights and some more), the shard the row
    would have then.  The texts are only measured where they are read; what
    is shuffled is a few numbers a row, in cells of (shard, digest prefix),
    so no task holds a whole shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), key.alias("key"),
                     (F.octet_length(text).cast("bigint") + 8).alias("size"),
                     F.crc32(text.cast("binary")).alias("text_crc32"))
    grown = rendezvous(F.col("key"), grown_weights) if grown_weights else F.lit(None).cast("int")
    rows = rows.select("id", "size", "text_crc32", rendezvous(F.col("key"), weights).cast("int").alias("shard"),
                       grown.cast("int").alias("grown_shard"),
                       F.substring(F.md5("key"), 1, CELL_DIGITS).alias("cell"))
    rows = staged(rows, "shards")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
             .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    in_cell = Window.partitionBy("shard", "cell").orderBy("id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(in_cell) - 1)
    return (ranked.join(cells, ["shard", "cell"])
            .select("id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).cast("bigint").alias("slot"),
                    "grown_shard"))
