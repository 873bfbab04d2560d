"""Exact dedup: a persistent index of text digests, bucketed and sorted by
digest, empty at first.  A batch is reduced to one row per digest, the digests
that the index already has fall away in a sort-merge anti-join with it (the
index side is not shuffled: its buckets are the join's partitions), and the
rest are appended.

Defined cases: a null text counts as empty, so null and empty texts are one
group; a group whose ids are all null keeps a null id; rows that repeat both
id and text are the same document and get the same verdict; an empty batch
adds nothing; other columns of the batch are neither read nor needed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lcspark.llm.common import ascii_lower, fresh, join_groups, partitions, staged
from lcspark.sources.io import scratch_dir


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (32 bytes): SHA-256 of the text in UTF-8 after lower-casing A-Z."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"),
                     F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """Index table ``digest, keep_id``, bucketed and sorted by digest, made
    empty where it is missing.  With a ``path`` the files lie there: an index
    of earlier applications is taken up again (with its number of buckets),
    and ``forget`` leaves them."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or partitions(spark)
        if not spark.catalog.tableExists(name):
            place = f"LOCATION '{path}'" if path else ""
            spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT) USING parquet "
                      f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {place}")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        # one task per bucket writes one sorted file per bucket
        (fresh.select("digest", F.col("keep_id").cast("bigint").alias("keep_id")).repartition(self.buckets, "digest")
         .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))

    def forget(self) -> None:
        """Drop the catalog's entry (of a table with a path: not its files)."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch and return id, digest, keep_id, group_size for each of
        its rows.  ``keep_id`` is the id kept for the text: of an earlier
        batch if the index had it, else the largest of this batch;
        ``group_size`` counts the batch's rows with the text."""
        rows = staged(digests(batch, id_col, text_col), "digests")
        groups = staged(rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")),
                        "digest-groups")
        # the index lies hashed and sorted by its buckets: only the groups are shuffled
        known = self.read().hint("merge")
        self.append(groups.join(known, "digest", "left_anti"))
        verdicts = staged(groups.drop("keep_id").hint("merge").join(self.read(), "digest"), "digest-verdicts")
        return join_groups(rows, verdicts, "digest")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_path: str | None = None) -> DataFrame:
    """Verdicts of one batch: id, digest, keep_id, group_size, kept.  With an
    ``index_path`` (a shared folder) the index there is used and grows, so a
    text of an earlier batch is kept under that batch's id; without one the
    index is a new one below the shared checkpoint folder."""
    spark = df.sparkSession
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}", path=index_path or scratch_dir(spark, "digest-index"))
    try:
        out = index.add(df, id_col, text_col)
    finally:
        index.forget()
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_path: str | None = None) -> DataFrame:
    """The rows of ``df`` that stay, all columns; of rows that repeat both id
    and text one stays.  Texts stay where they are: what is joined with them
    is the bounded or narrow list of (id, digest) that go, and only rows of
    repeated (id, digest) pairs meet in a window."""
    gone, gone_text, digest, nth, again = (fresh(df, x) for x in ("_gone", "_gone_text", "_digest", "_nth", "_again"))
    verdicts = staged(exact_duplicates(df, id_col, text_col, index_path).select("id", "digest", "kept"), "verdicts")
    dropped = verdicts.where(~F.col("kept")).select(F.col("id").alias(gone), F.col("digest").alias(gone_text)).distinct()
    repeated = (verdicts.where("kept").groupBy("id", "digest").count().where("count > 1")
                .select(F.col("id").alias(gone), F.col("digest").alias(gone_text), F.lit(True).alias(again)))
    own = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(gone)) & (F.col(digest) == F.col(gone_text))
    marks = dropped.withColumn(again, F.lit(False)).unionByName(repeated)
    marked = df.withColumn(digest, own).join(marks, same, "left").drop(gone, gone_text)
    once = marked.where(F.col(again).isNull())
    first = Window.partitionBy(id_col, digest).orderBy(text_col)
    one = marked.where(again).withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1)
    return once.drop(digest, again).unionByName(one.drop(digest, again, nth))
