"""The corpus pipeline: raw documents to packed training sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.  No stage can be said in SQL as a
whole (language model, random field, tokenizer), so ``ORACLE_SQL`` is None;
``tests/llm`` holds the stages against brute-force versions.

Defined cases, for every stage: rows without an id are documents like any
other; rows that share an id are kept or dropped each by its own text; a null
text counts as empty (language ID rejects it, and later stages keep a null
text null); further columns, whatever their names, come through all stages
but the last; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lcspark.llm import exactdedup, langid, neardup, packing, pii
from lcspark.llm.common import staged, table
from lcspark.llm.queries import word_tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the documents that name their language; documents without
    any letter are rejected, and a missing language is filled in.  Without
    any named language nothing can be learnt and only texts are required."""
    model = langid.train(docs)
    found = langid.identify(docs, model)
    known = F.col("lang_pred") != langid.UNDETERMINED if model.languages else F.col("text").rlike(r"\p{L}")
    lang = F.coalesce("lang", F.when(F.col("lang_pred") != langid.UNDETERMINED, F.col("lang_pred")))
    return found.where(known).withColumn("lang", lang).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays."""
    return exactdedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word
    shingles, the one with the least id stays."""
    return neardup.drop_near_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows."""
    clean = pii.redact(docs, pii.train(docs))
    chars = F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))
    return clean.withColumn("n_chars", chars).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents and their places in sequences."""
    out = packing.pack_documents(docs, word_tokenizer())
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("pii", redact_personal_data), ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
