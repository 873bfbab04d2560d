"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lcspark.sources.io import scratch_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# White space of the word rule [^\x20\x09-\x0D]+ shared by the operators on words.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run here have their shuffle files removed when they end,
    not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP_CONF, None)
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_CONF)
        else:
            spark.conf.set(_CLEANUP_CONF, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: later steps start from files that survive a lost executor, and
    nothing reads the write's shuffle files again."""
    path = scratch_dir(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# Bytes of an Arrow batch.  Without a limit one holds 10,000 texts, and each
# running task has it several times: in the JVM's buffers, which grow by
# doubling, and in its Python worker.  A batch of texts is a slice of packing.
BATCH_BYTES = 4_000_000
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def limit_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``, unless the
    session has a limit of its own."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors' Python workers (once per
    application), so that they needn't have it installed, and keep what the
    workers get at a time small."""
    limit_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(SparkFiles.getRootDirectory(), "lcspark_modules.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.  For text of ASCII only (as many
    bytes as characters) that is what ``lower`` does, and faster."""
    return (F.when(F.octet_length(c) == F.length(c), F.lower(c))
            .otherwise(F.translate(c, UPPER, UPPER.lower())))


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once: a one-element array binds it
    to a lambda variable, which the optimiser can't inline per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text in order (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def freed(batches: Iterator) -> Iterator:
    """Batches of a task; after the last, what the allocators keep goes back to
    the system: a Python worker lives on for other stages, beside the memory
    that those take."""
    yield from batches
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most ``rows`` rows: what a task holds as
    Python objects at a time."""
    for batch in freed(batches):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def add_columns(df: DataFrame, text_col: str, fields: str, compute: Callable[[list], list], rows: int = 500) -> DataFrame:
    """All columns of ``df`` (those named as new ones are replaced), then the
    new ``fields`` (DDL).  ``compute`` gets the texts of at most ``rows`` rows
    (null: empty) and returns one sequence per field, in their order."""
    ship_package(df.sparkSession)
    new = StructType.fromDDL(fields)
    kept = df.drop(*[f.name for f in new])
    if text_col not in kept.columns:
        raise ValueError(f"{text_col} is not a column or would be replaced")
    types = [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, rows):
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            made = [pa.array(values, kind) for values, kind in zip(compute(texts), types)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *[f.name for f in new]])
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *new.fields]))


# A key with more than total / HOT_PARTS rows is hot; there can be at most
# HOT_PARTS of them, so the list of hot keys can be broadcast.
HOT_PARTS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Give each row its group's columns; ``groups`` has one row per key and
    ``group_size``, the rows of the key.  Both are stored and read twice.
    Rows of hot keys (a bounded list) are joined by broadcast and stay where
    they are; the rest by sort-merge."""
    most = F.lit(rows.count()) / HOT_PARTS
    hot = F.col("group_size") > most
    listed = F.broadcast(groups.where(hot).select(key, F.struct(*[c for c in groups.columns if c != key]).alias("_hot")))
    marked = rows.join(listed, key, "left")
    is_hot = F.col("_hot").isNotNull()
    of_hot = marked.where(is_hot).select(*rows.columns, "_hot.*")
    of_rest = marked.where(~is_hot).drop("_hot").join(groups.where(~hot).hint("merge"), key)
    return of_hot.unionByName(of_rest.select(*of_hot.columns))
