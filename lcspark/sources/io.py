"""Scans, readers and writers.

Folders for intermediate files are taken from the cluster's shared
``spark.checkpoint.dir`` (see ``scratch_dir``), never from a machine-local
temporary folder.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lcspark.schema import METADATA_SCHEMA, OBSERVATION_SCHEMA, RUN_METRICS_SCHEMA
from lcspark.session import ensure_checkpoint_dir

__all__ = ["read_table", "read_observations_csv", "read_metadata_csv", "read_delimited",
           "write_table", "append_run", "create_if_absent", "compact_files", "recover_compaction", "log_run",
           "scratch_dir", "bucketed", "write_delimited", "write_csv", "read_with_rejects"]


def _is_path(name: str) -> bool:
    return "/" in name or name.startswith(".")


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A new folder under the shared checkpoint folder, removed when the
    application ends (its tables may be read until then)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/lcspark-{name}-{uuid.uuid4().hex[:12]}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def bucketed(df: DataFrame, path: str, keys, buckets: int, options: dict | None = None) -> DataFrame:
    """Write ``df`` below ``path`` in ``buckets`` buckets by ``keys``, each
    sorted by them, and read it back: the plan knows the buckets, so joins,
    groupings and look-ups by the keys need no exchange.  Input that is hashed
    by the keys into that many partitions already is written as it lies.  The
    catalog entry that carries the layout is dropped at once; the files
    stay as long as their folder."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    (df.write.format("parquet").options(**(options or {})).bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(name))
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def read_table(spark: SparkSession, name: str, columns=None, fmt: str = "parquet") -> DataFrame:
    """A catalog table or a Parquet path; with ``columns`` only those are
    read (column pruning reaches the scan's ReadSchema)."""
    df = spark.read.format(fmt).load(name) if _is_path(name) else spark.table(name)
    return df.select(*columns) if columns else df


def _csv_reader(spark: SparkSession, schema, options: dict):
    return spark.read.schema(schema).options(**options)


def read_with_rejects(spark: SparkSession, path: str, schema, options: dict, rejects: str) -> DataFrame:
    """Delimited text whose malformed rows (a value that is not of its
    column's type, too many or too few fields) go to a side table instead
    of stopping the job or turning into nulls: ``rejects`` gets one row for
    each, ``file`` and ``record`` (its text), appended as Parquet.  Rows in
    the files = rows returned + rows set aside.  The files are parsed whole,
    whatever columns are selected later, and the rows returned are read
    from a stored copy, so both sides come from one parse."""
    corrupt = "_record"
    wide = StructType([*schema.fields, StructField(corrupt, StringType())])
    parsed = (_csv_reader(spark, wide, {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt,
                                        "columnPruning": "false"})
              .csv(path).withColumn("_file", F.col("_metadata.file_path")))
    copy = scratch_dir(spark, "parsed")
    # one table of good and malformed rows: a table split by them would be sorted, a whole task's rows at a time
    parsed.write.parquet(copy)
    stored = spark.read.schema(StructType([*wide.fields, StructField("_file", StringType())])).parquet(copy)
    (stored.where(F.col(corrupt).isNotNull()).select(F.col("_file").alias("file"), F.col(corrupt).alias("record"))
     .write.mode("append").parquet(rejects))
    return stored.where(F.col(corrupt).isNull()).select(*[f.name for f in schema.fields])


def _read_text(spark: SparkSession, path: str, schema, options: dict, rejects: str | None, mode: str) -> DataFrame:
    if rejects is not None:
        return read_with_rejects(spark, path, schema, options, rejects)
    return _csv_reader(spark, schema, {**options, "mode": mode}).csv(path)


def read_observations_csv(spark: SparkSession, path: str, schema=OBSERVATION_SCHEMA, rejects: str | None = None) -> DataFrame:
    """Observation CSV with header and a declared schema (no inference).
    A malformed row stops the job, or goes to the side table ``rejects``."""
    return _read_text(spark, path, schema, {"header": "true"}, rejects, "FAILFAST")


def read_metadata_csv(spark: SparkSession, path: str, schema=METADATA_SCHEMA, rejects: str | None = None) -> DataFrame:
    """Metadata CSV; the text ``nan`` (distmod of galactic objects) is
    read as null.  Malformed rows as in ``read_observations_csv``."""
    return _read_text(spark, path, schema, {"header": "true", "nullValue": "nan"}, rejects, "FAILFAST")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", null_text: str = "") -> None:
    df.write.mode(mode).option("header", True).option("nullValue", null_text).csv(path)


# Hive's LazySimpleSerDe text layout: fields split by \x01, null as \N.
HIVE_FIELD_SEP = "\x01"
HIVE_NULL = "\\N"


def read_delimited(spark: SparkSession, path: str, schema, sep: str = HIVE_FIELD_SEP,
                   null_text: str = HIVE_NULL, rejects: str | None = None) -> DataFrame:
    """S3: delimited text as a Hive text table stores it.  A malformed row
    stops the job, or goes to the side table ``rejects``."""
    return _read_text(spark, path, schema, {"sep": sep, "header": "false", "nullValue": null_text}, rejects, "FAILFAST")


def write_delimited(df: DataFrame, path: str, sep: str = HIVE_FIELD_SEP,
                    null_text: str = HIVE_NULL, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", sep).option("nullValue", null_text).csv(path)


def write_table(df: DataFrame, name: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by=None) -> None:
    """Parquet table (catalog name or path), ``overwrite`` or ``append``."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if _is_path(name):
        w.save(name)
    else:
        w.saveAsTable(name)


def append_run(df: DataFrame, name: str, run_id: str, fmt: str = "parquet") -> None:
    """Append the rows of one run, at most once: the table is partitioned
    by ``run_id``, and writing a run replaces what an earlier (broken or
    complete) attempt of the same run wrote and nothing else."""
    spark = df.sparkSession
    rows = df.withColumn("run_id", F.lit(run_id))
    w = rows.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "dynamic")
    if _is_path(name):
        w.partitionBy("run_id").save(name)
    elif spark.catalog.tableExists(name):
        rows.select(*spark.table(name).columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(name)
    else:
        w.partitionBy("run_id").saveAsTable(name)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path.rstrip("/"))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def _claimed(spark: SparkSession, fs, claim) -> bool:
    """Makes the file ``claim``; of callers at the same time one gets True,
    the others False or an error.  Hadoop's create of a local file looks for
    the file first and makes it afterwards, so there it is Java's own, which
    is one step."""
    if fs.getUri().getScheme() != "file":
        fs.create(claim, False).close()
        return True
    claim = fs.makeQualified(claim)
    fs.mkdirs(claim.getParent())
    return spark._jvm.java.io.File(claim.toUri().getPath()).createNewFile()


def create_if_absent(df: DataFrame, name: str, fmt: str = "parquet") -> bool:
    """CREATE TABLE IF NOT EXISTS ... AS: a second call leaves the table
    as it is.  Returns whether this call made it.

    Of callers that run at the same time one wins: a claim beside the
    folder, made by a create that fails if it exists, decides before
    anything is written; the rows go to a folder of the claim's own and
    appear under the name by one rename, so no reader sees a part of them.
    A claim whose maker broke off is removed by hand (``<path>.claim``)."""
    spark = df.sparkSession
    if not _is_path(name):
        if spark.catalog.tableExists(name):
            return False
        try:
            df.write.mode("errorifexists").format(fmt).saveAsTable(name)
        except AnalysisException:
            if spark.catalog.tableExists(name):
                return False                         # another caller of this catalog was first
            raise
        return True
    fs, at = _file_system(spark, name)
    target, claim = at(name.rstrip("/")), at(f"{name.rstrip('/')}.claim")
    if fs.exists(target):
        return False
    try:
        if not _claimed(spark, fs, claim):
            return False
    except Exception as e:                           # noqa: BLE001  any failure but an existing claim is raised
        if fs.exists(claim) or fs.exists(target):
            return False
        raise e
    try:
        if fs.exists(target):                        # made and its claim removed since we looked
            return False
        made = f"{name.rstrip('/')}.making-{uuid.uuid4().hex[:12]}"
        df.write.format(fmt).save(made)
        if not fs.rename(at(made), target):
            raise OSError(f"could not rename {made} to {name}")
        return True
    finally:
        fs.delete(claim, False)


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below ``path`` (from the listing; no content is read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return int(files.agg(F.sum("length")).first()[0] or 0)


def compact_files(spark: SparkSession, src: str, dst: str, target_bytes: int = 2_684_354_560,
                  codec: str = "gzip", swap: bool = False) -> str:
    """Merge many small text files into ceil(bytes / ``target_bytes``)
    files and compress them.  The number comes from the input's size alone,
    not from the cluster's cores or the scan's splits, and the splits are
    joined without a shuffle.  The result goes to a new folder ``dst``; with
    ``swap`` it then takes the place of ``src``, whose old files move to
    ``dst`` (see ``recover_compaction``).  Returns the folder that holds the
    result."""
    recover_compaction(spark, src)
    files = max(1, -(-input_bytes(spark, src) // int(target_bytes)))
    spark.read.text(src).coalesce(files).write.mode("errorifexists").option("compression", codec).text(dst)
    if not swap:
        return dst
    fs, at = _file_system(spark, src)
    out = fs.create(at(_swap_marker(src)), False)
    made = next(f.getPath().getName() for f in fs.listStatus(at(dst)) if f.getPath().getName().startswith("part-"))
    out.write(bytearray(f"{dst.rstrip('/')}\n{made}".encode()))
    out.close()
    recover_compaction(spark, src)
    return src


def _swap_marker(src: str) -> str:
    return f"{src.rstrip('/')}.swap"


def recover_compaction(spark: SparkSession, src: str, step=lambda: None) -> bool:
    """Carry out, or finish, the swap of a compacted folder with its source:
    three renames (source aside, result to the source's place, old files to
    the result's) that a marker beside the source announces.  Which of them
    are done shows from the folders that exist and from a file of the result
    that the marker names, so a swap that broke off anywhere is completed by
    calling this again (``compact_files`` does).  Returns whether there was
    one.  ``step`` is called after each rename."""
    fs, at = _file_system(spark, src)
    marker = at(_swap_marker(src))
    if not fs.exists(marker):
        return False
    stream = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(marker), "UTF-8"))
    dst, part = stream.readLine(), stream.readLine()
    stream.close()
    source, made, aside = at(src.rstrip("/")), at(dst), at(f"{dst}.old")

    def rename(a, b):
        if not fs.rename(a, b):
            raise OSError(f"could not rename {a} to {b}")
        step()
    if not fs.exists(at(f"{src.rstrip('/')}/{part}")):
        if fs.exists(source):
            rename(source, aside)
        rename(made, source)
    if fs.exists(aside):
        rename(aside, made)
    fs.delete(marker, False)
    return True


def log_run(spark: SparkSession, metrics: dict, name: str) -> DataFrame:
    """Append one row: what ran, the nine settings of the session, and
    18 columns of elapsed and CPU seconds."""
    row = {f.name: None for f in RUN_METRICS_SCHEMA.fields}
    sc = spark.sparkContext
    conf = sc.getConf()
    dynamic = conf.get("spark.dynamicAllocation.enabled", "false") == "true"
    row.update({
        "run_id": metrics.get("run_id", uuid.uuid4().hex),
        "spark_master": sc.master,
        "app_id": sc.applicationId,
        "app_name": sc.appName,
        "executor_memory": conf.get("spark.executor.memory", "1g"),
        "executor_cores": conf.get("spark.executor.cores", None),
        "driver_memory": conf.get("spark.driver.memory", "1g"),
        "driver_cores": conf.get("spark.driver.cores", "1"),
        "default_parallelism": str(sc.defaultParallelism),
        "deploy_mode": conf.get("spark.submit.deployMode", "client"),
        "executor_instances": conf.get("spark.executor.instances", "dynamic" if dynamic else "1"),
    })
    for k, v in metrics.items():
        if k in row:
            f = RUN_METRICS_SCHEMA[k]
            row[k] = float(v) if f.dataType.typeName() == "double" and v is not None else v
    df = spark.createDataFrame([Row(**row)], RUN_METRICS_SCHEMA)
    write_table(df, name, mode="append")
    return df


class StageTimer:
    """Elapsed and CPU seconds of named stages, for ``log_run``."""

    def __init__(self):
        self.metrics: dict = {}

    def stage(self, name: str):
        timer = self

        class _Ctx:
            def __enter__(self):
                self.t0, self.c0 = time.time(), time.process_time()

            def __exit__(self, *exc):
                timer.metrics[f"{name}_elapsed"] = time.time() - self.t0
                timer.metrics[f"{name}_cpu"] = time.process_time() - self.c0
                return False

        return _Ctx()
