"""Incremental landing-zone ingest, each file once.

The reference keeps a registry of file names and skips a file already
registered.  Here Structured Streaming's file source tracks processed files in
its checkpoint, ``trigger(availableNow=True)`` drains what has landed and
stops, and every micro-batch goes through ``foreachBatch``.

A batch becomes visible by one atomic step.  Its rows, its rejects and the
paths of its files are written to folders of names that nothing else uses;
then one manifest that names them is moved to the next number of the log, which
fails if that number is taken.  Readers and the registry take only folders that
a manifest names.  So whatever write a crash falls between, and in whatever
batches, on whatever day and with whatever checkpoint the files come again,
each file's rows are there once: a batch without a manifest was never there,
and files of a batch with one are known.  Folders without a manifest are litter
that :func:`uncommitted` lists."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import new_files_only
from ..session import materialize

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
ROWS, REJECTS, FILES = "rows", "rejects", "files"


class Conflict(RuntimeError):
    """Another writer has taken the next number of the log."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, target: str) -> list[dict[str, str]]:
    """What each committed batch wrote (part -> folder below ``target``), in the order of the commits."""
    jvm, log, fs = _hadoop(spark, f"{target}/log")
    if not fs.exists(log):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(log) if s.getPath().getName().endswith(".json"))
    if not names:
        return []
    lines = spark.read.text([f"{target}/log/{n}" for n in names], wholetext=True).select(
        F.col("_metadata.file_name").alias("name"), "value").collect()
    return [json.loads(r.value) for r in sorted(lines, key=lambda r: r.name)]


def committed(spark: SparkSession, target: str, part: str = ROWS, schema: T.StructType | str | None = None) -> DataFrame:
    """The rows (or rejects, or files) of all committed batches; with none of them an empty table of ``schema``."""
    folders = [f"{target}/{m[part]}" for m in manifests(spark, target) if part in m]
    if folders:
        return spark.read.parquet(*folders)
    if schema is None:
        raise FileNotFoundError(f"nothing is committed to {target}/{part}")
    return spark.createDataFrame([], schema)


def uncommitted(spark: SparkSession, target: str) -> list[str]:
    """Data folders that no manifest names: of batches that did not end, or that are being written."""
    jvm, data, fs = _hadoop(spark, f"{target}/data")
    known = {folder for m in manifests(spark, target) for folder in m.values()}
    found = [f"data/{s.getPath().getName()}" for s in fs.listStatus(data)] if fs.exists(data) else []
    return sorted(f for f in found if f not in known)


def _write(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def _commit(spark: SparkSession, target: str, number: int, manifest: dict[str, str]) -> None:
    jvm, staged, fs = _hadoop(spark, f"{target}/staged/{uuid.uuid4().hex}")
    final = jvm.org.apache.hadoop.fs.Path(f"{target}/log/{number:012d}.json")
    fs.mkdirs(final.getParent())
    out = fs.create(staged)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    none = spark.sparkContext._gateway.new_array(rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    try:
        context.rename(fs.makeQualified(staged), fs.makeQualified(final), none)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            raise Conflict(f"batch {number} of {target} is taken") from e
        raise


def commit_batch(batch: DataFrame, target: str, read: Callable[[list[str]], DataFrame],
                 transform: Callable | None = None) -> bool:
    """Append the rows of those files of a batch (``source_path``) that are not committed.  ``read`` gives the rows of a
    list of files; ``transform`` the rows to write, or (rows, rejects).  Files are told apart before any is opened, so a
    replay costs no reading; rows that feed two parts are read from their files once.  False if no file is new."""
    spark = batch.sparkSession
    before = manifests(spark, target)
    registry = committed(spark, target, FILES, "source_path string")
    name = uuid.uuid4().hex
    manifest = {FILES: f"data/{name}-{FILES}"}
    _write(new_files_only(batch.select("source_path").distinct(), registry, "source_path"), f"{target}/{manifest[FILES]}")
    files = [r.source_path for r in spark.read.schema("source_path string").parquet(f"{target}/{manifest[FILES]}").collect()]
    if not files:
        return False
    rows = read([_readable(f) for f in sorted(files)])
    out = transform(rows) if transform else rows.withColumn("file_name", F.col("source_file"))
    if isinstance(out, tuple):
        out = transform(materialize(rows, spark, "batch"))
    for part, df in zip((ROWS, REJECTS), out if isinstance(out, tuple) else (out,), strict=False):
        manifest[part] = f"data/{name}-{part}"
        _write(df, f"{target}/{manifest[part]}")
    _commit(spark, target, len(before), manifest)
    return True


def _readable(file_path: str) -> str:
    """The path that a reader takes for a ``_metadata.file_path``, which is encoded; readers expand patterns."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(file_path))


def ingest_files(spark: SparkSession, source_dir: str, fmt: str, schema: T.StructType, target: str,
                 checkpoint: str, transform: Callable | None = None,
                 options: dict | None = None,
                 max_files_per_trigger: int | None = None) -> int:
    """Drain newly landed files of ``source_dir`` into the table folder
    ``target`` (read it by :func:`committed`).  Returns the number of
    micro-batches run.  ``transform`` cleans/types one batch (e.g.
    ``bank_rows``) into rows, or into (rows, rejects); it gets the columns of
    the format plus ``source_file`` and ``s3_url`` (the source path)."""
    # the stream tells which files landed, and does not open them
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).options(**options or {})
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir).select(F.col("_metadata.file_path").alias("source_path"))
    batches = []

    def read(files: list[str]) -> DataFrame:
        return spark.read.format(fmt).schema(schema).options(**options or {}).load(files).select(
            "*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("s3_url"))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        commit_batch(batch, target.rstrip("/"), read, transform)
        batches.append(epoch_id)

    q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(batches)


def ingest_invoices(spark: SparkSession, source_dir: str, target: str, checkpoint: str, load_date=None,
                    max_files_per_trigger: int | None = None) -> int:
    """S1 as a stream: new invoice XML files into typed rows and rejects, both under one commit a batch."""
    from ..sources.invoices import INVOICE_SCHEMA, XML_OPTIONS, invoices

    def typed(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        good, bad = invoices(batch, load_date)
        return good, bad.select("s3_url", "source_file", "fiscal_uuid", F.col("_Folio").alias("folio"), "reject_reason")

    return ingest_files(spark, source_dir, "xml", INVOICE_SCHEMA, target, checkpoint, typed, XML_OPTIONS,
                        max_files_per_trigger)
