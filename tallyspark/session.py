"""Session helpers: building a local session for tests/bench, and locating the
shared scratch folder (``spark.checkpoint.dir``) used for landing files and for
cutting lineage.

Library operators never create sessions or set configuration; they take and
return DataFrames.  Only tests, ``bench.py`` and the rows-only registry entries
that land files call into this module.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster deployment is expected to carry as well; listed here so
# local runs plan the same way (AQE re-plans joins from runtime sizes, splits
# skewed partitions and coalesces small ones).
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Spark's setting that removes a query's shuffle files at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "tallyspark", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in {**CLUSTER_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``.  Only when it is unset in a single local process
    (tests) a fresh folder under the system temp dir is created and registered;
    on a cluster that folder would not be shared, so its absence is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unique folder below the shared checkpoint dir (never a
    machine-local temp folder when the cluster names one)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def freed_shuffles(spark: SparkSession, on: bool = True) -> Iterator[None]:
    """The shuffle files of a write go as soon as it ends, not when the driver
    happens to collect its garbage.  The session's setting holds again
    afterwards; Spark before 4.1 does not know it and keeps the files."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    try:
        if on:
            spark.conf.set(FREE_SHUFFLES, "true")
        yield
    finally:
        if on:
            spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def materialize(df: DataFrame, spark: SparkSession | None = None, label: str = "stage",
                free_shuffles: bool = False, **options: str) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet, with the writer's ``options``,
    into the shared folder and reading it back.  Survives executor loss (unlike
    local checkpoints).  ``free_shuffles``: :func:`freed_shuffles`."""
    spark = spark or df.sparkSession
    path = scratch_path(spark, label)
    with freed_shuffles(spark, free_shuffles):
        df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a ``materialize``d table that nothing reads any more."""
    sc = table.sparkSession.sparkContext
    for folder in {os.path.dirname(f) for f in table.inputFiles()}:  # as escaped URIs
        discard_folder(table.sparkSession, sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(folder)))


def discard_folder(spark: SparkSession, folder) -> None:
    """Delete a folder, a path or one of Hadoop's, that nothing reads any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder) if isinstance(folder, str) else folder
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so Python-side writers can use the path."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)
