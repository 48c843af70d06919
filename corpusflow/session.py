"""Session helpers: a tuned local session for tests/bench, and the shared folder.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names (a
distributed filesystem path). Only a local-mode session without that setting
gets a private temporary folder, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


#: Spark's setting that deletes a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "corpusflow") -> SparkSession:
    master = master or os.environ.get("CORPUSFLOW_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Spill-aware sizing: AQE coalesces/splits shuffle output towards
        # ~128 MB partitions, and file scans split at the same size, so a task's
        # text fits executor memory at any scale factor.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        .config("spark.sql.files.maxPartitionBytes", "128m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORPUSFLOW_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.ansi.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, sub: str | None = None) -> str:
    """Folder visible to every executor, for checkpoints and written tables.

    Read from ``spark.checkpoint.dir``; if unset, only a local-mode session may
    fall back to a private temporary folder (tests, bench). ``sub`` gets a
    fresh unique child so concurrent jobs never collide.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="corpusflow-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    base = base.rstrip("/")
    if sub is None:
        return base
    return f"{base}/{sub}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str, codec: str | None = None):
    """Cut lineage by writing ``df`` as a Parquet table into the shared folder
    and reading it back. Computes the plan once (a reliable ``checkpoint()``
    computes it twice unless cached) and survives executor loss. ``codec`` is Parquet's
    compression, for tables of texts. The shuffle files of the plan are deleted once the
    table is there, not whenever the driver next collects garbage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    writer = df.write.mode("errorifexists")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        (writer.option("compression", codec) if codec else writer).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)


def discard(table) -> None:
    """Delete the files of a table that :func:`materialize` wrote and nothing that is
    still in use reads. Other tables, and other places, are left alone."""
    spark = table.sparkSession
    base = shared_dir(spark)
    fs = spark._jvm.org.apache.hadoop.fs
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path, root = fs.Path(folder), fs.Path(base)
        if path.toUri().getPath().startswith(root.toUri().getPath().rstrip("/") + "/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
