"""Snapshot read and write.

A snapshot is a Parquet directory. Reads keep Catalyst's column pruning and
filter pushdown and add nothing to the scan. Only on request (``spread``) is a
scan with fewer splits than cores dealt out by a round-robin ``repartition``:
that is for the test tables, one file of one row group each.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when the input has too few splits."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def read_snapshot(spark: SparkSession, path: str, columns: list[str] | None = None,
                  parallel: bool = False) -> DataFrame:
    """Read a Parquet snapshot (optionally only ``columns``). ``parallel``
    deals out the rows of too few splits, at the price of a shuffle."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    return spread(df) if parallel else df


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
          parallel: bool = True) -> DataFrame:
    """One of the driver tables: ``<sf_dir>/<name>.parquet``."""
    return read_snapshot(spark, os.path.join(sf_dir, f"{name}.parquet"), columns, parallel)


def write_snapshot(df: DataFrame, path: str, mode: str = "errorifexists",
                   partition_by: list[str] | None = None,
                   max_records_per_file: int | None = None) -> str:
    """Write a snapshot. ``errorifexists`` by default: a snapshot is
    immutable. ``partition_by`` (e.g. ``dataset, config, split``) keeps splits
    from overwriting each other."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.parquet(path)
    return path


def write_split(df: DataFrame, root: str, dataset_name: str, config_name: str | None = None, split: str = "train",
                file_bytes: int | None = 128 << 20) -> str:
    """S2/S6 in one tree: ``root/dataset=/config=/split=``. Only the partition that is
    written is replaced (dynamic overwrite), so splits are ingested again one by one,
    and a filter on ``dataset``, ``config`` or ``split`` reads no other folder.
    ``file_bytes`` is the size to which files are evened out, by Spark's rebalancing of
    the shuffled bytes (None: rows are written where they are, without a shuffle)."""
    spark = df.sparkSession
    names = {"dataset": dataset_name, "config": config_name or "default", "split": split}
    if clash := sorted(set(names) & set(df.columns)):
        raise ValueError(f"columns of the data have the names of partitions: {clash}")
    out = df.select("*", *[F.lit(v).alias(k) for k, v in names.items()])
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size, None)
    try:
        if file_bytes:
            spark.conf.set(size, str(file_bytes))
            out = out.hint("rebalance")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(root)
    finally:
        if file_bytes:
            spark.conf.unset(size) if before is None else spark.conf.set(size, before)
    return root


def read_split(spark: SparkSession, root: str, dataset_name: str | None = None, config_name: str | None = None,
               split: str | None = None) -> DataFrame:
    """The splits of such a tree, all or those named (folders of others aren't read)."""
    # names stay strings, whatever they look like
    columns = spark.read.parquet(root).schema
    for f in columns.fields:
        if f.name in ("dataset", "config", "split"):
            f.dataType = T.StringType()
    df = spark.read.schema(columns).parquet(root)
    for name, value in (("dataset", dataset_name), ("config", config_name), ("split", split)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def snapshot_name(dataset_name: str, config_name: str | None = None,
                  split: str | None = "train", parallel: bool = False) -> str:
    """Folder name from dataset/config/split: ``/`` -> ``_``, parts joined by
    ``_``; the parallel form ends in ``_parallel`` and ignores the split."""
    name = dataset_name.replace("/", "_")
    if config_name:
        name += f"_{config_name}"
    name += "_parallel" if parallel else f"_{split}"
    return name
