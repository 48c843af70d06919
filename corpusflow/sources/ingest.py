"""Ingest a monolingual or parallel source into a snapshot.

A source is any Spark file format (parquet, json, csv, text, orc). Rows get a
stable ``row_id`` once, at ingest: an existing key column if given, otherwise the
row's place in the corpus, counted from 0 over the files in order of their paths.
Errors raise.

Spark packs file splits by size, so scan order isn't file order. A row's place is
its place in its file (for Parquet the scan's own row index; for other formats its
rank within its file block) plus the rows of all files (blocks) before. Only one
count per file or block is summed up in order; the rows themselves aren't sorted,
and the first n rows are a filter on ``row_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.operators.pairs import pair_columns
from corpusflow.operators.sample import head_n
from corpusflow.session import shared_dir
from corpusflow.sources.readers import snapshot_name, write_snapshot, write_split


def read_source(spark: SparkSession, path: str, fmt: str = "parquet",
                options: dict | None = None, schema=None) -> DataFrame:
    r = spark.read.format(fmt).options(**(options or {}))
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def with_row_id(df: DataFrame, id_col: str | None = None, fmt: str = "parquet") -> DataFrame:
    """``df``, as read from its files, with ``row_id``."""
    if "row_id" in df.columns:
        return df
    if id_col:
        return df.withColumn("row_id", F.col(id_col).cast("long"))
    columns = df.columns
    place = [F.col("_metadata.file_path").alias("_f")]
    if fmt == "parquet":
        rows = df.select("*", *place, F.lit(0).cast("long").alias("_b"), F.col("_metadata.row_index").alias("_i"))
    else:
        rows = df.select("*", *place, F.col("_metadata.file_block_start").alias("_b"),
                         F.monotonically_increasing_id().alias("_m"))
        rank = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_m"))
        rows = rows.withColumn("_i", (rank - 1).cast("long")).drop("_m")
    sizes = df.select(*place, (F.lit(0) if fmt == "parquet" else F.col("_metadata.file_block_start"))
                      .cast("long").alias("_b")).groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per file or block
    starts = sizes.select("_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return rows.join(starts, ["_f", "_b"]).select(*columns, (F.col("_s") + F.col("_i")).alias("row_id"))


def _first(df: DataFrame, max_samples: int | None, counted: bool) -> DataFrame:
    """The first rows (0/None = all): by their number where it counts from 0."""
    if not max_samples:
        return df
    return df.where(F.col("row_id") < max_samples) if counted else head_n(df, max_samples)


def ingest(spark: SparkSession, source: str, dataset_name: str, config_name: str | None = None,
           split: str = "train", output_dir: str | None = None, fmt: str = "parquet",
           max_samples: int | None = None, id_col: str | None = None,
           options: dict | None = None, partitioned: bool = False) -> str:
    """S3: read ``source``, keep the first ``max_samples`` rows (0/None = all),
    write ``<output_dir>/<name>_<config>_<split>``; returns the path. ``partitioned``
    writes the split into the tree of ``write_split`` under ``output_dir`` instead."""
    raw = read_source(spark, source, fmt, options)
    df = _first(with_row_id(raw, id_col, fmt), max_samples, not id_col and "row_id" not in raw.columns)
    out = (output_dir or shared_dir(spark, "ingest")).rstrip("/")
    if partitioned:
        return write_split(df, out, dataset_name, config_name, split)
    path = f"{out}/{snapshot_name(dataset_name, config_name, split)}"
    return write_snapshot(df, path)


def ingest_parallel(spark: SparkSession, source: str, dataset_name: str,
                    config_name: str | None = None, src_lang: str = "en", tgt_lang: str = "bn",
                    output_dir: str | None = None, fmt: str = "parquet",
                    max_samples: int | None = None, id_col: str | None = None) -> str:
    """As :func:`ingest`, checking the pair layout on the schema first;
    the folder ends in ``_parallel``. An empty source raises."""
    raw = read_source(spark, source, fmt)
    df = with_row_id(raw, id_col, fmt)
    pair_columns(df.schema, src_lang, tgt_lang)
    if df.isEmpty():
        raise ValueError(f"parallel source {source} is empty")
    df = _first(df, max_samples, not id_col and "row_id" not in raw.columns)
    out = (output_dir or shared_dir(spark, "ingest")).rstrip("/")
    path = f"{out}/{snapshot_name(dataset_name, config_name, parallel=True)}"
    return write_snapshot(df, path)
