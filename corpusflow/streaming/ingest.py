"""Bounded streaming ingest with Structured Streaming.

``readStream`` over the source files -> ``row_id`` -> ``writeStream`` to a Parquet
sink with ``Trigger.AvailableNow``: every file present at start is processed (in
as many micro-batches as the rate limits give) and the query stops. The
checkpoint lives in the shared folder, so a restarted job resumes where it
stopped and never writes a file twice.

``row_id`` comes from a key column. A Parquet source without one is numbered in
order of arrival: batch after batch, and within a batch by file path and row. Such
batches are written by ``foreachBatch`` to a folder each, which a repeated batch
replaces. A ledger beside them has one row per batch, where it starts and ends: the
next batch reads the row of the one before it, never the data. Numbers are dense.

Deduplication (:func:`first_rows`) is a join per micro-batch: the first row of each key
of the batch, without the keys of earlier batches. Those are a table of hashes beside
the checkpoint, a folder per batch, which a repeated batch replaces like its rows. The
first row in order of arrival wins, within a batch the least order key. Fed in corpus
order, batch by batch, it gives the rows of the batch job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.operators.dedup import first_per_key
from corpusflow.session import shared_dir


def first_rows(batch: DataFrame, key, order_cols: Sequence[str], seen: DataFrame | None = None) -> DataFrame:
    """D1/D2 on a batch of a stream: a row for each value of the column ``key`` whose hash
    isn't in ``seen`` (``_h``), the least by ``order_cols``. Null keys are one group."""
    keyed = first_per_key(batch.withColumn("_h", _hash(key)), "_h", order_cols)
    if seen is not None:
        keyed = keyed.join(seen, "_h", "left_anti")
    return keyed.select(*batch.columns)


def _hash(key):
    return F.unhex(F.coalesce(F.md5(key), F.lit("")))


def stream_ingest(spark: SparkSession, source: str, schema, fmt: str = "parquet",
                  sink: str | None = None, checkpoint: str | None = None,
                  id_col: str | None = None, max_files_per_trigger: int | None = None,
                  timeout_s: float | None = None, max_samples: int | None = None,
                  dedup_col: str | None = None) -> str:
    """Materialise everything available under ``source`` into ``sink``; returns
    the sink path. ``max_samples`` keeps only the first n rows of the stream
    (a streaming global limit, in arrival order); 0/None means all. ``dedup_col`` keeps
    the first row of each of its values, over all batches of the checkpoint; it asks
    for ``row_id`` or ``id_col``, and its batches are folders ``batch=`` of the sink."""
    sink = sink or shared_dir(spark, "stream-sink")
    checkpoint = checkpoint or shared_dir(spark, "stream-ckpt")
    reader = spark.readStream.format(fmt).schema(schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        # The file source watches directories: watch the parent, admit one name.
        reader = reader.option("pathGlobFilter", path.getName())
        source = path.getParent().toString()
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream: DataFrame = reader.load(source)
    if id_col and "row_id" not in stream.columns:
        stream = stream.withColumn("row_id", F.col(id_col).cast("long"))
    numbered = fmt == "parquet" and "row_id" not in stream.columns
    if dedup_col:
        if "row_id" not in stream.columns:
            raise ValueError("deduplication of a stream needs row_id or id_col")
    if numbered:
        stream = stream.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    if max_samples and not dedup_col:
        stream = stream.limit(max_samples)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    if numbered:
        q = writer.foreachBatch(lambda batch, n: _write_numbered(batch, n, sink, bool(max_samples))).start()
    elif dedup_col:
        q = writer.foreachBatch(lambda batch, n: _write_first(batch, n, sink, checkpoint, dedup_col, max_samples)).start()
    else:
        q = writer.format("parquet").option("path", sink).start()
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming ingest did not finish in time")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return sink


def ledger(spark: SparkSession, sink: str) -> DataFrame:
    """``batch, first, next``: the numbers of every batch, next being the one behind it."""
    return spark.read.parquet(*[f"{sink}/_ledger/batch={n}" for n in range(_batches(spark, sink))])


def _batches(spark: SparkSession, sink: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/_ledger")
    return len(path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def _write_numbered(batch: DataFrame, n: int, sink: str, limited: bool) -> None:
    """Write batch ``n`` with row ids that follow those of the batch before."""
    spark = batch.sparkSession
    first = spark.read.parquet(f"{sink}/_ledger/batch={n - 1}").first()["next"] if n else 0
    columns = [c for c in batch.columns if c not in ("_f", "_i")]
    if limited:
        # a limit leaves gaps in a file's own row indexes: its rows are ranked
        rank = F.row_number().over(Window.partitionBy("_f").orderBy("_i"))
        batch = batch.persist().withColumn("_i", (rank - 1).cast("long"))
    files = batch.groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))  # a row per file
    before = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_f", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    rows = batch.join(files, "_f").select(*columns, (F.lit(first) + F.col("_s") + F.col("_i")).cast("long").alias("row_id"))
    rows.write.mode("overwrite").parquet(f"{sink}/batch={n}")
    size = files.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # the data is there when the ledger says so; a repeated batch replaces both
    spark.createDataFrame([(n, first, first + size)], "batch long, first long, next long") \
        .coalesce(1).write.mode("overwrite").parquet(f"{sink}/_ledger/batch={n}")


def _write_first(batch: DataFrame, n: int, sink: str, checkpoint: str, dedup_col: str, max_samples: int | None) -> None:
    """Write the rows of batch ``n`` whose key no earlier batch had, and then their hashes."""
    spark, seen = batch.sparkSession, f"{checkpoint}/seen"
    before = spark.read.schema("_h binary").parquet(*[f"{seen}/batch={i}" for i in range(n)]) if n else None
    rows = first_rows(batch, F.col(dedup_col), ["row_id"], before)
    if max_samples:
        rows = rows.orderBy("row_id").limit(max(0, max_samples - (before.count() if n else 0)))
    rows.write.mode("overwrite").parquet(f"{sink}/batch={n}")
    written = spark.read.schema(batch.schema).parquet(f"{sink}/batch={n}")
    written.select(_hash(F.col(dedup_col)).alias("_h")).write.mode("overwrite").parquet(f"{seen}/batch={n}")
