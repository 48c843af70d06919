"""M2/M3: dataset inspection as DataFrames (no console formatting).

``inspect_sample``: the row count and the first ``num_samples`` rows, one
output row per (sample, field) with values truncated for display.
``raw_vs_clean``: raw and cleaned row counts of several corpora side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import truncate_display
from corpusflow.operators.sample import head_n


def inspect_sample(df: DataFrame, name: str, num_samples: int = 3,
                   order_cols: Sequence[str] = ("row_id",)) -> DataFrame:
    """Columns ``dataset, total, sample_no, field, value``. The total is one
    aggregate; the samples are a TakeOrdered of ``num_samples`` rows."""
    if num_samples is None or num_samples < 0:
        raise ValueError("num_samples must be 0 or more")
    fields = df.columns
    first = head_n(df, num_samples, order_cols)
    w_order = [F.col(c) for c in order_cols]
    # row_number over the <= num_samples rows of the TakeOrdered only.
    kv = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
                   for c in fields])
    from pyspark.sql import Window
    numbered = first.withColumn("sample_no", F.row_number().over(Window.orderBy(*w_order)).cast("long"))
    rows = numbered.select("sample_no", F.explode(kv).alias("kv")).select(
        "sample_no", "kv.field", truncate_display(F.col("kv.value")).alias("value"))
    total = df.count()
    return rows.select(F.lit(name).alias("dataset"), F.lit(total).cast("long").alias("total"),
                       "sample_no", "field", "value")


def inspect_path(spark: SparkSession, path: str, name: str, num_samples: int = 3,
                 order_cols: Sequence[str] = ("row_id",)) -> DataFrame:
    """As :func:`inspect_sample` of a snapshot; an absent one gives a single row with
    a null total and the field ``missing`` (its path is the value)."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(1).select(F.lit(name).alias("dataset"), F.lit(None).cast("long").alias("total"),
                                     F.lit(0).cast("long").alias("sample_no"), F.lit("missing").alias("field"),
                                     F.lit(path).alias("value"))
    return inspect_sample(df, name, num_samples, order_cols)


def raw_vs_clean(pairs: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """One row per corpus: ``corpus, raw_rows, clean_rows, kept_pct``."""
    parts = []
    for name, raw, clean in pairs:
        r = raw.select(F.lit(name).alias("corpus"), F.lit(1).alias("r"), F.lit(0).alias("c"))
        c = clean.select(F.lit(name).alias("corpus"), F.lit(0).alias("r"), F.lit(1).alias("c"))
        parts += [r, c]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    agg = u.groupBy("corpus").agg(F.sum("r").cast("long").alias("raw_rows"),
                                  F.sum("c").cast("long").alias("clean_rows"))
    return agg.withColumn("kept_pct", F.round(F.col("clean_rows") * 100.0 /
                                              F.nullif(F.col("raw_rows"), F.lit(0)), 2))
