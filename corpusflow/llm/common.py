"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word in the contracts: U+0020 and U+0009-U+000D.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of the test data, read by Spark only (any store)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def whole(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id`` and ``_text`` only (null text: empty), so that no other column of
    the input can clash with what an operator adds."""
    return df.select(F.col(id_col).cast("long").alias("_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def spaced(text: Column) -> Column:
    """The text with every word-ending white-space character as U+0020."""
    for ch in WORD_SPACE[1:]:
        text = F.replace(text, F.lit(ch), F.lit(" "))
    return text


def label_split(id_col: str, mod: int, rest: int) -> Column:
    """Whether crc32(id as text) mod ``mod`` is ``rest`` (the held-out fold)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == F.lit(rest)


#: A side of a join is broadcast if its rows take no more than this.
BROADCAST_BYTES = 64 << 20


def narrow(rows: DataFrame, row_bytes: int) -> DataFrame:
    """A written table of fixed-width rows, with a broadcast hint only if its counted
    size allows it; otherwise Spark shuffles and splits skewed keys."""
    return F.broadcast(rows) if rows.count() * row_bytes <= BROADCAST_BYTES else rows


def with_labels(docs: DataFrame, labels: DataFrame, row_bytes: int = 32) -> DataFrame:
    """Inner join on ``_id`` of texts with a table of labels, one per id: of several the greatest."""
    one = labels.where("_id is not null").groupBy("_id").agg(F.max("_label").alias("_label"))
    return docs.join(narrow(one, row_bytes), "_id")


def hash_sample(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most ``n`` rows, those of the least hash of ``columns``, equal ones once. The
    rows are counted and thinned to about 2 * n by their hash where they are, so no
    task ever gathers more, however many partitions there are."""
    total = df.count()
    df = df.withColumn("_h", F.xxhash64(*columns))
    if total > 4 * n:
        df = df.where(F.col("_h") < int(-(1 << 63) + (1 << 64) * (2 * n / total)))
    return df.dropDuplicates(["_h"]).orderBy("_h").limit(n).drop("_h")
