"""K1-K3: first rows, seeded train/validation split, evaluation-set choice.

The split ranks rows by a seeded hash ``h = md5("<seed>:<row_id>")`` (first 60
bits), ties broken by ``row_id``. The validation side is exactly the
``ceil(n * fraction)`` lowest ranks - the size rule of the common
``train_test_split``. The permutation itself cannot equal that library's; the
contract kept is: seeded, disjoint, exhaustive, exact size.

Exact rank threshold without a global sort or single-task window: a radix
select over the 60-bit hash, 15 bits per level. Each level is one partial
aggregate returning at most 32,768 bucket counts to the driver, so driver
traffic is bounded by the bucket count, never by the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialize

HASH_BITS = 60
LEVEL_BITS = 15


#: Up to so many rows are gathered in one task; more are selected where they are.
GATHERED = 100_000


def head_n(df: DataFrame, n: int | None, order_cols: Sequence[str] = ("row_id",), gathered: int = GATHERED) -> DataFrame:
    """K1: first ``n`` rows in corpus order. None means all rows, 0 none.

    Up to ``gathered`` rows: TakeOrdered (top-n per partition, then a merge), in order.
    Beyond it, the n-th key is found and rows up to it are a filter, in no order: keys
    alone are range-partitioned and sorted where they are, one count per task tells in
    which one the n-th key lies, and its place there names it. Of rows that tie with
    the n-th key, as many as are needed stay."""
    if n is None:
        return df
    order = [F.col(c) for c in order_cols]
    if n <= gathered:
        return df.orderBy(*order).limit(n)
    keys = df.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("k"))
    # the place of the row deals out keys that are equal
    keys = keys.withColumn("_row", F.monotonically_increasing_id())
    keys = keys.repartitionByRange("k", "_row").sortWithinPartitions("k", "_row").select("k")
    keys = materialize(keys.withColumn("_m", F.monotonically_increasing_id()), "head-keys")
    runs = keys.groupBy(F.shiftright("_m", 33).alias("task")).agg(F.min("_m").alias("first"), F.count(F.lit(1)).alias("n")) \
        .orderBy("task").collect()  # a row per task
    before = 0
    for r in runs:
        if before + r["n"] >= n:
            break
        before += r["n"]
    else:
        return df  # there are no more than n
    last = keys.where(F.col("_m") == r["first"] + n - before - 1).select("k").first()["k"]  # one row
    bound = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in keys.schema["k"].dataType])
    mine = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    less, ties = keys.agg(F.count(F.when(F.col("k") < bound, 1)), F.count(F.when(F.col("k").eqNullSafe(bound), 1))).first()
    if ties == n - less:
        return df.where(mine <= bound)
    return df.where(mine < bound).unionAll(df.where(mine.eqNullSafe(bound)).limit(n - less))


def split_hash(row_id, seed: int) -> Column:
    """60-bit seeded hash of the row id, as a non-negative long."""
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    hexs = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), rid.cast("string"))), 1, HASH_BITS // 4)
    return F.conv(hexs, 16, 10).cast("long")


def _kth(df: DataFrame, k: int) -> tuple[int, int]:
    """(h*, r*) such that exactly k rows have (h, row_id) <= (h*, r*);
    ``df`` has columns ``_h`` and ``_r``; 1 <= k <= count."""
    remaining = k
    prefix = 0
    cond = None
    shift = HASH_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        sub = df if cond is None else df.where(cond)
        bucket = F.shiftright("_h", shift).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))
        counts = sub.groupBy(bucket.alias("b")).count().orderBy("b").collect()
        cum = 0
        chosen = None
        for r in counts:
            if cum + r["count"] >= remaining:
                chosen = r["b"]
                break
            cum += r["count"]
        remaining -= cum
        prefix = (prefix << LEVEL_BITS) | int(chosen)
        cond = F.shiftright("_h", shift) == F.lit(prefix)
    # Rows sharing the full hash (md5 collisions only): order by row id.
    ties = (df.where(F.col("_h") == F.lit(prefix)).select("_r").orderBy("_r")
              .limit(remaining).collect())
    return prefix, ties[-1]["_r"]


def train_val_split(df: DataFrame, fraction: float = 0.01, seed: int = 42,
                    row_id: str = "row_id", exact: bool = True,
                    split_col: str = "split") -> DataFrame:
    """K2: add ``split`` = ``validation`` | ``train``.

    ``exact=True``: validation size is exactly ``ceil(n * fraction)`` (one count
    plus four small bucket-count jobs). ``exact=False``: one narrow pass,
    validation iff the hash falls below ``fraction * 2**60`` (size ~ n*fraction)."""
    if not (0 < fraction < 1):
        raise ValueError("fraction must be in (0, 1)")
    h = split_hash(row_id, seed)
    if not exact:
        limit = int(fraction * (1 << HASH_BITS))
        return df.withColumn(split_col, F.when(h < F.lit(limit), "validation").otherwise("train"))
    keyed = df.select(h.alias("_h"), F.col(row_id).alias("_r"))
    n = keyed.count()
    k = math.ceil(n * fraction)
    if k == 0:
        return df.withColumn(split_col, F.lit("train"))
    if k == n:
        raise ValueError(f"{n} row(s) and a fraction of {fraction} leave no training rows")
    hk, rk = _kth(keyed, k)
    val = (h < F.lit(hk)) | ((h == F.lit(hk)) & (F.col(row_id) <= F.lit(rk)))
    return df.withColumn(split_col, F.when(val, "validation").otherwise("train"))


def choose_eval(train: DataFrame, eval_df: DataFrame | None = None, fraction: float = 0.01,
                seed: int = 42, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """K3: a given evaluation set replaces the split; otherwise split ``train``."""
    if eval_df is not None:
        return train, eval_df
    s = train_val_split(train, fraction, seed, row_id)
    return (s.where(F.col("split") == "train").drop("split"),
            s.where(F.col("split") == "validation").drop("split"))
