"""Exact deduplication, first row (in the corpus order) wins.

Spark has no implicit row order, so "first" is the minimum of explicit order
columns (``row_id``, or e.g. ``doc_id, line_no``). ``dropDuplicates`` is not used: it
keeps an arbitrary row. Two forms give the same rows:

* ``gather``: a single ``groupBy(key).agg(min_by(payload, order))``. The aggregate is
  partial (map-side), so a hot key holding a third of all rows is reduced to one row
  per map task before the shuffle; the payload moves once. One pass over the input,
  which suits rows that are costly to compute.
* ``filter``: two passes, and no payload moves. The first one shuffles (key, order)
  only, and writes the first row's order for every key that occurs more than once:
  one small row for a group of any size. The second pass drops the losers where they
  are, by an outer join with that table, broadcast. Should the table be larger than
  ``MAX_BROADCAST_BYTES`` (counted), the rows are gathered after all. The order
  columns must tell rows of a key apart; rows that tie would all stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialize

# Keys of repeated rows are broadcast only if they take no more bytes than this.
MAX_BROADCAST_BYTES = 256 << 20


def first_per_key(df: DataFrame, key: str, order_cols: Sequence[str],
                  keep_key: bool = True, method: str = "gather") -> DataFrame:
    """One row per distinct ``key``: the row with the smallest ``order_cols``.

    Output columns keep ``df``'s order. Null keys are one group, like any value. With
    ``gather`` the result is hash-partitioned by ``key``; with ``filter`` rows stay in
    their partitions.
    """
    if method not in ("gather", "filter"):
        raise ValueError(f"no such form of deduplication: {method}")
    order_cols = list(order_cols)
    if method == "filter" and (kept := _filtered(df, key, order_cols)) is not None:
        return kept if keep_key else kept.drop(key)
    payload = [c for c in df.columns if c not in order_cols and c != key]
    packed = F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in payload])
    # only the order columns are compared, so a payload may hold maps
    out = df.groupBy(key).agg(F.min_by(packed, F.struct(*[F.col(c) for c in order_cols])).alias("_first"))
    cols = [F.col(f"_first.{c}").alias(c) if c != key else F.col(key)
            for c in df.columns]
    res = out.select(*cols)
    return res if keep_key else res.drop(key)


def _filtered(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame | None:
    """Rows that are the first of their key; None if too many keys are repeated."""
    order = F.col(order_cols[0]) if len(order_cols) == 1 else F.struct(*[F.col(c) for c in order_cols])
    repeated = df.groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = materialize(repeated.where("_n > 1").select("_k", "_first"), "dedup-repeated")
    if repeated.count() * (64 + 24 * len(order_cols)) > MAX_BROADCAST_BYTES:
        return None
    joined = df.join(F.broadcast(repeated), df[key].eqNullSafe(F.col("_k")), "left")
    return joined.where(F.col("_first").isNull() | order.eqNullSafe(F.col("_first"))).select(*df.columns)


def dedup_exact(df: DataFrame, text_col: str = "text",
                order_cols: Sequence[str] = ("row_id",), method: str = "filter") -> DataFrame:
    """Keep the first row of each distinct text (MD5 of its UTF-8 bytes)."""
    keyed = df.withColumn("_h", F.md5(F.col(text_col)))
    return first_per_key(keyed, "_h", order_cols, keep_key=False, method=method)


def dedup_pairs(df: DataFrame, src_col: str, tgt_col: str,
                order_cols: Sequence[str] = ("row_id",), method: str = "filter") -> DataFrame:
    """Keep the first row of each distinct (src, tgt) pair (MD5 of src TAB tgt)."""
    keyed = df.withColumn("_h", F.md5(F.concat(F.col(src_col), F.lit("\t"), F.col(tgt_col))))
    return first_per_key(keyed, "_h", order_cols, keep_key=False, method=method)
