"""Clean a monolingual corpus.

Order of the rules (first failing one is the reject reason):
normalise -> URL strip -> whitelist -> collapse, then
``short`` (empty or < min_chars) -> ``dup`` (text seen in an earlier row that
passed the length rule) -> ``lang`` (strict LID on the first such row).

Plan: one narrow projection (all regex work, JVM-side; NFKC in Python only for
rows that can change), one shuffle for dedup keyed by the text hash, then the
LID verdict on survivors, which are already partitioned by that hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import clean_text
from corpusflow.operators.dedup import first_per_key
from corpusflow.operators.filters import MIN_MONO_CHARS, mono_length_ok
from corpusflow.operators.langid import THRESHOLD, LabelColumnLid, strict_keep
from corpusflow.sources.readers import read_snapshot, write_snapshot


def _cleaned(df: DataFrame, lang: str | None, text_col: str, whitelist: bool,
             min_chars: int) -> DataFrame:
    out = df.withColumn(text_col, clean_text(F.col(text_col), lang if whitelist else None))
    return out.withColumn("_ok_len", mono_length_ok(text_col, min_chars))


def clean_monolingual(df: DataFrame, lang: str, lid=None, text_col: str = "text",
                      order_cols: Sequence[str] = ("row_id",), whitelist: bool = True,
                      min_chars: int = MIN_MONO_CHARS,
                      threshold: float = THRESHOLD, dedup: str = "gather",
                      keep_text: bool = True) -> DataFrame:
    """Cleaned rows that pass every rule; all input columns kept, ``text`` replaced.
    ``dedup`` is the form of :func:`first_per_key`. Without ``keep_text`` the text is left
    out of the rows and of the shuffle; language labels must then be columns of the rows.

    ``lid``: a provider with ``annotate(df, text_col, key_cols, prefix)``
    (see ``operators.langid``), or None to skip language filtering."""
    if not (keep_text or lid is None or isinstance(lid, LabelColumnLid)):
        raise ValueError("language identification by text needs keep_text")
    cols = [c for c in df.columns if keep_text or c != text_col]
    cleaned = _cleaned(df, lang, text_col, whitelist, min_chars)
    passing = cleaned.where("_ok_len").select(*cols, F.md5(F.col(text_col)).alias("_h"))
    firsts = first_per_key(passing, "_h", order_cols, method=dedup)
    if lid is not None:
        firsts = lid.annotate(firsts, text_col, ["_h"], prefix="_lid")
        firsts = firsts.where(strict_keep("_lid_label", "_lid_score", lang, threshold))
    return firsts.select(*cols)


def clean_report_monolingual(df: DataFrame, lang: str, lid=None, text_col: str = "text",
                             order_cols: Sequence[str] = ("row_id",), whitelist: bool = True,
                             min_chars: int = MIN_MONO_CHARS,
                             threshold: float = THRESHOLD) -> DataFrame:
    """D3 (mono): one row ``total, short, dup, lang, kept``.

    One pass over the text and one narrow shuffle: rows are grouped by the
    hash of their cleaned text (short rows under a null key), carrying the
    count and the first row's order key and verdict, never the text."""
    cleaned = _cleaned(df, lang, text_col, whitelist, min_chars)
    rows = cleaned.withColumn("_h", F.when(F.col("_ok_len"), F.md5(F.col(text_col))))
    order = F.struct(*[F.col(c) for c in order_cols]) if len(order_cols) > 1 else F.col(order_cols[0])
    # the verdict is a column of the row, judged before grouping and taken from the first
    # row: fixed-width buffers only, so Spark can hash-aggregate and no text is shuffled
    if lid is None:
        rows = rows.withColumn("_v", F.lit(True))
    else:
        rows = lid.annotate(rows.withColumn(text_col, F.when(F.col("_ok_len"), F.col(text_col))), text_col,
                            list(order_cols), prefix="_lid")
        rows = rows.withColumn("_v", strict_keep("_lid_label", "_lid_score", lang, threshold))
    per_hash = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_rows"),
                                      F.min_by(F.coalesce("_v", F.lit(False)), order).alias("_v"))
    short, verdict = F.col("_h").isNull(), F.coalesce("_v", F.lit(False))
    total = lambda when, n, name: F.coalesce(F.sum(F.when(when, n)), F.lit(0)).cast("long").alias(name)
    return per_hash.agg(F.sum("_rows").cast("long").alias("total"), total(short, F.col("_rows"), "short"),
                        total(~short, F.col("_rows") - 1, "dup"), total(~short & ~verdict, 1, "lang"),
                        total(~short & verdict, 1, "kept"))


def clean_snapshot(spark: SparkSession, source: str, target: str, lang: str, **options) -> dict[str, int]:
    """C1 from snapshot to snapshot: returns the row counts before and after, observed
    while the one job that writes the target runs."""
    before, after = Observation("before"), Observation("after")
    raw = read_snapshot(spark, source).observe(before, F.count(F.lit(1)).alias("n"))
    out = clean_monolingual(raw, lang, **options).observe(after, F.count(F.lit(1)).alias("n"))
    write_snapshot(out, target)
    return {"before": before.get["n"], "after": after.get["n"]}
