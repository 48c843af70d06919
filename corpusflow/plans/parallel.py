"""Clean a parallel corpus.

Per pair, the first failing rule is the reject reason, in this order:
``invalid`` (null translation value) -> ``empty`` -> ``dup`` (pair already
accepted from an earlier row) -> ``length`` -> ``ratio`` -> ``lang`` -> ``numbers``.

Every rule is a function of the cleaned pair (or of per-row label columns), so
"first accepted row wins" equals *filter, then keep the first row per pair
hash*: one shuffle, keyed by the hash, with a partial aggregate in front.
Language ID by a text-only model runs after that dedup, on survivors that are
already partitioned by the hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import clean_text, count_numbers, let, word_count
from corpusflow.operators.dedup import first_per_key
from corpusflow.operators.filters import (MAX_RATIO, MAX_WORDS, MIN_WORDS, pair_length_ok,
                                          pair_ratio_ok)
from corpusflow.operators.langid import THRESHOLD, LabelColumnLid, lenient_reject
from corpusflow.operators.pairs import resolve_pairs, restore_structure
from corpusflow.sources.readers import read_snapshot, write_snapshot
from corpusflow.sources.shards import expand_jsonl

REASONS = ("invalid", "empty", "dup", "length", "ratio", "lang", "numbers")
_INTERNAL = {"_src", "_tgt", "_valid", "_s", "_t", "_ws", "_wt", "_reason0", "_h", "_o"}


def _prepare(df: DataFrame, src_lang: str, tgt_lang: str, whitelist: bool,
             min_words: int, max_words: int, max_ratio: float, cleaned: bool = False) -> DataFrame:
    if "translation" not in df.columns and "jsonl" in df.columns:
        df = expand_jsonl(df, src_lang, tgt_lang)
    r = resolve_pairs(df, src_lang, tgt_lang)
    if cleaned:
        r = r.withColumnsRenamed({"_src": "_s", "_tgt": "_t"})
    else:
        r = (r.withColumn("_s", clean_text("_src", src_lang if whitelist else None))
              .withColumn("_t", clean_text("_tgt", tgt_lang if whitelist else None))
              .drop("_src", "_tgt"))
    # a filter on the reason would count the words anew for each time they are named
    cheap = let(F.struct(word_count("_s").alias("s"), word_count("_t").alias("t")), lambda w: (
        F.when(~F.col("_valid"), "invalid")
         .when((F.col("_s") == "") | (F.col("_t") == ""), "empty")
         .when(~pair_length_ok(w.s, w.t, min_words, max_words), "length")
         .when(~pair_ratio_ok(w.s, w.t, max_ratio), "ratio")))
    return r.withColumn("_reason0", cheap)


def _lid_columns(df: DataFrame, lid, key: Sequence[str]) -> DataFrame:
    """Label/score per side; the cleaned sides are the text columns ``_s``/``_t``."""
    if hasattr(lid, "annotate_all"):
        return lid.annotate_all(df, {"_ls": "_s", "_lt": "_t"}, key)
    df = lid.annotate(df, "_s", key, prefix="_ls")
    return lid.annotate(df, "_t", key, prefix="_lt")


def _lid_reject(src_lang: str, tgt_lang: str, threshold: float):
    return (lenient_reject("_ls_label", "_ls_score", src_lang, threshold)
            | lenient_reject("_lt_label", "_lt_score", tgt_lang, threshold))


def _order(df: DataFrame, order_cols: Sequence[str] | None) -> list[str]:
    """The order columns given, or by default those of the input: ``row_id``, and for
    packed shards the shard (its ``row_id``, or else key) with ``line_no``."""
    if order_cols is not None:
        return list(order_cols)
    if "jsonl" in df.columns:
        return ["row_id" if "row_id" in df.columns else "__key__", "line_no"]
    return ["row_id"]


def clean_parallel(df: DataFrame, src_lang: str, tgt_lang: str, lid=None,
                   order_cols: Sequence[str] | None = None, whitelist: bool = True,
                   min_words: int = MIN_WORDS, max_words: int = MAX_WORDS,
                   max_ratio: float = MAX_RATIO, threshold: float = THRESHOLD,
                   expect: tuple[str, str] | None = None, dedup: str = "gather",
                   cleaned: bool = False) -> DataFrame:
    """Accepted pairs. ``translation`` is replaced by the cleaned
    ``struct<src_lang, tgt_lang>``; every other input column is kept.
    ``expect`` overrides the labels the LID rule expects per side (default:
    the two language codes); ``dedup`` is the form of :func:`first_per_key`; texts that are
    ``cleaned`` already (``clean_text`` of the side's language) aren't cleaned again."""
    if expect:
        src_lang_lid, tgt_lang_lid = expect
    else:
        src_lang_lid, tgt_lang_lid = src_lang, tgt_lang
    order_cols = _order(df, order_cols)
    base = _prepare(df, src_lang, tgt_lang, whitelist, min_words, max_words, max_ratio, cleaned)
    out_cols = [c for c in base.columns if c not in _INTERNAL and c != "translation"]
    ok = base.where(F.col("_reason0").isNull() & (count_numbers("_s") == count_numbers("_t")))
    per_row_lid = isinstance(lid, LabelColumnLid)
    if lid is not None and per_row_lid:
        ok = _lid_columns(ok, lid, list(order_cols)).where(
            ~_lid_reject(src_lang_lid, tgt_lang_lid, threshold))
    ok = ok.withColumn("_h", F.md5(F.concat("_s", F.lit("\t"), "_t")))
    ok = ok.select(*out_cols, "_s", "_t", "_h")
    firsts = first_per_key(ok, "_h", order_cols, method=dedup)
    if lid is not None and not per_row_lid:
        firsts = _lid_columns(firsts, lid, ["_h"]).where(
            ~_lid_reject(src_lang_lid, tgt_lang_lid, threshold))
    firsts = restore_structure(firsts, "_s", "_t", src_lang, tgt_lang)
    return firsts.select(*out_cols, "translation")


def clean_report_parallel(df: DataFrame, src_lang: str, tgt_lang: str, lid=None,
                          order_cols: Sequence[str] | None = None, whitelist: bool = True,
                          min_words: int = MIN_WORDS, max_words: int = MAX_WORDS,
                          max_ratio: float = MAX_RATIO,
                          threshold: float = THRESHOLD,
                          expect: tuple[str, str] | None = None) -> DataFrame:
    """D3 (pairs): one row with ``total`` and a count per reason plus ``kept``.

    A row is ``dup`` only if an earlier row with its hash was accepted, so
    repeated rejects keep their own reason.

    Text-based (or no) language ID: every rule is a function of the cleaned
    pair, so all rows of one hash share a verdict. One pass, one shuffle of
    (hash, reason, count), no text. Per-row label columns: verdicts may differ inside a
    hash, so the first accepted order key per hash (partial aggregate) is
    joined back on the narrow rows (AQE splits a hot hash)."""
    src_lid, tgt_lid = expect or (src_lang, tgt_lang)
    order_cols = _order(df, order_cols)
    base = _prepare(df, src_lang, tgt_lang, whitelist, min_words, max_words, max_ratio)
    base = base.withColumn("_h", F.md5(F.concat("_s", F.lit("\t"), "_t")))
    if lid is None or getattr(lid, "text_only", False):
        # Every rule is known per row: aggregate counts only (hash aggregate), no texts.
        lid_bad = F.lit(False)
        if lid is not None:  # pairs that are rejected already aren't scored
            open_ = F.col("_reason0").isNull()
            base = base.withColumn("_s", F.when(open_, F.col("_s"))).withColumn("_t", F.when(open_, F.col("_t")))
            base = _lid_columns(base, lid, order_cols)
            lid_bad = F.coalesce(_lid_reject(src_lid, tgt_lid, threshold), F.lit(False))
        r1 = F.when(F.col("_reason0").isNotNull(), F.col("_reason0")).when(lid_bad, "lang").when(
            count_numbers("_s") != count_numbers("_t"), "numbers")
        rk = base.select("_h", F.coalesce(r1, F.lit("ok")).alias("_rk"))
        g = rk.groupBy("_h", "_rk").agg(F.count(F.lit(1)).alias("_n"))
        r = g.select("_n", F.when(F.col("_rk") != "ok", F.col("_rk")).alias("reason"))
        return r.agg(
            F.sum("_n").cast("long").alias("total"),
            *[F.coalesce(F.sum(F.when(F.col("reason") == x, F.col("_n"))), F.lit(0)).cast("long").alias(x)
              if x != "dup" else
              F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("_n") - 1)), F.lit(0)).cast("long").alias(x)
              for x in REASONS],
            F.coalesce(F.sum(F.when(F.col("reason").isNull(), 1)), F.lit(0)).cast("long").alias("kept"))
    order = F.struct(*[F.col(c) for c in order_cols])
    base = _lid_columns(base.withColumn("_o", order), lid, list(order_cols))
    rows = base.select("_h", "_o", "_reason0",
                       _lid_reject(src_lid, tgt_lid, threshold).alias("_lid_bad"), "_s", "_t")
    rows = rows.withColumn(
        "_reason1",
        F.when(F.col("_reason0").isNotNull(), F.col("_reason0"))
         .when(F.col("_lid_bad"), "lang")
         .when(count_numbers("_s") != count_numbers("_t"), "numbers")).drop("_s", "_t")
    # empty and invalid pairs share one hash and can't be duplicates: they don't join
    early = F.coalesce(F.col("_reason1").isin("invalid", "empty"), F.lit(False))
    first_ok = rows.where(F.col("_reason1").isNull()).groupBy("_h").agg(F.min("_o").alias("_first"))
    joined = rows.where(~early).join(first_ok, "_h", "left").select("_o", "_first", "_reason1").unionByName(
        rows.where(early).select("_o", F.lit(None).cast(rows.schema["_o"].dataType).alias("_first"), "_reason1"))
    reason = (F.when(F.col("_first").isNotNull() & (F.col("_o") > F.col("_first")), "dup")
               .when(F.col("_reason1").isNull(), "kept")
               .otherwise(F.col("_reason1")))
    r = joined.select(reason.alias("reason"))
    return r.agg(F.count(F.lit(1)).alias("total"),
                 *[F.sum(F.when(F.col("reason") == x, 1).otherwise(0)).cast("long").alias(x)
                   for x in REASONS + ("kept",)])


def clean_pairs_snapshot(spark: SparkSession, source: str, target: str, src_lang: str, tgt_lang: str,
                         **options) -> dict[str, int]:
    """C2 from snapshot to snapshot: returns the row counts before and after, observed
    while the one job that writes the target runs."""
    before, after = Observation("before"), Observation("after")
    raw = read_snapshot(spark, source).observe(before, F.count(F.lit(1)).alias("n"))
    out = clean_parallel(raw, src_lang, tgt_lang, **options).observe(after, F.count(F.lit(1)).alias("n"))
    write_snapshot(out, target)
    return {"before": before.get["n"], "after": after.get["n"]}
