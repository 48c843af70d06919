"""Parallel-corpus schema shaping, resolved once on ``df.schema``.

Accepted layouts, tried in this order:

1. ``translation``: a struct (or map) keyed by language code;
2. flat columns named after the two languages;
3. flat generic columns ``src`` / ``tgt``;

anything else raises, naming the columns found.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import let

# Fixed value: the default task prefix of translation examples.
DEFAULT_PREFIX = "translate English to Bengali: "


def pair_columns(schema: T.StructType, src_lang: str, tgt_lang: str) -> tuple[Column, Column, Column]:
    """(source, target, valid) of the first accepted layout that ``schema`` has;
    a row is invalid if its ``translation`` value itself is null."""
    have = schema.fieldNames()
    if "translation" in have:
        value, kind = F.col("translation"), schema["translation"].dataType
        return _side(value, kind, src_lang), _side(value, kind, tgt_lang), value.isNotNull()
    for s, t in ((src_lang, tgt_lang), ("src", "tgt")):
        if s in have and t in have:
            return F.col(s), F.col(t), F.lit(True)
    raise ValueError(f"no pair of texts among the columns {', '.join(sorted(have))}: neither `translation` "
                     f"nor `{src_lang}` and `{tgt_lang}` nor `src` and `tgt`")


def _side(tr: Column, dtype: T.DataType, lang: str) -> Column:
    if isinstance(dtype, T.MapType):
        return F.element_at(tr, F.lit(lang))
    if isinstance(dtype, T.StructType):
        if lang in dtype.fieldNames():
            return tr.getField(lang).cast("string")
        return F.lit(None).cast("string")
    raise ValueError(f"`translation` must be a struct or map, got {dtype.simpleString()}")


def resolve_pairs(df: DataFrame, src_lang: str, tgt_lang: str,
                  src_out: str = "_src", tgt_out: str = "_tgt",
                  valid_out: str = "_valid") -> DataFrame:
    """B1 + B3: add raw ``src_out``/``tgt_out`` (null side -> '') and
    ``valid_out`` (false when the ``translation`` value itself is null)."""
    s, t, valid = pair_columns(df.schema, src_lang, tgt_lang)
    return (df.withColumn(src_out, F.coalesce(s.cast("string"), F.lit("")))
              .withColumn(tgt_out, F.coalesce(t.cast("string"), F.lit("")))
              .withColumn(valid_out, valid))


def pairs_from_translation(df: DataFrame, src_lang: str, tgt_lang: str) -> DataFrame:
    """Flatten any accepted layout to ``<src_lang>``, ``<tgt_lang>`` columns (B1+B3)."""
    layouts = [("translation",), (src_lang, tgt_lang), ("src", "tgt")]
    used = next((x for x in layouts if set(x) <= set(df.columns)), ())
    keep = [c for c in df.columns if c not in used and c != "translation"]
    r = resolve_pairs(df, src_lang, tgt_lang)
    return r.select(*keep, F.col("_src").alias(src_lang), F.col("_tgt").alias(tgt_lang),
                    F.col("_valid").alias("valid"))


def restore_structure(df: DataFrame, src_col: str, tgt_col: str, src_lang: str,
                      tgt_lang: str) -> DataFrame:
    """``translation`` becomes the cleaned struct; all other columns stay
    (raw flat language columns included)."""
    return df.withColumn("translation", F.struct(F.col(src_col).alias(src_lang),
                                                 F.col(tgt_col).alias(tgt_lang)))


def to_translation(df: DataFrame, src: str, tgt: str, src_lang: str = "en",
                   tgt_lang: str = "bn") -> DataFrame:
    """Pack two flat columns into the canonical ``translation`` struct."""
    return df.withColumn("translation", F.struct(F.col(src).alias(src_lang),
                                                 F.col(tgt).alias(tgt_lang))).drop(src, tgt)


def union_corpora(corpora: Sequence[tuple[str, DataFrame]], text_col: str = "text",
                  order_col: str = "row_id") -> DataFrame:
    """Concatenate corpora, first then second. Output ``corpus_no, lang,
    row_id, text``; the order is (``corpus_no``, ``row_id``) and ``idx`` is not
    materialised (no global numbering, no single-task sort)."""
    parts = []
    for i, (lang, df) in enumerate(corpora):
        parts.append(df.select(F.lit(i).alias("corpus_no"), F.lit(lang).alias("lang"),
                               F.col(order_col).cast("long").alias("row_id"),
                               F.col(text_col).alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_prefix(c, prefix: str | None = DEFAULT_PREFIX) -> Column:
    """Prepend the task prefix; empty/None means none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(prefix), c) if prefix else c


def adjacent_line_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        each: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs (line i, line i+1) of every text, split on ``\\n``: one narrow
    ``posexplode``, no shuffle. ``each`` is applied to the lines, once a line. Output
    ``<id_col>, line_no, src, tgt``."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    zipped = let(F.transform(lines, each) if each else lines, lambda x: F.zip_with(
        F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1),
        lambda a, b: F.struct(a.alias("src"), b.alias("tgt"))))
    return (df.select(F.col(id_col), zipped.alias("_pairs"))
              .select(id_col, F.posexplode("_pairs").alias("line_no", "p"))
              .select(id_col, F.col("line_no").cast("long").alias("line_no"), "p.src", "p.tgt"))


def conversation_pairs(conv: DataFrame, prompt_role: str = "user",
                       reply_role: str = "assistant") -> DataFrame:
    """Pairs (prompt turn t, reply turn t+1) of each conversation: an equi-join
    on the near-unique key (conv_id, turn), so no conversation, however long,
    lands in a single task. Output ``conv_id, turn, src, tgt``."""
    prompts = conv.where(F.col("role") == prompt_role).select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("src"))
    replies = conv.where(F.col("role") == reply_role).select(
        "conv_id", "turn", F.col("text").alias("tgt"))
    return prompts.join(replies, ["conv_id", "turn"], "inner").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "src", "tgt")
