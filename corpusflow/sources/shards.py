"""B2: expand packed JSON-lines shards into one ``translation`` row per line.

Input rows carry ``jsonl`` (binary, or string) plus ``__key__``/``__url__``.
Bytes are decoded as UTF-8 with U+FFFD for bad sequences, split into lines
like Python's ``str.splitlines``, stripped, and parsed as JSON objects. Lines
that are blank, malformed, not an object, or miss either language are dropped.
Everything is one narrow ``posexplode``: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import strip_ws

# The line boundaries of Python's str.splitlines
# (CR LF, LF, CR, VT, FF, FS, GS, RS, NEL, LINE SEPARATOR, PARAGRAPH SEPARATOR).
SPLITLINES = "\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}\\x{1d}\\x{1e}\\x{85}\\x{2028}\\x{2029}]"


def decoded_text(c) -> "F.Column":
    """Binary -> string with U+FFFD for invalid UTF-8 (never raises)."""
    return F.make_valid_utf8(F.col(c).cast("string"))


def jsonl_lines(df: DataFrame, blob_col: str = "jsonl") -> DataFrame:
    """One row per non-blank line: all other columns, ``line_no`` and ``line``."""
    dtype = df.schema[blob_col].dataType
    text = decoded_text(blob_col) if isinstance(dtype, T.BinaryType) else F.col(blob_col).cast("string")
    others = [c for c in df.columns if c != blob_col]
    lines = df.where(F.col(blob_col).isNotNull()).select(
        *others, F.posexplode(F.split(text, SPLITLINES)).alias("line_no", "line"))
    return (lines.withColumn("line", strip_ws("line"))
                 .where(F.col("line") != "")
                 .withColumn("line_no", F.col("line_no").cast("long")))


def expand_jsonl(df: DataFrame, src_lang: str, tgt_lang: str,
                 blob_col: str = "jsonl") -> DataFrame:
    """Rows with a ``translation`` struct<src_lang, tgt_lang> per valid line.

    ``from_json`` ignores what follows a value, so a line is parsed twice: inside
    an array, which must then have one element, and inside an object. Junk behind
    the object breaks at least one of the two. Single quotes are refused.
    Non-string values become their JSON text. Lineage columns (``__key__``, ``__url__``, ``line_no``) are kept."""
    schema = T.StructType([T.StructField(src_lang, T.StringType()),
                           T.StructField(tgt_lang, T.StringType())])
    lines = jsonl_lines(df, blob_col)
    options = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    one = F.from_json(F.concat(F.lit("["), "line", F.lit("]")), T.ArrayType(schema), options)
    inner = F.from_json(F.concat(F.lit('{"o":'), "line", F.lit("}")),
                        T.StructType([T.StructField("o", schema)]), options)
    parsed = lines.where(F.col("line").rlike("(?s)^\\{.*\\}$")).where(F.size(one) == 1) \
        .withColumn("_obj", inner.getField("o"))
    ok = parsed.where(F.col(f"_obj.`{src_lang}`").isNotNull() & F.col(f"_obj.`{tgt_lang}`").isNotNull())
    others = [c for c in lines.columns if c != "line"]
    return ok.select(*others, F.struct(F.col(f"_obj.`{src_lang}`").alias(src_lang),
                                       F.col(f"_obj.`{tgt_lang}`").alias(tgt_lang)).alias("translation"))
