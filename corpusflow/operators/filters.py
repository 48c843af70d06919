"""Row predicates as Columns (combine freely; Catalyst fuses them)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import count_numbers

# Default bounds of the cleaning rules.
MIN_MONO_CHARS = 10
MIN_WORDS = 2
MAX_WORDS = 150
MAX_RATIO = 3.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mono_length_ok(text, min_chars: int = MIN_MONO_CHARS) -> Column:
    """Cleaned text is non-empty and has at least ``min_chars`` characters."""
    return F.length(_c(text)) >= min_chars


def pair_nonempty(src, tgt) -> Column:
    """Both sides non-empty."""
    return (_c(src) != "") & (_c(tgt) != "")


def pair_length_ok(src_words, tgt_words, min_words: int = MIN_WORDS,
                   max_words: int = MAX_WORDS) -> Column:
    """Word counts of both sides within [min_words, max_words]."""
    s, t = _c(src_words), _c(tgt_words)
    return s.between(min_words, max_words) & t.between(min_words, max_words)


def pair_ratio_ok(src_words, tgt_words, max_ratio: float = MAX_RATIO) -> Column:
    """max/min word count <= max_ratio (exactly the bound passes); a zero
    side fails. ``nullif`` keeps ANSI mode from raising on zero."""
    s, t = _c(src_words), _c(tgt_words)
    ratio = F.greatest(s, t).cast("double") / F.nullif(F.least(s, t), F.lit(0)).cast("double")
    return F.coalesce(ratio <= F.lit(float(max_ratio)), F.lit(False))


def pair_numbers_ok(src, tgt) -> Column:
    """P5: same number of digit runs on both sides (counts, not values)."""
    return count_numbers(src) == count_numbers(tgt)
