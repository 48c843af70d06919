"""M1: corpus BLEU over (prediction, one reference) rows, as Spark aggregates.

Published BLEU with the usual defaults: "13a" tokenisation, clipped n-gram
precision for n = 1..4 summed over the corpus (never per-row means), geometric
mean, brevity penalty ``exp(1 - ref/sys)`` when the system is shorter,
exponential smoothing of zero counts, scaled to 0..100, 0 when nothing matches.

Plan: no 13a rule looks beyond the white space around a word, so the rules are applied to
the distinct words of a portion of texts. An n-gram is only ever compared with those of its
own row, so nothing is exploded or shuffled: a helper over Arrow batches numbers the
tokens, numbers n-grams by (row, number of the shorter one, next token), sorts those of both
sides and adds up the clipped matches. A few rows leave as one row of ten sums; their total
is the only exchange. With no rows the score is null.
:func:`tokenize_13a` has the same tokens as a JVM expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import patterns
from corpusflow.functions.text import ws_to_space

MAX_ORDER = 4

# The "13a" tokenisation rules (applied in this order).
UNESCAPE = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
RULES_13A = [
    ("([\\{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])", " $1 "),
    ("([^0-9])([\\.,])", "$1 $2 "),
    ("([\\.,])([^0-9])", " $1 $2"),
    ("([0-9])(-)", "$1 $2 "),
]


def tokenize_13a(c) -> Column:
    """Array of 13a tokens."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    t = F.regexp_replace(t, f"[{patterns.WS()}]+\\z", "")  # white space at the end goes first
    t = F.replace(t, F.lit("<skipped>"), F.lit(""))
    t = F.replace(t, F.lit("-\n"), F.lit(""))
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    for a, b in UNESCAPE:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pat, rep in RULES_13A:
        t = F.regexp_replace(t, pat, rep)
    return F.array_remove(F.split(F.regexp_replace(ws_to_space(t), " +", " "), " "), "")


#: Rows whose n-grams are counted together; bytes of texts that are split at once.
ROWS, BYTES = 256, 2 << 20
SUMS = [*(f"correct_{n}" for n in range(1, MAX_ORDER + 1)), *(f"total_{n}" for n in range(1, MAX_ORDER + 1)),
        "sys_len", "ref_len", "groups"]


#: Without any of these a word is one token.
TOUCHED = r"[\{-\~\[-\` -\&\(-\+\:-\@\/.,-]"


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 13a tokens of the texts, one text after another and numbered densely, and how many
    each has. Arrow's white space is that of ``patterns.WS``."""
    coded = pc.fill_null(texts, "").dictionary_encode()
    known = pc.utf8_rtrim_whitespace(coded.dictionary)
    for skipped in ("<skipped>", "-\n"):
        known = pc.replace_substring(known, skipped, "")
    split = pc.utf8_split_whitespace(known)
    words = split.flatten().dictionary_encode()
    touched = pc.match_substring_regex(words.dictionary, TOUCHED)
    pieces = _ruled(words.dictionary.filter(touched))
    whole = words.dictionary.filter(pc.invert(touched))
    numbers = pa.concat_arrays([whole, pieces.flatten()]).dictionary_encode().indices.to_numpy()
    # where the tokens of a word are: its own number, or those of its pieces
    touched, many = touched.to_numpy(zero_copy_only=False), pieces.value_lengths().to_numpy()
    start, size = np.empty(len(touched), "i8"), np.empty(len(touched), "i8")
    start[~touched], size[~touched] = np.arange(len(whole)), pc.not_equal(whole, "").to_numpy(zero_copy_only=False)
    start[touched], size[touched] = len(whole) + np.cumsum(many) - many, many
    numbers, size = _pick(numbers, start, size, words.indices.to_numpy())
    upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])]
    return _pick(_dense(numbers), upto[:-1], np.diff(upto), coded.indices.to_numpy())


def _ruled(words: pa.Array) -> pa.ListArray:
    """The tokens of words."""
    for a, b in UNESCAPE:
        words = pc.replace_substring(words, a, b)
    words = pc.binary_join_element_wise(" ", words, " ", "")
    for pattern, rep in RULES_13A:
        words = pc.replace_substring_regex(words, pattern, rep.replace("$", "\\"))
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(words))


def _pick(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` named by ``which``, one after another, and their sizes."""
    start, size = start[which], size[which]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)], size


def _dense(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 without gaps, equal for equal ones."""
    met = np.zeros(int(numbers.max(initial=-1)) + 1, "i4")
    met[numbers] = 1
    return (np.cumsum(met) - 1)[numbers]


def _ngrams(tokens: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..4: the row of every n-gram of consecutive rows, and its number. Equal
    n-grams have equal numbers, below 2 ** 52; they are made dense only where they would
    get too large."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(tokens))  # tokens up to the end of the row
    at, number, size = np.arange(len(tokens)), tokens, int(tokens.max(initial=0)) + 1
    top = size
    for n in range(1, MAX_ORDER + 1):
        if n > 1:
            more = left[at] >= n
            at, number = at[more], number[more]
            if top * size >= 1 << 52:
                number = np.unique(number, return_inverse=True)[1]
                top = len(number)
            number, top = number * size + tokens[at + n - 1], top * size
        yield row[at], number


def _clipped(flat: np.ndarray, lengths: np.ndarray) -> list[int]:
    """The sums of a few rows: the tokens of all predictions and then of all references."""
    rows = len(lengths) // 2
    size = lengths[:rows].sum(), lengths[rows:].sum()
    correct, total = [], []
    # both sides in one numbering: the references follow as rows of their own
    for row, number in _ngrams(_dense(flat), lengths):
        is_ref = row >= rows
        key = np.sort(((row - rows * is_ref) * (int(number.max(initial=0)) + 1) + number) * 2 + is_ref)
        start = np.flatnonzero(np.diff(key >> 1, prepend=-1))
        refs = np.add.reduceat(key & 1, start) if len(start) else start
        hyps = np.diff(start, append=len(key)) - refs
        correct.append(int(np.minimum(hyps, refs).sum()))
        total.append(len(row) - int(is_ref.sum()))
    return [*correct, *total, *map(int, size), rows]


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of, if more than one, at most ``BYTES`` bytes."""
    size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype("i8") for c in batch.columns)
    ends, a = np.cumsum(size), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, BYTES + (ends[a - 1] if a else 0), "right")))
        yield batch.slice(a, b - a)
        a = b


def bleu_stats(df: DataFrame, pred_col: str, ref_col: str, key_cols: list[str] | None = None) -> DataFrame:
    """One row: ``correct_n, total_n (n=1..4), sys_len, ref_len`` and ``groups``, the
    number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch):
                n = part.num_rows
                flat, size = _tokens(pa.concat_arrays(part.columns))
                upto = np.concatenate([[0], np.cumsum(size)])
                for a in range(0, n, ROWS):
                    b = min(n, a + ROWS)
                    both = [np.concatenate([x[i:j], x[k:m]]) for x, i, j, k, m in (
                        (flat, upto[a], upto[b], upto[n + a], upto[n + b]), (size, a, b, n + a, n + b))]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in _clipped(*both)], names=SUMS)

    texts = df.select(F.col(pred_col).alias("h"), F.col(ref_col).alias("r"))
    sums = texts.mapInArrow(run, ", ".join(f"{c} long" for c in SUMS))
    return sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS])


def bleu_from_stats(stats: DataFrame) -> DataFrame:
    """Adds ``bleu``, ``bp`` and ``p1..p4`` (percent) to the one-row stats."""
    c = [F.col(f"correct_{n}") for n in range(1, MAX_ORDER + 1)]
    t = [F.col(f"total_{n}") for n in range(1, MAX_ORDER + 1)]
    sys_len, ref_len = F.col("sys_len").cast("double"), F.col("ref_len").cast("double")
    bp = (F.when(sys_len < ref_len,
                 F.when(sys_len > 0, F.exp(F.lit(1.0) - ref_len / sys_len)).otherwise(F.lit(0.0)))
           .otherwise(F.lit(1.0)))
    precisions = []
    zeros_so_far = F.lit(0)
    reached = F.lit(True)
    for n in range(MAX_ORDER):
        reached = reached & (t[n] > 0)
        zeros_so_far = zeros_so_far + F.when(c[n] == 0, 1).otherwise(0)
        p = F.when(~reached, F.lit(0.0)).when(
            c[n] > 0, F.lit(100.0) * c[n].cast("double") / t[n].cast("double")).otherwise(
            F.lit(100.0) / (F.pow(F.lit(2.0), zeros_so_far.cast("double")) * t[n].cast("double")))
        precisions.append(p)
    logs = [F.when(p == 0.0, F.lit(-9999999999.0)).otherwise(F.log(p)) for p in precisions]
    mean_log = sum(logs[1:], logs[0]) / F.lit(float(MAX_ORDER))
    any_match = sum(c[1:], c[0]) > 0
    score = F.when(F.col("groups") == 0, F.lit(None).cast("double")).when(
        ~any_match, F.lit(0.0)).otherwise(bp * F.exp(mean_log))
    return stats.select("*", score.alias("bleu"), bp.alias("bp"),
                        *[p.alias(f"p{n + 1}") for n, p in enumerate(precisions)])


def corpus_bleu(df: DataFrame, pred_col: str = "pred", ref_col: str = "ref",
                key_cols: list[str] | None = None) -> DataFrame:
    """One row with the corpus BLEU and its statistics (``key_cols`` are not needed
    any more: rows keep to themselves)."""
    return bleu_from_stats(bleu_stats(df, pred_col, ref_col, key_cols))
