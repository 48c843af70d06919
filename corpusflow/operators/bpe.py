"""Byte-pair-encoding vocabulary, trained and applied as Spark jobs.

Tokenizer being reproduced: whitespace/punctuation pre-tokenizer
(``\\w+|[^\\w\\s]+``, Unicode classes), BPE with ``[UNK]`` for unknown
characters, five special tokens, the 256 byte-level symbols added to the
initial alphabet, and a byte-level decoder (which restores no spaces).

Training (T3-T5) is in ``bpe_train``: the corpus is read once, for word counts (a
partial aggregate: hot words collapse map-side); a round of merges then reads only the
distinct words that it touches.

Encoding (T8) and decoding (T9) are narrow: a row's words (or ids) stay in the
row and pass through one Arrow-batched helper that holds the merge ranks (or the
tokens' bytes) and remembers the words it has seen. No explode, join or shuffle.
Merges and tokens are bounded by the vocabulary size parameter, which bounds what
is broadcast.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Special tokens in id order, the pre-tokenizer pattern and the
# end-of-sequence / padding / mask tokens used by the example builders.
SPECIALS = ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]"]
PRETOKEN = "(?U)\\w+|[^\\w\\s]+"
UNK, EOS, PAD, MASK = "[UNK]", "[SEP]", "[PAD]", "[MASK]"

# Words that a worker remembers while it encodes, before it starts anew.
REMEMBERED_WORDS = 200_000
# Words or ids of a batch that are looked up at once.
ITEMS_AT_ONCE = 1 << 20
# Words that are cut at once.
WORDS_AT_ONCE = 1 << 15


@functools.lru_cache(maxsize=None)
def byte_alphabet() -> tuple[str, ...]:
    """The 256 byte-level symbols (GPT-2 rule): printable Latin-1 bytes map to
    themselves, the other 68 bytes to U+0100.. in increasing byte order."""
    keep = list(range(ord("!"), ord("~") + 1)) + list(range(0xA1, 0xAC + 1)) + \
        list(range(0xAE, 0xFF + 1))
    out, n = {}, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return tuple(out[b] for b in range(256))


@functools.lru_cache(maxsize=None)
def byte_decoder() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


def token_bytes(tok: str) -> bytes:
    """Byte-level decoding of one token: its byte symbols, or its UTF-8 bytes
    when any character is not a byte symbol."""
    dec = byte_decoder()
    if all(c in dec for c in tok):
        return bytes(dec[c] for c in tok)
    return tok.encode("utf-8")


def pretokenize(c) -> Column:
    """Words and punctuation runs, in order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PRETOKEN), 0)


def chars(c) -> Column:
    """Code points of a string, in order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(c, F.lit("(?s)."), 0)


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, count`` over the whole corpus."""
    return (df.select(F.explode(pretokenize(text_col)).alias("word"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("count")))


def char_pair_counts(wc: DataFrame) -> DataFrame:
    """T4 (initial round): adjacent character pairs weighted by word count."""
    ch = wc.select(chars("word").alias("c"), "count")
    n = F.size("c") - 1
    z = F.zip_with(F.slice("c", 1, n), F.slice("c", 2, n),
                   lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return (ch.select(F.explode(z).alias("p"), "count")
              .groupBy("p.left", "p.right").agg(F.sum("count").alias("count")))


@dataclass
class BpeModel:
    """Trained vocabulary. ``tokens[i]`` is the token of id i; ``merges`` are
    ``(left_id, right_id, new_id)`` in rank order. Both are bounded by the
    vocabulary size parameter, so they live on the driver and are broadcast."""

    tokens: list[str]
    merges: list[tuple[int, int, int]]
    rounds: int = 0
    tok2id: dict[str, int] = field(default_factory=dict)
    #: False if ``max_rounds`` ended the training before the vocabulary was full.
    complete: bool = True

    def __post_init__(self):
        if not self.tok2id:
            self.tok2id = {t: i for i, t in enumerate(self.tokens)}

    def token_to_id(self, tok: str) -> int | None:
        return self.tok2id.get(tok)

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, bytearray(token_bytes(t)), t in SPECIALS) for i, t in enumerate(self.tokens)]
        return spark.createDataFrame(rows, "id int, token string, token_bytes binary, special boolean")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        rows = [(r, self.tokens[a], self.tokens[b], n) for r, (a, b, n) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left string, right string, new_id int")


def save_bpe(model: BpeModel, spark: SparkSession, path: str) -> str:
    """Vocabulary and merges as two Parquet tables under ``path``."""
    model.vocab_df(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/vocab")
    model.merges_df(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/merges")
    return path


def load_bpe(spark: SparkSession, path: str) -> BpeModel:
    vocab = spark.read.parquet(f"{path}/vocab").orderBy("id").collect()
    tokens = [r["token"] for r in vocab]
    tok2id = {t: i for i, t in enumerate(tokens)}
    merges = [(tok2id[r["left"]], tok2id[r["right"]], r["new_id"])
              for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    return BpeModel(tokens, merges, tok2id=tok2id)


def train_bpe(df: DataFrame, text_col: str = "text", vocab_size: int = 32000,
              mode: str = "exact", relaxed_ratio: float = 0.9, top_k: int = 20_000,
              max_rounds: int | None = None) -> BpeModel:
    """T5: learn the vocabulary of ``df[text_col]`` (see ``bpe_train``). ``top_k`` pairs
    are counted on the driver at a time, which has no effect on the result. A model
    that ``max_rounds`` cut short says so in ``complete``."""
    from corpusflow.operators.bpe_train import train
    return train(df, text_col, vocab_size, mode, relaxed_ratio, top_k, max_rounds)


def segment(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is left: a
    heap of pairs over a linked list, so a word of n symbols takes n log n steps."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := ranks.get((symbols[i], symbols[j]))) is not None:
            heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged since
        symbols[i], symbols[j], after[i] = new, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [x for x in symbols if x >= 0]


class Pieces(dict):
    """Words -> their ids as 32-bit integers, remembered per task. Unknown characters
    are ``[UNK]``."""

    def __init__(self, tok2id, ranks, unk):
        from corpusflow.operators.bpe_train import Merges
        self.tok2id, self.unk = tok2id, unk
        self.merges = Merges([(*pair, new) for pair, (_, new) in sorted(ranks.items(), key=lambda x: x[1])], again=True)

    def of(self, words: list[str]) -> list[bytes]:
        """Each word's ids. Those that aren't remembered are cut at once, as by :func:`segment`."""
        found = [*map(self.get, words)]
        at = [i for i, x in enumerate(found) if x is None]
        fresh = [words[i] for i in at]
        made = [x for a in range(0, len(fresh), WORDS_AT_ONCE) for x in self._cut(fresh[a:a + WORDS_AT_ONCE])]
        for i, x in zip(at, made):
            found[i] = x
        if len(self) + len(fresh) > REMEMBERED_WORDS:
            self.clear()
        if len(fresh) <= REMEMBERED_WORDS:
            self.update(zip(fresh, made))
        return found

    def _cut(self, words: list[str]) -> list[bytes]:
        """The ids of words, by columns of their characters."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        kinds, kind = np.unique(codes, return_inverse=True)
        size = np.fromiter(map(len, words), "i8", len(words))
        symbols = np.full(len(codes) + len(words) + 1, -1, "i4")
        symbols[np.arange(len(codes)) + np.repeat(np.arange(1, len(words) + 1), size)] = np.array(
            [self.tok2id.get(chr(c), self.unk) for c in kinds.tolist()], "i4")[kind]
        symbols = self.merges(symbols)
        # the ids of a word stand between two ends
        data, at = symbols.astype("<i4").tobytes(), (4 * np.flatnonzero(symbols < 0)).tolist()
        return [data[i + 4:j] for i, j in zip(at, at[1:])]

    def ids(self, words: pa.ListArray) -> pa.ListArray:
        """The ids of each row's words. Only the distinct words of the rows become
        Python objects."""
        flat = words.flatten().dictionary_encode()
        made = self.of(flat.dictionary.to_pylist())
        size = np.array([len(x) // 4 for x in made], "i8")
        values, at = np.frombuffer(b"".join(made), "<i4"), flat.indices.to_numpy()
        n = size[at]
        stops = np.concatenate([[0], np.cumsum(n)])
        # where each word's ids begin among those of the distinct words, less where they go
        places = np.arange(stops[-1]) + np.repeat((np.cumsum(size) - size)[at] - stops[:-1], n)
        per_row = np.concatenate([[0], np.cumsum(np.asarray(words.value_lengths()).astype("i8"))])
        return pa.ListArray.from_arrays(pa.array(stops[per_row].astype("i4")), pa.array(values[places], pa.int32()))


def _portions(lists: pa.ListArray) -> list[tuple[int, int]]:
    """(start, rows) of pieces of a batch that hold about ``ITEMS_AT_ONCE`` items."""
    before = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(), dtype="i8")])
    cuts = [0, *(np.flatnonzero(np.diff(before[:-1] // ITEMS_AT_ONCE)) + 1).tolist(), len(lists)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def _segmenter(bc):
    """Words of a row -> its ids."""

    def seg(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = Pieces(*bc.value)
        for words in batches:
            yield pa.concat_arrays([pieces.ids(words.slice(a, n)) for a, n in _portions(words)]
                                   or [pa.array([], pa.list_(pa.int32()))])

    return F.arrow_udf(seg, T.ArrayType(T.IntegerType()))


def encode(df: DataFrame, text_col: str, model: BpeModel, key_cols: list[str],
           out_col: str = "ids") -> DataFrame:
    """``keys, ids`` for every row (empty text -> empty array), in one narrow
    pass over the rows."""
    return encode_words(df, pretokenize(text_col), model, key_cols, out_col)


def encode_words(df: DataFrame, words, model: BpeModel, key_cols: list[str], out_col: str = "ids") -> DataFrame:
    """:func:`encode` of a column of words."""
    ranks = {(a, b): (r, n) for r, (a, b, n) in reversed(list(enumerate(model.merges)))}
    bc = df.sparkSession.sparkContext.broadcast((model.tok2id, ranks, model.tok2id[UNK]))
    return df.select(*key_cols, _segmenter(bc)(words).alias(out_col))


def decode(df: DataFrame, ids_col: str, model: BpeModel, key_cols: list[str],
           out_col: str = "text", sep: str = "") -> DataFrame:
    """Ids -> text with the byte-level decoder, skipping special tokens.
    ``sep=''`` reproduces the decoder exactly (no word boundaries);
    ``sep=' '`` puts a space between tokens. Linear in the ids."""
    mark = sep.encode()
    pieces = [b"" if t in SPECIALS else token_bytes(t) + mark for t in model.tokens]
    kept = np.array([t not in SPECIALS for t in model.tokens])
    bc = df.sparkSession.sparkContext.broadcast((b"".join(pieces), np.array([len(p) for p in pieces], "i8"), kept))

    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        text, size, kept = bc.value
        text, starts = np.frombuffer(text, "u1"), np.cumsum(size) - size

        def some(lists: pa.ListArray) -> pa.Array:
            ids = lists.flatten().fill_null(-1).to_numpy()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            good = (ids >= 0) & (ids < len(size))
            good[good] = kept[ids[good]]
            ids, row = ids[good], row[good]
            n = size[ids]
            n[np.flatnonzero(np.diff(row, append=-1))] -= len(mark)  # none behind a row's last token
            stops = np.concatenate([[0], np.cumsum(n)])
            places = np.arange(stops[-1]) + np.repeat(starts[ids] - stops[:-1], n)
            ends = stops[np.searchsorted(row, np.arange(len(lists) + 1))]
            return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype("<i8").tobytes()),
                                                                         pa.py_buffer(text[places].tobytes())]).cast(pa.binary())

        for lists in batches:
            yield pa.concat_arrays([some(lists.slice(a, n)) for a, n in _portions(lists)] or [pa.array([], pa.binary())])

    raw = F.arrow_udf(join, T.BinaryType())(ids_col)
    return df.select(*key_cols, F.make_valid_utf8(raw.cast("string")).alias(out_col))


def tokenizer_rows(df: DataFrame, text_col: str, model: BpeModel, key_cols: list[str]) -> DataFrame:
    """T10 per row: ``keys, text, tokens, ids, decoded``."""
    enc = encode(df, text_col, model, [*key_cols, text_col])
    bc = df.sparkSession.sparkContext.broadcast(model.tokens)

    def names(rows: pd.Series) -> pd.Series:
        return pd.Series([[bc.value[i] for i in ids] for ids in rows], dtype=object)

    enc = enc.withColumn("tokens", F.pandas_udf(names, T.ArrayType(T.StringType()))("ids"))
    out = decode(enc, "ids", model, [*key_cols, text_col, "tokens", "ids"], "decoded")
    return out.select(*key_cols, F.col(text_col).alias("text"), "tokens", "ids", "decoded")


def tokenizer_report(df: DataFrame, text_col: str, model: BpeModel, key_cols: list[str],
                     group_col: str | None = None) -> DataFrame:
    """Per group: rows, words, tokens, unknown tokens, tokens per word,
    unknown rate."""
    group = [group_col] if group_col else []
    enc = encode_words(df.select(*group, pretokenize(text_col).alias("_w")), "_w", model, [*group, "_w"])
    unk = model.tok2id[UNK]
    j = enc.select(*group, F.size("_w").alias("_w"), F.size("ids").alias("_t"),
                   F.size(F.filter("ids", lambda x: x == F.lit(unk))).alias("_u"))
    g = j.groupBy(*group)
    out = g.agg(F.count(F.lit(1)).cast("long").alias("rows"), F.sum("_w").cast("long").alias("words"),
                F.sum("_t").cast("long").alias("tokens"), F.sum("_u").cast("long").alias("unknown"))
    return (out.withColumn("tokens_per_word", F.round(F.col("tokens") / F.nullif("words", F.lit(0)), 4))
               .withColumn("unknown_rate", F.round(F.col("unknown") / F.nullif("tokens", F.lit(0)), 6)))
