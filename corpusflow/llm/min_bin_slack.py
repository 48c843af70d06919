"""Packing documents into sequences by minimum bin slack (operator 4).

A document's ids and an end id make one piece, or several of ``capacity`` ids and
a rest. Pieces of one length can stand for each other, so the packing is decided
on the histogram of lengths, which has at most ``capacity`` rows however large the
corpus is. Per bin the largest length left opens it, and a bitset subset-sum
dynamic programme over the lengths still available finds the fullest combination
with it; the combination is removed as often as the histogram allows, so a bin is
in effect filled one after another.

Pieces then find their place by rank: a task numbers the pieces of each length
that it writes, a window over the (task, length) counts adds what earlier tasks
have, and the plan says which bin and offset has the pieces of a length from one
rank to another. No length is ever gathered in one task: the hottest key of the
join is the pieces of one length from one task.

Defined cases: a null or empty text is the end id alone; a null id stays null;
rows that repeat are packed once each; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import whole
from corpusflow.llm.word_ids import encoder
from corpusflow.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                           ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()),
                           ("part", pa.int32()), ("nth", pa.int64())])


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
               id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents; ``ids`` is filled only with ``keep_ids``. ``part``
    and ``nth`` number the pieces of each length within a task."""
    end, step = struct.pack("<I", end_id), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer_path).encode, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, "i8")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    piece = ids[at:at + step]
                    n = len(piece) // 4
                    rows.append({"doc_id": doc_id, "piece": k, "start": at // 4, "length": n,
                                 "ids_crc32": zlib.crc32(piece), "ids": piece if keep_ids else None,
                                 "part": part, "nth": int(seen[n])})
                    seen[n] += 1
            yield pa.RecordBatch.from_pylist(rows, schema=_PIECES_ARROW)

    return whole(docs, id_col, text_col).mapInArrow(cut, PIECES)


@dataclass
class Plan:
    """For each length, runs of ranks: the pieces from rank ``first`` on go to the
    bins from ``bin`` on, ``each`` to a bin, at ``offset`` and behind it."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    n_bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = np.int64(1) << 44
        k = np.searchsorted(self.length * scale + self.first, length * scale + rank, side="right") - 1
        j = rank - self.first[k]
        return self.bin[k] + j // self.each[k], self.offset[k] + (j % self.each[k]) * length


def fullest(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum of at most ``room``.

    Bit s of ``reach`` says whether a sum of s is possible with the lengths so far;
    going back, a length is used only if the sum can't be had without it, so
    larger lengths, which come first, are preferred.
    """
    reach, full, trail = 1, (1 << room + 1) - 1, []
    for length in order:
        if length > room or not counts[length]:
            continue
        trail.append((length, reach))
        left, take = min(counts[length], room // length), 1
        while left > 0:
            use = min(take, left)
            reach |= reach << use * length & full
            left, take = left - use, take * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(trail):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            used[length] = n
    return used


def plan_bins(histogram: dict[int, int], capacity: int) -> Plan:
    """Fill bins one combination after another until the histogram is empty."""
    counts = {k: v for k, v in histogram.items() if v}
    taken, rows, bins = dict.fromkeys(counts, 0), [], 0
    order = sorted(counts, reverse=True)
    while order:
        largest = order[0]
        counts[largest] -= 1
        used = fullest(counts, order, capacity - largest)
        counts[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        times, offset = min(counts[k] // n for k, n in used.items()), 0
        for k, n in used.items():
            rows.append((k, taken[k], n, bins, offset))
            taken[k] += n * times
            counts[k] -= n * times
            offset += n * k
        bins += times
        order = [k for k in order if counts[k]]
    rows.sort()
    columns = np.array(rows, "i8").reshape(-1, 5).T
    return Plan(*columns, n_bins=bins)


def assign(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces (a written table with ``length``, ``part``, ``nth``) with
    ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_bins(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        if not len(length):
            return pd.DataFrame({"sequence_id": pd.Series(dtype="i8"), "offset": pd.Series(dtype="i8")})
        bins, offset = plan.value.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": bins, "offset": offset})

    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    joined = pieces.join(before, ["part", "length"])
    return joined.select(*kept, place("length", F.col("nth") + F.col("before")).alias("p")).select(*kept, "p.*")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; the pieces are written once."""
    pieces = cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids)
    return assign(materialize(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` of packed pieces that kept their ids."""
    parts = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts"))
    return parts.select("sequence_id", "length",
                        F.unhex(F.concat_ws("", F.col("parts.ids"))).alias("ids"))
