"""Ranked lexical search without random access (operator 13).

The score of a document for an item is the sum over the item's terms (repeats count)
of ``weight * ((1000000000 * tf) div (1000 * tf + 8 * m))`` in 64-bit integers, with
global statistics, so results of shards can be compared as they are.

Plan:

1. One pass over the documents writes, per document with a term, its length and the
   frequencies of the terms that the items ask for. Document count, total length and
   document frequencies are aggregates of that table.
2. The index is written from it: each task closes a shard when it has ``postings``
   postings, however many documents that takes, and writes its posting lists in order
   of falling impact, cut into segments of ``SEGMENT`` postings.
3. Each shard's segments are dealt to one task and read in turn. Per item, NRA: all
   lists are read on in parallel, sequentially, in steps that grow. A document's lower
   bound is what has been read of it; its upper bound adds, for each list in which it
   has not been seen, the next impact of that list. Documents that can't reach the
   k-th lower bound (of this shard, or of shards before it in the task) are dropped;
   reading ends when the k best are known with final scores and no other document,
   seen or not, could pass or tie them.
4. The shards' best are merged: at most k rows per item and shard are shuffled.

Items go to the tasks in blocks of at most ``item_bytes`` bytes of text (counted), so
a broadcast is bounded; more items make more passes.

Defined cases: null, empty and term-free texts have no terms: such a document is in no
count, such an item has no results; an item whose id is null or repeated is an item of
its own; repeated documents are documents of their own; a null doc_id counts in the
statistics and is never returned; equal scores rank by ascending doc_id; other columns
are not read; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.bpe_dp import slices
from corpusflow.llm.common import whole
from corpusflow.session import discard, materialize

#: Postings of a shard, and of a segment of a posting list (one row).
POSTINGS, SEGMENT = 1 << 20, 4096
#: Bytes of item texts that are broadcast at once.
ITEM_BYTES = 16 << 20
#: First step of reading, per list; later ones grow.
STEP = 256

#: Bytes of a term stay, A-Z in lower case; the others end it.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERM).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def forward(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of the documents with a term: the known terms' numbers
    and frequencies as 32-bit integers."""
    bc = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bc.value
        for batch in batches:
            for part in slices(batch):
                ids, size, at, tf = [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = terms(text)
                    if not found:
                        continue
                    counts = Counter(found)
                    mine = counts.keys() & known.keys()
                    ids.append(doc_id)
                    size.append(len(found))
                    at.append(np.array([known[t] for t in mine], "<i4").tobytes())
                    tf.append(np.array([counts[t] for t in mine], "<i4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(at, pa.binary()),
                                                  pa.array(tf, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("_id", "_text").mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def frequencies(table: DataFrame, n_terms: int) -> np.ndarray:
    """Document frequency of every known term, summed up per task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, "i8")
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(n_terms, "i8")
    found = table.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in found.collect():  # at most the terms of a block of items
        out[r["term"]] = r["df"]
    return out


_INDEX = "shard long, term int, part int, docs binary, values binary"


def inverted(table: DataFrame, n_docs: int, n_words: int, postings: int) -> DataFrame:
    """Shards of posting lists in order of falling impact. The list of term -1 holds
    the shard's document ids, in ascending order, to which postings refer by place."""
    def shard(number: int, ids: list, size: list, at: list, tf: list) -> Iterator[pa.RecordBatch]:
        count = np.array([len(a) // 4 for a in at])
        ids = np.array([-(1 << 63) if i is None else i for i in ids], "i8")
        term, tf = np.frombuffer(b"".join(at), "<i4").astype("i8"), np.frombuffer(b"".join(tf), "<i4").astype("i8")
        place = np.argsort(ids, kind="stable")
        doc = np.empty(len(ids), "i8")
        doc[place] = np.arange(len(ids))
        m = 25 + np.array([75 * n * n_docs // n_words for n in size], "i8")
        value = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, count))
        doc = np.repeat(doc, count)
        order = np.lexsort((doc, -value, term))
        term, doc, value = term[order], doc[order].astype("<i4"), value[order].astype("<i4")
        cuts = np.append(np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else [], len(term)).astype("i8")
        rows = [(-1, k, ids[place[a:a + SEGMENT]].astype("<i8").tobytes(), b"")
                for k, a in enumerate(range(0, len(ids), SEGMENT))]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows += [(int(term[lo]), k, doc[a:min(a + SEGMENT, hi)].tobytes(), value[a:min(a + SEGMENT, hi)].tobytes())
                     for k, a in enumerate(range(lo, hi, SEGMENT))]
        for a in range(0, len(rows), 1024):
            t, k, d, v = zip(*rows[a:a + 1024])
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(t), pa.int64()), pa.array(t, pa.int32()), pa.array(k, pa.int32()),
                                              pa.array(d, pa.binary()), pa.array(v, pa.binary())],
                                             names=["shard", "term", "part", "docs", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: tuple[list, list, list, list] = ([], [], [], [])
        n = 0
        for batch in batches:
            for part in slices(batch):
                for column, more in zip(held, part.columns):
                    column += more.to_pylist()
                n += sum(len(x) // 4 for x in held[2][-part.num_rows:]) + part.num_rows
                if n >= postings:
                    yield from shard(number, *held)
                    held, n, number = ([], [], [], []), 0, number + 1
        if held[0]:
            yield from shard(number, *held)

    return table.select("doc_id", "n", "terms", "tfs").mapInArrow(run, _INDEX)


class Shard:
    """Posting lists of one shard."""

    def __init__(self, ids: np.ndarray, lists: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.ids, self.lists = ids, lists

    def best(self, asked: list[tuple[int, int]], k: int, floor: int) -> list[tuple[int, int]]:
        """(place, score) of the ``k`` best documents for (term, factor) pairs, by NRA;
        those under ``floor`` may be left out."""
        # factor 0: the term adds nothing to any score
        found = [(*self.lists[t], c) for t, c in asked if c > 0 and t in self.lists]
        if not found:
            return []
        n = len(self.ids)
        lower, alive = np.zeros(n, "i8"), self.ids > -(1 << 63)
        read = np.zeros(len(found), "i8")
        seen_doc, seen_list = [], []  # postings read of documents that are still alive
        step, unseen = STEP, True
        while True:
            for x, (docs, values, factor) in enumerate(found):
                a, b = int(read[x]), min(int(read[x]) + step, len(docs))
                if a == b:
                    continue
                d, v = docs[a:b], values[a:b]
                mine = alive[d]
                if not mine.all():
                    d, v = d[mine], v[mine]
                lower[d] += v.astype("i8") * factor  # a list has a document once
                seen_doc.append(d)
                seen_list.append(np.full(len(d), x, "i4"))
                read[x] = b
            bound = np.array([int(values[r]) * c if r < len(values) else 0 for r, (_, values, c) in zip(read.tolist(), found)], "i8")
            rest = int(bound.sum())
            docs = np.concatenate(seen_doc)
            part = np.concatenate(seen_list)
            # what a document may still gain: the next impacts of lists it was not seen in
            upper = lower + rest
            np.subtract.at(upper, docs, bound[part])
            kth = int(np.partition(lower[alive], -k)[-k]) if alive.sum() > k else 0
            least = max(kth, floor, 1)
            if unseen:
                alive &= upper >= least if rest >= least else (upper >= least) & (lower > 0)
                unseen = rest >= least
            else:
                alive &= upper >= least
            left = np.flatnonzero(alive)
            if not rest or not unseen and self._settled(left, lower, upper, k):
                left = left[lower[left] > 0]
                order = np.lexsort((left, -lower[left]))[:k]
                return [(int(p), int(lower[p])) for p in left[order]]
            mine = alive[docs]
            seen_doc, seen_list = [docs[mine]], [part[mine]]
            step *= 4

    @staticmethod
    def _settled(left: np.ndarray, lower: np.ndarray, upper: np.ndarray, k: int) -> bool:
        """Whether the ``k`` best of the documents left have final scores, and no other
        one could pass or tie them."""
        order = left[np.lexsort((left, -lower[left]))]
        top, others = order[:k], order[k:]
        if (upper[top] > lower[top]).any():
            return False
        return not len(others) or int(upper[others].max()) < int(lower[top[-1]]) or \
            bool(((upper[others] < lower[top[-1]]) | (others > top[-1]) & (upper[others] == lower[top[-1]])).all())


def ranked(index: DataFrame, asked: list[list[tuple[int, int]]], k: int) -> DataFrame:
    """``q, doc_id, score``: the best of every shard for every item of the block."""
    bc = index.sparkSession.sparkContext.broadcast(asked)

    def search(shard: Shard, floors: list[int]) -> pa.RecordBatch:
        rows = []
        for q, one in enumerate(bc.value):
            best = shard.best(one, k, floors[q])
            if len(best) == k:
                floors[q] = max(floors[q], best[-1][1])
            rows += [(q, int(shard.ids[p]), s) for p, s in best]
        columns = np.array(rows, "i8").reshape(-1, 3).T
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = [0] * len(bc.value)
        now, parts = None, {}

        def close() -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(d, "<i8") for d, _ in parts.pop(-1)])
            lists = {t: tuple(np.concatenate([np.frombuffer(x[i], "<i4") for x in rows]) for i in (0, 1)) for t, rows in parts.items()}
            return search(Shard(ids, lists), floors)

        for batch in batches:
            for shard, term, d, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                         batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if shard != now and parts:
                    yield close()
                    parts = {}
                now = shard
                parts.setdefault(term, []).append((d, v))
        if parts:
            yield close()

    dealt = index.repartition("shard").sortWithinPartitions("shard", "term", "part")
    return dealt.mapInArrow(run, "q long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
           postings: int = POSTINGS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of every item."""
    spark = docs.sparkSession
    texts = whole(docs, id_col, text_col)
    asked = whole(items, item_col, text_col).withColumn("_n", F.octet_length("_text"))
    size = asked.agg(F.sum("_n").alias("n")).first()["n"] or 0
    blocks = -(-size // item_bytes) or 1
    asked = materialize(asked.select("_id", "_text", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)).alias("_b")), "nra-items")
    best = None
    for b in range(blocks):
        rows = asked.where(F.col("_b") == b).select("_id", "_text").collect()  # about item_bytes
        found = [Counter(terms(r["_text"])) for r in rows]
        known = {t: i for i, t in enumerate(sorted(set().union(*found)))}
        table = materialize(forward(texts, known), "nra-forward")
        stat = table.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
        if not stat["docs"] or not known:
            continue
        df = frequencies(table, len(known))
        index = materialize(inverted(table, stat["docs"], stat["words"], postings), "nra-index")
        discard(table)
        weights = {t: weight(stat["docs"], int(df[i])) for t, i in known.items()}
        lists = [[(known[t], c * weights[t]) for t, c in sorted(one.items())] for one in found]
        names = spark.createDataFrame([(q, r["_id"]) for q, r in enumerate(rows)], "q long, item_id long")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
        top = ranked(index, lists, k).withColumn("rank", place).where(F.col("rank") <= k)
        part = materialize(top.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"), "nra-best")
        discard(index)
        best = part if best is None else best.unionAll(part)
    if best is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return best
