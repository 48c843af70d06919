"""T5: exact byte-pair training that moves only the words a merge touches.

All distinct words with their counts are written once into the shared folder (one pass
over the corpus), each as its symbols. A round reads them as columns of symbols and
makes the merges since they were written, all words at once (:class:`Merges`); now and
then they are written anew, without those that have become one symbol.

A round covers the next pairs in order: tasks send the words that hold one of them, up
to ``HELD_SYMBOLS`` symbols in all, and the driver merges these (:class:`Held`). As a
covered pair, and every pair with a symbol made in the round, is in sent words only, the
counts stay exact, and merges go on until the best pair isn't covered. Pairs that touch
too many words for that, the first ones of a large corpus, are merged where the words
are: a round takes the next pairs as a guess, and the tasks send what each guessed merge,
one after another, adds to and takes from the pair counts. The driver then goes through
the guess: as long as its next pair is the best one under the counts brought up to date,
the merge is made; at the first that is not, the rest of the guess is dropped.

Beyond ``SCANNED_MERGES`` merges there is an index instead (:class:`Rounds`): character
n-gram -> words, partitioned by a hash of the n-gram and sorted by it. The words that can
hold a pair are listed under every n-gram of the two tokens' string; a round reads the
rarest one's list only and replays its words. Words of more than ``LONG_WORD`` characters
are not indexed but read each round.

Pair counts live on the driver for the best pairs only, at most four times ``top_k``,
with ``edge``, the rank key behind which all other pairs lie. Counts of pairs never
rise unless a merge makes a symbol, and pairs with a new symbol are counted from the
first one on, so the edge stays valid until the best pair falls behind it; a pair that
rises behind it, as a symbol is made in a second way, moves it. Then the best pairs are fetched again (:func:`top_pairs`), by a threshold algorithm over
counts per task: not all pairs are shuffled, just those that can be among the best.

So merges, their order and ties are those of training one merge at a time
(``mode='exact'``). ``mode='relaxed'`` makes all
merges of a round that share no symbol and have ``relaxed_ratio`` of the top count.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.bpe import SPECIALS, BpeModel, byte_alphabet, chars, word_counts
from corpusflow.session import discard, materialize, shared_dir

#: Distinct words in a task that counts all pairs, and candidates in a task of a round.
WORDS_PER_TASK, TOUCHED_PER_TASK = 50_000, 2_000
#: Up to so many tasks of a round send their sums without a shuffle before.
FEW_TASKS = 16
#: Words beyond this length are not indexed by their n-grams.
LONG_WORD = 64
#: Frequent n-grams whose number of words the driver knows; the others are rarer.
KNOWN_GRAMS = 65_536
#: Up to so many merges words are read without an index, all of them in every round.
SCANNED_MERGES = 900_000
#: Symbols of the words that a round sends to the driver, pairs it covers, and merges it makes, at most.
HELD_SYMBOLS, MOST_COVERED, MOST_HELD = 3 << 20, 4_096, 2_000
#: Pairs that the first round, and any round, asks for at least; symbols that are looked up at once.
FIRST_ASKED, LEAST_ASKED, LOOKED_UP = 1_024, 64, 1 << 18
#: A round that covers fewer pairs is followed by some that guess.
FEW_COVERED, THEN_GUESSED = 8, 4
#: The words are written anew after so many merges, at least and at most, in between after half
#: as many as before: the first ones change most of the words.
LEAST_REWRITTEN, REWRITTEN = 16, 1_000
#: Merges guessed in a round, at least and at most.
LEAST_GUESS, MOST_GUESS = 4, 128

Merge = tuple[int, int, int]


def fold(symbols: list[int], left: int, right: int, new: int) -> list[int]:
    """One merge, from left to right."""
    out: list[int] = []
    i, n = 0, len(symbols)
    while i < n:
        if symbols[i] == left and i + 1 < n and symbols[i + 1] == right:
            out.append(new)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


class Replay:
    """Words -> symbols after all merges, each applied once, in order. A pair may be
    merged again later: two ways can lead to one token."""

    def __init__(self, alphabet: dict[str, int], merges: list[Merge]):
        self.alphabet, self.merges = alphabet, merges
        ranks: dict[tuple[int, int], tuple[int, ...]] = {}
        for rank, (left, right, _) in enumerate(merges):
            ranks[left, right] = ranks.get((left, right), ()) + (rank,)
        self.ranks = ranks

    def _next(self, left: int, right: int, now: int) -> int | None:
        for rank in self.ranks.get((left, right), ()):
            if rank > now:
                return rank
        return None

    def __call__(self, word: str) -> list[int]:
        symbols = [self.alphabet[c] for c in word]
        if len(symbols) > 32:
            return self._long(symbols)
        now = -1
        while True:
            found = [r for pair in zip(symbols, symbols[1:]) if (r := self._next(*pair, now)) is not None]
            if not found:
                return symbols
            now = min(found)
            symbols = fold(symbols, *self.merges[now])

    def _long(self, symbols: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n steps."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, now: int) -> None:
            j = after[i]
            if j < n and (rank := self._next(symbols[i], symbols[j], now)) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[j]))

        for i in range(n):
            offer(i, -1)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = self.merges[rank][2], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i], rank)
            offer(i, rank)
        return [s for s in symbols if s >= 0]


def flat(words: list[str], alphabet: dict[str, int]) -> np.ndarray:
    """The symbols of all words in one array, -1 before, between and behind them."""
    codes = np.frombuffer(("\n" + "".join(w + "\n" for w in words)).encode("utf-32-le"), "<u4")
    table = np.full(int(codes.max()) + 1, -1, "i4")  # words hold no line breaks
    for c, i in alphabet.items():
        if len(c) == 1 and ord(c) < len(table):
            table[ord(c)] = i
    return table[codes]


def places(symbols: np.ndarray, left: int, right: int) -> np.ndarray:
    """Where a merge applies, from left to right."""
    at = np.flatnonzero((symbols[:-1] == left) & (symbols[1:] == right))
    return every_second(at) if left == right else at


def every_second(at: np.ndarray) -> np.ndarray:
    """Places without every second one of a run."""
    if len(at) > 1:
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        at = at[nth % 2 == 0]
    return at


def fold_at(symbols: np.ndarray, at: np.ndarray, new: int) -> np.ndarray:
    """:func:`fold` of all words at once; ``symbols`` is overwritten."""
    if not len(at):
        return symbols
    symbols[at] = new
    return np.delete(symbols, at + 1)


def pair_sums(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left << 32 | right) and how often the words have them."""
    word = np.cumsum(symbols < 0)[:-1] - 1
    inside = (symbols[:-1] >= 0) & (symbols[1:] >= 0)
    keys, at = np.unique(symbols[:-1][inside].astype("i8") << 32 | symbols[1:][inside], return_inverse=True)
    total = np.zeros(len(keys), "i8")
    np.add.at(total, at, counts[word[inside]])
    return keys, total


def changed(symbols: np.ndarray, at: np.ndarray, new: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words after a merge at ``at``, and by how much the counts of which pairs change."""
    word = np.cumsum(symbols < 0) - 1
    near = np.zeros(len(symbols), bool)
    for i in (-1, 0, 1):
        near[at + i] = True
    old = np.flatnonzero(near[:-1] & (symbols[:-1] >= 0) & (symbols[1:] >= 0))
    keys, by = [symbols[old].astype("i8") << 32 | symbols[old + 1]], [-counts[word[old]]]
    owner = np.delete(word, at + 1)
    symbols = fold_at(symbols, at, new)
    place = at - np.arange(len(at))
    near = np.zeros(len(symbols), bool)
    for i in (-1, 0):
        near[place + i] = True
    now = np.flatnonzero(near[:-1] & (symbols[:-1] >= 0) & (symbols[1:] >= 0))
    keys.append(symbols[now].astype("i8") << 32 | symbols[now + 1])
    by.append(counts[owner[now]])
    keys, total = summed(np.concatenate(keys), np.concatenate(by))
    return symbols, keys[total != 0], total[total != 0]


def summed(keys: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, by = keys[order], by[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.empty(0, "i8")
    return keys[first], np.add.reduceat(by, first) if len(first) else by.astype("i8")


BLOCK = "symbols binary, counts binary"


def block(symbols: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Many words as one row, so that a round moves few rows."""
    return pa.RecordBatch.from_arrays([pa.array([symbols.astype("<i4").tobytes()], pa.binary()),
                                       pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["symbols", "counts"])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols, as in :func:`flat`, and counts of the words of each row."""
    for batch in batches:
        for symbols, counts in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(symbols.as_buffer(), "<i4").copy(), np.frombuffer(counts.as_buffer(), "<i8")


class Merges:
    """Some merges on all words at once. In each step every word takes the first merge
    behind its last one that it has a pair for; words without one are done. With ``again``
    the first one of all: that is how a trained vocabulary cuts a word (``bpe.segment``)."""

    BITS = 21  # of a symbol, and of a merge's number

    def __init__(self, merges: list[Merge], again: bool = False):
        left, right, self.new = (np.array(x, "i8") for x in (zip(*merges) if merges else ([], [], [])))
        self.keys = np.sort(left << 2 * self.BITS | right << self.BITS | np.arange(len(merges)))
        self.left, self.right, self.again = left, right, again
        # merges whose symbol an earlier one takes: behind each of their places comes that one
        uses: dict[int, int] = {}
        for i, pair in reversed([*enumerate(zip(left.tolist(), right.tolist()))]):
            uses |= dict.fromkeys(pair, i)
        self.single = np.array([again and uses.get(n, i) < i for i, n in enumerate(self.new.tolist())], bool)

    def _ranks(self, left: np.ndarray, right: np.ndarray, least: np.ndarray | int) -> np.ndarray:
        """The number of the first merge of each pair from ``least`` on, -1 without one."""
        pair = left.astype("i8") << 2 * self.BITS | right.astype("i8") << self.BITS
        found = self.keys[np.minimum(np.searchsorted(self.keys, pair | least), len(self.keys) - 1)]
        good = (found >= pair | least) & (found >> self.BITS == pair >> self.BITS)
        return np.where(good, found & (1 << self.BITS) - 1, -1)

    def __call__(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return symbols
        # the last entry stands for the -1 between words
        is_left, is_right = np.zeros((2, int(max(symbols.max(), self.left.max(), self.right.max(), self.new.max())) + 2), bool)
        is_left[self.left] = is_right[self.right] = True
        at = np.flatnonzero(is_left[symbols[:-1]] & is_right[symbols[1:]])
        found = self._ranks(symbols[at], symbols[at + 1], 0)
        at, found = at[found >= 0], found[found >= 0]
        if not len(at):
            return symbols
        symbols, gone = symbols.copy(), np.zeros(len(symbols), bool)
        word = np.cumsum(symbols < 0) - 1
        hit = np.zeros(word[-1] + 1, bool)
        hit[word[at]] = True
        rank = np.full(len(symbols), -1)
        rank[at] = found
        place = np.flatnonzero(hit[word])  # where the symbols of the words at work stand
        some, rank = symbols[place], rank[place]
        while len(place):
            word = np.cumsum(some < 0) - 1
            at = np.flatnonzero(rank >= 0)
            if not len(at):
                break
            first = np.flatnonzero(np.diff(word[at], prepend=-1))
            best = np.full(word[-1] + 1, -1)
            best[word[at[first]]] = np.minimum.reduceat(rank[at], first)
            at = every_second(at[rank[at] == best[word[at]]])
            if self.again:
                later = np.diff(word[at], prepend=-1) == 0
                at = at[~(later & self.single[best[word[at]]])]
            some[at] = symbols[place[at]] = self.new[best[word[at]]]
            gone[place[at + 1]] = True
            # only pairs with a new symbol get another rank; words without a merge are done
            other = np.zeros(len(place), bool)
            other[at] = other[at - 1] = True
            stays = best[word] >= 0
            stays[at + 1] = False
            place, some, rank, other, word = place[stays], some[stays], rank[stays], other[stays], word[stays]
            rank[other] = -1
            at = np.flatnonzero(other[:-1] & is_left[some[:-1]] & is_right[some[1:]])
            rank[at] = self._ranks(some[at], some[at + 1], 0 if self.again else best[word[at]] + 1)
        return symbols[~gone]


def _columns(rows: dict, *names: str) -> pa.RecordBatch:
    """A batch of (key parts..., value) from a dictionary."""
    made = [list(x) for x in zip(*((*k, v) for k, v in rows.items()))] or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=list(names))


def local_pairs(words: DataFrame, read) -> DataFrame:
    """``part, place, l, r, c``: every task's own count of every pair of its words,
    largest first. ``read`` makes symbols and counts of batches of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.empty(0, "i8"), np.empty(0, "i8")
        held, size = [], 0

        def add() -> None:
            nonlocal keys, sums, size
            if held:
                keys, sums = summed(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([sums, *(c for _, c in held)]))
                held.clear()
                size = 0

        for symbols, counts in read(batches):
            held.append(pair_sums(symbols, counts))
            size += len(held[-1][0])
            if size > max(1 << 20, len(keys)):
                add()
        add()
        order = np.argsort(-sums, kind="stable")  # keys are in order
        keys, sums = keys[order], sums[order]
        part = TaskContext.get().partitionId()
        for a in range(0, len(keys), 65_536):
            k, c = keys[a:a + 65_536], sums[a:a + 65_536]
            made = np.full(len(k), part, "i8"), np.arange(a, a + len(k)), k >> 32, k & 0xFFFFFFFF, c
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["part", "place", "l", "r", "c"])

    return words.mapInArrow(run, "part long, place long, l long, r long, c long")


def top_pairs(local: DataFrame, k: int) -> tuple[list, bool]:
    """The ``k`` best pairs (count descending, then ids) of written counts per task, and
    whether these are all there are.

    Three phases: sums over the tasks' first places give a lower bound of the k-th
    count; a pair that is below bound / tasks in every task can't reach it, so only
    rows above that are summed; what could still be among the best is summed exactly."""
    parts, rows = local.agg(F.count_distinct("part"), F.count(F.lit(1))).first()
    order = [F.desc("c"), "l", "r"]
    summed = lambda df: df.groupBy("l", "r").agg(F.sum("c").cast("long").alias("c"), F.count(F.lit(1)).alias("n"))
    if parts > 1 and rows > 4 * k:
        head = summed(local.where(F.col("place") < k)).orderBy(*order).limit(k).agg(F.min("c"), F.count(F.lit(1))).first()
        bound = head[0] if head[1] == k else 0
        least = -(-bound // parts)
        if least > 1:
            # a pair's tasks without a row here add less than ``least`` each
            maybe = summed(local.where(F.col("c") >= least)).where(F.col("c") + (parts - F.col("n")) * (least - 1) >= bound)
            maybe = materialize(maybe.select("l", "r"), "bpe-candidates")
            local = local.join(maybe, ["l", "r"], "left_semi")
    best = summed(local).orderBy(*order).limit(k + 1).collect()
    return [(r["l"], r["r"], r["c"]) for r in best[:k]], len(best) <= k and rows <= 4 * k


class Ranking:
    """Exact counts of the best pairs, by rank key (-count, left, right). Pairs that
    are not held lie behind ``edge`` (None: there are no others), except that those
    with a symbol of ``complete`` or above are all held."""

    def __init__(self, keep: int):
        self.keep, self.counts, self.heap = keep, {}, []
        self.edge: tuple[int, int, int] | None = None
        self.complete = 0

    def fetch(self, best: list[tuple[int, int, int]], whole: bool, symbols: int) -> None:
        self.counts = {(left, right): c for left, right, c in best}
        self.heap = [(-c, left, right) for left, right, c in best]
        heapq.heapify(self.heap)
        self._begin(None if whole or not best else (-best[-1][2], *best[-1][:2]), symbols)

    def _begin(self, edge: tuple[int, int, int] | None, symbols: int) -> None:
        self.edge, self.first_edge, self.risen = edge, edge, {}
        self.complete = 0 if edge is None else symbols

    def _valid(self, key: tuple[int, int, int]) -> bool:
        return self.counts.get(key[1:]) == -key[0]

    def first(self, n: int) -> list[tuple[int, int, int]]:
        """The first ``n`` keys, none behind the edge."""
        out: list[tuple[int, int, int]] = []
        while self.heap and len(out) < n:
            key = self.heap[0]
            if not self._valid(key) or out and key == out[-1]:
                heapq.heappop(self.heap)
            elif self.edge is not None and key > self.edge:
                break
            else:
                out.append(heapq.heappop(self.heap))
        for key in out:
            heapq.heappush(self.heap, key)
        return out

    def change(self, pair: tuple[int, int], by: int) -> None:
        count = self.counts.get(pair)
        if count is None:
            if max(pair) < self.complete:
                if by > 0:  # a pair that isn't held has become more frequent: by this at most it lies before the edge
                    rise = self.risen[pair] = self.risen.get(pair, 0) + by
                    self.edge = min(self.edge, (self.first_edge[0] - rise, -1, -1))
                return
            count = 0
        if count + by > 0:
            self.counts[pair] = count + by
            heapq.heappush(self.heap, (-count - by, *pair))
        else:
            self.counts.pop(pair, None)

    def prune(self, symbols: int) -> None:
        if len(self.counts) > 4 * self.keep:
            keys = heapq.nsmallest(self.keep, ((-c, *pair) for pair, c in self.counts.items()))
            edge = keys[-1] if self.edge is None else min(keys[-1], self.edge)
            self.fetch([(left, right, -c) for c, left, right in keys], False, symbols)
            self._begin(edge, symbols)
        elif len(self.heap) > 8 * self.keep:
            self.heap = [(-c, *pair) for pair, c in self.counts.items()]
            heapq.heapify(self.heap)


def _grams(text: str) -> set[str]:
    return {text[i:i + n] for n in (2, 3) for i in range(len(text) - n + 1)}


def n_buckets(n_words: int) -> int:
    return min(4096, max(8, n_words // 25_000))


def index_words(words: DataFrame, n_words: int) -> DataFrame:
    """``bucket, gram, word, count`` of all words of up to ``LONG_WORD`` characters,
    written by bucket and sorted by n-gram; a frequent n-gram's words are dealt to as
    many files as their number asks for."""
    spark, buckets = words.sparkSession, n_buckets(n_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                grams, names, counts = [], [], []
                for word, count in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = _grams(word)
                    grams += found
                    names += [word] * len(found)
                    counts += [count] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int64())],
                                                 names=["gram", "word", "count"])

    short = words.where(F.char_length("word").between(2, LONG_WORD)).select("word", "count")
    rows = short.mapInArrow(run, "gram string, word string, count long").withColumn("bucket", _bucket(F.col("gram"), buckets))
    deal = F.pmod(F.xxhash64("word"), F.lit(-(-n_words // 500_000) or 1))
    path = shared_dir(spark, "bpe-index")
    rows.repartition("bucket", deal).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)
    return spark.read.schema("gram string, word string, count long, bucket int").parquet(path)


def _bucket(gram, buckets: int):
    return (F.crc32(gram.cast("binary")) % buckets).cast("int")


def replayed(batches: Iterator[pa.RecordBatch], alphabet: dict[str, int], merges: list[Merge]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and counts as in :func:`blocks`, after all merges."""
    replay = Replay(alphabet, merges)
    for batch in batches:
        symbols = [x for word in batch.column(0).to_pylist() for x in (-1, *replay(word))]
        yield np.array([*symbols, -1], "i4"), batch.column(1).to_numpy()


class Rounds:
    """The words that guessed merges touch, and what the merges change."""

    def __init__(self, spark: SparkSession, words: DataFrame, n_words: int, alphabet):
        self.alphabet, self.index = alphabet, index_words(words, n_words)
        self.buckets = n_buckets(n_words)
        self.long = words.where(F.char_length("word") > LONG_WORD).select(F.lit("").alias("gram"), "word", "count")
        self.any_long = not self.long.isEmpty()
        known = self.index.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(KNOWN_GRAMS)
        self.known = {r["gram"]: r["n"] for r in known.collect()}

    def rarest(self, text: str) -> str:
        """The n-gram of a pair's string that the fewest words hold."""
        return min((g for g in _grams(text) if len(g) == 3 or len(text) == 2), key=lambda g: (self.known.get(g, 0), g))

    def changes(self, merges: list[Merge], guess: list[Merge], tokens: list[str]) -> list[dict[tuple[int, int], int]]:
        """Per guessed merge, by how much it changes the pairs' counts."""
        texts = [tokens[left] + tokens[right] for left, right, _ in guess]
        grams = sorted({self.rarest(t) for t in texts})
        alphabet = self.alphabet

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            replay, total = Replay(alphabet.value, merges), defaultdict(int)
            for batch in batches:
                for gram, word, count in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if gram and next(g for g in grams if g in word) != gram:
                        continue  # listed under an earlier one as well
                    steps = [i for i, t in enumerate(texts) if t in word]
                    if not steps:
                        continue
                    symbols = replay(word)
                    for i in steps:
                        left, right, new = guess[i]
                        pairs = list(zip(symbols, symbols[1:]))
                        if (left, right) not in pairs:
                            continue
                        symbols = fold(symbols, left, right, new)
                        for pair in pairs:
                            total[i, *pair] -= count
                        for pair in zip(symbols, symbols[1:]):
                            total[i, *pair] += count
            yield _columns({k: v for k, v in total.items() if v}, "step", "l", "r", "c")

        buckets = sorted({zlib.crc32(g.encode()) % self.buckets for g in grams})
        rows = self.index.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)).select("gram", "word", "count")
        touched = sum(self.known.get(g, 0) for g in grams)
        few = touched <= FEW_TASKS * TOUCHED_PER_TASK
        if few:
            rows = rows.coalesce(-(-touched // TOUCHED_PER_TASK) or 1)
        if self.any_long:
            rows = rows.unionAll(self.long)
        found = rows.mapInArrow(run, "step long, l long, r long, c long")
        if not few or self.any_long:  # many tasks: their sums are added up before they leave
            found = found.groupBy("step", "l", "r").agg(F.sum("c").cast("long").alias("c"))
        out: list[dict[tuple[int, int], int]] = [defaultdict(int) for _ in guess]
        for r in found.collect():
            out[r["step"]][r["l"], r["r"]] += r["c"]
        return out


class Scans:
    """All words in every round, as columns of symbols, without an index."""

    def __init__(self, words: DataFrame, alphabet):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield block(flat(batch.column(0).to_pylist(), alphabet.value), batch.column(1).to_numpy())

        self.table, self.written = materialize(words.select("word", "count").mapInArrow(run, BLOCK), "bpe-symbols"), 0
        self.tasks = max(1, self.table.rdd.getNumPartitions())

    def read(self, merges: list[Merge]):
        """What makes the symbols of words after ``merges``, and their counts, of rows of the table."""
        apply = Merges(merges[self.written:])
        return lambda batches: ((apply(symbols), counts) for symbols, counts in blocks(batches))

    def rewrite(self, merges: list[Merge]) -> None:
        """Write the words anew if many merges have been made since, without those of one symbol."""
        if len(merges) - self.written < min(REWRITTEN, max(LEAST_REWRITTEN, self.written // 2)):
            return
        read = self.read(merges)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for symbols, counts in read(batches):
                more = np.diff(np.flatnonzero(symbols < 0)) > 2
                yield block(symbols[np.append(more, True)[np.cumsum(symbols < 0) - 1]], counts[more])

        before = self.table
        self.table, self.written = materialize(before.mapInArrow(run, BLOCK), "bpe-symbols"), len(merges)
        self.tasks = max(1, self.table.rdd.getNumPartitions())
        discard(before)

    def changes(self, merges: list[Merge], guess: list[Merge], tokens: list[str]) -> list[dict[tuple[int, int], int]]:
        """Per guessed merge, by how much it changes the pairs' counts."""
        read = self.read(merges)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = defaultdict(int)
            for symbols, counts in read(batches):
                for i, (left, right, new) in enumerate(guess):
                    at = places(symbols, left, right)
                    if len(at):
                        symbols, keys, by = changed(symbols, at, new, counts)
                        for key, n in zip(keys.tolist(), by.tolist()):
                            total[i, key >> 32, key & 0xFFFFFFFF] += n
            yield _columns({k: v for k, v in total.items() if v}, "step", "l", "r", "c")

        found = self.table.mapInArrow(run, "step long, l long, r long, c long")
        found = found.groupBy("step", "l", "r").agg(F.sum("c").cast("long").alias("c")).where("c <> 0")
        out: list[dict[tuple[int, int], int]] = [defaultdict(int) for _ in guess]
        for r in found.collect():
            out[r["step"]][r["l"], r["r"]] += r["c"]
        return out

    def held(self, merges: list[Merge], pairs: list[tuple[int, int]]) -> Held:
        """The words that hold one of the first ``pairs``, as many pairs as there is room for.
        A task sends its words by the first pair that they hold, up to its share."""
        read, most = self.read(merges), max(1, HELD_SYMBOLS // self.tasks)
        asked = np.array([left << 32 | right for left, right in pairs])
        order = np.argsort(asked)
        asked = asked[order]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts, words, counts = [], [], []
            for symbols, some in read(batches):
                at, number = located(symbols, asked)
                if not len(at):
                    continue
                word = np.cumsum(symbols < 0) - 1
                first = np.full(word[-1], len(asked))
                np.minimum.at(first, word[at], order[number])
                hit = first < len(asked)
                words.append(np.append(symbols[np.append(hit, False)[word]], np.int32(-1)))
                firsts.append(first[hit])
                counts.append(some[hit])
            stop = len(asked)
            symbols, counts = joined(words), np.concatenate(counts) if counts else np.empty(0, "i8")
            if firsts:
                first, word = np.concatenate(firsts), np.cumsum(symbols < 0) - 1
                per_pair = np.cumsum(np.bincount(first, np.bincount(word[:-1]), len(asked)))
                stop = int(np.searchsorted(per_pair, most, "right"))
                symbols, counts = symbols[np.append(first < stop, True)[word]], counts[first < stop]
            yield pa.RecordBatch.from_arrays([pa.array([stop]), pa.array([symbols.astype("<i4").tobytes()]),
                                              pa.array([counts.astype("<i8").tobytes()])], names=["stop", "symbols", "counts"])

        found = self.table.mapInArrow(run, "stop long, symbols binary, counts binary").collect()
        stop = min((r["stop"] for r in found), default=len(pairs))
        return Held(joined([np.frombuffer(r["symbols"], "<i4") for r in found]),
                    np.concatenate([np.frombuffer(r["counts"], "<i8") for r in found] or [np.empty(0, "i8")]), pairs[:stop])


def joined(words: list[np.ndarray]) -> np.ndarray:
    """Several columns of words as one."""
    return np.concatenate([*(w[:-1] for w in words), np.array([-1], "i4")])


def located(symbols: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs of ``asked`` (left << 32 | right, in order) stand, and which ones."""
    most = int(max(symbols.max(initial=0), (asked >> 32).max(initial=0), (asked & 0xFFFFFFFF).max(initial=0)))
    is_left, is_right = np.zeros(most + 2, bool), np.zeros(most + 2, bool)
    is_left[asked >> 32] = is_right[asked & 0xFFFFFFFF] = True
    at = np.flatnonzero(is_left[symbols[:-1]] & is_right[symbols[1:]])
    key = symbols[at].astype("i8") << 32 | symbols[at + 1]
    number = np.minimum(np.searchsorted(asked, key), max(0, len(asked) - 1))
    good = asked[number] == key if len(asked) else np.zeros(len(at), bool)
    return at[good], number[good]


class Held:
    """All words that hold one of some pairs, and the merges of these pairs, and of pairs
    with a symbol that such a merge made. A pair's list may hold words that have lost it."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, pairs: list[tuple[int, int]]):
        self.pairs, self.counts = set(pairs), counts
        ends = np.flatnonzero(symbols < 0)
        self.start, self.size = ends[:-1] + 1, np.diff(ends) - 1
        self.symbols = symbols
        asked = np.sort(np.array([left << 32 | right for left, right in pairs], "i8"))
        numbers, words = [], []
        for a in range(0, len(symbols), LOOKED_UP):
            at, number = located(symbols[a:a + LOOKED_UP + 1], asked)
            numbers.append(number.astype("u4"))
            words.append((np.searchsorted(ends, a + at) - 1).astype("i4"))
        self.words: dict[int, list[np.ndarray]] = {}
        if numbers:
            self._list(asked, np.concatenate(numbers), np.concatenate(words))

    def _list(self, keys: np.ndarray, number: np.ndarray, word: np.ndarray) -> None:
        """``word``, in order, to the lists of the pairs ``keys[number]``."""
        order = np.argsort(number, kind="stable")
        number, word = number[order], word[order]
        bounds = np.searchsorted(number, np.arange(len(keys) + 1)).tolist()
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (number[1:] != number[:-1])
        for key, a, b in zip(keys.tolist(), bounds, bounds[1:]):
            if b > a:
                self.words.setdefault(key, []).append(word[a:b][new[a:b]])

    def merge(self, left: int, right: int, new: int) -> list[tuple[tuple[int, int], int]]:
        """Make a merge; by how much it changes the counts of which pairs."""
        found = self.words.pop(left << 32 | right, [])
        word = found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.empty(0, "i8")
        if not len(word):
            return []
        size = self.size[word]
        offset = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(self.start[word] - offset, size)
        some = np.full(len(place) + len(word) + 1, -1, "i4")
        some[np.arange(len(place)) + np.repeat(np.arange(1, len(word) + 1), size)] = self.symbols[place]
        at = places(some, left, right)
        if not len(at):
            return []
        some, keys, by = changed(some, at, new, self.counts[word])
        ends = np.flatnonzero(some < 0)
        self.size[word] = size = np.diff(ends) - 1
        offset = np.cumsum(size) - size
        self.symbols[np.arange(int(size.sum())) + np.repeat(self.start[word] - offset, size)] = some[some >= 0]
        near = np.flatnonzero(((some[:-1] == new) | (some[1:] == new)) & (some[:-1] >= 0) & (some[1:] >= 0))
        made, number = np.unique(some[near].astype("i8") << 32 | some[near + 1], return_inverse=True)
        self._list(made, number, word[np.searchsorted(ends, near) - 1].astype("i4"))
        return [((key >> 32, key & 0xFFFFFFFF), n) for key, n in zip(keys.tolist(), by.tolist())]


def _relaxed(first: list[tuple[int, int, int]], tokens: list[str], tok2id: dict[str, int], ratio: float) -> list[tuple[int, int, int]]:
    """The pairs that share no symbol and make new tokens, down to ``ratio`` of the top count."""
    used, made, out = set(), set(), []
    for key in first:
        c, left, right = key
        new = tokens[left] + tokens[right]
        if -c < ratio * -first[0][0]:
            break
        if left in used or right in used or left == right or new in tok2id or new in made:
            if not out:
                return [key]
            continue
        out.append(key)
        used |= {left, right}
        made.add(new)
    return out


def train(df: DataFrame, text_col: str, vocab_size: int, mode: str, relaxed_ratio: float, top_k: int,
          max_rounds: int | None) -> BpeModel:
    """See :func:`corpusflow.operators.bpe.train_bpe`."""
    spark = df.sparkSession
    wc = materialize(word_counts(df, text_col), "bpe-word-counts")
    alphabet = {r["ch"] for r in wc.select(F.explode(chars("word")).alias("ch")).distinct().collect()}
    alphabet |= set(byte_alphabet())
    tokens = [*SPECIALS, *(c for c in sorted(alphabet) if c not in set(SPECIALS))]
    tok2id = {t: i for i, t in enumerate(tokens)}
    merges: list[Merge] = []
    rounds, complete, guess_size, guessing, asked = 0, True, 2 * LEAST_GUESS, 0, FIRST_ASKED
    if len(tokens) >= vocab_size:
        discard(wc)
        return BpeModel(tokens, merges, rounds=0, tok2id=tok2id)
    n_words = wc.count()
    words = wc.repartition(max(-(-n_words // WORDS_PER_TASK), min(8, -(-n_words // TOUCHED_PER_TASK))))
    letters = spark.sparkContext.broadcast({t: i for t, i in tok2id.items() if t not in SPECIALS})
    scanned = vocab_size - len(tokens) <= SCANNED_MERGES
    if scanned:
        touched = Scans(words, letters)
    else:
        words = materialize(words, "bpe-words")
        touched = Rounds(spark, words, n_words, letters)
    discard(wc)
    ranking = Ranking(top_k)

    def fetch() -> None:
        if scanned:
            local = local_pairs(touched.table, touched.read(merges))
        else:
            so_far = list(merges)
            local = local_pairs(words.select("word", "count"), lambda batches: replayed(batches, letters.value, so_far))
        local = materialize(local, "bpe-local-pairs")
        ranking.fetch(*top_pairs(local, top_k), len(tokens))
        discard(local)

    def cover() -> bool:
        """A round that covers pairs; whether it made a merge."""
        nonlocal guessing, asked
        keys = ranking.first(asked)
        held = touched.held(merges, [key[1:] for key in keys])
        asked = min(MOST_COVERED, max(LEAST_ASKED, 4 * len(held.pairs)))
        guessing = THEN_GUESSED if len(held.pairs) < min(len(keys), FEW_COVERED) else 0
        known, before = len(tokens), len(merges)
        while len(tokens) < vocab_size and len(merges) - before < MOST_HELD:
            best = _relaxed(ranking.first(top_k), tokens, tok2id, relaxed_ratio) if mode == "relaxed" else ranking.first(1)
            if not best or any(key[1:] not in held.pairs and max(key[1:]) < known for key in best):
                break
            for _, left, right in best:
                if len(tokens) >= vocab_size:
                    break
                new = tok2id.setdefault(tokens[left] + tokens[right], len(tokens))
                if new == len(tokens):
                    tokens.append(tokens[left] + tokens[right])
                merges.append((left, right, new))
                for pair, by in held.merge(left, right, new):
                    ranking.change(pair, by)
            ranking.prune(len(tokens))
        return len(merges) > before

    fetch()
    while len(tokens) < vocab_size:
        if max_rounds is not None and rounds >= max_rounds:
            complete = False
            break
        if not ranking.first(1):
            if ranking.edge is None:
                break  # no pair is left
            fetch()
            continue
        if scanned:
            touched.rewrite(merges)
            if not guessing and cover():
                rounds += 1
                continue
            guessing = max(0, guessing - 1)
        keys = ranking.first(top_k if mode == "relaxed" else guess_size)
        if mode == "relaxed":
            keys = _relaxed(keys, tokens, tok2id, relaxed_ratio)
        guess: list[Merge] = []
        new_ids: dict[str, int] = {}
        for _, left, right in keys:
            new = tokens[left] + tokens[right]
            known = tok2id.get(new, new_ids.get(new))
            if known is None:
                if len(tokens) + len(new_ids) >= vocab_size:
                    break
                known = new_ids[new] = len(tokens) + len(new_ids)
            guess.append((left, right, known))
        changes = touched.changes(list(merges), guess, tokens)
        rounds += 1
        made = 0
        for (left, right, new), change in zip(guess, changes):
            if mode != "relaxed" and made:
                best = ranking.first(1)
                if not best or best[0][1:] != (left, right):
                    break
            if new == len(tokens):
                tokens.append(tokens[left] + tokens[right])
                tok2id[tokens[new]] = new
            merges.append((left, right, new))
            for pair, by in change.items():
                ranking.change(pair, by)
            made += 1
        ranking.prune(len(tokens))
        guess_size = min(MOST_GUESS, 2 * guess_size) if made == len(guess) else max(LEAST_GUESS, min(MOST_GUESS, 2 * made))
    if scanned:
        discard(touched.table)
    else:
        discard(words)
        discard(touched.index)
    return BpeModel(tokens, merges, rounds=rounds, tok2id=tok2id, complete=complete)
