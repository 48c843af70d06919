"""Jaccard self-join of word n-gram sets by PartEnum signatures (operator 2).

Sets fall into size bands such that a link joins sets of one band or of
neighbouring bands; a set takes part in its own band's instance and in the next.
Within an instance a link's sets differ in at most k features. The feature domain
is cut into n1 groups and each group into n2 parts; of a link's groups all but
k // (k2 + 1) differ in at most k2 features, so that some n2 - k2 parts of such a
group are equal. A signature is the content of n2 - k2 parts of one group, for all
such subsets: linked sets share one. n1 has a few groups to spare, so that groups
with an empty signature can be left out; a set with more of those than to spare
signs again under another cut of the domain, as does any set it could miss.

From signatures to components:

1. One pass writes, per document, its set's size, fingerprint, parity sketch and
   signatures (once per set and task). Equal sets are one class, known by the number
   of the one row that signs for it; copies are never paired.
2. Signatures are exchanged once, as (signature, class), and those of a single class
   fall away where they meet. They are exchanged in portions by their leading bits, one
   after the other, so that a portion is all that the exchange holds on disk. Sizes and
   sketches stay in a table of their own, and wide sketches of large sets in another.
3. Rounds: in each group of a signature, one leader is paired with the members of
   other components; sizes and sketches rule out what they can, then wide sketches do;
   exact intersections decide, and components are merged. A group of near copies becomes one component
   this way without all its pairs.
4. Last, all pairs of a group that are still in different components are compared,
   unless sizes or sketches rule them out, both of which are exact bounds. So no
   link that could join two components is left out.

Defined cases: a null or empty text, or one of white space, has an empty set, no
links and itself as component; a text of fewer than ``words`` words has one
feature, its whole sequence; a null id has no links and a null component; rows with one id and
different texts are linked by their own texts; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.bpe_dp import slices
from corpusflow.llm.common import narrow, whole
from corpusflow.llm.components import components
from corpusflow.session import discard, materialize

REMEMBERED = 600_000
SKETCH = 8  # longs of the parity sketch
PORTIONS = 4  # of the signatures, a power of two
FEATURES = 3  # least features in a signature's parts, on average
SEEDS = 12  # cuts of the domain, for sets with many empty signatures
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection that scatters 64-bit integers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Shingles(dict):
    """Words -> 64-bit hashes, remembered per worker; texts -> sets of n-gram hashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, text: str, words: int) -> np.ndarray:
        """Sorted distinct features. Of bytes, ``lower`` and ``split`` know only A-Z
        and the six white-space characters of the contract."""
        w = np.array(list(map(self.__getitem__, text.encode().lower().split())), "u8")
        if not len(w):
            return w
        n = min(len(w), words)
        out = np.full(len(w) - n + 1, n, "u8")
        for i in range(n):
            out = mix(out * MIX + w[i:len(w) - n + 1 + i])
        return np.unique(out)


_SHINGLES = Shingles()


@cache
def bands(percent: int, size: int) -> tuple[int, int, int]:
    """(index, least, most size) of the band that has a size."""
    i, low = 0, 1
    while True:
        high = low * 100 // percent
        if size <= high:
            return i, low, high
        i, low = i + 1, high + 1


@cache
def cuts(percent: int, low: int, high: int) -> tuple[int, int, int, int] | None:
    """(n1, n2, k2, spare) for the instance whose band is from ``low`` to ``high``;
    None if its sets can't differ. The fewest signatures whose parts hold three
    features or more on average, with groups to spare for a hundredth of the sets."""
    k = 2 * high * (100 - percent) // (100 + percent)
    if not k:
        return None
    best = None
    for k2, n2 in ((0, 1), (1, 2), (1, 3), (2, 4)):
        for spare in range(0, 1 + k):
            n1 = k // (k2 + 1) + 1 + spare
            empty = min(1.0, comb(n2, k2) * float(np.exp(-low / n1 * (n2 - k2) / n2)))
            miss = 1 - sum(comb(n1, j) * empty ** j * (1 - empty) ** (n1 - j) for j in range(spare + 1)) \
                if n1 < 400 else float(n1 * empty > spare / 3)
            if miss <= 0.01:
                break
        cost = (low / n1 * (n2 - k2) / n2 < FEATURES, n1 * comb(n2, k2))
        if best is None or cost < best[0]:
            best = (cost, (n1, n2, k2, spare))
    return best[1]


def signatures(features: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a set, in both instances that it takes part in."""
    i, low, high = bands(percent, len(features))
    out = []
    for at, (a, b) in ((i, (low, high)), (i + 1, bands(percent, high + 1)[1:])):
        cut = cuts(percent, a, b)
        if cut is None:
            continue
        n1, n2, k2, spare = cut
        for seed in range(SEEDS):
            tag = np.uint64((at << 8) + seed)
            h = mix(features ^ mix(np.array([tag + np.uint64(1)]) * MIX))
            cell = ((h >> np.uint64(32)) % np.uint64(n1 * n2)).astype("i8")
            order = np.argsort(cell, kind="stable")
            cell, h = cell[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            total, count = np.zeros(n1 * n2, "u8"), np.zeros(n1 * n2, "i8")
            total[cell[first]] = np.add.reduceat(mix(h), first)
            count[cell[first]] = np.diff(np.append(first, len(cell)))
            total = mix(total + np.arange(n1 * n2, dtype="u8") * MIX).reshape(n1, n2)
            count, made, filled = count.reshape(n1, n2), [], []
            for t, parts in enumerate(combinations(range(n2), n2 - k2)):
                made.append(mix(total[:, parts].sum(1, dtype="u8") * MIX + (tag << np.uint64(8)) + np.uint64(t)))
                filled.append(count[:, parts].sum(1) > 0)
            made, filled = np.stack(made, 1), np.stack(filled, 1)
            out.append(made[filled])
            if (~filled.all(1)).sum() <= spare:
                break
        else:
            out.append(made[~filled])  # no cut suits this set: empty parts sign as well
    return np.unique(np.concatenate(out)) if out else np.empty(0, "u8")


def sketch(features: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """Parity of the features in each of 64 * ``longs`` cells: two sketches differ in
    no more cells than their sets in features."""
    n = 64 * longs
    odd = np.bincount((mix(features * MIX) % np.uint64(n)).astype("i8"), minlength=n) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("<i8")


def wide(features: np.ndarray) -> np.ndarray:
    """A sketch of two to four cells a feature, for sets that fill the short one; its
    longs are a power of two, so that the longer of two folds into the other's cells."""
    n = len(features)
    return sketch(features, 1 << (2 * n // 64 - 1).bit_length()) if n > 64 * SKETCH else np.empty(0, "<i8")


FIELDS = [f"s{i}" for i in range(SKETCH)]
SIGS = [f"sigs{i}" for i in range(PORTIONS)]
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()), ("signs", pa.bool_()),
                   *[(s, pa.list_(pa.int64())) for s in (*SIGS, "wide")], *[(s, pa.int64()) for s in FIELDS]])
SETS = "doc_id long, n_shingles long, f0 long, f1 long, signs boolean, " + \
    ", ".join([f"{s} array<long>" for s in (*SIGS, "wide")] + [f"{s} long" for s in FIELDS])


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype("i4"))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows)))


def sign(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: set size, fingerprint, sketch, and signatures (sorted, in portions)
    and wide sketch if it is the first of its set in its task."""
    edges = np.arange(1, PORTIONS, dtype="u8") * np.uint64((1 << 64) // PORTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in slices(batch, 1024):
                ids, size, prints, sigs, wides, lines = part.column(0).to_pylist(), [], [], [], [], []
                for doc_id, text in zip(ids, part.column(1).to_pylist()):
                    found = _SHINGLES.of(text, words)
                    mark = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    new = len(found) > 0 and doc_id is not None and mark not in seen
                    if new:
                        seen.add(mark)
                    size.append(len(found))
                    prints.append(mark)
                    own = signatures(found, percent) if new else np.empty(0, "u8")
                    sigs.append(np.split(own.view("i8"), np.searchsorted(own, edges)))
                    wides.append(wide(found) if new else np.empty(0, "<i8"))
                    lines.append(sketch(found))
                marks = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
                lines = np.stack(lines)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                     pa.array([any(map(len, s)) for s in sigs], pa.bool_()),
                     *[_lists([s[i] for s in sigs]) for i in range(PORTIONS)], _lists(wides),
                     *[pa.array(lines[:, i]) for i in range(SKETCH)]], schema=_SETS)

    return whole(docs, id_col, text_col).mapInArrow(run, SETS)


def _features(docs: DataFrame, reps: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``c, features`` of the classes in ``reps(c, rep, f0, f1)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [_SHINGLES.of(t, words) for t in part.column(1).to_pylist()]
                marks = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets),
                                      "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                     pa.array([s.view("i8") for s in sets], pa.list_(pa.int64()))], names=["rep", "f0", "f1", "features"])

    ids = reps.select(F.col("rep").alias("_id")).distinct()
    texts = whole(docs, id_col, text_col).join(narrow(ids, 16), "_id", "left_semi")
    sets = texts.mapInArrow(run, "rep long, f0 long, f1 long, features array<long>")
    # an id may have other texts too, and a row may be there twice
    return sets.join(narrow(reps, 40), ["rep", "f0", "f1"]).select("c", "features").dropDuplicates(["c"])


def link_components(docs: DataFrame, words: int = 4, percent: int = 85, rounds: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document: sets link when
    100 * intersection >= percent * union."""
    # every row has a number; a class is known by that of the one row that signs for it
    numbered = sign(docs, words, percent, id_col, text_col).withColumn("r", F.monotonically_increasing_id())
    written = materialize(numbered, "partenum-sets")
    signed = materialize(written.select("r", "doc_id", "n_shingles", "f0", "f1", *FIELDS, "signs"), "partenum-documents")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("f0", "f1").agg(F.min(F.when(F.col("signs"), F.col("r"))).alias("c"), F.min("doc_id").alias("rep"),
                                           F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "partenum-classes")
    # a class may have signed in several tasks: all signers but one of each go
    copies = full.where("signs").select("r", "f0", "f1").join(classes.where("n > 1").select("f0", "f1", "c"), ["f0", "f1"])
    copies = narrow(materialize(copies.where("r <> c").select("r"), "partenum-copies"), 16)
    rows = written.where("doc_id is not null and signs").join(copies, "r", "left_anti")
    # the one exchange of all signatures: those of a single class fall away where they meet
    members = None
    for sigs in SIGS:
        part = rows.select(F.explode(sigs).alias("sig"), F.col("r").alias("c")).repartition("sig")
        part = part.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sig"))).where("n > 1").select("sig", "c")
        part = materialize(part, "partenum-members")
        members = part if members is None else members.unionAll(part)
    shared = materialize(members.select("c").distinct(), "partenum-shared")
    wides = written.where(F.size("wide") > 0).select(F.col("r").alias("c"), "wide").join(narrow(shared, 16), "c", "left_semi")
    wides = materialize(wides, "partenum-wide")
    discard(written)  # the signatures, by far the largest table, have done their work
    info = full.where("signs").select(F.col("r").alias("c"), "n_shingles", *FIELDS).join(narrow(shared, 16), "c", "left_semi")
    info = materialize(info, "partenum-info")
    reps = materialize(classes.select("c", "rep", "f0", "f1").join(narrow(shared, 16), "c", "left_semi"), "partenum-reps")

    links, comp = None, None
    for step in range(rounds + 1):
        open_ = members.withColumn("comp", F.col("c")) if comp is None else \
            members.join(comp.withColumnRenamed("node", "c"), "c", "left") \
            .select("sig", "c", F.coalesce("component", "c").alias("comp"))
        group = Window.partitionBy("sig")
        if comp is not None:  # groups within one component are done
            open_ = open_.withColumn("x", F.min("comp").over(group)).withColumn("y", F.max("comp").over(group)).where("x < y")
            done, members = members, materialize(open_.select("sig", "c", "comp"), "partenum-open")
            discard(done)
            open_, members = members, members.select("sig", "c")
            if open_.isEmpty():
                break
        if step < rounds:  # one leader for each signature, another one each round
            lead = F.min(F.struct(F.xxhash64(F.lit(step), "c").alias("h"), "c", "comp")).over(group)
            pairs = open_.withColumn("l", lead).where("comp <> l.comp").select(
                F.least("c", "l.c").alias("u"), F.greatest("c", "l.c").alias("v")).distinct()
        else:
            pairs = _pairs(open_.join(info, "c"), percent)
        # sets are made for the classes of pairs that sizes and sketches leave, and deleted after the round
        pairs = materialize(_possible(pairs, info, wides, percent), "partenum-pairs")
        if pairs.isEmpty():
            found = pairs
        else:
            nodes = materialize(pairs.select(F.col("u").alias("c")).unionAll(pairs.select("v")).distinct(), "partenum-nodes")
            sets = materialize(_features(docs, reps.join(narrow(nodes, 16), "c", "left_semi"), words, id_col, text_col), "partenum-features")
            found = materialize(_verified(pairs, sets, percent), f"partenum-links{step}")
            discard(sets)
        links = found if links is None else links.unionAll(found)
        comp = components(links)
    named = classes.where("n > 1").select("f0", "f1", F.col("rep").alias("least"))
    if comp is not None:
        linked = comp.withColumnRenamed("node", "c").join(classes.select("c", "f0", "f1", "rep"), "c")
        least = linked.groupBy("component").agg(F.min("rep").alias("least"))
        linked = linked.join(least, "component").select("f0", "f1", "least")
        named = linked.unionAll(named.join(linked, ["f0", "f1"], "left_anti"))
    # a set that is alone and has no links needs no join
    named = narrow(materialize(named, "partenum-named"), 40)
    out = signed.select("doc_id", "n_shingles", "f0", "f1").join(named, ["f0", "f1"], "left")
    linked = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), linked).alias("component_id"))


def _apart(a: str, b: str, percent: int) -> Column:
    """Whether neither the sizes nor the sketches of two sets rule a link out."""
    both = F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles")
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in FIELDS), F.lit(0))
    least, most = (f(f"{a}.n_shingles", f"{b}.n_shingles") for f in (F.least, F.greatest))
    return (least * 100 >= most * percent) & (apart * (100 + percent) <= both * (100 - percent))


def _pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs that share a signature and are in different components."""
    a, b = open_.alias("a"), open_.alias("b")
    return a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.comp") < F.col("b.comp")) & _apart("a", "b", percent)).select(
        F.least("a.c", "b.c").alias("u"), F.greatest("a.c", "b.c").alias("v")).distinct()


def _possible(pairs: DataFrame, info: DataFrame, wides: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and sketches don't rule out, the wide ones last."""
    x = pairs.join(info.alias("a"), F.col("u") == F.col("a.c")).join(info.alias("b"), F.col("v") == F.col("b.c"))
    x = x.where(_apart("a", "b", percent)).select("u", "v", (F.col("a.n_shingles") + F.col("b.n_shingles")).alias("both"))
    x = x.join(wides.select(F.col("c").alias("u"), F.col("wide").alias("p")), "u", "left")
    x = x.join(wides.select(F.col("c").alias("v"), F.col("wide").alias("q")), "v", "left")
    longs = F.least(F.size("p"), F.size("q"))

    def folded(w: str) -> Column:
        halves = F.zip_with(F.slice(w, 1, longs), F.slice(w, longs + 1, longs), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(w) > longs, halves).otherwise(F.col(w))

    odd = F.aggregate(F.zip_with(folded("p"), folded("q"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, b: n + b)
    # sizes that differ more than twofold, which low similarities allow, are left to the exact check
    other = F.greatest(F.size("p"), F.size("q")) > 2 * longs
    out = F.col("p").isNull() | F.col("q").isNull() | other | (odd * (100 + percent) <= F.col("both") * (100 - percent))
    return x.where(out).select("u", "v")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets' exact Jaccard similarity is high enough."""
    x = pairs.join(sets.select(F.col("c").alias("u"), F.col("features").alias("p")), "u")
    x = x.join(sets.select(F.col("c").alias("v"), F.col("features").alias("q")), "v")
    x = x.select("u", "v", F.size(F.array_intersect("p", "q")).alias("i"), (F.size("p") + F.size("q")).alias("n"))
    return x.where(F.col("i") * (100 + percent) >= F.col("n") * percent).select("u", "v")
