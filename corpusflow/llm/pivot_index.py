"""Near-duplicate vectors by a pivot-permutation index (operator 12).

Every vector is described by its ``prefix`` nearest reference points (pivots), in
order of nearness. Inverted lists are kept for every combination of ``shared``
pivots, so that two vectors meet in a list just when their prefixes share at least
that many; a pair that shares more meets again and counts only in the list of its
least shared pivots. What meets is verified by its exact cosine.

Plan:

1. One pass over the table reads the vectors; equal vectors are one class with a
   count (partial aggregation), so copies are never compared.
2. Pivots are chosen from at most ``sample`` vectors, those of the least hash: one
   after another unless it is close to one already chosen, so that a group of near
   copies gives one pivot; random directions fill up. Their number grows with the
   square root of the classes, up to ``most_pivots``, which keeps lists short.
3. The written index has every class with its pivots. Lists of more than ``block``
   classes are cut into blocks by hash, and each pair of blocks is a unit of work of
   bounded size. A unit emits, per class, the sum of its links, and edges that span
   its linked classes: never its pairs.
4. Components by alternating stars; copies get the results of their class.

The index is fitted on a sample, holds every row, and loses the links of pairs that
share fewer pivots: recall is measured against brute force in the tests.

Defined cases: a vector that is null, empty, zero, or has a null or non-finite
component has no links, and itself as component; vectors of different lengths don't
link; a null id has no links and a null component; rows of one id and the same or
different vectors are vectors of their own, whose component is named by the least id;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.bpe_dp import slices
from corpusflow.llm.common import hash_sample, narrow
from corpusflow.llm.components import components
from corpusflow.session import materialize

#: Rows of one unit of work, and pairs of small lists compared at once.
BLOCK, PAIRS = 2048, 1 << 16
#: A pivot is no closer than this to the ones before it.
APART = 0.6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as double vectors of length 1, whatever their scale."""
    x = x.astype("f8")
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def classes(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``_id, f0, f1`` (null without a usable vector) and classes of equal ones:
    ``f0, f1, n, rep, dim, vector``."""
    single = isinstance(df.schema[vec_col].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                lists = part.column(1)
                flat = lists.flatten()
                nulls = np.asarray(flat.is_null())
                values = np.asarray(flat.fill_null(0)).astype(kind)
                size = np.asarray(lists.value_lengths().fill_null(0)).astype("i8")
                stop = np.cumsum(size)
                bad = nulls | ~np.isfinite(values)
                good, some = np.zeros(len(size) + 1, "i8"), np.concatenate([[0], np.cumsum(bad)])
                good[:-1] = some[stop] - some[stop - size]
                nonzero = np.concatenate([[0], np.cumsum(values != 0)])
                usable = (good[:-1] == 0) & (nonzero[stop] > nonzero[stop - size])
                raw = [values[b - n:b].tobytes() if u else None
                       for b, n, u in zip(stop.tolist(), size.tolist(), usable.tolist())]
                mark = [None if r is None else np.frombuffer(hashlib.blake2b(r, digest_size=16).digest(), "<i8") for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([None if m is None else int(m[i]) for m in mark], pa.int64()) for i in (0, 1)],
                     pa.array(size, pa.int64()), pa.array(raw, pa.binary())], names=["_id", "f0", "f1", "dim", "vector"])

    found = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v")).mapInArrow(
        run, "_id long, f0 long, f1 long, dim long, vector binary")
    rows = materialize(found, "pivot-rows")
    made = rows.where("f0 is not null and _id is not null").groupBy("f0", "f1").agg(
        F.count(F.lit(1)).alias("n"), F.min("_id").alias("rep"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    return rows.select("_id", "f0", "f1"), materialize(made, "pivot-classes")


@dataclass(frozen=True)
class Pivots:
    """Reference points per vector length, rows of length 1."""

    points: dict[int, np.ndarray]
    kind: str
    prefix: int
    shared: int

    def permutation(self, x: np.ndarray) -> np.ndarray:
        """The nearest pivots of vectors of one length, nearest first."""
        points = self.points.get(x.shape[1])
        if points is None:
            return np.empty((len(x), 0), "i4")
        near = x @ points.T
        k = min(self.prefix, len(points))
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1).astype("i4")


def fit(found: DataFrame, kind: str, prefix: int, shared: int, sample: int, most_pivots: int) -> Pivots:
    """Pivots from a bounded sample of the classes."""
    n = found.count()
    rows = hash_sample(found.select("f0", "f1", "dim", "vector"), sample, "f0", "f1").collect()
    wanted = min(most_pivots, max(64, int(2 * n ** 0.5)))
    points: dict[int, np.ndarray] = {}
    for dim in sorted({r["dim"] for r in rows}):
        x = unit(np.stack([np.frombuffer(r["vector"], kind) for r in rows if r["dim"] == dim]))
        chosen = np.empty((wanted, dim))
        size = 0
        for row in x:
            if size < wanted and (not size or (chosen[:size] @ row).max() < APART):
                chosen[size] = row
                size += 1
        fill = np.random.default_rng(dim).standard_normal((wanted - size, dim))
        points[dim] = np.concatenate([chosen[:size], unit(fill)]) if size < wanted else chosen
    return Pivots(points, kind, prefix, shared)


def index(found: DataFrame, pivots: Pivots) -> DataFrame:
    """Every class with ``pivots``, its nearest reference points in order, and
    ``keys``, the inverted lists that it stands in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048):
                dims = np.asarray(part.column(2))
                raw = part.column(3)
                order, keys = [None] * len(dims), [None] * len(dims)
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    x = unit(np.stack([np.frombuffer(raw[i].as_py(), pivots.kind) for i in at.tolist()]))
                    near = pivots.permutation(x)
                    lists = _lists(near, pivots.shared, dim)
                    for i, p, k in zip(at.tolist(), near.tolist(), lists.tolist()):
                        order[i], keys[i] = p, k
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(4), raw,
                     pa.array(order, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))],
                    names=["f0", "f1", "n", "vector", "pivots", "keys"])

    return found.select("f0", "f1", "dim", "vector", "n").mapInArrow(
        run, "f0 long, f1 long, n long, vector binary, pivots array<int>, keys array<long>")


def _lists(near: np.ndarray, shared: int, dim: int) -> np.ndarray:
    """Keys of all combinations of ``shared`` of the given pivots; fewer pivots than
    that make a single list."""
    sets = np.sort(near, axis=1).astype("i8")
    many = min(shared, sets.shape[1])
    out = []
    for part in combinations(range(sets.shape[1]), many):
        key = np.full(len(sets), dim, "i8")
        for i in part:
            key = (key << 14) + sets[:, i]
        out.append(key)
    return np.stack(out, 1)


def _first_list(a: np.ndarray, b: np.ndarray, shared: int, dim: int) -> np.ndarray:
    """The key of the least pivots that rows of two (sorted) prefixes share."""
    many = min(shared, a.shape[1])
    both = (a[:, :, None] == b[:, None, :]).any(2)
    nth = np.cumsum(both, axis=1)
    key = np.full(len(a), dim, "i8")
    for i in range(many):
        key = (key << 14) + np.where(both & (nth == i + 1), a, 0).sum(1)
    return key


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least linked row of each row, over links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_OUT = "f0 long, f1 long, links long, p0 long, p1 long"


def links(indexed: DataFrame, pivots: Pivots, threshold: float, block: int) -> DataFrame:
    """Per unit of work and linked class: the rows it links to, and an edge."""
    rows = indexed.select("f0", "f1", "n", "vector", "pivots", F.explode("keys").alias("key"))
    # only lists that are too long for one unit, at most one per ``block`` rows
    long_ = indexed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block)
    long_ = materialize(long_.select("key", F.ceil(F.col("c") / block).cast("int").alias("cuts")), "pivot-long-lists")
    rows = rows.join(narrow(long_, 32), "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("f0", "f1"), F.col("cuts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                       "f0", "f1", "n", "vector", F.array_sort("pivots").alias("pivots"))
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own")
    return rows.mapInArrow(lambda batches: _units(batches, pivots, threshold, block), _OUT)


def _units(batches: Iterator[pa.RecordBatch], pivots: Pivots, threshold: float, block: int) -> Iterator[pa.RecordBatch]:
    """Whole units, several small ones at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for part in slices(batch, block):
            held.append(part)
            n += part.num_rows
            if n >= 2 * block:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                begins = _begins(table)
                whole = int(begins[-1])  # the last unit may go on
                if whole:
                    yield from _linked(table.slice(0, whole), begins[:-1], pivots, threshold)
                held, n = [table.slice(whole)], table.num_rows - whole
    if n:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield from _linked(table, _begins(table), pivots, threshold)


def _begins(table: pa.RecordBatch) -> np.ndarray:
    unit_ = np.stack([np.asarray(table.column(c)).astype("i8") for c in range(3)])
    return np.flatnonzero(np.concatenate([[True], (unit_[:, 1:] != unit_[:, :-1]).any(0)]))


def _linked(table: pa.RecordBatch, begins: np.ndarray, pivots: Pivots, threshold: float) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(np.append(begins, table.num_rows))
    keep = np.repeat(sizes > 1, sizes)  # lists of one vector have nothing to compare
    if not keep.any():
        return
    table = table.filter(pa.array(keep))
    sizes = sizes[sizes > 1]
    begins = np.cumsum(sizes) - sizes
    key, i, j, own, f0, f1, n = [np.asarray(table.column(c)).astype("i8") for c in range(7)]
    raw, near = table.column(7), table.column(8)
    a_all, b_all = [], []
    width = np.asarray(pa.compute.binary_length(raw))
    # units of one vector length stand together: the length leads the key
    edges = np.flatnonzero(np.concatenate([[True], width[begins][1:] != width[begins][:-1]]))
    for e, first in enumerate(edges.tolist()):
        last = int(edges[e + 1]) if e + 1 < len(edges) else len(begins)
        lo, hi = int(begins[first]), int(begins[last - 1] + sizes[last - 1])
        x = unit(np.stack([np.frombuffer(v.as_py(), pivots.kind) for v in raw[lo:hi]]))
        sets = np.asarray(near[lo:hi].flatten()).reshape(hi - lo, -1).astype("i8")
        for a, b in _pairs(begins[first:last] - lo, sizes[first:last], x, i[lo:hi], j[lo:hi], own[lo:hi], threshold):
            mine = _first_list(sets[a], sets[b], pivots.shared, x.shape[1]) == key[lo:hi][a]
            a_all.append(a[mine] + lo)
            b_all.append(b[mine] + lo)
    if not sum(map(len, a_all)):
        return
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    total = np.zeros(len(n), "i8")
    np.add.at(total, a, n[b])
    np.add.at(total, b, n[a])
    root = _roots(len(n), a, b)
    at = np.flatnonzero(total)
    edge = root[at] != at
    yield pa.RecordBatch.from_arrays(
        [pa.array(f0[at]), pa.array(f1[at]), pa.array(total[at]),
         *[pa.array(f[root[at]], mask=~edge) for f in (f0, f1)]], names=["f0", "f1", "links", "p0", "p1"])


def _pairs(begins: np.ndarray, sizes: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, own: np.ndarray,
           threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one unit whose cosine is high enough; of a unit of two blocks,
    those between the blocks."""
    cut = i[begins] != j[begins]
    small = (sizes <= 64) & ~cut
    for at, size in zip(begins[~small].tolist(), sizes[~small].tolist()):
        split = at + int((own[at:at + size] == i[at]).sum())
        apart = i[at] != j[at]
        for p in range(at, split if apart else at + size, 512):
            q = min(p + 512, split if apart else at + size)
            base = split if apart else p + 1
            a, b = np.nonzero(x[p:q] @ x[base:at + size].T >= threshold)
            a, b = a + p, b + base
            yield (a, b) if apart else (a[b > a], b[b > a])
    begins, sizes = begins[small], sizes[small]
    count = sizes * (sizes - 1) // 2
    done = 0
    while done < len(begins):
        upto = max(done + 1, int(np.searchsorted(np.cumsum(count[done:]), PAIRS, "right")) + done)
        a, b = [], []
        for size in np.unique(sizes[done:upto]).tolist():
            at = begins[done:upto][sizes[done:upto] == size]
            u, v = np.triu_indices(size, 1)
            a.append((at[:, None] + u).ravel())
            b.append((at[:, None] + v).ravel())
        a, b = np.concatenate(a), np.concatenate(b)
        hit = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        yield a[hit], b[hit]
        done = upto


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", prefix: int = 6,
                    shared: int = 2, sample: int = 8192, most_pivots: int = 4096, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    kind = "<f4" if isinstance(df.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    rows, found = classes(df, id_col, vec_col)
    pivots = fit(found, kind, prefix, shared, sample, most_pivots)
    indexed = materialize(index(found, pivots), "pivot-index")
    met = materialize(links(indexed, pivots, threshold, block), "pivot-links")
    degree = met.groupBy("f0", "f1").agg(F.sum("links").alias("links"))
    edges = met.where("p0 is not null").select(F.struct("f0", "f1").alias("u"), F.struct(F.col("p0").alias("f0"), F.col("p1").alias("f1")).alias("v"))
    joined = components(edges, "pivot-components").select("node.f0", "node.f1", "component")
    # a class without links and copies says nothing that its row doesn't
    said = found.select("f0", "f1", "n", "rep").join(degree, ["f0", "f1"], "left").join(joined, ["f0", "f1"], "left")
    said = said.where("n > 1 or links is not null")
    least = said.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    said = said.join(least, "component", "left").select(
        "f0", "f1", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("least"))
    said = narrow(materialize(said, "pivot-classes-linked"), 48)
    out = rows.join(said, (rows["f0"] == said["f0"]) & (rows["f1"] == said["f1"]) & rows["_id"].isNotNull(), "left")
    out = out.select(F.col("_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.coalesce("least", "_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
