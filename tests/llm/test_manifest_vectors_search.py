"""Merkle manifest, pivot index and NRA search against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusflow.llm import merkle, nra, pivot_index, queries

SF = "/root/testdata/sf0.001"
EXTRA = "g string, at long, nodes long, leaf string, fold string, path string, root string, _row string, _m long"
JUNK = ("x", 1, 2, "l", "f", "p", "r", "m", 3)


# -- 11 --------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sized(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests, fanout=2):
    """Root and, per digest, (left, right) siblings level by level."""
    paths, own = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, below = [], []
        for i in range(0, len(digests), fanout):
            run = digests[i:i + fanout]
            for j in range(len(run)):
                for x in own[i + j]:
                    paths[x].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(sha(*run))
            below.append(sum(own[i:i + fanout], []))
        digests, own = up, below
    return digests[0], paths


def manifest_rows(rows, fanout=2):
    """Expected audit of (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, n: sha(*map(sized, (r[0], r[1], r[2], n, r[4])))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    made = []
    for n in names:
        mine = sorted(groups[n], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[3])))
        made.append((mine, *tree([leaf(r, r[3]) for r in mine], fanout)))
    root, tops = tree([m[1] for m in made], fanout)
    out = []
    for (mine, subroot, paths), top in zip(made, tops):
        for r, path in zip(mine, paths):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, r[3] + 1 if hit else r[3])
            for left, right in path + top:
                node = sha(left, node, right)
            out.append((r[0], leaf(r, r[3]), subroot, root, sha(*[a + b for a, b in path + top]), node, node == root))
    return out


def rank(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


ODD_DOCS = [(1, "a", "en", 3, "one"), (1, "a", "en", 3, "one"), (1, "b", "en", 3, "other"), (None, None, "en", None, None),
            (None, "s", None, 5, "x" * 200_000), (3, "s", None, None, ""), (4, "s", "é", 9_223_372_036_854_775_807, "日本"),
            (-7, "s", "z", -1, "a:b"), *[(i, "hot", "en", i, f"text {i}") for i in range(10, 150)]]


@pytest.mark.parametrize("fanout, levels", [(2, 6), (2, 1), (3, 2)])
def test_merkle_against_a_plain_tree(spark, fanout, levels):
    schema = "doc_id long, source string, lang string, n_chars long, text string, " + EXTRA
    df = spark.createDataFrame([r + JUNK for r in ODD_DOCS], schema).repartition(3)
    got = [tuple(r) for r in merkle.audit(merkle.manifest(df, fanout=fanout, levels=levels)).collect()]
    assert rank(got) == rank(manifest_rows(ODD_DOCS, fanout))
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_merkle_of_one_row_and_of_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = [(5, "s", "en", 1, "t")]
    got = [tuple(r) for r in merkle.audit(merkle.manifest(spark.createDataFrame(one, schema))).collect()]
    assert got == manifest_rows(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")
    assert merkle.audit(merkle.manifest(spark.createDataFrame([], schema))).collect() == []


def test_merkle_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    found = queries.QUERIES["op11_merkle_pivot"](spark, SF)
    assert found.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rank(tuple(r) for r in found.collect()) == rank(manifest_rows([tuple(r) for r in docs.collect()]))


# -- 12 --------------------------------------------------------------------------

def near(ids, x):
    """Per row (links, least id reachable), by comparing all pairs."""
    x = np.array(x, "f8")
    x = x / np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], label.max()).min(1))
        if (new == label).all():
            return list(zip(hit.sum(1).tolist(), label.tolist()))
        label = new


def found_rows(df):
    return [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_pivot_index_finds_groups_copies_and_chains(spark, kind):
    rng = np.random.default_rng(3)
    group = rng.standard_normal(24) + 0.12 * rng.standard_normal((90, 24))
    chain = [np.eye(24)[0] * math.cos(0.4 * i) + np.eye(24)[1] * math.sin(0.4 * i) for i in range(8)]
    rest = rng.standard_normal((150, 24))
    x = np.concatenate([rest, group, chain, [rest[0] * 3, rest[1], rest[1]]])
    if kind == "float":
        x = x.astype("f4").astype("f8")
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in zip(ids, x.tolist())],
                               f"vec_id long, embedding array<{kind}>, f0 string, n long")
    want = [(i, n, c, i == c) for i, (n, c) in zip(ids, near(ids, x))]
    for block in (2048, 16):  # lists cut into blocks give the same
        assert sorted(found_rows(pivot_index.near_duplicates(df, block=block))) == sorted(want)


def test_pivot_index_recall_at_the_threshold_and_no_false_links(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.88, 0.93, len(base))[:, None]
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos * cos) * side])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    want = [n for n, _ in near(list(range(len(x))), x)]
    got = {i: n for i, n, _, _ in found_rows(pivot_index.near_duplicates(df))}
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.95 * sum(want)


def test_pivot_index_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2e300, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (10, [0.0, 1.0]), (11, [1e-300, 1e-301]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True),
            (8, 0, 8, True), (9, 0, 9, True), (None, 0, None, True), (10, 1, 10, True), (10, 1, 10, True), (11, 2, 1, False), (12, 0, 12, True)]
    assert rank(found_rows(pivot_index.near_duplicates(df))) == rank(want)
    assert pivot_index.near_duplicates(df.where("false")).collect() == []


def test_pivot_index_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = queries.QUERIES["op12_pivot_index"](spark, SF)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = [(i, n, c, i == c) for (i, _), (n, c) in zip(rows, near([r[0] for r in rows], [r[1] for r in rows]))]
    assert sorted(found_rows(found)) == sorted(want)


# -- 13 --------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranking(docs, items, k=10):
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for q, text in items:
        scores = []
        for i, c in found:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                    for t, r in Counter(TERM.findall((text or "").translate(LOWER))).items() if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def test_terms_are_ascii_letters_digits_and_all_else():
    every = "".join(map(chr, [*range(0x3000), 0x1F600, 0x1F601])) + " Straße ÄÖ İx K"
    assert [t.decode() for t in nra.terms(every)] == TERM.findall(every.translate(LOWER))


@pytest.mark.parametrize("options", [{}, {"postings": 40}, {"postings": 300, "item_bytes": 60}])
def test_nra_against_all_scores(spark, options):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(59, int(x))] for x in rng.exponential(12, n))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(400)]
    docs += [(i, "w1 w2 w3") for i in range(500, 560)]  # ties
    docs += [(1000, None), (1001, ""), (1002, " \t.,-"), (None, "w1 w2 w50"), (1003, "W1,w2;É日 w1\x00w9"), (1003, "w9 w9"), (1004, "w7 " * 40_000)]
    items = [(1, "w1 w2 w3"), (2, text(30)), (2, "w50 w50 w51"), (3, None), (4, "--"), (5, "nowhere"), (None, "w9 é日"), (6, text(300)), (7, "É日")]
    a = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in docs], "doc_id long, text string, n long, terms string, shard long").repartition(4)
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, q long")
    got = [tuple(r) for r in nra.search(a, b, **options).collect()]
    assert rank(got) == rank(ranking(docs, items))


def test_nra_stops_early_and_is_exact():
    """Most postings of long lists stay unread once the best are settled."""
    rng = np.random.default_rng(2)
    n = 100_000
    lists = {}
    for t in range(3):
        values = np.sort(rng.integers(1, 1000, n))[::-1].astype("i4")
        values[:20] += 50_000
        lists[t] = (np.concatenate([np.arange(20), 20 + rng.permutation(n - 20)]).astype("i4"), values)
    touched = []

    class Spied(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                touched.append(at.stop - at.start)
            return np.asarray(super().__getitem__(at)) if isinstance(at, slice) else np.asarray(self)[at]

    shard = nra.Shard(np.arange(n), {t: (d.view(Spied), v) for t, (d, v) in lists.items()})
    total = np.zeros(n, "i8")
    for d, v in lists.values():
        total[d] += v.astype("i8") * 7
    best = np.lexsort((np.arange(n), -total))[:10]
    assert shard.best([(t, 7) for t in range(3)], 10, 0) == [(int(p), int(total[p])) for p in best]
    assert sum(touched) < 0.1 * 3 * n


def test_nra_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [tuple(r) for r in nra.search(docs, items).collect()] == ranking([(1, "a b")], [(1, "a")])
    assert nra.search(docs.where("false"), items).collect() == []
    assert nra.search(docs, items.where("false")).collect() == []


def test_nra_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = queries.QUERIES["op13_nra"](spark, SF)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(ranking(docs, items))
