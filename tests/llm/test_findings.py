"""Findings of the last review: clashing names and ids, very long tokens, conflicting
labels, and the registered queries by their contracts."""

import time
import zlib
from collections import Counter

import pytest

from corpusflow.llm import deobfuscate, nbsvm, pii_boost, queries, rule_ledger

SF = "/root/testdata/sf0.001"


def test_ledger_keeps_columns_with_the_names_of_its_helpers(spark):
    names = ["_t", "_s", "_words", "_lines", "_hashes", "_repeats", "_sorted", "_at", "given", "a.b", "0", "_"]
    text = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = rule_ledger.verdicts(rule_ledger.ledger(df), rule_ledger.STRICT)
    row = out.first().asDict()
    assert [row[n] for n in names] == names and row["n_words"] == 30 and row["kept"] is True
    plain = rule_ledger.ledger(df.select("doc_id", "text")).first().asDict()
    assert all(row[k] == v for k, v in plain.items())


def test_long_tokens_take_linear_time():
    words = "stupid idiot trash people reading books every day".split()
    counts = Counter(g for w in words for g in [f"^^{w}$"[i:i + 3] for i in range(len(w) + 1)])
    model = deobfuscate.CharModel(counts)
    took = []
    for n in (20_000, 160_000):
        t = time.perf_counter()
        model.restore("a1b2$c0d!" * (n // 9))
        took.append(time.perf_counter() - t)
    assert took[1] < 20 * max(took[0], 0.05)
    restorer = deobfuscate.Restorer(model)
    assert restorer.text("x" * 50_000 + " 1d10t") .endswith("idiot")
    assert all(len(t) <= deobfuscate.LONGEST for t in restorer.seen)


def test_many_spans_are_selected_in_time():
    class Sure:
        def margin(self, x):
            return x[:, 0]

    import numpy as np
    feats = lambda v: np.array([v], "f4").tobytes()
    rows = [(0, 10 * i + s, 10 * i + s + 6, pii_boost.PROPOSED, feats(5.0 - s)) for i in range(50_000) for s in (0, 3)]
    t = time.perf_counter()
    got = pii_boost.select_spans(rows, {0: (Sure(), 1.0, 0.0, 0.5)})
    assert time.perf_counter() - t < 30
    assert sorted(got) == [(0, 10 * i, 10 * i + 6) for i in range(50_000)]


@pytest.mark.parametrize("module, label", [(deobfuscate, "toxic"), (nbsvm, "quality")])
def test_of_conflicting_labels_the_greatest_counts(spark, module, label):
    docs = spark.createDataFrame([(i, "bad words here" if i % 2 else "good words there") for i in range(400)], "doc_id long, text string")
    one = [(i, i % 2) for i in range(400)]
    conflict = one + [(i, 0) for i in range(1, 400, 2)]
    a, b = (module.score(docs, module.train(docs, spark.createDataFrame(rows, f"doc_id long, {label} int"), label)) for rows in (one, conflict))
    assert sorted((r.doc_id, round(r.score, 9)) for r in a.collect()) == sorted((r.doc_id, round(r.score, 9)) for r in b.collect())


def test_pipeline_join_keeps_unlinked_rows_of_one_id(spark):
    import corpus_pipeline
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    near = text(5).replace("w5x39", "changed")
    rows = [(1, text(1)), (1, text(2)), (2, text(3)), (2, text(3)), (3, text(3)), (None, text(1)), (None, text(4)), (5, text(5)), (4, near),
            (6, None), (7, ""), (6, "three words only")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.jaccard_join(spark, docs.withColumn("_row", docs.doc_id), SF)
    assert tuple(got.columns) == corpus_pipeline.COLUMNS
    want = [(1, text(1)), (1, text(2)), (2, text(3)), (None, text(4)), (4, near), (6, None), (7, ""), (6, "three words only")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


TYPES = {
    "op1_token_store": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3_bpe_prefix": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_min_bin_slack": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
                          "sequence_id": "bigint", "offset": "bigint"},
    "op6_deobfuscate": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_mincut_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


@pytest.mark.parametrize("name", TYPES)
def test_registered_queries_return_their_contract(spark, name):
    found = queries.QUERIES[name](spark, SF)
    types = dict(found.dtypes)
    assert {c: types.get(c) for c in TYPES[name]} == TYPES[name]
    rows = found.collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    if name == "op10_mincut_html":
        assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
        assert all(r.n_chars == len(r.text) for r in rows)
        return
    assert {r.doc_id for r in rows} == set(docs)
    if name == "op6_deobfuscate":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
                   for r in rows)
        return
    import hashlib

    import numpy as np
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.BYTE_BPE if name == "op3_bpe_prefix" else queries.WORD_BPE)
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    raw = lambda x: np.array(x, "<u4").tobytes()
    if name == "op1_token_store":
        at = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            want = ids[r.doc_id] + [1]
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(raw(want)))
            at += len(want)
    elif name == "op3_bpe_prefix":
        for r in rows:
            assert r.n_tokens == len(ids[r.doc_id]) and r.ids_sha256 == hashlib.sha256(raw(ids[r.doc_id])).hexdigest()
            text = tokenizer.decode(ids[r.doc_id], skip_special_tokens=False)
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    else:
        for r in rows:
            whole = ids[r.doc_id] + [0]
            part = whole[r.start:r.start + r.length]
            assert r.start == 2048 * r.piece and len(part) == r.length and r.ids_crc32 == zlib.crc32(raw(part))
        assert sum(r.length for r in rows) == sum(len(x) + 1 for x in ids.values())
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for found in places.values():
            at = 0
            for offset, length in sorted(found):
                assert offset == at
                at += length
            assert at <= 2048
