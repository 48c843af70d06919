"""Registered queries without SQL hold their contracts on a whole small table."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def run(spark, name, **types):
    df = entry.queries()[name](spark, SF)
    assert {c: dict(df.dtypes)[c] for c in types} == types
    return df.collect()


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in sorted(rows)}


def test_op1(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = run(spark, "op1_token_store", doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint")
    want, start = {}, 0
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)


def test_op3(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = run(spark, "op3_bpe_prefix", doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    want = {}
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                   hashlib.sha256(decoded.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == want


def test_op4(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = run(spark, "op4_min_bin_slack", doc_id="bigint", piece="int", start="bigint", length="bigint",
               ids_crc32="bigint", sequence_id="bigint", offset="bigint")
    want = {}
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        want |= {(i, at // 2048): (at, len(ids[at:at + 2048]), crc(ids[at:at + 2048])) for at in range(0, len(ids), 2048)}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


@pytest.mark.parametrize("name, mod, rest", [("op6_deobfuscate", 4, 2), ("op8_nbsvm", 5, 0)])
def test_scores(spark, texts, name, mod, rest):
    rows = run(spark, name, doc_id="bigint", held_out="boolean", score="double", predicted="int")
    assert sorted(r["doc_id"] for r in rows) == list(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_op10(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = run(spark, "op10_mincut_html", page_id="bigint", url="string", text="string", n_chars="bigint")
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        assert not re.search(r"[^\S\n ]|  |^ | $|\n\n", r["text"])
