"""One small test per settled finding of round 4."""

from __future__ import annotations

import random

import numpy as np


def _documents(spark, path, n_words: int) -> None:
    """Random words, so that 400 tokens are far from all; rows repeat, texts are null or empty."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n_words)]
    rows = [(i, " ".join(rng.choices(words, k=40)) + "!", rng.choice(["en", "de"])) for i in range(30)]
    rows += [rows[0], (30, None, "en"), (31, "", "de"), (32, "ab" * 40 + " aaaaaaa 😀😀 é", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")


def _oracle(path, sql: str) -> list[tuple]:
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return sorted(con.execute(sql).fetchall(), key=repr)


def test_merges_go_on_to_the_whole_vocabulary(spark, tmp_path):
    from corpusflow.plans import catalog as C
    _documents(spark, tmp_path, 120)
    df = C.q_bpe_merges(spark, str(tmp_path))
    got = [tuple(r) for r in df.select("rank", "left", "right", "new_id").collect()]
    assert len(got) > 300  # until no pair is left, not up to 400 tokens
    assert sorted(got, key=repr) == _oracle(tmp_path, C.ORACLES["bpe_merges"])
    assert "32000" in C.ORACLES["bpe_merges"] and "32000" not in C.ORACLES["bpe_vocab"]


def test_covered_pairs_are_merged_like_guessed_ones(spark, tmp_path, monkeypatch):
    """With little room rounds guess and cover in turn, and words are written anew; merges
    and ties are the library's."""
    from corpusflow.operators import bpe as B
    from corpusflow.operators import bpe_train as T
    from test_bpe import _lib_merges, _library
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.choice([1, 2, 3, 5, 8, 70]))) for _ in range(90)]
    texts = [" ".join(rng.choices(words, k=25)) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    base = len(B.train_bpe(df, vocab_size=0).tokens)
    lib = _lib_merges(_library(texts, base + 250))
    rounds = set()
    for room, top_k, rewritten in ((4 << 20, 20_000, 1000), (900, 40, 20), (900, 20_000, 1), (1, 60, 30)):
        monkeypatch.setattr(T, "HELD_SYMBOLS", room)
        monkeypatch.setattr(T, "REWRITTEN", rewritten)
        monkeypatch.setattr(T, "LOOKED_UP", room)
        m = B.train_bpe(df, vocab_size=base + 250, top_k=top_k)
        assert [[m.tokens[a], m.tokens[b]] for a, b, _ in m.merges] == lib
        rounds.add(m.rounds)
    assert min(rounds) == 1 < max(rounds)


def test_merges_on_all_words_at_once():
    from corpusflow.operators import bpe_train as T
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aab\U0001F600"), rng.integers(1, 14))) for _ in range(500)]
    alphabet = {c: i for i, c in enumerate("ab\U0001F600")}
    merges = [(0, 0, 3), (3, 0, 4), (1, 3, 5), (2, 2, 6), (3, 3, 7), (0, 0, 3), (3, 1, 5), (5, 5, 8)]
    want = T.flat(words, alphabet)
    for left, right, new in merges:
        want = T.fold_at(want, T.places(want, left, right), new)
    assert T.Merges(merges)(T.flat(words, alphabet)).tolist() == want.tolist()
    some, counts = next(T.blocks([T.block(T.Merges(merges[:3])(T.flat(words, alphabet)), np.arange(500))]))
    assert T.Merges(merges[3:])(some).tolist() == want.tolist() and counts.tolist() == list(range(500))
    assert T.Merges([])(want).tolist() == want.tolist()


def test_many_words_are_cut_like_single_ones(monkeypatch):
    """Also where a symbol that a merge makes is taken by an earlier merge."""
    from corpusflow.operators import bpe
    rng = random.Random(9)
    tok2id = {"[UNK]": 0, "a": 1, "b": 2, "c": 3}
    words = ["".join(rng.choice("aabcx") for _ in range(rng.randint(0, 14))) for _ in range(800)]
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 100)
    for _ in range(60):
        ranks, top = {}, 4
        for rank in range(14):
            new = rng.choice([top, rng.randrange(4, top + 1)])
            ranks.setdefault((rng.randrange(1, top + 3), rng.randrange(1, top + 3)), (rank, new))
            top = max(top, new + 1)
        pieces = bpe.Pieces(tok2id, ranks, 0)
        got = [np.frombuffer(x, "<i4").tolist() for x in pieces.of(words)]
        assert got == [bpe.segment([tok2id.get(c, 0) for c in w], ranks) for w in words]


def test_a_pair_behind_the_edge_that_rises_moves_the_edge():
    from corpusflow.operators.bpe_train import Ranking
    ranking = Ranking(2)
    ranking.fetch([(1, 2, 9), (3, 4, 7)], False, 10)
    ranking.change((5, 6), 1)  # its count, 7 at most before, is 8 at most
    assert ranking.first(5) == [(-9, 1, 2)]
    ranking.change((5, 6), 1)
    assert ranking.first(5) == []  # it could be 9
    ranking.fetch([(1, 2, 9), (3, 4, 7)], False, 10)
    ranking.change((5, 6), -3)
    assert ranking.first(5) == [(-9, 1, 2), (-7, 3, 4)]


def test_the_report_is_on_the_whole_vocabulary(spark, tmp_path):
    from corpusflow.plans import catalog as C
    _documents(spark, tmp_path, 60)
    cols = ["lang", "rows", "words", "tokens", "unknown", "tokens_per_word", "unknown_rate"]
    got = C.q_tokenizer_report(spark, str(tmp_path)).select(*cols).collect()
    by_lang = {r.lang: r for r in got}
    # every word of up to 9 letters is one token when no pair is left
    assert all(by_lang[lang].tokens == by_lang[lang].words for lang in ("en", "de")) and len(got) == 3
