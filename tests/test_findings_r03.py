"""One small test per settled finding of round 3."""

from __future__ import annotations


def test_padding_to_the_fixed_length_is_back_and_cuts_nothing(spark, tmp_path):
    from corpusflow.plans.catalog import PAD_TO, q_pad_ids
    texts = ["w " * 40_000 + "end", "", "one two", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_fixed, r.n_pad_fixed) for r in q_pad_ids(spark, str(tmp_path)).collect()}
    assert got == {0: (40_001, 0), 1: (PAD_TO, PAD_TO - 1), 2: (PAD_TO, PAD_TO - 2), 3: (PAD_TO, PAD_TO - 1)}


def test_sets_sign_with_few_signatures_at_four_fifths():
    import numpy as np
    from corpusflow.llm.partenum import cuts, bands, signatures
    for size in (1000, 5000):
        features = np.random.default_rng(size).integers(0, 1 << 62, size, dtype="u8")
        assert len(signatures(features, 80)) < 0.7 * size
    n1, n2, k2, spare = cuts(80, *bands(80, 400)[1:])
    assert (n2, k2) == (1, 0)


def test_encoding_makes_python_objects_of_distinct_words_only(spark, monkeypatch):
    import pyarrow as pa
    from corpusflow.operators import bpe
    monkeypatch.setattr(bpe, "ITEMS_AT_ONCE", 5)
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 2)
    tok2id = {"[UNK]": 0, "a": 1, "b": 2, "ab": 3}
    pieces = bpe.Pieces(tok2id, {(1, 2): (0, 3)}, 0)
    rows = [["ab", "b"], [], ["aab", "xyz", "ab"], ["ab"] * 7, [], ["b"], ["", "a"]]
    words = pa.array(rows, pa.list_(pa.string()))
    want = [[i for w in r for i in bpe.segment([tok2id.get(c, 0) for c in w], {(1, 2): (0, 3)})] for r in rows]
    assert pieces.ids(words).to_pylist() == want
    assert [x for a, n in bpe._portions(words) for x in pieces.ids(words.slice(a, n)).to_pylist()] == want
    assert len(bpe._portions(words)) > 1


def test_decoding_by_columns(spark, monkeypatch):
    from corpusflow.operators import bpe
    tokens = [*bpe.SPECIALS, *bpe.byte_alphabet(), "ab", "\u0995"]
    model = bpe.BpeModel(tokens, [])
    ids = [model.tok2id[t] for t in ("a", "ab", "\u0995", "\u00e9", "b")]
    rows = [(0, ids), (1, []), (2, None), (3, [0, 2, ids[0], 3]), (4, [-1, ids[1], 10 ** 6, None, ids[4]]), (5, [1])]
    df = spark.createDataFrame(rows, "k long, ids array<int>").coalesce(1)
    for sep in ("", " "):
        got = {r.k: r.text for r in bpe.decode(df, "ids", model, ["k"], sep=sep).collect()}
        assert got == {0: sep.join(["a", "ab", "\u0995", "\ufffd", "b"]), 1: "", 2: "", 3: "a", 4: sep.join(["ab", "b"]), 5: ""}


def test_columns_of_symbols_merge_like_single_words():
    import numpy as np
    from corpusflow.operators import bpe_train as B
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aab\U0001F600"), rng.integers(1, 12))) for _ in range(400)]
    alphabet = {c: i for i, c in enumerate("ab\U0001F600")}
    merges = [(0, 0, 3), (3, 0, 4), (1, 3, 5), (2, 2, 6), (3, 3, 7), (0, 0, 3)]
    symbols, one = B.flat(words, alphabet), B.Replay(alphabet, merges)
    for left, right, new in merges:
        symbols = B.fold_at(symbols, B.places(symbols, left, right), new)
    want = [one(w) for w in words]
    assert symbols.tolist() == [-1, *(x for w in want for x in (*w, -1))]
    keys, sums = B.pair_sums(symbols, np.arange(len(words)))
    brute = {}
    for n, w in enumerate(want):
        for a, b in zip(w, w[1:]):
            brute[a << 32 | b] = brute.get(a << 32 | b, 0) + n
    assert dict(zip(keys.tolist(), sums.tolist())) == brute


def test_few_merges_are_learned_without_an_index(spark, monkeypatch):
    from corpusflow.operators import bpe_train as B
    from corpusflow.operators.bpe import train_bpe
    texts = ["aaaa banana bandana the then there these", "in on an and aaab aaa aa " + "ab" * 50, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    made = []
    monkeypatch.setattr(B, "index_words", lambda *a, f=B.index_words: made.append(1) or f(*a))
    few = train_bpe(df, vocab_size=320)
    assert not made
    monkeypatch.setattr(B, "SCANNED_MERGES", -1)
    many = train_bpe(df, vocab_size=320)
    assert made and few.tokens == many.tokens and few.merges == many.merges


def test_language_is_scored_in_small_portions(monkeypatch):
    import numpy as np
    import pandas as pd
    from corpusflow.operators import langid as L
    model = L.DenseModel(["abc", "bcd", "xyz"], np.array([[1.0, 0.2], [0.5, 0.1], [0.0, 2.0]]), ["p", "q"], [1.0, 1.1])
    texts = pd.Series(["abcd" * 5, None, "xyzxyz", "", "ab", "bcdxyz" * 9])
    whole = model(texts)
    monkeypatch.setattr(L, "WINDOW", 8)
    most, some = [], model._some
    monkeypatch.setattr(model, "_some", lambda t: most.append(len(t)) or some(t))
    parts = model(texts)
    assert len(most) > 2 and list(parts["label"]) == list(whole["label"])
    assert np.allclose(parts["score"], whole["score"]) and len(model(pd.Series([], dtype=object))) == 0


def test_every_example_counts_in_the_models_of_personal_data(spark, monkeypatch):
    from corpusflow.llm import pii_boost as P
    texts = [f"Call me on +1 555 010 {i:04d} or write to user{i}@mail{i % 7}.example.org now, host 10.0.{i % 256}.{i % 250}." for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = P.materialize(P.find_spans(docs), "pii-spans")
    want = sum(role != P.PROPOSED for t in texts for _, _, _, role, _ in P.extract(t))
    seen, fit = [], P._fit
    monkeypatch.setattr(P, "_fit", lambda rows, *a: seen.append((len(rows), sum(r["good"] + r["bad"] for r in rows))) or fit(rows, *a))
    models = P.train(spans)
    assert sum(n for _, n in seen) == want and set(models) >= {0, 1}
    seen.clear()
    P.train(spans, cells=12)  # a coarser grid leaves none out
    assert sum(n for _, n in seen) == want and max(c for c, _ in seen) <= 12


def test_signatures_are_exchanged_in_portions(spark):
    import numpy as np
    from corpusflow.llm import partenum as P
    texts = [" ".join(f"w{i * 7 + j}" for j in range(40 + i)) for i in range(30)]
    rows = P.sign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80, "doc_id", "text").collect()
    assert len(rows) == 30 and P.PORTIONS > 1
    held = np.zeros(P.PORTIONS, "i8")
    for r in rows:
        parts = [np.array(r[c], "i8").view("u8") for c in P.SIGS]
        whole = P.signatures(P.Shingles().of(texts[r["doc_id"]], 5), 80)
        assert r["signs"] and np.concatenate(parts).tolist() == whole.tolist()
        for i, part in enumerate(parts):
            assert (part // np.uint64((1 << 64) // P.PORTIONS) == i).all()
            held[i] += len(part)
    assert held.min() * 2 > held.max()


def test_wide_sketches_rule_out_large_sets_and_lose_no_link(spark):
    import numpy as np
    from corpusflow.llm import partenum as P
    rng = np.random.default_rng(5)
    sets, pairs, near = [], [], set()
    for n in (520, 1000, 1023, 1030, 2100, 4000):
        for share in (1.0, 0.95, 0.9, 0.89, 0.6, 0.3):
            a = np.unique(rng.integers(0, 1 << 63, n).astype("u8"))
            b = np.unique(np.concatenate([a[:int(n * share)], rng.integers(0, 1 << 63, n - int(n * share) + n // 20).astype("u8")]))
            both = len(np.intersect1d(a, b))
            if both * 100 >= 80 * (len(a) + len(b) - both):
                near.add(len(sets))
            pairs.append((len(sets), len(sets) + 1, both / (len(a) + len(b) - both)))
            sets += [a, b]
    info = spark.createDataFrame([(i, len(s), *P.sketch(s).tolist()) for i, s in enumerate(sets)],
                                 "c long, n_shingles long, " + ", ".join(f"{f} long" for f in P.FIELDS))
    wides = spark.createDataFrame([(i, P.wide(s).tolist()) for i, s in enumerate(sets)], "c long, wide array<long>")
    got = {r["u"] for r in P._possible(spark.createDataFrame([p[:2] for p in pairs], "u long, v long"), info, wides, 80).collect()}
    assert len(near) >= 12 and near <= got
    assert not [p for p in pairs if p[2] < 0.5 and p[0] in got]
    # without them the short ones leave such pairs
    none = {r["u"] for r in P._possible(spark.createDataFrame([p[:2] for p in pairs], "u long, v long"), info, wides.limit(0), 80).collect()}
    assert [p for p in pairs if p[2] < 0.5 and p[0] in none]


def test_shuffle_files_go_when_a_table_is_written(spark):
    import time
    from pyspark.sql import functions as F
    from corpusflow import session as S
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f.getName() for f in (files.getAllFiles().apply(i) for i in range(files.getAllFiles().size()))
                     if f.getName().startswith("shuffle_")}
    held, before = names(), spark.conf.get(S.SHUFFLE_CLEANUP)
    df = spark.range(20000).groupBy((F.col("id") % 977).alias("k")).agg(F.sum("id").alias("s"))
    table = S.materialize(df, "cleaned")
    for _ in range(40):
        if not names() - held:
            break
        time.sleep(0.25)
    assert not names() - held and spark.conf.get(S.SHUFFLE_CLEANUP) == before
    assert table.agg(F.sum("s")).first()[0] == 20000 * 19999 // 2


def test_stream_dedup_runs_no_python_per_key_and_repeats_a_batch(spark, tmp_path, monkeypatch):
    """no task of the stream runs Python; a batch that is repeated finds the same rows."""
    from corpusflow.streaming import ingest as I
    made = []
    real = I.first_rows

    def spied(*args):
        made.append(real(*args))
        return made[-1]

    monkeypatch.setattr(I, "first_rows", spied)
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    schema, want = "doc_id long, text string", []
    for n, rows in enumerate([[(3, "a"), (1, "a"), (2, None), (9, "b")], [(0, "a"), (4, "c"), (5, None)], [(7, "c"), (6, "d")]]):
        df = spark.createDataFrame(rows, schema).repartition(1)
        df.write.mode("append").parquet(source)
        I.stream_ingest(spark, source, schema, sink=sink, checkpoint=check, id_col="doc_id", dedup_col="text", timeout_s=600)
        if n == 1:  # as after a failure between the rows and the commit
            I._write_first(df.withColumn("row_id", df.doc_id), 1, sink, check, "text", None)
    got = spark.read.parquet(sink)
    assert sorted((r.doc_id, r.text, r.row_id) for r in got.collect()) == sorted(
        [(1, "a", 1), (2, None, 2), (9, "b", 9), (4, "c", 4), (6, "d", 6)], key=lambda r: r[0])
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in made]
    assert len(plans) == 4 and not any("Python" in p or "Pandas" in p for p in plans)


def test_stream_dedup_with_a_limit_keeps_that_many_distinct_rows(spark, tmp_path):
    from corpusflow.streaming.ingest import stream_ingest
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for lo in (0, 10):
        spark.range(lo, lo + 10).selectExpr("id as row_id", "cast(id % 4 + id div 10 as string) as text").coalesce(1) \
            .write.mode("append").parquet(source)
        stream_ingest(spark, source, "row_id long, text string", sink=sink, checkpoint=check, dedup_col="text", max_samples=5, timeout_s=600)
    assert sorted(r.row_id for r in spark.read.parquet(sink).collect()) == [0, 1, 2, 3, 11]


def test_13a_by_words_equals_the_expression(spark, monkeypatch):
    """F16: the rules run once for each distinct word, with the tokens of the JVM expression."""
    import random
    import pyarrow as pa
    import pyarrow.compute as pc
    from corpusflow.functions.patterns import whitespace_codepoints
    from corpusflow.operators import metrics as M
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cut = pc.list_value_length(pc.utf8_split_whitespace(pa.array([f"a{chr(c)}b" for c in points]))).to_pylist()
    assert tuple(c for c, n in zip(points, cut) if n == 2) == whitespace_codepoints()
    rng = random.Random(5)
    parts = ["a", "B7", "1", "12", ".", ",", "..", "-", "-\n", "\n", " ", "  ", "\t", " ", "　", "\x1c", "\x85", "​", "&", "&amp;",
             "&lt;", "&quot;", "<skipped>", "<", "(", "'", "/", "কা", "১", "\U0001F600", "[", "~", ":", "@", "\\", "^", "`"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {r.i: r.x for r in df.select("i", M.tokenize_13a("t").alias("x")).collect()}
    flat, size = M._tokens(pa.array(texts))
    words = [w for i in range(len(texts)) for w in want[i]]
    assert size.tolist() == [len(want[i]) for i in range(len(texts))]
    assert len(set(zip(words, flat.tolist()))) == len(set(words)) == len(set(flat.tolist()))
    assert M._tokens(pa.array([], pa.string()))[0].tolist() == []
    applied, real = [], M._ruled
    monkeypatch.setattr(M, "_ruled", lambda words: applied.extend(words.to_pylist()) or real(words))
    M._tokens(pa.array(["one, two. one, plain", "plain two."] * 50))
    assert applied == ["one,", "two."]


def test_clipped_counts_with_dense_numbers(monkeypatch):
    """F16: n-grams packed into one number, and numbered anew where they don't fit."""
    import numpy as np
    from collections import Counter
    from corpusflow.operators import metrics as M
    rng = np.random.default_rng(2)
    for top, rows, long in ((3, 40, 12), (1 << 17, 3, 40_000), (5, 0, 1), (2, 5, 2)):
        hyp, ref = ([rng.integers(0, top, rng.integers(0, long)).tolist() for _ in range(rows)] for _ in range(2))
        correct, total = [0] * 4, [0] * 4
        for h, r in zip(hyp, ref):
            for n in range(1, 5):
                a, b = (Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
                correct[n - 1] += sum((a & b).values())
                total[n - 1] += sum(a.values())
        both = hyp + ref
        got = M._clipped(np.array(sum(both, []), "i8"), np.array([len(x) for x in both], "i8"))
        assert got == [*correct, *total, sum(map(len, hyp)), sum(map(len, ref)), rows]


ODD_LINES = ["", " ", "a  b", "ﬁne Ａ http://x.y/z?q=1 b", "wwwq", "x　y z\t\x1cq", "é naïve‍x [ok]", "কা ১২  3.5%", "http", "a http", "q",
             "ভাষা। don’t", "\U0001F600 w ww www", "  lead and trail  "]


def test_cleaning_makes_each_text_once(spark):
    """the steps of cleaning aren't worked out anew wherever their result is named."""
    import re
    import unicodedata
    from pyspark.sql import functions as F
    from corpusflow.functions import patterns as P
    from corpusflow.functions import text as X
    from corpusflow.operators.pairs import adjacent_line_pairs
    from corpusflow.plans.parallel import clean_parallel
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, *ODD_LINES])], "i int, t string")
    for lang in ("en", "bn", None):
        cleaned = df.select("i", X.clean_text("t", lang).alias("x"))
        plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("java_method(") == 1 and plan.count("regexp_replace(") == 2
        got = {r.i: r.x for r in cleaned.collect()}
        for i, t in enumerate([None, *ODD_LINES]):
            t = re.sub(r"(http|www)\S+", "", unicodedata.normalize("NFKC", t or ""))
            kept = P.whitelist_chars(lang)
            t = "".join(c if c.isspace() or kept is None or c in kept else " " for c in t)
            assert got[i] == " ".join(t.split()), (lang, i)
    docs = spark.createDataFrame([(1, "a b\nc d"), (2, "one  two\n\nthree")], "doc_id long, text string")
    pairs = adjacent_line_pairs(docs, each=lambda t: X.clean_text(t, None))
    out = clean_parallel(pairs, "src", "tgt", whitelist=False, order_cols=["doc_id", "line_no"], cleaned=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("java_method(") == 1 and plan.count("replace(src") + plan.count("split(src") <= 1
    assert [tuple(r.translation) for r in out.collect()] == [("a b", "c d")]


def test_pairs_of_cleaned_lines_equal_cleaned_pairs(spark):
    import random
    from corpusflow.functions.text import clean_text
    from corpusflow.operators.pairs import adjacent_line_pairs
    from corpusflow.plans.parallel import clean_parallel
    rng = random.Random(4)
    texts = [None, "", "\n", "\n\n", *("\n".join(rng.choices(ODD_LINES, k=rng.randint(1, 12))) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys, options = ["doc_id", "line_no"], dict(whitelist=False, order_cols=["doc_id", "line_no"], min_words=1)
    raw = adjacent_line_pairs(df)
    assert sorted(map(tuple, raw.collect())) == [(i, n, a, b) for i, t in enumerate(texts)
                                                 for n, (a, b) in enumerate(zip((t or "").split("\n"), (t or "").split("\n")[1:]))]
    got = clean_parallel(adjacent_line_pairs(df, each=lambda t: clean_text(t, None)), "src", "tgt", cleaned=True, **options)
    want = clean_parallel(raw, "src", "tgt", **options)
    assert sorted(got.select(*keys, "translation").collect()) == sorted(want.select(*keys, "translation").collect()) != []


def test_mono_without_texts_keeps_the_same_rows(spark):
    """rows are counted without a shuffle of their texts."""
    import pytest
    from corpusflow.operators.langid import LabelColumnLid
    from corpusflow.plans.mono import clean_monolingual
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the same text", "en"), ("the same  text", "bn"), (None, "en"), ("other long text", None),
                                                        ("another long text", "en"), ("short", "en"), ("first is bn", "bn"), ("first is bn", "en")])]
    df = spark.createDataFrame([*rows, (None, "first is bn", "en")], "row_id long, text string, lang string")
    want = clean_monolingual(df, "en", LabelColumnLid("lang"))
    got = clean_monolingual(df, "en", LabelColumnLid("lang"), keep_text=False)
    assert got.columns == ["row_id", "lang"] and sorted(got.collect(), key=str) == sorted(want.select("row_id", "lang").collect(), key=str)
    with pytest.raises(ValueError):
        clean_monolingual(df, "en", object(), keep_text=False)
