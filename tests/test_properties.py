"""Randomised differential and property checks (one Spark job per property)."""

import random

from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import bpe as B
from corpusflow.operators.sample import train_val_split
from test_text import expected

# Pool of characters that exercise every rule: all 29 whitespace characters,
# URL starts, whitelist edges, Bengali letters/digits/danda, joiners,
# compatibility characters, combining marks, emoji.
POOL = ([chr(c) for c in range(0x110000) if chr(c).isspace()]
        + list("abcXYZ019.,!?'\"-()[];:%$&/@<>") + ["http", "www", "https://", "HTTP"]
        + list("ভাষাআর্য০১২৩।") + ["‌", "‍", "ﬁ", "Ａ", "１", "①", "é", "é",
                                   "́", "😀", "ß", "İ", "ǅ", "™", "½"])


def test_random_cleaning_matches_python(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for lang in ("en", "bn", None):
        out = df.select("i", X.clean_text("t", lang).alias("o")).collect()
        bad = [(texts[r.i], r.o) for r in out if r.o != expected(texts[r.i], lang)]
        assert not bad, (lang, bad[:3])


def test_cleaning_idempotent_on_url_free_text(spark):
    rng = random.Random(11)
    pool = [p for p in POOL if p not in ("http", "www", "https://")]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(1000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select(X.clean_text("t", "en").alias("a"))
    twice = once.select("a", X.clean_text("a", "en").alias("b"))
    assert twice.where("a != b").count() == 0


def test_relaxed_bpe_is_valid(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    df = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(20)),) for _ in range(200)],
                               "text string")
    base = len(B.train_bpe(df, vocab_size=0).tokens)
    exact = B.train_bpe(df, vocab_size=base + 40)
    relaxed = B.train_bpe(df, vocab_size=base + 40, mode="relaxed", relaxed_ratio=0.5)
    assert len(relaxed.tokens) == len(exact.tokens) == base + 40
    assert relaxed.rounds <= exact.rounds
    # every merge joins two tokens that existed before it
    seen = set(range(base))
    for a, b, n in relaxed.merges:
        assert a in seen and b in seen
        seen.add(n)


def test_approx_split_properties(spark):
    df = spark.range(20000).withColumnRenamed("id", "row_id")
    s = train_val_split(df, 0.1, 42, exact=False)
    n_val = s.where("split = 'validation'").count()
    assert 1600 < n_val < 2400
    assert s.count() == 20000
    again = train_val_split(df.repartition(3), 0.1, 42, exact=False)
    a = set(r.row_id for r in s.where("split = 'validation'").collect())
    b = set(r.row_id for r in again.where("split = 'validation'").collect())
    assert a == b
