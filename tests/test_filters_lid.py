"""Filters P1-P5 and language rules L2/L3 (FIXTURES cases)."""

from pyspark.sql import functions as F

from corpusflow.operators import filters as FL
from corpusflow.operators.langid import lenient_reject, strict_keep, train_trigram_lid


def ev(spark, expr, data, schema):
    df = spark.createDataFrame(data, schema)
    return [r.o for r in df.select(expr.alias("o")).collect()]


def test_length_bounds(spark):
    data = [(1, 2), (2, 2), (150, 2), (151, 2)]
    assert ev(spark, FL.pair_length_ok("a", "b"), data, "a int, b int") == [False, True, True, False]


def test_ratio(spark):
    data = [(2, 6), (2, 7), (0, 3)]
    assert ev(spark, FL.pair_ratio_ok("a", "b"), data, "a int, b int") == [True, False, False]


def test_mono_length(spark):
    assert ev(spark, FL.mono_length_ok("t"), [("x" * 9,), ("x" * 10,), ("",)], "t string") == \
        [False, True, False]


def test_strict_and_lenient(spark):
    data = [("en", 0.5), ("en", 0.49), ("fr", 0.9)]
    assert ev(spark, strict_keep("l", "s", "en"), data, "l string, s double") == [True, False, False]
    data = [("fr", 0.5), ("fr", 0.51), ("en", 0.1)]
    assert ev(spark, ~lenient_reject("l", "s", "en"), data, "l string, s double") == [True, False, True]


def test_trigram_lid_learns_languages(spark):
    train = spark.createDataFrame(
        [(1, "the cat and the dog are in the house", "en"),
         (2, "le chat et le chien sont dans la maison", "fr"),
         (3, "ab", "en")], "doc_id long, text string, lang string")
    lid = train_trigram_lid(train)
    test = spark.createDataFrame([(1, "the house and the cat"), (2, "la maison et le chien"), (3, "x")],
                                 "doc_id long, text string")
    out = {r.doc_id: (r.p_label, r.p_score) for r in lid.scores(test, "text", ["doc_id"], "p").collect()}
    assert out[1][0] == "en" and out[2][0] == "fr"
    assert out[3] == ("other", 0.0)
    assert 0.5 < out[1][1] <= 1.0
