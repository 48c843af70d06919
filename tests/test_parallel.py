"""C2 golden case, pair layouts, shard expansion."""

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.langid import LabelColumnLid
from corpusflow.operators.pairs import pair_columns, resolve_pairs
from corpusflow.plans.parallel import clean_parallel, clean_report_parallel
from corpusflow.sources.shards import expand_jsonl

# The documented example pairs and, below, which of them are kept; they
# must stay as they are for the results to be comparable.
GOLDEN = [(1, "Hello world", "ওহে বিশ্ব"), (2, "Hello world", "ওহে বিশ্ব"),
          (3, "Hi", "This is a very long sentence that should definitely be removed because the ratio is way off"),
          (4, "", "Something"), (5, "I have 3 cats", "আমার চারটি বিড়াল আছে"),
          (6, "I have 2 dogs", "আমার 2 টি কুকুর আছে")]


def golden(spark):
    df = spark.createDataFrame(GOLDEN, "row_id long, en string, bn string")
    return df.select("row_id", F.struct("en", "bn").alias("translation"),
                     F.lit("en").alias("ls"), F.lit("bn").alias("lt"))


STUB = LabelColumnLid(by_text={"_s": ("ls", None), "_t": ("lt", None)})


def test_golden(spark):
    out = clean_parallel(golden(spark), "en", "bn", lid=STUB).orderBy("row_id").collect()
    assert [r.row_id for r in out] == [1, 6]
    assert out[0].translation.en == "Hello world"
    assert out[1].translation.en == "I have 2 dogs"
    rep = clean_report_parallel(golden(spark), "en", "bn", lid=STUB).collect()[0]
    assert (rep.total, rep.kept, rep.dup, rep.empty, rep.length, rep.numbers) == (6, 2, 1, 1, 1, 1)


def test_golden_partition_invariant(spark):
    g = golden(spark)
    a = clean_parallel(g.repartition(1), "en", "bn", lid=STUB).select("row_id").collect()
    b = clean_parallel(g.repartition(7).orderBy(F.rand(3)), "en", "bn", lid=STUB).select("row_id").collect()
    assert sorted(r.row_id for r in a) == sorted(r.row_id for r in b) == [1, 6]


def test_layouts(spark):
    flat = spark.createDataFrame([(1, "a b", "c d")], "row_id long, en string, bn string")
    generic = spark.createDataFrame([(1, "a b", "c d")], "row_id long, src string, tgt string")
    bad = spark.createDataFrame([(1, "x")], "row_id long, foo string")
    for df in (flat, generic):
        assert [(r._src, r._tgt, r._valid) for r in resolve_pairs(df, "en", "bn").collect()] == [("a b", "c d", True)]
    with pytest.raises(ValueError, match="foo"):
        pair_columns(bad.schema, "en", "bn")
    out = clean_parallel(flat, "en", "bn").collect()[0]
    assert out.en == "a b" and out.translation.en == "a b"


def test_null_sides(spark):
    df = spark.createDataFrame([(1, None, "x y"), (2, "a b", None)], "row_id long, en string, bn string")
    tr = df.select("row_id", F.struct("en", "bn").alias("translation"))
    r = resolve_pairs(tr, "en", "bn").orderBy("row_id").collect()
    assert [(x._src, x._tgt) for x in r] == [("", "x y"), ("a b", "")]
    nulltr = spark.createDataFrame([(1, None)], "row_id long, translation struct<en:string,bn:string>")
    rep = clean_report_parallel(nulltr, "en", "bn").collect()[0]
    assert rep.invalid == 1


def test_jsonl_cases(spark):
    lines = ['{"en":"one two","bn":"three four"}', "", "not json", "[1]", '{"en":"a"}',
             '{"en":null,"bn":"b"}', "{'en':'a','bn':'b'}", '{"en":"a","bn":"b"} junk',
             '{"en":"","bn":""}']
    blob = "\n".join(lines).encode() + b'\n{"en":"x\xff","bn":"y"}' + \
        ' {"en":"p","bn":"q"}'.encode()
    df = spark.createDataFrame([("k", "u", bytearray(blob))], "__key__ string, __url__ string, jsonl binary")
    out = expand_jsonl(df, "en", "bn").orderBy("line_no").collect()
    got = [(r.translation.en, r.translation.bn) for r in out]
    assert got == [("one two", "three four"), ("", ""), ("x�", "y"), ("p", "q")]
    cleaned = clean_parallel(df, "en", "bn", order_cols=["__key__", "line_no"]).collect()
    assert [r.translation.en for r in cleaned] == ["one two"]
