"""E1-E7 array builders and K1-K3 split properties."""

import math

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import examples as E
from corpusflow.operators.sample import choose_eval, head_n, train_val_split


def arr(spark, n):
    return spark.createDataFrame([(1, list(range(10, 10 + n)))], "row_id long, ids array<int>")


def test_truncate_eos(spark):
    for n, kept in ((127, 127), (128, 127), (5, 5)):
        out = arr(spark, n).select(E.truncate_eos("ids", 2).alias("o")).collect()[0].o
        assert len(out) == kept + 1 and out[-1] == 2 and out[:-1] == list(range(10, 10 + kept))


def test_denoising(spark):
    df = arr(spark, 40)
    ex = E.denoising_examples(df, "ids", "row_id", eos_id=2, pad_id=3, mask_id=4).collect()[0]
    assert len(ex.input_ids) == len(ex.labels) == len(ex.attention_mask) == 128
    assert sum(ex.attention_mask) == 40
    assert ex.labels[:41] == list(range(10, 50)) + [2] and ex.labels[41:] == [3] * 87
    masked = sum(1 for a, b in zip(ex.input_ids[:40], ex.labels[:40]) if a != b)
    assert all(a in (b, 4) for a, b in zip(ex.input_ids[:40], ex.labels[:40]))
    assert 0 < masked < 20
    again = E.denoising_examples(df, "ids", "row_id", 2, 3, 4).collect()[0]
    assert again.input_ids == ex.input_ids
    other = E.denoising_examples(df, "ids", "row_id", 2, 3, 4, epoch=1).collect()[0]
    assert other.input_ids != ex.input_ids
    eos = E.denoising_examples(df, "ids", "row_id", 2, 3, 4, mask_eos=True).collect()[0]
    assert sum(eos.attention_mask) == 41


def test_translation(spark):
    df = spark.createDataFrame([(1, [7, 8, 9], [5] * 200)], "row_id long, s array<int>, t array<int>")
    ex = E.translation_examples(df, "s", "t", eos_id=2, pad_id=3).collect()[0]
    assert ex.input_ids[:4] == [7, 8, 9, 2] and ex.input_ids[4:] == [3] * 124
    assert sum(ex.attention_mask) == 4
    assert ex.labels[-1] == 2 and len(ex.labels) == 128
    short = spark.createDataFrame([(1, [7], [6])], "row_id long, s array<int>, t array<int>")
    lab = E.translation_examples(short, "s", "t", 2, 3).collect()[0].labels
    assert lab[:2] == [6, 2] and lab[2:] == [-100] * 126


def test_split_exact(spark):
    df = spark.range(250).withColumnRenamed("id", "row_id")
    s = train_val_split(df, 0.01, 42)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"validation": 3, "train": 247}
    s2 = train_val_split(df.repartition(5), 0.01, 42)
    a = sorted(r.row_id for r in s.where("split = 'validation'").collect())
    b = sorted(r.row_id for r in s2.where("split = 'validation'").collect())
    assert a == b
    big = spark.range(10007).withColumnRenamed("id", "row_id")
    n_val = train_val_split(big, 0.1, 7).where("split = 'validation'").count()
    assert n_val == math.ceil(10007 * 0.1)
    for f in (0.0, 1.0):
        with pytest.raises(ValueError):
            train_val_split(df, f)


def test_choose_eval_and_head(spark):
    df = spark.range(100).withColumnRenamed("id", "row_id")
    ev = spark.range(5).withColumnRenamed("id", "row_id")
    tr, va = choose_eval(df, ev)
    assert tr.count() == 100 and va.count() == 5
    tr, va = choose_eval(df, None, 0.1)
    assert tr.count() == 90 and va.count() == 10
    assert set(r.row_id for r in tr.collect()).isdisjoint(r.row_id for r in va.collect())
    assert [r.row_id for r in head_n(df.repartition(4), 3).collect()] == [0, 1, 2]
