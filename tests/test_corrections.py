"""Cases that earlier tests did not reach: file order, caps of 0, strict shards, maps."""

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.dedup import dedup_exact
from corpusflow.operators.inspect import inspect_path
from corpusflow.operators.langid import LabelColumnLid
from corpusflow.operators.metrics import corpus_bleu, tokenize_13a
from corpusflow.operators.pairs import pairs_from_translation
from corpusflow.operators.sample import head_n, train_val_split
from corpusflow.plans.mono import clean_monolingual, clean_report_monolingual, clean_snapshot
from corpusflow.plans.parallel import clean_pairs_snapshot, clean_parallel, clean_report_parallel
from corpusflow.plans.training_data import evaluate_pairs
from corpusflow.sources.ingest import ingest
from corpusflow.sources.shards import expand_jsonl


@pytest.mark.parametrize("fmt", ["parquet", "json", "text"])
def test_rows_are_numbered_in_file_order(spark, tmp_path, fmt):
    """Files that grow, so that Spark packs the largest first."""
    want = []
    for k, n in enumerate((10, 400, 9_000)):
        part = [f"{k}-{i:05d}" for i in range(n)]
        want += part
        df = spark.createDataFrame([(x,) for x in part], "value string").coalesce(1)
        df.write.format(fmt).save(str(tmp_path / "made" / f"p{k}"))
        (tmp_path / "source").mkdir(exist_ok=True)
        made = next(f for f in (tmp_path / "made" / f"p{k}").iterdir() if f.name.startswith("part-"))
        made.rename(tmp_path / "source" / f"f{k}{made.suffix}")
    path = ingest(spark, str(tmp_path / "source"), "a/b", output_dir=str(tmp_path / "out"), fmt=fmt)
    rows = sorted((r.row_id, r.value) for r in spark.read.parquet(path).collect())
    assert rows == list(enumerate(want))
    path = ingest(spark, str(tmp_path / "source"), "a/c", output_dir=str(tmp_path / "out"), fmt=fmt, max_samples=25)
    assert sorted((r.row_id, r.value) for r in spark.read.parquet(path).collect()) == list(enumerate(want[:25]))


def test_caps_of_zero_and_none(spark):
    df = spark.createDataFrame([(i, "a b c d e", "a b c d e") for i in range(3)], "row_id long, pred string, ref string")
    assert head_n(df, None).count() == 3 and head_n(df, 0).count() == 0 and head_n(df, 2).count() == 2
    assert evaluate_pairs(df).first().bleu == pytest.approx(100.0)
    assert evaluate_pairs(df, max_rows=0).first().bleu is None
    with pytest.raises(ValueError):
        train_val_split(df.limit(1), 0.5)


def test_shards_take_only_whole_objects(spark):
    good = ['{"en":"a","bn":"b"}', '{"en":"x}","bn":"]"}', '{"bn":"q","en":"p","en":"r"}']
    bad = ['{"en":"a","bn":"b"} junk}', '{"en":"a","bn":"b"}}', '{"en":"a","bn":"b"},{"x":1}', '{"en":"a","bn":"b"} {"y":2}',
           '{"en":"a","bn":"b"]}', '{"en":"a","bn":"b"}]}', '{"en":"a","bn":"b"}] [{}', "[1]", "{}", '{"en":"a"}']
    lines = [x for pair in zip(good + [""] * 9, bad) for x in pair]
    df = spark.createDataFrame([("k", bytearray("\n".join(lines).encode()))], "__key__ string, jsonl binary")
    got = [tuple(r.translation) for r in expand_jsonl(df, "en", "bn").orderBy("line_no").collect()]
    assert got == [("a", "b"), ("x}", "]"), ("r", "q")]


def test_shards_clean_with_default_order(spark):
    text = '{"en":"good morning friends","bn":"ami bhalo achi"}\n' * 2 + '{"en":"two more words","bn":"aro duti kotha"}'
    for columns in ("__key__ string, jsonl string", "row_id long, jsonl string"):
        df = spark.createDataFrame([("1" if "key" in columns else 1, text)], columns)
        out = clean_parallel(df, "en", "bn", whitelist=False).collect()
        assert sorted(r.line_no for r in out) == [0, 2]
        report = clean_report_parallel(df, "en", "bn", whitelist=False).first()
        assert (report.total, report.dup, report.kept) == (3, 1, 2)


def test_report_agrees_with_cleaner(spark):
    rows = [(1, "a long enough text", "xx", "en"), (2, "another fine text here", "en", "de"), (3, "a long enough text", "en", "en")]
    df = spark.createDataFrame(rows, "row_id long, text string, lang string, other string")

    class Plain:
        def annotate(self, df, text_col, key_cols, prefix="lid"):
            return df.withColumn(f"{prefix}_label", F.col("other")).withColumn(f"{prefix}_score", F.lit(1.0))

    for lid in (LabelColumnLid("lang", by_text={"text": ("other", None)}), Plain(), LabelColumnLid("lang"), None):
        kept = clean_monolingual(df, "en", lid=lid).count()
        report = clean_report_monolingual(df, "en", lid=lid).first()
        assert report.kept == kept and report.total == 3 and report.dup == 1 and report.kept + report.lang == 2


def test_maps_survive_dedup(spark):
    df = spark.createDataFrame([(2, "same", {"a": 1}), (1, "same", {"b": 2}), (3, "x", None)], "row_id long, text string, m map<string,int>")
    got = {r.row_id: r.m for r in dedup_exact(df).collect()}
    assert got == {1: {"b": 2}, 3: None}


def test_pair_layouts(spark):
    df = spark.createDataFrame([("a", "b", 5)], "src string, tgt string, n int")
    assert pairs_from_translation(df, "en", "bn").columns == ["n", "en", "bn", "valid"]
    with pytest.raises(ValueError, match="no pair of texts among the columns n"):
        pairs_from_translation(df.select("n"), "en", "bn")


def test_white_space_at_the_end_goes_before_the_rules(spark):
    df = spark.createDataFrame([("abc -\n",), ("x-\ny \t\n",), (" - ",)], "t string")
    assert [r.x for r in df.select(tokenize_13a("t").alias("x")).collect()] == [["abc", "-"], ["xy"], ["-"]]


def test_bleu_is_one_aggregate_without_a_join(spark):
    df = spark.createDataFrame([(1, "a b c d", "a b c e"), (2, "", "q"), (3, "", "")], "row_id long, pred string, ref string")
    out = corpus_bleu(df)
    row = out.first()
    assert (row.sys_len, row.ref_len, row.correct_1, row.total_4) == (4, 5, 3, 1)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert corpus_bleu(df.where("row_id = 3")).first().bleu == 0.0
    assert corpus_bleu(df.where("false")).first().bleu is None


def test_snapshot_jobs_and_missing_data(spark, tmp_path):
    df = spark.createDataFrame([(1, "some text that stays"), (2, "some text that stays"), (3, "x")], "row_id long, text string")
    df.write.parquet(str(tmp_path / "raw"))
    assert clean_snapshot(spark, str(tmp_path / "raw"), str(tmp_path / "clean"), "en") == {"before": 3, "after": 1}
    pairs = spark.createDataFrame([(1, "two words", "duti kotha"), (2, "two words", "duti kotha")], "row_id long, en string, bn string")
    pairs.write.parquet(str(tmp_path / "rawp"))
    counts = clean_pairs_snapshot(spark, str(tmp_path / "rawp"), str(tmp_path / "cleanp"), "en", "bn", whitelist=False)
    assert counts == {"before": 2, "after": 1}
    missing = inspect_path(spark, str(tmp_path / "none"), "none").collect()
    assert [(r.dataset, r.total, r.field) for r in missing] == [("none", None, "missing")]
    assert {r.field for r in inspect_path(spark, str(tmp_path / "raw"), "raw").collect()} == {"row_id", "text"}


def test_stream_sink_feeds_the_cleaner(spark, tmp_path):
    from corpusflow.streaming.ingest import stream_ingest
    want = []
    for k, n in enumerate((5, 60, 20)):
        part = [f"text number {k} and {i}" for i in range(n)]
        want += part
        spark.createDataFrame([(x,) for x in part], "text string").coalesce(1).write.parquet(str(tmp_path / "made" / f"p{k}"))
        (tmp_path / "source").mkdir(exist_ok=True)
        made = next(f for f in (tmp_path / "made" / f"p{k}").iterdir() if f.name.startswith("part-"))
        made.rename(tmp_path / "source" / f"f{k}.parquet")
    for per in (None, 1):
        sink = stream_ingest(spark, str(tmp_path / "source"), "text string", max_files_per_trigger=per)
        rows = spark.read.parquet(sink)
        got = sorted((r.row_id, r.text) for r in rows.collect())
        assert [i for i, _ in got] == list(range(len(want))) and sorted(t for _, t in got) == sorted(want)
        if per is None:
            assert [t for _, t in got] == want
        assert clean_monolingual(rows, "en").count() == len(want)
    one = stream_ingest(spark, str(tmp_path / "source" / "f1.parquet"), "text string")
    assert spark.read.parquet(one).count() == 60


def test_padding_goes_to_the_next_multiple(spark, tmp_path):
    from corpusflow.plans.catalog import q_pad_ids
    texts = ["w " * 40_000 + "end", "", "one", " ".join(["x"] * 128), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n, r.n_pad, r.ids.split(",")) for r in q_pad_ids(spark, str(tmp_path)).collect()}
    assert [got[i][0] for i in range(5)] == [40_064, 128, 128, 128, 128]
    assert [got[i][1] for i in range(5)] == [63, 127, 127, 0, 127]
    assert all(len(ids) == n and ids[n - pad:] == ["3"] * pad for n, pad, ids in got.values())
