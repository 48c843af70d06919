"""Forms made for scale against the plain ones: dedup without moving texts, selection,
streams with state, split trees, language ID and BLEU inside the rows."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from corpusflow.operators import dedup, langid, metrics, sample
from corpusflow.plans import mono, parallel
from corpusflow.session import shared_dir
from corpusflow.sources import readers
from corpusflow.sources.ingest import ingest
from corpusflow.streaming import ingest as streaming
from test_bleu import py_bleu


def exchanged(df):
    """The output columns of every exchange of the executed plan, as text."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    text = df._jdf.queryExecution().toString()
    assert "Exchange" in text or "Exchange" in plan
    formatted = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [re.search(r"Input \[\d+\]: \[(.*?)\]", part).group(1)
            for part in re.split(r"\n\n+", formatted) if re.match(r"\(\d+\) (Broadcast)?Exchange", part)]


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "a", "b", "hot", "hot", "hot", f"own {i}"]), rng.random()) for i in range(300)]
    return spark.createDataFrame(rows, "row_id long, text string, x double")


def test_dedup_forms_agree_and_filter_moves_no_text(spark, copies, monkeypatch):
    want = sorted(dedup.dedup_exact(copies, method="gather").collect())
    got = dedup.dedup_exact(copies, method="filter")
    assert sorted(got.collect()) == want
    assert not any("text#" in columns for columns in exchanged(got))
    # too many repeated keys to broadcast: the rows are gathered
    monkeypatch.setattr(dedup, "MAX_BROADCAST_BYTES", 10)
    assert sorted(dedup.dedup_exact(copies, method="filter").collect()) == want
    with pytest.raises(ValueError):
        dedup.dedup_exact(copies, method="other")


def test_dedup_filter_with_two_order_columns_and_none(spark):
    rows = [(d, n, t) for d in range(5) for n, t in enumerate(["x", "y", "x", None])]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, src string").withColumn("tgt", F.lit("t"))
    got = dedup.dedup_pairs(df, "src", "tgt", ["doc_id", "line_no"])
    assert sorted((r.doc_id, r.line_no) for r in got.collect()) == [(0, 0), (0, 1), (0, 3)]
    assert dedup.dedup_pairs(df.where("false"), "src", "tgt", ["doc_id", "line_no"]).collect() == []


def test_cleaning_with_either_dedup(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = mono.clean_monolingual(docs, "en", order_cols=["doc_id"], dedup="filter")
    assert sorted(a.collect()) == sorted(mono.clean_monolingual(docs, "en", order_cols=["doc_id"]).collect())


def test_selected_head_equals_sorted_head(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(20)]), i, "payload") for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, p string").repartition(6)
    want = [(r.a, r.b) for r in df.orderBy("a", "b").collect()]
    for n in (1, 7, 250, 499, 500, 800):
        got = [(r.a, r.b) for r in sample.head_n(df, n, ["a", "b"], gathered=0).collect()]
        assert sorted(got, key=str) == sorted(want[:n], key=str)
    # ties of the n-th key: as many as are needed
    got = sample.head_n(df, 100, ["a"], gathered=10).collect()
    assert len(got) == 100
    assert sorted((r.a for r in got), key=str) == sorted((a for a, _ in want[:100]), key=str)
    assert sample.head_n(df.where("false"), 5, ["a"], gathered=1).collect() == []
    plan = sample.head_n(df, 250, ["a", "b"], gathered=10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan


def test_stream_of_a_hundred_files_has_dense_numbers(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    for i in range(0, 100, 20):
        spark.range(i * 3, (i + 20) * 3).repartitionByRange(20, "id").sortWithinPartitions("id").write.mode("append").parquet(source)
    sink, check = str(tmp_path / "out"), str(tmp_path / "ckpt")
    read = []
    real = type(spark.read).parquet

    def spied(self, *paths, **options):
        read.extend(paths)
        return real(self, *paths, **options)

    monkeypatch.setattr(type(spark.read), "parquet", spied)
    streaming.stream_ingest(spark, source, "id long", sink=sink, checkpoint=check, max_files_per_trigger=5, timeout_s=600)
    monkeypatch.undo()
    assert read and all("/_ledger/" in p for p in read)  # no earlier batch is read
    rows = spark.read.parquet(f"{sink}/batch=*").collect()
    assert sorted(r.row_id for r in rows) == list(range(300)) and len({r.id for r in rows}) == 300
    marks = streaming.ledger(spark, sink).orderBy("batch").collect()
    assert [m.first for m in marks] == [0, *[m.next for m in marks[:-1]]] and marks[-1].next == 300 and len(marks) == 20
    # a restart goes on behind them
    spark.range(300, 310).coalesce(1).write.mode("append").parquet(source)
    streaming.stream_ingest(spark, source, "id long", sink=sink, checkpoint=check, timeout_s=600)
    assert sorted(r.row_id for r in spark.read.parquet(f"{sink}/batch=*").collect()) == list(range(310))


def test_stream_dedup_equals_the_batch_job_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "", "hot", "hot", "a", "b", f"own {i}", f"twin {i // 40}"])) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, text string")
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    options = dict(sink=sink, checkpoint=check, timeout_s=600, dedup_col="text")
    for lo in range(0, 240, 80):
        df.where(f"row_id >= {lo} and row_id < {lo + 40}").repartition(1).write.mode("append").parquet(source)
        df.where(f"row_id >= {lo + 40} and row_id < {lo + 80}").repartition(1).write.mode("append").parquet(source)
        streaming.stream_ingest(spark, source, df.schema, max_files_per_trigger=1, **options)
    got = sorted((r.row_id, r.text) for r in spark.read.parquet(sink).collect())
    assert got == sorted((r.row_id, r.text) for r in dedup.dedup_exact(df).collect())
    with pytest.raises(ValueError):
        streaming.stream_ingest(spark, source, "x long", sink=sink, dedup_col="x")


def test_split_tree_replaces_one_split_and_prunes(spark, tmp_path):
    root = str(tmp_path / "tree")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for split in ("train", "test"):
        ingest(spark, f"{SF}/documents.parquet", "corpus/docs", "7", split, output_dir=root, id_col="doc_id", partitioned=True)
    readers.write_split(docs.where("doc_id < 50").withColumn("row_id", F.col("doc_id")), root, "corpus/docs", "7", "test")
    n = docs.count()
    assert readers.read_split(spark, root, "corpus/docs", "7", "train").count() == n
    assert readers.read_split(spark, root, split="test").count() == docs.where("doc_id < 50").count()
    one = readers.read_split(spark, root, split="train")
    assert dict(one.dtypes)["config"] == "string"
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().toString().replace("#", "").replace("\n", " ") or \
        "PartitionFilters: [isnotnull" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        readers.write_split(docs.withColumn("split", F.lit(1)), root, "x")


def test_split_files_keep_their_size(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 40).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    root = str(tmp_path / "even")
    readers.write_split(rows, root, "d", file_bytes=2 << 20)
    sizes = sorted(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet"))
    assert 3 < len(sizes) < 40 and sizes[-1] < 6 << 20 and sizes[len(sizes) // 2] > 200_000
    assert spark.read.parquet(root).count() == 200_000


def test_counts_are_observed_on_the_write(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = mono.clean_snapshot(spark, f"{SF}/documents.parquet", str(tmp_path / "mono"), "en", order_cols=["doc_id"])
    assert n == {"before": docs.count(), "after": spark.read.parquet(str(tmp_path / "mono")).count()}
    pairs = spark.createDataFrame([(i, ("one two three", "un deux trois")) for i in range(9)],
                                  "row_id long, translation struct<en: string, fr: string>")
    pairs.write.parquet(str(tmp_path / "pairs"))
    n = parallel.clean_pairs_snapshot(spark, str(tmp_path / "pairs"), str(tmp_path / "clean"), "en", "fr")
    assert n == {"before": 9, "after": 1}


@pytest.fixture(scope="module")
def lid(spark):
    return langid.train_trigram_lid(spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang"))


def test_dense_scores_equal_joined_scores(spark, lid, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "ab"), (-4, "日本語😀😀😀"), (-5, "The\nEnd " * 30_000)], "doc_id long, text string")
    docs = docs.unionAll(extra)
    monkeypatch.setattr(langid, "WINDOW", 1000)
    dense = {r.doc_id: (r.p_label, r.p_score) for r in lid.scores(docs, "text", ["doc_id"], "p").collect()}
    joined = {r.doc_id: (r.p_label, r.p_score) for r in lid._joined(docs, "text", ["doc_id"], "p").collect()}
    assert dense.keys() == joined.keys()
    for k, (label, score) in joined.items():
        assert dense[k][0] == label and dense[k][1] == pytest.approx(score, abs=1e-9)


def test_scoring_is_narrow_and_reports_move_no_text(spark, lid):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = lid.annotate(docs, "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and plan.count("ArrowEvalPython") == 1
    kept = lid.annotate(docs, "text", prefix="p").where("p_label = 'en' and p_score >= 0.5")
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    report = mono.clean_report_monolingual(docs, "en", lid=lid, order_cols=["doc_id"])
    assert not any("text#" in c for c in exchanged(report))
    pairs = spark.createDataFrame([(1, ("a b c", "d e f"))], "row_id long, translation struct<en: string, fr: string>")
    report = parallel.clean_report_parallel(pairs, "en", "fr", lid=lid)
    assert not any("_s#" in c or "_t#" in c or "translation#" in c for c in exchanged(report))


def test_lid_is_saved_and_loaded(spark, lid, tmp_path):
    again = langid.load_lid(spark, langid.save_lid(lid, str(tmp_path / "lid")))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert sorted(again.scores(docs, "text", ["doc_id"]).collect()) == sorted(lid.scores(docs, "text", ["doc_id"]).collect())


def test_bleu_sums_inside_rows(spark, monkeypatch):
    rng = random.Random(12)
    words = ["a", "b", "c", "the", "1,000", "don't", "(x)", "&amp;"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 60])))
    pairs = [(text(), text()) for _ in range(400)] + [("a a a a", "a a"), ("", "a"), ("a", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "row_id long, pred string, ref string").repartition(3)
    monkeypatch.setattr(metrics, "ROWS", 7)
    out = metrics.corpus_bleu(df)
    assert out.first().bleu == pytest.approx(py_bleu(pairs), abs=1e-9)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2  # one deals out the test rows
    assert metrics.corpus_bleu(df.where("false")).first().bleu is None


def test_ngram_numbers_name_equal_ngrams():
    tokens, lengths = np.array([1, 2, 1, 2, 1, 2, 3]), np.array([4, 0, 3])
    found = [sorted(zip(r.tolist(), g.tolist())) for r, g in metrics._ngrams(tokens, lengths)]
    assert [len(f) for f in found] == [7, 5, 3, 1]
    assert found[2][0][1] == min(g for _, g in found[2]) and len({g for _, g in found[1]}) == 3
