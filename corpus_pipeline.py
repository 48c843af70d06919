"""Corpus pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before
kept, and is written as Parquet and reread as the next one's ``docs``. All but the
last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import min_bin_slack, nbsvm, partenum, pii_boost, rule_ledger
from corpusflow.llm.common import label_split, narrow, read
from corpusflow.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: A document stays if its probability of good quality is at least this.
QUALITY = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that fail a rule of the strict policy go."""
    judged = rule_ledger.verdicts(rule_ledger.ledger(docs), rule_ledger.STRICT)
    return judged.where("kept").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: learned on the labelled documents of the corpus (the learning fold
    of the query); documents that score below ``QUALITY`` go."""
    learn = read(spark, sf_dir, "labels", "doc_id", "quality").where(~label_split("doc_id", 5, 0))
    model = nbsvm.train(read(spark, sf_dir, "documents", "doc_id", "text"), learn, "quality")
    scored = nbsvm.score_rows(docs.select(*COLUMNS), model, "score")
    return scored.where(F.col("score") >= QUALITY).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2, on five words and a similarity of 0.8: of each group of linked rows
    the one with the least id stays (of several the first row; a null id comes last).
    Rows are linked by their own number, so rows of one id go only where their texts
    are linked."""
    rows = materialize(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "jaccard-rows", "zstd")
    found = materialize(partenum.link_components(rows, words=5, percent=80, id_col="_row"), "jaccard")
    found = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("g"))
    linked = found.where("_row <> g")
    linked = linked.unionAll(linked.select(F.col("g").alias("_row"), "g").distinct())
    linked = materialize(linked.join(rows.select("_row", "doc_id"), "_row"), "jaccard-linked")
    first = linked.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_stays"))
    gone = linked.join(narrow(materialize(first, "jaccard-first"), 32), "g").where("_row <> _stays").select("_row")
    return rows.join(narrow(materialize(gone, "jaccard-gone"), 16), "_row", "left_anti").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: base spans and selected candidates are replaced by their kind."""
    spans = materialize(pii_boost.find_spans(docs), "pii-spans")
    clean = pii_boost.redact_rows(docs.select(*COLUMNS), pii_boost.train(spans))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: all remaining documents in sequences of at most 2048 ids."""
    packed = min_bin_slack.pack(docs, WORD_BPE)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: The classifiers are learned, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
