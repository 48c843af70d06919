"""Quality by naive Bayes support vectors (operator 8).

A text's features are indicators of n-grams: its distinct words, and the distinct
1-, 2- and 3-grams of its word shapes (runs of upper case, lower case, digits and
each punctuation mark; a word equal to the one before has a shape of its own),
hashed into ``BUCKETS``. The class log-count ratio of each bucket comes from all
labelled texts of the learning fold, counted per task and summed by bucket. The
indicators, scaled by the ratios and to unit length, feed a linear hinge-loss
model fitted by dual coordinate descent on a bounded sample (``sample`` labelled
texts in hash order); sigmoid calibration on as many others turns margins into
probabilities.

Ratios and weights are ``BUCKETS`` numbers each, whatever the corpus, and are the
only thing broadcast besides the labels, whose size is checked first. Scoring is
one pass over the texts without a shuffle.

Defined cases: a null or empty text has no features, so its score is that of
margin 0; a null id stays null and is never learned from; rows that repeat get the
same score, and a repeated label counts once; other columns are not read; an empty
table gives no rows; with labels of one class only, the score is their share.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.boosting import platt, sigmoid
from corpusflow.llm.bpe_dp import slices
from corpusflow.llm.common import whole, with_labels

BUCKETS = 1 << 18
REMEMBERED = 400_000
_RUN = re.compile(r"(.)\1+")
_SHAPE = str.maketrans({**{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)},
                        **{chr(c): "9" for c in range(48, 58)}})


def shape(word: str) -> str:
    """``Of%%%`` -> ``Xx%``: the kinds of its characters, each run once."""
    mapped = word.translate(_SHAPE)
    if not mapped.isascii():
        mapped = "".join(c if c < "\x80" else "X" if c.isupper() else "x" if c.isalpha() else c for c in mapped)
    return _RUN.sub(r"\1", mapped)


class Features(dict):
    """Word -> (bucket of the word, code of its shape), remembered per worker."""

    def __missing__(self, word: str) -> tuple[int, int]:
        found = (zlib.crc32(word.lower().encode()) % BUCKETS, zlib.crc32(shape(word).encode()) & 0xFFFFFF)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """The distinct buckets of a text's n-grams."""
        words = text.split()
        if not words:
            return np.empty(0, "i4")
        both = np.array(list(map(self.__getitem__, words)), "u8")
        codes = both[:, 1] + np.uint64(1)
        same = np.concatenate([[False], (both[1:] == both[:-1]).all(1)])
        codes[same] = np.uint64(0xFFFFFFF)
        grams, scale = [codes], np.uint64(0x9E3779B97F4A7C15)
        for _ in range(2):
            before = grams[-1]
            grams.append(before[:-1] * scale + codes[len(codes) - len(before) + 1:])
        hashed = np.unique(np.concatenate([np.unique(g) for g in grams])) * scale >> np.uint64(40)
        return np.unique(np.concatenate([both[:, 0], hashed % np.uint64(BUCKETS)])).astype("i4")


_FEATURES = Features()


@dataclass
class Model:
    """Weights by bucket (ratios included), and the calibration of the margin."""

    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        norm = float(np.sqrt(r @ r))
        return float(r @ self.weight[found]) / norm if norm else 0.0

    def score(self, text: str) -> float:
        return float(sigmoid(self.slope * self.margin(_FEATURES.of(text)) + self.shift))


def descend(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, c: float = 4.0,
            rounds: int = 12) -> np.ndarray:
    """Hinge loss with squared norm by dual coordinate descent: each step solves one
    row's dual variable, kept within 0 and ``c``, and moves the weights with it."""
    weight, alpha = np.zeros(len(ratio)), np.zeros(len(rows))
    scaled = []
    for found in rows:
        r = ratio[found]
        norm = np.sqrt(r @ r)
        scaled.append(r / norm if norm else r)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            x, found, y = scaled[i], rows[i], label[i]
            if not len(x) or not x.any():
                continue
            new = min(max(alpha[i] - (y * (x @ weight[found]) - 1), 0.0), c)  # rows have unit length
            if new != alpha[i]:
                weight[found] += (new - alpha[i]) * y * x
                alpha[i] = new
    return weight


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id",
          text_col: str = "text", sample: int = 6000) -> Model:
    """``labels`` holds only what may be learned from. ``sample`` bounds the texts
    whose features reach the driver, for the fit and for the calibration together."""
    texts = whole(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("_id"),
                          (F.col(label_col) > 0).cast("int").alias("_label")).where("_label is not null") \
        .groupBy("_id").agg(F.max("_label").alias("_label"))
    counted = pa.schema([("bucket", pa.int32()), ("pos", pa.int64()), ("neg", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS + 1), "i8")  # the last one counts texts
        for batch in batches:
            for part in slices(batch):
                for text, label in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    n[label, _FEATURES.of(text)] += 1
                    n[label, BUCKETS] += 1
        at = np.flatnonzero(n.any(0)).astype("i4")
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1, at]), pa.array(n[0, at])], schema=counted)

    sums = with_labels(texts, known).select("_id", "_text", "_label").mapInArrow(
        count, "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    total = np.zeros((2, BUCKETS + 1))
    table = sums.toPandas()  # at most BUCKETS + 1 rows
    total[1, table["bucket"]], total[0, table["bucket"]] = table["p"], table["n"]
    texts_of = total[:, BUCKETS]
    if not texts_of.all():
        share = (texts_of[1] + 1) / (texts_of.sum() + 2)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, float(np.log(share / (1 - share))))
    p, n = total[1, :BUCKETS] + 1, total[0, :BUCKETS] + 1
    ratio = np.log(p / p.sum()) - np.log(n / n.sum())

    # half of the sample from each class, so that the rare one isn't lost
    picked = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2)
        picked = part if picked is None else picked.unionAll(part)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [_FEATURES.of(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.binary())],
                                                 names=["id", "label", "found"])

    rows = with_labels(texts, picked).select("_id", "_text", "_label").mapInArrow(
        extract, "id long, label int, found binary").dropDuplicates(["id"]).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    found = [np.frombuffer(r["found"], "i4") for r in rows]
    label = np.array([r["label"] for r in rows], float)
    half = len(rows) // 2
    weight = descend(found[:half], 2 * label[:half] - 1, ratio)
    model = Model(ratio, weight, 1.0, 0.0)
    slope, shift = platt(np.array([model.margin(f) for f in found[half:]]), label[half:])
    # the sample has as many of each class as it can; give back the corpus's odds
    odds = texts_of[1] / texts_of[0] / max(label[half:].sum(), 1) * max((1 - label[half:]).sum(), 1)
    return Model(ratio.astype("f4"), weight.astype("f4"), slope, shift + float(np.log(odds)))


def score_rows(docs: DataFrame, model: Model, column: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text in ``column``
    (in place of a column of that name)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                scores = [sent.value.score(t or "") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())],
                                                 names=[*part.schema.names, column])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text."""
    return score_rows(whole(docs, id_col, text_col), model, "score", "_text").select(
        F.col("_id").alias("doc_id"), "score")
