"""L1-L3: language identification as Spark jobs, with pluggable providers.

Providers add ``<prefix>_label`` and ``<prefix>_score`` for a text column:

* :class:`LabelColumnLid` (L1c) - existing label/score columns.
* :class:`TrigramLid` (L1a/L1b) - character-trigram multinomial naive Bayes,
  trained with explode -> aggregate. Applied in one vectorised pass over Arrow
  batches: trigrams become integer codes, looked up by binary search in the sorted
  codes of the model, and rows of its dense matrix are added up per text. No row per
  trigram, no key, no join, no shuffle. The model is sent to the tasks if its bytes
  allow; a larger one is joined to the exploded trigrams.

Model. For language l with trigram counts c_l(g), N_l = sum_g c_l(g) and V the
number of distinct training trigrams, add-one smoothing gives
``ln P(g|l) = ln(c_l(g)+1) - ln(N_l+V)``. A text with n trigrams therefore
scores ``s_l = -n ln(N_l+V) + sum_g ln(c_l(g)+1)``: the model table only needs
``ln(c+1)`` per (gram, language) and unseen grams add 0. Uniform prior; the
label is argmax s_l (ties: smallest label), the score its softmax probability.
Text is lower-cased with newlines as spaces; the whole text is used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Decision threshold of both rules and the label for text without
# any trigram.
THRESHOLD = 0.5
NO_LABEL = "other"

# A model is sent to the tasks only if its rows (one double per language, the trigram
# and overhead) take no more bytes than this; otherwise it is joined by a shuffle.
MAX_BROADCAST_BYTES = 256 << 20
GRAM_BYTES = 48
# Trigrams of a batch that are looked up at once.
WINDOW = 1 << 20


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lid_text(c) -> Column:
    """Feature text: lower-cased, newlines as spaces."""
    return F.lower(F.translate(_c(c), "\n", " "))


def trigrams(c) -> Column:
    """All overlapping character trigrams of the feature text, in order."""
    # the dot behind the look-ahead steps over whole code points
    return F.regexp_extract_all(lid_text(c), F.lit("(?s)(?=(.{3}))."), 1)


class LabelColumnLid:
    """Take the label (and optionally the score) from existing columns."""

    text_only = False

    def __init__(self, label_col: str = "lang", score_col: str | None = None,
                 by_text: dict[str, tuple[str, str | None]] | None = None):
        """``by_text`` maps a text column to its own (label, score) columns,
        e.g. one pair per side of a parallel corpus."""
        self.label_col = label_col
        self.score_col = score_col
        self.by_text = by_text or {}

    def annotate(self, df: DataFrame, text_col: str, key_cols: Sequence[str] = (),
                 prefix: str = "lid") -> DataFrame:
        label_col, score_col = self.by_text.get(text_col, (self.label_col, self.score_col))
        score = F.col(score_col).cast("double") if score_col else F.lit(1.0)
        return (df.withColumn(f"{prefix}_label", F.col(label_col))
                  .withColumn(f"{prefix}_score", score))


def codes(text: np.ndarray) -> np.ndarray:
    """Integer codes of consecutive trigrams of code points (21 bits each)."""
    c = text.astype("i8")
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def portions(texts) -> Iterator[list]:
    """The texts in pieces of about ``WINDOW`` code points."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n >= WINDOW:
            yield part
            part, n = [], 0
    if part:
        yield part


class DenseModel:
    """Sorted trigram codes and their matrix, as a worker uses them."""

    def __init__(self, grams: list[str], matrix: np.ndarray, langs: list[str], log_norm: list[float]):
        # a trigram is three code points, so the codes lie in triples
        flat = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4")
        code = codes(flat)[::3] if len(flat) else np.empty(0, "i8")
        order = np.argsort(code)
        by_name = sorted(range(len(langs)), key=lambda i: langs[i])  # ties: smallest label
        self.code, self.matrix = code[order], np.ascontiguousarray(matrix[order][:, by_name])
        self.langs = [langs[i] for i in by_name]
        self.log_norm = np.array([log_norm[i] for i in by_name])

    def __call__(self, texts: pd.Series) -> pd.DataFrame:
        found = [self._some([t or "" for t in part]) for part in portions(texts)]
        return pd.concat(found, ignore_index=True) if found else self._some([])

    def _some(self, texts: list[str]) -> pd.DataFrame:
        size = np.array([len(t) for t in texts], "i8")
        n = np.maximum(size - 2, 0)
        sums = np.zeros((len(texts), len(self.langs)))
        stop = np.cumsum(size)
        rows = np.repeat(np.arange(len(texts)), size)
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        for a in range(0, max(0, len(flat) - 2), WINDOW):
            code = codes(flat[a:a + WINDOW + 2])
            place = np.arange(a, a + len(code))
            row = rows[a:a + len(code)]
            at = np.minimum(np.searchsorted(self.code, code), max(len(self.code) - 1, 0))
            hit = (place + 2 < stop[row]) & (self.code[at] == code) if len(self.code) else np.zeros(len(code), bool)
            for lang in range(len(self.langs)):
                sums[:, lang] += np.bincount(row[hit], self.matrix[at[hit], lang], len(texts))
        score = sums - n[:, None] * self.log_norm
        if not len(self.langs):
            return pd.DataFrame({"label": [NO_LABEL] * len(texts), "score": [0.0] * len(texts)})
        best = score.max(1)
        label = np.array(self.langs, dtype=object)[score.argmax(1)]
        with np.errstate(under="ignore"):
            value = 1.0 / np.exp(score - best[:, None]).sum(1)
        return pd.DataFrame({"label": np.where(n > 0, label, NO_LABEL), "score": np.where(n > 0, value, 0.0)})


@dataclass
class TrigramLid:
    """L1a/L1b trained model: ``model`` has columns ``gram, d0..d{L-1}`` where
    ``d_i = ln(count+1)`` for language ``langs[i]``."""

    model: DataFrame
    langs: list[str]
    text_only = True
    log_norm: list[float]          # ln(N_l + V) per language
    n_grams: int                   # V, rows of ``model``
    _dense: object = field(default=None, repr=False)

    def dense(self):
        """The scoring function of one text column, or None if the model is too large
        to be sent to every task."""
        if self.n_grams * (GRAM_BYTES + 8 * len(self.langs)) > MAX_BROADCAST_BYTES:
            return None
        if self._dense is None:
            rows = self.model.toArrow()
            matrix = np.stack([rows[f"d{i}"].to_numpy() for i in range(len(self.langs))], 1) if self.langs \
                else np.empty((rows.num_rows, 0))
            made = DenseModel(rows["gram"].to_pylist(), matrix, self.langs, self.log_norm)
            bc = self.model.sparkSession.sparkContext.broadcast(made)
            # not deterministic by declaration: a filter on the label must not be
            # pushed below, where the text would be scored once more
            self._dense = F.arrow_udf(_scorer(bc), "label string, score double").asNondeterministic()
        return self._dense

    def annotate_all(self, df: DataFrame, text_cols: dict[str, str], key_cols: Sequence[str] = ()) -> DataFrame:
        """``<prefix>_label, <prefix>_score`` for several (prefix -> text column) in one
        pass over the rows."""
        udf = self.dense()
        if udf is None:
            for prefix, text_col in text_cols.items():
                df = df.join(self._joined(df, text_col, key_cols, prefix), list(key_cols), "left")
            return df
        out = df.select("*", *[udf(lid_text(c)).alias(f"_{p}_lid") for p, c in text_cols.items()])
        return out.select(*df.columns, *[F.col(f"_{p}_lid.{x}").alias(f"{p}_{x}") for p in text_cols for x in ("label", "score")])

    def scores(self, df: DataFrame, text_col: str, key_cols: Sequence[str],
               prefix: str = "lid") -> DataFrame:
        """``keys, <prefix>_label, <prefix>_score`` of every row."""
        if self.dense() is None:
            return self._joined(df, text_col, key_cols, prefix)
        return self.annotate_all(df.select(*key_cols, text_col), {prefix: text_col}).drop(text_col)

    def _joined(self, df: DataFrame, text_col: str, key_cols: Sequence[str],
               prefix: str = "lid") -> DataFrame:
        """The same for a model that is too large to be sent to the tasks, for unique
        keys: exploded trigrams are joined with it and added up by key."""
        keys = list(key_cols)
        L = len(self.langs)
        # explode(regexp_extract_all(text)) stays inline in the Generate: no
        # expression over the text sits above it (it would be re-evaluated per
        # trigram), and the trigram count n comes from the aggregate itself.
        exploded = df.select(*keys, F.explode_outer(trigrams(text_col)).alias("gram"))
        joined = exploded.join(self.model, "gram", "left")
        agg = joined.groupBy(*keys).agg(
            F.count("gram").alias("_n"),
            *[F.sum(F.coalesce(F.col(f"d{i}"), F.lit(0.0))).alias(f"_S{i}") for i in range(L)])
        s = [F.col("_n") * F.lit(-self.log_norm[i]) + F.col(f"_S{i}") for i in range(L)]
        agg = agg.select(*keys, "_n", *[s[i].alias(f"_s{i}") for i in range(L)])
        m = F.greatest(*[F.col(f"_s{i}") for i in range(L)]) if L > 1 else F.col("_s0")
        order = sorted(range(L), key=lambda i: self.langs[i])
        label = F.coalesce(*[F.when(F.col(f"_s{i}") == F.col("_m"), F.lit(self.langs[i]))
                             for i in order])
        denom = sum((F.exp(F.col(f"_s{i}") - F.col("_m")) for i in range(1, L)),
                    F.exp(F.col("_s0") - F.col("_m")))
        has = F.col("_n") > 0
        return (agg.withColumn("_m", m)
                   .select(*keys,
                           F.when(has, label).otherwise(F.lit(NO_LABEL)).alias(f"{prefix}_label"),
                           F.when(has, F.lit(1.0) / denom).otherwise(F.lit(0.0))
                            .alias(f"{prefix}_score")))

    def annotate(self, df: DataFrame, text_col: str, key_cols: Sequence[str] = (),
                 prefix: str = "lid") -> DataFrame:
        """Add label and score columns, in the rows' own partitions. (Only a model too
        large for that needs ``key_cols``, unique in ``df``.)"""
        return self.annotate_all(df, {prefix: text_col}, key_cols)


def _scorer(bc):
    def score(texts: pa.Array) -> pa.Array:
        # a text becomes a Python object when its turn comes
        found = bc.value(x.as_py() for x in texts)
        return pa.StructArray.from_arrays([pa.array(found["label"], pa.string()), pa.array(found["score"], pa.float64())], ["label", "score"])

    return score


def save_lid(lid: TrigramLid, path: str) -> str:
    """The model as two Parquet tables under ``path``."""
    spark = lid.model.sparkSession
    lid.model.write.mode("errorifexists").parquet(f"{path}/grams")
    rows = [(i, lang, norm) for i, (lang, norm) in enumerate(zip(lid.langs, lid.log_norm))]
    spark.createDataFrame(rows, "i int, lang string, log_norm double").coalesce(1).write.mode("errorifexists").parquet(f"{path}/languages")
    return path


def load_lid(spark: SparkSession, path: str) -> TrigramLid:
    model = spark.read.parquet(f"{path}/grams")
    langs = spark.read.parquet(f"{path}/languages").orderBy("i").collect()
    return TrigramLid(model=model, langs=[r["lang"] for r in langs], log_norm=[r["log_norm"] for r in langs], n_grams=model.count())


def train_trigram_lid(df: DataFrame, text_col: str = "text", label_col: str = "lang",
                      checkpoint: bool = True) -> TrigramLid:
    """``groupBy(language, trigram).count()`` over the exploded training
    text (partial aggregate: frequent trigrams collapse map-side), written to
    the shared folder; then a pivot of that small table to one row per
    trigram. Only the language list and per-language totals reach the driver."""
    from corpusflow.session import materialize
    counts = (df.where(F.col(label_col).isNotNull())
                .select(F.col(label_col).alias("_lang"), F.explode(trigrams(text_col)).alias("gram"))
                .groupBy("_lang", "gram").count())
    if checkpoint:
        counts = materialize(counts, "lid-counts")
    totals = counts.groupBy("_lang").agg(F.sum("count").alias("N")).collect()
    langs = sorted(r["_lang"] for r in totals)
    N = {r["_lang"]: int(r["N"]) for r in totals}
    model = (counts.groupBy("gram")
                   .pivot("_lang", langs)
                   .agg(F.first(F.log1p(F.col("count").cast("double"))))
                   .na.fill(0.0))
    model = model.select("gram", *[F.col(f"`{l}`").alias(f"d{i}") for i, l in enumerate(langs)])
    if checkpoint:
        model = materialize(model, "lid-model")
    V = model.count()
    return TrigramLid(model=model, langs=langs,
                      log_norm=[math.log(N[l] + V) for l in langs], n_grams=V)


def strict_keep(label, score, lang: str, threshold: float = THRESHOLD) -> Column:
    """L2 (monolingual): keep iff label == lang and score >= threshold."""
    return (_c(label) == F.lit(lang)) & (_c(score) >= threshold)


def lenient_reject(label, score, lang: str, threshold: float = THRESHOLD) -> Column:
    """L3 (parallel, per side): reject iff score > threshold and label != lang;
    low-confidence predictions pass."""
    return (_c(score) > threshold) & (_c(label) != F.lit(lang))
