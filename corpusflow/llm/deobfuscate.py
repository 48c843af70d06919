"""Toxicity through a noisy channel (operator 6).

Writers hide words by look-alike digits and signs, by spacing letters out and by
repeating them. A token that shows any of this becomes a character lattice: each
run of equal characters offers the letters it may stand for, with a channel cost
each (one or two letters for a run, the letters that a digit or sign resembles,
nothing for a separator). A Viterbi search over states of two letters finds the
cheapest path under channel cost plus a character trigram model. Every token with a
repeated letter, a digit or a sign goes through it, numbers too; a token of letters
counts as it stands besides. In a run of spaced-out characters each gap may end a
word, and the lexicon is also asked at every start within the run. Restored words are
then scored.

* The character model counts trigrams of all words of all documents, per task and
  then by trigram. Letters below U+0250 only, so its size doesn't follow the corpus.
* The lexicon is learned from a bounded sample of the learning fold (``sample``
  texts per class, in hash order): in how many toxic and other texts each restored
  word and word beginning (4 to 6 letters) occurs. Kept are those that speak for
  label 1 by the lower bound of their share.
* A text's evidence is that of its words, each word's the best of its lexicon
  entries; boosted trees over the strongest evidence, calibrated on the other half
  of the sample, give the score.

Scoring is one pass without a shuffle; model and lexicon are broadcast and bounded
by alphabet and sample.

Defined cases: a null or empty text has no evidence and gets the score of that; a
null id stays null and is never learned from; rows that repeat get the same score,
and a repeated label counts once; other columns are not read; an empty table gives
no rows; with labels of one class only, the score is their share.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.boosting import BoostedTrees, platt, sigmoid
from corpusflow.llm.bpe_dp import slices
from corpusflow.llm.common import whole, with_labels

#: Tokens that a worker remembers before it starts anew, and the longest of them.
REMEMBERED, LONGEST = 300_000, 64
# The letters that signs and digits are written for.
RESEMBLES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "×": "x",
    "*": "aeiou", "#": "aeiouh", "%": "aeiou", "?": "aeiou",
}
SEPARATORS = frozenset(" .-_*~'`/\\,:;=^·•")
LOOKALIKE, MASKED, DROP_SEPARATOR, DROP_SIGN, DROP_DIGIT, SHORTEN = 1.0, 2.5, 0.3, 3.0, 6.0, 0.7

_RUN = re.compile(r"(.)\1*", re.S)
_REPEATED = re.compile(r"(.)\1", re.S)
_LETTERS = re.compile(r"[^\W\d_]{4,}")
#: Three or more single characters in a row, each between white space.
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){2,}")
#: What is looked up from a start within such a run: more than the longest beginning.
_WINDOW = 7
_EDGE = re.compile(r"^[.,;:?()\[\]\"'«»¿¡]+|[.,;:?!()\[\]\"'«»]+$")
_PADDING = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")


class CharModel:
    """Interpolated character trigrams; cost in nats of a letter after two others."""

    def __init__(self, counts: dict[str, int]):
        self.tri, self.bi, self.uni = counts, Counter(), Counter()
        tri_of, bi_of = Counter(), Counter()
        for gram, n in counts.items():
            tri_of[gram[:2]] += n
            self.bi[gram[1:]] += n
            bi_of[gram[1]] += n
            self.uni[gram[2]] += n
        self.tri_of, self.bi_of, self.total = tri_of, bi_of, max(1, sum(self.uni.values()))
        self.known: dict[str, float] = {}
        self.moves: dict[tuple[str, str], tuple[float, str]] = {}
        self.arcs: dict[tuple[str, int], list[tuple[str, float]]] = {}

    def cost(self, before: str, letter: str) -> float:
        gram = before + letter
        found = self.known.get(gram)
        if found is None:
            p = (self.uni[letter] + 0.1) / (self.total + 30)
            p = 0.85 * self.bi[gram[1:]] / max(1, self.bi_of[gram[1]]) + 0.15 * p
            p = 0.8 * self.tri.get(gram, 0) / max(1, self.tri_of[gram[:2]]) + 0.2 * p
            found = self.known[gram] = -float(np.log(p))
        return found

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """Per run of equal characters, what it may stand for and the channel's cost."""
        return [self._arcs(m.group(1), m.end() - m.start()) for m in _RUN.finditer(token)]

    def _arcs(self, ch: str, n: int) -> list[tuple[str, float]]:
        arcs = self.arcs.get((ch, n))
        if arcs is None:
            if ch.isalpha():
                arcs = [(ch * n, 0.0)] if n == 1 else [(ch, SHORTEN), (ch * 2, 0.0 if n == 2 else SHORTEN)]
            else:
                price = LOOKALIKE if len(RESEMBLES.get(ch, "")) < 3 else MASKED
                arcs = [(x * k, price * k) for x in RESEMBLES.get(ch, "") for k in ((1,) if n == 1 else (1, 2))]
                drop = DROP_SEPARATOR if ch in SEPARATORS else DROP_DIGIT if ch.isdigit() else DROP_SIGN
                arcs.append(("", drop))
            arcs.sort()  # equal costs go by the letters
            if len(self.arcs) >= REMEMBERED:
                self.arcs.clear()
            self.arcs[ch, n] = arcs
        return arcs

    def _cheapest(self, steps: list[list[tuple[str, float]]]) -> str:
        """The cheapest path's letters (Viterbi over the last two letters). A space ends
        a word. Of equal costs the path stays that is first by its arcs, each step's in
        order of their letters: a state's rank among the paths of its step decides, not
        the paths themselves, so that a token takes linear time however long it is."""
        paths: list[tuple[str, float, tuple | None]] = [("^^", 0.0, None)]  # in order of rank
        for arcs in steps:
            if len(arcs) == len(paths) == 1:  # nothing to choose
                (state, paid, path), (letters, price) = paths[0], arcs[0]
                if letters:
                    extra, state = self.moves.get((state, letters)) or self._move(state, letters)
                    paths = [(state, paid + price + extra, (path, letters))]
                else:
                    paths = [(state, paid + price, path)]
                continue
            after: dict[str, tuple[float, int, int, str, tuple | None]] = {}
            for rank, (state, paid, path) in enumerate(paths):
                for arc, (letters, price) in enumerate(arcs):
                    cost, at = paid + price, state
                    if letters:
                        move = self.moves.get((state, letters))
                        if move is None:
                            move = self._move(state, letters)
                        cost, at = cost + move[0], move[1]
                    old = after.get(at)
                    if old is None or cost < old[0]:  # an equal cost comes from a later rank or arc
                        after[at] = (cost, rank, arc, letters, path)
            if len(after) > 1:
                paths = [(at, cost, (path, letters) if letters else path) for at, (cost, _, _, letters, path)
                         in sorted(after.items(), key=lambda x: x[1][1:3])]
            else:
                paths = [(at, x[0], (x[4], x[3]) if x[3] else x[4]) for at, x in after.items()]
        least, best = None, None
        for at, paid, path in paths:
            cost = paid + self.cost(at, "$")
            if least is None or cost < least:
                least, best = cost, path
        return _spell(best)

    def _move(self, state: str, letters: str) -> tuple[float, str]:
        """What letters cost behind a state, and the state behind them."""
        cost, at = 0.0, state
        for x in letters:
            if x == " ":
                cost, at = cost + self.cost(at, "$"), "^^"
            else:
                cost += self.cost(at, x)
                at = at[1] + x
        if len(self.moves) >= REMEMBERED:
            self.moves.clear()
        found = self.moves[state, letters] = (cost, at)
        return found

    def restore(self, token: str) -> str:
        """The word that a token most likely stands for."""
        return self._cheapest(self.lattice(token.lower()))

    def split(self, run: str) -> list[str]:
        """The words that spaced-out characters most likely stand for."""
        steps = []
        for part in run.lower().split():
            if steps:
                steps.append([("", DROP_SEPARATOR), (" ", DROP_SEPARATOR)])
            steps += self.lattice(part)
        return self._cheapest(steps).split()


def _spell(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def char_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> CharModel:
    """Trigrams of all words of all texts (``^^`` before and ``$`` behind a word)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = Counter(), Counter()

        def settle():
            for word, n in words.items():
                if word.isalpha() and max(word) < "ɐ":
                    padded = f"^^{word}$"
                    for i in range(len(padded) - 2):
                        grams[padded[i:i + 3]] += n
            words.clear()

        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    words.update(text.lower().split())
                if len(words) > REMEMBERED:
                    settle()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())],
                                         names=["gram", "n"])

    rows = whole(docs, id_col, text_col).select("_text").mapInArrow(count, "gram string, n long") \
        .groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # at most letters ** 3 rows
    return CharModel(dict(zip(rows["gram"].tolist(), rows["n"].tolist())))


@dataclass
class Restorer:
    """Tokens -> the words they may hide; remembered per worker."""

    model: CharModel
    seen: dict = field(default_factory=dict)

    def words(self, token: str) -> tuple[str, ...]:
        found = self.seen.get(token)
        if found is None:
            core = token.lower() if token.isalpha() else _EDGE.sub("", _PADDING.sub("", token)).lower()
            if core.isalpha() and not _REPEATED.search(core):
                found = (core,)
            else:
                whole = [core] if core.isalpha() else _LETTERS.findall(core)
                found = tuple(x for x in dict.fromkeys([self.model.restore(core), *whole]) if x)
            if len(token) <= LONGEST:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[token] = found
        return found

    def run(self, run: str) -> set[str]:
        """Words within a run of spaced-out characters: by the lattice's boundaries, as
        one word, and from every start."""
        parts = self.model.split(_EDGE.sub("", run))
        joined = "".join(parts)
        return {joined, *parts, *(joined[i:i + _WINDOW] for i in range(len(joined) - 2))} - {""}

    def of(self, text: str) -> set[str]:
        """The distinct restored words of a text, spaced-out words included."""
        seen = self.seen.get
        out = set(chain.from_iterable([seen(token) or self.words(token) for token in set(text.split())]))
        for m in _SPACED.finditer(text):
            out.update(self.run(m.group()))
        return out

    def text(self, text: str) -> str:
        """The text with every disguised token replaced by its restored word."""
        text = _SPACED.sub(lambda m: " ".join(self.model.split(m.group())), text)
        return re.sub(r"\S+", lambda m: m.group() if not (w := self.words(m.group()))
                      or w[0] in m.group().lower() else w[0], text)


def entries(word: str) -> list[str]:
    """What the lexicon may know a word by: itself and its beginnings."""
    return [word + "$", *[word[:n] for n in (4, 5, 6) if len(word) > n]]


@dataclass
class Model:
    restorer: Restorer
    lexicon: dict[str, float]
    trees: BoostedTrees | None = None
    slope: float = 0.0
    shift: float = 0.0

    def __post_init__(self):
        # every entry of a word begins like the word with its end
        self.starts = {entry[:4] for entry in self.lexicon}

    def evidence(self, text: str) -> list[float]:
        best, get, starts = [], self.lexicon.get, self.starts
        words = self.restorer.of(text)
        for word in words:
            if (word + "$")[:4] in starts:
                found = [e for x in entries(word) if (e := get(x)) is not None]
                if found:
                    best.append(max(found))
        best = sorted(best, reverse=True)[:3] + [-6.0] * 3
        return [best[0], best[1], best[2], float(np.log1p(len(words)))]

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), sigmoid(self.shift))
        x = np.array([self.evidence(t) for t in texts], float).reshape(-1, 4)
        return sigmoid(self.slope * self.trees.margin(x) + self.shift)


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
          sample: int = 5000, least: int = 4) -> Model:
    """``labels`` holds only what may be learned from; ``sample`` bounds the texts of
    each class that the lexicon, the trees and the calibration are fitted on."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("_id"),
                          (F.col(label_col) > 0).cast("int").alias("_label")).where("_label is not null and _id is not null") \
        .groupBy("_id").agg(F.max("_label").alias("_label"))
    sizes = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    restorer = Restorer(char_counts(docs, id_col, text_col))
    if len(sizes) < 2:
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return Model(restorer, {}, shift=float(np.log(share / (1 - share))))
    picked = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        picked = part if picked is None else picked.unionAll(part)
    texts = with_labels(whole(docs, id_col, text_col), picked).select("_id", "_label", "_text").dropDuplicates(["_id"])
    sent = spark.sparkContext.broadcast(restorer)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [sorted({e for w in sent.value.of(t) for e in entries(w)}) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.list_(pa.string()))], names=["id", "label", "found"])

    # first half of the sample: the lexicon; second half: trees and calibration
    first = F.crc32(F.concat(F.lit("half"), F.col("_id").cast("string")).cast("binary")) % 2 == 0
    found = texts.where(first).mapInArrow(extract, "id long, label int, found array<string>")
    table = found.select("label", F.explode("found").alias("e")).groupBy("e").agg(
        F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).where(F.col("p") >= least).toPandas()
    weigh = (sizes[0] / min(sample, sizes[0])) / (sizes[1] / min(sample, sizes[1]))  # the corpus's odds
    p, n = table["p"].to_numpy(float), table["n"].to_numpy(float) * weigh
    share, total = (p + 0.05) / (p + n + 1.0), p + table["n"].to_numpy(float) + 1.0
    low = np.clip(share - 1.0 * np.sqrt(share * (1 - share) / total), 1e-3, 1 - 1e-3)
    keep = low > 0.3
    lexicon = dict(zip(table["e"][keep].tolist(), np.log(low / (1 - low))[keep].tolist()))
    model = Model(restorer, lexicon)
    sent_model = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = [sent_model.value.evidence(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(x, pa.list_(pa.float64()))], names=["id", "label", "x"])

    rows = texts.where(~first).mapInArrow(measure, "id long, label int, x array<double>").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    if not rows:
        return model
    x, y = np.array([r["x"] for r in rows], float), np.array([r["label"] for r in rows], float)
    half = np.arange(len(rows)) % 2 == 0
    trees = BoostedTrees(n_trees=25, depth=2).fit(x[half], y[half])
    slope, shift = platt(trees.margin(x[~half]), y[~half])
    shift -= float(np.log(weigh))
    return Model(restorer, lexicon, trees, slope, shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: the probability of label 1 of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sent.value.scores(part.column(1).to_pylist()), pa.float64())],
                    names=["doc_id", "score"])

    return whole(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def restore(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with disguised words restored."""
    sent = docs.sparkSession.sparkContext.broadcast(model.restorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([sent.value.text(t) for t in part.column(1).to_pylist()], pa.string())],
                    names=["doc_id", "text"])

    return whole(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string")
