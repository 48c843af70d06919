"""Personal data by candidate gradient boosting (operator 5).

One pass over the whole texts writes, per document, the base spans of the
contract and candidates of high-recall generators: national and run-on phone
numbers, card numbers within longer runs of digits, spelled-out addresses, IP
addresses with other separators. Candidates may overlap. Each has features of its
format and of its context, never the contract's own verdict.

The model learns from the corpus itself: base spans are positive, and so are base
addresses rewritten in the spelled-out forms that the generator proposes; base matches
that fail their check, and base spans spoilt in place (a digit changed, a part too
large, digits cut off, glued to a word, a sentence's end for a host, a plain word
before "at"), are negative. Every example counts: they are summed by the cells of a
grid of quantiles, and boosted trees are fitted on the weighted cells of one half, one
set per kind; on the other half the margins are calibrated, and each kind's threshold is
the lowest at which ``precision`` of that half is kept. Selected candidates that don't
overlap a base span or a better candidate are added. Base spans always stay.

The table between the passes holds spans and features, not texts. There is no
shuffle of texts and nothing per document reaches the driver.

Defined cases: a null or empty text has no spans; a null id stays null; rows that
repeat are judged one by one; other columns are not read; an empty table gives no
rows; without enough examples of a kind nothing of that kind is added.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.boosting import BoostedTrees, platt, sigmoid
from corpusflow.llm.bpe_dp import slices
from corpusflow.llm.common import whole
from corpusflow.session import discard, materialize

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns. Possessive forms and the look-behind match
# the same spans and keep the time linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Generators: wide patterns, checked by the model alone.
SPELLED = re.compile(r"(?i)(?<![\w.])[a-z0-9][\w.+-]{0,63}[ ]?(?:\(at\)|\[at\]|\{at\}|[ ]at[ ]|@)[ ]?[a-z0-9-]{1,63}"
                     r"(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\}|[ ]dot[ ]|\.)[ ]?[a-z]{2,24}){1,4}(?![\w@])")
NUMBERS = re.compile(r"[+(]?[0-9](?:[\x20()./_-]{0,2}[0-9]){6,}")
GROUPED = re.compile(r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
QUADS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:[ ]?[.][ ]?|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])")
AT = re.compile(r"(?i)[ ]?(?:\(at\)|\[at\]|\{at\}|[ ]at[ ]|@)[ ]?")
DOT = re.compile(r"(?i)[ ]?(?:\(dot\)|\[dot\]|\{dot\}|[ ]dot[ ]|\.)[ ]?")
HINTS = {
    "email": ("mail", "contact", "write", "schreib", "correo", "courriel", "@"),
    "ip": ("ip", "host", "server", "address", "login", "ping"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "anruf", "whatsapp"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes) of the contract's leftmost matches."""
    found, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            found.append((0, start, last, True))
        at = text.find("@", at + 1)
    found += [(1, *m.span(), _octets(m.group())) for m in IP.finditer(text)]
    for m in CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() >= 13 else ""
        if len(d) >= 13:
            found.append((2, *m.span(), 16 <= len(d) <= 19 and luhn(d)))
    if "+" in text:
        found += [(3, *m.span(), 8 <= len(_digits(m.group())) <= 15) for m in PHONE.finditer(text)]
    return found


def candidates(text: str) -> set[tuple[int, int, int]]:
    """Overlapping proposals of all generators."""
    found = set()
    lower = text.lower()
    if any(sign in lower for sign in ("@", " at ", "(at)", "[at]", "{at}")):
        found |= {(0, *m.span()) for m in SPELLED.finditer(text)}
    found |= {(1, *m.span()) for m in QUADS.finditer(text)}
    found |= {(3, *m.span()) for m in GROUPED.finditer(text)}
    for m in NUMBERS.finditer(text):
        a, b = m.span()
        # digit groups of the run: every stretch of whole groups up to 19 digits is a proposal
        groups = [(g.start() + a, g.end() + a) for g in re.finditer("[0-9]+", m.group())]
        for i in range(len(groups)):
            n = 0
            for j in range(i, len(groups)):
                n += groups[j][1] - groups[j][0]
                if n > 19:
                    break
                if n >= 13:
                    found.add((2, groups[i][0], groups[j][1]))
                if 8 <= n <= 15 and i < j:
                    start = groups[i][0]
                    while start > a and text[start - 1] in "+(":
                        start -= 1
                    found.add((3, start, groups[j][1]))
    return found


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of a span and what stands around it; of an e-mail address how it is
    spelled, as lengths and digits say nothing about that."""
    span = text[start:end]
    if kind == 0:
        return _spelling(text, start, end)
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    digits = _digits(span)
    before, after = text[max(0, start - 1):start], text[end:end + 1]
    side = lambda c: 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3
    around = (text[max(0, start - 32):start] + " " + text[end:end + 16]).lower()
    values = [int(g) if len(g) < 10 else 10 ** 9 for g in re.findall("[0-9]+", span)] or [0]
    labels = re.split(r"\.|dot", span.lower().rpartition("@")[2])
    return [len(span), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1],
            span.count(" "), span.count("-"), span.count("."), span.count("(") == span.count(")"),
            span[:1] == "+", span.count("@"), sum(c.isalpha() for c in span),
            len(labels), len(labels[-1].strip(" []{}()")), max(values) if kind == 1 else min(max(values), 999),
            len(digits) > 12 and len(digits) < 20 and luhn(digits), len({*span} - {*"0123456789"}),
            side(before), side(after), any(h in around for h in HINTS[KINDS[kind]]),
            len(set(digits)), before in tuple(".,:;-/_") and text[max(0, start - 2):start - 1].isdigit()]


N_FEATURES = 24


def _spelling(text: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    sign = AT.search(span)
    local, dots = span[:sign.start()], [m.group() for m in DOT.finditer(span, sign.end())]
    around = (text[max(0, start - 32):start] + " " + text[end:end + 16]).lower()
    return [span.count("@"), sign.group().strip()[0] in "([{", sum(len(d) > 3 for d in dots), dots.count("."),
            sum("." in d and d != "." for d in dots), not local.isalpha(), text[max(0, start - 1):start].isalnum(),
            text[end:end + 1].isalnum(), any(h in around for h in HINTS["email"])]


def spelled(text: str, start: int, end: int) -> list[tuple[str, int, int, int]]:
    """The base address spelled out in place, in several ways that depend on it alone."""
    local, _, host = text[start:end].partition("@")
    seed = zlib.crc32(text[start:end].encode())
    lead, tail = text[max(0, start - 40):start], text[end:end + 40]
    pad, (left, right) = " " * (seed % 2), ("()", "[]", "{}")[seed // 2 % 3]
    at, dot = ("AT", "DOT") if seed // 6 % 4 == 0 else ("at", "dot")
    sign, stop = f"{pad}{left}{at}{right}{pad}", f"{pad}{left}{dot}{right}{pad}"
    mixed = ((sign, "."), ("@", stop), ("@", f" {dot} "), (sign, f" {dot} "), (f" {at} ", stop))[seed // 24 % 5]
    # plain names and short hosts too, so that only the form tells the classes apart
    names, hosts = (local, re.sub("[^A-Za-z]", "", local)), (host, ".".join(host.split(".")[-2:]))
    made = [names[seed >> i & 1] + a + hosts[seed >> i + 3 & 1].replace(".", d)
            for i, (a, d) in enumerate([(sign, stop), (f" {at} ", f" {dot} "), mixed])]
    made.append(f"{local} at {hosts[seed >> 6 & 1]}")
    return [(lead + s + tail, 0, len(lead), len(lead) + len(s)) for s in made if SPELLED.fullmatch(s)]


def spoilt(text: str, kind: int, start: int, end: int) -> list[tuple[str, int, int, int]]:
    """The span made wrong in place, in several ways that depend on the span alone."""
    span = text[start:end]
    seed = zlib.crc32(span.encode())
    lead, tail = text[max(0, start - 40):start], text[end:end + 40]
    made = []
    if kind == 2:
        i = next(k for k in range(len(span) - 1, -1, -1) if span[k].isdigit())
        made = [span[:i] + str((int(span[i]) + 1 + seed % 8) % 10), span[:-4], span + str(seed % 10)]
    elif kind == 1:
        p = span.split(".")
        p[seed % 4] = str(256 + seed % 700)
        made = [".".join(p), span + "." + str(seed % 20)]
    elif kind == 3:
        d = _digits(span)
        made = [d[:4] + "-" + d[4:6] + "-" + d[6:8], d[:5] + " " + d[5:8], d[:3] + "." + d[3:5] + "." + d[5:8]]
    else:
        # a sentence that ends after "at", and one that names a site: no address
        local, _, host = span.partition("@")
        words = re.findall(r"(?<![\w.@-])[A-Za-z]{2,24}(?![\w@-])", lead) or ["see"]
        later = re.findall(r"(?<![\w.@-])[A-Za-z]{2,24}(?![\w@-])", tail) or ["on"]
        place = host.split(".")[0]
        made = [f"{words[-1]} at {place}. {later[0]}", f"{local} at {place}. {later[0]}",
                f"{local} {('(at)', '[at]', '{at}')[seed % 3]} {place}. {later[0]}",
                f"{words[-1]} at {host}", f"{words[-1]} at {'.'.join(host.split('.')[-2:])}"]
        made = [s for s in made if SPELLED.fullmatch(s)]
    out = [(lead + s + tail, kind, len(lead), len(lead) + len(s)) for s in made]
    glued = lead.rstrip() + "x7" + span + "9q" + tail.lstrip()
    a = len(lead.rstrip()) + 2
    return [*out, (glued, kind, a, a + len(span))] if kind else out


SCHEMA = ("doc_id long, kind array<int>, start array<long>, stop array<long>, "
          "role array<int>, feats array<binary>")
BASE, PROPOSED, WRONG, RIGHT = 0, 1, 2, 3
#: Spans after which a task sends on the documents it has.
SPANS_AT_ONCE = 20_000
_ARROW = pa.schema([("doc_id", pa.int64()), ("kind", pa.list_(pa.int32())), ("start", pa.list_(pa.int64())),
                    ("stop", pa.list_(pa.int64())), ("role", pa.list_(pa.int32())),
                    ("feats", pa.list_(pa.binary()))])


def extract(text: str) -> list[tuple[int, int, int, int, bytes]]:
    """(kind, start, end, role, features): base spans, proposals that overlap none
    of them, and further right and wrong examples for training."""
    out = []
    pack = lambda t, *s: np.array(features(t, *s), "f4").tobytes()
    matches = base_matches(text)
    base = [m[:3] for m in matches if m[3]]
    for k, a, b in base:
        out.append((k, a, b, BASE, pack(text, k, a, b)))
        out += [(k, -1, -1, WRONG, pack(t, *s)) for t, *s in spoilt(text, k, a, b)]
        if k == 0:
            out += [(k, -1, -1, RIGHT, pack(t, *s)) for t, *s in spelled(text, a, b)]
    out += [(k, -1, -1, WRONG, pack(text, k, a, b)) for k, a, b, good in matches if not good]
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], "i8")
    stops = np.maximum.accumulate(np.array([b for _, b in taken], "i8")) if taken else starts
    for k, a, b in sorted(candidates(text)):
        i = int(np.searchsorted(starts, b)) - 1  # the base spans that begin before its end
        if i < 0 or stops[i] <= a:
            out.append((k, a, b, PROPOSED, pack(text, k, a, b)))
    return out


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind, start, stop, role, feats = zip(*x) if (x := extract(text)) else [()] * 5
                rows.append({"doc_id": doc_id, "kind": kind, "start": start, "stop": stop,
                             "role": role, "feats": feats})
                n += len(kind)
                if n > SPANS_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, n = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return whole(docs, id_col, text_col).mapInArrow(run, SCHEMA)


EXAMPLES = pa.schema([("kind", pa.int32()), ("feats", pa.binary()), ("half", pa.int32()), ("good", pa.int64()), ("bad", pa.int64())])
EXAMPLE = "kind int, feats binary, half int, good long, bad long"


def _examples(spans: DataFrame) -> DataFrame:
    """All examples as distinct vectors of features with their numbers, by half."""
    x = spans.select("doc_id", F.posexplode(F.arrays_zip("kind", "role", "feats")).alias("at", "x")).select("doc_id", "at", "x.*")
    x = x.where(f"role <> {PROPOSED}").withColumn("half", F.pmod(F.xxhash64("doc_id", "at"), F.lit(2)).cast("int"))
    good = F.sum((F.col("role") != WRONG).cast("long"))
    return x.groupBy("kind", "feats", "half").agg(good.alias("good"), (F.count(F.lit(1)) - good).alias("bad"))


def _edges(examples: DataFrame, bins: int) -> dict[int, list[np.ndarray]]:
    """Per kind and feature the quantiles of all examples' values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, n = batch.column(0).to_numpy(), batch.column(3).to_numpy() + batch.column(4).to_numpy()
            feats = batch.column(1).to_pylist()
            for kind in np.unique(kinds).tolist():
                at = np.flatnonzero(kinds == kind)
                x = np.stack([np.frombuffer(feats[i], "f4") for i in at]).astype("f8")
                for j, column in enumerate(x.T):
                    values, where = np.unique(column, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), v, "i4")) for v in (kind, j)] + [
                        pa.array(values), pa.array(np.bincount(where, n[at]).astype("i8"))], names=["kind", "j", "v", "n"])

    counts = examples.mapInArrow(run, "kind int, j int, v double, n long").groupBy("kind", "j", "v").agg(F.sum("n").alias("n"))
    steps = ", ".join(f"{i / bins}D" for i in range(1, bins))
    found: dict[int, list[np.ndarray]] = {}
    for r in counts.groupBy("kind", "j").agg(F.expr(f"percentile(v, array({steps}), n)").alias("q")).orderBy("kind", "j").collect():
        found.setdefault(r["kind"], []).append(np.unique(r["q"]))
    return found


def _cells(examples: DataFrame, edges: dict[int, list[np.ndarray]]) -> DataFrame:
    """Examples by the cell of the grid in which they lie; ``feats`` names the cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [bytes([int(np.searchsorted(e, v, side="right")) for e, v in zip(edges[k], np.frombuffer(f, "f4"))])
                     for k, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), *batch.columns[2:]], schema=EXAMPLES)

    sums = [F.sum(c).cast("long").alias(c) for c in ("good", "bad")]
    return examples.where(F.col("kind").isin(list(edges))).select(*EXAMPLES.names).mapInArrow(run, EXAMPLE).groupBy("kind", "feats", "half").agg(*sums)


def train(spans: DataFrame, cells: int = 32_768, precision: float = 0.95, bins: int = 24) -> dict:
    """Per kind (trees, calibration, threshold) from all examples. They are counted by
    the cells of a grid of quantiles; a kind with more than ``cells`` cells gets a
    coarser grid, and at two steps a feature one of fewer features: 2 ** 14 cells in
    each half at most, so that the driver's part is bounded and no example is left out."""
    examples = materialize(_examples(spans).select(*EXAMPLES.names), "pii-examples")
    models, todo, cells = {}, _edges(examples, bins), max(cells, 4)
    while todo:
        table = materialize(_cells(examples, todo), "pii-cells")
        size = {r["kind"]: r["count"] for r in table.groupBy("kind").count().collect()}
        coarser = {}
        for kind, edges in todo.items():
            if size[kind] > cells:
                used = [j for j, e in enumerate(edges) if len(e)]
                if max(len(e) for e in edges) > 1:
                    coarser[kind] = [e[len(e) // 2:][:1] if len(e) < 4 else e[1::2] for e in edges]
                else:
                    coarser[kind] = [e if j in used[:max(1, min(14, len(used) - 1))] else e[:0] for j, e in enumerate(edges)]
                continue
            rows = sorted(table.where(F.col("kind") == kind).collect(), key=lambda r: (r["feats"], r["half"]))
            if (model := _fit(rows, edges, precision)) is not None:
                models[kind] = model
        discard(table)
        todo = coarser
    discard(examples)
    return models


def _fit(rows: list, edges: list[np.ndarray], precision: float) -> tuple | None:
    """Trees on one half of a kind's cells, calibration and threshold on the other."""
    # a value of each feature that lies in the cell: its lower edge
    lower = [np.concatenate([[e[0] - 1 if len(e) else 0.0], e]) for e in edges]
    feats = np.array([[low[c] for low, c in zip(lower, r["feats"])] for r in rows], float)
    feats, first = np.concatenate([feats, feats]), np.array([r["half"] == 0 for r in rows] * 2)
    label = np.repeat([1.0, 0.0], len(rows))
    weight = np.array([r["good"] for r in rows] + [r["bad"] for r in rows], float)
    some = weight > 0
    feats, first, label, weight = feats[some], first[some], label[some], weight[some]
    if min(weight[(first == half) & (label == good)].sum() for half in (True, False) for good in (0, 1)) < 5:
        return None
    trees = BoostedTrees().fit(feats[first], label[first], weight[first], edges)
    margin, y, w = trees.margin(feats[~first]), label[~first], weight[~first]
    a, b = platt(margin, y, weight=w)
    # examples of one probability stay or go together
    p, same = np.unique(np.round(sigmoid(a * margin + b), 9), return_inverse=True)
    good, every = np.bincount(same, w * y)[::-1].cumsum(), np.bincount(same, w)[::-1].cumsum()
    fine = np.flatnonzero(good / every >= precision)
    return (trees, a, b, max(0.5, float(p[::-1][fine[-1]]) - 1e-9)) if len(fine) else None


def select_spans(rows: list[tuple], models: dict) -> list[tuple[int, int, int]]:
    """Of one document's proposals, those over their threshold, best first, that
    overlap none selected before. Of equal ones the longest."""
    scored = []
    for kind, (trees, a, b, least) in models.items():
        mine = [r for r in rows if r[0] == kind and r[3] == PROPOSED]
        if mine:
            p = sigmoid(a * trees.margin(np.stack([np.frombuffer(r[4], "f4") for r in mine]).astype("f8")) + b)
            scored += [(-round(float(q), 6), r[1] - r[2], r[1], r[2], kind) for q, r in zip(p, mine) if q >= least]
    chosen: list[tuple[int, int, int]] = []  # by start; none overlaps another
    for _, _, a, b, kind in sorted(scored):
        at = bisect_left(chosen, a, key=lambda x: x[1])
        if (at == len(chosen) or b <= chosen[at][1]) and (not at or chosen[at - 1][2] <= a):
            chosen.insert(at, (kind, a, b))
    return chosen


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = 32_768,
           precision: float = 0.95) -> DataFrame:
    """``doc_id, base, added``: arrays of (kind, start, stop), by kind, then start."""
    spans = materialize(find_spans(docs, id_col, text_col), "pii-spans")
    models = docs.sparkSession.sparkContext.broadcast(train(spans, cells, precision))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    arrow = pa.schema([("doc_id", pa.int64()), ("base", span), ("added", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda s: {"kind": KINDS[s[0]], "start": s[1], "stop": s[2]}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows = list(zip(r["kind"], r["start"], r["stop"], r["role"], r["feats"]))
                out.append({"doc_id": r["doc_id"],
                            "base": [name(x) for x in sorted(x[:3] for x in rows if x[3] == BASE)],
                            "added": [name(x) for x in sorted(select_spans(rows, models.value))]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    item = "array<struct<kind:string,start:long,stop:long>>"
    return spans.mapInArrow(run, f"doc_id long, base {item}, added {item}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span as ``[KIND]``; spans that overlap are joined."""
    out, last = [], 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, stop)
    return "".join([*out, text[last:]])


def redact_rows(docs: DataFrame, models: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with every base span and selected candidate of the whole texts
    replaced by its kind; all other columns as they are, a null text stays null."""
    sent, at = docs.sparkSession.sparkContext.broadcast(models), docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        rows = extract(text) if text else []
        spans = [x[:3] for x in rows if x[3] == BASE] + select_spans(rows, sent.value)
        return redact(text, [(KINDS[k], a, b) for k, a, b in spans]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = pa.array([clean(t) for t in part.column(at).to_pylist()], pa.string())
                yield part.set_column(at, part.schema.field(at).with_type(pa.string()), texts)

    return docs.mapInArrow(run, docs.schema)


def listing(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(listing(spans).encode()).hexdigest()
