"""M1: corpus BLEU against a plain-Python restatement of the published formula."""

import math
import re
from collections import Counter

from corpusflow.operators.metrics import corpus_bleu


def tok13a(line):
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(a, b)
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


def py_bleu(pairs):
    correct, total = [0] * 4, [0] * 4
    sys_len = ref_len = 0
    for h, r in pairs:
        h, r = tok13a(h), tok13a(r)
        sys_len += len(h)
        ref_len += len(r)
        for n in range(1, 5):
            hc = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
            rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            correct[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            total[n - 1] += sum(hc.values())
    bp = 1.0 if sys_len >= ref_len else (math.exp(1 - ref_len / sys_len) if sys_len else 0.0)
    if not any(correct):
        return 0.0
    prec, smooth = [0.0] * 4, 1.0
    for n in range(4):
        if total[n] == 0:
            break
        if correct[n] == 0:
            smooth *= 2
            prec[n] = 100.0 / (smooth * total[n])
        else:
            prec[n] = 100.0 * correct[n] / total[n]
    return bp * math.exp(sum(-9999999999 if p == 0 else math.log(p) for p in prec) / 4)


CASES = [
    [("the cat sat on the mat.", "the cat sat on the mat."), ("a b c d", "a b c e")],
    [("It costs 3,5 euros - or 4-5.", "It costs 3,5 euros, or 4-5!"), ("x &amp; y", "x & y")],
    [("completely different", "nothing shared here at all")],
    [("one two three four five", "one two three four five six seven eight")],
    [("short", "short")],
]


def test_bleu_matches_python(spark):
    for case in CASES:
        df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(case)],
                                   "row_id long, pred string, ref string")
        got = corpus_bleu(df).collect()[0].bleu
        assert abs(got - py_bleu(case)) < 1e-9, case


def test_bleu_empty_is_null(spark):
    df = spark.createDataFrame([], "row_id long, pred string, ref string")
    assert corpus_bleu(df).collect()[0].bleu is None
