"""Scalar text functions: FIXTURES cases and all-code-point differentials."""

import unicodedata

from pyspark.sql import functions as F

from corpusflow.functions import patterns as P
from corpusflow.functions import text as X


def one(spark, col_fn, value):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(col_fn(F.col("t")).alias("o")).collect()[0]["o"]


# The characters that the rules keep besides white space, and the code
# points on which ICU's Unicode version and Python's may differ.
KEPT = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,!?'\"-()[];:")
BENGALI = {chr(c) for c in range(0x980, 0xA00)}
NEWER = {0xA7F1}


def expected(text, lang):
    """The rules of F1-F6 stated character by character: a link runs from "http" or
    "www" to the next white space, and needs a character of its own behind that."""
    text = unicodedata.normalize("NFKC", text)
    allowed = {"en": KEPT, "bn": KEPT | BENGALI}.get(lang)
    out, i = [], 0
    while i < len(text):
        lead = next((w for w in ("http", "www") if text.startswith(w, i)), None)
        if lead and not text[i + len(lead):i + len(lead) + 1].isspace() and i + len(lead) < len(text):
            while i < len(text) and not text[i].isspace():
                i += 1
            continue
        out.append(text[i] if allowed is None or text[i] in allowed else " ")
        i += 1
    return " ".join("".join(out).split())


def test_normalize_cases(spark):
    assert one(spark, X.normalize_text, None) == ""
    assert one(spark, X.normalize_text, "ﬁne ＡＢＣ１") == "fine ABC1"
    assert one(spark, X.normalize_text, "　x\u001c") == "x"


def test_normalize_python_engine(spark):
    df = spark.createDataFrame([("ﬁne ＡＢＣ１",), ("plain",), (None,)], "t string")
    out = df.select(X.nfkc("t", engine="python").alias("o")).collect()
    assert [r.o for r in out] == ["fine ABC1", "plain", None]


def test_strip_urls(spark):
    assert one(spark, X.strip_urls, "see httpd https://x.y/z?q=1 HTTP://U ok") == "see   HTTP://U ok"


def test_whitelists(spark):
    assert one(spark, lambda c: X.clean_characters(c, "en"), "don’t 5% é") == "don t 5"
    assert one(spark, lambda c: X.clean_characters(c, "bn"), "ভাষা।") == "ভাষা"
    assert one(spark, lambda c: X.clean_characters(c, "bn"), "ক‍খ") == "ক খ"
    assert one(spark, lambda c: X.clean_characters(c, "fr"), "naïve 5%") == "naïve 5%"


def test_count_numbers(spark):
    assert one(spark, X.count_numbers, "১২ a 3") == 2
    assert one(spark, X.count_numbers, "1.5") == 2
    assert one(spark, X.count_numbers, "abc") == 0


def test_whitespace_class_is_python(spark):
    ws = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert len(ws) == 29
    assert set(P.whitespace_codepoints()) == {ord(c) for c in ws}


def test_all_bmp_code_points_differential(spark):
    """Every BMP code point through normalise + clean (en, bn, other) equals the
    stated rules, alone, between letters, behind "http" and before a link."""
    cps = [c for c in range(0x20, 0x10000) if not 0xD800 <= c <= 0xDFFF and c not in NEWER]
    texts = [(c, f" a{chr(c)}b {chr(c)} http{chr(c)} x {chr(c)}wwwx ") for c in cps]
    df = spark.createDataFrame(texts, "i int, t string").repartition(8)
    given = dict(texts)
    for lang in ("en", "bn", None):
        out = df.select("i", X.clean_text("t", lang).alias("o")).collect()
        bad = {hex(r.i) for r in out if r.o != expected(given[r.i], lang)}
        assert bad == set(), lang
    spaces = df.select("i", X.collapse_ws("t").alias("o")).collect()
    assert all(r.o == " ".join(given[r.i].split()) for r in spaces)


def test_word_count_and_hash(spark):
    df = spark.createDataFrame([("a b  c",), ("",)], "t string")
    out = df.select(X.word_count(X.collapse_ws("t")).alias("w"),
                    X.text_hash(X.collapse_ws("t")).alias("h")).collect()
    assert [r.w for r in out] == [3, 0]
    import hashlib
    assert out[0].h == hashlib.md5("a b c".encode()).hexdigest()


def test_truncate_display(spark):
    long = "x" * 301
    assert one(spark, X.truncate_display, long) == "x" * 300 + "... [TRUNCATED]"
    assert one(spark, X.truncate_display, "x" * 300) == "x" * 300
