"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator
or job, and for each the DuckDB SQL that must give the same rows.

Every query reads the given tables whole (no id subsets, no row caps); a
``limit`` appears only where taking the first rows *is* the operator (K1, M2).
Output columns are aliased identically on both sides; arrays are rendered as
comma-joined strings so the value hash does not depend on list types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import dedup as D
from corpusflow.operators import filters as FL
from corpusflow.operators.langid import LabelColumnLid
from corpusflow.operators.pairs import (adjacent_line_pairs, conversation_pairs,
                                        pairs_from_translation, union_corpora)
from corpusflow.plans import oracle_sql as S
from corpusflow.plans.mono import clean_monolingual, clean_report_monolingual
from corpusflow.plans.parallel import REASONS, clean_parallel, clean_report_parallel
from corpusflow.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# Fixed values: "dirt" appended to test text so that rules with nothing to do on
# the clean tables are exercised (NFKC-stable, so DuckDB needs no NFKC).
DIRT = " ভাষা। don’t 5% é naïve‍x http://x.y/z?q=1 wwwq HTTP://U [ok] ১২ 3.5"
PAIR_DIRT = " ভাষা। don’t é naïve‍x http://x.y/z?q=1 wwwq HTTP://U [ok] 3.5"
NFKC_HEAD, NFKC_HEAD_NORM = "　ﬁne ", "fine "
NFKC_TAIL, NFKC_TAIL_NORM = " ＡＢＣ１\u001c", " ABC1"


# ---------------------------------------------------------------- C1 / D3 mono
@register("clean_mono", f"""
WITH c AS (SELECT doc_id, lang, source, n_chars, {S.clean('text', 'en')} AS text FROM documents),
p AS (SELECT *, md5(text) AS h FROM c WHERE length(text) >= 10),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1)
SELECT doc_id, text, lang, source, n_chars FROM f WHERE lang = 'en'
""")
def q_clean_mono(spark, sf):
    docs = table(spark, sf, "documents")
    return clean_monolingual(docs, "en", lid=LabelColumnLid("lang"), order_cols=["doc_id"])


@register("clean_report_mono", f"""
WITH c AS (SELECT doc_id, lang, {S.clean('text', 'en')} AS text FROM documents),
p AS (SELECT *, md5(text) AS h,
             row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn
        FROM c WHERE length(text) >= 10)
SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS total,
       CAST((SELECT count(*) FROM c WHERE length(text) < 10) AS BIGINT) AS short,
       CAST((SELECT count(*) FROM p WHERE rn > 1) AS BIGINT) AS dup,
       CAST((SELECT count(*) FROM p WHERE rn = 1 AND lang <> 'en') AS BIGINT) AS lang,
       CAST((SELECT count(*) FROM p WHERE rn = 1 AND lang = 'en') AS BIGINT) AS kept
""")
def q_clean_report_mono(spark, sf):
    docs = table(spark, sf, "documents")
    return clean_report_monolingual(docs, "en", lid=LabelColumnLid("lang"), order_cols=["doc_id"])


# ---------------------------------------------------------------- C2 / D3 pairs
def _pairs_sql(pairs: str, keys: str, whitelist: str | None = None) -> str:
    return f"""
WITH c AS (SELECT {keys}, {S.clean('src', whitelist)} AS s, {S.clean('tgt', whitelist)} AS t
             FROM {pairs}),
w AS (SELECT *, {S.words('s')} AS ws, {S.words('t')} AS wt FROM c),
ok AS (SELECT * FROM w
        WHERE s <> '' AND t <> '' AND ws BETWEEN 2 AND 150 AND wt BETWEEN 2 AND 150
          AND greatest(ws, wt) <= 3.0 * least(ws, wt)
          AND {S.digit_runs('s')} = {S.digit_runs('t')})
SELECT {keys}, s AS src, t AS tgt FROM ok
QUALIFY row_number() OVER (PARTITION BY md5(s || chr(9) || t) ORDER BY {keys}) = 1
"""


def _pairs_report_sql(pairs: str, keys: str) -> str:
    reasons = ", ".join(
        f"CAST(sum(CASE WHEN reason = '{r}' THEN 1 ELSE 0 END) AS BIGINT) AS {r}"
        for r in REASONS + ("kept",))
    return f"""
WITH c AS (SELECT {keys}, {S.clean('src', None)} AS s, {S.clean('tgt', None)} AS t FROM {pairs}),
w AS (SELECT *, {S.words('s')} AS ws, {S.words('t')} AS wt, md5(s || chr(9) || t) AS h FROM c),
r AS (SELECT *, CASE WHEN s = '' OR t = '' THEN 'empty'
                     WHEN NOT (ws BETWEEN 2 AND 150 AND wt BETWEEN 2 AND 150) THEN 'length'
                     WHEN greatest(ws, wt) > 3.0 * least(ws, wt) THEN 'ratio'
                     WHEN {S.digit_runs('s')} <> {S.digit_runs('t')} THEN 'numbers' END AS r0
        FROM w),
fa AS (SELECT h, min(({keys})) AS first_ok FROM r WHERE r0 IS NULL GROUP BY h),
x AS (SELECT CASE WHEN r0 = 'empty' THEN 'empty'
                  WHEN fa.first_ok IS NOT NULL AND ({keys}) > fa.first_ok THEN 'dup'
                  WHEN r0 IS NULL THEN 'kept' ELSE r0 END AS reason
        FROM r LEFT JOIN fa USING (h))
SELECT CAST(count(*) AS BIGINT) AS total, {reasons} FROM x
"""


def _flat(df: DataFrame, keys: list[str], src_lang: str, tgt_lang: str) -> DataFrame:
    return df.select(*keys, F.col(f"translation.{src_lang}").alias("src"),
                     F.col(f"translation.{tgt_lang}").alias("tgt"))


@register("clean_pairs", _pairs_sql(S.adjacent_pairs(), "doc_id, line_no"))
def q_clean_pairs(spark, sf):
    pairs = adjacent_line_pairs(table(spark, sf, "documents"), each=lambda line: X.clean_text(line, None))
    out = clean_parallel(pairs, "src", "tgt", whitelist=False, order_cols=["doc_id", "line_no"], cleaned=True)
    return _flat(out, ["doc_id", "line_no"], "src", "tgt")


@register("clean_report_pairs", _pairs_report_sql(S.adjacent_pairs(), "doc_id, line_no"))
def q_clean_report_pairs(spark, sf):
    pairs = adjacent_line_pairs(table(spark, sf, "documents"))
    return clean_report_parallel(pairs, "src", "tgt", whitelist=False,
                                 order_cols=["doc_id", "line_no"])


@register("clean_pairs_conv", _pairs_sql(S.conversation_pairs(), "conv_id, turn"))
def q_clean_pairs_conv(spark, sf):
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    out = clean_parallel(pairs, "src", "tgt", whitelist=False, order_cols=["conv_id", "turn"])
    return _flat(out, ["conv_id", "turn"], "src", "tgt")


@register("clean_report_conv", _pairs_report_sql(S.conversation_pairs(), "conv_id, turn"))
def q_clean_report_conv(spark, sf):
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    return clean_report_parallel(pairs, "src", "tgt", whitelist=False, order_cols=["conv_id", "turn"])


def _pairs_sql_langs(pairs: str, keys: str, src_lang: str, tgt_lang: str) -> str:
    return _pairs_sql(pairs, keys).replace(
        S.clean('src', None), S.clean('src', src_lang)).replace(
        S.clean('tgt', None), S.clean('tgt', tgt_lang))


@register("clean_pairs_whitelist",
          _pairs_sql_langs(f"(SELECT conv_id, turn, src || {S.q(PAIR_DIRT)} AS src, tgt || {S.q(PAIR_DIRT)} AS tgt "
                           f"FROM {S.conversation_pairs()})", "conv_id, turn", "en", "bn"))
def q_clean_pairs_whitelist(spark, sf):
    """C2 on the canonical ``translation`` struct with the English whitelist on
    the source and the Bengali one on the target."""
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    tr = pairs.select("conv_id", "turn", F.struct(
        F.concat("src", F.lit(PAIR_DIRT)).alias("en"),
        F.concat("tgt", F.lit(PAIR_DIRT)).alias("bn")).alias("translation"))
    out = clean_parallel(tr, "en", "bn", order_cols=["conv_id", "turn"])
    return out.select("conv_id", "turn", F.col("translation.en").alias("src"),
                      F.col("translation.bn").alias("tgt"))


# ---------------------------------------------------------------- scalar text functions
@register("normalize_text", f"""
SELECT doc_id, {S.strip(f"{S.q(NFKC_HEAD_NORM)} || coalesce(text, '') || {S.q(NFKC_TAIL_NORM)}")} AS text
  FROM documents
""")
def q_normalize_text(spark, sf):
    docs = table(spark, sf, "documents")
    dirty = F.concat(F.lit(NFKC_HEAD), F.coalesce("text", F.lit("")), F.lit(NFKC_TAIL))
    return docs.select("doc_id", X.normalize_text(dirty).alias("text"))


@register("strip_urls", f"""
SELECT page_id, regexp_replace('see ' || url || ' ' || html || {S.q(DIRT)}, {S.q(S.P.url_pattern())}, '', 'g') AS text
  FROM pages
""")
def q_strip_urls(spark, sf):
    pages = table(spark, sf, "pages")
    t = F.concat(F.lit("see "), "url", F.lit(" "), "html", F.lit(DIRT))
    return pages.select("page_id", X.strip_urls(t).alias("text"))


def _chars_sql(lang):
    return f"SELECT doc_id, {S.clean(f'text || {S.q(DIRT)}', lang)} AS text FROM documents"


def _chars_q(lang):
    def fn(spark, sf):
        docs = table(spark, sf, "documents")
        return docs.select("doc_id", X.clean_text(F.concat("text", F.lit(DIRT)), lang).alias("text"))
    return fn


register("clean_chars_en", _chars_sql("en"))(_chars_q("en"))
register("clean_chars_bn", _chars_sql("bn"))(_chars_q("bn"))
register("clean_chars_other", _chars_sql(None))(_chars_q("fr"))


@register("count_numbers", f"""
SELECT page_id, CAST({S.digit_runs(f"html || {S.q(DIRT)}")} AS BIGINT) AS n_numbers FROM pages
""")
def q_count_numbers(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", X.count_numbers(F.concat("html", F.lit(DIRT))).cast("long")
                        .alias("n_numbers"))


@register("word_count", f"""
SELECT doc_id, CAST({S.words(S.clean('text', None))} AS BIGINT) AS n_words,
       CAST(length({S.clean('text', None)}) AS BIGINT) AS n_chars_clean
  FROM documents
""")
def q_word_count(spark, sf):
    docs = table(spark, sf, "documents")
    c = X.clean_text("text", None)
    return docs.select("doc_id", c.alias("_c")).select(
        "doc_id", X.word_count("_c").cast("long").alias("n_words"),
        F.length("_c").cast("long").alias("n_chars_clean"))


@register("text_hash", f"""
SELECT doc_id, md5({S.clean('text', 'en')}) AS text_md5,
       md5(coalesce(text, '') || chr(9) || coalesce(source, '')) AS pair_md5
  FROM documents
""")
def q_text_hash(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", X.text_hash(X.clean_text("text", "en")).alias("text_md5"),
                       X.pair_hash(F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")))
                       .alias("pair_md5"))


# ---------------------------------------------------------------- filters P3-P5
def _pair_filter_sql(cond: str) -> str:
    return f"""
WITH c AS (SELECT doc_id, line_no, {S.clean('src', None)} AS s, {S.clean('tgt', None)} AS t
             FROM {S.adjacent_pairs()}),
w AS (SELECT *, {S.words('s')} AS ws, {S.words('t')} AS wt FROM c)
SELECT doc_id, line_no, CAST(ws AS BIGINT) AS src_words, CAST(wt AS BIGINT) AS tgt_words
  FROM w WHERE {cond}
"""


def _pair_filter_q(pred):
    def fn(spark, sf):
        pairs = adjacent_line_pairs(table(spark, sf, "documents"))
        c = pairs.select("doc_id", "line_no", X.clean_text("src", None).alias("s"),
                         X.clean_text("tgt", None).alias("t"))
        w = c.withColumn("ws", X.word_count("s")).withColumn("wt", X.word_count("t"))
        return w.where(pred()).select("doc_id", "line_no", F.col("ws").cast("long").alias("src_words"),
                                    F.col("wt").cast("long").alias("tgt_words"))
    return fn


register("pair_length_filter", _pair_filter_sql("ws BETWEEN 2 AND 150 AND wt BETWEEN 2 AND 150"))(
    _pair_filter_q(lambda: FL.pair_length_ok("ws", "wt")))
register("pair_ratio_filter", _pair_filter_sql(
    "least(ws, wt) > 0 AND greatest(ws, wt) <= 3.0 * least(ws, wt)"))(
    _pair_filter_q(lambda: FL.pair_ratio_ok("ws", "wt")))
register("pair_number_filter", _pair_filter_sql(f"{S.digit_runs('s')} = {S.digit_runs('t')}"))(
    _pair_filter_q(lambda: FL.pair_numbers_ok("s", "t")))
register("pair_nonempty_filter", _pair_filter_sql("s <> '' AND t <> ''"))(
    _pair_filter_q(lambda: FL.pair_nonempty("s", "t")))


# ---------------------------------------------------------------- dedup D1 / D2
@register("dedup_exact", """
SELECT doc_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1
""")
def q_dedup_exact(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text", "lang"])
    return D.dedup_exact(docs, "text", ["doc_id"]).select("doc_id", "lang")


@register("dedup_pairs", f"""
SELECT doc_id, line_no FROM {S.adjacent_pairs()}
QUALIFY row_number() OVER (PARTITION BY md5(src || chr(9) || tgt) ORDER BY doc_id, line_no) = 1
""")
def q_dedup_pairs(spark, sf):
    pairs = adjacent_line_pairs(table(spark, sf, "documents"))
    return D.dedup_pairs(pairs, "src", "tgt", ["doc_id", "line_no"]).select("doc_id", "line_no")


# ---------------------------------------------------------------- D4 / B6
@register("corpus_sizes", """
SELECT 'documents' AS corpus, lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang
UNION ALL
SELECT 'benchmark' AS corpus, 'en' AS lang, CAST(count(*) AS BIGINT) AS n FROM benchmark
""")
def q_corpus_sizes(spark, sf):
    docs = table(spark, sf, "documents", ["lang"])
    bench = table(spark, sf, "benchmark", ["item_id"])
    a = docs.groupBy("lang").agg(F.count(F.lit(1)).cast("long").alias("n")) \
            .select(F.lit("documents").alias("corpus"), "lang", "n")
    b = bench.agg(F.count(F.lit(1)).cast("long").alias("n")) \
             .select(F.lit("benchmark").alias("corpus"), F.lit("en").alias("lang"), "n")
    return a.unionByName(b)


@register("corpus_union", """
SELECT 0 AS corpus_no, 'en' AS lang, doc_id AS row_id, text FROM documents
UNION ALL
SELECT 1 AS corpus_no, 'xx' AS lang, item_id AS row_id, text FROM benchmark
""")
def q_corpus_union(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "row_id")
    bench = table(spark, sf, "benchmark").withColumnRenamed("item_id", "row_id")
    return union_corpora([("en", docs), ("xx", bench)])


# ---------------------------------------------------------------- B1 / B3
@register("pairs_from_struct", f"""
SELECT conv_id, turn, coalesce(src, '') AS en, coalesce(tgt, '') AS bn, true AS valid
  FROM {S.conversation_pairs()}
""")
def q_pairs_from_struct(spark, sf):
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    tr = pairs.select("conv_id", "turn", F.struct(F.col("src").alias("en"),
                                                  F.col("tgt").alias("bn")).alias("translation"))
    return pairs_from_translation(tr, "en", "bn")


@register("pairs_from_flat", f"""
SELECT conv_id, turn, coalesce(src, '') AS en, coalesce(tgt, '') AS bn, true AS valid
  FROM {S.conversation_pairs()}
""")
def q_pairs_from_flat(spark, sf):
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    return pairs_from_translation(pairs, "en", "bn")


@register("pairs_null_sides", f"""
SELECT conv_id, turn,
       CASE WHEN instr(src, '?') > 0 THEN '' ELSE src END AS en,
       CASE WHEN instr(tgt, ',') > 0 THEN '' ELSE tgt END AS bn,
       true AS valid
  FROM {S.conversation_pairs()}
""")
def q_pairs_null_sides(spark, sf):
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    tr = pairs.select("conv_id", "turn", F.struct(
        F.when(F.instr("src", "?") > 0, F.lit(None)).otherwise(F.col("src")).alias("en"),
        F.when(F.instr("tgt", ",") > 0, F.lit(None)).otherwise(F.col("tgt")).alias("bn"))
        .alias("translation"))
    return pairs_from_translation(tr, "en", "bn")


# ---------------------------------------------------------------- L1-L3 language ID
_LID_TRAIN_SQL = "SELECT lang, text FROM documents"
_LID_MODEL = {}


def _lid(spark, sf):
    """Trigram model trained on the whole ``documents`` table (label = ``lang``);
    cached per (session, table dir) so several queries share one training job."""
    from corpusflow.operators.langid import train_trigram_lid
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LID_MODEL:
        _LID_MODEL.clear()
        _LID_MODEL[key] = train_trigram_lid(table(spark, sf, "documents", ["text", "lang"]))
    return _LID_MODEL[key]


@register("lid_predict", f"""
WITH {S.lid_model_ctes(_LID_TRAIN_SQL)},
{S.lid_score_ctes('p', 'SELECT doc_id, text FROM documents', 'doc_id')}
SELECT doc_id, label, round(score, 4) AS score FROM p
""")
def q_lid_predict(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    sc = _lid(spark, sf).scores(docs, "text", ["doc_id"], prefix="p")
    return sc.select("doc_id", F.col("p_label").alias("label"), F.round("p_score", 4).alias("score"))


@register("lid_predict_conv", f"""
WITH {S.lid_model_ctes(_LID_TRAIN_SQL)},
{S.lid_score_ctes('p', "SELECT conv_id * 4294967296 + turn AS k, text FROM conversations", 'k')}
SELECT k // 4294967296 AS conv_id, k % 4294967296 AS turn, label, round(score, 4) AS score FROM p
""")
def q_lid_predict_conv(spark, sf):
    conv = table(spark, sf, "conversations", ["conv_id", "turn", "text"])
    sc = _lid(spark, sf).scores(conv, "text", ["conv_id", "turn"], prefix="p")
    return sc.select("conv_id", "turn", F.col("p_label").alias("label"),
                     F.round("p_score", 4).alias("score"))


@register("lid_accuracy", f"""
WITH {S.lid_model_ctes("SELECT lang, text FROM documents WHERE doc_id % 2 = 1")},
{S.lid_score_ctes('p', 'SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0', 'doc_id')}
SELECT d.lang, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN p.label = d.lang THEN 1 ELSE 0 END) AS BIGINT) AS correct
  FROM documents d JOIN p USING (doc_id) GROUP BY d.lang
""")
def q_lid_accuracy(spark, sf):
    """Accuracy on the documents that the model wasn't trained on."""
    from corpusflow.operators.langid import train_trigram_lid
    docs = table(spark, sf, "documents", ["doc_id", "text", "lang"])
    model = train_trigram_lid(docs.where("doc_id % 2 = 1").select("text", "lang"))
    sc = model.annotate(docs.where("doc_id % 2 = 0"), "text", ["doc_id"], prefix="p")
    return sc.groupBy("lang").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sum(F.when(F.col("p_label") == F.col("lang"), 1).otherwise(0)).cast("long").alias("correct"))


@register("lid_strict", f"""
WITH {S.lid_model_ctes(_LID_TRAIN_SQL)},
{S.lid_score_ctes('p', 'SELECT doc_id, text FROM documents', 'doc_id')}
SELECT doc_id FROM p WHERE label = 'en' AND score >= 0.5
""")
def q_lid_strict(spark, sf):
    from corpusflow.operators.langid import strict_keep
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    sc = _lid(spark, sf).scores(docs, "text", ["doc_id"], prefix="p")
    return sc.where(strict_keep("p_label", "p_score", "en")).select("doc_id")


@register("lid_lenient", f"""
WITH {S.lid_model_ctes(_LID_TRAIN_SQL)},
_pairs AS (SELECT doc_id * 4294967296 + line_no AS k, src, tgt FROM {S.adjacent_pairs()}),
{S.lid_score_ctes('ps', 'SELECT k, src AS text FROM _pairs', 'k')},
{S.lid_score_ctes('pt', 'SELECT k, tgt AS text FROM _pairs', 'k')}
SELECT k // 4294967296 AS doc_id, k % 4294967296 AS line_no FROM ps JOIN pt USING (k)
 WHERE NOT (ps.score > 0.5 AND ps.label <> 'en') AND NOT (pt.score > 0.5 AND pt.label <> 'en')
""")
def q_lid_lenient(spark, sf):
    from corpusflow.operators.langid import lenient_reject
    pairs = adjacent_line_pairs(table(spark, sf, "documents"))
    lid = _lid(spark, sf)
    j = lid.annotate_all(pairs.select("doc_id", "line_no", "src", "tgt"), {"s": "src", "t": "tgt"}, ["doc_id", "line_no"])
    return j.where(~lenient_reject("s_label", "s_score", "en")
                   & ~lenient_reject("t_label", "t_score", "en")).select("doc_id", "line_no")


@register("clean_mono_lid", f"""
WITH {S.lid_model_ctes(_LID_TRAIN_SQL)},
c AS (SELECT doc_id, lang, source, n_chars, {S.clean('text', 'en')} AS text FROM documents),
f AS (SELECT * FROM c WHERE length(text) >= 10
      QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1),
{S.lid_score_ctes('p', 'SELECT doc_id, text FROM f', 'doc_id')}
SELECT doc_id, text, lang, source, n_chars FROM f JOIN p USING (doc_id)
 WHERE p.label = 'en' AND p.score >= 0.5
""")
def q_clean_mono_lid(spark, sf):
    """C1 with the trigram model as language identifier (strict rule)."""
    docs = table(spark, sf, "documents")
    return clean_monolingual(docs, "en", lid=_lid(spark, sf), order_cols=["doc_id"])


@register("clean_pairs_lid", f"""
WITH {S.lid_model_ctes(_LID_TRAIN_SQL)},
ok AS ({_pairs_sql(S.adjacent_pairs(), "doc_id, line_no")}),
k AS (SELECT doc_id * 4294967296 + line_no AS k, src, tgt FROM ok),
{S.lid_score_ctes('ps', 'SELECT k, src AS text FROM k', 'k')},
{S.lid_score_ctes('pt', 'SELECT k, tgt AS text FROM k', 'k')}
SELECT k // 4294967296 AS doc_id, k % 4294967296 AS line_no, src, tgt
  FROM k JOIN ps USING (k) JOIN pt USING (k)
 WHERE NOT (ps.score > 0.5 AND ps.label <> 'en') AND NOT (pt.score > 0.5 AND pt.label <> 'en')
""")
def q_clean_pairs_lid(spark, sf):
    """C2 over adjacent lines with the lenient rule, expecting English on both sides."""
    pairs = adjacent_line_pairs(table(spark, sf, "documents"))
    pairs = pairs.withColumnRenamed("src", "en").withColumnRenamed("tgt", "en2")
    out = clean_parallel(pairs, "en", "en2", lid=_lid(spark, sf), whitelist=False,
                         order_cols=["doc_id", "line_no"], expect=("en", "en"))
    return out.select("doc_id", "line_no", F.col("translation.en").alias("src"),
                      F.col("translation.en2").alias("tgt"))


# ---------------------------------------------------------------- K1-K3 sampling
@register("head_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def q_head_n(spark, sf):
    from corpusflow.operators.sample import head_n
    return head_n(table(spark, sf, "documents", ["doc_id", "lang"]), 100, ["doc_id"])


@register("head_n_selected", "SELECT doc_id, lang FROM documents ORDER BY lang, doc_id LIMIT 700")
def q_head_n_selected(spark, sf):
    """K1 beyond what one task gathers: the 700th key is selected, rows up to it stay."""
    from corpusflow.operators.sample import head_n
    return head_n(table(spark, sf, "documents", ["doc_id", "lang"]), 700, ["lang", "doc_id"], gathered=100)


@register("corpus_counts_observed", f"""
SELECT CAST(count(*) AS BIGINT) AS before,
       (SELECT CAST(count(DISTINCT text) AS BIGINT) FROM (SELECT {S.clean('text', 'en')} AS text FROM documents)
         WHERE length(text) >= 10) AS after
  FROM documents
""")
def q_corpus_counts_observed(spark, sf):
    """C1 from snapshot to snapshot, rows before and after observed on the write."""
    from corpusflow.plans.mono import clean_snapshot
    from corpusflow.session import shared_dir
    n = clean_snapshot(spark, f"{sf}/documents.parquet", shared_dir(spark, "clean"), "en", order_cols=["doc_id"])
    return spark.createDataFrame([(n["before"], n["after"])], "before long, after long")


_SPLIT_H = "('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 15))::UBIGINT"


@register("train_val_split", f"""
WITH h AS (SELECT doc_id, {_SPLIT_H} AS hv FROM documents)
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY hv, doc_id)
                         <= (SELECT ceil(count(*) * 0.01) FROM documents)
                    THEN 'validation' ELSE 'train' END AS split
  FROM h
""")
def q_train_val_split(spark, sf):
    from corpusflow.operators.sample import train_val_split
    docs = table(spark, sf, "documents", ["doc_id"])
    return train_val_split(docs, 0.01, 42, row_id="doc_id").select("doc_id", "split")


@register("train_val_split_approx", f"""
SELECT doc_id, CASE WHEN {_SPLIT_H} < CAST(0.1 * 1152921504606846976 AS UBIGINT)
                    THEN 'validation' ELSE 'train' END AS split
  FROM documents
""")
def q_train_val_split_approx(spark, sf):
    from corpusflow.operators.sample import train_val_split
    docs = table(spark, sf, "documents", ["doc_id"])
    return train_val_split(docs, 0.1, 42, row_id="doc_id", exact=False).select("doc_id", "split")


# ---------------------------------------------------------------- M2 / M3 inspection
@register("inspect_sample", """
WITH s AS (SELECT row_number() OVER (ORDER BY doc_id) AS sample_no, CAST(doc_id AS VARCHAR) AS doc_id,
                  text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars
             FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 3)),
u AS (UNPIVOT s ON doc_id, text, lang, source, n_chars INTO NAME field VALUE value)
SELECT 'documents' AS dataset, (SELECT CAST(count(*) AS BIGINT) FROM documents) AS total,
       sample_no, field,
       CASE WHEN length(value) > 300 THEN substr(value, 1, 300) || '... [TRUNCATED]' ELSE value END AS value
  FROM u
""")
def q_inspect_sample(spark, sf):
    from corpusflow.operators.inspect import inspect_sample
    return inspect_sample(table(spark, sf, "documents"), "documents", 3, ["doc_id"])


@register("raw_vs_clean", f"""
SELECT 'documents_en' AS corpus, CAST((SELECT count(*) FROM documents) AS BIGINT) AS raw_rows,
       CAST((SELECT count(*) FROM ({ORACLES['clean_mono']})) AS BIGINT) AS clean_rows
UNION ALL
SELECT 'adjacent_lines', CAST((SELECT count(*) FROM {S.adjacent_pairs()}) AS BIGINT),
       CAST((SELECT count(*) FROM ({ORACLES['clean_pairs']})) AS BIGINT)
UNION ALL
SELECT 'conversations', CAST((SELECT count(*) FROM {S.conversation_pairs()}) AS BIGINT),
       CAST((SELECT count(*) FROM ({ORACLES['clean_pairs_conv']})) AS BIGINT)
""")
def q_raw_vs_clean(spark, sf):
    from corpusflow.operators.inspect import raw_vs_clean
    docs = table(spark, sf, "documents")
    adj = adjacent_line_pairs(docs)
    conv = conversation_pairs(table(spark, sf, "conversations"))
    mono = clean_monolingual(table(spark, sf, "documents", ["doc_id", "lang", "text"]), "en", lid=LabelColumnLid("lang"),
                             order_cols=["doc_id"], keep_text=False)
    return raw_vs_clean([
        ("documents_en", docs, mono),
        ("adjacent_lines", adj, q_clean_pairs(spark, sf)),
        ("conversations", conv, q_clean_pairs_conv(spark, sf)),
    ]).select("corpus", "raw_rows", "clean_rows")


# ---------------------------------------------------------------- S2-S5 ingest
@register("ingest_mono", """
SELECT doc_id AS row_id, doc_id, text, lang, source, n_chars FROM documents
""")
def q_ingest_mono(spark, sf):
    """S3 + S2 + S1: ingest ``documents`` to a snapshot in the shared folder and read it back."""
    from corpusflow.session import shared_dir
    from corpusflow.sources.ingest import ingest
    from corpusflow.sources.readers import read_snapshot
    path = ingest(spark, f"{sf}/documents.parquet", "corpus/documents", "sf", "train",
                  output_dir=shared_dir(spark, "ingest"), id_col="doc_id")
    return read_snapshot(spark, path).select("row_id", "doc_id", "text", "lang", "source", "n_chars")


@register("ingest_stream", """
SELECT doc_id AS row_id, doc_id, text, lang FROM documents
""")
def q_ingest_stream(spark, sf):
    """The same source through Structured Streaming (AvailableNow) into a Parquet sink."""
    from corpusflow.sources.readers import read_snapshot
    from corpusflow.streaming.ingest import stream_ingest
    src = f"{sf}/documents.parquet"
    schema = spark.read.parquet(src).schema
    sink = stream_ingest(spark, src, schema, id_col="doc_id", timeout_s=600)
    return read_snapshot(spark, sink).select("row_id", "doc_id", "text", "lang")


def _stream_in_four(spark, sf, columns, **options):
    """``documents`` arrive in four portions, in order of ``doc_id``; the ingest is
    started again on the same sink and checkpoint after each. Returns the sink."""
    from corpusflow.session import shared_dir
    from corpusflow.streaming.ingest import stream_ingest
    source, sink, checkpoint = (shared_dir(spark, f"stream-{x}") for x in ("source", "sink", "ckpt"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*columns)
    cuts = [-(1 << 62), *docs.approxQuantile("doc_id", [0.25, 0.5, 0.75], 0.01), 1 << 62]
    for lo, hi in zip(cuts, cuts[1:]):
        part = docs.where((F.col("doc_id") >= lo) & (F.col("doc_id") < hi)).repartitionByRange("doc_id")
        part.sortWithinPartitions("doc_id").write.mode("append").parquet(source)
        stream_ingest(spark, source, docs.schema, sink=sink, checkpoint=checkpoint, timeout_s=600, **options)
    return sink


@register("ingest_stream_batches", """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, lang FROM documents
""")
def q_ingest_stream_batches(spark, sf):
    """S4 without a key: numbers go on from batch to batch by the ledger."""
    sink = _stream_in_four(spark, sf, ["doc_id", "lang"])
    return spark.read.parquet(f"{sink}/batch=*").select("row_id", "doc_id", "lang")


@register("ingest_stream_dedup", """
SELECT doc_id, lang, md5(text) AS text_md5 FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
""")
def q_ingest_stream_dedup(spark, sf):
    """S4 + D1 over four runs; the first row of every text stays."""
    from corpusflow.sources.readers import read_snapshot
    sink = _stream_in_four(spark, sf, ["doc_id", "lang", "text"], id_col="doc_id", dedup_col="text")
    return read_snapshot(spark, sink).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@register("ingest_split_tree", """
SELECT doc_id, 'odd' AS split, n_chars FROM documents WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, 'even', n_chars + 1 FROM documents WHERE doc_id % 2 = 0
""")
def q_ingest_split_tree(spark, sf):
    """Two splits in one tree; one of them is ingested again and replaced."""
    from corpusflow.session import shared_dir
    from corpusflow.sources.readers import read_split, write_split
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    root = shared_dir(spark, "split-tree")
    for split, rest, add in (("odd", 1, 0), ("even", 0, 0), ("even", 0, 1)):
        write_split(docs.where(f"doc_id % 2 = {rest}").withColumn("n_chars", F.col("n_chars") + add), root, "corpus/documents", "sf", split)
    return read_split(spark, root, "corpus/documents").select("doc_id", "split", "n_chars")


@register("ingest_pairs", f"""
SELECT conv_id * 4294967296 + turn AS row_id, conv_id, turn, src AS en, tgt AS bn
  FROM {S.conversation_pairs()}
""")
def q_ingest_pairs(spark, sf):
    """A parallel source (``translation`` struct) ingested with its layout checked."""
    from corpusflow.session import shared_dir
    from corpusflow.sources.ingest import ingest_parallel
    from corpusflow.sources.readers import read_snapshot, write_snapshot
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    staged = write_snapshot(
        pairs.select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("row_id"), "conv_id", "turn",
                     F.struct(F.col("src").alias("en"), F.col("tgt").alias("bn")).alias("translation")),
        shared_dir(spark, "staged-pairs"))
    path = ingest_parallel(spark, staged, "corpus/conversations", "sf",
                           output_dir=shared_dir(spark, "ingest"))
    return read_snapshot(spark, path).select("row_id", "conv_id", "turn", F.col("translation.en").alias("en"),
                                             F.col("translation.bn").alias("bn"))


# ---------------------------------------------------------------- B2 shard expansion
# Junk lines appended to every generated shard (each must be dropped).
SHARD_JUNK = ["", "   ", "not json", "[1]", '{"en":"a"}', '{"en":null,"bn":"b"}',
              "{'en':'a','bn':'b'}", '{"en":"a","bn":"b"} junk', '{"en":"a","bn":"b"} junk}',
              '{"en":"a","bn":"b"}}', '{"en":"a","bn":"b"},{"x":1}', '{"en":"a","bn":"b"} {"en":"c","bn":"d"}',
              '{"en":"a","bn":"b"]}', '{"en":"a","bn":"b"}]}', '{"en":"a","bn":"b"}] [{}']


def build_shards(docs: DataFrame) -> DataFrame:
    """One packed shard per document: every line as ``{"en": line, "bn": "[line]"}``,
    then the junk lines, a line with an invalid UTF-8 byte inside a string, and
    two objects separated by U+2028. Columns ``__key__, __url__, jsonl`` (binary)."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    objs = F.transform(lines, lambda l: F.to_json(F.struct(l.alias("en"),
                                                           F.concat(F.lit("["), l, F.lit("]")).alias("bn"))))
    junk = F.array(*[F.lit(j) for j in SHARD_JUNK])
    head = F.concat_ws("\n", F.concat(objs, junk))
    blob = F.concat(F.encode(F.concat(head, F.lit('\n{"en":"bad')), "UTF-8"), F.unhex(F.lit("FF")),
                    F.encode(F.lit('","bn":"b"}\n{"en":"p","bn":"q"} {"en":"r","bn":"s"}'), "UTF-8"))
    return docs.select(F.col("doc_id").cast("string").alias("__key__"),
                       F.col("source").alias("__url__"), blob.alias("jsonl"))


@register("expand_jsonl", f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS k, source AS u,
                  string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
docl AS (SELECT k, u, CAST(i - 1 AS BIGINT) AS line_no, ls[i] AS en, '[' || ls[i] || ']' AS bn
           FROM d, LATERAL (SELECT unnest(range(1, len(d.ls) + 1)) AS i) r),
extra AS (SELECT k, u, CAST(len(ls) + {len(SHARD_JUNK)} + e.o AS BIGINT) AS line_no, e.en, e.bn
            FROM d, (VALUES (0, 'bad' || chr(65533), 'b'), (1, 'p', 'q'), (2, 'r', 's')) e(o, en, bn))
SELECT k AS __key__, u AS __url__, line_no, en, bn FROM docl
UNION ALL
SELECT k, u, line_no, en, bn FROM extra
""")
def q_expand_jsonl(spark, sf):
    from corpusflow.sources.shards import expand_jsonl
    shards = build_shards(table(spark, sf, "documents", ["doc_id", "text", "source"]))
    out = expand_jsonl(shards, "en", "bn")
    return out.select("__key__", "__url__", "line_no", F.col("translation.en").alias("en"),
                      F.col("translation.bn").alias("bn"))


# ---------------------------------------------------------------- T2-T10 tokenizer
_BPE_MODELS = {}
BPE_VOCAB = 400
#: The reference's setting, for the queries that train and report the whole vocabulary.
WHOLE_VOCAB = 32_000


def _bpe(spark, sf, vocab_size=BPE_VOCAB):
    """BPE vocabulary of the whole ``documents`` table, shared by the queries."""
    from corpusflow.operators.bpe import train_bpe
    key = (spark.sparkContext.applicationId, sf, vocab_size)
    if key not in _BPE_MODELS:
        _BPE_MODELS[key] = train_bpe(table(spark, sf, "documents", ["text"]), vocab_size=vocab_size)
    return _BPE_MODELS[key]


@register("pretokenize", f"""
SELECT doc_id, CAST(len({S.pretokenize('text')}) AS BIGINT) AS n_words,
       array_to_string({S.pretokenize('text')}, ' ') AS words
  FROM documents
""")
def q_pretokenize(spark, sf):
    from corpusflow.operators.bpe import pretokenize
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    w = docs.select("doc_id", pretokenize("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"),
                    F.array_join("w", " ").alias("words"))


@register("word_counts", f"""
SELECT word, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT unnest({S.pretokenize('text')}) AS word FROM documents) GROUP BY word
""")
def q_word_counts(spark, sf):
    from corpusflow.operators.bpe import word_counts
    wc = word_counts(table(spark, sf, "documents", ["text"]))
    return wc.select("word", F.col("count").cast("long").alias("n"))


@register("bpe_pair_counts", f"""
WITH wc AS (SELECT word, count(*) AS c
              FROM (SELECT unnest({S.pretokenize('text')}) AS word FROM documents) GROUP BY word),
ch AS (SELECT string_split(word, '') AS s, c FROM wc)
SELECT s[i] AS "left", s[i + 1] AS "right", CAST(sum(c) AS BIGINT) AS n
  FROM ch, LATERAL (SELECT unnest(range(1, len(ch.s))) AS i) r
 GROUP BY s[i], s[i + 1]
""")
def q_bpe_pair_counts(spark, sf):
    from corpusflow.operators.bpe import char_pair_counts, word_counts
    pc = char_pair_counts(word_counts(table(spark, sf, "documents", ["text"])))
    return pc.select("left", "right", F.col("count").cast("long").alias("n"))


def _byte_alphabet_sql() -> str:
    from corpusflow.operators.bpe import byte_alphabet
    return ", ".join(f"(chr({ord(c)}))" for c in byte_alphabet())


def _alphabet_sql() -> str:
    return f"""
WITH ch AS (SELECT DISTINCT unnest(string_split(word, '')) AS token
              FROM (SELECT unnest({S.pretokenize('text')}) AS word FROM documents)
             WHERE word <> ''),
a AS (SELECT token FROM ch UNION SELECT token FROM (VALUES {_byte_alphabet_sql()}) v(token)),
sp AS (SELECT * FROM (VALUES (0, '[UNK]'), (1, '[CLS]'), (2, '[SEP]'), (3, '[PAD]'), (4, '[MASK]')) v(id, token))
SELECT id, token FROM sp
UNION ALL
SELECT CAST(4 + row_number() OVER (ORDER BY token) AS INTEGER) AS id, token FROM a"""


@register("bpe_alphabet", f"SELECT CAST(id AS BIGINT) AS id, token FROM ({_alphabet_sql()})")
def q_bpe_alphabet(spark, sf):
    """T6 + initial alphabet: a BPE model with no merges is exactly its alphabet."""
    m = _bpe(spark, sf, vocab_size=0)
    return m.vocab_df(spark).select(F.col("id").cast("long").alias("id"), "token")


def _bpe_sql(*extra: str) -> str:
    return f"WITH RECURSIVE {S.bpe_ctes(_alphabet_sql(), BPE_VOCAB, extra)}"


def _whole_bpe_sql() -> str:
    return f"WITH RECURSIVE {S.bpe_ctes_by_key(_alphabet_sql(), WHOLE_VOCAB)}"


_DOC_IDS = S.encoded("e", "doc_id", "SELECT doc_id, text FROM documents")


@register("bpe_merges", f"""{_whole_bpe_sql()}
SELECT CAST(step - 1 AS INTEGER) AS rank, a.token AS "left", b.token AS "right", nid AS new_id
  FROM merge JOIN tok a ON a.id = l JOIN tok b ON b.id = r
""")
def q_bpe_merges(spark, sf):
    """T5: merges (exact training, vocabulary 32,000), in order."""
    return _bpe(spark, sf, WHOLE_VOCAB).merges_df(spark)


@register("bpe_vocab", f"{_bpe_sql()} SELECT id, token, id < 5 AS special FROM tok")
def q_bpe_vocab(spark, sf):
    return _bpe(spark, sf).vocab_df(spark).select("id", "token", "special")


def _encode_sql() -> str:
    return f"""
WITH alpha AS ({_alphabet_sql()}),
w AS (SELECT doc_id, {S.pretokenize('text')} AS ws FROM documents),
wc AS (SELECT doc_id, wi, string_split(ws[wi], '') AS cs
         FROM w, LATERAL (SELECT unnest(range(1, len(w.ws) + 1)) AS wi) r),
c AS (SELECT doc_id, wi, ci, cs[ci] AS token
        FROM wc, LATERAL (SELECT unnest(range(1, len(wc.cs) + 1)) AS ci) r),
e AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY wi, ci) AS ids, count(*) AS n
        FROM c JOIN alpha USING (token) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(e.n, 0) AS BIGINT) AS n_tokens, coalesce(e.ids, '') AS ids
  FROM documents d LEFT JOIN e USING (doc_id)"""


@register("encode_chars", _encode_sql())
def q_encode_chars(spark, sf):
    """T8 through the distributed path (distinct words -> segment -> join back
    -> ordered reassembly) with the no-merge model, so SQL can check it."""
    from corpusflow.operators.bpe import encode
    m = _bpe(spark, sf, vocab_size=0)
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    e = encode(docs, "text", m, ["doc_id"])
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.array_join("ids", ",").alias("ids"))


@register("encode_corpus", f"""{_bpe_sql()}, {_DOC_IDS}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, array_to_string(ids, ',') AS ids FROM e
""")
def q_encode_corpus(spark, sf):
    """T8 with the trained vocabulary."""
    from corpusflow.operators.bpe import encode
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    e = encode(docs, "text", _bpe(spark, sf), ["doc_id"])
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.array_join("ids", ",").alias("ids"))


# Byte symbols from U+00A1 on are single bytes that are no UTF-8 by themselves; a token
# with any other character stands for its own UTF-8.
@register("decode_ids", f"""{_bpe_sql()}, {_DOC_IDS},
d AS (SELECT id, CASE WHEN id < 5 THEN '' WHEN regexp_matches(token, '[^!-~\u00a1-\u00ac\u00ae-\u00ff]') THEN token
                      ELSE regexp_replace(token, '[\u00a1-\u00ac\u00ae-\u00ff]', chr(65533), 'g') END AS t FROM tok),
m AS (SELECT list(t ORDER BY id) AS t FROM d)
SELECT doc_id, array_to_string(list_transform(ids, lambda i: m.t[i + 1]), '') AS text FROM e, m
""")
def q_decode_ids(spark, sf):
    """Round trip of every document through encode and byte-level decode."""
    from corpusflow.operators.bpe import decode, encode
    m = _bpe(spark, sf)
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    return decode(encode(docs, "text", m, ["doc_id"]), "ids", m, ["doc_id"])


@register("tokenizer_report", f"""{_whole_bpe_sql()}, {_DOC_IDS},
x AS (SELECT lang, len({S.pretokenize('text')}) AS w, len(ids) AS t, len(list_filter(ids, lambda i: i = 0)) AS u
        FROM documents JOIN e USING (doc_id))
SELECT lang, CAST(count(*) AS BIGINT) AS "rows", CAST(sum(w) AS BIGINT) AS words, CAST(sum(t) AS BIGINT) AS tokens,
       CAST(sum(u) AS BIGINT) AS unknown, round(sum(t) / nullif(sum(w), 0), 4) AS tokens_per_word,
       round(sum(u) / nullif(sum(t), 0), 6) AS unknown_rate
  FROM x GROUP BY lang
""")
def q_tokenizer_report(spark, sf):
    """Tokens per word and unknown rate per language over all documents."""
    from corpusflow.operators.bpe import tokenizer_report
    docs = table(spark, sf, "documents", ["doc_id", "text", "lang"])
    return tokenizer_report(docs, "text", _bpe(spark, sf, WHOLE_VOCAB), ["doc_id"], "lang")


# ---------------------------------------------------------------- E1-E7 examples
def _len_ids(col="text") -> Column:
    """Id arrays derived from table data (word lengths + 5), so the array
    operators are checked independently of the tokenizer."""
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(F.split(F.coalesce(c, F.lit("")), " "), lambda w: F.length(w) + 5)


def _len_ids_sql(x: str = "text") -> str:
    return f"list_transform(string_split(coalesce({x}, ''), ' '), lambda w: CAST(length(w) + 5 AS INTEGER))"


def _pad_sql(x: str, value: int, n: int = 128) -> str:
    return (f"list_concat({x}, list_transform(range(greatest({n} - len({x}), 0)), lambda i: {value}))[1:{n}]")


def _ones_sql(k: str, n: int = 128) -> str:
    return (f"list_concat(list_transform(range(least({k}, {n})), lambda i: 1), "
            f"list_transform(range({n} - least({k}, {n})), lambda i: 0))")


@register("truncate_eos", f"""
SELECT doc_id, array_to_string(list_concat(({_len_ids_sql()})[1:127], [2]), ',') AS ids FROM documents
""")
def q_truncate_eos(spark, sf):
    from corpusflow.operators.examples import truncate_eos
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.array_join(truncate_eos(_len_ids(), 2), ",").alias("ids"))


#: The padding query pads every example to the next multiple of the one, and to the fixed
#: length of the other; a longer example stays whole, and makes no other one longer.
PAD_MULTIPLE, PAD_TO = 128, 32768


@register("pad_ids", f"""
WITH e AS (SELECT doc_id, {_len_ids_sql()} AS ids FROM documents),
n AS (SELECT doc_id, ids, greatest(1, (len(ids) + {PAD_MULTIPLE - 1}) // {PAD_MULTIPLE}) * {PAD_MULTIPLE} AS n,
             list_concat(ids, list_transform(range(greatest({PAD_TO} - len(ids), 0)), lambda i: 3)) AS p FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n,
       array_to_string(list_concat(ids, list_transform(range(n - len(ids)), lambda i: 3)), ',') AS ids,
       CAST(n - len(ids) AS BIGINT) AS n_pad, CAST(len(p) AS BIGINT) AS n_fixed,
       CAST(len(list_filter(p, lambda x: x = 3)) AS BIGINT) AS n_pad_fixed FROM n
""")
def q_pad_ids(spark, sf):
    """E3 on whole texts: each row padded to the next multiple of 128, and to a fixed length."""
    from corpusflow.operators.examples import pad_ids, pad_to_multiple
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    p = docs.select("doc_id", pad_to_multiple(_len_ids(), 3, PAD_MULTIPLE).alias("p"),
                    pad_ids(_len_ids(), 3, PAD_TO, cut=False).alias("f"))
    pads = lambda c: F.size(F.filter(c, lambda x: x == 3)).cast("long")
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.array_join("p", ",").alias("ids"), pads("p").alias("n_pad"),
                    F.size("f").cast("long").alias("n_fixed"), pads("f").alias("n_pad_fixed"))


def _u_sql(row: str, pos: str, seed: int = 42, epoch: int = 0) -> str:
    return (f"(('0x' || substr(md5('{seed}:{epoch}:' || CAST({row} AS VARCHAR) || ':' || CAST({pos} AS VARCHAR)), 1, 8))"
            f"::UBIGINT / 4294967296.0)")


@register("denoise_examples", f"""
WITH t AS (SELECT doc_id, ({_len_ids_sql()})[1:127] AS t FROM documents),
n AS (SELECT doc_id, t, list_transform(t, lambda x, i: CASE WHEN {_u_sql('doc_id', 'i - 1')} < 0.15
                                                       THEN 4 ELSE x END) AS noisy FROM t)
SELECT doc_id,
       array_to_string({_pad_sql("list_concat(noisy, [2])", 3)}, ',') AS input_ids,
       array_to_string({_pad_sql("list_concat(t, [2])", 3)}, ',') AS labels,
       array_to_string({_ones_sql("len(t)")}, ',') AS attention_mask
  FROM n
""")
def q_denoise_examples(spark, sf):
    """C4 tail: masking (seed 42, epoch 0), EOS, padding, mask without EOS."""
    from corpusflow.operators.examples import denoising_examples
    docs = table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", _len_ids().alias("ids"))
    ex = denoising_examples(docs, "ids", "doc_id", eos_id=2, pad_id=3, mask_id=4)
    return ex.select("doc_id", *[F.array_join(c, ",").alias(c)
                                 for c in ("input_ids", "labels", "attention_mask")])


@register("translation_examples", f"""
WITH p AS (SELECT conv_id, turn, {_len_ids_sql(f"{S.q('translate English to Bengali: ')} || src")} AS s,
                  {_len_ids_sql('tgt')} AS t FROM {S.conversation_pairs()}),
e AS (SELECT conv_id, turn, list_concat(s[1:127], [2]) AS i, list_concat(t[1:127], [2]) AS l FROM p)
SELECT conv_id, turn,
       array_to_string({_pad_sql('i', 3)}, ',') AS input_ids,
       array_to_string({_ones_sql('len(i)')}, ',') AS attention_mask,
       array_to_string({_pad_sql('l', -100)}, ',') AS labels
  FROM e
""")
def q_translation_examples(spark, sf):
    """C5 tail: task prefix (B7), EOS, PAD inputs, mask with EOS, labels padded with -100."""
    from corpusflow.operators.examples import translation_examples
    from corpusflow.operators.pairs import with_prefix
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    ids = pairs.select("conv_id", "turn", _len_ids(with_prefix("src")).alias("s"), _len_ids("tgt").alias("t"))
    ex = translation_examples(ids, "s", "t", eos_id=2, pad_id=3)
    return ex.select("conv_id", "turn", *[F.array_join(c, ",").alias(c)
                                          for c in ("input_ids", "attention_mask", "labels")])


@register("choose_eval", """
SELECT 'train' AS split, doc_id AS row_id FROM documents
UNION ALL SELECT 'validation', item_id FROM benchmark
""")
def q_choose_eval(spark, sf):
    """K3: a given evaluation set replaces the split, so all other rows train."""
    from corpusflow.operators.sample import choose_eval
    docs = table(spark, sf, "documents", ["doc_id"]).withColumnRenamed("doc_id", "row_id")
    bench = table(spark, sf, "benchmark", ["item_id"]).withColumnRenamed("item_id", "row_id")
    train, val = choose_eval(docs, bench)
    return train.select(F.lit("train").alias("split"), "row_id").unionByName(
        val.select(F.lit("validation").alias("split"), "row_id"))


@register("required_specials", f"""{_bpe_sql()}
SELECT token, id FROM tok WHERE token IN ('[PAD]', '[SEP]', '[MASK]')
""")
def q_required_specials(spark, sf):
    """The ids of the special tokens that the example builders need."""
    from corpusflow.operators.examples import require_specials
    ids = require_specials(_bpe(spark, sf), ("[PAD]", "[SEP]", "[MASK]"))
    return _bpe(spark, sf).vocab_df(spark).where(F.col("id").isin(list(ids.values()))).select("token", "id")


# ---------------------------------------------------------------- M1 BLEU
_BLEU_COLS = ["bleu", "bp", "sys_len", "ref_len", "correct_1", "correct_2", "correct_3", "correct_4",
              "total_1", "total_2", "total_3", "total_4", "p1", "p2", "p3", "p4"]


def _bleu_out(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ("bleu", "bp", "p1", "p2", "p3", "p4") else F.col(c)
                       for c in _BLEU_COLS])


@register("corpus_bleu", S.corpus_bleu(
    f"SELECT conv_id * 4294967296 + turn AS k, src AS pred, tgt AS ref FROM {S.conversation_pairs()}", "k"))
def q_corpus_bleu(spark, sf):
    """BLEU of each user turn against the assistant reply that follows."""
    from corpusflow.operators.metrics import corpus_bleu
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    return _bleu_out(corpus_bleu(pairs, "src", "tgt", ["conv_id", "turn"]))


@register("corpus_bleu_lines", S.corpus_bleu(
    f"SELECT doc_id * 4294967296 + line_no AS k, src AS pred, tgt AS ref FROM {S.adjacent_pairs()}", "k"))
def q_corpus_bleu_lines(spark, sf):
    """M1 over adjacent document lines (line i as prediction of line i+1)."""
    from corpusflow.operators.metrics import corpus_bleu
    pairs = adjacent_line_pairs(table(spark, sf, "documents"))
    return _bleu_out(corpus_bleu(pairs, "src", "tgt", ["doc_id", "line_no"]))


# ---------------------------------------------------------------- C3-C6 composite jobs
_BOTH_TEXTS = ("SELECT 0 AS corpus_no, doc_id AS row_id, text FROM documents UNION ALL "
               "SELECT 1, item_id, text FROM benchmark")


@register("denoise_corpus", f"""{_bpe_sql("SELECT text FROM benchmark")},
{S.encoded("e", "corpus_no, row_id", _BOTH_TEXTS)},
t AS (SELECT corpus_no, row_id, ids[1:127] AS t FROM e),
n AS (SELECT corpus_no, row_id, t, list_transform(t, lambda x, i: CASE
        WHEN {_u_sql("corpus_no || ':' || row_id", 'i - 1')} < 0.15 THEN 4 ELSE x END) AS noisy FROM t)
SELECT corpus_no, row_id,
       array_to_string({_pad_sql("list_concat(noisy, [2])", 3)}, ',') AS input_ids,
       array_to_string({_pad_sql("list_concat(t, [2])", 3)}, ',') AS labels,
       array_to_string({_ones_sql("len(t)")}, ',') AS attention_mask
  FROM n
""")
def q_denoise_corpus(spark, sf):
    """C4: documents and benchmark texts, BPE-encoded (vocabulary 400), as
    128-token denoising examples."""
    from corpusflow.plans.training_data import build_denoising_examples
    docs = table(spark, sf, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "row_id")
    bench = table(spark, sf, "benchmark").withColumnRenamed("item_id", "row_id")
    ex = build_denoising_examples([("en", docs), ("xx", bench)], _bpe(spark, sf))
    return ex.select("corpus_no", "row_id", *[F.array_join(c, ",").alias(c)
                                              for c in ("input_ids", "labels", "attention_mask")])


_PREFIXED = f"SELECT conv_id * 4294967296 + turn AS row_id, {S.q('translate English to Bengali: ')} || src AS src, tgt FROM {S.conversation_pairs()}"


@register("translation_corpus", f"""{_bpe_sql(f"SELECT src AS text FROM ({_PREFIXED})", f"SELECT tgt AS text FROM ({_PREFIXED})")},
{S.encoded("a", "row_id", _PREFIXED, "src")},
{S.encoded("b", "row_id", _PREFIXED, "tgt")},
v AS (SELECT row_id, row_number() OVER (ORDER BY substr(md5('42:' || row_id), 1, 15), row_id) AS k, count(*) OVER () AS n FROM a),
e AS (SELECT row_id, CASE WHEN k <= ceil(n * 0.01) THEN 'validation' ELSE 'train' END AS split,
             list_concat(a.ids[1:127], [2]) AS i, list_concat(b.ids[1:127], [2]) AS l
        FROM a JOIN b USING (row_id) JOIN v USING (row_id))
SELECT split, row_id,
       array_to_string({_pad_sql('i', 3)}, ',') AS input_ids,
       array_to_string({_ones_sql('len(i)')}, ',') AS attention_mask,
       array_to_string({_pad_sql('l', -100)}, ',') AS labels
  FROM e
""")
def q_translation_corpus(spark, sf):
    """Conversation pairs -> seeded 1 % validation split -> prefixed,
    BPE-encoded translation examples; both splits, tagged."""
    from corpusflow.plans.training_data import build_translation_examples
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    pairs = pairs.select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("row_id"),
                         F.struct(F.col("src").alias("en"), F.col("tgt").alias("bn")).alias("translation"))
    tr, va = build_translation_examples(pairs, _bpe(spark, sf))
    cols = [F.array_join(c, ",").alias(c) for c in ("input_ids", "attention_mask", "labels")]
    return (tr.select(F.lit("train").alias("split"), "row_id", *cols)
              .unionByName(va.select(F.lit("validation").alias("split"), "row_id", *cols)))


@register("evaluate_pairs", S.corpus_bleu(
    f"SELECT conv_id * 4294967296 + turn AS k, src AS pred, tgt AS ref FROM {S.conversation_pairs()}", "k"))
def q_evaluate_pairs(spark, sf):
    """C6 with no row cap: same numbers as ``corpus_bleu``."""
    from corpusflow.plans.training_data import evaluate_pairs
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    return _bleu_out(evaluate_pairs(pairs, "src", "tgt", ["conv_id", "turn"]))


@register("clean_report_mono_lid", f"""
WITH {S.lid_model_ctes(_LID_TRAIN_SQL)},
c AS (SELECT doc_id, {S.clean('text', 'en')} AS text FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn
        FROM c WHERE length(text) >= 10),
f AS (SELECT doc_id, text FROM p WHERE rn = 1),
{S.lid_score_ctes('s', 'SELECT doc_id, text FROM f', 'doc_id')}
SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS total,
       CAST((SELECT count(*) FROM c WHERE length(text) < 10) AS BIGINT) AS short,
       CAST((SELECT count(*) FROM p WHERE rn > 1) AS BIGINT) AS dup,
       CAST((SELECT count(*) FROM s WHERE NOT (label = 'en' AND score >= 0.5)) AS BIGINT) AS lang,
       CAST((SELECT count(*) FROM s WHERE label = 'en' AND score >= 0.5) AS BIGINT) AS kept
""")
def q_clean_report_mono_lid(spark, sf):
    """D3 (mono) with the trigram identifier."""
    docs = table(spark, sf, "documents")
    return clean_report_monolingual(docs, "en", lid=_lid(spark, sf), order_cols=["doc_id"])


@register("clean_report_pairs_lid", f"""
WITH {S.lid_model_ctes(_LID_TRAIN_SQL)},
c AS (SELECT doc_id * 4294967296 + line_no AS k, {S.clean('src', None)} AS s, {S.clean('tgt', None)} AS t
        FROM {S.adjacent_pairs()}),
w AS (SELECT *, {S.words('s')} AS ws, {S.words('t')} AS wt, md5(s || chr(9) || t) AS h FROM c),
r0 AS (SELECT *, CASE WHEN s = '' OR t = '' THEN 'empty'
                      WHEN NOT (ws BETWEEN 2 AND 150 AND wt BETWEEN 2 AND 150) THEN 'length'
                      WHEN greatest(ws, wt) > 3.0 * least(ws, wt) THEN 'ratio' END AS r0 FROM w),
{S.lid_score_ctes('ps', 'SELECT k, s AS text FROM r0 WHERE r0 IS NULL', 'k')},
{S.lid_score_ctes('pt', 'SELECT k, t AS text FROM r0 WHERE r0 IS NULL', 'k')},
r AS (SELECT r0.*, CASE WHEN r0 IS NOT NULL THEN r0
                        WHEN (ps.score > 0.5 AND ps.label <> 'en') OR (pt.score > 0.5 AND pt.label <> 'en') THEN 'lang'
                        WHEN {S.digit_runs('s')} <> {S.digit_runs('t')} THEN 'numbers' END AS r1
        FROM r0 LEFT JOIN ps USING (k) LEFT JOIN pt USING (k)),
fa AS (SELECT h, min(k) AS first_ok FROM r WHERE r1 IS NULL GROUP BY h),
x AS (SELECT CASE WHEN r1 = 'empty' THEN 'empty'
                  WHEN fa.first_ok IS NOT NULL AND k > fa.first_ok THEN 'dup'
                  WHEN r1 IS NULL THEN 'kept' ELSE r1 END AS reason
        FROM r LEFT JOIN fa USING (h))
SELECT CAST(count(*) AS BIGINT) AS total,
       {", ".join(f"CAST(sum(CASE WHEN reason = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS {x}" for x in REASONS + ("kept",))}
  FROM x
""")
def q_clean_report_pairs_lid(spark, sf):
    """D3 (pairs) with the trigram identifier, English expected on both sides."""
    pairs = adjacent_line_pairs(table(spark, sf, "documents"))
    pairs = pairs.withColumnRenamed("src", "en").withColumnRenamed("tgt", "en2")
    return clean_report_parallel(pairs, "en", "en2", lid=_lid(spark, sf), whitelist=False,
                                 order_cols=["doc_id", "line_no"], expect=("en", "en"))
