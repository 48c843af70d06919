"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import (bm25_wand, bpe_dp, deobfuscate, merkle, min_bin_slack, mincut_html, nbsvm, nra, partenum, pii_boost,
                            pivot_index, rule_ledger, token_store)
from corpusflow.llm.common import label_split, read

#: Vocabulary files of the queries; the operators take any path.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    stored = token_store.read_store(token_store.write_store(docs, WORD_BPE))
    return stored.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                         F.crc32("ids").alias("ids_crc32"))


def op2_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.link_components(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    done = bpe_dp.decode(bpe_dp.encode(docs, BYTE_BPE), BYTE_BPE)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op4_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    packed = min_bin_slack.pack(docs, WORD_BPE)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = pii_boost.detect(docs)
    kinds = ", ".join(f"'{k}'" for k in pii_boost.KINDS)
    listed = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.stop)))"
    every = f"array_sort(transform(concat(base, added), s -> struct(array_position(array({kinds}), s.kind) as k, " \
            "s.start as start, s.stop as stop, s.kind as kind)))"
    return found.select(
        "doc_id", *[F.expr(f"bigint(size(filter(base, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in pii_boost.KINDS],
        F.sha2(F.expr(listed.format("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(listed.format(every)).alias("spans"))


def op6_deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    learn = read(spark, sf_dir, "labels", "doc_id", "toxic").where(~label_split("doc_id", 4, 2))
    scored = deobfuscate.score(docs, deobfuscate.train(docs, learn, "toxic"))
    return scored.select("doc_id", label_split("doc_id", 4, 2).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return bm25_wand.search(docs, docs.where("doc_id % 20 = 0"))


def op8_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    learn = read(spark, sf_dir, "labels", "doc_id", "quality").where(~label_split("doc_id", 5, 0))
    scored = nbsvm.score(docs, nbsvm.train(docs, learn, "quality"))
    return scored.select("doc_id", label_split("doc_id", 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    out = rule_ledger.verdicts(rule_ledger.ledger(docs), rule_ledger.STRICT)
    base = F.col("fail_bits").bitwiseAND(F.lit(rule_ledger.BASE.mask)) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def op10_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    texts = mincut_html.extract(pages, mincut_html.train(pages))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op11_merkle_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    return merkle.audit(merkle.manifest(docs))


def op12_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.search(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


#: Measurements and fail bits of the ledger over ``documents``.
LEDGER_SQL = r"""
with t as (
  select row_number() over () rid, doc_id, coalesce(text, '') as text from documents
), w as (
  select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from t
), win as (
  select rid, unnest(range(1, len(words) - 6)) as i, words from w where len(words) >= 8
), keyed as (
  select rid, i, array_to_string(words[i:i + 7], ' ') as k from win
), hit as (
  select rid, i from (select rid, i, count(*) over (partition by rid, k) as c from keyed) where c > 1
), rep as (
  select rid, sum(least(8, i - p)) as n
  from (select rid, i, coalesce(lag(i) over (partition by rid order by i), -8) as p from hit) group by rid
), m as (
  select w.rid, doc_id, text, len(words)::bigint as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(rep.n, 0)::bigint as n_repeat_words,
         len(regexp_extract_all(text, '!'))::bigint as n_exclaims
  from w left join rep on w.rid = rep.rid
), ledger as (
  select *, (case when n_words < 20 then 1 else 0 end)
    + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
    + (case when 100 * n_symbols > 20 * n_words then 4 else 0 end)
    + (case when n_dup_lines > 3 and 100 * n_dup_lines > 50 * n_lines then 8 else 0 end)
    + (case when word_chars < 2 * n_words or word_chars > 15 * n_words then 16 else 0 end)
    + (case when 100 * n_exclaims > 30 * n_words then 32 else 0 end) as fail_bits
  from m
)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_partenum": op2_partenum,
    "op3_bpe_prefix": op3_bpe_prefix,
    "op4_min_bin_slack": op4_min_bin_slack,
    "op5_pii_boost": op5_pii_boost,
    "op6_deobfuscate": op6_deobfuscate,
    "op7_bm25_wand": op7_bm25_wand,
    "op8_nbsvm": op8_nbsvm,
    "op9_rule_ledger": op9_rule_ledger,
    "op10_mincut_html": op10_mincut_html,
    "op11_merkle_pivot": op11_merkle_pivot,
    "op12_pivot_index": op12_pivot_index,
    "op13_nra": op13_nra,
}

#: The ten best texts for every twentieth text as a query, all pairs scored.
SEARCH_SQL = r"""
with w as (
  select doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) as term
  from documents
), tf as (
  select doc_id, term, count(*)::double as n from w group by all
), len as (
  select doc_id, sum(n) as n from tf group by doc_id
), stat as (
  select count(*)::double as docs, sum(n) / count(*) as mean from len
), df as (
  select term, count(*)::double as n from tf group by term
), hit as (
  select q.doc_id as query_id, tf.doc_id, sum(round(
    tf.n * 2.2 / (tf.n + 1.2 * (1 - 0.75 + 0.75 * len.n / mean)) * (ln(1 + (docs - df.n + 0.5) / (df.n + 0.5)) * 1048576.0)
  )::bigint)::bigint as score
  from tf q join df on q.term = df.term join tf on tf.term = q.term join len on len.doc_id = tf.doc_id cross join stat
  where q.doc_id % 20 = 0 group by all
), best as (
  select *, row_number() over (partition by query_id order by score desc, doc_id)::integer as rank from hit
)
select query_id, rank, doc_id, score from best where rank <= 10"""



def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: crc32 of the decimal digits of doc_id: a step per digit, eight bits each.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
  list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _tree_sql(name: str, start: str) -> str:
    """Recursive: all nodes of the trees of ``start(g, place, nodes, digest)``."""
    return f"""{name} as (
  select g, 0 as level, place, nodes, digest from {start}
  union all
  select g, level + 1, place // 2, (nodes + 1) // 2, sha256(string_agg(digest, '' order by place))
  from {name} where nodes > 1 group by g, level, place // 2, nodes
)"""


def _path_sql(name: str, start: str, tree: str) -> str:
    """Recursive: the way up of ``start(rid, g, place, nodes, fold)``, with what it folds to."""
    return f"""{name} as (
  select rid, g, 0 as level, place, nodes, fold, '' as sibling from {start}
  union all
  select p.rid, p.g, p.level + 1, p.place // 2, (p.nodes + 1) // 2,
         sha256(case when p.place % 2 = 1 then coalesce(s.digest, '') || p.fold else p.fold || coalesce(s.digest, '') end),
         coalesce(s.digest, '')
  from {name} p left join {tree} s on s.g = p.g and s.level = p.level and s.place = xor(p.place, 1) where p.nodes > 1
)"""


#: Trees of all languages and of their roots, level by level; every document's way up.
MERKLE_SQL = f"""
with recursive leaf as (
  select row_number() over () as rid, doc_id, coalesce('=' || lang, '') as g, {_leaf_sql("n_chars")} as digest,
         case when {_CRC_SQL} % 7 = 0 and n_chars is not null then {_leaf_sql("(n_chars::hugeint + 1)")} end as changed
  from documents
), node as (
  select rid, doc_id, g, digest, coalesce(changed, digest) as fold,
         row_number() over (partition by g order by doc_id nulls first, digest) - 1 as place, count(*) over (partition by g) as nodes
  from leaf
), {_tree_sql("tree", "node")}, {_path_sql("way", "node", "tree")}, sub as (
  select g as lang, '' as g, digest, row_number() over (order by g) - 1 as place, count(*) over () as nodes from tree where nodes = 1
), {_tree_sql("top", "sub")}, low as (
  select rid, string_agg(sibling, '' order by level) as proof, max_by(fold, level) as fold from way group by rid
), high0 as (
  select node.rid, sub.g, sub.place, sub.nodes, low.fold from node join sub on sub.lang = node.g join low on low.rid = node.rid
), {_path_sql("upper", "high0", "top")}, high as (
  select rid, string_agg(sibling, '' order by level) as proof, max_by(fold, level) as fold from upper group by rid
)
select node.doc_id, node.digest as leaf, sub.digest as subroot, root.digest as root, sha256(low.proof || high.proof) as proof_sha256,
       high.fold as folded_root, high.fold = root.digest as verified
from node join low on low.rid = node.rid join high on high.rid = node.rid join sub on sub.lang = node.g
cross join (select digest from top where nodes = 1) root"""

#: The ten best documents for every benchmark item, all documents scored.
RANKED_SQL = r"""
with t as (
  select rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as rid, doc_id, text from documents)
), tf as (
  select rid, doc_id, term, count(*)::bigint as tf from t group by all
), len as (
  select rid, sum(tf)::bigint as n from tf group by rid
), stat as (
  select count(*)::bigint as docs, sum(n)::bigint as total from len
), weight as (
  select term, floor(1000 * ln((2 * max(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf cross join stat group by term
), asked as (
  select q, item_id, term, count(*)::bigint as c from (
    select q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select row_number() over () as q, item_id, text from benchmark)) group by all
), hit as (
  select q, item_id, tf.rid, tf.doc_id,
         sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::bigint as score
  from asked join weight using (term) join tf using (term) join len on len.rid = tf.rid cross join stat
  where tf.doc_id is not null group by all
), best as (
  select *, row_number() over (partition by q order by score desc, doc_id)::integer as rank from hit where score > 0
)
select item_id, rank, doc_id, score from best where rank <= 10"""

ORACLES: dict[str, str] = {
    "op11_merkle_pivot": MERKLE_SQL,
    "op13_nra": RANKED_SQL,
    "op7_bm25_wand": SEARCH_SQL,
    "op9_rule_ledger": LEDGER_SQL + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 as base_failed, fail_bits = 0 as kept, fail_bits::bigint as fail_bits
from ledger""",
}
