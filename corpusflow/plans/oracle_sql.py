"""SQL fragments for the DuckDB oracle (RE2 regex, ``'g'`` flag for global).

These restate the rules independently of the Spark code paths: Python's
whitespace class and the original regex forms, no translate/trim shortcuts.
DuckDB has no NFKC, so oracles feed text that NFKC leaves unchanged (the test
tables have none that it changes) or the already-normalised literal.
"""

from __future__ import annotations

from collections.abc import Sequence

from corpusflow.functions import patterns as P


def q(s: str) -> str:
    """SQL single-quoted literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    ws = P.WS()
    return f"regexp_replace({x}, {q(f'^[{ws}]+|[{ws}]+$')}, '', 'g')"


def clean(x: str, lang: str | None) -> str:
    """normalise(strip) -> URL strip -> whitelist -> collapse + strip."""
    ws = P.WS()
    t = strip(f"coalesce({x}, '')")
    t = f"regexp_replace({t}, {q(P.url_pattern())}, '', 'g')"
    cls = P.whitelist_class(lang) if lang else None
    if cls:
        t = f"regexp_replace({t}, {q(cls)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(f'[{ws}]+')}, ' ', 'g')"
    return strip(t)


def words(x: str) -> str:
    """Word count of collapsed text."""
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END)"


def digit_runs(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\p{{Nd}}+'))"


def adjacent_pairs() -> str:
    """(doc_id, line_no, src, tgt) from consecutive lines of each document."""
    return """(SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, ls[i] AS src, ls[i + 1] AS tgt
       FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
            LATERAL (SELECT unnest(range(1, len(d.ls))) AS i) r)"""


def conversation_pairs() -> str:
    return """(SELECT u.conv_id, CAST(u.turn + 1 AS BIGINT) AS turn, u.text AS src, a.text AS tgt
       FROM conversations u JOIN conversations a
         ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant')"""


def _trigram_list(x: str) -> str:
    c = f"string_split(lower(replace(coalesce({x}, ''), chr(10), ' ')), '')"
    return c


def lid_model_ctes(train_sql: str) -> str:
    """CTEs ``_lid_cnt(lang, gram, c)`` and ``_lid_langs(lang, lognorm)`` for a
    training query selecting ``lang, text``."""
    return f"""
_lid_tr AS (SELECT lang, {_trigram_list('text')} AS c FROM ({train_sql}) WHERE lang IS NOT NULL),
_lid_g AS (SELECT lang, unnest(list_transform(range(1, len(c) - 1),
                   lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM _lid_tr),
_lid_cnt AS (SELECT lang, gram, count(*) AS c FROM _lid_g GROUP BY lang, gram),
_lid_v AS (SELECT count(DISTINCT gram) AS v FROM _lid_cnt),
_lid_langs AS (SELECT lang, ln(sum(c) + any_value(v)) AS lognorm FROM _lid_cnt, _lid_v GROUP BY lang)"""


def lid_score_ctes(name: str, texts_sql: str, key: str) -> str:
    """CTE ``<name>(key, label, score)`` scoring ``texts_sql`` (selecting
    ``key, text``) with the model CTEs above."""
    return f"""
{name}_t AS (SELECT {key}, {_trigram_list('text')} AS c FROM ({texts_sql})),
{name}_n AS (SELECT {key}, greatest(len(c) - 2, 0) AS n FROM {name}_t),
{name}_g AS (SELECT {key}, unnest(list_transform(range(1, len(c) - 1),
                   lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM {name}_t),
{name}_m AS (SELECT g.{key}, k.lang, sum(ln(k.c + 1)) AS s FROM {name}_g g JOIN _lid_cnt k USING (gram)
             GROUP BY g.{key}, k.lang),
{name}_s AS (SELECT n.{key}, n.n, l.lang, -n.n * l.lognorm + coalesce(m.s, 0) AS s
               FROM {name}_n n CROSS JOIN _lid_langs l
               LEFT JOIN {name}_m m ON m.{key} = n.{key} AND m.lang = l.lang),
{name}_x AS (SELECT {key}, any_value(n) AS n, max(s) AS mx,
                    first(lang ORDER BY s DESC, lang) AS top FROM {name}_s GROUP BY {key}),
{name} AS (SELECT x.{key},
                  CASE WHEN x.n > 0 THEN x.top ELSE 'other' END AS label,
                  CASE WHEN x.n > 0 THEN 1.0 / sum(exp(s.s - x.mx)) ELSE 0.0 END AS score
             FROM {name}_x x JOIN {name}_s s USING ({key})
            GROUP BY x.{key}, x.n, x.top)"""


# Word pattern of the pre-tokenizer for RE2 (Unicode word = letters, marks,
# letter numbers, decimal digits, connector punctuation; White_Space spelled out).
WORD_CLASS = "\\p{L}\\p{M}\\p{Nl}\\p{Nd}\\p{Pc}"
WHITE_SPACE = ("\\x{9}-\\x{d}\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
               "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}")


def pretokenize(x: str) -> str:
    pat = f"[{WORD_CLASS}]+|[^{WORD_CLASS}{WHITE_SPACE}]+"
    return f"regexp_extract_all(coalesce({x}, ''), {q(pat)})"


def tokenize_13a(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), {q('[' + P.WS() + ']+$')}, '')"
    t = f"replace(replace(replace({t}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    t = f"replace(replace(replace(replace({t}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    t = f"(' ' || {t} || ' ')"
    t = f"regexp_replace({t}, {q('([{-~[-` -&(-+:-@/])')}, ' \\1 ', 'g')"
    t = f"regexp_replace({t}, '([^0-9])([.,])', '\\1 \\2 ', 'g')"
    t = f"regexp_replace({t}, '([.,])([^0-9])', ' \\1 \\2', 'g')"
    t = f"regexp_replace({t}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    t = strip(f"regexp_replace({t}, {q('[' + P.WS() + ']+')}, ' ', 'g')")
    return f"(CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split({t}, ' ') END)"


def corpus_bleu(pairs_sql: str, key: str) -> str:
    """One-row BLEU over ``pairs_sql`` selecting ``key, pred, ref``."""
    grams = []
    for n in range(1, 5):
        for side, hv, rv in (("h", 1, 0), ("r", 0, 1)):
            grams.append(
                f"SELECT {key}, {n} AS n, unnest(list_transform(range(1, len({side}) - {n} + 2), "
                f"lambda i: array_to_string({side}[i:i + {n - 1}], ' '))) AS g, {hv} AS ch, {rv} AS cr FROM t")
    corr = ", ".join(f"CAST(sum(CASE WHEN n = {n} THEN m ELSE 0 END) AS BIGINT) AS correct_{n}" for n in range(1, 5))
    tot = ", ".join(f"CAST(sum(CASE WHEN n = {n} THEN ch ELSE 0 END) AS BIGINT) AS total_{n}" for n in range(1, 5))
    prec = []
    for n in range(1, 5):
        reached = " AND ".join(f"total_{m} > 0" for m in range(1, n + 1))
        zeros = " + ".join(f"(CASE WHEN correct_{m} = 0 THEN 1 ELSE 0 END)" for m in range(1, n + 1))
        prec.append(f"(CASE WHEN NOT ({reached}) THEN 0.0 WHEN correct_{n} > 0 "
                    f"THEN 100.0 * correct_{n} / total_{n} "
                    f"ELSE 100.0 / (pow(2.0, {zeros}) * total_{n}) END) AS p{n}")
    logs = " + ".join(f"(CASE WHEN p{n} = 0.0 THEN -9999999999.0 ELSE ln(p{n}) END)" for n in range(1, 5))
    return f"""
WITH t AS (SELECT {key}, {tokenize_13a('pred')} AS h, {tokenize_13a('ref')} AS r FROM ({pairs_sql})),
g AS ({' UNION ALL '.join(grams)}),
per AS (SELECT {key}, n, g, sum(ch) AS ch, sum(cr) AS cr FROM g GROUP BY {key}, n, g),
s AS (SELECT {corr}, {tot} FROM (SELECT n, least(ch, cr) AS m, ch FROM per)),
l AS (SELECT CAST(sum(len(h)) AS BIGINT) AS sys_len, CAST(sum(len(r)) AS BIGINT) AS ref_len,
             CAST(count(*) AS BIGINT) AS rows FROM t),
x AS (SELECT *, CASE WHEN sys_len < ref_len THEN (CASE WHEN sys_len > 0 THEN exp(1.0 - ref_len / sys_len) ELSE 0.0 END)
                     ELSE 1.0 END AS bp FROM s, l),
y AS (SELECT *, {', '.join(prec)} FROM x)
SELECT round(CASE WHEN rows = 0 THEN NULL WHEN correct_1 + correct_2 + correct_3 + correct_4 = 0 THEN 0.0
                  ELSE bp * exp(({logs}) / 4.0) END, 6) AS bleu,
       round(bp, 6) AS bp, sys_len, ref_len, correct_1, correct_2, correct_3, correct_4,
       total_1, total_2, total_3, total_4,
       round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4
  FROM y
"""


def bpe_ctes(alphabet_sql: str, vocab: int, extra: Sequence[str] = ()) -> str:
    """Byte-pair training over ``documents``, one merge a step, and what it leaves:
    ``tok`` (id, token), ``merge`` (step, l, r, nid) and ``seg`` (word, ids).

    A word is a string of ``<id>`` symbols, so a replacement merges from left to
    right. ``extra`` are queries of further texts, whose words follow the merges
    without a count of their own. The row without a word carries the tokens."""
    texts = "SELECT text, 1 AS c FROM documents" + "".join(f" UNION ALL SELECT text, 0 FROM ({x})" for x in extra)
    return f"""
alpha AS ({alphabet_sql}),
wc AS (SELECT word, CAST(sum(c) AS BIGINT) AS c
         FROM (SELECT unnest({pretokenize('text')}) AS word, c FROM ({texts})) GROUP BY word),
ch AS (SELECT word, c, s[i] AS ch, i
         FROM (SELECT word, c, string_split(word, '') AS s FROM wc) x, LATERAL (SELECT unnest(range(1, len(x.s) + 1)) AS i) r),
init AS (SELECT word, c, string_agg('<' || coalesce(id, 0) || '>', '' ORDER BY i) AS syms
           FROM ch LEFT JOIN alpha ON token = ch GROUP BY word, c),
bpe AS (
  SELECT 0 AS step, word, c, syms, NULL::VARCHAR[] AS toks, NULL::INTEGER AS l, NULL::INTEGER AS r, NULL::INTEGER AS nid FROM init
  UNION ALL
  SELECT 0, NULL, 0, NULL, (SELECT list(token ORDER BY id) FROM alpha), NULL, NULL, NULL
  UNION ALL
  SELECT b.step + 1, b.word, b.c, replace(b.syms, '<' || t.l || '><' || t.r || '>', '<' || t.nid || '>'),
         CASE WHEN b.word IS NULL THEN (CASE WHEN t.nid < len(t.toks) THEN t.toks ELSE list_append(t.toks, t.new) END) END,
         t.l, t.r, t.nid
    FROM bpe b,
         (SELECT l, r, toks, toks[l + 1] || toks[r + 1] AS new,
                 CAST(coalesce(list_position(toks, toks[l + 1] || toks[r + 1]), len(toks) + 1) - 1 AS INTEGER) AS nid
            FROM (SELECT l, r FROM (
                    SELECT x[i] AS l, x[i + 1] AS r, c
                      FROM (SELECT list_transform(string_split(syms[2:len(syms) - 1], '><'), lambda v: CAST(v AS INTEGER)) AS x, c
                              FROM bpe WHERE word IS NOT NULL AND c > 0) y, LATERAL (SELECT unnest(range(1, len(y.x))) AS i) z)
                   GROUP BY l, r ORDER BY sum(c) DESC, l, r LIMIT 1) top,
                 (SELECT toks FROM bpe WHERE word IS NULL) k
           WHERE len(toks) < {vocab}) t),
last AS (SELECT * FROM bpe WHERE step = (SELECT max(step) FROM bpe)),
merge AS (SELECT step, l, r, nid FROM bpe WHERE word IS NULL AND step > 0),
tok AS (SELECT CAST(i - 1 AS INTEGER) AS id, toks[i] AS token
          FROM (SELECT toks FROM last WHERE word IS NULL) x, LATERAL (SELECT unnest(range(1, len(x.toks) + 1)) AS i) r),
seg AS (SELECT word, list_transform(string_split(syms[2:len(syms) - 1], '><'), lambda v: CAST(v AS INTEGER)) AS ids
          FROM last WHERE word IS NOT NULL)"""


def bpe_ctes_by_key(alphabet_sql: str, vocab: int) -> str:
    """:func:`bpe_ctes` for many merges, without ``extra``: a step changes only the rows
    of what the merge touches. Rows by ``kind``: 0 words (``s`` symbols, ``n`` count),
    1 pairs, 2 tokens, 3 merges, 4 the number of tokens and the step."""
    ids = lambda s: f"list_transform(string_split({s}[2:len({s}) - 1], '><'), lambda v: CAST(v AS INTEGER))"
    return f"""
alpha AS MATERIALIZED ({alphabet_sql}),
wc AS MATERIALIZED (SELECT word, CAST(count(*) AS BIGINT) AS c, CAST(row_number() OVER (ORDER BY word) AS INTEGER) AS w
         FROM (SELECT unnest({pretokenize('text')}) AS word FROM documents) GROUP BY word),
ch AS (SELECT w, c, s[i] AS ch, i
         FROM (SELECT w, c, string_split(word, '') AS s FROM wc) x, LATERAL (SELECT unnest(range(1, len(x.s) + 1)) AS i) r),
init AS MATERIALIZED (SELECT w, c, list(id ORDER BY i) AS ids FROM ch JOIN alpha ON token = ch GROUP BY w, c),
bpe(kind, a, b, n, s, x, y) USING KEY (kind, a, b) AS (
  SELECT 0, w, 0, c, '<' || array_to_string(ids, '><') || '>', 0, 0 FROM init
  UNION ALL
  SELECT 1, ids[i], ids[i + 1], CAST(sum(c) AS BIGINT), NULL, 0, 0
    FROM init, LATERAL (SELECT unnest(range(1, len(init.ids))) AS i) r GROUP BY ALL
  UNION ALL
  SELECT 2, id, 0, 0, token, 0, 0 FROM alpha
  UNION ALL
  SELECT 4, 0, 0, (SELECT count(*) FROM alpha), NULL, 0, 0
  UNION
  (WITH k AS MATERIALIZED (SELECT * FROM recurring.bpe),
  t AS MATERIALIZED (
    SELECT l, r, new, coalesce(known.a, len) AS nid, known.a IS NULL AS fresh, step, len
      FROM (SELECT top.l, top.r, lt.s || rt.s AS new, st.n AS len, st.x + 1 AS step
              FROM (SELECT a AS l, b AS r FROM k WHERE kind = 1 AND n > 0 ORDER BY n DESC, a, b LIMIT 1) top,
                   k lt, k rt, k st
             WHERE lt.kind = 2 AND lt.a = top.l AND rt.kind = 2 AND rt.a = top.r AND st.kind = 4 AND st.n < {vocab}) z
           LEFT JOIN (SELECT a, s FROM k WHERE kind = 2) known ON known.s = z.new),
  old AS MATERIALIZED (SELECT a AS w, n AS c, s, replace(s, '<' || l || '><' || r || '>', '<' || nid || '>') AS s2
            FROM k, t WHERE kind = 0 AND contains(s, '<' || l || '><' || r || '>')),
  d AS (SELECT l, r, sum(c) AS n FROM (
          SELECT v[i] AS l, v[i + 1] AS r, c FROM (SELECT {ids('s')} AS v, -c AS c FROM old UNION ALL SELECT {ids('s2')}, c FROM old) q,
                 LATERAL (SELECT unnest(range(1, len(q.v))) AS i) z) GROUP BY l, r)
  SELECT 0, w, 0, c, s2, 0, 0 FROM old
  UNION ALL SELECT 1, d.l, d.r, CAST(coalesce(p.n, 0) + d.n AS BIGINT), NULL, 0, 0
              FROM d LEFT JOIN (SELECT a, b, n FROM k WHERE kind = 1) p ON p.a = d.l AND p.b = d.r WHERE d.n <> 0
  UNION ALL SELECT 2, nid, 0, 0, new, 0, 0 FROM t WHERE fresh
  UNION ALL SELECT 3, step, 0, nid, NULL, l, r FROM t
  UNION ALL SELECT 4, 0, 0, len + CAST(fresh AS INTEGER), NULL, step, 0 FROM t)),
merge AS (SELECT a AS step, x AS l, y AS r, CAST(n AS INTEGER) AS nid FROM bpe WHERE kind = 3),
tok AS (SELECT a AS id, s AS token FROM bpe WHERE kind = 2),
seg AS (SELECT word, {ids('s')} AS ids FROM bpe JOIN wc ON w = a WHERE kind = 0)"""


def encoded(name: str, keys: str, texts_sql: str, text: str = "text") -> str:
    """``name`` (keys, ids): the ids of every text of a query, in word order."""
    return f"""
{name}_w AS (SELECT {keys}, {pretokenize(text)} AS ws FROM ({texts_sql})),
{name}_s AS (SELECT {keys}, i, ids FROM (SELECT {keys}, i, ws[i] AS word FROM {name}_w x,
                LATERAL (SELECT unnest(range(1, len(x.ws) + 1)) AS i) r) JOIN seg USING (word)),
{name}_g AS (SELECT {keys}, flatten(list(ids ORDER BY i)) AS ids FROM {name}_s GROUP BY {keys}),
{name} AS (SELECT {keys}, coalesce(ids, []::INTEGER[]) AS ids FROM {name}_w LEFT JOIN {name}_g USING ({keys}))"""
