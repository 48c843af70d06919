"""Quality rules as a bitmask ledger (operator 9), DataFrame functions only.

``measure`` evaluates every measurement of a text once; ``ledger`` turns them
into one ``fail_bits`` long (bit i set: rule i failed) kept beside the
measurements. A policy is a version with a mask of rules; ``verdicts`` and
``ablation`` read only the bits, so a new policy never touches the texts again.

The whole operator is one projection over the scan: no shuffle, no Python. Only
``ablation`` aggregates, and its groups are the distinct bit patterns (at most
2 ** number of rules), counted on the map side first.

Defined cases: a null or empty text has all counts 0 and fails ``few_words``;
rows that repeat are judged row by row; a null id stays null; an input column
whose name equals a computed one is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import WORD_SPACE, spaced

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
#: Words in a window of the repetition rule (fixed by the contract).
WINDOW = 8

#: Rules in bit order: name and SQL over the measurements that is true if it fails.
#: The first two are the base rules.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    # a heading that returns as the last line is no fault, so a few don't count
    ("duplicate_lines", "n_dup_lines > 3 and 100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("shouting", "100 * n_exclaims > 30 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the rules that reject: a document stays if none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
STRICT = Policy("strict", tuple(name for name, _ in RULES))
POLICIES = (BASE, STRICT)


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the measurements of its text column, all long."""
    given = [c for c in df.columns if c not in MEASURES]
    # helpers begin with as many underscores as no column of the input does
    tag = "_"
    while any(c.startswith(tag) for c in df.columns):
        tag += "_"
    df = df.select(*[F.col(f"`{c}`") for c in given], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(f"{tag}t"))
    df = df.withColumn(f"{tag}s", spaced(F.col(f"{tag}t")))
    df = df.withColumn(f"{tag}words", F.expr(f"filter(split({tag}s, ' '), w -> w != '')"))
    df = df.withColumn(f"{tag}lines", F.expr(
        f"transform(filter(split({tag}t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]'), l -> l)"))
    # One hash per window: if all differ no window repeats, which is certain.
    df = df.withColumn(f"{tag}hashes", F.expr(
        f"case when size({tag}words) >= {WINDOW} then transform(sequence(1, size({tag}words) - {WINDOW - 1}), "
        f"i -> xxhash64(slice({tag}words, i, {WINDOW}))) else array() end"))
    df = df.withColumn(f"{tag}repeats", F.expr(f"size(array_distinct({tag}hashes)) < size({tag}hashes)"))
    # Only texts with a repeat: sort windows by 96 bits of hash, keep those equal to a
    # neighbour, and add up the words that the kept windows cover.
    df = df.withColumn(f"{tag}sorted", F.expr(
        f"case when {tag}repeats then array_sort(transform({tag}hashes, (h, i) -> "
        f"struct(h as h, hash(slice({tag}words, i + 1, {WINDOW})) as g, i as i))) end"))
    df = df.withColumn(f"{tag}at", F.expr(
        f"array_sort(transform(filter({tag}sorted, (x, j) -> "
        f"(j > 0 and get({tag}sorted, j - 1).h = x.h and get({tag}sorted, j - 1).g = x.g) or "
        f"(j + 1 < size({tag}sorted) and get({tag}sorted, j + 1).h = x.h and get({tag}sorted, j + 1).g = x.g)), x -> x.i))"))
    counts = {
        "n_words": f"size({tag}words)",
        "word_chars": f"char_length(replace({tag}s, ' ', ''))",
        "n_symbols": f"char_length({tag}t) - char_length(translate({tag}t, '{SYMBOLS}', ''))",
        "n_lines": f"size({tag}lines)",
        "n_dup_lines": f"size({tag}lines) - size(array_distinct({tag}lines))",
        "n_repeat_words": f"coalesce(aggregate({tag}at, struct(0L as n, -{WINDOW}L as p), "
                          f"(a, x) -> struct(a.n + least({WINDOW}L, x - a.p) as n, bigint(x) as p), a -> a.n), 0L)",
        "n_exclaims": f"char_length({tag}t) - char_length(replace({tag}t, '!', ''))",
    }
    return df.select(*[F.col(f"`{c}`") for c in given],
                     *[F.expr(e).cast("long").alias(c) for c, e in counts.items()])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims")


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the measurements and ``fail_bits``: every rule evaluated once.

    The bits pass through a generator of one row: Spark pushes no filter on a verdict
    below it, where it would evaluate all measurements again, and more than once.
    """
    df = measure(df, text_col).drop("fail_bits")
    bits = " | ".join(f"if({test}, {1 << i}L, 0L)" for i, (_, test) in enumerate(RULES))
    return df.select("*", F.explode(F.array(F.expr(bits))).alias("fail_bits"))


def verdicts(df: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    """A ledger with the verdict of one policy: true if none of its rules failed."""
    return df.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(df: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule of it: documents that fail the rule, that only this rule
    rejects (they would stay without it), and that the policy keeps.

    The ledger is reduced to one row per bit pattern before anything is joined.
    """
    table = [{"version": p.version, "mask": p.mask, "rule": name, "bit": 1 << i} for p in policies
             for i, (name, _) in enumerate(RULES) if p.mask >> i & 1]
    patterns = df.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    # at most 2 ** rules patterns meet a few rules per policy
    rows = patterns.select("fail_bits", "n", F.explode(F.array(*[
        F.struct(*[F.lit(v).cast("long" if isinstance(v, int) else "string").alias(c) for c, v in r.items()]) for r in table])).alias("r"))
    rows = rows.select("fail_bits", "n", "r.*")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return rows.groupBy("version", "rule").agg(
        F.sum(F.when(failed.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(failed == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(failed == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.expr("bit_or(fail_bits)").alias("seen_bits"))
