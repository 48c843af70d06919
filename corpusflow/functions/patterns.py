"""Regex character classes shared by Spark (Java regex) and the DuckDB oracle (RE2).

Both engines accept ``\\x{hhhh}`` escapes and ``\\p{Nd}``, so one pattern string
serves both. Classes with many members are derived by rule from Python's own
character database, never typed in by hand.
"""

from __future__ import annotations

import functools


def _ranges(codepoints) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in sorted(codepoints):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


def _class_body(codepoints) -> str:
    parts = []
    for a, b in _ranges(codepoints):
        parts.append(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}")
    return "".join(parts)


@functools.lru_cache(maxsize=None)
def whitespace_codepoints() -> tuple[int, ...]:
    """Python's ``str.isspace`` set (also what ``re``'s ``\\s`` matches on str)."""
    return tuple(c for c in range(0x110000) if chr(c).isspace())


@functools.lru_cache(maxsize=None)
def WS() -> str:
    """Class body (no brackets) for Python whitespace, for use inside ``[...]``."""
    return _class_body(whitespace_codepoints())


# The character whitelists of the cleaning rules.
# English keeps ASCII letters, ASCII digits, whitespace and these punctuation marks:
#   . , ! ? ' " - ( ) [ ] ; :
# Bengali keeps the same plus the Bengali block U+0980..U+09FF.
EN_PUNCT = ".,!?'\"-()[];:"
BN_BLOCK = (0x0980, 0x09FF)


def _punct_body(chars: str) -> str:
    return "".join("\\" + ch if ch in "\\[]-^" else ch for ch in chars)


@functools.lru_cache(maxsize=None)
def whitelist_class(lang: str, with_ws: bool = True) -> str | None:
    """Negated class matching every character the language's whitelist drops.
    ``with_ws=False`` keeps only U+0020 of the whitespace (for text whose
    whitespace was already mapped to spaces)."""
    ws = WS() if with_ws else " "
    if lang == "en":
        return f"[^a-zA-Z0-9{ws}{_punct_body(EN_PUNCT)}]"
    if lang == "bn":
        lo, hi = BN_BLOCK
        return f"[^\\x{{{lo:x}}}-\\x{{{hi:x}}}a-zA-Z0-9{ws}{_punct_body(EN_PUNCT)}]"
    return None


@functools.lru_cache(maxsize=None)
def whitelist_chars(lang: str | None) -> str | None:
    """The characters a language's whitelist keeps, other than whitespace
    (U+0020 included as the one space left after mapping); None = no rule."""
    base = ("abcdefghijklmnopqrstuvwxyz" "ABCDEFGHIJKLMNOPQRSTUVWXYZ" "0123456789" " " + EN_PUNCT)
    if lang == "en":
        return base
    if lang == "bn":
        lo, hi = BN_BLOCK
        return base + "".join(chr(c) for c in range(lo, hi + 1))
    return None


def url_pattern() -> str:
    """``http\\S+|www\\S+`` with Python's whitespace (the ``https`` branch is subsumed)."""
    return f"(?:http|www)[^{WS()}]+"


def digit_run_pattern() -> str:
    """Python ``\\d+`` on str = runs of Unicode decimal digits."""
    return "\\p{Nd}+"
