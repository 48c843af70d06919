from corpusflow.functions.text import (
    apply_whitelist,
    clean_characters,
    clean_text,
    collapse_ws,
    count_numbers,
    nfkc,
    normalize_text,
    pair_hash,
    strip_urls,
    strip_ws,
    text_hash,
    truncate_display,
    word_count,
)

__all__ = [
    "apply_whitelist", "clean_characters", "clean_text", "collapse_ws",
    "count_numbers", "nfkc", "normalize_text", "pair_hash", "strip_urls",
    "strip_ws", "text_hash", "truncate_display", "word_count",
]
