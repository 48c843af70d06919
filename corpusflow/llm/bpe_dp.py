"""Exact byte-pair encoding by per-prefix dynamic programming (operator 3).

A sequence of tokens is the library's encoding of its text if and only if each
token encodes to itself and each two neighbours are compatible: merging their
bytes gives the two again. So each prefix of a word has one last token, and the
last token of a prefix is the one token that ends there, is compatible with the
last token of the prefix before it, and encodes to itself. An automaton over the
vocabulary, whose suffix links list every token that is a suffix of what was
read, gives the candidates; the table of last tokens is followed back to front
to emit the ids. No merge is ever simulated, and time is linear in the text.

Texts are cut where the vocabulary's own splitting rule starts a word in any
case (at a space before a character that isn't white space), and each worker
remembers the ids of words it has seen (bounded; it only saves time).

Defined cases: a null or empty text has no ids and decodes to an empty text; a
null id stays null; rows that repeat are encoded once each; columns other than
the two named are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusflow.llm.common import whole

# The splitting rule of byte-level vocabularies, for any text and for ASCII.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Entries that a worker's memories hold before they start anew, and the longest word kept.
REMEMBERED, LONGEST = 400_000, 48
NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabulary files: printable
    bytes stand for themselves, the others for the letters from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class PrefixEncoder(dict):
    """Word (with its leading space) -> ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.letters = {b: c for b, c in enumerate(letters)}
        back = {c: b for b, c in enumerate(letters)}
        self.made: dict[int, int] = dict.fromkeys(vocab.values(), -1)
        self.left, self.right, self.rank = {}, {}, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            token = vocab[a + b]
            if self.made[token] >= 0:
                raise ValueError("a token that two merges make has no unique history")
            self.made[token] = rank
            self.left[token], self.right[token] = vocab[a], vocab[b]
            self.rank[vocab[a], vocab[b]] = rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.content = {i: bytes(back[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.content |= {i: s.encode() for s, i in self.special.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            if s not in self.special and self._whole(i):
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _meet(self, a: int, b: int, top: bool) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` keeps them apart. Undo the
        merge that was made last, on the right edge of a or the left edge of b, and
        see at each step whether the two at the border would have merged before
        either was used up; of equal merges the left one comes first."""
        end_a = end_b = NEVER
        while True:
            if top:
                rank = self.rank.get((a, b))
                if rank is not None and rank < end_a and rank <= end_b:
                    return False
            top = True
            made_a, made_b = self.made[a], self.made[b]
            if made_a > made_b:
                end_a, a = made_a, self.right[a]
            elif made_b >= 0:
                end_b, b = made_b, self.left[b]
            else:
                return True

    def _whole(self, token: int) -> bool:
        """Whether a token's bytes encode to the token itself."""
        if self.made[token] < 0:
            return len(self.content[token]) == 1
        return self._meet(self.left[token], self.right[token], False)

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[a, b] = self._meet(a, b, True)
        return found

    def word(self, word: str) -> bytes:
        """Ids of one word of the splitting rule, by the table of last tokens."""
        found = self.words.get(word)
        if found is not None:
            return found
        mapped = word.encode().decode("latin-1").translate(self.letters)
        n = len(mapped)
        last, size, compatible = [0] * (n + 1), [0] * (n + 1), self.compatible
        for end, (token, length) in self.automaton.iter(mapped):
            at = end + 1
            if not size[at] and (at == length or size[at - length] and compatible(last[at - length], token)):
                last[at], size[at] = token, length
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        ids.reverse()
        found = array("I", ids).tobytes()
        if len(word) <= LONGEST:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[word] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        split = _ASCII if chunk.isascii() else _ANY
        found = b"".join([self.word(w) for w in split(chunk)])
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _LOOSE.search(text):
            first, *rest = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
        get = self.__getitem__
        return b"".join([get(first) if first else b"", *[get(" " + w) for w in rest]])

    def encode(self, text: str) -> bytes:
        if self.cut_special is None:
            return self.plain(text)
        parts = self.cut_special.split(text)
        return b"".join([array("I", [self.special[p]]).tobytes() if i % 2 else self.plain(p)
                         for i, p in enumerate(parts)])

    def decode(self, ids: bytes) -> str:
        """As the library decodes: the tokens' bytes as UTF-8, bad bytes replaced."""
        codes = array("I")
        codes.frombytes(ids)
        return b"".join(map(self.content.__getitem__, codes)).decode("utf-8", "replace")


_ASCII, _ANY = re.compile(SPLIT_ASCII).findall, regex.compile(SPLIT).findall
#: A space that can't be cut at: before white space or the end. And one that can.
_LOOSE, _CUT = re.compile(r" (?!\S)"), re.compile(r" (?=\S)")
_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text as unsigned 32-bit integers."""
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer_path).encode
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([to_ids(t) for t in part.column(1).to_pylist()], pa.binary())],
                    schema=arrow)

    return whole(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids`` with ``text``, decoded with special tokens kept."""
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_text = encoder(tokenizer_path).decode
        for batch in batches:
            for part in slices(batch):
                texts = [to_text(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], schema=arrow)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in small pieces, so that a worker holds few texts as Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
