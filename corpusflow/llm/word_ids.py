"""Token ids of whole texts by the ``tokenizers`` library, chunk by chunk.

The word-level vocabulary drops white space before it splits words, so a text's
ids are those of its space-separated chunks, one after another. Its rule also parts
letters from punctuation and lowers case, so a chunk of letters with punctuation
behind it is a lower-case word and the punctuation. Each worker remembers the ids
of what it has seen; the memory is bounded and only saves time. All ids come from
the library: a lower-case word of Latin letters is one piece that the normalizer
leaves as it is, so it goes straight to the library's BPE model; all else goes through
the whole tokenizer.
"""

from __future__ import annotations

from array import array

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusflow.llm.common import whole

#: Chunks that a worker remembers before it starts anew, and the longest of them.
REMEMBERED, LONGEST = 800_000, 48
#: Punctuation that may stand behind a word; an apostrophe can belong to it.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


# The published byte-level alphabet, as the character that stands for a byte.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = dict(zip((b for b in range(256) if b not in _SHOWN), range(256, 512)))


class ChunkEncoder(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(PUNCTUATION)
        if core.isalpha() and max(core) < "\u0250":  # Latin: lower case by letter
            lower = core.lower()
            if lower.isalpha():
                if lower == chunk:
                    return self._keep(chunk, self._word(chunk))
                return self._keep(chunk, self[lower] + self[chunk[len(core):]] if core != chunk else self[lower])
        return self._keep(chunk, array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes())

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [token.id for token in self.model.tokenize(word)]).tobytes()

    def _keep(self, chunk: str, found: bytes) -> bytes:
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def sorted_texts(docs, id_col: str, text_col: str):
    """Whole texts in ascending id order over range partitions. Equal ids are
    ordered by a hash of the text, so that one id can be in several partitions."""
    df = whole(docs, id_col, text_col).withColumn("_h", F.xxhash64("_text"))
    return df.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h", "_text").select("_id", "_text")
