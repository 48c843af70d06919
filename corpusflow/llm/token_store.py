"""Token-id files of independent zstandard frames with a seek table (operator 1).

A shard file holds, in ascending document order, the frames of its documents
(one frame each; a document of over ``FRAME_IDS`` ids has several), a skippable
frame with the document index, and last a skippable frame with the seek table of
the public "seekable format": per frame its compressed size, decompressed size
and the low 32 bits of XXH64 of its content. A reader takes the two tables from
the end of the file, and then reads and decompresses only the frames of the
documents it was asked for.

Spark range-partitions the texts by document id; a task encodes, compresses and
writes one shard, document by document, through pyarrow's file systems, into the
shared folder. A file gets a name of its own per attempt; only those that
finished tasks report are in the manifest, so lost or speculative attempts leave
nothing that is read. The manifest has one row per shard.

Defined cases: a null or empty text has the end id alone; null ids come first,
in a shard's index as null; rows that repeat are stored once each, next to each
other; other columns are not read; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.word_ids import encoder, sorted_texts
from corpusflow.session import materialize, shared_dir

# Fixed values of the public seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

#: Ids in a frame at most: a reader never needs more memory than this for a frame.
FRAME_IDS = 1 << 20
MANIFEST = "shard int, path string, n_docs long, n_tokens long, first_id long, last_id long"


def _file_system(uri: str):
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes one shard to an open stream."""

    def __init__(self, out, level: int):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.seek, self.ids, self.frames, self.n_ids = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        step = 4 * FRAME_IDS
        pieces = [ids[i:i + step] for i in range(0, len(ids), step)] or [b""]
        for piece in pieces:
            frame = self.zstd.compress(piece)
            self.out.write(frame)
            self.seek.append((len(frame), len(piece), xxhash.xxh64_intdigest(piece) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.frames.append(len(pieces))
        self.n_ids += len(ids) // 4

    def close(self) -> None:
        known = np.array([x is not None for x in self.ids], "u1")
        index = self.zstd.compress(struct.pack("<I", len(self.ids)) + known.tobytes()
                                   + np.array([x or 0 for x in self.ids], "<i8").tobytes()
                                   + np.array(self.frames, "<u4").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array(self.seek, "<u4").tobytes() + struct.pack("<IBI", len(self.seek), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, file):
        self.file, size = file, file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        self.seek = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.offset = np.concatenate([[0], np.cumsum(self.seek[:, 0], dtype=np.int64)])
        self.zstd = zstandard.ZstdDecompressor()
        magic, length = struct.unpack("<II", self._at(int(self.offset[-1]), 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index before the seek table")
        index = self.zstd.decompress(self._at(int(self.offset[-1]) + 8, length))
        m, = struct.unpack_from("<I", index)
        self.known = np.frombuffer(index, "u1", m, 4).astype(bool)
        self.ids = np.frombuffer(index, "<i8", m, 4 + m)
        frames = np.frombuffer(index, "<u4", m, 4 + 9 * m)
        self.first = np.concatenate([[0], np.cumsum(frames, dtype=np.int64)])
        sizes = np.concatenate([[0], np.cumsum(self.seek[:, 1], dtype=np.int64)])
        #: Ids of the shard's documents before each document.
        self.start = sizes[self.first[:-1]] // 4

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def document(self, k: int) -> bytes:
        """The ids of the shard's ``k``-th document; only its frames are read."""
        a, b = int(self.first[k]), int(self.first[k + 1])
        data = self._at(int(self.offset[a]), int(self.offset[b] - self.offset[a]))
        out, at = [], 0
        for size, _, check in self.seek[a:b].tolist():
            piece = self.zstd.decompress(data[at:at + size])
            if xxhash.xxh64_intdigest(piece) & 0xFFFFFFFF != check:
                raise ValueError(f"checksum of document {self.ids[k]} differs")
            out.append(piece)
            at += size
        return b"".join(out)


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 1, level: int = 3,
                id_col: str = "doc_id", text_col: str = "text", base: str | None = None) -> DataFrame:
    """Encode all documents into shard files under ``base`` (default: a new folder
    in the shared one); returns the manifest, itself a table there."""
    spark = docs.sparkSession
    base = base or shared_dir(spark, "token-store")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(base)
        shard = TaskContext.get().partitionId()
        name, out, shut = f"{shard:08d}-{uuid.uuid4().hex}.zst", None, None
        encode, first, last = encoder(tokenizer_path).encode, None, None
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        shut = ShardWriter(out, level)
                    shut.add(doc_id, encode(text) + end)
                    first, last = doc_id if first is None else first, doc_id
            if out is not None:
                shut.close()
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(f"{root}/{name}")
            raise
        if out is not None:
            yield pa.RecordBatch.from_pylist([{
                "shard": shard, "path": f"{base}/{name}", "n_docs": len(shut.ids), "n_tokens": shut.n_ids,
                "first_id": first, "last_id": last}], schema=_MANIFEST_ARROW)

    return materialize(sorted_texts(docs, id_col, text_col).mapInArrow(write, MANIFEST), "token-manifest")


_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()),
                             ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def _placed(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids of all shards before each, a task per shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    df = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return df.repartition(max(1, manifest.count()))


def read_store(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """``doc_id, start, ids`` of all documents, or of those in ``wanted`` (a list
    of any size the driver holds): shards without them aren't opened, and other
    frames not read. ``ids`` are little-endian unsigned 32-bit integers, ``start``
    counts the ids of all documents before."""
    schema = "doc_id long, start long, ids binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    picked = None if wanted is None else np.unique(np.array(wanted, "i8"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _file_system(row["path"])
                with fs.open_input_file(path) as file:
                    shard = ShardReader(file)
                    ks = np.arange(len(shard.ids)) if picked is None else \
                        np.flatnonzero(np.isin(shard.ids, picked) & shard.known)
                    rows, size = [], 0
                    for k in ks.tolist():
                        ids = shard.document(k)
                        rows.append({"doc_id": int(shard.ids[k]) if shard.known[k] else None,
                                     "start": row["before"] + int(shard.start[k]), "ids": ids})
                        size += len(ids)
                        if size > 1 << 24 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    df = _placed(manifest)
    if picked is not None:
        df = df.where(F.exists(F.array(*[F.lit(int(x)) for x in picked]) if len(picked) else
                               F.array().cast("array<bigint>"),
                               lambda x: x.between(F.col("first_id"), F.col("last_id"))))
    return df.mapInArrow(load, schema)


def store_corpus(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write a corpus and read it back whole."""
    return read_store(write_store(docs, tokenizer_path))
