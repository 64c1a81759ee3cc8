"""Token ids in files of independent zstandard frames.

A file is a run of frames, each of whole documents' ids (little-endian unsigned 32-bit) with a content checksum; then a
skippable frame with the index (document ids and lengths); then the seek table of the public seekable format: sizes and
an XXH64 checksum for each frame. A reader takes the two tails and decompresses only the frames it needs.

Defined cases: a null text is empty and has the end id alone; null document ids come first and stay null; repeated ids
keep their rows, ordered by text; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import Store, new_folder, partitions, small, table
from tallyloom.llm.tokens import AT_ONCE, encoder, slices, vocabulary

#: Fixed values of the seekable format: skippable frame for the seek table, footer, and a skippable frame of our own.
SEEK_MAGIC, SEEKABLE, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
END = 2
#: Uncompressed bytes after which a frame is closed; a longer document has a frame of its own.
FRAME_BYTES = 1 << 18
#: Stands for a null document id in the index.
NULL_ID = -(1 << 63)


class Writer:
    def __init__(self, out, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.counts: list[int] = []  # documents in each frame
        self.open_docs = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)
        self.open_docs += 1
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.open_docs:
            raw = b"".join(self.held)
            frame = self.pack.compress(raw)
            self.out.write(frame)
            self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.counts.append(self.open_docs)
            self.held, self.size, self.open_docs = [], 0, 0

    def close(self) -> None:
        self.flush()
        index = self.pack.compress(struct.pack("<QQ", len(self.docs), len(self.counts)) + np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes() + np.array(self.counts, "<u8").tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        body = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        # the footer is 9 bytes at the end of the file; before the table stands the index's length, as one more frame
        self.out.write(struct.pack("<III", INDEX_MAGIC + 1, 4, len(index)))
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(body)) + body)


class Reader:
    """Reads the tails of a file; read(k) decompresses what holds the k-th document and nothing else."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - 9)
        n, kind, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE or kind != 0x80:
            raise ValueError("no seek table")
        table_at = size - 9 - 12 * n - 8
        f.seek(table_at)
        head = f.read(8 + 12 * n)
        if struct.unpack("<II", head[:8]) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(head[8:], "<u4").reshape(n, 3).astype(np.int64)
        f.seek(table_at - 12)
        length = struct.unpack("<III", f.read(12))[2]
        f.seek(table_at - 12 - length)
        self.unpack = zstandard.ZstdDecompressor()
        index = self.unpack.decompress(f.read(length))
        docs, frames = struct.unpack("<QQ", index[:16])
        self.docs = np.frombuffer(index, "<i8", docs, 16)
        self.lengths = np.frombuffer(index, "<u8", docs, 16 + 8 * docs).astype(np.int64)
        counts = np.frombuffer(index, "<u8", frames, 16 + 16 * docs).astype(np.int64)
        self.frame_of = np.repeat(np.arange(frames), counts)
        self.first = np.cumsum(counts) - counts
        self.at = np.cumsum(self.frames[:, 0]) - self.frames[:, 0]
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.f.seek(int(self.at[k]))
            raw = self.unpack.decompress(self.f.read(int(self.frames[k, 0])))  # checks the frame's own checksum
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2] or len(raw) != self.frames[k, 1]:
                raise ValueError(f"frame {k} is damaged")
            self.last = k, raw
        return self.last[1]

    def read(self, k: int) -> bytes:
        frame = int(self.frame_of[k])
        at = 4 * int(self.lengths[self.first[frame] : k].sum())
        return self.frame(frame)[at : at + 4 * int(self.lengths[k])]

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        at, held = 0, -1
        for doc, length, frame in zip(self.docs.tolist(), self.lengths.tolist(), self.frame_of.tolist(), strict=True):
            if frame != held:
                at, held = 0, frame
            yield None if doc == NULL_ID else doc, self.frame(frame)[at : at + 4 * length]
            at += 4 * length


def size_of(f) -> int:
    f.seek(0, 2)
    return f.tell()


def write(docs: DataFrame, uri: str, path: str, key: str = "doc_id", text: str = "text") -> list[tuple[int, str, int, int]]:
    """Encodes and writes all rows in ascending order of key; (range, file, documents, ids) for every file.

    A range of the order is a file. Its name depends on the range alone, so a repeated task replaces equal bytes. Ranges
    look at the text's first letters too, so rows without an id, or with one id, are not all in one.
    """
    end = np.array([END], dtype="<u4").tobytes()

    def files(batches):
        part, store, docs_in, ids_in = TaskContext.get().partitionId(), Store(uri), 0, 0
        name, out, made = f"ids-{part:06d}.tokens.zst", None, encoder(path)
        for batch in small(batches):
            if batch.num_rows == 0:
                continue
            if out is None:
                ctx = store.create(name)
                out = Writer(ctx.__enter__())
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, AT_ONCE):
                for k, ids in zip(keys[a:b], made.ids(texts[a:b]), strict=True):
                    out.add(k, ids + end)
                    ids_in += len(ids) // 4 + 1
            docs_in += len(texts)
        if out is not None:
            out.close()
            ctx.__exit__(None, None, None)
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [docs_in], "ids": [ids_in]})

    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(partitions(docs.sparkSession), "k", F.substring("t", 1, 64)).sortWithinPartitions("k", "t")
    return sorted(map(tuple, ordered.mapInArrow(files, "part long, file string, docs long, ids long").collect()))


def read(spark: SparkSession, uri: str, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; a file is a task."""
    starts, total = [], 0
    for _, name, _, ids in files:
        starts.append((name, total))
        total += ids
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def rows(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                name, start = starts[i]
                held: tuple[list, ...] = ([], [], [], [])
                with Store(uri).open(name) as f:
                    for doc, ids in Reader(f, size_of(f)):
                        for column, x in zip(held, (doc, start, len(ids) // 4, zlib.crc32(ids)), strict=True):
                            column.append(x)
                        start += len(ids) // 4
                        if len(held[0]) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], schema=schema)
                            held = ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], schema=schema)

    return spark.range(0, len(starts), 1, max(1, len(starts))).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_folder(spark, "token-store")
    return read(spark, uri, write(table(spark, sf_dir, "documents"), uri, vocabulary()))
