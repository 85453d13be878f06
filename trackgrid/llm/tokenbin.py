"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits. Level 0 has the lowest chunk of every
id; a bit beside each chunk says whether the id goes on, and the chunks of
those that do follow in the next level. The number of ones before a bit, its
rank, is where the id goes on; a directory has the rank of every 512th bit, so
any id is found from a few bytes and nothing else is decoded.

One file holds a run of documents in ascending order of their ids. Numbers are
little-endian:

    "DAC1", levels u32, documents u64, ids u64
    document ids i64 each, 1 for a null document id u8 each, ends (ids so far) u64 each
    per level: chunks n u64, chunks u8 each, continuation bits (padded to 64 bits), ranks u64 for every 512 bits
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, text_or_empty, written
from .tokens import tokenizer

MAGIC = b"DAC1"
RANK_BITS = 512
#: Ids of one file, about; a file is held in memory while it is written or read.
FILE_IDS = 1 << 22
MANIFEST = "part int, file int, path string, n_docs long, n_ids long"


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, continuation bits (packed) and ranks of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        padded = np.zeros(-(-len(rest) // RANK_BITS) * RANK_BITS, np.uint8)
        padded[: len(rest)] = more
        ones = padded.reshape(-1, RANK_BITS).sum(1, dtype=np.uint64)
        levels.append(((rest & 0xFF).astype(np.uint8), np.packbits(padded, bitorder="little"), np.cumsum(ones) - ones))
        if not more.any():
            return levels
        rest = rest[more] >> 8


def pack_file(doc_ids: list[int | None], ends: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one file."""
    levels = encode_levels(ids)
    out = [
        MAGIC, np.uint32(len(levels)).tobytes(), np.array([len(doc_ids), len(ids)], "<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array(ends, "<u8").tobytes(),
    ]
    for chunks, bits, ranks in levels:
        out += [np.uint64(len(chunks)).tobytes(), chunks.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
    return b"".join(out)


class TokenFile:
    """Random access to the ids in the bytes of a file."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n_levels = int(np.frombuffer(raw, "<u4", 1, 4)[0])
        n, self.n_ids = (int(x) for x in np.frombuffer(raw, "<u8", 2, 8))
        ids, null = np.frombuffer(raw, "<i8", n, 24), np.frombuffer(raw, np.uint8, n, 24 + 8 * n)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null)]
        self.ends, at, self.levels = np.frombuffer(raw, "<u8", n, 24 + 9 * n), 24 + 17 * n, []
        for _ in range(n_levels):
            size = int(np.frombuffer(raw, "<u8", 1, at)[0])
            blocks = -(-size // RANK_BITS)
            chunks = np.frombuffer(raw, np.uint8, size, at + 8)
            bits = np.frombuffer(raw, np.uint8, blocks * RANK_BITS // 8, at + 8 + size)
            ranks = np.frombuffer(raw, "<u8", blocks, at + 8 + size + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + size + len(bits) + 8 * blocks

    def _rank(self, level: int, at: int) -> int:
        _, bits, ranks = self.levels[level]
        if at >= len(bits) * 8:
            at, extra = len(bits) * 8 - RANK_BITS, RANK_BITS
        else:
            extra = at % RANK_BITS
        first = (at - at % RANK_BITS) // 8
        inside = np.unpackbits(bits[first : first + -(-extra // 8)], bitorder="little")[:extra]
        return int(ranks[at // RANK_BITS]) + int(inside.sum())

    def token(self, i: int) -> int:
        """The id at ``i``."""
        return int(self.tokens(i, i + 1)[0])

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to before ``stop``; only their own chunks are read."""
        value = np.zeros(stop - start, np.uint32)
        goes_on = np.arange(stop - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if not len(goes_on):
                break
            stop = start + len(goes_on)
            value[goes_on] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            first = start // 8
            more = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            start = self._rank(level, start) if more.any() else 0
            goes_on = goes_on[more]
        return value

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of ``docs``, each followed by ``end_id``, below ``path``; returns the files in order.

    Documents are in ascending order of id over all files, null ids first; rows with equal ids are all written,
    ordered by their texts. A null text is empty and has the end id only. Files have whole documents
    and are named by part and number; ``start`` counts the ids of earlier files. A task that
    runs again writes the same bytes; each file is written beside its name and renamed, so none
    is ever seen in part. No rows give no files.
    """
    spark = prepare(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        context, encoder = TaskContext.get(), tokenizer(vocabulary)
        part, file, end = context.partitionId(), 0, np.uint32(end_id).tobytes()
        doc_ids, ends, held = [], [], []

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{file:05d}.dac"
            draft = f"{base}/.{name}-{context.taskAttemptId()}"
            with store.open_output_stream(draft) as f:
                f.write(pack_file(doc_ids, ends, np.frombuffer(b"".join(held), "<u4")))
            store.move(draft, f"{base}/{name}")
            row = {"part": [part], "file": [file], "path": [f"{path}/{name}"], "n_docs": [len(ends)], "n_ids": [ends[-1]]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                held.append(raw + end)
                doc_ids.append(d)
                ends.append((ends[-1] if ends else 0) + len(raw) // 4 + 1)
                if ends[-1] >= file_ids:
                    yield flush()
                    file, doc_ids, ends, held = file + 1, [], [], []
        if ends:
            yield flush()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = written(ordered.mapInArrow(write, MANIFEST), "token-files")
    # One row per file.
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of ``files``: ``doc_id, start, n_tokens, ids_crc32``, and ``ids`` if asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    found = TokenFile(f.read())
                for low in range(0, len(found.doc_ids), 1000):
                    some = range(low, min(low + 1000, len(found.doc_ids)))
                    ids = [found.document(i) for i in some]
                    columns = [
                        pa.array([found.doc_ids[i] for i in some], pa.int64()),
                        pa.array([start + int(found.ends[i]) - len(x) for i, x in zip(some, ids)], pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    tasks = max(1, min(10_000, files.count()))
    return files.select("path", "start").repartition(tasks).mapInArrow(read, schema)
