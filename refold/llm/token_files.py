"""Token ids in Arrow stream files with fixed-size-list batches.

A set of files holds the corpus in the order of doc_id. Each file has record batches of `rows`
sequences of `length` ids: `ids` fixed_size_list<uint16 or uint32>[length], the narrower if all ids of
the vocabulary fit, and `mask` fixed_size_list<bool>[length], true where an id counts. A file's ids are one run without gaps; only its last sequence is
filled up, under mask false. All values lie in one buffer per column, so sequence k of a file is a slice
of batch k // rows: a reader that maps the file copies nothing. A second file beside it lists its
documents (doc_id, start in the file, n_tokens).

Writing: one range shuffle by doc_id (ties by a hash of the text), then each task sorts, encodes and
writes its own file, a batch at a time. The driver sees one row for each file. A lost task writes
its files again under the same names.

Edge cases: null texts have the end id only; null doc_ids come first; repeated rows are written
each; an empty table gives an empty set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for
from .store import reading, replacing
from .tokens import encoder, slices

LENGTH, ROWS = 2048, 64
FILES = "part int, n_docs long, n_tokens long, n_sequences long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(length: int, width: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(width), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Gathers ids and writes full batches of one file."""

    def __init__(self, sink, length: int, rows: int, width: np.dtype):
        self.schema, self.length, self.size, self.width = _schema(length, width), length, length * rows, width
        self.out, self.held, self.n, self.total = pa.ipc.new_stream(sink, self.schema), [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= self.size:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.size * self.size
            for at in range(0, whole, self.size):
                self._batch(flat[at : at + self.size], np.ones(self.size, bool))
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.n:
            flat, room = np.concatenate(self.held), -self.n % self.length
            self._batch(np.pad(flat, (0, room)), np.pad(np.ones(self.n, bool), (0, room)))
        self.out.close()

    def _batch(self, ids: np.ndarray, mask: np.ndarray) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids.astype(self.width, copy=False), mask)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, length: int = LENGTH, rows: int = ROWS) -> list:
    """Encodes docs (doc_id, text) into files under path; returns a row of FILES for each file."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, at, index = TaskContext.get().partitionId(), encoder(tokenizer_path), 0, []
        with replacing(path, f"part-{part:06d}.arrow") as sink:
            out = _Writer(sink, length, rows, np.dtype(np.uint16 if max(enc.top, end_id) < 1 << 16 else np.uint32))
            for b in slices(batches, "text"):
                ids, edge = enc.column(b.column("text"))
                ids, n = np.insert(ids, edge[1:], end_id), np.diff(edge) + 1
                out.add(ids)
                index.append(pa.record_batch([b.column("doc_id"), pa.array(at + np.cumsum(n) - n), pa.array(n)], schema=DOCS))
                at += len(ids)
            out.close()
        with replacing(path, f"part-{part:06d}.docs") as sink, pa.ipc.new_stream(sink, DOCS) as listing:
            for b in index:
                listing.write_batch(b)
        yield pa.record_batch([pa.array([part], pa.int32()), *(pa.array([x]) for x in (sum(b.num_rows for b in index), at, -(-at // length)))], names=["part", "n_docs", "n_tokens", "n_sequences"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = chosen.repartitionByRange(parts_for(docs), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    return sorted(dealt.mapInArrow(encode, FILES).collect(), key=lambda r: r.part)


def batches_of(path: str, part: int) -> list[pa.RecordBatch]:
    """The batches of a file; on a local disk they are views of the mapped file."""
    return list(pa.ipc.open_stream(reading(path, f"part-{part:06d}.arrow")))


def sequence(batches: list[pa.RecordBatch], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of sequence k of a file; the ids are a view of it, not a copy."""
    rows = batches[0].num_rows
    ids, mask = (c.slice(k % rows, 1).flatten() for c in batches[k // rows].columns)
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def read_documents(spark, path: str, files: list) -> DataFrame:
    """doc_id, start in the whole set, n_tokens, and the crc32 of the ids, read from the files. Ids
    under mask false never count."""
    before, rows = 0, []
    for f in files:
        if f.n_docs:
            rows.append((f.part, before))
        before += f.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base in zip(*(b.column(c).to_pylist() for c in ("part", "base")), strict=True):
                yield from _documents(path, part, base)

    source = spark.createDataFrame(rows, "part int, base long").repartition(max(1, len(rows)))
    return source.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(path: str, part: int, base: int) -> Iterator[pa.RecordBatch]:
    held, at = np.zeros(0, np.uint32), 0  # ids from place `at` of the file on
    source = iter(pa.ipc.open_stream(reading(path, f"part-{part:06d}.arrow")))
    for docs in pa.ipc.open_stream(reading(path, f"part-{part:06d}.docs")):
        start, n = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
        crc = np.zeros(len(n), np.int64)
        for k, (s, size) in enumerate(zip(start.tolist(), n.tolist(), strict=True)):
            while at + len(held) < s + size:
                b = next(source)
                ids, mask = (c.flatten().to_numpy(zero_copy_only=False) for c in b.columns)
                held, at = np.concatenate([held[max(0, s - at) :], ids[mask].astype(np.uint32)]), max(s, at)
            crc[k] = zlib.crc32(held[s - at : s - at + size].tobytes())
        yield pa.record_batch([docs.column("doc_id"), pa.array(start + base), docs.column("n_tokens"), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
