"""Best-fit-decreasing packing of token sequences, planned on lengths and carried out on rows.

Lengths are whole numbers up to the capacity, so the plan needs only how many pieces have each
length: at most `capacity` counts reach the driver, whatever the corpus. Pieces of one length are
placed in runs: the tightest open bins that fit are found in a segment tree over remaining
capacities, and each of them takes as many as fit, which is what placing them one by one does. The
runs are few: a bin range that a run uses up is left with less than half its room, so with D
lengths there are at most D * (3 * log2(capacity) + 1) runs (under 160,000 for 4096), about 6 MB at
most; they are broadcast.

A piece finds its run by its length and its rank among pieces of that length. Ranks come from
buckets of about BUCKET pieces (by a hash of the document), so no length meets in one task.

Edge cases: a null text is empty and has the end token only; repeated rows are packed each; an empty
table gives no rows; a document of exactly the capacity is one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, small_batches
from .tokens import encoder, slices

CAPACITY = 4096
BUCKET = 1000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf is set while bins have that much
    left. first(need): the least capacity of at least `need` that is set, or None."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def put(self, leaf: int, on: bool) -> None:
        k = leaf + self.size
        self.any[k] = on
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def first(self, need: int) -> int | None:
        k = need + self.size
        while not self.any[k]:
            while k & 1:  # a right child: nothing more beside it, go up
                k //= 2
            if k == 0:
                return None
            k += 1
            if k & (k - 1) == 0:  # past the last node of the level
                return None
        while k < self.size:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        return k - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs as columns (length, first rank, pieces in each bin, first bin, offset), by length and rank."""
    tree, open_bins, bins, runs = CapacityTree(capacity), {}, 0, []

    def give(left: int, first: int, n: int) -> None:
        if n and left:
            open_bins.setdefault(left, []).append((first, n))
            tree.put(left, True)

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            left = tree.first(length)
            if left is None:
                n = -(-todo // (capacity // length))
                give(capacity, bins, n)
                bins += n
                continue
            first, n = open_bins[left].pop()
            if not open_bins[left]:
                tree.put(left, False)
            each = left // length
            full = min(n, todo // each)
            if full:
                runs.append((length, rank, each, first, capacity - left))
                give(left - each * length, first, full)
                rank, todo, first, n = rank + full * each, todo - full * each, first + full, n - full
            if n and todo and todo < each:
                runs.append((length, rank, todo, first, capacity - left))
                give(left - todo * length, first, 1)
                rank, todo, first, n = rank + todo, 0, first + 1, n - 1
            give(left, first, n)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The documents' pieces: ids of the text and the end token, cut every `capacity` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in slices(batches, "text"):
            ids, at = enc.column(b.column("text"))
            out: list[list] = [[], [], [], [], []]
            for k, doc in enumerate(b.column("doc_id").to_pylist()):
                own = ids[at[k] : at[k + 1]].tobytes() + end
                for p, start in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[start : start + 4 * capacity]
                    for col, v in zip(out, (doc, p, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (PIECES) with sequence_id and offset. parts must give the same rows each time it is read."""
    spark = parts.sparkSession
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan(counts, capacity))
    deep = {n: -(-c // BUCKET) for n, c in counts.items() if c > BUCKET}
    buckets = F.lit(1)
    if deep:
        buckets = F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for kv in deep.items() for x in kv]), F.col("length").cast("int")), F.lit(1))
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets).cast("long"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        key = (table[:, 0] << 44) + table[:, 1] if len(table) else None
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            _, first, each, bins, offset = table[np.searchsorted(key, (length << 44) + rank, "right") - 1].T
            k = rank - first
            own = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*own, pa.array(bins + k // each), pa.array(offset + k % each * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Documents to packed pieces; the pieces are kept in the shared folder, so ids are made once."""
    return pack(settle(pieces(docs, tokenizer_path, end_id, capacity), "pieces"), capacity)
