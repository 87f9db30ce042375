"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared as lower-case letters and digits with one blank for anything else. With
n = min(MIN, item) and e = floor(RATE * n), a document holds a passage of an item where some stretch of n
item characters aligns with at most e edits. What is reported there is the best local alignment (RATE for
each item character, less 1 for each edit) if it covers n item characters or more, else the stretch with
the fewest edits. The parts of the document before and after it are searched again, so every passage
that overlaps no better one of its item is reported.

Filter. Such a stretch shares at least n + 1 - Q * (e + 1) of its q-grams, on e + 1 neighbouring
diagonals (e is less where that would be under 1: items of 13 to 15 characters must be there without
edits). Shared q-grams are counted in diagonal bands that overlap by half, each wide enough that some
band holds them all; regions that reach the bound are kept, so the filter loses nothing. Neighbouring
bands make one region of at most SPAN diagonals. Verification. In each kept region the local alignment is
found within the band, or else the stretch; a run that matches a whole item needs no table.

Items over PIECE characters are looked up in pieces that overlap by MIN; a passage that runs through
several gives a row for each. Documents are scanned in a narrow map against an index of the items, once for
each block of at most BLOCK characters, whose index is broadcast: its size is bounded by the parameter,
whatever the items. Shared q-grams of a text are held LIMIT at a time, by stretches of the text and, where
one q-gram stands in very many items, by ranges of items.

Edge cases: null and empty texts hold no passage; items with fewer than Q letters, digits and single
blanks are too short to be evidence; repeated rows and items each give rows; an empty table on either
side gives none.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import slices

Q, MIN, BLOCK = 8, 48, 4 << 20
#: Characters of an item looked up together; diagonals of a region; shared q-grams held at a time.
PIECE, SPAN, LIMIT = 4096, 256, 1 << 21
#: Edits for each character, as a fraction: GAIN / COST.
GAIN, COST = 2, 25
#: Diagonals of a band (half of it is more than the edits of a stretch); diagonals on either side for alignments.
WIDTH, SLACK = 8, 32
HITS = "doc_id long, item_id long, doc_start long, doc_end long, item_start int, item_end int, item_chars int, edits int"
_TABLE = 0x3000


@functools.cache
def _codes() -> np.ndarray:
    """Code point -> lower-case letter or digit, 0 for anything else."""
    return np.array([_code(c) for c in range(_TABLE)], np.uint32)


def _code(c: int) -> int:
    return ord(chr(c).lower()[0]) if chr(c).isalnum() else 0


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(characters as compared, place of each in the text)."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    code = _codes()[np.minimum(raw, _TABLE - 1)]
    if (high := raw >= _TABLE).any():
        seen, place = np.unique(raw[high], return_inverse=True)
        code[high] = np.array([_code(c) for c in seen.tolist()], np.uint32)[place]
    word = code != 0
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first of what stands between words
    at = np.flatnonzero(keep)
    out = code[at]
    if len(out) and not out[-1]:
        at, out = at[:-1], out[:-1]
    out[out == 0] = 32
    return out, at


def grams(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each q-gram (Q = 8)."""
    h, by = codes.astype(np.uint32), 0x9E3779B1
    for step in (1, 2, 4):
        h = h[:-step] * np.uint32(by) + h[step:] if len(h) > step else h[:0]
        by = by * by & 0xFFFFFFFF
        h = h ^ (h >> np.uint32(15))
    return h * np.uint32(0x85EBCA6B)


class Index:
    """Q-grams of a block of item pieces (item_id, characters of the whole item, place in it, codes)."""

    def __init__(self, pieces: list[tuple[int, int, int, np.ndarray]]):
        self.ids, self.sizes, self.starts, self.items = ([p[k] for p in pieces] for k in range(4))
        length = np.array([len(c) for c in self.items], np.int64).reshape(-1)
        n = np.minimum(MIN, length)
        e = np.minimum(n * GAIN // COST, n // Q - 1)
        self.least, self.edits, self.need, self.reach = n, e, n + 1 - Q * (e + 1), n + e - Q
        self.margin = int((length + e).max(initial=0))
        all_grams = [grams(c) for c in self.items]
        flat = np.concatenate(all_grams) if pieces else np.zeros(0, np.uint32)
        order = np.argsort(flat, kind="stable")
        self.gram, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        item = np.repeat(np.arange(len(pieces)), [len(g) for g in all_grams])[order] if pieces else flat.astype(np.int64)
        # postings by q-gram and item: the entries of a q-gram in a range of items lie together
        self.posting = np.repeat(np.arange(len(self.gram)), self.count) * len(pieces) + item
        self.place = (np.concatenate([np.arange(len(g)) for g in all_grams])[order] if pieces else flat).astype(np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[flat >> np.uint32(12)] = True

    def passages(self, text: str | None) -> Iterator[tuple]:
        """(item_id, doc_start, doc_end, item_start, item_end, item_chars, edits); places in the text are
        code points, those in the item count characters as compared."""
        if not text or not len(self.gram):
            return
        doc, at = normal(text)
        h = grams(doc)
        i = np.flatnonzero(self.maybe[h >> np.uint32(12)])
        k = np.searchsorted(self.gram, h[i])
        ok = self.gram[np.minimum(k, len(self.gram) - 1)] == h[i]
        i, k = i[ok], k[ok]
        taken: dict[int, list[tuple[int, int]]] = {}
        for lo, hi, first, last in self._groups(i, k):
            for item, a, b, x, y, edits in self._found(doc, i[lo:hi], k[lo:hi], first, last, taken):
                yield (self.ids[item], int(at[x]), int(at[y - 1]) + 1, self.starts[item] + a, self.starts[item] + b, self.sizes[item], edits)

    def _entries(self, k: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of q-grams k in items first..last - 1 begin and how many they are."""
        if last - first == len(self.items):
            return self.first[k], self.count[k]
        begin = np.searchsorted(self.posting, k * len(self.items) + first)
        return begin, np.searchsorted(self.posting, k * len(self.items) + last) - begin

    def _groups(self, i: np.ndarray, k: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Ranges (of shared places, of items) with at most LIMIT postings each, or as few as a passage needs."""
        todo = [(0, len(i), 0, len(self.items))]
        while todo:
            lo, hi, first, last = todo.pop()
            if hi - lo < self.need[first:last].min():
                continue
            if self._entries(k[lo:hi], first, last)[1].sum() > LIMIT:
                one = int(self.least[first] + self.edits[first])
                for enough, margin in ((True, self.margin), (last - first == 1, one)):
                    # cut in two that share a margin; each must be shorter than the whole
                    middle = i[(lo + hi) // 2]
                    cut, back = lo + np.searchsorted(i[lo:hi], middle + margin, "right"), lo + np.searchsorted(i[lo:hi], middle - margin)
                    if enough and cut < hi and back > lo:
                        todo += [(int(back), hi, first, last), (lo, int(cut), first, last)]
                        break
                else:
                    if last - first == 1:
                        yield lo, hi, first, last
                    else:
                        half = (first + last) // 2
                        todo += [(lo, hi, half, last), (lo, hi, first, half)]
                continue
            yield lo, hi, first, last

    def _found(self, doc: np.ndarray, i: np.ndarray, k: np.ndarray, first: int, last: int, taken: dict) -> Iterator[tuple]:
        begin, n = self._entries(k, first, last)
        entry = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, place, i = self.posting[entry] - np.repeat(k, n) * len(self.items), self.place[entry], np.repeat(i, n)
        enough = np.flatnonzero((np.bincount(item, minlength=len(self.items)) >= self.need)[item])
        if not len(enough):
            return
        item, i, diagonal = item[enough], i[enough], i[enough] - place[enough]
        order = np.lexsort((diagonal, item))
        item, i, diagonal = item[order], i[order], diagonal[order]
        for it, lo, hi in self._regions(i, item, diagonal):
            a, b = np.searchsorted(item, it), np.searchsorted(item, it, "right")
            a, b = a + np.searchsorted(diagonal[a:b], lo), a + np.searchsorted(diagonal[a:b], hi, "right")
            spots, codes, spans = np.sort(i[a:b]), self.items[it], taken.setdefault(it, [])
            around = int(self.least[it] + self.edits[it])
            todo = [(max(0, int(spots[0]) - around), min(len(doc), int(spots[-1]) + Q + around))]
            for x, y in spans[max(0, bisect.bisect(spans, todo[0]) - 1) :]:  # what has been reported is left out
                u, v = todo[-1]
                if x >= v:
                    break
                if y > u:
                    todo[-1:] = [(u, x), (y, v)]
            while todo:
                x, y = todo.pop()
                if np.searchsorted(spots, y - Q, "right") - np.searchsorted(spots, x) < self.need[it]:
                    continue
                found = align(codes, doc, lo, hi, x, y, int(self.least[it]), int(self.edits[it]))
                if found:
                    bisect.insort(spans, (found[2], found[3]))
                    todo += [(found[3], y), (x, found[2])]
                    yield (it, *found)

    def _regions(self, i: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, least and greatest diagonal) of regions with enough shared q-grams."""
        found = []
        for shift in (0, WIDTH // 2):  # two grids of bands, half a band apart
            band = (diagonal + shift) // WIDTH
            order = np.lexsort((i, band, item))
            o_item, o_band, o_i = item[order], band[order], i[order]
            once = np.append(True, (np.diff(o_item) != 0) | (np.diff(o_band) != 0) | (np.diff(o_i) != 0))
            order, o_item, o_band, o_i = order[once], o_item[once], o_band[once], o_i[once]  # a place counts once
            last = np.arange(len(order)) + self.need[o_item] - 1
            inside = last < len(order)
            last = np.minimum(last, len(order) - 1)
            ok = inside & (o_item[last] == o_item) & (o_band[last] == o_band) & (o_i[last] - o_i <= self.reach[o_item])
            found.append(np.stack([o_item[ok], o_band[ok] * WIDTH - shift], 1))
        spans = np.unique(np.concatenate(found), axis=0)
        out: list[list[int]] = []
        for it, d in spans.tolist():  # neighbouring bands of an item are one region, up to SPAN
            if out and out[-1][0] == it and d <= out[-1][2] + 1 and d + WIDTH <= out[-1][1] + SPAN:
                out[-1][2] = d + WIDTH - 1
            else:
                out.append([it, d, d + WIDTH - 1])
        return [tuple(x) for x in out]


def align(item: np.ndarray, doc: np.ndarray, lo: int, hi: int, first: int, last: int, n: int, most: int, slack: int = SLACK) -> tuple | None:
    """A passage in doc[first:last] on diagonals lo - slack..hi + slack (document place less item place):
    (item start, end, document start, end, edits), if there is a stretch of n item characters with `most`
    edits. It is the best local alignment (GAIN for each item character, -COST for each edit; of equal scores
    the one that ends first in the item, then in the document) if that covers n item characters; else the
    stretch with the fewest edits."""
    m, near = len(item), (lo, hi)
    for d in range(max(lo, first), min(hi, last - m) + 1):  # a whole item without edits
        if doc[d] == item[0] and np.array_equal(doc[d : d + m], item):
            return 0, m, d, d + m, 0
    least = stretch(item, doc[:last], *near, first, n, most)
    if not least:
        return None
    lo, hi = max(lo - slack, first - m + 1), min(hi + slack, last - 1)
    width = hi - lo + 1
    if max(m, width + m) >= 1 << 20:
        raise ValueError("an item or a region is too long to align")
    pad = np.full(width + m, 0xFFFFFFFF, np.uint32)  # what lies outside matches nothing
    a, b = max(first, lo), min(last, lo + width + m)
    pad[a - lo : b - lo] = doc[a:b]
    cols = np.arange(width)
    # score << 40 | item start << 20 | document start (relative to lo): one maximum carries all three
    one, best, where = 1 << 40, -1, None
    row = np.full(width, -(1 << 60), np.int64)
    drift = cols * (COST * one)
    for p in range(m):
        gap = np.append(row[1:], -(1 << 60)) + (GAIN - COST) * one
        fresh = (p << 20) + (p + cols)
        step = np.maximum(row, fresh) + np.where(pad[p : p + width] == item[p], GAIN, GAIN - COST) * one
        row = np.maximum(gap, step)
        row = np.maximum.accumulate(row + drift) - drift
        k = int(np.argmax(row >> 40))
        if row[k] >> 40 > best:
            best, where = int(row[k] >> 40), (int(row[k]), p, k)
    value, p, k = where
    a, x = value >> 20 & 0xFFFFF, (value & 0xFFFFF) + lo
    edits = (GAIN * (p + 1 - a) - best) // COST
    if p + 1 - a < n or m < MIN and edits > most:
        return least
    return a, p + 1, x, p + lo + k + 1, edits


def stretch(item: np.ndarray, doc: np.ndarray, lo: int, hi: int, first: int, n: int, most: int) -> tuple | None:
    """Of all stretches of n item characters the first with the fewest edits, if these are `most` at most,
    in the document from `first` on and on diagonals lo - most..hi + most: (item start, end, document start,
    end, edits)."""
    run, seeds = n // (most + 1), []  # of most + 1 parts of a stretch one is without edits
    for d in range(max(lo, first - len(item)), min(hi, len(doc)) + 1):
        a, b = max(0, first - d), min(len(item), len(doc) - d)
        if b - a >= run:
            same = np.append(0, np.cumsum(item[a:b] == doc[a + d : b + d]))
            clean = np.flatnonzero(same[run:] - same[:-run] == run)
            seeds += [(d, a + int(k)) for k in (clean[0], clean[-1])] if len(clean) else []
    if not seeds:
        return None
    lo, hi = min(d for d, _ in seeds) - most, max(d for d, _ in seeds) + most
    from_, to = max(0, min(k for _, k in seeds) + run - n), min(len(item) - n, max(k for _, k in seeds))
    cols, best = np.arange(hi - lo + 1), None
    one = 1 << 20
    for some in range(from_, to + 1, 1024):  # edits << 20 | first diagonal, a row for each stretch
        starts = np.arange(some, min(some + 1024, to + 1))
        cost = np.repeat(cols[None], len(starts), 0)
        for p in range(n):
            place = (starts + p + lo)[:, None] + cols
            inside = (place >= first) & (place < len(doc))
            same = inside & (doc[np.clip(place, 0, len(doc) - 1)] == item[starts + p][:, None])
            step = cost + np.where(same, 0, one)
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + one)
            cost = np.minimum.accumulate(step - cols * one, axis=1) + cols * one
        w, c = np.unravel_index(np.argmin(cost), cost.shape)
        if cost[w, c] >> 20 <= most and (best is None or cost[w, c] >> 20 < best[4]):
            a, value = int(starts[w]), int(cost[w, c])
            x, y = a + lo + (value & one - 1), a + n + lo + int(c)
            best = a, a + n, max(x, first), min(y, len(doc)), value >> 20
    return best


# ---------------------------------------------------------------- over tables


def pieces_of(item_id: int, text: str | None) -> list[tuple[int, int, int, np.ndarray]]:
    """An item as pieces of at most PIECE characters, each MIN characters into the one before."""
    codes = normal(text)[0] if text else np.zeros(0, np.uint32)
    n = len(codes)
    return [(item_id, n, k, codes[k : k + PIECE]) for k in range(0, max(1, n - MIN), PIECE - MIN)] if n >= Q else []


def blocks(items: DataFrame, limit: int = BLOCK) -> list:
    """Broadcast indexes of the items (item_id, text), each of `limit` characters and one piece at most.
    The driver reads the items a partition at a time."""
    context, out, held, size = items.sparkSession.sparkContext, [], [], 0
    for item_id, text in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        for piece in pieces_of(item_id, text):
            held.append(piece)
            size += len(piece[3])
            if size >= limit:
                out.append(context.broadcast(Index(held)))
                held, size = [], 0
    return [*out, context.broadcast(Index(held))] if held or not out else out


def passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row of HITS for each passage of an item in a document."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    small_batches(docs.sparkSession)
    for index in blocks(items):
        found = chosen.mapInArrow(_finder(index), HITS)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(index):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        names = [x.split()[0] for x in HITS.split(", ")]
        for b in slices(batches, "text"):
            rows = [(doc, *p) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for p in index.value.passages(text)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return find


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no passage of any item, with their own columns."""
    small_batches(docs.sparkSession)
    for index in blocks(items):
        docs = docs.mapInArrow(_keeper(index), docs.schema)
    return docs


def _keeper(index):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            free = [next(index.value.passages(t), None) is None for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(free, pa.bool_()))

    return keep
