"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints. Each shingle's XXH64 votes on 64 bits. Documents are first reduced to their distinct
fingerprints, so a group of exact copies counts once from here on.

Upper nodes. A node is a masked bit pattern: which bits are fixed, and to what. Two fingerprints that
differ in at most DISTANCE bits agree on at least one of DISTANCE + 1 disjoint parts of the free
bits, so each fingerprint goes to that many nodes, and every link lies inside some node. A node that
holds more than NODE fingerprints is divided again by the same rule over its remaining free bits; at
FREE or fewer free bits a node cannot hold more than NODE. So no task gathers more than that, whatever
the data. Nodes with an outsized share of the rows are known from a count before any is dealt (there
are at most SHARE of them) and are divided at once; the others are found too large while streaming.

Lower nodes. Inside a node the fingerprints are sorted by Gray rank, so neighbours share bits, and
runs of FAN make the next level up: bits on which a run agrees are its mask and pattern. Two runs
are compared on the bits both have fixed; what differs is added to what their parents differed in,
and the whole pair of groups is pruned once that exceeds DISTANCE.

Links. A node gives a forest of its near pairs (at most NODE - 1 links), closest first. Components
of distinct fingerprints are then found by alternating large-star and small-star steps on tables in
the shared folder, and each document gets the smallest doc_id of its component.

Edge cases: texts without words (null, blank) have fingerprint zero and link like any other; fewer
words than a shingle make one shingle; repeated rows get a row each; null doc_ids get the smallest
doc_id of their component, null if it has none; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, small_batches
from .tokens import slices

DISTANCE, SHINGLE, SEED = 2, 3, 42
NODE, FREE, SHARE, FAN = 2048, 11, 256, 8
#: Pairs of index nodes compared at once.
FRONTIER = 1 << 19


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode().lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return int(np.uint64(digest(line, SEED)).astype(np.int64))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(size) - 1
    start = stop - size + 1
    spans = zip(start[: len(words) - width + 1].tolist(), stop[width - 1 :].tolist(), strict=True)
    h = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp for each document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, "doc_id long, fp long")


# ---------------------------------------------------------------- upper nodes


def _parts(mask: int) -> list[int]:
    """The masks below a mask: each fixes one of DISTANCE + 1 parts of its free bits as well."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // (DISTANCE + 1) for k in range(DISTANCE + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _levels() -> list[list[int]]:
    """The masks of each level, down to nodes that can't hold more than NODE."""
    levels = [_parts(0)]
    while 64 - min(m.bit_count() for m in levels[-1]) > FREE:
        levels.append([n for m in levels[-1] if 64 - m.bit_count() > FREE for n in _parts(m)])
    return levels


_BELOW = {m: _parts(m) for level in [[0], *_levels()] for m in level if 64 - m.bit_count() > FREE}


def _descend(rows: DataFrame) -> DataFrame:
    """Rows (kind, fp, mask) to their nodes one level down (kind, fp, mask, bits)."""
    table = F.create_map(*[x for m, ns in _BELOW.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(n)) for n in ns]))])
    down = rows.select("kind", "fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
    return down.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))


def links(fps: DataFrame) -> DataFrame:
    """Links (kind, a, b) among the distinct fingerprints (kind, fp) of each kind, each within DISTANCE: in
    every node a forest, so that the links' components are those of all pairs within DISTANCE."""
    level, found = fps.select("kind", "fp", F.lit(0).cast("long").alias("mask")), []
    for _ in _levels():
        rows = _descend(level)
        total = rows.count()
        if not total:
            break
        outsized = rows.groupBy("kind", "mask", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(NODE, total // SHARE)).collect()
        big = F.lit(False)
        if outsized:  # at most SHARE nodes
            keys = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.mask).alias("mask"), F.lit(r.bits).alias("bits")) for r in outsized])
            big = F.array_contains(keys, F.struct("kind", "mask", "bits"))
        dealt = rows.where(~big).repartition("kind", "mask", "bits").sortWithinPartitions("kind", "mask", "bits")
        out = settle(dealt.mapInArrow(_search, "kind int, a long, b long, mask long"), "links")
        found.append(out.where(F.col("mask").isNull()).select("kind", "a", "b"))
        level = out.where(F.col("mask").isNotNull()).select("kind", F.col("a").alias("fp"), "mask")
        if outsized:
            level = level.unionByName(rows.where(big).select("kind", "fp", "mask"))
    union = found[0] if found else fps.select("kind", F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    for f in found[1:]:
        union = union.unionByName(f)
    return union.distinct()


# ---------------------------------------------------------------- lower nodes


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, fp, mask, bits), sorted by node, to links (kind, a, b, null), and members of nodes too
    large to search here as (kind, fp, null, mask). Holds a batch and NODE fingerprints at most."""
    tail: tuple | None = None  # node and members so far of the last node of the batch before
    spilling = None  # node that has been found too large
    for b in batches:
        kind, fp, mask, bits = (b.column(c).to_numpy() for c in ("kind", "fp", "mask", "bits"))
        if not len(fp):
            continue
        edge = np.flatnonzero((kind[1:] != kind[:-1]) | (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])) + 1
        lo, hi = np.concatenate([[0], edge]), np.append(edge, len(fp))
        done, over = [], []

        def close(node, members, done=done):
            if len(members) > 1:
                done.append((node, members))

        # only the first and the last node of a batch can reach beyond it
        singles = hi - lo == 1
        singles[[0, -1]] = False
        for x, y in zip(lo[~singles].tolist(), hi[~singles].tolist(), strict=True):
            node, own = (int(kind[x]), int(mask[x]), int(bits[x])), fp[x:y]
            if tail is not None:
                if tail[0] == node:
                    own = np.concatenate([tail[1], own])
                else:
                    close(*tail)
                tail = None
            if spilling == node or len(own) > NODE:
                spilling = node
                over.append((node, own))
            elif y == len(fp):
                tail = (node, own)
            else:
                close(node, own)
        yield from _answer(done, over)
    if tail is not None and len(tail[1]) > 1:
        yield from _answer([tail], [])


def _answer(done: list, over: list) -> Iterator[pa.RecordBatch]:
    names = ["kind", "a", "b", "mask"]
    repeated = lambda nodes, k, n: pa.array(np.repeat([x[0][k] for x in nodes], n))
    if over:
        n = [len(m) for _, m in over]
        yield pa.record_batch([repeated(over, 0, n).cast(pa.int32()), pa.array(np.concatenate([m for _, m in over])), pa.nulls(sum(n), pa.int64()), repeated(over, 1, n)], names=names)
    if done:
        a, b, group = forest(np.concatenate([m for _, m in done]), np.array([len(m) for _, m in done]))
        kinds = np.array([x[0][0] for x in done], np.int32)[group]
        yield pa.record_batch([pa.array(kinds), pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=names)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def near_pairs(codes: np.ndarray, sizes: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of codes within `distance`, inside groups of the given sizes; codes are sorted by
    Gray rank within each group. i = j is included."""
    levels = [(codes, np.full(len(codes), ~np.uint64(0)), np.arange(len(codes)), np.ones(len(codes), np.int64))]
    count = sizes.astype(np.int64)
    while count.max(initial=0) > 1:  # runs of FAN nodes of a group make a node above
        above = -(-count // FAN)
        begin = np.repeat(np.cumsum(count) - count, above) + FAN * (np.arange(above.sum()) - np.repeat(np.cumsum(above) - above, above))
        stop = np.minimum(begin + FAN, np.repeat(np.cumsum(count), above))
        value, mask, _, _ = levels[-1]
        same = np.bitwise_and.reduceat(mask, begin) & ~(np.bitwise_or.reduceat(value, begin) ^ np.bitwise_and.reduceat(value, begin))
        levels.append((np.bitwise_and.reduceat(value, begin) & same, same, begin, stop - begin))
        count = above
    roots = np.arange(len(sizes))
    stack = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.uint64), np.zeros(len(roots), np.uint8))]
    while stack:
        depth, i, j, seen, gone = stack.pop()
        if depth == 0:
            yield i, j
            continue
        _, _, child, n = levels[depth]
        value, mask, _, _ = levels[depth - 1]
        pairs = n[i] * n[j]
        for a, z in _chunks(pairs):
            k = np.repeat(np.arange(a, z), pairs[a:z])
            r = np.arange(len(k)) - np.repeat(np.cumsum(pairs[a:z]) - pairs[a:z], pairs[a:z])
            x, y = child[i[k]] + r // n[j[k]], child[j[k]] + r % n[j[k]]
            ok = (i[k] != j[k]) | (x <= y)
            k, x, y = k[ok], x[ok], y[ok]
            both = mask[x] & mask[y]
            new = gone[k] + np.bitwise_count((value[x] ^ value[y]) & both & ~seen[k])
            ok = new <= distance
            if ok.any():
                stack.append((depth - 1, x[ok], y[ok], both[ok], new[ok]))


def _chunks(pairs: np.ndarray) -> Iterator[tuple[int, int]]:
    group = (np.cumsum(pairs) - pairs) // FRONTIER
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(pairs)]
    return ((a, z) for a, z in zip(edges, edges[1:], strict=False) if z > a)


def forest(fp: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Near pairs (a, b, group) that connect in each group what all its near pairs connect, without
    cycles and the closest first."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    codes = fp.view(np.uint64)
    order = np.lexsort((gray_rank(codes), group))
    codes, signed = codes[order], fp[order]
    pairs = [(i[i != j], j[i != j]) for i, j in near_pairs(codes, sizes)]
    i, j = (np.concatenate([p[s] for p in pairs]) if pairs else np.zeros(0, np.int64) for s in (0, 1))
    label, kept_i, kept_j = np.arange(len(codes)), [], []
    apart = np.bitwise_count(codes[i] ^ codes[j])
    for d in range(DISTANCE + 1):
        x, y = i[apart == d], j[apart == d]
        while len(x):
            high, low = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
            open_ = high != low
            x, y, high, low = x[open_], y[open_], high[open_], low[open_]
            root, at = np.unique(high, return_index=True)  # each root is hooked to a smaller one, once
            kept_i.append(x[at])
            kept_j.append(y[at])
            label[root] = low[at]
            while (label[label] != label).any():
                label = label[label]
    x, y = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (kept_i, kept_j))
    return signed[x], signed[y], group[x]


# ---------------------------------------------------------------- components


def components(pairs: DataFrame) -> DataFrame:
    """node, root (its component's least node) for every node of the links (a, b)."""
    edges = settle(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = settle(small.where("u <> v").distinct(), "edges")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return (r.n, r.h)


def cluster(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for each document."""
    own = settle(fingerprints(docs, width), "fingerprints")
    least = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least.withColumn("kind", F.lit(0))))
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = settle(named.join(smallest, "root").select("fp", "component_id"), "named")
    return own.join(by_fp, "fp")


# ---------------------------------------------------------------- near copies by checked similarity

#: Similarity of near copies: the Jaccard coefficient of their sets of five-word shingles.
SIMILARITY, CHECKED = 0.8, 5
#: Least bytes of long words, for one fingerprint each, and how many of them a text must have.
LONG, ENOUGH = (7, 9, 10, 12), 5


def telling(text: str | None) -> list[int]:
    """Fingerprints of a text: of its shingles, and of its distinct words of each length in LONG, which
    few edits change; where it has few of these, the shingles' again."""
    from xxhash import xxh64_intdigest as digest

    own = {w for w in (text or "").encode().lower().split() if len(w) >= LONG[0]}
    size = np.fromiter(map(len, own), np.int64, len(own))
    h = np.fromiter((digest(w, SEED) for w in own), np.uint64, len(own))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = [fingerprint(text)]
    for least in LONG:
        chosen = bits[size >= least]
        out.append(int(np.packbits(2 * chosen.sum(0, dtype=np.int64) > len(chosen), bitorder="little").view(np.int64)[0]) if len(chosen) >= ENOUGH else out[0])
    return out


def shingle_set(text: str | None, width: int = CHECKED) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode().lower().split()
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + width])) for k in range(n)), np.uint64, n))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


ROWS = "row long, doc long, same string, fps array<long>"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh128_hexdigest

    for b in slices(batches, "text"):
        texts = b.column("text").to_pylist()
        same = [xxh128_hexdigest(b" ".join((t or "").encode().lower().split())) for t in texts]
        yield pa.record_batch([b.column("row"), b.column("doc"), pa.array(same), pa.array([telling(t) for t in texts], pa.list_(pa.int64()))], names=["row", "doc", "same", "fps"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = functools.lru_cache(16)(shingle_set)
    for b in batches:
        keep = [similarity(known(x), known(y)) >= SIMILARITY for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


#: One in so many texts has its shingles counted to tell common shingles; the most of these that are kept.
SAMPLE, COMMON = 8, 1 << 20
#: Texts that take part in a check are first sifted by a hash of their row, to so many values.
SIEVE = 1 << 20
SHARED = "sh long, at long, row long, root long"
#: Before all pairs are checked, groups of near copies are connected by pairs drawn in so many turns: of a
#: row that a shingle would pair with MANY others, DRAWS are drawn for that shingle and PARTNERS kept in the first
#: turn, twice as many in each next one, as fewer rows are left.
TURNS, MANY, DRAWS, PARTNERS = 4, 16, 32, 8


def _overlap(sizes: np.ndarray) -> np.ndarray:
    """Shingles that two sets of so many in all must share to be similar (with some room for rounding)."""
    return SIMILARITY / (1 + SIMILARITY) * sizes - 1e-6


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a set's shingles, rare ones first; of similar sets these always share one."""
    names, counts = common
    k = np.minimum(np.searchsorted(names, shingles), max(len(names) - 1, 0))
    often = np.where(names[k] == shingles, counts[k], 0) if len(names) else np.zeros(len(shingles), np.int64)
    n = len(shingles)
    return shingles[np.lexsort((shingles, often))][: n - int(np.ceil(SIMILARITY * n - 1e-6)) + 1]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        sets = [shingle_set(t) for t in b.column("text").to_pylist()]
        if sets:
            sh, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.record_batch([pa.array(sh.view(np.int64)), pa.array(n)], names=["sh", "n"])


def _common(texts: DataFrame):
    """Broadcast (shingles, counts) of shingles that several texts of a sample hold. It sets an order only:
    which texts are found doesn't hang on it."""
    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_counted, "sh long, n long")
    counts = settle(some.groupBy("sh").agg(F.sum("n").alias("n")).where("n > 1"), "common")
    held = F.least("n", F.lit(1 << 16)).alias("n")
    # the least count from which on there are COMMON shingles at most
    levels = sorted(((r.n, r.k) for r in counts.groupBy(held).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least = min([n for (n, _), total in zip(levels, np.cumsum([k for _, k in levels]), strict=True) if total <= COMMON], default=None)
    top = counts.where(F.lit(False) if least is None else F.col("n") >= least).toArrow()
    sh, n = (top.column(c).to_numpy() for c in ("sh", "n"))
    order = np.argsort(sh.view(np.uint64))
    return texts.sparkSession.sparkContext.broadcast((sh.view(np.uint64)[order], n[order]))


def _prefixes(common):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            if not sets:
                continue
            own = [prefix(s, common.value) for s in sets]
            n = np.array([len(x) for x in own])
            at = (np.repeat([len(s) for s in sets], n) << 32) + np.concatenate([np.arange(k) for k in n])
            rows = [pa.array(np.repeat(b.column(c).to_numpy(), n)) for c in ("row", "root")]
            yield pa.record_batch([pa.array(np.concatenate(own).view(np.int64)), pa.array(at), *rows], names=["sh", "at", "row", "root"])

    return make


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of SHARED, sorted by shingle and size, as (sh, at, row, root, least, pairs, old): a row may be
    similar to the `pairs` rows from `least` on; the first `old` rows have been seen before and have none.
    Of a shingle's rows those that are large enough for the next one are held, those from least[-1] on."""
    held = [np.zeros(0, np.int64)] * 4
    for b in batches:
        if not b.num_rows:
            continue
        old = len(held[0])
        sh, at, row, root = (np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, ("sh", "at", "row", "root"), strict=True))
        size = at >> 32
        new = np.append(True, sh[1:] != sh[:-1])
        group = np.cumsum(new) << 32
        least = np.searchsorted(group + size, group + np.ceil(SIMILARITY * size - 1e-6).astype(np.int64))
        # what stands directly before a row and has its root is connected to it already
        run = np.maximum.accumulate(np.where(new | np.append(True, root[1:] != root[:-1]), np.arange(len(sh)), 0))
        pairs = np.maximum(run - least, 0)
        pairs[:old] = 0
        yield sh, at, row, root, least, pairs, old
        held = [v[least[-1] :] for v in (sh, at, row, root)]


def _may(i: np.ndarray, j: np.ndarray, at: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Whether rows i and j have different roots and enough shingles from this one on to be similar."""
    size, place = at >> 32, at & 0xFFFFFFFF
    return (root[i] != root[j]) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= _overlap(size[i] + size[j]))


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of SHARED that take part in any pair, without their roots, once each."""
    done = np.zeros(0, bool)
    for sh, at, row, _, least, pairs, old in _windows(batches):
        done = np.append(done, np.zeros(len(sh) - old, bool))
        edge = np.zeros(len(sh) + 1, np.int64)
        np.add.at(edge, least, pairs > 0)
        np.add.at(edge, least + pairs, -(pairs > 0).astype(np.int64))
        now = ((np.cumsum(edge[:-1]) > 0) | (pairs > 0)) & ~done
        if now.any():
            yield pa.record_batch([pa.array(v[now]) for v in (sh, at, row)], names=["sh", "at", "row"])
        done = (done | now)[least[-1] :]


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs (a, b) of rows of SHARED that may be similar, so many at once."""
    for _, at, row, root, least, pairs, _ in _windows(batches):
        for x, y in _chunks(pairs):
            j = np.repeat(np.arange(x, y), pairs[x:y])
            i = least[j] + np.arange(len(j)) - np.repeat(np.cumsum(pairs[x:y]) - pairs[x:y], pairs[x:y])
            ok = _may(i, j, at, root)
            if ok.any():
                i, j = row[i[ok]], row[j[ok]]
                yield pa.record_batch([pa.array(np.maximum(i, j)), pa.array(np.minimum(i, j))], names=["a", "b"])


def _scattered(x: np.ndarray) -> np.ndarray:
    """A number drawn for each number, the same on every run."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn(turn: int):
    """DRAWS << turn pairs (a, b), if their roots differ, for each row of SHARED that has MANY or more to be paired with."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sh, at, row, root, least, pairs, _ in _windows(batches):
            draws, rows = DRAWS << turn, np.flatnonzero(pairs >= MANY)
            step = (1 << 16) // draws  # rows at once: 65,536 pairs
            for x in range(0, len(rows), step):
                j = np.repeat(rows[x : x + step], draws)
                nth = np.arange(len(j), dtype=np.uint64) % np.uint64(draws) + np.uint64(draws)
                seed = _scattered(_scattered(row[j].view(np.uint64)) + nth) ^ sh[j].view(np.uint64)
                i = least[j] + (_scattered(seed) % pairs[j].astype(np.uint64)).astype(np.int64)
                ok = _may(i, j, at, root)
                if ok.any():
                    yield pa.record_batch([pa.array(row[j[ok]]), pa.array(row[i[ok]])], names=["a", "b"])

    return draw


def prefixes(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """sh, at, row: the shingles of the rows' prefixes that rows of another root share, and may be similar
    to by size. Rows without a root are left out."""
    rows = texts.hint("merge").join(roots, "row").select("row", "root", "text")
    return _dealt(rows.mapInArrow(_prefixes(_common(texts)), SHARED)).mapInArrow(_partnered, "sh long, at long, row long")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.select("sh", "at", "row", "root").repartition("sh").sortWithinPartitions("sh", "at")


def sharing(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows that share a shingle of their prefixes, can be similar by size and place, and
    have different roots (row, root)."""
    return _dealt(rows.join(roots, "row")).mapInArrow(_meeting, "a long, b long").distinct()


def drawn(rows: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Some of the pairs of sharing: of a row that could be paired with many, PARTNERS << turn."""
    pairs = _dealt(rows.join(roots, "row")).mapInArrow(_drawn(turn), "a long, b long").distinct()
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b", F.lit(turn)), "b"))
    few = pairs.withColumn("place", place).where(F.col("place") <= PARTNERS << turn)
    return few.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def check(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose texts are similar."""
    sifted = lambda x: F.pmod(F.xxhash64(x), F.lit(SIEVE)).alias("sieve")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).select(sifted("row")).distinct()  # at most SIEVE rows
    some = texts.withColumn("sieve", sifted("row")).join(F.broadcast(ends), "sieve", "left_semi")
    side = lambda x: some.select(F.col("row").alias(x), F.col("text").alias(f"text_{x}")).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_similar, "a long, b long")


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, with docs' own columns.

    A pair counts if its texts' five-word shingles have a similarity of SIMILARITY or more, and every such
    pair is connected. Texts with the same words are one from the start. Links of the index over several
    fingerprints of each text (telling) connect most groups cheaply, and drawn pairs what is left of large
    ones; then all pairs between different groups whose prefixes share a shingle (sharing) are checked, and no
    similar pair is without one. Of rows that repeat the smallest doc_id one stays; rows without doc_id stay only if
    their group has no other.
    """
    small_batches(docs.sparkSession)
    mark = "__q9_row"
    base = settle(docs.withColumn(mark, F.monotonically_increasing_id()), "rows")
    texts = base.select(F.col(mark).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    own = settle(texts.mapInArrow(_described, ROWS), "fingerprints")
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "row")
    one = settle(own.groupBy("same").agg(F.min(order).alias("first"), F.min("fps").alias("fps")).withColumn("row", F.col("first.row")), "distinct")
    each = one.select("row", F.posexplode("fps").alias("kind", "fp"))
    by = settle(each.groupBy("kind", "fp").agg(F.min("row").alias("rep"), F.max("row").alias("last")), "kinds")
    # texts of one fingerprint are held against its first and its last
    inside = each.join(by, ["kind", "fp"]).select(F.col("row").alias("a"), F.explode(F.array("rep", "last")).alias("b"))
    reps = lambda x: by.select("kind", F.col("fp").alias(x), F.col("rep").alias(f"rep_{x}"))
    across = links(by).join(reps("a"), ["kind", "a"]).join(reps("b"), ["kind", "b"]).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    found = inside.unionByName(across).where("a <> b")
    pairs = settle(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "candidates")
    checked = settle(check(pairs, texts), "checked")
    rooted = lambda found: one.join(components(found).withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    roots = settle(rooted(checked).select("row", "root"), "roots")
    rows = settle(prefixes(texts, roots), "prefixes")
    tried = texts.sparkSession.createDataFrame([], "a long, b long")
    for turn in range(TURNS):
        some = settle(drawn(rows, roots, turn), "candidates")
        new = settle(check(some, texts), "checked")
        if new.isEmpty():
            break
        checked, tried = checked.unionByName(new), tried.unionByName(some)
        roots = settle(rooted(checked).select("row", "root"), "roots")
    left = sharing(rows, roots).join(tried, ["a", "b"], "left_anti")
    named = rooted(checked.unionByName(settle(check(settle(left, "candidates"), texts), "checked")))
    chosen = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(mark))
    # by shuffle at every size: the chosen rows grow with the documents
    return base.join(settle(chosen, "chosen").hint("merge"), mark, "left_semi").select(*docs.columns)
