"""Evaluation texts leaking into training text: SimHash of item-sized windows, verified exactly.

Two kinds of windows are laid over documents, by one machinery. Windows of the
shortest passage that counts (12 words) meet equal windows of items, so that
passages of any length are found, in part or whole. Windows as long as the
items (lengths are rounded down to classes) meet those of items within a
Hamming radius, so that whole items are found although words were changed.
Candidates are then compared by their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.tables import cut
from .mail import parse, words

SHINGLE = 5
BLOCKS, BLOCK_BITS = 4, 16  # a fingerprint's 64 bits are four blocks
BUCKETS = 1 << 16  # word weights are kept by a hash of the word
BITMAP = 1 << 26  # bits that say which fingerprints items have
GROWTH = 1.15  # from one class of window lengths to the next
CHUNK = 4096
BLOCK_WORDS = 131_072
NEAR_AT_ONCE = 16_384  # item-sized windows searched for in one pass
FEW_WINDOWS = 200_000  # item windows that may be broadcast
FOUND = "kind int, doc_id bigint, row bigint, pos bigint, item_id bigint, off int, size int, words array<bigint>"
PROBE = "kind int, item_id bigint, off int, size int, print bigint"


# Words and fingerprints ------------------------------------------------------


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63) or 1
        return h


_hashes = _Hashes()


def hashed(text: str) -> np.ndarray:
    """The words of a text as 64-bit hashes; none is 0."""
    ws = words(text)
    return np.fromiter(map(_hashes.__getitem__, ws), np.int64, len(ws))


def weigh(items_with: np.ndarray, n: int) -> np.ndarray:
    """Weights by bucket from the number of items that have its words: rare ones weigh more, those of no item nothing."""
    c = np.maximum(items_with, 1)
    return np.where(items_with > 0, np.maximum(1, np.rint(4 * np.log1p(n / c))), 0).astype(np.int16)


def fingerprints(h: np.ndarray, weights: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """The SimHash of every window of each size: the signs of the sums of its words' weighted bit vectors, by running sums."""
    n, most = len(h), max(sizes)
    out = {s: np.empty(max(0, n - s + 1), np.uint64) for s in sizes}
    step = max(CHUNK, most)
    for lo in range(0, n, step):
        part = np.ascontiguousarray(h[lo : lo + step + most - 1])
        w = np.where(part == 0, 0, weights[part & (BUCKETS - 1)]).astype(np.int16)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        run = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(np.where(bits, w[:, None], -w[:, None]), axis=0, out=run[1:])
        for s in sizes:
            m = min(step, n - s + 1 - lo)
            if m > 0:
                out[s][lo : lo + m] = np.packbits(run[s : s + m] > run[:m], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def size_class(n: int, least: int) -> int:
    """The greatest window length of the classes that is at most ``n``."""
    k = max(0, int(math.log(n / least) / math.log(GROWTH)) - 1)
    while int(least * GROWTH ** (k + 1)) <= n:
        k += 1
    return int(least * GROWTH**k)


def _spots(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bit numbers of the bitmap for each fingerprint."""
    p = prints.view(np.int64) if prints.dtype == np.uint64 else prints
    return p & (BITMAP - 1), (p >> 32) & (BITMAP - 1)


# Multi-index Hamming search --------------------------------------------------


class Near:
    """Fingerprints of one window length, found within ``radius`` bits.

    Two fingerprints within ``radius`` differ by at most radius // 4 bits in
    one of four blocks. Every block of a probe is stored under all values that
    near, so that one look at each block of a window misses none.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        flips = [0]
        for k in range(1, radius // BLOCKS + 1):
            flips += [sum(1 << b for b in c) for c in combinations(range(BLOCK_BITS), k)]
        self.order, self.starts = [], []
        for b in range(BLOCKS):
            key = self._key(prints, b)[:, None] ^ np.array(flips, np.int64)[None, :]
            order = np.argsort(key.ravel(), kind="stable")
            self.starts.append(np.searchsorted(key.ravel()[order], np.arange((1 << BLOCK_BITS) + 1)))
            self.order.append((order // len(flips)).astype(np.int32))

    @staticmethod
    def _key(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, probe) pairs whose fingerprints differ in at most ``radius`` bits, each once."""
        wins, probes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for b in range(BLOCKS):
            key = self._key(prints, b)
            first = self.starts[b][key]
            many = self.starts[b][key + 1] - first
            at = np.flatnonzero(many)
            for lo in range(0, len(at), 65_536):  # in slices: a block value may be common
                part = at[lo : lo + 65_536]
                reps = many[part]
                win = np.repeat(part, reps)
                offset = np.arange(len(win)) - np.repeat(np.cumsum(reps) - reps, reps)
                probe = self.order[b][np.repeat(first[part], reps) + offset]
                near = np.bitwise_count(prints[win] ^ self.prints[probe]) <= self.radius
                wins.append(win[near])
                probes.append(probe[near].astype(np.int64))
        pair = np.unique(np.concatenate(wins) * max(1, len(self.prints)) + np.concatenate(probes))
        return pair // max(1, len(self.prints)), pair % max(1, len(self.prints))


def similarity(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> float:
    """Weighted Jaccard of the five-word shingles of two windows; a shingle weighs what its words weigh, words of no item as much as the heaviest."""
    heavy = np.where(weights == 0, weights.max(initial=1), weights).astype(np.int64)
    shingles = []
    for x in (a, b):
        view = np.lib.stride_tricks.sliding_window_view(x, SHINGLE)
        shingles.append({v.tobytes(): int(w) for v, w in zip(view, heavy[view & (BUCKETS - 1)].sum(axis=1), strict=True)})
    both = sum(w for k, w in shingles[0].items() if k in shingles[1])
    return both / max(1, sum(shingles[0].values()) + sum(shingles[1].values()) - both)


def similarities(run: np.ndarray, item: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``similarity`` of every window of ``run`` that is as long as ``item``; shingles are told apart once for all."""
    heavy = np.where(weights == 0, weights.max(initial=1), weights).astype(np.int64)
    view = np.lib.stride_tricks.sliding_window_view
    both = np.concatenate([view(run, SHINGLE), view(item, SHINGLE)])
    ids = np.unique(both, axis=0, return_inverse=True)[1].ravel()
    mine, theirs = ids[: len(run) - SHINGLE + 1], np.unique(ids[len(run) - SHINGLE + 1 :], return_index=True)
    w = heavy[both & (BUCKETS - 1)].sum(axis=1)
    total = int(w[len(mine) :][theirs[1]].sum())
    common = np.where(np.isin(mine, theirs[0]), w[: len(mine)], 0)
    n, m = len(run) - len(item) + 1, len(item) - SHINGLE + 1
    # A shingle that stands again within a window counts once: where it stood less than a window before, it is left out.
    before = np.full(len(mine), -m, np.int64)
    order = np.argsort(mine, kind="stable")
    same = np.flatnonzero(np.diff(mine[order]) == 0)
    before[order[same + 1]] = order[same]
    again = np.flatnonzero(np.arange(len(mine)) - before < m)
    out = []
    for x in (w[: len(mine)], common):
        sums = np.concatenate([[0], np.cumsum(x)])
        out.append(sums[m : m + n] - sums[:n])
        for k in again:  # windows that hold both places
            lo, hi = max(0, k - m + 1), min(n - 1, before[k])
            out[-1][lo : hi + 1] -= x[k]
    own, shared = out
    return shared / np.maximum(1, own + total - shared)


# The search ------------------------------------------------------------------


def _hash_items(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [hashed(t.as_py() or "") for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(h, pa.list_(pa.int64()))], names=["item_id", "words"])

    return cut(items.mapInArrow(run, "item_id bigint, words array<bigint>"))


def _probes(items: DataFrame, weights, size: int) -> DataFrame:
    """Fingerprints of items: all windows of ``size`` words (kind 0), and the first and last of the item's own class (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for i, ws in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = ws.values.to_numpy(zero_copy_only=False) if len(ws.values or []) else np.empty(0, np.int64)
                if len(h) < size:
                    continue
                own = size_class(len(h), size)
                prints = fingerprints(h, weights.value, sorted({size, own}))
                for kind, s, offs in ((0, size, range(len(h) - size + 1)), (1, own, sorted({0, len(h) - own}))):
                    for o in offs:
                        for c, v in zip(cols, (kind, i, o, s, int(prints[s].view(np.int64)[o])), strict=True):
                            c.append(v)
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in PROBE.split(", ")])

    return cut(items.mapInArrow(run, PROBE))


def _scan(docs: DataFrame, weights, size: int, bitmap, near, decoded: bool) -> DataFrame:
    """Candidates of all documents: runs of words whose windows the bitmap knows (kind 0), or are near to one window of an item (kind 1).

    ``near`` is (items, offsets, sizes, fingerprints, radius). ``decoded``
    documents are words already, with zeros between parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        item, off, length, prints, radius = near.value if near is not None else (None, None, np.empty(0, np.int32), None, 0)
        at = {int(s): np.flatnonzero(length == s) for s in np.unique(length)}
        tables = {s: Near(prints[k], radius) for s, k in at.items()}
        sizes = sorted({*tables, *([size] if bitmap is not None else [])})
        ids: list[np.ndarray] = []
        docs_held: list[tuple[int, int]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([np.append(x, 0) for x in ids])
            lens = np.array([len(x) + 1 for x in ids])
            start = np.cumsum(lens) - lens
            doc = np.repeat(np.arange(len(ids)), lens)
            part = np.cumsum(h == 0)
            f = fingerprints(h, w, sizes)
            rows: list[tuple] = []

            def emit(kind: int, lo: int, n: int, i: int | None, o: int | None, s: int) -> None:
                d = doc[lo]
                rows.append((kind, *docs_held[d], int(lo - start[d]), i, o, s, h[lo : lo + n]))

            def whole(win: np.ndarray, s: int) -> np.ndarray:
                return (part[win] == part[win + s - 1]) & (h[win] != 0) & (h[win + s - 1] != 0)

            if bitmap is not None and len(f[size]):
                known = np.ones(len(f[size]), bool)
                for spot in _spots(f[size]):
                    known &= ((bitmap.value[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                win = np.flatnonzero(known)
                win = win[whole(win, size)]
                for r in np.split(win, np.flatnonzero((np.diff(win) != 1) | (part[win[1:]] != part[win[:-1]])) + 1) if len(win) else []:
                    emit(0, r[0], len(r) + size - 1, None, None, size)
            for s, t in tables.items():
                win, probe = t.candidates(f[s])
                ok = whole(win, s)
                win, probe = win[ok], probe[ok]
                if not len(win):
                    continue
                order = np.lexsort((win, probe))
                win, probe = win[order], at[s][probe[order]]
                split = (np.diff(win) != 1) | (np.diff(probe) != 0) | (part[win[1:]] != part[win[:-1]])
                first = np.flatnonzero(np.concatenate([[True], split]))
                for lo, hi in zip(first, [*first[1:], len(win)], strict=True):  # windows in a row are one run of words
                    emit(1, win[lo], int(hi - lo) + s - 1, int(item[probe[lo]]), int(off[probe[lo]]), s)
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

        for b in batches:
            for d, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = _words_of(t, decoded)
                if d is None or not len(x):
                    continue
                ids.append(x)
                docs_held.append((d, r))
                total += len(x) + 1
                if total >= BLOCK_WORDS:
                    yield flush()
                    ids, docs_held, total = [], [], 0
        if total:
            yield flush()

    return docs.mapInArrow(run, FOUND)


def _words_of(value: pa.Scalar, decoded: bool) -> np.ndarray:
    """A document's words: all text parts, a zero between two."""
    if decoded:
        return value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.empty(0, np.int64)
    text = value.as_py()
    parts = [hashed(p) for _, p in parse(text).parts] if text else []
    return np.concatenate([y for x in parts for y in (x, np.zeros(1, np.int64))][:-1]) if parts else np.empty(0, np.int64)


def _decode(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([_words_of(t, False) for t in b.column(2)], pa.list_(pa.int64()))], names=["doc_id", "row", "words"])

    return cut(docs.mapInArrow(run, "doc_id bigint, row bigint, words array<bigint>"))


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 12, radius: int = 7, least: float = 0.8, exact: bool = True, near: bool = True
) -> DataFrame:
    """Which documents hold passages of which items: (doc_id, item_id, exact_windows, longest_run, near_windows, best).

    ``exact_windows``: how many ``size``-word windows of the document equal one
    of the item; ``longest_run``: words of the longest stretch of neighbouring
    ones. ``near_windows``: windows of the item's length class whose
    fingerprint lies within ``radius`` bits of the item's and whose weighted
    five-word shingles are alike to at least ``least``; ``best`` is the best of
    them (null if none). ``exact`` and ``near`` say which kinds are searched.

    Whole texts are read: all text parts, decoded, markup taken off; no window
    spans two parts. Null or empty texts, null ids, and items with fewer words
    than ``size`` have no rows; repeated document ids are reported as one.

    Items stay distributed: their windows are a table; tasks get word weights
    by ``BUCKETS`` hashes and a bitmap of ``BITMAP`` bits, both of fixed size,
    and item-sized fingerprints in passes of at most ``NEAR_AT_ONCE``.
    Documents are decoded once: with several passes, their words are written
    first. What passes is joined with the items' words, by broadcast if these
    are few, else by a shuffle on salted window hashes.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    it = _hash_items(items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null"))
    n = it.count()
    have = it.select(F.explode(F.array_distinct("words")).alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    items_with = np.zeros(BUCKETS, np.int64)
    for r in have.collect():  # at most BUCKETS rows
        items_with[r["b"]] = r["n"]
    weights = sc.broadcast(weigh(items_with, n))
    probes = _probes(it, weights, size)

    bitmap = None
    if exact:
        spot = F.explode(F.array(*[x.bitwiseAND(F.lit(BITMAP - 1)) for x in (F.col("print"), F.shiftright("print", 32))])).alias("s")
        bits = probes.filter("kind = 0").select(spot).groupBy(F.shiftright("s", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("v"))
        filled = np.zeros(BITMAP // 64, np.uint64)
        for r in bits.collect():  # at most BITMAP / 64 rows, whatever the number of items
            filled[r["k"]] = r["v"] & 0xFFFFFFFFFFFFFFFF
        bitmap = sc.broadcast(filled)
    own = probes.filter("kind = 1")
    passes = -(-own.count() // NEAR_AT_ONCE) if near else 0
    if passes > 1:
        d = _decode(d)
    found = None
    for k in range(max(1, passes)):
        held = None
        if near:
            rows = own.filter(F.pmod(F.xxhash64("item_id", "off"), F.lit(passes)) == k).select("item_id", "off", "size", "print").collect() if passes else []  # about NEAR_AT_ONCE
            cols = [np.array([r[c] for r in rows], t) for c, t in (("item_id", np.int64), ("off", np.int32), ("size", np.int32), ("print", np.int64))]
            held = sc.broadcast((*cols[:3], cols[3].view(np.uint64), radius))
        one = _scan(d, weights, size, bitmap if k == 0 else None, held, passes > 1)
        found = one if found is None else found.unionByName(one)
    found = cut(found)
    out = _exact(found.filter("kind = 0"), it, size).unionByName(_near(found.filter("kind = 1"), it, weights, least))
    return out.groupBy("doc_id", "item_id").agg(F.sum("exact_windows").alias("exact_windows"), F.max("longest_run").alias("longest_run"), F.sum("near_windows").alias("near_windows"), F.max("best").alias("best"))


RESULT = ["doc_id", "item_id", "exact_windows", "longest_run", "near_windows", "best"]


def _exact(runs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    windows = F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda i: F.struct(i.alias("i"), F.slice("words", i + 1, size).alias("w"))))
    mine = runs.select("doc_id", "row", "pos", windows.alias("x")).select("doc_id", "row", (F.col("pos") + F.col("x.i")).alias("pos"), "x.w")
    theirs = items.filter(F.size("words") >= size).select("item_id", windows.alias("x")).select("item_id", "x.w").distinct()
    theirs = cut(theirs)
    if theirs.limit(FEW_WINDOWS + 1).count() <= FEW_WINDOWS:
        j = mine.join(F.broadcast(theirs), "w")
    else:
        j = mine.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(16))).join(theirs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint")))), ["w", "salt"])
    # Neighbouring windows: position less rank is the same along a run. A partition has at most one text's windows.
    one = j.select("doc_id", "row", "item_id", "pos").withColumn("run", F.col("pos") - F.row_number().over(W.partitionBy("doc_id", "row", "item_id").orderBy("pos")))
    per = one.groupBy("doc_id", "row", "item_id", "run").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("doc_id", "item_id").agg(F.sum("n").alias("exact_windows"), (F.max("n") + size - 1).alias("longest_run"))
    return per.withColumn("near_windows", F.lit(0).cast("bigint")).withColumn("best", F.lit(None).cast("double")).select(*RESULT)


def _near(windows: DataFrame, items: DataFrame, weights, least: float) -> DataFrame:
    few = items.limit(FEW_WINDOWS // 100 + 1).count() <= FEW_WINDOWS // 100
    theirs = items.select("item_id", F.col("words").alias("all"))
    j = windows.join(F.broadcast(theirs) if few else theirs, "item_id")
    j = j.select("doc_id", "item_id", F.col("words").alias("a"), F.slice("all", F.col("off") + 1, F.col("size")).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for t in batches:
            pairs = zip(t.column(2), t.column(3), strict=True)
            sims = [similarities(*(x.values.to_numpy(zero_copy_only=False) for x in p), w) for p in pairs]
            n = pa.array([int((x >= least).sum()) for x in sims], pa.int64())
            yield pa.record_batch([t.column(0), t.column(1), n, pa.array([float(x.max()) for x in sims], pa.float64())], names=["doc_id", "item_id", "n", "best"])

    ok = j.mapInArrow(run, "doc_id bigint, item_id bigint, n bigint, best double").filter("n > 0")
    per = ok.groupBy("doc_id", "item_id").agg(F.sum("n").alias("near_windows"), F.max("best").alias("best"))
    return per.withColumn("exact_windows", F.lit(0).cast("bigint")).withColumn("longest_run", F.lit(0).cast("bigint")).select(*RESULT)
