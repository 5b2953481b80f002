"""Filling fixed-capacity containers: best-fit decreasing per partition, certified by lower bounds, repacked where a gap stays."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import cut

PIECES = "doc_id bigint, piece bigint, tokens bigint"
PACKED = "doc_id bigint, piece bigint, tokens bigint, grp bigint, bin bigint, fill bigint, bins bigint, bound bigint"

@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The byte-pair tokenizer of a rank file, made once per worker; text is cut before merging by the pattern installed beside it."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens): each whole text's length in tokens; 0 for null and empty texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(ranks)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(count, "doc_id bigint, tokens bigint")


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, tokens): a text whole, or, if longer than a container, cut into full pieces and a rest."""
    n = F.greatest(F.ceil(F.col("tokens") / F.lit(capacity)), F.lit(1))
    p = counts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("piece"), F.col("tokens").alias("all"))
    return p.select("doc_id", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("all") - F.col("piece") * capacity).alias("tokens"))


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing needs fewer bins: the best of several dual feasible functions.

    A dual feasible function maps sizes so that whatever fits one bin sums to
    at most 1; so the mapped total, rounded up, bounds the bins. Two families
    are tried: dropping sizes below a limit while those above capacity less
    the limit count in full, and rounding to multiples of 1/k.
    """
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    n_upto, sum_upto = np.cumsum(count), np.cumsum(count * x)
    limit = np.arange(0, capacity // 2 + 1)
    whole = n_upto[-1] - n_upto[capacity - limit]
    middle = sum_upto[capacity - limit] - np.where(limit > 0, sum_upto[np.maximum(limit - 1, 0)], 0)
    best = int((whole + -(-middle // capacity)).max())
    for k in range(1, 21):
        scaled = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, by best-fit decreasing; ``sizes`` must fall.

    Bins wait in lists by room left; a big integer has a bit per non-empty
    list, so the tightest fitting bin is its lowest bit from the size up.
    """
    out = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for k, s in enumerate(sizes.tolist()):
        fits = mask >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, b = capacity, used
            used += 1
        out[k] = b
        left -= s
        room[left].append(b)
        mask |= 1 << left
    return out


def best_set_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, as ``best_fit``, but a bin takes the best-fitting set at once.

    A bin opens with the largest size left; of the rest the set that fills its
    room best is found by subset sums, kept as the bits of one integer per
    distinct size, and given up as soon as one fills it wholly. ``sizes`` must
    fall. Work is bins times distinct sizes, for the few items of an exchange.
    """
    out = np.full(len(sizes), -1, np.int64)
    waiting: dict[int, list[int]] = {}
    for k in range(len(sizes) - 1, -1, -1):
        waiting.setdefault(int(sizes[k]), []).append(k)
    order = sorted(waiting, reverse=True)
    b = 0
    while order:
        top = order[0]
        out[waiting[top].pop()] = b
        room = capacity - top
        full, reach, steps = (1 << (room + 1)) - 1, 1, []
        for s in order:
            many = min(len(waiting[s]), room // s) if 0 < s <= room else 0
            if many:
                before = reach
                for _ in range(many):
                    reach |= (reach << s) & full
                steps.append((s, before))
                if reach >> room & 1:
                    break
        left = reach.bit_length() - 1
        for s, before in reversed(steps):
            while not before >> left & 1:
                out[waiting[s].pop()] = b
                left -= s
        order = [s for s in order if waiting[s]]
        if order and order[0] == 0:  # sizes of 0 need no room
            out[out < 0] = b
            break
        b += 1
    return out


def _pack_groups(items: DataFrame, groups: int, capacity: int, seed: int) -> DataFrame:
    grp = F.pmod(F.xxhash64("doc_id", "piece", F.lit(seed)), F.lit(groups)).cast("bigint")

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        doc, piece = (t.column(c).combine_chunks() for c in ("doc_id", "piece"))
        size = t.column("tokens").to_numpy().astype(np.int64)
        bins = (best_set_fit if seed else best_fit)(size, capacity)
        fill = np.bincount(bins, weights=size).astype(np.int64)
        n = len(size)
        cols = [doc, piece, size, np.full(n, t.column("grp")[0].as_py()), bins, fill[bins], np.full(n, len(fill)), np.full(n, max(1, lower_bound(size, capacity)))]
        return pa.table({f.split()[0]: pa.array(c, pa.int64()) for f, c in zip(PACKED.split(", "), cols, strict=True)})

    # A group holds about per_group small rows, whatever the input: see pack().
    return items.withColumn("grp", grp).groupBy("grp").applyInArrow(one, PACKED)


def pack(items: DataFrame, capacity: int = 2048, per_group: int = 20_000, rounds: int = 3, tight: float = 0.98) -> DataFrame:
    """Puts items (doc_id, piece, tokens) into containers: adds ``container``.

    Items are hashed into groups of about ``per_group`` and packed best-fit
    decreasing. A group whose bin count equals its lower bound is certified:
    no packing of it is better. Of the other groups, and of the one or two
    poorly filled last bins of every group, the bins below ``tight`` are
    opened again; their items are exchanged, hashed into new groups across old
    borders, and packed anew, each bin now taking the best-fitting set, up to
    ``rounds`` times. A round that can't save a bin is not begun. Sizes
    above the capacity must have been cut; sizes of 0 go where room is. Null
    ids are hashed like any other. Nothing but group statistics is collected.
    """
    done = None
    todo, seed = items.select("doc_id", "piece", "tokens"), 0
    while True:
        n = todo.count()
        if n == 0:
            break
        groups = max(1, -(-n // per_group))
        packed = cut(_pack_groups(todo, groups, capacity, seed))
        packed = packed.withColumn("container", F.concat_ws("-", F.lit(seed), "grp", "bin"))
        seed += 1
        gap = F.col("bins") > F.col("bound")
        loose = (F.col("fill") < tight * capacity) & (gap | F.lit(groups > 1))
        if seed > rounds or groups == 1 and seed > 1:
            keep, todo = packed, None
        else:
            stats = packed.filter(loose).agg(F.countDistinct("container").alias("bins"), F.sum("tokens").alias("t")).first()
            gain = (stats["bins"] or 0) - -(-(stats["t"] or 0) // capacity)
            if gain <= 0:
                keep, todo = packed, None
            else:
                keep, todo = packed.filter(~loose), packed.filter(loose).select("doc_id", "piece", "tokens")
        keep = keep.select("doc_id", "piece", "tokens", "container", "fill")
        done = keep if done is None else done.unionByName(keep)
        if todo is None:
            break
    if done is None:
        return items.select("doc_id", "piece", "tokens").withColumns({"container": F.lit(""), "fill": F.lit(0).cast("bigint")}).limit(0)
    return done


def pack_documents(docs: DataFrame, ranks: str, capacity: int = 2048, **how) -> DataFrame:
    """(doc_id, piece, first_token, tokens, container, fill) of every text in ``docs``."""
    sizes = cut(pieces(token_counts(docs, ranks), capacity))
    return pack(sizes, capacity, **how).withColumn("first_token", F.col("piece") * capacity)
