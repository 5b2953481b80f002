"""Items that appear together: exact pair counts and lift, by heavy-light decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import cut

BLOCK = 65_536


def heavy_pairs(items: DataFrame, heavy: list[str]) -> DataFrame:
    """(a, b, n): rows that hold both of two heavy items, a < b; ``items`` is one array column of distinct items.

    Each task sets a bit per (heavy item, row) in blocks of rows and counts
    pairs by popcounts of ANDed bit rows; it holds one block and one square of
    counts, and puts out at most one row per pair.
    """
    heavy = sorted(heavy)
    h = len(heavy)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(heavy, pa.string())
        total = np.zeros((h, h), dtype=np.int64)

        def add(ids: np.ndarray, rows: np.ndarray, n: int) -> None:
            bits = np.zeros((h, -(-n // 64) * 64), dtype=bool)
            bits[ids, rows] = True
            words = np.packbits(bits, axis=1).view(np.uint64)
            for i in range(h - 1):
                total[i, i + 1 :] += np.bitwise_count(words[i + 1 :] & words[i]).sum(axis=1, dtype=np.int64)

        held_ids, held_rows, n = [], [], 0
        for b in batches:
            col = b.column(0)
            for at in range(0, len(col), BLOCK):
                part = col.slice(at, BLOCK)
                found = pc.index_in(part.flatten(), value_set=names)
                rows = pc.list_parent_indices(part).to_numpy(zero_copy_only=False)
                ok = found.is_valid().to_numpy(zero_copy_only=False)
                held_ids.append(found.drop_null().to_numpy())
                held_rows.append(rows[ok] + n)
                n += len(part)
                if n >= BLOCK:
                    add(np.concatenate(held_ids), np.concatenate(held_rows), n)
                    held_ids, held_rows, n = [], [], 0
        if n:
            add(np.concatenate(held_ids), np.concatenate(held_rows), n)
        i, j = np.nonzero(total)
        yield pa.record_batch([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(total[i, j])], names=["a", "b", "n"])

    if h < 2:
        return items.sparkSession.createDataFrame([], "a string, b string, n bigint")
    return items.mapInArrow(count, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def cooccurrence(df: DataFrame, row_id: str | None, items: str, min_count: int = 1, min_lift: int | None = None, max_heavy: int = 256) -> DataFrame:
    """Pairs of items in one record: (item_a, item_b, n_ab, n_a, n_b, lift), item_a < item_b.

    ``row_id`` is unique and not null. None makes every row a record of its
    own, repeated rows included: rows are then written out with numbers first.
    ``items`` is an array of text. Null arrays and items count for nothing, a repeated item once per record; records without items
    still count in the total that lift is taken from. lift = n_ab * total /
    (n_a * n_b); pairs below ``min_count`` or ``min_lift`` are left out.

    An item is heavy if it has more than 1/``max_heavy`` of all entries, so
    there are fewer than ``max_heavy``. Heavy pairs are counted by
    ``heavy_pairs``; pairs of light items by hash, with map-side combining;
    mixed ones by probing each light item against its record's heavy list.
    An item seen in fewer than ``min_count`` records, or in so many that
    total / n is below ``min_lift``, can be in no result and is dropped before
    pairs are made; that loses nothing. Light items meet their counts in one
    join on the item, before which heavy ones are taken out of the rows, and
    carry them along; counts of heavy items are a broadcast table. So nothing
    is joined once pairs are made. Pairs of one record are streamed by nested
    explodes, never held as one list of pairs.
    """
    spark = df.sparkSession
    own = F.monotonically_increasing_id() if row_id is None else F.col(row_id)
    x = df.select(own.alias("__row"), F.array_distinct(F.filter(F.coalesce(F.col(items), F.array().cast("array<string>")), lambda t: t.isNotNull())).alias("__items"))
    x = cut(x) if row_id is None else x
    rows = x.count()
    counts = cut(x.select(F.explode("__items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    entries = counts.agg(F.sum("n")).first()[0] or 0
    lift_ok = F.lit(True) if min_lift is None else F.col("n") * min_lift <= rows
    usable = counts.filter((F.col("n") >= min_count) & lift_ok)
    often = counts.filter(F.col("n") > entries // max_heavy).select("item", "n").collect()  # fewer than max_heavy
    fits = {r["item"] for r in often if r["n"] >= min_count and (min_lift is None or r["n"] * min_lift <= rows)}
    heavy = sorted((r["item"], r["n"]) for r in often if r["item"] in fits)
    dense = heavy_pairs(x.select("__items"), [t for t, _ in heavy]).filter(F.col("n") >= min_count)
    marks = F.broadcast(spark.createDataFrame(heavy, "item string, n bigint"))  # fewer than max_heavy
    n_of = lambda c, name: marks.select(F.col("item").alias(c), F.col("n").alias(name))
    dense = dense.join(n_of("a", "n_a"), "a").join(n_of("b", "n_b"), "b").select("a", "b", "n_a", "n_b", "n")

    listed = lambda names: F.array(*[F.lit(t) for t in names]).cast("array<string>")  # noqa: E731  # fewer than max_heavy
    flat = x.select("__row", F.explode(F.array_except("__items", listed([r["item"] for r in often]))).alias("item"))
    light = flat.join(usable.filter(F.col("n") <= entries // max_heavy).select("item", "n"), "item").select("__row", F.struct("item", "n").alias("x"), F.lit(None).cast("array<string>").alias("hs"))
    solid = x.select("__row", F.lit(None).cast("struct<item:string,n:bigint>").alias("x"), F.array_intersect("__items", listed([t for t, _ in heavy])).alias("hs")).filter(F.size("hs") > 0)
    record = light.unionByName(solid).groupBy("__row").agg(F.array_sort(F.collect_list("x")).alias("ls"), F.coalesce(F.max("hs"), listed([])).alias("hs"))
    each = record.filter(F.size("ls") > 0).select(F.posexplode("ls").alias("k", "x"), "ls", "hs")
    # Light items after this one in the sorted list, and the record's heavy items, whose counts are put in last.
    heavy_as = F.transform("hs", lambda t: F.struct(t.alias("item"), F.lit(None).cast("bigint").alias("n")))
    partner = each.select("x", F.explode(F.concat(F.slice("ls", F.col("k") + 2, F.size("ls")), heavy_as)).alias("y"))
    pair = partner.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).select(F.col("a.item").alias("a"), F.col("b.item").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))
    sparse = pair.groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    for c in ("a", "b"):
        known = n_of(c, "__n")
        sparse = sparse.join(known, c, "left").withColumn(f"n_{c}", F.coalesce(f"n_{c}", "__n")).drop("__n")

    out = dense.unionByName(sparse.select(dense.columns)).select(
        F.col("a").alias("item_a"),
        F.col("b").alias("item_b"),
        F.col("n").alias("n_ab"),
        "n_a",
        "n_b",
        (F.col("n").cast("double") * rows / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"),
    )
    if min_lift is not None:
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        out = out.filter(wide("n_ab") * F.lit(rows).cast("decimal(19,0)") >= (wide("n_a") * wide("n_b")) * F.lit(min_lift))
    return out
