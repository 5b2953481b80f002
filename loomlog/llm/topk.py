"""Most frequent items among billions, in bounded memory: three-phase threshold top-k."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.tables import cut

FLUSH = 262_144
BROADCAST_BYTES = 32 << 20
RANGES = 65_536  # hash ranges of a field's values, of which totals are kept
SUMMARY = "node int, field string, item_value string, n bigint, err bigint, total bigint"


class Summary:
    """Counts of at most ``capacity`` values; what is missing or too low is off by at most total / (capacity + 1).

    A value's true count lies between its count here and that plus ``err``.
    """

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.err, self.total = capacity, {}, 0, 0

    def add(self, values: list, counts: list[int]) -> None:
        get, mine = self.counts.get, self.counts
        for v, n in zip(values, counts, strict=True):
            mine[v] = get(v, 0) + n
        self.total += sum(counts)
        if len(mine) > self.capacity:
            cut_off = sorted(mine.values(), reverse=True)[self.capacity]
            self.err += cut_off
            self.counts = {v: n - cut_off for v, n in mine.items() if n > cut_off}


def local_counts(df: DataFrame, fields: dict[str, Column], capacity: int) -> DataFrame:
    """Phase 1: every node (scan task) counts its own values in a bounded summary.

    One row per kept value, and one with a null value per field that carries
    the node's ``err`` and ``total``. Null values and arrays count for nothing.
    """
    names = list(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        sums = [Summary(capacity) for _ in names]
        held: list[list[pa.Array]] = [[] for _ in names]
        size = [0] * len(names)

        def flush(k: int) -> None:
            if not size[k]:
                return
            vc = pa.chunked_array(held[k], pa.string()).value_counts()
            vc = pa.concat_arrays(vc.chunks) if isinstance(vc, pa.ChunkedArray) else vc
            sums[k].add(vc.field(0).to_pylist(), vc.field(1).to_pylist())
            held[k], size[k] = [], 0

        for b in batches:
            for k in range(len(names)):
                v = b.column(k).flatten().drop_null()
                held[k].append(v.cast(pa.string()))
                size[k] += len(v)
                if size[k] >= FLUSH:
                    flush(k)
        for k, name in enumerate(names):
            flush(k)
            s = sums[k]
            values = [None, *s.counts]
            n = len(values)
            yield pa.record_batch(
                [pa.array([node] * n, pa.int32()), pa.array([name] * n, pa.string()), pa.array(values, pa.string()), pa.array([0, *s.counts.values()], pa.int64()), pa.array([s.err] * n, pa.int64()), pa.array([s.total] * n, pa.int64())],
                names=["node", "field", "item_value", "n", "err", "total"],
            )

    return df.select(*[c.alias(n) for n, c in fields.items()]).mapInArrow(count, SUMMARY)


def _entries(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    def part(name: str, c: Column) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("field"), v.alias("item_value")))

    parts = [part(n, c) for n, c in fields.items()]
    return df.select(F.explode(F.concat(*parts)).alias("x")).select("x.*").filter("item_value is not null")


def frequent(df: DataFrame, fields: dict[str, Column], k: int | None = None, one_in: int | None = None, min_count: int = 1, capacity: int = 4096, most: int | None = None) -> DataFrame:
    """The most frequent values per field: (field, item_value, n, low, high, total).

    Either the ``k`` most frequent (ties by value), or all that make up at
    least 1/``one_in`` of their field's entries; at least ``min_count`` in any
    case. ``n`` is exact; ``low`` and ``high`` bound what phase 1 knew of it.
    Repeated entries of a row all count. Empty input gives no rows.

    Phase 1: bounded local counts; the sums of the local leaders' counts give a
    lower bound, the k-th of them, or the wanted share, being the threshold.
    Phase 2: a value that reaches the threshold overall has its share of it on
    some node (the node's part of all entries). A node whose error is below a
    quarter of its share holds every such value in its summary; its values
    that may reach the share are fetched, and those whose upper bound (what is
    known, plus the errors of all nodes) is below the threshold dropped.
    Phase 3: the remaining ones are counted exactly.

    If some node's error is larger (a flat top-k), phase 1 is repeated with
    more capacity, up to ``most`` (64 times as much by default). Beyond that
    the undecided values alone are counted again: values are hashed to
    ``RANGES`` ranges whose totals bound the values in them, and only ranges
    that reach the threshold are counted value by value, by an aggregate that
    spills. The result is the same on every path; so is the bound on memory.
    """
    if (k is None) == (one_in is None):
        raise ValueError("give either k or one_in")
    if one_in is not None:
        capacity = max(capacity, 4 * one_in)
    most = capacity * 64 if most is None else max(most, capacity)
    while True:
        local = cut(local_counts(df, fields, capacity))
        nodes = local.filter("item_value is null").select("node", "field", "total", "err")
        vals = local.filter("item_value is not null")
        sums = vals.groupBy("field", "item_value").agg(F.sum("n").alias("low"))
        facts = nodes.groupBy("field").agg(F.sum("total").alias("total_all"), F.sum("err").alias("err_all"))
        if one_in is None:
            leaders = vals.withColumn("r", F.row_number().over(W.partitionBy("node", "field").orderBy(F.desc("n"), "item_value"))).filter(F.col("r") <= k)
            led = leaders.groupBy("field", "item_value").agg(F.sum("n").alias("low"))
            kth = led.withColumn("r", F.row_number().over(W.partitionBy("field").orderBy(F.desc("low"), "item_value"))).filter(F.col("r") <= k)
            least = kth.groupBy("field").agg(F.min("low").alias("m"), F.count(F.lit(1)).alias("found"))
            facts = facts.join(least, "field", "left").withColumn("tau", F.when(F.coalesce("found", F.lit(0)) < k, F.lit(1)).otherwise(F.col("m")))
        else:
            facts = facts.withColumn("tau", F.ceil(F.col("total_all") / F.lit(one_in)))
        facts = facts.withColumn("tau", F.greatest("tau", F.lit(min_count), F.lit(1))).select("field", "total_all", "err_all", F.col("tau").cast("bigint").alias("tau"))
        known = facts.collect()  # a row per field
        if not known:
            return df.sparkSession.createDataFrame([], "field string, item_value string, n bigint, low bigint, high bigint, total bigint")
        limits = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in known], facts.schema))
        wide = lambda c: F.col(c).cast("decimal(38,0)")
        # How much larger each node's error is than a quarter of its share of the threshold.
        ratio = F.ceil(wide("err") * 4 * wide("total_all") / (wide("tau") * F.greatest(wide("total"), F.lit(1).cast("decimal(38,0)"))))
        worst = int(nodes.join(limits, "field").agg(F.coalesce(F.max(ratio), F.lit(0))).first()[0])
        if worst <= 1:
            break
        if capacity >= most:
            return _finish(_undecided(df, fields, limits), k, one_in, min_count)
        capacity = min(most, capacity * max(2, worst))
    share = (F.col("n") + F.col("err")).cast("decimal(38,0)") * F.col("total_all") >= F.col("tau").cast("decimal(38,0)") * F.col("total")
    fetched = vals.join(limits, "field").filter(share).select("field", "item_value").distinct()
    kept = sums.join(fetched, ["field", "item_value"], "left_semi").join(limits, "field").withColumn("high", F.col("low") + F.col("err_all")).filter("high >= tau")
    kept = cut(kept.select("field", "item_value", "low", "high", F.col("total_all").alias("total")))
    size = kept.agg(F.coalesce(F.sum(F.octet_length("item_value") + 64), F.lit(0))).first()[0]
    side = F.broadcast(kept) if size <= BROADCAST_BYTES else kept
    exact = _entries(df, fields).join(side.select("field", "item_value"), ["field", "item_value"]).groupBy("field", "item_value").agg(F.count(F.lit(1)).alias("n"))
    return _finish(exact.join(kept, ["field", "item_value"]), k, one_in, min_count)


def _undecided(df: DataFrame, fields: dict[str, Column], limits: DataFrame) -> DataFrame:
    """Exact counts of all values that may reach their field's threshold ``tau``.

    Values share ranges of hashes; a range whose total is below the threshold
    holds no such value and is not counted again. At most ``RANGES`` rows a
    field are broadcast.
    """
    at = F.pmod(F.xxhash64("item_value"), F.lit(RANGES)).cast("int")
    e = _entries(df, fields).withColumn("__at", at)
    full = cut(e.groupBy("field", "__at").agg(F.count(F.lit(1)).alias("n")).join(limits, "field").filter("n >= tau").select("field", "__at"))
    n = e.join(F.broadcast(full), ["field", "__at"]).groupBy("field", "item_value").agg(F.count(F.lit(1)).alias("n"))
    out = n.join(limits, "field").filter("n >= tau")
    return out.select("field", "item_value", "n", F.col("n").alias("low"), F.col("n").alias("high"), F.col("total_all").alias("total"))


def _finish(out: DataFrame, k: int | None, one_in: int | None, min_count: int) -> DataFrame:
    out = out.filter(F.col("n") >= min_count)
    if one_in is not None:
        out = out.filter(F.col("n") * one_in >= F.col("total"))
    else:
        out = out.withColumn("r", F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "item_value"))).filter(F.col("r") <= k)
    return out.select("field", "item_value", "n", "low", "high", "total")
