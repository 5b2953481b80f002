"""Shared helpers: cutting lineage into the cluster's shared folder, ranks without one big window, range lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


HOT_ROWS = 10_000  # rows of one value that a task takes without harm


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the context's.

    Only where neither is set, and only in local mode, a folder of our own.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomlog-")
        sc.setCheckpointDir(at)
    return at


def session_path(spark: SparkSession) -> str:
    """A new path in the shared folder, of those that ``release`` removes."""
    return f"{shared_dir(spark)}/loomlog-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder, with no lineage behind it.

    It survives lost executors. ``release`` removes all of a session's tables.
    """
    spark = df.sparkSession
    path = session_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what this session wrote under ``session_path``, all tables of ``cut`` among it; frames built on them can't be read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomlog-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def join_split(df: DataFrame, side: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Left join on columns that are unique in ``side`` and not null in ``df``, whatever values are hot.

    The ``tasks`` most frequent values of more than ``HOT_ROWS`` rows meet their
    side by broadcast; any other value has less than one in ``tasks`` of the
    rows and is shuffled. ``counts`` (``on`` and ``n``) says how often values
    stand in ``df``; without it they are counted, map-side first.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = counts.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(tasks).select(*on).collect()  # at most tasks rows
    if not hot:
        return df.join(side, on, "left")
    keys = F.broadcast(spark.createDataFrame([tuple(r) for r in hot], counts.select(*on).schema))
    few = F.broadcast(side.join(keys, on, "left_semi"))  # at most a row per key
    return df.join(keys, on, "left_semi").join(few, on, "left").unionByName(df.join(keys, on, "left_anti").join(side, on, "left"))


def chunked(df: DataFrame, by: list[Column], chunks: int | None = None, name: str = "__chunk") -> DataFrame:
    """``df`` cut into range chunks along ``by``, as a written table with a column ``name``.

    Chunks follow the order of ``by`` and hold about equally many rows, however
    the leading columns are skewed. The table is written, so that every use
    sees the same chunks.
    """
    spark = df.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *by).withColumn(name, F.spark_partition_id()))


def global_rank(df: DataFrame, by: list[Column], name: str = "seq", start: int = 0, chunks: int | None = None) -> DataFrame:
    """Adds 1, 2, ... along ``by`` (plus ``start``), without one window over all rows.

    Rows are shuffled once, by range; each partition is sorted and its rows are
    numbered while they are written; one count per partition is broadcast.
    ``by`` should be total: rows that tie may get each other's number, and
    equal values all fall into one partition. A column called ``name`` is
    replaced.
    """
    spark = df.sparkSession
    chunk, within, before = (fresh(df, c) for c in ("__chunk", "__in", "__before"))
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The low 33 bits of the id count a partition's rows in their order.
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    t = cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns({chunk: F.spark_partition_id(), within: inside}))
    per = t.groupBy(chunk).agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(W.orderBy(chunk).rowsBetween(W.unboundedPreceding, -1))  # one row a chunk
    offsets = per.select(chunk, F.coalesce(so_far, F.lit(0)).alias(before))
    return t.join(F.broadcast(offsets), chunk).withColumn(name, F.col(within) + F.col(before) + F.lit(start)).drop(chunk, within, before)  # as many rows as chunks


def range_lookup(df: DataFrame, point: str, ranges: DataFrame, first: str, last: str, broadcast_rows: int = 500_000) -> DataFrame:
    """Joins each row of ``df`` to the ranges [first, last] that hold its ``point``.

    Ranges are laid on buckets a quarter of their mean width, so that the join
    is an equi-join with a check of the bounds: about five bucket rows a range.
    They are broadcast if there are at most ``broadcast_rows``, else shuffled.
    Rows without a range, or with a null point, are left out.
    """
    s = ranges.agg(F.count(F.lit(1)), F.min(first), F.max(last)).first()
    n, lo, hi = s[0], s[1] or 0, s[2] or 0
    width = max(1, (hi - lo + 1) // max(1, 4 * n))
    b = fresh(df, "__bucket")
    bucket = lambda c: F.expr(f"(`{c}` - {lo}L) div {width}L")
    r = ranges.withColumn(b, F.explode(F.sequence(bucket(first), bucket(last))))
    r = F.broadcast(r) if n * 6 <= broadcast_rows else r
    return df.filter(F.col(point).isNotNull()).withColumn(b, bucket(point)).join(r, b).filter(F.col(point).between(F.col(first), F.col(last))).drop(b)
