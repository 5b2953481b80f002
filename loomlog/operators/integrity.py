"""Integrity checks of a log, its index and its tracking rows; printing events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.access import tag_index


def integrity_report(log: DataFrame, index: DataFrame | None = None, tracking: DataFrame | None = None, head: int | None = None) -> DataFrame:
    """One row: rows, distinct positions, bounds, index and tracking differences, and ``ok``.

    The index must equal the log's distinct tags row by row; both are hashed
    and summed per side first, in one map-side aggregate each, so equal sides
    cost no comparison shuffle. An empty log is sound.
    """
    base = log.agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("position").alias("positions"),
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
    )

    def digest(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        h = F.xxhash64(*cols).cast("decimal(20,0)")
        return df.agg(F.struct(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)"))).alias(name))

    ok = (F.col("events") == 0) | ((F.col("first_position") == 1) & (F.col("events") == F.col("positions")) & (F.col("last_position") == F.col("events")))
    if head is not None:
        ok = ok & (F.coalesce(F.col("last_position"), F.lit(0)) == head)
    out = base
    for name, side, real in (
        ("index_ok", index, tag_index(log) if index is not None else None),
        ("tracking_ok", tracking, log.filter("tracking_info is not null").groupBy("tracking_info.source").agg(F.max("tracking_info.position").alias("position")) if tracking is not None else None),
    ):
        if side is None:
            out = out.withColumn(name, F.lit(True))
            continue
        cols = ["tag", "position"] if name == "index_ok" else ["source", "position"]
        out = out.crossJoin(F.broadcast(digest(side, cols, "__a"))).crossJoin(F.broadcast(digest(real, cols, "__b")))  # single rows
        out = out.withColumn(name, F.col("__a") == F.col("__b")).drop("__a", "__b")
    return out.withColumn("ok", ok & F.col("index_ok") & F.col("tracking_ok"))


def index_differences(log: DataFrame, index: DataFrame) -> DataFrame:
    """(tag, position, side) of index rows that only one side has."""
    real = tag_index(log).select("tag", "position")
    have = index.select("tag", "position")
    return real.exceptAll(have).withColumn("side", F.lit("missing")).unionByName(have.exceptAll(real).withColumn("side", F.lit("surplus")))


def print_events(log: DataFrame) -> DataFrame:
    """Flat text form of events: tags joined by |, payload in hex with its length."""
    return log.select(
        "position",
        "event_type",
        F.array_join("tags", "|").alias("tags"),
        "uuid",
        F.octet_length("data").cast("long").alias("data_len"),
        F.lower(F.hex("data")).alias("data_hex"),
    )
