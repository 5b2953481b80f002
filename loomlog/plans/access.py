"""Access paths of a read: scan and filter, or the tag index.

The index is the table (tag, position) of distinct tags per event. A query
whose items all carry tags is answered by relational division on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Query
from ..operators.tables import cut, fresh
from .compiler import bounds_column, is_match_all, query_column


BROADCAST_BYTES = 32 << 20


def tag_index(log: DataFrame) -> DataFrame:
    """(tag, position), each tag once per event, whatever the event repeats.

    Events with null or empty tags have no rows; null tags are skipped.
    """
    return (
        log.select("position", F.explode(F.array_distinct("tags")).alias("tag")).filter(F.col("tag").isNotNull()).select("tag", "position")
    )


def choose(query: Query | None, has_index: bool) -> str:
    """"index" if every item has tags and an index is there, else "scan"."""
    if not has_index or is_match_all(query):
        return "scan"
    return "index" if all(i.tags for i in query.items) else "scan"


def scan_plan(log: DataFrame, query: Query | None, start: int | None = None, backwards: bool = False) -> DataFrame:
    """Position bounds and type lists reach the scan; tags are tested in generated code."""
    return log.filter(bounds_column(start, backwards)).filter(query_column(query))


def index_hits(index: DataFrame, query: Query, start: int | None = None, backwards: bool = False) -> DataFrame:
    """(position, qi) of the items whose tags an event carries; types are not looked at yet.

    The item table holds the caller's query, a literal of its size; it is the
    broadcast side. Counting per (position, item) combines before the shuffle.
    """
    spark = index.sparkSession
    rows = [(qi, t, len(set(i.tags))) for qi, i in enumerate(query.items) for t in set(i.tags)]
    items = spark.createDataFrame(rows, "qi int, tag string, need int")
    wanted = sorted({t for _, t, _ in rows})
    hit = index.filter(F.col("tag").isin(wanted)).filter(bounds_column(start, backwards))
    return (
        hit.join(F.broadcast(items), "tag")
        .groupBy("position", "qi")
        .agg(F.count(F.lit(1)).alias("got"), F.first("need").alias("need"))
        .filter("got = need")
        .select("position", "qi")
    )


def index_plan(log: DataFrame, index: DataFrame, query: Query, start: int | None = None, backwards: bool = False) -> DataFrame:
    """Division on the index, then the events by position, then the types of the items that hit.

    The hits, positions and item numbers, are written and measured first. Few
    enough, they are broadcast and their bounds reach the scan of the log, so
    that payloads are fetched last and moved nowhere; else both sides are
    shuffled by position.
    """
    hits = index_hits(index, query, start, backwards)
    typed = [(qi, t) for qi, i in enumerate(query.items) for t in set(i.types)]
    free = [qi for qi, i in enumerate(query.items) if not i.types]
    qis = fresh(log, "__items")
    per_event = cut(hits.groupBy("position").agg(F.collect_set("qi").alias(qis)))  # at most one entry per item
    size = per_event.agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.sum(F.size(qis)).alias("q")).first()
    if not size["n"]:
        return log.limit(0)
    ok = F.arrays_overlap(qis, F.array(*[F.lit(x) for x in free]).cast("array<int>")) if free else F.lit(False)
    for qi in sorted({qi for qi, _ in typed}):
        ok = ok | (F.array_contains(qis, qi) & F.col("event_type").isin(sorted(t for q, t in typed if q == qi)))
    side = F.broadcast(per_event) if 48 * size["n"] + 4 * size["q"] <= BROADCAST_BYTES else per_event
    return log.filter(F.col("position").between(size["lo"], size["hi"])).join(side, "position").filter(ok).drop(qis)
