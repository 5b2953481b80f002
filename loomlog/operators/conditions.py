"""Append conditions: which requests does a snapshot forbid, and which are retries?

A batch of requests, held by the driver anyway, is tested in one pass over the
snapshot and is the broadcast side. Conditions given as a table, as many as
the log if need be, meet it in an as-of join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..model import MAX_POSITION, AppendRequest
from ..plans.access import tag_index
from ..plans.compiler import is_match_all
from .tables import chunked

FEW_KEYS = 100_000  # keys that may be broadcast
ITEM_SCHEMA = "req int, item int, types array<string>, tags array<string>, after bigint, n int"


def request_items(spark, requests: list[AppendRequest]) -> DataFrame:
    """One row per query item of each request that has a condition; a match-all query is one item without parts."""
    rows = []
    for r, q in enumerate(requests):
        if q.condition is None:
            continue
        after = -1 if q.condition.after is None else min(q.condition.after, MAX_POSITION - len(q.events) - 1)
        query = q.condition.fail_if_events_match
        items = [([], [])] if is_match_all(query) else [(sorted(set(i.types)), sorted(set(i.tags))) for i in query.items]
        rows += [(r, k, types, tags, after, max(1, len(q.events))) for k, (types, tags) in enumerate(items)]
    return spark.createDataFrame(rows, ITEM_SCHEMA)


def first_matches(log: DataFrame, items: DataFrame, index: DataFrame | None = None, small: bool = True) -> DataFrame:
    """(req, rank, position, uuid): the first ``n`` events after ``after`` that each request's query matches.

    Tagged items go by relational division on the tag index; items with types
    only join on the type; match-all items need only positions, which are
    gapless. The ranking keeps ``n`` rows of a request per partition before it
    shuffles, so a query that matches half the log moves little. ``small``
    allows the items to be broadcast; EventStore sets it by their number.
    """
    hint = F.broadcast if small else lambda df: df
    idx = tag_index(log) if index is None else index.select("tag", "position")
    need = hint(items.filter(F.size("tags") > 0).withColumn("need", F.size("tags")).withColumn("tag", F.explode("tags")).select("req", "item", "tag", "need", "after", "n"))
    hits = (
        idx.join(need, "tag")
        .filter(F.col("position") > F.col("after"))
        .groupBy("req", "item", "position")
        .agg(F.count(F.lit(1)).alias("got"), F.first("need").alias("need"), F.first("n").alias("n"))
        .filter("got = need")
        .select("req", "item", "position", "n")
    )
    types = hint(items.select("req", "item", "types"))
    core = log.select("position", "event_type", "uuid")
    tagged = hits.join(core, "position").join(types, ["req", "item"]).filter((F.size("types") == 0) | F.array_contains("types", F.col("event_type")))
    by_type = hint(
        items.filter((F.size("tags") == 0) & (F.size("types") > 0)).withColumn("event_type", F.explode("types")).select("req", "event_type", "after", "n")
    )
    typed = core.join(by_type, "event_type").filter(F.col("position") > F.col("after"))
    free = items.filter((F.size("tags") == 0) & (F.size("types") == 0)).withColumn("from", F.greatest(F.col("after"), F.lit(0)))
    wanted = free.select("req", "n", F.explode(F.expr("sequence(`from` + 1, `from` + n)")).alias("position"))
    everything = core.join(hint(wanted), "position")
    cols = ["req", "n", "position", "uuid"]
    # A request's items may meet the same event: keep one row of each.
    both = tagged.select(cols).unionByName(typed.select(cols)).unionByName(everything.select(cols)).dropDuplicates(["req", "position"])
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("req").orderBy("position")))
    return ranked.filter(F.col("rank") <= F.col("n")).select("req", "rank", "position", "uuid")


def next_match(events: DataFrame, asks: DataFrame) -> DataFrame:
    """(req, p): for each ask (req, key, after) the least event position of its key beyond ``after``.

    An as-of join: events and asks are put in one order, positions falling, and
    a running minimum of the events is read off at each ask. It runs over range
    chunks of (key, position) with chunk minima carried over, so neither a key
    that half the events have nor one that many ask for makes a large task, and
    the work grows with events plus asks, not with their product.
    """
    both = events.select("key", F.col("position").alias("at"), F.lit(None).cast(asks.schema["req"].dataType).alias("req"), F.lit(1).alias("kind")).unionByName(
        asks.select("key", F.col("after").alias("at"), "req", F.lit(0).alias("kind"))
    )
    t = chunked(both, [F.col("key"), F.col("at").desc(), F.col("kind")])
    event = F.when(F.col("kind") == 1, F.col("at"))
    inside = W.partitionBy("key", "__chunk").orderBy(F.col("at").desc(), "kind").rowsBetween(W.unboundedPreceding, 0)
    least = t.groupBy("key", "__chunk").agg(F.min(event).alias("m"))
    over = W.partitionBy("key").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)  # a row per key and chunk
    carry = least.select("key", "__chunk", F.min("m").over(over).alias("carry"))
    return t.withColumn("m", F.min(event).over(inside)).join(carry, ["key", "__chunk"]).filter("kind = 0").select("req", F.least("m", "carry").alias("p"))


def check_conditions(log: DataFrame, conditions: DataFrame) -> DataFrame:
    """Many simple conditions against one snapshot, as rows: (req, tag, event_type, after) in, verdicts out.

    A null tag or type is no demand; a null ``after`` looks at the whole log.
    Out: ``req``, ``violated``, ``first_match`` (null if none), a row for each
    condition. Conditions may be as many as the log. Those with a tag, a type,
    or both meet the events in one as-of join on that key; only the forms of
    key that occur among the conditions are made of the events. Conditions
    without any demand need nothing but the next position.
    """
    after = F.least(F.coalesce(F.col("after"), F.lit(-1)), F.lit(MAX_POSITION - 1))
    asked = conditions.select("req", F.col("tag").alias("t"), F.col("event_type").alias("e"), after.alias("after"))
    forms = {(r["t"], r["e"]) for r in asked.select(F.col("t").isNotNull().alias("t"), F.col("e").isNotNull().alias("e")).distinct().collect()}  # at most four
    shape = lambda t, e: F.struct(t.cast("string").alias("t"), e.cast("string").alias("e"))
    none = F.lit(None)
    per_event = []
    if (False, True) in forms:
        per_event.append(F.array(shape(none, F.col("event_type"))))
    tags = F.filter(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: t.isNotNull())
    if (True, False) in forms:
        per_event.append(F.transform(tags, lambda t: shape(t, none)))
    if (True, True) in forms:
        per_event.append(F.transform(tags, lambda t: shape(t, F.col("event_type"))))
    head = F.broadcast(log.agg(F.max("position").alias("head")))  # one row
    step = F.greatest(F.col("after") + 1, F.lit(1))
    found = asked.filter("t is null and e is null").crossJoin(head).select("req", F.when(step <= F.col("head"), step).alias("p"))
    if per_event:
        wanted = asked.filter("t is not null or e is not null").select("req", shape(F.col("t"), F.col("e")).alias("key"), "after")
        events = log.select("position", F.explode(F.concat(*per_event)).alias("key"))
        keys = wanted.select("key").distinct()
        if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS:  # few are asked for: leave out other events before anything moves
            events = events.join(F.broadcast(keys), "key", "left_semi")
        found = found.unionByName(next_match(events, wanted))
    return found.select("req", F.col("p").isNotNull().alias("violated"), F.col("p").alias("first_match"))


def idempotent_matches(first: DataFrame, submitted: DataFrame) -> DataFrame:
    """Which requests are retries: (req, position) of those whose first N matches carry exactly the N submitted uuids.

    ``submitted`` has (req, rank, uuid). A null uuid anywhere makes it no retry.
    """
    s = submitted.groupBy("req").agg(F.count(F.lit(1)).alias("n"), F.count("uuid").alias("ids"))
    j = first.join(submitted.withColumnRenamed("uuid", "want"), ["req", "rank"]).filter(F.col("uuid") == F.col("want"))
    got = j.groupBy("req").agg(F.count(F.lit(1)).alias("same"), F.max("position").alias("position"))
    return got.join(s, "req").filter("same = n and ids = n").select("req", "position")


def assign_tracking(requests: DataFrame) -> DataFrame:
    """Which tracked records rise strictly within their source, in ``seq`` order: adds ``violates``.

    Every position is held against the greatest one before it. An accepted one
    is always above all before it and a refused one never raises that maximum,
    so this equals the serial rule. Rows of one source are cut into chunks by
    sequence; chunk maxima are carried over, so no source fills one task.
    """
    t = chunked(requests, [F.col("source"), F.col("seq")])
    inside = W.partitionBy("source", "__chunk").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    carry = t.groupBy("source", "__chunk").agg(F.max("position").alias("__m"))
    over = W.partitionBy("source").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)  # a row per chunk
    carry = carry.select("source", "__chunk", F.max("__m").over(over).alias("__carry"))
    before = F.greatest(F.max("position").over(inside), F.col("__carry"))
    return (
        t.join(carry, ["source", "__chunk"])
        .withColumn("violates", F.coalesce(F.col("position") <= before, F.lit(False)))
        .drop("__chunk", "__carry")
    )
