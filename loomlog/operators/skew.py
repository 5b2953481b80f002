"""A few keys with most rows: fragment-replicate by estimated load.

Keys are hashed to buckets, whose loads are counted map-side and stand for the
loads of the keys in them. Buckets heavier than a fair share, which hold the
heavy keys, are split into shards in proportion; shards and other buckets are
packed onto tasks, largest first. Rows are then sent to the partition of their
task, the matching side to the tasks of its keys' shards only, and joins and
aggregates run inside the tasks without another shuffle. The plan has at most
``BUCKETS_PER_TASK * tasks`` buckets, whatever the number of keys or rows.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh

BUCKETS_PER_TASK = 16


@dataclass
class Plan:
    """Where rows go: ``places`` has the tasks of each bucket (one, or one per shard), ``load`` each task's estimated rows."""

    keys: list[str]
    types: list[str]
    tasks: int
    rows: int
    places: dict[int, list[int]]
    load: list[float]

    def split(self) -> int:
        """How many buckets are split."""
        return sum(len(t) > 1 for t in self.places.values())

    def imbalance(self) -> float:
        """The fullest task's estimated load over the mean; 1 is even."""
        total = sum(self.load)
        return max(self.load) * self.tasks / total if total else 1.0


def _bucket(keys: list[str], types: list[str], tasks: int) -> Column:
    hashed = F.xxhash64(*[F.col(f"`{k}`").cast(t) for k, t in zip(keys, types, strict=True)])
    return F.pmod(hashed, F.lit(BUCKETS_PER_TASK * tasks)).cast("int")


def plan(df: DataFrame, keys: list[str], tasks: int, share: float = 0.5) -> Plan:
    """Packs the keys of ``df`` onto ``tasks``.

    One pass over the key columns and one map-side aggregate; only buckets and
    their counts are collected. A bucket of more than ``share`` of a task's
    mean load is split into one shard per such load. Null keys are a key like
    any other; an empty input gives an even plan.
    """
    types = [df.schema[k].dataType.simpleString() for k in keys]
    seen = df.groupBy(_bucket(keys, types, tasks).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    buckets = {r["b"]: r["n"] for r in seen.collect()}  # at most BUCKETS_PER_TASK a task
    rows = sum(buckets.values())
    limit = max(1, math.ceil(rows * share / tasks))
    pieces = [(n / k, b) for b, n in buckets.items() for k in [min(tasks, math.ceil(n / limit))] for _ in range(k)]
    load = [0.0] * tasks
    heap = [(0.0, t) for t in range(tasks)]
    places: dict[int, list[int]] = {b: [] for b in buckets}
    for size, b in sorted(pieces, key=lambda p: (-p[0], p[1])):
        at, t = heapq.heappop(heap)
        load[t] = at + size
        heapq.heappush(heap, (load[t], t))
        places[b].append(t)
    return Plan(keys, types, tasks, rows, places, load)


def _with_tasks(df: DataFrame, p: Plan) -> tuple[DataFrame, str]:
    """``df`` with the tasks of its key's bucket in the column named; a key the plan hasn't seen goes where its bucket number falls."""
    where, b = fresh(df, "__tasks"), fresh(df, "__b")
    table = df.sparkSession.createDataFrame(list(p.places.items()), f"`{b}` int, `{where}` array<int>")
    bucket = _bucket(p.keys, p.types, p.tasks)
    j = df.withColumn(b, bucket).join(F.broadcast(table), b, "left")  # at most BUCKETS_PER_TASK rows a task
    return j.withColumn(where, F.coalesce(where, F.array(F.pmod(F.col(b), F.lit(p.tasks)).cast("int")))).drop(b), where


def place(df: DataFrame, p: Plan, salt: list[str], name: str = "__task") -> DataFrame:
    """``df`` with each row in the partition of its task, whose number is in ``name``, for per-task work of any kind.

    A split bucket's rows spread over its shards by a hash of ``salt``, the
    same in every attempt; so ``salt`` must differ between a key's rows.
    """
    out, where = _with_tasks(df, p)
    shard = F.pmod(F.xxhash64(*[F.col(c) for c in salt], F.lit("shard")), F.size(where)).cast("int")
    return out.withColumn(name, F.element_at(where, shard + 1)).drop(where).repartitionById(p.tasks, F.col(name))


def replicate(side: DataFrame, p: Plan, name: str = "__task") -> DataFrame:
    """The matching side, in the partitions of its tasks: a key's rows go to the tasks of its bucket's shards only."""
    out, where = _with_tasks(side, p)
    return out.withColumn(name, F.explode(F.array_distinct(where))).drop(where).repartitionById(p.tasks, F.col(name))


def measured(placed: DataFrame) -> DataFrame:
    """(partition, rows): how many rows each partition of a placed table really has."""
    return placed.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def balanced_join(df: DataFrame, side: DataFrame, keys: list[str], salt: list[str], tasks: int, share: float = 0.5, p: Plan | None = None) -> DataFrame:
    """Inner join on ``keys`` (null keys match nothing) inside the plan's tasks.

    Other columns of ``side`` that ``df`` has too get the suffix ``_side``.
    """
    p = p or plan(df, keys, tasks, share)
    have = {c.lower() for c in df.columns}
    side = side.select(*[F.col(f"`{c}`").alias(c if c in keys or c.lower() not in have else f"{c}_side") for c in side.columns])
    task = fresh(side, fresh(df, "__task"))
    return place(df, p, salt, task).join(replicate(side, p, task).hint("shuffle_merge"), [*keys, task]).drop(task)


def balanced_aggregate(df: DataFrame, keys: list[str], salt: list[str], partial: dict[str, Column], merge: dict[str, Column], tasks: int, p: Plan | None = None) -> DataFrame:
    """Per-key aggregates of any kind: per key inside the plan's tasks, then the few shards of a key together.

    ``partial`` makes columns that ``merge`` puts together by name. Adds
    ``shards``, over how many tasks the key was spread. The columns used must
    be in ``df``; take others away first, all columns are moved once.
    """
    p = p or plan(df, keys, tasks)
    task = fresh(df, "__task")
    parts = place(df, p, salt, task).groupBy(*keys, task).agg(*[c.alias(n) for n, c in partial.items()])
    return parts.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()], F.count(F.lit(1)).alias("shards"))


def log_keys(log: DataFrame) -> DataFrame:
    """The keys of the log: (field, item_value, position); a tag once per event. Null types and tags are left out."""
    tags = F.transform(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: F.struct(F.lit("tags").alias("field"), t.alias("item_value")))
    own = F.array(F.struct(F.lit("event_type").alias("field"), F.col("event_type").alias("item_value")))
    x = log.select("position", F.explode(F.concat(own, tags)).alias("x"))
    return x.select("x.field", "x.item_value", "position").filter("item_value is not null")


def key_results(log: DataFrame, tasks: int, p: Plan | None = None) -> DataFrame:
    """Per event type and tag: events ``n``, ``last_position``, ``shards``."""
    x = log_keys(log)
    return balanced_aggregate(
        x,
        ["field", "item_value"],
        ["position"],
        {"__n": F.count(F.lit(1)), "__p": F.max("position")},
        {"n": F.sum("__n"), "last_position": F.max("__p")},
        tasks,
        p,
    )


def heavy_keys(log: DataFrame, tasks: int, percent: int = 2) -> DataFrame:
    """The results of the keys that at least ``percent`` of all events hold."""
    rows = log.count()
    return key_results(log, tasks).filter(F.col("n") * 100 >= F.lit(percent * rows))
