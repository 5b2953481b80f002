"""Processing only what is new: reread from a safe horizon, take away what the ledger has."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import ConflictError
from ..files import Files
from .tables import chunked, cut


def horizons(runs: DataFrame) -> DataFrame:
    """Per source, what its furthest committed run surely took: (source, upto, asof).

    Records up to ``upto`` that had arrived by ``asof`` need no second look;
    everything else is reread. One row per source, by a map-side aggregate.
    """
    done = runs.filter("outcome = 'committed' and source is not null and position is not null and started_at is not null")
    best = done.groupBy("source").agg(F.max(F.struct("position", "started_at")).alias("b"))
    return best.select("source", F.col("b.position").alias("upto"), F.col("b.started_at").alias("asof"))


def ledger(records: DataFrame, runs: DataFrame) -> DataFrame:
    """The processed ledger: the (source, position, version) of ``records`` that a committed run took.

    A run took a record if it reached the record's position and started no
    earlier than its version (the first arrival). So a record's question is:
    what is the latest start among its source's committed runs that reached at
    least as far? That is a running maximum down the positions. It is taken
    over range chunks of (source, position) with chunk maxima carried over, so
    a source with a third of all rows is spread like any other.
    """
    done = runs.filter("outcome = 'committed' and source is not null and position is not null and started_at is not null")
    both = records.select("source", "position", "version", F.lit(1).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("started")).unionByName(
        done.select("source", "position", F.lit(None).cast(records.schema["version"].dataType).alias("version"), F.lit(0).alias("kind"), F.col("started_at").cast("timestamp_ntz").alias("started"))
    )
    t = chunked(both, [F.col("source"), F.col("position").desc(), F.col("kind")])
    inside = W.partitionBy("source", "__chunk").orderBy(F.col("position").desc(), "kind").rowsBetween(W.unboundedPreceding, 0)
    carry = t.groupBy("source", "__chunk").agg(F.max("started").alias("__m"))
    over = W.partitionBy("source").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)  # a row per source and chunk
    carry = carry.select("source", "__chunk", F.max("__m").over(over).alias("__carry"))
    latest = F.greatest(F.max("started").over(inside), F.col("__carry"))
    return (
        t.join(carry, ["source", "__chunk"])
        .withColumn("latest", latest)
        .filter("kind = 1 and latest >= version")
        .select("source", "position", "version")
    )


def unprocessed(deliveries: DataFrame, runs: DataFrame) -> DataFrame:
    """(source, position, version): the records that no committed run took, each once.

    The version is the first arrival. Failed, running and unknown runs count
    for nothing; repeated run rows change nothing; late records come out
    although a later run passed their position. Null sources and positions
    identify nothing and are left out; a null arrival is taken as never taken.
    """
    seen = deliveries.filter("source is not null and position is not null").groupBy("source", "position").agg(F.min(F.col("received_at").cast("timestamp_ntz")).alias("version"))
    h = horizons(runs)
    reread = seen.join(h, "source", "left").filter("upto is null or version is null or not (position <= upto and version <= asof)").select("source", "position", "version")
    return reread.join(ledger(reread, runs), ["source", "position", "version"], "left_anti")


class IncrementalRun:
    """Runs a step over the records not yet in its own ledger, exactly once each.

    A run reads the markers of the runs before it; its number is theirs plus
    one. It rereads records at or beyond the last marker's horizon, which is
    the oldest transaction that was open when that run read (its records may
    have appeared since), and anti-joins their (key, version) pairs with the
    ledger parts that reach as far. It writes the step's result and its own
    ledger part under new names, and then publishes one marker under its
    number. Before the marker nothing counts: a failed run leaves files that
    no one reads. If another run took the number meanwhile, what was written
    is thrown away and the run begins anew, so no record is processed twice.

    Records with a null version are always reread. Keys may be null. Equal
    rows of one run are all handed to the step, once.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], version: str):
        self.spark, self.keys, self.version = spark, keys, version
        self.files = Files(spark, root)
        self.root = self.files.root

    def markers(self) -> list[dict]:
        """What the committed runs published, in order."""
        return [json.loads(self.files.text(f"runs/{n}")) for n in self.files.names("runs") if n.endswith(".json") and n[:-5].isdigit()]

    def results(self) -> list[str]:
        return [f"{self.root}/{m['result']}" for m in self.markers()]

    def ledgers(self, since: str | None, markers: list[dict] | None = None, kind: str = "string") -> list[str]:
        """Folders of the ledger parts with null versions or any from ``since`` on; versions compare as type ``kind``."""
        markers = self.markers() if markers is None else markers
        if since is None or not markers:
            return [f"{self.root}/{m['ledger']}" for m in markers]
        rows = self.spark.createDataFrame([(m["ledger"], m["latest"], m["nulls"]) for m in markers], "l string, v string, n boolean")
        hit = rows.filter(F.col("n") | (F.col("v").cast(kind) >= F.lit(since).cast(kind)))
        return [f"{self.root}/{r['l']}" for r in hit.collect()]  # a row per run at most

    def pending(self, records: DataFrame, markers: list[dict] | None = None) -> DataFrame:
        """The records of the next run: the reread part without what the ledger has."""
        markers = self.markers() if markers is None else markers
        if not markers:
            return records
        since, kind = markers[-1]["since"], records.schema[self.version].dataType.simpleString()
        from_on = lambda df: df.filter(F.col(self.version).isNull() | (F.col(self.version) >= F.lit(since).cast(kind))) if since is not None else df
        parts = self.ledgers(since, markers, kind)
        if not parts:
            return from_on(records)
        keys = [*self.keys, self.version]
        done = from_on(self.spark.read.schema(records.select(*keys).schema).parquet(*parts))
        records = from_on(records)
        return records.join(done, [records[c].eqNullSafe(done[c]) for c in keys], "left_anti")

    def run(self, records: DataFrame, step: Callable[[DataFrame], DataFrame], opened: DataFrame | None = None, retries: int = 20) -> str:
        """Processes what is pending; returns the folder of the result.

        ``opened`` has the version column of the transactions open while
        ``records`` is read: the next horizon is the least of them, or, if none
        is open, the greatest version read. Without it everything is reread
        next time.
        """
        for _ in range(retries):
            markers = self.markers()
            name = uuid.uuid4().hex
            todo, result, part = (f"{x}/{name}" for x in ("todo", "result", "ledger"))
            low = opened.agg(F.min(self.version).cast("string")).first()[0] if opened is not None else None
            self.pending(records, markers).write.parquet(f"{self.root}/{todo}")
            batch = self.spark.read.schema(records.schema).parquet(f"{self.root}/{todo}")
            step(batch).write.parquet(f"{self.root}/{result}")
            batch.select(*self.keys, self.version).distinct().write.parquet(f"{self.root}/{part}")
            v = F.col(self.version)
            seen = batch.agg(F.max(v).cast("string").alias("latest"), F.coalesce(F.max(v.isNull()), F.lit(False)).alias("nulls")).first()
            since = low
            if opened is not None and low is None:
                since = seen["latest"] or (markers[-1]["since"] if markers else None)
            for written in (result, part):
                self.files.sync(written)
            try:
                text = json.dumps({"result": result, "ledger": part, "since": since, "latest": seen["latest"], "nulls": seen["nulls"]})
                self.files.publish(f"runs/{len(markers):010d}.json", text)
                return f"{self.root}/{result}"
            except ConflictError:
                self.files.delete(result)
                self.files.delete(part)
            finally:
                self.files.delete(todo)
        raise ConflictError("other runs kept committing first")

    def vacuum(self) -> None:
        """Deletes what failed runs left. Run it while no run is on."""
        live = {m[k] for m in self.markers() for k in ("result", "ledger")}
        for folder in ("todo", "result", "ledger"):
            for n in self.files.names(folder):
                if f"{folder}/{n}" not in live:
                    self.files.delete(f"{folder}/{n}")
        self.files.delete("todo")


def transactions(deliveries: DataFrame) -> DataFrame:
    """Upstream batches as transactions: (batch_id, version, ended); a batch begins with its first arrival and is seen whole."""
    t = F.col("received_at").cast("timestamp_ntz")
    return deliveries.filter("batch_id is not null").groupBy("batch_id").agg(F.min(t).alias("version"), F.max(t).alias("ended"))


def replay(deliveries: DataFrame, root: str, runs: int = 3) -> IncrementalRun:
    """Feeds deliveries to an ``IncrementalRun`` in ``runs`` runs, each seeing the batches there by then, old ones included.

    Records are (source, position), changed where an earlier first arrival
    appears; their version is that arrival. Batches that a run doesn't see are
    the transactions open while it reads. Nulls identify nothing and are left
    out, as are rows without a batch.
    """
    spark = deliveries.sparkSession
    inc = IncrementalRun(spark, root, ["source", "position"], "version")
    known = deliveries.filter("source is not null and position is not null and batch_id is not null")
    tx = cut(transactions(deliveries))
    ends = tx.agg(F.min("batch_id"), F.max("batch_id")).first()
    first, last = (ends[0] or 0), (ends[1] or 0)
    for k in range(1, runs + 1):
        upto = first + (last - first) * k // runs
        seen = known.filter(F.col("batch_id") <= upto)
        records = seen.groupBy("source", "position").agg(F.min(F.col("received_at").cast("timestamp_ntz")).alias("version"))
        opened = tx.filter(F.col("batch_id") > upto).select("version")
        inc.run(records, lambda df: df, opened)
    return inc
