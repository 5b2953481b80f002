"""Subscriptions: a streaming source whose offset is a log position, and exactly-once projections."""

from __future__ import annotations

import json
import os
import re
import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import CancelledError, IntegrityError, StoreTimeoutError
from ..files import Files
from ..model import LOG_SCHEMA, MAX_POSITION, Query, TrackingInfo
from ..plans.compiler import is_match_all, query_column


def _local(path: str) -> str:
    return path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path


class _Files:
    """Lists and reads a store's files without a JVM, for the source's Python processes."""

    def __init__(self, root: str):
        import pyarrow.fs as pafs

        if "://" in root and not root.startswith("file://"):
            self.fs, self.root = pafs.FileSystem.from_uri(root)
        else:
            self.fs, self.root = pafs.LocalFileSystem(), os.path.abspath(_local(root))

    def manifest(self) -> dict:
        import pyarrow.fs as pafs

        at = f"{self.root}/manifest"
        infos = self.fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
        names = sorted(i.base_name for i in infos if i.base_name.endswith(".json") and i.base_name[:-5].isdigit())
        if not names:
            return {"head": 0, "log": []}
        last = self._json(f"{at}/{names[-1]}")
        chain = [self._json(f"{at}/{n}") for n in names[:-1] if int(n[:-5]) >= last["full"]] + [last]
        return {"head": last["head"], "log": [x for m in chain for x in m["log"]]}

    def _json(self, path: str) -> dict:
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def number(self, name: str, default: int) -> int:
        """A number kept in a small file."""
        try:
            with self.fs.open_input_stream(f"{self.root}/{name}") as f:
                return int(f.read())
        except FileNotFoundError:
            return default

    def put(self, name: str, text: str) -> None:
        """Replaces a small file as a whole."""
        self.fs.create_dir(self.root, recursive=True)
        with self.fs.open_output_stream(f"{self.root}/{name}.new") as f:
            f.write(text.encode())
        self.fs.move(f"{self.root}/{name}.new", f"{self.root}/{name}")

    def parts(self, folder: str) -> list[str]:
        import pyarrow.fs as pafs

        infos = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{folder}"))
        return [f"{folder}/{i.base_name}" for i in infos if i.base_name.endswith(".parquet")]


class Span(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class LogStreamReader(DataSourceStreamReader):
    """Offsets are positions; the latest one is at most the manifest's head, so a batch never passes a commit.

    A batch has a task per Parquet file that may hold its positions, and, with
    ``maxEvents``, as many positions at most. What was given out last is kept
    in a file of the folder ``state``, for a restarted query to go on from;
    it is written before the offset is used, so it is never behind.
    """

    def __init__(self, options: dict):
        self.root = options["path"]
        self.after = int(options.get("after", 0))
        self.most = int(options.get("maxEvents", 0))
        self.state = options.get("state", "")
        self.types = json.loads(options.get("types", "null"))
        self.given: int | None = None

    def initialOffset(self) -> dict:
        return {"position": self.after}

    def latestOffset(self) -> dict:
        head = max(self.after, _Files(self.root).manifest()["head"])
        if not self.most:
            return {"position": head}
        kept = _Files(self.state)
        if self.given is None:  # the first look of a new or restarted query
            self.given = kept.number("given", self.after)
        self.given = min(head, self.given + self.most)
        kept.put("given", str(self.given))
        return {"position": self.given}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        first, last = start["position"] + 1, end["position"]
        files = _Files(self.root)
        spans = []
        for f in files.manifest()["log"]:
            if f["last"] >= first and f["first"] <= last:
                spans += [Span(p, max(first, f["first"]), min(last, f["last"])) for p in files.parts(f["path"])]
        return spans or [Span("", 1, 0)]

    def read(self, partition: Span) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        if not partition.path:
            return
        files = _Files(self.root)
        data = ds.dataset(f"{files.root}/{partition.path}", format="parquet", filesystem=files.fs)
        keep = (pc.field("position") >= partition.first) & (pc.field("position") <= partition.last)
        if self.types is not None:
            keep &= pc.field("event_type").isin(self.types)
        names = [f.name for f in LOG_SCHEMA.fields]
        for b in data.to_batches(columns=names, filter=keep):
            if b.num_rows:
                yield b


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomlog"

    def schema(self):
        return LOG_SCHEMA

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def subscribe(spark: SparkSession, root: str, query: Query | None = None, after: int | None = None, max_events: int | None = None, state: str | None = None) -> DataFrame:
    """A stream of the matching events beyond ``after``: first those there, then each commit.

    Rows of a micro-batch come unordered; sort by position inside foreachBatch.
    ``after`` at or beyond the greatest position gives a stream that stays empty.
    Where every item of the query names types, other events are left out while
    files are read. ``max_events`` bounds the positions of one micro-batch, so
    that a long history comes in many; it needs ``state``, a folder of the
    query's own beside its checkpoint, from its first start on. With such a bound use a processing-time
    trigger: ``availableNow`` ends after the first batch.
    """
    after = after or 0
    if max_events is not None and not state:
        raise ValueError("max_events needs a state folder")
    spark.dataSource.register(LogSource)
    s = spark.readStream.format("loomlog").option("path", Files(spark, root).root).option("after", str(min(after, MAX_POSITION)))
    if max_events is not None:
        s = s.option("maxEvents", str(max(1, max_events))).option("state", Files(spark, state).root)
    if not is_match_all(query) and all(i.types for i in query.items):
        s = s.option("types", json.dumps(sorted({t for i in query.items for t in i.types})))
    out = s.load().filter(F.col("position") > min(after, MAX_POSITION)).filter(query_column(query))
    return out.filter(F.lit(False)) if after >= MAX_POSITION else out


class Subscription:
    """An endless, ordered iterator over a store's matching events: those there, then each commit.

    For a consumer in the driver; ``subscribe`` is the distributed form. Reads
    chunks of ``batch`` events by position and waits ``poll`` seconds between
    looks at an unchanged head. A cancelled one raises CancelledError.
    """

    def __init__(self, store, query: Query | None = None, after: int | None = None, batch: int = 1024, poll: float = 0.2):
        self.store, self.query, self.batch, self.poll = store, query, min(max(1, batch), 4096), poll
        self.last = after or 0
        self._ready: list = []
        self._cancelled = threading.Event()

    def next_batch(self, timeout: float | None = None) -> list:
        """The next events, at least one; StoreTimeoutError if none came in ``timeout`` seconds."""
        if self._ready:
            out, self._ready = self._ready, []
            return out
        end = None if timeout is None else time.monotonic() + timeout
        while True:
            if self._cancelled.is_set():
                raise CancelledError("cancelled by user")
            if self.last >= MAX_POSITION:
                return []
            snapshot = self.store.snapshot()
            if snapshot.head > self.last:
                out = list(self.store.read(self.query, start=self.last + 1, limit=self.batch, snapshot=snapshot))
                self.last = out[-1].position if len(out) == self.batch else snapshot.head
                if out:
                    return out
                continue
            if end is not None and time.monotonic() >= end:
                raise StoreTimeoutError("nothing arrived in time")
            self._cancelled.wait(self.poll if end is None else max(0.0, min(self.poll, end - time.monotonic())))

    def next_timeout(self, timeout: float):
        """The next single event."""
        first, *self._ready = self.next_batch(timeout)
        return first

    def __iter__(self):
        return self

    def __next__(self):
        batch = self.next_batch()
        if not batch:
            raise StopIteration
        first, *self._ready = batch
        return first

    def cancel(self) -> None:
        """Ends this subscription, also from another thread."""
        self._cancelled.set()


def project(stream: DataFrame, checkpoint: str, source: str, target, fold: Callable[[DataFrame], list], available_now: bool = True):
    """Feeds a stream into another store exactly once.

    ``fold`` makes the events to append from a micro-batch sorted by position
    (a list of Event, of the size of one commit). They are appended with the
    batch's last position as tracking position of ``source``; a batch that was
    replayed after a failure is refused by that and skipped.
    """

    def step(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            last = batch.agg(F.max("position")).first()[0]
            if last is None:
                return
            events = fold(batch.orderBy("position"))
            if events:
                try:
                    target.append(events, tracking_info=TrackingInfo(source, last))
                except IntegrityError:
                    recorded = target.get_tracking_info(source)
                    if recorded is None or recorded < last:
                        raise
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def cancel_all(spark: SparkSession, queries: list | None = None) -> int:
    """Stops the given streaming queries, or else those of the session that read a store; returns how many there were."""
    active = [q for q in (spark.streams.active if queries is None else queries) if q.isActive and (queries is not None or _reads_a_store(q))]
    for q in active:
        q.stop()
    return len(active)


def _reads_a_store(query) -> bool:
    """Whether a streaming query's sources are logs: Python sources whose offsets are positions."""

    def is_log(source: dict) -> bool:
        offset = re.fullmatch(r"\W*position\W+\d+\W*", str(source.get("endOffset")))
        return "PythonMicroBatchStream" in source.get("description", "") and offset is not None

    return any(is_log(s) for s in (query.lastProgress or {}).get("sources", []))
