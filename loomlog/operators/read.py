"""Reads: ordered, bounded, limited, on a fixed snapshot."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CancelledError
from ..model import Event, Query, SequencedEvent, TrackingInfo
from ..plans.access import choose, index_plan, scan_plan
from .tables import global_rank


def head_of(log: DataFrame) -> DataFrame:
    """One row ``head``: the greatest position, null on an empty log."""
    return log.agg(F.max("position").alias("head"))


def read(
    log: DataFrame,
    query: Query | None = None,
    start: int | None = None,
    backwards: bool = False,
    limit: int | None = None,
    index: DataFrame | None = None,
    ordered: bool = True,
    path: str | None = None,
) -> DataFrame:
    """The events that match, in position order (descending if backwards).

    ``start`` is inclusive; ``limit`` counts matching events and 0 gives none.
    A limited read is a top-k, an unlimited one a range sort. ``path`` forces
    "scan" or "index". Null tags count as none, a null type as the empty one.
    """
    path = path or choose(query, index is not None)
    out = index_plan(log, index, query, start, backwards) if path == "index" else scan_plan(log, query, start, backwards)
    if limit is not None and limit <= 0:
        return out.limit(0)
    if limit is not None or ordered:
        out = out.orderBy(F.col("position").desc() if backwards else F.col("position").asc())
    return out if limit is None else out.limit(limit)


def with_order(df: DataFrame, backwards: bool = False, name: str = "seq") -> DataFrame:
    """Adds each row's place in the result order, counted in parallel."""
    return global_rank(df, [F.col("position").desc() if backwards else F.col("position").asc()], name)


def response_head(log: DataFrame, result: DataFrame, limit: int | None, backwards: bool = False) -> DataFrame:
    """One row ``head``: the log's head, or under a limit the last returned position.

    The last one returned is the least when reading backwards; null if none was.
    """
    if limit is None:
        return head_of(log)
    return result.agg((F.min if backwards else F.max)("position").alias("head"))


def keyset_pages(df: DataFrame, size: int, backwards: bool = False) -> DataFrame:
    """Adds ``page``, counted from 0, of ``size`` events in result order."""
    return with_order(df, backwards).withColumn("page", F.expr(f"(seq - 1) div {int(size)}"))


def to_event(row) -> SequencedEvent:
    """A collected log row as a value."""
    t = row["tracking_info"]
    return SequencedEvent(
        row["position"],
        Event(row["event_type"], bytes(row["data"]), list(row["tags"]), row["uuid"], [(m["key"], m["value"]) for m in row["metadata"]]),
        TrackingInfo(t["source"], t["position"]) if t else None,
    )


class ReadResponse:
    """A read on one snapshot: a DataFrame, and an iterator with a head.

    Chunks hold 1 to 4096 events (1024 by default); the driver keeps no more
    than one partition besides.
    """

    def __init__(self, frame: DataFrame, head: Callable[[], int | None], limit: int | None, batch: int = 1024, backwards: bool = False):
        self._backwards, self._tag = backwards, f"read-{uuid.uuid4().hex}"
        self.frame, self._head, self._limit = frame, head, limit
        self.batch = min(max(1, batch), 4096)
        self._rows: Iterator | None = None
        self._last: int | None = None
        self._cancelled = False

    def __iter__(self) -> Iterator[SequencedEvent]:
        return self

    def __next__(self) -> SequencedEvent:
        if self._cancelled:
            raise StopIteration
        if self._rows is None:
            sc = self.frame.sparkSession.sparkContext
            sc.addJobTag(self._tag)
            try:
                self._rows = self.frame.toLocalIterator(prefetchPartitions=True)
            finally:
                sc.removeJobTag(self._tag)
        e = to_event(next(self._rows))
        self._last = e.position
        return e

    def next_batch(self) -> list[SequencedEvent]:
        out = []
        for e in self:
            out.append(e)
            if len(out) == self.batch:
                break
        return out

    def head(self) -> int | None:
        """The snapshot's head; under a limit, the position of the last event so far, or of the whole read if none was fetched yet."""
        if self._limit is None:
            return self._head()
        if self._last is None and not self._cancelled and self._limit:
            end = F.min("position") if self._backwards else F.max("position")
            self._last = self.frame.agg(end).first()[0]
        return self._last

    def collect_with_head(self) -> tuple[list[SequencedEvent], int | None]:
        out = list(self)
        return out, self._head() if self._limit is None else self._last

    def cancel(self) -> None:
        """Ends this response and stops its running jobs; later calls return nothing."""
        self._cancelled = True
        self.frame.sparkSession.sparkContext.cancelJobsWithTag(self._tag)
        self._rows = iter(())

    def raise_if_cancelled(self) -> None:
        if self._cancelled:
            raise CancelledError("cancelled by user")
