"""The stored log: Parquet files, a tag index, tracking rows, and numbered manifests.

A commit writes its files under new names, then publishes manifest v+1 under a
name that must not exist yet. Readers take the greatest manifest; its file list
is their snapshot. Two writers can't publish the same version: the loser
re-reads and judges its requests again. A manifest names only what its commit
added, and the version whose full list it goes on from; every ``FULL_EVERY``
commits one has the full list. Small parts at the end are merged when there
are ``MERGE_PARTS`` of them, so neither lists nor files grow with the commits.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, CorruptionError, EventStoreError, IntegrityError, InvalidArgumentError
from ..files import Files
from ..model import INDEX_SCHEMA, LOG_SCHEMA, MAX_POSITION, TRACKING_SCHEMA, AppendCondition, AppendRequest, Event, Query, TrackingInfo
from ..operators import conditions as C
from ..operators.integrity import integrity_report
from ..operators.read import ReadResponse, read
from ..operators.tables import global_rank
from ..operators.validate import check_event, check_tracking, error_column
from ..plans.access import tag_index
from ..plans.compiler import matches

log = logging.getLogger(__name__)

if TYPE_CHECKING:
    from ..streaming.subscribe import Subscription

SOURCE_BUCKETS = 16
GROUP_EVENTS = 2048  # events that one commit takes before it is closed; a fixed value of the protocol
FULL_EVERY = 32
MERGE_PARTS = 32
SMALL_PART = 100_000  # events below which a part is small
SMALL_BATCH = 200_000  # query parts and events of a batch whose conditions may be broadcast


@dataclass
class Snapshot:
    """A manifest: what the log is made of at one version."""

    version: int = 0
    head: int = 0
    log: list[dict] = field(default_factory=list)  # {"path", "first", "last"}
    index: list[dict] = field(default_factory=list)
    tracking: list[str] = field(default_factory=list)

    def added_to(self, old: Snapshot, full: int) -> dict:
        """The manifest of this snapshot as an addition to ``old``'s, whose last full list is that of version ``full``."""
        new = {k: getattr(self, k)[len(getattr(old, k)) :] for k in ("log", "index", "tracking")}
        return {"version": self.version, "head": self.head, "full": full} | new

    def files(self, first: int | None = None, last: int | None = None) -> list[str]:
        """Log folders that may hold positions in [first, last]."""
        return [f["path"] for f in self.log if (first is None or f["last"] >= first) and (last is None or f["first"] <= last)]


class EventStore:
    """An event log in a folder of any Hadoop file system.

    ``max_header_bytes`` bounds an event's type and tags together (None: no bound).
    """

    def __init__(self, spark: SparkSession, root: str, max_header_bytes: int | None = None):
        self.spark, self.max_header_bytes = spark, max_header_bytes
        self.files = Files(spark, root)
        self.root = self.files.root

    # Manifests -------------------------------------------------------------

    @staticmethod
    def _manifest_name(version: int) -> str:
        return f"manifest/{version:020d}.json"

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("manifest") if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict:
        try:
            return json.loads(self.files.text(self._manifest_name(version)))
        except ValueError as e:
            raise CorruptionError(f"manifest {version} can't be read") from e

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest snapshot, or that of ``version``."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return Snapshot()
        last = self._manifest(version)
        try:
            chain = [self._manifest(v) for v in range(last["full"], version)] + [last]
            lists = {k: [x for m in chain for x in m[k]] for k in ("log", "index", "tracking")}
            return Snapshot(version, last["head"], **lists)
        except (KeyError, TypeError) as e:
            raise CorruptionError(f"manifest {version} can't be read") from e

    def _publish(self, s: Snapshot, old: Snapshot | None) -> None:
        """Makes a manifest appear whole, or raises ConflictError if its version is taken; ``old`` is what it adds to, None for a full list."""
        full = s.version if old is None or old.version == 0 else self._manifest(old.version)["full"]
        if full == s.version or s.version - full >= FULL_EVERY:
            text = s.added_to(Snapshot(), s.version)
        else:
            text = s.added_to(old, full)
        self.files.publish(self._manifest_name(s.version), json.dumps(text))

    # Reading ---------------------------------------------------------------

    def _empty(self, schema) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def log(self, snapshot: Snapshot | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
        """The log of a snapshot, from the files that may hold [first, last]."""
        s = snapshot or self.snapshot()
        files = s.files(first, last)
        df = self.spark.read.schema(LOG_SCHEMA).parquet(*[f"{self.root}/{p}" for p in files]) if files else self._empty(LOG_SCHEMA)
        return df.filter(F.col("position") <= s.head)

    def index(self, snapshot: Snapshot | None = None) -> DataFrame:
        s = snapshot or self.snapshot()
        files = [f"{self.root}/{f['path']}" for f in s.index]
        return self.spark.read.schema(INDEX_SCHEMA).parquet(*files) if files else self._empty(INDEX_SCHEMA)

    def tracking(self, snapshot: Snapshot | None = None) -> DataFrame:
        """(source, position): the greatest position recorded per source."""
        s = snapshot or self.snapshot()
        files = [f"{self.root}/{p}" for p in s.tracking]
        df = self.spark.read.schema(TRACKING_SCHEMA).parquet(*files) if files else self._empty(TRACKING_SCHEMA)
        return df.groupBy("source").agg(F.max("position").alias("position"))

    def read(self, query: Query | None = None, start: int | None = None, backwards: bool = False, limit: int | None = None, snapshot: Snapshot | None = None, path: str | None = None) -> ReadResponse:
        """A read on one snapshot; files outside the position bound aren't opened.

        A limited read opens the files from its start on, four times as many
        each time, until they hold enough matches; the rest stay closed.
        """
        s = snapshot or self.snapshot()
        bound = None if start is None else min(start, MAX_POSITION)
        low, high = (None, bound) if backwards else (bound, None)
        files = sorted((f for f in s.log if (low is None or f["last"] >= low) and (high is None or f["first"] <= high)), key=lambda f: f["first"], reverse=backwards)
        k = 1 if limit else len(files)
        while True:
            part = files[:k]
            ends = (min(f["first"] for f in part), max(f["last"] for f in part)) if part else (None, None)
            log = self.log(s, *ends) if part else self._empty(LOG_SCHEMA)
            log = log.filter(F.col("position").between(*ends)) if part else log
            out = read(log, query, start, backwards, limit, index=self.index(s), path=path)
            if k >= len(files) or out.count() >= limit:
                return ReadResponse(out, lambda: s.head or None, limit, backwards=backwards)
            k *= 4

    def read_with_head(self, query: Query | None = None, start: int | None = None, backwards: bool = False, limit: int | None = None):
        return self.read(query, start, backwards, limit).collect_with_head()

    def head(self) -> int | None:
        return self.snapshot().head or None

    def get_tracking_info(self, source: str) -> int | None:
        row = self.tracking().filter(F.col("source") == source).first()
        return row["position"] if row else None

    def subscribe(self, query: Query | None = None, after: int | None = None, max_events: int | None = None, state: str | None = None) -> DataFrame:
        """A streaming DataFrame of the matching events beyond ``after``; see ``streaming.subscribe``."""
        from ..streaming.subscribe import subscribe

        return subscribe(self.spark, self.root, query, after, max_events, state)

    def follow(self, query: Query | None = None, after: int | None = None, batch: int = 1024) -> Subscription:
        """An ordered iterator in the driver over the matching events beyond ``after``, without an end."""
        from ..streaming.subscribe import Subscription

        return Subscription(self, query, after, batch)

    def view(self, name: str) -> DataFrame:
        """Registers the newest snapshot as a temporary view for SQL."""
        log = self.log()
        log.createOrReplaceTempView(name)
        return log

    def close(self) -> None:
        """Nothing is held open; here so that a store can stand in a with statement."""

    def __enter__(self) -> EventStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # Appending ---------------------------------------------------------------

    def append(self, events: Iterable[Event], condition: AppendCondition | None = None, tracking_info: TrackingInfo | None = None) -> int:
        """Appends all or nothing; returns the last event's position (0 for no events, unchecked)."""
        result = self.append_batch([AppendRequest(list(events), condition, tracking_info)])[0]
        if isinstance(result, Exception):
            raise result
        return result

    def append_batch(self, requests: list[AppendRequest], retries: int = 20) -> list[int | Exception]:
        """Judges requests in order, each seeing what those before it added.

        Requests are taken in groups of at least ``GROUP_EVENTS`` events (the
        last may have fewer), one commit each. A request that breaks a
        condition or a rule gets its error and uses no positions. Any other
        error aborts its group: nothing of it is committed, and each of its
        requests gets an error that says no more than that. An empty request
        gives 0.
        """
        out: list[int | Exception] = []
        group: list[AppendRequest] = []
        for r in requests:
            group.append(r)
            if sum(len(g.events) for g in group) >= GROUP_EVENTS:
                out += self._append_group(group, retries)
                group = []
        return out + (self._append_group(group, retries) if group else [])

    def _append_group(self, requests: list[AppendRequest], retries: int) -> list[int | Exception]:
        try:
            for k in range(retries):
                s = self.snapshot()
                results, accepted = self._judge(requests, s)
                if not accepted:
                    return results
                try:
                    self._commit(s, accepted)
                    return results
                except ConflictError:
                    time.sleep(min(1.0, 0.01 * 2**k))
            raise ConflictError("other writers kept winning")
        except Exception as e:
            if len(requests) == 1:
                raise
            log.warning("a group of %d requests was aborted", len(requests), exc_info=e)
            return [EventStoreError("the group of this request was aborted; nothing was written") for _ in requests]

    def _judge(self, requests: list[AppendRequest], s: Snapshot):
        found: dict[int, list[tuple[int, str | None]]] = {}
        if s.head and any(r.condition for r in requests):
            log = self.log(s)
            small = sum(len(i.tags) + len(i.types) + len(r.events) + 1 for r in requests if r.condition for i in r.condition.fail_if_events_match.items) <= SMALL_BATCH
            for row in C.first_matches(log, C.request_items(self.spark, requests), self.index(s), small).collect():  # at most a row per submitted event
                found.setdefault(row["req"], []).append((row["rank"], row["position"], row["uuid"]))
        sources = sorted({r.tracking_info.source for r in requests if r.tracking_info})
        tracked = {r["source"]: r["position"] for r in self.tracking(s).filter(F.col("source").isin(sources)).collect()} if sources else {}
        results: list[int | Exception] = []
        accepted: list[tuple[int, Event, TrackingInfo | None]] = []
        head = s.head
        for k, r in enumerate(requests):
            try:
                if not r.events:
                    results.append(0)
                    continue
                if r.condition is not None:
                    last = self._condition(r, [x[1:] for x in sorted(found.get(k, []))], accepted)
                    if last is not None:
                        results.append(last)
                        continue
                for e in r.events:
                    check_event(e, self.max_header_bytes)
                if r.tracking_info is not None:
                    t = r.tracking_info
                    check_tracking(t)
                    if t.source in tracked and t.position <= tracked[t.source]:
                        raise IntegrityError(f"tracking position {t.position} of {t.source!r} is not above {tracked[t.source]}")
                    tracked[t.source] = t.position
                for e in r.events:
                    head += 1
                    accepted.append((head, e, r.tracking_info))
                results.append(head)
            except (IntegrityError, InvalidArgumentError) as e:
                results.append(e)
        return results, accepted

    @staticmethod
    def _condition(r: AppendRequest, old: list[tuple[int, str | None]], accepted) -> int | None:
        """None if the condition holds; the old position for a retry; else raises."""
        after = -1 if r.condition.after is None else r.condition.after
        want = len(r.events)
        hits = list(old)
        for position, e, _ in accepted:
            if len(hits) >= want:
                break
            if position > after and matches(r.condition.fail_if_events_match, e):
                hits.append((position, e.uuid))
        if not hits:
            return None
        ids = [e.uuid for e in r.events]
        if all(ids) and [u for _, u in hits[:want]] == ids:
            return hits[want - 1][0]
        raise IntegrityError(f"condition failed: event {hits[0][0]} matches")

    def _commit(self, s: Snapshot, accepted) -> None:
        rows = [
            (p, e.event_type, list(e.tags), bytearray(e.data), e.uuid, list(e.metadata), (t.source, t.position) if t else None) for p, e, t in accepted
        ]
        self._write(s, self.spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1), accepted[-1][0], small=True)

    def _write(self, s: Snapshot, df: DataFrame, head: int, small: bool) -> None:
        name = f"{s.version + 1:020d}-{uuid.uuid4().hex}"
        (df if small else df.sortWithinPartitions("position")).write.parquet(f"{self.root}/log/{name}")
        written = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/log/{name}")
        idx = tag_index(written)
        idx = idx.coalesce(1) if small else idx.repartitionByRange("tag", "position")
        idx.sortWithinPartitions("tag", "position").write.parquet(f"{self.root}/index/{name}")
        tracked = written.filter("tracking_info is not null").groupBy("tracking_info.source").agg(F.max("tracking_info.position").alias("position"))
        tracked.coalesce(1 if small else SOURCE_BUCKETS).write.parquet(f"{self.root}/tracking/{name}")
        for part in ("log", "index", "tracking"):  # on disk before the manifest names them
            self.files.sync(f"{part}/{name}")
        new = Snapshot(
            s.version + 1,
            head,
            [*s.log, {"path": f"log/{name}", "first": s.head + 1, "last": head}],
            [*s.index, {"path": f"index/{name}", "first": s.head + 1, "last": head}],
            [*s.tracking, f"tracking/{name}"],
        )
        self._publish(new, s)
        small_parts = self._small_tail(new)
        if small_parts >= MERGE_PARTS:
            try:
                self._merge(new, len(new.log) - small_parts)
            except ConflictError:
                pass  # the winner of the next version merges

    @staticmethod
    def _small_tail(s: Snapshot) -> int:
        n = 0
        while n < len(s.log) and s.log[-1 - n]["last"] - s.log[-1 - n]["first"] < SMALL_PART:
            n += 1
        return n

    def _merge(self, s: Snapshot, keep: int) -> None:
        """Rewrites the parts of ``s`` from number ``keep`` on as one sorted part each of log, index and tracking."""
        name = f"{s.version + 1:020d}-{uuid.uuid4().hex}"
        first = s.log[keep]["first"]
        tail = Snapshot(s.version, s.head, s.log[keep:], s.index[keep:], s.tracking[keep:])
        small = s.head - first < SMALL_PART
        events, index = self.log(tail), self.index(tail)
        events = events.coalesce(1) if small else events.repartitionByRange("position")
        index = index.coalesce(1) if small else index.repartitionByRange("tag", "position")
        events.sortWithinPartitions("position").write.parquet(f"{self.root}/log/{name}")
        index.sortWithinPartitions("tag", "position").write.parquet(f"{self.root}/index/{name}")
        self.tracking(tail).coalesce(1 if small else SOURCE_BUCKETS).write.parquet(f"{self.root}/tracking/{name}")
        for part in ("log", "index", "tracking"):
            self.files.sync(f"{part}/{name}")
        one = {"first": first, "last": s.head}
        self._publish(Snapshot(s.version + 1, s.head, [*s.log[:keep], one | {"path": f"log/{name}"}], [*s.index[:keep], one | {"path": f"index/{name}"}], [*s.tracking[:keep], f"tracking/{name}"]), None)

    def bulk_load(self, events: DataFrame, order: list, retries: int = 5) -> int:
        """Appends a large DataFrame of events unconditionally, in the order of the columns ``order``.

        Positions are counted per range chunk, not by one window. Rows that
        break a rule make the whole load fail; extra columns are left out, and
        a missing tracking_info is null. Returns the new head.
        """
        bad = events.select(error_column(self.max_header_bytes).alias("e")).filter("e is not null").first()
        if bad:
            raise InvalidArgumentError(bad["e"])
        for _ in range(retries):
            s = self.snapshot()
            keep = [f.name for f in LOG_SCHEMA.fields[1:] if f.name in events.columns]
            ranked = global_rank(events, order, "__position", start=s.head).drop("position").withColumnRenamed("__position", "position")
            if "tracking_info" not in keep:
                ranked = ranked.withColumn("tracking_info", F.lit(None).cast("struct<source:string,position:bigint>"))
            ranked = ranked.select([F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in LOG_SCHEMA.fields])
            n = ranked.count()
            if n == 0:
                return s.head
            try:
                self._write(s, ranked, s.head + n, small=False)
                return s.head + n
            except ConflictError:
                continue
        raise ConflictError("other writers kept winning")

    # Upkeep ---------------------------------------------------------------

    def check(self, index: DataFrame | None = None) -> DataFrame:
        """One row of integrity figures of the newest snapshot, or of another index beside it; ``ok`` sums them up."""
        s = self.snapshot()
        return integrity_report(self.log(s), self.index(s) if index is None else index, self.tracking(s), s.head)

    def compact(self) -> None:
        """Rewrites the snapshot's files as one sorted set; old snapshots stay readable until ``vacuum``."""
        s = self.snapshot()
        if not s.head:
            return
        self._merge(s, 0)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes folders that none of the last ``keep`` manifests names, and older manifests. Run it without writers."""
        versions = self.versions()
        live = [self.snapshot(v) for v in versions[-keep:]]
        used = {f["path"] for s in live for f in [*s.log, *s.index]} | {p for s in live for p in s.tracking}
        oldest = min((self._manifest(v)["full"] for v in versions[-keep:]), default=0)
        gone = [f"{part}/{n}" for part in ("log", "index", "tracking") for n in self.files.names(part) if f"{part}/{n}" not in used]
        for rel in gone:
            self.files.delete(rel)
        for v in versions[:-keep]:
            if v < oldest:
                self.files.delete(self._manifest_name(v))
        return gone
