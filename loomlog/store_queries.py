"""Registered queries that go through a stored log: loads, appends, snapshots, streams and checks, and their SQL.

Every query loads the whole log into a store of its own in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import IntegrityError
from .model import AppendCondition, AppendRequest, Event, Query, QueryItem, TrackingInfo
from .operators.integrity import index_differences
from .operators.read import with_order
from .operators.tables import cut, session_path
from .queries import BERTH, BOTH, CARGO, DESK, FARE, FLAT, OR_ITEMS, SQL_BOTH, SQL_OR, TENANT, TYPES, UNNESTED, WEB, Queries, flat
from .sources.store import EventStore
from .sources.tables import event_log

TAGS = [TENANT, DESK, WEB, "audit:sample", "no:such-tag"]
KINDS = ["", BERTH, CARGO, FARE]
AFTERS = [None, 600, 9_990]


def loaded(spark: SparkSession, d: str, where: str = "true") -> EventStore:
    store = EventStore(spark, session_path(spark))
    store.bulk_load(event_log(spark, d).filter(where), [F.col("position")])
    return store


def _rows(spark: SparkSession, names: list[str], results: list) -> DataFrame:
    """A row per request: accepted (its position), refused (null)."""
    rows = [(n, "refused", None) if isinstance(r, IntegrityError) else (n, "done", r) for n, r in zip(names, results, strict=True)]
    return spark.createDataFrame(rows, "req string, outcome string, position bigint")


def _conditions() -> list[tuple[str, str, str, int | None]]:
    return [(f"{t}/{k}/{a}", t, k, a) for t in TAGS for k in KINDS for a in AFTERS]


def store_conditions(spark: SparkSession, d: str) -> DataFrame:
    """One group of conditional appends against the stored log, judged by its index; each adds an event of a tag of its own."""
    store = loaded(spark, d)
    asks = _conditions()
    requests = [AppendRequest([Event("Decided", b"", [f"decision:{n}"])], AppendCondition(Query([QueryItem([k] if k else [], [t])]), a)) for n, t, k, a in asks]
    return _rows(spark, [n for n, *_ in asks], store.append_batch(requests))


def store_retries(spark: SparkSession, d: str) -> DataFrame:
    """Requests sent again: the first two events of each tag, known by their ids; done if both ids are there and stand first."""
    store = loaded(spark, d)
    names, requests = [], []
    for t in TAGS:
        query = Query([QueryItem([], [t])])
        old = [e.event for e in store.read(query, limit=2)]
        for n, events in ((t, old), (f"{t}/swapped", old[::-1])):
            names.append(n)
            requests.append(AppendRequest(events or [Event("New", b"", [f"own:{n}"])], AppendCondition(query)))
    return _rows(spark, names, store.append_batch(requests))


def store_tracked(spark: SparkSession, d: str) -> DataFrame:
    """Tracked appends for every source of the log: its greatest position again, one above, that one again, two above."""
    store = loaded(spark, d)
    top = {r["source"]: r["position"] for r in store.tracking().collect()}  # a row per source
    names, requests = [], []
    for s in sorted(top):
        for k, step in enumerate((0, 1, 1, 3)):
            names.append(f"{s}/{k}")
            requests.append(AppendRequest([Event("Seen", b"", [])], None, TrackingInfo(s, top[s] + step)))
    return _rows(spark, names, store.append_batch(requests))


def store_batches(spark: SparkSession, d: str) -> DataFrame:
    """Unconditional and conditional appends of growing size in one call, across commits; the log's tail read back."""
    store = loaded(spark, d)
    head = store.head() or 0
    sizes = [1, 700, 1400, 5, 2500, 1]
    requests = [AppendRequest([Event("Batch", b"", [f"batch:{k}"]) for _ in range(n)], AppendCondition(Query([QueryItem([], [f"batch:{k - 1}"])]), None if k == 3 else head + 10_000)) for k, n in enumerate(sizes)]
    store.append_batch(requests)
    return flat(store.read(start=head + 1).frame)


def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The log loaded into a store and read back backwards through its index."""
    return flat(with_order(loaded(spark, d).read(BOTH, backwards=True).frame, True))


def snapshot_read(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot taken after 800 events, read when the whole log is there."""
    store = loaded(spark, d, "position <= 800")
    then = store.snapshot()
    store.bulk_load(event_log(spark, d).filter("position > 800"), [F.col("position")])
    return flat(with_order(store.read(OR_ITEMS, snapshot=then).frame))


def subscribe_catchup(spark: SparkSession, d: str) -> DataFrame:
    """The stored log followed from position 500 by a stream into a table, in micro-batches of bounded size."""
    store = loaded(spark, d)
    at = session_path(spark)
    most = max(2000, -(-(store.head() or 0) // 4))
    stream = store.subscribe(TYPES, after=500, max_events=most, state=f"{at}/state")
    w = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").start()
    try:
        w.processAllAvailable()
    finally:
        w.stop()
    return flat(with_order(spark.read.schema(stream.schema).parquet(f"{at}/out")))


def tracking_lookup(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d).tracking()


def _damaged(store: EventStore) -> DataFrame:
    """The store's index without every 97th position's rows and with a row too many for every 500th."""
    index = store.index()
    lost = index.filter("position % 97 <> 0")
    extra = index.filter("position % 500 = 0").select("position").distinct().select(F.lit("no:such-tag").alias("tag"), "position")
    return cut(lost.unionByName(extra))


def index_check(spark: SparkSession, d: str) -> DataFrame:
    """The rows in which a damaged copy of a stored index differs from the log."""
    store = loaded(spark, d)
    return index_differences(store.log(), _damaged(store))


def integrity_check(spark: SparkSession, d: str) -> DataFrame:
    """The report on a stored log, with its own index and with a damaged copy of it."""
    store = loaded(spark, d)
    own = store.check().withColumn("index", F.lit("own"))
    r = own.unionByName(store.check(_damaged(store)).withColumn("index", F.lit("damaged")))
    return r.select("index", "events", "positions", "first_position", "last_position", F.col("index_ok").cast("string").alias("index_ok"), F.col("ok").cast("string").alias("ok"))


def queries() -> Queries:
    every = (store_conditions, store_retries, store_tracked, store_batches, store_round_trip, snapshot_read, subscribe_catchup, tracking_lookup, index_check, integrity_check)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    asks = ", ".join(f"({i}, '{n}', '{t}', '{k}', {-1 if a is None else a})" for i, (n, t, k, a) in enumerate(_conditions()))
    tags = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TAGS))
    head = "(SELECT count(*) FROM sequenced_events)"
    done = f"row_number() OVER (PARTITION BY ok ORDER BY i) + {head}"
    outcome = "CASE WHEN ok THEN 'done' ELSE 'refused' END AS outcome"
    events = "count(*) AS events, count(DISTINCT position) AS positions, min(position) AS first_position, max(position) AS last_position"
    return {
        "store_conditions": f"""
            WITH a(i, req, tag, kind, after) AS (VALUES {asks}),
            r AS (SELECT i, req, NOT EXISTS (SELECT 1 FROM sequenced_events e WHERE list_contains(e.tags, a.tag) AND (a.kind = '' OR e.event_type = a.kind) AND e.position > a.after) AS ok FROM a)
            SELECT req, {outcome}, CASE WHEN ok THEN {done} END AS position FROM r""",
        "store_retries": f"""
            WITH a(i, tag) AS (VALUES {tags}),
            f AS (SELECT i, a.tag, u.position, e.uuid, row_number() OVER (PARTITION BY a.tag ORDER BY u.position) AS k FROM a JOIN {UNNESTED} u ON u.tag = a.tag JOIN sequenced_events e ON e.position = u.position),
            t AS (SELECT a.i, a.tag, count(f.position) AS n, count(uuid) AS ids, max(f.position) AS p, max(CASE WHEN k = 1 THEN uuid END) = max(CASE WHEN k = 2 THEN uuid END) AS same
                  FROM a LEFT JOIN f ON f.tag = a.tag AND k <= 2 GROUP BY 1, 2),
            q AS (SELECT 2 * i AS i, tag AS req, n, n = ids AND n > 0 AS again, p FROM t UNION ALL SELECT 2 * i + 1, tag || '/swapped', n, n = ids AND n > 0 AND (n = 1 OR same), p FROM t),
            r AS (SELECT *, n = 0 AS ok FROM q)
            SELECT req, CASE WHEN n = 0 OR again THEN 'done' ELSE 'refused' END AS outcome, CASE WHEN n = 0 THEN {done} WHEN again THEN p END AS position FROM r""",
        "store_tracked": f"""
            WITH s AS (SELECT DISTINCT tracking_info.source AS source FROM sequenced_events WHERE tracking_info IS NOT NULL), k AS (SELECT * FROM range(4) r(k)),
            r AS (SELECT row_number() OVER (ORDER BY source, k) AS i, source || '/' || k AS req, k IN (1, 3) AS ok FROM s, k)
            SELECT req, {outcome}, CASE WHEN ok THEN {done} END AS position FROM r""",
        "store_batches": f"""
            WITH b(k, n) AS (VALUES (0, 1), (1, 700), (2, 1400), (4, 2500), (5, 1)),
            e AS (SELECT row_number() OVER (ORDER BY k) AS i, k FROM (SELECT k, unnest(range(n)) FROM b))
            SELECT {head} + i AS position, 'Batch' AS event_type, 'batch:' || k AS tags, '' AS data FROM e""",
        "store_round_trip": f"SELECT row_number() OVER (ORDER BY position DESC) AS seq, {FLAT} FROM sequenced_events WHERE {SQL_BOTH}",
        "snapshot_read": f"SELECT row_number() OVER (ORDER BY position) AS seq, {FLAT} FROM sequenced_events WHERE ({SQL_OR}) AND position <= 800",
        "subscribe_catchup": f"SELECT row_number() OVER (ORDER BY position) AS seq, {FLAT} FROM sequenced_events WHERE event_type IN ('{BERTH}', '{FARE}') AND position > 500",
        "tracking_lookup": "SELECT tracking_info.source AS source, max(tracking_info.position) AS position FROM sequenced_events WHERE tracking_info IS NOT NULL GROUP BY 1",
        "index_check": f"""
            SELECT tag, position, 'missing' AS side FROM {UNNESTED} WHERE position % 97 = 0
            UNION ALL SELECT DISTINCT 'no:such-tag', position, 'surplus' FROM {UNNESTED} WHERE position % 500 = 0""",
        "integrity_check": f"""
            WITH e AS (SELECT {events} FROM sequenced_events)
            SELECT 'own' AS index, e.*, 'true' AS index_ok, 'true' AS ok FROM e UNION ALL SELECT 'damaged', e.*, 'false', 'false' FROM e""",
    }
