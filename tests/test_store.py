"""The store's semantics, on small logs."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from loomlog import AppendCondition, AppendRequest, Event, IntegrityError, InvalidArgumentError, Query, QueryItem, TrackingInfo
from loomlog.model import LOG_SCHEMA, MAX_POSITION
from loomlog.operators.read import read
from loomlog.plans.access import tag_index
from loomlog.plans.compiler import matches
from loomlog.sources.store import EventStore


def E(t, *tags, **k):
    return Event(t, k.pop("data", b"d"), list(tags), **k)


def Q(*items):
    return Query([QueryItem(*i) for i in items])


@pytest.fixture()
def store(spark, tmp_path):
    return EventStore(spark, f"file://{tmp_path}/s")


def at(store, *a, **k):
    events, head = store.read_with_head(*a, **k)
    return [e.position for e in events], head


def test_empty_store(store):
    assert store.head() is None
    assert at(store) == ([], None)
    assert store.get_tracking_info("s") is None
    assert store.append([]) == 0
    assert store.check().first()["ok"]


def test_conformance_log(store):
    assert store.append([E("type1", "tagX", data=b"data1", metadata={"source": "s", "correlation_id": "c"})]) == 1
    assert store.append([E("type2", "tagA", "tagB", data=b"data2"), E("type3", "tagA", "tagC", data=b"data3")]) == 3
    assert store.head() == 3
    assert at(store) == ([1, 2, 3], 3)
    assert at(store, backwards=True) == ([3, 2, 1], 3)
    assert at(store, start=2) == ([2, 3], 3)
    assert at(store, start=2, backwards=True) == ([2, 1], 3)
    assert at(store, start=2, limit=1) == ([2], 2)
    assert at(store, start=2, limit=1, backwards=True) == ([2], 2)
    assert at(store, start=11, limit=10) == ([], None)
    assert at(store, start=11, limit=10, backwards=True) == ([3, 2, 1], 1)
    assert at(store, start=0, backwards=True) == ([], 3)
    assert at(store, limit=0) == ([], None)
    two = Q((["type2"], ["tagB"]), (["type3"], ["tagC"]))
    assert at(store, two) == ([2, 3], 3)
    assert at(store, Query(two.items[::-1]), backwards=True, limit=1) == ([3], 3)
    assert at(store, Q(([], ["tagA"]), (["type2"], ["tagA", "tagB"]))) == ([2, 3], 3)
    refused = [
        AppendCondition(),
        AppendCondition(after=1),
        AppendCondition(Q((["type1"], []))),
        AppendCondition(Q((["type2"], [])), 1),
        AppendCondition(Q(([], ["tagX"]))),
        AppendCondition(Q(([], ["tagA"])), 1),
        AppendCondition(Q((["type3"], ["tagA", "tagC"])), 2),
    ]
    results = store.append_batch([AppendRequest([E("type4")], c) for c in refused])
    assert all(isinstance(r, IntegrityError) for r in results)
    allowed = [
        None,
        AppendCondition(Q((["typeN"], []))),
        AppendCondition(Q(([], ["tagY"]))),
        AppendCondition(Q((["type1"], [])), 1),
        AppendCondition(Q(([], ["tagX"])), 1),
        AppendCondition(Q((["type1"], ["tagX"])), 1),
        AppendCondition(after=MAX_POSITION),
    ]
    assert store.append_batch([AppendRequest([E("type4")], c) for c in allowed]) == [4, 5, 6, 7, 8, 9, 10]
    first = store.read(limit=1).next_batch()[0]
    assert first.event.metadata == [("source", "s"), ("correlation_id", "c")] and first.event.data == b"data1"
    assert store.check().first()["ok"]


def test_batch_sees_its_own_writes(store):
    x = Q(([], ["x"]))
    out = store.append_batch([AppendRequest([E("a", "x")]), AppendRequest([E("b")], AppendCondition(x)), AppendRequest([E("c")], AppendCondition(x, 1))])
    assert out[0] == 1 and isinstance(out[1], IntegrityError) and out[2] == 2
    assert store.head() == 2
    out = store.append_batch([AppendRequest([E("d")]), AppendRequest([E("e")], AppendCondition()), AppendRequest([E("f")], AppendCondition(after=10))])
    assert out[0] == 3 and isinstance(out[1], IntegrityError) and out[2] == 4


def test_idempotent_retries(store):
    e1, e2 = E("a", uuid=str(uuid.uuid4())), E("b", uuid=str(uuid.uuid4()))
    every = AppendCondition()
    assert store.append([e1], every) == 1
    assert store.append([e1], every) == 1
    assert store.append([e2]) == 2
    assert store.append([e1, e2], every) == 2
    with pytest.raises(IntegrityError):
        store.append([e2], every)
    with pytest.raises(IntegrityError):
        store.append([e2, e1], every)
    with pytest.raises(IntegrityError):
        store.append([E("a")], every)
    assert store.append([e1]) == 3  # no condition, no deduplication
    f1, f2 = E("f", "k", uuid=str(uuid.uuid4())), E("g", "k", uuid=str(uuid.uuid4()))
    k = AppendCondition(Q(([], ["k"])))
    assert store.append_batch([AppendRequest([f1]), AppendRequest([f2]), AppendRequest([f1, f2], k)]) == [4, 5, 5]
    # a retry skips the tracking check
    assert store.append([f1, f2], k, TrackingInfo("s", 1)) == 5
    assert store.get_tracking_info("s") is None


def test_tracking(store):
    t = lambda n: AppendRequest([E("a")], None, TrackingInfo("S", n))
    out = store.append_batch([t(5), t(5), t(6)])
    assert out[0] == 1 and isinstance(out[1], IntegrityError) and out[2] == 2
    assert store.get_tracking_info("S") == 6
    with pytest.raises(IntegrityError):
        store.append([E("a")], tracking_info=TrackingInfo("S", 6))
    with pytest.raises(InvalidArgumentError):
        store.append([E("a")], tracking_info=TrackingInfo("é" * 128, 6))
    assert store.head() == 2 and store.check().first()["ok"]


def test_rejections_leave_nothing(spark, tmp_path):
    s = EventStore(spark, f"file://{tmp_path}/r", max_header_bytes=4000)
    for bad in (E("a", "t" * 5000), E("t" * 5000), E("a", metadata=[("k", "1"), ("k", "2")]), E("a", metadata=[("k" * 70000, "")]), E("a", metadata=[("k", "v" * 70000)])):
        with pytest.raises(InvalidArgumentError):
            s.append([E("ok"), bad])
    assert s.head() is None
    with pytest.raises(InvalidArgumentError):
        Event(uuid="nonsense")


def test_snapshot_compaction_and_chunks(store):
    store.append([E("a", "t", data=b"x" * 100_000) for _ in range(300)])
    r = store.read()
    store.append([E("a") for _ in range(50)])
    assert len(r.next_batch()) == 300 and r.next_batch() == [] and r.head() == 300
    assert at(store, start=299)[0][:3] == [299, 300, 301]
    before = store.snapshot()
    store.compact()
    assert store.check().first()["ok"] and store.head() == 350
    assert store.log(before).count() == 350
    store.vacuum()
    assert at(store, Q(([], ["t"])), limit=2, backwards=True) == ([300, 299], 299)
    c = store.read()
    c.cancel()
    assert c.next_batch() == []


def test_conflicting_writer_judges_again(store):
    store.append([E("a")])
    old = store.snapshot()
    store.append([E("b", "x")])
    calls = []
    real = store.snapshot
    store.snapshot = lambda version=None: old if version is None and not calls and not calls.append(1) else real(version)
    assert store.append([E("c")], AppendCondition(Q(([], ["y"])))) == 3
    calls.clear()
    with pytest.raises(IntegrityError):
        store.append([E("d")], AppendCondition(Q(([], ["x"]))))


def test_random_queries_agree(spark):
    """Scan, index and the plain matcher find the same events; empty, repeated and missing parts included."""
    rng = random.Random(5)
    tags, types = [f"t{i}" for i in range(6)], ["A", "B", ""]
    events = [E(rng.choice(types), *[rng.choice(tags) for _ in range(rng.randrange(5))]) for _ in range(200)]
    rows = [(i + 1, e.event_type, e.tags, bytearray(e.data), None, [], None) for i, e in enumerate(events)]
    log = spark.createDataFrame(rows, LOG_SCHEMA).cache()
    index = tag_index(log).cache()
    for _ in range(12):
        items = [QueryItem(rng.sample(types, rng.randrange(3)), [rng.choice(tags) for _ in range(rng.randrange(1, 4))]) for _ in range(rng.randrange(1, 4))]
        q, start = Query(items), rng.choice([None, 50, 150])
        for backwards in (False, True):
            want = [i + 1 for i, e in enumerate(events) if matches(q, e) and (start is None or (i + 1 <= start if backwards else i + 1 >= start))]
            want = want[::-1] if backwards else want
            for path in ("scan", "index"):
                got = [r["position"] for r in read(log, q, start, backwards, None, index, path=path).select("position").collect()]
                assert got == want
    assert log.filter(F.lit(True)).count() == 200


def test_subscription(store, spark, tmp_path):
    from loomlog.streaming.subscribe import cancel_all, project

    store.append([E("a", "x"), E("b"), E("a", "x")])
    q = store.subscribe(Q(([], ["x"])), after=1).writeStream.format("memory").queryName("sub_x").start()
    q.processAllAvailable()
    assert [r["position"] for r in spark.table("sub_x").collect()] == [3]
    store.append([E("c", "x")])
    q.processAllAvailable()
    assert sorted(r["position"] for r in spark.table("sub_x").collect()) == [3, 4]
    assert cancel_all(spark) >= 1
    q = store.subscribe(after=MAX_POSITION).writeStream.format("memory").queryName("sub_none").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sub_none").count() == 0

    target = EventStore(spark, f"file://{tmp_path}/target")
    fold = lambda df: [E("seen", data=str(r["position"]).encode()) for r in df.select("position").collect()]
    for k in range(2):  # the second run starts without its checkpoint and is refused by the tracking position
        project(store.subscribe(), f"{tmp_path}/cp{k}", "up", target, fold).awaitTermination()
    assert target.head() == 4 and target.get_tracking_info("up") == 4


def test_stream_in_bounded_batches(store, spark, tmp_path):
    from loomlog.streaming.subscribe import cancel_all

    store.append([E("a" if k % 3 else "b") for k in range(20)])
    sizes = []

    def start():
        s = store.subscribe(Q((["a"], [])), max_events=6, state=f"{tmp_path}/state")
        return s.writeStream.foreachBatch(lambda df, _: sizes.append(sorted(r["position"] for r in df.select("position").collect()))).option("checkpointLocation", f"{tmp_path}/cp").start()

    q = start()
    q.processAllAvailable()
    assert cancel_all(spark) == 1 and cancel_all(spark) == 0
    first = len(sizes)
    assert all(len(x) <= 6 for x in sizes)
    store.append([E("a") for _ in range(15)])
    q = start()  # goes on where it was, still in small batches
    q.processAllAvailable()
    q.stop()
    assert sorted(p for x in sizes for p in x) == [k + 1 for k in range(20) if k % 3] + list(range(21, 36))
    assert all(len(x) <= 6 for x in sizes) and len(sizes) >= first + 3
    with pytest.raises(ValueError):
        store.subscribe(max_events=5)


def test_many_commits_stay_small(store, monkeypatch):
    """Manifests are additions to full lists, and small parts are merged; every version stays readable until vacuum."""
    from loomlog.sources import store as module

    monkeypatch.setattr(module, "FULL_EVERY", 3)
    monkeypatch.setattr(module, "MERGE_PARTS", 4)
    for k in range(9):
        store.append([E("a", f"t{k}")], tracking_info=TrackingInfo("s", k))
    assert at(store)[0] == list(range(1, 10)) and store.get_tracking_info("s") == 8
    assert len(store.snapshot().log) <= 4 and store.check().first()["ok"]
    heads = [store.snapshot(v).head for v in store.versions()]
    assert heads == sorted(heads) and heads[-1] == 9
    store.vacuum()
    assert at(store, Q(([], ["t3"]))) == ([4], 9) and store.check().first()["ok"]


def test_aborted_group(store, monkeypatch):
    """An unexpected failure commits nothing of its group; the others' errors don't tell its cause."""
    from loomlog import EventStoreError
    from loomlog.sources import store as module

    monkeypatch.setattr(module, "GROUP_EVENTS", 2)
    real, calls = store._commit, []

    def fail(s, accepted):
        calls.append(len(accepted))
        if len(calls) == 1:
            raise OSError("secret disk")
        return real(s, accepted)

    monkeypatch.setattr(store, "_commit", fail)
    out = store.append_batch([AppendRequest([E("a")]), AppendRequest([E("b")]), AppendRequest([E("c")])])
    assert [type(x) for x in out[:2]] == [EventStoreError] * 2 and "secret" not in str(out[0]) and out[2] == 1
    assert store.head() == 1 and calls == [2, 1]


def test_cancel_stops_jobs(spark, store):
    store.append([E("a") for _ in range(3)])
    r = store.read(limit=2)
    assert r.head() == 2
    slow = spark.range(8, numPartitions=8).select(F.expr("cast(java_method('java.lang.Thread', 'sleep', 60000L) as string) as s"))
    r.frame = slow
    import threading
    import time as clock

    threading.Timer(3, r.cancel).start()
    began = clock.time()
    try:
        assert r.next_batch() == []
    except Exception as e:  # the job's own cancellation may surface
        assert "cancel" in str(e).lower()
    assert clock.time() - began < 40


def test_command_line(store, spark, capsys, tmp_path):
    import json

    from loomlog.__main__ import main

    rows = [(k, "a" if k % 2 else "b", ["t", f"x{k}"], bytearray(b"d"), None, [], None) for k in range(1, 7)]
    spark.createDataFrame(rows, LOG_SCHEMA).write.parquet(f"{tmp_path}/in")
    run = lambda *a: (main([store.root, *a], spark), [json.loads(x) for x in capsys.readouterr().out.splitlines()])
    assert run("load", "--source", f"{tmp_path}/in", "--order", "position") == (0, [{"head": 6}])
    assert run("head") == (0, [{"head": 6}])
    assert [r["position"] for r in run("read", "--type", "a", "--tag", "t", "--start", "4", "--backwards", "--limit", "1")[1]] == [3]
    assert run("compact")[0] == 0 and run("check")[0] == 0
    assert len(run("vacuum")[1][0]["deleted"]) == 3


def test_follow(store, spark):
    from loomlog import CancelledError, StoreTimeoutError

    with store:
        store.append([E("a", "x"), E("b"), E("a", "x"), E("a", "x")])
    f = store.follow(Q(([], ["x"])), after=1, batch=1)
    assert f.next_timeout(60).position == 3 and [e.position for e in f.next_batch(60)] == [4]
    with pytest.raises(StoreTimeoutError):
        f.next_batch(0.1)
    store.append([E("c"), E("c", "x")])
    assert next(f).position == 6
    f.cancel()
    with pytest.raises(CancelledError):
        f.next_batch()
    assert list(store.follow(after=MAX_POSITION)) == []
    store.view("the_log")
    assert spark.sql("SELECT count(*) FROM the_log WHERE array_contains(tags, 'x')").first()[0] == 4
