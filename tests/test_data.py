"""The general data operators against brute force, with nulls, empty input, repeats and clashing names."""

import datetime as dt
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.model import LOG_SCHEMA
from loomlog.operators import conditions as C
from loomlog.operators import delivered_once as D
from loomlog.operators import drift, incremental, skew
from loomlog.operators.tables import global_rank, range_lookup

DELIVERIES = "delivery_id bigint, batch_id bigint, received_at timestamp_ntz, source string, position bigint, event_type string, tags array<string>, data binary, uuid string"
RUNS = "run_id bigint, source string, position bigint, started_at timestamp_ntz, finished_at timestamp_ntz, outcome string"
T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def event(position, event_type="A", tags=(), data=b"", metadata=()):
    return (position, event_type, list(tags) if tags is not None else None, bytearray(data) if data is not None else None, None, list(metadata) if metadata is not None else None, None)


def log_of(spark, events):
    loose = LOG_SCHEMA.simpleString()
    return spark.createDataFrame(events, loose)


# Ranks and ranges


def test_global_rank(spark):
    rows = [(i % 7, i, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v int, __chunk string")
    got = {(r["k"], r["v"]): r["seq"] for r in global_rank(df, [F.col("k").desc(), F.col("v")], start=5).collect()}
    want = {(k, v): n + 6 for n, (k, v, _) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert got == want
    assert global_rank(df.limit(0), [F.col("k")]).count() == 0


@pytest.mark.parametrize("most", [0, 10**6])
def test_range_lookup(spark, most):
    ranges = spark.createDataFrame([(1, 1, 10), (2, 11, 11), (3, 12, 500)], "id int, f bigint, l bigint")
    df = spark.createDataFrame([(p, p) for p in (0, 1, 10, 11, 12, 499, 501)] + [(None, 9)], "p bigint, __bucket bigint")
    got = {(r["p"], r["id"]) for r in range_lookup(df, "p", ranges, "f", "l", most).collect()}
    assert got == {(1, 1), (10, 1), (11, 2), (12, 3), (499, 3)}
    assert range_lookup(df, "p", ranges.limit(0), "f", "l").count() == 0


# Conditions


def test_check_conditions(spark):
    rng = random.Random(11)
    events = [event(i + 1, rng.choice(["A", "B", None]), rng.choice([None, ["x"], ["x", "y", "x"], ["z", None]])) for i in range(120)]
    asks = [(k, rng.choice([None, "x", "y", "q"]), rng.choice([None, "A", "B", "Q"]), rng.choice([None, 0, 5, 60, 119, 120, 2**63 - 1])) for k in range(150)]
    log = log_of(spark, events).withColumn("key", F.lit("clash"))
    c = spark.createDataFrame(asks, "req int, tag string, event_type string, after bigint")
    got = {r["req"]: (r["violated"], r["first_match"]) for r in C.check_conditions(log, c).collect()}
    for req, tag, kind, after in asks:
        hits = [e[0] for e in events if (after is None or e[0] > after) and (tag is None or tag in (e[2] or [])) and (kind is None or kind == e[1])]
        assert got[req] == (bool(hits), min(hits, default=None)), (req, tag, kind, after)
    assert len(got) == len(asks)
    assert C.check_conditions(log.limit(0), c).filter("violated").count() == 0
    assert C.check_conditions(log, c.limit(0)).count() == 0


def test_assign_tracking(spark):
    rng = random.Random(12)
    rows = [(k, rng.choice("aab"), rng.randrange(50)) for k in range(200)]
    top, want = {}, {}
    for k, s, p in rows:
        want[k] = s in top and p <= top[s]
        if not want[k]:
            top[s] = p
    df = spark.createDataFrame(rows, "seq bigint, source string, position bigint")
    assert {r["seq"]: r["violates"] for r in C.assign_tracking(df).collect()} == want


# Delivered once


def copies(rows):
    """Brute force: delivery ids that aren't the least of their group."""
    top = {r[0]: r[0] for r in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for key in (lambda r: digits(r[8]), lambda r: None if r[3] is None or r[4] is None else (r[3], r[4])):
        first = {}
        for r in rows:
            if (k := key(r)) is not None:
                a, b = sorted((root(r[0]), root(first.setdefault(k, r[0]))))
                top[b] = a
    return {r[0] for r in rows if root(r[0]) != r[0]}


def digits(u):
    if u is None:
        return None
    u = u.strip().lower()
    for c in "{}()-":
        u = u.replace(c, "")
    u = u.removeprefix("urn:").removeprefix("uuid:")
    return u if len(u) == 32 and set(u) <= set("0123456789abcdef") and u != "0" * 32 else None


def test_copies_random(spark):
    rng = random.Random(3)
    ids = [f"{i:08x}-0000-4000-8000-{i:012x}" for i in range(1, 40)]
    dress = [str, str.upper, lambda u: "{" + u + "}", lambda u: "urn:uuid:" + u, lambda u: u.replace("-", "")]
    junk = [None, "", "n/a", "0", "-", "00000000-0000-0000-0000-000000000000"]
    rows = []
    for k in range(1, 161):
        u = rng.choice(junk) if rng.random() < 0.5 else rng.choice(dress)(rng.choice(ids))
        s, p = (None, None) if rng.random() < 0.3 else (rng.choice("ab"), rng.choice([None, *range(60)]))
        rows.append((k, 1, hours(k), s, p, "A", [], b"", u))
    rows += [(1000 + k, 1, hours(k), "hot", 7, "A", [], b"", None) for k in range(100)]  # a third in one group
    df = spark.createDataFrame(rows, DELIVERIES).withColumn("first_id", F.lit("clash")).withColumn("__uuid", F.lit("clash"))
    got = [r[0] for r in D.surplus(df, D.delivery_identifiers(), "delivery_id").collect()]
    assert sorted(got) == sorted(copies(rows))


def test_copies_chain_and_empty(spark):
    # d1 -uuid- d2 -position- d3 -uuid- d4 ...: one event by way of others
    rows = [(k, 1, hours(k), "s", 500 + (k + 1) // 2, "A", [], b"", f"{k // 2 + 1:032x}") for k in range(1, 40)]
    df = spark.createDataFrame(rows, DELIVERIES)
    assert sorted(r[0] for r in D.surplus(df, D.delivery_identifiers(), "delivery_id").collect()) == list(range(2, 40))
    assert D.surplus(df.limit(0), D.delivery_identifiers(), "delivery_id").count() == 0


def test_copies_with_hot_identifiers(spark, monkeypatch):
    """A uuid, a position and a combination that each have many rows go by broadcast; the groups stay the same."""
    from loomlog.operators import tables

    rng = random.Random(5)
    rows = [(k, 1, hours(k), "s", k, "A", [], b"", f"{1:032x}" if k % 3 else f"{k:032x}") for k in range(1, 60)]
    rows += [(100 + k, 1, hours(k), "s", 7, "A", [], b"", f"{k + 500:032x}" if k % 2 else None) for k in range(60)]
    rows += [(200 + k, 1, hours(k), None, 7, "A", [], b"", f"{2:032x}") for k in range(60)]
    rows += [(300 + k, 1, hours(k), "s", 1000, "A", [], b"", rng.choice([None, f"{3:032x}"])) for k in range(9)]
    df = spark.createDataFrame(rows, DELIVERIES)
    want = sorted(copies(rows))
    monkeypatch.setattr(tables, "HOT_ROWS", 5)
    assert sorted(r[0] for r in D.surplus(df, D.delivery_identifiers(), "delivery_id").collect()) == want


def test_keep_one(spark):
    rows = [(1, "a", 5, {"x": 1}), (2, "a", 5, {"x": 1}), (3, None, 1, None), (4, None, None, None), (5, "b", None, None), (6, "b", 9, None), (6, "b", 9, None)]
    df = spark.createDataFrame(rows, "v int, id string, t int, r map<string,int>")
    got = D.keep_one(df, F.col("id"), ["t", "v"])
    assert got.columns == ["v", "id", "t", "r"]
    assert sorted(r["v"] for r in got.collect()) == [1, 3, 4, 5]
    assert D.keep_one(df.limit(0), F.col("id"), ["t"]).count() == 0
    same = spark.createDataFrame([(1, "a")] * 5, "v int, id string")
    assert D.keep_one(same, F.col("id"), ["v"]).count() == 1


# Incremental


def test_unprocessed(spark):
    rng = random.Random(4)
    deliveries = [(k, 1, hours(rng.randrange(80)), rng.choice(["hot", "hot", "b", "c", None]), rng.choice([None, *range(40)]), "A", [], b"", None) for k in range(300)]
    runs = [(k, rng.choice(["hot", "b", None]), rng.choice([None, *range(40)]), hours(rng.choice([None, *range(90)])), None, rng.choice(["committed", "committed", "failed", "running", None])) for k in range(60)]
    runs += runs[:5]
    first = {}
    for d in deliveries:
        if d[3] is not None and d[4] is not None:
            k = (d[3], d[4])
            first[k] = min(first.get(k, d[2]), d[2])
    took = lambda k, v: any(r[1] == k[0] and r[5] == "committed" and r[2] is not None and r[3] is not None and r[2] >= k[1] and r[3] >= v for r in runs)
    want = sorted(k for k, v in first.items() if not took(k, v))
    d, r = spark.createDataFrame(deliveries, DELIVERIES).withColumn("version", F.lit(1)), spark.createDataFrame(runs, RUNS).withColumn("upto", F.lit(1))
    assert sorted((x["source"], x["position"]) for x in incremental.unprocessed(d, r).collect()) == want
    assert incremental.unprocessed(d, r.limit(0)).count() == len(first)
    assert incremental.unprocessed(d.limit(0), r).count() == 0


def test_incremental_run_survives_failures(spark, tmp_path):
    run = incremental.IncrementalRun(spark, f"file://{tmp_path}/inc", ["k"], "v")
    recs = lambda rows: spark.createDataFrame(rows, "k string, v bigint, x int")
    opened = lambda *v: spark.createDataFrame([(x,) for x in v], "v bigint")
    ident = lambda df: df.select("k", "v", "x")
    one = recs([("a", 1, 0), ("b", 2, 0), ("c", None, 0)])
    with pytest.raises(RuntimeError, match="boom"):
        run.run(one, lambda df: (_ for _ in ()).throw(RuntimeError("boom")))
    run.run(one, ident, opened(2, 7))
    two = recs([("a", 1, 0), ("b", 2, 0), ("b", 3, 1), ("b", 3, 1), ("d", 2, 0), ("c", None, 0)])  # b changed, d came late
    run.run(two, ident, opened())
    run.run(two, ident)
    run.run(recs([]), ident)
    got = sorted((r["k"], r["v"]) for p in run.results() for r in spark.read.parquet(p).collect() if r["v"] is not None)
    assert got == [("a", 1), ("b", 2), ("b", 3), ("b", 3), ("d", 2)]  # equal rows of one run are all processed, in that run
    assert sum(1 for p in run.results() for r in spark.read.parquet(p).collect() if r["v"] is None) == 1
    assert [m["since"] for m in run.markers()] == ["2", "3", None, None] and [m["latest"] for m in run.markers()] == ["2", "3", None, None]
    run.vacuum()
    assert len(run.results()) == 4 and not (tmp_path / "inc" / "todo").exists()


def test_incremental_runs_that_overlap(spark, tmp_path):
    """A run that another one overtakes publishes nothing and takes only what is left."""
    inc = lambda: incremental.IncrementalRun(spark, f"file://{tmp_path}/inc", ["k"], "v")
    records = spark.createDataFrame([(k, k) for k in range(5)], "k int, v int")
    taken = []

    def slow(df):
        if not taken:
            taken.append(1)
            inc().run(records.filter("k < 3"), lambda d: d)
        return df

    inc().run(records, slow)
    assert sorted(r["k"] for p in inc().results() for r in spark.read.parquet(p).collect()) == [0, 1, 2, 3, 4]
    assert len(inc().results()) == 2


def test_incremental_reads_the_ledger_from_the_horizon(spark, tmp_path):
    run = incremental.IncrementalRun(spark, f"file://{tmp_path}/inc", ["k"], "v")
    for k in range(4):
        run.run(spark.createDataFrame([(k, k * 10), (k + 100, k * 10 + 5)], "k int, v int"), lambda d: d, spark.createDataFrame([(k * 10 + 5,)], "v int"))
    assert len(run.ledgers("25", kind="int")) == 2 and len(run.ledgers(None)) == 4  # parts whose latest version is 25 or later


# Skew


def test_skew(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.1 else f"k{rng.randrange(300)}", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v int").withColumn("__task", F.lit("mine")).withColumn("__tasks", F.lit(0))
    p = skew.plan(df, ["k"], 8)
    assert p.rows == 4000 and p.split() >= 1 and p.imbalance() < 1.05
    placed = skew.place(df, p, ["v"], "t")
    parts = placed.select("t", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(parts) == 8 and all(r["t"] == r["p"] for r in parts)
    sizes = [r["rows"] for r in skew.measured(placed).collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 4000 / 8 * 1.2  # the hot key alone has four times a fair share
    agg = skew.balanced_aggregate(df, ["k"], ["v"], {"__n": F.count(F.lit(1)), "__m": F.max("v")}, {"n": F.sum("__n"), "m": F.max("__m")}, 8, p)
    want = Counter(k for k, _ in rows)
    assert {r["k"]: r["n"] for r in agg.collect()} == dict(want)
    plans = [x.sparkSession._jvm.PythonSQLUtils.explainString(x._jdf.queryExecution(), "simple").split("== Initial Plan ==")[0] for x in (agg, skew.balanced_join(df, df, ["k"], ["v"], 8, p=p))]
    assert plans[0].count("Exchange") - plans[0].count("BroadcastExchange") == 2  # to the tasks; the shards of a key
    assert plans[1].count("Exchange") - plans[1].count("BroadcastExchange") == 2  # the two sides
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4), ("zz", 5)], "k string, v int")
    got = Counter((r["k"], r["v_side"]) for r in skew.balanced_join(df, side, ["k"], ["v"], 8).collect())
    assert got == Counter({("hot", 1): want["hot"], ("hot", 2): want["hot"], ("k1", 3): want["k1"]})
    empty = df.limit(0)
    assert skew.plan(empty, ["k"], 8).imbalance() == 1.0
    assert skew.balanced_join(empty, side, ["k"], ["v"], 8).count() == 0


def test_heavy_keys(spark):
    events = [event(i + 1, "T" if i % 3 else None, None if i % 10 == 0 else ["x", "x", f"u{i}"]) for i in range(100)]
    df = log_of(spark, events).withColumn("field", F.lit("clash")).withColumn("n", F.lit(0))
    got = {(r["field"], r["item_value"]): (r["n"], r["last_position"]) for r in skew.heavy_keys(df, 4).collect()}
    assert got == {("event_type", "T"): (66, 99), ("tags", "x"): (90, 100)}
    assert skew.heavy_keys(df.limit(0), 4).count() == 0


# Drift


def test_forms_and_likeness():
    assert drift.form("BK123") == "BK9" and drift.form("u-77") == "u-9" and drift.form("deadbeef12ab34cd") == "x16" and drift.form("a b c") == "text"
    assert drift.value_form("[\"q1\",\"q22\"]", "array") == ("[q9]", ["q9"]) and drift.value_form('{"b":1,"a":{"c":2}}', "object") == ("{a,b,c}", ["a", "b", "c"])
    assert drift.value_form(None, "string") == ("", []) and drift.name_likeness("data.windKn", "data.wind_kn") == 1.0


def test_flooding_decides():
    def f(name, kind="string", n=10, distinct=2, rng=None, wordy=1.0, nested=0.0):
        return {"name": name, "kind": kind, "n": n, "distinct": distinct, "range": rng, "wordy": wordy, "nested_sum": nested}

    same = {"shared_old": 10.0, "shared_new": 10.0, "forms": 1.0, "nested": 0.0}
    apart = {"shared_old": 0.0, "shared_new": 0.0, "forms": 1.0, "nested": 0.0}
    gone = [f("data.colour"), f("data.size"), f("data.n", "integer", rng=[1, 5, 9])]
    come = [f("data.extent"), f("data.tint"), f("data.far", "integer", rng=[9000, 9500, 9900]), f("metadata.tint")]
    pairs = {("data.colour", "data.tint"): same, ("data.size", "data.extent"): same, ("data.colour", "data.extent"): apart, ("data.size", "data.tint"): apart}
    assert sorted(drift.match_fields(gone, come, ["data.x"], pairs)) == [("data.colour", "data.tint"), ("data.size", "data.extent")]
    assert drift.match_fields([], come, ["data.x"], {}) == []
    # Nested names decide where forms alone are in doubt.
    box = [f("data.box", "object", nested=3.0)], [f("data.crate", "object", nested=3.0), f("data.spot", "object", nested=3.0)]
    half = {"shared_old": 0.0, "shared_new": 0.0, "forms": 0.5}
    nested = {("data.box", "data.crate"): half | {"nested": 2.9}, ("data.box", "data.spot"): half | {"nested": 0.3}}
    assert drift.match_fields(*box, [], nested) == [("data.box", "data.crate")]
    assert drift.match_fields(box[0], box[1][1:], [], nested) == []


def test_flood_is_sparse_and_settles():
    n = 200_000
    ends = np.stack([np.arange(1, n), np.zeros(n - 1, np.int64)], 1)
    score = drift.flood(np.linspace(0, 1, n), ends)
    assert score.max() == 1.0 and (np.diff(score[1:]) >= 0).all()


def test_changes(spark):
    p = 0
    events, segs = [], []

    def segment(vol, docs):
        nonlocal p
        first = p + 1
        for t, data, meta in docs:
            p += 1
            events.append(event(p, t, [], data, meta))
        segs.append((len(segs) + 1, vol, first, p, None))

    def doc(**k):
        return json.dumps(k).encode()

    old = [("Ship_v1", doc(code=f"BK{i}", n=i, gone="x", keep=True), [("who", f"u-{i}")]) for i in range(20)]
    new = [("Ship.v2", doc(ref=f"BK{i + 50}", n=f"{i}", keep=False, more=[1]), [("actor", f"u-{i + 9}")]) for i in range(20)]
    rare = [("Ship", doc(code="BK1", n=1, keep=True, blip=1), None)]
    segment("a", old + [("Other", b"", []), (None, None, None)])
    segment("a", [("Other", b"{bad", []), ("Other", b"\xff\xfe{}", [])])
    segment("a", new)
    segment("a", [*new, *rare, ("Ship", b"null", [("actor", None)])])
    segment("b", old)
    df = log_of(spark, events).withColumn("segment_id", F.lit("clash"))
    seg = spark.createDataFrame(segs, "segment_id bigint, volume_name string, first_position bigint, last_position bigint, written_at timestamp")
    got = {tuple(r) for r in drift.changes(df, seg).collect()}
    assert got == {
        (3, "Ship", "renamed", "data.code", "data.ref"),
        (3, "Ship", "renamed", "metadata.who", "metadata.actor"),
        (3, "Ship", "retyped", "data.n", "data.n"),
        (3, "Ship", "removed", "data.gone", ""),
        (3, "Ship", "added", "", "data.more"),
    }
    table = {r["position"]: r for r in drift.unified(df, seg).collect()}
    assert len(table) == len(events)
    text = lambda p: {k: v.toPython() for k, v in table[p]["fields"].items()}
    assert text(1)["data.code"] == "BK0" and text(25)["data.code"].startswith("BK5") and table[1]["event_type"] == "Ship"
    assert text(3)["data.n"] == "2" and text(3)["data.keep"] is True and text(30)["data.more"] == [1]  # n became text
    assert not any(r["conflicts"] for r in table.values())
    assert table[21]["unread"] and not table[1]["unread"]
    assert drift.changes(df.limit(0), seg).count() == 0


def test_unified_keeps_both_values_of_a_name(spark):
    """A producer that sends both names of a renamed field, a key twice, kinds that meet: nothing is lost."""
    doc = lambda **k: json.dumps(k).encode()
    old = [event(i, "T", [], doc(old=i, w=1)) for i in range(1, 21)]
    new = [event(20 + i, "T", [], doc(new=i, w=2.5)) for i in range(1, 21)]
    both = [event(41, "T", [], doc(new=5, old=6, x=None, w=3), [("k", "a"), ("k", "b"), (None, "c"), ("z", None)]), event(42, "T", [], b"nonsense")]
    df = log_of(spark, old + new + both)
    seg = spark.createDataFrame([(1, "a", 1, 20), (2, "a", 21, 42)], "segment_id bigint, volume_name string, first_position bigint, last_position bigint")
    u = drift.unified(df, seg)
    t = {r["position"]: r for r in u.collect()}
    py = lambda m: {k: v.toPython() for k, v in m.items()}
    assert py(t[1]["fields"]) == {"data.old": 1, "data.w": 1.0} and py(t[21]["fields"]) == {"data.old": 1, "data.w": 2.5}
    assert py(t[41]["fields"]) == {"data.old": 6, "data.w": 3.0, "metadata.k": "a"}
    assert [(c["field"], c["raw"], c["value"].toPython()) for c in t[41]["conflicts"]] == [("data.old", "data.new", 5), ("metadata.k", "metadata.k", "b")]
    assert t[42]["unread"] and not t[42]["fields"] and len(t) == 42
    assert {tuple(r) for r in drift.conflicts(u).collect()} == {("T", "data.old", "data.new", 1), ("T", "metadata.k", "metadata.k", 1)}


def test_base_type(spark):
    names = {"Tow.v2": "Tow", "TowV3": "Tow", "Tow_v12": "Tow", "Tow@5": "Tow", "Tow": "Tow", "": "", "Tow-2": "Tow", "View": "View"}
    df = spark.createDataFrame([(k,) for k in names], "t string")
    assert {r["t"]: r["b"] for r in df.withColumn("b", drift.base_type(F.col("t"))).collect()} == names
