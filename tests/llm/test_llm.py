"""The operators of loomlog.llm against brute force, with nulls, empty input, repeats and clashing names."""

import base64
import os
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlog.llm import leaks, mail, packing, topk, truncation
from loomlog.llm.cooccurrence import cooccurrence

# Pairs


@pytest.mark.parametrize(("max_heavy", "min_count", "min_lift"), [(4, 1, None), (8, 3, 2), (64, 2, None)])
def test_cooccurrence(spark, max_heavy, min_count, min_lift):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        t = [f"h{k}" for k in range(5) if rng.random() < 0.4] + [f"l{rng.randrange(60)}" for _ in range(rng.randrange(4))]
        t += ["twin_a", "twin_b"] if i % 50 == 0 else []
        rows.append((i, None if i % 40 == 7 else [*t, None, *t[:1]], "clash"))
    df = spark.createDataFrame(rows, "id int, tags array<string>, item string").withColumn("n", F.lit(0))
    n, both = Counter(), Counter()
    for _, t, _ in rows:
        s = sorted({x for x in t or [] if x is not None})
        n.update(s)
        both.update(combinations(s, 2))
    want = {(a, b, c, n[a], n[b]) for (a, b), c in both.items() if c >= min_count and (min_lift is None or c * len(rows) >= min_lift * n[a] * n[b])}
    out = cooccurrence(df, "id", "tags", min_count, min_lift, max_heavy)
    got = [tuple(r)[:5] for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # repeated rows, each a record
    twice = cooccurrence(df.unionByName(df).withColumn("id", F.lit(1)), None, "tags", 2 * min_count, min_lift, max_heavy)
    assert {tuple(r)[:5] for r in twice.collect()} == {(a, b, 2 * c, 2 * x, 2 * y) for a, b, c, x, y in want}
    assert cooccurrence(df.limit(0), "id", "tags").count() == 0


# Top-k


@pytest.mark.parametrize("capacity", [16, 4096])
def test_frequent(spark, capacity):
    rng = random.Random(2)
    rows = [(i, None if i % 9 == 0 else [f"v{min(int(rng.paretovariate(0.6)), 4000)}" for _ in range(5)] + [None], [f"u{i}", "é" * 300 if i % 3 else ""]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>").withColumn("item_value", F.lit("clash")).repartition(7)
    fields = {"a": F.col("a"), "b": F.col("b")}
    n = {"a": Counter(x for _, a, _ in rows for x in a or [] if x is not None), "b": Counter(x for _, _, b in rows for x in b)}
    total = {k: sum(c.values()) for k, c in n.items()}
    got = {tuple(r)[:3] for r in topk.frequent(df, fields, one_in=50, min_count=40, capacity=capacity).collect()}
    assert got == {(k, v, c) for k in n for v, c in n[k].items() if c * 50 >= total[k] and c >= 40}
    best = topk.frequent(df, fields, k=10, capacity=capacity).collect()
    want = {(k, v, c) for k in n for v, c in sorted(n[k].items(), key=lambda x: (-x[1], x[0]))[:10]}
    assert {tuple(r)[:3] for r in best} == want and all(r["low"] <= r["n"] <= r["high"] for r in best)
    assert topk.frequent(df.limit(0), fields, k=5).count() == 0
    assert topk.frequent(df.select(F.lit(None).cast("array<string>").alias("a")), {"a": F.col("a")}, k=5).count() == 0


def top(parts, k):
    n = Counter(v for p in parts for v in p)
    return {(v, c) for v, c in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:k]}


def nodes_of(spark, parts):
    """A table with one scan task per part, however uneven."""
    rows = [(k, p) for k, p in enumerate(parts)]
    return spark.createDataFrame(rows, "k int, a array<string>").repartitionById(len(parts), F.col("k"))


def test_frequent_small_node_loses_a_leader(spark):
    # A summary that forgot a value on a small node must not lose it overall.
    lost = ["X", *[f"s{k}" for k in range(5)]]
    parts = [["F"] * 100_000 + ["X"] * 9 + ["Y"] * 10, lost, [x.replace("s", "t") for x in lost]]
    got = topk.frequent(nodes_of(spark, parts), {"a": F.col("a")}, k=2, capacity=4).collect()
    assert {(r["item_value"], r["n"]) for r in got} == {("F", 100_000), ("X", 11)}


@pytest.mark.parametrize("most", [4, 8, None])
def test_frequent_uneven_nodes(spark, most):
    rng = random.Random(most)
    for _ in range(2):
        parts = []
        for _ in range(rng.randrange(2, 5)):
            size, spread = rng.choice([3, 30, 600]), rng.choice([3, 20, 300])
            parts.append([f"v{int(spread * rng.random() ** rng.choice([1, 3]))}" for _ in range(size)])
        k = rng.choice([1, 3, 7])
        df = nodes_of(spark, parts)
        got = topk.frequent(df, {"a": F.col("a")}, k=k, capacity=4, most=most).collect()
        assert {(r["item_value"], r["n"]) for r in got} == top(parts, k)
        got = topk.frequent(df, {"a": F.col("a")}, one_in=20, capacity=4, most=most).collect()
        n = Counter(v for p in parts for v in p)
        assert {(r["item_value"], r["n"]) for r in got} == {(v, c) for v, c in n.items() if c * 20 >= n.total()}


@given(st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=8), st.integers(1, 10))
@settings(max_examples=60, deadline=None)
def test_summary_bounds(batches, capacity):
    s, true = topk.Summary(capacity), Counter()
    for b in batches:
        c = Counter(b)
        true.update(c)
        s.add(list(c), list(c.values()))
    assert len(s.counts) <= capacity and s.err * (capacity + 1) <= s.total == sum(true.values())
    assert all(s.counts.get(v, 0) <= n <= s.counts.get(v, 0) + s.err for v, n in true.items())


# Packing


@given(st.lists(st.integers(0, 50), max_size=120), st.just(50))
@settings(max_examples=80, deadline=None)
def test_best_fit_and_bound(sizes, capacity):
    a = np.array(sorted(sizes, reverse=True), np.int64)
    for bins in (packing.best_fit(a, capacity), packing.best_set_fit(a, capacity)):
        if len(a):
            assert bins.min() == 0 and len(set(bins.tolist())) == bins.max() + 1
            fill = np.bincount(bins, weights=a)
            assert fill.max() <= capacity
            bound = packing.lower_bound(a, capacity)
            assert -(-int(a.sum()) // capacity) <= bound <= len(fill)


def test_bound_sees_what_volume_misses():
    assert packing.lower_bound(np.array([26] * 10), 50) == 10  # no two fit, though the volume would fit 6
    assert packing.lower_bound(np.array([17] * 9), 50) == 5  # two each


def test_pack(spark):
    rng = random.Random(3)
    counts = spark.createDataFrame([(i, min(int(rng.paretovariate(1) * 20), 900)) for i in range(3000)] + [(9000, 0), (None, 5), (9001, 50_000), (9001, 50_000)], "doc_id bigint, tokens bigint")
    items = packing.pieces(counts, 256)
    out = packing.pack(items.withColumn("bin", F.lit("clash")), 256, per_group=500)
    rows = out.collect()
    want = Counter((r["doc_id"], r["piece"], r["tokens"]) for r in items.collect())
    assert Counter((r["doc_id"], r["piece"], r["tokens"]) for r in rows) == want
    fill = Counter()
    for r in rows:
        fill[r["container"]] += r["tokens"]
    assert max(fill.values()) <= 256
    least = -(-sum(fill.values()) // 256)
    assert len(fill) <= least * 1.005 + 1
    per_doc = Counter()
    for r in rows:
        per_doc[r["doc_id"]] += r["tokens"]
    assert per_doc[9001] == 100_000 and all(r["tokens"] == 256 for r in rows if r["doc_id"] == 9001 and r["piece"] < 195)
    assert packing.pack(items.limit(0), 256).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 0, 0)], "doc_id bigint, piece bigint, tokens bigint"), 256).count() == 1


def test_token_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    ranks = public.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "Hello there, world <|endoftext|>"), (2, ""), (3, None), (4, "ab " * 30_000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(docs, ranks).collect()}
    enc = packing.tokenizer(ranks)
    assert got[1] == len(enc.encode_ordinary("Hello there, world <|endoftext|>")) and got[2] == got[3] == 0 and got[4] > 20_000
    packed = packing.pack_documents(docs, ranks, 2048).collect()
    assert sum(r["tokens"] for r in packed) == sum(got.values()) and {r["doc_id"] for r in packed} == {1, 2, 3, 4}


# Mail


def test_mail():
    assert mail.parse(None).parts == [] and not mail.parse("").body
    head = "From: a@b\nSubject: x\n"
    m = mail.parse(head + "\n\n")
    assert not m.body and m.open == ""
    m = mail.parse("Received: from x;\n\t\n" + head + "Content-Type: text/html\n\n<html><p>Caf&eacute; <b>m</b>ore<br>x</p>&gt; y</html>")
    assert mail.words(m.parts[0][1]) == ["café", "more", "x", "y"] and m.open == ""
    assert mail.parse(head + "Content-Type: text/html\n\n<html><p>half").open == "markup"
    code = base64.b64encode("Grüße aus Köln".encode()).decode()
    b64 = head + "Content-Transfer-Encoding: base64\n\n"
    assert mail.parse(b64 + code).parts[0][1] == "Grüße aus Köln"
    assert mail.parse(b64 + code[:11]).open == "base64"
    qp = mail.parse(head + "Content-Transfer-Encoding: quoted-printable\n\nch=C3=B3fer so=\nft")
    assert qp.parts[0][1] == "chófer soft" and qp.open == ""
    assert mail.parse(head + "Content-Transfer-Encoding: quoted-printable\n\nch=C3=").open == "quoted"
    multi = head + 'Content-Type: multipart/mixed; boundary="q"\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nfirst part\r\n--q\r\nContent-Type: image/png\r\nContent-Transfer-Encoding: base64\r\n\r\nAAAA\r\n--q--\r\n'
    m = mail.parse(multi)
    assert [t.strip() for _, t in m.parts] == ["first part"] and m.open == ""
    assert mail.parse(multi[:-12]).open == "multipart"
    assert mail.parse("just words, no header").parts == [("text/plain", "just words, no header")]


def test_mail_nested_deep():
    text = "From: x\n\nthe innermost words"
    for k in range(40):
        text = f'From: x\nContent-Type: multipart/mixed; boundary="b{k}x"\n\n--b{k}x\n{text}\n--b{k}x\n\nafter {k}\n--b{k}x--\n' if k % 2 else f"From: x\nContent-Type: message/rfc822\n\n{text}"
    m = mail.parse(text)
    got = [mail.words(t) for _, t in m.parts]
    assert got[0] == ["the", "innermost", "words"] and got[1:] == [["after", str(k)] for k in range(1, 40, 2)] and m.open == ""


# Leaks


def passages(rng, n):
    v = [f"w{k}" for k in range(60)] + ["the", "a", "of", "été"]
    return [" ".join(rng.choice(v) for _ in range(n)) for _ in range(8)]


def brute(docs, items, size):
    index = {}
    for i, t in items:
        w = mail.words(t or "")
        for k in range(len(w) - size + 1):
            index.setdefault(tuple(w[k : k + size]), set()).add(i)
    found = set()
    for d, t in docs:
        for _, part in mail.parse(t).parts:
            w = mail.words(part)
            for k in range(len(w) - size + 1):
                found |= {(d, i) for i in index.get(tuple(w[k : k + size]), ())}
    return found


def leak_tables(spark):
    rng = random.Random(7)
    texts = passages(rng, 40)
    items = [(k, t) for k, t in enumerate(texts)] + [(50, "too short"), (51, None), (52, ""), (None, texts[0])]
    docs = [(1, None), (2, ""), (3, "From: x\n\nnothing of the kind here"), (None, texts[0])]
    for k in range(60):
        w = texts[k % 8].split()
        lo, n = rng.randrange(20), rng.choice([8, 11, 12, 13, 20, 40])
        part = w[lo : lo + n]
        if k % 5 == 0 and len(part) > 12:
            part[6] = "changed"
        filler = " ".join(rng.choice(["one", "the", "w3", "a", "two"]) for _ in range(rng.randrange(300)))
        body = filler + "\n> " + " *".join(part).upper() + "*\n> " + filler
        form = k % 3
        if form == 1:
            body = "From: x\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(body.encode()).decode()
        if form == 2:
            body = "From: x\nContent-Type: text/html\n\n<html>" + body.replace("*", "<b>").replace(">", "&gt;", 0) + "</html>"
        docs.append((100 + k, body))
    docs += [(500, texts[0] + " and then " + texts[1]), (500, texts[0]), (501, (texts[2] + " ") * 500)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).withColumn("row", F.lit("x")).repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1)).withColumn("words", F.lit("x"))
    keep = lambda rows: [r for r in rows if r[0] is not None]
    return d, i, brute(keep(docs), keep(items), 12)


def test_leaks(spark, monkeypatch):
    d, i, want = leak_tables(spark)
    out = leaks.find_leaks(d, i).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out if r["exact_windows"]} == want
    assert len(out) == len({(r["doc_id"], r["item_id"]) for r in out})
    one = next(r for r in out if (r["doc_id"], r["item_id"]) == (500, 0))
    assert one["longest_run"] == 40 and one["best"] == 1.0 and one["exact_windows"] == 58
    whole = next(r for r in out if (r["doc_id"], r["item_id"]) == (501, 2))
    assert whole["exact_windows"] >= 500 * 29 and whole["longest_run"] >= 40
    # in several passes, and with items too many to broadcast, the rows are the same
    monkeypatch.setattr(leaks, "NEAR_AT_ONCE", 4)
    monkeypatch.setattr(leaks, "FEW_WINDOWS", 1)
    assert sorted(map(str, leaks.find_leaks(d, i).collect())) == sorted(map(str, out))
    assert leaks.find_leaks(d.limit(0), i).count() == 0 and leaks.find_leaks(d, i.limit(0)).count() == 0


def test_near_leaks_are_found(spark):
    """Whole items with changed, added and dropped words: of those alike to 0.8 at least nine in ten are met."""
    rng = random.Random(11)
    vocab = [f"word{k}" for k in range(900)]
    items = [[vocab[int(900 * rng.random() ** 2)] for _ in range(rng.randrange(30, 150))] for _ in range(60)]
    h = [leaks.hashed(" ".join(x)) for x in items]
    with_ = np.zeros(leaks.BUCKETS, np.int64)
    for x in h:
        with_[np.unique(x & (leaks.BUCKETS - 1))] += 1
    weights = leaks.weigh(with_, len(items))
    docs, want = [], set()
    for k in range(240):
        i = k % 60
        part = list(items[i])
        for _ in range(rng.randrange(1, 4)):
            at, how = rng.randrange(len(part)), rng.choice("cad")
            part[at : at + (how != "a")] = [] if how == "d" else [f"other{rng.randrange(50)}"]
        docs.append((k, " ".join([*rng.choices(vocab, k=30), *part, *rng.choices(vocab, k=30)])))
        d, s = leaks.hashed(docs[-1][1]), leaks.size_class(len(items[i]), 12)
        offs = {0, len(items[i]) - s}
        if any(leaks.similarity(d[p : p + s], h[i][o : o + s], weights) >= 0.8 for o in offs for p in range(25, min(len(d) - s, 40 + len(items[i]) - s) + 1)):
            want.add((k, i))
    out = leaks.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string"), exact=False)
    got = {(r["doc_id"], r["item_id"]) for r in out.collect() if r["near_windows"] and r["best"] >= 0.8}
    assert got <= want and len(want) > 60
    assert len(got) >= 0.9 * len(want), (len(got), len(want))


@pytest.mark.parametrize("radius", [3, 7])
def test_block_index_misses_nothing(radius):
    rng = np.random.default_rng(9)
    prints = rng.integers(0, 2**63, 200).astype(np.uint64)
    p = leaks.Near(prints, radius)
    near = prints[rng.integers(0, len(prints), 300)].copy()
    for k in range(len(near)):
        for b in rng.choice(64, rng.integers(0, radius + 3), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    win, probe = p.candidates(near)
    want = {(a, b) for a in range(len(near)) for b in range(len(prints)) if int(near[a] ^ prints[b]).bit_count() <= radius}
    assert set(zip(win.tolist(), probe.tolist(), strict=True)) == want


def test_fingerprints_and_similarity():
    rng = np.random.default_rng(1)
    weights = rng.integers(0, 20, leaks.BUCKETS).astype(np.int16)
    ids = rng.integers(-(2**62), 2**62, 9000)
    ids[100] = 0
    got = leaks.fingerprints(ids, weights, [1, 5, 12, 16, 5000])
    for size, prints in got.items():
        assert len(prints) == 9000 - size + 1
        for k in (0, 17, 95, len(prints) // 2, len(prints) - 1):
            h = ids[k : k + size]
            w = np.where(h == 0, 0, weights[h & (leaks.BUCKETS - 1)]).astype(int)
            assert prints[k] == sum(1 << b for b in range(64) if (w * (2 * ((h >> b) & 1) - 1)).sum() > 0)
    w = np.ones(leaks.BUCKETS, np.int16)
    a, b = np.array([1, 2, 3, 4, 5, 6, 7]), np.array([1, 2, 3, 4, 5, 6, 8])
    assert leaks.similarity(a, b, w) == 2 / 4 and leaks.similarity(np.ones(7, np.int64), np.ones(7, np.int64), w) == 1.0
    weights[5] = 0
    for k in range(300):  # windows of a run at once; few words, so that shingles repeat
        words_ = rng.integers(1, 2 + k % 4 if k % 3 else 9, (2, 60))
        run, item = words_[0, : 12 + k % 40], words_[1, : 12 if k % 2 else 9]
        one = [leaks.similarity(run[p : p + len(item)], item, weights) for p in range(len(run) - len(item) + 1)]
        assert np.allclose(leaks.similarities(run, item, weights), one)
    assert [leaks.size_class(n, 12) for n in (12, 13, 14, 15, 146)] == [12, 13, 13, 15, 129]


# Truncation

HEAD = "From: x@y\nSubject: t\n"


def test_tail_of():
    assert truncation.tail_of("It was repaired. The auditor has wel")[:4] == ("wel", "has", False, 4)
    assert truncation.tail_of("It was repaired. The aud [message clipped]")[0] == "aud"
    assert truncation.tail_of("Done now.\n> \n.")[2] is True
    assert truncation.tail_of("so it went and ")[4] is True
    assert truncation.tail_of("")[0] == ""
    # nothing is cut off by a window: long marks, long rests, long sentences, long words
    assert truncation.tail_of("The aud [" + "." * 500 + "message truncated" + "-" * 500 + "]" + " " * 3000)[0] == "aud"
    assert truncation.tail_of("The aud" + "\n> " * 5000)[0] == "aud"
    assert truncation.tail_of("Yes. the " + "wide " * 4000 + "aud")[:4] == ("aud", "wide", False, 4002)
    assert truncation.tail_of("The " + "z" * 9000)[0] == "z" * 9000


def test_trie_of_long_words(spark):
    long = ["ab" * 30, "ab" * 40 + "x", "q" * 500]
    vocab = spark.createDataFrame([(w, 5, 0) for w in [*long, "abbey"]] + [("rare" * 20, 1, 0)], "word string, n bigint, n_end bigint")
    ends = ["ab" * 22, "ab" * 30, "q" * 41, "q" * 499, "q" * 500, "rare" * 15, "abb", "zz"]
    got = {r["prefix"]: (r["below"], r["words"]) for r in truncation.trie(vocab, ends=spark.createDataFrame([(w,) for w in ends], "w string")).collect()}
    for w in ends:
        n = sum(1 for x in [*long, "abbey"] if x.startswith(w) and x != w)
        assert got.get(w) == ((5 * n, n) if n else None), w
    assert {k: v for k, v in got.items() if len(k) <= 40} == {r["prefix"]: (r["below"], r["words"]) for r in truncation.trie(vocab).collect() if len(r["prefix"]) <= 40}


def test_truncated(spark):
    rng = random.Random(10)
    words = ["harbour", "kettle", "warranty", "repaired", "yesterday", "forklift", "painted", "contractor", "measured", "carpenter"]

    def sentence(n=8):
        return "The " + " ".join(rng.choice(words) for _ in range(n)) + "."

    rows = [(k, HEAD + "\n" + " ".join(sentence() for _ in range(rng.randrange(2, 9))) + ("\n\nRegards\nJorn" if k % 2 else ""), "open-src" if k % 3 else None) for k in range(200)]
    cut_word = HEAD + "\nThe harbour was repaired. The contractor measured the forkl"
    limit = 180
    at_limit = []
    for k in range(8):
        t = HEAD + "\n" + " ".join(sentence() for _ in range(6))
        while t[limit - 1] == "." or t[limit - 2] == ".":
            t = HEAD + "\n" + " ".join(sentence() for _ in range(6))
        at_limit.append((300 + k, t[:limit], "short-src"))
    rows += at_limit + [(320 + k, HEAD + "\n" + sentence(3 + k % 5), "short-src") for k in range(12)]
    padded = HEAD + "\n" + sentence()
    padded = padded[:-1] + " " + "9" * (limit - len(padded) - 1) + "."
    special = [
        (400, cut_word, "open-src", True),
        (401, cut_word + " [truncated]", "open-src", True),
        (402, cut_word + "…", "open-src", True),
        (403, None, "open-src", False),
        (404, "", "open-src", False),
        (405, HEAD, "open-src", False),
        (406, HEAD + "\nThe kettle was painted", "open-src", False),  # no closing punctuation, but whole
        (407, HEAD + "\nThe kettle was painted.\n\n[...]\n\nThanks\nIvo", "open-src", False),
        (408, HEAD + "Content-Type: text/html\n\n<html><p>The kettle was pain", "open-src", True),
        (409, HEAD + 'Content-Type: multipart/mixed; boundary="b"\n\n--b\n\nThe kettle', "open-src", True),
        (410, HEAD + 'Content-Type: multipart/mixed; boundary="b"\n\n--b\n\nThe kettle\n--b--\n', "open-src", False),
        (411, padded, "short-src", False),
        (412, HEAD + "\nThe kettle was yesterday. The ", "open-src", True),
        (413, HEAD + "Content-Transfer-Encoding: base64\n\n" + base64.b64encode(b"The harbour was painted").decode()[:17], "open-src", True),
    ]
    docs = spark.createDataFrame([*rows, *[s[:3] for s in special], (400, cut_word, "open-src")], "doc_id bigint, text string, source string")
    docs = docs.withColumn("n", F.lit(1)).withColumn("tail", F.lit("clash")).repartition(3)
    assert [(r["source"], r["size"]) for r in truncation.limits(truncation.scan(docs)).filter("unit = 'chars' and source = 'short-src'").collect()] == [("short-src", limit)]
    seen = truncation.evidence(docs)
    found = {r["doc_id"] for r in truncation.truncated(seen).collect()}
    want = {s[0] for s in special if s[3]} | {r[0] for r in at_limit}
    assert found == want
    method = {r["doc_id"] for r in truncation.by_method(seen).collect()}
    assert method == {400, 401, 402} | {r[0] for r in at_limit}
    share = {r["source"]: (r["docs"], r["truncated"]) for r in truncation.shares(seen, truncation.truncated(seen)).collect()}
    assert share["short-src"] == (21, 8) and share[None][1] == 0
    assert truncation.truncated(truncation.evidence(docs.limit(0))).count() == 0


# Registered queries


D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
def test_registered(spark):
    from loomlog.llm import queries as q
    from tests.oracle import compare

    runs, sqls = q.queries(), q.oracle_sql()
    assert list(runs).index("p9_method") < list(runs).index("p9_found")
    for name, sql in sqls.items():
        got, want = compare(spark, D, name, runs[name], sql)
        assert got == want, name
    for name in set(runs) - set(sqls):
        runs[name](spark, D).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/eval_items.parquet").collect()]
    assert {tuple(r) for r in runs["p8_found"](spark, D).collect()} == brute(docs, items, 12)
