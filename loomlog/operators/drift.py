"""Schemas that drift: find every change of payload and metadata fields, and read everything into one table.

Changes are found from per-segment field counts, in one pass over the log.
Where fields go and others come in one step, their values are compared in a
second pass over only those segments and types, all values of them, and
matched by similarity flooding: the two schemas become graphs of a type, its
fields, their kinds, names, values and nested names. What is known at first
of pairs of names, values and nested names flows along the graph of pairs
until it settles; fields are one if their pair then stands above the pairs
that say that either has no partner.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import cut, join_split, range_lookup

# The kinds of payload values, in the order that settles ties.
KINDS = ["string", "integer", "decimal", "boolean", "array", "object"]
SHARE = 5  # a field belongs if at least one in SHARE holds it
RENAMES = pa.schema([("segment_id", pa.int64()), ("base_type", pa.string()), ("old_field", pa.string()), ("new_field", pa.string())])
NAME_WEIGHT = 0.05  # names tell little: a renamed field has another one
WORDY = "^(a|Aa|aA|text|A[0-9])$"  # forms of values that are words


def base_type(c: Column) -> Column:
    """The type without a version number at its end and what sets that off."""
    return F.regexp_replace(c, r"(?:[^\p{L}\p{N}]*[vV])?[^\p{L}\p{N}]*\p{Nd}+$", "")


def _kind(schema: Column) -> Column:
    return (
        F.when(schema == "STRING", "string")
        .when(schema == "BIGINT", "integer")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema != "VOID", "decimal")
    )


def located(log: DataFrame, segments: DataFrame) -> DataFrame:
    """Events with their segment, volume and base type; ``text`` is the payload where it is valid UTF-8.

    Null types count as empty, null metadata as none; events outside all
    segments are left out.
    """
    e = log.select("position", base_type(F.coalesce("event_type", F.lit(""))).alias("base_type"), "data", "metadata")
    s = segments.select("segment_id", "volume_name", F.col("first_position").alias("__f"), F.col("last_position").alias("__l"))
    text = F.when(F.is_valid_utf8(F.col("data").cast("string")), F.col("data").cast("string"))
    return range_lookup(e, "position", s, "__f", "__l").drop("__f", "__l").withColumn("text", text).drop("data")


def _objects(events: DataFrame) -> DataFrame:
    """Adds ``doc``, the payload as a variant if it is a JSON object, else null."""
    doc = F.try_parse_json(F.col("text"))
    return events.withColumn("doc", F.when(F.ltrim(F.col("text"), F.lit(" \t\r\n")).startswith("{"), doc))


ENTRY = "array<struct<field:string,kind:string>>"


def _values() -> Column:
    """The payload's fields as (field, kind, value) structs; null values have a null kind. Null if ``doc`` is."""
    entries = F.map_entries(F.expr("try_variant_get(doc, '$', 'map<string,variant>')"))
    return F.transform(entries, lambda x: F.struct(F.concat(F.lit("data."), x["key"]).alias("field"), _kind(F.schema_of_variant(x["value"])).alias("kind"), x["value"].alias("value")))


def field_counts(events: DataFrame) -> DataFrame:
    """(volume_name, segment_id, base_type, field, kind, n), from one scan and one map-side aggregate.

    The field "" counts the type's events (kind "events") and readable payloads
    (kind "readable"). Metadata fields have the kind "text"; an event that
    repeats a key counts once.
    """
    at = ["volume_name", "segment_id", "base_type"]
    o = _objects(events).select(*at, "doc", "metadata")
    meta = F.array_distinct(F.transform(F.coalesce("metadata", F.array().cast("array<struct<key:string,value:string>>")), lambda m: m["key"]))
    pair = lambda f, k: F.struct(f.alias("field"), k.alias("kind"))
    empty = F.array().cast(ENTRY)
    every = F.concat(
        F.array(pair(F.lit(""), F.lit("events"))),
        F.when(F.col("doc").isNotNull(), F.array(pair(F.lit(""), F.lit("readable")))).otherwise(empty),
        F.transform(F.filter(meta, lambda k: k.isNotNull()), lambda k: pair(F.concat(F.lit("metadata."), k), F.lit("text"))),
        F.coalesce(F.transform(_values(), lambda x: pair(x["field"], x["kind"])), empty),
    )
    rows = o.select(*at, F.explode(every).alias("x")).select(*at, "x.field", "x.kind").filter("kind is not null")
    return rows.groupBy(*at, "field", "kind").agg(F.count(F.lit(1)).alias("n"))


def schemas(counts: DataFrame) -> DataFrame:
    """Per volume, segment and type the fields that belong: ``fields``, an array of (field, kind)."""
    at = ["volume_name", "segment_id", "base_type"]
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.lit(0))
    per_field = counts.groupBy(*at, "field").agg(
        F.sum("n").alias("n"),
        F.max_by("kind", F.struct("n", -rank)).alias("kind"),
        F.sum(F.when(F.col("kind") == "events", F.col("n"))).alias("events"),
        F.sum(F.when(F.col("kind") == "readable", F.col("n"))).alias("readable"),
    )
    per_type = per_field.groupBy(*at).agg(
        F.max("events").alias("events"),
        F.coalesce(F.max("readable"), F.lit(0)).alias("readable"),
        F.collect_list(F.when(F.col("field") != "", F.struct("field", "kind", "n"))).alias("all"),
    )
    belongs = lambda x: x["n"] * SHARE >= F.when(x["field"].startswith("data."), F.col("readable")).otherwise(F.col("events"))
    kept = F.transform(F.filter("all", belongs), lambda x: F.struct(x["field"].alias("field"), x["kind"].alias("kind")))
    return per_type.select(*at, F.array_sort(kept).alias("fields"))


def steps(schema: DataFrame) -> DataFrame:
    """Each schema beside that of the last earlier segment of its volume that holds the type."""
    w = W.partitionBy("volume_name", "base_type").orderBy("segment_id")  # a row per segment of one volume
    prev = schema.withColumn("before", F.lag("fields").over(w)).withColumn("before_segment", F.lag("segment_id").over(w))
    names = lambda c: F.transform(c, lambda x: x["field"])
    out = prev.filter("before_segment is not null and before != fields")
    gone = F.filter("before", lambda x: ~F.array_contains(names(F.col("fields")), x["field"]))
    come = F.filter("fields", lambda x: ~F.array_contains(names(F.col("before")), x["field"]))
    kept = F.filter("fields", lambda x: F.array_contains(names(F.col("before")), x["field"]) & ~F.array_contains(F.col("before"), x))
    return out.select("segment_id", "before_segment", "base_type", "fields", gone.alias("gone"), come.alias("come"), kept.alias("retyped"))


def _space(field: str) -> str:
    return field.split(".", 1)[0]


# How values look ------------------------------------------------------------


def form(value: str) -> str:
    """What a text value looks like: runs of digits are 9, of letters a, A or Aa, mixed runs x; short marks before digits stay."""
    if value.count(" ") >= 2:
        return "text"
    out, digits, first = [], any(c.isdigit() for c in value), True
    for run in re.findall(r"[^\W_]+|[\W_]", value):
        if not run[0].isalnum():
            out.append(run)
            continue
        if run.isdigit():
            out.append("9")
        elif run.isalpha():
            mark = digits and first and len(run) <= 2
            out.append(run if mark else "a" if run.islower() else f"A{len(run)}" if run.isupper() else "Aa" if run.istitle() else "aA")
        elif m := re.fullmatch(r"([^\W\d_]{1,3})(\d+)", run):
            out.append(m[1] + "9")
        elif re.fullmatch(r"\d+[^\W\d_]", run):
            out.append("9A" if run[-1].isupper() else "9a")
        else:
            out.append(f"x{len(run)}")
        first = False
    return "".join(out)


def value_form(text: str | None, kind: str) -> tuple[str, list[str]]:
    """The form of a value of any kind, given as JSON text (strings bare), and the names or item forms nested in it."""
    if text is None:
        return "", []
    if kind in ("integer", "decimal"):
        return ("-9" if text.startswith("-") else "9"), []
    if kind == "boolean":
        return "bool", []
    if kind == "array":
        items = re.findall(r'"((?:[^"\\]|\\.)*)"|(-?[\d.]+)', text)
        inner = sorted({form(a) if a else "9" for a, _ in items})
        return "[" + "|".join(inner) + "]", inner
    if kind == "object":
        inner = sorted(set(re.findall(r'"((?:[^"\\]|\\.)*)"\s*:', text)))
        return "{" + ",".join(inner) + "}", inner
    return form(text), []


def value_rows(events: DataFrame, at: list[str]) -> DataFrame:
    """Every payload and metadata value as (at..., field, kind, value text)."""
    o = _objects(events)
    text = F.transform(_values(), lambda x: F.struct(x["field"].alias("field"), x["kind"].alias("kind"), x["value"].cast("string").alias("value")))
    meta = F.transform("metadata", lambda m: F.struct(F.concat(F.lit("metadata."), m["key"]).alias("field"), F.lit("text").alias("kind"), m["value"].alias("value")))
    empty = F.array().cast("array<struct<field:string,kind:string,value:string>>")
    rows = o.select(*at, F.explode(F.concat(F.coalesce(text, empty), F.coalesce(meta, empty))).alias("x")).select(*at, "x.*")
    return rows.filter("field is not null and kind is not null and value is not null")


def distinct_values(values: DataFrame, at: list[str]) -> DataFrame:
    """Every distinct value of each field with its count, form, hash, number and nested names, as a written table.

    Equal values are counted, map-side, before forms are taken. Long forms are
    kept as a digest, which tells them apart as well.
    """

    @F.pandas_udf("form string, nested array<string>")
    def forms(v: pd.Series, k: pd.Series) -> pd.DataFrame:
        out = [value_form(a, b) for a, b in zip(v, k, strict=True)]
        short = [f if len(f) <= 64 else hashlib.sha256(f.encode("utf-8", "replace")).hexdigest() for f, _ in out]
        return pd.DataFrame({"form": pd.Series(short, dtype=object), "nested": pd.Series([n for _, n in out], dtype=object)})

    per = values.groupBy(*at, "field", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    num = F.when(F.col("kind").isin("integer", "decimal"), F.expr("try_cast(value as double)"))
    per = per.select(*at, "field", "n", forms("value", "kind").alias("f"), F.xxhash64("value").alias("h"), num.alias("num"))
    return cut(per.select(*at, "field", "n", "f.form", "f.nested", "h", "num"))


def field_facts(per: DataFrame, at: list[str]) -> DataFrame:
    """Per (at..., field): occurrences ``n``, ``distinct`` values, number ``range``, share of word-like values ``wordy``, sum of nested shares."""
    wordy = F.sum(F.when(F.col("form").rlike(WORDY), F.col("n")).otherwise(0))
    return per.groupBy(*at, "field").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("distinct"),
        F.percentile_approx("num", [0.05, 0.5, 0.95], 200).alias("range"),
        (wordy / F.sum("n")).alias("wordy"),
        (F.sum(F.size("nested") * F.col("n")) / F.sum("n")).alias("nested_sum"),
    )


def pair_facts(sides: DataFrame, per: DataFrame, facts: DataFrame) -> DataFrame:
    """What pairs of fields of one step have in common, over all their values.

    (segment_id, base_type, old, new, shared_old, shared_new, forms, nested):
    occurrences whose value the other field has too, the common part of both
    distributions of forms, and of nested names. Values meet by equality
    within a step, a namespace and a kind, each once per field.
    """
    seg = ["seg", "base_type", "field"]
    at = ["segment_id", "base_type", "space", "kind"]
    sized = sides.join(facts.select(*seg, F.col("n").alias("size")), seg)
    rows = sized.join(per, seg).withColumn("share", F.col("n") / F.col("size"))

    def met(by: str, data: DataFrame, old: Column, new: Column, name: list[str]) -> DataFrame:
        per_side = data.groupBy(*at, "side", "field", by).agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
        left = per_side.filter("side = 'gone'").select(*at, by, F.col("field").alias("old"), F.col("n").alias("n_l"), F.col("share").alias("s_l"))
        right = per_side.filter("side = 'come'").select(*at, by, F.col("field").alias("new"), F.col("n").alias("n_r"), F.col("share").alias("s_r"))
        j = left.join(right, [*at, by]).groupBy("segment_id", "base_type", "old", "new").agg(old.alias(name[0]), new.alias(name[1]))
        return j.select("segment_id", "base_type", "old", "new", *[(F.col(c) if c in name else F.lit(0.0)).cast("double").alias(c) for c in ("shared_old", "shared_new", "forms", "nested")])

    least, none = F.sum(F.least("s_l", "s_r")), F.lit(0.0)
    words = met("h", rows, F.sum("n_l"), F.sum("n_r"), ["shared_old", "shared_new"])
    forms = met("form", rows, least, none, ["forms", "-"])
    nested = met("part", rows.withColumn("part", F.explode("nested")), least, none, ["nested", "-"])
    every = words.unionByName(forms).unionByName(nested)
    return every.groupBy("segment_id", "base_type", "old", "new").agg(*[F.sum(c).alias(c) for c in ("shared_old", "shared_new", "forms", "nested")])


def _range_likeness(a: dict, b: dict) -> float:
    """How far two number ranges lie over each other, on a scale that is linear near 0 and logarithmic beyond."""
    squash = lambda x: np.sign(x) * np.log1p(abs(x))
    lo1, _, hi1 = (squash(x) for x in a["range"])
    lo2, _, hi2 = (squash(x) for x in b["range"])
    both, either = min(hi1, hi2) - max(lo1, lo2), max(hi1, hi2) - min(lo1, lo2)
    spread = min(a["n"], b["n"])
    slack = 1.2 / max(1, spread) + 0.05  # few values cover a range only in part
    return 1.0 if either == 0 else float(np.clip((both + slack * 2) / (min(hi1 - lo1, hi2 - lo2) + slack * 2 + 0.35 * (either - max(hi1 - lo1, hi2 - lo2))), 0, 1))


def value_likeness(a: dict, b: dict, kind: str, pair: dict) -> float:
    """0 to 1: are two fields' values of one sort? Same vocabulary, form, or range."""
    if kind in ("integer", "decimal"):
        return _range_likeness(a, b) if a["range"] and b["range"] else 0.0
    if kind in ("boolean", "array", "object"):
        return pair["forms"]
    # The share of occurrences whose word the other side has too; a few common words already tell.
    common = min(1.0, 0.8 * (pair["shared_old"] / a["n"] + pair["shared_new"] / b["n"]))
    # A vocabulary is closed if values repeat; then other words mean another sort.
    repeat = [1 - p["distinct"] / p["n"] for p in (a, b)]
    wordy = a["wordy"] > 0.5
    closed = min(1.0, 2 * min(repeat)) if wordy else 0.0
    if wordy and min(a["n"], b["n"]) < 6:  # too few to see repeats
        closed = max(closed, 0.3 if common == 0 else 0.0)
    return max(common if closed > 0.5 or not wordy else 0.0, pair["forms"] * (1 - closed) + common * closed)


def nested_likeness(a: dict, b: dict, pair: dict) -> float:
    """0 to 1: how much of their nested names (or item forms) two fields share, by occurrence."""
    either = a["nested_sum"] + b["nested_sum"] - pair["nested"]
    return pair["nested"] / either if either > 0 else 1.0


def name_likeness(a: str, b: str) -> float:
    """Shared character pairs of two names, whatever their case and separators."""
    x, y = (re.sub(r"[\W_]+", "", n.split(".", 1)[1].lower()) for n in (a, b))
    p, q = ({n[i : i + 2] for i in range(len(n) - 1)} for n in (x, y))
    return 2 * len(p & q) / max(1, len(p) + len(q))


def flood(first: np.ndarray, ends: np.ndarray, rounds: int = 200, eps: float = 1e-6) -> np.ndarray:
    """Similarity flooding to its fixpoint.

    ``first`` are the initial scores of pair nodes, ``ends`` the node numbers
    of each edge, shape (edges, 2). A score is divided evenly over the node's
    edges and flows to its neighbours, in both directions; every round adds
    what was there at first and what flowed in, and scales to a greatest of 1.
    Work and memory grow with nodes and edges.
    """
    n = len(first)
    src, dst = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    part = 1.0 / np.maximum(np.bincount(src, minlength=n), 1)
    score = first.copy()
    for _ in range(rounds):
        have = first + score
        new = have + np.bincount(dst, weights=(have * part)[src], minlength=n)
        new /= max(new.max(initial=0.0), 1e-12)
        if np.abs(new - score).max(initial=0.0) < eps:
            return new
        score = new
    return score


def match_fields(gone: list[dict], come: list[dict], kept: list[str], pairs: dict[tuple[str, str], dict], accept: float = 0.55) -> list[tuple[str, str]]:
    """One-to-one matches of the fields that went with those that came in the same step.

    Fields are dicts of name, kind and facts; ``pairs`` has what two of them
    have in common. The graph's nodes are pairs of types, of kinds, of fields
    of one namespace and kind, and, hanging on each pair of fields, those of
    their names, values and, for arrays and objects, nested names. Fields of
    both schemas that ``kept`` names are pairs too. Each field also has a pair
    with nothing, built alike, whose values are alike to ``accept``. A pair of
    fields is taken if its score at the fixpoint is above those of both its
    fields with nothing, the highest first.
    """
    nothing = {"shared_old": 0.0, "shared_new": 0.0, "forms": 0.0, "nested": 0.0}
    first: list[float] = [1.0]  # node 0: the two types
    ends: list[tuple[int, int]] = []
    kinds: dict[tuple, int] = {}

    def node(score: float, *near: int) -> int:
        first.append(score)
        ends.extend((len(first) - 1, k) for k in near)
        return len(first) - 1

    def fields(kind: str, space: str, value: float, name: float, nested: float) -> int:
        if (k := kinds.get((space, kind))) is None:
            k = kinds[(space, kind)] = node(0.5, 0)
        f = node(0.0, 0, k)
        node(value, f)
        node(NAME_WEIGHT * name, f)
        if kind in ("array", "object"):
            node(nested, f)
        return f

    for _ in kept:
        node(1.0, 0)
    alone = {(s, f["name"]): fields(f["kind"], _space(f["name"]), accept, 0.0, accept) for s, side in (("g", gone), ("c", come)) for f in side}
    at = {}
    for g in gone:
        for c in come:
            if _space(g["name"]) == _space(c["name"]) and g["kind"] == c["kind"]:
                p = pairs.get((g["name"], c["name"]), nothing)
                at[(g["name"], c["name"])] = fields(g["kind"], _space(g["name"]), value_likeness(g, c, g["kind"], p), name_likeness(g["name"], c["name"]), nested_likeness(g, c, p))
    if not at:
        return []
    score = flood(np.array(first), np.array(ends))
    found, used = [], set()
    for (g, c), k in sorted(at.items(), key=lambda x: (-score[x[1]], x[0])):
        if score[k] >= max(score[alone[("g", g)]], score[alone[("c", c)]]) and not used & {("g", g), ("c", c)}:
            found.append((g, c))
            used |= {("g", g), ("c", c)}
    return found


SHEET = "segment_id long, base_type string, side string, field string, other string, kind string, names array<string>, n long, distinct long, range array<double>, wordy double, nested_sum double, shared_old double, shared_new double, forms double, nested double"


def renames(step: DataFrame, events: DataFrame) -> DataFrame:
    """(segment_id, base_type, old_field, new_field): fields of one step that are one field under two names."""
    spaces = lambda c: F.transform(c, lambda x: F.substring_index(x["field"], ".", 1))
    both = cut(step.filter(F.arrays_overlap(spaces(F.col("gone")), spaces(F.col("come")))))
    side = lambda name, seg: both.select("segment_id", "base_type", F.col(seg).alias("seg"), F.lit(name).alias("side"), F.explode(name).alias("x"), "fields", "come")
    sides = side("gone", "before_segment").unionByName(side("come", "segment_id"))
    new = F.transform("come", lambda f: f["field"])
    names = F.array_except(F.transform("fields", lambda f: f["field"]), new)
    sides = sides.select("segment_id", "base_type", "seg", "side", "x.field", "x.kind", F.substring_index("x.field", ".", 1).alias("space"), names.alias("names"))
    wanted = sides.select(F.col("seg").alias("segment_id"), "base_type", "field").distinct()
    few = wanted.limit(100_001).count() <= 100_000
    hint = F.broadcast if few else lambda x: x
    at = ["segment_id", "base_type"]
    there = events.join(hint(wanted.select(*at).distinct()), at, "left_semi")
    per = distinct_values(value_rows(there, at).join(hint(wanted), [*at, "field"]), at).withColumnRenamed("segment_id", "seg")
    facts = cut(field_facts(per, ["seg", "base_type"]))
    pairs = pair_facts(sides.drop("names"), per, facts)
    sheet = sides.drop("space").join(facts, ["seg", "base_type", "field"]).drop("seg")
    sheet = sheet.unionByName(pairs.withColumnRenamed("old", "field").withColumnRenamed("new", "other").withColumn("side", F.lit("pair")), allowMissingColumns=True)
    sheet = sheet.select([F.col(c.split()[0]).cast(c.split()[1]) for c in SHEET.split(", ")])

    def one(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        by = {s: sorted((r | {"name": r["field"]} for r in rows if r["side"] == s), key=lambda f: f["name"]) for s in ("gone", "come")}
        pairs = {(r["field"], r["other"]): r for r in rows if r["side"] == "pair"}
        kept = next((r["names"] for r in rows if r["names"] is not None), [])
        m = match_fields(by["gone"], by["come"], kept, pairs)
        n = len(m)
        cols = [[rows[0]["segment_id"]] * n, [rows[0]["base_type"]] * n, [x for x, _ in m], [x for _, x in m]]
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(RENAMES, cols, strict=True)})

    # A group is the fields of one step and their pairs, whatever the number of events.
    return sheet.groupBy("segment_id", "base_type").applyInArrow(one, "segment_id long, base_type string, old_field string, new_field string")


def changes(log: DataFrame, segments: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Every change: (segment_id, event_type, change_kind, old_field, new_field).

    A field belongs to a type in a segment if at least a fifth of its readable
    payloads (of its events, for metadata) hold it. A type whose segment has no
    readable payload has no payload fields there. An empty log has no changes.
    ``counts`` are the log's ``field_counts``, if they are there already.
    """
    events = located(log, segments)
    step = cut(steps(schemas(field_counts(events) if counts is None else counts)))
    ren = cut(renames(step, events))
    row = lambda kind, old, new: F.struct(F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"))
    no = F.lit("")
    plain = F.concat(
        F.transform("come", lambda x: row("added", no, x["field"])),
        F.transform("gone", lambda x: row("removed", x["field"], no)),
        F.transform("retyped", lambda x: row("retyped", x["field"], x["field"])),
    )
    named = ren.groupBy("segment_id", "base_type").agg(
        F.collect_list(row("renamed", F.col("old_field"), F.col("new_field"))).alias("ren"),
        F.collect_list("old_field").alias("olds"),
        F.collect_list("new_field").alias("news"),
    )
    j = step.withColumn("plain", plain).join(named, ["segment_id", "base_type"], "left")
    empty = F.array().cast("array<string>")
    olds, news = F.coalesce("olds", empty), F.coalesce("news", empty)
    rest = F.filter(
        "plain",
        lambda x: ~((x["change_kind"] == "added") & F.array_contains(news, x["new_field"])) & ~((x["change_kind"] == "removed") & F.array_contains(olds, x["old_field"])),
    )
    every = F.when(F.col("ren").isNull(), F.col("plain")).otherwise(F.concat(rest, F.col("ren")))
    return j.select("segment_id", F.col("base_type").alias("event_type"), F.explode(every).alias("x")).select("segment_id", "event_type", "x.*")


def canonical_names(changed: DataFrame) -> DataFrame:
    """(event_type, field, canonical): names linked by renames of a type, and the one that stands for them.

    The name seen first in the log stands for all. A type's distinct rename
    pairs are few however often each happened; they are one small group.
    """
    first = changed.filter("change_kind = 'renamed'").groupBy("event_type", "old_field", "new_field").agg(F.min("segment_id").alias("at"))

    def one(t: pa.Table) -> pa.Table:
        top: dict[str, str] = {}

        def root(x: str) -> str:
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        rows = t.to_pylist()
        for r in sorted(rows, key=lambda r: (r["at"], r["old_field"], r["new_field"])):
            a, b = root(r["old_field"]), root(r["new_field"])
            if a != b:
                top[b] = a
        names = sorted(top)
        cols = [[rows[0]["event_type"]] * len(names), names, [root(n) for n in names]]
        return pa.table([pa.array(c, pa.string()) for c in cols], names=["event_type", "field", "canonical"])

    return first.groupBy("event_type").applyInArrow(one, "event_type string, field string, canonical string")


def widest_kinds(counts: DataFrame, names: DataFrame) -> DataFrame:
    """(base_type, field, canonical, kind): for every field its canonical name, and the kind that holds all values under that name.

    One kind stays; integers and decimals make a decimal; any other mixture,
    and metadata, are strings.
    """
    own = counts.filter("field != ''").select("base_type", "field", F.when(F.col("kind") == "text", "string").otherwise(F.col("kind")).alias("kind")).distinct()
    n = names.select(F.col("event_type").alias("base_type"), "field", "canonical")
    named = own.join(n, ["base_type", "field"], "left").withColumn("canonical", F.coalesce("canonical", "field"))
    kinds = F.array_sort(F.collect_set("kind"))
    wide = F.when(F.size("ks") == 1, F.col("ks")[0]).when(F.col("ks") == F.array(F.lit("decimal"), F.lit("integer")), "decimal").otherwise("string")
    per = named.groupBy("base_type", "canonical").agg(kinds.alias("ks")).select("base_type", "canonical", wide.alias("kind"))
    return named.select("base_type", "field", "canonical").distinct().join(per, ["base_type", "canonical"])


def _typed(v: Column, kind: Column) -> Column:
    """A variant cast to its field's kind."""
    text, number = v.cast("string").cast("variant"), v.cast("double").cast("variant")
    return F.when((kind == "decimal") & (F.schema_of_variant(v) == "BIGINT"), number).when(kind.isin(KINDS[1:]), v).otherwise(text)


def unified(log: DataFrame, segments: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """All events in one form: position, segment_id, event_type, ``fields``, ``conflicts``, ``unread``.

    ``fields`` maps canonical names to typed values (variants). Renamed fields
    stand under one name; values whose kind changed are cast to the widest
    kind that the name has anywhere in the type. Nulls are no values. Where an
    event has several values under one name (both names of a renamed field, or
    a metadata key twice), the one whose own name is the canonical one stands
    in ``fields``, and all others in ``conflicts``, an array of (field, raw,
    value): nothing is lost. A payload that can't be read gives no payload
    fields and is marked ``unread``. Names are joined as one map per type, by
    broadcast if they are at most 100,000, else with the frequent types split
    off.
    """
    counts = cut(field_counts(located(log, segments)))
    changed = changes(log, segments, counts) if changed is None else changed
    names = cut(widest_kinds(counts, canonical_names(changed).filter("field != canonical")))
    maps = names.groupBy("base_type").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("canonical", "kind").alias("to")))).alias("__to"))
    e = _objects(located(log, segments))
    e = e.join(F.broadcast(maps), "base_type", "left") if names.limit(100_001).count() <= 100_000 else join_split(e, maps, ["base_type"])
    none = F.array().cast("array<struct<raw:string,value:variant>>")
    entry = lambda p, v: lambda x: F.struct(F.concat(F.lit(p), x["key"]).alias("raw"), v(x["value"]).alias("value"))
    objects = F.map_entries(F.expr("try_variant_get(doc, '$', 'map<string,variant>')"))
    data = F.coalesce(F.transform(objects, entry("data.", lambda v: v)), none)
    meta = F.coalesce(F.transform("metadata", entry("metadata.", lambda v: v.cast("variant"))), none)
    kept = F.filter(F.concat(data, meta), lambda x: x["raw"].isNotNull() & x["value"].isNotNull() & (F.schema_of_variant(x["value"]) != "VOID"))
    to = lambda x: F.element_at("__to", x["raw"])
    named = F.transform(
        "__kept",  # a column of its own, so that it isn't made again for every element below
        lambda x, i: F.struct(
            F.coalesce(to(x)["canonical"], x["raw"]).alias("field"),
            (F.coalesce(to(x)["canonical"], x["raw"]) != x["raw"]).alias("other"),
            i.alias("i"),
            x["raw"].alias("raw"),
        ),
    )
    # In order of canonical name, own name first; the value is fetched by its place, as variants have no order.
    ranked = e.withColumn("__kept", kept).withColumn("__order", F.array_sort(named))
    again = lambda i: (i > 0) & (F.try_element_at("__order", i)["field"] == F.element_at("__order", i + 1)["field"])
    full = F.transform(
        "__order",
        lambda x, i: F.struct(
            x["field"].alias("field"),
            x["raw"].alias("raw"),
            _typed(F.element_at("__kept", x["i"] + 1)["value"], F.coalesce(F.element_at("__to", x["raw"])["kind"], F.lit("string"))).alias("value"),
            again(i).alias("again"),
        ),
    )
    out = ranked.withColumn("__all", full)
    firsts = F.transform(F.filter("__all", lambda x: ~x["again"]), lambda x: F.struct(x["field"].alias("key"), x["value"].alias("value")))
    rest = F.transform(F.filter("__all", lambda x: x["again"]), lambda x: F.struct(x["field"].alias("field"), x["raw"].alias("raw"), x["value"].alias("value")))
    return out.select("position", "segment_id", F.col("base_type").alias("event_type"), F.map_from_entries(firsts).alias("fields"), rest.alias("conflicts"), F.col("doc").isNull().alias("unread"))


def conflicts(table: DataFrame) -> DataFrame:
    """(event_type, field, raw, events): under which names a second value of a field came, in how many events."""
    names = F.transform("conflicts", lambda c: F.struct(c["field"].alias("field"), c["raw"].alias("raw")))
    # Written first: a filter that the optimizer makes of the explode would evaluate the whole table again.
    x = cut(table.select("event_type", names.alias("conflicts"))).select("event_type", F.explode("conflicts").alias("x"))
    return x.groupBy("event_type", F.col("x.field").alias("field"), F.col("x.raw").alias("raw")).agg(F.count(F.lit(1)).alias("events"))
