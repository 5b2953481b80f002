"""At-least-once deliveries: keep exactly one copy of each message."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, join_split


def uuid_digits(c: Column) -> Column:
    """The 32 hex digits of a uuid in lower case, whatever its dressing; null for all zeros and any other text."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"[\s{}()\[\]<>\"'-]", "")
    bare = F.regexp_replace(bare, "^(urn:)?(uuid:)?", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$") & (bare != "0" * 32), bare)


def keep_one(df: DataFrame, identifier: Column, order: list[str]) -> DataFrame:
    """One row per value of ``identifier``: the first by ``order``; rows with a null identifier all stay.

    A hash aggregation with min_by over a struct: every task keeps one row per
    identifier before anything is shuffled, so a message that came a billion
    times moves once per task. ``order`` need not be total: rows that tie are
    told apart by a hash of the whole row, equal rows are one. Columns stay as
    they are, whatever their names; nulls in ``order`` come first.
    """
    has_map = any("map<" in t for _, t in df.dtypes)
    whole = F.xxhash64(F.to_json(F.struct("*"))) if has_map else F.xxhash64("*")
    packed = df.select(identifier.alias("id"), F.struct("*").alias("r"), F.struct(*[F.col(c) for c in order], whole).alias("k"))
    one = packed.filter("id is not null").groupBy("id").agg(F.min_by("r", "k").alias("r"))
    return one.select("r.*").unionByName(packed.filter("id is null").select("r.*"))


def first_copies(df: DataFrame, identifiers: dict[str, Column], row_id: str, max_rounds: int = 60) -> DataFrame:
    """Groups rows that share any identifier, also by way of other rows.

    Returns ``row_id`` and ``first_id``, the least row id of its group, for
    every row with an identifier; a row without any is its own group and is
    left out, as are rows with a null id, which nothing could name. A row id
    that stands twice gives a row for each.

    Rows are first reduced, map-side, to distinct identifier combinations with
    their least row id. A combination whose identifiers stand nowhere else is
    done. The others pass minima along shared identifiers, and each also takes
    over what its current minimum's combination has learned, so a chain of n
    links takes about log n rounds; every round is a written table. A group of
    copies of any size is one row per combination. Shared identifiers are
    aggregated before the shuffle; rows that lack one go around its join, and
    hot ones are joined by a bounded broadcast.
    """
    names = list(identifiers)
    keyed = df.select(F.col(row_id).alias("__row"), *[F.coalesce(c, F.lit("")).alias(n) for n, c in identifiers.items()])
    keyed = keyed.filter("__row is not null").filter(reduce(lambda a, b: a | b, [F.col(n) != "" for n in names]))
    combos = cut(keyed.groupBy(*names).agg(F.min("__row").alias("first_id"), F.count(F.lit(1)).alias("__rows")))
    seen = combos.withColumn("__shared", F.lit(False))
    for n in names:
        seen = _along(seen, n, F.count(F.lit(1)).alias("__k"), "__shared", lambda: F.col("__shared") | F.col("__k").isNotNull(), F.col("__k") > 1)
    seen = cut(seen)
    done = seen.filter("not __shared").drop("__shared")
    live = seen.filter("__shared").drop("__shared").withColumn("__self", F.col("first_id"))
    for _ in range(max_rounds):
        step = live.withColumn("__old", F.col("first_id"))
        for n in names:
            step = _along(step, n, F.min("first_id").alias("__k"), "first_id", lambda: F.least("first_id", "__k"))
        live = cut(step)
        if not live.filter("first_id < __old").limit(1).count():
            break
        known = live.select(F.col("__self").alias("first_id"), F.col("first_id").alias("__m"))
        live = join_split(live.drop("__old"), known, ["first_id"]).withColumn("first_id", F.col("__m")).drop("__m")
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    labels = cut(done.unionByName(live.select(*names, "first_id", "__rows")))
    counts = labels.select(*names, F.col("__rows").alias("n"))
    return join_split(keyed, labels.drop("__rows"), names, counts).select(F.col("__row").alias(row_id), "first_id")


def _along(step: DataFrame, name: str, agg: Column, target: str, new: Callable[[], Column], wanted: Column | None = None) -> DataFrame:
    """Sets ``target`` to ``new()``, of which ``__k`` is ``agg`` over the rows that share identifier ``name``; rows without it stay.

    Only values for which ``wanted`` holds are joined; for others ``__k`` is null.
    """
    have = step.filter(F.col(name) != "")
    side = have.groupBy(name).agg(agg, F.count(F.lit(1)).alias("n"))
    side = cut(side if wanted is None else side.filter(wanted))
    met = join_split(have, side.drop("n"), [name], side.select(name, "n")).withColumn(target, new()).select(*step.columns)
    return met.unionByName(step.filter(F.col(name) == ""))


def surplus(df: DataFrame, identifiers: dict[str, Column], row_id: str) -> DataFrame:
    """``row_id`` of every row that is not the first copy of its message."""
    return first_copies(df, identifiers, row_id).filter(F.col(row_id) != F.col("first_id")).select(row_id)


def own_identifier() -> Column:
    """The one identifier of a delivery for a single aggregation: its uuid, else its source and position."""
    return F.coalesce(*delivery_identifiers().values())


def delivery_identifiers() -> dict[str, Column]:
    """How ``deliveries`` are known: by uuid, or by source and position together."""
    both = F.col("source").isNotNull() & F.col("position").isNotNull()
    return {"__uuid": uuid_digits(F.col("uuid")), "__upstream": F.when(both, F.concat(F.col("position").cast("string"), F.lit(":"), F.col("source")))}
