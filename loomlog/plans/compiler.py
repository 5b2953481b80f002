"""Compiles a query into one boolean column, and matches it in plain Python.

Empty parts are dropped here, never left to SQL: ``isin()`` of nothing matches
nothing, while an item without types must match every type.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MAX_POSITION, Event, Query, QueryItem


def item_column(item: QueryItem, type_col: str = "event_type", tags_col: str = "tags") -> Column:
    """The item as a column that is never null."""
    parts = []
    if item.types:
        parts.append(F.coalesce(F.col(type_col), F.lit("")).isin(sorted(set(item.types))))
    parts += [F.array_contains(F.coalesce(F.col(tags_col), F.array().cast("array<string>")), t) for t in dict.fromkeys(item.tags)]
    return reduce(operator.and_, parts) if parts else F.lit(True)


def is_match_all(query: Query | None) -> bool:
    return query is None or not query.items or any(not i.types and not i.tags for i in query.items)


def query_column(query: Query | None, type_col: str = "event_type", tags_col: str = "tags") -> Column:
    """The query as one column; an event that several items match is still one row.

    Where every item names types, their union is added as a conjunct of its
    own, as an ``IN`` that reaches the Parquet scan while ``array_contains``
    does not.
    """
    if is_match_all(query):
        return F.lit(True)
    out = reduce(operator.or_, [item_column(i, type_col, tags_col) for i in query.items])
    if all(i.types for i in query.items):
        out = F.col(type_col).isin(sorted({t for i in query.items for t in i.types})) & out
    return out


def bounds_column(start: int | None, backwards: bool, position_col: str = "position") -> Column:
    """``start`` is inclusive in both directions."""
    if start is None or (not backwards and start <= 0):
        return F.lit(True)
    if start > MAX_POSITION:
        return F.lit(bool(backwards))
    c = F.col(position_col)
    return c <= start if backwards else c >= start


def matches(query: Query | None, event: Event) -> bool:
    """The same test on one event, for the in-batch part of appends."""
    if query is None or not query.items:
        return True
    tags = set(event.tags)
    return any((not i.types or event.event_type in i.types) and tags.issuperset(i.tags) for i in query.items)
