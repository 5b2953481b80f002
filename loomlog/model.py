"""Values of the event-log API and the canonical schemas."""

from __future__ import annotations

import uuid as _uuid
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import InvalidArgumentError

MAX_POSITION = 2**63 - 1

EVENT_FIELDS = [
    T.StructField("event_type", T.StringType(), False),
    T.StructField("tags", T.ArrayType(T.StringType(), False), False),
    T.StructField("data", T.BinaryType(), False),
    T.StructField("uuid", T.StringType(), True),
    T.StructField(
        "metadata",
        T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]), False),
        False,
    ),
]
TRACKING_TYPE = T.StructType([T.StructField("source", T.StringType()), T.StructField("position", T.LongType())])
LOG_SCHEMA = T.StructType(
    [T.StructField("position", T.LongType(), False), *EVENT_FIELDS, T.StructField("tracking_info", TRACKING_TYPE, True)]
)
INDEX_SCHEMA = T.StructType([T.StructField("tag", T.StringType(), False), T.StructField("position", T.LongType(), False)])
TRACKING_SCHEMA = T.StructType([T.StructField("source", T.StringType(), False), T.StructField("position", T.LongType(), False)])


@dataclass(frozen=True)
class TrackingInfo:
    """The upstream record that caused an append."""

    source: str
    position: int


@dataclass
class Event:
    """An event not yet in the log. ``metadata`` keeps its order; keys are unique."""

    event_type: str = ""
    data: bytes = b""
    tags: list[str] = field(default_factory=list)
    uuid: str | None = None
    metadata: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if isinstance(self.metadata, dict):
            self.metadata = list(self.metadata.items())
        if self.uuid is not None:
            try:
                self.uuid = str(_uuid.UUID(str(self.uuid)))
            except ValueError as e:
                raise InvalidArgumentError(f"bad uuid: {self.uuid!r}") from e


@dataclass
class SequencedEvent:
    """An event with its place in the log."""

    position: int
    event: Event
    tracking_info: TrackingInfo | None = None


@dataclass
class QueryItem:
    """Matches an event of any of ``types`` (all, if empty) that carries all ``tags``."""

    types: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)


@dataclass
class Query:
    """Matches an event that any item matches; without items, every event."""

    items: list[QueryItem] = field(default_factory=list)


@dataclass
class AppendCondition:
    """Fails if an event beyond ``after`` (any event, if None) matches the query."""

    fail_if_events_match: Query = field(default_factory=Query)
    after: int | None = None


@dataclass
class AppendRequest:
    """What one append call asks for."""

    events: list[Event]
    condition: AppendCondition | None = None
    tracking_info: TrackingInfo | None = None
