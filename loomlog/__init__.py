"""loomlog: an append-only event-log engine on PySpark.

One gapless, globally ordered log of events (type, tags, opaque payload,
optional id, metadata), read by type-and-tag queries, appended to under
conditions, followed by subscriptions; and the data-processing operators that
large logs need (deduplication, incremental pickup, skewed keys, drifting
schemas).
"""

from .errors import (
    CancelledError,
    CorruptionError,
    EventStoreError,
    IntegrityError,
    InvalidArgumentError,
    StoreTimeoutError,
)
from .model import AppendCondition, AppendRequest, Event, Query, QueryItem, SequencedEvent, TrackingInfo

__all__ = [
    "AppendCondition",
    "AppendRequest",
    "CancelledError",
    "CorruptionError",
    "Event",
    "EventStoreError",
    "IntegrityError",
    "InvalidArgumentError",
    "Query",
    "QueryItem",
    "SequencedEvent",
    "StoreTimeoutError",
    "TrackingInfo",
]
