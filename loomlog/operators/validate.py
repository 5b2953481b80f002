"""The rules an event must keep before it is appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgumentError
from ..model import Event, TrackingInfo

# Fixed values of the log format.
MAX_TAGS = 65_535
MAX_METADATA = 65_535
MAX_METADATA_BYTES = 65_535
MAX_SOURCE_BYTES = 255


def header_bytes(type_col: str = "event_type", tags_col: str = "tags") -> Column:
    """Bytes of the parts that must stay together: type and tags."""
    tags = F.aggregate(F.coalesce(F.col(tags_col), F.array().cast("array<string>")), F.lit(0), lambda a, t: a + F.octet_length(t))
    return F.octet_length(F.coalesce(F.col(type_col), F.lit(""))) + tags


def error_column(max_header_bytes: int | None = None) -> Column:
    """The first rule an event breaks, or null. Null tags and metadata count as empty."""
    meta = F.coalesce(F.col("metadata"), F.array().cast("array<struct<key:string,value:string>>"))
    keys = F.transform(meta, lambda m: m["key"])
    long_key = F.exists(meta, lambda m: F.octet_length(F.coalesce(m["key"], F.lit(""))) > MAX_METADATA_BYTES)
    long_value = F.exists(meta, lambda m: F.octet_length(F.coalesce(m["value"], F.lit(""))) > MAX_METADATA_BYTES)
    out = (
        F.when(F.size(F.coalesce(F.col("tags"), F.array().cast("array<string>"))) > MAX_TAGS, "too many tags")
        .when(F.size(meta) > MAX_METADATA, "too many metadata entries")
        .when(long_key, "metadata key too long")
        .when(long_value, "metadata value too long")
        .when(F.size(F.array_distinct(keys)) != F.size(keys), "a metadata key stands twice")
    )
    if max_header_bytes is not None:
        out = out.when(header_bytes() > max_header_bytes, "event too large")
    return out


def validate(df: DataFrame, max_header_bytes: int | None = None) -> DataFrame:
    """``df`` with ``error``: null for events that may be appended."""
    return df.withColumn("error", error_column(max_header_bytes))


def check_event(e: Event, max_header_bytes: int | None = None) -> None:
    """The same rules on one event; raises InvalidArgumentError."""
    keys = [k for k, _ in e.metadata]
    size = len(e.event_type.encode()) + sum(len(t.encode()) for t in e.tags)
    for bad, why in (
        (len(e.tags) > MAX_TAGS, "too many tags"),
        (len(keys) > MAX_METADATA, "too many metadata entries"),
        (any(len(k.encode()) > MAX_METADATA_BYTES for k in keys), "metadata key too long"),
        (any(len(v.encode()) > MAX_METADATA_BYTES for _, v in e.metadata), "metadata value too long"),
        (len(set(keys)) != len(keys), "a metadata key stands twice"),
        (max_header_bytes is not None and size > max_header_bytes, "event too large"),
    ):
        if bad:
            raise InvalidArgumentError(why)


def check_tracking(t: TrackingInfo) -> None:
    if len(t.source.encode()) > MAX_SOURCE_BYTES:
        raise InvalidArgumentError("the name of a tracking source is too long")
