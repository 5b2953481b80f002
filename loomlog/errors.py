"""Error hierarchy of the event store."""


class EventStoreError(Exception):
    """Any failure reported by the store."""


class InvalidArgumentError(EventStoreError, ValueError):
    """The caller's input breaks a rule; nothing was written."""


class IntegrityError(EventStoreError, ValueError):
    """An append condition or a tracking position forbids the append."""


class CorruptionError(EventStoreError, RuntimeError):
    """Stored files contradict the manifest."""


class CancelledError(EventStoreError):
    """A read or subscription was cancelled by the user."""


class StoreTimeoutError(EventStoreError, TimeoutError):
    """Nothing arrived in the time given."""


class ConflictError(EventStoreError):
    """Another writer published the same manifest version first."""
