"""Schemas, settings and errors of the event engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

CONTRACT_VIOLATION = "contract_violation"
DUPLICATE_KEY = "duplicate_key"
#: Fixed value: the error code of a unique-key conflict; every other code may be tried again.
DUPLICATE_CODE = 11000
#: The code given to rows of a bulk call that didn't get through; they are tried again.
UNAVAILABLE_CODE = 91


class EngineError(Exception):
    """Base of the errors that the engine raises itself."""


class EmptyNamespace(EngineError):
    pass


class MissingSink(EngineError):
    pass


class MissingContract(EngineError):
    pass


class MissingSource(EngineError):
    pass


class EmptyKey(EngineError):
    pass


class Closed(EngineError):
    pass


class SinkUnavailable(EngineError):
    """A whole bulk write failed; everything in it stays pending."""


class UnknownStrategy(EngineError, ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    """Defaults hold unless a caller gives a positive value.

    bands: partitions of keys; each is flushed, and written over one connection, by itself.
    flush_window_ms: pending rows are flushed at least so often.
    max_batch: rows of one bulk call to a store, and the depth at which a band is flushed at once.
    key_ttl_ms, expire: with expire, events older than that are dropped; off by default, so an outage loses nothing.
    batched_writes, write_batch, write_window_ms: journal every write_window_ms and flush a band at write_batch rows.
    poll_ms: as write_window_ms, but with max_batch as the depth; 0 flushes every micro-batch.
    dlq_batch: rows of one bulk call for dead letters; dead_letter_ttl_ms: how long a dead letter is kept.
    max_attempts: how often a bulk call is tried.
    """

    bands: int = 16
    flush_window_ms: int = 250
    max_batch: int = 1000
    key_ttl_ms: int = 30_000
    expire: bool = False
    degraded_direct: bool = True
    batched_writes: bool = False
    write_batch: int = 200
    write_window_ms: int = 5
    poll_ms: int = 0
    dlq_interval_s: float = 30.0
    dlq_batch: int = 100
    dead_letter_ttl_ms: int = 7 * 24 * 3600 * 1000
    max_attempts: int = 5

    def __post_init__(self) -> None:
        for name, f in type(self).__dataclass_fields__.items():
            if not isinstance(f.default, bool) and getattr(self, name) <= 0:
                object.__setattr__(self, name, f.default)

    @property
    def trigger_ms(self) -> int:
        return self.write_window_ms if self.batched_writes else self.poll_ms or self.flush_window_ms

    @property
    def volume(self) -> int | None:
        """The depth at which a band is flushed before its time; None if every micro-batch flushes all."""
        return self.write_batch if self.batched_writes else self.max_batch if self.poll_ms else None
