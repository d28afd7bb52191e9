"""Column functions of the event engine; all are built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME, MASK32 = 2166136261, 16777619, 0xFFFFFFFF


def fnv32a(key: Column) -> Column:
    """FNV-1a over the UTF-8 bytes of a string, as an unsigned value in a BIGINT."""
    octets = key.cast("binary")
    each = F.when(F.octet_length(octets) > 0, F.sequence(F.lit(1), F.octet_length(octets))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        each,
        F.lit(FNV_BASIS).cast("long"),
        lambda h, i: (h.bitwiseXOR(F.conv(F.hex(F.substring(octets, i, F.lit(1))), 16, 10).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK32)),
    )


def band_of(key: Column, bands: int) -> Column:
    return (fnv32a(key) % F.lit(bands)).cast("int")


def dlq_key(key: Column, at: Column) -> Column:
    """A key for re-insertion: the old one and the time in nanoseconds."""
    return F.concat(key, F.lit("_dlq_"), (F.unix_micros(at) * 1000).cast("string"))


def prefixed_key(key: Column, prefix: str = "reinserted_") -> Column:
    return F.concat(F.lit(prefix), key)


def retry_key(key: Column, at: Column) -> Column:
    return F.concat(key, F.lit(":retry:"), F.date_format(at, "yyyyMMdd'T'HHmmss"))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def padded(prefix: str, width: int, n: Column) -> Column:
    return F.format_string(f"{prefix}%0{width}d", n)


def pick(options: list[str], n: Column) -> Column:
    """The option at position n modulo their number."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(n, F.lit(len(options))) + 1).cast("int"))
