"""Operators on keyed events, from arrival to the pending set.

Each takes and returns DataFrames, so the same code runs over a bounded table
and inside a micro-batch.  An event has a key and ``seq``, its place in the order
of arrival; the latest event of a key is the one with the highest ``seq``,
whatever time it carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import band_of, epoch_ms


def valid_key(key: Column) -> Column:
    return key.isNotNull() & (key != "")


def ingest(events: DataFrame, key: str = "key") -> DataFrame:
    """Events that have a key; the rest can't be stored and are refused."""
    return events.filter(valid_key(F.col(key)))


def refused(events: DataFrame, key: str = "key") -> DataFrame:
    return events.filter(~valid_key(F.col(key)))


def coalesce_latest(events: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """One row per key: the one that arrived last.

    A partial aggregate runs before the shuffle, so a hot key sends one row per
    task.  Of equal ``seq`` the greatest row wins, which makes replays agree.
    """
    rest = [c for c in events.columns if c != key]
    row = F.struct(F.col(seq).alias("_order"), *rest)
    return events.groupBy(key).agg(F.max(row).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def with_band(rows: DataFrame, bands: int, key: str = "key") -> DataFrame:
    return rows.withColumn("band", band_of(F.col(key), bands))


def _cuts(rows: DataFrame, column: str, parts: int) -> list:
    """Values that cut the rows into at most ``parts`` ranges of about equal size."""
    kind = rows.schema[column].dataType
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        found = rows.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)] or [1.0], max(10_000, 10 * parts))).collect()[0][0]
        return sorted(set(found or []))
    ranged = rows.select(column).filter(F.col(column).isNotNull()).repartitionByRange(parts, column)
    return sorted({r.least for r in ranged.groupBy(F.spark_partition_id()).agg(F.min(column).alias("least")).collect()})


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Add ``_place``, a row's place from 0 in its group, without a task that sees a whole group.

    Rows are numbered within ranges of the first column of ``order`` and shifted
    by the counts of the ranges before.  The ranges' bounds are found first and
    are literals of the plan: the counts and the rows are read by different
    branches, and a lost executor's tasks are run again, so a partition's number
    would not do.  There is a count for each group and range; groups are few.
    Rows equal in the first column share a range.  Nulls are numbered first.
    """
    by = by or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(rows, order[0], parts)
    bounds = F.array(*(F.lit(c) for c in cuts)).cast(T.ArrayType(rows.schema[order[0]].dataType))
    # how many bounds are not above the value, by halving steps
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length())))).cast("array<int>")
    ranged = rows.withColumn("_range", F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(bounds, at + step - 1) <= F.col(order[0]), step).otherwise(0)))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy(*by, "_range").count().select(*by, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(shift, [*by, "_range"]).withColumn("_place", F.col("_own") + F.col("_shift")).drop("_own", "_range", "_shift")


def write_batches(events: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """Number the events in arrival order and deal them to batches of ``size``."""
    return numbered(events, [seq]).withColumn("write_batch", F.floor(F.col("_place") / size)).drop("_place")


def depth(rows: DataFrame) -> DataFrame:
    """Distinct keys of each band; rows hold a key once."""
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("depth"))


def ready_bands(rows: DataFrame, threshold: int) -> DataFrame:
    """Bands that have reached the volume at which they are flushed at once."""
    return depth(rows).filter(F.col("depth") >= threshold)


def bands_touched(batched: DataFrame) -> DataFrame:
    return batched.select("write_batch", "band").distinct()


def drain_oldest(rows: DataFrame, limit: int, score: str, key: str = "key") -> DataFrame:
    """The ``limit`` rows of each band that were last written longest ago; ties by key."""
    order = Window.partitionBy("band").orderBy(score, key)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def unexpired(rows: DataFrame, ttl_ms: int, now: Column, ts: str = "ts", payload: str | None = "payload") -> DataFrame:
    """Drop rows whose payload is missing, empty or past its time."""
    alive = epoch_ms(F.col(ts)) + F.lit(ttl_ms) > epoch_ms(now)
    if payload is not None:
        alive &= F.col(payload).isNotNull() & (F.octet_length(F.col(payload)) > 0)
    return rows.filter(alive)


def attach_payload(pending: DataFrame, payloads: DataFrame, key: str = "key") -> DataFrame:
    """Look up what is stored under each pending key; keys without a payload are marked as expired."""
    found = payloads.withColumn("_found", F.lit(True))
    return pending.join(found, key, "left").withColumn("expired", F.col("_found").isNull()).drop("_found")


def flush_chunks(rows: DataFrame, size: int, score: str, key: str = "key") -> DataFrame:
    """Deal the rows of each band, oldest first, to bulk calls of at most ``size``."""
    return numbered(rows, [score, key], ["band"]).withColumn("chunk", F.floor(F.col("_place") / size)).drop("_place")


def flush_windows(events: DataFrame, width: str, key: str = "key", seq: str = "seq", ts: str = "ts") -> DataFrame:
    """Coalesce within tumbling windows: what a timer of that width would have flushed."""
    windowed = events.withColumn("window_start", F.window(F.col(ts).cast("timestamp"), width)["start"])
    rest = [c for c in events.columns if c not in (key,)]
    row = F.struct(F.col(seq).alias("_order"), *rest)
    latest = windowed.groupBy("window_start", key).agg(F.max(row).alias("_row"), F.count(F.lit(1)).alias("events"))
    return latest.select("window_start", key, "events", *(F.col(f"_row.{c}").alias(c) for c in rest))


def io_reduction(events: DataFrame, key: str = "key") -> DataFrame:
    """Events, keys left after coalescing, and their ratio."""
    per_key = events.groupBy(key).count()
    sums = per_key.agg(F.sum("count").alias("events"), F.count(F.lit(1)).alias("upserts"))
    return sums.withColumn("ratio", F.col("events").cast("double") / F.col("upserts"))
