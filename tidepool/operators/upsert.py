"""Bulk upserts into a keyed table, their counters, and what becomes of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.model import DUPLICATE_CODE


def merge(base: DataFrame, new: DataFrame, key: str = "_id", insert: bool = True) -> DataFrame:
    """The table after the upsert: listed fields are set, even to null; others stay.

    Fields that only one side has are null where a row lacks them.  Without
    ``insert`` rows that match nothing are left out.
    """
    fields = [c for c in dict.fromkeys([*base.columns, *new.columns]) if c != key]
    b = base.select(key, *(F.col(c).alias(f"_b_{c}") for c in base.columns if c != key))
    n = new.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_n_{c}") for c in new.columns if c != key))

    def value(c: str) -> Column:
        old = F.col(f"_b_{c}") if c in base.columns else F.lit(None)
        return (F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(old) if c in new.columns else old).alias(c)

    return b.join(n, key, "full_outer" if insert else "left").select(key, *map(value, fields))


def merge_map(old: Column, new: Column) -> Column:
    """Field-level set on free-form documents: keys of ``new`` win, others stay."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def merge_counts(base: DataFrame, new: DataFrame, key: str = "_id", insert: bool = True) -> DataFrame:
    """matched, modified and upserted, as one row; an upsert never counts as inserted."""
    shared = [c for c in new.columns if c != key and c in base.columns]
    added = [c for c in new.columns if c != key and c not in base.columns]
    b = base.select(key, F.lit(True).alias("_old"), *(F.col(c).alias(f"_b_{c}") for c in shared))
    both = new.join(b, key, "left")
    changed = F.lit(False)
    for c in shared:
        changed |= ~F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    for c in added:
        changed |= F.col(c).isNotNull()
    total = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(
        F.lit(0).cast("long").alias("inserted"),
        total(F.col("_old").isNotNull()).alias("matched"),
        total(F.col("_old").isNotNull() & changed).alias("modified"),
        total(F.col("_old").isNull() & F.lit(insert)).alias("upserted"),
    )


def unique_conflicts(rows: DataFrame, unique: list[str], order: str, key: str = "key") -> DataFrame:
    """Rank the rows that claim a unique value; all but the first of them conflict."""
    place = F.row_number().over(Window.partitionBy(*unique).orderBy(order, key))
    return rows.withColumn("claim", place).withColumn("conflict", F.col("claim") > 1)


def conflicts_with_table(rows: DataFrame, base: DataFrame, unique: str, key: str = "_id") -> DataFrame:
    """Rows whose unique value another row of the table already holds."""
    held = base.select(F.col(unique).alias("_value"), F.col(key).alias("_holder"))
    return rows.join(held, (F.col(unique) == F.col("_value")) & (F.col(key) != F.col("_holder")), "left_semi")


def route_of(code: Column) -> Column:
    """What happens to a row with that error code: ok, dlq (never to succeed) or retry."""
    return F.when(code.isNull(), "ok").when(code == DUPLICATE_CODE, "dlq").otherwise("retry")


def succeeded(rows: DataFrame, failed: DataFrame, key: str = "key") -> DataFrame:
    return rows.join(failed.select(key).distinct(), key, "left_anti")


def carry_over(failed: DataFrame, arriving: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Rows to be tried again together with the next batch; a newer event replaces the old one."""
    from .journal import coalesce_latest

    return coalesce_latest(failed.unionByName(arriving), key, seq)


def direct(events: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The writes of the uncoalesced path: every event is one, numbered by key in arrival order."""
    order = Window.partitionBy(key).orderBy(seq)
    return events.withColumn("write_no", F.row_number().over(order)).withColumn("final", F.lead(F.lit(1)).over(order).isNull())
