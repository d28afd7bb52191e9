"""Dead letters: rows that were refused, and the ways to be rid of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.model import UnknownStrategy

STRATEGIES = ("ignore", "upsert", "reinsert")


def strategy_name(strategy: int | str) -> str:
    """A strategy by its name or its place among STRATEGIES; unknown for any other."""
    if isinstance(strategy, str):
        return strategy if strategy in STRATEGIES else "unknown"
    return STRATEGIES[strategy] if 0 <= strategy < len(STRATEGIES) else "unknown"


@dataclass
class DlqOutcome:
    """left: what stays; written: documents to upsert; again: events to journal under a new key; counts: one row."""

    left: DataFrame
    written: DataFrame | None
    again: DataFrame | None
    counts: DataFrame


def to_dead_letters(rejects: DataFrame, failed_at: Column, reason: str | None = None) -> DataFrame:
    """A dead letter carries its own copy of the payload and why and when it failed."""
    rows = rejects if reason is None else rejects.withColumn("reason", F.lit(reason))
    return rows.withColumn("failed_at", failed_at)


def move(pending: DataFrame, letters: DataFrame, key: str = "key") -> DataFrame:
    """The pending set without the dead letters."""
    return pending.join(letters.select(key).distinct(), key, "left_anti")


def by_reason(letters: DataFrame) -> DataFrame:
    return letters.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _counts(letters: DataFrame, good: Column) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return letters.agg(F.count(F.lit(1)).alias("processed"), n(good).alias("succeeded"), n(~good).alias("failed"))


def process(letters: DataFrame, strategy: str, heal: Callable[[DataFrame], DataFrame] | None = None, mutate: Callable[[Column], Column] | None = None, key: str = "key") -> DlqOutcome:
    """Apply a strategy to every dead letter, each once.

    ignore: all go.  upsert: ``heal`` (a contract's apply) shapes the rows; those
    it refuses stay.  reinsert: all are journalled again under ``mutate(key)``.
    """
    nothing = letters.limit(0)
    if strategy == "ignore":
        return DlqOutcome(nothing, None, None, _counts(letters, F.lit(True)))
    if strategy == "upsert":
        if heal is None:
            raise ValueError("the upsert strategy needs a contract")
        shaped = heal(letters)
        good = shaped.filter("ok")
        return DlqOutcome(letters.join(shaped.filter(~F.col("ok")).select(key), key, "left_semi"), good, None, _counts(shaped, F.col("ok")))
    if strategy == "reinsert":
        if mutate is None:
            raise ValueError("the reinsert strategy needs a key mutator")
        return DlqOutcome(nothing, None, letters.withColumn(key, mutate(F.col(key))), _counts(letters, F.lit(True)))
    raise UnknownStrategy(strategy)
