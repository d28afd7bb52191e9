"""Contracts: what turns a key and its payload into an upsert, or refuses it.

A contract is built from column expressions where possible; one written in
Python runs over Arrow batches.  Either way a row comes out with ``ok`` and, if
refused, ``reason``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.model import CONTRACT_VIOLATION


@dataclass(frozen=True)
class ColumnContract:
    """fields: the document's columns; accept: whether a row may be written."""

    fields: dict[str, Column]
    accept: Column | None = None
    schema: T.StructType | None = None
    payload: str = "payload"
    upsert: bool = True

    def apply(self, rows: DataFrame, key: str = "key") -> DataFrame:
        ok = self.accept if self.accept is not None else F.lit(True)
        if self.schema is not None:
            # a payload that doesn't parse is refused; the parsed one is the struct column doc
            parsed = T.StructType([*self.schema.fields, T.StructField("_corrupt", T.StringType())])
            rows = rows.withColumn("doc", F.from_json(self.payload, parsed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
            ok = F.col("doc._corrupt").isNull() & ok
        shaped = rows.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumns(self.fields)
        return shaped.withColumn("upsert", F.lit(self.upsert)).withColumn("reason", F.when(~F.col("ok"), CONTRACT_VIOLATION))


@dataclass(frozen=True)
class PythonContract:
    """func(key, payload) returns a dict of fields or raises; ``schema`` names the fields."""

    func: Callable[[str, str], dict[str, Any] | None]
    schema: T.StructType
    payload: str = "payload"
    upsert: bool = True
    _extra: T.StructType = field(default_factory=lambda: T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())]))

    def apply(self, rows: DataFrame, key: str = "key") -> DataFrame:
        names, func, payload = self.schema.names, self.func, self.payload

        def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                made: dict[str, list] = {n: [] for n in [*names, "ok", "error"]}
                for k, p in zip(pdf[key], pdf[payload], strict=True):
                    try:
                        doc, error = func(k, p), None
                        if doc is None:
                            error = "the contract returned no document"
                    except Exception as e:  # noqa: BLE001  whatever a user's contract raises refuses the row
                        doc, error = None, str(e)
                    for n in names:
                        made[n].append((doc or {}).get(n))
                    made["ok"].append(error is None)
                    made["error"].append(error)
                yield pdf.assign(**{n: pd.Series(v, index=pdf.index, dtype=object if n != "ok" else bool) for n, v in made.items()})

        out = T.StructType([*(f for f in rows.schema.fields if f.name not in {*names, "ok", "error"}), *self.schema.fields, *self._extra.fields])
        shaped = rows.drop(*names, "ok", "error").mapInPandas(shape, out)
        return shaped.withColumn("upsert", F.lit(self.upsert)).withColumn("reason", F.when(~F.col("ok"), CONTRACT_VIOLATION))


def accepted(shaped: DataFrame) -> DataFrame:
    return shaped.filter("ok")


def rejected(shaped: DataFrame) -> DataFrame:
    return shaped.filter(~F.col("ok"))


def route_counts(shaped: DataFrame) -> DataFrame:
    return shaped.groupBy(F.when(F.col("ok"), "ok").otherwise(F.col("reason")).alias("route")).agg(F.count(F.lit(1)).alias("n"))
