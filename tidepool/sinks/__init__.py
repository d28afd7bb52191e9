"""Where upserts go.

A sink takes a batch of documents keyed by ``_id`` and says which rows failed.
The same batch id may come again after a failure; a sink applies it once.
"""

from __future__ import annotations

import itertools
import json
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.model import DUPLICATE_CODE, UNAVAILABLE_CODE, Settings, SinkUnavailable
from tidepool.operators.upsert import conflicts_with_table, merge, merge_counts, unique_conflicts

_ERRORS = "key string, code int, error string"
_COUNTERS = ("inserted", "matched", "modified", "upserted")


@dataclass
class BulkResult:
    """errors: key, code, error for each row that failed, or None if none did."""

    inserted: int = 0
    matched: int = 0
    modified: int = 0
    upserted: int = 0
    errors: DataFrame | None = None


class Sink(ABC):
    @abstractmethod
    def bulk_write(self, docs: DataFrame, batch_id: int) -> BulkResult:
        """Upsert docs (_id and fields); raise SinkUnavailable if nothing could be written."""

    def write(self, docs: DataFrame, call_rows: int | None = None) -> BulkResult:
        """Documents outside of batches (dead letters, the degraded path), call_rows of them to a bulk call."""
        return self.bulk_write(docs, -1)

    def configure(self, settings: Settings) -> None:
        """The engine's settings, given when it is built."""

    def ping(self) -> None:
        """Raise SinkUnavailable if the sink can't be reached."""

    def close(self) -> None:
        """Release what the sink holds."""


@dataclass
class SnapshotSink(Sink):
    """A keyed table of parquet files, rewritten by bucket.

    Keys are dealt to buckets; a batch rewrites only the buckets that it
    touches and then swaps a small manifest, so readers see whole batches and a
    failed one leaves the old state.  Beyond ``bucket_rows`` rows a bucket the
    number of buckets doubles with the next batch, so a batch rewrites about as
    many rows for each key however large the table is.  ``unique`` names fields
    no two documents may share: later claimants fail with the duplicate-key code.

    The manifest holds the last batch's result; if that batch comes again it is
    given back and nothing is written.  Folders that neither this manifest nor
    the one before it names are deleted.
    """

    spark: SparkSession
    path: str
    buckets: int = 16
    unique: list[str] = field(default_factory=list)
    bucket_rows: int = 1_000_000

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, fs, path) -> list[str]:
        return sorted(s.getPath().getName() for s in fs.listStatus(path(self.path))) if fs.exists(path(self.path)) else []

    def _manifest(self) -> dict:
        fs, path = self._fs()
        done = [n for n in self._names(fs, path) if n.startswith("manifest-")]
        if not done:
            return {"n": 0, "batch": -1, "buckets": self.buckets, "rows": 0, "folders": {}, "schema": None, "result": None}
        row = self.spark.read.text(f"{self.path}/{done[-1]}", wholetext=True).collect()[0]
        return json.loads(row[0])

    def read(self) -> DataFrame | None:
        m = self._manifest()
        return self._read(m, m["folders"]) if m["folders"] else None

    def _read(self, m: dict, folders: dict[str, str]) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(m["schema"])).parquet(*folders.values())

    def _replayed(self, m: dict, batch_id: int) -> BulkResult:
        r = m["result"]
        if batch_id < m["batch"] or r is None:
            return BulkResult()
        errors = self.spark.read.schema(_ERRORS).parquet(r["errors"]) if r["errors"] else None
        return BulkResult(r["inserted"], r["matched"], r["modified"], r["upserted"], errors)

    def bulk_write(self, docs: DataFrame, batch_id: int) -> BulkResult:
        m = self._manifest()
        if 0 <= batch_id <= m["batch"]:
            return self._replayed(m, batch_id)
        grown = m["rows"] > m["buckets"] * self.bucket_rows
        buckets = m["buckets"] * (2 if grown else 1)
        bucket = F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int")
        touched = list(range(buckets)) if grown else [r.b for r in docs.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
        old = m["folders"] if grown else {b: m["folders"][str(b)] for b in touched if str(b) in m["folders"]}
        base = self._read(m, old) if old else docs.limit(0)
        name = f"{m['n'] + 1:012d}-{uuid.uuid4().hex}"
        errors, wrong = None, None
        if self.unique:
            wrong = f"{self.path}/errors-{name}"
            self._conflicts(docs).write.parquet(wrong)
            errors = self.spark.read.schema(_ERRORS).parquet(wrong)
            if errors.isEmpty():
                errors, wrong = None, None
        good = docs if errors is None else docs.join(errors.select(F.col("key").alias("_id")), "_id", "left_anti")
        counts = merge_counts(base, good, "_id").collect()[0].asDict()
        folder = f"{self.path}/data-{name}"
        new = merge(base, good, "_id")
        new.repartition(bucket).withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(folder)
        fs, path = self._fs()
        made = {s.getPath().getName() for s in fs.listStatus(path(folder))}
        kept = {} if grown else m["folders"]
        folders = {**kept, **{str(b): f"{folder}/_bucket={b}" for b in touched if f"_bucket={b}" in made}}
        text = json.dumps(
            {"n": m["n"] + 1, "batch": max(batch_id, m["batch"]), "buckets": buckets, "rows": m["rows"] + counts["upserted"], "folders": folders, "schema": self._widened(m, new),
             "result": {**counts, "errors": wrong} if batch_id >= 0 else m["result"]}
        )
        self._put(fs, path, f"manifest-{m['n'] + 1:012d}", text)
        self._prune(fs, path, [text, json.dumps(m)], m["n"])
        return BulkResult(**counts, errors=errors)

    def _prune(self, fs, path, manifests: list[str], oldest: int) -> None:
        """Delete what only manifests before ``oldest`` name."""
        for n in self._names(fs, path):
            kind, _, rest = n.partition("-")
            if kind == "manifest" and int(rest) < oldest or (kind == "errors" or kind == "data" and int(rest[:12]) <= oldest) and not any(n in text for text in manifests):
                fs.delete(path(f"{self.path}/{n}"), True)

    def _widened(self, m: dict, new: DataFrame) -> dict:
        known = {f["name"]: f for f in (m["schema"] or {"fields": []})["fields"]}
        known |= {f["name"]: f for f in json.loads(new.schema.json())["fields"]}
        return {"type": "struct", "fields": [f | {"nullable": True} for f in known.values()]}

    def _put(self, fs, path, name: str, text: str) -> None:
        part = path(f"{self.path}/.{name}.{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(part, path(f"{self.path}/{name}")):
            raise SinkUnavailable(f"another writer has made {name}")

    def _conflicts(self, docs: DataFrame) -> DataFrame:
        """Claims of values that are taken; of the table only the field and the key are read."""
        whole = self.read()
        out = None
        for field_ in self.unique:
            claims = unique_conflicts(docs.filter(F.col(field_).isNotNull()), [field_], "_id", "_id").filter("conflict").select("_id")
            if whole is not None and field_ in whole.columns:
                claims = claims.union(conflicts_with_table(docs, whole.select("_id", field_), field_).select("_id"))
            out = claims if out is None else out.union(claims)
        return out.distinct().select(F.col("_id").alias("key"), F.lit(DUPLICATE_CODE).alias("code"), F.lit("duplicate key").alias("error"))


@dataclass
class ClientSink(Sink):
    """A document store, written to by the workers through its own client.

    ``connect()`` runs on a worker and returns a client with ``bulk(docs) ->
    (counters, [(place in docs, code, error)])``, ``ping()`` and ``close()``;
    pools and timeouts are its own.  Each of ``bands`` partitions of the keys has
    one connection, over which it sends bulk calls of at most ``max_batch``
    documents, unordered among themselves.  A call that raises is tried
    ``max_attempts`` times; then its rows fail with UNAVAILABLE_CODE, so they stay
    pending while the rest is done.  An error's place in its call gives its key.
    """

    connect: Callable[[], Any]
    settings: Settings = field(default_factory=Settings)
    wait_s: float = 0.1

    def configure(self, settings: Settings) -> None:
        self.settings = settings

    def bulk_write(self, docs: DataFrame, batch_id: int) -> BulkResult:
        return self._send(docs, self.settings.max_batch)

    def write(self, docs: DataFrame, call_rows: int | None = None) -> BulkResult:
        return self._send(docs, call_rows or self.settings.max_batch)

    def _send(self, docs: DataFrame, size: int) -> BulkResult:
        connect, attempts, wait = self.connect, self.settings.max_attempts, self.wait_s

        def call(client: Any, rows: list[dict]) -> tuple[dict, list[tuple]]:
            for k in range(attempts):
                try:
                    return client.bulk(rows)
                except Exception as e:  # noqa: BLE001  whatever a client raises is tried again
                    error = str(e)
                    time.sleep(wait * 2**k if k + 1 < attempts else 0)
            return {}, [(i, UNAVAILABLE_CODE, error) for i in range(len(rows))]

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client, rows = None, []
            try:
                for pdf in itertools.chain(batches, [None]):
                    if pdf is not None:
                        rows += pdf.astype(object).where(pdf.notna(), None).to_dict("records")
                    while len(rows) >= size or pdf is None and rows:
                        client = client or connect()
                        now, rows = rows[:size], rows[size:]
                        done, wrong = call(client, now)
                        keys = [now[i]["_id"] if 0 <= i < len(now) else "" for i, _, _ in wrong]
                        made = [(None, None, None, *(done.get(c, 0) for c in _COUNTERS), len(now))] + [(key, code, error, 0, 0, 0, 0, 0) for key, (_, code, error) in zip(keys, wrong, strict=True)]
                        yield pd.DataFrame(made, columns=["key", "code", "error", *_COUNTERS, "sent"])
            finally:
                if client is not None:
                    client.close()

        schema = _ERRORS + "".join(f", {c} long" for c in (*_COUNTERS, "sent"))
        # the calls are made once: their results are held, and a lost part is an upsert made again
        done = docs.repartition(self.settings.bands, "_id").mapInPandas(send, schema).persist()
        total = done.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*_COUNTERS, "sent"))).collect()[0].asDict()
        errors = done.filter("code IS NOT NULL").select("key", "code", "error")
        wrong = errors.agg(F.count(F.lit(1)), F.sum(F.when(F.col("code") == UNAVAILABLE_CODE, 1))).collect()[0]
        sent = total.pop("sent")
        if sent and wrong[1] == sent:
            done.unpersist()
            raise SinkUnavailable("no bulk call got through")
        return BulkResult(**total, errors=errors if wrong[0] else None)

    def ping(self) -> None:
        try:
            client = self.connect()
            client.ping()
            client.close()
        except Exception as e:  # noqa: BLE001
            raise SinkUnavailable(str(e)) from e


@dataclass
class MemorySink(Sink):
    """Documents in the driver's memory, for tests and small tables; ``fail`` scripts errors by key."""

    docs: dict[str, dict] = field(default_factory=dict)
    fail: dict[str, int] = field(default_factory=dict)
    down: bool = False
    closed: bool = False
    batches: list[int] = field(default_factory=list)

    def bulk_write(self, docs: DataFrame, batch_id: int) -> BulkResult:
        self.ping()
        spark, out, bad = docs.sparkSession, BulkResult(), []
        for r in docs.toLocalIterator():
            d = r.asDict()
            key = d.pop("_id")
            if key in self.fail:
                bad.append((key, self.fail[key], "scripted"))
                continue
            old = self.docs.get(key)
            out.matched += old is not None
            out.upserted += old is None
            out.modified += old is not None and any(old.get(k) != v for k, v in d.items())
            self.docs[key] = {**(old or {}), **d}
        self.batches.append(batch_id)
        out.errors = spark.createDataFrame(bad, "key string, code int, error string") if bad else None
        return out

    def ping(self) -> None:
        if self.down:
            raise SinkUnavailable("the sink is down")

    def close(self) -> None:
        self.closed = True
