"""The engine as a streaming query: coalesce, shape, upsert, dead-letter, for each micro-batch.

Spark's source offsets and checkpoint are the journal: a batch that fails is
replayed whole under the same id.  Rows that the sink couldn't take for the time
being are carried in a state table to the next batch.
"""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepool.functions import dlq_key
from tidepool.metrics import Metrics
from tidepool.model import CONTRACT_VIOLATION, DUPLICATE_CODE, DUPLICATE_KEY, EVENT, Closed, EmptyKey, EmptyNamespace, MissingContract, MissingSink, MissingSource, Settings, SinkUnavailable, UnknownStrategy
from tidepool.operators import dead_letters
from tidepool.operators.journal import coalesce_latest, depth, ingest, ready_bands, refused, unexpired, with_band
from tidepool.sinks import BulkResult, Sink

OnFlush = Callable[[DataFrame, BulkResult | None, Exception | None], None]


class StateTable:
    """A small table in the state folder, replaced as a whole; the newest complete version counts.

    The version before it is kept for whoever still reads it, older ones are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, metrics: Metrics | None = None):
        self.spark, self.path, self.metrics = spark, path, metrics or Metrics()

    def _versions(self) -> list[str]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p))
        return [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def newest(self) -> str | None:
        have = self._versions()
        return have[-1] if have else None

    def read(self) -> DataFrame | None:
        began, have = time.monotonic(), self._versions()
        out = self.spark.read.parquet(f"{self.path}/{have[-1]}") if have else None
        self.metrics.journal("read", time.monotonic() - began)
        return out

    def replace(self, rows: DataFrame) -> str:
        began, have = time.monotonic(), self._versions()
        n = int(have[-1][1:13]) + 1 if have else 1
        made = f"v{n:012d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{made}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(path(self.path)):
            name = s.getPath().getName()
            if name.startswith("v") and int(name[1:13]) < n - 1:
                fs.delete(s.getPath(), True)
        self.metrics.journal("replace", time.monotonic() - began)
        return made


class Engine:
    """Built by ``Engine.named(...)`` and the with_ methods; ``start`` gives the streaming query."""

    def __init__(self, namespace: str):
        self.namespace = namespace
        self.sink: Sink | None = None
        self.contract: Any = None
        self.source: DataFrame | None = None
        self.state: str | None = None
        self.settings = Settings()
        self.metrics: Metrics = Metrics()
        self.on_flush: OnFlush | None = None
        self.auto: tuple[float | None, str] | None = None
        self.mutator: Callable[[Column], Column] = lambda key: dlq_key(key, F.current_timestamp())
        self.log = logging.getLogger(f"tidepool.{namespace}")
        self.closed = False
        self.query: StreamingQuery | None = None
        self._timer: threading.Event | None = None
        self._thread: threading.Thread | None = None
        self._lock = threading.RLock()
        self._flushed = time.monotonic()
        self._empty: str | None = None  # the version of ``pending`` known to hold nothing

    @classmethod
    def named(cls, namespace: str) -> Engine:
        return cls(namespace)

    def with_sink(self, sink: Sink) -> Engine:
        self.sink = sink
        return self

    def with_contract(self, contract: Any) -> Engine:
        self.contract = contract
        return self

    def with_source(self, events: DataFrame, state: str) -> Engine:
        """events: key, payload, ts, seq (streaming or not); state: the folder of checkpoint and state tables."""
        self.source, self.state = events, f"{state}/{self.namespace}"
        return self

    def with_settings(self, **values: Any) -> Engine:
        self.settings = Settings(**{**self.settings.__dict__, **values})
        return self

    def with_batched_writes(self, size: int = 0, window_ms: int = 0) -> Engine:
        """Journal every window_ms; flush a band at ``size`` pending keys, and all when the flush window is over."""
        return self.with_settings(batched_writes=True, write_batch=size, write_window_ms=window_ms)

    def with_logger(self, log: logging.Logger) -> Engine:
        self.log = log
        return self

    def with_metrics(self, metrics: Metrics) -> Engine:
        self.metrics = metrics
        return self

    def with_callback(self, on_flush: OnFlush) -> Engine:
        self.on_flush = on_flush
        return self

    def with_key_mutator(self, mutator: Callable[[Column], Column]) -> Engine:
        self.mutator = mutator
        return self

    def with_auto_dlq(self, strategy: int | str, every_s: float | None = None) -> Engine:
        name = dead_letters.strategy_name(strategy)
        if name == "unknown":
            raise UnknownStrategy(strategy)
        self.auto = (every_s if every_s and every_s > 0 else None, name)
        return self

    def build(self) -> Engine:
        for missing, error in ((not self.namespace, EmptyNamespace), (self.sink is None, MissingSink), (self.contract is None, MissingContract), (self.source is None, MissingSource)):
            if missing:
                raise error()
        self.sink.ping()
        spark = self.source.sparkSession
        self.sink.configure(self.settings)
        self.pending = StateTable(spark, f"{self.state}/pending", self.metrics)
        self.letters = StateTable(spark, f"{self.state}/letters", self.metrics)
        self.plans = StateTable(spark, f"{self.state}/plans", self.metrics)
        return self

    # -- flushing ------------------------------------------------------------

    def flush(self, batch: DataFrame, batch_id: int) -> None:
        """What foreachBatch calls: one batch of events, at most once each."""
        began, s = time.monotonic(), self.settings
        with self._lock:
            events = batch.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT.fields))
            newest = self.pending.newest()
            held = self.pending.read() if newest is not None and newest != self._empty else None
            if held is not None:
                events = held.select(*EVENT.names).unionByName(events)
            latest = coalesce_latest(ingest(events))
            payload = F.col("payload").isNotNull() & (F.octet_length("payload") > 0)
            latest = unexpired(latest, s.key_ttl_ms, F.current_timestamp()) if s.expire else latest.filter(payload)
            due, rest = self._due(latest, batch_id)
            shaped = self.contract.apply(due).persist()
            try:
                if self._heard("write"):  # the source is read once more for it
                    self.metrics.write(*batch.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("key").isNull() | (F.col("key") == ""), 1)), F.lit(0))).collect()[0])
                self._flush(shaped, rest, batch_id, began)
            finally:
                shaped.unpersist()

    def _heard(self, measure: str) -> bool:
        """Whether the recorder does anything with a measure that costs a job."""
        return getattr(type(self.metrics), measure) is not getattr(Metrics, measure)

    def _due(self, latest: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame | None]:
        """What is flushed now and what stays pending: bands are due by depth, and all of them by time.

        The choice is written down before it is acted upon, so a batch that is
        replayed flushes the same bands.
        """
        s = self.settings
        banded = with_band(latest, s.bands)
        if self._heard("depth"):
            self.metrics.depth({r.band: r.depth for r in depth(banded).collect()})  # a row per band
        if s.volume is None or batch_id < 0:
            return latest, None
        held = self.plans.read()
        plan = held.filter(F.col("batch") == batch_id).collect() if held is not None else []  # one row
        if plan:
            bands = plan[0].bands
        else:
            over = time.monotonic() - self._flushed >= s.flush_window_ms / 1000
            bands = None if over else [r.band for r in ready_bands(banded, s.volume).collect()]  # at most s.bands
            self.plans.replace(latest.sparkSession.createDataFrame([(batch_id, bands)], "batch long, bands array<int>"))
        if bands is None:
            self._flushed = time.monotonic()
            return latest, None
        ready = F.col("band").isin(bands) if bands else F.lit(False)
        return banded.filter(ready).drop("band"), banded.filter(~ready).select(*EVENT.names)

    def documents(self, shaped: DataFrame) -> DataFrame:
        fields = self.contract.fields if hasattr(self.contract, "fields") else self.contract.schema.names
        return shaped.select(F.col("key").alias("_id"), *fields)

    def _flush(self, shaped: DataFrame, rest: DataFrame | None, batch_id: int, began: float) -> None:
        good, bad = shaped.filter("ok"), shaped.filter(~F.col("ok"))
        dead = bad.select(*EVENT.names, F.lit(CONTRACT_VIOLATION).alias("reason"))
        n = {r.ok: r["count"] for r in shaped.groupBy("ok").count().collect()}  # two rows
        n_bad, rows, n_doubled = n.get(False, 0), n.get(True, 0), 0
        if n_bad:
            self.metrics.contract_error(n_bad)
            self.metrics.dead_letter(n_bad, CONTRACT_VIOLATION)
            self._tell(bad.select("key"), None, ValueError(CONTRACT_VIOLATION))
        result, error, later = BulkResult(), None, good.select(*EVENT.names).limit(0)
        try:
            if rows:
                result = self.sink.bulk_write(self.documents(good), batch_id)
        except SinkUnavailable as e:
            error, later = e, good.select(*EVENT.names)  # all of it stays pending
        if result.errors is not None:
            wrong = result.errors.select("key", "code").distinct()
            doubled = good.join(wrong.filter(F.col("code") == DUPLICATE_CODE), "key", "left_semi")
            n_doubled = doubled.count()
            self.metrics.dead_letter(n_doubled, DUPLICATE_KEY)
            dead = dead.unionByName(doubled.select(*EVENT.names, F.lit(DUPLICATE_KEY).alias("reason")))
            later = good.join(wrong.filter(F.col("code") != DUPLICATE_CODE), "key", "left_semi").select(*EVENT.names)
        self._bury(dead, n_bad + n_doubled)
        if rest is not None:
            later = later.unionByName(rest)
        nothing = error is None and result.errors is None and rest is None
        if not nothing or self._empty is None or self.pending.newest() != self._empty:
            made = self.pending.replace(later)
            self._empty = made if nothing else None
        if self._heard("pending"):
            self.metrics.pending(0 if nothing else self.pending.read().count())
        self.metrics.flush(rows, time.monotonic() - began, error is None)
        if rows:
            self._tell(good.select("key"), result, error)

    def _bury(self, dead: DataFrame, n: int) -> None:
        """Add dead letters; a key that dies again keeps its latest letter, and old ones go."""
        if not n:
            return
        fresh = dead.withColumn("failed_at", F.current_timestamp())
        old = self._letters()
        every = fresh if old is None else old.unionByName(fresh)
        self.letters.replace(coalesce_latest(every))

    def _letters(self) -> DataFrame | None:
        """The dead letters whose time isn't over."""
        held = self.letters.read()
        return None if held is None else unexpired(held, self.settings.dead_letter_ttl_ms, F.current_timestamp(), ts="failed_at", payload=None)

    def _tell(self, keys: DataFrame, result: BulkResult | None, error: Exception | None) -> None:
        if self.on_flush is not None:
            self.on_flush(keys, result, error)

    # -- running -------------------------------------------------------------

    def start(self, available_now: bool = False) -> StreamingQuery:
        if self.closed:
            raise Closed()
        writer = self.source.writeStream.foreachBatch(self.flush).option("checkpointLocation", f"{self.state}/checkpoint")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{self.settings.trigger_ms} milliseconds")
        self.query = writer.start()
        if self.auto is not None:
            self._timer = threading.Event()
            self._thread = threading.Thread(target=self._tick, daemon=True)
            self._thread.start()
        return self.query

    def _tick(self) -> None:
        every, strategy = self.auto
        while not self._timer.wait(every or self.settings.dlq_interval_s):
            try:
                self.process_dlq(strategy)
            except Exception:  # noqa: BLE001  the next tick tries again
                self.log.exception("dead letters could not be processed")

    def write_direct(self, events: DataFrame) -> list[BulkResult]:
        """The degraded path: no coalescing, each event an upsert in arrival order; a refusal is the caller's.

        Events are applied in rounds, the n-th of every key in the n-th round.
        """
        from tidepool.operators.upsert import direct

        if self.closed:
            raise Closed()
        if not self.settings.degraded_direct:
            raise SinkUnavailable("the degraded path is turned off")
        if not refused(events).isEmpty():
            raise EmptyKey()
        numbered = direct(events).persist()
        shaped = self.contract.apply(numbered)
        if not shaped.filter(~F.col("ok")).isEmpty():
            self.metrics.degraded_write(False)
            raise ValueError(CONTRACT_VIOLATION)
        rounds = numbered.agg(F.max("write_no")).collect()[0][0] or 0
        out = [self.sink.write(self.documents(shaped.filter(F.col("write_no") == n))) for n in range(1, rounds + 1)]
        numbered.unpersist()
        self.metrics.degraded_write(True)
        return out

    def process_dlq(self, strategy: int | str, contract: Any = None, mutator: Callable[[Column], Column] | None = None, batch: int | None = None, log: logging.Logger | None = None) -> dict[str, int]:
        """Every dead letter once; returns processed, succeeded and failed.  batch: rows of a bulk call, dlq_batch by default."""
        if self.closed:
            raise Closed()
        name = dead_letters.strategy_name(strategy)
        if name == "unknown":
            raise UnknownStrategy(strategy)
        strategy = name
        with self._lock:
            letters = self._letters()
            if letters is None or letters.isEmpty():
                return {"processed": 0, "succeeded": 0, "failed": 0}
            contract = contract or self.contract
            done = dead_letters.process(letters, strategy, heal=lambda rows: contract.apply(rows.drop("reason")), mutate=mutator or self.mutator)
            counts, left = done.counts.collect()[0].asDict(), done.left.select(*letters.columns)
            if done.written is not None:
                fields = contract.fields if hasattr(contract, "fields") else contract.schema.names
                result = self.sink.write(done.written.select(F.col("key").alias("_id"), *fields), batch or self.settings.dlq_batch)
                if result.errors is not None:
                    failed = letters.join(result.errors.select("key").distinct(), "key", "left_semi").select(*letters.columns)
                    n = failed.count()
                    counts["succeeded"] -= n
                    counts["failed"] += n
                    left = left.unionByName(failed).dropDuplicates(["key"])
            if done.again is not None:
                held = self.pending.read()
                again = done.again.select(*EVENT.names)
                self.pending.replace(coalesce_latest(again if held is None else held.select(*EVENT.names).unionByName(again)))
            self.letters.replace(left)
            self.metrics.dlq(strategy, **counts)
            (log or self.log).info("dead letters: %s %s", strategy, counts)
            return counts

    def drain(self) -> None:
        """Flush what is pending, until the sink takes it or takes no more of it."""
        before = None
        spark = self.source.sparkSession
        while True:
            held = self.pending.read()
            n = 0 if held is None else held.count()
            if not n or n == before:
                return
            before = n
            self.flush(spark.createDataFrame([], EVENT), -1)

    def drain_and_close(self) -> None:
        """Stop the timer, process what has arrived, flush what is pending, close the sink; once."""
        if self.closed:
            return
        if self._timer is not None:
            self._timer.set()
            self._thread.join()
        if self.query is not None and self.query.isActive:
            self.query.processAllAvailable()
            self.query.stop()
        self.drain()
        self.closed = True
        self.sink.close()
