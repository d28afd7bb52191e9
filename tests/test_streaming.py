import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import prefixed_key
from tidepool.metrics import CountingMetrics
from tidepool.model import EVENT, Closed, EmptyKey, EmptyNamespace, MissingContract, MissingSink, MissingSource
from tidepool.operators.contract import ColumnContract
from tidepool.sinks import MemorySink, SnapshotSink
from tidepool.sources import file_stream
from tidepool.streaming import Engine

DOC = T.StructType([T.StructField("channel", T.StringType()), T.StructField("n", T.IntegerType())])

def strict():
    return ColumnContract(fields={"channel": F.col("doc.channel"), "n": F.col("doc.n")}, accept=F.col("doc.channel") != "REJECT", schema=DOC)


def healed():
    return ColumnContract(fields={"channel": F.when(F.col("doc.channel") == "REJECT", "email").otherwise(F.col("doc.channel")), "n": F.col("doc.n")}, schema=DOC)


class Feed:
    """Events as files that a stream picks up."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.seq = spark, str(folder), 0

    def put(self, *events):
        made = []
        for key, payload in events:
            self.seq += 1
            made.append((key, payload if payload is None or isinstance(payload, str) else json.dumps(payload), None, self.seq))
        self.spark.createDataFrame(made, EVENT).write.mode("append").parquet(self.folder)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path / "in")


def engine(spark, feed, tmp_path, sink, contract=None):
    return Engine.named("t").with_sink(sink).with_contract(contract or strict()).with_source(file_stream(spark, feed.folder, EVENT), str(tmp_path / "state")).build()


def run(e):
    e.start(available_now=True).awaitTermination()


def test_what_is_missing_is_named_in_order(spark):
    with pytest.raises(EmptyNamespace):
        Engine.named("").build()
    with pytest.raises(MissingSink):
        Engine.named("n").build()
    with pytest.raises(MissingContract):
        Engine.named("n").with_sink(MemorySink()).build()
    with pytest.raises(MissingSource):
        Engine.named("n").with_sink(MemorySink()).with_contract(strict()).build()


def test_reject_then_heal(spark, feed, tmp_path):
    feed.put(*[(f"crn_good_{i}", {"channel": "push", "n": i}) for i in range(6)], *[(f"bad_crn_{i}", {"channel": "REJECT", "n": i}) for i in range(4)])
    sink, heard, m = MemorySink(), [], CountingMetrics()
    e = engine(spark, feed, tmp_path, sink).with_callback(lambda keys, result, error: heard.append((keys.count(), error is None))).with_metrics(m)
    run(e)
    assert len(sink.docs) == 6 and e.letters.read().count() == 4 and not e.pending.read().count()
    assert heard == [(4, False), (6, True)] and m.total["contract_errors"] == 4
    assert e.process_dlq("upsert", contract=healed()) == {"processed": 4, "succeeded": 4, "failed": 0}
    assert len(sink.docs) == 10 and sink.docs["bad_crn_0"]["channel"] == "email" and not e.letters.read().count()
    assert e.process_dlq("ignore") == {"processed": 0, "succeeded": 0, "failed": 0}


def test_reinserted_keys_flow_through_again(spark, feed, tmp_path):
    feed.put(*[(f"bad_{i}", {"channel": "REJECT", "n": i}) for i in range(3)])
    sink = MemorySink()
    e = engine(spark, feed, tmp_path, sink)
    run(e)
    e.contract = healed()
    assert e.process_dlq("reinsert", mutator=prefixed_key) == {"processed": 3, "succeeded": 3, "failed": 0}
    e.drain()
    assert sorted(sink.docs) == [f"reinserted_bad_{i}" for i in range(3)]


def test_sink_errors_are_retried_or_buried(spark, feed, tmp_path):
    feed.put(("a", {"channel": "x", "n": 1}), ("b", {"channel": "x", "n": 2}), ("c", {"channel": "x", "n": 3}))
    sink = MemorySink(fail={"a": 91, "b": 11000})
    e = engine(spark, feed, tmp_path, sink)
    run(e)
    assert set(sink.docs) == {"c"}
    assert [r.key for r in e.pending.read().collect()] == ["a"]
    assert [(r.key, r.reason) for r in e.letters.read().collect()] == [("b", "duplicate_key")]
    sink.fail.clear()
    feed.put(("a", {"channel": "newer", "n": 9}))
    run(e)
    assert sink.docs["a"]["n"] == 9 and not e.pending.read().count()


def test_outage_keeps_everything_pending(spark, feed, tmp_path):
    feed.put(("a", {"channel": "x", "n": 1}), ("", {"channel": "x", "n": 1}), ("e", ""))
    sink = MemorySink()
    e = engine(spark, feed, tmp_path, sink)
    sink.down = True
    run(e)
    assert not sink.docs and [r.key for r in e.pending.read().collect()] == ["a"]
    sink.down = False
    e.drain_and_close()
    e.drain_and_close()
    assert set(sink.docs) == {"a"} and sink.closed
    with pytest.raises(Closed):
        e.process_dlq("ignore")
    with pytest.raises(Closed):
        e.start()


def test_direct_writes_keep_the_order_of_arrival(spark, feed, tmp_path):
    feed.put(("z", {"channel": "x", "n": 0}))
    sink = MemorySink()
    e = engine(spark, feed, tmp_path, sink)
    events = spark.createDataFrame([("k", json.dumps({"channel": "c", "n": i}), None, i) for i in range(3)], EVENT)
    assert len(e.write_direct(events)) == 3 and sink.docs["k"]["n"] == 2
    with pytest.raises(EmptyKey):
        e.write_direct(spark.createDataFrame([("", "{}", None, 1)], EVENT))


def test_auto_dlq_runs_and_stops(spark, feed, tmp_path):
    import time

    feed.put(("bad", {"channel": "REJECT", "n": 1}))
    e = engine(spark, feed, tmp_path, MemorySink()).with_auto_dlq("ignore", 0.3)
    run(e)
    until = time.time() + 60
    while time.time() < until and e.letters.read().count():
        time.sleep(0.3)
    assert not e.letters.read().count()
    e.drain_and_close()
    assert not e._thread.is_alive()


def test_snapshot_sink(spark, tmp_path):
    sink = SnapshotSink(spark, str(tmp_path / "docs"), buckets=4, unique=["u"])
    docs = lambda *r: spark.createDataFrame(list(r), "_id string, u int, v string")
    assert sink.read() is None
    r = sink.bulk_write(docs(("a", 1, "x"), ("b", 2, "x"), ("c", 2, "x")), 0)
    assert (r.upserted, r.matched) == (2, 0) and [x.key for x in r.errors.collect()] == ["c"]
    r = sink.bulk_write(docs(("a", 1, "y"), ("d", 2, "x")), 1)
    assert (r.upserted, r.matched, r.modified) == (0, 1, 1)
    sink.bulk_write(docs(("a", 1, "replayed")), 1)
    assert sorted(tuple(x) for x in sink.read().select("_id", "u", "v").collect()) == [("a", 1, "y"), ("b", 2, "x")]
