"""Replays, triggers, bulk calls, expiry and sources of the engine: every setting has an effect here."""

import json
import logging
import os
import time
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidepool.functions import dlq_key, retry_key
from tidepool.metrics import CountingMetrics
from tidepool.model import EVENT, Settings, SinkUnavailable, UnknownStrategy
from tidepool.operators.dead_letters import strategy_name
from tidepool.operators.upsert import merge_map
from tidepool.sinks import ClientSink, MemorySink, SnapshotSink
from tidepool.sources import broker_stream, file_stream, synthetic_stream
from tidepool.sources.queue import FolderQueue, QueueSource
from tidepool.streaming import Engine, StateTable

from test_streaming import Feed, engine, run, strict


@pytest.fixture
def feed(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    return Feed(spark, tmp_path / "in")


def fails_once(owner, name, when):
    """Let a method fail once, before or after it has done its work."""
    real, left = getattr(owner, name), [1]

    def call(*args, **kwargs):
        if when == "before" and left:
            left.pop()
            raise RuntimeError("scripted")
        out = real(*args, **kwargs)
        if when == "after" and left:
            left.pop()
            raise RuntimeError("scripted")
        return out

    setattr(owner, name, call)


STEPS = ["bulk_write", "_bury", "replace", "_tell"]


@pytest.mark.parametrize("when", ["before", "after"])
@pytest.mark.parametrize("step", STEPS)
def test_a_batch_that_fails_anywhere_loses_no_row(spark, feed, tmp_path, step, when):
    feed.put(("a", {"channel": "x", "n": 1}), ("b", {"channel": "x", "n": 2}), ("c", {"channel": "x", "n": 2}), ("d", {"channel": "REJECT", "n": 3}))
    sink = SnapshotSink(spark, str(tmp_path / "docs"), buckets=2, unique=["n"])
    e = engine(spark, feed, tmp_path, sink).with_callback(lambda *_: None)
    fails_once({"bulk_write": sink, "replace": e.pending}.get(step, e), step, when)
    with pytest.raises(StreamingQueryException):
        run(e)
    run(e)
    assert sorted(tuple(r) for r in sink.read().select("_id", "n").collect()) == [("a", 1), ("b", 2)]
    assert sorted((r.key, r.reason) for r in e.letters.read().collect()) == [("c", "duplicate_key"), ("d", "contract_violation")]
    assert not e.pending.read().count()


def test_a_replayed_batch_gets_its_result_again(spark, tmp_path):
    sink = SnapshotSink(spark, str(tmp_path / "docs"), unique=["u"])
    docs = spark.createDataFrame([("a", 1), ("b", 1)], "_id string, u int")
    first, again = sink.bulk_write(docs, 3), sink.bulk_write(docs, 3)
    assert (again.upserted, [tuple(r) for r in again.errors.collect()]) == (1, [tuple(r) for r in first.errors.collect()]) and first.upserted == 1
    assert sink.bulk_write(docs, 2).upserted == 0


def test_old_folders_go(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"))
    sink = SnapshotSink(spark, str(tmp_path / "docs"), buckets=2, unique=["u"])
    for i in range(5):
        table.replace(spark.range(i))
        sink.bulk_write(spark.createDataFrame([("a", i), ("b", 10 + i)], "_id string, u int"), i)
    assert len(os.listdir(tmp_path / "state")) == 2 and table.read().count() == 4
    names = [n for n in os.listdir(tmp_path / "docs") if not n.startswith(".")]
    assert sorted(n.split("-")[0] for n in names) == ["data", "data", "manifest", "manifest"]
    assert sorted(r.u for r in sink.read().collect()) == [4, 14]


def test_buckets_grow_with_the_table(spark, tmp_path):
    sink = SnapshotSink(spark, str(tmp_path / "docs"), buckets=1, bucket_rows=10)
    docs = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("_id"), F.col("id").alias("v"))
    for i in range(4):
        sink.bulk_write(docs(i * 30, i * 30 + 40), i)
    m = sink._manifest()
    assert m["buckets"] == 8 and m["rows"] == 130 and len(m["folders"]) == 8
    assert sorted(r.v for r in sink.read().collect()) == list(range(130))


# -- triggers ------------------------------------------------------------------


def test_a_band_is_flushed_by_its_depth_and_all_by_time(spark, feed, tmp_path):
    sink, m = MemorySink(), CountingMetrics()
    e = engine(spark, feed, tmp_path, sink).with_metrics(m).with_settings(bands=1, flush_window_ms=3_600_000).with_batched_writes(20, 5).build()
    assert e.settings.trigger_ms == 5
    feed.put(*[(f"bw_{i:04d}", {"channel": "x", "n": i}) for i in range(15)])
    run(e)
    assert not sink.docs and e.pending.read().count() == 15 and m.total["deepest_band"] == 15  # neither deep enough nor late
    feed.put(*[(f"bw_{i:04d}", {"channel": "y", "n": i}) for i in range(10, 25)])
    run(e)
    assert len(sink.docs) == 25 and sink.docs["bw_0012"]["channel"] == "y" and not e.pending.read().count()
    feed.put(("late", {"channel": "x", "n": 1}))
    run(e)
    assert "late" not in sink.docs
    e._flushed -= 3600  # the window is over
    feed.put(("later", {"channel": "x", "n": 1}))
    run(e)
    assert {"late", "later"} <= set(sink.docs)
    feed.put(("last", {"channel": "x", "n": 1}))
    run(e)
    e.drain_and_close()
    assert "last" in sink.docs and m.total["journal_replace"] > 5


def test_a_replay_flushes_the_bands_it_had_chosen(spark, feed, tmp_path):
    sink = SnapshotSink(spark, str(tmp_path / "docs"))
    e = engine(spark, feed, tmp_path, sink).with_settings(bands=4, flush_window_ms=3_600_000, poll_ms=10, max_batch=4).build()
    feed.put(*[(f"k{i}", {"channel": "x", "n": i}) for i in range(14)])
    fails_once(e, "_bury", "before")
    with pytest.raises(StreamingQueryException):
        run(e)
    e._flushed -= 3600  # by now all would be due, but the batch was written with fewer bands
    run(e)
    held, docs = {r.key for r in e.pending.read().collect()}, {r._id for r in sink.read().collect()}
    assert held | docs == {f"k{i}" for i in range(14)} and not held & docs
    e.drain()
    assert sink.read().count() == 14


def test_settings_fall_back_to_their_defaults():
    s = Settings(bands=0, max_batch=-1, write_batch=0, expire=False)
    assert (s.bands, s.max_batch, s.write_batch, s.volume, s.trigger_ms) == (16, 1000, 200, None, 250)
    assert Settings(poll_ms=7).volume == 1000 and Settings(batched_writes=True).volume == 200 and Settings(batched_writes=True).trigger_ms == 5


# -- bulk calls ----------------------------------------------------------------


class FileStore:
    """A store in a folder: each bulk call is a file; keys that begin with dup or busy fail."""

    def __init__(self, folder, down=False):
        self.folder, self.down = folder, down

    def ping(self):
        if self.down:
            raise OSError("no connection")

    def close(self):
        pass

    def bulk(self, docs):
        tries = Path(self.folder, f"tries-{docs[0]['_id']}")
        tries.write_text(tries.read_text() + "x" if tries.exists() else "x")
        if self.down or any(d["_id"].startswith("flaky") for d in docs) and len(tries.read_text()) < 3:
            raise OSError("no connection")
        Path(self.folder, f"call-{time.time_ns()}").write_text(json.dumps([d["_id"] for d in docs]))
        wrong = [(i, 11000 if d["_id"].startswith("dup") else 50, "no") for i, d in enumerate(docs) if d["_id"].startswith(("dup", "busy"))]
        return {"upserted": len(docs) - len(wrong)}, wrong


def store(tmp_path, down=False):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["x"]))
    folder = tmp_path / "store"
    folder.mkdir(exist_ok=True)
    where = str(folder)
    return ClientSink(lambda: FileStore(where, down), wait_s=0.0), folder


def calls(folder):
    return [json.loads(p.read_text()) for p in folder.glob("call-*")]


def test_bulk_calls_are_cut_and_errors_find_their_keys(spark, feed, tmp_path):
    sink, folder = store(tmp_path)
    e = engine(spark, feed, tmp_path, sink).with_settings(bands=1, max_batch=20).build()
    feed.put(*[(f"vol_{i}", {"channel": "x", "n": i}) for i in range(19)], ("dup_1", {"channel": "x", "n": 1}), ("busy_1", {"channel": "x", "n": 1}))
    heard = []
    e.with_callback(lambda keys, result, error: heard.append(result.upserted))
    run(e)
    assert sorted(map(len, calls(folder))) == [1, 20] and heard == [19]
    assert [r.key for r in e.letters.read().collect()] == ["dup_1"] and [r.key for r in e.pending.read().collect()] == ["busy_1"]
    assert e.process_dlq("upsert", batch=7)["failed"] == 1


def test_dead_letters_go_in_calls_of_their_own_size(spark, feed, tmp_path):
    sink, folder = store(tmp_path)
    e = engine(spark, feed, tmp_path, sink).with_settings(bands=1, dlq_batch=4).build()
    feed.put(*[(f"bad_{i}", {"channel": "REJECT", "n": i}) for i in range(10)])
    run(e)
    from test_streaming import healed

    assert e.process_dlq(1, contract=healed()) == {"processed": 10, "succeeded": 10, "failed": 0}
    assert sorted(map(len, calls(folder))) == [2, 4, 4]


def test_calls_are_tried_again(spark, tmp_path):
    docs = spark.createDataFrame([("flaky",)], "_id string")
    sink, folder = store(tmp_path)
    sink.configure(Settings(bands=1, max_attempts=2))
    with pytest.raises(SinkUnavailable):
        sink.bulk_write(docs, 0)
    sink.configure(Settings(bands=1, max_attempts=3))
    assert sink.bulk_write(docs, 0).upserted == 1 and calls(folder) == [["flaky"]]
    with pytest.raises(SinkUnavailable):
        store(tmp_path, down=True)[0].ping()


# -- dead letters --------------------------------------------------------------


def test_dead_letters_expire(spark, feed, tmp_path):
    e = engine(spark, feed, tmp_path, MemorySink()).with_settings(dead_letter_ttl_ms=1)
    feed.put(("bad", {"channel": "REJECT", "n": 1}))
    run(e)
    time.sleep(0.05)
    assert e.process_dlq("ignore") == {"processed": 0, "succeeded": 0, "failed": 0}
    assert Settings().dead_letter_ttl_ms == 7 * 24 * 3600 * 1000


def test_events_expire_only_if_asked_to(spark, feed, tmp_path):
    sink = MemorySink()
    e = engine(spark, feed, tmp_path, sink).with_settings(expire=True, key_ttl_ms=1000).build()
    old = spark.sql("SELECT 'k' AS key, '{\"channel\":\"x\",\"n\":1}' AS payload, current_timestamp() - INTERVAL 5 SECONDS AS ts, 1L AS seq")
    old.write.mode("append").parquet(feed.folder)
    run(e)
    assert not sink.docs and not e.pending.read().count()


def test_auto_dlq_goes_on_after_an_error(spark, feed, tmp_path, caplog):
    log = logging.getLogger("own")
    e = engine(spark, feed, tmp_path, MemorySink()).with_auto_dlq(0, 0.2).with_logger(log)
    fails_once(e, "process_dlq", "before")
    feed.put(("bad", {"channel": "REJECT", "n": 1}))
    with caplog.at_level(logging.INFO, "own"):
        run(e)
        until = time.time() + 60
        while time.time() < until and e.letters.read().count():
            time.sleep(0.2)
        e.drain_and_close()
    assert not e.letters.read().count() and any("could not" in r.message for r in caplog.records) and any("ignore" in r.getMessage() for r in caplog.records)


@pytest.mark.parametrize("strategy", ["ignore", "upsert", "reinsert"])
def test_auto_dlq_takes_every_strategy(strategy):
    assert Engine.named("n").with_auto_dlq(strategy).auto == (None, strategy) and Engine.named("n").with_auto_dlq(strategy, -1).auto[0] is None


def test_strategies_by_number():
    assert [strategy_name(i) for i in (0, 1, 2, 3, "upsert", "x")] == ["ignore", "upsert", "reinsert", "unknown", "upsert", "unknown"]
    with pytest.raises(UnknownStrategy):
        Engine.named("n").with_auto_dlq(7)


# -- sources -------------------------------------------------------------------


def test_queue_messages_arrive_and_are_deleted(spark, tmp_path):
    queue = FolderQueue({"folder": str(tmp_path / "queue")})
    for i in range(25):
        queue.send(f"crn_{i % 20:07d}", json.dumps({"channel": "x", "n": i}))
    spark.dataSource.register(QueueSource)
    events = spark.readStream.format("queue").option("client", "tidepool.sources.queue:FolderQueue").option("folder", str(tmp_path / "queue")).option("perTrigger", "12").load()
    sink = MemorySink()
    e = Engine.named("q").with_sink(sink).with_contract(strict()).with_source(events, str(tmp_path / "state")).build()
    query = e.start()
    until = time.time() + 90
    while time.time() < until and (len(sink.docs) < 20 or os.listdir(tmp_path / "queue")) and query.isActive:
        if len(sink.docs) == 20 and len(os.listdir(tmp_path / "queue")) and not getattr(queue, "more", None):
            queue.more = queue.send("another", json.dumps({"channel": "x", "n": 1})) or True  # offsets are committed with the next batch
        time.sleep(0.3)
    e.drain_and_close()
    assert {f"crn_{i:07d}" for i in range(20)} <= set(sink.docs) and sink.docs["crn_0000004"]["n"] == 24
    assert len(os.listdir(tmp_path / "queue")) <= 2


def test_a_queue_delivers_again_what_was_not_committed(tmp_path):
    from tidepool.sources.queue import QueueReader

    options = {"client": "tidepool.sources.queue:FolderQueue", "folder": str(tmp_path / "queue")}
    queue = FolderQueue(options)
    for i in range(13):
        queue.send(f"k{i}", "{}")
    reader = QueueReader(options)
    rows, end = reader.read(reader.initialOffset())
    assert end == {"seq": 13} and [r[0] for r in rows] == [f"k{i}" for i in range(13)]
    assert len(list(reader.readBetweenOffsets({"seq": 5}, end))) == 8
    again = QueueReader(options)  # a restart before the commit
    assert [r[3] for r in again.readBetweenOffsets({"seq": 0}, end)] == list(range(13))
    again.commit(end)
    assert not os.listdir(tmp_path / "queue") and list(QueueReader(options).read(end)[0]) == []


def test_broker_streams_ask_for_the_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        broker_stream(spark, "localhost:9092", "topic", per_trigger=10)


def test_file_stream_takes_files_by_the_trigger(spark, feed, tmp_path):
    feed.put(*[(f"crn_kafka_{i:07d}", {"channel": "x", "n": i}) for i in range(5000)])
    sink = SnapshotSink(spark, str(tmp_path / "docs"))
    e = Engine.named("f").with_sink(sink).with_contract(strict()).with_source(file_stream(spark, feed.folder, EVENT, max_files=2), str(tmp_path / "state")).build()
    run(e)
    assert sink.read().count() == 5000


def test_generated_stream(spark, tmp_path):
    made = synthetic_stream(spark, 50, 7)
    query = made.writeStream.format("memory").queryName("made").start()
    until = time.time() + 60
    while time.time() < until and spark.table("made").count() < 20:
        time.sleep(0.5)
    query.stop()
    r = spark.table("made").orderBy("seq").first()
    assert r.key == "crn_000000000" and json.loads(r.payload) == {"channel": "push", "priority": 1, "campaign_id": "camp_0000"}


# -- functions -----------------------------------------------------------------


def test_keys_for_another_try(spark):
    r = spark.sql("SELECT 'k' AS key, timestamp'2024-01-02 03:04:05' AS at").select(dlq_key(F.col("key"), F.col("at")).alias("a"), retry_key(F.col("key"), F.col("at")).alias("b")).first()
    assert r.a == "k_dlq_1704164645000000000" and r.b == "k:retry:20240102T030405"


def test_free_form_documents_merge_by_field(spark):
    r = spark.sql("SELECT map('a', '1', 'b', '2') AS old, map('b', cast(null AS string), 'c', '3') AS new").select(merge_map(F.col("old"), F.col("new")).alias("m")).first()
    assert r.m == {"a": "1", "b": None, "c": "3"}
