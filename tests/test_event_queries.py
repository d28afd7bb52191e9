"""Each query against its SQL, and the fixtures whose results are known."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidepool.functions import fnv32a
from tidepool.model import UnknownStrategy
from tidepool.operators import contract, dead_letters, journal, upsert
from tidepool.plans.event_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    rel = db.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    norm = lambda v: round(v, 9) if isinstance(v, float) else int(v) if type(v).__name__ == "Decimal" else v
    mine = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    theirs = sorted(repr([norm(dict(zip(rel.columns, r, strict=True))[c]) for c in cols]) for r in rel.fetchall())
    assert mine == theirs


def rows(spark, *events):
    return spark.createDataFrame([(k, p, i) for i, (k, p) in enumerate(events)], "key string, payload string, seq long")


def test_latest_is_the_last_to_arrive(spark):
    got = journal.coalesce_latest(rows(spark, *[("crn_same", f"v{i}") for i in range(50)])).collect()
    assert [(r.key, r.payload) for r in got] == [("crn_same", "v49")]


def test_keys_without_a_name_are_refused(spark):
    events = rows(spark, ("", "a"), (None, "b"), ("k", "c"))
    assert [r.key for r in journal.ingest(events).collect()] == ["k"]
    assert journal.refused(events).count() == 2


def test_fnv_of_known_strings(spark):
    got = spark.createDataFrame([("",), ("a",), ("foobar",), ("ключ",)], "k string").select(F.hex(fnv32a(F.col("k"))).alias("h")).collect()
    h = 2166136261
    for b in "ключ".encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    assert [r.h for r in got] == ["811C9DC5", "E40C292C", "BF9CF968", f"{h:X}"]


def test_chunks_of_a_band(spark):
    one = journal.with_band(rows(spark, *[(f"vol_{i}", "x") for i in range(21)]), 1)
    got = journal.flush_chunks(one, 20, "seq").groupBy("chunk").count().collect()
    assert sorted((r.chunk, r["count"]) for r in got) == [(0, 20), (1, 1)]


def test_write_batches_are_exact(spark):
    got = journal.write_batches(rows(spark, *[(f"bw_{i:04d}", "x") for i in range(50)]), 20).groupBy("write_batch").count().collect()
    assert sorted((r.write_batch, r["count"]) for r in got) == [(0, 20), (1, 20), (2, 10)]


def test_batches_of_rows_whose_other_columns_are_read(spark):
    """Counts and rows are read by two branches of the plan; both must cut the same ranges."""
    n = 200_000
    events = spark.range(0, n, 1, 12).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    got = journal.write_batches(events, 200).withColumn("wrong", F.col("write_batch") != F.floor(F.col("seq") / 200))
    r = got.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("wrong").cast("int")).alias("wrong"), F.max("key")).collect()[0]
    assert (r.n, r.wrong) == (n, 0)


@pytest.mark.parametrize("kind", ["long", "string", "timestamp", "decimal(20,0)"])
def test_places_with_ties_and_nulls(spark, kind):
    value = F.col("n").cast(kind) if kind != "timestamp" else F.timestamp_seconds("n")
    data = [(f"k{i:03d}", i % 3, None if i % 10 == 0 else 5 if i % 3 == 0 else i * 37 % 100) for i in range(300)]
    df = spark.createDataFrame(data, "key string, band int, n int").withColumn("score", value)
    got = {(r.band, r.key): r._place for r in journal.numbered(df, ["score", "key"], ["band"]).collect()}
    order = (lambda v: (v is not None, str(v))) if kind == "string" else (lambda v: (v is not None, v or 0))
    for band in range(3):
        want = sorted((r for r in data if r[1] == band), key=lambda r: (order(r[2]), r[0]))
        assert [got[band, k] for k, _, _ in want] == list(range(100))


def test_no_rows_have_no_places(spark):
    assert journal.write_batches(rows(spark, ("k", "x")).filter("false"), 5).collect() == []
    assert journal.flush_chunks(journal.with_band(rows(spark, ("k", "x")).filter("false"), 4), 5, "seq").collect() == []


def test_expired_and_empty_payloads_go(spark):
    df = spark.sql("select * from values ('a', 'x', timestamp'2024-01-01 00:00:00'), ('b', '', timestamp'2024-01-01 00:00:59'), ('c', 'x', timestamp'2024-01-01 00:00:59'), ('d', null, timestamp'2024-01-01 00:00:59') t(key, payload, ts)")
    got = journal.unexpired(df, 30_000, F.expr("timestamp'2024-01-01 00:01:00'"))
    assert [r.key for r in got.collect()] == ["c"]


def test_contract_refuses_what_does_not_parse(spark):
    from pyspark.sql import types as T

    c = contract.ColumnContract(fields={"a": F.col("doc.a"), "n": F.col("doc.n")}, schema=T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.IntegerType())]))
    got = {r.key: r.ok for r in c.apply(rows(spark, ("good", '{"a":"x","n":1}'), ("oops", "{oops"), ("type", '{"a":"x","n":"y"}'), ("part", '{"a":"x"}'), ("list", "[1]"))).collect()}
    assert got == {"good": True, "oops": False, "type": False, "part": True, "list": False}


def test_python_contract(spark):
    from pyspark.sql import types as T

    def shape(key, payload):
        if key.startswith("bad_"):
            raise ValueError("bad")
        return {"value": payload.upper()}

    c = contract.PythonContract(shape, T.StructType([T.StructField("value", T.StringType())]))
    got = {r.key: (r.ok, r.value, r.reason) for r in c.apply(rows(spark, ("good_1", "a"), ("bad_1", "b"))).collect()}
    assert got == {"good_1": (True, "A", None), "bad_1": (False, None, "contract_violation")}


def test_merge_sets_only_listed_fields(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "_id string, n int, s string")
    new = spark.createDataFrame([("a", None), ("c", 3)], "_id string, n int")
    got = {r._id: (r.n, r.s) for r in upsert.merge(base, new).collect()}
    assert got == {"a": (None, "x"), "b": (2, "y"), "c": (3, None)}
    c = upsert.merge_counts(base, new).collect()[0]
    assert (c.inserted, c.matched, c.modified, c.upserted) == (0, 1, 1, 1)


def test_dead_letter_strategies(spark):
    letters = rows(spark, *[(f"bad_{i}", "x") for i in range(5)])
    c = dead_letters.process(letters, "ignore").counts.collect()[0]
    assert (c.processed, c.succeeded, c.failed) == (5, 5, 0)
    again = dead_letters.process(letters, "reinsert", mutate=lambda k: F.concat(F.lit("reinserted_"), k)).again
    assert sorted(r.key for r in again.collect()) == [f"reinserted_bad_{i}" for i in range(5)]
    empty = dead_letters.process(letters.limit(0), "ignore").counts.collect()[0]
    assert (empty.processed, empty.succeeded, empty.failed) == (0, 0, 0)
    with pytest.raises(UnknownStrategy):
        dead_letters.process(letters, "burn")
