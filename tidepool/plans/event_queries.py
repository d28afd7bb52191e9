"""The engine's operators over the events table, each with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import prefixed_key
from tidepool.model import CONTRACT_VIOLATION
from tidepool.operators import contract, dead_letters, journal, upsert
from tidepool.sources import event_rows, synthetic, table

BANDS, BATCH, CHUNK, TTL_MS, HEAL_FROM = 16, 200, 5, 6 * 3600 * 1000, 20.0


def accepting() -> contract.ColumnContract:
    """Refuses events of type error."""
    return contract.ColumnContract(fields={"n": F.get_json_object("props", "$.k").cast("int")}, accept=F.col("event_type") != "error")


def healing() -> contract.ColumnContract:
    """Repairs events of type error, from a value of HEAL_FROM on."""
    repaired = F.when(F.col("event_type") == "error", "repaired").otherwise(F.col("event_type"))
    return contract.ColumnContract(fields={"n": F.get_json_object("props", "$.k").cast("int"), "event_type": repaired}, accept=F.col("value") >= HEAL_FROM)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_HASH = """list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, octet_length(encode(k))),
  lambda i: ('0x'||substr(hex(encode(k)),(2*i+1)::INT,2))::BIGINT)),
  lambda h,b: (xor(h,b)*16777619) & 4294967295)"""
_SQL = f"""WITH e AS (SELECT cast(user_id AS varchar) AS k, event_id AS seq, ts, event_type, value, props,
    cast(json_extract_string(props, '$.k') AS int) AS n FROM events WHERE user_id IS NOT NULL),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1),
b AS (SELECT *, cast({_HASH} % {BANDS} AS int) AS band FROM l),
r AS (SELECT * FROM b WHERE event_type = 'error'), a AS (SELECT * FROM b WHERE event_type <> 'error')
"""


def _query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = _SQL + sql
        return f

    return keep


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.ingest(event_rows(spark, sf_dir))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.coalesce_latest(_events(spark, sf_dir))


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.with_band(_latest(spark, sf_dir), BANDS)


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepting().apply(_banded(spark, sf_dir))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letters.to_dead_letters(contract.rejected(_shaped(spark, sf_dir)), F.col("ts"))


@_query("SELECT count(*) AS events FROM e WHERE k <> ''")
def ingest_validate(spark, sf_dir):
    return _events(spark, sf_dir).agg(F.count(F.lit(1)).alias("events"))


@_query("SELECT k, seq, ts, value, props FROM l")
def coalesce_latest(spark, sf_dir):
    return _latest(spark, sf_dir).select(F.col("key").alias("k"), "seq", "ts", "value", "props")


@_query(f"SELECT cast((rn - 1) // {BATCH} AS bigint) AS write_batch, count(*) AS events FROM (SELECT row_number() OVER (ORDER BY seq) AS rn FROM e) GROUP BY 1")
def write_batches(spark, sf_dir):
    return journal.write_batches(_events(spark, sf_dir), BATCH).groupBy("write_batch").agg(F.count(F.lit(1)).alias("events"))


@_query("SELECT k, band FROM b")
def band_assign(spark, sf_dir):
    return _banded(spark, sf_dir).select(F.col("key").alias("k"), "band")


@_query("SELECT band, count(*) AS depth FROM b GROUP BY 1")
def band_depth(spark, sf_dir):
    return journal.depth(_banded(spark, sf_dir))


@_query("SELECT band, count(*) AS depth FROM b GROUP BY 1 HAVING count(*) >= 10")
def volume_ready_bands(spark, sf_dir):
    return journal.ready_bands(_banded(spark, sf_dir), 10)


@_query(f"SELECT DISTINCT cast((rn - 1) // {BATCH} AS bigint) AS write_batch, cast({_HASH} % {BANDS} AS int) AS band FROM (SELECT k, row_number() OVER (ORDER BY seq) AS rn FROM e)")
def bands_touched(spark, sf_dir):
    return journal.bands_touched(journal.with_band(journal.write_batches(_events(spark, sf_dir), BATCH), BANDS))


@_query(f"SELECT band, k, seq, ts, cast(place AS int) AS place FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY ts, k) AS place FROM b) WHERE place <= {CHUNK}")
def drain_oldest_topk(spark, sf_dir):
    return journal.drain_oldest(_banded(spark, sf_dir), CHUNK, "ts").select("band", F.col("key").alias("k"), "seq", "ts", "place")


@_query(f"SELECT band, cast((rn - 1) // {CHUNK} AS bigint) AS chunk, count(*) AS n FROM (SELECT band, row_number() OVER (PARTITION BY band ORDER BY ts, k) AS rn FROM b) GROUP BY 1, 2")
def flush_chunks(spark, sf_dir):
    return journal.flush_chunks(_banded(spark, sf_dir), CHUNK, "ts").groupBy("band", "chunk").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT k, ts FROM l WHERE ts > (SELECT max(ts) FROM e) - INTERVAL 6 HOUR AND length(props) > 0")
def drain_ttl_filter(spark, sf_dir):
    now = _events(spark, sf_dir).agg(F.max("ts").alias("now"))
    rows = _latest(spark, sf_dir).join(F.broadcast(now))  # one row
    return journal.unexpired(rows, TTL_MS, F.col("now"), payload="props").select(F.col("key").alias("k"), "ts")


@_query("SELECT k, l.seq IS NULL AS expired, l.value FROM (SELECT DISTINCT k FROM e) LEFT JOIN (SELECT * FROM l WHERE value >= 5) l USING (k)")
def drain_payload_join(spark, sf_dir):
    stored = _latest(spark, sf_dir).filter("value >= 5").select("key", "value")
    pending = _events(spark, sf_dir).select("key").distinct()
    return journal.attach_payload(pending, stored).select(F.col("key").alias("k"), "expired", "value")


@_query("SELECT k, event_type, value, n FROM a")
def contract_project(spark, sf_dir):
    return contract.accepted(_shaped(spark, sf_dir)).select(F.col("key").alias("k"), "event_type", "value", "n")


@_query("SELECT CASE WHEN event_type = 'error' THEN 'contract_violation' ELSE 'ok' END AS route, count(*) AS n FROM l GROUP BY 1")
def contract_route(spark, sf_dir):
    return contract.route_counts(_shaped(spark, sf_dir))


@_query("SELECT CASE WHEN starts_with(k, '1') THEN 'contract_violation' ELSE 'ok' END AS route, count(*) AS n FROM l GROUP BY 1")
def contract_route_prefix(spark, sf_dir):
    by_prefix = contract.ColumnContract(fields={}, accept=~F.startswith(F.col("key"), F.lit("1")))
    return contract.route_counts(by_prefix.apply(_latest(spark, sf_dir)))


@_query("SELECT k, seq FROM b WHERE k NOT IN (SELECT k FROM r)")
def commit_success_keys(spark, sf_dir):
    shaped = _shaped(spark, sf_dir)
    return upsert.succeeded(shaped, contract.rejected(shaped)).select(F.col("key").alias("k"), "seq")


@_query("SELECT k, n, cast(row_number() OVER (PARTITION BY n ORDER BY seq, k) AS int) AS claim, row_number() OVER (PARTITION BY n ORDER BY seq, k) > 1 AS conflict FROM a")
def dup_key_detect(spark, sf_dir):
    good = contract.accepted(_shaped(spark, sf_dir))
    return upsert.unique_conflicts(good, ["n"], "seq").select(F.col("key").alias("k"), "n", "claim", "conflict")


@_query("""SELECT k, CASE WHEN code IS NULL THEN 'ok' WHEN code = 11000 THEN 'dlq' ELSE 'retry' END AS route
FROM (SELECT k, CASE WHEN row_number() OVER (PARTITION BY n ORDER BY seq, k) > 1 THEN 11000 WHEN seq % 17 = 0 THEN 91 END AS code FROM a)""")
def route_bulk_errors(spark, sf_dir):
    claims = upsert.unique_conflicts(contract.accepted(_shaped(spark, sf_dir)), ["n"], "seq")
    code = F.when(F.col("conflict"), 11000).when(F.col("seq") % 17 == 0, 91)
    return claims.select(F.col("key").alias("k"), upsert.route_of(code).alias("route"))


@_query(""", m AS (SELECT max(seq) // 2 AS half FROM e), f AS (SELECT k, max(seq) AS seq FROM e, m WHERE seq <= half GROUP BY k HAVING max(seq) % 17 = 0),
u AS (SELECT * FROM f UNION ALL SELECT k, seq FROM e, m WHERE seq > half) SELECT k, max(seq) AS seq FROM u GROUP BY k""")
def retry_pending(spark, sf_dir):
    e = _events(spark, sf_dir)
    half = F.broadcast(e.agg(F.floor(F.max("seq") / 2).alias("half")))  # one row
    e = e.join(half)
    failed = journal.coalesce_latest(e.filter("seq <= half")).filter("seq % 17 = 0")
    return upsert.carry_over(failed, e.filter("seq > half")).select(F.col("key").alias("k"), "seq")


def _halves(spark, sf_dir):
    e = _events(spark, sf_dir)
    doc = lambda rows: journal.coalesce_latest(rows).select(F.col("key").alias("_id"), "event_type", "value")
    return doc(e.filter("seq < 500")), doc(e.filter("seq >= 500"))


_HALVES = """, o AS (SELECT * FROM e WHERE seq < 500 QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1),
w AS (SELECT * FROM e WHERE seq >= 500 QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)
"""


@_query(_HALVES + """SELECT 0::BIGINT AS inserted, count(o.k) AS matched,
count(*) FILTER (WHERE o.k IS NOT NULL AND (o.event_type IS DISTINCT FROM w.event_type OR o.value IS DISTINCT FROM w.value)) AS modified,
count(*) FILTER (WHERE o.k IS NULL) AS upserted FROM w LEFT JOIN o USING (k)""")
def bulk_upsert_counts(spark, sf_dir):
    return upsert.merge_counts(*_halves(spark, sf_dir))


@_query(_HALVES + """SELECT coalesce(o.k, a.k) AS _id, CASE WHEN a.k IS NOT NULL THEN a.event_type ELSE o.event_type END AS event_type,
CASE WHEN a.k IS NOT NULL THEN a.value ELSE o.value END AS value, a.n FROM o FULL JOIN a ON o.k = a.k""")
def bulk_upsert_table(spark, sf_dir):
    base, _ = _halves(spark, sf_dir)
    new = contract.accepted(_shaped(spark, sf_dir)).select(F.col("key").alias("_id"), "event_type", "value", "n")
    return upsert.merge(base, new)


@_query("SELECT k, seq, cast(row_number() OVER (PARTITION BY k ORDER BY seq) AS int) AS write_no, lead(1) OVER (PARTITION BY k ORDER BY seq) IS NULL AS final FROM e")
def degraded_direct(spark, sf_dir):
    return upsert.direct(_events(spark, sf_dir)).select(F.col("key").alias("k"), "seq", "write_no", "final")


@_query("""SELECT d AS window_start, count(DISTINCT k) AS upserts, count(*) AS events
FROM (SELECT date_trunc('day', ts) AS d, k FROM e) GROUP BY 1""")
def flush_window_coalesce(spark, sf_dir):
    per = journal.flush_windows(_events(spark, sf_dir), "1 day").groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start"))
    return per.agg(F.count(F.lit(1)).alias("upserts"), F.sum("events").alias("events"))


@_query("SELECT count(*) AS events, count(DISTINCT k) AS upserts, 1.0e0 * count(*) / count(DISTINCT k) AS ratio FROM e")
def io_reduction(spark, sf_dir):
    return journal.io_reduction(_events(spark, sf_dir))


@_query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def count_docs(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT 'crn_' || lpad((i % 100)::varchar, 9, '0') AS key, i AS seq, ['push','email','sms','inapp'][i % 4 + 1] AS channel, (i % 5 + 1)::int AS priority,
'camp_' || lpad((i % 100)::varchar, 4, '0') AS campaign_id FROM range(1000) t(i)""")
def gen_synthetic(spark, sf_dir):
    return synthetic(spark, 1000, 100).select("key", "seq", "channel", "priority", "campaign_id")


@_query("SELECT band, count(*) AS depth FROM r GROUP BY 1")
def dlq_depth(spark, sf_dir):
    return journal.depth(_letters(spark, sf_dir))


@_query("SELECT 'contract_violation' AS reason, count(*) AS n FROM r")
def dlq_by_reason(spark, sf_dir):
    return dead_letters.by_reason(_letters(spark, sf_dir))


@_query("SELECT k, 'pending' AS state, NULL::varchar AS reason FROM a UNION ALL SELECT k, 'dlq', 'contract_violation' FROM r")
def move_to_dlq(spark, sf_dir):
    letters = _letters(spark, sf_dir)
    left = dead_letters.move(_banded(spark, sf_dir), letters)
    pending = left.select(F.col("key").alias("k"), F.lit("pending").alias("state"), F.lit(None).cast("string").alias("reason"))
    return pending.union(letters.select("key", F.lit("dlq"), F.lit(CONTRACT_VIOLATION)))


@_query("SELECT band, k, cast(place AS int) AS place FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY ts, k) AS place FROM r) WHERE place <= 2")
def dlq_drain(spark, sf_dir):
    return journal.drain_oldest(_letters(spark, sf_dir), 2, "failed_at").select("band", F.col("key").alias("k"), "place")


@_query("SELECT count(*) AS processed, count(*) AS succeeded, 0::BIGINT AS failed, 0::BIGINT AS left_over FROM r")
def dlq_ignore(spark, sf_dir):
    done = dead_letters.process(_letters(spark, sf_dir), "ignore")
    return done.counts.join(F.broadcast(done.left.agg(F.count(F.lit(1)).alias("left_over"))))  # one row each


@_query(f"SELECT k, 'repaired' AS event_type, value, n FROM r WHERE value >= {HEAL_FROM}")
def dlq_upsert_heal(spark, sf_dir):
    done = dead_letters.process(_letters(spark, sf_dir), "upsert", heal=healing().apply)
    return done.written.select(F.col("key").alias("k"), "event_type", "value", "n")


@_query("SELECT 'reinserted_' || k AS k, seq FROM r")
def dlq_reinsert(spark, sf_dir):
    done = dead_letters.process(_letters(spark, sf_dir), "reinsert", mutate=prefixed_key)
    return done.again.select(F.col("key").alias("k"), "seq")


@_query(f"SELECT count(*) AS processed, count(*) FILTER (WHERE value >= {HEAL_FROM}) AS succeeded, count(*) FILTER (WHERE NOT value >= {HEAL_FROM}) AS failed FROM r")
def dlq_result(spark, sf_dir):
    return dead_letters.process(_letters(spark, sf_dir), "upsert", heal=healing().apply).counts
