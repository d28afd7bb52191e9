"""DuckDB SQL that gives the same rows as the native queries on op2 and op3.

The mixture's solver bisects over the same shares; a place on the ring and every
random order is the beginning of an MD5 digest on both sides.
"""

from __future__ import annotations

from .hash_ring import cell_bits, ring

_WORD = r"[^\x20\x09-\x0D]+"


def _digest(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def mixing_sql(max_repetition: float, block_tokens: int, seed: int) -> str:
    """temperature_mix with a limit of repetition and no budget."""
    key = "coalesce(cast(id AS varchar), '') || '|' || a || '|' || b"
    return rf"""
WITH RECURSIVE t AS (
  SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS n, md5(coalesce(text, '')) AS h FROM documents),
u AS (
  SELECT id, source, ('0x' || substr(h, 1, 15))::BIGINT AS a, ('0x' || substr(h, 16, 15))::BIGINT AS b, sum(n)::BIGINT AS n_tokens, count(*) AS copies
  FROM t GROUP BY ALL),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM u GROUP BY 1),
total AS (SELECT sum(tokens)::BIGINT AS total FROM s),
q AS (SELECT tokens, count(*) AS m, tokens / any_value(total)::DOUBLE AS q FROM s, total WHERE tokens > 0 GROUP BY 1),
bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN wide THEN mid ELSE low END, CASE WHEN wide THEN high ELSE mid END
  FROM (SELECT *, (low + high) / 2 AS mid, (SELECT max(pow(q, (low + high) / 2) / q) / min(pow(q, (low + high) / 2) / q) FROM q) > {max_repetition} AS wide FROM bisect WHERE step < 48)),
e AS (SELECT CASE WHEN (SELECT max(1 / q) / min(1 / q) FROM q) <= {max_repetition} THEN 0.0 ELSE high END AS exponent FROM bisect WHERE step = 48),
z AS (SELECT sum(m * pow(q, exponent)) AS whole FROM q, e),
w AS (SELECT source, tokens, exponent, CASE WHEN tokens > 0 THEN pow(tokens / total::DOUBLE, exponent) / whole ELSE 0.0 END AS weight FROM s, total, e, z),
lo AS (SELECT min(weight / tokens) AS slight FROM w WHERE tokens > 0),
p AS (SELECT w.*, CASE WHEN tokens > 0 THEN greatest(round(weight * (1.0 / slight))::BIGINT, tokens) ELSE 0 END AS target_tokens FROM w, lo),
k AS (SELECT *, CASE WHEN tokens > 0 THEN target_tokens // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN target_tokens % tokens ELSE 0 END AS rest, greatest(1, ceil(tokens / {block_tokens}))::BIGINT AS blocks FROM p),
r AS (
  SELECT id, a, b, u.source, n_tokens, copies, exponent, weight, target_tokens, tokens, whole, rest, {_digest(f"'{seed}|' || {key}")} % blocks AS block,
    unnest(range(whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS pass
  FROM u JOIN k ON u.source IS NOT DISTINCT FROM k.source),
sums AS (SELECT source, pass, block, sum(n_tokens) AS own FROM r GROUP BY ALL),
starts AS (SELECT source, pass, block, coalesce(sum(own) OVER (PARTITION BY source, pass ORDER BY {_digest(f"'{seed + 1}|' || pass || '|' || block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sums),
o AS (
  SELECT r.*, start + coalesce(sum(n_tokens) OVER (PARTITION BY r.source, r.pass, r.block ORDER BY {_digest(f"'{seed + 2}|' || r.pass || '|' || {key}")}, id NULLS FIRST, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot
  FROM r JOIN starts ON r.source IS NOT DISTINCT FROM starts.source AND r.pass = starts.pass AND r.block = starts.block),
used AS (SELECT *, unnest(range(copies)) AS copy FROM o WHERE pass < whole OR spot < rest)
SELECT id AS doc_id, source, pass::INT AS pass, block, (pass * tokens + spot)::BIGINT AS position, n_tokens, round(exponent, 9) AS exponent, round(weight, 9) AS weight, target_tokens FROM used
"""


def ring_sql(shards: int, virtual_nodes: int) -> str:
    """assign without slack, for tables in which no text is hot."""
    bits = cell_bits(shards, virtual_nodes)
    owner = ring(shards, virtual_nodes)
    return rf"""
WITH RECURSIVE crc AS (  -- the table of the reflected polynomial
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
d AS (
  SELECT r, doc_id, octet_length(encode(t)) + 1 AS size, {_digest("t")} AS place,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(t))), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM (SELECT *, hex(encode(t)) AS h FROM t), crc),
p AS (SELECT *, (place >> {60 - bits})::INT AS cell FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY place, doc_id NULLS FIRST, text_crc32, size) - 1 AS rank FROM p),
own AS (SELECT unnest(range({1 << bits}))::INT AS cell, unnest({owner}) AS shard),
cap AS (SELECT s AS shard, (SELECT count(*) FROM p) // {shards} + CASE WHEN s < (SELECT count(*) FROM p) % {shards} THEN 1 ELSE 0 END AS cap FROM range({shards}) x(s)),
n AS (SELECT cell, shard, cap, n, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (SELECT cell, count(*) AS n FROM p GROUP BY 1) JOIN own USING (cell) JOIN cap USING (shard)),
taken AS (SELECT cell, shard, greatest(0, least(n, cap - before)) AS took, least(before, cap) AS slot0, n FROM n),
spill AS (SELECT row_number() OVER (ORDER BY cell) AS i, cell, took AS a, n AS z FROM taken WHERE took < n),
room AS (SELECT list(cap - coalesce(took, 0) ORDER BY shard) AS room, list(coalesce(took, 0) ORDER BY shard) AS used FROM cap LEFT JOIN (SELECT shard, sum(took)::BIGINT AS took FROM taken GROUP BY 1) USING (shard)),
far AS (  -- how far clockwise the next cell of each shard lies
  SELECT c.cell, list(coalesce(ahead, wrap + {1 << bits}) - c.cell ORDER BY s.shard) AS far
  FROM (SELECT DISTINCT cell FROM spill) c, (SELECT shard, list(cell ORDER BY cell) AS cells, min(cell) AS wrap FROM own GROUP BY 1) s, LATERAL (SELECT min(x) AS ahead FROM (SELECT unnest(s.cells) AS x) WHERE x > c.cell) GROUP BY 1),
walk(i, cell, first, past, shard, slot0, room, used, a) AS (
  SELECT 0::BIGINT, NULL::INT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, room, used, NULL::BIGINT FROM room
  UNION ALL
  SELECT i, cell, a, a + k, sh, used[sh + 1], list_transform(room, lambda x, j: CASE WHEN j = sh + 1 THEN x - k ELSE x END), list_transform(used, lambda x, j: CASE WHEN j = sh + 1 THEN x + k ELSE x END), CASE WHEN a + k < z THEN a + k END
  FROM (SELECT *, least(z - a, room[sh + 1]) AS k
    FROM (SELECT o.i, o.cell, coalesce(w.a, o.a) AS a, o.z, w.room, w.used,
        (SELECT arg_min(s, f.far[s + 1]) FROM range({shards}) y(s) WHERE w.room[s + 1] > 0) AS sh
      FROM walk w JOIN spill o ON o.i = CASE WHEN w.a IS NULL THEN w.i + 1 ELSE w.i END JOIN far f ON f.cell = o.cell))),
seg AS (SELECT cell, 0 AS first, took AS past, shard, slot0 FROM taken WHERE took > 0 UNION ALL SELECT cell, first, past, shard, slot0 FROM walk WHERE cell IS NOT NULL)
SELECT k.doc_id, k.size::BIGINT AS size, k.text_crc32, 'rows' AS law, seg.shard::INT AS shard, (seg.slot0 + k.rank - seg.first)::BIGINT AS slot, NULL::INT AS grown_shard
FROM k JOIN seg ON k.cell = seg.cell AND k.rank >= seg.first AND k.rank < seg.past
"""
