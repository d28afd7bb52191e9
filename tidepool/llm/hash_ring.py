"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import written

#: The ring is 2**CELL_BITS cells, more for many shards; a virtual node stands at the end of a cell.
CELL_BITS = 11
#: A text with more rows than these (and than a ten-thousandth of all) is numbered in SALTS parts, so that it is many tasks' work.
HOT_ROWS, SALTS = 1_000, 64


def cell_bits(shards: int, virtual_nodes: int) -> int:
    """The ring has at least three cells a virtual node, so that each node finds a free one."""
    return max(CELL_BITS, (3 * shards * virtual_nodes - 1).bit_length())


def ring(shards: int, virtual_nodes: int) -> list[int]:
    """The shard that owns each cell: that of the next virtual node clockwise.

    A node's place is a hash of its shard and number, or the next free cell after
    those of lower shards, so another shard takes cells over and moves none
    between the old ones.  Where another shard asks for a finer ring, a node stands
    in one of the parts of its old cell, so only cells with nodes may move besides.
    """
    bits = cell_bits(shards, virtual_nodes)
    cells = 1 << bits
    at: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = int.from_bytes(hashlib.md5(f"{shard}/{node}".encode()).digest()[:8])
            p = digest % (1 << CELL_BITS)
            for k in range(CELL_BITS, bits):
                p = 2 * p + (digest >> k & 1)
            while p in at:
                p = (p + 1) % cells
            at[p] = shard
    owner, nxt = [0] * cells, at[min(at)]
    for c in reversed(range(cells)):
        nxt = at.get(c, nxt)
        owner[c] = nxt
    return owner


def segments(count: dict[int, int], owner: list[int], shards: int, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Place the counted rows of each cell under the shards' capacities.

    Without slack capacities differ by one row at most and sum to all rows; with
    it each is larger by that share.  A shard takes the
    rows of its own cells in ring order while it has room.  What overflows
    continues clockwise, past full shards, to the next one with room.  Returns
    (cell, first rank, one past the last, shard, slot of the first).
    """
    total = sum(count.values())
    room = [math.ceil((total // shards + (s < total % shards)) * (1 + slack)) for s in range(shards)]
    used = [0] * shards
    out, over = [], []

    def put(cell: int, first: int, n: int, shard: int) -> None:
        out.append((cell, first, first + n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    for cell in sorted(count):
        n = min(count[cell], room[owner[cell]])
        if n:
            put(cell, 0, n, owner[cell])
        if n < count[cell]:
            over.append((cell, n, count[cell]))
    for cell, first, end in over:
        step = cell
        while first < end:
            step = (step + 1) % len(owner)
            n = min(end - first, room[owner[step]])
            if n:
                put(cell, first, n, owner[step])
                first += n
    return out


def _literal_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table written into the plan; its size is bounded by the ring's, not the data's."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def place_of(text: Column) -> Column:
    """Where a text stands on the ring: 60 bits of a digest."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def assign(docs: DataFrame, shards: int = 16, virtual_nodes: int = 128, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard; counts of shards differ by one at most (law ``rows``).

    A row's place on the ring is a digest of its text.  The rows of a cell are
    numbered by place, so where a shard fills up at most one group of equal texts
    is cut.  With ``slack`` (law ``bounded``) a shard takes that share more than
    an even one, and one more shard moves fewer rows between the old ones.
    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot (gapless
    from 0 in each shard), grown_shard (null under these laws).  A null text is
    empty.  Null ids and repeated rows are placed one by one; an empty table gives
    no row; other columns are ignored.  The driver sees one count per cell, the
    shuffle moves a narrow row per document; a hot text is numbered in parts.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bits = cell_bits(shards, virtual_nodes)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place_of(text).alias("place"))
    rows = written(spark, rows.withColumn("cell", F.shiftright("place", 60 - bits).cast("int")), "ring-rows")

    count = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cell of the ring
    split = _literal_table(spark, segments(count, ring(shards, virtual_nodes), shards, slack), "cell int, first long, past long, shard int, slot0 long")
    cut = max(HOT_ROWS, sum(count.values()) // 10_000)
    hot = written(spark, rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cut).select(F.col("place").alias("hot")), "ring-hot")  # 10,000 rows at most
    rows = rows.join(F.broadcast(hot), F.col("place") == F.col("hot"), "left").withColumn("hot", F.coalesce("hot", F.lit(-1)))
    rows = rows.withColumn("salt", F.when(F.col("hot") < 0, 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).cast("int"))

    block = ["cell", "hot", "salt"]
    before = Window.partitionBy("cell").orderBy("hot", "salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))  # a row per cell, and SALTS per hot text
    rank = F.row_number().over(Window.partitionBy(*block).orderBy("place", "doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("rank", rank).join(F.broadcast(shift), block).withColumn("rank", F.col("rank") + F.col("shift"))
    s = F.broadcast(split).alias("s")
    placed = ranked.alias("r").join(s, (F.col("r.cell") == F.col("s.cell")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    law = F.lit("bounded" if slack else "rows").alias("law")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
