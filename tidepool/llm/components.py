"""Connected components of a graph of links, by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import dropped, written

#: Links that one task contracts: some 100 MB of its memory.
TASK_LINKS = 1 << 20


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a task's links by stars: each node and the least node it reaches over them."""
    u, v = [], []
    for batch in batches:
        u.append(np.asarray(batch.column(0)))
        v.append(np.asarray(batch.column(1)))
    if not u:
        return
    nodes, at = np.unique(np.concatenate([*u, *v]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    half = len(at) // 2
    for a, b in zip(at[:half].tolist(), at[half:].tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    end = np.array([find(i) for i in range(len(nodes))])
    own = np.flatnonzero(end != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[end[own]])], names=["u", "v"])


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """node, root for every node of ``links`` (a, b): root is the least node reachable.

    First each task contracts its share of the links, TASK_LINKS of them, to
    stars; one task's stars are the result.  The stars of several are joined in
    rounds: each node points at the least node known to be linked with it; nodes that
    point at each other's followers are joined to the least of them (the large-
    and small-star steps), so chains shorten by about half in a round.  A hot
    node's followers are aggregated before they are shuffled, and stay spread
    over the tasks that hold them.  Every round is written, which ends lineage.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = written(spark, edges, "links")
    tasks = -(-edges.count() // task_links)
    stars = written(spark, edges.coalesce(max(1, tasks)).mapInArrow(_contracted, "u long, v long"), "links")
    dropped(spark, edges)
    edges = stars
    while tasks > 1:
        # large star: the larger neighbours of a node link to its least neighbour
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new = written(spark, small, "links")
        mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        same = mark(new) == mark(edges)
        dropped(spark, edges)
        edges = new
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
