"""Connected components by alternating stars, for graphs of any size and hubs of any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import cut


#: Edges that are worth a task of their own: a small graph is not spread over all shuffle partitions,
#: each of which would leave its files behind in every round.
EDGES_PER_TASK = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge.

    In turn every node points its larger neighbours, then its smaller ones, to the smallest
    node it knows, until nothing changes. Minima are aggregated before any shuffle, so a hub
    is never gathered; the join that brings them back can be split. Edges with a null end or
    both ends alike say nothing.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y"))
    now = cut(pairs.filter("u <> v AND NOT x AND NOT y").select("u", "v").distinct())
    state = _fingerprint(now)
    while True:
        tasks = max(1, -(-2 * state[0] // EDGES_PER_TASK))
        now = now.coalesce(tasks)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.coalesce(tasks).union(least.select("u", F.col("m").alias("v")).coalesce(tasks)).distinct().coalesce(tasks))
        before, state = state, _fingerprint(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s"), F.sum(F.hash("u", "v").cast("long")).alias("t")).head()
    return tuple(row)
