"""Connected components of large edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.frames import cut_lineage

#: Edges of one task, about: a list of few edges is not dealt over many tasks, each of which would write files of its own.
TASK_EDGES = 50_000


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``(id, component)`` for each node of ``edges(a, b)``; the component is its smallest node.

    ``most_rounds`` only guards against a loop without end: it is an error, not a result.

    Alternating large-star and small-star steps: each step links nodes to the smallest
    node they know of, so the number of rounds grows with the logarithm of the longest
    path. Minima are aggregated before the shuffle; all edges of a long list never meet in one
    task or on the driver, which sees a count and a sum for each round. A step's tasks grow
    with the number of edges, ``TASK_EDGES`` in each or fewer.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    n, before = now.count(), None
    for _ in range(most_rounds):
        tasks = -(-n // TASK_EDGES) or 1
        now = now.coalesce(tasks)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # a centre may have a third of all edges: these are plain joins, which Spark splits at such a key
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # not more rows than ``both``; those that are equal meet in the step's last distinct
        large = large.where("a <> b").coalesce(2 * tasks)
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = cut_lineage(small.unionByName(lowest.select("a", F.col("low").alias("b"))).coalesce(2 * tasks).distinct())
        # exact in any order of summation: whole numbers
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        n, before = state[0], state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
