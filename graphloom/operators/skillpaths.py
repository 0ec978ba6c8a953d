"""Paths over prerequisites and transitions, growth over time, and intents about the network of skills."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import netmetrics, paths, traverse
from graphloom.operators.lineage import cut_lineage

# Words of a question that tell what it asks of the network, in order of precedence.
INTENTS = {
    "learning_path": r"learning path|what should i learn first|prerequisite",
    "high_leverage_skills": r"high.leverage|most central|unlock",
    "transition_difficulty": r"how (hard|difficult)|difficulty",
    "bridge_skills": r"bridge|connect(s|ing)? .* (and|with)",
    "skill_transfer": r"how far|transfer|switch|shortest path",
}


def intent(question: Column) -> Column:
    """The first intent whose words occur, or general."""
    text = F.lower(F.coalesce(question, F.lit("")))
    found = F.lit("general")
    for name, pattern in reversed(INTENTS.items()):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def learning_paths(prerequisites: DataFrame, starts: DataFrame, goals: DataFrame, most: int = 5, shown: int = 3) -> DataFrame:
    """``(goal, rank, steps, path)``: the shortest simple ways of up to ``most`` steps from any of the starts to each goal, on any graph."""
    start, goal = starts.columns[0], goals.columns[0]
    # only pairs that the starts can reach: each start's nodes within so many steps
    reached = traverse.khop(prerequisites.select("src", "dst"), starts, most).select(F.col("seed").alias("start"), F.col("node").alias("goal"))
    pairs = reached.join(goals.select(F.col(goal).alias("goal")).distinct().hint("merge"), "goal", "left_semi")
    found = paths.k_shortest(prerequisites, pairs.select("start", "goal"), shown, most)
    rank = F.row_number().over(Window.partitionBy("goal").orderBy("steps", "path"))
    return found.withColumn("rank", rank).where(F.col("rank") <= shown).select("goal", "rank", "steps", "path")


def learning_order(prerequisites: DataFrame, known: DataFrame, target: DataFrame, depth: int = 2, none: int = 999) -> DataFrame:
    """``(skill_id, steps)`` of the target's skills that aren't known: steps over prerequisites from any known one."""
    gap = target.join(known, "skill_id", "left_anti")
    near = traverse.khop(prerequisites.select("src", "dst"), known, depth).groupBy(F.col("node").alias("skill_id")).agg(F.min("hops").alias("hops"))
    return gap.join(near, "skill_id", "left").select("skill_id", F.coalesce("hops", F.lit(none)).alias("steps"))


def progressions(steps: DataFrame, starts: DataFrame, most: int = 3, frequency: float = 0.2, shown: int = 10) -> DataFrame:
    """``(path, months, difficulty)``: the quickest ways over ``steps(src, dst, frequency, months, difficulty)``, each step being frequent enough.

    Months are positive, so a way is quicker than all that go on from it: what is not among the ``shown`` quickest so far is
    not extended, and no round holds more than those.
    """
    links = cut_lineage(steps.where(F.col("frequency") > frequency).select("src", "dst", "months", "difficulty"))
    start = F.col(starts.columns[0])
    now = starts.select(start.alias("node"), F.array(start).alias("path"), F.lit(0).cast("long").alias("taken"), F.lit(0.0).alias("hard"))
    best, order = None, ["taken", F.col("hard") / (F.size("path") - 1), "path"]
    for _ in range(most):
        step = now.join(links, now["node"] == links["src"]).where(~F.array_contains("path", F.col("dst")))
        step = step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), (F.col("taken") + F.col("months")).alias("taken"), (F.col("hard") + F.col("difficulty")).alias("hard"))
        size = F.size("path")
        best = cut_lineage((step if best is None else best.unionByName(step)).orderBy(*order).limit(shown))
        longest = best.agg(F.max(size)).first()[0]
        if longest is None:
            break
        now = best.where(size == longest) if step is not None else best
        if now.isEmpty():
            break
    return best.select("path", F.col("taken").alias("months"), (F.col("hard") / (F.size("path") - 1)).alias("difficulty")).orderBy("months", "difficulty", "path")


def cluster_closeness(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: the mean over the left skills of their mean closeness to all right ones (0 where there is no way), and how many they are."""
    a, b = left.columns[0], right.columns[0]
    goals = right.select(F.col(b).alias("node")).distinct()
    n = goals.count()
    near = netmetrics.shortest_distances(edges, left).join(goals, "node", "left_semi").groupBy("source").agg(F.sum(netmetrics.closeness(F.col("distance"))).alias("c"))
    every = left.select(F.col(a).alias("source")).distinct().join(near, "source", "left")
    return every.agg((F.avg(F.coalesce("c", F.lit(0.0))) / F.lit(max(1, n))).alias("closeness"), F.count("*").alias("n"))


def growth(rows: DataFrame, item: str, time: str, start: datetime, quarters: int = 20, least: float = 0.5, shown: int = 20) -> DataFrame:
    """``(item, quarters, first_n, last_n, change)``: the first of the quarters against the last, for the items that changed most."""
    first = F.date_trunc("quarter", F.lit(start))
    k = F.floor(F.months_between(F.date_trunc("quarter", time), first) / 3)
    counted = rows.withColumn("k", k).where((F.col("k") >= 0) & (F.col("k") < quarters)).groupBy(item, "k").agg(F.count("*").alias("n"))
    ends = counted.groupBy(item).agg(F.count("*").alias("quarters"), F.min_by("n", "k").alias("first_n"), F.max_by("n", "k").alias("last_n"))
    change = (F.col("first_n") - F.col("last_n")) / F.col("last_n")
    return ends.withColumn("change", change).where(F.col("change") > least).orderBy(F.desc("change"), item).limit(shown)


def pair_correlation(rows: DataFrame, pair: str, expert: str, own: str, target: float = 0.7) -> DataFrame:
    """One row: pairs, the correlation of their mean ratings with the system's mean values, and whether it is high enough."""
    means = rows.groupBy(pair).agg(F.avg(expert).alias("e"), F.avg(own).alias("o"))
    return means.agg(F.count("*").alias("pairs"), F.corr("e", "o").alias("r")).withColumn("met", F.col("r") > target)
