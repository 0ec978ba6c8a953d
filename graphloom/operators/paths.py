"""Shortest ways between given pairs: the k shortest simple paths, and distances by a search from both ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import netmetrics
from graphloom.operators.lineage import cut_lineage


def steps_to(links: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """``(goal, node, left)``: the fewest of up to ``most`` steps over ``links(src, dst)`` from each node to each goal.

    Links are as many as the table has, so they are never broadcast, however small they are taken to be by their files.
    """
    now = goals.select(F.col("goal"), F.col("goal").alias("node")).distinct()
    seen = cut_lineage(now.withColumn("left", F.lit(0)))
    now = seen
    for step in range(1, most + 1):
        back = now.select("goal", F.col("node").alias("dst")).join(links.hint("merge"), "dst").select("goal", F.col("src").alias("node")).distinct()
        now = cut_lineage(back.join(seen.select("goal", "node").hint("merge"), ["goal", "node"], "left_anti").withColumn("left", F.lit(step)))
        if now.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(now))
    return seen


def _detours(links: DataFrame, ahead: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """``(start, goal, path)``: for each of ``roots(start, goal, root, banned)`` the first shortest way on from the root's end to the goal.

    The way holds no node of the root again and begins with none of the banned nodes. All roots are searched at
    once, step by step; of the ways that meet in a node the first is kept, and a root is done when it has its way.
    """
    task = ["start", "goal", "root"]
    now = roots.withColumn("path", F.col("root"))
    found = None
    while True:
        on = now.withColumn("src", F.element_at("path", -1)).join(links.hint("merge"), "src")
        on = on.where(~F.array_contains("root", F.col("dst")) & ((F.size("path") > F.size("root")) | ~F.array_contains("banned", F.col("dst"))))
        on = on.join(ahead.select("goal", F.col("node").alias("dst"), "left").hint("merge"), ["goal", "dst"]).where(F.size("path") + F.col("left") <= most)
        step = on.groupBy(*task, "dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path"), F.first("banned").alias("banned"))
        step = cut_lineage(step)
        done = step.where("dst = goal").select(*task, "path")
        found = done if found is None else found.unionByName(done)
        now = step.join(done.select(*task).hint("merge"), task, "left_anti").select(*task, "banned", "path")
        # a path has at most this many nodes, so the loop ends
        now = cut_lineage(now.where(F.size("path") <= most))
        if now.isEmpty():
            return found.select("start", "goal", "path")


def k_shortest(links: DataFrame, pairs: DataFrame, k: int = 3, most: int = 5) -> DataFrame:
    """``(start, goal, rank, steps, path)``: the k simple paths of fewest steps, up to ``most``, for each of ``pairs(start, goal)``.

    Deviation paths: the next path of a pair leaves one of those found before at some node (the spur), by another step.
    So each round takes the pair's best candidate and searches from every spur of it; all pairs and spurs are searched at
    once, and only nodes from which the goal can still be reached in time are visited. It holds on graphs with cycles.
    Equally long paths are in order of their nodes; a goal that is its own start has no path. The many joins of small tables
    are no broadcasts, each of which would take a page of the driver's memory however few its rows.
    """
    links = cut_lineage(links.select("src", "dst").where("src <> dst").distinct())
    pairs = cut_lineage(pairs.select("start", "goal").where("start IS NOT NULL AND goal IS NOT NULL AND start <> goal").distinct())
    ahead = steps_to(links, pairs, most)
    # all ways lead over nodes from which a goal is near, so the other links are left behind here
    links = cut_lineage(links.join(ahead.select(F.col("node").alias("dst")).distinct().hint("merge"), "dst", "left_semi").select("src", "dst"))
    spurs = pairs.select("start", "goal", F.array("start").alias("root"), F.filter(F.array("start"), lambda x: F.lit(False)).alias("banned"))
    candidates = cut_lineage(_detours(links, ahead, spurs, most))
    taken = None
    best = Window.partitionBy("start", "goal").orderBy(F.size("path"), "path")
    for rank in range(1, k + 1):
        first = cut_lineage(candidates.withColumn("n", F.row_number().over(best)).where("n = 1").select("start", "goal", "path"))
        chosen = first.withColumn("rank", F.lit(rank))
        taken = cut_lineage(chosen if taken is None else taken.unionByName(chosen))
        if rank == k or first.isEmpty():
            break
        # every proper prefix of the path just taken, with the steps that paths already taken make after it
        cut = lambda df: df.select("start", "goal", "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("n")).select("start", "goal", F.slice("path", 1, F.col("n")).alias("root"), F.element_at("path", F.col("n") + 1).alias("next"))
        spurs = cut(first).select("start", "goal", "root").join(cut(taken).hint("merge"), ["start", "goal", "root"]).groupBy("start", "goal", "root").agg(F.collect_set("next").alias("banned"))
        more = _detours(links, ahead, spurs, most)
        candidates = cut_lineage(candidates.unionByName(more).distinct().join(taken.select("start", "goal", "path").hint("merge"), ["start", "goal", "path"], "left_anti"))
    return taken.select("start", "goal", "rank", (F.size("path") - 1).alias("steps"), "path")


#: Nodes with most edges, the distances to which say at the start how far a pair is apart at most; none by default.
LANDMARKS = 0


def landmark_distances(links: DataFrame, landmarks: int) -> DataFrame:
    """``(node, far)``: an array of each node's distance to the landmarks, the nodes with most edges; null where there is no way."""
    chosen = links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(landmarks).select("node")
    marks = [r[0] for r in chosen.collect()]
    found = netmetrics.shortest_distances(links, chosen)
    return found.groupBy("node").agg(F.array(*[F.max(F.when(F.col("source") == m, F.col("distance"))) for m in marks]).alias("far"))


#: No way known yet, and no node left to go on from.
_NONE = float("inf")


def search_pairs(edges: DataFrame, pairs: DataFrame, landmarks: int = LANDMARKS, most_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``(distances, settled)`` of ``pairs(a, b)`` over undirected ``edges(a, b, cost)``: see :func:`pair_distances`.

    ``settled(pair, side, node, distance)`` has a row for each node that a side of a pair's search has gone on from.
    """
    both = edges.select("a", "b", "cost").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost"))
    links = cut_lineage(both.where("a <> b").groupBy("a", "b").agg(F.min("cost").alias("cost")))
    # a round goes about one edge further
    width = links.agg(F.avg("cost")).first()[0] or 0.0
    # a number for each pair; written, so that it stays
    asked = cut_lineage(pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct().withColumn("pair", F.monotonically_increasing_id()))
    high = F.lit(_NONE)
    ends = asked.where("a <> b")
    if landmarks:
        far = landmark_distances(links, landmarks)
        ends = ends.join(far.toDF("a", "far_a"), "a", "left").join(far.toDF("b", "far_b"), "b", "left")
        high = F.coalesce(F.array_min(F.zip_with("far_a", "far_b", lambda x, y: x + y)), high)
    no = F.lit(None).cast("double")
    # best: the cheapest way known; low0, low1: what no node still to go on from is nearer than, on each side
    bounds = cut_lineage(ends.select("pair", high.alias("best"), F.lit(0.0).alias("low0"), F.lit(0.0).alias("low1")))
    at = lambda end, d0, d1: asked.where("a <> b").select("pair", F.col(end).alias("node"), d0.alias("d0"), d1.alias("d1"), no.alias("e0"), no.alias("e1"))
    # d0, d1: a node's distances from the two ends so far; e0, e1: those at which it was last gone on from
    now = cut_lineage(at("a", F.lit(0.0), no).unionByName(at("b", no, F.lit(0.0))))
    ended, left = [asked.where("a = b").select("pair", F.lit(0.0).alias("distance"))], []
    is_open = lambda k: F.col(f"d{k}").isNotNull() & (F.col(f"e{k}").isNull() | (F.col(f"d{k}") < F.col(f"e{k}")))
    for _ in range(most_rounds):
        # the nearest nodes of each side, but none from which even the other side's nearest would be too far
        rows = now.join(bounds, "pair")
        goes = [F.coalesce(is_open(k) & (F.col(f"d{k}") <= F.col(f"low{k}") + width) & (F.col(f"d{k}") + F.col(f"low{1 - k}") < F.col("best")), F.lit(False)) for k in (0, 1)]
        out = rows.select("pair", "best", "node", *[F.when(goes[k], F.col(f"d{k}")).alias(f"d{k}") for k in (0, 1)]).where("d0 IS NOT NULL OR d1 IS NOT NULL")
        step = out.join(links.toDF("node", "to", "cost"), "node").select("pair", "best", F.col("to").alias("node"), *[(F.col(f"d{k}") + F.col("cost")).alias(f"d{k}") for k in (0, 1)])
        step = step.where("d0 < best OR d1 < best").select("pair", "node", "d0", "d1", no.alias("e0"), no.alias("e1"))
        kept = rows.select("pair", "node", "d0", "d1", *[F.when(goes[k], F.col(f"d{k}")).otherwise(F.col(f"e{k}")).alias(f"e{k}") for k in (0, 1)])
        merged = cut_lineage(kept.unionByName(step).groupBy("pair", "node").agg(*[F.min(c).alias(c) for c in ("d0", "d1", "e0", "e1")]))
        lows = [F.coalesce(F.min(F.when(is_open(k), F.col(f"d{k}"))), F.lit(_NONE)).alias(f"low{k}") for k in (0, 1)]
        met = merged.groupBy("pair").agg(F.min(F.col("d0") + F.col("d1")).alias("met"), *lows)
        known = cut_lineage(met.join(bounds.select("pair", "best"), "pair").select("pair", F.least("best", F.coalesce("met", "best")).alias("best"), "low0", "low1"))
        # a cheaper way would pass a node that both sides have gone on from
        done = (F.col("low0") + F.col("low1") >= F.col("best")) | (F.col("low0") == _NONE) | (F.col("low1") == _NONE)
        ended.append(known.where(done & (F.col("best") < _NONE)).select("pair", F.col("best").alias("distance")))
        bounds = known.where(~done)
        left.append(merged.join(known.where(done).select("pair"), "pair", "left_semi"))
        now = merged
        if bounds.isEmpty():
            break
    else:
        raise RuntimeError(f"distances still improve after {most_rounds} rounds")
    distances = asked.join(reduce(DataFrame.unionByName, ended), "pair").select("a", "b", "distance")
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"e{k}").alias("distance")) for k in (0, 1)]))
    settled = reduce(DataFrame.unionByName, left).select("pair", "node", sides.alias("s")).where("s.distance IS NOT NULL")
    return distances, settled.select("pair", "s.side", "node", "s.distance")


def pair_distances(edges: DataFrame, pairs: DataFrame, landmarks: int = LANDMARKS) -> DataFrame:
    """``(a, b, distance)`` of the cheapest path for each of ``pairs(a, b)`` that has one, over undirected ``edges(a, b, cost)``.

    Each pair is searched from both ends, all pairs at once. In a round each side goes on from its nearest nodes, those
    within an edge's mean cost of the nearest one, so that a side goes little further than half of the pair's distance. A pair is
    done when the ways that are left on both sides add up to no less than the best way known, or one side has no way left.
    Costs are not negative.
    """
    return search_pairs(edges, pairs, landmarks)[0]
