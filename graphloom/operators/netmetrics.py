"""Network metrics of a skill graph: co-occurrence, centrality, distances and indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut_lineage


def co_occurrence(members: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """``(a, b, both, n_a, n_b)``: pairs of items that share groups, with the counts of each.

    Pairs are made inside a group (a job), whose size doesn't grow with the corpus.
    """
    pairs_of = members.select(group, item).distinct()
    counts = pairs_of.groupBy(item).agg(F.count("*").alias("n"))
    left, right = pairs_of.select(group, F.col(item).alias("a")), pairs_of.select(group, F.col(item).alias("b"))
    pairs = left.join(right, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both")).where(F.col("both") >= least)
    return pairs.join(counts.select(F.col(item).alias("a"), F.col("n").alias("n_a")), "a").join(counts.select(F.col(item).alias("b"), F.col("n").alias("n_b")), "b")


def jaccard(both: Column, n_a: Column, n_b: Column) -> Column:
    return both / (n_a + n_b - both)


def overlap(both: Column, n_a: Column, n_b: Column) -> Column:
    return both / F.least(n_a, n_b)


def shortest_distances(edges: DataFrame, sources: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """``(source, node, distance, path)`` over undirected ``edges(a, b, cost)``: the cheapest path to every node that has one.

    Relaxation to the end: each round extends only what the round before improved, and the rounds stop
    when nothing improves. Edges are written once and distances once a round, so a round's plan is that
    of two joins however many went before. ``most_rounds`` only guards against a loop without end; costs
    are not negative, so it is not reached. Of equally cheap paths the first in order of nodes counts.
    """
    both = edges.select("a", "b", "cost").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost"))
    links = cut_lineage(both.groupBy("a", "b").agg(F.min("cost").alias("cost")))
    node = sources.columns[0]
    best = cut_lineage(sources.select(F.col(node).alias("source")).distinct().select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance"), F.array("source").alias("path")))
    improved = best
    for _ in range(most_rounds):
        step = improved.join(links, improved["node"] == links["a"]).select("source", F.col("b").alias("node"), F.struct((F.col("distance") + F.col("cost")).alias("distance"), F.concat("path", F.array("b")).alias("path")).alias("way"))
        step = step.groupBy("source", "node").agg(F.min("way").alias("way"))
        known = best.select("source", "node", F.col("distance").alias("known"))
        improved = cut_lineage(step.join(known, ["source", "node"], "left").where("known IS NULL OR way.distance < known").select("source", "node", "way.distance", "way.path"))
        if improved.isEmpty():
            return best
        best = cut_lineage(best.join(improved.select("source", "node"), ["source", "node"], "left_anti").unionByName(improved))
    raise RuntimeError(f"distances still improve after {most_rounds} rounds")


def closeness(distance: Column) -> Column:
    """1 / (1 + distance); 0 where there is no path."""
    return F.coalesce(1 / (1 + distance), F.lit(0.0))


def inverse_weight(weight: Column) -> Column:
    """The other form of closeness: 1 / weight; 0 where there is no edge or no weight."""
    return F.coalesce(F.when(weight > 0, 1 / weight), F.lit(0.0))


def blended(path: Column, semantic: Column, substitution: Column | None = None) -> Column:
    """0.6 of the path's closeness and 0.3 of the meaning's, and 0.1 of the substitution's where that is given."""
    both = 0.6 * path + 0.3 * semantic
    return both if substitution is None else both + 0.1 * substitution


#: How much more a core skill counts for a job's closeness.
CORE_WEIGHT = 2.0
#: Rounds between two checkpoints, at each of which the change is read.
STEP = 5


def eigenvector_centrality(edges: DataFrame, tolerance: float = 1e-4, most_rounds: int = 100) -> DataFrame:
    """``(node, centrality, converged)`` by power iteration over undirected ``edges(a, b)``, unit length.

    Rounds go on until no value changes by ``tolerance``, or until ``most_rounds``, and ``converged`` tells
    which. Each node counts itself too, which leaves the result and lets graphs of two sides converge. The
    vector is written and brought to unit length every ``STEP`` rounds, so plans stay small and values finite.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut_lineage(both)
    nodes = both.select(F.col("a").alias("node")).distinct()
    links = cut_lineage(both.unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    score = nodes.withColumn("centrality", F.lit(1.0))
    done, converged = 0, False
    while done < most_rounds and not converged:
        for _ in range(min(STEP, most_rounds - done)):
            step = links.join(score.select("node", "centrality"), links["b"] == F.col("node")).groupBy("a")
            own = F.sum(F.when(F.col("a") == F.col("b"), F.col("centrality")))
            score = step.agg(F.sum("centrality").alias("centrality"), own.alias("before")).withColumnRenamed("a", "node")
            done += 1
        score = cut_lineage(score)
        now, last = score.agg(*(F.sqrt(F.sum(F.col(c) * F.col(c))) for c in ("centrality", "before"))).first()
        if now is None:  # no edges
            break
        change = score.agg(F.max(F.abs(F.col("centrality") / now - F.col("before") / last))).first()[0]
        score = score.select("node", (F.col("centrality") / now).alias("centrality"))
        converged = change < tolerance
    return score.select("node", "centrality", F.lit(converged).alias("converged"))


def creation_vs_history(dated: DataFrame, window: str = "INTERVAL 5 YEARS") -> DataFrame:
    """``(job_id, creation)`` of ``dated(job_id, industry, c1, c2, posted_at)``: share of a job's pairs that no job of its industry had in the window before.

    The pair's previous date decides: that of its part of the time, else the last of the part before,
    so that a frequent pair is spread over parts.
    """
    key = ["industry", "c1", "c2"]
    second = F.unix_micros(F.col("posted_at").cast("timestamp"))
    since = F.unix_micros(F.col("posted_at").cast("timestamp") - F.expr(window))
    rows = dated.select("job_id", *key, second.alias("at"), since.alias("since"), F.floor(second / 86_400_000_000 / 60).alias("part"))
    last = rows.groupBy(*key, "part").agg(F.max("at").alias("last"))
    carried = last.select(*key, "part", F.lag("last").over(Window.partitionBy(*key).orderBy("part")).alias("carried"))
    earlier = F.max("at").over(Window.partitionBy(*key, "part").orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    known = rows.withColumn("earlier", earlier).join(carried, [*key, "part"], "left").withColumn("previous", F.coalesce("earlier", "carried"))
    novel = F.when(F.col("industry").isNotNull() & (F.col("previous") >= F.col("since")), 0.0).otherwise(1.0)
    return known.groupBy("job_id").agg(F.avg(novel).alias("creation"))


def transition_band(index: Column, high: float = 0.7, low: float = 0.4) -> Column:
    return F.when(index > high, "high").when(index > low, "medium").otherwise("low")
