"""Queries of significance and of centrality over mixed edges. SQL has no incomplete beta function and can't go on until something converges, so most have tests instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import significance
from graphloom.operators import centrality, netmetrics
from graphloom.plans.graph_queries import _similar
from graphloom.plans.path_queries import _prerequisites
from graphloom.plans.registry import query
from graphloom.sources.domain import Graph


def _links(g: Graph) -> DataFrame:
    """SIMILAR_TO and COMPLEMENTS (skills that two jobs or more want together), both undirected, and PREREQUISITE_OF."""
    together = netmetrics.co_occurrence(g.requires(), "job_id", "skill_id", 2).select("a", "b")
    return centrality.mixed([_similar(g).select("src", "dst"), together], [_prerequisites(g).select("src", "dst")])


@query()
def centrality_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of skills over similar, complementary and prerequisite skills together."""
    return centrality.eigenvector(_links(Graph(spark, sf_dir))).select("node", F.round("centrality", 6).alias("centrality"), "converged")


@query()
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback of the above: ranks of the same skills."""
    return centrality.pagerank(_links(Graph(spark, sf_dir))).select("node", F.round("rank", 9).alias("rank"), "converged")


@query()
def pearson_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part type the correlation of quantity and price over its lines, with its p-value."""
    g = Graph(spark, sf_dir)
    lines = g.table("lineitem").join(g.skills().select(F.col("skill_id").alias("l_partkey"), "subcategory"), "l_partkey").where("l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
    found = lines.groupBy("subcategory").agg(F.count("*").alias("n"), F.corr("l_quantity", "l_extendedprice").alias("r"))
    p = significance.pearson_p_value(F.col("r"), F.col("n"))
    return found.select("subcategory", "n", F.round("r", 9).alias("r"), F.round(p, 9).alias("p"), (p < 0.05).alias("significant"))


@query()
def ab_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each type of event the difference of two arms' means, with Welch's t, its degrees of freedom and its p-value."""
    rows = Graph(spark, sf_dir).table("events").withColumn("arm", F.col("user_id") % 2)
    of = lambda arm: F.when(F.col("arm") == arm, F.col("value"))
    sums = [f.alias(f"{name}_{arm}") for arm in (0, 1) for name, f in (("mean", F.avg(of(arm))), ("var", F.var_samp(of(arm))), ("n", F.count(of(arm))))]
    t, df, p = significance.welch(*[F.col(f"{name}_{arm}") for arm in (0, 1) for name in ("mean", "var", "n")])
    found = rows.groupBy("event_type").agg(*sums)
    return found.select("event_type", F.col("n_0").alias("n_a"), F.col("n_1").alias("n_b"), F.round(t, 9).alias("t"), F.round(df, 6).alias("df"), F.round(p, 9).alias("p"), (p < 0.05).alias("significant"))


@query(
    """SELECT l_returnflag, count(*) AS n,
  round(1.5 * (1 - (var_samp(l_quantity) + var_samp(l_extendedprice / 1000) + var_samp(100 * l_discount)) / var_samp(l_quantity + l_extendedprice / 1000 + 100 * l_discount)), 6) AS alpha
FROM lineitem GROUP BY l_returnflag"""
)
def cronbach_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well three ratings agree: each line's quantity, price and discount as items of one test, by return flag."""
    items = {"i1": F.col("l_quantity"), "i2": F.col("l_extendedprice") / 1000, "i3": 100 * F.col("l_discount")}
    rows = Graph(spark, sf_dir).table("lineitem").select("l_returnflag", *[v.alias(k) for k, v in items.items()])
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(significance.cronbach_alpha(list(items)), 6).alias("alpha"))
