"""Queries that build a question's context: skill gap, market summary and capped matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine, normalized_score
from graphloom.plans.registry import query
from graphloom.sources.domain import Graph


@query(
    """WITH demand AS (SELECT lower(p_name) AS name, count(DISTINCT l_orderkey) AS jobs FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
top AS (SELECT name FROM demand ORDER BY jobs DESC, name LIMIT 15)
SELECT name FROM top WHERE name NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey < 10) ORDER BY name LIMIT 10"""
)
def skill_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 15 skills most in demand, the first 10 by name that a person doesn't have."""
    g = Graph(spark, sf_dir)
    skills = g.skills().select("skill_id", F.lower("name").alias("name"))
    demand = g.requires().join(skills, "skill_id").groupBy("name").agg(F.count_distinct("job_id").alias("jobs"))
    top = demand.orderBy(F.desc("jobs"), "name").limit(15)
    return top.join(skills.where("skill_id < 10"), "name", "left_anti").select("name").orderBy("name").limit(10)


@query(
    """SELECT o_orderpriority AS job_title, count(*) AS jobs, floor(sum(o_totalprice) / count(*))::BIGINT AS mean_salary, count(DISTINCT o_custkey) AS companies
FROM orders WHERE o_totalprice > 0 GROUP BY o_orderpriority"""
)
def market_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, mean salary and companies for each title."""
    jobs = Graph(spark, sf_dir).jobs().where("max_salary > 0")
    mean = F.floor(F.sum("max_salary") / F.count("*")).cast("long")
    return jobs.groupBy("job_title").agg(F.count("*").alias("jobs"), mean.alias("mean_salary"), F.count_distinct("company_id").alias("companies"))


@query(
    """WITH scored AS (SELECT b.vec_id AS id, b.label AS kind, (1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2 AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0)
SELECT kind, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 5"""
)
def top_matches_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of each kind of node."""
    g = Graph(spark, sf_dir)
    probe = F.lit(list(g.vectors().where("id = 0").first()["v"])).cast("array<double>")
    rows = g.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), normalized_score(cosine(F.col("embedding").cast("array<double>"), probe)).alias("score"))
    best = Window.partitionBy("kind").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(best)).where("rank <= 5").select("kind", "id", "rank")
