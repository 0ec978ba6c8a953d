"""Queries over a stored graph that is loaded twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.lineage import shared_folder
from graphloom.plans.registry import query
from graphloom.sources.domain import SQL, Graph
from graphloom.sources.graph_store import Edges, Nodes


@query(
    f"""{SQL} SELECT skill_id, name, category, CASE WHEN skill_id % 7 = 0 THEN level + 100 ELSE level END AS level,
  CASE WHEN skill_id % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS created_at,
  CASE WHEN skill_id % 2 = 0 AND skill_id % 7 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS updated_at
FROM skill WHERE skill_id IS NOT NULL"""
)
def stored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills in hash buckets: a first load of the even ones, then one of all, in which every seventh has another level."""
    skills = Graph(spark, sf_dir).skills().select("skill_id", "name", "category", F.col("level").cast("int").alias("level"))
    store = Nodes(spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}", "skill_id", skills.schema)
    store.load(skills.where("skill_id % 2 = 0"), F.lit("2024-01-01").cast("timestamp"))
    level = F.when(F.col("skill_id") % 7 == 0, F.col("level") + 100).otherwise(F.col("level"))
    store.load(skills.withColumn("level", level), F.lit("2024-02-01").cast("timestamp"))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")}
    return store.rows().withColumns(times)


@query(f"{SQL} SELECT job_id AS src, skill_id AS dst, CASE WHEN skill_id % 3 = 0 THEN 'first' ELSE 'second' END AS source FROM requires")
def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REQUIRES in hash buckets: an edge that the first load made keeps its property in the second."""
    edges = Graph(spark, sf_dir).requires().select(F.col("job_id").alias("src"), F.col("skill_id").alias("dst"))
    rows = edges.withColumn("source", F.lit("first"))
    store = Edges(spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}", rows.schema)
    store.load(rows.where("dst % 3 = 0"))
    store.load(edges.withColumn("source", F.lit("second")))
    return store.rows()
