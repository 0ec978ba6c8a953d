"""The job-market graph over the driver's tables: one frame for each node label and edge type.

Jobs are orders, skills are parts, REQUIRES is the distinct pairs of lineitem, companies
are customers, locations nations, categories brands, subcategories part types, and a
part's vector is the embedding with its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Graph:
    """Lazy frames; nothing is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def jobs(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("job_title"), F.col("o_totalprice").alias("max_salary"),
            F.col("o_orderdate").alias("posted_at"), F.col("o_custkey").alias("company_id"),
        )

    def skills(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("name"), F.col("p_size").alias("level"), F.col("p_brand").alias("category"), F.col("p_type").alias("subcategory")
        )

    def requires(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id")).distinct()

    def companies(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"), F.col("c_nationkey").alias("location_id"), F.col("c_mktsegment").alias("industry"))

    def locations(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("location_name"))

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


#: The same views for DuckDB; a query's SQL starts with this.
SQL = """
WITH RECURSIVE job AS (SELECT o_orderkey AS job_id, o_orderpriority AS job_title, o_totalprice AS max_salary, o_orderdate AS posted_at, o_custkey AS company_id FROM orders),
skill AS (SELECT p_partkey AS skill_id, p_name AS name, p_size AS level, p_brand AS category, p_type AS subcategory FROM part),
requires AS (SELECT DISTINCT l_orderkey AS job_id, l_partkey AS skill_id FROM lineitem),
company AS (SELECT c_custkey AS company_id, c_name AS company_name, c_nationkey AS location_id, c_mktsegment AS industry FROM customer),
location AS (SELECT n_nationkey AS location_id, n_name AS location_name FROM nation),
vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
seed_job AS (SELECT job_id FROM job ORDER BY max_salary DESC, job_id LIMIT 50),
pair AS (SELECT a.id AS src, b.id AS dst, least(1.0, greatest(0.0, list_cosine_similarity(a.v, b.v))) AS score FROM vec a JOIN vec b ON a.id <> b.id),
similar_to AS (SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rn FROM pair WHERE score > 0.3) WHERE rn <= 5),
undirected AS (SELECT src, dst FROM similar_to UNION SELECT dst, src FROM similar_to),
seed_skill AS (SELECT dst AS skill_id FROM (SELECT b.id AS dst, (1 + list_cosine_similarity(a.v, b.v)) / 2 AS s FROM vec a, vec b WHERE a.id = 0) WHERE s > 0.5 ORDER BY s DESC, dst LIMIT 15)
"""
