"""Queries of the inverted-list index and of text vectors; results are approximate or hashed, so tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vectors import normalized_score
from graphloom.operators import questions, text_search, text_vectors, vector_index
from graphloom.operators.lineage import cut_lineage
from graphloom.plans.graph_queries import EDGE_THRESHOLD
from graphloom.plans.question_queries import asked
from graphloom.plans.registry import query
from graphloom.sources.domain import Graph

#: Recall that the indexed queries are tuned to.
GOAL = 0.95


@query()
def knn_graph_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity graph of all vectors by inverted lists."""
    found = vector_index.knn_graph(Graph(spark, sf_dir).vectors(), EDGE_THRESHOLD, 5, GOAL)
    return found.select("src", "dst", F.round("score", 6).alias("score"))


@query()
def vector_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nearest of all vectors for each of a table of queries: those whose id is divisible by 100."""
    vectors = Graph(spark, sf_dir).vectors()
    index = vector_index.build(vectors)
    found = vector_index.search(index, vectors.where(F.col("id") % 100 == 0), 25, vector_index.tune(index, 25, GOAL))
    return found.select("src", "dst", F.round(normalized_score(F.col("score")), 6).alias("score"))


@query()
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of 384 numbers for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return text_vectors.embed_texts(docs).select("doc_id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


#: What people ask when they mean an intent: five questions each, whose mean vector stands for it.
EXAMPLES = {
    "career_path": ("how to become a data scientist", "how do I become a data scientist", "how to become a scientist", "what is the path to become a data engineer", "how to become a manager"),
    "company_query": ("which companies hire for React", "which companies hire at Google or IBM", "which companies hire engineers", "what companies hire for React and Java", "companies that hire at Google"),
    "salary_analysis": ("what do they pay a software engineer", "what do they pay for SQL", "what do they pay an engineer for Java", "how much do they pay a software engineer for SQL", "pay of a software engineer"),
    "skill_relationship": ("what skills are similar to Python", "what skills are similar to Java", "which skills are similar to Java or Python", "Java vs Python", "skills similar to Java or SQL"),
    "skill_requirement": ("should I learn Go", "should I learn AWS", "should I learn Go and AWS for the cloud", "should I learn Docker", "what should I learn for AWS"),
}


def _examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(intent, text) for intent, texts in EXAMPLES.items() for text in texts], "intent string, text string")


def _embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All questions, and the intents' examples, with vectors whose weights all of these texts give."""
    # the texts are few bytes and much work, and may lie in one file
    rows, examples = asked(spark, sf_dir).repartition("id"), _examples(spark)
    weight = text_vectors.weights(rows.select("text").unionByName(examples.select("text")), "text")
    return text_vectors.embed_texts(rows, weight=weight), text_vectors.embed_texts(examples, weight=weight)


def _text_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, examples = _embedded(spark, sf_dir)
    return questions.alike(rows, questions.archetypes(examples.select("intent", "v")), "id")


@query()
def semantic_intents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents whose examples a question's text is like, for parts' questions and every conversation turn, at the default thresholds."""
    return _text_intents(spark, sf_dir).withColumn("score", F.round("score", 6))


@query()
def refined_intents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of texts' vectors and of patterns together, for all questions."""
    rows = asked(spark, sf_dir).repartition("id")
    syntactic = rows.select("id", F.explode(questions.intents(F.col("text"))).alias("intent"))
    ranked = questions.refined(_text_intents(spark, sf_dir), syntactic, questions.entities(rows, "id"), "id")
    return ranked.withColumn("score", F.round("score", 6))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(kind, name)``: names that a question can mean."""
    read = lambda name, kind, column: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.lit(kind).alias("kind"), F.col(column).alias("name"))
    every = read("part", "skill", "p_name").unionByName(read("orders", "job", "o_orderpriority")).unionByName(read("customer", "company", "c_name"))
    return every.where("name IS NOT NULL").distinct()


def _near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, kind, name, score, rank)``: the nearest names of each kind for every question, of those that score enough for an entity."""
    rows, names = asked(spark, sf_dir), cut_lineage(_names(spark, sf_dir))
    weight = text_vectors.weights(rows.select("text").unionByName(names.select(F.col("name").alias("text"))), "text")
    # equal texts are asked once, and written once for all kinds
    texts = cut_lineage(rows.select("text").where("text IS NOT NULL").distinct().select(F.xxhash64("text").alias("id"), "text"))
    found = None
    for kind, (most, least, _, _) in questions.NEAREST.items():
        # a score is (1 + cosine) / 2, which rounds
        near = text_search.nearest_names(texts, names.where(F.col("kind") == kind).select(F.col("name").alias("text")), weight, 2 * least - 1 - 1e-12, most)
        near = near.withColumn("kind", F.lit(kind))
        found = near if found is None else found.unionByName(near)
    ranked = found.withColumn("score", normalized_score(F.col("score")))
    return rows.select("id", F.xxhash64("text").alias("src")).join(ranked, "src").select("id", "kind", "name", "score", "rank")


@query()
def semantic_entities_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills, jobs and companies whose names a question's text is like, for all questions, at the default thresholds."""
    return questions.near_entities(_near_names(spark, sf_dir), "id").withColumn("confidence", F.round("confidence", 6))


@query()
def ranked_entities_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of vectors and of patterns for all questions, each once, best first."""
    semantic = questions.near_entities(_near_names(spark, sf_dir), "id")
    found = questions.best_entities({"semantic": semantic, "pattern": questions.entities(asked(spark, sf_dir), "id")}, "id")
    return found.withColumn("confidence", F.round("confidence", 6))
