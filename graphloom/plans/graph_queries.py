"""Queries of vector search, similarity, traversal and graph statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vectors import normalized_score
from graphloom.operators import traverse, vector_search
from graphloom.plans.registry import query
from graphloom.sources.domain import SQL, Graph

#: The largest raw cosine of the synthetic vectors is about 0.5, so edges need a lower threshold here.
EDGE_THRESHOLD = 0.3


def _probe(g: Graph, vec_id: int = 0) -> list[float]:
    """The vector of one row: a query's own input, a single row."""
    return list(g.vectors().where(F.col("id") == vec_id).first()["v"])


def _similar(g: Graph) -> DataFrame:
    return vector_search.knn_graph(g.vectors(), EDGE_THRESHOLD)


def _seed_jobs(g: Graph) -> DataFrame:
    return g.jobs().orderBy(F.desc("max_salary"), "job_id").limit(50).select("job_id")


def _seed_skills(g: Graph) -> DataFrame:
    return vector_search.top_k(g.vectors(), _probe(g), 15, 0.5).select(F.col("id").alias("skill_id"))


_SCORES = "scored AS (SELECT b.id, (1 + list_cosine_similarity(a.v, b.v)) / 2 AS score FROM vec a, vec b WHERE a.id = 0)"


@query(f"{SQL}, {_SCORES} SELECT id, round(score, 6) AS score FROM scored ORDER BY score DESC, id LIMIT 25")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return vector_search.top_k(g.vectors(), _probe(g), 25).withColumn("score", F.round("score", 6))


@query(f"{SQL}, {_SCORES} SELECT id, round(score, 6) AS score FROM scored WHERE score > 0.6 ORDER BY score DESC, id LIMIT 100")
def vector_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return vector_search.top_k(g.vectors(), _probe(g), 100, 0.6).withColumn("score", F.round("score", 6))


@query(
    f"""{SQL}, {_SCORES}, lists AS (
  (SELECT 0 AS rank, 'Skill' AS node_type, id, score FROM scored JOIN embeddings ON id = vec_id WHERE label IN (0, 1, 2) AND score > 0.5 ORDER BY score DESC, id LIMIT 10) UNION ALL
  (SELECT 1, 'Job', id, score FROM scored JOIN embeddings ON id = vec_id WHERE label IN (3, 4, 5) AND score > 0.5 ORDER BY score DESC, id LIMIT 5) UNION ALL
  (SELECT 2, 'Company', id, score FROM scored JOIN embeddings ON id = vec_id WHERE label > 5 AND score > 0.5 ORDER BY score DESC, id LIMIT 5))
SELECT node_type, id, round(score, 6) AS score FROM lists ORDER BY score DESC, rank, id LIMIT 15"""
)
def vector_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    probe, rows = _probe(g), g.table("embeddings")
    group = lambda keep: rows.where(keep).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    label = F.col("label")
    parts = [("Skill", label.isin(0, 1, 2), 10), ("Job", label.isin(3, 4, 5), 5), ("Company", label > 5, 5)]
    return vector_search.hybrid([(name, vector_search.top_k(group(keep), probe, k, 0.5)) for name, keep, k in parts], 15).withColumn("score", F.round("score", 6))


@query(f"{SQL}, {_SCORES} SELECT id, name, category, subcategory, round(score, 6) AS score FROM scored LEFT JOIN skill ON id = skill_id WHERE score > 0.5 ORDER BY scored.score DESC, id LIMIT 20")
def vector_skill_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    found = vector_search.top_k(g.vectors(), _probe(g), 20, 0.5)
    return found.join(g.skills().withColumnRenamed("skill_id", "id"), "id", "left").select("id", "name", "category", "subcategory", F.round("score", 6).alias("score"))


@query(f"{SQL} SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM vec a JOIN vec b ON a.id = 7 AND b.id <> 7 ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id LIMIT 10")
def vector_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    near = vector_search.top_k(g.vectors().where("id <> 7"), _probe(g, 7), 10, mode="raw")
    return near.select(F.lit(7).cast("long").alias("src"), F.col("id").alias("dst"), F.round("score", 6).alias("cos"))


@query(f"{SQL} SELECT src, dst, round(score, 6) AS score FROM similar_to")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(Graph(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"{SQL} SELECT count(*) AS n_edges, count(DISTINCT src) AS n_src, count(*) FILTER (EXISTS (SELECT 1 FROM similar_to b WHERE b.src = a.dst AND b.dst = a.src)) AS n_mutual FROM similar_to a")
def knn_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _similar(Graph(spark, sf_dir)).select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    return edges.join(back, ["src", "dst"], "left").agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_src"), F.count("back").alias("n_mutual"))


_KHOP = """
walk AS (SELECT skill_id AS seed, skill_id AS node, 0 AS hops FROM seed_skill
  UNION SELECT seed, dst, hops + 1 FROM walk JOIN undirected ON node = src WHERE hops < {depth}),
khop AS (SELECT seed, node, min(hops) AS hops FROM walk GROUP BY seed, node HAVING min(hops) > 0)"""


@query(f"{SQL}, {_KHOP.format(depth=3)} SELECT seed, node, hops FROM khop")
def khop_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return traverse.khop(traverse.undirected(_similar(g)), _seed_skills(g), 3)


@query(
    f"""{SQL}, edge AS (SELECT src * 100000000 + dst AS edge_id, src, dst FROM similar_to),
trail AS (SELECT skill_id AS seed, skill_id AS node, 0 AS hops, []::BIGINT[] AS path FROM seed_skill
  UNION ALL SELECT seed, dst, hops + 1, list_append(path, edge_id) FROM trail JOIN edge ON node = src AND NOT list_contains(path, edge_id) WHERE hops < 3)
SELECT seed, node, hops, count(*) AS n_trails FROM trail WHERE hops > 0 GROUP BY ALL"""
)
def trail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    edges = _similar(g).select((F.col("src") * 100000000 + F.col("dst")).alias("edge_id"), "src", "dst")
    return traverse.trails(edges, _seed_skills(g), 3).groupBy("seed", "node", "hops").agg(F.count("*").alias("n_trails"))


@query(f"{SQL} SELECT job_id, skill_id, name, level, category, subcategory FROM seed_job JOIN requires USING (job_id) JOIN skill USING (skill_id)")
def traverse_skill_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return traverse.skill_requirement(_seed_jobs(g), g.requires(), g.skills())


@query(
    f"""{SQL}, {_KHOP.format(depth=2)}
SELECT seed AS skill_id, job_id, node AS similar_id, hops, name AS similar_name, category
FROM khop JOIN requires ON requires.skill_id = seed LEFT JOIN skill ON skill.skill_id = node"""
)
def traverse_career_path_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return traverse.career_path_from_skills(_seed_skills(g), _similar(g), g.requires(), g.skills(), 2)


@query(
    f"""{SQL}, own AS (SELECT job_id, skill_id FROM seed_job JOIN requires USING (job_id)),
walk AS (SELECT DISTINCT skill_id AS seed, skill_id AS node, 0 AS hops FROM own UNION SELECT seed, dst, hops + 1 FROM walk JOIN undirected ON node = src WHERE hops < 2),
khop AS (SELECT seed, node, min(hops) AS hops FROM walk GROUP BY seed, node HAVING min(hops) > 0)
SELECT own.job_id, r.job_id AS next_job_id, min(hops) AS hops, count(DISTINCT node) AS n_similar
FROM own JOIN khop ON own.skill_id = seed JOIN requires r ON r.skill_id = node WHERE own.job_id <> r.job_id GROUP BY own.job_id, r.job_id"""
)
def traverse_career_path_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return traverse.career_path_from_jobs(_seed_jobs(g), _similar(g), g.requires(), 2)


@query(
    f"""{SQL} SELECT job_id, job_title, max_salary, skill_id, name, company_name, location_name
FROM seed_job JOIN job USING (job_id) JOIN requires USING (job_id) JOIN skill USING (skill_id) JOIN company USING (company_id) LEFT JOIN location USING (location_id)
ORDER BY max_salary DESC NULLS FIRST, job_id, skill_id LIMIT 500"""
)
def traverse_salary_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return traverse.salary_analysis(_seed_jobs(g), g.jobs(), g.requires(), g.skills(), g.companies(), g.locations())


@query(f"{SQL}, {_KHOP.format(depth=2)} SELECT skill_id, node AS similar_id, hops, name, category, subcategory FROM seed_skill LEFT JOIN khop ON seed = skill_id LEFT JOIN skill USING (skill_id)")
def traverse_skill_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return traverse.skill_relationship(_seed_skills(g), _similar(g), g.skills(), 2)


@query(
    f"""{SQL}, employer AS (SELECT DISTINCT company_id FROM seed_job JOIN job USING (job_id))
SELECT company_id, company_name, location_name, count(DISTINCT job.job_id) AS n_jobs, count(DISTINCT requires.skill_id) AS n_skills
FROM employer JOIN job USING (company_id) LEFT JOIN requires USING (job_id) JOIN company USING (company_id) LEFT JOIN location USING (location_id) GROUP BY ALL"""
)
def traverse_company_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return traverse.company_query(_seed_jobs(g), g.jobs(), g.requires(), g.companies(), g.locations())


_SHAPED = """
hit AS (SELECT job_id, job_title, skill_id, name, category, company_id, company_name, location_id, location_name
  FROM seed_job JOIN job USING (job_id) JOIN requires USING (job_id) JOIN skill USING (skill_id) JOIN company USING (company_id) LEFT JOIN location USING (location_id)),
rel AS (SELECT 'REQUIRES' AS rel_type, job_id::VARCHAR AS src, skill_id::VARCHAR AS dst FROM hit UNION SELECT 'POSTED_BY', job_id::VARCHAR, company_id::VARCHAR FROM hit
  UNION SELECT 'LOCATED_IN', job_id::VARCHAR, location_id::VARCHAR FROM hit UNION SELECT 'BELONGS_TO_CATEGORY', skill_id::VARCHAR, category FROM hit)"""


def _hits(g: Graph) -> DataFrame:
    rows = _seed_jobs(g).join(g.jobs(), "job_id").join(g.requires(), "job_id").join(g.skills(), "skill_id")
    return rows.join(g.companies(), "company_id").join(g.locations(), "location_id", "left")


@query(
    f"""{SQL}, {_SHAPED} SELECT 'Job' AS node_type, job_id::VARCHAR AS id, job_title AS name FROM hit UNION SELECT 'Skill', skill_id::VARCHAR, name FROM hit
UNION SELECT 'Company', company_id::VARCHAR, company_name FROM hit UNION SELECT 'Location', location_id::VARCHAR, location_name FROM hit UNION SELECT 'Category', category, category FROM hit"""
)
def graph_shape_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = _hits(Graph(spark, sf_dir))
    return traverse.shape_nodes(
        Job=hit.select("job_id", "job_title"), Skill=hit.select("skill_id", "name"), Company=hit.select("company_id", "company_name"),
        Location=hit.select("location_id", "location_name"), Category=hit.select("category", F.col("category").alias("name")),
    )


def _relationships(g: Graph) -> DataFrame:
    hit = _hits(g)
    return traverse.shape_relationships(
        REQUIRES=hit.select("job_id", "skill_id"), POSTED_BY=hit.select("job_id", "company_id"), LOCATED_IN=hit.select("job_id", "location_id"), BELONGS_TO_CATEGORY=hit.select("skill_id", "category")
    )


@query(f"{SQL}, {_SHAPED} SELECT rel_type, src, dst FROM rel")
def graph_shape_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relationships(Graph(spark, sf_dir))


@query(f"{SQL}, {_SHAPED} SELECT rel_type, count(*) AS n FROM rel GROUP BY rel_type ORDER BY n DESC, rel_type LIMIT 5")
def rel_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relationships(Graph(spark, sf_dir)).groupBy("rel_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel_type").limit(5)


@query(f"{SQL} SELECT company_id, company_name, count(job_id) AS job_count FROM company LEFT JOIN job USING (company_id) GROUP BY ALL")
def company_job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    counts = g.jobs().groupBy("company_id").agg(F.count("job_id").alias("job_count"))
    return g.companies().join(counts, "company_id", "left").select("company_id", "company_name", F.coalesce("job_count", F.lit(0)).alias("job_count"))


@query(f"{SQL} SELECT skill_id, name, count(*) AS demand FROM requires JOIN skill USING (skill_id) GROUP BY ALL")
def skill_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return g.requires().groupBy("skill_id").agg(F.count("*").alias("demand")).join(g.skills(), "skill_id").select("skill_id", "name", "demand")


@query(
    f"""{SQL} SELECT 'Skill' AS label, count(*) AS n FROM skill UNION ALL SELECT 'Job', count(*) FROM job UNION ALL SELECT 'Company', count(*) FROM company
UNION ALL SELECT 'Location', count(*) FROM location UNION ALL SELECT 'REQUIRES', count(*) FROM requires"""
)
def database_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    frames = {"Skill": g.skills(), "Job": g.jobs(), "Company": g.companies(), "Location": g.locations(), "REQUIRES": g.requires()}
    found = None
    for label, df in frames.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        found = part if found is None else found.unionByName(part)
    return found


@query(
    f"""{SQL}, last AS (SELECT max(posted_at) AS latest FROM job)
SELECT latest, date_diff('day', latest::DATE, DATE '2000-01-01') AS days, CASE WHEN latest IS NULL THEN 'never' WHEN date_diff('day', latest::DATE, DATE '2000-01-01') <= 0 THEN 'today'
 WHEN date_diff('day', latest::DATE, DATE '2000-01-01') = 1 THEN '1 day ago' ELSE date_diff('day', latest::DATE, DATE '2000-01-01') || ' days ago' END AS age FROM last"""
)
def graph_stats_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = Graph(spark, sf_dir).jobs().agg(F.max("posted_at").alias("latest"))
    days = F.datediff(F.lit("2000-01-01").cast("date"), F.col("latest").cast("date"))
    age = F.when(F.col("latest").isNull(), "never").when(days <= 0, "today").when(days == 1, "1 day ago").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    return latest.select("latest", days.alias("days"), age.alias("age"))


@query(
    f"""{SQL} SELECT category, count(*) AS total, count(id) AS with_embedding, round(count(id) / count(*) * 100, 2) AS coverage_pct FROM skill LEFT JOIN vec ON id = skill_id GROUP BY category"""
)
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return vector_search.coverage(g.skills(), g.vectors(), "skill_id", "category")


@query(f"{SQL} SELECT len(v) AS dimension, count(*) AS n FROM vec GROUP BY 1")
def embedding_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.dimensions(Graph(spark, sf_dir).vectors())


@query(f"{SQL} SELECT count(*) AS n_invalid FROM vec WHERE v IS NULL OR len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 OR len(list_filter(v, lambda x: x <> 0)) = 0")
def embedding_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.invalid(Graph(spark, sf_dir).vectors()).agg(F.count("*").alias("n_invalid"))


@query(f"{SQL} SELECT (pos - 1)::INTEGER AS position, round(avg(v[pos]), 6) AS mean FROM vec, unnest(range(1, 65)) t(pos) GROUP BY pos")
def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.mean_vector(Graph(spark, sf_dir).vectors()).withColumn("mean", F.round("mean", 6))


@query(
    """SELECT a.vec_id AS src, b.vec_id AS dst, round((1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2, 6) AS score
FROM embeddings a JOIN embeddings b ON a.label = 0 AND b.label = 1
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 3"""
)
def cross_type_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of a second label for each of a first, here of label 1 for label 0."""
    g = Graph(spark, sf_dir)
    of = lambda label: g.table("embeddings").where(F.col("label") == label).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    near = vector_search.nearest(of(0), of(1), None, 3, clipped=False)
    return near.select("src", "dst", F.round(normalized_score(F.col("score")), 6).alias("score"))


_NODES = """node AS (SELECT 'Job' AS node_type, job_id::VARCHAR AS id FROM hit UNION SELECT 'Skill', skill_id::VARCHAR FROM hit UNION SELECT 'Company', company_id::VARCHAR FROM hit
  UNION SELECT 'Location', location_id::VARCHAR FROM hit UNION SELECT 'Category', category FROM hit)"""
_SOURCES = f"""{_NODES}, source AS (SELECT node_type, id, min(place) AS place FROM (SELECT 'Skill' AS node_type, skill_id::VARCHAR AS id, 1 AS place FROM seed_skill UNION ALL SELECT node_type, id, 2 FROM node) GROUP BY ALL)"""


@query(
    f"""{SQL}, {_SHAPED}, {_NODES} SELECT 'node' AS part, node_type AS kind, count(*) AS n FROM node GROUP BY node_type
UNION ALL (SELECT 'rel', rel_type, count(*) AS n FROM rel GROUP BY rel_type ORDER BY n DESC, rel_type LIMIT 5)"""
)
def context_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of a context: nodes of each type, and the five most frequent types of relationship."""
    nodes = graph_shape_nodes(spark, sf_dir).groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n"))
    rels = rel_type_histogram(spark, sf_dir).withColumnRenamed("rel_type", "kind")
    return nodes.select(F.lit("node").alias("part"), "kind", "n").unionByName(rels.withColumn("part", F.lit("rel")))


@query(f"{SQL}, {_SHAPED} SELECT rel_type, count(*) AS n FROM (SELECT * FROM rel ORDER BY rel_type, src, dst LIMIT 50) GROUP BY rel_type")
def context_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the first 50 relationships that a context shows."""
    return _relationships(Graph(spark, sf_dir)).orderBy("rel_type", "src", "dst").limit(50).groupBy("rel_type").agg(F.count("*").alias("n"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _seed_skills(Graph(spark, sf_dir)).select(F.lit("Skill").alias("node_type"), F.col("skill_id").cast("string").alias("id"), F.lit("vector").alias("origin"))
    nodes = graph_shape_nodes(spark, sf_dir).select("node_type", F.col("id").cast("string").alias("id"), F.lit("graph").alias("origin"))
    return found.unionByName(nodes).groupBy("node_type", "id").agg(F.max("origin").alias("origin"))


@query(f"{SQL}, {_SHAPED}, {_SOURCES} SELECT node_type, id, CASE place WHEN 1 THEN 'vector' ELSE 'graph' END AS origin FROM source")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that an answer rests on, each once; what the vector search found comes before the graph's."""
    return _sources(spark, sf_dir)


@query(
    f"""{SQL}, {_SHAPED}, {_SOURCES}, n AS (SELECT count(*) FILTER (node_type = 'Job') AS j, count(*) FILTER (node_type = 'Skill') AS s, count(*) FILTER (node_type = 'Company') AS c FROM source)
SELECT 'Based on ' || j || ' jobs, ' || s || ' skills, and ' || c || ' companies' AS summary FROM n"""
)
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence with the number of sources of each type."""
    count = lambda kind: F.count(F.when(F.col("node_type") == kind, 1)).cast("string")
    text = F.concat(F.lit("Based on "), count("Job"), F.lit(" jobs, "), count("Skill"), F.lit(" skills, and "), count("Company"), F.lit(" companies"))
    return _sources(spark, sf_dir).agg(text.alias("summary"))
