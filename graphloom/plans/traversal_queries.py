"""Queries of the traversal for a table of questions, and of the rules that skip some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import question_graph, questions, skillpaths
from graphloom.plans.graph_queries import _similar
from graphloom.plans.question_queries import _ASCII, _MATCHED, asked
from graphloom.plans.registry import query
from graphloom.sources.domain import SQL, Graph

#: A question about a part has the part and the two after it as its seeds if its number modulo 8 is 0, 6 or 7, else the jobs that
#: require the part; a conversation turn has the jobs of the company with the conversation's number.
_SEEDS = """found AS (
  SELECT concat('part-', p_partkey) AS question, k AS place, 'Skill' AS node_type, p_partkey + k AS node FROM part, range(3) t(k) WHERE p_partkey % 8 IN (0, 6, 7)
  UNION ALL SELECT concat('part-', skill_id), job_id, 'Job', job_id FROM requires WHERE skill_id % 8 NOT IN (0, 6, 7)
  UNION ALL SELECT concat('turn-', conv_id, '-', turn), job_id, 'Job', job_id FROM conversations JOIN job ON company_id = conv_id),
typed AS (SELECT *, first(node_type) OVER w AS first_type FROM found WINDOW w AS (PARTITION BY question ORDER BY place, node_type, node)),
seed AS (SELECT question, node_type, node FROM typed WHERE node_type = first_type QUALIFY row_number() OVER (PARTITION BY question ORDER BY place, node) <= 50)"""
_INTENTS = f"""{_ASCII}, intent AS (SELECT id AS question, unnest(string_split(nullif(concat_ws(',', {_MATCHED}), ''), ',')) AS intent FROM asked),
task AS (SELECT question, intent, node_type, node FROM intent JOIN seed USING (question))"""


def _found(g: Graph) -> DataFrame:
    part = g.skills().select("skill_id")
    own = F.col("skill_id") % 8
    skills = part.where(own.isin(0, 6, 7)).select(F.concat(F.lit("part-"), "skill_id").alias("question"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("place"), "skill_id")
    skills = skills.select("question", "place", F.lit("Skill").alias("node_type"), (F.col("skill_id") + F.col("place")).alias("node"))
    jobs = g.requires().where(~own.isin(0, 6, 7)).select(F.concat(F.lit("part-"), "skill_id").alias("question"), F.col("job_id").alias("place"), F.lit("Job").alias("node_type"), F.col("job_id").alias("node"))
    turns = g.table("conversations").select(F.concat(F.lit("turn-"), "conv_id", F.lit("-"), "turn").alias("question"), F.col("conv_id").alias("company_id"))
    turns = turns.join(g.jobs().select("company_id", "job_id"), "company_id").select("question", F.col("job_id").alias("place"), F.lit("Job").alias("node_type"), F.col("job_id").alias("node"))
    return skills.unionByName(jobs).unionByName(turns)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select(F.col("id").alias("question"), questions.intents(F.col("text")).alias("intents"))


@query(
    f"""{SQL}, {_SEEDS}, {_INTENTS},
start AS (
  SELECT DISTINCT node AS s FROM task WHERE node_type = 'Skill' AND intent IN ('career_path', 'skill_relationship')
  UNION SELECT skill_id FROM task JOIN requires ON job_id = node WHERE node_type = 'Job' AND intent = 'career_path'),
walk AS (SELECT s, s AS t, 0 AS hops FROM start UNION SELECT s, dst, hops + 1 FROM walk JOIN undirected ON t = src WHERE hops < 2),
near AS (SELECT DISTINCT s, t FROM walk WHERE s <> t),
wanted AS (SELECT question, intent, job_id, skill_id FROM task JOIN requires ON job_id = node WHERE node_type = 'Job'),
skilled AS (SELECT DISTINCT skill_id FROM requires),
onward AS (
  SELECT question, intent, s, t FROM task JOIN near ON s = node WHERE node_type = 'Skill' AND (intent = 'skill_relationship' OR (intent = 'career_path' AND s IN (FROM skilled)))
  UNION SELECT question, intent, s, t FROM wanted JOIN near ON s = skill_id WHERE intent = 'career_path' AND t IN (FROM skilled)),
goes AS (
  SELECT question, intent, s AS skill_id FROM onward JOIN task USING (question, intent) WHERE intent = 'career_path' AND node_type = 'Skill' AND node = s
  UNION SELECT question, intent, t FROM onward JOIN task USING (question, intent) WHERE intent = 'career_path' AND node_type = 'Job'),
wants AS (
  SELECT question, intent, job_id, skill_id FROM wanted WHERE intent IN ('skill_requirement', 'career_path', 'salary_analysis')
  UNION SELECT question, intent, job_id, skill_id FROM goes JOIN requires USING (skill_id)
  UNION SELECT question, intent, r.job_id, r.skill_id FROM (SELECT DISTINCT question, intent, company_id FROM wanted JOIN job USING (job_id) WHERE intent = 'company_query') JOIN job j USING (company_id) JOIN requires r ON r.job_id = j.job_id),
employed AS (SELECT DISTINCT question, intent, job_id, company_id, location_id FROM wanted JOIN job USING (job_id) JOIN company USING (company_id) WHERE intent IN ('salary_analysis', 'company_query')),
posts AS (
  SELECT question, intent, job_id, company_id FROM employed
  UNION SELECT question, intent, job.job_id, company_id FROM (SELECT DISTINCT question, intent, company_id FROM employed WHERE intent = 'company_query') JOIN job USING (company_id)),
made AS (
  SELECT question, intent, 'node' AS kind, 'Job' AS type, job_id::VARCHAR AS id, NULL::VARCHAR AS dst FROM wants
  UNION ALL SELECT question, intent, 'node', 'Skill', skill_id::VARCHAR, NULL FROM wants UNION ALL SELECT question, intent, 'relationship', 'REQUIRES', job_id::VARCHAR, skill_id::VARCHAR FROM wants
  UNION ALL SELECT question, intent, 'node', 'Skill', s::VARCHAR, NULL FROM onward UNION ALL SELECT question, intent, 'node', 'Skill', t::VARCHAR, NULL FROM onward
  UNION ALL SELECT question, intent, 'relationship', 'SIMILAR_TO', s::VARCHAR, t::VARCHAR FROM onward
  UNION ALL SELECT question, intent, 'node', 'Skill', node::VARCHAR, NULL FROM task WHERE node_type = 'Skill' AND intent = 'skill_relationship'
  UNION ALL SELECT question, intent, 'node', 'Job', job_id::VARCHAR, NULL FROM posts UNION ALL SELECT question, intent, 'node', 'Company', company_id::VARCHAR, NULL FROM posts
  UNION ALL SELECT question, intent, 'relationship', 'POSTED_BY', job_id::VARCHAR, company_id::VARCHAR FROM posts
  UNION ALL SELECT question, intent, 'node', 'Location', location_id::VARCHAR, NULL FROM employed WHERE location_id IS NOT NULL
  UNION ALL SELECT question, intent, 'relationship', 'LOCATED_IN', job_id::VARCHAR, location_id::VARCHAR FROM employed WHERE location_id IS NOT NULL),
merged AS (SELECT question, kind, type, id, dst, string_agg(DISTINCT intent, ',' ORDER BY intent) AS intents FROM made GROUP BY question, kind, type, id, dst),
capped AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY question, kind ORDER BY type, id, dst) <= CASE kind WHEN 'node' THEN 500 ELSE 1000 END)
SELECT question, kind, type, intents, count(*) AS n, min(concat_ws('>', id, dst)) AS first, max(concat_ws('>', id, dst)) AS last FROM capped GROUP BY question, kind, type, intents"""
)
def questions_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question's seeds and intents lead to in the graph, by type: how many, the first and the last; for parts' questions and conversation turns."""
    g = Graph(spark, sf_dir)
    market = question_graph.Market(g.requires(), _similar(g).select("src", "dst"), g.jobs(), g.companies())
    return question_graph.summary(_questions(spark, sf_dir), _found(g), market)


@query(
    f"""{SQL}, {_SEEDS}, {_INTENTS}
SELECT id AS question, CASE WHEN id NOT IN (SELECT question FROM seed) THEN 'no results' WHEN id NOT IN (SELECT question FROM intent) THEN 'general' ELSE 'traverse' END AS rule FROM asked"""
)
def question_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions are traversed, and why the others are not: the search found nothing, or no intent says where to go."""
    rows = _questions(spark, sf_dir)
    some = question_graph.seeds_of(_found(Graph(spark, sf_dir))).select("question", F.lit(True).alias("found")).distinct()
    rule = F.when(F.col("found").isNull(), "no results").when(~F.exists("intents", lambda i: ~i.isin(*question_graph.GENERAL)), "general").otherwise("traverse")
    return rows.join(some, "question", "left").select("question", rule.alias("rule"))


_NETWORK = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in skillpaths.INTENTS.items())


@query(f"WITH {_ASCII} SELECT id AS question, CASE {_NETWORK} ELSE 'general' END AS intent FROM asked")
def question_network_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question about a part, and each conversation turn, asks of the network of skills."""
    return asked(spark, sf_dir).select(F.col("id").alias("question"), skillpaths.intent(F.col("text")).alias("intent"))
