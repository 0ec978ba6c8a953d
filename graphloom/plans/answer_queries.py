"""Queries of searches with their decorations, merged traversals and the sections of a context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import and_others, iso_time, lakhs, truncated
from graphloom.operators import context, traverse, vector_search
from graphloom.plans.graph_queries import _SCORES, _probe, _seed_jobs
from graphloom.plans.registry import query
from graphloom.sources.domain import SQL, Graph

#: A job's vector is that of its number, a company's that of its.
_FOUND = f"{SQL}, {_SCORES}"


@query(
    f"""{_FOUND} SELECT job_id, job_title, company_name, location_name, max_salary, round(score, 6) AS score FROM scored JOIN job ON job_id = id LEFT JOIN company USING (company_id) LEFT JOIN location USING (location_id)
WHERE score > 0.5 ORDER BY scored.score DESC, id LIMIT 20"""
)
def vector_job_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest jobs with their company, location and pay."""
    g = Graph(spark, sf_dir)
    near = vector_search.top_k(g.vectors().join(g.jobs().select(F.col("job_id").alias("id")), "id", "left_semi"), _probe(g), 20, 0.5)
    rows = near.join(g.jobs().withColumnRenamed("job_id", "id"), "id").join(g.companies(), "company_id", "left").join(g.locations(), "location_id", "left")
    return rows.select(F.col("id").alias("job_id"), "job_title", "company_name", "location_name", "max_salary", F.round("score", 6).alias("score"))


@query(
    f"""{_FOUND} SELECT company_id, company_name, industry, (SELECT count(*) FROM job WHERE job.company_id = c.company_id) AS job_count, round(score, 6) AS score FROM scored JOIN company c ON c.company_id = id
WHERE score > 0.5 ORDER BY scored.score DESC, id LIMIT 20"""
)
def vector_company_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest companies with the number of their jobs, 0 where there are none."""
    g = Graph(spark, sf_dir)
    near = vector_search.top_k(g.vectors().join(g.companies().select(F.col("company_id").alias("id")), "id", "left_semi"), _probe(g), 20, 0.5).withColumnRenamed("id", "company_id")
    counts = g.jobs().join(near.select("company_id"), "company_id", "left_semi").groupBy("company_id").agg(F.count("job_id").alias("job_count"))
    rows = near.join(g.companies(), "company_id").join(counts, "company_id", "left")
    return rows.select("company_id", "company_name", "industry", F.coalesce("job_count", F.lit(0)).alias("job_count"), F.round("score", 6).alias("score"))


@query(
    f"""{SQL}, own AS (SELECT job_id, company_id FROM seed_job JOIN job USING (job_id)), other AS (SELECT company_id, job.job_id, job_title FROM (SELECT DISTINCT company_id FROM own) JOIN job USING (company_id)),
rel AS (SELECT company_id, 'other_job' AS relation, job_id AS id, job_title AS name FROM other UNION SELECT company_id, 'required_skill', skill_id, name FROM own JOIN requires USING (job_id) JOIN skill USING (skill_id)
  UNION SELECT company_id, 'related_skill', skill_id, name FROM other JOIN requires USING (job_id) JOIN skill USING (skill_id))
SELECT company_id, company_name, relation, id, name FROM rel JOIN company USING (company_id) ORDER BY company_id, relation, id LIMIT 500"""
)
def company_query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the seed jobs' companies offer and ask for, the first 500 rows."""
    g = Graph(spark, sf_dir)
    return traverse.company_rows(_seed_jobs(g), g.jobs(), g.requires(), g.skills(), g.companies())


_FOUND_NODES = f"""{_FOUND}, kinds AS (SELECT 'Skill' AS node_type, skill_id AS id, name, NULL AS company_name, NULL::DOUBLE AS min_salary, NULL::DOUBLE AS max_salary, category, 'A ' || subcategory || ' skill of level ' || level || repeat('.', 120) AS description FROM skill
  UNION ALL SELECT 'Job', job_id, job_title, company_name, max_salary * 0.75, max_salary, NULL, NULL FROM job JOIN company USING (company_id) UNION ALL SELECT 'Company', company_id, company_name, company_name, NULL, NULL, NULL, NULL FROM company),
found AS (SELECT *, row_number() OVER (ORDER BY score DESC, node_type, id) AS place FROM scored JOIN kinds USING (id) WHERE score > 0.5 QUALIFY place <= 15)"""


def _found(g: Graph) -> DataFrame:
    """The 15 nearest skills, jobs and companies, in order."""
    nothing, amount = F.lit(None).cast("string"), F.lit(None).cast("double")
    described = F.concat(F.lit("A "), "subcategory", F.lit(" skill of level "), F.col("level").cast("string"), F.repeat(F.lit("."), F.lit(120)))
    skills = g.skills().select(F.lit("Skill").alias("node_type"), F.col("skill_id").alias("id"), "name", nothing.alias("company_name"), amount.alias("min_salary"), amount.alias("max_salary"), "category", described.alias("description"))
    jobs = g.jobs().join(g.companies(), "company_id").select(F.lit("Job").alias("node_type"), F.col("job_id").alias("id"), F.col("job_title").alias("name"), "company_name", (F.col("max_salary") * 0.75).alias("min_salary"), "max_salary", nothing.alias("category"), nothing.alias("description"))
    companies = g.companies().select(F.lit("Company").alias("node_type"), F.col("company_id").alias("id"), F.col("company_name").alias("name"), "company_name", amount.alias("min_salary"), amount.alias("max_salary"), nothing.alias("category"), nothing.alias("description"))
    # of each type the nearest vectors of that type: three lists of 15, merged
    probe = _probe(g)
    lists = []
    for df in (skills, jobs, companies):
        near = vector_search.top_k(g.vectors().join(df.select("id").distinct(), "id", "left_semi"), probe, 15, 0.5)
        lists.append(df.join(near, "id"))
    merged = lists[0].unionByName(lists[1]).unionByName(lists[2]).orderBy(F.desc("score"), "node_type", "id").limit(15)
    ordered = merged.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "node_type", "id", *[c for c in merged.columns if c not in ("node_type", "id")]))).alias("r"))  # 15 rows
    return ordered.select(F.posexplode("r").alias("k", "r")).select((F.col("k") + 1).alias("place"), "r.*").drop("s")


@query(
    f"""{_FOUND_NODES}, shown AS (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY place) AS rank FROM found WHERE place <= 10),
pay AS (SELECT *, CASE WHEN min_salary > 100000 THEN format('{{:,.1f}} LPA', round(min_salary / 100000, 1)) ELSE format('{{:,.0f}}', min_salary) END AS lo, CASE WHEN max_salary > 100000 THEN format('{{:,.1f}} LPA', round(max_salary / 100000, 1)) ELSE format('{{:,.0f}}', max_salary) END AS hi FROM shown)
SELECT node_type, rank, CASE node_type WHEN 'Job' THEN name || ' at ' || company_name || ' (' || lo || ' to ' || hi || ')' WHEN 'Skill' THEN name || ' (' || category || '): ' || left(description, 100) || '...' ELSE name END AS line
FROM pay WHERE rank <= CASE node_type WHEN 'Skill' THEN 8 ELSE 5 END"""
)
def context_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a context's matches: of the first ten up to five jobs, eight skills and five companies."""
    return context.top_matches(_found(Graph(spark, sf_dir)))


@query(
    f"""{_FOUND_NODES}, g AS (SELECT DISTINCT name FROM (SELECT name FROM found WHERE node_type = 'Skill' UNION ALL SELECT name FROM seed_job JOIN requires USING (job_id) JOIN skill USING (skill_id)) WHERE lower(name) NOT IN (SELECT lower(name) FROM skill WHERE skill_id < 10))
SELECT (SELECT string_agg(name, ', ' ORDER BY name) FROM (SELECT name FROM g ORDER BY name LIMIT 10)) AS skills, count(*) AS missing, CASE WHEN count(*) = 0 THEN 'on the right track' WHEN count(*) <= 5 THEN 'focus on ' || count(*) WHEN count(*) <= 10 THEN 'first 5 of ' || count(*) ELSE '3 to 5 of ' || count(*) END AS advice FROM g"""
)
def context_skill_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills found and required by the seed jobs that a person lacks, and advice by how many they are."""
    g = Graph(spark, sf_dir)
    wanted = _seed_jobs(g).join(g.requires(), "job_id").join(g.skills(), "skill_id").select("name")
    return context.skill_gap(_found(g).where("node_type = 'Skill'").select("name").unionByName(wanted), g.skills().where("skill_id < 10").select("name"))


@query(
    f"""{_FOUND_NODES}, m AS (SELECT count(*) FILTER (node_type = 'Job') AS jobs, count(*) FILTER (node_type = 'Job' AND min_salary <> 0 AND max_salary <> 0) AS paid, floor(sum(min_salary) FILTER (node_type = 'Job') / count(*) FILTER (node_type = 'Job')) AS lo,
  floor(sum(max_salary) FILTER (node_type = 'Job') / count(*) FILTER (node_type = 'Job')) AS hi, list_sort(list_distinct(list(company_name) FILTER (company_name IS NOT NULL))) AS c, count(*) FILTER (node_type = 'Skill') AS skills FROM found)
SELECT jobs, paid, CASE WHEN lo > 100000 THEN format('{{:,.1f}} LPA', round(lo / 100000, 1)) ELSE format('{{:,.0f}}', lo) END AS least, CASE WHEN hi > 100000 THEN format('{{:,.1f}} LPA', round(hi / 100000, 1)) ELSE format('{{:,.0f}}', hi) END AS most,
 array_to_string(c[1:5], ', ') || CASE WHEN len(c) > 5 THEN ' and ' || (len(c) - 5) || ' others' ELSE '' END AS companies, skills FROM m"""
)
def context_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, mean pay, companies and skills of what a search found."""
    return context.market_summary(_found(Graph(spark, sf_dir)))


@query(
    f"""{_FOUND_NODES}, rel AS (SELECT 'REQUIRES' AS rel_type, job_id AS src, skill_id AS dst FROM seed_job JOIN requires USING (job_id) UNION ALL SELECT 'POSTED_BY', job_id, company_id FROM seed_job JOIN job USING (job_id)),
counted AS (SELECT rel_type, count(*) AS n FROM (SELECT * FROM rel ORDER BY rel_type, src, dst LIMIT 50) GROUP BY rel_type),
node AS (SELECT DISTINCT 'Skill' AS t, name FROM seed_job JOIN requires USING (job_id) JOIN skill USING (skill_id) UNION SELECT DISTINCT 'Company', company_name FROM seed_job JOIN job USING (job_id) JOIN company USING (company_id))
SELECT 'rel' AS part, rel_type AS kind, n::VARCHAR AS text FROM counted UNION ALL SELECT 'node', t, string_agg(name, ', ' ORDER BY name) FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY name) AS rank FROM node) WHERE rank <= CASE t WHEN 'Skill' THEN 8 ELSE 5 END GROUP BY t"""
)
def context_related_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related nodes up to their type's cap, and types of the first 50 relationships."""
    g = Graph(spark, sf_dir)
    seeds = _seed_jobs(g)
    hit = seeds.join(g.requires(), "job_id").join(g.skills(), "skill_id")
    firm = seeds.join(g.jobs(), "job_id").join(g.companies(), "company_id")
    nodes = hit.select(F.lit("Skill").alias("node_type"), "name").unionByName(firm.select(F.lit("Company").alias("node_type"), F.col("company_name").alias("name"))).distinct()
    shown = context.capped(nodes, [F.col("name")], context.RELATED).groupBy("node_type").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("text"))
    rels = hit.select(F.lit("REQUIRES").alias("rel_type"), F.col("job_id").alias("src"), F.col("skill_id").alias("dst")).unionByName(firm.select(F.lit("POSTED_BY").alias("rel_type"), F.col("job_id").alias("src"), F.col("company_id").alias("dst")))
    counted = rels.orderBy("rel_type", "src", "dst").limit(context.COUNTED).groupBy("rel_type").agg(F.count("*").cast("string").alias("text"))
    return shown.select(F.lit("node").alias("part"), F.col("node_type").alias("kind"), "text").unionByName(counted.select(F.lit("rel").alias("part"), F.col("rel_type").alias("kind"), "text"))


_GRAPH = "SELECT 'node' AS kind, 'Job' AS type, job_id::VARCHAR AS id, NULL AS dst FROM {0} UNION SELECT 'node', 'Skill', skill_id::VARCHAR, NULL FROM {0} UNION SELECT 'relationship', 'REQUIRES', job_id::VARCHAR, skill_id::VARCHAR FROM {0}"


@query(
    f"""{SQL}, need AS (SELECT job_id, skill_id FROM seed_job JOIN requires USING (job_id)), paid AS (SELECT job_id, skill_id FROM need JOIN job USING (job_id) WHERE max_salary > 200000),
part AS (SELECT *, 'skill_requirement' AS intent FROM ({_GRAPH.format('need')}) UNION ALL SELECT *, 'salary_analysis' FROM ({_GRAPH.format('paid')})),
merged AS (SELECT kind, type, id, dst, string_agg(DISTINCT intent, ',' ORDER BY intent) AS intents FROM part GROUP BY ALL)
(SELECT * FROM merged WHERE kind = 'node' ORDER BY type, id, dst LIMIT 100) UNION ALL (SELECT * FROM merged WHERE kind = 'relationship' ORDER BY type, id, dst LIMIT 150)"""
)
def multi_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and relationships of two intents, each once, up to 100 and 150."""
    g = Graph(spark, sf_dir)
    need = _seed_jobs(g).join(g.requires(), "job_id")
    paid = need.join(g.jobs().where("max_salary > 200000").select("job_id"), "job_id", "left_semi")
    return traverse.multi_intent({"skill_requirement": traverse.as_graph(need), "salary_analysis": traverse.as_graph(paid)}, 100, 150)


@query(f"{_FOUND_NODES} SELECT node_type, id, place FROM found WHERE node_type = (SELECT node_type FROM found WHERE place = 1)")
def seed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a traversal starts from: those of the first row's type."""
    return traverse.seed_rows(_found(Graph(spark, sf_dir))).select("node_type", "id", "place")


@query("SELECT has_results, intents, NOT has_results OR intents IN ('general', 'general,unknown') AS skipped FROM (VALUES (true, 'general'), (true, 'general,unknown'), (true, 'general,career_path'), (false, 'career_path'), (true, 'career_path')) t(has_results, intents)")
def skip_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a traversal is left out, for five cases."""
    cases = [(True, "general"), (True, "general,unknown"), (True, "general,career_path"), (False, "career_path"), (True, "career_path")]
    return spark.createDataFrame([(has, intents, traverse.skipped(has, intents.split(","))) for has, intents in cases], "has_results boolean, intents string, skipped boolean")


@query(f"""{SQL} SELECT job_id, skill_id, name, level, category, subcategory FROM seed_job JOIN requires USING (job_id) JOIN skill USING (skill_id) ORDER BY job_id, skill_id LIMIT 100""")
def traverse_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A traversal's first rows in a total order."""
    g = Graph(spark, sf_dir)
    return traverse.first_rows(traverse.skill_requirement(_seed_jobs(g), g.requires(), g.skills()), "job_id", "skill_id", limit=100)


@query(f"{SQL} SELECT job_id, to_json({{'job_id': job_id, 'job_title': job_title, 'max_salary': max_salary}})::VARCHAR AS job_node FROM seed_job JOIN job USING (job_id)")
def whole_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed jobs as whole nodes, one struct each, spelt as JSON."""
    g = Graph(spark, sf_dir)
    return _seed_jobs(g).join(g.jobs(), "job_id").select("job_id", F.struct("job_id", "job_title", "max_salary").alias("job_node")).withColumn("job_node", F.to_json("job_node"))


@query(f"{SQL} SELECT skill_id, name FROM skill WHERE contains(name, 'ed') AND NOT starts_with(name, 'red')")
def skill_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills whose name holds a text but doesn't start with another."""
    return Graph(spark, sf_dir).skills().where(F.col("name").contains("ed") & ~F.col("name").startswith("red")).select("skill_id", "name")


@query(
    f"""{SQL}, j AS (SELECT company_id, job_title FROM job) SELECT company_id, array_to_string(list_sort(list_distinct(list(job_title)))[1:2], ', ') || CASE WHEN len(list_distinct(list(job_title))) > 2 THEN ' and ' || (len(list_distinct(list(job_title))) - 2) || ' others' ELSE '' END AS titles
FROM j GROUP BY company_id"""
)
def company_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that a company looks for: the first two and how many others."""
    return Graph(spark, sf_dir).jobs().groupBy("company_id").agg(and_others(F.collect_set("job_title"), 2).alias("titles"))


@query(
    """SELECT o_orderkey AS job_id, CASE WHEN o_totalprice > 100000 THEN format('{:,.1f} LPA', round(o_totalprice / 100000, 1)) ELSE format('{:,.0f}', o_totalprice) END AS pay, left(o_orderpriority, 4) || '...' AS title,
o_orderdate AS posted FROM orders"""
)
def display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay in lakhs, shortened titles, and a moment read back from ISO text with Z."""
    rows = Graph(spark, sf_dir).table("orders")
    posted = iso_time(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).cast("timestamp_ntz")
    return rows.select(F.col("o_orderkey").alias("job_id"), lakhs(F.col("o_totalprice")).alias("pay"), truncated(F.col("o_orderpriority"), 4).alias("title"), posted.alias("posted"))


@query(
    """SELECT l_orderkey AS job_id, list_sort(list(DISTINCT l_returnflag)) AS flags, list_position(list_sort(list(DISTINCT l_returnflag)), 'R')::BIGINT AS place, coalesce(list_position(list_sort(list(DISTINCT l_returnflag)), 'R'), 0) > 0 AS returned
FROM lineitem GROUP BY l_orderkey"""
)
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of flags, the place of one of them, and whether it is there."""
    rows = Graph(spark, sf_dir).table("lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return rows.select("job_id", "flags", F.nullif(F.array_position("flags", "R"), F.lit(0)).cast("long").alias("place"), F.array_contains("flags", "R").alias("returned"))


@query("SELECT p_partkey AS skill_id, CASE WHEN p_size > 10 THEN 'name,size,type' ELSE 'name,type' END AS kept FROM part")
def map_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's properties as a map, without those that a filter leaves out."""
    part = Graph(spark, sf_dir).table("part")
    made = F.create_map(F.lit("name"), "p_name", F.lit("type"), "p_type", F.lit("size"), F.when(F.col("p_size") > 10, F.col("p_size").cast("string")))
    return part.select(F.col("p_partkey").alias("skill_id"), F.array_join(F.array_sort(F.map_keys(F.map_filter(made, lambda k, v: v.isNotNull()))), ",").alias("kept"))


@query(
    """WITH s AS (SELECT user_id AS session, event_type AS stage, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY ALL)
SELECT session, count(*) FILTER (e > 0) = 0 AS open, CASE WHEN count(*) FILTER (e > 0) = 0 THEN '' ELSE 'error' END AS blocked_by FROM s GROUP BY session"""
)
def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose answer may be written, and stages whose errors forbid it."""
    rows = Graph(spark, sf_dir).table("events").select(F.col("user_id").alias("session"), F.col("event_type").alias("stage"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return context.gate(rows)


@query(
    f"""{SQL}, known AS (SELECT DISTINCT skill_id FROM requires JOIN seed_job USING (job_id)), m AS (SELECT job_id, count(*) AS total, count(known.skill_id) AS matched, array_to_string(list_sort(list(requires.skill_id) FILTER (known.skill_id IS NULL)), ',') AS missing
  FROM requires LEFT JOIN known USING (skill_id) GROUP BY job_id)
SELECT job_id, total, matched, round(matched / total * 100, 4) AS pct, coalesce(missing, '') AS missing FROM m JOIN job USING (job_id) WHERE matched / total >= 0.5 ORDER BY matched / total DESC, max_salary DESC, job_id LIMIT 50"""
)
def job_match_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best matching jobs with the skills that are still missing."""
    g = Graph(spark, sf_dir)
    known = g.requires().join(_seed_jobs(g), "job_id", "left_semi").select("skill_id").distinct().withColumn("has", F.lit(1))
    rows = g.requires().join(known, "skill_id", "left")
    listed = rows.groupBy("job_id").agg(F.count("*").alias("total"), F.count("has").alias("matched"), F.array_sort(F.collect_list(F.when(F.col("has").isNull(), F.col("skill_id")))).alias("missing"))
    listed = listed.withColumn("share", F.col("matched") / F.col("total")).where("share >= 0.5").join(g.jobs().select("job_id", "max_salary"), "job_id")
    best = listed.orderBy(F.desc("share"), F.desc("max_salary"), "job_id").limit(50)
    return best.select("job_id", "total", "matched", F.round(F.col("share") * 100, 4).alias("pct"), F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))
