"""Queries of network metrics, over brands as skills where part pairs are too rare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine
from graphloom.operators import netmetrics, quantiles, vector_search
from graphloom.plans.registry import query
from graphloom.sources.domain import SQL, Graph


def _brands(g: Graph) -> DataFrame:
    return g.requires().join(g.skills(), "skill_id").select("job_id", "category").distinct()


def _pairs(g: Graph, least: int = 1) -> DataFrame:
    return netmetrics.co_occurrence(_brands(g), "job_id", "category", least)


_CO = f"""{SQL}, brand AS (SELECT DISTINCT job_id, category FROM requires JOIN skill USING (skill_id)),
demand AS (SELECT category, count(*) AS n FROM brand GROUP BY category),
co AS (SELECT a, b, both_n, x.n AS n_a, y.n AS n_b FROM (SELECT l.category AS a, r.category AS b, count(*) AS both_n FROM brand l JOIN brand r USING (job_id) WHERE l.category < r.category GROUP BY ALL)
  JOIN demand x ON a = x.category JOIN demand y ON b = y.category)"""


@query(f"{_CO} SELECT a, b, both_n AS both, n_a, n_b FROM co WHERE both_n >= 5")
def skill_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(Graph(spark, sf_dir), 5)


@query(f"{_CO} SELECT a, b, round(both_n / (n_a + n_b - both_n), 6) AS rate FROM co WHERE both_n / (n_a + n_b - both_n) > 0.08 AND both_n >= 5")
def complements_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(Graph(spark, sf_dir), 5)
    rate = netmetrics.jaccard(F.col("both"), F.col("n_a"), F.col("n_b"))
    return pairs.where(rate > 0.08).select("a", "b", F.round(rate, 6).alias("rate"))


@query(f"{_CO} SELECT a, b, round(both_n / (SELECT count(*) FROM job), 6) AS rate FROM co WHERE both_n >= 5 AND both_n / (SELECT count(*) FROM job) > 0.02")
def complements_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    jobs = g.jobs().count()
    return _pairs(g, 5).withColumn("rate", F.col("both") / F.lit(jobs)).where("rate > 0.02").select("a", "b", F.round("rate", 6).alias("rate"))


@query(f"{_CO} SELECT a, b, both_n AS both, round(both_n / least(n_a, n_b), 6) AS overlap FROM co WHERE both_n / least(n_a, n_b) > 0.15")
def skill_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = netmetrics.overlap(F.col("both"), F.col("n_a"), F.col("n_b"))
    return _pairs(Graph(spark, sf_dir)).where(rate > 0.15).select("a", "b", "both", F.round(rate, 6).alias("overlap"))


@query(
    f"""{SQL}, top AS (SELECT skill_id FROM requires GROUP BY skill_id ORDER BY count(*) DESC, skill_id LIMIT 1)
SELECT r.skill_id, count(DISTINCT r.job_id) AS n_jobs FROM top JOIN requires o ON o.skill_id = top.skill_id JOIN requires r ON r.job_id = o.job_id AND r.skill_id <> o.skill_id
GROUP BY r.skill_id ORDER BY n_jobs DESC, r.skill_id LIMIT 20"""
)
def coreq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = Graph(spark, sf_dir).requires()
    top = edges.groupBy("skill_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill_id").limit(1).select("skill_id")
    jobs = edges.join(top, "skill_id", "left_semi").select("job_id", F.col("skill_id").alias("own"))
    rows = edges.join(jobs, "job_id").where("skill_id <> own").groupBy("skill_id").agg(F.count_distinct("job_id").alias("n_jobs"))
    return rows.orderBy(F.desc("n_jobs"), "skill_id").limit(20)


@query(
    f"""{SQL}, need AS (SELECT skill_id, count(*) AS n FROM requires GROUP BY skill_id),
co AS (SELECT l.skill_id AS a, r.skill_id AS b, count(*) AS both_n FROM requires l JOIN requires r USING (job_id) WHERE l.skill_id <> r.skill_id GROUP BY ALL),
w AS (SELECT a, b, 0.5 * both_n / n + 0.3 * list_cosine_similarity(x.v, y.v) + 0.2 * (1 - abs(s.level - t.level) / (SELECT max(level) - min(level) FROM skill)) AS weight
  FROM co JOIN need ON need.skill_id = a JOIN vec x ON x.id = a JOIN vec y ON y.id = b JOIN skill s ON s.skill_id = a JOIN skill t ON t.skill_id = b)
SELECT a, b, round(weight, 6) AS weight FROM w WHERE weight > 0.3"""
)
def transitions_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    pairs = netmetrics.co_occurrence(g.requires(), "job_id", "skill_id")
    both_ways = pairs.select("a", "b", "both", "n_a").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "both", F.col("n_b").alias("n_a")))
    node = g.skills().select("skill_id", "level").join(g.vectors().withColumnRenamed("id", "skill_id"), "skill_id")
    gap = g.skills().agg((F.max("level") - F.min("level")).alias("gap")).first()["gap"]
    rows = both_ways.join(node.toDF("a", "level_a", "v_a"), "a").join(node.toDF("b", "level_b", "v_b"), "b")
    weight = 0.5 * F.col("both") / F.col("n_a") + 0.3 * cosine(F.col("v_a"), F.col("v_b")) + 0.2 * (1 - F.abs(F.col("level_a") - F.col("level_b")) / F.lit(gap))
    return rows.withColumn("weight", weight).where("weight > 0.3").select("a", "b", F.round("weight", 6).alias("weight"))


_INDEX = """, rare AS (SELECT a, b FROM co WHERE both_n / (SELECT count(*) FROM job) < 0.02),
own AS (SELECT l.job_id, l.category AS a, r.category AS b FROM brand l JOIN brand r USING (job_id) WHERE l.category < r.category),
idx AS (SELECT job_id, count(rare.a) / count(*) AS creation FROM own LEFT JOIN rare USING (a, b) GROUP BY job_id)"""


@query(
    f"""{_CO}{_INDEX} SELECT job_id, round(creation, 6) AS creation, round(1 - creation, 6) AS reuse, CASE WHEN creation > 0.5 THEN 'high' WHEN creation > 0.3 THEN 'medium' ELSE 'low' END AS band FROM idx"""
)
def creation_reuse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    jobs = g.jobs().count()
    brand = _brands(g)
    rare = _pairs(g).where(F.col("both") / F.lit(jobs) < 0.02).select("a", "b", F.lit(1).alias("rare"))
    own = brand.select("job_id", F.col("category").alias("a")).join(brand.select("job_id", F.col("category").alias("b")), "job_id").where("a < b")
    index = own.join(rare, ["a", "b"], "left").groupBy("job_id").agg((F.count("rare") / F.count("*")).alias("x"))
    return index.select("job_id", F.round("x", 6).alias("creation"), F.round(1 - F.col("x"), 6).alias("reuse"), netmetrics.transition_band(F.col("x"), 0.5, 0.3).alias("band"))


_SOURCES = ("Brand#11", "Brand#23")
_WALK = """, edge AS (SELECT a, b, 1 / both_n AS cost FROM co UNION ALL SELECT b, a, 1 / both_n FROM co),
short(source, node, distance) USING KEY (source, node) AS (SELECT c, c, 0.0::DOUBLE FROM (VALUES ('Brand#11'), ('Brand#23')) t(c)
  UNION SELECT s.source, e.b, min(s.distance + e.cost) FROM short s JOIN edge e ON s.node = e.a LEFT JOIN recurring.short k ON k.source = s.source AND k.node = e.b
  WHERE k.distance IS NULL OR s.distance + e.cost < k.distance GROUP BY ALL)"""


def _short(g: Graph) -> DataFrame:
    """From two brands, the given question's sources, to all others."""
    edges = _pairs(g).select("a", "b", (1 / F.col("both")).alias("cost"))
    sources = g.skills().select("category").where(F.col("category").isin(*_SOURCES)).distinct()
    return netmetrics.shortest_distances(edges, sources)


@query(f"{_CO}{_WALK} SELECT source, node, round(distance, 8) AS distance FROM short")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(Graph(spark, sf_dir)).select("source", "node", F.round("distance", 8).alias("distance"))


@query(f"{_CO}{_WALK} SELECT source, node, round(1 / (1 + distance), 8) AS closeness FROM short")
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(Graph(spark, sf_dir)).select("source", "node", F.round(netmetrics.closeness(F.col("distance")), 8).alias("closeness"))


#: A skill that at least 15 % of the jobs of a title want is core for it here, and counts twice.
_JOB_CLOSE = """, close AS (SELECT node AS category, max(1 / (1 + distance)) AS c FROM short GROUP BY node),
titled AS (SELECT job_title, count(*) AS jobs FROM job GROUP BY job_title),
core AS (SELECT category, job_title, 2 * count(*) >= 0.3 * max(jobs) AS is_core FROM brand JOIN job USING (job_id) JOIN titled USING (job_title) GROUP BY category, job_title),
jc AS (SELECT job_id, sum(w * coalesce(c, 0)) / sum(w) AS closeness, avg(CASE WHEN coalesce(c, 0) > 0.9985 THEN 1.0 ELSE 0.0 END) AS core, avg(n) AS demand
  FROM (SELECT job_id, category, CASE WHEN is_core THEN 2.0 ELSE 1.0 END AS w FROM brand JOIN job USING (job_id) JOIN core USING (category, job_title)) LEFT JOIN close USING (category) JOIN demand USING (category) GROUP BY job_id)"""


def _job_close(g: Graph) -> DataFrame:
    close = _short(g).groupBy("node").agg(F.max(netmetrics.closeness(F.col("distance"))).alias("c")).withColumnRenamed("node", "category")
    brand = _brands(g).join(g.jobs().select("job_id", "job_title"), "job_id")
    demand = brand.groupBy("category").agg(F.count("*").alias("n"))
    titled = g.jobs().groupBy("job_title").agg(F.count("*").alias("jobs"))
    core = brand.groupBy("category", "job_title").agg(F.count("*").alias("own")).join(titled, "job_title").select("category", "job_title", (2 * F.col("own") >= 0.3 * F.col("jobs")).alias("is_core"))
    rows = brand.join(core, ["category", "job_title"]).join(close, "category", "left").join(demand, "category").withColumn("c", F.coalesce("c", F.lit(0.0)))
    weight = F.when(F.col("is_core"), netmetrics.CORE_WEIGHT).otherwise(1.0)
    return rows.groupBy("job_id").agg((F.sum(weight * F.col("c")) / F.sum(weight)).alias("closeness"), F.avg(F.when(F.col("c") > 0.9985, 1.0).otherwise(0.0)).alias("core"), F.avg("n").alias("demand"))


@query(f"{_CO}{_WALK}{_JOB_CLOSE} SELECT job_id, round(closeness, 6) AS closeness FROM jc")
def job_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _job_close(Graph(spark, sf_dir)).select("job_id", F.round("closeness", 6).alias("closeness"))


@query(
    f"""{_CO}{_WALK}{_JOB_CLOSE}, ti AS (SELECT job_id, 0.5 * closeness + 0.3 * core + 0.2 * least(1.0, demand / 10000) AS i FROM jc)
SELECT job_id, round(i, 5) AS transition_index, CASE WHEN i > 0.7 THEN 'high' WHEN i > 0.4 THEN 'medium' ELSE 'low' END AS band FROM ti"""
)
def transition_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = 0.5 * F.col("closeness") + 0.3 * F.col("core") + 0.2 * F.least(F.lit(1.0), F.col("demand") / 10000)
    rows = _job_close(Graph(spark, sf_dir)).withColumn("i", index)
    return rows.select("job_id", F.round("i", 5).alias("transition_index"), netmetrics.transition_band(F.col("i")).alias("band"))


#: Up to 100 rounds, each node counting itself too; the first of rounds 5, 10, ... in which no value changes by 1e-4, else the last.
_POWER = """, u AS (SELECT src, dst FROM undirected WHERE src <> dst UNION SELECT src, src FROM undirected),
power(k, node, c) AS (SELECT 0, node, 1.0::DOUBLE FROM (SELECT DISTINCT src AS node FROM u) UNION ALL SELECT k + 1, src, sum(c) FROM power JOIN u ON dst = node WHERE k < 100 GROUP BY k, src),
unit AS (SELECT k, node, c / sqrt(sum(c * c) OVER (PARTITION BY k)) AS c FROM power),
moved AS (SELECT a.k, max(abs(a.c - b.c)) AS d FROM unit a JOIN unit b ON a.node = b.node AND b.k = a.k - 1 WHERE a.k % 5 = 0 GROUP BY a.k),
r AS (SELECT node, c FROM unit WHERE k = coalesce((SELECT min(k) FROM moved WHERE d < 1e-4), 100))"""


def _central(g: Graph) -> DataFrame:
    return netmetrics.eigenvector_centrality(vector_search.knn_graph(g.vectors(), 0.3).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query(f"{SQL}{_POWER} SELECT node, round(c, 6) AS centrality FROM r")
def eigenvector_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _central(Graph(spark, sf_dir)).select("node", F.round("centrality", 6).alias("centrality"))


_TOP_CENTRAL = "SELECT category, node, round(c, 6) AS centrality FROM r JOIN skill ON skill_id = node WHERE category IN ('Brand#11', 'Brand#22', 'Brand#33', 'Brand#44') ORDER BY r.c DESC, node LIMIT 10"


@query(f"{SQL}{_POWER} {_TOP_CENTRAL}")
def central_in_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    wanted = g.skills().where(F.col("category").isin("Brand#11", "Brand#22", "Brand#33", "Brand#44")).select(F.col("skill_id").alias("node"), "category")
    rows = _central(g).join(wanted, "node")
    return rows.orderBy(F.desc("centrality"), "node").limit(10).select("category", "node", F.round("centrality", 6).alias("centrality"))


@query(f"{SQL}{_POWER} SELECT node, round(c, 6) AS centrality FROM r")
def eigenvector_centrality_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its name of before the query above went on until it converged."""
    return eigenvector_centrality(spark, sf_dir)


@query(f"{SQL}{_POWER} {_TOP_CENTRAL}")
def central_in_categories_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its name of before the query above went on until it converged."""
    return central_in_categories(spark, sf_dir)


@query(f"{_CO}{_WALK} SELECT source, round(avg(1 / (1 + distance)), 6) AS closeness FROM short WHERE node LIKE 'Brand#3%' GROUP BY source")
def cluster_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short(Graph(spark, sf_dir)).where(F.col("node").startswith("Brand#3"))
    return rows.groupBy("source").agg(F.round(F.avg(netmetrics.closeness(F.col("distance"))), 6).alias("closeness"))


@query(
    f"""{SQL}, known AS (SELECT skill_id FROM requires JOIN seed_job USING (job_id)), m AS (SELECT job_id, count(*) AS total, count(known.skill_id) AS matched
  FROM requires LEFT JOIN (SELECT DISTINCT skill_id FROM known) known USING (skill_id) GROUP BY job_id)
SELECT job_id, total, matched, round(matched / total * 100, 4) AS pct FROM m JOIN job USING (job_id) WHERE matched / total >= 0.5 ORDER BY matched / total DESC, max_salary DESC, job_id LIMIT 50"""
)
def job_match_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    seeds = g.jobs().orderBy(F.desc("max_salary"), "job_id").limit(50).select("job_id")
    known = g.requires().join(seeds, "job_id", "left_semi").select("skill_id").distinct().withColumn("has", F.lit(1))
    rows = g.requires().join(known, "skill_id", "left").groupBy("job_id").agg(F.count("*").alias("total"), F.count("has").alias("matched"))
    rows = rows.withColumn("share", F.col("matched") / F.col("total")).where("share >= 0.5").join(g.jobs().select("job_id", "max_salary"), "job_id")
    return rows.orderBy(F.desc("share"), F.desc("max_salary"), "job_id").limit(50).select("job_id", "total", "matched", F.round(F.col("share") * 100, 4).alias("pct"))


@query(
    f"""{SQL}, known AS (SELECT DISTINCT skill_id FROM requires WHERE job_id = (SELECT job_id FROM job ORDER BY max_salary DESC, job_id LIMIT 1)),
target AS (SELECT DISTINCT skill_id FROM requires JOIN seed_job USING (job_id)), gap AS (SELECT skill_id FROM target ANTI JOIN known USING (skill_id)),
walk AS (SELECT skill_id AS node, 0 AS hops FROM known UNION SELECT dst, hops + 1 FROM walk JOIN undirected ON node = src WHERE hops < 2)
SELECT skill_id, coalesce(min(hops), 999) AS steps FROM gap LEFT JOIN walk ON node = skill_id GROUP BY skill_id"""
)
def gap_learning_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators import traverse

    g = Graph(spark, sf_dir)
    ranked = g.jobs().orderBy(F.desc("max_salary"), "job_id")
    known = g.requires().join(ranked.limit(1).select("job_id"), "job_id", "left_semi").select("skill_id").distinct()
    target = g.requires().join(ranked.limit(50).select("job_id"), "job_id", "left_semi").select("skill_id").distinct()
    gap = target.join(known, "skill_id", "left_anti")
    edges = traverse.undirected(vector_search.knn_graph(g.vectors(), 0.3))
    near = traverse.khop(edges, known, 2).groupBy(F.col("node").alias("skill_id")).agg(F.min("hops").alias("hops"))
    return gap.join(near, "skill_id", "left").select("skill_id", F.coalesce("hops", F.lit(999)).alias("steps"))


def _creation(g: Graph, window: str) -> DataFrame:
    rows = g.requires().join(g.skills().select("skill_id", "category"), "skill_id").select("job_id", "category").distinct()
    pairs = rows.select("job_id", F.col("category").alias("c1")).join(rows.select("job_id", F.col("category").alias("c2")), "job_id").where("c1 < c2")
    dated = pairs.join(g.jobs().select("job_id", "posted_at", "company_id"), "job_id").join(g.companies().select("company_id", "industry"), "company_id")
    return netmetrics.creation_vs_history(dated, window).withColumn("creation", F.round("creation", 6))


@query(
    f"""{SQL}, e AS (SELECT job_id, skill_id, posted_at, industry FROM requires JOIN job USING (job_id) JOIN company USING (company_id)),
p AS (SELECT x.job_id, x.industry, x.posted_at, a.category AS c1, b.category AS c2 FROM e x JOIN e y USING (job_id) JOIN skill a ON a.skill_id = x.skill_id JOIN skill b ON b.skill_id = y.skill_id WHERE a.category < b.category GROUP BY ALL),
n AS (SELECT p.job_id, p.c1, p.c2, count(q.job_id) AS before FROM p LEFT JOIN p q ON q.industry = p.industry AND q.c1 = p.c1 AND q.c2 = p.c2 AND q.posted_at < p.posted_at AND q.posted_at >= p.posted_at - INTERVAL 60 DAY GROUP BY ALL)
SELECT job_id, round(avg(CASE WHEN before = 0 THEN 1.0 ELSE 0.0 END), 6) AS creation FROM n GROUP BY job_id"""
)
def creation_vs_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a job's pairs that no job of its industry had in the 60 days before."""
    return _creation(Graph(spark, sf_dir), "INTERVAL 60 DAYS")


@query(
    f"""{SQL}, e AS (SELECT job_id, skill_id, posted_at, industry FROM requires JOIN job USING (job_id) JOIN company USING (company_id)),
p AS (SELECT x.job_id, x.industry, x.posted_at, a.category AS c1, b.category AS c2 FROM e x JOIN e y USING (job_id) JOIN skill a ON a.skill_id = x.skill_id JOIN skill b ON b.skill_id = y.skill_id WHERE a.category < b.category GROUP BY ALL),
n AS (SELECT p.job_id, p.c1, p.c2, count(q.job_id) AS before FROM p LEFT JOIN p q ON q.industry = p.industry AND q.c1 = p.c1 AND q.c2 = p.c2 AND q.posted_at < p.posted_at AND q.posted_at >= p.posted_at - INTERVAL 5 YEAR GROUP BY ALL)
SELECT job_id, round(avg(CASE WHEN before = 0 THEN 1.0 ELSE 0.0 END), 6) AS creation FROM n GROUP BY job_id"""
)
def creation_vs_history_5_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the 5 years of the specification."""
    return _creation(Graph(spark, sf_dir), "INTERVAL 5 YEARS")


@query(
    f"""{SQL}, q AS (SELECT category, date_trunc('quarter', posted_at) AS quarter, count(*) AS n FROM requires JOIN job USING (job_id) JOIN skill USING (skill_id) GROUP BY ALL),
v AS (SELECT category, stddev_samp(n) / avg(n) AS cv FROM q GROUP BY category) SELECT category, round(cv, 6) AS cv, CASE WHEN cv < 0.2 THEN 'stable' WHEN cv < 0.5 THEN 'moderate' ELSE 'volatile' END AS band FROM v"""
)
def demand_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    rows = g.requires().join(g.jobs(), "job_id").join(g.skills(), "skill_id")
    quarters = rows.groupBy("category", F.date_trunc("quarter", "posted_at").alias("quarter")).agg(F.count("*").alias("n"))
    cv = quarters.groupBy("category").agg((F.stddev_samp("n") / F.avg("n")).alias("x"))
    return cv.select("category", F.round("x", 6).alias("cv"), F.when(F.col("x") < 0.2, "stable").when(F.col("x") < 0.5, "moderate").otherwise("volatile").alias("band"))


@query(
    f"""{SQL}, s AS (SELECT category, quantile_cont(max_salary, 0.25) AS p25, quantile_cont(max_salary, 0.75) AS p75 FROM requires JOIN job USING (job_id) JOIN skill USING (skill_id) GROUP BY category)
SELECT category, round(p25, 4) AS p25, round(p75, 4) AS p75, round(p75 - p25, 4) AS spread, round(p75 / p25, 6) AS ratio FROM s"""
)
def salary_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    rows = g.requires().join(g.jobs(), "job_id").join(g.skills(), "skill_id")
    found = quantiles.exact_quantiles(rows, "category", "max_salary", (0.25, 0.75))
    of = lambda share: F.max(F.when(F.col("share") == share, F.col("quantile")))
    q = found.groupBy("category").agg(of(0.25).alias("low"), of(0.75).alias("high"))
    return q.select(
        "category", F.round("low", 4).alias("p25"), F.round("high", 4).alias("p75"), F.round(F.col("high") - F.col("low"), 4).alias("spread"), F.round(F.col("high") / F.col("low"), 6).alias("ratio")
    )


@query(
    f"""{SQL}, q AS (SELECT category, date_trunc('quarter', posted_at) AS quarter, count(*) AS n, sum(max_salary) AS weight FROM requires JOIN job USING (job_id) JOIN skill USING (skill_id) GROUP BY ALL),
f AS (SELECT category, arg_min(n, quarter) AS first_n, arg_max(n, quarter) AS last_n, count(*) AS quarters FROM q GROUP BY category)
SELECT category, quarters, first_n, last_n, round((first_n - last_n) / last_n, 6) AS change FROM f ORDER BY (first_n - last_n) / last_n DESC, category LIMIT 20"""
)
def quarterly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    rows = g.requires().join(g.jobs(), "job_id").join(g.skills(), "skill_id")
    quarters = rows.groupBy("category", F.date_trunc("quarter", "posted_at").alias("quarter")).agg(F.count("*").alias("n"))
    ends = quarters.groupBy("category").agg(F.count("*").alias("quarters"), F.min_by("n", "quarter").alias("first_n"), F.max_by("n", "quarter").alias("last_n"))
    change = (F.col("first_n") - F.col("last_n")) / F.col("last_n")
    return ends.withColumn("x", change).orderBy(F.desc("x"), "category").limit(20).select("category", "quarters", "first_n", "last_n", F.round("x", 6).alias("change"))


@query(
    f"""{SQL}, near AS (SELECT skill_id, array_agg(dst ORDER BY score DESC, dst)[1:5] AS similar_ids FROM skill JOIN similar_to ON src = skill_id GROUP BY skill_id),
j AS (SELECT skill_id, array_agg(job_id ORDER BY max_salary DESC, job_id)[1:3] AS job_ids FROM requires JOIN job USING (job_id) GROUP BY skill_id)
SELECT skill_id, name, category, subcategory, array_to_string(coalesce(similar_ids, []), ',') AS similar_ids, array_to_string(coalesce(job_ids, []), ',') AS job_ids FROM skill LEFT JOIN near USING (skill_id) LEFT JOIN j USING (skill_id)"""
)
def skill_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    g = Graph(spark, sf_dir)
    near = vector_search.knn_graph(g.vectors(), 0.3).groupBy(F.col("src").alias("skill_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "dst"))).alias("x"))
    near = near.select("skill_id", F.array_join(F.transform("x", lambda r: r["dst"].cast("string")), ",").alias("similar_ids"))
    best = Window.partitionBy("skill_id").orderBy(F.desc("max_salary"), "job_id")
    top = g.requires().join(g.jobs(), "job_id").withColumn("rn", F.row_number().over(best)).where("rn <= 3")
    jobs = top.groupBy("skill_id").agg(F.array_sort(F.collect_list(F.struct("rn", "job_id"))).alias("x")).select("skill_id", F.array_join(F.transform("x", lambda r: r["job_id"].cast("string")), ",").alias("job_ids"))
    rows = g.skills().join(near, "skill_id", "left").join(jobs, "skill_id", "left")
    return rows.select("skill_id", "name", "category", "subcategory", F.coalesce("similar_ids", F.lit("")).alias("similar_ids"), F.coalesce("job_ids", F.lit("")).alias("job_ids"))


@query("SELECT corr(l_quantity, l_extendedprice) AS r, regr_slope(l_extendedprice, l_quantity) AS slope FROM lineitem")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).table("lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.regr_slope("l_extendedprice", "l_quantity").alias("slope"))


@query(
    """WITH g AS (SELECT user_id % 2 AS arm, count(*) AS n, avg(value) AS mean, var_samp(value) AS var, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) AS click_rate FROM events GROUP BY 1)
SELECT a.n AS n_a, b.n AS n_b, round(a.mean, 6) AS mean_a, round(b.mean, 6) AS mean_b, round((b.mean - a.mean) / a.mean * 100, 6) AS improvement_pct,
 round((b.mean - a.mean) / sqrt(a.var / a.n + b.var / b.n), 6) AS welch_t, round(a.click_rate, 6) AS click_a, round(b.click_rate, 6) AS click_b FROM g a JOIN g b ON a.arm = 0 AND b.arm = 1"""
)
def ab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms in one aggregation."""
    e = Graph(spark, sf_dir).table("events").withColumn("arm", F.col("user_id") % 2)
    cols = []
    for arm, k in (("a", 0), ("b", 1)):
        own = F.when(F.col("arm") == k, F.col("value"))
        cols += [F.count(F.when(F.col("arm") == k, 1)).alias(f"n_{arm}"), F.avg(own).alias(f"m_{arm}"), F.var_samp(own).alias(f"v_{arm}")]
        cols.append(F.avg(F.when(F.col("arm") == k, (F.col("event_type") == "click").cast("double"))).alias(f"c_{arm}"))
    x = e.agg(*cols)
    t = (F.col("m_b") - F.col("m_a")) / F.sqrt(F.col("v_a") / F.col("n_a") + F.col("v_b") / F.col("n_b"))
    return x.select(
        "n_a", "n_b", F.round("m_a", 6).alias("mean_a"), F.round("m_b", 6).alias("mean_b"), F.round((F.col("m_b") - F.col("m_a")) / F.col("m_a") * 100, 6).alias("improvement_pct"),
        F.round(t, 6).alias("welch_t"), F.round("c_a", 6).alias("click_a"), F.round("c_b", 6).alias("click_b"),
    )
