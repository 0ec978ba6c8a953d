"""Bounded graph traversal over edge frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut_lineage

MAX_DEPTH = 5


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    forward = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return forward.unionByName(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def khop(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``(seed, node, hops)``: nodes within ``depth`` steps of each seed, with the fewest steps.

    Each step expands only the pairs found in the step before, and drops those already reached. Edges are
    written once and each step's pairs as well, so a step's plan is two joins whatever the depth. Seeds are
    not their own result.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    links = cut_lineage(edges.select("src", "dst"))
    start = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct()
    frontier = cut_lineage(start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")))
    rounds = [frontier]
    for hop in range(1, depth + 1):
        # links grow with the table and go through no driver, however small their files
        step = frontier.join(links.hint("merge"), frontier["node"] == links["src"]).select("seed", F.col("dst").alias("node")).distinct()
        reached = reduce(DataFrame.unionByName, rounds).select("seed", "node")
        frontier = cut_lineage(step.join(reached.hint("merge"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        rounds.append(frontier)
    return reduce(DataFrame.unionByName, rounds[1:])


def trails(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``(seed, node, hops, path)``: every path that uses an edge ``(edge_id, src, dst)`` once; for small graphs. Each hop's paths are written once."""
    depth = max(1, min(depth, MAX_DEPTH))
    start = seeds.select(F.col(seeds.columns[0]).alias("seed"))
    paths = start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"), F.array().cast("array<long>").alias("path"))
    edges, found = cut_lineage(edges.select("edge_id", "src", "dst")), None
    for hop in range(1, depth + 1):
        step = paths.join(edges, (paths["node"] == edges["src"]) & ~F.array_contains("path", F.col("edge_id")))
        paths = cut_lineage(step.select("seed", F.col("dst").alias("node"), F.lit(hop).alias("hops"), F.concat("path", F.array("edge_id")).alias("path")))
        found = paths if found is None else found.unionByName(paths)
    return found


def skill_requirement(seeds: DataFrame, requires: DataFrame, skills: DataFrame) -> DataFrame:
    """What the seed jobs require, with category and subcategory."""
    return seeds.join(requires, "job_id").join(skills, "skill_id").select("job_id", "skill_id", "name", "level", "category", "subcategory")


def career_path_from_skills(seeds: DataFrame, edges: DataFrame, requires: DataFrame, skills: DataFrame, depth: int) -> DataFrame:
    """Jobs that require a seed skill which has similar skills, and these with their category."""
    near = khop(undirected(edges), seeds, depth).select(F.col("seed").alias("skill_id"), F.col("node").alias("similar_id"), "hops")
    category = skills.select(F.col("skill_id").alias("similar_id"), F.col("name").alias("similar_name"), "category")
    return near.join(requires, "skill_id").join(category, "similar_id", "left").select("skill_id", "job_id", "similar_id", "hops", "similar_name", "category")


def career_path_from_jobs(seeds: DataFrame, edges: DataFrame, requires: DataFrame, depth: int) -> DataFrame:
    """Other jobs reached through skills similar to those of the seed jobs, with the fewest steps."""
    own = seeds.join(requires, "job_id").select("job_id", "skill_id")
    near = khop(undirected(edges), own.select("skill_id"), depth).select(F.col("seed").alias("skill_id"), F.col("node").alias("similar_id"), "hops")
    onward = requires.select(F.col("job_id").alias("next_job_id"), F.col("skill_id").alias("similar_id"))
    reached = own.join(near, "skill_id").join(onward, "similar_id").where("job_id <> next_job_id")
    return reached.groupBy("job_id", "next_job_id").agg(F.min("hops").alias("hops"), F.count_distinct("similar_id").alias("n_similar"))


def salary_analysis(seeds: DataFrame, jobs: DataFrame, requires: DataFrame, skills: DataFrame, companies: DataFrame, locations: DataFrame, limit: int = 500) -> DataFrame:
    """Seed jobs with skill, company and location, best paid first (unknown pay before known)."""
    rows = seeds.join(jobs, "job_id").join(requires, "job_id").join(skills.select("skill_id", "name"), "skill_id").join(companies, "company_id").join(locations, "location_id", "left")
    return rows.select("job_id", "job_title", "max_salary", "skill_id", "name", "company_name", "location_name").orderBy(F.desc_nulls_first("max_salary"), "job_id", "skill_id").limit(limit)


def skill_relationship(seeds: DataFrame, edges: DataFrame, skills: DataFrame, depth: int) -> DataFrame:
    """Seed skills with similar ones where there are any, and category and subcategory."""
    near = khop(undirected(edges), seeds, depth).select(F.col("seed").alias("skill_id"), F.col("node").alias("similar_id"), "hops")
    return seeds.join(near, "skill_id", "left").join(skills.select("skill_id", "name", "category", "subcategory"), "skill_id", "left").select("skill_id", "similar_id", "hops", "name", "category", "subcategory")


def company_query(seeds: DataFrame, jobs: DataFrame, requires: DataFrame, companies: DataFrame, locations: DataFrame) -> DataFrame:
    """Companies of the seed jobs with their location, all their jobs and the skills of these.

    Counts and not the product of skills, other jobs and their skills, which would grow
    with the third power of a company's size.
    """
    employers = seeds.join(jobs, "job_id").select("company_id").distinct()
    other = employers.join(jobs.select("job_id", "company_id"), "company_id")
    counted = other.join(requires, "job_id", "left").groupBy("company_id").agg(F.count_distinct("job_id").alias("n_jobs"), F.count_distinct("skill_id").alias("n_skills"))
    return counted.join(companies, "company_id").join(locations, "location_id", "left").select("company_id", "company_name", "location_name", "n_jobs", "n_skills")


def shape_nodes(**frames: DataFrame) -> DataFrame:
    """Distinct typed nodes ``(node_type, id, name)`` of several results."""
    found = None
    for label, df in frames.items():
        key, name = df.columns[:2]
        part = df.select(F.lit(label).alias("node_type"), F.col(key).cast("string").alias("id"), F.col(name).cast("string").alias("name"))
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["node_type", "id"])


def shape_relationships(**frames: DataFrame) -> DataFrame:
    """Distinct typed edges ``(rel_type, src, dst)`` of several results."""
    found = None
    for label, df in frames.items():
        src, dst = df.columns[:2]
        part = df.select(F.lit(label).alias("rel_type"), F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def company_rows(seeds: DataFrame, jobs: DataFrame, requires: DataFrame, skills: DataFrame, companies: DataFrame, limit: int = 500) -> DataFrame:
    """The other jobs and the skills of the seed jobs' companies, a row each and not their product: ``(company_id, company_name, relation, id, name)``.

    ``other_job`` rows hold the seed jobs too, ``required_skill`` rows the seed jobs' skills and ``related_skill`` rows those
    of all the company's jobs.
    """
    own = seeds.join(jobs, "job_id").select("job_id", "company_id")
    other = own.select("company_id").distinct().join(jobs.select("company_id", "job_id", "job_title"), "company_id")
    skill = skills.select("skill_id", "name")
    parts = [
        other.select("company_id", F.lit("other_job").alias("relation"), F.col("job_id").alias("id"), F.col("job_title").alias("name")),
        own.join(requires, "job_id").join(skill, "skill_id").select("company_id", F.lit("required_skill").alias("relation"), F.col("skill_id").alias("id"), "name"),
        other.join(requires, "job_id").join(skill, "skill_id").select("company_id", F.lit("related_skill").alias("relation"), F.col("skill_id").alias("id"), "name"),
    ]
    rows = reduce(DataFrame.unionByName, parts).distinct().join(companies.select("company_id", "company_name"), "company_id")
    return rows.select("company_id", "company_name", "relation", "id", "name").orderBy("company_id", "relation", "id").limit(limit)


def first_rows(rows: DataFrame, *order: str, limit: int = 500) -> DataFrame:
    """The first rows in a total order; 0 is no limit."""
    return rows.orderBy(*order).limit(limit) if limit else rows


def seed_rows(found: DataFrame, most: int = 50) -> DataFrame:
    """The first rows of a search by ``place`` that are of the first row's type; a search returns some dozens of rows."""
    first = found.agg(F.min_by("node_type", "place").alias("node_type"))
    return found.join(F.broadcast(first), "node_type").orderBy("place").limit(most)  # one row


def skipped(has_results: bool, intents: list[str]) -> bool:
    """Nothing to traverse: the search found nothing, or no intent says where to go."""
    return not has_results or all(i in ("general", "unknown", "") for i in intents)


def multi_intent(parts: dict[str, DataFrame], nodes: int = 500, relationships: int = 1000) -> DataFrame:
    """``(kind, type, id, dst, intents)``: nodes and relationships of several intents, each once, with the intents that found it.

    ``parts`` has a table ``(kind, type, id, dst)`` for each intent, ``kind`` being node or relationship and ``dst`` null for
    nodes. The first by type and id are kept, so many of each kind; 0 is no limit.
    """
    every = reduce(DataFrame.unionByName, [df.select("kind", "type", "id", "dst", F.lit(name).alias("intent")) for name, df in parts.items()])
    merged = every.groupBy("kind", "type", "id", "dst").agg(F.array_join(F.array_sort(F.collect_set("intent")), ",").alias("intents"))
    caps = [(kind, n) for kind, n in (("node", nodes), ("relationship", relationships))]
    return reduce(DataFrame.unionByName, [first_rows(merged.where(F.col("kind") == kind), "type", "id", "dst", limit=n) for kind, n in caps])


def as_graph(rows: DataFrame, job: str = "job_id", skill: str = "skill_id") -> DataFrame:
    """``(kind, type, id, dst)``: the jobs, skills and edges of rows that pair them."""
    text = lambda c: F.col(c).cast("string")
    nothing = F.lit(None).cast("string")
    one = lambda kind, label, key, to: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("type"), text(key).alias("id"), to.alias("dst"))
    made = F.array(one("node", "Job", job, nothing), one("node", "Skill", skill, nothing), one("relationship", "REQUIRES", job, text(skill)))
    return rows.select(F.explode(made).alias("m")).select("m.*").distinct()
