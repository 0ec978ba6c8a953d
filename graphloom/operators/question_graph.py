"""Traversal for a table of questions: each question's seeds and intents go to the patterns they ask for, in one plan.

A question's seeds are the first rows of its search that are of the first row's type, and its intents name patterns:
what jobs require, where a career leads, what is paid, which skills are alike, and who posts jobs. A question without
seeds or with general intents only is skipped. All questions are traversed together: similar skills and a skill's jobs are
looked up once whatever the number of questions, and results are capped for each question.

What a question finds is moved as lists (a job with its skills, a skill with similar ones), once, and is spelt as nodes and
relationships only where all of a question's lists are together: a task takes some questions at a time, counts each node and
relationship once, and applies the caps.

Caps keep the first nodes and relationships of a question in order of type, id and target. So of a skill's jobs only the
first so many can be shown, and no more are joined: a skill that a third of all jobs want doesn't multiply its questions.
A null question, intent or seed is no row; repeated rows count once; ids are compared as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut_lineage
from graphloom.operators.traverse import khop, undirected

#: Seeds of a question, and nodes and relationships that it may show.
SEEDS, NODES, RELATIONSHIPS = 50, 500, 1000
#: Intents that say nothing about where to go.
GENERAL = ("general", "unknown", "")
#: Intents that have a pattern, in order.
FOLLOWED = ("career_path", "company_query", "salary_analysis", "skill_relationship", "skill_requirement")
#: Questions whose rows a task holds at a time, about, and how many times as many it takes.
QUESTIONS, TASK_TIMES = 256, 4
#: Types in order, and what a list says: the node of its head, the node of each item, and their relationship, from the head or from the item.
NODE_TYPES, LINK_TYPES = ("Company", "Job", "Location", "Skill"), ("LOCATED_IN", "POSTED_BY", "REQUIRES", "SIMILAR_TO")
LISTS = (
    ("Job", "Skill", "REQUIRES", True), ("Job", "Company", "POSTED_BY", True), (None, "Location", "LOCATED_IN", True),
    ("Skill", "Skill", "SIMILAR_TO", True), (None, "Job", "REQUIRES", False), (None, "Job", "POSTED_BY", False),
)
REQUIRED, POSTED, LOCATED, ALIKE, WANTED, POSTS = range(len(LISTS))
_ROWS = pa.schema([(c, pa.string()) for c in ("question", "kind", "type", "id", "dst", "intents")])


@dataclass(frozen=True)
class Market:
    """The graph's frames: ``requires(job_id, skill_id)``, ``similar(src, dst)`` and ``jobs(job_id, company_id)``, ``companies(company_id, location_id)``."""

    requires: DataFrame
    similar: DataFrame
    jobs: DataFrame
    companies: DataFrame


def seeds_of(found: DataFrame, most: int = SEEDS) -> DataFrame:
    """``(question, node_type, node)``: the first rows by ``place`` of each question's search that are of the type of its first."""
    rows = found.select("question", "place", "node_type", "node").where("question IS NOT NULL AND node IS NOT NULL AND place IS NOT NULL AND node_type IS NOT NULL")
    order = Window.partitionBy("question").orderBy("place", "node_type", "node")
    typed = rows.withColumn("first", F.first("node_type").over(order)).where("node_type = first").drop("first")
    return typed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("question", "node_type", "node").distinct()


def asked_for(questions: DataFrame) -> DataFrame:
    """``(question, intent)`` of ``questions(question, intents)``, without general intents."""
    rows = questions.select("question", F.explode("intents").alias("intent"))
    return rows.where(F.col("question").isNotNull() & ~F.col("intent").isin(*GENERAL)).distinct()


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _list(form: int, bits: Column, head: str, items: Column) -> Column:
    return F.struct(F.lit(form).alias("form"), F.coalesce(bits, F.lit(0)).cast("int").alias("bits"), _text(head).alias("head"), items.cast("array<string>").alias("items"))


def _packed(rows: DataFrame, *lists: Column) -> DataFrame:
    """``(question, form, bits, head, items)``: the lists of each row, without those that no intent asks for."""
    return rows.select("question", F.explode(F.array(*lists)).alias("m")).select("question", "m.*").where("bits <> 0")


def _merged(keys: np.ndarray, bits: np.ndarray, question: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the bits of all its rows; of each question, whose keys are in steps of ``question``, the first ``most`` (0: all)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    bits = np.bitwise_or.reduceat(bits[order], starts) if len(keys) else bits
    keys = keys[starts]
    if most:
        own = keys // question
        first = np.arange(len(keys)) - np.searchsorted(own, own) < most
        keys, bits = keys[first], bits[first]
    return keys, bits


def gathered(nodes: int, relationships: int) -> Callable[[pa.Table], pa.Table]:
    """A function of the lists of some questions, whole, to their nodes and relationships within the caps."""
    code = lambda names, k: np.array([names.index(x[k]) if x[k] else -1 for x in LISTS])
    head_type, item_type, link_type, forward = code(NODE_TYPES, 0), code(NODE_TYPES, 1), code(LINK_TYPES, 2), np.array([x[3] for x in LISTS])
    # the intents of each set of bits
    named = pa.array([",".join(name for k, name in enumerate(FOLLOWED) if b >> k & 1) for b in range(1 << len(FOLLOWED))])

    def gather(rows: pa.Table) -> pa.Table:
        asked = rows.column("question").combine_chunks().dictionary_encode()
        q = np.asarray(asked.indices, np.int64)
        form, bits = np.asarray(rows.column("form")), np.asarray(rows.column("bits"), np.int64)
        items = rows.column("items").combine_chunks()
        parent = np.repeat(np.arange(len(q)), np.asarray(pa.compute.list_value_length(items), np.int64))
        # numbers that have the order of the texts
        spelt = pa.concat_arrays([rows.column("head").combine_chunks(), items.flatten()]).dictionary_encode()
        order = np.asarray(pa.compute.sort_indices(spelt.dictionary))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        texts, n = spelt.dictionary.take(pa.array(order)), len(order)
        numbers = rank[np.asarray(spelt.indices)]
        head, item = numbers[: len(q)], numbers[len(q) :]
        shown = head_type[form] >= 0
        key = lambda at, types, ids: (q[at] * len(NODE_TYPES) + types) * n + ids
        keys = np.concatenate([key(shown, head_type[form[shown]], head[shown]), key(parent, item_type[form[parent]], item)])
        keys, held = _merged(keys, np.concatenate([bits[shown], bits[parent]]), len(NODE_TYPES) * n, nodes)
        ahead = forward[form[parent]]
        links = key(parent, link_type[form[parent]], np.where(ahead, head[parent], item)) * n + np.where(ahead, item, head[parent])
        links, tied = _merged(links, bits[parent], len(LINK_TYPES) * n * n, relationships)
        take = lambda values, at: values.take(pa.array(at))
        types = [take(pa.array(names), keys // size % len(names)) for names, keys, size in ((NODE_TYPES, keys, n), (LINK_TYPES, links, n * n))]
        of_nodes = [take(asked.dictionary, keys // n // len(NODE_TYPES)), pa.repeat("node", len(keys)), types[0], take(texts, keys % n), pa.nulls(len(keys), pa.string()), take(named, held)]
        of_links = [take(asked.dictionary, links // n // n // len(LINK_TYPES)), pa.repeat("relationship", len(links)), types[1], take(texts, links // n % n), take(texts, links % n), take(named, tied)]
        return pa.concat_tables([pa.table(of_nodes, schema=_ROWS), pa.table(of_links, schema=_ROWS)])

    return gather


def _first(rows: DataFrame, by: str, other: str, most: int) -> DataFrame:
    """The first rows of each ``by`` in order of the other column's text; 0 is no limit."""
    if not most:
        return rows
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(_text(other)))).where(F.col("n") <= most).drop("n")


def _wanting(rows: DataFrame, skill_jobs: DataFrame, nodes: int, relationships: int) -> DataFrame:
    """``(question, intent, skill_id, job_id)``: a row for each job of :func:`_wanting_lists`."""
    return _wanting_lists(rows, skill_jobs, nodes, relationships).select("question", "intent", "skill_id", F.explode("jobs").alias("job_id"))


def _wanting_lists(rows: DataFrame, skill_jobs: DataFrame, nodes: int, relationships: int) -> DataFrame:
    """``(question, intent, skill_id, jobs)``: the jobs that want the skills of ``rows(question, intent, skill_id)``, but none that a question's caps can't show.

    The first jobs of each skill, together at least as many pairs as a cap allows, are some of the question's: where they fill both
    caps, no job beyond their last is among the first of all. So most of a skill's jobs are left out before they are rows.
    """
    if not (nodes and relationships):
        return rows.join(skill_jobs.groupBy("skill_id").agg(F.collect_list("job_id").alias("jobs")), "skill_id").select("question", "intent", "skill_id", "jobs")
    # a skill's jobs are cut to the larger cap
    listed = skill_jobs.groupBy("skill_id").agg(F.array_sort(F.collect_list(F.struct(_text("job_id").alias("id"), "job_id"))).alias("jobs"))
    rows = cut_lineage(rows.select("question", "intent", "skill_id").distinct().join(listed.select("skill_id"), "skill_id", "left_semi"))
    listed = cut_lineage(listed)
    share = F.ceil(F.lit(max(nodes, relationships)) / F.count("*")).cast("int")
    some = rows.join(rows.groupBy("question", "intent").agg(share.alias("share")), ["question", "intent"]).join(listed, "skill_id")
    some = some.select("question", "intent", F.col("skill_id").cast("string").alias("dst"), F.explode(F.slice("jobs", F.lit(1), F.col("share"))).alias("job")).select("question", "intent", "dst", "job.id")
    own = Window.partitionBy("question", "intent")
    some = some.withColumn("pair", F.row_number().over(own.orderBy("id", "dst"))).withColumn("node", F.dense_rank().over(own.orderBy("id")))
    last = some.groupBy("question", "intent").agg(F.min(F.when(F.col("pair") == relationships, F.col("id"))).alias("pair"), F.min(F.when(F.col("node") == nodes, F.col("id"))).alias("node"))
    # one bound for all intents of a question: what is shown names all of them
    last = last.where("pair IS NOT NULL AND node IS NOT NULL").groupBy("question").agg(F.min(F.greatest("pair", "node")).alias("last"))
    shown = F.filter("jobs", lambda job: F.col("last").isNull() | (job["id"] <= F.col("last")))
    return rows.join(last, "question", "left").join(listed, "skill_id").select("question", "intent", "skill_id", F.transform(shown, lambda job: job["job_id"]).alias("jobs"))


def traverse(questions: DataFrame, found: DataFrame, market: Market, depth: int = 2, nodes: int = NODES, relationships: int = RELATIONSHIPS) -> DataFrame:
    """``(question, kind, type, id, dst, intents)`` of ``questions(question, intents)`` and the search's rows ``found(question, place, node_type, node)``.

    ``intents`` names, in order, the intents that found a node or relationship; 0 is no cap.
    """
    return _lists_of(questions, found, market, depth, nodes, relationships).applyInArrow(gathered(nodes, relationships), ", ".join(f"{c} string" for c in _ROWS.names))


def summary(questions: DataFrame, found: DataFrame, market: Market, depth: int = 2, nodes: int = NODES, relationships: int = RELATIONSHIPS) -> DataFrame:
    """``(question, kind, type, intents, n, first, last)``: what :func:`traverse` finds, counted where it is found, with the first and the last as text."""
    gather, by = gathered(nodes, relationships), ["question", "kind", "type", "intents"]

    def count(lists: pa.Table) -> pa.Table:
        rows = gather(lists)
        name = pa.compute.binary_join_element_wise(rows.column("id"), rows.column("dst"), ">", null_handling="skip")
        return rows.select(by).append_column("name", name).group_by(by).aggregate([("name", "count"), ("name", "min"), ("name", "max")])

    kind = ", ".join(f"{c} string" for c in by) + ", n long, first string, last string"
    found = _lists_of(questions, found, market, depth, nodes, relationships)
    return found.applyInArrow(lambda lists: count(lists).rename_columns([*by, "n", "first", "last"]), kind)


def _lists_of(questions: DataFrame, found: DataFrame, market: Market, depth: int, nodes: int, relationships: int) -> GroupedData:
    """The lists of all questions, some questions with all of theirs in each group."""
    most = max(nodes, relationships) if nodes and relationships else 0
    bit = {intent: 1 << k for k, intent in enumerate(FOLLOWED)}
    bits = reduce(lambda a, intent: a.when(F.col("intent") == intent, bit[intent]), FOLLOWED[1:], F.when(F.col("intent") == FOLLOWED[0], bit[FOLLOWED[0]]))
    asks = lambda *intents: F.col("bits").bitwiseAND(F.lit(sum(bit[i] for i in intents)))
    # each is read by several of the parts below, and made once
    tasks = asked_for(questions).join(seeds_of(found), "question").groupBy("question", "node_type", "node").agg(F.bit_or(bits).alias("bits"))
    tasks = cut_lineage(tasks.where("bits IS NOT NULL"))
    seeds = lambda kind, key, *intents: tasks.where((F.col("node_type") == kind) & (asks(*intents) != 0)).select("question", "bits", F.col("node").alias(key))
    requires = cut_lineage(market.requires.select("job_id", "skill_id").distinct())
    needs = cut_lineage(requires.groupBy("job_id").agg(F.collect_list("skill_id").alias("skills")))
    posted = market.jobs.select("job_id", "company_id")
    place = posted.join(market.companies.select("company_id", "location_id"), "company_id")

    from_jobs = seeds("Job", "job_id", "skill_requirement", "career_path", "salary_analysis", "company_query")
    wanted = cut_lineage(from_jobs.join(needs, "job_id").join(place, "job_id", "left"))
    paid = asks("salary_analysis", "company_query")
    at = lambda key, bits: F.when(F.col(key).isNotNull(), bits)
    parts = [
        _packed(
            wanted,
            _list(REQUIRED, asks("skill_requirement", "career_path", "salary_analysis"), "job_id", F.col("skills")),
            _list(POSTED, at("company_id", paid), "job_id", F.array("company_id")),
            _list(LOCATED, at("location_id", paid), "job_id", F.array("location_id")),
        )
    ]

    # similar skills of all that is asked about, found once
    career, alike = F.lit(bit["career_path"]), F.lit(bit["skill_relationship"])
    from_skills = seeds("Skill", "skill_id", "career_path", "skill_relationship")
    careers = wanted.where(asks("career_path") != 0).select("question", F.explode("skills").alias("skill_id")).distinct()
    start = from_skills.select("skill_id").unionByName(careers.select("skill_id")).distinct()
    near = khop(undirected(market.similar), start, depth).select(F.col("seed").alias("skill_id"), F.col("node").alias("similar_id"))
    skilled = requires.select("skill_id").distinct().withColumn("has", F.lit(True))
    # all similar skills of a skill, those that jobs want, and whether jobs want the skill itself
    near = near.join(skilled.withColumnRenamed("skill_id", "similar_id"), "similar_id", "left")
    near = near.groupBy("skill_id").agg(F.collect_list("similar_id").alias("alike"), F.collect_list(F.when(F.col("has"), F.col("similar_id"))).alias("onward"))
    near = cut_lineage(near.join(skilled, "skill_id", "left"))
    none = F.array().cast("array<string>")
    parts.append(_packed(from_skills.where(asks("skill_relationship") != 0).join(near, "skill_id", "left"), _list(ALIKE, alike, "skill_id", F.coalesce(F.col("alike").cast("array<string>"), none))))
    # a career from a skill goes on where the skill has both similar ones and jobs
    onward = from_skills.where(asks("career_path") != 0).join(near, "skill_id").where("has")
    parts.append(_packed(onward, _list(ALIKE, career, "skill_id", F.col("alike"))))
    # and from a job to other jobs that want skills similar to its own
    reached = careers.join(near, "skill_id").where(F.size("onward") > 0)
    parts.append(_packed(reached, _list(ALIKE, career, "skill_id", F.col("onward"))))
    goes = onward.select("question", "skill_id").unionByName(reached.select("question", F.explode("onward").alias("skill_id"))).withColumn("intent", F.lit("career_path"))
    parts.append(_packed(_wanting_lists(goes, _first(requires, "skill_id", "job_id", most), nodes, relationships), _list(WANTED, career, "skill_id", F.col("jobs"))))

    # all jobs of the companies, and what these require
    company = F.lit(bit["company_query"])
    whole = wanted.where((asks("company_query") != 0) & F.col("company_id").isNotNull()).select("question", "company_id").distinct()
    offers = _first(posted, "company_id", "job_id", most)
    parts.append(_packed(whole.join(offers.groupBy("company_id").agg(F.collect_list("job_id").alias("jobs")), "company_id"), _list(POSTS, company, "company_id", F.col("jobs"))))
    parts.append(_packed(whole.join(offers.join(needs, "job_id"), "company_id"), _list(REQUIRED, company, "job_id", F.col("skills"))))

    every = reduce(DataFrame.unionByName, parts)
    groups = -(-tasks.select("question").distinct().count() // QUESTIONS) or 1
    dealt = every.withColumn("group", F.pmod(F.xxhash64("question"), F.lit(groups))).repartition(-(-groups // TASK_TIMES), "group")
    return dealt.groupBy("group")
