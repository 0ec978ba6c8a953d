"""Sections of a question's context, as tables of lines: matches, related nodes, skill gap and market summary."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import and_others, lakhs, truncated

#: Matches that a context looks at, and lines of each type that it shows.
TOP, SHOWN = 10, {"Job": 5, "Skill": 8, "Company": 5}
#: Related nodes that it shows, and relationships that it counts.
RELATED, COUNTED = {"Skill": 8, "Job": 5, "Company": 5}, 50
#: Characters of a description.
DESCRIPTION = 100


def capped(nodes: DataFrame, order: list[Column], caps: Mapping[str, int]) -> DataFrame:
    """Nodes with their ``rank`` within their type, those within the type's cap; other types are left out.

    Each type is cut by a limit of its own: a task sends on no more than the cap, and no type is sorted as a whole.
    """
    window = Window.partitionBy("node_type").orderBy(*order)
    parts = [nodes.where(F.col("node_type") == label).orderBy(*order).limit(n).withColumn("rank", F.row_number().over(window)) for label, n in caps.items()]
    return reduce(DataFrame.unionByName, parts)


def top_matches(found: DataFrame) -> DataFrame:
    """``(node_type, rank, line)``: of the first ten rows by ``place`` up to five jobs, eight skills and five companies.

    ``found`` has place, node_type, name, company_name, min_salary, max_salary, category and description.
    """
    first = found.orderBy("place").limit(TOP)
    pay = F.when((F.col("min_salary") > 0) & (F.col("max_salary") > 0), F.concat(F.lit(" ("), lakhs(F.col("min_salary")), F.lit(" to "), lakhs(F.col("max_salary")), F.lit(")")))
    at = F.when(F.col("company_name") != "", F.concat(F.lit(" at "), "company_name"))
    of = F.when(F.col("category") != "", F.concat(F.lit(" ("), "category", F.lit(")")))
    said = F.when(F.col("description") != "", F.concat(F.lit(": "), truncated(F.col("description"), DESCRIPTION)))
    empty = lambda c: F.coalesce(c, F.lit(""))
    line = F.when(F.col("node_type") == "Job", F.concat("name", empty(at), empty(pay))).when(F.col("node_type") == "Skill", F.concat("name", empty(of), empty(said))).otherwise(F.col("name"))
    return capped(first, [F.col("place")], SHOWN).select("node_type", "rank", line.alias("line"))


def skill_gap(top: DataFrame, known: DataFrame) -> DataFrame:
    """One row: up to ten sorted names of ``top(name)`` that ``known(name)`` lacks in any case, how many there are, and advice.

    ``top`` is what a search returned, at most some dozens of rows.
    """
    missing = top.where("name <> ''").join(known.select(F.lower("name").alias("_known")).distinct(), F.lower("name") == F.col("_known"), "left_anti")
    names = F.array_sort(F.collect_set("name"))
    n = F.size("names")
    advice = F.when(n == 0, "on the right track").when(n <= 5, F.concat(F.lit("focus on "), n.cast("string"))).when(n <= 10, F.concat(F.lit("first 5 of "), n.cast("string"))).otherwise(F.concat(F.lit("3 to 5 of "), n.cast("string")))
    return missing.agg(names.alias("names")).select(F.array_join(F.slice("names", 1, 10), ", ").alias("skills"), n.cast("long").alias("missing"), advice.alias("advice"))


def market_summary(found: DataFrame) -> DataFrame:
    """One row about a search's rows: jobs, mean least and highest pay of those that name both, companies, and skills."""
    paid = (F.col("min_salary") != 0) & (F.col("max_salary") != 0) & (F.col("node_type") == "Job")
    mean = lambda c: F.floor(F.sum(F.when(paid, F.col(c))) / F.count(F.when(paid, 1)))
    return found.agg(
        F.count_if(F.col("node_type") == "Job").alias("jobs"), F.count(F.when(paid, 1)).alias("paid"), mean("min_salary").alias("least"), mean("max_salary").alias("most"),
        and_others(F.collect_set(F.when(F.col("company_name") != "", F.col("company_name"))), 5).alias("companies"), F.count_if(F.col("node_type") == "Skill").alias("skills"),
    ).select("jobs", "paid", lakhs(F.col("least")).alias("least"), lakhs(F.col("most")).alias("most"), "companies", "skills")


def gate(stages: DataFrame) -> DataFrame:
    """``(session, open, blocked_by)``: a question is answered only if no stage before reported an error."""
    failed = F.when(F.col("error").isNotNull() & (F.col("error") != ""), F.col("stage"))
    listed = stages.groupBy("session").agg(F.array_sort(F.collect_set(failed)).alias("f"))
    return listed.select("session", (F.size("f") == 0).alias("open"), F.array_join("f", ", ").alias("blocked_by"))
