"""Queries of CSV ingestion and of the bookkeeping of ingestion runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import first_text, literal_list, stable_id
from graphloom.operators import ingest, linkage
from graphloom.operators.lineage import shared_folder
from graphloom.plans.registry import query
from graphloom.sources import csv_files
from graphloom.sources.tables import Records


def _parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


#: A skills file made of all parts: some rows lack a name, some have quotes, commas and line ends in a cell, some a level that is no number.
_SKILL_CELLS = """p_partkey AS "ID", CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE p_name END AS "NAME", CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('A "quoted", text', chr(10), 'of ', p_type) ELSE concat('=', p_type) END AS "DESCRIPTION",
p_brand AS "CATEGORY", p_type AS "SUBCATEGORY", CASE WHEN p_partkey % 13 = 0 THEN 'high' ELSE CAST(p_size AS VARCHAR) END AS "LEVEL" """


def _skills_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the file and scan it again."""
    part, key = _parquet(spark, sf_dir, "part"), F.col("p_partkey")
    quoted = F.concat(F.lit('A "quoted", text\nof '), "p_type")
    rows = part.select(
        key.alias("ID"), F.when(key % 11 == 0, "  ").otherwise(F.col("p_name")).alias("NAME"),
        F.when(key % 4 == 0, None).when(key % 4 == 1, quoted).otherwise(F.concat(F.lit("="), "p_type")).alias("DESCRIPTION"),
        F.col("p_brand").alias("CATEGORY"), F.col("p_type").alias("SUBCATEGORY"), F.when(key % 13 == 0, "high").otherwise(F.col("p_size").cast("string")).alias("LEVEL"),
    )
    path = _new_folder(spark)
    csv_files.write_csv(rows, path)
    return csv_files.scan(spark, path)


@query(f"""SELECT "ID"::VARCHAR AS id, "NAME" AS name, nullif("DESCRIPTION", '') AS description, "CATEGORY" AS category, "SUBCATEGORY" AS subcategory, "LEVEL" AS level FROM (SELECT {_SKILL_CELLS} FROM part)""")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of a file as text, with quotes, commas and line ends inside cells."""
    rows = _skills_file(spark, sf_dir)
    return rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns])


@query("SELECT count(*) AS total, least(count(*), 10) AS shown, count(*) > 10 AS has_more FROM part")
def csv_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a preview shows, and of how many."""
    seen = csv_files.preview(_skills_file(spark, sf_dir))
    return seen.rows.agg(F.count("*").alias("shown")).select(F.lit(seen.total).cast("long").alias("total"), "shown", F.lit(seen.has_more).alias("has_more"))


@query(
    """SELECT 'skills' AS file, 0 AS place, NULL AS message WHERE false UNION ALL
SELECT * FROM (VALUES ('jobs', 0, 'Required columns: Job ID, Job Title, Company Name, Location, standardized_skills'), ('jobs', 1, 'Missing columns: Job Title, Company Name, Location, standardized_skills'),
 ('jobs', 2, 'Found columns: job id, NAME'), ('empty', 0, 'CSV has header row but no data')) t"""
)
def header_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages about three files: a good one of skills, one of jobs with two columns, and one without rows."""
    jobs = _parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job id"), F.col("o_orderpriority").alias("NAME"))
    files = {"skills": (_skills_file(spark, sf_dir), csv_files.SKILL_COLUMNS), "jobs": (jobs, csv_files.JOB_COLUMNS), "empty": (jobs.where("false"), csv_files.JOB_COLUMNS)}
    rows = [(name, place, message) for name, (df, required) in files.items() for place, message in enumerate(csv_files.header_errors(df, required))]
    return spark.createDataFrame(rows, "file string, place int, message string")


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _skills_file(spark, sf_dir).withColumn("row_number", F.col("ID").cast("long") + 2)
    return ingest.split_typed(rows, ["ID", "NAME"], {"LEVEL": "int"}, "row_number")


@query(
    f"""WITH s AS (SELECT {_SKILL_CELLS} FROM part)
SELECT "ID" + 2 AS row_number, CASE WHEN trim("NAME") = '' THEN 'Missing required field: NAME' ELSE 'Invalid data type: LEVEL must be int' END AS error_message FROM s WHERE trim("NAME") = '' OR "LEVEL" = 'high'"""
)
def error_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of rejected rows, written and read again: fields that are missing, and cells that are not of their type."""
    _, errors = _typed(spark, sf_dir)
    path = _new_folder(spark)
    csv_files.write_errors(errors, path)
    return csv_files.scan(spark, path).select(F.col("row_number").cast("long").alias("row_number"), "error_message")


@query(f"""WITH s AS (SELECT {_SKILL_CELLS} FROM part) SELECT "ID"::VARCHAR AS id, "LEVEL"::INTEGER AS level FROM s WHERE trim("NAME") <> '' AND "LEVEL" <> 'high'""")
def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that an ingestion takes, with the types asked for."""
    good, _ = _typed(spark, sf_dir)
    return good.select(F.col("ID").alias("id"), F.col("LEVEL").alias("level"))


@query(f"""WITH s AS (SELECT {_SKILL_CELLS} FROM part) SELECT "ID" AS id, coalesce(nullif(trim("DESCRIPTION"), ''), nullif(trim("NAME"), ''), '') AS text FROM s""")
def embedding_text_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a skill that would be embedded: its description, else its name."""
    rows = _skills_file(spark, sf_dir)
    return rows.select(F.col("ID").cast("long").alias("id"), first_text(F.col("DESCRIPTION"), F.col("NAME")).alias("text"))


#: Jobs that name their skills in a list cell, with a shorter list of scores.
_TAXONOMY = "p_partkey % 3 <> 0"
_MENTIONED = f"""WITH cells AS (SELECT p_partkey AS job_id, p_name, p_size FROM part),
tax AS (SELECT DISTINCT lower(trim(p_name)) AS c FROM part WHERE {_TAXONOMY}),
m AS (SELECT job_id, 1 AS position, lower(trim(p_name)) AS name, 0.5::DOUBLE AS score FROM cells UNION ALL SELECT job_id, 2, lower(trim(p_name)), p_size::DOUBLE FROM cells UNION ALL SELECT job_id, 3, lower(trim(p_name)) || 'xyzq', NULL FROM cells),
near AS (SELECT name, count(*) AS n, min(levenshtein(name, c)) AS d, min(c) AS c FROM (SELECT DISTINCT name FROM m WHERE name NOT IN (SELECT c FROM tax)), tax WHERE levenshtein(name, c) <= 2 GROUP BY name),
linked AS (SELECT m.*, CASE WHEN name IN (SELECT c FROM tax) THEN 'exact' WHEN n = 1 THEN 'fuzzy' ELSE 'orphan' END AS match_type, CASE WHEN name IN (SELECT c FROM tax) THEN name WHEN n = 1 THEN c END AS matched,
  CASE WHEN name IN (SELECT c FROM tax) THEN 1.0 WHEN n = 1 THEN 1.0 - d / 10 END AS confidence FROM m LEFT JOIN near USING (name))"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    names = F.concat(F.lit('[None, "'), name, F.lit('", "'), F.upper(name), F.lit('", "'), name, F.lit('xyzq"]'))
    cells = _parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("job_id"), names.alias("names"), F.concat(F.lit("0.5, "), F.col("p_size").cast("string")).alias("scores"))
    return linkage.mentions(cells, "job_id", literal_list(F.col("names")), F.split("scores", ","))


def _mention_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    said = _mentions(spark, sf_dir)
    return said, linkage.link(said, _parquet(spark, sf_dir, "part").where(_TAXONOMY), taxonomy_col="p_name")


@query(f"{_MENTIONED} SELECT job_id, matched, round(arg_min(score, position), 6) AS score, round(arg_min(confidence, position), 6) AS confidence FROM linked WHERE matched IS NOT NULL GROUP BY job_id, matched")
def requires_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from jobs to matched skills, with the score at the name's place in the list and the match's confidence; of repeated names the first."""
    edges = linkage.requires_edges(*_mention_links(spark, sf_dir))
    return edges.withColumns({c: F.round(c, 6) for c in ("score", "confidence")})


@query(f"{_MENTIONED} SELECT match_type, count(*) AS mentions, count(DISTINCT name) AS names FROM linked GROUP BY match_type")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions and names of each kind of match."""
    return linkage.match_counts(*_mention_links(spark, sf_dir))


@query(f"{_MENTIONED} SELECT DISTINCT sha256(name) AS skill_id, name FROM linked WHERE match_type = 'orphan'")
def orphan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same id for an orphan's name in every run."""
    _, links = _mention_links(spark, sf_dir)
    return links.where("match_type = 'orphan'").select(stable_id(F.col("name")).alias("skill_id"), "name")


@query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'created' WHEN p_partkey % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM part WHERE p_partkey % 2 = 0) GROUP BY action")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an ingestion created, updated and left."""
    part = _parquet(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    new = part.where("p_partkey % 2 = 0").withColumn("p_size", F.expr("p_size + IF(p_partkey % 3 = 0, 1, 0)"))
    return ingest.actions(part.where("p_partkey % 7 <> 0"), new, "p_partkey", ["p_name", "p_size"]).groupBy("action").agg(F.count("*").alias("n"))


@query(
    """SELECT o_custkey AS company_id, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderpriority <> '1-URGENT') AS description, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS price
FROM orders GROUP BY o_custkey"""
)
def company_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of a batch, one row each: the first description that isn't blank, and the last of all other fields."""
    orders = _parquet(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").alias("company_id"), F.when(F.col("o_orderpriority") == "1-URGENT", " ").otherwise(F.col("o_orderpriority")).alias("description"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return ingest.merge_batch(rows, "company_id", "o_orderkey", ["description"], ["status", "price"])


@query("SELECT l_orderkey AS job_id, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) + 2) // 3 AS batch FROM lineitem")
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each line in its order's file and the batch of three it falls in, both from 1."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    rows = _parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), place.alias("place"))
    return rows.withColumn("batch", ingest.batch_number(F.col("place"), 3))


#: Runs of ingestion: an order is a run, its lines are the rows, returned ones failed; every fifth run isn't over, every seventh has no good row.
_RUNS = """SELECT l_orderkey AS run, count(*) AS total, CASE WHEN l_orderkey % 7 = 0 THEN 0 WHEN l_orderkey % 5 = 0 THEN count(*) - 1 ELSE count(*) FILTER (WHERE l_returnflag <> 'R') END AS processed,
CASE WHEN l_orderkey % 7 = 0 THEN count(*) WHEN l_orderkey % 5 = 0 THEN 0 ELSE count(*) FILTER (WHERE l_returnflag = 'R') END AS failed, CAST(sum(l_quantity) AS DOUBLE) / 10 AS speed FROM lineitem GROUP BY l_orderkey"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an ingestion run of its lines: those of every seventh fail, one of every fifth is still to come, else returned ones fail."""
    failed = F.col("l_returnflag") == "R"
    rows = _parquet(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run"))
    sums = rows.agg(F.count("*").alias("total"), F.count_if(~failed).alias("good"), F.count_if(failed).alias("bad"), (F.sum("l_quantity").cast("double") / 10).alias("speed"))
    seventh, fifth = F.col("run") % 7 == 0, F.col("run") % 5 == 0
    processed = F.when(seventh, 0).when(fifth, F.col("total") - 1).otherwise(F.col("good"))
    return sums.select("run", "total", processed.alias("processed"), F.when(seventh, F.col("total")).when(fifth, 0).otherwise(F.col("bad")).alias("failed"), "speed")


_STATES = f"""r AS ({_RUNS}), s AS (SELECT *, CASE WHEN processed + failed < total THEN 'processing' WHEN processed = 0 THEN 'failed' WHEN failed > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM r)"""


@query(f"WITH {_STATES} SELECT run, status FROM s")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run goes on, is done, done with errors, or has failed."""
    return _runs(spark, sf_dir).select("run", ingest.job_state(F.col("processed"), F.col("failed"), F.col("total")).alias("status"))


@query(
    f"""WITH {_STATES} SELECT run, round(processed / total * 100, 2) AS pct, CASE WHEN status = 'processing' AND total > processed AND speed > 0 THEN floor((total - processed) / speed)::BIGINT END AS eta, (total + 999) // 1000 AS batches FROM s"""
)
def ingest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a run is: percent, whole seconds left while it goes on, and batches."""
    state = ingest.job_state(F.col("processed"), F.col("failed"), F.col("total"))
    pct, eta, batches = ingest.progress(F.col("total"), F.col("processed"), F.col("speed"), state)
    return _runs(spark, sf_dir).select("run", pct.alias("pct"), eta.alias("eta"), batches.alias("batches"))


@query("SELECT count(*) AS failed, format('{:,} of {:,} rows failed', count(*) FILTER (l_returnflag = 'R'), count(*)) AS summary FROM lineitem")
def ingest_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence about the rows that failed, with thousands apart."""
    counts = _parquet(spark, sf_dir, "lineitem").agg(F.count("*").alias("failed"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    return counts.select("failed", ingest.error_summary(F.col("bad"), F.col("failed")).alias("summary"))


_GONE = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"


@query(
    f"""WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem), gone AS ({_GONE}), kept AS (SELECT * FROM e WHERE src NOT IN (SELECT * FROM gone) AND dst NOT IN (SELECT * FROM gone))
SELECT count(*) AS kept, (SELECT count(*) FROM e) - count(*) AS removed FROM kept"""
)
def edge_cleanup_both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left and removed when those at either end of the given nodes go."""
    edges = _parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return ingest.removal_counts(edges, _parquet(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderkey", both_ends=True)


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 2 = 0")
def full_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that takes the place of all rows, written over the old ones after the confirmation."""
    part = _parquet(spark, sf_dir, "part").select("p_partkey", "p_size")
    table = Records(spark, _new_folder(spark)).append(part)
    return Records(spark, table.folder).append(ingest.replace_all(table.rows(), part.where("p_partkey % 2 = 0"), ingest.CONFIRMATION)).rows()


@query("SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS relationships, 0 AS left_over")
def delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a deletion of the whole graph removes, and what is left."""
    edges = _parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    counts, nodes, rest = ingest.delete_all(_parquet(spark, sf_dir, "part").select("p_partkey"), edges)
    return counts.withColumn("left_over", F.lit(nodes.count() + rest.count()))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice >= 1000"""
)
def record_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of records after two appends, an update and two deletions."""
    rows = _parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    table = Records(spark, _new_folder(spark)).append(rows.where("id % 2 = 0")).append(rows.where("id % 2 = 1"))
    table = table.update(F.col("status") == "O", {"status": F.lit("open")}).delete(F.col("priority") == "5-LOW").delete(F.col("price") < 1000)
    return table.rows().drop("priority")


@query("SELECT p_brand AS label, 'ONLINE' AS state, count(*) AS entries, round(count(vec_id) / count(*) * 100, 2) AS population_pct FROM part LEFT JOIN embeddings ON vec_id = p_partkey GROUP BY p_brand HAVING count(vec_id) = count(*) UNION ALL SELECT p_brand, 'POPULATING', count(*), round(count(vec_id) / count(*) * 100, 2) FROM part LEFT JOIN embeddings ON vec_id = p_partkey GROUP BY p_brand HAVING count(vec_id) < count(*) AND count(vec_id) > 0 UNION ALL SELECT p_brand, 'EMPTY', count(*), 0.0 FROM part LEFT JOIN embeddings ON vec_id = p_partkey GROUP BY p_brand HAVING count(vec_id) = 0")
def index_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each label's vectors in place of an index catalogue: all there, some, or none."""
    from graphloom.operators import vector_search

    vectors = _parquet(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return vector_search.catalogue(_parquet(spark, sf_dir, "part"), vectors, "p_partkey", "p_brand")
