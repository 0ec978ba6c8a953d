"""Queries of record linkage, ingestion and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import literal_list, sanitize_cell, split_list, token_count
from graphloom.operators import ingest, linkage, monitor
from graphloom.plans.registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Mentions are part names, some misspelt; the taxonomy is the names of two thirds of the parts.
_SPELT = "CASE p_partkey % 5 WHEN 1 THEN substring(p_name, 1, length(p_name) - 1) WHEN 2 THEN concat(p_name, 'xyz') WHEN 3 THEN upper(p_name) WHEN 4 THEN substring(p_name, 1, 1) ELSE p_name END"
_LINKED = f"""
WITH m AS (SELECT p_partkey AS job_id, lower(trim({_SPELT})) AS name FROM part), names AS (SELECT DISTINCT name FROM m),
tax AS (SELECT DISTINCT lower(trim(p_name)) AS c FROM part WHERE p_partkey % 3 <> 0),
near AS (SELECT name, count(*) AS n, min(levenshtein(name, c)) AS d, list_sort(list(c)) AS cs FROM names, tax
  WHERE length(name) >= 2 AND name NOT IN (SELECT c FROM tax) AND levenshtein(name, c) <= 2 GROUP BY name),
linked AS (SELECT name, CASE WHEN length(name) < 2 THEN 'orphan' WHEN e THEN 'exact' WHEN n = 1 THEN 'fuzzy' ELSE 'orphan' END AS match_type,
  CASE WHEN length(name) < 2 THEN NULL WHEN e THEN name WHEN n = 1 THEN cs[1] END AS matched,
  CASE WHEN length(name) < 2 THEN NULL WHEN e THEN 1.0 WHEN n = 1 THEN 1.0 - d / 10 END AS confidence,
  CASE WHEN length(name) < 2 THEN 'too_short' WHEN e OR n = 1 THEN NULL WHEN n > 1 THEN 'ambiguous_fuzzy_match' ELSE 'no_match' END AS reason,
  coalesce(array_to_string(cs, ','), '') AS candidates FROM (SELECT *, name IN (SELECT c FROM tax) AS e FROM names LEFT JOIN near USING (name)))
"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("job_id"), F.expr(_SPELT).alias("name"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link(_mentions(spark, sf_dir), _table(spark, sf_dir, "part").where("p_partkey % 3 <> 0"), taxonomy_col="p_name")


@query(f"{_LINKED} SELECT * FROM linked")
def link_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).withColumn("candidates", F.concat_ws(",", "candidates")).withColumn("confidence", F.round("confidence", 6))


@query(f"{_LINKED} SELECT match_type, coalesce(reason, '') AS reason, count(*) AS names FROM linked GROUP BY ALL")
def link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).groupBy("match_type", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("names"))


@query(f"{_LINKED} SELECT name, reason, candidates, count(DISTINCT job_id) AS jobs FROM linked JOIN m USING (name) WHERE match_type = 'orphan' GROUP BY ALL")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = linkage.review_queue(_mentions(spark, sf_dir), _linked(spark, sf_dir))
    return queue.select("name", "reason", F.concat_ws(",", "candidates").alias("candidates"), F.col("jobs_requiring_skill").alias("jobs"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An old table of parts and a new one with changed, unchanged and new rows."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return part.where("p_partkey % 7 <> 0"), part.where("p_partkey % 2 = 0").withColumn("p_size", F.expr("p_size + IF(p_partkey % 3 = 0, 1, 0)"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'created' WHEN p_partkey % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM part WHERE p_partkey % 2 = 0")
def upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.actions(*_versions(spark, sf_dir), "p_partkey", ["p_name", "p_size"])


@query(
    """SELECT p_partkey, p_name, p_size + CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 1 ELSE 0 END AS p_size,
CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 1 END AS created_at, CASE WHEN p_partkey % 2 = 0 AND (p_partkey % 7 = 0 OR p_partkey % 3 = 0) THEN 2 ELSE 1 END AS updated_at
FROM part WHERE p_partkey % 7 <> 0 OR p_partkey % 2 = 0"""
)
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return ingest.upsert(old.withColumns({"created_at": F.lit(1), "updated_at": F.lit(1)}), new, "p_partkey", ["p_name", "p_size"], F.lit(2))


@query("SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey)) AS last_part, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY l_orderkey")
def write_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    # line numbers repeat within an order, so the part decides between equal ones
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.struct("l_linenumber", "l_partkey").alias("place"))
    last = ingest.last_write(lines, "l_orderkey", "place").select("l_orderkey", F.col("l_partkey").alias("last_part"))
    return last.join(ingest.first_write(lines, "l_orderkey", "place").select("l_orderkey", F.col("l_partkey").alias("first_part")), "l_orderkey")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_returnflag")


@query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem")
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).select("src", "dst", "l_returnflag")
    return ingest.merge_edges(edges.where("l_returnflag = 'A'").dropDuplicates(["src", "dst"]), edges).select("src", "dst")


@query("WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem) SELECT src, dst FROM e WHERE src NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def edge_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return ingest.remove_edges(_edges(spark, sf_dir).select("src", "dst").distinct(), gone, "o_orderkey")


@query("SELECT count(*) AS kept, (SELECT count(*) FROM documents) - count(*) AS errors FROM documents WHERE trim(coalesce(text, '')) <> '' AND trim(coalesce(lang, '')) <> ''")
def required_field_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, errors = ingest.split_valid(_table(spark, sf_dir, "documents"), ["text", "lang"], "doc_id")
    return good.agg(F.count("*").alias("kept")).crossJoin(errors.agg(F.count("*").alias("errors")))  # two single rows


@query("SELECT doc_id, CASE WHEN regexp_matches(trim(coalesce(source, '')), '^[=+@|%-]') THEN '''' || source ELSE coalesce(source, '') END AS source, coalesce(length(text), 0) // 4 AS tokens FROM documents")
def sanitized_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", sanitize_cell(F.col("source")).alias("source"), token_count(F.col("text")).alias("tokens"))


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> '') AS items FROM part")
def parse_list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", split_list(F.translate("p_name", " ", ",")).alias("items"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 6) AS avg_ms FROM events")
def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.totals(_table(spark, sf_dir, "events"), F.col("event_type") == "error", "value")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_ms, round(stddev_samp(value), 6) AS sd_ms FROM events GROUP BY event_type")
def log_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_ms"), F.round(F.stddev_samp("value"), 6).alias("sd_ms"))


@query("SELECT event_id, event_type, value FROM events WHERE value >= 200 ORDER BY value DESC, event_id LIMIT 50")
def slow_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.slowest(_table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", "event_id", 200, 50)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id % 2 = 0 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 10")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "events").where("event_type = 'error' AND user_id % 2 = 0")
    return found.orderBy(F.desc("ts"), F.desc("event_id")).offset(10).limit(20).select("event_id", "user_id")


@query("SELECT event_type, count(*) FILTER (value < 50) AS fast, count(*) FILTER (value >= 50 AND value < 100) AS fair, count(*) FILTER (value >= 100) AS late FROM events GROUP BY event_type")
def stage_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(count("value < 50", "fast"), count("value >= 50 AND value < 100", "fair"), count("value >= 100", "late"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def session_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.latest(_table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query(
    """WITH r AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM r WHERE ts > last - INTERVAL 24 HOUR) WHERE rank <= 5"""
)
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.last_of_each(_table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 5, 24).select("user_id", "event_id", "rank")


@query("SELECT count(*) AS n, user_id, date_trunc('hour', ts) AS start FROM events GROUP BY user_id, start HAVING count(*) > 1")
def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.over_rate(_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "1 hour", 1).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, value AS ema FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, 0.3 * r.value + 0.7 * f.ema FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT user_id, round(arg_max(ema, k), 6) AS ema FROM f GROUP BY user_id"""
)
def speed_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.moving_average(_table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id").withColumn("ema", F.round("ema", 6))


@query("SELECT date_trunc('week', ts) AS week, count(*) AS n, sum(length(props))::BIGINT AS chars, max(length(props)) AS longest FROM events GROUP BY week")
def growth_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")
    return _table(spark, sf_dir, "events").groupBy(week).agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("chars"), F.max(F.length("props")).alias("longest"))


@query("SELECT doc_id, length(text) AS size FROM documents ORDER BY size DESC NULLS LAST, doc_id LIMIT 10")
def largest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size")).orderBy(F.desc_nulls_last("size"), "doc_id").limit(10)


@query("SELECT user_id, count(*) AS n, sum(length(props))::BIGINT AS total FROM events GROUP BY user_id ORDER BY total DESC, user_id LIMIT 20")
def usage_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("total")).orderBy(F.desc("total"), "user_id").limit(20)


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(avg(value), 6) AS avg_ms FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY k")
def json_intent_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return _table(spark, sf_dir, "events").where(k.isNotNull()).groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_ms"))


_CELL = "CASE p_partkey % 5 WHEN 0 THEN concat('[None, \"', p_name, '\", \"Java\"]') WHEN 1 THEN p_name WHEN 2 THEN concat('\"', p_name, '\"') WHEN 3 THEN '  ' ELSE NULL END"


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '|Java' WHEN 1 THEN trim(p_name) WHEN 2 THEN p_name ELSE '' END AS items FROM part")
def literal_list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of a part from a cell in Python's notation."""
    return _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", literal_list(F.expr(_CELL))).alias("items"))
