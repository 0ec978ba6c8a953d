"""Queries of the query log and of its storage: types, pages, stage sums, eviction, archives and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import monitor
from graphloom.plans.registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


#: Texts of graph queries, by event.
_TEXT = """CASE event_id % 9 WHEN 0 THEN 'CALL db.index.vector.queryNodes(i, 5, v)' WHEN 1 THEN 'MATCH (a)-[:R]->(b)-[:S]->(c) RETURN c' WHEN 2 THEN 'MATCH (a) OPTIONAL MATCH (a)-[:R]->(b) RETURN b'
 WHEN 3 THEN 'MATCH (a)-[:R]->(b) RETURN b' WHEN 4 THEN 'merge (a) return a' WHEN 5 THEN 'SHOW TABLES OFFSET 5' WHEN 6 THEN '  ' WHEN 7 THEN 'create vector index' END"""
_WANTED = "CASE event_id % 9 WHEN 0 THEN 'VECTOR_SEARCH' WHEN 1 THEN 'GRAPH_TRAVERSAL' WHEN 2 THEN 'GRAPH_TRAVERSAL' WHEN 3 THEN 'READ' WHEN 4 THEN 'WRITE' WHEN 5 THEN 'WRITE' WHEN 7 THEN 'VECTOR_SEARCH' ELSE 'OTHER' END"


@query(f"SELECT event_id, {_WANTED} AS type FROM events")
def query_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each logged query does, by its text."""
    return _events(spark, sf_dir).select("event_id", monitor.query_type(F.expr(_TEXT)).alias("type"))


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'OTHER' END AS type, count(*) AS n FROM events GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of known types, and all others together."""
    return monitor.type_counts(_events(spark, sf_dir).withColumnRenamed("event_type", "type"), "type", ("click", "view"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 30 OFFSET 5")
def log_search_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the log with one of its optional filters set."""
    return monitor.search(_events(spark, sf_dir), "ts", "event_id", 30, 5, event_type="click", user_id=None).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id = 17")
def log_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.by_id(_events(spark, sf_dir), "event_id", 17).select("event_id", "user_id", "event_type")


@query(
    """SELECT user_id, round(sum(value), 4) AS total_ms, count(*) FILTER ((event_type = 'click' AND value >= 50) OR (event_type = 'view' AND value >= 100)) = 0 AND sum(value) < 200 AS within FROM events GROUP BY user_id"""
)
def stage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's stages added up, and whether they keep targets of 50, 100 and 200 ms."""
    return monitor.stage_sums(_events(spark, sf_dir), "user_id", "event_type", "value", {"click": 50, "view": 100}, 200).withColumn("total_ms", F.round("total_ms", 4))


@query(
    """WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, max(ts) AS last FROM events GROUP BY user_id)
SELECT user_id, stage FROM s WHERE user_id NOT IN (SELECT user_id FROM s ORDER BY last, user_id LIMIT 10) OR (SELECT count(*) FROM s) <= 20"""
)
def session_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their latest stage, without the ten oldest of more than 20."""
    found = _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("last"))
    return monitor.evict(found, "last", "user_id", 20, 10).select("user_id", "stage")


_LAST = "(SELECT max(ts) FROM events)"


def _before(spark: SparkSession, sf_dir: str, days: int) -> F.Column:
    last = _events(spark, sf_dir).agg(F.max("ts").alias("t")).first()["t"]
    return F.lit(last).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))


@query(f"SELECT event_id FROM events WHERE ts >= {_LAST} - INTERVAL 30 DAY")
def history_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History that stays when what is older than 30 days goes."""
    kept, _ = monitor.split_by_age(_events(spark, sf_dir), "ts", _before(spark, sf_dir, 30))
    return kept.select("event_id")


@query(f"SELECT CASE WHEN ts < {_LAST} - INTERVAL 90 DAY THEN 'archive' ELSE 'live' END AS part, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def archive_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows older than 90 days written to an archive, and the rest; both read again."""
    import uuid

    from graphloom.operators.lineage import shared_folder
    from graphloom.sources.tables import Records

    live, old = monitor.split_by_age(_events(spark, sf_dir), "ts", _before(spark, sf_dir, 90))
    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    parts = {"live": Records(spark, folder).append(live).rows(), "archive": Records(spark, folder).append(old).rows()}
    every = parts["live"].withColumn("part", F.lit("live")).unionByName(parts["archive"].withColumn("part", F.lit("archive")))
    return every.groupBy("part").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(
    f"""WITH r AS (SELECT length(props) AS s FROM events WHERE ts > {_LAST} - INTERVAL 7 DAY)
SELECT count(*) AS n, round(coalesce(avg(s), 0), 6) AS mean, coalesce(sum(s), 0)::BIGINT // (1024 * 1024) AS mb, coalesce(max(s), 0)::BIGINT AS largest, 'ok' AS total_alert, 'ok' AS mean_alert, 'ok' AS largest_alert FROM r"""
)
def storage_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage of the last seven days, with its alerts."""
    rows = _events(spark, sf_dir).where(F.col("ts") > _before(spark, sf_dir, 7))
    return monitor.storage_alerts(rows, F.length("props"))


@query(f"SELECT user_id, count(*) AS n, sum(length(props))::BIGINT AS total, round(avg(length(props)), 6) AS mean FROM events WHERE ts > {_LAST} - INTERVAL 30 DAY GROUP BY user_id ORDER BY total DESC, user_id LIMIT 20")
def usage_by_user_30_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage of the last 30 days by user, the largest 20."""
    size = F.length("props")
    rows = _events(spark, sf_dir).where(F.col("ts") > _before(spark, sf_dir, 30)).groupBy("user_id")
    return rows.agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.round(F.avg(size), 6).alias("mean")).orderBy(F.desc("total"), "user_id").limit(20)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 20")
def newest_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 queries that name a value in their JSON."""
    k = F.get_json_object("props", "$.k")
    return _events(spark, sf_dir).where(k.isNotNull()).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", k.alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE / 100 AS confidence FROM events WHERE json_extract_string(props, '$.k')::DOUBLE / 100 < 0.7 ORDER BY confidence, event_id LIMIT 50")
def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least confident answers below 0.7, ordered as numbers."""
    confidence = F.get_json_object("props", "$.k").try_cast("double") / 100
    return _events(spark, sf_dir).select("event_id", confidence.alias("confidence")).where("confidence < 0.7").orderBy("confidence", "event_id").limit(50)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_ms, round(avg(length(props)), 6) AS avg_result FROM events WHERE event_type LIKE 'c%' GROUP BY event_type")
def source_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and size of the results of one family of sources."""
    rows = _events(spark, sf_dir).where(F.col("event_type").startswith("c"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_ms"), F.round(F.avg(F.length("props")), 6).alias("avg_result"))


@query(
    f"""SELECT o_orderkey AS run, round(o_orderkey % 97 / 97 * 100, 2) AS pct, date_diff('second', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS seconds FROM orders WHERE o_orderstatus = 'P'"""
)
def reindex_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that go on, with percent done and seconds since their start."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    last = orders.agg(F.max("o_orderdate").alias("t")).first()["t"]
    since = F.unix_timestamp(F.lit(last).cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("run"), F.round(F.col("o_orderkey") % 97 / 97 * 100, 2).alias("pct"), since.alias("seconds"))
