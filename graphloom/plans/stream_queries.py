"""Structured Streaming queries over the query log, with the SQL of their batch equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.registry import query
from graphloom.streaming import events, machines


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.run_now(events.running_totals(events.read_log(spark, sf_dir)), ["event_type"]).withColumn("total", F.round("total", 4))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.run_now(events.windows(events.read_log(spark, sf_dir)), ["start", "event_type"])
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events.read_log(spark, sf_dir)
    return events.run_now(events.first_events(log.unionByName(log)).select("event_id")).agg(F.count("*").alias("n"))


@query(
    """WITH marked AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 8 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOURS AS "end", count(*) AS n FROM numbered GROUP BY user_id, s
HAVING max(ts) + INTERVAL 8 HOURS <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user that have ended, eight hours without an event apart."""
    found = events.run_now(events.sessions(events.read_log(spark, sf_dir), "8 hours"))
    return found.select("user_id", F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "n")


@query("SELECT user_id, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY user_id, date_trunc('day', ts) HAVING count(*) > 1 AND date_trunc('day', ts) + INTERVAL 1 DAY <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR")
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that sent more than one request in a day, once the day is over."""
    found = events.run_now(events.over_rate(events.read_log(spark, sf_dir), "1 day", 1))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 events of each user, from a table of bounded size that each micro-batch is merged into."""
    return events.recent_now(events.read_log(spark, sf_dir), 20)


@query(
    """WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, value AS ema FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, 0.3 * r.value + 0.7 * f.ema FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT user_id, round(arg_max(ema, k), 6) AS ema FROM f GROUP BY user_id"""
)
def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's moving average as a stream."""
    found = events.run_now(events.moving_average(events.read_log(spark, sf_dir)), ["user_id"])
    return found.select("user_id", F.round("ema", 6).alias("ema"))


#: What the watermark has passed when the stream has read all there is.
_PASSED = "ts < date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR"


@query(
    f"""WITH RECURSIVE r AS (
  SELECT user_id, ts, event_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE {_PASSED}),
m AS (
  SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, 'closed' AS before, 'closed' AS mid, 'closed' AS state, 0 AS good, []::TIMESTAMP[] AS recent, NULL::TIMESTAMP AS failed_at FROM r
  UNION ALL
  SELECT user_id, k, event_id, ts, before, mid,
    CASE WHEN mid = 'half_open' AND failed THEN 'open' WHEN mid = 'half_open' AND good + 1 >= 2 THEN 'closed' WHEN mid = 'closed' AND failed AND len(now) >= 3 THEN 'open' ELSE mid END,
    CASE WHEN mid = 'half_open' AND NOT failed AND good + 1 < 2 THEN good + 1 ELSE 0 END,
    CASE WHEN mid = 'closed' AND failed AND len(now) < 3 THEN now WHEN mid = 'closed' AND NOT failed THEN recent ELSE [] END,
    CASE WHEN failed AND mid <> 'open' THEN ts ELSE failed_at END
  FROM (
    SELECT m.user_id, r.k, r.event_id, r.ts, r.failed, m.state AS before, m.recent, m.failed_at,
      CASE WHEN m.state = 'open' AND r.ts - m.failed_at >= INTERVAL 1 DAY THEN 'half_open' ELSE m.state END AS mid,
      CASE WHEN m.state = 'half_open' THEN m.good ELSE 0 END AS good,
      list_append(list_filter(m.recent, lambda t: t > r.ts - INTERVAL 5 DAYS), r.ts) AS now
    FROM m JOIN r ON r.user_id = m.user_id AND r.k = m.k + 1)),
turned AS (
  SELECT user_id, event_id, ts, 1 AS step, mid AS state FROM m WHERE k > 0 AND mid <> before UNION ALL
  SELECT user_id, event_id, ts, CASE WHEN mid <> before THEN 2 ELSE 1 END, state FROM m WHERE k > 0 AND state <> mid)
SELECT * FROM turned"""
)
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each user's circuit, errors being failures: three in five days open it, for a day; the log is too thin for seconds."""
    day = 86_400
    turns = machines.breaker(events.read_log(spark, sf_dir), F.col("user_id"), F.col("event_type") == "error", 5 * day, 3, 2, day)
    found = events.run_now(turns, conf=machines.STORE)
    return found.select(F.col("source").alias("user_id"), "event_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), "step", "state")


_MONITOR = "(regexp_extract(props, '[0-9]+')::INTEGER // 25)"


@query(
    f"""WITH RECURSIVE r AS (
  SELECT {_MONITOR} AS monitor, user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY {_MONITOR} ORDER BY ts, event_id) AS k FROM events WHERE {_PASSED}),
m AS (
  SELECT DISTINCT monitor, 0::BIGINT AS k, []::STRUCT(u BIGINT, started TIMESTAMP, first_k BIGINT, last TIMESTAMP)[] AS held FROM r
  UNION ALL
  SELECT monitor, k, CASE WHEN len(held) > 60 THEN held[7:] ELSE held END
  FROM (
    SELECT monitor, k, CASE WHEN len(list_filter(alive, lambda x: x.u = u)) > 0
        THEN list_transform(alive, lambda x: {{'u': x.u, 'started': x.started, 'first_k': x.first_k, 'last': CASE WHEN x.u = u THEN ts ELSE x.last END}})
        ELSE list_append(alive, {{'u': u, 'started': ts, 'first_k': k, 'last': ts}}) END AS held
    FROM (SELECT r.monitor, r.k, r.user_id AS u, r.ts, list_filter(m.held, lambda x: x.last >= r.ts - INTERVAL 3 DAYS) AS alive FROM m JOIN r ON r.monitor = m.monitor AND r.k = m.k + 1))),
final AS (SELECT monitor, unnest(held) AS s FROM m QUALIFY k = max(k) OVER (PARTITION BY monitor))
SELECT f.monitor, f.s.u AS session, f.s.started AS started, r.event_type AS stage, arg_max(r.event_id, r.k) AS event_id
FROM final f JOIN r ON r.monitor = f.monitor AND r.user_id = f.s.u AND r.k >= f.s.first_k GROUP BY ALL"""
)
def stream_session_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each monitor's sessions with the latest event of every stage: 60 of them at most, the six oldest evicted beyond that, and none after three days of silence."""
    monitor = F.expr("cast(regexp_extract(props, '[0-9]+', 0) as int) div 25").cast("int")
    tables = machines.session_stages(events.read_log(spark, sf_dir), monitor, F.col("user_id"), F.col("event_type"), 60, 6, 3 * 86_400)
    found = events.run_now(tables, conf=machines.STORE)
    last = found.groupBy("monitor").agg(F.max("as_of").alias("as_of"))
    return found.join(last, ["monitor", "as_of"]).select("monitor", "session", F.timestamp_micros("started").cast("timestamp_ntz").alias("started"), "stage", "event_id")
