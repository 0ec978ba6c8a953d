"""Monitoring of a query log: totals, paging, latest states, recency windows and averages over time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(log: DataFrame, failed: Column, ms: str) -> DataFrame:
    """One row: all, successful and failed queries, and their mean duration."""
    return log.agg(F.count("*").alias("total"), F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed"), F.round(F.avg(ms), 6).alias("avg_ms"))


def slowest(log: DataFrame, ms: str, key: str, least: float, limit: int) -> DataFrame:
    return log.where(F.col(ms) >= least).orderBy(F.desc(ms), key).limit(limit)


def latest(log: DataFrame, by: str, value: str, *order: str) -> DataFrame:
    """The last value of each group; aggregated before the shuffle."""
    return log.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias(value))


#: Parts of time over which a group's rows are spread before their order is told.
PARTS = 32


def _ranked(log: DataFrame, by: str, time: str, key: str) -> DataFrame:
    """The log with ``rank``, each row's place in its group from the last one back.

    A group may hold a third of all rows, so it is cut into parts of time, rows are ranked within a part, and the
    sizes of the later parts (at most ``PARTS`` of a group) are added.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    ends = log.groupBy(by).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    part = F.floor((at - F.col("_lo")) * PARTS / (F.col("_hi") - F.col("_lo") + 1)).cast("int")
    spread = log.join(ends, by).withColumn("_part", part).drop("_lo", "_hi")
    sizes = spread.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    later = sizes.withColumn("_later", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(by, "_part").orderBy(F.desc(time), F.desc(key)))
    return spread.withColumn("_within", within).join(later, [by, "_part"]).withColumn("rank", (F.col("_within") + F.col("_later")).cast("int")).drop("_part", "_within", "_later")


def last_of_each(log: DataFrame, by: str, time: str, key: str, n: int, hours: int) -> DataFrame:
    """The last n rows of each group within some hours of the group's last one, with their ``rank``.

    The rank's limit is applied to each task's rows before the shuffle, so no task gets all rows of a large group.
    """
    same = Window.partitionBy(by)
    last = log.withColumn("rank", F.row_number().over(same.orderBy(F.desc(time), F.desc(key)))).where(F.col("rank") <= n)
    return last.withColumn("_last", F.max(time).over(same)).where(F.col(time) > F.col("_last") - F.make_interval(hours=F.lit(hours))).drop("_last")


def moving_average(log: DataFrame, by: str, value: str, time: str, key: str, alpha: float = 0.3) -> DataFrame:
    """Exponential moving average of each group in closed form: a weight for each row's rank from the end, then a sum."""
    ranked = _ranked(log, by, time, key)
    aged = F.pow(F.lit(1 - alpha), F.col("rank") - 1)
    oldest = F.max_by(value, F.col("rank")) * F.pow(F.lit(1 - alpha), F.max("rank") - 1)
    # the oldest row starts the average, so its share is not scaled by alpha
    rest = F.sum(alpha * aged * F.col(value)) - alpha * oldest
    return ranked.groupBy(by).agg((rest + oldest).alias("ema"))


def over_rate(log: DataFrame, by: str, time: str, width: str, most: int) -> DataFrame:
    """Tumbling windows in which a client sent more than it may."""
    return log.groupBy(by, F.window(time, width).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > most).select(by, F.col("w.start").alias("start"), "n")


# Words that tell what a graph query does, in order of precedence; they count inside other words too.
WRITES = ("CREATE", "MERGE", "SET", "DELETE", "REMOVE", "DROP")
READS = ("MATCH", "RETURN", "WHERE", "WITH")
#: Types that have a counter of their own.
TYPES = ("READ", "WRITE", "VECTOR_SEARCH", "GRAPH_TRAVERSAL", "OTHER")
#: Most milliseconds of a question's stages and of their sum.
TARGETS = {"vector_search": 1000, "graph_traversal": 2000, "total": 5000}


def query_type(text: Column) -> Column:
    """VECTOR_SEARCH, GRAPH_TRAVERSAL, WRITE, READ or OTHER, by the query's words; null is OTHER."""
    upper = F.upper(F.trim(text))
    has = lambda words: F.coalesce(F.greatest(*[upper.contains(w) for w in words], F.lit(False)), F.lit(False))
    hops = F.size(F.split(text, r"-\[")) - 1
    vector = text.contains("db.index.vector.queryNodes") | upper.contains("VECTOR")
    return F.when(vector, "VECTOR_SEARCH").when((hops > 1) | ((hops > 0) & upper.contains("OPTIONAL MATCH")), "GRAPH_TRAVERSAL").when(has(WRITES), "WRITE").when(has(READS), "READ").otherwise("OTHER")


def type_counts(log: DataFrame, kind: str, known: Sequence[str] = TYPES) -> DataFrame:
    """``(kind, n)``: queries of each type; a type that isn't known counts as OTHER."""
    return log.groupBy(F.when(F.col(kind).isin(*known), F.col(kind)).otherwise("OTHER").alias(kind)).agg(F.count("*").alias("n"))


def search(log: DataFrame, time: str, key: str, limit: int = 100, offset: int = 0, **wanted: object) -> DataFrame:
    """A page of the log, newest first, with the values wanted; those that are None ask for nothing."""
    for column, value in wanted.items():
        if value is not None:
            log = log.where(F.col(column) == F.lit(value))
    return log.orderBy(F.desc(time), F.desc(key)).offset(offset).limit(limit)


def by_id(log: DataFrame, key: str, value: object) -> DataFrame:
    return log.where(F.col(key) == F.lit(value))


def stage_sums(log: DataFrame, question: str, stage: str, ms: str, targets: Mapping[str, float], whole: float) -> DataFrame:
    """``(question, total_ms, within)``: a question's stages added up, and whether each of them and the sum keep their targets."""
    late = None
    for name, most in targets.items():
        late = F.when(F.col(stage) == name, F.col(ms) >= most) if late is None else late.when(F.col(stage) == name, F.col(ms) >= most)
    return log.groupBy(question).agg(F.sum(ms).alias("total_ms"), F.max(F.coalesce(late.otherwise(False), F.lit(False))).alias("_late")).select(
        question, "total_ms", (~F.col("_late") & (F.col("total_ms") < whole)).alias("within")
    )


def evict(sessions: DataFrame, time: str, key: str, most: int = 100, batch: int = 10) -> DataFrame:
    """Sessions that stay when there are more than ``most``: all but the ``batch`` oldest."""
    if sessions.count() <= most:
        return sessions
    oldest = sessions.orderBy(time, key).limit(batch).select(key)
    return sessions.join(oldest, key, "left_anti")


def split_by_age(log: DataFrame, time: str, before: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows that are older; without a time they stay."""
    old = F.coalesce(F.col(time) < before, F.lit(False))
    return log.where(~old), log.where(old)


def storage_alerts(log: DataFrame, size: Column) -> DataFrame:
    """One row: number, mean, whole megabytes and largest of the sizes, with alerts at strict thresholds."""
    total = F.expr("sum(s) div (1024 * 1024)")
    sums = log.select(size.alias("s")).agg(F.count("*").alias("n"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("mean"), F.coalesce(total, F.lit(0)).alias("mb"), F.coalesce(F.max("s"), F.lit(0)).cast("long").alias("largest"))
    level = lambda c, warn, bad: F.when(F.col(c) > bad, "critical").when(F.col(c) > warn, "warning").otherwise("ok")
    return sums.select("n", F.round("mean", 6).alias("mean"), "mb", "largest", level("mb", 100, 200).alias("total_alert"), level("mean", 30_000, 50_000).alias("mean_alert"), F.when(F.col("largest") > 100_000, "warning").otherwise("ok").alias("largest_alert"))
