"""Exact quantiles without a group's values in one task: selection by refined histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut_lineage

#: Parts that the range which holds a rank is cut into each round.
BINS = 1024


def exact_quantiles(rows: DataFrame, group: str, value: str, shares: Sequence[float], most_rounds: int = 400) -> DataFrame:
    """``(group, share, quantile)``: quantiles with linear interpolation between neighbouring values, as SQL's continuous percentile.

    Each round counts the values by bins of the range in which a wanted rank lies, and goes on with the one bin that holds
    it, as narrow as its own least and largest value. Counts are added up before the shuffle, so a task holds ``BINS``
    numbers for each rank and never a group's values. It ends when all values left are equal; the result is exact.
    Null and NaN values are left out; a group without values has no row; a null group is a group.
    """
    kept = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    sizes = kept.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.col("share") * (F.col("n") - 1)
    asked = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("at", at)
    ranks = asked.select("g", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor("at").cast("long"), F.ceil("at").cast("long")))).alias("rank")).distinct()
    # ``rank`` is the place wanted, ``left`` that among the values which are still possible
    state = cut_lineage(ranks.withColumn("left", F.col("rank")))
    asked, done = cut_lineage(asked.select("g", "share", "at")), None
    for _ in range(most_rounds):
        found = state.where("lo = hi").select("g", "rank", F.col("lo").alias("v"))
        done = found if done is None else done.unionByName(found)
        state = state.where("lo < hi")
        if state.isEmpty():
            break
        span = kept.join(state.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).where("v >= lo AND v <= hi")
        # halves of the range, as its whole may be larger than any number
        place = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        cell = F.when(F.col("v") == F.col("hi"), BINS - 1).otherwise(F.least(F.lit(BINS - 2), F.floor(place * (BINS - 1)))).cast("int")
        bins = span.groupBy("g", "rank", "left", cell.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("g", "rank").orderBy("bin"))
        own = bins.withColumn("upto", upto).where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
        state = cut_lineage(own.select("g", "lo", "hi", "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left")))
    else:
        raise RuntimeError(f"quantiles are not told apart after {most_rounds} rounds")
    values = done.select(F.col("g").alias("h"), F.col("rank"), "v")
    low = asked.join(values, F.col("g").eqNullSafe(F.col("h")) & (F.floor("at") == F.col("rank"))).select("g", "share", "at", F.col("v").alias("low"))
    both = low.join(values, F.col("g").eqNullSafe(F.col("h")) & (F.ceil("at") == F.col("rank")))
    weight = F.col("at") - F.floor("at")
    between = F.when(weight == 0, F.col("low")).otherwise(F.col("low") + weight * (F.col("v") - F.col("low")))
    return both.select(F.col("g").alias(group), "share", between.alias("quantile"))
