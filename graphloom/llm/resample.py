"""Target-distribution importance resampling over hashed word n-grams.

DuckDB tokenises inside each task: SQL splits the texts of a batch into words, unnests
them, forms n-grams over windows of a text's words, hashes each distinct n-gram with a
registered CRC function, and counts the buckets of each row. Spark writes these counts as
Parquet beside the checkpoints, so that a lost executor costs one task, merges them into the
counts of the corpus and of the target, and scores every row: the floored mean gain of its
features plus Gumbel noise of its id, of which the highest scores are drawn.

Defined results: null and empty texts, and those without words, have no features and weight
0; a null id has null noise, score and rank, and is neither counted nor drawn; rows
that repeat an id have the same noise and are drawn each by itself, equal ones in any order;
an empty target has no occurrence in any bucket; long texts are counted whole, in one
statement; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.frames import cut_lineage, numbered, write_shared
from graphloom.llm.words import parts

#: Bytes of text that one DuckDB statement counts, about, and the memory that it may take before it spills.
BATCH_BYTES, MEMORY = 2 << 20, "300MB"
BUCKETS = 10_000

_COUNT = """
WITH split AS (
  SELECT row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM batch),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split),
grams AS ({grams}),
counted AS MATERIALIZED (SELECT row, gram, count(*) AS n FROM grams WHERE gram IS NOT NULL GROUP BY row, gram),
hashed AS (SELECT gram, (crc32_of(gram) % {buckets})::INTEGER AS bucket FROM (SELECT DISTINCT gram FROM counted)),
bucketed AS (SELECT row, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (gram) GROUP BY row, bucket),
listed AS (SELECT row, list(bucket) AS buckets, list(n) AS counts FROM bucketed GROUP BY row)
SELECT coalesce(len(w), 0)::BIGINT AS n_words, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
FROM split LEFT JOIN listed USING (row) ORDER BY row
"""


def _grams(longest: int) -> str:
    """SQL of all runs of 1 to ``longest`` words of a row."""
    runs = ["SELECT row, word AS gram FROM words"]
    for n in range(2, longest + 1):
        rest = " || ' ' || ".join(f"lead(word, {k}) OVER of_row" for k in range(1, n))
        runs.append(f"SELECT row, word || ' ' || {rest} AS gram FROM words WINDOW of_row AS (PARTITION BY row ORDER BY pos)")
    return " UNION ALL ".join(runs)


def _crc32(grams: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(g.encode()) for g in grams.to_pylist()], pa.int64())


def bucket_counts(df: DataFrame, id_col: str, text_col: str, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``(id, n_words, buckets, counts)``: how often the n-grams of each row's text fall in which buckets."""
    sql = _COUNT.format(grams=_grams(longest), buckets=buckets)
    types = pa.schema([("n_words", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False}) as con:
            con.create_function("crc32_of", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
            for whole in batches:
                for part in parts(whole, 1, BATCH_BYTES):
                    con.register("batch", pa.table({"row": pa.array(range(part.num_rows), pa.int64()), "text": part.column(1)}))
                    for found in con.sql(sql).to_arrow_table().cast(types).combine_chunks().to_batches():
                        yield pa.RecordBatch.from_arrays([part.column(0), *found.columns], names=["id", *types.names])
                    con.unregister("batch")

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, f"id {id_type}, n_words long, buckets array<int>, counts array<long>")


def totals(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences by bucket over all rows; as many numbers as there are buckets reach the driver."""
    each = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("e")).groupBy("e.buckets").agg(F.sum("e.counts"))
    total = np.zeros(buckets, np.int64)
    for bucket, n in each.collect():
        total[bucket] = n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed rates in the target and the corpus, floored."""
    size = float(len(corpus))
    s_all, t_all = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(corpus.astype(float), target.astype(float), strict=True)], np.int64)


def _gained(buckets: Column, counts: Column, gain: np.ndarray, context) -> Column:
    """``(features, total gain)`` of a row's counts."""
    shared = context.broadcast(gain)
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("gain", T.LongType())])

    def add(b: pa.Array, c: pa.Array) -> pa.Array:
        n = np.asarray(c.flatten(), np.int64)
        each = shared.value[np.asarray(b.flatten())] * n
        ends = np.cumsum(np.asarray(pa.compute.list_value_length(b)))
        sums = [np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends]])) for x in (n, each)]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in sums], names=["n", "gain"])

    return F.arrow_udf(add, kind)(buckets, counts)


def noise(row_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate of the id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), row_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20
) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` of each row; undrawn rows have no rank."""
    counted = write_shared(bucket_counts(df, id_col, text_col, longest, buckets))
    wanted = bucket_counts(target.select(F.lit(0).alias("_id"), target_text), "_id", target_text, longest, buckets)
    gain = gains(totals(counted, buckets), totals(wanted, buckets))
    found = counted.select("id", "n_words", _gained(F.col("buckets"), F.col("counts"), gain, df.sparkSession.sparkContext).alias("g"))
    # whole numbers: a quotient in doubles could be rounded up to the next one
    floored = F.expr("(g.gain - pmod(g.gain, g.n)) div g.n")
    weighed = found.select("id", "n_words", F.col("g.n").alias("n_features"), F.when(F.col("g.n") > 0, floored).otherwise(F.lit(0)).cast("long").alias("weight"))
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    n = scored.where(fit).count()
    rank = F.when(F.col("number") < n * percent // 100, F.col("number") + 1)
    ranked = numbered(scored.where(fit), n, F.desc("score"), F.asc("id")).withColumn("rank", rank).drop("number")
    rows = ranked.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
    return rows.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
