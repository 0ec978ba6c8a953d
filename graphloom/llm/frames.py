"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import accumulate, chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder, so that a lost executor costs no recomputation chain."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir``, or one of this machine where the master is local and none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that a worker holds the Python objects of few rows at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches grouped by their first columns; few rows are Python objects at a time."""
    rows = chain.from_iterable(zip(*[c.to_pylist() for c in part.columns], strict=True) for batch in batches for part in slices(batch))
    return groupby(rows, key=lambda row: row[:keys])


def join_spread(left: DataFrame, right: DataFrame, on: list[str], ways: int = 8, how: str = "left") -> DataFrame:
    """Join a large side with keys of any skew to a side that has each key once.

    The large side deals each key over ``ways`` parts by a hash of its other columns, and
    the small side is repeated for each part, so no task gets all rows of a hot key.
    Keys that are null match nothing.
    """
    part = F.pmod(F.xxhash64(*[c for c in left.columns if c not in on]), F.lit(ways)).cast("int")
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return left.withColumn("_part", part).join(copies, [*on, "_part"], how).drop("_part")


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Bytes of rejected rows' names up to which they are broadcast; more are joined, with the same rows left.
BROADCAST_NAMES = 8 << 20


def drop_rows(df: DataFrame, rejected: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``df`` but those named in ``rejected(id, text_key)`` by id and hash of the text; nulls equal nulls.

    The names are written and measured first: if they are few, the texts need not be shuffled to meet them.
    """
    key, text_key = free_name(df, "_gone_id"), free_name(df, "_gone_key")
    gone = cut_lineage(rejected.toDF(key, text_key).distinct())
    size = gone.agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{key}`").cast("string")), F.lit(0)) + 32)).first()[0] or 0
    gone = F.broadcast(gone) if size <= BROADCAST_NAMES else gone
    return df.join(gone, df[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(df[text_col]) == F.col(text_key)), "left_anti")


#: Rows of one task when a table is numbered, about.
NUMBERED_ROWS = 500_000


def numbered(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The ``n`` rows of a table with ``number``, their place from 0 in the given order: sorted by ranges, plus each range's offset."""
    dealt = df.repartitionByRange(max(1, -(-n // NUMBERED_ROWS)), *order).sortWithinPartitions(*order)
    # a row's number in its range; written, so that no task is run again with another order
    placed = cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    starts = accumulate((size for _, size in sizes), initial=0)
    offsets = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "_range int, _start long")
    joined = placed.withColumn("_range", part.cast("int")).join(F.broadcast(offsets), "_range")
    return joined.withColumn("number", F.col("_start") + place).drop("_range", "_start", "_at")


def write_shared(df: DataFrame, rows_together: int | None = None) -> DataFrame:
    """Write a table beside the checkpoints, where every executor can read it, and read it back.

    Of rows that are large, ``rows_together`` is the most that a writer or reader holds at a time (a row group).
    """
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write if rows_together is None else df.write.option("parquet.block.row.count.limit", rows_together)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
