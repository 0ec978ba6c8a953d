"""An inverted-list index of vectors: approximate nearest neighbours without comparing all pairs.

Centroids are fitted by spherical k-means on a bounded sample (``SAMPLE_ROWS``, the rows with the
lowest hashes of their ids), every vector is stored with the list of its nearest centroid, and a query
looks only into the lists nearest to it. What is found there is ranked by exact cosines, so scores are
exact and only neighbours in lists not looked into are missed. How many lists a query needs depends
on the vectors: :func:`tune` measures it on a bounded set of queries against all rows.

Queries come as a table. Lists that are near each other are put together in cells of ``LIST_ROWS`` rows, about. A query goes
once to each cell that holds a list of its, and is compared with all rows there in one matrix product in a task, so other lists of
these cells are looked into as well. A list of more rows is cut in parts, each with its own copy of the queries. So a query is
moved once for each cell and not for each list: where most of the lists are needed, as with vectors that have no clusters, that is
the number of rows divided by ``LIST_ROWS``.

Vectors that are null, empty, without length or not finite are in no list and find nothing. Equal scores
are ordered by id. An empty table gives an empty index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.lineage import cut_lineage
from graphloom.operators.vector_search import comparison

#: Rows that centroids are fitted on, at most, and those of one list, about, when the number of lists is not given.
SAMPLE_ROWS, ROWS_PER_LIST, MOST_LISTS = 20_000, 64, 4096
#: Rows of a cell, at most, and cells that an index has at least, so that there are tasks for all; queries of it that one task compares.
LIST_ROWS, LEAST_ROWS, LEAST_CELLS, QUERY_ROWS = 16_384, 512, 12, 16_384
#: Queries that :func:`tune` measures recall on, at most.
TUNE_QUERIES = 256


@dataclass(frozen=True)
class Index:
    """``rows(id, v, list)`` of unit vectors by list, and the lists' centroids."""

    rows: DataFrame
    centroids: np.ndarray


def _units(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(places, unit vectors)`` of those vectors that have a direction and the batch's usual length."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch), 0), np.int64)
    if batch.flatten().null_count:
        # a vector with a null component counts as empty
        whole = [v is not None and None not in v for v in batch.to_pylist()]
        sizes = np.where(whole, sizes, 0)
    size = int(sizes.max(initial=0))
    at = np.flatnonzero((sizes == size) & (size > 0))
    if not len(at):
        return at, np.zeros((0, size))
    x = batch.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
    with np.errstate(all="ignore"):
        # the largest component first, so that no square overflows
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _unit(vectors: pa.Array) -> pa.Array:
    at, x = _units(vectors)
    sizes = np.zeros(len(vectors), np.int64)
    sizes[at] = x.shape[1]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(sizes == 0, False))
    return pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))


def _nearest_lists(v: Column, centroids: np.ndarray, probes: int, context) -> Column:
    """The numbers of the ``probes`` nearest lists, nearest first."""
    shared = context.broadcast(centroids)

    def near(vectors: pa.Array) -> pa.Array:
        c = shared.value
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), c.shape[1])
        best = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * best.shape[1], pa.int32()), pa.array(best.ravel().astype(np.int32)))

    return F.arrow_udf(near, T.ArrayType(T.IntegerType()))(v)


def _cells(v: Column, centroids: np.ndarray, probes: int, cell_of: np.ndarray, context) -> Column:
    """The numbers of the cells that hold the ``probes`` nearest lists, each once."""
    shared = context.broadcast((centroids, cell_of))

    def near(vectors: pa.Array) -> pa.Array:
        c, cell_of = shared.value
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), c.shape[1])
        best = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
        wanted = np.zeros((len(x), int(cell_of.max()) + 1), bool)
        np.put_along_axis(wanted, cell_of[best], True, axis=1)
        offsets = np.concatenate([[0], np.cumsum(wanted.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(wanted)[1].astype(np.int32)))

    return F.arrow_udf(near, T.ArrayType(T.IntegerType()))(v)


def cells_of(sizes: dict[int, int], centroids: np.ndarray, cell_rows: int) -> np.ndarray:
    """The cell of each list: lists in a chain from one to the nearest that is left, cut where a cell would have too many rows."""
    cell_of, cell, rows, now = np.zeros(len(centroids), np.int64), 0, 0, 0
    left = np.ones(len(centroids), bool)
    for _ in range(len(centroids)):
        size = sizes.get(now, 0)
        if rows and rows + size > cell_rows:
            cell, rows = cell + 1, 0
        cell_of[now], rows, left[now] = cell, rows + size, False
        now = int(np.argmax(np.where(left, centroids @ centroids[now], -np.inf)))
    return cell_of


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cluster takes the vector that is furthest from its centroid."""
    chosen = np.random.default_rng(seed).permutation(len(x))[:lists]
    centres = x[np.sort(chosen)].copy()
    for _ in range(rounds):
        cos = x @ centres.T
        own = cos.argmax(axis=1)
        worst = iter(np.argsort(cos[np.arange(len(x)), own], kind="stable"))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        for k in np.flatnonzero(np.linalg.norm(sums, axis=1) == 0):
            sums[k] = x[next(worst)]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def _directions(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", _unit(F.col("v").cast("array<double>")).alias("v")).where("v IS NOT NULL")


def build(vectors: DataFrame, lists: int | None = None) -> Index:
    """The index of ``vectors(id, v)``; its rows are written once, and every row is in it."""
    units = cut_lineage(_directions(vectors))
    n = units.count()
    if n == 0:
        return Index(units.withColumn("list", F.lit(0)), np.zeros((0, 0)))
    sample = units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    x = sample.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(sample.num_rows, -1)
    lists = min(lists or -(-n // ROWS_PER_LIST), MOST_LISTS, len(x))
    centroids = fit_centroids(x, lists)
    listed = units.withColumn("list", _nearest_lists(F.col("v"), centroids, 1, units.sparkSession.sparkContext)[0])
    return Index(cut_lineage(listed.repartition("list")), centroids)


def save(index: Index, path: str) -> None:
    """Write the index: rows by list, and one small table of centroids."""
    index.rows.sortWithinPartitions("list", "id").write.mode("overwrite").parquet(f"{path}/rows")
    spark = index.rows.sparkSession
    centres = [(k, [float(c) for c in row]) for k, row in enumerate(index.centroids)]
    spark.createDataFrame(centres, "list int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> Index:
    centres = sorted(spark.read.parquet(f"{path}/centroids").collect())
    return Index(spark.read.parquet(f"{path}/rows"), np.array([v for _, v in centres]) if centres else np.zeros((0, 0)))


def search(index: Index, queries: DataFrame, top: int, probes: int, threshold: float | None = None, others: bool = False, clipped: bool = False) -> DataFrame:
    """``(src, dst, score)``: for each of ``queries(id, v)`` the nearest rows of its lists by cosine, above a strict threshold if there is one.

    With ``others`` a row is not its own neighbour; ``clipped`` limits scores to 0..1.
    """
    spark = index.rows.sparkSession
    if not len(index.centroids):
        return spark.createDataFrame([], "src long, dst long, score double")
    probes = min(probes, len(index.centroids))
    # one row for each list, as many as there are centroids
    sizes = dict(index.rows.groupBy("list").count().collect())
    n = sum(sizes.values())
    cell_rows = max(1, min(LIST_ROWS, max(LEAST_ROWS, -(-n // LEAST_CELLS))))
    cell_of = cells_of(sizes, index.centroids, cell_rows)
    held = np.bincount(cell_of, [sizes.get(k, 0) for k in range(len(cell_of))]).astype(int)
    shape = F.broadcast(spark.createDataFrame([(k, int(cell_of[k]), int(-(-held[cell_of[k]] // cell_rows))) for k in sizes], "list int, cell int, parts int"))
    cells = shape.select("cell", "parts").distinct()
    # written once: what queries come from is not made again for their number
    asked = cut_lineage(_directions(queries).withColumn("cell", _cells(F.col("v"), index.centroids, probes, cell_of, spark.sparkContext)))
    asks = asked.select(F.explode("cell").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("asks"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = F.broadcast(cut_lineage(asks))
    left = asked.withColumn("cell", F.explode("cell")).join(F.broadcast(cells), "cell").join(asks, "cell").select("cell", own("asks").alias("i"), every("parts").alias("j"), "id", "v", F.lit(0).alias("side"))
    right = index.rows.join(shape, "list").join(asks, "cell").select("cell", every("asks").alias("i"), own("parts").alias("j"), "id", "v", F.lit(1).alias("side"))
    hits = left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(comparison(threshold, top, others, clipped), "src long, dst long, score double")
    ranked = hits.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst")))
    return ranked.where(F.col("rn") <= top).drop("rn")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact pairs ``(src, dst)`` that were found; 1 if there are none."""
    row = exact.select("src", "dst").join(found.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left").agg(F.count("hit").alias("hit"), F.count("*").alias("n")).first()
    return row["hit"] / row["n"] if row["n"] else 1.0


def tune(index: Index, top: int, goal: float = 0.95, threshold: float | None = None) -> int:
    """The number of lists a query must look into for a recall of ``goal``.

    Measured on at most ``TUNE_QUERIES`` of the rows (those with the lowest hashes), a stated set, against
    all rows in one pass: for each, the exact ``top`` others, and how near their lists are. One number for
    each of them comes back, so the answer is exact for these queries.
    """
    if not len(index.centroids):
        return 1
    probe = index.rows.orderBy(F.xxhash64("id"), "id").limit(TUNE_QUERIES).toArrow()
    ids, q = np.asarray(probe.column("id")), np.array(probe.column("v").to_pylist(), np.float64)
    order = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
    shared = index.rows.sparkSession.sparkContext.broadcast((ids, q, rank))
    kind = "src long, dst long, score double, rank int"

    def best(batches):
        ids, q, rank = shared.value
        for batch in batches:
            x = np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, -1)
            dst, lists = np.asarray(batch.column("id")), np.asarray(batch.column("list"))
            score = q @ x.T
            score[ids[:, None] == dst[None, :]] = -np.inf
            near = np.argsort(-score, axis=1)[:, :top]
            row = np.repeat(np.arange(len(ids)), near.shape[1])
            columns = [ids[row], dst[near.ravel()], score[row, near.ravel()], rank[row, lists[near.ravel()]].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["src", "dst", "score", "rank"])

    hits = index.rows.select("id", "v", "list").mapInArrow(best, kind).where(F.col("score") > (float("-inf") if threshold is None else threshold))
    exact = hits.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))).where(F.col("rn") <= top)
    # at most TUNE_QUERIES * top numbers
    ranks = sorted(r[0] for r in exact.select("rank").collect())
    return ranks[max(0, int(np.ceil(goal * len(ranks))) - 1)] + 1 if ranks else 1


def knn_graph(vectors: DataFrame, threshold: float, top: int, goal: float = 0.95, lists: int | None = None) -> DataFrame:
    """``(src, dst, score)`` as the exact graph has it, by an index tuned to a recall of ``goal``."""
    index = build(vectors, lists)
    return search(index, index.rows.select("id", "v"), top, tune(index, top, goal, threshold), threshold, others=True, clipped=True)
