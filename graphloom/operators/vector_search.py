"""Exact vector search, similarity graphs and vector health reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import as_vector, cosine, normalized_score
from graphloom.operators.lineage import cut_lineage

#: Defaults of similarity edges and of the three searches.
KNN_THRESHOLD, KNN_TOP = 0.7, 5
SCORE_THRESHOLD = 0.5


def top_k(vectors: DataFrame, query: Sequence[float], k: int, threshold: float | None = None, mode: str = "normalized") -> DataFrame:
    """``(id, score)`` of the k nearest rows of ``vectors(id, v)``; ties by id.

    The query is a literal, so this is one scan and a partial top-k in each task.
    A strict threshold on the score is applied first, which gives the same rows.
    """
    cos = cosine(F.col("v"), as_vector(query))
    scored = vectors.select("id", (normalized_score(cos) if mode == "normalized" else cos).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") > threshold)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def hybrid(parts: Sequence[tuple[str, DataFrame]], k: int) -> DataFrame:
    """The best k of several top-k lists; equal scores keep the order of the lists."""
    lists = [df.select(F.lit(rank).alias("rank"), F.lit(label).alias("node_type"), "id", "score") for rank, (label, df) in enumerate(parts)]
    merged = lists[0]
    for more in lists[1:]:
        merged = merged.unionByName(more)
    return merged.orderBy(F.desc("score"), "rank", "id").limit(k).drop("rank")


def knn_graph(vectors: DataFrame, threshold: float = KNN_THRESHOLD, top: int = KNN_TOP, block_rows: int | None = None) -> DataFrame:
    """``(src, dst, score)``: each row's nearest others by clipped cosine above a strict threshold, exactly.

    The graph, at most ``top`` edges a row, is written once: whatever reads it twice does not compare all rows again.
    """
    return cut_lineage(nearest(vectors, vectors, threshold, top, block_rows, others=True))


#: Numbers of one block, at most (a row is moved once for each block), and blocks that a table of some size has at least, so that there are tasks for all.
BLOCK_NUMBERS, LEAST_ROWS, LEAST_BLOCKS = 1 << 22, 512, 12
#: Rows of each side whose scores a task holds at a time.
TILE_ROWS, TILE_COLUMNS = 512, 2048


def comparison(threshold: float | None, top: int, others: bool, clipped: bool) -> Callable[[pa.Table], pa.Table]:
    """A function of rows ``(id, v, side)`` that compares those of side 0 with those of side 1, tile by tile: the best ``top`` above the threshold for each."""
    least = -np.inf if threshold is None else threshold

    def product(rows: pa.Table) -> pa.Table:
        side = np.asarray(rows.column("side"))
        ids = np.asarray(rows.column("id"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return _EDGE.empty_table()
        unit = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        length = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = np.divide(unit, length, out=np.zeros_like(unit), where=length > 0)
        b = b[np.argsort(ids[b], kind="stable")]
        targets = np.ascontiguousarray(unit[b].T)
        found = []
        for first in range(0, len(a), TILE_ROWS):
            q = a[first : first + TILE_ROWS]
            queries = unit[q]
            # what is still among the best of each row: row, place in b, score
            row, place, kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            floor = np.full((len(q), 1), -np.inf)
            for start in range(0, len(b), TILE_COLUMNS):
                score = queries @ targets[:, start : start + TILE_COLUMNS]
                if clipped and not least >= 0:
                    np.clip(score, 0.0, 1.0, out=score)
                if start == 0 and score.shape[1] > top > 0:
                    if others:
                        score[ids[q][:, None] == ids[b[:TILE_COLUMNS]][None, :]] = -np.inf
                    first_best = np.partition(np.nan_to_num(score, nan=-np.inf), score.shape[1] - top, axis=1)[:, score.shape[1] - top, None]
                    floor = np.minimum(first_best, 1.0) if clipped else first_best
                # one pass over the tile: above the threshold, and not below the best so far
                r, c = np.nonzero(score >= np.maximum(floor, np.nextafter(least, np.inf)))
                new = np.minimum(score[r, c], 1.0) if clipped else score[r, c]
                good = new > least
                if others:
                    good &= ids[q[r]] != ids[b[c + start]]
                row, place, kept = np.concatenate([row, r[good]]), np.concatenate([place, c[good] + start]), np.concatenate([kept, new[good]])
                order = np.lexsort((place, -kept, row))
                row, place, kept = row[order], place[order], kept[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, place, kept, rank = (x[rank < top] for x in (row, place, kept, rank))
                floor[row[rank == top - 1], 0] = kept[rank == top - 1]
            found.append(pa.table([pa.array(ids[q][row]), pa.array(ids[b][place]), pa.array(kept)], schema=_EDGE))
        return pa.concat_tables(found)

    return product


def nearest(left: DataFrame, right: DataFrame, threshold: float | None, top: int, block_rows: int | None = None, others: bool = False, clipped: bool = True) -> DataFrame:
    """``(src, dst, score)``: for each row of ``left(id, v)`` the nearest of ``right(id, v)`` by cosine above a strict threshold if there is one.

    A set of queries against all rows, in blocks: both sides are dealt into blocks and each pair of blocks is compared in one
    task, tile by tile, so a task holds two blocks and one tile of scores whatever the tables' sizes. Of a tile only scores above
    the threshold and not below the best ``top`` of the tiles before are looked at. Each pair of blocks sends on at most ``top`` rows
    for each source, and a window takes the best of these. With ``others`` a row is not its own neighbour; a null vector is no row.
    """

    def blocks(df: DataFrame) -> int:
        n, numbers = df.agg(F.count("*"), F.sum(F.greatest(F.size("v"), F.lit(0)))).first()
        return max(1, -(-n // block_rows)) if block_rows else max(1, -(-(numbers or 0) // BLOCK_NUMBERS), min(LEAST_BLOCKS, -(-n // LEAST_ROWS)))

    l_blocks = blocks(left)
    r_blocks = l_blocks if others else blocks(right)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a_side = left.where("v IS NOT NULL").select(own(l_blocks).alias("i"), every(r_blocks).alias("j"), "id", "v", F.lit(0).alias("side"))
    b_side = right.where("v IS NOT NULL").select(every(l_blocks).alias("i"), own(r_blocks).alias("j"), "id", "v", F.lit(1).alias("side"))
    found = a_side.unionByName(b_side).groupBy("i", "j").applyInArrow(comparison(threshold, top, others, clipped), "src long, dst long, score double")
    ranked = found.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst")))
    return ranked.where(F.col("rn") <= top).drop("rn")


_EDGE = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("score", pa.float64())])


def coverage(nodes: DataFrame, vectors: DataFrame, key: str, group: str) -> DataFrame:
    """Rows with a vector in each group, and their share in percent."""
    joined = nodes.select(F.col(key).alias("id"), group).join(vectors.select("id", F.lit(1).alias("has")), "id", "left")
    return joined.groupBy(group).agg(
        F.count("*").alias("total"), F.count("has").alias("with_embedding"), F.round(F.count("has") / F.count("*") * 100, 2).alias("coverage_pct")
    )


def catalogue(nodes: DataFrame, vectors: DataFrame, key: str, label: str) -> DataFrame:
    """``(label, state, entries, population_pct)``: how far each label's nodes have vectors, in place of an index catalogue."""
    seen = coverage(nodes, vectors, key, label)
    state = F.when(F.col("with_embedding") == 0, "EMPTY").when(F.col("with_embedding") < F.col("total"), "POPULATING").otherwise("ONLINE")
    return seen.select(F.col(label).alias("label"), state.alias("state"), F.col("total").alias("entries"), F.col("coverage_pct").alias("population_pct"))


def dimensions(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy(F.size("v").alias("dimension")).agg(F.count("*").alias("n"))


def invalid(vectors: DataFrame) -> DataFrame:
    """Vectors with null or non-finite components, or without length."""
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("v", lambda x: x != 0)
    return vectors.where(F.col("v").isNull() | broken | zero)


def mean_vector(vectors: DataFrame) -> DataFrame:
    """``(position, mean)`` of each component."""
    return vectors.select(F.posexplode("v").alias("position", "x")).groupBy("position").agg(F.avg("x").alias("mean"))
