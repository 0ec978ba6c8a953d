"""Names that texts are like, exactly: every pair of a text and a name whose vectors' cosine reaches a least one.

Texts are moved and not their vectors, which are many times as long and are made again where they meet. Not all texts meet all
names: a unit vector r is split into its ``m`` largest components and the rest, of length ``rest``. A unit vector q whose
components there are all smaller than ``least - rest`` by the sum of r's, taken in r's signs, has a cosine below ``least`` with
it. So a name for which that share is ``SHARE`` or more, for one of the first numbers of components, lies in a list for
each of these components and its sign, and a text looks into the lists of its own components of ``SHARE`` and more. Such components
are few, as their squares add up to one. The other names, whose vectors have no large components, are compared with all texts.
Each list, and these names together, are cut into blocks; a task compares one block of texts with one of names.

A text or name that is null or has no words finds nothing and is not found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut_lineage
from graphloom.operators.text_vectors import in_slices

#: The least component that a text looks into a list for, and the most components that a name is in a list for.
SHARE, MOST_LISTS = 0.12, 16
#: The list of the names that all texts are compared with.
ALL = -1
#: Texts and names of a block, at most, and those whose scores a task holds at a time.
BLOCK_TEXTS, BLOCK_NAMES, TILE_TEXTS, TILE_NAMES = 16_384, 16_384, 512, 4096
#: Pairs of blocks that one task compares, about.
TASK_BLOCKS = 4
#: What single precision may be off.
_NEAR = 1e-5
_LISTED = "list int, side int, id long, text string"


def name_lists(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, lists)`` of unit vectors: the lists that each name is in."""
    most = min(MOST_LISTS, x.shape[1])
    place = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :most]
    large = np.take_along_axis(x, place, axis=1)
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.cumsum(large * large, axis=1)))
    enough = (least - rest - 1e-9) / np.cumsum(np.abs(large), axis=1) >= SHARE
    m = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, 0)
    rows, k = np.nonzero(np.arange(most)[None, :] < m[:, None])
    blunt = np.flatnonzero(m == 0)
    return np.concatenate([rows, blunt]), np.concatenate([2 * place[rows, k] + (large[rows, k] < 0), np.full(len(blunt), ALL)])


def text_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, lists)`` of unit vectors: the lists that each text looks into."""
    rows, k = np.nonzero(np.abs(x) >= SHARE)
    every = np.arange(len(x))
    return np.concatenate([rows, every]), np.concatenate([2 * k + (x[rows, k] < 0), np.full(len(x), ALL)])


def _listed(df: DataFrame, side: int, shared: Broadcast, lists: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, x in in_slices(batch.column("text"), shared.value):
                some = np.flatnonzero(x.any(axis=1))
                rows, found = lists(x[some])
                part = batch.take(pa.array(start + some[rows]))
                columns = [pa.array(found.astype(np.int32)), pa.array(np.full(len(rows), side, np.int32)), part.column("id"), part.column("text")]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "side", "id", "text"])

    return df.select("id", "text").where("text IS NOT NULL").mapInArrow(place, _LISTED)


def _comparison(least: float, top: int, shared: Broadcast) -> Callable[[pa.Table], pa.Table]:
    """A function of rows ``(list, side, id, text)`` that compares texts of side 0 with names of side 1: for each text the best ``top``."""
    schema = pa.schema([("src", pa.int64()), ("name", pa.string()), ("score", pa.float64())])

    def vectors(texts: pa.Array) -> np.ndarray:
        return np.concatenate([x for _, x in in_slices(texts, shared.value)])

    def compare(rows: pa.Table) -> pa.Table:
        side = np.asarray(rows.column("side"))
        texts, names = rows.filter(pa.array(side == 0)), rows.filter(pa.array(side == 1))
        if not texts.num_rows or not names.num_rows:
            return schema.empty_table()
        # of equal scores the first name counts
        names = names.sort_by("text")
        ids, spelt = np.asarray(texts.column("id")), names.column("text").combine_chunks()
        right = vectors(spelt)
        targets = np.ascontiguousarray(right.T.astype(np.float32))
        found = []
        for first in range(0, len(ids), TILE_TEXTS):
            left = vectors(texts.column("text").slice(first, TILE_TEXTS).combine_chunks())
            queries = left.astype(np.float32)
            row, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for start in range(0, len(right), TILE_NAMES):
                r, c = np.nonzero(queries @ targets[:, start : start + TILE_NAMES] >= least - _NEAR)
                for cut in range(0, len(r), 1 << 16):
                    at, to = r[cut : cut + (1 << 16)], c[cut : cut + (1 << 16)] + start
                    # the same for a pair in whatever block it is
                    exact = np.einsum("ij,ij->i", left[at], right[to])
                    good = exact >= least
                    row, place, score = np.concatenate([row, at[good]]), np.concatenate([place, to[good]]), np.concatenate([score, exact[good]])
                    order = np.lexsort((place, -score, row))
                    row, place, score = row[order], place[order], score[order]
                    best = np.arange(len(row)) - np.searchsorted(row, row) < top
                    row, place, score = row[best], place[best], score[best]
            found.append(pa.table([pa.array(ids[first + row]), spelt.take(pa.array(place)), pa.array(score)], schema=schema))
        return pa.concat_tables(found)

    return compare


def nearest_names(asked: DataFrame, names: DataFrame, weight: np.ndarray, least: float, top: int) -> DataFrame:
    """``(src, name, score, rank)``: for each of ``asked(id, text)`` the ``top`` of ``names(text)`` by cosine, of those that reach ``least``; of equal ones the first name."""
    shared = asked.sparkSession.sparkContext.broadcast(weight)
    # a name has no number: its hash deals it, and names are told apart by their letters
    known = cut_lineage(_listed(names.select("text").distinct().withColumn("id", F.xxhash64("text")), 1, shared, lambda x: name_lists(x, least)))
    # a row for each list that has names
    held = F.broadcast(cut_lineage(known.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_NAMES).cast("int").alias("parts"))))
    looks = cut_lineage(_listed(asked, 0, shared, text_lists).join(held, "list"))
    asks = F.broadcast(cut_lineage(looks.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("asks"))))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = looks.join(asks, "list").select("list", own("asks").alias("i"), every("parts").alias("j"), "side", "id", "text")
    right = known.join(held, "list").join(asks, "list").select("list", every("asks").alias("i"), own("parts").alias("j"), "side", "id", "text")
    # few bytes are much work, so there are tasks by the number of blocks
    blocks = held.join(asks, "list").agg(F.sum(F.col("parts") * F.col("asks"))).first()[0] or 0
    hits = left.unionByName(right).repartition(-(-blocks // TASK_BLOCKS) or 1, "list", "i", "j").groupBy("list", "i", "j").applyInArrow(_comparison(least, top, shared), "src long, name string, score double")
    # a pair may meet in several lists
    order = Window.partitionBy("src").orderBy(F.desc("score"), "name")
    return hits.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
