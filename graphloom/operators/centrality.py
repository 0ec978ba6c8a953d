"""Centrality over mixed edges: undirected and directed ones together, to convergence, and PageRank as the fallback.

Both go round over the same links many times, so links are laid out once. Nodes are dealt into blocks by hash, and
the links between two blocks are a tile that knows its sources' places in the one block and its targets' places in the
other. In a round each block gets one row of sums from each tile that leads to it, adds them up and sends on its own: one
shuffle of a number for each target of a tile, while tiles stay where they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut_lineage

#: Rounds between two checkpoints, at each of which the change is read.
STEP = 5
#: Links that leave one block, about, and the blocks that small graphs are dealt into if each has some links.
BLOCK_LINKS, LEAST_BLOCKS, LEAST_LINKS = 200_000, 12, 25_000


def mixed(undirected: Sequence[DataFrame], directed: Sequence[DataFrame]) -> DataFrame:
    """``(src, dst)``: links that pass importance on. An undirected edge (its first two columns) passes it both ways, a directed one to its target."""
    named = lambda df, a, b: df.select(F.col(df.columns[a]).alias("src"), F.col(df.columns[b]).alias("dst"))
    parts = [named(df, 0, 1) for df in [*undirected, *directed]] + [named(df, 1, 0) for df in undirected]
    return reduce(DataFrame.unionByName, parts).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


_NODES, _LEAVING, _COMING = 0, 1, 2
_MESSAGE = pa.schema([("block", pa.int32()), ("sender", pa.int32()), ("numbers", pa.binary())])
_NUMBERS = "block int, sender int, numbers binary"


def _tile(rows: pa.Table) -> pa.Table:
    """The links from one block to another as one row: sources, and for each its target's place among the distinct targets."""
    targets, slots = np.unique(rows.column("dst").to_numpy(), return_inverse=True)
    kind = rows.schema.field("src").type
    one = [rows.column("i")[:1], rows.column("j")[:1], pa.array([rows.column("src").to_pylist()], pa.list_(kind)), pa.array([targets.tolist()], pa.list_(kind)), pa.array([slots.astype(np.int32).tobytes()], pa.binary())]
    return pa.table(one, names=["i", "j", "sources", "targets", "slots"])


def _layout(leaving: pa.Table, coming: pa.Table) -> pa.Table:
    """A block's rows: its nodes in order, each tile that leaves it and each that comes to it, by places in that order."""
    sides = [(_LEAVING, "j", "sources", leaving), (_COMING, "i", "targets", coming)]
    block = (leaving.column("i") if len(leaving) else coming.column("j"))[0].as_py()
    kind = leaving.schema.field("sources").type
    ids = [part.values.to_numpy(zero_copy_only=False) for _, _, name, side in sides for part in side.column(name)]
    nodes = np.unique(np.concatenate(ids))
    rows = [(block, _NODES, -1, nodes.tolist(), None, None)]
    for which, other, name, side in sides:
        slots = side.column("slots").to_pylist() if which == _LEAVING else [None] * len(side)
        for to, part, slot in zip(side.column(other).to_pylist(), side.column(name), slots, strict=True):
            at = np.searchsorted(nodes, part.values.to_numpy(zero_copy_only=False)).astype(np.int32)
            rows.append((block, which, to, None, at.tobytes(), slot))
    kinds = [pa.int32(), pa.int32(), pa.int32(), kind, pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "part", "other", "nodes", "at", "slots"])


def _laid_out(links: DataFrame) -> DataFrame:
    """``(block, part, other, nodes, at, slots)`` of links, kept dealt by block until it is unpersisted."""
    n = links.count()
    blocks = max(1, -(-n // BLOCK_LINKS), min(LEAST_BLOCKS, n // LEAST_LINKS))
    kind = links.schema["src"].dataType.simpleString()
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = links.select(of("src").alias("i"), of("dst").alias("j"), "src", "dst")
    tiles = cut_lineage(dealt.groupBy("i", "j").applyInArrow(_tile, f"i int, j int, sources array<{kind}>, targets array<{kind}>, slots binary"))
    leaving, coming = tiles.select("i", "j", "sources", "slots").groupBy("i"), tiles.select("i", "j", "targets").groupBy("j")
    rows = leaving.cogroup(coming).applyInArrow(_layout, f"block int, part int, other int, nodes array<{kind}>, at binary, slots binary")
    return cut_lineage(rows).repartition(blocks, "block").persist()


def _round(receive: bool, send: bool, keep: int, base: float | None, damping: float | None):
    """One round of one block: add up what came, then send it on.

    What a block keeps has sender -1: its last ``keep`` vectors, the newest first. A node starts from ``base``, or from its
    own last number if there is none, and with ``damping`` shares that part of it among its links.
    """

    def run(layout: pa.Table, messages: pa.Table) -> pa.Table:
        block = layout.column("block")[0].as_py()
        part, other = np.asarray(layout.column("part")), np.asarray(layout.column("other"))
        at, slots = layout.column("at"), layout.column("slots")
        ints = lambda column, k: np.frombuffer(column[k].as_buffer(), np.int32)
        # numbers are added in the order of the blocks that they come from, so each run has the same sums
        order = np.argsort(other, kind="stable")
        n = len(layout.column("nodes")[int(np.flatnonzero(part == _NODES)[0])])
        got = {s: np.frombuffer(v.as_buffer(), np.float64) for s, v in zip(messages.column("sender").to_pylist(), messages.column("numbers"), strict=True)}
        vectors = list(got.get(-1, np.ones(n)).reshape(-1, n))
        if receive:
            new = vectors[0].copy() if base is None else np.full(n, base)
            for k in order[part[order] == _COMING].tolist():
                new[ints(at, k)] += got[int(other[k])]
            vectors = [new, *vectors]
        rows = [(block, -1, np.concatenate(vectors[:keep]).tobytes())]
        if send:
            leaving = [(k, ints(at, k), ints(slots, k)) for k in order[part[order] == _LEAVING].tolist()]
            now = vectors[0]
            if damping is not None:
                links = sum((np.bincount(a, minlength=n) for _, a, _ in leaving), np.zeros(n, np.int64))
                now = now * (damping / np.maximum(links, 1))
            rows += [(int(other[k]), block, np.bincount(s, now[a]).tobytes()) for k, a, s in leaving]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _MESSAGE.types, strict=True)], schema=_MESSAGE)

    return run


def _rounds(layout: DataFrame, vectors: DataFrame, keep: int, base: float | None = None, damping: float | None = None) -> DataFrame:
    """The last ``keep`` vectors after ``STEP`` rounds from the last one of ``vectors``, written."""
    blocks = layout.groupBy("block")
    for k in range(STEP + 1):
        run = _round(k > 0, k < STEP, max(1, keep - (STEP - k)), base, damping)
        vectors = blocks.cogroup(vectors.groupBy("block")).applyInArrow(run, _NUMBERS)
    return cut_lineage(vectors)


def _of_blocks(rows: DataFrame, function, names: Sequence[str]) -> DataFrame:
    """A row of numbers for each row, of its binary columns as vectors."""

    def run(batches):
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                found = function(*(np.frombuffer(v.as_buffer(), np.float64) for v in row))
                yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in found], names=list(names))

    return rows.mapInArrow(run, ", ".join(f"{name} double" for name in names))


def _values(layout: DataFrame, vectors: DataFrame, factor: float, name: str) -> DataFrame:
    """``(node, name)``: each node with its number of the last vector times a factor, written; the layout is given up."""

    def run(batches):
        for batch in batches:
            for nodes, numbers in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([nodes.values, pa.array(np.frombuffer(numbers.as_buffer(), np.float64) * factor)], names=["node", name])

    kind = layout.schema["nodes"].dataType.elementType.simpleString()
    nodes = layout.where(F.col("part") == _NODES).select("block", "nodes")
    last = vectors.select("block", "numbers")
    found = cut_lineage(nodes.join(last, "block").select("nodes", "numbers").mapInArrow(run, f"node {kind}, {name} double"))
    layout.unpersist()
    return found


def eigenvector(links: DataFrame, tolerance: float = 1e-4, most_rounds: int = 500) -> DataFrame:
    """``(node, centrality, converged)`` of ``links(src, dst)``: power iteration to unit length, a node's value being the sum of those that link to it.

    Each node counts itself too, which leaves the result and lets graphs of two sides converge. Where the
    second largest eigenvalue is near the largest, the error falls by nearly the same share each round; that share is
    estimated from the last two changes and the rest of the geometric series is added at once. The error that
    is left is estimated likewise, and rounds go on until it is below ``tolerance`` for every node.
    """
    links = cut_lineage(links.where("src IS NOT NULL AND dst IS NOT NULL"))
    if links.isEmpty():
        return links.select(F.col("src").alias("node"), F.lit(1.0).alias("centrality"), F.lit(True).alias("converged"))
    layout = _laid_out(links)
    vectors = links.sparkSession.createDataFrame([], _NUMBERS)
    done, converged = 0, False
    while done < most_rounds and not converged:
        vectors = _rounds(layout, vectors, 3)
        done += STEP
        three = vectors.select("numbers")
        lengths = np.sqrt(_of_blocks(three, lambda x: (x.reshape(3, -1) ** 2).sum(axis=1), "cba").agg(F.sum("c"), F.sum("b"), F.sum("a")).first())

        def compared(x, lengths=lengths):
            c, b, a = x.reshape(3, -1) / lengths[:, None]
            return (b - a) @ (c - b), (b - a) @ (b - a), np.abs(c - b).max()

        both, own, most = _of_blocks(three, compared, ["both", "own", "most"]).agg(F.sum("both"), F.sum("own"), F.max("most")).first()
        share = min(0.999, max(0.0, both / own)) if own else 0.0
        converged = most / (1 - share) < tolerance
        # a last step that is exact, or one that jumps ahead
        vectors = _jump(vectors, lengths, 0.0 if converged else share / (1 - share))
    length = _of_blocks(vectors.select("numbers"), lambda c: (c @ c,), ["n"]).agg(F.sum("n")).first()[0] ** 0.5
    return _values(layout, vectors, 1 / length, "centrality").withColumn("converged", F.lit(converged))


def _jump(vectors: DataFrame, lengths: np.ndarray, far: float) -> DataFrame:
    """The last vector brought to unit length, and ``far`` times its last change added; nothing falls below 0."""

    def run(batches):
        for batch in batches:
            for block, numbers in zip(*batch.columns, strict=True):
                c, b, _ = np.frombuffer(numbers.as_buffer(), np.float64).reshape(3, -1) / lengths[:, None]
                ahead = np.maximum(0.0, c + far * (c - b))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block.as_py(), -1, ahead.tobytes()), _MESSAGE.types, strict=True)], schema=_MESSAGE)

    return vectors.select("block", "numbers").mapInArrow(run, _NUMBERS)


def pagerank(links: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, most_rounds: int = 300) -> DataFrame:
    """``(node, rank, converged)`` of ``links(src, dst)``; ranks add up to 1, and a node without links gives its rank to all.

    With even chances for jumps, the ranks are the solution of ``x = 1 + damping * x passed on`` brought to
    the sum of 1, so the rank that dangling nodes give away needs no sum over all nodes in each round.
    """
    links = cut_lineage(links.where("src IS NOT NULL AND dst IS NOT NULL"))
    if links.isEmpty():
        return links.select(F.col("src").alias("node"), F.lit(1.0).alias("rank"), F.lit(True).alias("converged"))
    layout = _laid_out(links)
    vectors = links.sparkSession.createDataFrame([], _NUMBERS)
    done, converged = 0, False
    while done < most_rounds and not converged:
        before, vectors = vectors, _rounds(layout, vectors, 1, 1.0, damping)
        # before the first round each node has 1
        both = vectors.join(before.select("block", F.col("numbers").alias("was")), "block", "left").select("numbers", F.coalesce("was", F.lit(b"")).alias("was"))
        change, total = _of_blocks(both, lambda x, was: (np.abs(x - (was if len(was) else 1.0)).max(), x.sum()), ["change", "total"]).agg(F.max("change"), F.sum("total")).first()
        done += STEP
        converged = change / total / (1 - damping**STEP) < tolerance
    return _values(layout, vectors, 1 / total, "rank").withColumn("converged", F.lit(converged))
