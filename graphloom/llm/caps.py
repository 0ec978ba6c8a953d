"""Embedding near-dedup with spherical-cap filters.

A filter is a direction; a vector meets it if their inner product exceeds a threshold.
Directions are the codewords of a random product code: the coordinates are cut into
blocks, each with a small random codebook, and a direction takes one codeword from every
block. All directions that a vector exceeds are list-decoded block by block, cutting
partial sums that the best remaining codewords can't lift over the threshold, so millions
of directions cost a few hundred inner products. Vectors of one label that share a filter
are candidates, and their cosine is then computed in double precision.

The threshold and the number of directions follow from the largest label's number of
distinct vectors: a vector meets about ``HITS`` filters of each of ``CODES`` independent
codes at every size, and one filter a share ``CHANCE`` of a vector of a label by chance, so candidates
grow in proportion to the input. Where a vector exceeds fewer than ``LEAST_HITS`` of a
code's directions, its own threshold for that code is lowered until it does. A pair at
cosine 0.98 shares each of its filters with a probability near one half, so it is missed
only if that fails for all of its filters in all codes.

Vectors that share a filter are compared inside tasks, in cells of one block against
another, and a pair counts in the first filter that both meet alone. So neither candidates
nor links are rows: a cell sends on each vector's number of new links, and links that
connect what is linked in the cell.

Equal vectors of one label are one node: their copies are counted, not paired.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and vectors without a label, link with nothing and are their own component; vectors of
different length don't link; rows that repeat a vector link with each other; a
cosine of exactly the bound links; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.frames import by_key, cut_lineage, join_spread
from graphloom.llm.graph import components

COSINE = 0.98
#: Independent product codes, filters of each that a vector meets on average, and at least.
CODES, HITS, LEAST_HITS = 4, 10, 6
#: Vectors of a label that one filter catches by chance.
CHANCE = 0.1
#: Codewords of one block's codebook, at most.
CODEWORDS = 512
#: Vectors of one side of a cell, and of a chunk of small cells that are compared at once.
BLOCK_ROWS, CHUNK_ROWS, SMALL = 512, 4096, 32


class Filters:
    """Directions of one code for vectors of one length."""

    def __init__(self, length: int, vectors: int, code: int):
        chance = min(0.02, max(1e-10, CHANCE / max(1, vectors)))
        # beyond 0.7 of a vector's own length caps get too small for few coordinates
        deviations = min(NormalDist().inv_cdf(1 - chance), 0.7 * length**0.5)
        count = HITS / (1 - NormalDist().cdf(deviations))
        blocks = 1
        while count ** (1 / blocks) > CODEWORDS and blocks < max(1, length // 4):
            blocks += 1
        self.size = int(np.ceil(count ** (1 / blocks)))
        random = np.random.default_rng([length, blocks, code])
        self.rotation = np.linalg.qr(random.standard_normal((length, length)))[0]
        self.cuts = np.cumsum([len(x) for x in np.array_split(np.arange(length), blocks)])[:-1]
        self.books = []
        for width in np.diff([0, *self.cuts, length]):
            book = random.standard_normal((self.size, width))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
        self.threshold = deviations * (blocks / length) ** 0.5

        self.step = 0.15 * (blocks / length) ** 0.5

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Numbers of all filters that each unit vector exceeds."""
        turned = np.split(vectors @ self.rotation, self.cuts, axis=1)
        scores = [part @ book.T for part, book in zip(turned, self.books, strict=True)]
        best = np.stack([s.max(axis=1) for s in scores])
        rest = np.append(np.cumsum(best[::-1], axis=0)[::-1], np.zeros((1, len(vectors))), axis=0)
        found = []
        for i in range(len(vectors)):
            own = [s[i] for s in scores]
            threshold = min(self.threshold, rest[0, i])
            met = self._exceeded(own, rest[1:, i], threshold)
            while len(met) < min(LEAST_HITS, self.size ** len(own)):
                threshold -= self.step
                met = self._exceeded(own, rest[1:, i], threshold)
            found.append(met)
        return found

    def _exceeded(self, scores: list[np.ndarray], rest: np.ndarray, threshold: float) -> np.ndarray:
        sums, numbers = np.zeros(1), np.zeros(1, dtype=np.int64)
        for s, lift in zip(scores, rest, strict=True):
            least = threshold - lift - 1e-12
            own = np.flatnonzero(s >= least - sums.max())
            total = sums[:, None] + s[own][None, :]
            a, b = np.nonzero(total >= least)
            sums, numbers = total[a, b], numbers[a] * self.size + own[b]
            if not len(sums):
                break
        return numbers


@lru_cache(maxsize=64)
def filters(length: int, vectors: int, code: int) -> Filters:
    return Filters(length, vectors, code)


def buckets(vectors: DataFrame, largest: int) -> DataFrame:
    """``(id, label, length, filter)`` for each filter that each row of ``vectors(id, label, v)`` meets."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                column = part.column(2)
                lengths = np.asarray(pa.compute.list_value_length(column))
                for length in np.unique(lengths).tolist():
                    rows = np.flatnonzero(lengths == length)
                    taken = part.take(pa.array(rows))
                    unit = np.asarray(taken.column(2).flatten()).reshape(len(rows), length)
                    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                    for code in range(CODES):
                        met = filters(length, largest, code).decode(unit)
                        repeat = np.repeat(np.arange(len(rows)), [len(m) for m in met])
                        again = taken.take(pa.array(repeat))
                        numbers = np.concatenate(met) * CODES + code
                        yield pa.RecordBatch.from_arrays(
                            [again.column(0), again.column(1), pa.array(np.full(len(repeat), length, np.int32)), pa.array(numbers)], names=["id", "label", "length", "filter"]
                        )

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", vectors.schema["label"].dataType), T.StructField("length", T.IntegerType()), T.StructField("filter", T.LongType())])
    return vectors.select("id", "label", "v").mapInArrow(run, schema)


_FOUND = "id long, others long, a long, b long"


def _packed(kind: str):
    def run(vectors: pa.Array) -> pa.Array:
        return pa.array([None if v is None else np.asarray(v, dtype=kind).tobytes() for v in (x.values if x.is_valid else None for x in vectors)], pa.binary())

    return F.arrow_udf(run, T.BinaryType())


class Cell:
    """Rows of one filter's blocks, ready to be compared: unit vectors, numbers of copies, and the filters of each."""

    def __init__(self, rows: list[tuple], kind: str):
        self.number, self.copies, self.side = np.array([r[5] for r in rows]), np.array([r[7] for r in rows]), np.array([r[4] for r in rows])
        v = np.frombuffer(b"".join(r[6] for r in rows), dtype=kind).reshape(len(rows), -1).astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)  # norms neither vanish nor overflow
        self.unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        self.met = [np.frombuffer(r[8], dtype=np.int64) for r in rows]


def _small_links(rows: list[tuple], cuts: list[int], kind: str, cosine: float) -> tuple[np.ndarray, np.ndarray, Cell]:
    """Pairs of positions that are linked and counted, of consecutive small cells at once."""
    cell = Cell(rows, kind)
    left, right, owner = [], [], []
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        i, j = np.triu_indices(end - start, 1)
        left.append(i + start)
        right.append(j + start)
        owner.append(np.full(len(i), start))
    left, right, owner = np.concatenate(left), np.concatenate(right), np.concatenate(owner)
    near = np.einsum("ij,ij->i", cell.unit[left], cell.unit[right]) >= cosine
    left, right, owner = left[near], right[near], owner[near]
    sets = [set(m.tolist()) for m in cell.met] if len(left) else []
    first = np.array([min(sets[i] & sets[j]) == rows[k][1] for i, j, k in zip(left.tolist(), right.tolist(), owner.tolist(), strict=True)], dtype=bool)
    return left[first], right[first], cell


def _large_counts(rows: list[tuple], kind: str, cosine: float) -> tuple[np.ndarray, np.ndarray, Cell]:
    """New links of each row of one large cell, and the mask of all links of its left against its right rows."""
    cell = Cell(rows, kind)
    same = not cell.side.any()
    left = np.flatnonzero(~cell.side)
    right = left if same else np.flatnonzero(cell.side)
    linked = cell.unit[left] @ cell.unit[right].T >= cosine
    if same:
        linked = np.triu(linked, 1)
    # whether a pair shares a filter before this one: by products of incidence
    lower = [m[m < rows[0][1]] for m in cell.met]
    numbers, at = np.unique(np.concatenate(lower), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(m) for m in lower])
    shared = np.bincount(at, minlength=len(numbers)) > 1
    column = np.cumsum(shared) - 1
    kept = shared[at]
    new = linked.copy()
    width = 2048
    for start in range(0, int(shared.sum()), width):
        own = kept & (column[at] >= start) & (column[at] < start + width)
        incidence = np.zeros((len(rows), min(width, int(shared.sum()) - start)), dtype=np.float32)
        incidence[owner[own], column[at[own]] - start] = 1
        new &= incidence[left] @ incidence[right].T == 0
    counts = np.zeros(len(rows), dtype=np.int64)
    counts[left] += new @ cell.copies[right]
    np.add.at(counts, right, new.T @ cell.copies[left])
    return counts, linked, cell


def _spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect what the pairs connect, one fewer than nodes of each component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = up
        return x

    kept = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _spanning_mask(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The same for a mask of left against right numbers: for each row that still adds something its links to new nodes."""
    pairs: list[tuple[int, int]] = []
    reached = np.full(linked.shape[1], -1)  # the row whose link reached a column first
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        columns = np.flatnonzero(linked[i])
        fresh = columns[reached[columns] < 0]
        reached[fresh] = i
        pairs += [(int(left[i]), int(right[c])) for c in fresh]
        # one link to each star met before is enough
        _, one = np.unique(reached[columns], return_index=True)
        pairs += [(int(left[i]), int(right[c])) for c in columns[one]]
    return _spanning(pairs)


def compared(vectors: DataFrame, cosine: float, largest: int, kind: str) -> DataFrame:
    """``(id, others, a, b)``: shares of the numbers of links of ``vectors(id, label, vector, v, copies)``, or links that connect."""
    met = cut_lineage(buckets(vectors, largest))
    on = ["label", "length", "filter"]
    sizes = met.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").select(*on, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("of"))
    # at most some dozens of filters of each vector
    own = join_spread(met, sizes, on, how="inner").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("filter", "of"))).alias("met"))
    rows = vectors.join(own, "id").select("id", "label", F.size("v").alias("length"), "copies", _packed(kind)("vector").alias("packed"), _packed("int64")(F.col("met.filter")).alias("filters"), F.explode("met").alias("m"))
    block = F.pmod(F.xxhash64("id"), F.col("m.of")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("m.of") - 1))
    dealt = rows.select("*", block.alias("own"), other.alias("other")).select(
        "label", F.col("m.filter").alias("filter"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"),
        "id", "packed", "copies", "filters", "length",
    )
    cells = dealt.repartition("label", "length", "filter", "i", "j").sortWithinPartitions("label", "length", "filter", "i", "j", "side")

    def run(batches):
        held: list[tuple] = []
        cuts = [0]

        def small():
            if len(held) > 1:
                left, right, cell = _small_links(held, cuts, kind, cosine)
                if len(left):
                    counts = np.zeros(len(held), dtype=np.int64)
                    np.add.at(counts, left, cell.copies[right])
                    np.add.at(counts, right, cell.copies[left])
                    yield from _batches(cell, counts, _spanning(list(zip(cell.number[left].tolist(), cell.number[right].tolist(), strict=True))))
            held.clear()
            cuts[:] = [0]

        length = None
        for (_, _, _, _), members in by_key(batches, 4):
            members = list(members)
            # vectors of different length may have filters of one number
            for one in sorted({m[9] for m in members}):
                part = members if len({m[9] for m in members}) == 1 else [m for m in members if m[9] == one]
                if len(part) > SMALL or part[0][2] != part[0][3]:
                    if len(part) > 1:
                        counts, linked, cell = _large_counts(part, kind, cosine)
                        left = cell.number[~cell.side]
                        right = cell.number[cell.side] if cell.side.any() else left
                        yield from _batches(cell, counts, _spanning_mask(linked, left, right))
                    continue
                if held and (length != one or len(held) > CHUNK_ROWS):
                    yield from small()
                length = one
                held.extend(part)
                cuts.append(len(held))
        yield from small()

    return cells.mapInArrow(run, _FOUND)


def _batches(cell: Cell, counts: np.ndarray, links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(counts)
    nothing = lambda n: pa.nulls(n, pa.int64())
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(cell.number[some]), pa.array(counts[some]), nothing(len(some)), nothing(len(some))], names=["id", "others", "a", "b"])
    if links:
        a, b = zip(*links, strict=True)
        yield pa.RecordBatch.from_arrays([nothing(len(a)), nothing(len(a)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["id", "others", "a", "b"])


def classes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    largest_part = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    usable = rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("vector") > 0)).where(largest_part > 0)
    distinct = usable.groupBy("label", "vector").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    scaled = distinct.withColumn("v", F.transform("vector", lambda x: x.cast("double") / largest_part))
    # nodes are numbered once; the numbers are read from the checkpoint ever after
    nodes = cut_lineage(scaled.select(F.monotonically_increasing_id().alias("id"), "first", "label", "copies", "v", "vector"))
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    kind = "float32" if rows.schema["vector"].dataType.elementType == T.FloatType() else "float64"

    found = cut_lineage(compared(nodes, cosine, largest, kind))
    others = found.where("id is not null").groupBy("id").agg(F.sum("others").alias("others"))
    merged = cut_lineage(components(found.where("a is not null").select("a", "b")))
    linked = nodes.select("id", "first").join(merged, "id")
    smallest = linked.groupBy("component").agg(F.min("first").alias("smallest"))
    of_node = join_spread(linked.select("id", "component"), smallest, ["component"], how="inner").select("id", "smallest")
    named = nodes.select("id", "first", "label", "vector", "copies").join(others, "id", "left").join(of_node, "id", "left").where("copies > 1 OR others is not null")
    named = named.select("label", "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("smallest", "first").alias("component_id"))
    # rows that cannot link have no equal among the nodes
    joined = join_spread(rows, named, ["label", "vector"])
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    ).withColumn("kept", F.col(id_col) == F.col("component_id"))
