"""MinHash near-dedup: BagMinHash signatures, banding, and exact multiset overlap.

A text is a multiset of word 5-grams; a gram's weight is how often it occurs. BagMinHash
draws, for each gram, a Poisson process over time and weight: the weight axis is cut into
dyadic intervals [0,1), [1,2), [2,4), ..., each interval is a process of its own with a
rate equal to its length, and a point counts if its place on the weight axis is below the
gram's weight. Each point falls on one register, which keeps its earliest time. Two texts
agree in a register with a probability equal to their weighted Jaccard similarity. A
process stops as soon as its next point comes after the latest register, so heavy grams
and long texts cost little more than one point for each gram.

Bands of registers give candidate buckets. A node is a distinct text, whatever the ids of
its rows. In each bucket every node is compared with the smallest one only (a star, dealt
over tasks in parts of ``BLOCK_ROWS``); verified links are contracted to components, and
only nodes of one bucket that are then still in different components are compared with each
other, block against block inside tasks, so that pairs are never rows. No link that would
join two components is left out. A 1-bit sketch of the registers and the multisets' sizes
rule out most pairs before their texts are read. Links count if the exact weighted Jaccard
similarity is at least 0.8.

Defined results: words are runs of a-z, 0-9 and non-ASCII characters after lower-casing
A-Z; a text of one to four words is one gram; null texts and texts without words link
with nothing; rows that repeat an id are one document, which has all their texts and links
by any of them, in whatever order the rows come; rows without an id are left out by
:func:`classes` and kept by :func:`keep`; extra columns are ignored by :func:`classes`
and kept by :func:`keep`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.frames import by_key, cut_lineage, free_name, join_spread
from graphloom.llm.graph import components
from graphloom.llm.words import LETTERS, Words, mix, parts

GRAM = 5
SIMILARITY = 0.8
#: A pair of exactly 0.8 meets in none of the bands with probability (1 - 0.8**6)**36 = 2e-5.
BANDS, BAND_ROWS = 36, 6
REGISTERS = BANDS * BAND_ROWS
#: Least share of equal bits of two 1-bit sketches: 5 standard deviations below that of similarity 0.8.
SKETCH_SHARE = 0.8

#: Documents and 5-grams of one side of a comparison of texts, about: what it holds in memory.
BLOCK_ROWS, BLOCK_GRAMS = 256, 300_000
#: Blocks of texts whose sketches make one side of a comparison of sketches.
SKETCH_BLOCKS = 16

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xC2B2AE3D27D4EB4F)


def multisets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, gram and weight of each distinct gram of each row, sorted."""
    hashes = words.hashes()
    grams, at = words.grams(GRAM, hashes=hashes)
    rows = words.rows[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < GRAM))
    if len(short):
        whole = [mix(np.array([sum(int(h) * (2 * k + 3) for k, h in enumerate(hashes[words.first[r] : words.first[r + 1]])) & (2**64 - 1)], np.uint64))[0] for r in short]
        rows, grams = np.concatenate([rows, short]), np.concatenate([grams, np.array(whole, np.uint64)])
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    first = np.flatnonzero(new)
    return rows[first], grams[first], np.diff(np.append(first, len(rows)))


def signatures(rows: np.ndarray, grams: np.ndarray, weights: np.ndarray, n_rows: int) -> np.ndarray:
    """BagMinHash registers (times) of each row; rows without grams keep infinity."""
    registers = np.full((n_rows, REGISTERS), np.inf)
    if not len(rows):
        return registers
    # one process for each gram and dyadic interval of its weight
    unit_rows, seeds, low, high, weight = [rows], [mix(grams)], [np.zeros(len(rows))], [np.ones(len(rows))], [weights]
    level, reached = 1, np.flatnonzero(weights > 1)
    while len(reached):
        start = 1 << (level - 1)
        unit_rows.append(rows[reached])
        seeds.append(mix(grams[reached] + np.uint64(int(_LEVEL) * level & (2**64 - 1))))
        low.append(np.full(len(reached), float(start)))
        high.append(np.full(len(reached), float(2 * start)))
        weight.append(weights[reached])
        reached = reached[weights[reached] > 2 * start]
        level += 1
    row, seed = np.concatenate(unit_rows), np.concatenate(seeds)
    low, rate = np.concatenate(low), np.concatenate(high) - np.concatenate(low)
    weight = np.concatenate(weight)
    time, flat = np.zeros(len(row)), registers.reshape(-1)
    while len(row):
        seed = seed + _STEP
        draw = mix(seed)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        where = mix(draw)
        at = row * REGISTERS + (where >> np.uint64(40)).astype(np.int64) % REGISTERS
        counts = low + rate * ((where & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < weight
        np.minimum.at(flat, at[counts], time[counts])
        latest = registers.max(axis=1)
        on = time < latest[row]
        row, seed, time, low, rate, weight = row[on], seed[on], time[on], low[on], rate[on], weight[on]
    return registers


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band."""
    bits = mix(registers.view(np.uint64)).reshape(len(registers), BANDS, BAND_ROWS)
    keys = np.zeros((len(registers), BANDS), dtype=np.uint64)
    for k in range(BAND_ROWS):
        keys = keys * _STEP + bits[:, :, k]
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * _LEVEL)


def bit_sketch(registers: np.ndarray) -> np.ndarray:
    """One bit of each register, as signed 64-bit words."""
    bits = (mix(registers.view(np.uint64)) & np.uint64(1)).astype(np.uint8)
    padded = np.zeros((len(registers), -(-REGISTERS // 64) * 64), dtype=np.uint8)
    padded[:, :REGISTERS] = bits
    return np.packbits(padded, axis=1).view(np.int64)


def similarity(a: str | None, b: str | None) -> float:
    """Exact weighted Jaccard similarity of two texts' multisets of grams."""
    rows, grams, weights = multisets(Words([a, b], LETTERS))
    if not len(rows):
        return 0.0
    total, cut = int(weights.sum()), int(np.searchsorted(rows, 1))
    _, i, j = np.intersect1d(grams[:cut], grams[cut:], assume_unique=True, return_indices=True)
    common = int(np.minimum(weights[:cut][i], weights[cut:][j]).sum())
    return common / (total - common)


def sign(docs: DataFrame) -> DataFrame:
    """``(doc, text_key binary, weight, bands, bits)`` of each row of ``docs(doc, text)``."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, 1):
                texts = part.column(1).to_pylist()
                rows, grams, weights = multisets(Words(texts, LETTERS))
                registers = signatures(rows, grams, weights, len(texts))
                total = np.bincount(rows, weights, minlength=len(texts)).astype(np.int64)
                keys = [hashlib.md5((t or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(keys, pa.binary()), pa.array(total),
                        pa.array(list(band_keys(registers).view(np.int64)), pa.list_(pa.int64())), pa.array(list(bit_sketch(registers)), pa.list_(pa.int64())),
                    ],
                    names=["doc", "text_key", "weight", "bands", "bits"],
                )

    return docs.mapInArrow(run, "doc long, text_key binary, weight long, bands array<long>, bits array<long>")


def _may_be_similar(a: str, b: str, similar: float) -> Column:
    """Sizes and 1-bit sketches allow the similarity."""
    equal = sum((F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(-(-REGISTERS // 64))), F.lit(0))
    sizes = F.least(f"{a}.weight", f"{b}.weight") >= similar * F.greatest(f"{a}.weight", f"{b}.weight")
    return sizes & (equal <= (1 - SKETCH_SHARE) * REGISTERS)


def _star_links(stars: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """``(a, b)``: pairs of ``stars(a, b)`` whose texts are similar enough.

    A centre's nodes are dealt over parts by their number, each of which reads the centre's
    text once, so neither a task nor a join gets all nodes of a large star.
    """
    size = stars.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("of"))
    dealt = join_spread(stars, size, ["a"], how="inner").withColumn("part", F.pmod(F.xxhash64("b"), F.col("of")).cast("int"))
    around = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", F.lit(False).alias("center"), F.col("b").alias("id"), "text")
    center = size.select("a", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("part")).join(texts.withColumnRenamed("id", "a"), "a")
    rows = center.select("a", "part", F.lit(True).alias("center"), F.col("a").alias("id"), "text").unionByName(around)

    def run(batches):
        found: list[tuple[int, int]] = []
        for (a, _), members in by_key(batches, 2):
            own: tuple[np.ndarray, np.ndarray] | None = None
            for _, _, is_center, node, text in members:
                _, grams, weights = multisets(Words([text], LETTERS))
                if is_center:
                    own = grams, weights
                elif own is not None:
                    _, i, j = np.intersect1d(own[0], grams, assume_unique=True, return_indices=True)
                    common = int(np.minimum(own[1][i], weights[j]).sum())
                    if common >= (similar - 1e-12) * (int(own[1].sum() + weights.sum()) - common):
                        found.append((a, node))
            if len(found) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("center")).mapInArrow(run, "a long, b long")


def _cell_rows(apart: DataFrame, similar: float) -> DataFrame:
    """Members of each bucket's cells for which sizes and sketches allow a link.

    A bucket's nodes are cut into blocks of texts, and those outside its main component as
    well; a cell is one block of the latter against one of the former. Sketches are small,
    so they are compared in cells of ``SKETCH_BLOCKS`` times as many nodes on each side: a
    bucket of n nodes makes n rows for each n / 4096 of them, never a row for each pair.
    """
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    coarse = lambda n: F.floor(block(n) / SKETCH_BLOCKS).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / SKETCH_BLOCKS).cast("int")))
    kept = ["is_main", "id", "component", "weight", "bits"]
    left = apart.where("NOT is_main").select("band", coarse("of_others").alias("x"), every("of_all").alias("y"), F.lit(True).alias("left"), block("of_others").alias("k"), *kept)
    right = apart.select("band", every("of_others").alias("x"), coarse("of_all").alias("y"), F.lit(False).alias("left"), block("of_all").alias("k"), *kept)
    cells = left.unionByName(right).repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "left", "k")

    def run(batches):
        out: list[tuple] = []
        for (band, _, _), members in by_key(batches, 3):
            sides: dict[bool, dict[int, list[tuple]]] = {True: {}, False: {}}
            for _, _, _, side, k, *rest in members:
                sides[side].setdefault(k, []).append(tuple(rest))
            held = {side: {k: [np.array([r[c] for r in rows]) for c in range(5)] for k, rows in blocks.items()} for side, blocks in sides.items()}
            for i, (_, id_l, of_l, w_l, bits_l) in held[True].items():
                for j, (main_r, id_r, of_r, w_r, bits_r) in held[False].items():
                    may = (of_l[:, None] != of_r[None, :]) & (main_r[None, :] | (id_l[:, None] < id_r[None, :]))
                    may &= np.minimum(w_l[:, None], w_r[None, :]) >= similar * np.maximum(w_l[:, None], w_r[None, :])
                    if not may.any():
                        continue
                    may &= np.bitwise_count(bits_l[:, None, :] ^ bits_r[None, :, :]).sum(axis=2) <= (1 - SKETCH_SHARE) * REGISTERS
                    out += [(band, i, j, True, *sides[True][i][k][:3]) for k in np.flatnonzero(may.any(axis=1))]
                    out += [(band, i, j, False, *sides[False][j][k][:3]) for k in np.flatnonzero(may.any(axis=0))]
            if len(out) >= 4096:
                yield _cell_batch(out)
                out = []
        if out:
            yield _cell_batch(out)

    return cells.mapInArrow(run, "band long, i int, j int, left boolean, is_main boolean, id long, component long")


def _cell_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["band", "i", "j", "left", "is_main", "id", "component"])


def _joined(members: list[tuple], similar: float) -> list[tuple[int, int]]:
    """Links of one cell that join components, by exact similarity."""
    rows, grams, weights = multisets(Words([m[7] for m in members], LETTERS))
    known, numbers = np.unique(grams, return_inverse=True)
    total = np.bincount(rows, weights, minlength=len(members))
    root = {m[6]: m[6] for m in members}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links, dense = [], np.zeros(len(known))
    first = np.searchsorted(rows, np.arange(len(members) + 1))
    for k in [k for k, m in enumerate(members) if m[3]]:
        own = slice(first[k], first[k + 1])
        dense[numbers[own]] = weights[own]
        common = np.bincount(rows, np.minimum(weights, dense[numbers]), minlength=len(members))
        dense[numbers[own]] = 0
        near = np.flatnonzero(common >= (similar - 1e-12) * (total + total[k] - common))
        for other in near.tolist():
            m = members[other]
            if not m[3] and (m[4] or members[k][5] < m[5]) and (a := find(members[k][6])) != (b := find(m[6])):
                root[a] = b
                links.append((members[k][5], m[5]))
    return links


def _cell_links(cells: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """``(a, b)``: verified links between components, a spanning set for each cell."""
    read = cut_lineage(cells).join(texts, "id").select("band", "i", "j", "left", "is_main", "id", "component", "text")

    def run(batches):
        for _, members in by_key(batches, 3):
            links = _joined(list(members), similar)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return read.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long")


def _nodes_of_ids(signed: DataFrame, nodes: DataFrame, repeated: DataFrame) -> DataFrame:
    """``(a, b)``: links between the texts of one document, where ids repeat with different texts."""
    several = join_spread(signed.where("weight > 0").select("doc", "text_key"), repeated.where("lo < hi").select("doc", "lo"), ["doc"], how="inner").select("doc", "text_key").distinct()
    named = join_spread(several, nodes.select("text_key", "id"), ["text_key"], how="inner").select("doc", "id")
    first = named.groupBy("doc").agg(F.min("id").alias("a"))
    return join_spread(named, first, ["doc"], how="inner").select("a", F.col("id").alias("b")).where("a <> b")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILARITY) -> DataFrame:
    """``(id, component, kept)`` for each row with an id; the component is its smallest id."""
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = cut_lineage(sign(docs))
    # one node for each distinct text, numbered once: the numbers are read from the checkpoint ever after
    texts_of = signed.where("weight > 0").groupBy("text_key").agg(
        F.min("doc").alias("doc"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("weight", "bands", "bits"))
    )
    nodes = cut_lineage(texts_of.withColumn("id", F.monotonically_increasing_id()))
    rows = nodes.select("id", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("center < last").select("band", "center")
    shared = cut_lineage(join_spread(rows, buckets, ["band"], how="inner"))

    near = cut_lineage(nodes.select("id", "doc", "text_key", "weight", "bits").join(shared.select("id").distinct(), "id", "left_semi"))
    keyed = docs.withColumn("text_key", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    texts = cut_lineage(keyed.join(near.select("id", "doc", "text_key"), ["doc", "text_key"]).select("id", "text").dropDuplicates(["id"]))

    near = near.select("id", "weight", "bits")
    stars = shared.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(near.withColumnRenamed("id", "b").alias("y"), "b")
    stars = join_spread(stars.select("a", "b", F.struct("weight", "bits").alias("y")), near.select(F.col("id").alias("a"), F.struct("weight", "bits").alias("x")), ["a"], how="inner")
    first = cut_lineage(_star_links(stars.where(_may_be_similar("x", "y", similar)).select("a", "b"), texts, similar))
    labels = components(first)

    # what still stands apart within a bucket: all but the commonest component of the bucket against the bucket
    labelled = shared.select("band", "id").join(near, "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parted = labelled.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    most = parted.groupBy("band").agg(F.max(F.struct("n", "component", "w")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("parts > 1")
    n_blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK_ROWS, w / BLOCK_GRAMS)).cast("int")
    blocks = most.select("band", F.col("most.component").alias("main"), n_blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("of_others"), n_blocks(F.col("n"), F.col("w")).alias("of_all"))
    apart = cut_lineage(join_spread(labelled, blocks, ["band"], how="inner").withColumn("is_main", F.col("component") == F.col("main")))
    second = _cell_links(_cell_rows(apart, similar), texts, similar)
    links = first.unionByName(second)
    key = F.when(F.col("weight") > 0, F.col("text_key"))
    repeated = signed.groupBy("doc").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).where("n > 1")
    once = repeated.isEmpty()
    merged = components(links if once else links.unionByName(_nodes_of_ids(signed, nodes, repeated)))

    # a class is named by the smallest id of its rows; only texts that are linked or repeated can have another one than their own row's
    linked = nodes.select("id", "doc", "text_key").join(merged, "id")
    smallest = linked.groupBy("component").agg(F.min("doc").alias("smallest"))
    lone = nodes.where("copies > 1").join(merged.select("id"), "id", "left_anti").select("text_key", F.col("doc").alias("smallest"))
    named = join_spread(linked, smallest, ["component"], how="inner").select("text_key", "smallest").unionByName(lone)
    found = join_spread(signed.select("doc", "text_key", "weight"), named, ["text_key"])
    found = found.select("doc", F.when(F.col("weight") > 0, F.coalesce("smallest", "doc")).otherwise(F.col("doc")).alias("component"))
    if not once:  # rows of one document agree, those without words as well
        found = join_spread(found.withColumn("row", F.monotonically_increasing_id()).select("doc", "row"), found.groupBy("doc").agg(F.min("component").alias("component")), ["doc"], how="inner")
    return found.select(F.col("doc").alias(id_col), "component").withColumn("kept", F.col(id_col) == F.col("component"))


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the smallest id, with all columns."""
    name = free_name(df, "_gone")
    gone = classes(df, id_col, text_col, similar).where(~F.col("kept")).select(F.col(id_col).alias(name)).distinct()
    return df.join(gone, df[id_col] == F.col(name), "left_anti")
