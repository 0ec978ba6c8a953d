"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a text if at least a share (0.8) of its distinct shingles occur in
it. Shingles are word 5-grams; an item of one to four words is one shingle, all its words.
A text may be thousands of times longer than an item, so Jaccard signatures of texts would
say nothing; the search keeps sketches of the items alone. Items are partitioned by their
number of shingles, in powers of two. A sketch holds an item's smallest mixed shingle
hashes, and its size is that of its partition: it exceeds by four the number of shingles
that the partition's largest item may miss. So a text that contains an item meets at least
four (or all) of its sketch, whatever the hashes. Each partition is probed by itself with
its own threshold; candidates are then verified by exact containment of all shingles.

The items' sketches are computed in tasks and written once. If all their shingles are few
enough (``BROADCAST_SHINGLES``, counted beforehand), they are broadcast and the texts are
streamed past them once. Otherwise the texts' shingles are joined with the sketches: a
table of fixed size tells most shingles of texts from those of any sketch before they are
shuffled, hits are counted for each text and item, and candidates are verified by a second
join. Both ways give the same rows.

Defined results: words are runs of a-z, 0-9 and non-ASCII characters after lower-casing
A-Z; items without words are found nowhere; null and empty texts contain nothing; repeated
rows give repeated results, an item repeated word for word under one id counts once, and
items that share an id are searched each by itself; a share of exactly the bound is a find; other columns are kept by :func:`keep`
and ignored by :func:`search`; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.frames import drop_rows, join_spread, write_shared
from graphloom.llm.words import LETTERS, Words, mix

GRAM = 5
CONTAINMENT = 0.8
#: Shingles of all items up to which they are broadcast (about 100 MB in a task); more are joined.
BROADCAST_SHINGLES = 4_000_000
#: Bits of the table that tells most shingles of texts from those of any sketch.
TABLE_BITS = 20

_MATCH = pa.struct([("item", pa.int64()), ("n", pa.int32()), ("found", pa.int32())])
_MATCHES = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("found", T.IntegerType())]))
_INDEX = T.StructType(
    [T.StructField("width", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("need", T.IntegerType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("shingles", T.ArrayType(T.LongType()))]
)
_INDEX_ARROW = pa.struct([("width", pa.int32()), ("part", pa.int32()), ("need", pa.int32()), ("sketch", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])


def _shingles(words: Words, width: int) -> np.ndarray:
    """Mixed hashes of the width-grams; equal words of different width differ."""
    return mix(words.grams(width, seed=0 if width == GRAM else width)[0])


def _may_miss(n: int, containment: float) -> int:
    """Shingles that an item of n may miss and still be contained."""
    return n - int(np.ceil(containment * n - 1e-9))


def _indexed(containment: float):
    def one(text: str | None) -> dict | None:
        words = Words([text], LETTERS)
        width = min(GRAM, len(words))
        if not width:
            return None
        shingles = np.unique(_shingles(words, width))
        n = len(shingles)
        part = (n - 1).bit_length()
        size = min(n, _may_miss(1 << part, containment) + 4)
        return {"width": width, "part": part, "need": size - _may_miss(n, containment), "sketch": shingles[:size].view(np.int64), "shingles": shingles.view(np.int64)}

    return F.arrow_udf(lambda texts: pa.array([one(t) for t in texts.to_pylist()], _INDEX_ARROW), _INDEX)


def index(items: DataFrame, item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """``(item, id, width, part, need, sketch, shingles)`` of each distinct item with words, written once; ``item`` numbers them."""
    distinct = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).distinct()
    made = distinct.select("id", _indexed(containment)("text").alias("x")).where("x is not null")
    return write_shared(made.select(F.monotonically_increasing_id().alias("item"), "id", "x.*"))


class Block:
    """All items' sketches, partition by partition, and their shingles, as flat arrays."""

    def __init__(self, table: pa.Table, containment: float):
        table = table.combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        part, sketches, shingles = np.asarray(column("part")), column("sketch"), column("shingles")
        self.item, self.need, self.containment = np.asarray(column("item")), np.asarray(column("need")), containment
        self.widths = np.unique(np.asarray(column("width"))).tolist()
        self.start, self.shingle = np.asarray(shingles.offsets), np.asarray(shingles.flatten()).view(np.uint64)
        sketch, owner = np.asarray(sketches.flatten()).view(np.uint64), np.repeat(np.arange(len(part)), np.diff(np.asarray(sketches.offsets)))
        self.parts = []
        for p in np.unique(part):
            own = np.flatnonzero(part[owner] == p)
            own = own[np.argsort(sketch[own], kind="stable")]
            self.parts.append((sketch[own], owner[own]))
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[sketch >> np.uint64(64 - TABLE_BITS)] = True

    def matches(self, text: str | None) -> list[dict[str, int]]:
        words = Words([text], LETTERS)
        found: list[dict[str, int]] = []
        every = np.concatenate([np.zeros(0, np.uint64), *(_shingles(words, w) for w in self.widths)])
        near = np.unique(every[self.table[every >> np.uint64(64 - TABLE_BITS)]])
        if not len(near):
            return found
        every = np.sort(every)
        for sketch, owner in self.parts:
            lo, hi = np.searchsorted(sketch, near, "left"), np.searchsorted(sketch, near, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            owners, counts = np.unique(np.concatenate([owner[lo[k] : hi[k]] for k in hit]), return_counts=True)
            for i in owners[counts >= self.need[owners]].tolist():
                wanted = self.shingle[self.start[i] : self.start[i + 1]]
                at = np.minimum(np.searchsorted(every, wanted), len(every) - 1)
                held = int((every[at] == wanted).sum())
                if held >= self.containment * len(wanted) - 1e-9:
                    found.append({"item": int(self.item[i]), "n": len(wanted), "found": held})
        return found


def _matcher(docs: DataFrame, known: DataFrame, containment: float):
    """A function of texts that lists the items contained; the items were counted and are few."""
    shared = docs.sparkSession.sparkContext.broadcast(Block(known.select("item", "width", "part", "need", "sketch", "shingles").toArrow(), containment))

    def run(column: pa.Array) -> pa.Array:
        block = shared.value
        return pa.array([block.matches(t) for t in column.to_pylist()], pa.list_(_MATCH))

    return F.arrow_udf(run, _MATCHES)


def _exploded(docs: DataFrame, widths: list[int], table: np.ndarray | None) -> DataFrame:
    """``(id, text_key, shingle)``: distinct shingles of each text, those that the table has if there is one."""
    shared = None if table is None else docs.sparkSession.sparkContext.broadcast(table)

    def run(texts: pa.Array) -> pa.Array:
        lists = []
        for text in texts.to_pylist():
            words = Words([text], LETTERS)
            every = np.concatenate([np.zeros(0, np.uint64), *(_shingles(words, w) for w in widths)])
            if shared is not None:
                every = every[shared.value[every >> np.uint64(64 - TABLE_BITS)]]
            lists.append(np.unique(every).view(np.int64))
        return pa.array(lists, pa.list_(pa.int64()))

    return docs.select("id", "text_key", F.explode(F.arrow_udf(run, T.ArrayType(T.LongType()))("text")).alias("shingle"))


def _joined(docs: DataFrame, known: DataFrame, containment: float) -> DataFrame:
    """``(id, text_key, item, n, found)`` of distinct texts of ``docs(id, text_key, text)``, by joins alone."""
    widths = [w for (w,) in known.select("width").distinct().collect()]  # at most five
    sketches = known.select("item", "need", F.explode("sketch").alias("shingle"))
    # at most one row for each bit of the table, whatever the number of items
    bits = sketches.select(F.shiftrightunsigned("shingle", 64 - TABLE_BITS).alias("bit")).distinct().toArrow()
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[np.asarray(bits.column("bit").combine_chunks())] = True
    hits = join_spread(_exploded(docs, widths, table).distinct(), sketches, ["shingle"], how="inner")
    near = hits.groupBy("id", "text_key", "item", "need").agg(F.count("*").alias("met")).where("met >= need").select("id", "text_key", "item")
    near = write_shared(near)
    read = docs.alias("d").join(near.select("id", "text_key").distinct().alias("n"), F.col("d.id").eqNullSafe(F.col("n.id")) & (F.col("d.text_key") == F.col("n.text_key")), "left_semi")
    held = _exploded(read, widths, None).distinct()
    wanted = join_spread(near, known.select("item", "shingles"), ["item"], how="inner").select("id", "text_key", "item", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    same = F.col("w.id").eqNullSafe(F.col("h.id")) & (F.col("w.text_key") == F.col("h.text_key")) & (F.col("w.shingle") == F.col("h.shingle"))
    both = wanted.alias("w").join(held.alias("h"), same).select("w.*")
    counted = both.groupBy("id", "text_key", "item", "n").agg(F.count("*").alias("found"))
    return counted.where(F.col("found") >= containment * F.col("n") - 1e-9)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """``(id, item_id, n_shingles, n_found, containment)`` for each text and item contained in it."""
    known = index(items, item_id, item_text, containment)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    if _few(known):
        match = _matcher(docs, known, containment)
        hits = rows.select("id", F.explode(match("text")).alias("m")).select("id", "m.item", "m.n", "m.found")
    else:
        found = _joined(rows, known, containment)
        same = F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.text_key") == F.col("f.text_key"))
        hits = rows.drop("text").alias("r").join(found.alias("f"), same).select("r.id", "f.item", "f.n", "f.found")
    named = join_spread(hits, known.select("item", F.col("id").alias("name")), ["item"], how="inner")
    return named.select(
        F.col("id").alias(id_col), F.col("name").alias(item_id), F.col("n").cast("long").alias("n_shingles"), F.col("found").cast("long").alias("n_found"), (F.col("found") / F.col("n")).alias("containment")
    )


def _few(known: DataFrame) -> bool:
    return (known.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= BROADCAST_SHINGLES


def keep(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """The rows whose text contains no item, with all their columns."""
    known = index(items, item_id, item_text, containment)
    if _few(known):
        return docs.where(F.size(_matcher(docs, known, containment)(F.col(text_col))) == 0)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return drop_rows(docs, _joined(rows, known, containment).select("id", "text_key"), id_col, text_col)
