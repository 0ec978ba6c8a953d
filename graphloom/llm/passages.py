"""Substring dedup: remove word windows that also start in a document with a smaller id.

A window is 13 consecutive words. Comparing every window of the corpus would shuffle a row
for each word, so the work goes in three steps:

1. Recurring passages are confirmed. A text that an earlier document holds whole recurs as
   a whole and is not looked at further. In the others, each window has an anchor, the smallest hash of the
   6-grams inside it (a minimizer), which depends on the window's words alone: equal
   windows have equal anchors, and a text has about two anchors for nine words. Windows
   whose anchor occurs in a second document are candidates, and those that start in two
   documents recur. A recurring passage is a run of such windows in the document where
   they stand first.
2. Passages are compiled to Aho-Corasick automata over words, sharded by the document they
   stand first in, so one automaton is never larger than one document (and at most
   ``SHARD_WINDOWS`` windows at a time).
3. The stretches of all documents that hold recurring windows are streamed past the
   automaton of their shard, which locates every occurrence word for word. A shard whose
   windows occur often is dealt over several tasks by the number of its occurrences, each
   with its own copy of the passages.

Texts are exchanged once, by id and compressed; each step joins its findings to that one exchange.

Whole copies are told by a 128-bit digest; elsewhere hashes only choose what is searched,
and what is removed was matched word for word.

Defined results: words are runs of anything but ASCII white space; a null or empty text
has none; texts of under 13 words keep everything; documents that share an id never
remove from each other; a row without an id keeps everything; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.frames import by_key, join_spread
from graphloom.llm.words import SOLID, Words, parts

WINDOW = 13
ANCHOR = 6
#: What is kept of an anchor: it only chooses candidates, so one that is like another by chance costs some work, and zero bytes hardly count in a shuffle.
ANCHOR_MASK = (1 << 40) - 1
#: Windows of one automaton, at most; longer sources are compiled and streamed past in parts.
SHARD_WINDOWS = 50_000
#: Occurrences of windows, and documents of one window, that one task streams past a shard, about.
SHARD_OCCURRENCES, SHARD_DOCUMENTS = 25_000, 256
#: Bytes of packed texts that are looked at together, about half a megabyte of text.
PACKED_BYTES = 1 << 17
_LONGS = T.ArrayType(T.LongType())


def _pack():
    def run(texts: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=3).compress
        return pa.array([None if t is None else press(t) for t in (x.as_py() for x in texts.cast(pa.binary()))], pa.binary())

    return F.arrow_udf(_by_parts(run, pa.binary(), 1 << 20), T.BinaryType())


def _unpacked(packed: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, null being empty."""
    spread = zstandard.ZstdDecompressor().decompress
    return (b"" if not p.is_valid else spread(p.as_py()) for p in packed)


def _sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` neighbours, by doubling."""
    lowest, width = values, 1
    while width < span:
        step = min(width, span - width)
        lowest = np.minimum(lowest[:-step], lowest[step:])
        width += step
    return lowest


def _window_anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and anchor of each window of each text."""
    hashes = words.hashes()
    windows, at = words.grams(window, hashes=hashes)
    if not len(at):
        return at, windows, windows
    grams, starts = words.grams(anchor, seed=anchor, hashes=hashes)
    placed = np.zeros(len(words), dtype=np.uint64)
    placed[starts] = grams
    return words.rows[at], windows, _sliding_min(placed, window - anchor + 1)[at] & np.uint64(ANCHOR_MASK)


def _combined(rows: np.ndarray, values: np.ndarray, ids: np.ndarray, name: str) -> pa.RecordBatch:
    """``(name, id, more)`` for each distinct value: the smallest id of the rows that have it, and those of the other rows (null: none)."""
    # neighbouring windows often share an anchor: drop these before sorting
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    order = np.lexsort((rows, ids[rows], values))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(first)
    sizes = np.diff(np.append(at, len(rows))) - 1
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    more = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[rows[~first]]), mask=pa.array(sizes == 0))
    return pa.RecordBatch.from_arrays([pa.array(values[at].view(np.int64)), pa.array(ids[rows[at]]), more], names=[name, "id", "more"])


def _keyed(found, name: str):
    """The values found in texts, for ``mapInArrow`` over ``(id, packed, ...)``; texts that are looked at together send a value they share as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, PACKED_BYTES):
                rows, values = found(*part.columns[1:])
                if len(rows):
                    yield _combined(rows, values, part.column(0).to_numpy(zero_copy_only=False), name)

    return run


def _by_parts(run, kind: pa.DataType, limit: int | None = None):
    """A function of columns, the first being texts, that is applied to so many bytes of them at a time."""

    def whole(*columns: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(list(columns), names=[str(k) for k in range(len(columns))])
        return pa.concat_arrays([pa.array([], kind), *(run(*part.columns) for part in parts(batch, 0, limit or PACKED_BYTES))])

    return whole


def _anchors(window: int, anchor: int):
    def found(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows, _, anchors = _window_anchors(Words(list(_unpacked(texts)), SOLID), window, anchor)
        return rows, anchors

    return _keyed(found, "anchor")


def _candidates(window: int, anchor: int):
    def found(texts: pa.Array, recurring: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows, windows, anchors = _window_anchors(Words(list(_unpacked(texts)), SOLID), window, anchor)
        # an anchor recurs or not whatever the text
        marked = np.isin(anchors, recurring.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        return rows[marked], windows[marked]

    return _keyed(found, "window")


_STRETCH = pa.list_(pa.struct([("source", pa.int64()), ("level", pa.int32()), ("start", pa.int64()), ("words", pa.string())]))
_STRETCHES = T.ArrayType(T.StructType([T.StructField("source", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("words", T.StringType())]))


def _stretches(window: int):
    """Runs of recurring windows of each text that stand first in the same document."""

    def run(texts: pa.Array, *recurring: pa.Array) -> pa.Array:
        words = Words(list(_unpacked(texts)), SOLID)
        # where a window stands first does not depend on the text
        hashes, source, level = (lists.flatten().to_numpy(zero_copy_only=False) for lists in recurring)
        hashes, one = np.unique(hashes, return_index=True)
        source, level = source[one], level[one]
        grams, at = words.grams(window)
        grams = grams.view(np.int64)
        found = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
        marked = np.flatnonzero(hashes[found] == grams)
        source, level, at = source[found[marked]], level[found[marked]], at[marked]
        rows = words.rows[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) > 1) | (rows[1:] != rows[:-1]) | (source[1:] != source[:-1]) | (level[1:] != level[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for i, j in zip(first.tolist(), last.tolist(), strict=True):
            start, end, row = int(at[i]), int(at[j]) + window, int(rows[i])
            listed = words.list(start, end)
            out[row].append({"source": int(source[i]), "level": int(level[i]), "start": start - int(words.first[row]), "words": b" ".join(listed).decode("utf-8", "surrogatepass")})
        return pa.array(out, _STRETCH)

    return F.arrow_udf(_by_parts(run, _STRETCH), _STRETCHES)


def _letter(number: int) -> str:
    """A character that stands for a word; surrogates are left out."""
    return chr(number if number < 0xD800 else number + 0x800)


class Shard:
    """Automata over the windows of passages, each word being one letter."""

    def __init__(self, passages: list[str], window: int):
        self.window, self.parts = window, []
        letters: dict[str, str] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)

        def close() -> None:
            if len(automaton):
                automaton.make_automaton()
                self.parts.append((letters, automaton))

        for passage in passages:
            listed = passage.split(" ")
            for at in range(0, len(listed) - window + 1, SHARD_WINDOWS):
                if len(automaton) + min(len(listed), SHARD_WINDOWS) > SHARD_WINDOWS and len(automaton):
                    close()
                    letters, automaton = {}, ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
                part = listed[at : at + SHARD_WINDOWS + window - 1]
                for word in part:
                    if word not in letters:
                        letters[word] = _letter(len(letters) + 1)
                spelled = "".join([letters[w] for w in part])
                for k in range(len(part) - window + 1):
                    automaton.add_word(spelled[k : k + window])
        close()

    def locate(self, stretch: str) -> list[tuple[int, int]]:
        """Word ranges of the stretch that windows of the passages cover, in order."""
        listed = stretch.split(" ")
        ends = set()
        for letters, automaton in self.parts:
            spelled = "".join([letters.get(w, "\0") for w in listed])
            ends.update(end for end, _ in automaton.iter(spelled))
        ranges: list[tuple[int, int]] = []
        for end in sorted(ends):
            start = end + 1 - self.window
            if ranges and start <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], end + 1)
            else:
                ranges.append((start, end + 1))
        return ranges


def _located(window: int):
    """Rows come by shard, passages first; one shard's passages are in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int, int]] = []
        for _, members in by_key(batches, 3):
            passages, shard = [], None
            for _, _, _, of_source, key, text_key, first, words in members:
                if of_source:
                    passages.append(words)
                    continue
                shard = shard or Shard(passages, window)
                found += [(key, text_key, first + a, first + b) for a, b in shard.locate(words)]
            if len(found) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["id", "text_key", "start", "end"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["id", "text_key", "start", "end"])

    return run


_CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def _cut(window: int):
    def run(texts: pa.Array, keys: pa.Array, ranges: pa.Array, copied: pa.Array) -> pa.Array:
        rows = []
        for text, key, known, whole in zip(_unpacked(texts), keys.to_pylist(), ranges.to_pylist(), copied.to_pylist(), strict=True):
            listed = text.split()  # bytes: ASCII white space only
            if key in (whole or ()):
                kept = [] if len(listed) >= window else listed
            else:
                gone = np.zeros(len(listed) + 1, dtype=np.int64)
                for r in known or ():
                    if r["text_key"] == key:
                        gone[r["start"]] += 1
                        gone[r["end"]] -= 1
                covered = np.cumsum(gone[:-1]) > 0
                kept = [w for w, c in zip(listed, covered.tolist(), strict=True) if not c] if covered.any() else listed
            rows.append({"n_words": len(listed), "n_removed": len(listed) - len(kept), "kept": b" ".join(kept).decode("utf-8", "replace")})
        return pa.array(rows, kind)

    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    return F.arrow_udf(_by_parts(run, kind), _CUT)


def _copied(docs: DataFrame) -> DataFrame:
    """``(id, copied)``: keys of the texts that a document with a smaller id holds whole."""
    keyed = docs.where("text is not null").select("id", "text_key", F.md5(F.encode("text", "UTF-8")).alias("whole"))
    firsts = keyed.groupBy("whole").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("whole", "first")
    return join_spread(keyed, firsts, ["whole"], how="inner").where("id > first").groupBy("id").agg(F.collect_set("text_key").alias("copied"))


def _held() -> Column:
    """How many texts a row of ``_combined`` stands for."""
    return F.lit(1) + F.coalesce(F.array_size("more"), F.lit(0))


def _ids() -> Column:
    """The ids of the texts that a row of ``_combined`` stands for."""
    return F.concat(F.array("id"), F.coalesce("more", F.array().cast(_LONGS)))


def _recurring(combined: DataFrame, name: str) -> DataFrame:
    """Rows whose value is in two texts, with ``n``, the number of these, and ``source``, the smallest id: one exchange serves the counts and the rows."""
    same = Window.partitionBy(name)
    return combined.select("*", F.sum(_held()).over(same).alias("n"), F.min("id").over(same).alias("source")).where("n > 1")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` for each row: its words, those removed, and the text that stays.

    One job: the joins with the texts use the same exchange by id.
    """
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    copied = _copied(rows.where("id is not null"))
    packed = rows.select("id", "text_key", _pack()("text").alias("packed"))
    docs = packed.where("id is not null").join(copied, "id", "left")
    fresh = docs.where(F.col("copied").isNull() | ~F.array_contains("copied", F.col("text_key"))).select("id", "text_key", "packed")

    # texts that share an id are counted too: they only add candidates
    anchors = fresh.select(F.col("id").cast("long"), "packed").mapInArrow(_anchors(window, anchor), "anchor long, id long, more array<long>")
    marked = _recurring(anchors, "anchor").select("anchor", F.explode(_ids()).alias("id")).groupBy("id").agg(F.collect_list("anchor").alias("anchors"))
    looked_at = fresh.join(marked, "id").select(F.col("id").cast("long"), "packed", "anchors")
    # said here, the joins below don't add the condition, and one exchange serves all that follows
    candidates = looked_at.mapInArrow(_candidates(window, anchor), "window long, id long, more array<long>").where("window is not null").repartition("window")

    # windows that start in two texts; the level of their source tells over how many tasks (2 to its power) its occurrences are dealt
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.sum("n") / SHARD_OCCURRENCES, F.max("n") / SHARD_DOCUMENTS)))).cast("int")
    # few sources need more than one task; for all others the level is 0, and only the windows of these few meet their level
    each = candidates.groupBy("window").agg(F.min("id").alias("source"), F.sum(_held()).alias("n")).where("n > 1")
    busy = each.groupBy("source").agg(level.alias("level")).where("level > 0")
    levelled = each.join(busy, "source").select("window", "level")
    held = _recurring(candidates, "window").join(levelled, "window", "left").select("window", "source", F.coalesce("level", F.lit(0)).alias("level"), F.explode(_ids()).alias("id"))
    # lists of one aggregate are in one order; apart they are half as long as a list of structs
    of_doc = held.groupBy("id").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("window", "source", "level")])

    stretches = fresh.join(of_doc, "id").select("id", "text_key", F.explode(_stretches(window)("packed", "windows", "sources", "levels")).alias("s")).select("id", "text_key", "s.*")
    of_source, ways = F.col("id") == F.col("source"), F.pow(F.lit(2), F.col("level")).cast("int")
    tasks = F.when(of_source, F.sequence(F.lit(0), ways - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), ways).cast("int")))
    dealt = stretches.select("source", "level", F.explode(tasks).alias("task"), of_source.alias("of_source"), "id", "text_key", "start", "words")
    shards = dealt.repartition("source", "level", "task").sortWithinPartitions("source", "level", "task", F.desc("of_source"))
    located = shards.mapInArrow(_located(window), "id long, text_key long, start long, end long")

    ranges = located.groupBy("id").agg(F.collect_list(F.struct("text_key", "start", "end")).alias("ranges"))
    joined = docs.join(ranges, "id", "left")
    # a null id joins with nothing; apart from the rest, it doesn't keep the exchange from being used again
    nameless = packed.where("id is null").select("*", *[F.lit(None).cast(joined.schema[c].dataType).alias(c) for c in ("copied", "ranges")])
    cut = joined.unionByName(nameless).select("id", _cut(window)("packed", "text_key", "ranges", "copied").alias("c"))
    return cut.select(F.col("id").alias(id_col), "c.n_words", "c.n_removed", "c.kept")
