"""Phrase collocations by vertical positional inverted lists.

Texts are indexed once, in segments of one language: each distinct word of a segment with
the ascending list of the positions where it stands. Positions leave a gap where a piece of
text ends, so words at adjacent positions stand side by side in one piece. The index is
written beside the checkpoints. Level by level, the occurrence lists of frequent phrases are
merge-joined with the postings of the words at the next position; the length of the new
list is the phrase's exact frequency in the segment, and Spark adds the lengths up. Only
phrases both of whose parts (all but the last word, all but the first) are frequent are
extended.

Frequent phrases of a level are numbered, and a longer phrase is named by the number of its
part and that of its last word, so counts are exact. Only words are recognised by a hash, and only
after it was checked that no other word of the corpus has a frequent word's; else another
hash is taken. The numbers of a level reach the tasks by a broadcast while there are few
(``BROADCAST_KEYS``), else by a join that gives each segment those of its own.

Defined results: a null or empty text has no words; a null language is ``und``; repeated rows
count each; ties of score and frequency are ordered by the phrase's bytes, and of cuts the
first wins; long texts are indexed whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.frames import cut_lineage, numbered, write_shared
from graphloom.llm.words import PIECES, SOLID, Words, mix, parts

#: Bytes of text of one segment, about; a longer text is a segment of its own.
SEGMENT_BYTES = 1 << 20
#: Segments whose counts are added up in a task at a time.
TOGETHER = 8
#: Occurrences of one part when phrases are counted, about.
PART_KEYS = 1_000_000
#: Frequent phrases up to which a level's keys and numbers are broadcast (16 bytes each); more are joined, with the same result.
BROADCAST_KEYS = 4_000_000


def index(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Segments ``(block, lang, words, ends, at)``: the positions of word i are ``at[ends[i - 1]:ends[i]]``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for whole in batches:
            for part in parts(whole, 1, SEGMENT_BYTES):
                langs = part.column(0)
                for lang in langs.unique().to_pylist():
                    w = Words(part.column(1).filter(pa.compute.equal(langs, lang)).to_pylist(), PIECES)
                    if not len(w):
                        continue
                    codes, vocabulary = w.encoded()
                    position = np.arange(len(w)) + np.cumsum(w.breaks())
                    order = np.argsort(codes, kind="stable")
                    ends = np.cumsum(np.bincount(codes, minlength=len(vocabulary)))
                    lists = [vocabulary.cast(pa.string()), pa.array(ends.astype(np.int32)), pa.array(position[order].astype(np.int32))]
                    columns = [pa.array([block]), pa.array([lang], pa.string()), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "lang", "words", "ends", "at"])
                    block += 1

    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(build, "block long, lang string, words array<string>, ends array<int>, at array<int>")


class _Level:
    """The phrases of one length in a segment, and where each occurrence starts, in order."""

    def __init__(self, starts: np.ndarray, names: np.ndarray, keys: np.ndarray):
        #: ``keys[names[i]]`` is the phrase that starts at ``starts[i]``
        self.starts, self.names, self.keys = starts, names, keys

    def numbered(self, keys: np.ndarray, numbers: np.ndarray) -> _Level:
        """Those phrases that are among the sorted ``keys``, by their numbers."""
        if not len(keys):
            return _Level(self.starts[:0], self.names[:0], self.keys[:0])
        at = np.minimum(np.searchsorted(keys, self.keys), len(keys) - 1)
        good = keys[at] == self.keys
        kept = good[self.names]
        return _Level(self.starts[kept], (np.cumsum(good) - 1)[self.names[kept]], numbers[at[good]])

    def counts(self) -> np.ndarray:
        return np.bincount(self.names, minlength=len(self.keys))


def word_keys(lang: str, words: list[str], seed: int) -> np.ndarray:
    """Hashes of a language's words."""
    of_lang = np.frombuffer(hashlib.sha256(f"{seed}:{lang}".encode("utf-8", "surrogatepass")).digest()[:8], np.uint64)
    return mix(Words(words, SOLID).hashes() + of_lang)


def _words_of(lang: str, words: pa.Array, ends: np.ndarray, at: np.ndarray, seed: int) -> _Level:
    """The first level: a segment's postings in order of position."""
    codes = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    order = np.argsort(at)
    return _Level(at[order], codes[order], word_keys(lang, words.to_pylist(), seed).view(np.int64))


def _extend(level: _Level, words: _Level, size: int) -> _Level:
    """The next level: occurrences of ``size`` words merge-joined with the postings of the words that follow them."""
    if not len(level.starts) or not len(words.starts):
        return _Level(level.starts[:0], level.names[:0], level.keys[:0])
    follows = level.starts + size
    j = np.minimum(np.searchsorted(words.starts, follows), len(words.starts) - 1)
    found = words.starts[j] == follows
    if size > 1:
        # what begins one word later must be frequent too
        later = np.minimum(np.searchsorted(level.starts, level.starts + 1), len(level.starts) - 1)
        found &= level.starts[later] == level.starts + 1
    pairs, names = np.unique((level.keys[level.names[found]] << 32) | words.keys[words.names[j[found]]], return_inverse=True)
    return _Level(level.starts[found], names, pairs)


def _level(batch: pa.RecordBatch, row: int, shared: list, length: int, seed: int) -> _Level:
    """The phrases of ``length`` words of one segment; shorter ones only where they are frequent."""
    words, ends, at = batch.column("words")[row].values, *[np.asarray(batch.column(c)[row].values, np.int64) for c in ("ends", "at")]
    now = every = _words_of(batch.column("lang")[row].as_py(), words, ends, at, seed)
    for size in range(1, length):
        given = shared[size - 1]
        if given is None:
            own = batch.column(f"own{size}")[row].values
            keys, numbers = (np.zeros(0, np.int64),) * 2 if own is None else (np.asarray(own.field(c), np.int64) for c in ("key", "number"))
            order = np.argsort(keys)
            keys, numbers = keys[order], numbers[order]
        else:
            keys, numbers = given.value
        now = now.numbered(keys, numbers)
        every = now if size == 1 else every
        now = _extend(now, every, size)
    return now


def _add_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their numbers."""
    order = np.argsort(keys)
    keys = keys[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[firsts], np.add.reduceat(n[order], firsts) if len(keys) else n


def _count(segments: DataFrame, shared: list, length: int, seed: int, least: int, ways: int) -> DataFrame:
    """``(key, f)`` of the phrases of one length that occur ``least`` times or more.

    Lists of keys and counts are dealt over ``ways`` parts by a hash of the key, so that rows are lists and not single
    phrases, and a task adds up one part of about ``PART_KEYS`` keys at a time. The counts of a few segments are added
    up before they leave a task, so a frequent phrase makes no part larger than others.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                levels = [_level(batch, row, shared, length, seed) for row in range(start, min(start + TOGETHER, batch.num_rows))]
                keys, n = _add_up(np.concatenate([x.keys for x in levels]), np.concatenate([x.counts() for x in levels]))
                part = (mix(keys.view(np.uint64)) % np.uint64(ways)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                parts, starts = np.unique(part[order], return_index=True)
                offsets = pa.array(np.concatenate([starts, [len(keys)]]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (keys, n)]
                yield pa.RecordBatch.from_arrays([pa.array(parts), *lists], names=["part", "keys", "n"])

    def add(group: pa.Table) -> pa.Table:
        keys, n = _add_up(*[np.asarray(group.column(c).combine_chunks().flatten(), np.int64) for c in ("keys", "n")])
        return pa.table({"key": keys[n >= least], "f": n[n >= least]})

    return segments.mapInArrow(count, "part long, keys array<long>, n array<long>").groupBy("part").applyInArrow(add, "key long, f long")


def _blocks(segments: DataFrame, shared: list, length: int, seed: int) -> DataFrame:
    """``(block, key)``: the phrases of one length in each segment."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                level = _level(batch, row, shared, length, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(level.keys), batch.column("block")[row].as_py())), pa.array(level.keys)], names=["block", "key"])

    return segments.mapInArrow(named, "block long, key long")


def _vocabulary(segments: DataFrame, least: int, seed: int) -> tuple[int, DataFrame]:
    """``(lang, word, f, key)`` of the words that occur ``least`` times or more, counted by their spelling, and the hash's seed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                found = []
                for row in range(start, min(start + TOGETHER, batch.num_rows)):
                    words, ends = batch.column("words")[row].values, np.asarray(batch.column("ends")[row].values, np.int64)
                    found.append(pa.table([pa.repeat(batch.column("lang")[row], len(words)), words, pa.array(np.diff(ends, prepend=0))], names=["lang", "word", "n"]))
                summed = pa.concat_tables(found).group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")])
                yield from summed.select(["lang", "word", "n_sum"]).rename_columns(["lang", "word", "n"]).combine_chunks().to_batches()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.int64)
            langs, words = batch.column("lang"), batch.column("word")
            for lang in langs.unique().to_pylist():
                own = np.flatnonzero(pa.compute.equal(langs, lang).to_numpy(zero_copy_only=False))
                keys[own] = word_keys(lang, words.take(pa.array(own)).to_pylist(), seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=["lang", "word", "f", "key"])

    summed = segments.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counted = summed.mapInArrow(keyed, "lang string, word string, f long, key long")
    every = write_shared(counted)
    words = every.where(F.col("f") >= least)
    # a word, however rare, that has a frequent word's key would be taken for it
    shared_keys = every.groupBy("key").agg(F.count("*").alias("words"), F.max("f").alias("f")).where((F.col("words") > 1) & (F.col("f") >= least))
    return (seed, words) if shared_keys.isEmpty() else _vocabulary(segments, least, seed + 1)


def frequencies(segments: DataFrame, longest: int, least: int, broadcast_keys: int | None = None) -> DataFrame:
    """``(lang, phrase, size, f)`` of all phrases of 1 to ``longest`` words that occur ``least`` times or more."""
    limit = BROADCAST_KEYS if broadcast_keys is None else broadcast_keys
    shared: list = []
    found = spelled = words = None
    seed = 0
    ways = 1 + (segments.agg(F.sum(F.size("at").cast("long"))).first()[0] or 0) // PART_KEYS
    for length in range(1, longest + 1):
        if length == 1:
            seed, frequent = _vocabulary(segments, least, seed)
        else:
            frequent = _count(segments, shared, length, seed, least, ways)
        frequent = cut_lineage(frequent)
        n = frequent.count()
        if n >= 1 << 31:
            raise ValueError(f"{n} frequent phrases of {length} words: more than can be numbered")
        level = cut_lineage(numbered(frequent, n, F.asc("key")))
        if length == 1:
            words = level.select("number", "lang", F.col("word").alias("phrase"), "f")
            spelled = words
        else:
            part, last = F.shiftright("key", 32), F.col("key").bitwiseAND((1 << 32) - 1)
            named = level.select("number", "f", part.alias("part"), last.alias("last")).join(spelled.select(F.col("number").alias("part"), "lang", "phrase"), "part")
            named = named.join(words.select(F.col("number").alias("last"), F.col("phrase").alias("word")), "last")
            spelled = cut_lineage(named.select("number", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "f"))
        rows = spelled.select("lang", "phrase", F.lit(length).alias("size"), "f")
        found = rows if found is None else found.unionByName(rows)
        if length == longest:
            break
        if n <= limit:
            pairs = level.select("key", "number").toArrow()
            keys, numbers = (np.asarray(pairs.column(c).combine_chunks(), np.int64) for c in ("key", "number"))
            order = np.argsort(keys)
            shared.append(segments.sparkSession.sparkContext.broadcast((keys[order], numbers[order])))
        else:
            # a segment has as many keys as phrases, so a list is bounded by SEGMENT_BYTES
            own = _blocks(segments, shared, length, seed).join(level.select("key", "number"), "key")
            own = own.groupBy("block").agg(F.collect_list(F.struct("key", "number")).alias(f"own{length}"))
            segments = write_shared(segments.join(own, "block", "left"), TOGETHER)
            shared.append(None)
    return found


def collocations(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, covered: int = 50, first: int = 2000, broadcast_keys: int | None = None
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``first`` phrases of 2 to ``longest`` words by score.

    A phrase's score is that of its worst cut in two; one that a longer candidate holds, which
    has ``covered`` percent of its occurrences or more, is dropped.
    """
    segments = write_shared(index(df, lang_col, text_col), TOGETHER)
    totals = segments.groupBy("lang").agg(F.sum(F.size("at").cast("long")).alias("n"))
    found = cut_lineage(frequencies(segments, longest, least, broadcast_keys))
    part = found.select("lang", F.col("phrase").alias("part"), "f")
    phrases = found.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    run = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("head"), run(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    cuts = cuts.join(part.toDF("lang", "head", "l"), ["lang", "head"]).join(part.toDF("lang", "tail", "r"), ["lang", "tail"])
    # decimals of 38 digits: a count may have fifteen
    whole = lambda c: f"cast({c} as decimal(15, 0))"
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every shorter phrase of two words or more inside a phrase, with the largest count of what holds it
    inner = [F.struct(run(F.lit(i), F.lit(s)).alias("phrase"), (F.col("size") >= i + s - 1).alias("there")) for s in range(2, longest) for i in range(1, longest - s + 2)]
    if inner:
        held = phrases.select("lang", "a", "size", F.explode(F.array(*inner)).alias("p"), F.size("w").alias("words")).where("p.there")
        held = held.where(F.size(F.split("p.phrase", " ")) < F.col("size")).groupBy("lang", F.col("p.phrase").alias("phrase")).agg(F.max("a").alias("most"))
        scored = scored.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < covered * F.col("a"), F.lit(True)))
    rows = cut_lineage(scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    # all languages are sorted together by ranges, so no task sorts a whole language
    placed = numbered(rows, rows.count(), F.asc("lang"), F.desc("score"), F.desc("a"), F.asc("phrase"))
    begins = placed.groupBy("lang").agg(F.min("number").alias("begin"))
    ranked = placed.join(begins, "lang").withColumn("rank", F.col("number") - F.col("begin") + 1).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
