"""Toxicity scores: logistic regression by FTRL-proximal over hashed words.

Features of a text are hashes of its words, of the heads of its words (their first bytes),
of its word bigrams and of its skip-grams (a word and the second after it), each counted
once a text, so that a long text's score doesn't grow with what it repeats. The learner is
FTRL-proximal: each coordinate has its own rate, which falls with the squared gradients it
has seen, and an L1 term that keeps a weight at zero until enough evidence is there. What is
left are a few thousand weights, which are broadcast to score all texts.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows (those with the lowest hashes of
id and text; each distinct text once), dealt over shards of ``SHARD_ROWS`` rows or fewer. Each
task learns on its shard in several passes, and the weights of the shards are averaged, as
in parallel stochastic gradient descent. A feature must occur in two rows of a shard.

Defined results: a null or empty text, or one without words, has the score of a text of
which nothing is known; long texts are read whole; an id with several labels counts as
toxic if one of them is; rows with a null label or id teach nothing; rows that repeat an id
are scored each by itself; without any labelled row every score is 0.5 and nothing is
predicted toxic but by that score; other columns are ignored; an empty table gives an empty
result. A score of exactly the threshold counts as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.frames import cut_lineage
from graphloom.llm.words import LETTERS, Words, mix, parts

#: Labelled rows that the model is fitted on, at most, and those of one shard.
TRAIN_ROWS, SHARD_ROWS = 16_000, 4_000
#: Rows of a shard that must have a feature, and places of a filter that leaves out most of those that have it in fewer.
LEAST_ROWS, PLACES = 3, 1 << 24
#: Lengths in bytes of the heads of words that are features.
HEADS = (5, 6, 7, 8)
#: Learning rate, its offset, and the strengths of L1 and L2.
ALPHA, BETA, L1, L2 = 0.4, 1.0, 3.0, 0.5
PASSES = 4
#: Least score that is predicted toxic.
THRESHOLD = 0.3
#: Key of the weight that every text has.
_BIAS = 0
_KINDS = {"word": 0x51, "bigram": 0x52, "skip": 0x53, "head": 0x60}


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, keys)``: the hashed features of some texts, each once for each row, by row and key."""
    w = Words(texts, LETTERS)
    h, rows = w.hashes(), w.rows
    kinds = [mix(h ^ np.uint64(_KINDS["word"]))]
    at = [rows]
    for gap, kind in ((1, "bigram"), (2, "skip")):
        if len(h) > gap:
            same = rows[gap:] == rows[:-gap]
            kinds.append(mix(h[:-gap][same] * np.uint64(0xD1342543DE82EF95) + h[gap:][same] + np.uint64(_KINDS[kind])))
            at.append(rows[gap:][same])
    sizes = w.ends - w.starts
    for size in HEADS:
        longer = sizes > size
        kinds.append(mix(w.hashes(size)[longer] ^ np.uint64(_KINDS["head"] + size)))
        at.append(rows[longer])
    keys, at = np.concatenate(kinds), np.concatenate(at)
    order = np.lexsort((keys, at))
    keys, at = keys[order], at[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])
    return at[first], keys[first]


def learn(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, weights)`` that are not zero, after several passes of FTRL-proximal over the rows in their order."""
    chunks = range(0, len(texts), 64)
    place_of = lambda keys: (keys >> np.uint64(40)).astype(np.int64)
    filled = np.zeros(PLACES, np.uint32)
    for start in chunks:
        np.add.at(filled, place_of(features(texts[start : start + 64])[1]), 1)
    kept, sizes = [], np.zeros(len(texts), np.int64)
    for start in chunks:
        rows, keys = features(texts[start : start + 64])
        often = filled[place_of(keys)] >= LEAST_ROWS
        kept.append(keys[often])
        sizes[start : start + 64] = np.bincount(rows[often], minlength=len(texts[start : start + 64]))
    del filled
    names, inverse, seen = np.unique(np.concatenate(kept), return_inverse=True, return_counts=True)
    del kept
    often = seen >= LEAST_ROWS
    place = np.cumsum(often)  # 0 is the bias
    held = often[inverse]
    rows, index = np.repeat(np.arange(len(texts)), sizes)[held], place[inverse[held]]
    names = np.concatenate([np.array([_BIAS], np.uint64), names[often]])
    ends = np.searchsorted(rows, np.arange(len(texts) + 1))
    z, n = np.zeros(len(names)), np.zeros(len(names))

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(PASSES):
        for i, y in enumerate(labels):
            at = np.concatenate([[0], index[ends[i] : ends[i + 1]]])
            w = weight(z[at], n[at])
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(z, n)
    return names[w != 0], w[w != 0]


def _sample(keys: DataFrame) -> DataFrame:
    """Of ``keys(key, at, label)`` each key once, and at most ``TRAIN_ROWS`` of them: those with the lowest numbers ``at``."""
    firsts = cut_lineage(keys.groupBy("key").agg(F.min(F.struct("at", "label")).alias("first")).select("key", "first.*"))
    n, wanted = firsts.count(), TRAIN_ROWS + TRAIN_ROWS // 5 + 10
    if n <= TRAIN_ROWS:
        return firsts
    if n > wanted:  # a little more than the bound's share of all hashes; whole numbers
        firsts = firsts.where(F.col("at") <= F.lit((wanted << 64) // n - (1 << 63)))
    return firsts.orderBy("at", "key").limit(TRAIN_ROWS)


def fit(rows: DataFrame, known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, weights)`` sorted by key, from ``rows(id, text)`` and ``known(id, label)`` with labels 0 or 1."""
    key, at = F.xxhash64("text"), F.xxhash64("id", "text")
    # texts are not shuffled to meet their labels: only hashes are, and the few chosen ones are broadcast
    chosen = cut_lineage(_sample(rows.select("id", key.alias("key"), at.alias("at")).join(known, "id").select("key", "at", "label")))
    n = chosen.count()
    shards = max(1, -(-n // SHARD_ROWS))
    sample = rows.select(key.alias("key"), at.alias("at"), "text").join(F.broadcast(chosen), ["key", "at"]).dropDuplicates(["key"])
    dealt = sample.select("text", "label", "at").repartition(shards, F.pmod("at", F.lit(shards))).sortWithinPartitions("at")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        if texts:
            keys, weights = learn(texts, labels)
            share = len(texts) / n
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(weights * share)], names=["key", "weight"])

    # a few thousand weights: L1 keeps those of most of the sample's features at zero
    mixed = dealt.mapInArrow(shard, "key long, weight double").groupBy("key").agg(F.sum("weight")).collect()
    keys = np.array([r[0] for r in mixed], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r[1] for r in mixed], np.float64)[order]


def scores(text: Column, model: tuple[np.ndarray, np.ndarray], context) -> Column:
    """The chance that a text is toxic."""
    shared = context.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        keys, weights = shared.value
        out = []
        for part in parts(pa.record_batch([texts], names=["text"]), 0):
            n = part.num_rows
            total = np.zeros(n)
            if len(keys):
                total += weights[0] if keys[0] == _BIAS else 0.0
                rows, found = features(part.column(0).to_pylist())
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                hit = keys[at] == found
                total += np.bincount(rows[hit], weights[at[hit]], minlength=n)
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(score, T.DoubleType())(text)


def held_out(row_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether a row is kept from learning: by the CRC of its id's digits."""
    return F.coalesce(F.pmod(F.crc32(row_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(id, held_out, score, predicted)`` for each row; only rows that are not held out teach."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")).select("id", "text"), known)
    scored = rows.select(F.col("id").alias(id_col), "held_out", scores(F.col("text"), model, df.sparkSession.sparkContext).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
