"""Text vectors by weighted feature hashing: no model, the same on every machine.

Features are a text's words and the letter triples of its words (in lower case, with a space
at both ends of a word), hashed into ``BUCKETS`` buckets. A bucket weighs the more the fewer
texts have it, by document frequencies from one grouped aggregation over all texts, and
grows with the logarithm of its count in the text. Each bucket has ``SPREAD`` signed places in
the vector, also by hash, and the sums are brought to unit length. Texts that share rare words
or parts of words have a high cosine, others one near zero.

A null text and one without words have the zero vector, as all vectors of a service that is asked
to embed blank text. Long texts are read whole; equal texts have equal vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 384
#: Buckets of features (the weights of all are broadcast: 8 bytes each), half of them words', half triples'.
BUCKETS = 1 << 18
SPREAD = 3
#: What a triple counts, when a word counts one.
TRIPLE = 0.4
#: Bytes of text that arrays are made for at a time, about.
SLICE = 1 << 20
_WORD, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64) + 64
    group = np.cumsum(size) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end > start:
            yield texts.slice(start, end - start)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, buckets, counts)``: the features of some texts by row and bucket."""
    lowered = pa.compute.utf8_lower(pa.compute.fill_null(texts, "")).to_pylist()
    encoded = [t.encode("utf-8", "surrogatepass") for t in lowered]
    raw = np.frombuffer(b" " + b" ".join(encoded) + b" ", np.uint8)
    letter = (raw >= 0x80) | ((raw >= 0x61) & (raw <= 0x7A)) | ((raw >= 0x30) & (raw <= 0x39))
    change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = change[0::2], change[1::2]
    row_starts = np.cumsum([1] + [len(t) + 1 for t in encoded])
    row_of = lambda at: np.searchsorted(row_starts, at, side="right") - 1
    # words: a polynomial over their bytes, each with its place in the word
    n = int((ends - starts).sum())
    word = np.repeat(np.arange(len(starts)), ends - starts)
    place = np.arange(n) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
    powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, _WORD))
    sums = np.zeros(len(starts), np.uint64)
    if n:
        terms = (raw[letter].astype(np.uint64) + np.uint64(1)) * powers[place]
        sums = np.add.reduceat(terms, np.cumsum(ends - starts) - (ends - starts))
    half = BUCKETS // 2
    words = (_mix(sums) % np.uint64(half)).astype(np.int64)
    # triples: of the bytes of a word with one space before and after
    inside = letter.copy()
    inside[1:] |= letter[:-1]
    inside[:-1] |= letter[1:]
    spelt = np.where(letter, raw, 0x20).astype(np.uint64)
    code = (spelt[:-2] << np.uint64(16)) | (spelt[1:-1] << np.uint64(8)) | spelt[2:]
    good = letter[1:-1] & inside[:-2] & inside[2:]
    at = np.flatnonzero(good)
    triples = half + (_mix(code[at] * _SPREAD) % np.uint64(half)).astype(np.int64)
    pairs = np.concatenate([row_of(starts) * BUCKETS + words, row_of(at + 1) * BUCKETS + triples])
    pairs, counts = np.unique(pairs, return_counts=True)
    return pairs // BUCKETS, pairs % BUCKETS, counts


def weights(df: DataFrame, text_col: str) -> np.ndarray:
    """The weight of each bucket: ``log(1 + n / (1 + df))``, with n texts of which df have the bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(BUCKETS + 1, np.int64)
            for part in _slices(batch.column(0)):
                total[:BUCKETS] += np.bincount(features(part)[1], minlength=BUCKETS)
            total[BUCKETS] = batch.num_rows
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    seen = np.zeros(BUCKETS + 1)
    # one row for each bucket at most
    for bucket, n in df.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).toLocalIterator():
        seen[bucket] = n
    return np.log(1 + seen[BUCKETS] / (1 + seen[:BUCKETS]))


def project(rows: np.ndarray, buckets: np.ndarray, counts: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors of n rows; a row without features is zero."""
    value = weight[buckets] * (1 + np.log(counts)) * np.where(buckets < BUCKETS // 2, 1.0, TRIPLE)
    flat = np.zeros(n * DIMENSIONS)
    for k in range(SPREAD):
        h = _mix(buckets.astype(np.uint64) * _SPREAD + np.uint64((k + 1) * int(_WORD) % (1 << 64)))
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        flat += np.bincount(rows * DIMENSIONS + (h % np.uint64(DIMENSIONS)).astype(np.int64), sign * value, minlength=len(flat))
    vectors = flat.reshape(n, DIMENSIONS)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def in_slices(texts: pa.Array, weight: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(start, vectors)`` of some texts at a time."""
    start = 0
    for part in _slices(texts):
        yield start, project(*features(part), weight, len(part))
        start += len(part)


def vector(text: Column, weight: np.ndarray, context) -> Column:
    """The text's vector of ``DIMENSIONS`` numbers."""
    shared = context.broadcast(weight)

    def embed(texts: pa.Array) -> pa.Array:
        out = [project(*features(part), shared.value, len(part)).ravel() for part in _slices(texts)]
        flat = np.concatenate(out) if out else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * DIMENSIONS, pa.int32()), pa.array(flat))

    return F.arrow_udf(embed, T.ArrayType(T.DoubleType()))(text)


def embed_texts(df: DataFrame, text_col: str = "text", vector_col: str = "v", weight: np.ndarray | None = None) -> DataFrame:
    """The rows with a vector of their text beside it; weights are counted over these rows if none are given."""
    weight = weights(df, text_col) if weight is None else weight
    return df.withColumn(vector_col, vector(F.col(text_col), weight, df.sparkSession.sparkContext))
