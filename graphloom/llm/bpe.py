"""Byte-level BPE encoding and decoding over Arrow batches.

Pieces are the matches of the vocabulary's split pattern. Each piece's bytes become
byte characters (one printable character for each byte value), the ``tokenizers``
library merges them, and a bounded cache remembers pieces already seen. Offsets come
from the tokens' byte lengths, mapped back to characters of the text.

Defined results: a null text counts as empty and gives no ids; very long texts are
encoded whole; repeated rows give repeated results; other columns are ignored, so
their names cannot clash; an empty table gives an empty result. Special tokens never
arise: their strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.frames import slices

#: Pieces kept per worker before the cache starts anew.
CACHE_PIECES = 400_000

#: White space as the vocabulary's pattern means it (Unicode White_Space); ``\s`` of the
#: regex module differs in the separators U+001C to U+001F.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def byte_characters() -> list[str]:
    """The byte table: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return [table[b] for b in range(256)]


class ByteBPE:
    """A vocabulary of ranked byte strings, with both directions."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        from tokenizers.models import BPE

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        chars = byte_characters()
        self._table = dict(enumerate(chars))
        self._bytes = {c: b for b, c in enumerate(chars)}
        spell = lambda token: token.decode("latin-1").translate(self._table)
        merges = [
            (spell(token[:cut]), spell(token[cut:]))
            for token, _ in sorted(ranks.items(), key=lambda item: item[1])
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        vocabulary = {spell(token): rank for token, rank in ranks.items()}
        self._model = BPE(vocab=vocabulary, merges=merges, ignore_merges=True, cache_capacity=0)
        self._tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for spelled, rank in vocabulary.items():
            self._tokens[rank] = bytes(self._bytes[c] for c in spelled)
        self.token_bytes = np.array([len(t) for t in self._tokens], dtype=np.int64)
        # a negated class keeps its other members: only the white space escape is spelled out
        spelled_out = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
        self._split = regex.compile(spelled_out).findall
        self._seen: dict[str, list[int]] = {}

    def _merge(self, piece: str) -> list[int]:
        if len(self._seen) >= CACHE_PIECES:
            self._seen.clear()
        ids = [t.id for t in self._model.tokenize(piece.encode().decode("latin-1").translate(self._table))]
        if len(piece) <= 64:
            self._seen[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        seen, merge = self._seen.get, self._merge
        for piece in self._split(text or ""):
            ids += seen(piece) or merge(piece)
        return ids

    def offsets(self, text: str | None, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token; a token that starts or ends inside a character includes it."""
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        char_of = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.token_bytes[ids]) if ids else np.zeros(0, np.int64)
        starts = ends - self.token_bytes[ids] if ids else ends
        return (char_of[starts], char_of[ends - 1] + 1) if ids else (starts, ends)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: exact even where a token holds only a part of a character."""
        tokens = self._tokens
        return b"".join([tokens[i] for i in ids])

    def decode_text(self, ids: list[int]) -> str:
        """Text of the ids; characters split between tokens are whole again, cut ones become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> ByteBPE:
    """One vocabulary for each worker process."""
    return ByteBPE(ranks_path, pattern)


def _schema(df: DataFrame, id_col: str, more: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([df.schema[id_col], *(T.StructField(name, kind) for name, kind in more.items())])


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """``(id, ids array<int>[, starts array<int>, ends array<int>])`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                ids = [bpe.encode(t) for t in texts]
                columns = [part.column(0), pa.array(ids, pa.list_(pa.int32()))]
                names = [id_col, "ids"]
                if offsets:
                    spans = [bpe.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                    columns += [pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    ints = T.ArrayType(T.IntegerType())
    more = {"ids": ints} | ({"starts": ints, "ends": ints} if offsets else {})
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, _schema(df, id_col, more))


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, decoded binary)`` for each row of ids; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch):
                decoded = [bpe.decode(ids or []) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(decoded, pa.binary())], names=[id_col, "decoded"])

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, _schema(df, id_col, {"decoded": T.BinaryType()}))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode its ids again, and return the digests of ids, offsets and text.

    Both directions run in one pass over the batch, so ids never leave the worker:
    ``(id, n_tokens, ids_sha256, decoded_sha256, n_bytes, offsets_sha256)``. The last is of
    the tokens' first and end characters as little-endian unsigned 32-bit integers, all
    first ones before all ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch):
                counts, id_digests, text_digests, sizes, span_digests = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = bpe.encode(text)
                    decoded = bpe.decode(ids)
                    counts.append(len(ids))
                    id_digests.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                    text_digests.append(hashlib.sha256(decoded).hexdigest())
                    sizes.append(len(decoded))
                    span_digests.append(hashlib.sha256(np.concatenate(bpe.offsets(text, ids)).astype("<u4").tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(span_digests, pa.string())],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "offsets_sha256"],
                )

    more = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "n_bytes": T.LongType(), "offsets_sha256": T.StringType()}
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, _schema(df, id_col, more))
