"""Words and word k-grams of many texts at once, as numpy arrays over UTF-8 bytes.

Three kinds of words occur in this subpackage. All are runs of bytes, because every byte
of a multi-byte character is at least 0x80:

* ``LETTERS``: runs of a-z, 0-9 and non-ASCII characters, after A-Z was lower-cased;
* ``SOLID``: runs of anything but ASCII white space (0x20, 0x09 to 0x0D), unchanged;
* ``PIECES``: runs of anything but spaces, tabs and the marks that end a piece
  (``.,;:!?`` and 0x0A to 0x0D), after A-Z was lower-cased.

A word's hash is a polynomial over its bytes modulo 2**64, mixed; a k-gram's hash is a
polynomial over its words' hashes, mixed again. Hashes are equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_BYTE, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_BYTE_INVERSE = np.uint64(pow(int(_BYTE), -1, 1 << 64))
LETTERS, SOLID, PIECES = "letters", "solid", "pieces"
_MARKS = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_KINDS = {
    LETTERS: np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]),
    SOLID: ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)]),
    PIECES: ~(_MARKS | np.isin(np.arange(256), [0x20, 0x09])),
}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, dtype=np.uint64)
    if n:
        powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


class Words:
    """Words of a list of texts or their UTF-8 bytes (null: empty), in order, with the row each belongs to."""

    def __init__(self, texts: list[str | bytes | None], kind: str):
        encoded = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        if kind != SOLID:
            encoded = [t.lower() for t in encoded]  # bytes: A-Z only
        # a white space byte ends every text, so that no word spans two of them
        self.data = b" ".join(encoded) + b" "
        raw = np.frombuffer(self.data, dtype=np.uint8)
        inside = _KINDS[kind][raw]
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            change = np.concatenate([[0], change])
        self.starts, self.ends = change[0::2], change[1::2]
        text_starts = np.cumsum([0] + [len(t) + 1 for t in encoded])
        #: words of row i are those from first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, text_starts)
        self._raw = raw

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Hashes of the words, or of their first bytes if only so many count."""
        n = len(self._raw)
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self._raw.astype(np.uint64) + np.uint64(1)) * _powers(_BYTE, n), out=prefix[1:])
        return mix((prefix[ends] - prefix[self.starts]) * _powers(_BYTE_INVERSE, n)[self.starts])

    def grams(self, k: int, seed: int = 0, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-grams inside one row, and the index of each one's first word."""
        h = self.hashes() if hashes is None else hashes
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.full(n, np.uint64(seed), dtype=np.uint64)
        for j in range(k):
            total = total * _WORD + h[j : j + n]
        row_end = np.repeat(self.first[1:], self.counts)[:n]
        at = np.flatnonzero(np.arange(n) + k <= row_end)
        return mix(total[at]), at

    def breaks(self) -> np.ndarray:
        """Whether a word is the first of its piece: of its text, or after a mark that ends a piece."""
        marks = np.concatenate([[0], np.cumsum(_MARKS[self._raw])])
        broken = np.ones(len(self), bool)
        broken[1:] = (marks[self.starts[1:]] > marks[self.ends[:-1]]) | (np.diff(self.rows) > 0)
        return broken

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """``(codes, vocabulary)``: the words as numbers of a dictionary of their bytes."""
        sizes = self.ends - self.starts
        inside = np.zeros(len(self._raw) + 1, np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        letters = self._raw[np.cumsum(inside[:-1]).astype(bool)]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(letters.tobytes())]).dictionary_encode()
        return np.asarray(column.indices), column.dictionary

    def text(self, first: int, last: int) -> bytes:
        """Bytes from word first up to and including word last."""
        return self.data[self.starts[first] : self.ends[last]]

    def list(self, first: int = 0, end: int | None = None) -> list[bytes]:
        data = self.data
        return [data[s:e] for s, e in zip(self.starts[first:end].tolist(), self.ends[first:end].tolist(), strict=True)]


def parts(batch: pa.RecordBatch, text: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, so that arrays over them stay small."""
    column = batch.column(text)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    group = np.cumsum(sizes + 64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end > start:
            yield batch.slice(start, end - start)
