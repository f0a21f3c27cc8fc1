"""Word spans and word/shingle/window hashes over UTF-8 buffers, in numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; no word crosses
a document boundary.  Hashes are 64-bit polynomial hashes of random byte codes
(prefix sums modulo 2**64) finished by a bit mixer, so equal byte strings have
equal hashes in every process and unequal ones collide with odds near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORDCHAR = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


class _Poly:
    """Prefix-sum polynomial hash; power tables are made once in a process."""

    def __init__(self, seed: int) -> None:
        r = np.random.default_rng(seed)
        self.base = int(r.integers(1 << 60, 1 << 62)) | 5
        self.inv = pow(self.base, -1, 1 << 64)
        self.code = r.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
        self.pow = self.ipow = np.ones(1, U64)

    def tables(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, BLOCK + 1)
            self.pow, self.ipow = _powers(self.base, n), _powers(self.inv, n)

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[s:e] for each span."""
        n = len(values)
        self.tables(n + 1)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(values * self.pow[:n], out=total[1:])
        return (total[ends] - total[starts]) * self.ipow[starts]


_BYTES, _WORDS, _CHECK = _Poly(11), _Poly(23), _Poly(37)


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column; null is empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each document (one more than rows)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = _WORDCHAR[raw]
    first, last = word.copy(), word.copy()
    cut = off[(off > 0) & (off < n)]
    gap = word[:-1].copy()
    gap[cut - 1] = False  # a document's first byte has nothing before it
    first[1:] &= ~gap
    gap = word[1:].copy()
    gap[cut - 1] = False
    last[:-1] &= ~gap
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, in blocks of about BLOCK bytes whatever the length of the texts."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        b = raw[lo:hi]
        out[i:j] = _BYTES.spans(_BYTES.code[_LOWER[b] if lower else b], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return mix(out ^ (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


def window_hashes(words: np.ndarray, at: np.ndarray, width: int, check: bool = False) -> np.ndarray:
    """Hash of words[p : p + width] for each p in at; check: by another polynomial, independent of the first."""
    poly = _CHECK if check else _WORDS
    out = np.empty(len(at), U64)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK // 4, "right")))
        lo, hi = int(at[i]), int(at[j - 1]) + width
        out[i:j] = poly.spans(words[lo:hi], at[i:j] - lo, at[i:j] - lo + width)
        i = j
    return mix(out)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 4 << 20, max_rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text stays near max_bytes (one longer document stands alone), copied small ones joined."""
    kept: list[pa.RecordBatch] = []
    held = rows = 0

    def joined() -> pa.RecordBatch:
        return kept[0] if len(kept) == 1 else pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffer_of(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(off, off[i] + max(1, max_bytes - held), "right")) - 1
            j = min(max(j, i + 1), batch.num_rows, i + max(1, max_rows - rows))
            kept.append(batch.slice(i, j - i))
            held, rows = held + int(off[j] - off[i]), rows + j - i
            i = j
            if held >= max_bytes * 0.9 or rows >= max_rows:
                yield joined()
                kept, held, rows = [], 0, 0
    if kept:
        yield joined()
