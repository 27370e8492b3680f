"""Arrow text columns as numpy arrays: words, their hashes and shingles, without a Python object per word.

A word is a maximal run of bytes other than ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased. UTF-8 never uses those bytes
inside a character, so bytes and code points give the same words. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once, so that temporaries stay in the cache and memory doesn't follow the batch.
CHUNK = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=_U)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, _U)
        out[:1] = 1
        return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, CHUNK + 1), _powers(pow(_BASE, -1, 2**64), CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls become empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return buffers(col)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = col.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    if not len(col):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def polynomial(data: np.ndarray) -> np.ndarray:
    """Prefix sums c with c[0] = 0; (c[e] - c[s]) * inverse[s] is a hash of data[s:e] that doesn't depend on s."""
    with np.errstate(over="ignore"):
        out = np.empty(len(data) + 1, _U)
        out[0] = 0
        np.cumsum(_BYTES[data] * powers(len(data))[0], out=out[1:])
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n < len(_POW):
        return _POW[:n], _INV[: n + 1]
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n + 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], equal for equal bytes."""
    with np.errstate(over="ignore"):
        c, inverse = polynomial(data), powers(len(data))[1]
        return mix((c[ends] - c[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def _cuts(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK bytes that end between words."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + CHUNK)
        while hi < n and not _SPACE[data[hi - 1]]:
            step = data[hi : hi + 4096]
            at = np.flatnonzero(_SPACE[step])
            edge = bounds[np.searchsorted(bounds, hi)] if hi < bounds[-1] else n
            near = hi + at[0] + 1 if len(at) else hi + len(step)
            if edge <= near:
                hi = int(edge)
                break
            hi = int(near)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = True, apart: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the texts data[bounds[i]:bounds[i+1]], in pieces: starts, ends and hashes of the words, lower-cased or as they are.

    ``apart``: two tables of bytes; words are also cut between a byte of one and a byte of the other.
    """
    for lo, hi in _cuts(data, bounds):
        part = _LOWER[data[lo:hi]] if lower else data[lo:hi]
        space = _SPACE[part]
        edge = np.zeros(hi - lo + 1, bool)
        inner = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi, "right")] - lo
        edge[inner] = True
        edge[0] = edge[-1] = True
        if apart:
            a, b = apart[0][part], apart[1][part]
            edge[1:-1] |= (a[:-1] & b[1:]) | (b[:-1] & a[1:])
        word = ~space
        first = word.copy()
        first[1:] &= space[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= space[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        yield starts + lo, ends + lo, span_hashes(part, starts, ends)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a batch, and for each text the index of its first word (one more entry at the end)."""
    found = list(words(data, bounds))
    starts = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
    hashes = np.concatenate([x[2] for x in found]) if found else np.zeros(0, _U)
    return hashes, np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words inside each text and the text of each run; a shorter text with words is one run."""
    with np.errstate(over="ignore"):
        factor = mix(np.arange(1, size + 1, dtype=_U)) | _U(1)
        counts = np.diff(first)
        n = len(hashes) - size + 1
        text = np.repeat(np.arange(len(counts)), counts)
        if n > 0:
            runs = np.zeros(n, _U)
            for j in range(size):
                runs += hashes[j : j + n] * factor[j]
            whole = text[:n] == text[size - 1 :]
            runs, owner = runs[whole], text[:n][whole]
        else:
            runs, owner = np.zeros(0, _U), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            at = first[short]
            total = np.zeros(len(short), _U)
            for j in range(size - 1):
                has = counts[short] > j
                total[has] += hashes[at[has] + j] * factor[j]
            total += counts[short].astype(_U) * _U(0xA24BAED4963EE407)
            runs, owner = np.concatenate([runs, total]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            runs, owner = runs[order], owner[order]
    return mix(runs), owner


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], ..., starts[i] + lengths[i] - 1 of all i, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Remembered:
    """Ids of words, each encoded once: words are known by their hashes, and forgotten when there are more than ``limit``."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 2_000_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.hashes, self.starts, self.lengths, self.ids = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def of(self, hashes: np.ndarray, word: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each distinct hash are in ``self.ids``, and how many; ``word(i)`` is the word of hashes[i]."""
        if len(self.hashes) > self.limit:
            self.clear()
        at = np.searchsorted(self.hashes, hashes)
        new = np.flatnonzero(~(self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes) if len(self.hashes) else np.ones(len(hashes), bool))
        if len(new):
            found = self.encode([word(i) for i in new.tolist()])
            lengths = np.array([len(x) for x in found], np.int64)
            starts = len(self.ids) + np.cumsum(lengths) - lengths
            self.ids = np.concatenate([self.ids, np.concatenate(found).astype(np.uint32)])
            self.hashes, self.starts, self.lengths = (np.insert(a, at[new], b) for a, b in ((self.hashes, hashes[new]), (self.starts, starts), (self.lengths, lengths)))
            at = np.searchsorted(self.hashes, hashes)
        return self.starts[at], self.lengths[at]


def slices(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes together; a longer text stands alone."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
