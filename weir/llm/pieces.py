"""SentencePiece encoding and decoding with numpy, many words at a time.

Texts are cut where no piece reaches across, words are told apart by their hashes, and each distinct word is encoded once. Words of
equal length advance together: hashes of substrings probe the sorted hashes of all pieces, and the segmentation is found either by
Viterbi (the best sum of scores, what the library does for unigram models: at each place the best way to get there is a maximum over
piece lengths, kept as a back pointer) or by merging neighbours in the order of their scores (what it does for BPE models).
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm import text

_U = np.uint64
_SPACE = "▁"
#: A character without a piece costs this much less than the lowest score, as in the library.
_UNKNOWN = 10.0
_DEAD = -1e300
_HEAD = 20


class Pieces:
    """Keys, scores and texts of a SentencePiece model's pieces (with byte pieces for what no piece covers)."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        read = SentencePieceProcessor(model_proto=model)
        ids = range(read.get_piece_size())
        names = [read.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (read.is_byte(i) or read.is_control(i) or read.is_unknown(i) or read.is_unused(i))]
        if not all(read.is_byte(read.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError("the model has no byte pieces")
        if any("\n" in names[i] or _SPACE in names[i].lstrip(_SPACE) for i in plain):
            raise ValueError("a piece reaches over white space")
        self.bytes = np.array([read.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.longest = max(len(names[i]) for i in plain)
        keys = np.concatenate([_prefixes([names[i]])[0][:, -1:] for i in plain]).ravel()
        keys = _keyed(keys, np.array([len(names[i]) for i in plain], _U))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain)[order]
        self.some = np.zeros(1 << _HEAD, bool)  # which first bits any key has: most substrings are no piece and end here
        self.some[(self.keys >> _U(64 - _HEAD)).astype(np.int64)] = True
        self.scores = np.array([read.get_score(int(i)) for i in self.ids])
        self.named = {names[i]: k for k, i in enumerate(self.ids.tolist())}
        self.unknown = self.scores.min() - _UNKNOWN
        raw = self._raw(read, names, set(plain))
        self.lengths = np.array([len(r) for r in raw])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    @staticmethod
    def _raw(read, names: list[str], plain: set[int]) -> list[bytes]:
        """What each id stands for in a decoded text."""
        return [names[i].replace(_SPACE, " ").encode() if i in plain else bytes([int(names[i][3:5], 16)]) if read.is_byte(i) else b"" for i in range(len(names))]

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key among the sorted keys, or -1."""
        out = np.full(keys.shape, -1)
        maybe = self.some[(keys >> _U(64 - _HEAD)).astype(np.int64)]
        own = keys[maybe]
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == own, at, -1)
        return out


def _prefixes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of words of equal length: prefix hashes (a row for each word) and the inverse powers that shift them."""
    size = len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size).astype(_U)
    power, inverse = text.powers(size)
    out = np.zeros((len(words), size + 1), _U)
    with np.errstate(over="ignore"):
        np.cumsum(text.mix(points + _U(1)) * power, axis=1, out=out[:, 1:])
    return out, inverse


def _keyed(hashes: np.ndarray, lengths) -> np.ndarray:
    with np.errstate(over="ignore"):
        return text.mix(hashes + np.asarray(lengths, _U) * _U(0xD6E8FEB86659FD93))


def viterbi(words: list[str], pieces: Pieces) -> list[np.ndarray]:
    """Piece indices (-1: a character without a piece) of words of equal length, by the best sum of scores; of equal sums the one
    whose last piece is longest, from the end backwards."""
    prefix, inverse = _prefixes(words)
    n, size = len(words), len(words[0])
    best, back, used = np.full((n, size + 1), _DEAD), np.zeros((n, size + 1), np.int64), np.full((n, size + 1), -1)
    best[:, 0] = 0
    for end in range(1, size + 1):
        sizes = np.arange(min(end, pieces.longest), 0, -1)
        with np.errstate(over="ignore"):
            found = pieces.probe(_keyed((prefix[:, [end]] - prefix[:, end - sizes]) * inverse[end - sizes], sizes))
        sums = best[:, end - sizes] + np.where(found >= 0, pieces.scores[found], np.where(sizes == 1, pieces.unknown, _DEAD))
        pick = sums.argmax(axis=1)
        rows = np.arange(n)
        best[:, end], back[:, end], used[:, end] = sums[rows, pick], sizes[pick], found[rows, pick]
    at, rows, found = np.full(n, size), [], []
    while (live := np.flatnonzero(at > 0)).size:
        rows.append(live)
        found.append(used[live, at[live]])
        at[live] -= back[live, at[live]]
    row = np.concatenate(rows[::-1])
    order = np.argsort(row, kind="stable")  # steps went backwards, so the first pieces come first
    return _by_row(row[order], np.concatenate(found[::-1])[order], n)


def _by_row(row: np.ndarray, found: np.ndarray, n: int) -> list[np.ndarray]:
    at = np.searchsorted(row, np.arange(n + 1)).tolist()
    return [found[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def merges(words: list[str], pieces: Pieces) -> list[np.ndarray]:
    """Piece indices (-1: a character without a piece) of words of equal length: again and again the neighbours that make the
    piece of the highest score, the leftmost of equals, become one."""
    if len(words[0]) > ALONE:
        return [merged(w, pieces) for w in words]
    prefix, inverse = _prefixes(words)
    n, size = len(words), len(words[0])
    rows = np.arange(n)
    after, before = np.tile(np.arange(1, size + 2), (n, 1)), np.tile(np.arange(-1, size), (n, 1))  # neighbouring cuts of each cut

    def gain(i: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The score of joining what lies on both sides of ``cut``."""
        out = np.full(len(i), _DEAD)
        ok = (cut > 0) & (cut < size)
        i, cut = i[ok], cut[ok]
        lo, hi = before[i, cut], after[i, cut]
        with np.errstate(over="ignore"):
            found = pieces.probe(_keyed((prefix[i, hi] - prefix[i, lo]) * inverse[lo], hi - lo))
        out[ok] = np.where(found >= 0, pieces.scores[found], _DEAD)
        return out

    gains, standing = np.full((n, size + 1), _DEAD), np.ones((n, size + 1), bool)
    for cut in range(1, size):
        gains[:, cut] = gain(rows, np.full(n, cut))
    live = rows
    while live.size:
        cut = gains[live].argmax(axis=1)
        go = gains[live, cut] > _DEAD
        live, cut = live[go], cut[go]
        lo, hi = before[live, cut], after[live, cut]
        after[live, lo], before[live, hi] = hi, lo
        gains[live, cut], standing[live, cut] = _DEAD, False
        for side in (lo, hi):
            inner = (side > 0) & (side < size)
            gains[live[inner], side[inner]] = gain(live[inner], side[inner])
    row, cut = np.nonzero(standing)
    whole = row[1:] == row[:-1]
    row, lo, hi = row[1:][whole], cut[:-1][whole], cut[1:][whole]
    with np.errstate(over="ignore"):
        found = pieces.probe(_keyed((prefix[row, hi] - prefix[row, lo]) * inverse[lo], hi - lo))
    return _by_row(row, found, n)


def merged(word: str, pieces: Pieces) -> np.ndarray:
    """What ``merges`` finds for one word. Possible merges wait in a heap, so that each costs the logarithm of their number."""
    size = len(word)
    after, before = list(range(1, size + 2)), list(range(-1, size))

    def gain(cut: int) -> list[tuple[float, int, int, int]]:
        found = pieces.named.get(word[before[cut] : after[cut]]) if 0 < cut < size else None
        return [] if found is None else [(-pieces.scores[found], cut, before[cut], after[cut])]

    heap = [x for cut in range(1, size) for x in gain(cut)]
    heapq.heapify(heap)
    while heap:
        _, cut, lo, hi = heapq.heappop(heap)
        if (before[cut], after[cut]) == (lo, hi):
            after[lo], before[hi], after[cut] = hi, lo, -1
            for side in (lo, hi):
                for x in gain(side):
                    heapq.heappush(heap, x)
    out, lo = [], 0
    while lo < size:
        out.append(pieces.named.get(word[lo : after[lo]], -1))
        lo = after[lo]
    return np.array(out)


METHODS = {"viterbi": viterbi, "bpe": merges}
#: Length from which a word is merged alone.
ALONE = 512
#: Characters of words that advance together, about, and length from which a word is first cut where no piece reaches across.
TOGETHER, LONG = 1 << 18, 48


def encode_words(words: list[str], pieces: Pieces, method: str) -> list[np.ndarray]:
    """Ids of each word; characters without a piece become the byte pieces of their UTF-8 bytes."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) > LONG and len(parts := _safe_parts(w, pieces)) > 1:
            out[i] = np.concatenate(encode_words(parts, pieces, method))
        else:
            by_size.setdefault(len(w), []).append(i)
    for size, group in by_size.items():
        step = max(1, TOGETHER // (size + 1))
        for lo in range(0, len(group), step):
            own = group[lo : lo + step]
            each = METHODS[method]([words[i] for i in own], pieces)
            every = np.concatenate(each)
            ids, ends = pieces.ids[every], np.cumsum([len(x) for x in each])
            starts = [0, *ends.tolist()]
            for k, i in enumerate(own):
                out[i] = ids[starts[k] : starts[k + 1]]
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(every < 0), "right")).tolist():
                out[own[k]] = _with_bytes(words[own[k]], each[k], pieces)
    return out


def _with_bytes(word: str, found: np.ndarray, pieces: Pieces) -> np.ndarray:
    out, at = [], 0
    for p in found.tolist():
        if p >= 0:
            out.append(int(pieces.ids[p]))
            at += len(pieces.data[pieces.starts[pieces.ids[p]] : pieces.starts[pieces.ids[p]] + pieces.lengths[pieces.ids[p]]].tobytes().decode())
        else:
            out += pieces.bytes[list(word[at].encode("utf-8", "surrogatepass"))].tolist()
            at += 1
    return np.array(out)


def _safe_parts(word: str, pieces: Pieces) -> list[str]:
    """A word cut at every place that no piece occurring in it spans."""
    prefix, inverse = _prefixes([word])
    prefix, size = prefix[0], len(word)
    spans = np.zeros(size + 1, np.int64)
    for k in range(2, min(pieces.longest, size) + 1):
        with np.errstate(over="ignore"):
            at = np.flatnonzero(pieces.probe(_keyed((prefix[k:] - prefix[:-k]) * inverse[: size - k + 1], np.full(size - k + 1, k))) >= 0)
        np.add.at(spans, at + 1, 1)
        np.add.at(spans, at + k, -1)
    cuts = [0, *np.flatnonzero(np.cumsum(spans)[1:size] == 0) + 1, size]
    return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _spaced(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before each that isn't empty."""
    some = np.diff(bounds) > 0
    return np.insert(data, bounds[:-1][some], 32), bounds + np.concatenate([[0], np.cumsum(some)])


def encode(data: np.ndarray, bounds: np.ndarray, known: dict[str, text.Remembered]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of ``known``: the ids of all texts and where each text's begin (one more entry at the end)."""
    data, bounds = _spaced(data, bounds)
    space, line = data == 32, data == 10
    head = np.zeros(len(data) + 1, bool)
    head[1:-1] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    head[bounds] = True
    starts = np.flatnonzero(head[:-1])
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    hashes = np.concatenate([text.span_hashes(data[a:b], starts[i:j] - a, ends[i:j] - a) for i, j, a, b in _stretches(starts, ends)] or [np.zeros(0, _U)])
    distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw, first, out = data.tobytes(), np.searchsorted(starts, bounds), []
    lo, hi = starts[one].tolist(), ends[one].tolist()
    word = functools.cache(lambda i: raw[lo[i] : hi[i]].decode("utf-8", "replace").replace(" ", _SPACE))  # the methods ask for the same ones
    for memory in known.values():
        at, lengths = memory.of(distinct, word)
        at, lengths = at[which], lengths[which]
        out.append((memory.ids[text.gathered(at, lengths)], np.concatenate([[0], np.cumsum(lengths)])[first]))
    return out


def _stretches(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + text.CHUNK)) - 1)
        yield i, j, int(starts[i]), int(ends[j - 1])
        i = j


def decode(ids: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> list[bytes]:
    """The texts of ids, without the space that encoding puts first; control and unknown ids stand for nothing."""
    lengths = pieces.lengths[ids]
    raw = pieces.data[text.gathered(pieces.starts[ids], lengths)].tobytes()
    at = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
    return [raw[a + (raw[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


_caches: dict[tuple[bytes, str], text.Remembered] = {}
_pieces: dict[bytes, Pieces] = {}


def encoded(docs: DataFrame, model: str, methods: tuple[str, ...] = ("viterbi",), text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: row (a struct of all its columns but the text), text, and for each method its ids, as <method>,
    and what they decode to, as <method>_text.

    ``model`` is the path of a SentencePiece model without normalisation, with byte pieces and a space put before a text that isn't
    empty; the driver reads it. "viterbi" takes the pieces' scores as a unigram model's, "bpe" merges by them. A null text is an
    empty one and has no ids. U+2581 in a text can't be told from a space, as in the library, and decodes to a space.
    """
    with open(model, "rb") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held.value not in _pieces:
            _pieces[held.value] = Pieces(held.value)
        own = _pieces[held.value]
        for m in methods:
            _caches.setdefault((held.value, m), text.Remembered(lambda words, m=m: encode_words(words, own, m)))
        known = {m: _caches[held.value, m] for m in methods}
        for batch in batches:
            column = batch.column(1)
            data, bounds = text.buffers(pc.replace_substring(column, _SPACE, " "))
            for lo, hi in text.slices(bounds, text.CHUNK):
                out = [batch.column(0).slice(lo, hi - lo), column.slice(lo, hi - lo)]
                for ids, at in encode(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], known):
                    out += [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(decode(ids, at, own), pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["row", "text", *(c for m in methods for c in (m, f"{m}_text"))])

    fields = [f for m in methods for f in (T.StructField(m, T.ArrayType(T.IntegerType())), T.StructField(f"{m}_text", T.StringType()))]
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), *fields]))
