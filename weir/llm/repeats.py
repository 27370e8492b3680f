"""Repeated passages of at least ``length`` bytes, by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Equal strings of ``length`` bytes hold equal anchors: the k bytes with the smallest hash among all k bytes in them. The strings around
one anchor that begin next to each other are a segment. Texts are dealt to blocks once, and what blocks learn comes back to them:

1. Anchors that occur twice in the corpus are found from (anchor, block, number) rows: a block names an anchor once, however often it
   occurs there, so an anchor of a third of all documents is one row for each block.
2. Their segments are told apart by 128 bits of hashes, without their bytes. Of equal segments all but the first repeat as a whole.
   An anchor with more than ``hot`` segments has its strings told apart one by one instead, which needs no bytes ever.
3. Only anchors left with different segments send those, once each. There a breadth-first backward extension over the Burrows-Wheeler
   transform of several anchors' segments sets the longest common prefixes of neighbouring suffixes by increasing value and stops at
   ``length``; the suffixes it leaves unset repeat their neighbour's first ``length`` bytes, and all but the earliest of such a run
   are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm import text
from weir.llm.scratch import partitions

_U = np.uint64
#: Bytes of an anchor.
ANCHOR = 32
#: Between segments: a byte that UTF-8 never uses.
_BETWEEN = 0xFF
_LAST = 2**63 - 1
#: Bits for the number of an anchor's segments in a block, beside the block's number.
_MANY = 20


@dataclass(frozen=True)
class Sizes:
    """block: text bytes of a block of documents, about. hot: segments of one anchor from which its strings are told apart one by one,
    so that no group of segments is larger. together: segment bytes of one transform, about. Results don't depend on them."""

    block: int = 1 << 21
    hot: int = 50_000
    together: int = 1 << 21


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts of ``length``-byte strings inside texts that have the same anchor: anchor hashes, first starts, numbers, and hashes
    of the bytes of all strings of a run."""
    keys, firsts, counts, wholes = [], [], [], []
    long = np.diff(bounds) >= length
    open_ = np.zeros(len(data) + 1, np.int8)
    np.add.at(open_, bounds[:-1][long], 1)
    np.add.at(open_, bounds[1:][long] - length + 1, -1)
    open_ = np.cumsum(open_, dtype=np.int8)[:-1].astype(bool)
    span = length - ANCHOR + 1
    for lo in range(0, len(data), text.CHUNK - length):
        part = data[lo : lo + text.CHUNK]
        if len(part) < length:
            break
        c, inverse = text.polynomial(part), text.powers(len(part))[1]
        with np.errstate(over="ignore"):
            hashes = text.mix((c[ANCHOR:] - c[:-ANCHOR]) * inverse[: len(part) - ANCHOR + 1])
        least, step = (hashes >> _U(20) << _U(20)) | np.arange(len(hashes), dtype=_U), 1
        while step * 2 <= span:
            least, step = np.minimum(least[:-step], least[step:]), step * 2
        if step < span:
            least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
        start = np.flatnonzero(open_[lo : lo + min(len(least), text.CHUNK - length)])
        if not len(start):
            continue
        at = (least[start] & _U((1 << 20) - 1)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(start) != 1)]))
        many = np.diff(np.append(head, len(start)))
        a, b = start[head], start[head] + many + length - 1
        keys.append(hashes[at[head]])
        firsts.append(a + lo)
        counts.append(many)
        with np.errstate(over="ignore"):
            wholes.append(text.mix((c[b] - c[a]) * inverse[a] + (b - a).astype(_U) * _U(0xD6E8FEB86659FD93)))
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(keys, _U), join(firsts, np.int64), join(counts, np.int64), join(wholes, _U)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of integers, and an order that sorts them."""
    order = np.argsort(keys)
    new = np.diff(keys[order], prepend=keys[order[:1]]) != 0
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out, order


def prefix_order(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The circular suffixes of ``data`` in the order of their first ``length`` bytes, and ranks by their first 8 bytes."""
    ring = np.concatenate([data, np.resize(data, 8)]).astype(_U)
    key = np.zeros(len(data), _U)
    for k in range(8):
        key = key << _U(8) | ring[k : k + len(data)]
    first, order = _ranks(key)
    rank, known = first, 8
    while known < length:
        step = min(known, length - known)
        key, known = rank * len(data) + np.roll(rank, -step), known + step
        if known < length:
            rank, _ = _ranks(key)
        else:
            order = np.argsort(key)
    return order, first


def common_prefixes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the circular suffixes, and where the common prefix with the one before is shorter than ``length``.

    Intervals of suffixes that begin with a string w grow by backward extension: the suffixes of an interval that follow a byte c map
    to the interval of cw, and the bound behind it gets the length of w as its common prefix unless it has one. Only intervals that
    set a bound are extended further, so all levels together do work in proportion to the data. The first level is taken from the
    ranks by 8 bytes, the last is ``length`` - 1.
    """
    order, rank = prefix_order(data, length)
    n = len(data)
    before = data[order - 1]
    back = np.argsort(before, kind="stable")
    follow = np.empty(n, np.int64)  # where the suffix that begins one byte earlier stands
    follow[back] = np.arange(n)
    front = data[order]
    bound = np.ones(n + 1, bool)
    bound[1:n] = np.diff(rank[order]) != 0
    lows = np.flatnonzero(bound[:-1])
    highs, owner_at = np.append(lows[1:], n), np.empty(n, np.int64)
    for _ in range(8, length):
        size = highs - lows
        moved = follow[text.gathered(lows, size)]
        owner_at[moved] = np.repeat(np.arange(len(lows)), size)
        moved = np.sort(moved)
        owner = owner_at[moved]
        cut = np.flatnonzero((np.diff(moved) != 1) | (np.diff(owner) != 0) | (np.diff(front[moved]) != 0))
        low, high = moved[np.concatenate([[0], cut + 1])], moved[np.append(cut, len(moved) - 1)] + 1
        new = ~bound[high]
        lows, highs = low[new], high[new]
        bound[highs] = True
        if not len(lows):
            break
    return order, bound[:-1]


def _repeats(segments: list[bytes], where: np.ndarray, counts: np.ndarray, length: int) -> list[np.ndarray]:
    """Of each segment, which of its first counts[i] strings also begin earlier; where[i] is the place of its first string."""
    data = np.frombuffer(b"".join(s + bytes([_BETWEEN]) for s in segments), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(s) + 1 for s in segments])])[:-1]
    order, bound = common_prefixes(data, length)
    place = np.full(len(data), _LAST)
    at = text.gathered(begin, counts)
    place[at] = text.gathered(where, counts)
    ordered = place[order]
    heads = np.flatnonzero(bound)
    least = np.minimum.reduceat(ordered, heads)
    late = np.zeros(len(data), bool)
    late[order] = (ordered > np.repeat(least, np.diff(np.append(heads, len(data))))) & (ordered != _LAST)
    return np.split(late[at], np.cumsum(counts)[:-1])


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == _U else c) for c in columns], names)


def _groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``least`` rows, about, of rows that come in the order of their first column, cut between its values."""
    held, n, want = [], 0, least
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n < want:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = whole.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield whole.slice(0, cut)
        held, n = [whole.slice(cut)], n - cut
        want = max(least, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Texts:
    """A block's different (id, text), in the order of ids and then of hashes, their bytes one after the other."""

    def __init__(self, table: pa.Table):
        self.batch = table.combine_chunks().to_batches()[0]
        ids, u = (self.batch.column(c).to_numpy() for c in ("id", "u"))
        order = np.lexsort((u, ids))
        new = np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(u[order]) != 0)])
        #: Of each row the number of its text.
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.ids = ids[order[new]]
        self.data, self.bounds = text.buffers(self.batch.column("text").take(pa.array(order[new])))


def _merged(at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of starts, those that touch as one."""
    if not len(at):
        return at, count
    order = np.argsort(at)
    at, stop = at[order], np.maximum.accumulate((at + count)[order])
    head = np.flatnonzero(np.concatenate([[True], at[1:] > stop[:-1]]))
    return at[head], np.append(stop[head[1:] - 1], stop[-1]) - at[head]


def _spread(block: int, n: int) -> np.ndarray:
    """Keys that deal a block's rows to tasks by chance."""
    return text.mix(np.arange(n, dtype=_U) + _U(block << 24))


def _strings(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings that begin at increasing places."""
    out, lo = np.empty(len(at), _U), 0
    while lo < len(at):
        hi, a = int(np.searchsorted(at, at[lo] + text.CHUNK - length)), at[lo]
        out[lo:hi] = text.span_hashes(data[a : at[hi - 1] + length], at[lo:hi] - a, at[lo:hi] - a + length)
        lo = hi
    return out


def _anchored(length: int):
    """(key, at) of a block: its anchors, with the block's number and how many different segments each has there."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = _Texts(table)
        keys, _, _, wholes = anchors(own.data, own.bounds, length)
        order = np.lexsort((wholes, keys))
        keys, wholes = keys[order], wholes[order]
        new = np.ones(len(keys), bool)
        new[1:] = np.diff(keys) != 0
        different = new.copy()
        different[1:] |= np.diff(wholes) != 0
        head = np.flatnonzero(new)
        many = np.add.reduceat(different.astype(np.int64), head) if len(head) else head
        return pa.table({"key": keys[head].view(np.int64), "at": (key[0].as_py() << _MANY) + np.minimum(many, (1 << _MANY) - 1)})

    return run


def _again(hot: int):
    """(block, keys, hot): for blocks the anchors of theirs that have another segment somewhere, and which have more than ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 1 << 19):
            key, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            head = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
            total = np.repeat(np.add.reduceat(at & ((1 << _MANY) - 1), head), np.diff(np.append(head, len(key))))
            twice = np.flatnonzero(total > 1)
            block = at[twice] >> _MANY
            order = np.argsort(block, kind="stable")
            block, twice = block[order], twice[order]
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(block) != 0])) if len(block) else np.zeros(0, np.int64)
            offsets = pa.array(np.append(cuts, len(block)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (key[twice], total[twice] > hot)]
            yield _batch([block[cuts].astype(np.int32), *lists], ["block", "keys", "hot"])

    return run


_SEGMENTS = "key bigint, hash bigint, id bigint, block int, at int, count int"


def _cut(length: int):
    """A block's segments around anchors that occur again, each once, without their bytes. Rows without a hash are runs of repeats."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        own, block = _Texts(table), key[0].as_py()
        keys, first, count, wholes = anchors(own.data, own.bounds, length)
        twice, hot = (known.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("keys", "hot"))
        twice = twice.view(_U)
        again, single = np.isin(keys, twice), np.isin(keys, twice[hot.astype(bool)])
        at = text.gathered(first[single], count[single])
        by = np.repeat(keys[single], count[single])
        keys, wholes = np.concatenate([keys[~single], _strings(own.data, at, length)]), np.concatenate([wholes[~single], by])
        again = np.concatenate([again[~single], np.ones(len(at), bool)])
        first, count = np.concatenate([first[~single], at]), np.concatenate([count[~single], np.ones(len(at), np.int64)])
        order = np.lexsort((first, wholes, keys))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(keys[order]) != 0) | (np.diff(wholes[order]) != 0)
        late, lead = order[~new], order[new]
        lead = lead[again[lead]]
        a, n = _merged(first[late], count[late])
        ids = own.ids[np.searchsorted(own.bounds, first[lead], "right") - 1]
        names = [x.split()[0] for x in _SEGMENTS.split(", ")]
        rows = _batch([keys[lead], wholes[lead], ids, np.full(len(lead), block, np.int32), first[lead].astype(np.int32), count[lead].astype(np.int32)], names)
        done = _batch([_spread(block, len(a)), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), np.full(len(a), block, np.int32), a.astype(np.int32), n.astype(np.int32)], names)
        return pa.Table.from_batches([rows, done])

    return run


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, at, count, key): runs of repeats (key null), and the segments whose bytes must be compared."""
    for batch in _groups(batches):
        whole = batch.column("hash").is_valid().to_numpy(zero_copy_only=False)
        place = [batch.column(c).to_numpy() for c in ("block", "at", "count")]
        key, hash_ = batch.column("key").to_numpy()[whole], batch.column("hash").fill_null(0).to_numpy()[whole]
        first = np.ones(len(key), bool)
        first[1:] = np.diff(key) != 0
        new = first.copy()
        new[1:] |= np.diff(hash_) != 0
        many = np.bincount(np.cumsum(first) - 1, new, minlength=1)[np.cumsum(first) - 1]
        rows = np.flatnonzero(whole)
        late = np.concatenate([np.flatnonzero(~whole), rows[~new]])
        left = np.flatnonzero(new & (many > 1))
        both = np.concatenate([late, rows[left]])
        keys = pa.concat_arrays([pa.nulls(len(late), pa.int64()), pa.array(key[left])])
        yield _batch([*[x[both] for x in place], keys], ["block", "at", "count", "key"])


_BYTES = "key bigint, id bigint, block int, at int, count int, segment binary"


def _fetched(length: int):
    """The bytes of a block's segments that are asked for; rows without a segment are runs of repeats, touching ones as one."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, asked: pa.Table) -> pa.Table:
        block, names = key[0].as_py(), [x.split()[0] for x in _BYTES.split(", ")]
        wanted = asked.column("key").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        at, count = (asked.column(c).to_numpy().astype(np.int64) for c in ("at", "count"))
        keys = asked.column("key").combine_chunks().fill_null(0).to_numpy()[wanted]
        a, n = _merged(at[~wanted], count[~wanted])
        at, count = at[wanted], count[wanted]
        ids, data = np.zeros(0, np.int64), b""
        if len(at):
            own = _Texts(table)
            ids = own.ids[np.searchsorted(own.bounds, at, "right") - 1]
            data = own.data[text.gathered(at, count + length - 1)].tobytes()
        offsets = np.concatenate([[0], np.cumsum(count + length - 1)]).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        rows = _batch([keys, ids, np.full(len(at), block, np.int32), at.astype(np.int32), count.astype(np.int32), held], names)
        done = _batch([_spread(block, len(a)), pa.nulls(len(a), pa.int64()), np.full(len(a), block, np.int32), a.astype(np.int32), n.astype(np.int32), pa.nulls(len(a), pa.binary())], names)
        return pa.Table.from_batches([rows, done])

    return run


def _found(length: int, together: int):
    """Runs of repeated strings (block, at, count) from segments in the order of their keys."""
    names = ["block", "at", "count"]

    def expanded(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        id_, block, at, count = (batch.column(c).to_numpy() for c in ("id", "block", "at", "count"))
        order = np.lexsort((block, id_))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(np.concatenate([[False], (np.diff(id_[order]) != 0) | (np.diff(block[order]) != 0)]))
        flags = _repeats(batch.column("segment").to_pylist(), (place << 32) + at, count.astype(np.int64), length)
        late = np.concatenate(flags)
        edge = np.cumsum(count)
        begins, ends = late.copy(), late.copy()
        begins[1:] &= ~late[:-1]
        ends[:-1] &= ~late[1:]
        begins[edge[:-1]] |= late[edge[:-1]]
        ends[edge[:-1] - 1] |= late[edge[:-1] - 1]
        a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        of = np.searchsorted(edge, a, "right")
        yield _batch([block[of], (at[of] + a - (edge - count)[of]).astype(np.int32), (b - a).astype(np.int32)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in _groups(batches, 1024):
            has = batch.column("segment").is_valid()
            yield batch.filter(pa.compute.invert(has)).select(names)
            batch = batch.filter(has)
            if batch.num_rows:
                held, size = [*held, batch], size + batch.column("segment").nbytes
            if size >= together:
                yield from expanded(held)
                held, size = [], 0
        if held:
            yield from expanded(held)

    return run


def _left(length: int, as_text: bool):
    """Rows with what is left of their texts, from the runs of repeated strings of their block."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, spans: pa.Table) -> pa.Table:
        own = _Texts(table)
        at, count = (spans.column(c).to_numpy().astype(np.int64) for c in ("at", "count"))
        edge = np.zeros(len(own.data) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + count + length - 1, -1)
        gone = np.append(np.cumsum(edge[:-1]) > 0, False)
        cut = np.zeros(len(gone), bool)
        cut[own.bounds] = True
        a = np.flatnonzero(gone & (cut | ~np.roll(gone, 1)))
        b = np.flatnonzero(gone & np.roll(cut | ~gone, -1)) + 1
        doc = np.searchsorted(own.bounds, a, "right") - 1
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(own.ids)))]).astype(np.int32)
        removed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(a - own.bounds[doc]), pa.array(b - own.bounds[doc])], ["start", "stop"]))
        stays = np.concatenate([[0], np.cumsum(~gone[:-1])])[own.bounds]
        kept = pa.Array.from_buffers(pa.binary(), len(own.ids), [None, pa.py_buffer(stays.astype(np.int32)), pa.py_buffer(own.data[~gone[:-1]].tobytes())])
        if as_text:
            kept = pa.array([k.as_py().decode("utf-8", "ignore") for k in kept], pa.string())
        of = pa.array(own.of)
        return pa.table([own.batch.column("row"), kept.take(of), pa.array(np.diff(own.bounds)).take(of), removed.take(of)], names=["row", "kept", "n_bytes", "removed"])

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, as_text: bool = False, sizes: Sizes = Sizes()) -> DataFrame:
    """One row for each row of ``docs``: row (a struct of its other columns), kept (binary), n_bytes, removed. With ``as_text`` kept is a
    string, without the bytes left of characters that were cut.

    Texts are UTF-8 bytes, null ones empty. Each byte is removed that a string of ``length`` bytes covers which also begins earlier:
    in a document with a smaller id, or in the same one before. Overlaps count, strings never cross documents, and all are judged
    on the input. removed lists the maximal runs removed as (start, stop). Null ids come after all others; of different texts
    with one id, a hash decides which comes first; rows with equal ids and texts lose the same bytes, and share a block. ``length`` is
    at least the anchor's 32 bytes. Strings count as equal where 128 bits of their hashes are, or their bytes.
    """
    others = [c for c in docs.columns if c != text_col]
    n = partitions(docs.sparkSession)
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_LAST)).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = told.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    told = told.withColumn("u", F.xxhash64("id", "text"))
    # all four uses take all its columns, so that they share one shuffle
    dealt = told.withColumn("block", F.pmod("u", F.lit(-(-size // sizes.block) or 1)).cast("int")).repartition(n, "block")

    def answered(rows: DataFrame, apply, schema) -> DataFrame:
        return dealt.groupBy("block").cogroup(rows.repartition(n, "block").groupBy("block")).applyInArrow(apply, schema)

    named = dealt.groupBy("block").applyInArrow(_anchored(length), "key bigint, at bigint")
    known = named.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_again(sizes.hot), "block int, keys array<bigint>, hot array<boolean>")
    segments = answered(known, _cut(length), _SEGMENTS).repartition(n, "key").sortWithinPartitions("key", "hash", "id", "block", "at")
    asked = segments.mapInArrow(_settled, "block int, at int, count int, key bigint")
    held = answered(asked, _fetched(length), _BYTES).repartition(n, "key").sortWithinPartitions("key")
    found = held.mapInArrow(_found(length, sizes.together), "block int, at int, count int")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    kept = T.StructField("kept", T.StringType() if as_text else T.BinaryType())
    return answered(found, _left(length, as_text), T.StructType([told.schema["row"], kept, T.StructField("n_bytes", T.LongType()), T.StructField("removed", span)]))
