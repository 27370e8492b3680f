"""Token sequences of fixed size, packed by hierarchical best fit.

Every task tokenizes its documents and packs their pieces best-fit, longest first. Bins that are as good as full are done. The
others become items of a tree: their sums are dealt to nodes of a bounded size, each packs what it gets best-fit again, and so on, up
to one node or until hardly any bin fits another. Only (bin, sum) rows climb; pieces stay where they were written and learn their sequence from the composed levels.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm import text
from weir.llm.scratch import save

#: Items of one node of the tree, about, and the share of bins that a level must bring together for another one to follow.
NODE, LEAST = 20_000, 0.02


#: Bytes between which words are cut: the tokenizer never looks from a letter to one of these marks or back. Its contractions begin
#: with an apostrophe, and all its special tokens hold a bar.
_LETTER, _MARK = (np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"))


def _word_ids(model: str) -> text.Remembered:
    """A word between ASCII white space has the same ids wherever it stands, as the tokenizer drops white space, lower-cases and looks
    across none of the cuts. Text with a bar is not lower-cased before, as special tokens are told apart by case."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    return text.Remembered(lambda words: [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)])


_caches: dict[str, text.Remembered] = {}


def token_ids(data: np.ndarray, bounds: np.ndarray, known: text.Remembered, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by ``end``, and where each text's begin (one more entry at the end)."""
    raw = data.tobytes()
    found = list(text.words(data, bounds, b"|" not in raw, (_LETTER, _MARK)))
    starts, ends, hashes = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.uint64)))
    first = np.searchsorted(starts, bounds)
    distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    at, lengths = known.of(distinct, lambda i: raw[starts[one[i]] : ends[one[i]]].decode("utf-8", "replace"))
    at, lengths = at[which], lengths[which]
    before = np.concatenate([[0], np.cumsum(lengths)])
    offsets = before[first] + np.arange(len(bounds))
    ids = np.full(int(offsets[-1]), end, np.uint32)
    place = np.ones(len(ids), bool)
    place[offsets[1:] - 1] = False
    ids[place] = known.ids[text.gathered(at, lengths)]
    return ids, offsets


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first each into the fullest bin that still holds it, and the sum of each bin."""
    bins, offsets, sums = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0  # bit k: there are bins with k free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        above = some >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
        else:
            room, b = size, len(sums)
            sums.append(0)
        bins[i], offsets[i] = b, sums[b]
        sums[b] += n
        if room > n:
            free[room - n].append(b)
            some |= 1 << (room - n)
    return bins, offsets, np.array(sums, np.int64)


def _pieces(docs: DataFrame, model: Broadcast, size: int, slack: int, end: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, bin, offset, open (, ids): pieces in the bins of their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.value not in _caches:
            _caches.clear()
            _caches[model.value] = _word_ids(model.value)
        known, held = _caches[model.value], []
        for batch in batches:
            data, bounds = text.column(batch, "text")
            for lo, hi in text.slices(bounds, text.CHUNK):
                ids, at = token_ids(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], known, end)
                counts = np.diff(at)
                many = -(-counts // size)
                doc = np.repeat(np.arange(hi - lo), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                length = np.minimum(counts[doc] - piece * size, size)
                begin = at[doc] + piece * size
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(begin.tolist(), length.tolist(), strict=True)]
                own = [raw[4 * s : 4 * (s + n)] for s, n in zip(begin.tolist(), length.tolist(), strict=True)] if with_ids else []
                held.append((batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), piece, length, np.array(crc, np.int64), own))
        if not held:
            return
        length = np.concatenate([h[2] for h in held])
        bins, offset, sums = best_fit(length, size)
        task = TaskContext.get().partitionId()
        columns = [pa.concat_arrays([h[0] for h in held])]
        piece = np.concatenate([h[1] for h in held])
        columns += [pa.array(x) for x in (piece, piece * size, length, np.concatenate([h[3] for h in held]), bins + (task << 32), offset, (sums < size - slack)[bins])]
        if with_ids:
            columns.append(pa.array([x for h in held for x in h[4]], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "open", "ids"][: len(columns)])

    kinds = "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, open boolean"
    return docs.mapInArrow(run, kinds + ", ids binary" * with_ids)


def _level(items: DataFrame, level: int, nodes: int, size: int, slack: int) -> DataFrame:
    """(bin, up, shift, total, open): items (bin, total) in the bins of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        bins, shift, sums = best_fit(table.column("total").to_numpy(), size)
        task = TaskContext.get().partitionId()
        opened = sums < size - slack
        up = bins + (task << 32) + (level << 56)
        yield pa.RecordBatch.from_arrays([table.column("bin").combine_chunks(), pa.array(up), pa.array(shift), pa.array(sums[bins]), pa.array(opened[bins])], ["bin", "up", "shift", "total", "open"])

    dealt = items.withColumn("node", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(nodes))).repartition(nodes, "node").select("bin", "total")
    return save(dealt.mapInArrow(run, "bin bigint, up bigint, shift bigint, total bigint, open boolean"), f"level-{level}")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, slack: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", node: int = NODE) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (, ids: little-endian 32-bit bytes).

    ``tokenizer`` is the path of a tokenizers JSON file that drops white space, read by the driver. A document is its ids, then ``end``;
    a null or empty text is ``end`` alone. Only documents of more than ``size`` ids are cut. Pieces fill sequences from offset 0
    without gaps; a bin with at most ``slack`` places left is done. Repeated rows and null doc_ids are packed like others. ``node``: bins
    that one task packs anew, about.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    pieces = save(_pieces(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), model, size, slack, end, with_ids), "pieces")
    items = pieces.filter("open").groupBy("bin").agg(F.sum("length").alias("total"))
    way, level, before, after, nodes = None, 0, 0, items.count(), 2
    while way is None or (nodes > 1 and before - after > LEAST * before):
        nodes, level, before = max(1, -(-after // node)), level + 1, after
        step = _level(items, level, nodes, size, slack)
        items = step.filter("open").select(F.col("up").alias("bin"), "total").distinct()
        after = items.count()
        if way is None:
            way = step.select("bin", "up", "shift")
        else:
            onward = step.select(F.col("bin").alias("up"), F.col("up").alias("next"), F.col("shift").alias("more"))
            way = save(way.join(onward, "up", "left").select("bin", F.coalesce("next", "up").alias("up"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), f"way-{level}")
    placed = pieces.join(way, "bin", "left").withColumn("sequence_id", F.coalesce("up", "bin")).withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
    return placed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary): whole sequences from ``pack(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"))
