"""Repeated lines, dropped by probing a sharded minimal perfect hash of all line keys.

A key is the line, stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z lower-cased, if at least ``least`` code points long.
Keys travel as 64-bit hashes. Every hash is counted once (with a map-side combine, so a line that a third of the documents hold
is one row for each map task), dealt to shards, and each shard becomes one row: a minimal perfect hash and three arrays it
indexes (fingerprint, number of documents, first document). Documents' keys then probe the shards' arrays.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm import text
from weir.llm.scratch import partitions, save

_U = np.uint64
#: Distinct keys of a shard, and probes of a task, at most about.
SHARD, PROBES = 1 << 19, 1 << 20


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: at each level a key alone on its bit is placed, the others go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.concatenate([[0], np.cumsum(x)]) for x in levels]
        self.bases = np.concatenate([[0], np.cumsum([x.sum() for x in levels])]).astype(np.int64)

    @staticmethod
    def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (text.mix(keys ^ text.mix(np.array([level + 1], _U))) % _U(bits)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            bits = max(64, 2 * len(left))
            at = cls._at(left, len(levels), bits)
            once = np.bincount(at, minlength=bits) == 1
            levels.append(once)
            left = left[~once[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Numbers below the number of keys, distinct for distinct keys; -1 for some that aren't keys."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._at(keys[left], level, len(bits))
            here = bits[at]
            out[left[here]] = self.bases[level] + ranks[at[here]]
            left = left[~here]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (text.mix(keys ^ _U(0x2545F4914F6CDD1D)) >> _U(48)).astype(np.uint16)


def build(keys: np.ndarray, documents: np.ndarray, first: np.ndarray) -> bytes:
    """One shard: number of documents and first document of each distinct key."""
    table = PerfectHash.of(keys)
    at = table.index(keys)
    order = np.empty(len(keys), np.int64)
    order[at] = np.arange(len(keys))
    out = io.BytesIO()
    sizes = np.array([len(x) for x in table.levels], np.int64)
    np.savez(out, sizes=sizes, bits=np.packbits(np.concatenate([*table.levels, np.zeros(0, bool)])), print=_fingerprint(keys[order]), documents=np.minimum(documents[order], 255).astype(np.uint8), first=first[order])
    return out.getvalue()


class Shard:
    def __init__(self, blob: bytes):
        held = np.load(io.BytesIO(blob))
        bits = np.unpackbits(held["bits"], count=int(held["sizes"].sum())).astype(bool)
        self.hash = PerfectHash(np.split(bits, np.cumsum(held["sizes"])[:-1]) if len(held["sizes"]) else [])
        self.print, self.documents, self.first = held["print"], held["documents"], held["first"]

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents (at most 255; 0: no such key) and first document of each key."""
        at = self.hash.index(keys)
        known = at >= 0
        known[known] = self.print[at[known]] == _fingerprint(keys[known])
        at[~known] = 0
        return (np.where(known, self.documents[at], 0), np.where(known, self.first[at], 0)) if len(self.first) else (np.zeros(len(keys), int), np.zeros(len(keys), int))


def _keys(data: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of a run of texts: starts, ends, key hashes and whether the key is long enough."""
    low = text._LOWER[data]
    breaks = np.flatnonzero(low == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
    solid = np.flatnonzero(~text._SPACE[low])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    s, e = starts.copy(), starts.copy()
    s[some], e[some] = solid[a[some]], solid[b[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
    return starts, ends, text.span_hashes(low, s, e), points[e] - points[s] >= least


def _line_keys(docs: DataFrame, least: int) -> DataFrame:
    """(id, keys) of (id, text): hashes of the distinct keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text.column(batch, "text")
            for lo, hi in text.slices(bounds, text.CHUNK):
                own = bounds[lo : hi + 1] - bounds[lo]
                starts, _, hashes, long = _keys(data[bounds[lo] : bounds[hi]], own, least)
                at = _first_lines(data[bounds[lo] : bounds[hi]], own)
                keys = [np.unique(h[k]) for h, k in zip(np.split(hashes, at[1:-1]), np.split(long, at[1:-1]), strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).view(np.int64)))], ["id", "keys"])

    return docs.mapInArrow(run, "id bigint, keys array<bigint>")


def _first_lines(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of lines before each text, and of all: each text has one more than it has breaks."""
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    return np.concatenate([[0], np.cumsum(breaks[bounds[1:]] - breaks[bounds[:-1]] + 1)])


def _index(counted: DataFrame, shards: int) -> DataFrame:
    """(shard, held): a row for each shard of the counted keys (key, documents, first)."""
    dealt = counted.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).repartition(min(shards, max(partitions(counted.sparkSession), 1)), "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []

        def done() -> pa.RecordBatch:
            keys, documents, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([build(keys.view(_U), documents, first)], pa.binary())], ["shard", "held"])

        for batch in batches:
            own = batch.column(3).to_numpy()
            at = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
            for i, j in zip(at[:-1], at[1:], strict=True):
                if i == j:
                    continue
                if own[i] != shard:
                    if parts:
                        yield done()
                    shard, parts = int(own[i]), []
                parts.append([batch.column(k).slice(i, j - i).to_numpy(zero_copy_only=False) for k in range(3)])
        if parts:
            yield done()

    return dealt.select("key", "documents", "first", "shard").mapInArrow(run, "shard int, held binary")


def _probed(probes: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(id, key) of the probes whose key has an earlier document. A shard with many probes is copied to several tasks."""
    probes = probes.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    shares = probes.groupBy("shard").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("shares"))
    copies = index.join(shares, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("key"), "held")
    asked = probes.join(shares, "shard").select("shard", F.pmod(F.xxhash64("id"), "shares").cast("int").alias("share"), "id", "key", F.lit(None).cast("binary").alias("held"))
    n = partitions(probes.sparkSession)  # shards go to tasks in turn, and so do the shares of one
    dealt = copies.unionByName(asked).repartitionById(n, F.pmod(F.col("shard") + F.col("share"), F.lit(n)).cast("int"))
    ordered = dealt.sortWithinPartitions("shard", "share", F.col("held").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            heads = np.flatnonzero(batch.column(4).is_valid().to_numpy(zero_copy_only=False))
            ids, keys = (batch.column(k).fill_null(0).to_numpy() for k in (2, 3))
            cuts = [0, *heads.tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i in heads:
                    shard = Shard(batch.column(4)[i].as_py())
                    i += 1
                if i < j:
                    documents, first = shard.probe(keys[i:j].view(_U))
                    hit = np.flatnonzero((documents > 1) & (first != ids[i:j])) + i
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(keys[hit])], ["id", "key"])

    return ordered.mapInArrow(run, "id bigint, key bigint")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """One row for each row of ``docs``: row (a struct of its other columns), text (the lines left), n_lines, n_dropped.

    A text is split at \\n; a null or empty one is one empty line. Keys found in at least two documents lose all their lines
    except in the smallest document that holds them, which keeps even repeated ones. Rows that repeat an id are one document.
    Rows with a null id are left as they are and count for no key; of a null text, the text left is empty. Keys are told apart by 64
    bits: two of n different keys are taken for one with a probability of n * n / 2 ** 65, 3 in 100,000 for a thousand million.
    """
    others = [c for c in docs.columns if c != text_col]
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    lined = save(_line_keys(texts.select("id", "text").filter("id is not null and text is not null"), least), "line-keys")
    probes = lined.select("id", F.explode("keys").alias("key"))
    counted = probes.groupBy("key").agg(F.count("*").alias("documents"), F.min("id").alias("first"), F.max("id").alias("last"))
    counted = counted.select("key", F.when(F.col("first") == F.col("last"), 1).otherwise(F.col("documents")).alias("documents"), "first")
    n = lined.agg(F.sum(F.size("keys"))).first()[0] or 0
    shards = max(partitions(docs.sparkSession), -(-n // SHARD))
    index = save(_index(counted, shards), "line-index")
    lost = _probed(probes, index, shards).groupBy("id").agg(F.collect_set("key").alias("lost"))
    joined = texts.join(lost, "id", "left").select("row", "text", "lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text.column(batch, "text")
            lost = batch.column(2)
            at = np.concatenate([[0], lost.value_lengths().fill_null(0).to_numpy().cumsum()])
            gone = lost.flatten().to_numpy(zero_copy_only=False).view(_U)
            for lo, hi in text.slices(bounds, text.CHUNK):
                part, own = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
                starts, ends, hashes, long = _keys(part, own, least)
                lines, raw = _first_lines(part, own), part.tobytes()
                left, dropped = [], np.zeros(hi - lo, np.int64)
                for i in range(hi - lo):
                    mine = gone[at[lo + i] : at[lo + i + 1]]
                    if not len(mine):
                        left.append(raw[own[i] : own[i + 1]])
                        continue
                    a, b = lines[i], lines[i + 1]
                    stay = ~(long[a:b] & np.isin(hashes[a:b], mine))
                    dropped[i] = b - a - stay.sum()
                    left.append(b"\n".join(raw[s:e] for s, e in zip(starts[a:b][stay].tolist(), ends[a:b][stay].tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(left, pa.binary()).cast(pa.string()), pa.array(np.diff(lines)), pa.array(dropped)], ["row", "text", "n_lines", "n_dropped"])

    schema = T.StructType([texts.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(run, schema)
