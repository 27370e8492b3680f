"""Near-duplicate documents by b-bit MinHash with banding, confirmed on whole shingle sets.

Plan. One pass hashes every text's distinct word shingles to a set size, a 128-bit set hash, band keys (hashes of runs of
minima) and a packed signature that keeps the low ``bits`` of every minimum. Equal sets become one node. Nodes that share a
band key are compared with the key's smallest node first: the similarity estimated from the packed signatures, corrected for chance
collisions, drops hopeless pairs, and the rest is counted on the full sets. Where these stars leave a key's nodes in several
components, the node with the most links is the key's next hub. Where it still has several, those of
its nodes that have a second such key are compared inside the key, in tiles of bounded size, which return only a spanning forest.
Texts that share a key by chance, as those with a common header do, seldom have a second one. No pairs of a group are ever listed as
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm import text
from weir.llm.graph import components
from weir.llm.scratch import partitions, save

_U = np.uint64


@dataclass(frozen=True)
class MinHash:
    """words: shingle length. percent: least similarity. bands x rows minima: two nodes are compared if they share two band keys, or one
    with a hub. As set, a pair at 75 % shares none of 64 keys with probability 4e-6 and less than two with 5e-5. bits:
    kept of each minimum. deviations: standard deviations that an estimate may lie under ``percent`` before its pair is dropped
    uncounted. tile: shingles in one side of a tile; fan: pairs of one hub in a task.
    """

    words: int = 5
    percent: int = 75
    bands: int = 64
    rows: int = 6
    bits: int = 2
    deviations: float = 6.0
    tile: int = 250_000
    fan: int = 2000

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    def estimate(self, agreeing):
        """Similarity from the number of agreeing b-bit values (numbers, arrays or columns): unequal minima agree by chance once in
        2 ** bits."""
        chance = 2.0**-self.bits
        return (agreeing / self.minima - chance) / (1 - chance)

    @property
    def least_agreeing(self) -> float:
        """Agreeing values under which a pair at ``percent`` practically never falls."""
        p = self.percent / 100 + (1 - self.percent / 100) * 2.0**-self.bits
        return self.minima * p - self.deviations * math.sqrt(self.minima * p * (1 - p))

    @property
    def least(self) -> float:
        """The estimate from so many."""
        return self.estimate(self.least_agreeing)


def _minima(runs: np.ndarray, starts: np.ndarray, how: MinHash) -> np.ndarray:
    """Minima under each hash function, a row for each start."""
    rng = np.random.default_rng(7)
    factor = rng.integers(0, 2**32, how.minima, dtype=np.uint32) | np.uint32(1)
    shift = rng.integers(0, 2**32, how.minima, dtype=np.uint32)
    x, out = (runs >> _U(32)).astype(np.uint32), np.empty((len(starts), how.minima), np.uint32)
    for k in range(how.minima):
        y = x * factor[k]
        y += shift[k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def _packed(minima: np.ndarray, how: MinHash) -> np.ndarray:
    """The low bits of the minima in 64-bit words."""
    per = 64 // how.bits
    low = (minima & np.uint32(2**how.bits - 1)).astype(_U)
    out = np.zeros((len(minima), -(-how.minima // per)), _U)
    for k in range(how.minima):
        out[:, k // per] |= low[:, k] << _U(k % per * how.bits)
    return out


def _band_keys(minima: np.ndarray, how: MinHash) -> np.ndarray:
    with np.errstate(over="ignore"):
        odd = text.mix(np.arange(11, 11 + how.rows, dtype=_U)) | _U(1)
        rows = minima.reshape(len(minima), how.bands, how.rows).astype(_U)
        return text.mix((rows * odd).sum(axis=2, dtype=_U) + text.mix(np.arange(how.bands, dtype=_U) + _U(101)))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1).view(np.int64)))


def _distinct(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Ranges of rows and each row's sorted distinct shingle hashes."""
    data, bounds = text.column(batch, "text")
    for lo, hi in text.slices(bounds, text.CHUNK):
        hashes, first = text.word_hashes(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        runs, owner = text.shingles(hashes, first, words)
        at = np.searchsorted(owner, np.arange(hi - lo + 1))
        yield lo, hi, [np.unique(runs[at[i] : at[i + 1]]) for i in range(hi - lo)]


def signatures(docs: DataFrame, how: MinHash) -> DataFrame:
    """(id, n, set_a, set_b, packed, keys) of (id, text); texts without words have n = 0 and no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets in _distinct(batch, how.words):
                n = np.array([len(x) for x in sets], np.int64)
                full, counts = n > 0, np.zeros((2, hi - lo), np.int64)
                a, b, packed, keys = np.zeros(hi - lo, _U), np.zeros(hi - lo, _U), np.zeros(0, _U), np.zeros(0, _U)
                if full.any():
                    runs, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    with np.errstate(over="ignore"):
                        a[full] = np.add.reduceat(runs, starts)
                        b[full] = np.add.reduceat(text.mix(runs ^ _U(0x5851F42D4C957F2D)), starts)
                    minima = _minima(runs, starts, how)
                    packed, keys = _packed(minima, how), _band_keys(minima, how)
                    counts[:, full] = [[packed.shape[1]], [keys.shape[1]]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _lists(packed, counts[0]), _lists(keys, counts[1])],
                    ["id", "n", "set_a", "set_b", "packed", "keys"],
                )

    return docs.select("id", "text").mapInArrow(run, "id bigint, n bigint, set_a bigint, set_b bigint, packed array<bigint>, keys array<bigint>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, set_a, shingles) of (id, text): the sorted distinct 64-bit shingle hashes as bytes, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets in _distinct(batch, words):
                total = np.array([x.sum(dtype=_U) for x in sets], _U).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(total), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "set_a", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, set_a bigint, shingles binary")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _plausible(how: MinHash):
    """Whether rows a and b (n, packed) can be similar enough: by size, then by the agreement of their packed signatures."""
    words, low = -(-how.minima * how.bits // 64), sum(1 << i for i in range(0, 64, how.bits))
    low -= (low >> 63) << 64
    unequal = F.lit(0)
    for k in range(words):
        x = F.get("a_packed", F.lit(k)).bitwiseXOR(F.get("b_packed", F.lit(k)))
        for i in range(1, how.bits):
            x = x.bitwiseOR(F.shiftrightunsigned(F.get("a_packed", F.lit(k)).bitwiseXOR(F.get("b_packed", F.lit(k))), i))
        unequal = unequal + F.bit_count(x.bitwiseAND(F.lit(low).cast("bigint")))
    return (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * how.percent) & (how.estimate(F.lit(how.minima) - unequal) >= how.least)


def _confirmed(pairs: DataFrame, sets: DataFrame, how: MinHash) -> DataFrame:
    """The pairs (a, b) whose sets are linked. Each hub a goes once to each of its shares of at most about ``fan`` pairs."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / how.fan).alias("shares"))
    hub_rows = hubs.join(sets, hubs.a == sets.id).select("a", F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1)).alias("share"), F.lit(None).cast("bigint").alias("b"), "shingles")
    dealt = pairs.join(hubs, "a").select("a", (F.pmod(F.xxhash64("b"), "shares")).cast("int").alias("share"), "b")
    rows = hub_rows.unionByName(dealt.join(sets, dealt.b == sets.id).select("a", "share", "b", "shingles"))
    n = partitions(pairs.sparkSession)
    ordered = rows.repartition(n, "a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, _U)
        for batch in batches:
            a, b, found = batch.column(0).to_numpy(), batch.column(2), []
            member, (data, at) = b.is_valid().to_numpy(zero_copy_only=False), text.buffers(batch.column(3))
            for i in range(batch.num_rows):
                own = np.frombuffer(data[at[i] : at[i + 1]].tobytes(), _U)
                if not member[i]:
                    hub = own
                elif _linked(hub, own, how.percent):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[found]), b.take(pa.array(found, pa.int64()))], ["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint")


def _forest(rows: list[tuple], same: bool, how: MinHash) -> list[tuple[int, int]]:
    """Links that join different components of one tile: rows (side, id, component, packed, shingles)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    side = np.array([r[0] for r in rows])
    packed = np.frombuffer(b"".join(r[3] for r in rows), _U).reshape(len(rows), -1)
    size = np.array([len(r[4]) for r in rows])
    label = np.array([r[2] for r in rows])
    low, out = _U(sum(1 << i for i in range(0, 64, how.bits))), []
    for i in range(len(rows)):
        others = np.arange(i + 1, len(rows)) if same else np.flatnonzero(side != side[i]) if side[i] == 0 else np.zeros(0, int)
        others = others[label[others] != label[i]]
        others = others[100 * np.minimum(size[others], size[i]) >= how.percent * np.maximum(size[others], size[i])]
        if not len(others):
            continue
        x = packed[others] ^ packed[i]
        y = x.copy()
        for k in range(1, how.bits):
            y |= x >> _U(k)
        likely = how.estimate(how.minima - np.bitwise_count(y & low).sum(axis=1, dtype=np.int64))
        order = np.argsort(-likely, kind="stable")
        for j in others[order[likely[order] >= how.least]]:
            if root(label[i]) != root(label[j]) and _linked(rows[i][4], rows[j][4], how.percent):
                parent[root(label[i])] = root(label[j])
                out.append((rows[i][1], rows[j][1]))
    return out


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, component) of the rows (key, id) whose keys have nodes of different components under ``links``."""
    so_far = components(links)
    labelled = save(rows.join(so_far, rows.id == so_far.node, "left").select("key", "id", F.coalesce("component", "id").alias("component")), "labelled")
    return save(labelled.join(_apart(labelled, "key"), "key", "left_semi"), "split")


def _apart(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").drop("low", "high")


def _next_hubs(split: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, component, hub, hub_component): under each key the node with the most links so far, the smallest of equals, is its hub. A text that
    the others are copies of has links with the hubs of all its keys, so that it is found even if the others aren't alike."""
    degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    known = split.join(degrees, "id", "left").withColumn("place", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("id")).alias("low"), "component"))
    hubs = known.groupBy("key").agg(F.max("place").alias("place"))
    return split.join(hubs, "key").select("key", "id", "component", (-F.col("place.low")).alias("hub"), F.col("place.component").alias("hub_component")).filter("id != hub")


def _open(split: DataFrame) -> DataFrame:
    """(key, id, component): the nodes in ``split`` with two such keys, as a node that shares two keys with one of another component has,
    under all of them."""
    every = split.groupBy("id", "component").agg(F.collect_set("key").alias("keys")).filter(F.size("keys") > 1)
    return every.select(F.explode("keys").alias("key"), "id", "component")


def _rest(members: DataFrame, sets: DataFrame, how: MinHash) -> DataFrame:
    """Links between components inside keys. members: (key, id, component, n, packed); sets: (id, shingles)."""
    blocks = members.groupBy("key").agg(F.ceil(F.sum("n") / how.tile).cast("int").alias("blocks"))
    block = members.join(blocks, "key").join(sets, "id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    tiles = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "component", "packed", "shingles"
    )
    n = partitions(members.sparkSession)
    ordered = tiles.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, found = None, [], []
        for batch in batches:
            cols = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            data, at = text.buffers(cols["shingles"])
            heads = list(zip(*(cols[c].to_pylist() for c in ("key", "i", "j", "side", "id", "component", "packed")), strict=True))
            for k, (c, i, j, side, node, component, packed) in enumerate(heads):
                if (c, i, j) != tile:
                    found += _forest(rows, tile[1] == tile[2], how) if tile else []
                    tile, rows = (c, i, j), []
                rows.append((side, node, component, np.array(packed, np.int64).tobytes(), np.frombuffer(data[at[k] : at[k + 1]].tobytes(), _U)))
        found += _forest(rows, tile[1] == tile[2], how) if tile else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: MinHash = MinHash()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links reach; kept tells the rows where it is the row's own. Null and empty texts,
    and texts of white space only, have n_shingles 0 and are linked with nothing. Rows that repeat a doc_id are one node and
    keep their rows. A null doc_id is linked with nothing: its component_id is null and kept is true. Other columns of ``docs``
    are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = save(signatures(texts, how), "signatures")
    full = signed.filter("n > 0 and id is not null")
    found = save(full.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("rep")), "classes")
    # a node is a class of equal sets, not an id: one id may stand on several texts; numbers follow the classes' smallest ids
    classes = save(found.orderBy("rep", "set_a", "set_b", "n").withColumn("class", F.monotonically_increasing_id()), "numbered")
    of = full.join(classes, ["set_a", "set_b", "n"])
    same = save(of.filter("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b")), "same")
    nodes = of.filter("id = rep").drop("id").withColumnRenamed("class", "id")

    placed = nodes.select("id", F.explode("keys").alias("key"))
    hubs = placed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last").drop("last")
    buckets = save(placed.join(hubs, "key").filter("id != hub"), "buckets")

    ids = buckets.select(F.explode(F.array("id", "hub")).alias("id")).distinct()
    about = save(nodes.join(ids, "id", "left_semi").select("id", "rep", "n", "set_a", "packed").dropDuplicates(["id"]), "about")  # rows may repeat
    side = {s: about.select(F.col("id").alias(s), F.col("n").alias(f"{s}_n"), F.col("packed").alias(f"{s}_packed")) for s in "ab"}
    reps = about.select(F.col("rep").alias("id")).hint("merge")
    texts_of = shingle_sets(texts.join(reps, "id", "left_semi"), how.words).withColumnRenamed("id", "rep")
    sets = save(texts_of.join(about.select("id", "rep", "set_a"), ["rep", "set_a"]).select("id", "shingles").dropDuplicates(["id"]), "sets")

    def stars(met: DataFrame) -> DataFrame:
        pairs = met.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct().join(side["b"], "b").join(side["a"], "a")
        return save(_confirmed(save(pairs.filter(_plausible(how)).select("a", "b"), "pairs"), sets, how), "stars")

    first = stars(buckets)
    again = save(_next_hubs(_labelled(buckets.select("key", "id"), first), first), "next-hubs")
    links = first.union(stars(again.filter("component != hub_component")))
    members = save(_open(_labelled(again.select("key", "id"), links)).join(about.select("id", "n", "packed"), "id"), "members")
    links = links.union(save(_rest(members, sets, how), "links"))

    rep = {s: classes.select(F.col("class").alias(s), F.col("rep").alias(f"{s}_rep")) for s in "ab"}
    between = links.join(rep["a"], "a").join(rep["b"], "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    named = components(same.union(between))
    out = signed.join(named, signed.id == named.node, "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
