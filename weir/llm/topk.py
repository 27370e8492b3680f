"""Exact top-k inner products over impact-ordered indexes, score at a time.

Vectors are dealt to groups and queries to chunks; a task holds the indexes of one group and scores one chunk against them. An index
holds a block's components as postings (dimension, vectors, values) in segments of equal quantised impact: the rank of a component's
size among all of the block, in ``LEVELS`` steps. Queries take the segments by descending impact and keep for every vector the sum so
far. What is still to come of a vector is bounded by the norm of its components left and by the largest components left in each
dimension. A query stops as soon as these bounds prove that few vectors of the block can be among its k best, and those are scored
anew on their whole components. The k-th best score of the blocks before is carried along: it proves more the later the block, and
blocks, which hold a group's vectors by descending norm, are passed over where their largest norm can't reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.scratch import partitions

#: Quantised impacts, queries scored together, and possible members, as a share of a block, at which scoring anew begins.
LEVELS, QUERIES, FEW = 8, 256, 1 / 16
_NONE = -(2**62)


class Index:
    """Posting segments of one block by descending impact; rows must be integers whose inner products stay under 2 ** 53."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        size = np.abs(rows)
        #: Segments that a query may take, and segments taken by all queries so far.
        self.taken = 0
        self.norm = float(np.sqrt((rows.astype(float) ** 2).sum(axis=1).max(initial=0)))
        level = np.searchsorted(np.quantile(size, np.arange(1, LEVELS) / LEVELS), size) if rows.size else size
        self.segments = []
        for k in range(LEVELS - 1, -1, -1):
            dimension, row = np.nonzero(((level == k) & (size > 0)).T)
            if not len(row):
                continue
            left = np.where(level < k, size, 0)
            starts = np.flatnonzero(np.diff(dimension, prepend=-1))
            #: dimensions, bounds of each one's postings, vectors, values; norms and largest components left
            self.segments.append((dimension[starts], np.append(starts, len(row)), row, rows[row, dimension].astype(float), np.sqrt((left.astype(float) ** 2).sum(axis=1)), left.max(axis=0, initial=0).astype(float)))

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query its number and the ids and scores of all rows that can be among its k best. ``least``: for each query a score
        that its k-th best is known to reach."""
        q = queries.astype(float)
        norms = np.sqrt((q**2).sum(axis=1))
        active = np.flatnonzero(self.norm * norms * (1 + 1e-9) >= least)
        want, few = min(k + 1, len(self.ids)), max(k + 1, int(len(self.ids) * FEW))  # the query's own row may be one
        sums = np.zeros((len(self.ids), len(active)))
        for n, (dimensions, bounds, row, value, residual, largest) in enumerate(self.segments or [(np.zeros(0, int), np.zeros(1, int), np.zeros(0, int), np.zeros(0), np.zeros(len(self.ids)), np.zeros(self.rows.shape[1]))]):
            if not len(active):
                return
            self.taken += len(active)
            own = q[active]
            for d, i, j in zip(dimensions.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sums[row[i:j]] += np.outer(value[i:j], own[:, d])
            bound = np.minimum(np.outer(residual, norms[active]), np.abs(own) @ largest) * (1 + 1e-9)
            reached = np.maximum(least[active], np.partition(sums - bound, len(self.ids) - want, axis=0)[len(self.ids) - want])
            possible = sums + bound >= reached
            done = (possible.sum(axis=0) <= few) | (n + 1 >= len(self.segments))
            for i in np.flatnonzero(done).tolist():
                at = np.flatnonzero(possible[:, i])
                yield active[i], self.ids[at], self.rows[at] @ queries[active[i]]
            active, sums = active[~done], sums[:, ~done]


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """The k best others by score, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    return order[ids[order] != own][:k]


class Group:
    """The indexes of one group's vectors, in blocks by descending norm."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int):
        order = np.lexsort((ids, -(rows.astype(float) ** 2).sum(axis=1)))
        self.blocks = [Index(ids[order[i : i + block]], rows[order[i : i + block]]) for i in range(0, len(order), block)]

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the ids and scores of its k best others."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
        least = np.full(len(query_ids), _NONE, float)
        for index in self.blocks:
            for i, ids, scores in index.top(query_ids, queries, k, least):
                ids, scores = (np.concatenate(x) for x in zip(found[i], (ids, scores), strict=True))
                best = _best(ids, scores, query_ids[i], k)
                found[i] = ids[best], scores[best]
                if len(best) == k:
                    least[i] = scores[best[-1]]
        return found


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null for a vector that is null or empty or has null or non-finite components."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound & (F.size(vector) > 0), F.transform(wide, lambda x: F.floor(x * scale)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, group: int = 1 << 14, chunk: int = 1 << 13) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of ``vectors`` (id, vector) with the largest inner products with each of
    ``queries`` (id, vector), the row of the query's own id left out, ties to the smaller id; all, if fewer.

    Vectors are arrays of whole numbers; rows with a null id or vector take no part. Only vectors of one length meet, empty ones with
    score 0. Repeated ids are rows of their own. Other columns are ignored. ``block``: vectors of an index; ``group`` and ``chunk``: vectors
    and queries of a task, about, at most. A vector is copied to each chunk, a query to each group.
    """
    spark = vectors.sparkSession
    sound = [df.select(F.col("id").cast("bigint").alias("id"), "vector", F.size("vector").alias("size")).filter("id is not null and vector is not null") for df in (vectors, queries)]
    groups, asking, n = max(1, -(-sound[0].count() // group)), sound[1].count(), partitions(spark)
    chunks = max(1, -(-asking // min(chunk, max(QUERIES, asking * groups // n))))
    deal = lambda df, own, parts, other, copies, asks: df.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other), "size", F.lit(asks).alias("asks"), "id", "vector")
    rows, asked = deal(sound[0], "group", groups, "chunk", chunks, 0), deal(sound[1], "chunk", chunks, "group", groups, 1)
    dealt = rows.unionByName(asked).repartition(max(groups * chunks, n), "group", "chunk", "size").sortWithinPartitions("group", "chunk", "size", "asks").select("group", "chunk", "size", "asks", "id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, index = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            ids, flat = batch.column(4).to_numpy(), batch.column(5).flatten().to_numpy()
            begin = np.concatenate([[0], np.cumsum(keys[:, 2])])
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(ids)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                *cell, asks = keys[i].tolist()
                held = flat[begin[i] : begin[j]].reshape(j - i, cell[2])
                if cell != here:
                    here, parts, index = cell, [], None
                if not asks:
                    parts.append((ids[i:j], held))
                    continue
                if not parts and index is None:
                    continue  # no vectors of this length in the group
                if index is None:
                    index, parts = Group(*(np.concatenate(x) for x in zip(*parts, strict=True)), block), []
                for at in range(i, j, QUERIES):
                    own = ids[at : min(at + QUERIES, j)]
                    best = index.best(own, held[at - i : at - i + len(own)], k)
                    columns = [np.repeat(own, [len(x) for x, _ in best]), *(np.concatenate(x) for x in zip(*best, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
