"""Word n-gram language model by deleted interpolation, fitted and applied in exchanges of packed counts.

Tasks count the n-grams of their texts, cut the sorted hashes into ranges (shards) and send each shard one row with its delta-coded
hashes and counts; shards add them up. To score, texts are dealt to blocks; a block asks every shard about the n-grams it holds, each
once, and gets their counts back in the order asked, so no row travels for a single n-gram and no table has to fit in one place.

P_0 = 1 / (V + 1); P_m(w | h) = l P(w | last m - 1 words of h) + (1 - l) P_(m-1)(w | h), with maximum-likelihood P and a weight l for
each order and each frequency bucket of the context. The weights are learned by expectation-maximisation on a held-out part of the
training texts, each of whose tokens is predicted from counts that its own document is deleted from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm import text
from weir.llm.scratch import partitions, save

_U = np.uint64
#: Bits of an n-gram's hash (tokens, whose counts are exact by contract, have all 64); text bytes of a block and of a shard; tokens counted at once; context buckets (powers of 2).
BITS, BLOCK, SHARD, COUNTED, BUCKETS = 48, 1 << 23, 1 << 24, 1 << 21, 16
_START, _END = (text.mix(np.array([k], _U))[0] for k in (0xB05, 0xE05))


@dataclass(frozen=True)
class Model:
    """counts: (order, shard, grams, counts) rows of training n-grams. tokens, distinct: N and V. weights[m][b]: of order m + 1."""

    counts: DataFrame
    shards: int
    tokens: int
    distinct: int
    documents: int
    weights: np.ndarray

    @property
    def order(self) -> int:
        return len(self.weights)


def _packed(x: np.ndarray) -> bytes:
    """Unsigned integers, byte by byte of equal rank, compressed."""
    x = x.astype("<u4" if x.max(initial=0) < 1 << 32 else "<u8")
    return bytes([x.itemsize]) + zstandard.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(blob[0], -1).T).view(f"<u{blob[0]}").reshape(-1).astype(_U)


def _coded(sorted_: np.ndarray) -> bytes:
    return _packed(np.diff(sorted_, prepend=_U(0)))


def _decoded(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob), dtype=_U)


def _bits(order: int) -> int:
    return 64 if order == 1 else BITS


def _cuts(grams: np.ndarray, order: int, shards: int) -> np.ndarray:
    """Where each shard's range of sorted hashes begins (one more entry at the end). shards is a power of 2."""
    inner = np.arange(1, shards, dtype=_U) * _U((1 << _bits(order)) // max(shards, 2))
    return np.concatenate([[0], np.searchsorted(grams, inner), [len(grams)]])


def _grams(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams of orders 1 to ``order`` that end at each token, and each text's first token (one more at the end).

    Tokens are the lower-cased words of a text, then one end; n-grams reach over its start.
    """
    words, first = text.word_hashes(data, bounds)
    starts = first + np.arange(len(first))
    tokens = np.full(int(starts[-1]), _END, _U)
    place = np.ones(len(tokens), bool)
    place[starts[1:] - 1] = False
    tokens[place] = words
    out, at = [tokens], np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))
    with np.errstate(over="ignore"):
        for m in range(2, order + 1):
            back = np.roll(tokens, m - 1)
            back[at < m - 1] = _START
            out.append(text.mix(out[-1] * _U(0x9FB21C651E98DF25) + back + _U(m)))
    return [x >> _U(64 - _bits(m + 1)) for m, x in enumerate(out)], starts


def _counted(docs: DataFrame, order: int, shards: int) -> DataFrame:
    """(order, shard, grams, counts) of the n-grams of (text): their sums over all texts."""

    def sent(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        rows = []
        for m in range(order):
            grams, counts = np.unique(np.concatenate([p[m] for p in parts]), return_counts=True)
            cut = _cuts(grams, m + 1, shards)
            rows += [(m + 1, s, _coded(grams[i:j]), _packed(counts[i:j].astype(_U))) for s, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["order", "shard", "grams", "counts"])

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            data, bounds = text.column(batch, "text")
            for lo, hi in text.slices(bounds, text.CHUNK):
                grams, _ = _grams(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], order)
                parts.append(grams)
                held += len(grams[0])
                if held >= COUNTED:
                    yield sent(parts)
                    parts, held = [], 0
        if parts:
            yield sent(parts)

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grams = np.concatenate([_decoded(x.as_py()) for x in table.column("grams")])
        counts = np.concatenate([_unpacked(x.as_py()) for x in table.column("counts")])
        by = np.argsort(grams, kind="stable")
        grams, counts = grams[by], counts[by]
        head = np.flatnonzero(np.diff(grams, prepend=grams[0] ^ _U(1)) != 0)
        counts = np.add.reduceat(counts, head)
        return pa.table({"order": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "grams": [_coded(grams[head])], "counts": [_packed(counts)], "n": [len(head)], "total": [int(counts.sum())]})

    rows = docs.select("text").mapInArrow(count, "order int, shard int, grams binary, counts binary")
    dealt = rows.repartition(partitions(docs.sparkSession), "order", "shard")
    return dealt.groupBy("order", "shard").applyInArrow(add, "order int, shard int, grams binary, counts binary, n bigint, total bigint")


def _answered(dealt: DataFrame, counts: DataFrame, order: int, shards: int) -> DataFrame:
    """(block, answers): for each block of (block, id, text) the counts of its distinct n-grams, in their order, by order and shard."""
    n = partitions(dealt.sparkSession)

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        data, bounds = text.column(table.combine_chunks().to_batches()[0], "text")
        grams, _ = _grams(data, bounds, order)
        rows = []
        for m in range(order):
            own = np.unique(grams[m])
            cut = _cuts(own, m + 1, shards)
            rows += [(m + 1, s, key[0].as_py(), _coded(own[i:j])) for s, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["order", "shard", "block", "asked"])

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table, known: pa.Table) -> pa.Table:
        grams = _decoded(known.column("grams")[0].as_py()) if known.num_rows else np.zeros(0, _U)
        counts = np.append(_unpacked(known.column("counts")[0].as_py()) if known.num_rows else np.zeros(0, _U), _U(0))
        out = []
        for x in asked.column("asked"):
            own = _decoded(x.as_py())
            at = np.searchsorted(grams, own)
            out.append(_packed(np.where(np.append(grams, _U(0))[at] == own, counts[at], _U(0))))
        return pa.table({"block": asked.column("block"), "order": asked.column("order"), "shard": asked.column("shard"), "held": pa.array(out, pa.binary())})

    asked = dealt.groupBy("block").applyInArrow(ask, "order int, shard int, block int, asked binary").repartition(n, "order", "shard")
    known = counts.select("order", "shard", "grams", "counts").repartition(n, "order", "shard")
    return asked.groupBy("order", "shard").cogroup(known.groupBy("order", "shard")).applyInArrow(answer, "block int, order int, shard int, held binary")


def _dealt(docs: DataFrame) -> DataFrame:
    """(block, id, text), in blocks of about ``BLOCK`` bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("id", "text"), F.lit(-(-size // BLOCK) or 1)).cast("int")
    return docs.select(block.alias("block"), "id", "text").repartition(partitions(docs.sparkSession), "block")


def _told(table: pa.Table, answers: pa.Table, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """A block's n-grams, their counts, and each text's first token."""
    data, bounds = text.column(table.combine_chunks().to_batches()[0], "text")
    grams, starts = _grams(data, bounds, order)
    held = sorted(zip(answers.column("order").to_pylist(), answers.column("shard").to_pylist(), answers.column("held").to_pylist(), strict=True))
    counts = []
    for m in range(order):
        own = np.concatenate([_unpacked(x[2]) for x in held if x[0] == m + 1])
        counts.append(own[np.unique(grams[m], return_inverse=True)[1]].astype(float))
    return grams, counts, starts


def _likelihoods(counts: list[np.ndarray], starts: np.ndarray, tokens, documents: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """P(w | h) of each order, 0 where the context is unknown, and the bucket of each order's context."""
    shares, buckets = [counts[0] / np.maximum(tokens, 1)], [np.zeros(len(counts[0]), np.int64)]
    for m in range(1, len(counts)):
        context = np.roll(counts[m - 1], 1)
        context[starts[:-1]] = documents
        shares.append(np.minimum(counts[m] / np.maximum(context, 1), 1))
        buckets.append(np.minimum(np.log2(np.maximum(context, 0.5)).astype(np.int64) + 1, BUCKETS - 1) * (context > 0))
    return shares, buckets


#: Likelihoods are rounded to this part of a bit while the weights are learned, not when texts are scored.
_STEPS = 4


def _held_out(dealt: DataFrame, counts: DataFrame, order: int, shards: int, tokens: int, documents: int) -> DataFrame:
    """How many tokens have each combination of context buckets and rounded log2 likelihoods (b1, q1, b2, q2, ..., n)."""

    def tally(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        names = [f"{c}{m + 1}" for m in range(order) for c in "bq"]
        if not table.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in [*names, "n"]})
        grams, counts, starts = _told(table, answers, order)
        size = np.diff(starts)
        doc = np.repeat(np.arange(len(size)), size)
        left = []
        for g, c in zip(grams, counts, strict=True):
            with np.errstate(over="ignore"):
                _, which, many = np.unique(text.mix(g) + text.mix(doc.astype(_U)), return_inverse=True, return_counts=True)
            left.append(np.maximum(c - many[which], 0))
        shares, buckets = _likelihoods(left, starts, tokens - size[doc], documents - 1)
        rounded = [np.where(p > 0, np.round(_STEPS * np.log2(np.maximum(p, 1e-300))), 1).astype(np.int64) for p in shares]
        cells, many = np.unique(np.stack([x for b, q in zip(buckets, rounded, strict=True) for x in (b, q)]), axis=1, return_counts=True)
        return pa.table({**{n: pa.array(c) for n, c in zip(names, cells, strict=True)}, "n": pa.array(many)})

    answers = _answered(dealt, counts, order, shards).repartition(partitions(dealt.sparkSession), "block")
    names = [f"{c}{m + 1}" for m in range(order) for c in "bq"]
    cells = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tally, ", ".join(f"{n} bigint" for n in [*names, "n"]))
    return cells.groupBy(*names).agg(F.sum("n").alias("n"))


def _weights(cells: np.ndarray, order: int, distinct: int, rounds: int = 60) -> np.ndarray:
    """Weights by expectation-maximisation over rows b1, q1, ..., n; a bucket that no held-out token has gets 0.5 (bucket 0: 0)."""
    weights = np.full((order, BUCKETS), 0.5)
    if not len(cells):
        weights[1:, 0] = 0
        return weights
    buckets, rounded, n = cells[:, 0:-1:2], cells[:, 1:-1:2], cells[:, -1].astype(float)
    shares = np.where(rounded > 0, 0, 2.0 ** (np.minimum(rounded, 0) / _STEPS))
    for _ in range(rounds):
        below, seen = np.full(len(cells), 1 / (distinct + 1)), []
        for m in range(order):
            mine = weights[m, buckets[:, m]]
            seen.append((mine * shares[:, m], (1 - mine) * below))
            below = seen[-1][0] + seen[-1][1]
        reached = n.copy()  # the expected number of tokens drawn from this order or a lower one
        for m in range(order - 1, -1, -1):
            share = seen[m][0] / np.maximum(seen[m][0] + seen[m][1], 1e-300)
            here = np.bincount(buckets[:, m], reached * share, BUCKETS)
            every = np.bincount(buckets[:, m], reached, BUCKETS)
            weights[m] = np.where(every > 0, np.clip(here / np.maximum(every, 1e-300), 1e-6, 1 - 1e-6), weights[m])
            reached = reached * (1 - share)
    weights[1:, 0] = 0
    return weights


def fit(train: DataFrame, held_out: Column, order: int = 2) -> Model:
    """A model of ``train`` (id, text; null texts are empty). ``held_out`` chooses the rows that the weights are learned on, with
    their own documents' counts deleted. All rows count; without held-out rows the weights are 0.5."""
    train = train.select("id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("chosen"))
    size, documents = train.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = 1 << max(0, ((size or 0) // SHARD).bit_length())
    counts = save(_counted(train, order, shards), "ngrams")
    about = counts.filter("order = 1").agg(F.sum("total"), F.sum("n")).first()
    tokens, distinct = int(about[0] or 0), int(about[1] or 0)
    # for order m at most (BUCKETS * _STEPS * log2(tokens)) ** m rows, of which few occur: 2 ** 17 or so for order 2, whatever the corpus
    cells = _held_out(_dealt(train.filter("chosen").select("id", "text")), counts, order, shards, tokens, documents).collect()
    return Model(counts, shards, tokens, distinct, documents, _weights(np.array([list(r) for r in cells], np.int64).reshape(-1, 2 * order + 1), order, distinct))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (id, text): log10 probabilities of the text.

    A null or empty text is its end alone. An empty training set makes every token unknown. Repeated rows and null ids are rows of
    their own.
    """
    order, n, v, documents, weights = model.order, model.tokens, model.distinct, model.documents, model.weights

    def apply(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        _, counts, starts = _told(table, answers, order)
        shares, buckets = _likelihoods(counts, starts, n, documents)
        p = np.full(len(counts[0]), 1 / (v + 1))
        for m in range(order):
            mine = weights[m, buckets[m]]
            p = mine * shares[m] + (1 - mine) * p
        add = lambda x: np.add.reduceat(x, starts[:-1])
        return pa.table({"id": table.column("id"), "n_tokens": np.diff(starts), "n_known": add((counts[0] > 0).astype(np.int64)), "train_tokens": np.full(len(starts) - 1, n), "base_score": add(np.log10((counts[0] + 1) / (n + v + 1))), "score": add(np.log10(p))})

    dealt = _dealt(docs.select(F.col("id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text")))
    answers = _answered(dealt, model.counts, order, model.shards).repartition(partitions(docs.sparkSession), "block")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply, "id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
