"""Text quality by a factorisation machine over hashed words, structure statistics and the text's length.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i) ** 2 - sum_i v_if ** 2 x_i ** 2)): every pair of features interacts
through its factors' product, at a cost linear in the number of features. The machine is fitted on the driver from a sample of
labelled rows of bounded size; every row is scored where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm import lines, text

#: Hashed words; after them come the statistics.
BUCKETS = 4096
#: Byte classes whose shares are statistics: fixed sets of ASCII characters; the rest of a text are bytes over 127.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "break": b"\n",
    "stop": b".!?",
    "comma": b",;:",
    "quote": b"'\"`",
    "bracket": b"()[]{}<>",
    "symbol": b"#$%&*+/=@\\^_|~-",
    "control": bytes([*range(9), *range(14, 32), 127]),
}
STATISTICS = [*CLASSES, "wide", "length", "words", "word length", "long words", "distinct", "top word", "lines", "line length", "repeated lines", "words a stop"]


@dataclass(frozen=True)
class Machine:
    """w0, w and v of the formula, and the means and scales that statistics are brought to."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, owner: np.ndarray, index: np.ndarray, value: np.ndarray, statistics: np.ndarray) -> np.ndarray:
        """Of texts with hashed words (owner, index, value) and a row of statistics each."""
        n, x = len(statistics), _standard(statistics, self.mean, self.scale)
        total = self.bias + np.bincount(owner, self.linear[index] * value, n) + x @ self.linear[BUCKETS:]
        square = value * value
        for f in range(self.factors.shape[1]):
            v, own = self.factors[index, f], self.factors[BUCKETS:, f]
            total += 0.5 * ((np.bincount(owner, v * value, n) + x @ own) ** 2 - np.bincount(owner, v * v * square, n) - (x * x) @ (own * own))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _standard(statistics: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Statistics in standard deviations, at most 4, of about the weight that all hashed words have together."""
    return np.clip((statistics - mean) / scale, -4, 4) / np.sqrt(len(STATISTICS))


def _share(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, index and value of the hashed words of a run of texts (square roots of their shares), and the statistics."""
    n, size = len(bounds) - 1, np.maximum(np.diff(bounds), 1)
    found = list(text.words(data, bounds))
    starts, ends, hashes = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.uint64)))
    first = np.searchsorted(starts, bounds)
    words, of = np.diff(first), np.repeat(np.arange(n), np.diff(first))
    some = np.maximum(words, 1)
    cells, counts = np.unique(of * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    owner, index = cells // BUCKETS, cells % BUCKETS
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, counts)
    table = {c: np.isin(np.arange(256), list(chars)) for c, chars in CLASSES.items()}
    out = {c: _share(table[c][data], bounds) for c in CLASSES}
    points = _share((data & 0xC0) != 0x80, bounds)
    at = lines._first_lines(data, bounds)
    _, _, keys, solid = lines._keys(data, bounds, 1)
    many = np.diff(at)
    whole = np.unique(np.stack([np.repeat(np.arange(n), many)[solid], keys[solid].view(np.int64)]), axis=1) if solid.any() else np.zeros((2, 0), np.int64)
    filled = np.bincount(np.repeat(np.arange(n), many)[solid], minlength=n)
    columns = [
        *(x / size for x in out.values()),
        _share(data > 127, bounds) / size,
        np.log1p(points),
        np.log1p(words),
        _share_of(ends - starts, of, n) / some,
        _share_of(ends - starts > 14, of, n) / some,
        np.bincount(owner, minlength=n) / some,
        top / some,
        np.log1p(many),
        np.log1p(size / many),
        1 - np.bincount(whole[0], minlength=n) / np.maximum(filled, 1),
        words / (1 + out["stop"]) / (1 + words),
    ]
    return owner, index, np.sqrt(counts / words[owner]), np.stack(columns, axis=1)


def _share_of(x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, x, n)


def fit(index: list[np.ndarray], value: list[np.ndarray], statistics: np.ndarray, label: np.ndarray, factors: int = 8, steps: int = 750, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Machine:
    """Logistic loss by Adam on small batches, at least ``steps`` of them; an empty sample gives a machine that scores everything 0.5."""
    rng, width = np.random.default_rng(seed), BUCKETS + len(STATISTICS)
    mean, scale = (statistics.mean(0), statistics.std(0) + 1e-6) if len(label) else (np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    x = np.zeros((len(label), width), np.float32)
    for i, (k, v) in enumerate(zip(index, value, strict=True)):
        x[i, k] = v
    x[:, BUCKETS:] = _standard(statistics, mean, scale) if len(label) else 0
    share = np.clip(label.mean(), 0.01, 0.99) if len(label) else 0.5
    held = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(width, np.float32), rng.normal(0, 0.05, (width, factors)).astype(np.float32)]
    first, second, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    while step < steps and len(label):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            own = x[order[at : at + batch]]
            bias, w, v = held
            inner = own @ v
            square = own * own
            z = bias[0] + own @ w + 0.5 * (inner**2 - square @ (v * v)).sum(1)
            slope = (1 / (1 + np.exp(-z)) - label[order[at : at + batch]]).astype(np.float32) / len(own)
            grads = [np.array([slope.sum()], np.float32), own.T @ slope + decay * w, own.T @ (slope[:, None] * inner) - (square.T @ slope)[:, None] * v + decay * v]
            step += 1
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                held[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(held[0][0]), held[1].astype(float), held[2].astype(float), mean, scale)


def fold(id_: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo n; null for null."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(n))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8000) -> Machine:
    """Fit on the ``sample`` labelled rows that come first by a hash of their id. Rows without a label, id or text take no part."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(drawn), "id").select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text.column(batch, "text")
            for lo, hi in text.slices(bounds, text.CHUNK):
                owner, index, value, statistics = features(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                at = np.searchsorted(owner, np.arange(hi - lo + 1))
                packed = [[index[at[i] : at[i + 1]].astype(np.int16).tobytes(), value[at[i] : at[i + 1]].astype(np.float32).tobytes(), statistics[i].tobytes()] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(lo, hi - lo) for k in (0, 1)] + [pa.array([p[k] for p in packed], pa.binary()) for k in range(3)], ["id", "label", "index", "value", "statistics"])

    found = sorted(rows.mapInArrow(run, "id bigint, label int, index binary, value binary, statistics binary").collect(), key=lambda r: (r["id"], r["statistics"]))[:sample]
    return fit(
        [np.frombuffer(r["index"], np.int16) for r in found],
        [np.frombuffer(r["value"], np.float32) for r in found],
        np.array([np.frombuffer(r["statistics"]) for r in found]).reshape(-1, len(STATISTICS)),
        np.array([r["label"] for r in found], np.float32),
    )


def score(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: 0 to 1, higher where label 1 is likelier. Null texts score as empty ones. A column of that name
    is replaced; ids and all other columns are carried, never read."""
    kept = [c for c in docs.columns if c != score_col]
    held = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text.column(batch, "text")
            out = [held.value.scores(*features(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])) for lo, hi in text.slices(bounds, text.CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*out, np.zeros(0)]))], ["row", "score"])

    done = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return done.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("score").alias(score_col))
