"""What must hold for whole texts, repeated ids, and every level, block and share of the operators: their sizes are set small."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tests.llm.test_dedup import brute_repeats, shingles
from weir.llm import lines, lm, minhash, pieces, topk
from weir.llm.minhash import MinHash, near_duplicates
from weir.llm.packing import pack
from weir.llm.repeats import Sizes, drop_repeats


def test_near_duplicates_of_an_id_with_two_texts(spark):
    """Both texts of id 1 have a near copy: one node for the id, all links found, whichever text comes first."""
    from weir.llm.minhash import near_duplicates

    say = lambda c: " ".join(f"{c}{i}" for i in range(80))
    rows = [(1, say("a")), (1, say("b")), (2, say("a") + " x"), (3, say("b") + " y"), (4, say("c"))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_viterbi_against_a_plain_dynamic_programme():
    """Whole texts: the best sum of scores over all segmentations."""
    from pathlib import Path

    import public_tokenizers
    import pytest
    from sentencepiece import SentencePieceProcessor

    from weir.llm.pieces import Pieces, viterbi

    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    pieces, read = Pieces(model), SentencePieceProcessor(model_proto=model)
    own = {read.id_to_piece(int(i)): float(s) for i, s in zip(pieces.ids, pieces.scores, strict=True)}
    for said in ("one two three, and a line that returns", "naïve é ü 漢字 🙂 again and again", "unbelievablyinterconnectedwordswithoutblanks " * 5):
        t = "▁" + said.replace(" ", "▁")
        best = [0.0] + [float("-inf")] * len(t)
        for end in range(1, len(t) + 1):
            for start in range(max(0, end - pieces.longest), end):
                score = own.get(t[start:end], float(pieces.unknown) if end - start == 1 else float("-inf"))
                best[end] = max(best[end], best[start] + score)
        found = viterbi([t], pieces)[0]
        got = sum(float(pieces.scores[i]) if i >= 0 else float(pieces.unknown) for i in found)
        assert got == pytest.approx(best[-1])


def families() -> list[tuple[int, str]]:
    """Chains of near copies, a text with many copies that aren't all alike, and texts with nothing but a header in common."""
    rnd = random.Random(5)
    say = lambda n: " ".join(f"v{rnd.randrange(3000)}" for _ in range(n))
    texts = []

    def changed(words: list[str], n: int) -> list[str]:
        out = list(words)
        for _ in range(n):
            out[rnd.randrange(len(out))] = say(1)
        return out

    for k in range(6):
        words = say(120).split()
        for _ in range(8):
            words = changed(words, 2 + k)
            texts.append(" ".join(words))
    base = say(150).split()
    texts += [" ".join(changed(base, 4)) for _ in range(60)] + [" ".join(base)]
    header = say(40)
    texts += [f"{header} {say(60)}" for _ in range(100)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_in_small_tiles(spark):
    """Small tiles and fans, and keys that texts share by chance."""
    rows = families()
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_duplicates(docs, how=MinHash(bands=200, rows=3, tile=500, fan=3)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


def test_a_common_header_opens_few_nodes(spark, monkeypatch):
    """Texts with a header in common share keys by chance, but seldom two of them, so that few are compared beyond the stars."""
    rnd, opened = random.Random(2), []
    say = lambda n: " ".join(f"v{rnd.randrange(50_000)}" for _ in range(n))
    monkeypatch.setattr(minhash, "_open", lambda split, real=minhash._open: opened.append(out := minhash.save(real(split), "test-open")) or out)
    header = say(40)
    docs = spark.createDataFrame([(i, f"{header} {say(60)}") for i in range(3000)], "doc_id bigint, text string")
    assert near_duplicates(docs).filter("not kept").count() == 0
    pairs = opened[0].groupBy("key").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    assert pairs < 3 * 3000


def test_repeats_in_small_blocks(docs, rows):
    for sizes in (Sizes(block=3000, hot=2, together=500), Sizes(block=1, hot=1, together=1)):
        got = drop_repeats(docs, sizes=sizes).collect()
        assert {r.row.doc_id: (bytes(r.kept), len(r.removed)) for r in got} == brute_repeats(rows)


def test_lines_in_small_shards(docs, monkeypatch):
    whole = {r.row.doc_id: r.text for r in lines.drop_repeated_lines(docs).collect()}
    monkeypatch.setattr(lines, "SHARD", 2)
    monkeypatch.setattr(lines, "PROBES", 1)
    assert {r.row.doc_id: r.text for r in lines.drop_repeated_lines(docs).collect()} == whole


def test_packing_on_several_levels(spark):
    """Many short documents and nodes of few bins: nothing is lost, and hardly more sequences are made than at one node."""
    rnd = random.Random(1)
    docs = spark.createDataFrame([(i, "word " * rnd.randrange(1, 900)) for i in range(400)], "doc_id bigint, text string").repartition(16)
    path = public_tokenizers.path("word_bpe_49k.json")
    counts = []
    for node in (20_000, 20):
        packed = pack(docs, path, node=node).collect()
        bins: dict = {}
        for r in sorted(packed, key=lambda r: r.offset):
            assert bins.setdefault(r.sequence_id, 0) == r.offset
            bins[r.sequence_id] += r.length
        assert max(bins.values()) <= 2048 and len(packed) == 400
        counts.append(len(bins))
    assert counts[0] <= 1.05 * sum(bins.values()) / 2048 and counts[1] <= counts[0] * 1.1


def test_top_k_over_blocks(spark):
    """Several groups, chunks and blocks give the scores of plain multiplication."""
    rnd = np.random.default_rng(4)
    rows = rnd.integers(-90, 90, (700, 12))
    rows[::7] //= 9
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id bigint, vector array<bigint>")
    got = sorted(map(tuple, topk.top_k(table, table.filter("id % 3 = 0"), block=32, group=100, chunk=16).select("query_id", "rank", "vec_id", "score").collect()))
    want, scores = [], rows @ rows.T
    for q in range(0, 700, 3):
        best = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_stops_on_proof():
    """Queries leave segments and whole blocks untouched, and lose nothing by it."""
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(8192, 64))
    rows = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    rows[5000:] //= 4
    group = topk.Group(np.arange(len(rows)), rows, 2048)
    queries = np.arange(0, 5000, 50)
    best = group.best(queries, rows[queries], 5)
    for q, (ids, scores) in zip(queries.tolist(), best, strict=True):
        every = rows @ rows[q]
        assert [(int(i), int(s)) for i, s in zip(ids, scores, strict=True)] == [(i, -s) for s, i in sorted((-int(s), i) for i, s in enumerate(every) if i != q)[:5]]
    taken, most = [b.taken for b in group.blocks], [len(b.segments) * len(queries) for b in group.blocks]
    assert taken[-1] == 0 and all(t < m for t, m in zip(taken, most, strict=True)) and sum(taken) < 0.6 * sum(most)


def test_interpolated_scores_against_plain_python(docs, rows, monkeypatch):
    """Small shards and blocks; the score of each text from dictionaries of counts and the fitted weights."""
    monkeypatch.setattr(lm, "SHARD", 5000)
    monkeypatch.setattr(lm, "BLOCK", 5000)
    table = docs.select(F.col("doc_id").alias("id"), "text", "u")
    for order in (1, 2, 3):
        model = lm.fit(table.filter("id % 2 = 1"), F.col("id") % 5 == 0, order=order)
        assert model.weights.shape == (order, lm.BUCKETS) and ((model.weights >= 0) & (model.weights <= 1)).all()
        lowered = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lowered(t)), "\0end"] for i, t in rows}
        train = [ts for i, ts in tokens.items() if i % 2 == 1]

        def grams(ts, m):
            padded = ["\0start"] * (m - 1) + ts
            return [tuple(padded[k : k + m]) for k in range(len(ts))]

        counts = [Counter(g for ts in train for g in grams(ts, m)) for m in range(1, order + 1)]
        n, v = sum(counts[0].values()), len(counts[0])
        assert (model.tokens, model.distinct) == (n, v)
        for r in lm.score(table, model).collect():
            ts, total = tokens[r.id], 0.0
            own = [grams(ts, m) for m in range(1, order + 1)]
            for k in range(len(ts)):
                p = 1 / (v + 1)
                for m in range(1, order + 1):
                    gram = own[m - 1][k]
                    context = n if m == 1 else len(train) if k == 0 else counts[m - 2][own[m - 2][k - 1]]
                    bucket = 0 if m == 1 or not context else min(int(math.log2(context)) + 1, lm.BUCKETS - 1)
                    weight = model.weights[m - 1, bucket]
                    p = weight * (min(counts[m - 1][gram] / context, 1) if context else 0) + (1 - weight) * p
                total += math.log10(p)
            assert math.isclose(r.score, total, rel_tol=1e-9)


def test_long_words_are_merged_as_short_ones():
    """The heap's merges are those of words of equal length that advance together, and a very long word costs little."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        known = pieces.Pieces(file.read())
    rnd = random.Random(5)
    for alphabet in ("a", "ab", "etaoin", "the▁in", "é漢e"):
        words = ["".join(rnd.choice(alphabet) for _ in range(200)) for _ in range(20)]
        for together, word in zip(pieces.merges(words, known), words, strict=True):
            assert together.tolist() == pieces.merged(word, known).tolist()
    begin = time.perf_counter()
    (found,) = pieces.merges(["a" * 100_000], known)
    assert time.perf_counter() - begin < 20 and len(found) < 50_000
