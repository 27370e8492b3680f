"""Near duplicates, repeated lines and repeated passages against brute force."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import functions as F

from weir.llm.lines import PerfectHash, drop_repeated_lines
from weir.llm.minhash import MinHash, near_duplicates
from weir.llm.repeats import drop_repeats

BLANK = " \t\n\v\f\r"


def lowered(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(t: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(t or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(docs, rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())
    assert sorted(map(tuple, near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())) == want
    assert sum(not w[3] for w in want) >= 5


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_duplicates(odd).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got))) == sorted(map(str, [(None, 3, None, True), (2, 3, 2, True), (2, 3, 2, True), (2, 0, 2, True), (None, 0, None, True)]))
    assert near_duplicates(empty).count() == 0


def test_collision_correction():
    """With b bits kept, unequal minima agree by chance; the estimate takes that off."""
    how = MinHash()
    assert how.estimate(how.minima) == 1
    assert how.estimate(how.least_agreeing) < 0.75


def test_lines(docs, rows):
    keys: dict[str, set] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            keys.setdefault(lowered(line.strip(BLANK)), set()).add(i)
    stays = lambda i, line: len(k := lowered(line.strip(BLANK))) < 10 or len(keys[k]) < 2 or min(keys[k]) == i
    want = {i: "\n".join(x for x in (t or "").split("\n") if stays(i, x)) for i, t in rows}
    got = drop_repeated_lines(docs).collect()
    assert {r.row.doc_id: r.text for r in got} == want
    assert {r.row.doc_id: (r.n_lines, r.n_dropped) for r in got} == {i: ((t or "").count("\n") + 1, sum(not stays(i, x) for x in (t or "").split("\n"))) for i, t in rows}
    assert set(got[0].row.asDict()) == {"doc_id", "key", "start", "u"}


def test_lines_of_odd_rows(odd, empty):
    assert drop_repeated_lines(odd).filter("n_dropped > 0").count() == 0
    assert drop_repeated_lines(odd).count() == 5 and drop_repeated_lines(empty).count() == 0


def test_perfect_hash():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(1, 2**63, 5000).astype(np.uint64))
    assert sorted(PerfectHash.of(keys).index(keys).tolist()) == list(range(len(keys)))


def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            w = b[s : s + n]
            if w in seen:
                gone[s : s + n] = b"\x01" * n
            else:
                seen.add(w)
        out[i] = (bytes(x for x, g in zip(b, gone, strict=True) if not g), len(re.findall(b"\x01+", bytes(gone))))
    return out


def test_repeats(docs, rows):
    want = brute_repeats([(i, t) for i, t in rows])
    got = drop_repeats(docs).collect()
    assert {r.row.doc_id: (bytes(r.kept), len(r.removed)) for r in got} == want
    assert sum(len(x[0]) < len((dict(rows)[i] or "").encode()) for i, x in want.items()) > 5


def test_repeats_within_a_text(spark):
    """Periodic texts overlap themselves; short texts are left alone."""
    rows = [(1, "ab" * 200), (2, "abc" * 100 + "x" * 150), (3, "x" * 99), (4, "x" * 100), (5, "y" * 99 + "z")]
    got = drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.row.doc_id: (bytes(r.kept), len(r.removed)) for r in got} == brute_repeats(rows)


def test_repeats_as_text(spark):
    """A cut inside a character takes what is left of it."""
    rows = [(1, "é" * 49 + "a"), (2, "b" + "é" * 49 + "a" + "é")]
    got = {r.row.doc_id: r.kept for r in drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length=50, as_text=True).collect()}
    assert all(isinstance(x, str) and "�" not in x for x in got.values())
    assert drop_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert drop_repeats(spark.createDataFrame([(None, "q" * 150), (None, "q" * 150), (1, None)], "doc_id bigint, text string")).select(F.sum("n_bytes")).first()[0] == 300
