"""Fingerprints, quality, pieces, packing, search, language model, archives and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weir.llm import lm, quality, queries, warc
from weir.llm.fingerprints import combined, edited, fingerprint, likeness
from weir.llm.packing import pack, sequences
from weir.llm.pieces import encoded
from weir.llm.topk import quantised, top_k

SF = "/root/testdata/sf0.001"


def test_fingerprints(docs, rows):
    texts = [t or "" for _, t in rows]
    got = {r.doc_id: r for r in edited(docs).collect()}
    for k, (i, _) in enumerate(rows):
        t, following = texts[k], texts[(k + 1) % len(texts)]
        n = len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    prints = {i: r.fingerprint for i, r in got.items()}
    assert all((prints[a] == prints[b]) == ((ta or "") == (tb or "")) for a, ta in rows for b, tb in rows)


def test_fingerprints_add_and_take(spark):
    a, b = "first one.\nsecond", "third here\nfourth"
    df = spark.createDataFrame([(a, b, f"{a}\n{b}", f"{b}\n{a}")], "a string, b string, ab string, ba string")
    row = df.select(combined(fingerprint("a"), fingerprint("b")), fingerprint("ab"), fingerprint("ba"), combined(fingerprint("ab"), fingerprint("b"), -1), fingerprint("a"), likeness(fingerprint("ab"), fingerprint("ba"))).first()
    assert row[0] == row[1] == row[2] and row[3] == row[4] and row[5] == 1.0


def _sentences(text: str) -> Counter:
    long = lambda x: re.split(r"\s(?<=\S{7}\s)", x, flags=re.ASCII) if len(x) > 160 else [x]
    return Counter(y.strip(" ") for x in re.split(r"[.!?\n\u0964\u061f\u3002\uff01\uff1f]+", text) for y in long(x) if y.strip(" "))


def test_likeness_against_true_shares(spark):
    """The estimate from two fingerprints is near the true share of sentences that stand in both texts equally often."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id is not null")
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    got = edited(docs).orderBy("doc_id").select("near_edited", "near_next").collect()
    errors, unrelated = [], []
    for k, t in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        n = len(t) // 4
        for other, estimate in ((t[: len(t) - n] + following[:n], got[k].near_edited), (following, got[k].near_next)):
            a, b = _sentences(t), _sentences(other)
            share = 1.0 if t == other else sum(a[x] == b[x] for x in a | b) / max(1, len(a | b))
            errors.append(abs(share - estimate))
            unrelated += [estimate] if share == 0 and a and b else []
    assert max(errors) < 0.15 and sum(errors) / len(errors) < 0.01
    assert len(unrelated) > 500 and max(unrelated) < 0.01


def test_likeness_without_full_stops(spark):
    """A text of many words without an end of a sentence isn't one piece, whatever its script."""
    rnd = random.Random(3)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 11)))
    for letters in ("abcdefghij", "абвгдежзик"):
        text = " ".join(word(letters) for _ in range(2000))
        other = text[: len(text) * 3 // 4] + " ".join(word(letters) for _ in range(500))
        near = spark.createDataFrame([(text, other)], "a string, b string").select(likeness(fingerprint("a"), fingerprint("b"))).first()[0]
        assert 0.45 < near < 0.75


def test_fingerprints_of_odd_rows(odd, empty):
    assert edited(odd).count() == 5 and edited(empty).count() == 0
    assert edited(odd.limit(1)).count() == 1


def test_quality(spark):
    """Held-out labels are told well; what must not matter doesn't."""
    out = queries.op3_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    held = out.merge(labels, on="doc_id").query("held_out")
    assert ((held.predicted == held.quality).mean()) > 0.8
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    machine = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    again = quality.score(spark.createDataFrame([(9, None), (None, ""), (1, "a b")], "doc_id bigint, text string"), machine).collect()
    assert again[0].score == again[1].score and all(0 <= r.score <= 1 for r in again)
    assert quality.score(docs.filter("false"), quality.learn(docs.filter("false"), spark.read.parquet(f"{SF}/labels.parquet"))).count() == 0


def test_pairs_in_linear_time():
    """The machine's score equals the sum over all pairs of a text's features."""
    import numpy as np

    rnd, k = np.random.default_rng(3), len(quality.STATISTICS)
    size = quality.BUCKETS + k
    machine = quality.Machine(0.1, rnd.normal(size=size), rnd.normal(size=(size, 3)), np.zeros(k), np.ones(k))
    index, value, statistics = np.array([3, 70, 900]), np.array([0.5, 0.7, 0.2]), rnd.normal(size=(1, k))
    x = np.zeros(size)
    x[index], x[quality.BUCKETS :] = value, np.clip(statistics[0], -4, 4) / np.sqrt(k)
    on = np.flatnonzero(x)
    pairs = sum(machine.factors[i] @ machine.factors[j] * x[i] * x[j] for a, i in enumerate(on) for j in on[:a])
    want = 1 / (1 + math.exp(-(machine.bias + machine.linear @ x + pairs)))
    assert math.isclose(machine.scores(np.zeros(3, np.int64), index, value, statistics)[0], want, rel_tol=1e-9)


def test_pieces(docs, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.row.doc_id: r for r in encoded(docs.filter("length(text) < 5000 or text is null"), path, ("viterbi", "bpe")).collect()}
    for i, t in rows:
        if i in got:
            assert list(got[i].bpe) == library.encode(t or "")
            for back in (got[i].bpe_text, got[i].viterbi_text):
                assert (back if isinstance(back, str) else bytes(back).decode()) == (t or "").replace("▁", " ")
    assert encoded(docs.filter("false"), path).count() == 0


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    got = pack(docs, path, with_ids=True).cache()
    pieces = got.collect()
    for r in pieces:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * 2048 and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
    assert Counter(r.doc_id for r in pieces) == {i: -(-len(x) // 2048) for i, x in ids.items()}
    bins: dict = {}
    for r in sorted(pieces, key=lambda r: r.offset):
        assert bins.setdefault(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and len(bins) <= math.ceil(sum(map(len, ids.values())) / 2048) + 1
    assert {r.sequence_id: len(r.ids) // 4 for r in sequences(got).collect()} == bins
    assert pack(docs.filter("false"), path).count() == 0


def test_packing_of_odd_rows(odd):
    assert pack(odd, public_tokenizers.path("word_bpe_49k.json")).count() == 5


def test_top_k(spark):
    rows = [(i, [math.sin(i * j) for j in range(1, 9)]) for i in range(60)] + [(60, None), (61, [None] * 8), (62, [math.nan] * 8), (63, [0.5] * 3), (64, [math.sin(j) for j in range(1, 9)]), (None, [0.1] * 8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("vector"))
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in whole:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = top_k(table, table.filter("id % 10 = 0")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert top_k(table.filter("false"), table.filter("false")).count() == 0


def test_language_model(docs, rows):
    table = docs.select(F.col("doc_id").alias("id"), "text", "u")
    train = F.col("id") % 2 == 1
    model = lm.fit(table.filter(train), F.col("id") % 5 == 0)
    got = {r.id: r for r in lm.score(table, model).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower() if (t or "").isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t)), "\0"] for i, t in rows}
    counts = Counter(x for i, ts in tokens.items() if i % 2 == 1 for x in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ts), sum(counts[x] > 0 for x in ts), n)
        assert math.isclose(got[i].base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts), rel_tol=1e-9)
        assert got[i].score <= 0
    seen = [i for i in tokens if i % 2 == 1 and len(tokens[i]) > 20]
    assert sum(got[i].score for i in seen) > sum(got[i].base_score for i in seen)


def test_language_model_of_odd_rows(odd, empty):
    table = odd.select(F.col("doc_id").alias("id"), "text")
    assert lm.score(table, lm.fit(table, F.lit(False))).count() == 5
    none = empty.select(F.col("doc_id").alias("id"), "text")
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lm.score(table, lm.fit(none, F.lit(False))).collect())


PAGES = [(1, "http://a/1", "x" * 1500), (2, "http://a/2", "x" * 1500), (3, "http://a/3", "short"), (4, None, "short"), (5, "http://a/5", None), (6, "http://a/6", "é🙂\r\n" * 9000), (None, "http://a/7", "y" * 1200), (8, "http://a/8", "0\r\n\r\n"), (8, "http://a/8", "0\r\n\r\n")]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    got = sorted(map(str, (tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())))
    say = lambda i, h, kind="response", to=None: str((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), kind, to))
    assert got == sorted([say(1, "x" * 1500, "revisit", 2)] + [say(i, h) for i, _, h in PAGES[1:]])
    assert warc.round_trip(pages.filter("false")).count() == 0


def test_broken_archives(spark, tmp_path):
    """A missing segment, a wrong total, a wrong digest and a short chunk are told."""
    import gzip

    path = str(tmp_path / "whole")
    warc.write(spark.createDataFrame([(1, "http://a", "z" * 60_000)], "page_id bigint, url string, html string").coalesce(1), path)
    payload = warc.read(spark, path, payloads=True).first().payload
    assert (payload if isinstance(payload, str) else bytes(payload).decode()) == "z" * 60_000
    with pytest.raises(ValueError):
        warc.body(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab")
    [file] = (tmp_path / "whole").glob("*.gz")
    records = list(warc.parse(file.read_bytes()))
    assert len(records) > 2

    def archived(name: str, parts) -> str:
        (tmp_path / name).mkdir()
        whole = b"".join(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n" for head, block in parts)
        (tmp_path / name / "a.warc.gz").write_bytes(gzip.compress(whole))
        return str(tmp_path / name)

    assert warc.read(spark, archived("same", records)).count() == 1
    last = records[-1]
    broken = {
        "missing": [records[0], *records[2:]],
        "total": [*records[:-1], (last[0] | {"warc-segment-total-length": "7"}, last[1])],
        "digest": [(records[0][0] | {"warc-payload-digest": "sha1:" + "0" * 40}, records[0][1]), *records[1:]],
    }
    for name, parts in broken.items():
        with pytest.raises(Exception, match="missing or don't have|doesn't have its digest"):
            warc.read(spark, archived(name, parts)).collect()


def test_archive_members(spark, tmp_path):
    """Plain archives, one or several gzip members and any size of parts give the same records; revisits name their response as the
    format has it; cut archives and other bytes are told."""
    import gzip

    path = str(tmp_path / "whole")
    warc.write(spark.createDataFrame(PAGES, "page_id bigint, url string, html string").coalesce(1), path, segment=5000)
    [file] = (tmp_path / "whole").glob("*.gz")
    plain = gzip.decompress(file.read_bytes())
    want, half = list(warc.parse(plain)), len(plain) // 2
    for archive in (plain, gzip.compress(plain), gzip.compress(plain[:half]) + gzip.compress(plain[half:])):
        assert all(list(warc.parse(archive, step)) == want for step in (1, 37, 65_536))
    [revisit] = [head for head, _ in want if head["warc-type"] == "revisit"]
    assert revisit["warc-profile"].endswith("/identical-payload-digest") and revisit["warc-refers-to-target-uri"] == "http://a/2"
    assert list(warc.parse(b"")) == []
    for bad in (file.read_bytes()[:-20], plain[:-3], plain[:9], b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_pipeline(spark):
    """Each stage against what it took in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.save(stage(spark, kept, SF), f"test-{name}")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert out.join(kept, "doc_id", "left_anti").count() == 0 and 0 < out.count() <= kept.count()
        assert out.filter("n_chars <> length(text)").count() == 0 or name in ("quality", "near_duplicates")
        kept = out
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "passages", "packing"]
    empty = docs.filter("false")
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_words_are_made_once_for_all_methods_and_few_substrings_are_looked_up():
    import numpy as np
    import public_tokenizers

    from weir.llm import pieces

    class Asked:
        ids = np.zeros(0, np.int64)

        def of(self, distinct, word):
            self.words = [word(i) for i in range(len(distinct))]
            return np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)

    data, a, b = np.frombuffer(b"some words, some more", np.uint8), Asked(), Asked()
    pieces.encode(data, np.array([0, len(data)]), {"a": a, "b": b})
    assert sorted(a.words) == ["▁more", "▁some", "▁words,"] and all(x is y for x, y in zip(a.words, b.words, strict=True))
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        own = pieces.Pieces(file.read())
    others = np.random.default_rng(1).integers(0, 2**64, (100, 100), np.uint64)
    assert own.probe(own.keys).tolist() == list(range(len(own.keys))) and (own.probe(others) == np.where(np.isin(others, own.keys), 0, -1)).all()
    assert own.some[(others >> np.uint64(44)).astype(np.int64)].mean() < 0.1
