from __future__ import annotations

import random

import pytest

#: Nulls, empty and white texts, ties, repeated rows, a long text, and texts that differ by a little.
WORDS = [f"w{i}" for i in range(400)]


def corpus() -> list[tuple]:
    rnd = random.Random(11)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    base, passage, long = say(60), say(70), say(30_000)
    texts = [base, base, base.upper() + " more", base + " " + say(3), say(40) + "\n" + passage, passage + "\n" + say(40), "", None, " \t\n", "one two", "one two", "One  Two three", long, long + " end", "A line that returns\nx\nA line that returns \nb", "  a LINE that returns\ny", "é ü 漢字 🙂 " * 30, "é ü 漢字 🙂 " * 29 + "z", "<|endoftext|> it's", say(300)]
    texts += [" ".join(base.split()[:k] + [say(1)] + base.split()[k + 1 :]) for k in (5, 20, 58)]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "k", 7, "u") for i, t in rows], "doc_id bigint, text string, key string, start int, u string").repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, and repeated rows."""
    return spark.createDataFrame([(None, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (2, None), (None, None)], "doc_id bigint, text string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
