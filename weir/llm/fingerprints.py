"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A paragraph becomes a wide vector, a text's fingerprint is the sum of its paragraphs' vectors modulo powers of two. The sum
doesn't know the paragraphs' order, and paragraphs can be put in or taken out by adding or subtracting their vectors.

A vector has two parts. ``LANES`` lanes of 32 bits come from the paragraph's SHA-512; they carry equality. ``LEVELS`` x ``CELLS``
cells of 16 bits carry likeness: each sentence of the paragraph falls on level l with probability 2 ** -(l + 1) and adds its hash
to one cell there. Two fingerprints' equal and unequal cells, from the first level on that isn't crowded, tell the share of sentences
that both texts have, for short and long texts alike. Only cells that aren't zero are written. Sentences of more than ``LONG``
characters are cut into runs that end on a long word, so that a text without full stops isn't one piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES, LEVELS, CELLS = 16, 12, 256
#: A level on which two fingerprints use more cells than this is too crowded to count on.
CROWDED = 176
#: What ends a sentence, in several scripts; characters of a sentence that isn't cut further; where longer ones are cut.
ENDS, LONG, AFTER = r"[.!?\n\u0964\u061f\u3002\uff01\uff1f]+", 160, r"\s(?<=\S{7}\s)"
#: Documents of one window, about, and windows at most: their bounds are the only rows that reach the driver.
GROUP, GROUPS = 2000, 20_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it, inside functions of array elements too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lanes(paragraphs: Column) -> Column:
    """The sum modulo 2 ** 32 of each lane."""
    lane = lambda h, i: F.conv(F.substring(h, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
    sums = lambda hashes: F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: F.aggregate(hashes, F.lit(0).cast("bigint"), lambda s, h: (s + lane(h, i)) % (1 << 32)))
    return _let(F.transform(paragraphs, lambda p: F.sha2(p.cast("binary"), 512)), sums)


def _sentences(text: Column) -> Column:
    """Hashes of the pieces between ends of sentences, long ones cut after words of seven characters or more, without blanks around
    them and empty ones."""
    runs = F.flatten(F.transform(F.split(text, ENDS), lambda x: F.when(F.length(x) > LONG, F.split(x, AFTER)).otherwise(F.array(x))))
    return F.transform(F.filter(F.transform(runs, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x))


def _cell(h: Column) -> Column:
    """Of a sentence's hash: the number of trailing zeros of its upper half decides the level, its low bits the cell."""
    upper = F.shiftrightunsigned(h, 32)
    zeros = F.bit_count((upper.bitwiseAND(-upper)) - 1)
    return F.least(zeros, F.lit(LEVELS - 1)).cast("bigint") * CELLS + F.pmod(h, F.lit(CELLS))


def _grouped(items: Column, bits: int, body: Callable[[Column], Column]) -> Column:
    """The arrays that ``body`` makes of the items with equal upper bits, one after another."""
    keys = F.array_distinct(F.transform(items, lambda x: F.shiftright(x, bits)))
    return F.flatten(F.transform(keys, lambda k: _let(F.filter(items, lambda x: F.shiftright(x, bits) == k), body)))


def _cells(hashes: Column) -> Column:
    """Sorted cell * 2 ** 16 + (sum modulo 2 ** 16) of the cells that aren't zero. Levels, blocks of 16 cells and cells are told apart
    in turn, so that each scan meets few sentences but its own."""
    own = F.transform(hashes, lambda h: _cell(h) * 65536 + F.shiftrightunsigned(h, 8).bitwiseAND(65535))
    total = lambda items: F.array(F.shiftright(F.get(items, F.lit(0)), 16) * 65536 + F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + x.bitwiseAND(65535)) % 65536)
    sums = _let(own, lambda items: _grouped(items, 24, lambda level: _grouped(level, 20, lambda block: _grouped(block, 16, total))))
    return F.array_sort(F.filter(sums, lambda x: x % 65536 != 0))


def _hex(values: Column, digits: int) -> Column:
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text (null: empty): lanes, a dash, cells, all hexadecimal.

    Paragraphs are the pieces between \\n, the empty ones too, so texts that differ in anything but the order of paragraphs
    differ in lanes; sentences are as ``_sentences`` cuts them.
    """
    text = F.coalesce(text, F.lit(""))
    return F.concat_ws("-", _hex(_lanes(F.split(text, "\n")), 8), _hex(_let(_sentences(text), _cells), 7))


def _cut(digits: Column, size: int) -> Column:
    """The numerals of ``size`` digits that a part of a fingerprint holds."""
    return F.regexp_extract_all(digits, F.lit(f".{{{size}}}"), F.lit(0))


def _part(print_: Column, k: int) -> Column:
    return F.split_part(print_, F.lit("-"), F.lit(k))


def _number(numeral: Column) -> Column:
    return F.conv(numeral, 16, 10).cast("bigint")


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a's paragraphs with b's put in (sign 1) or taken out (sign -1).

    Exact: ``combined(fingerprint(x), fingerprint(y))`` is the fingerprint of x and y with \\n between. Taking out paragraphs that
    aren't in gives no text's fingerprint.
    """
    lanes = F.zip_with(F.transform(_cut(_part(a, 1), 8), _number), F.transform(_cut(_part(b, 1), 8), _number), lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))
    spread = lambda x: F.map_from_entries(F.transform(_cut(_part(x, 2), 7), lambda c: F.struct(F.substring(c, 1, 3).alias("key"), _number(F.substring(c, 4, 4)).alias("value"))))
    both = F.map_zip_with(spread(a), spread(b), lambda _, x, y: F.pmod(F.coalesce(x, F.lit(0)) + sign * F.coalesce(y, F.lit(0)), F.lit(65536)))
    cells = F.array_sort(F.transform(F.filter(F.map_entries(both), lambda e: e["value"] != 0), lambda e: _number(e["key"]) * 65536 + e["value"]))
    return F.concat_ws("-", _hex(lanes, 8), _hex(cells, 7))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints alone: the estimated share, among the different sentences of both texts, of those that stand in
    both equally often; 1 where all lanes are equal, 0 where they differ and neither text has a sentence."""
    cells = F.struct(_cut(_part(a, 2), 7).alias("a"), _cut(_part(b, 2), 7).alias("b"))
    return F.when(_part(a, 1) == _part(b, 1), F.lit(1.0)).otherwise(_let(cells, lambda x: _shared(x["a"], x["b"])))


def _shared(a: Column, b: Column) -> Column:
    """The share of equal sentences from the cells of two fingerprints. A cell is unequal if any differing sentence falls into it,
    and equal if none does but a common one: with u and e of m cells such, -ln(1 - u / m) differing and -ln(1 - e / (m - u)) common
    sentences a cell are the likeliest. Unrelated texts have no equal cells, whatever their length."""
    every = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    level = lambda keys: F.transform(keys, lambda x: F.floor(_number(F.substring(x, 1, 3)) / CELLS))
    per = lambda levels: F.transform(every, lambda i: F.size(F.filter(levels, lambda v: v == i)))
    unequal = F.array_distinct(F.transform(F.concat(F.array_except(a, b), F.array_except(b, a)), lambda x: F.substring(x, 1, 3)))
    counts = F.zip_with(_let(level(unequal), per), _let(level(F.array_intersect(a, b)), per), lambda u, e: F.struct(u.alias("u"), e.alias("e")))
    # the levels from the first uncrowded one on hold the same share of differing and of common sentences
    first = lambda n: F.coalesce(F.array_min(F.filter(every, lambda i: F.get(n, i)["u"] + F.get(n, i)["e"] <= CROWDED)), F.lit(LEVELS - 1))
    fallen = lambda part, whole: -F.ln(1 - F.least(part, whole - 0.5) / whole)
    both = lambda n, f: F.transform(
        F.filter(n, lambda _, i: i >= f), lambda x: F.struct(fallen(x["u"], F.lit(float(CELLS))).alias("differ"), fallen(x["e"], F.greatest(CELLS - x["u"], F.lit(1)).cast("double")).alias("agree"))
    )
    total = lambda rows: F.aggregate(rows, F.struct(F.lit(0.0).alias("differ"), F.lit(0.0).alias("agree")), lambda s, x: F.struct((s["differ"] + x["differ"]).alias("differ"), (s["agree"] + x["agree"]).alias("agree")))
    return _let(_let(counts, lambda n: _let(first(n), lambda f: total(both(n, f)))), lambda t: F.when(t["differ"] + t["agree"] > 0, t["agree"] / (t["differ"] + t["agree"])).otherwise(F.lit(0.0)))


def with_next(docs: DataFrame, id_col: str, carried: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``docs`` with next_<c> of each carried column: the value in the row with the next larger id; after the last, the first.
    ``derive`` adds columns before they are carried.

    The ids are cut into ranges of about ``GROUP`` rows, a window looks ahead inside each, and the first row of a range is also
    dealt to the range before it. Rows with equal ids follow one another in the order of their carried values; null ids come first.
    """
    spark, n = docs.sparkSession, docs.count()
    groups = max(1, min(GROUPS, n // GROUP))
    cuts = docs.filter(F.col(id_col).isNotNull()).agg(F.percentile_approx(id_col, [k / groups for k in range(1, groups)], 100 * groups)).first()[0] if groups > 1 else []
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    halves = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)]) if cuts else F.array().cast("array<int>")
    upto = F.aggregate(halves, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= F.col(id_col)), at + step).otherwise(at))
    group = F.when(F.col(id_col).isNull(), 0).otherwise(upto)
    dealt = docs.withColumn("_group", group.cast("int")).withColumn("_guest", F.lit(0))
    heads = sorted((r["_group"], r["least"], r["nulls"]) for r in dealt.groupBy("_group").agg(F.min(id_col).alias("least"), F.count_if(F.col(id_col).isNull()).alias("nulls")).collect())
    if not heads:
        return derive(docs).select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    before = [(None if nulls else least, heads[k - 1][0]) for k, (_, least, nulls) in enumerate(heads)]
    to = spark.createDataFrame(before, f"`{id_col}` bigint, `_to` int")
    guests = dealt.alias("d").join(F.broadcast(to.alias("t")), F.col(f"d.{id_col}").eqNullSafe(F.col(f"t.{id_col}"))).select("d.*", "t._to").withColumn("_group", F.col("_to")).withColumn("_guest", F.lit(1)).drop("_to")
    ahead = Window.partitionBy("_group").orderBy("_guest", F.col(id_col).asc_nulls_first(), *carried)
    out = derive(dealt.unionByName(guests)).select("*", *[F.lead(c).over(ahead).alias(f"next_{c}") for c in carried])
    return out.filter("_guest = 0").drop("_group", "_guest")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``docs``.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document. Null
    texts are empty; a single document is its own next. Rows that repeat an id count as neighbours; null ids come first. Columns
    other than the two named are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = with_next(texts, "doc_id", ["text", "fingerprint"], lambda df: df.withColumn("fingerprint", fingerprint(F.col("text"))))
    cut = F.floor(F.length("text") / 4).cast("int")
    own = own.select("doc_id", "fingerprint", F.col("next_fingerprint"), F.length("text").cast("bigint").alias("n_chars"), F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut)).alias("changed"))
    own = own.withColumn("edited_fingerprint", fingerprint(F.col("changed")))
    return own.select("doc_id", "n_chars", F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
