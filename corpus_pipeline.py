"""The corpus pipeline: quality, repeated lines, near duplicates, repeated passages, packing.

Each stage works on all rows that the one before it kept, and its decisions take effect: documents go, or their texts shrink. All
stages but the last return the columns of ``documents``; where a text changes, n_chars follows. ``run`` writes each stage's rows to
the shared folder and reads them back, as the driver does with STAGES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.lines import drop_repeated_lines
from weir.llm.minhash import near_duplicates
from weir.llm.packing import pack
from weir.llm.quality import fold, learn, score
from weir.llm.repeats import drop_repeats
from weir.llm.scratch import save

#: Score under which a document is rejected.
LEAST_QUALITY = 0.3


def _with_text(docs: DataFrame, left: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` from an operator's ``row`` struct, with another text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return left.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under LEAST_QUALITY go. The classifier learns from labelled rows whose fold of 5 isn't 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = learn(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    return score(docs, machine, score_col="_score").filter(F.col("_score") >= LEAST_QUALITY).drop("_score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; documents stay, if only with an empty text."""
    return _with_text(docs, drop_repeated_lines(docs), F.col("text"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id; rows without an id stay."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that begin earlier go; what is left of a character that was cut goes with them."""
    return _with_text(docs, drop_repeats(docs, as_text=True), F.col("kept"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences of 2048."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near), ("passages", passages), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The first stage is a trained classifier, which SQL can't express. Tests hold the operators of lines, near duplicates and passages
#: against brute force, but not the stages: of these they check columns, ids, row counts and n_chars only.
ORACLE_SQL = None
