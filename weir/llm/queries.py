"""The queries of this subpackage for the driver's entry module: thin wrappers that derive each contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import lm, quality, warc
from weir.llm.fingerprints import edited
from weir.llm.lines import drop_repeated_lines
from weir.llm.minhash import near_duplicates
from weir.llm.packing import pack
from weir.llm.pieces import encoded
from weir.llm.repeats import drop_repeats
from weir.llm.topk import quantised, top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no label and isn't held out."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    machine = quality.learn(docs, labels.filter(quality.fold(F.col("doc_id"), 5) != 0))
    scored = quality.score(docs, machine)
    return scored.select("doc_id", F.coalesce(quality.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"])
    return left.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the number of ids and the sum of ids by Viterbi and by merges (the library's ids for this file), and the
    digests of the texts they decode to."""
    import public_tokenizers

    out = encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), ("viterbi", "bpe"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: (s * 31 + x) % 2147483647)
    return out.select("row.doc_id", *[x for m in ("viterbi", "bpe") for x in (F.size(m).cast("bigint").alias(f"{m}_n_ids"), total(m).alias(f"{m}_ids_hash"), digest(f"{m}_text").alias(f"{m}_sha256"))])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null or empty, or hold null or non-finite components, take no part."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("vector"))
    return top_k(vectors, vectors.filter("id % 50 = 0"))


OP7_SQL = """
with whole as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v
    from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), scored as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from whole q join whole c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
    where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= 5
"""


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    fold = quality.fold(F.col("id"), 7)
    model = lm.fit(docs.filter(fold.isNull() | (fold != 2)), F.coalesce(fold == 3, F.lit(False)))
    return lm.score(docs, model).select(F.col("id").alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
with line as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
    from documents
), keyed as (
    select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line
), counted as (
    select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1
)
select doc_id, count(*) as n_lines, count(*) filter (first is not null and first <> doc_id) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (first is null or first = doc_id), '')) as kept_sha256
from keyed left join counted using (key) group by doc_id
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP10_SQL = """
with page as (
    select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as bytes, sha1(coalesce(html, '')) as digest from pages
), best as (
    select html, max(page_id) as first from page where bytes >= 1000 group by html
)
select page_id, cast(bytes as bigint) as payload_bytes, digest as payload_digest,
    case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
    case when first <> page_id then first end as refers_to
from page left join best using (html)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_fingerprint, op3_quality, op4_suffix, op5_sentencepiece, op6_packing, op7_topk, op8_lm, op9_lines, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op7_topk": OP7_SQL, "op9_lines": OP9_SQL, "op10_warc": OP10_SQL}
