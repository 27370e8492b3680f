"""WARC archives: pages written as segmented, chunked records, and archives read back with segments put together.

Writing is plain DataFrame work: a record is a row of text, and the two line ends that close a WARC record are the writer's line
separator, so Spark's own text writer lays down gzip-compressed archives wherever Spark can write. Reading parses archives in
tasks; continuation records then meet their first segment by its identifier, in the order of their segment numbers.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.scratch import partitions, save
from weir.session import shared_folder

_END = "\r\n"
_DATE = "2024-01-01T00:00:00Z"
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _pieces(c: Column, size: int) -> Column:
    """A text cut every ``size`` characters; one empty piece of an empty text."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(c) - 1) / size)).cast("int")), lambda i: F.substring(c, i * size + 1, F.lit(size)))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))


def records(pages: DataFrame, least: int = 1000, chunk: int = 4096, segment: int = 16384) -> DataFrame:
    """(record): the WARC records of ``pages`` (page_id, url, html), without the two line ends after each.

    A payload of at least ``least`` bytes that several pages have is written once, with the largest page_id; the others' records
    are revisits of that, which name it by its URI and date as the format has it, and by its page_id in a header of our own. Bodies are framed in chunks of ``chunk`` characters, and what is longer than ``segment`` characters is
    cut into continuation records. A null html is an empty payload; a null page_id or url has no header and takes part in no
    group. Rows that repeat the page_id that is kept are all responses.
    """
    page = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace("url", r"[\r\n]", "%0A").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    shared = page.filter((F.col("bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("best"), F.min("page_id").alias("last")).filter("best.page_id != last")
    shared = save(shared.select("digest", F.col("best.page_id").alias("first"), F.col("best.url").alias("first_url")), "shared-payloads")  # read back, its size is known when the join is planned
    page = page.join(shared, "digest", "left").withColumn("first", F.when(F.col("page_id") != F.col("first"), F.col("first")))
    page = page.withColumn("id", F.concat(F.lit("<urn:weir:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.monotonically_increasing_id().cast("string"), F.lit(">")))
    body = F.concat(F.array_join(F.transform(_pieces(F.col("html"), chunk), lambda x: F.concat(F.hex(F.octet_length(x)), F.lit(_END), x, F.lit(_END))), ""), F.lit("0\r\n\r\n"))
    full = F.concat(F.lit(f"{_HTTP}Transfer-Encoding: chunked\r\n\r\n"), F.when(F.col("html") == "", F.lit("0\r\n\r\n")).otherwise(body))
    bare = F.concat(F.lit(f"{_HTTP}Content-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    page = page.select("page_id", "url", "digest", "first", "first_url", "id", F.when(F.col("first").isNull(), full).otherwise(bare).alias("block"))
    part = page.withColumn("total", F.octet_length("block")).select("*", F.posexplode(_pieces(F.col("block"), segment)).alias("k", "piece")).withColumn("n", F.ceil(F.greatest(F.length("block"), F.lit(1)) / segment))
    begins, cut = F.col("k") == 0, F.col("n") > 1
    head = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _line("WARC-Type", F.when(~begins, "continuation").when(F.col("first").isNull(), "response").otherwise("revisit")),
        _line("WARC-Record-ID", F.when(begins, F.col("id")).otherwise(F.concat(F.expr("left(id, length(id) - 1)"), F.lit(":"), F.col("k").cast("string"), F.lit(">")))),
        _line("WARC-Date", F.lit(_DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Segment-Number", F.when(cut, F.col("k") + 1)),
        _line("WARC-Segment-Origin-ID", F.when(~begins, F.col("id"))),
        _line("WARC-Segment-Total-Length", F.when(F.col("k") == F.col("n") - 1, F.when(cut, F.col("total")))),
        F.when(begins, F.concat(_line("WARC-Page-ID", F.col("page_id")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), _line("WARC-Refers-To-Page-ID", F.col("first")))).otherwise(""),
        F.when(begins & F.col("first").isNotNull(), F.concat(_line("WARC-Profile", F.lit(_SAME)), _line("WARC-Refers-To-Target-URI", F.col("first_url")), _line("WARC-Refers-To-Date", F.lit(_DATE)))).otherwise(""),
        _line("Content-Type", F.when(begins, "application/http; msgtype=response")),
        _line("Content-Length", F.octet_length("piece")),
        F.lit(_END),
    )
    return part.select(F.concat(head, "piece").alias("record"))


def write(pages: DataFrame, path: str, per_archive: int = 1000, **how) -> None:
    """Write ``pages`` as gzip-compressed archives of at most ``per_archive`` records under ``path``."""
    records(pages, **how).write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", per_archive).text(path)


def _inflated(archive: bytes, step: int) -> Iterator[bytes]:
    """The archive's bytes part by part, out of ``step`` stored bytes each."""
    plain, member, view = archive[:2] != b"\x1f\x8b", None, memoryview(archive)
    for at in range(0, len(view), step):
        rest = view[at : at + step]
        if plain:
            yield bytes(rest)
            continue
        while rest:
            member = member or zlib.decompressobj(31)
            yield member.decompress(rest)
            rest = member.unused_data
            member = None if member.eof else member
    if member:
        raise ValueError("the archive ends inside a gzip member")


def parse(archive: bytes, step: int = 65_536) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive, plain or gzip (one member or several): lower-cased header names and the block. No more is inflated
    at a time than a record and what ``step`` stored bytes hold."""
    parts, data, at = _inflated(archive, step), bytearray(), 0

    def have(n: int) -> bool:
        while len(data) < n:
            part = next(parts, None)
            if part is None:
                return False
            data.extend(part)
        return True

    while have(1):
        if not have(5) or not data.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not have(len(data) + 1):
                raise ValueError(f"the header of the record at byte {at} doesn't end")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[:end].decode().split(_END)[1:])}
        start, size = end + 4, int(head["content-length"])
        if not have(start + size + 4) or data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end after {size} bytes")
        yield head, bytes(data[start : start + size])
        del data[: start + size + 4]
        at += start + size + 4


def body(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header and payload of an HTTP response, with chunked framing taken off."""
    at = block.index(b"\r\n\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:at].decode().split(_END)[1:])}
    data, at = block[at + 4 :], 0
    if head.get("transfer-encoding", "").lower() != "chunked":
        return head, data
    out = []
    while size := int(data[at : (line := data.index(b"\r\n", at))].split(b";")[0], 16):
        out.append(data[line + 2 : line + 2 + size])
        at = line + 2 + size + 2
        if len(out[-1]) != size or data[at - 2 : at] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
    return head, b"".join(out)


def _finished(head: dict[str, str], block: bytes) -> list:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of a whole record."""
    http, payload = body(block)
    digest, kind, number = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], lambda k: int(head[k]) if k in head else None
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {head['warc-record-id']} doesn't have its digest")
    return [number("warc-page-id"), len(payload) if kind == "response" else int(http["content-length"]), digest, kind, number("warc-refers-to-page-id"), payload if kind == "response" else None]


_FIELDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every response and revisit under ``path``; with
    ``payloads`` also payload (null for revisits).

    Continuation records join their first segment by WARC-Segment-Origin-ID, in the order of WARC-Segment-Number; numbers that
    don't run from 1, a length other than WARC-Segment-Total-Length, a broken chunk or another digest raise ValueError.
    """
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows: list[list], extra: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
        every = list(zip([*names, *(n for n, _ in extra)], [*kinds, *(t for _, t in extra)], strict=True))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(every)], [n for n, _ in every])

    more = [("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("digest", pa.string())]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for head, block in parse(archive.as_py()):
                    segment = int(head["warc-segment-number"]) if "warc-segment-number" in head else None
                    if segment is None:
                        done = _finished(head, block)
                        rows.append([*done[:5], done[5] if payloads else None, head["warc-record-id"], None, None, None, None])
                    else:
                        known = [int(head["warc-page-id"]) if "warc-page-id" in head else None, None, None, head["warc-type"], None, None]
                        rows.append([*known, head.get("warc-segment-origin-id", head["warc-record-id"]), segment, int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None, block, head.get("warc-payload-digest")])
                    if len(rows) == 256:
                        yield batch_of(rows, more)
                        rows = []
                yield batch_of(rows, more)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[dict] = []

        def close() -> list:
            blocks, last = b"".join(x["block"] for x in open_), open_[-1]
            if [x["segment"] for x in open_] != list(range(1, len(open_) + 1)) or last["total"] != len(blocks):
                raise ValueError(f"segments of {last['origin']} are missing or don't have their length together")
            head = {"warc-record-id": last["origin"], "warc-type": open_[0]["record_type"], "warc-payload-digest": open_[0]["digest"]}
            if open_[0]["page_id"] is not None:
                head["warc-page-id"] = open_[0]["page_id"]
            done = _finished(head, blocks)
            return done if payloads else [*done[:5], None]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if open_ and row["origin"] != open_[0]["origin"]:
                    out.append(close())
                    open_ = []
                if row["segment"] is None:
                    out.append([row[n] for n in names])
                else:
                    open_.append(row)
            yield batch_of(out, [])
        if open_:
            yield batch_of([close()], [])

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    parts = archives.mapInArrow(split, f"{_FIELDS}, origin string, segment int, total bigint, block binary, digest string")
    out = parts.repartition(partitions(spark), "origin").sortWithinPartitions("origin", "segment").mapInArrow(whole, _FIELDS)
    return out if payloads else out.drop("payload")


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: see ``records`` and ``read``."""
    path = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex[:12]}"
    write(pages, path, **how)
    return read(pages.sparkSession, path)
