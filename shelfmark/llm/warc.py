"""WARC archives of pages, with segmented records.

``write_archives`` writes gzipped WARC/1.1 files: per row a response whose block
is an HTTP message with a chunked body, or, for a payload that an earlier
record has, a revisit without body that names it. Blocks longer than
``segment_bytes`` are split: the record holds the first segment, continuation
records name it as their origin, count on, and the last one states the total
length. ``read_archives`` reads the files back: records are found by their
content lengths, continuation records are grouped by origin and ordered by
number, the total length is verified, the chunks are joined, digests are
verified, and revisits get the length of the record that they refer to.

Null payloads are empty and null urls ``about:blank``; a null page_id is
written as ``-``, ranks last among equal payloads and is read back as null.
Rows repeated as a whole are records of their own: the copies are revisits of
the first. Payloads shorter than ``least_bytes`` are always responses. An
empty table gives an empty archive. Extra columns are not stored.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded_batches, stored
from shelfmark.session import scratch_path

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
#: Records per file: bounds a file, as a record holds a segment at most.
FILE_RECORDS = 500
_CRLF = "\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits at a time make four letters."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _ascii(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary")


def _pieces(data: Column, size: int) -> Column:
    """A binary value in pieces of ``size`` bytes; an empty one is a single empty piece."""
    last = F.greatest(F.lit(0), F.floor((F.length(data) - 1) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _record(kind: str, rid: Column, fields: list[Column], block: Column) -> Column:
    """A record without its last line feed, which the text writer adds."""
    head = _ascii("WARC/1.1" + _CRLF, f"WARC-Type: {kind}{_CRLF}WARC-Record-ID: <urn:uuid:", rid, ">" + _CRLF, *fields)
    length = _ascii("Content-Length: ", F.length(block).cast("string"), _CRLF + _CRLF)
    return F.concat(head, length, block, F.lit(_CRLF + "\r").cast("binary"))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("-", *(p.cast("string") for p in parts)).cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def with_roles(pages: DataFrame, payload: str, least_bytes: int = 0) -> DataFrame:
    """(page, url, payload, digest, rid, first_rid): ``first_rid`` names the record that a revisit refers to.

    Rows are stored once with a number of their own. Only digests and numbers
    are compared; one row per repeated payload meets its copies, and the
    payloads meet their roles by number.
    """
    # a URL may hold anything: line breaks would end its header line
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "")
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("_id"), "page_id", url.alias("url"), body.alias("payload"))
    rows = stored(rows.withColumn("digest", base32_sha1(F.col("payload"))), "pages")
    slim = rows.filter(F.length("payload") >= least_bytes).select("page_id", "_id", "digest")
    order = F.struct(F.col("page_id").isNull().alias("null_last"), "page_id", "_id")
    firsts = slim.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = slim.join(firsts, "digest").filter("_id <> first._id").select("_id", F.col("first._id").alias("_first"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    named = rows.join(again, "_id", "left").withColumn("page", page)
    return named.withColumn("rid", _uuid(F.col("_id"))).withColumn("first_rid", F.when(F.col("_first").isNotNull(), _uuid(F.col("_first"))))


def write_archives(
    pages: DataFrame, folder: str, payload: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES
) -> None:
    """Write ``pages`` (page_id, url, payload) as WARC files to ``folder``."""
    rows = with_roles(pages, payload, least_bytes)
    common = [_ascii("WARC-Date: 2020-01-01T00:00:00Z" + _CRLF, "WARC-Target-URI: ", F.col("url"), _CRLF, "WARC-Page-ID: ", F.col("page"), _CRLF)]
    digest = _ascii("WARC-Payload-Digest: sha1:", F.col("digest"), _CRLF)
    kind = _ascii("Content-Type: application/http; msgtype=response" + _CRLF)
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

    refers = _ascii("WARC-Refers-To: <urn:uuid:", F.col("first_rid"), ">" + _CRLF, f"WARC-Profile: {_REVISIT_PROFILE}{_CRLF}")
    revisit = _record("revisit", F.col("rid"), [*common, digest, kind, refers], F.lit(http).cast("binary"))

    framed = F.transform(
        _pieces(F.col("payload"), chunk_bytes),
        lambda c: F.when(F.length(c) > 0, F.concat(_ascii(F.lower(F.hex(F.length(c))), _CRLF), c, F.lit(_CRLF).cast("binary"))).otherwise(F.lit(b"")),
    )
    body = F.aggregate(framed, F.lit(http).cast("binary"), lambda a, c: F.concat(a, c), lambda a: F.concat(a, F.lit("0\r\n\r\n").cast("binary")))
    n = F.size("segments")

    def segment(data: Column, i: Column) -> Column:
        number = _ascii("WARC-Segment-Number: ", (i + 1).cast("string"), _CRLF)
        one = F.when(n > 1, number).otherwise(F.lit(b""))
        total = F.when(i == n - 1, _ascii("WARC-Segment-Total-Length: ", F.length("block").cast("string"), _CRLF)).otherwise(F.lit(b""))
        origin = _ascii("WARC-Segment-Origin-ID: <urn:uuid:", F.col("rid"), ">" + _CRLF)
        first = _record("response", F.col("rid"), [*common, digest, kind, one], data)
        return F.when(i == 0, first).otherwise(_record("continuation", _uuid(F.col("rid"), i), [*common, number, origin, total], data))

    responses = rows.filter("first_rid is null").withColumn("block", body).withColumn("segments", _pieces(F.col("block"), segment_bytes))
    responses = responses.select(F.explode(F.transform("segments", segment)).alias("record"))
    records = responses.unionAll(rows.filter("first_rid is not null").select(revisit.alias("record")))
    out = records.select(F.col("record").cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(folder)


_FIELD = re.compile(rb"([^\r\n:]+): ?([^\r\n]*)\r\n")


def split_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a file, found by content length."""
    at = 0
    while at < len(raw):
        if not raw.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        end = raw.index(b"\r\n\r\n", at)
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(raw, at, end + 2)}
        block = end + 4
        at = block + int(fields["content-length"])
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {block} does not end where its length says")
        yield fields, raw[block:at]
        at += 4


def unchunk(block: bytes) -> bytes:
    """Payload of an HTTP message; chunked transfer framing is undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of all files, gzipped or not: its header fields and its block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        short = lambda s: None if s is None else s.strip("<>").removeprefix("urn:uuid:")
        for batch in batches:
            for raw in batch["content"]:
                rows = []
                for f, block in split_records(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    page = f.get("warc-page-id")
                    number = f.get("warc-segment-number")
                    total = f.get("warc-segment-total-length")
                    digest = f.get("warc-payload-digest", "").partition(":")[2]
                    rows.append(
                        (
                            short(f["warc-record-id"]), f["warc-type"], None if page in (None, "-") else int(page), f.get("warc-target-uri"),
                            digest, short(f.get("warc-refers-to")), short(f.get("warc-segment-origin-id")),
                            None if number is None else int(number), None if total is None else int(total), block,
                        )
                    )
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"page_id": "Int64", "number": "Int64", "total": "Int64"})

    names = ["rid", "type", "page_id", "url", "digest", "refers", "origin", "number", "total", "block"]
    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("content")
    kinds = "rid string, type string, page_id long, url string, digest string, refers string, origin string, number long, total long, block binary"
    return files.mapInPandas(run, kinds)


def reassemble(records: DataFrame) -> DataFrame:
    """Responses with whole blocks. Only records in several segments are grouped, by the id of their first one."""
    whole = records.filter("type = 'response' and number is null")
    split = records.filter("number is not null").withColumn("_origin", F.coalesce("origin", "rid"))
    first = F.when(F.col("origin").isNull(), F.struct("page_id", "url", "digest"))
    joined = split.groupBy("_origin").agg(
        F.first(first, ignorenulls=True).alias("head"),
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
    )
    block = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"]))
    counted = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    joined = joined.withColumn("block", block)
    broken = F.raise_error(F.concat(F.lit("segments of record "), "_origin", F.lit(" are not complete")))
    joined = joined.withColumn("block", F.when(counted & F.col("head").isNotNull() & (F.length("block") == F.col("total")), F.col("block")).otherwise(broken))
    joined = joined.select(F.col("_origin").alias("rid"), "head.page_id", "head.url", "head.digest", "block")
    return whole.select("rid", "page_id", "url", "digest", "block").unionByName(joined)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every page; revisits have no payload of their own."""
    records = read_records(spark, folder)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64
        import hashlib

        for batch in batches:
            payloads = [unchunk(b) for b in batch["block"]]
            found = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads]
            if found != batch["digest"].tolist():
                raise ValueError("a payload does not match its digest")
            yield batch.drop(columns="block").assign(payload=payloads)

    responses = reassemble(records).mapInPandas(decode, "rid string, page_id long, url string, digest string, payload binary")
    responses = responses.withColumn("payload_bytes", F.length("payload").cast("long"))
    known = responses.select(F.col("rid").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes", F.col("digest").alias("first_digest"))
    revisits = records.filter("type = 'revisit'").select("page_id", "url", "digest", "refers").join(known, "refers", "left")
    checked = F.when(F.col("digest") == F.col("first_digest"), F.col("digest")).otherwise(F.raise_error(F.lit("a revisit's record is not there or differs")))
    one = responses.select(
        "page_id", "url", "payload", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    )
    two = revisits.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "payload_bytes", checked.alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return one.unionByName(two)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    folder = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, html, sha1(html) as d, min(page_id) over (partition by html) as first_id from p),
g as (select page_id, html, first_id, list_transform(range(32), lambda i: (
    ('0x' || substr(d, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31) as digits from h)
select page_id, strlen(html) as payload_bytes,
    list_aggregate(list_transform(digits, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x::int + 1, 1)), 'string_agg', '') as payload_digest,
    case when page_id = first_id then 'response' else 'revisit' end as record_type,
    case when page_id <> first_id then first_id end as refers_to
from g
"""
