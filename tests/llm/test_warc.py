"""WARC archives: round trips, roles, segments and framing."""

import base64
import hashlib

import pytest

from shelfmark.checks import compare
from shelfmark.llm import warc
from shelfmark.llm.queries import ORACLES, QUERIES

SCHEMA = "page_id long, url string, html string, payload string, digest string"


def pages(spark):
    big = "é" * 5000 + "WARC/1.1\r\n\r\n0\r\n\r\n"
    rows = [(5, "http://a/\r\nX: y", "same"), (2, None, "same"), (9, "u", "same"), (3, "u", None), (4, "u", ""), (1, "u", big), (7, "v", big), (None, "u", "same"), (6, "u", "alone\r\n")]
    rows += [(8, "u", "twice"), (8, "u", "twice"), (None, None, None)]
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], SCHEMA).repartition(3)


def b32(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


@pytest.mark.parametrize("segment, chunk, least", [(1 << 16, 1 << 13, 0), (64, 7, 0), (100, 1000, 5), (1, 3, 0)])
def test_round_trip(spark, tmp_path, segment, chunk, least):
    if segment == 1:
        table = pages(spark).filter("length(html) < 50 or html is null")
    else:
        table = pages(spark)
    folder = str(tmp_path / "w")
    warc.write_archives(table, folder, least_bytes=least, segment_bytes=segment, chunk_bytes=chunk)
    got = warc.read_archives(spark, folder).collect()
    given = [(r["page_id"], (r["html"] or "").encode()) for r in table.collect()]
    order = lambda p: (p is None, p or 0)
    want, seen = [], {}
    for page, raw in sorted(given, key=lambda x: order(x[0])):
        first = seen.setdefault(raw, page) if len(raw) >= least else None
        again = len(raw) >= least and sum(1 for w in want if w[2] == b32(raw)) > 0
        want.append((page, len(raw), b32(raw), "revisit" if again else "response", first if again else None))
    key = lambda r: (order(r[0]), r[3], r[2], order(r[4]))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    bodies = {bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert bodies == {raw for _, raw in given}


def test_segments_are_continuations(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write_archives(pages(spark), folder, segment_bytes=500)
    records = warc.read_records(spark, folder).collect()
    more = [r for r in records if r["type"] == "continuation"]
    assert more and all(len(r["block"]) <= 500 for r in records)
    origins = {r["rid"]: r for r in records if r["type"] == "response" and r["number"] == 1}
    assert {r["origin"] for r in more} == set(origins)
    lost = warc.read_records(spark, folder).filter("not (type = 'continuation' and number = 2)")
    with pytest.raises(Exception, match="not complete"):
        warc.reassemble(lost).collect()


def test_framing():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.unchunk(head + b"3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    assert warc.unchunk(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    with pytest.raises(ValueError):
        warc.unchunk(head + b"2\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.split_records(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))


def test_empty(spark, tmp_path):
    warc.write_archives(pages(spark).filter("false"), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_op4_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare.spark_rows(QUERIES["op4_warc"](spark, sf)) == compare.duck_rows(compare.duck(sf), ORACLES["op4_warc"])
