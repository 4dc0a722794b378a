"""Personal data against plain regular expressions, and the pipeline's stages against each other."""

import hashlib
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from shelfmark.llm import pii
from shelfmark.llm.queries import QUERIES

from .cases import as_table, empty_docs, odd_docs, odd_rows, with_clashes
from .test_tokens import check_packing

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k in PATTERNS for m in re.finditer(PATTERNS[k], text or "") if passes(k, m.group())]


TEXTS = [
    "a@b.c_d@e.f.g x@y x@.z é@b.de 🙂 q@w.er.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.1 1.2.3 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 0000000000000000000 12345678901234567890",
    "+1 (555) 555-0100 +1234567 +123456789012345 +1234567890123456 +1 2 3 4 5 6 7 8 9. +-1",
    "1 " * 4000 + "+" + "1 " * 30,
    "name (at) host (dot) example (dot) org, 555-0100, (555) 555-0100, 00 49 30 1234567",
]


def test_base_spans(spark):
    rows = [*enumerate(TEXTS), (50, None), (51, ""), (None, TEXTS[0]), (0, TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.with_spans(docs, None).select("doc_id", pii.as_text(pii.F.col("base_spans")).alias("b"), pii.as_text(pii.F.col("spans")).alias("s")).collect()
    want = Counter((d, ",".join(f"{k}:{a}:{b}" for k, a, b in base(t))) for d, t in rows)
    assert Counter((r["doc_id"], r["b"]) for r in found) == want
    assert all(r["b"] == r["s"] for r in found)


def test_op6(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = base(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(f[0] == k for f in found) for k in PATTERNS]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_trees_add_unconfirmed_forms(spark):
    """Phones without plus sign are added once the corpus has shown their shape; other numbers are not."""
    numbers = [(i, f"please call +1 ({200 + i}) 555-{1000 + i} now and pay {i}00.{i % 90 + 10} 00 by 20{i % 90 + 10} 12 for {i} 20 items") for i in range(700)]
    docs = spark.createDataFrame([*numbers, (9000, "please call 1 (321) 555-1234 now"), (9001, "pay 1200.50 00 by 2024 12 for 7 20 items")], "doc_id long, text string")
    model = pii.fit(docs)
    assert model is not None and "phone" in model.thresholds
    rows = {r["doc_id"]: r["s"] for r in pii.with_spans(docs, model).select("doc_id", pii.as_text(pii.F.col("spans")).alias("s")).filter("doc_id >= 9000").collect()}
    assert rows[9001] == "" and rows[9000].startswith("phone:")


@pytest.mark.parametrize("share", [5, 2])
def test_forms_without_base_span_are_found_at_any_share(spark, share):
    """A fifth or half of the numbers without plus sign and of the addresses in brackets are added; amounts and bad hosts are not."""
    def text(i):
        plus, at = ("1", " (at) ") if i % share == 0 else ("+1", "@")
        return f"please call {plus} ({200 + i}) 555-{1000 + i} or write to user{i}{at}mail{i % 7}.example.com now, pay {i}00.{i % 90 + 10} 00 for a{i}@b.{i}"

    docs = spark.createDataFrame([(i, text(i)) for i in range(700)], "doc_id long, text string")
    found = pii.with_spans(docs, pii.fit(docs)).select("doc_id", pii.as_text(pii.F.col("spans")).alias("s")).collect()
    for r in found:
        t, spans = text(r["doc_id"]), [x.split(":") for x in r["s"].split(",")]
        values = [(k, t[int(a) : int(b)]) for k, a, b in spans]
        assert any(k == "phone" and v.endswith(f"555-{1000 + r['doc_id']}") for k, v in values), values
        assert any(k == "email" and v.startswith(f"user{r['doc_id']}") for k, v in values), values
        assert not any("00." in v for _, v in values), values


NUMBERS = ["5551234567", "00491701234567", "0171 1234567", "030/12345678", "030 / 12345678", "(030) 12345678", "0049 (0) 171 1234567", "1 (321) 555-1234", "555-0100", "123456789012345"]


def test_phone_proposals_hold_whole_numbers(spark):
    """Every form is proposed from its first to its last digit, also before another number; no span starts or ends inside digits."""
    rows = [(i, t) for i, n in enumerate(NUMBERS) for t in (n, f"ring {n}, or so", f"at {n} 2024 1231", f"on 2024 12 31 {n}")]
    rows += [(99, "1234567890123456 123456"), (99, "12 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.with_candidates(docs).collect():
        spans = [(p["start"], p["end"]) for p in r["_loose"] if p["what"] == "phone"]
        t = r["text"]
        for a, b in spans:
            assert not t[max(0, a - 1) : a].isdigit() and not t[b : b + 1].isdigit()
            assert 7 <= sum(c.isdigit() for c in t[a:b]) <= 15
        if r["doc_id"] < 99:
            number = NUMBERS[r["doc_id"]]
            start = t.index(number)
            assert (start, start + len(number)) in spans, (t, spans)


def test_thresholds_take_all_documents(spark):
    """A kind that few documents hold gets its threshold from all of them, whatever the sample of the trees."""
    rows = [(i, f"call +1 ({200 + i % 700}) 555-{1000 + i} and pay {i}00.10 00" + (f" host {i % 200}.2.3.{i % 250}" if i % 100 == 0 else "")) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    assert model is not None and {"phone", "ip"} <= set(model.thresholds)


def test_spans_next_to_a_dropped_one_stay(spark):
    """A touches B, B touches C, C scores best: B goes, A stays."""
    row = dict.fromkeys(pii.FEATURES, 0.0)
    at = {"a": (0, 10, 1.0), "b": (8, 20, 2.0), "c": (18, 30, 3.0)}
    loose = [pii.F.struct(pii.F.lit("phone").alias("what"), pii.F.lit(x).alias("start"), pii.F.lit(y).alias("end"), *(pii.F.lit(n if f == "n_chars" else v).alias(f) for f, v in row.items())) for x, y, n in at.values()]
    none = pii.F.array().cast("array<struct<what:string,start:int,end:int>>")
    model = pii.Model([(1.0, ("n_chars", 1.5, (1.0,), ("n_chars", 2.5, (2.0,), (3.0,))))], {"phone": 0.5})
    docs = spark.range(1).select(none.alias("_base"), pii.F.array(*loose).alias("_loose"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii, "with_candidates", lambda df: df)
        found = pii.with_spans(docs, model).collect()[0]["spans"]
    assert [(s["start"], s["end"]) for s in found] == [(0, 10), (18, 30)]


def test_redact(spark):
    docs = with_clashes(odd_docs(spark))
    done = pii.redact(docs)
    assert done.columns == docs.columns
    for r in done.filter("doc_id = 7").collect():
        assert r["text"] == "Mail [EMAIL] or [PHONE], card [CARD], host [IP]."
    same = Counter((r["doc_id"], r["text"]) for r in done.filter("doc_id <> 7").collect())
    assert same == Counter((d, t) for d, t, *_ in odd_rows() if d not in (7, None))
    assert pii.redact(empty_docs(spark)).count() == 0


def test_plan_has_no_python(spark):
    sf = "/root/testdata/sf0.001"
    plan = QUERIES["op6_pii"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        rows = docs.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows) and {r["doc_id"] for r in rows} <= set(texts)
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    assert all(not base(r["text"]) for r in rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in rows}
    check_packing(pieces, 1024)
    got = Counter(tuple(r[c] for c in ("doc_id", "piece", "length", "ids_crc32")) for r in entry.queries()["pipeline"](spark, sf).collect())
    assert got == Counter(tuple(r[c] for c in ("doc_id", "piece", "length", "ids_crc32")) for r in pieces)


@pytest.mark.parametrize("make", [odd_docs, empty_docs])
def test_pipeline_on_odd_tables(spark, tmp_path, make):
    docs = with_clashes(make(spark))
    folder = as_table(spark, docs, tmp_path)
    rows = corpus_pipeline.run(spark, folder).collect()
    check_packing(rows, 1024)
    assert bool(rows) == (make is odd_docs)
