"""Chat formatting against a turn-by-turn version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.checks import compare
from shelfmark.llm import chat
from shelfmark.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["\\", "\\\\", "### ", "###", "</turn>", "</turn>\n", ": ", ":", "\n", " ", "é", "🙂", "a", "<", "/turn>", "assistant", "### user: x</turn>\n"]


def escaped(text, role=False):
    return re.sub(r"(\\|### |</turn>" + ("|:" if role else "") + ")", r"\\\1", text)


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        text = text or ""
        convs.setdefault(conv, []).append((turn is not None, turn, role is not None, role, hashlib.md5(text.encode()).hexdigest(), text))
    out = {}
    for conv, turns in convs.items():
        turns = [(t[3] or "", t[5]) for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        formatted = "".join(f"### {escaped(r, True)}: {escaped(t)}</turn>\n" for r, t in turns)
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out[conv] = (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), formatted)
    return out


def check(parts, rows):
    want = expected(rows)
    got = chat.conversation_digests(parts).collect()
    assert len(got) == len(want)
    texts = {}
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["formatted"]
        for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True):
            assert r["formatted"][a - 11 : a] == "assistant: " and r["formatted"][b:].startswith("</turn>\n")
    for r in got:
        n, sha, n_loss, loss_sha, formatted = want[r["conv_id"]]
        assert texts[r["conv_id"]] == formatted
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (n, sha, n_loss, loss_sha, len(formatted))


def odd_rows():
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "system", "a:b", "\\", "", None]), "".join(rnd.choices(BITS, k=rnd.randint(0, 12)))) for c in range(300) for t in range(rnd.randint(1, 6))]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", None), (7, None, "assistant", "first"), (7, 1, "assistant", None), (8, 1, "user", ""), (8, 1, "user", ""), (9, 0, "assistant", "</turn>\\")]
    return [*rows, (400, 0, "assistant", "long \\ ### text é " * 20000), (401, 0, "assistant", "after")]


@pytest.mark.parametrize("part_bytes", [chat.PART_BYTES, 50])
def test_formats_and_reads_back(spark, part_bytes):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("mine") for c in ("part", "whole", "formatted", "digest", "place")})
    parts = chat.materialize(chat.format_conversations(docs, part_bytes), "parts")
    check(parts, rows)


def test_a_conversation_over_many_tasks(spark):
    rows = [(5, t, ["user", "assistant"][t % 2], f"turn {t} </turn>") for t in range(20000)] + [(c, 0, "assistant", "x") for c in range(6, 200)]
    parts = chat.materialize(chat.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(7), 2000), "parts")
    assert parts.filter("conv_id = 5").count() >= 8  # in all tasks
    check(parts, rows)


def test_empty_table(spark):
    parts = chat.format_conversations(spark.createDataFrame([], SCHEMA))
    assert parts.count() == 0 and chat.conversation_digests(parts).count() == 0


def test_op13_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    want = expected([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in QUERIES["op13_chat"](spark, sf).collect()}
    assert got == {k: (*v[:4], len(v[4])) for k, v in want.items()}


def test_op13_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare.spark_rows(QUERIES["op13_chat"](spark, sf)) == compare.duck_rows(compare.duck(sf), ORACLES["op13_chat"])
