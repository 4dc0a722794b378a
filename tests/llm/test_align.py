"""Alignment against both libraries and a merge in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import align
from shelfmark.llm.bpe import _byte_letters
from shelfmark.llm.queries import QUERIES

from .cases import as_table, empty_docs, odd_docs, odd_rows, with_clashes

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


class Plain:
    """One text at a time by the libraries themselves."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self.a_bytes = lambda i: bytes(letters[c] for c in self.a.id_to_token(i))

    def b_bytes(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def __call__(self, text):
        """(A's ids, B's ids, links as places, groups)."""
        if not text:
            return [], [], [], ""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        x, y = [self.a_bytes(i) for i in a], [self.b_bytes(i) for i in b]
        if b"".join(x) != (" " + text).encode() or b"".join(y) != b"".join(x):
            return [], [], [], ""
        spans = [[], []]
        for side, parts in enumerate((x, y)):
            at, spans[side] = 0, []
            for p in parts:
                spans[side].append((at, at + len(p)))
                at += len(p)
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((i, k))
                k += 1
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for end in both:
            sides = [",".join(str(t) for t, (s, _) in zip(ids, sp, strict=True) if low <= s < end) for ids, sp in ((a, spans[0]), (b, spans[1]))]
            groups.append("|".join(sides))
            low = end
        return a, b, links, ";".join(groups)


def expected(texts):
    plain = Plain()
    rows = [plain(t) for t in texts]
    n = Counter()
    for a, b, links, _ in rows:
        n.update({(a[i], b[k]) for i, k in links})
    top = Counter()
    for (a, _), c in n.items():
        top[a] = max(top[a], c)
    out = []
    for a, b, links, groups in rows:
        pairs = [(a[i], b[k]) for i, k in links]
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), groups.count(";") + bool(groups), len(links), sum(n[p] == top[p[0]] for p in pairs), sum(n[p] for p in pairs), sha))
    return out


def odd_texts():
    rnd = random.Random(4)
    bits = ["the", "hello", " ", "  ", "\n", "é", "中文", "🙂", "<|endoftext|>", "</s>", "▁", "<0x41>", "　", "ﬁ", "①", "it's", "12345", "x" * 40, "\t", "Ǆ", "é"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 15))) for _ in range(1500)]
    return texts + ["a\nb c\nd", "one two three\nfour", " lead", "trail ", "\n", " ", "", "word " * 2000, "y" * 5000, "é" * 3000]


def test_tokens_equal_the_libraries():
    import pyarrow as pa

    plain, tokens = Plain(), align.Tokens(A, B)
    assert tokens.cuts
    texts = odd_texts()
    for _ in range(2):  # the second time from the store
        a, n_a, b, n_b = tokens.encode(pa.array([*texts, None]))
        got_a, got_b = (np.split(ids, np.cumsum(n)[:-1]) for ids, n in ((a, n_a), (b, n_b)))
        for k, t in enumerate(texts):
            want = plain(t)
            assert (got_a[k].tolist(), got_b[k].tolist()) == want[:2], t
        assert n_a[-1] == n_b[-1] == 0


@pytest.mark.parametrize("lane", [1, 7, 1024])
def test_lanes_make_the_same_links(lane):
    rng = np.random.default_rng(3)
    starts, a, b, at = [], [], [], 0
    for size in rng.integers(1, 300, 60).tolist():
        starts.append(at)
        for ends in (a, b):
            inner = np.sort(rng.choice(np.arange(1, size), min(size - 1, int(rng.integers(0, size))), replace=False)) if size > 1 else []
            ends += [at + int(x) for x in inner] + [at + size]
        at += size
    a, b = np.array(a), np.array(b)
    link_a, link_b, cut = align.merge(a, b, np.array(starts), np.array([*starts[1:], at]), lane)
    ends = np.union1d(a, b)
    assert (np.searchsorted(a, ends) == link_a).all() and (np.searchsorted(b, ends) == link_b).all()
    assert (cut == np.isin(ends, np.intersect1d(a, b))).all()


def test_op11_on_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_BYTES", 5000)
    rows = odd_rows()
    texts = [t for _, t, *_ in rows]
    extra = [(1000 + k, t, None, None, None) for k, t in enumerate(odd_texts()[:400])]
    docs = odd_docs(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    want = Counter(zip([r[0] for r in rows + extra], expected(texts + [r[1] for r in extra]), strict=True))
    folder = as_table(spark, with_clashes(docs).withColumns({c: F.lit("mine") for c in ("block", "pairs", "groups")}), tmp_path)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = Counter((r["doc_id"], tuple(r[c] for c in columns)) for r in QUERIES["op11_align"](spark, folder).collect())
    assert got == want


def test_written_groups(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in align.aligned(align.align_blocks(docs, A, B)).collect()}
    assert rows[1]["groups"] == Plain()("hello world")[3] and rows[1]["n_groups"] == rows[1]["groups"].count(";") + 1
    assert rows[2]["groups"] == "" and rows[2]["n_links"] == 0


def test_empty_table(spark, tmp_path):
    assert QUERIES["op11_align"](spark, as_table(spark, empty_docs(spark), tmp_path)).count() == 0


def test_op11_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in docs], expected([r["text"] for r in docs]), strict=True))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in QUERIES["op11_align"](spark, sf).collect()} == want
