"""BPE, the Huffman format and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import bpe_codec, huffman, packing
from shelfmark.llm.bpe import Bpe
from shelfmark.llm.queries import QUERIES

from .cases import as_table, empty_docs, odd_docs, odd_rows, with_clashes

ALPHABET = "abcdefgh éßÉΣσİ'sdtll0123  \n\t\x1c\x85　﷐!?…中文字é🙂THEthe"


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def odd_texts():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 70))) for _ in range(3000)]
    special = ["<|endoftext|>", "  <|endoftext|> ", "<|startoftext|>"]
    texts += [rnd.choice(special).join(rnd.sample(texts, 2)) for _ in range(300)]
    return texts + ["", " ", "a  b", " \n ", "a\n\nb", "a \nb", "don't WE'LL I'M", "a" * 1000, "ab" * 400 + " " + "the" * 300]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    texts, bpe, own = odd_texts(), Bpe(public_tokenizers.path(name)), library(name)
    want = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from the cache
        flat, counts = bpe.encode(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want
    rows = [np.array(x, np.int64) for x in want]
    assert bpe.decode_rows(rows[:500]) == [own.decode(x, skip_special_tokens=False) for x in want[:500]]


def test_cache_starts_anew_without_change():
    bpe = Bpe(public_tokenizers.path("word_bpe_49k.json"))
    bpe.cache_chunks = 3
    own = library("word_bpe_49k.json")
    for text in ("one two three four five", "six one two", "", "five six seven eight"):
        assert bpe.encode([text])[0].tolist() == own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_keeps_nothing_and_encodes_each_word_once(name, monkeypatch):
    bpe, words = Bpe(public_tokenizers.path(name)), []
    inner = bpe.encode_words
    monkeypatch.setattr(bpe, "encode_words", lambda text, size: (words.append(len(size)), inner(text, size))[1])
    texts = ["one two, (two) one\ntwo! one" + " two one" * 500] * 20
    before = set(vars(bpe))
    assert bpe.encode(texts)[0].tolist() == [i for t in texts for i in library(name).encode(t, add_special_tokens=False).ids]
    assert sum(words) <= 12  # with and without a blank, marks
    assert set(vars(bpe)) - before <= {"_pats"}


def test_odd_ascii_chunks_equal_library():
    texts = ["'", "a'", "don't 's", "<", "<a <| a<|b", "x\x00y \x01", "12ab34 a1b2!!c", "\nA\nb", "A.B,C;1,2 THE The", "\ufdd0 a\ufdd0b", "\n", "\n\n"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        bpe, own = Bpe(public_tokenizers.path(name)), library(name)
        for t in texts:
            assert bpe.encode([t])[0].tolist() == own.encode(t, add_special_tokens=False).ids


def test_pieces_are_numbered_by_the_worker_that_makes_them(spark):
    pieces = packing.token_pieces(odd_docs(spark), public_tokenizers.path("byte_bpe_50k.json"))
    plan = packing.pack_documents(odd_docs(spark), public_tokenizers.path("byte_bpe_50k.json"))
    assert {"_part", "_rank"} <= set(pieces.columns) and not {"_part", "_rank"} & set(plan.columns)
    by_length = {}
    for r in pieces.collect():
        by_length.setdefault((r["_part"], r["length"]), []).append(r["_rank"])
    assert all(sorted(ranks) == list(range(len(ranks))) for ranks in by_length.values())


def test_op5(spark, tmp_path):
    own = library("word_bpe_49k.json")
    rows = {}
    for r in QUERIES["op5_bpe_codec"](spark, as_table(spark, odd_docs(spark), tmp_path)).collect():
        rows.setdefault(r["doc_id"], set()).add((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]))
    want = {}
    for doc_id, text, *_ in odd_rows():
        ids = own.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want.setdefault(doc_id, set()).add((len(ids), digest, decoded))
    assert rows == want


def test_op5_holds_one_python_worker_a_task(spark, tmp_path):
    rows = QUERIES["op5_bpe_codec"](spark, as_table(spark, odd_docs(spark), tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_round_trip_is_decode_of_encode(spark, name):
    path, docs = public_tokenizers.path(name), with_clashes(odd_docs(spark))
    both = bpe_codec.round_trip(docs, path)
    apart = bpe_codec.decode(bpe_codec.encode(docs, path), path)
    assert set(both.columns) == set(apart.columns) and bpe_codec.round_trip(empty_docs(spark), path).count() == 0
    rows = [sorted(repr(sorted(r.asDict().items())) for r in df.collect()) for df in (both, apart)]
    assert rows[0] == rows[1] and len(rows[0]) == len(odd_rows())


def test_codec_keeps_large_numbers_beside_nulls(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(2**53 + 1, "a"), (None, "b")], "doc_id long, text string").coalesce(1)
    back = bpe_codec.decode(bpe_codec.encode(docs, path), path)
    assert {(r["doc_id"], r["decoded"]) for r in back.collect()} == {(2**53 + 1, "a"), (None, "b")}
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert [tuple(r) for r in bpe_codec.decode(nulls, path).collect()] == [(1, None, "")]


def test_codec_keeps_columns(spark):
    docs = with_clashes(odd_docs(spark))
    path = public_tokenizers.path("byte_bpe_50k.json")
    back = bpe_codec.decode(bpe_codec.encode(docs, path), path)
    assert set(docs.columns) - {"text"} <= set(back.columns)
    assert sorted((r["decoded"] for r in back.collect())) == sorted((t or "") for _, t, *_ in odd_rows())
    assert bpe_codec.encode(empty_docs(spark), path).count() == 0


def test_code_is_shortest_within_limit():
    rnd = np.random.default_rng(1)
    for n in (2, 3, 7, 40):
        counts = rnd.integers(1, 10**6, n) ** 2
        bits = huffman.code_lengths(counts, 24).astype(int)
        heap = sorted(counts.tolist())
        best = 0  # plain Huffman by repeated merging
        while len(heap) > 1:
            a, b, *heap = heap
            best += a + b
            heap = sorted([*heap, a + b])
        assert (counts * bits).sum() == best
        assert sum(2.0**-b for b in bits) == 1
    skewed = np.array([1 << i for i in range(20)])
    bits = huffman.code_lengths(skewed, 6)
    assert bits.max() <= 6 and sum(2.0 ** -int(b) for b in bits) <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, np.int64), 3)


def test_blocks_round_trip():
    rnd = np.random.default_rng(2)
    ids = np.minimum(rnd.geometric(0.01, 5000), 900)
    counts = np.array([0, 1, 255, 256, 257, 0, 4231])
    assert counts.sum() == len(ids)
    bits = huffman.code_lengths(np.bincount(ids), 12)
    codes = huffman.canonical_codes(bits)
    stream, sizes, inner = huffman.pack_bits(ids, counts, bits, codes)
    row_at = (np.cumsum(sizes) - sizes) * 8
    starts, lengths, first = [], [], 0
    for n, at in zip(counts.tolist(), row_at.tolist(), strict=True):
        for k in range(0, n, huffman.BLOCK):
            starts.append(at + inner[first + k])
            lengths.append(min(huffman.BLOCK, n - k))
        first += n
    table = huffman.decode_table(bits, codes)
    assert huffman.unpack_bits(stream, np.array(starts), np.array(lengths), *table).tolist() == ids.tolist()
    # the block of a single token behind a full one, alone
    i = lengths.index(1, 2)
    assert huffman.unpack_bits(stream, np.array(starts[i : i + 1]), np.array([1]), *table).tolist() == ids[sum(lengths[:i]) :][:1].tolist()


@pytest.mark.parametrize("segment,ranges", [(huffman.SEGMENT_BYTES, "8"), (300, "3"), (huffman.SEGMENT_BYTES, "1")])
def test_op3(spark, tmp_path, monkeypatch, segment, ranges):
    monkeypatch.setattr(huffman, "SEGMENT_BYTES", segment)
    own = library("word_bpe_49k.json")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = QUERIES["op3_huffman_ids"](spark, as_table(spark, odd_docs(spark), tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ids = [(d, own.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, *_ in odd_rows()]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d is not None, d or 0, len(x), crc(x)) for d, x in ids)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in ids), key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_op3_empty(spark, tmp_path):
    assert QUERIES["op3_huffman_ids"](spark, as_table(spark, empty_docs(spark), tmp_path)).count() == 0


def check_packing(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def one_at_a_time(lengths, capacity):
    """Gaps left by best fit, longest first."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        gap = min((g for g in gaps if g >= n), default=None)
        if gap is not None:
            gaps.remove(gap)
        gaps.append((capacity if gap is None else gap) - n)
    return gaps


def test_plan_needs_no_more_sequences_than_one_at_a_time():
    rnd = random.Random(9)
    for capacity in (10, 64):
        lengths = [rnd.randint(1, capacity) for _ in range(500)] + [capacity // 3] * 200
        counts = {n: lengths.count(n) for n in set(lengths)}
        gaps = one_at_a_time(lengths, capacity)
        plan = packing.plan_sequences(counts, capacity)
        filled: dict[int, int] = {}
        for i, (n, rank, first, each, offset) in enumerate(plan):
            stop = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == n else counts[n]
            for k in range(stop - rank):
                assert filled.get(first + k // each, 0) == offset + k % each * n
                filled[first + k // each] = offset + (k % each + 1) * n
        assert sum(filled.values()) == sum(lengths) and max(filled.values()) <= capacity
        assert len(filled) <= len(gaps)


def test_op9(spark, tmp_path):
    own = library("byte_bpe_50k.json")
    rows = QUERIES["op9_best_fit"](spark, as_table(spark, odd_docs(spark), tmp_path)).collect()
    want = []
    for d, t, *_ in odd_rows():
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids), 1024), len(ids)]
        want += [(d is None, d or 0, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert check_packing(rows, 1024) <= -(-sum(w[4] for w in want) // 1024) + 2


def test_pack_many_equal_lengths(spark):
    pieces = spark.range(3000, numPartitions=7).selectExpr("id as doc_id", "cast(case when id % 3 = 0 then id % 50 + 1 else 30 end as long) as length", "'x' as offset")
    rows = packing.pack(pieces, 100).collect()
    assert len(rows) == 3000
    assert check_packing(rows, 100) <= len(one_at_a_time([r["length"] for r in rows], 100))
    assert packing.pack(pieces.filter("false"), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(pieces.selectExpr("doc_id", "length + 100 as length"), 100)
