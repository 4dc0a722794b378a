"""Alignment of two tokenizers' tokens by lockstep merging.

A is a byte-level BPE vocabulary, B a sentencepiece model. Both encode the text
behind one blank, B's own dummy prefix; control strings in the text are plain
text to both. A's and B's tokens are runs of the same bytes. Where tokens of both
end, the text is cut into groups; tokens whose bytes overlap are linked.

All documents of a batch are merged at once. One state vector holds, for
every document, the next token of A and of B; a step links the two, compares
their ends, advances the one that ends first, or both, which is a cut, and
compacts away what is finished. Long documents are several lanes of
``LANE_BYTES`` bytes: a lane takes the links that end inside it, so the state
at its beginning is the first token of each side that ends behind it.

The tokens of a text come from its chunks, white space with the word behind
it: no token of either side reaches over their borders, which is tested for the
vocabulary, and equal chunks of a task are encoded once. Texts with white space
other than single blanks and line feeds between words are one chunk each.

A link counts as often as documents of the corpus hold its pair of ids. Those
counts never visit the driver or all tasks: a block of documents lists its
distinct pairs with the number of its documents that hold them, sums are made
per pair, and every block gets the counts of its own pairs back.

Texts that are null, empty, or whose joined tokens of either side differ from
blank and text have no tokens: all numbers are zero and the groups are the empty
string. Null ids and repeated rows are documents of their own. Columns other than
id and text are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.bpe import _byte_letters
from shelfmark.llm.common import bounded_batches, documents, per_worker
from shelfmark.session import materialize

LANE_BYTES = 1024
#: Bytes of text whose links are one block, at most one document more.
BLOCK_BYTES = 4 << 20
#: Chunks a task keeps the tokens of; beyond it the store starts anew.
KEPT_CHUNKS = 150_000
_BLANK = "▁"
#: White space for which a text is not cut into chunks, as Arrow's and Python's patterns write it.
_ODD = r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"

_BLOCK = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, pairs array<long>, pair_docs array<int>, held_pairs binary, held_links binary, held_counts array<long>"


class Tokens:
    """Both vocabularies, and the tokens of the chunks seen so far."""

    #: Cuts a text into words (fixed pattern of the byte-level vocabulary).
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if all(c in letters for c in token)}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("the ids of A don't follow its merges")
        # merged tokens and single bytes only: what no merge makes is never produced
        known = {*made, *(vocab[c] for c in letters if c in vocab)}
        self.a = tiktoken.Encoding("a", pat_str=self.WORDS, mergeable_ranks={t: i for t, i in ranks.items() if i in known}, special_tokens={})
        self.a_bytes = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.mark = self.b.encode("x")  # stands before a chunk, so that B's own prefix falls on it
        self.cuts = len(self.mark) == 1 and not any(_BLANK in p.lstrip(_BLANK) or ("\n" in p and p != "\n") for p in plain)
        self.a_size, self.b_size = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        n = max(len(self.a_bytes), len(self.b_bytes))
        self.named = {sep: np.array([f"{i}{sep}" for i in range(n)], object) for sep in ",|;"}
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.pool = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.spans = np.zeros((0, 4), np.int64)  # start and number of A's and of B's tokens
        self.good = np.empty(0, bool)

    def _learn(self, chunks: list[str], whole: bool) -> None:
        """Encode new chunks, which begin with white space; ``whole``: texts behind their blank."""
        a = [self.a.encode_ordinary(c) for c in chunks]
        if whole:
            b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        else:
            b = [ids[1:] for ids in self.b.encode(["x" + c for c in chunks], num_threads=1)]
        joined = [c.encode() for c in chunks]
        good = [b"".join([self.a_bytes[i] for i in x]) == t == b"".join([self.b_bytes[i] for i in y]) for t, x, y in zip(joined, a, b, strict=True)]
        spans = np.empty((len(chunks), 4), np.int64)
        for side, rows in enumerate((a, b)):
            lens = np.fromiter(map(len, rows), np.int64, len(rows))
            spans[:, 2 * side], spans[:, 2 * side + 1] = len(self.pool[side]) + np.cumsum(lens) - lens, lens
            self.pool[side] = np.concatenate([self.pool[side], np.fromiter((i for r in rows for i in r), np.int32, int(lens.sum()))])
        first = len(self.good)
        if not whole:
            self.at.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.spans, self.good = np.concatenate([self.spans, spans]), np.concatenate([self.good, np.array(good, bool)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, their number per text, B's ids, their number per text)."""
        if len(self.good) > KEPT_CHUNKS:
            self.forget()
        texts = texts.cast(pa.string()).fill_null("")
        odd = np.asarray(pc.match_substring_regex(texts, _ODD)) | (not self.cuts)
        empty = np.asarray(pc.equal(texts, "")) | odd
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd), "", texts), "\n", " \n"), " ")
        counts = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        words = ["" if w is None else w if w[:1] == "\n" else " " + w for w in coded.dictionary.to_pylist()]
        new = [w for w in words if w not in self.at]
        if new:
            self._learn(new, False)
        place = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        flat = place[np.asarray(coded.indices)]
        keep = np.repeat(~empty, counts)
        counts = np.where(empty, 0, counts)
        flat = flat[keep]
        if odd.any():  # such a text is a chunk of its own, kept for this call only
            some = np.flatnonzero(odd)
            first = len(self.good)
            self._learn([" " + t for t in texts.take(pa.array(some)).to_pylist()], True)
            ends = np.cumsum(counts)
            flat = np.insert(flat, ends[some], first + np.arange(len(some)))
            counts[some] = 1
        owner = np.repeat(np.arange(len(counts)), counts)
        bad = np.zeros(len(counts), bool)
        bad[owner[~self.good[flat]]] = True
        flat, owner = flat[~bad[owner]], owner[~bad[owner]]
        out = []
        for side in (0, 1):
            starts, lens = self.spans[flat, 2 * side], self.spans[flat, 2 * side + 1]
            ends = np.cumsum(lens)
            take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)
            out += [self.pool[side][take], np.bincount(owner, weights=lens, minlength=len(counts)).astype(np.int64)]
        if odd.any():
            self.good, self.spans = self.good[:first], self.spans[:first]
        return tuple(out)


def merge(a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, lane_bytes: int = LANE_BYTES):
    """Links of all texts: (A's token, B's token, whether both end there), in the order of the bytes.

    ``a_ends``, ``b_ends``: the byte at which every token ends, over all texts
    in a row; ``starts``, ``stops``: the bytes of each text.
    """
    lanes = -(-(stops - starts) // lane_bytes)
    text = np.repeat(np.arange(len(starts)), lanes)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = starts[text] + nth * lane_bytes
    stop = np.minimum(begin + lane_bytes, stops[text])
    # the state: next token of A, of B, and the place of the next link
    a, b = np.searchsorted(a_ends, begin, "right"), np.searchsorted(b_ends, begin, "right")
    room = np.searchsorted(a_ends, stop, "right") - a + np.searchsorted(b_ends, stop, "right") - b
    at = np.cumsum(room) - room
    total = int(room.sum())
    link_a, link_b, cut = np.full(total, -1, np.int32), np.empty(total, np.int32), np.zeros(total, bool)
    far = np.iinfo(np.int64).max
    a_ends, b_ends = np.append(a_ends, far), np.append(b_ends, far)
    while len(a):
        x, y = a_ends[a], b_ends[b]
        live = np.minimum(x, y) <= stop
        if not live.all():
            a, b, at, stop, x, y = (v[live] for v in (a, b, at, stop, x, y))
        link_a[at], link_b[at], cut[at] = a, b, x == y
        a, b, at = a + (x <= y), b + (y <= x), at + 1
    made = link_a >= 0
    return link_a[made], link_b[made], cut[made]


def _group_texts(tokens: Tokens, a: np.ndarray, b: np.ndarray, link_a, link_b, cut, token_ends: np.ndarray) -> list[str]:
    """The written groups of each text; ``token_ends``: tokens of both sides up to the end of each text."""
    group = np.cumsum(cut) - cut  # of every link
    sides = []
    for link in (link_a, link_b):
        sides.append(group[np.flatnonzero(np.diff(link, prepend=-1))])
    n = int(cut.sum())
    in_a, in_b = (np.bincount(g, minlength=n) for g in sides)
    names = np.empty(len(a) + len(b), object)
    for ids, g, between, sep in ((a, sides[0], np.cumsum(in_b) - in_b, "|"), (b, sides[1], np.cumsum(in_a), ";")):
        last = np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool)
        names[np.arange(len(ids)) + between[g]] = np.where(last, tokens.named[sep][ids], tokens.named[","][ids])
    out, start = [], 0
    for end in token_ends.tolist():
        out.append("".join(names[start:end].tolist())[:-1])
        start = end
    return out


def _tokens(a_path: str, b_path: str) -> Tokens:
    return per_worker(("align", a_path, b_path), lambda: Tokens(a_path, b_path))


def align_blocks(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``_BLOCK``: the alignments of runs of documents, and the pairs of ids that each run links.

    ``pairs`` holds A's id in the upper half of a number and B's in the lower
    one. ``held_pairs`` (places in ``pairs``) and ``held_links`` (how many
    links) are 32-bit integers, ``held_counts`` of them for each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list] = {}
        size = 0

        def take(ids: pa.Array, texts: pa.Array) -> None:
            a, n_a, b, n_b = tokens.encode(texts)
            a_ends, b_ends = np.cumsum(tokens.a_size[a]), np.cumsum(tokens.b_size[b])
            upto = np.concatenate(([0], a_ends))[np.concatenate(([0], np.cumsum(n_a)))]
            link_a, link_b, cut = merge(a_ends, b_ends, upto[:-1], upto[1:])
            doc = np.repeat(np.arange(len(n_a)), n_a)[link_a]
            links = np.bincount(doc, minlength=len(n_a))
            # distinct pairs of each document and how many links each has
            codes, pairs = pd.factorize(a[link_a].astype(np.int64) << 32 | b[link_b])
            places, distinct = pd.factorize(doc * max(1, len(pairs)) + codes)
            held.setdefault("ids", []).append(ids)
            for name, value in (
                ("n_a", n_a), ("n_b", n_b), ("n_groups", np.bincount(doc[cut], minlength=len(n_a))), ("n_links", links),
                ("pairs", pairs[distinct % max(1, len(pairs))]), ("times", np.bincount(places, minlength=len(distinct))),
                ("counts", np.bincount(distinct // max(1, len(pairs)), minlength=len(n_a))),
            ):
                held.setdefault(name, []).append(value.astype(np.int64))
            held.setdefault("groups", []).extend(_group_texts(tokens, a, b, link_a, link_b, cut, np.cumsum(n_a + n_b)))

        def close() -> pa.RecordBatch:
            nonlocal number, size
            flat = {k: np.concatenate(v) for k, v in held.items() if k not in ("ids", "groups")}
            codes, pairs = pd.factorize(flat["pairs"])
            values = [
                number, pa.concat_arrays(held["ids"]), flat["n_a"], flat["n_b"], flat["n_groups"], flat["n_links"], held["groups"],
                pairs, np.bincount(codes, minlength=len(pairs)), codes.astype("<i4").tobytes(), flat["times"].astype("<i4").tobytes(), flat["counts"],
            ]
            kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}
            fields = [c.split() for c in _BLOCK.split(", ")]
            columns = []
            for v, (_, kind) in zip(values, fields, strict=True):
                if kind.startswith("array"):
                    v = pa.array(v, kinds[kind].value_type)
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
                else:
                    columns.append(pa.array([v], kinds[kind]))
            held.clear()
            number, size = number + 1, 0
            return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])

        for batch in batches:
            texts = batch["text"].cast(pa.string())
            lens = np.asarray(pc.binary_length(texts).fill_null(0))
            start = 0
            while start < len(lens):
                # an eighth of a block at a time, at least one text
                n = max(1, int(np.searchsorted(np.cumsum(lens[start:]), BLOCK_BYTES // 8, "right")))
                take(batch["doc_id"].slice(start, n), texts.slice(start, n))
                size += int(lens[start : start + n].sum())
                start += n
                if size >= BLOCK_BYTES or sum(map(len, held["ids"])) >= 1 << 16:
                    yield close()
        if held:
            yield close()
        tokens.forget()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _BLOCK)


def aligned(blocks: DataFrame) -> DataFrame:
    """One row per document: id, numbers and written groups."""
    names = {"doc_ids": "doc_id", "n_a": "n_a", "n_b": "n_b", "n_groups": "n_groups", "n_links": "n_links", "groups": "groups"}
    rows = blocks.select(F.explode(F.arrays_zip(*names)).alias("r"))
    return rows.select(*(F.col(f"r.{c}").alias(n) for c, n in names.items()))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, is_best): documents that hold each pair of ids linked, and whether no pair of its A id has more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p"))
    totals = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_docs").alias("n"))
    totals = materialize(totals.withColumn("a", F.shiftright("pair", 32)), "pair_counts")
    tops = totals.groupBy("a").agg(F.max("n").alias("top"))
    return totals.join(tops, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("is_best"))


def link_counts(blocks: DataFrame) -> DataFrame:
    """(block, n_best, count_sum): for each document of a block, in its order, its links of an A id's best pair and the sum of its links' counts."""
    own = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    known = own.join(pair_counts(blocks), "pair")
    # bounded by the links of one block
    per_block = known.groupBy("block").agg(F.collect_list(F.struct("place", "n", "is_best")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known = batch["known"][i].values
                pairs, times = (np.frombuffer(batch[c][i].as_buffer(), "<i4") for c in ("held_pairs", "held_links"))
                counts = np.asarray(batch["held_counts"][i].values)
                n, is_best = np.zeros((2, 0 if known is None else len(known)), np.int64)
                if len(n):
                    place = np.asarray(known.field("place"))
                    n[place], is_best[place] = np.asarray(known.field("n")), np.asarray(known.field("is_best").cast(pa.int8()))
                out = [pa.array([batch["block"][i].as_py()])]
                for value in (is_best, n):
                    upto = np.concatenate(([0], np.cumsum(value[pairs] * times)))[np.concatenate(([0], np.cumsum(counts)))]
                    out.append(pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(np.diff(upto))))
                yield pa.RecordBatch.from_arrays(out, ["block", "n_best", "count_sum"])

    joined = blocks.select("block", "held_pairs", "held_links", "held_counts").join(per_block, "block", "left")
    return joined.mapInArrow(run, "block long, n_best array<long>, count_sum array<long>")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded_batches(spark)
    blocks = align_blocks(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.transform("groups", lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256)))
    blocks = materialize(blocks.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts = materialize(link_counts(blocks), "link_counts")
    names = {"doc_ids": "doc_id"} | {c: c for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")}
    rows = blocks.select("block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(counts, "block")
    rows = rows.select(F.explode(F.arrays_zip(*names)).alias("r"))
    return rows.select(*(F.col(f"r.{c}").alias(n) for c, n in names.items()))
