"""Token ids as a Huffman-coded binary format.

Codes are canonical, limited in length and made from the counts of all ids.
A written folder holds ``codebook`` (id, bits) and ``segments``: rows of a
range of documents in ascending order of id, each with its documents, their
token counts, one bit stream and the checkpoints. Every document starts on a
byte and is cut into blocks of ``BLOCK`` tokens; a checkpoint is the bit
offset of a block in its segment, so that blocks are decoded independently of
each other. The reader decodes all blocks of a segment in step by one table of
``2 ** bits`` entries.

Null texts count as empty: such a document holds the end id alone. Null ids
come first; equal ids stand next to each other, ordered by length and hash of their
tokens.
An empty table gives an empty folder. Columns other than id and text are not
stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_groups, bounded_batches, bpe_of, documents, drop_per_worker, give_back, stored
from shelfmark.session import scratch_path

BLOCK = 256
#: Coded bytes of a segment (a longer document has a segment of its own).
SEGMENT_BYTES = 512 << 10


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Bits of each symbol with a count: a shortest code of at most ``max_bits`` bits (package merge)."""
    used = np.nonzero(counts)[0]
    bits = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols don't fit codes of {max_bits} bits")
    if len(used) == 1:
        bits[used] = 1
        return bits
    if not len(used):
        return bits
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    # level by level: the coins and pairs of the level below, sorted; True marks a coin
    levels, row = [], np.empty(0, np.int64)
    for _ in range(max_bits):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([coins, pairs])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(coins))
        row = both[by]
    take = 2 * (len(coins) - 1)
    for is_coin in reversed(levels):
        n_coins = int(is_coin[:take].sum())
        bits[order[:n_coins]] += 1
        take = 2 * (take - n_coins)
    return bits


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Codes in ascending (bits, symbol) order."""
    codes = np.zeros(len(bits), np.uint32)
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    if len(order):
        width = bits[order].astype(np.int64)
        top = int(width.max())
        steps = np.int64(1) << (top - width)
        codes[order] = (np.cumsum(steps) - steps) >> (top - width)
    return codes


def decode_table(bits: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, bits) by the next ``top`` bits of a stream."""
    top = max(1, int(bits.max(initial=0)))
    used = np.nonzero(bits)[0]
    order = used[np.argsort(codes[used].astype(np.int64) << (top - bits[used].astype(np.int64)), kind="stable")]
    repeat = np.int64(1) << (top - bits[order].astype(np.int64))
    symbol, length = np.zeros(1 << top, np.int32), np.ones(1 << top, np.uint8)
    n = int(repeat.sum())
    symbol[:n], length[:n] = np.repeat(order, repeat), np.repeat(bits[order], repeat)
    return symbol, length, top


def pack_bits(ids: np.ndarray, counts: np.ndarray, bits: np.ndarray, codes: np.ndarray):
    """Stream of all rows, each from a byte on: (bytes, size in bytes per row, bit offset of each token in its row)."""
    width = bits[ids].astype(np.int64)
    ends = np.cumsum(width)
    row_ends = np.cumsum(counts)
    total = np.concatenate(([0], ends))
    row_bits = total[row_ends] - total[row_ends - counts]
    sizes = (row_bits + 7) // 8
    base = (np.cumsum(sizes) - sizes) * 8
    inner = ends - width - np.repeat(total[row_ends - counts], counts)
    at = inner + np.repeat(base, counts)
    words = np.zeros(int(sizes.sum()) // 4 + 3, np.uint32)
    if len(ids):
        word = at >> 5
        value = codes[ids].astype(np.uint64) << (64 - (at & 31) - width).astype(np.uint64)
        firsts = np.nonzero(np.diff(word, prepend=-1))[0]
        words[word[firsts]] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), firsts)
        words[word[firsts] + 1] |= np.bitwise_or.reduceat(value.astype(np.uint32), firsts)
    return words.astype(">u4").tobytes()[: int(sizes.sum())], sizes, inner


def unpack_bits(stream: bytes, starts: np.ndarray, counts: np.ndarray, symbol, length, top: int) -> np.ndarray:
    """Tokens of blocks at bit offsets ``starts`` with ``counts`` tokens, one block after the other."""
    raw = np.frombuffer(stream + b"\0" * 4, np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out = np.empty(int(counts.sum()), np.int32)
    order = np.argsort(-counts, kind="stable")
    at, left, place = starts[order].astype(np.int64), counts[order], (np.cumsum(counts) - counts)[order]
    live = np.searchsorted(-left, -np.arange(int(counts.max(initial=0))), side="left")
    shift = np.uint32(32 - top)
    for step, n in enumerate(live.tolist()):
        at, place = at[:n], place[:n]
        seen = (window[at >> 3] << (at & 7).astype(np.uint32)) >> shift
        out[place + step] = symbol[seen]
        at = at + length[seen]
    return out


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids): the ids of every text and the end id, two bytes each where they fit, else four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path)
        kind = "<u2" if len(bpe.token_text) <= 1 << 16 else "<u4"
        step = int(kind[-1])
        for batch in arrow_groups(batches):
            flat, counts = bpe.encode(batch["text"])
            ends = np.cumsum(counts)
            raw = np.insert(flat, ends, end_id).astype(kind).tobytes()
            cut = (step * (ends + np.arange(1, len(ends) + 1))).tolist()
            ids = pa.array([raw[a:b] for a, b in zip([0, *cut], cut, strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.full(len(ids), step, np.int32)), ids], ["doc_id", "width", "ids"])
        give_back()

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.mapInArrow(run, "doc_id long, width int, ids binary")


def token_counts(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs; every task sends one row per id it has seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for width, ids in batch.groupby("width")["ids"]:
                n = np.bincount(np.frombuffer(b"".join(ids), f"<u{width}"))
                if len(n) > len(seen):
                    n[: len(seen)] += seen
                    seen = n
                else:
                    seen[: len(n)] += n
        some = np.nonzero(seen)[0]
        yield pd.DataFrame({"id": some, "n": seen[some]})

    return tokens.select("width", "ids").mapInPandas(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, max_bits: int | None = None) -> None:
    """Encode ``docs`` and write the format to ``folder``."""
    spark = docs.sparkSession
    tokens = stored(token_table(docs, path, end_id), "tokens")
    found = token_counts(tokens).collect()  # at most one row per id of the vocabulary
    size = 1 + max((r["id"] for r in found), default=0)
    counts = np.zeros(size, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    limit = max_bits or max(12, int(np.count_nonzero(counts)).bit_length() + 2)
    bits = code_lengths(counts, limit)
    codes = canonical_codes(bits)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_per_worker("bpe")
        bucket = TaskContext.get().partitionId()  # ranges are numbered in the order of their documents
        held, size, start = [], 0, 0

        def close() -> pd.DataFrame:
            nonlocal held, size, start
            base, points = 0, []
            for _, _, coded, own in held:
                points.append(own + 8 * base)
                base += len(coded)
            n = [row[1] for row in held]
            out = {
                "bucket": bucket,
                "start": start,
                "doc_ids": [None if pd.isna(row[0]) else int(row[0]) for row in held],
                "counts": n,
                "points": np.concatenate(points).astype("<u8").tobytes(),
                "stream": b"".join(row[2] for row in held),
            }
            start += sum(n)
            held, size = [], 0
            return pd.DataFrame([out])

        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.iloc[first : first + 512]
                rows = [np.frombuffer(x, f"<u{w}") for x, w in zip(part["ids"], part["width"], strict=True)]
                n = np.fromiter(map(len, rows), np.int64, len(rows))
                stream, sizes, inner = pack_bits(np.concatenate(rows), n, bits, codes)
                ends = np.cumsum(sizes).tolist()
                starts = (np.cumsum(n) - n).tolist()
                for doc_id, k, s, a, b in zip(part["doc_id"].tolist(), n.tolist(), starts, [0, *ends], ends, strict=False):
                    if held and size + b - a > SEGMENT_BYTES:
                        yield close()
                    held.append((doc_id, k, stream[a:b], inner[s : s + k : BLOCK].astype("<u8")))
                    size += b - a
        if held:
            yield close()

    # one range of documents a task; equal ids are told apart by their content, so that no id is too hot to be split
    order = [F.col("doc_id").asc_nulls_first(), F.length("ids"), F.xxhash64("ids")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.mapInPandas(
        segments, "bucket int, start long, doc_ids array<long>, counts array<long>, points binary, stream binary"
    ).write.parquet(f"{folder}/segments")
    some = np.nonzero(bits)[0]
    spark.createDataFrame([(int(i), int(bits[i])) for i in some], "id int, bits int").coalesce(1).write.parquet(f"{folder}/codebook")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a written folder; ids are unsigned 32-bit integers."""
    segments = spark.read.parquet(f"{folder}/segments")
    book = spark.read.parquet(f"{folder}/codebook").collect()  # bounded by the vocabulary
    bits = np.zeros(1 + max((r["id"] for r in book), default=0), np.uint8)
    for r in book:
        bits[r["id"]] = r["bits"]
    # one row per range of documents
    sums = segments.select("bucket", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    per_bucket = sums.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect()
    before, total = {}, 0
    for r in per_bucket:
        before[r["bucket"]] = total
        total += r["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_per_worker("bpe")
        table = decode_table(bits, canonical_codes(bits))
        for batch in batches:
            for r in batch.itertuples(index=False):
                n = np.asarray(r.counts, np.int64)
                blocks = -(-n // BLOCK)
                sizes = np.full(int(blocks.sum()), BLOCK)
                sizes[np.cumsum(blocks)[blocks > 0] - 1] = (n - (blocks - 1) * BLOCK)[blocks > 0]
                flat = unpack_bits(r.stream, np.frombuffer(r.points, "<u8"), sizes, *table).astype("<u4")
                ends = np.cumsum(n)
                raw, cut = flat.tobytes(), (4 * ends).tolist()
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(list(r.doc_ids), "Int64"),
                        "start": before[r.bucket] + r.start + ends - n,
                        "n_tokens": n,
                        "ids": [raw[a:b] for a, b in zip([0, *cut], cut, strict=False)],
                    }
                )

    return segments.mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded_batches(spark)
    folder = scratch_path(spark, "huffman")
    write_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
