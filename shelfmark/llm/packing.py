"""Best-fit packing of token sequences.

Documents longer than a sequence are cut into pieces; full pieces take a
sequence each, the rest is packed best fit, longest first. Lengths are whole
numbers up to the capacity, so documents range-sorted by length are runs of
equal length, and so are the gaps of the open sequences. A round takes the
longest run left and sweeps its successors among the gaps: the smallest gap
that holds the length, then the next; documents of the run meet gaps in the
order of their ranks, so two of them never want the same gap. The gaps are
updated and the next round begins. The plan needs the number of documents per
length only (at most ``capacity`` numbers, whatever the data); ranks are dealt
out and placements looked up by all tasks.

Repeated rows are packed as often as they occur; null texts are empty and
leave the end id alone; an empty table packs to an empty table. Columns other
than those named are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import arrow_groups, bounded_batches, bpe_of, crc32_rows, documents, give_back
from shelfmark.session import materialize

CAPACITY = 1024
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: The task that wrote a row, and how many rows of its length the task wrote before.
_PLACE = [T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType())]


def _ranks(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Number of every row among those of its length, from ``seen`` of that length on; ``seen`` counts them."""
    order = np.argsort(length, kind="stable")
    n = np.bincount(length, minlength=len(seen))
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(n) - n - seen, n)
    seen += n
    return rank


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, _part, _rank): documents as ids with the end id, long ones cut.

    All pieces of a long document but the first are full. Pieces are numbered
    where they are made: a second function would hold a second worker a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, part = bpe_of(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in arrow_groups(batches):
            flat, counts = bpe.encode(batch["text"])
            flat = np.insert(flat, np.cumsum(counts), end_id)
            counts = counts + 1
            pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = counts - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            crc = crc32_rows(flat, np.cumsum(length))
            columns = [batch["doc_id"].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            columns += [pa.array(np.full(len(doc), part, np.int32)), pa.array(_ranks(length, seen))]
            yield pa.RecordBatch.from_arrays(columns, [*PIECE, "_part", "_rank"])
        give_back()

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _rank long")


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, first sequence, documents per sequence, offset) in order of rank.

    counts: documents per length. The documents of a length from ``first
    rank`` on, up to the next placement of that length, fill sequences from
    ``first sequence`` on.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first sequence, sequences)
    opened, out = 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = [g for g in gaps if g >= length]
            gap = min(fits) if fits else capacity
            each = gap // length
            if fits:
                first, width = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            else:
                first, width = opened, -(-left // each)
                opened += width
            full = min(width, left // each)
            some = left - full * each if full < width else 0
            out.append((length, rank, first, each, capacity - gap))
            used = full + (some > 0)
            for rest, begin, n in ((gap - each * length, first, full), (gap - some * length, first + full, int(some > 0)), (gap, first + used, width - used)):
                if rest and n:
                    gaps.setdefault(rest, []).append((begin, n))
            rank += full * each + some
            left -= full * each + some
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths must lie between 1 and ``capacity``."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, part = np.zeros(capacity + 2, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            # lengths out of bounds are refused by their counts, below
            yield batch.assign(_part=part, _rank=_ranks(np.clip(batch["length"].to_numpy(), 0, capacity + 1), seen))

    schema = T.StructType([*(pieces.schema[c] for c in names), *_PLACE])
    return _placed(pieces.select(*names).mapInPandas(number, schema), names, capacity)


def _placed(pieces: DataFrame, names: list[str], capacity: int) -> DataFrame:
    """The columns ``names`` of numbered pieces, and their places."""
    numbered = materialize(pieces, "pieces")
    per_part = numbered.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    plan: dict[int, list[np.ndarray]] = {}
    for length in counts:
        plan[length] = []
    for length, *row in plan_sequences(counts, capacity):
        plan[length].append(np.array(row, np.int64))
    tables = {length: np.stack(rows) for length, rows in plan.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            rank = (batch["_rank"] + batch["_before"]).to_numpy()
            for length, at in batch.groupby("length").indices.items():
                rows = tables[length][np.searchsorted(tables[length][:, 0], rank[at], side="right") - 1]
                inner = rank[at] - rows[:, 0]
                sequence[at] = rows[:, 1] + inner // rows[:, 2]
                offset[at] = rows[:, 3] + inner % rows[:, 2] * length
            yield batch[names].assign(sequence_id=sequence, offset=offset)

    out = T.StructType([*(pieces.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.join(offsets, ["_part", "length"]).select(*names, "_rank", "_before").mapInPandas(place, out)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    return _placed(token_pieces(docs, path, capacity, end_id), PIECE, capacity)


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded_batches(spark)
    packed = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
