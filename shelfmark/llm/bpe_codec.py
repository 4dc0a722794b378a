"""BPE encoding and decoding of text columns.

``encode`` and ``decode`` follow the tokenizer file as its own library does
(specials in the text are recognised, none are added, no truncation, no
padding). Ids travel as binary columns of little-endian unsigned 32-bit
integers. Null and empty texts encode to no ids; null or empty ids decode to
the empty string. Repeated rows give repeated results; other columns stay, but
a column that carries the output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.bpe import Bpe
from shelfmark.llm.common import GROUP_CHARS, arrow_groups, bounded_batches, bpe_of, byte_runs, documents, give_back


def _with(batch: pa.RecordBatch, column: str, values: pa.Array, without: str | None = None) -> pa.RecordBatch:
    """``batch`` with ``column`` at its end and without the column ``without``."""
    names = [c for c in batch.schema.names if c not in (column, without)]
    return pa.RecordBatch.from_arrays([*(batch[c] for c in names), values], [*names, column])


def _encoded(bpe: Bpe, batches: Iterator[pa.RecordBatch], text: str, out: str) -> Iterator[pa.RecordBatch]:
    for batch in arrow_groups(batches, column=text):
        flat, counts = bpe.encode(batch[text])
        raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        yield _with(batch, out, pa.array([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary()), text)


def _decoded(bpe: Bpe, batches: Iterator[pa.RecordBatch], ids: str, out: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in byte_runs(batch[ids], GROUP_CHARS):
            part = batch.slice(start, stop - start)
            rows = [np.frombuffer(x or b"", "<u4") for x in part[ids].to_pylist()]
            yield _with(part, out, pa.array(bpe.decode_rows(rows), pa.string()))


def _schema(df: DataFrame, kept: list[str], **more: T.DataType) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, kind) for c, kind in more.items())])


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` without its text and with ``out``: the ids of each text."""
    kept = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoded(bpe_of(path), batches, text, out)
        give_back()

    return df.select(*kept, text).mapInArrow(run, _schema(df, kept, **{out: T.BinaryType()}))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the text that the ids stand for, specials included."""
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _decoded(bpe_of(path), batches, ids, out)
        give_back()

    return df.select(*kept).mapInArrow(run, _schema(df, kept, **{out: T.StringType()}))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``decode`` of ``encode`` by one worker a task: two functions would hold two, each with the tokenizer's tables."""
    kept = [c for c in df.columns if c not in (text, ids, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path)
        yield from _decoded(bpe, _encoded(bpe, batches, text, ids), ids, out)
        give_back()

    return df.select(*kept, text).mapInArrow(run, _schema(df, kept, **{ids: T.BinaryType(), out: T.StringType()}))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded_batches(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return round_trip(documents(spark, sf_dir).select("doc_id", "text"), path).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
