"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.bpe import Bpe
from shelfmark.session import scratch_path

#: Characters that one step of a Python kernel holds; batches of long texts are cut into groups of about this size.
GROUP_CHARS = 1 << 20
#: The same for encoders, which work on different words: the more text, the fewer of its words are new.
ENCODE_CHARS = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_groups(texts: Sequence[str | None], limit: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first position, texts) of runs of about ``limit`` characters; null counts as empty, no text is cut."""
    start, size, group = 0, 0, []
    for i, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        if group and size + len(text) > limit:
            yield start, group
            start, size, group = i, 0, []
        group.append(text)
        size += len(text)
    if group:
        yield start, group


def byte_runs(values: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of about ``limit`` bytes of a column of strings or bytes, at least one row each."""
    upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(values), 0)), dtype=np.int64)
    start = 0
    while start < len(values):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + limit, "right")))
        yield start, stop
        start = stop


def arrow_groups(batches: Iterator[pa.RecordBatch], limit: int = ENCODE_CHARS, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``, at least one row each; null counts as empty."""
    for batch in batches:
        text = pc.fill_null(batch[column], "")
        batch = batch.set_column(batch.schema.get_field_index(column), column, text)
        for start, stop in byte_runs(text, limit):
            yield batch.slice(start, stop - start)


def range_cuts(keys: DataFrame, order: Sequence, parts: int) -> list:
    """First row of each of about ``parts`` ranges of ``keys`` sorted by ``order``.

    Only key columns are read and sorted; at most ``parts`` rows reach the driver.
    """
    ranged = keys.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    # the smallest row per range: sorted inside the range, the first row kept
    firsts = ranged.groupBy("_part").agg(F.min(F.struct(*order)).alias("_first"))
    return [r["_first"] for r in firsts.orderBy("_part").collect()]


def crc32_rows(flat: np.ndarray, ends: np.ndarray) -> list[int]:
    """crc32 of every run of little-endian unsigned 32-bit integers in ``flat``, runs ending at ``ends``."""
    import zlib

    raw = memoryview(np.ascontiguousarray(flat, dtype="<u4")).cast("B")
    out, start = [], 0
    for end in ends.tolist():
        out.append(zlib.crc32(raw[4 * start : 4 * end]))
        start = end
    return out


def per_worker(key: tuple, build):
    """An object built once per Python worker process and kept for its later tasks.

    Functions of this package travel by value, so their own globals last for
    one task only; tables of a tokenizer are kept beside the imported modules.
    """
    import sys
    import types

    kept = sys.modules.setdefault("_shelfmark_per_worker", types.ModuleType("_shelfmark_per_worker")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def drop_per_worker(kind: str) -> None:
    """Forget what earlier tasks have kept in this worker and later ones don't need."""
    import sys

    kept = getattr(sys.modules.get("_shelfmark_per_worker"), "__dict__", {})
    for key in [k for k in kept if isinstance(k, tuple) and k[0] == kind]:
        del kept[key]


def give_back() -> None:
    """Let the system have the memory that Arrow keeps for later batches: a worker lives on beside later stages."""
    pa.default_memory_pool().release_unused()


def bpe_of(path: str) -> Bpe:
    return per_worker(("bpe", path), lambda: Bpe(path))


def bounded_batches(spark: SparkSession, size: str = "16MB") -> None:
    """Bound the bytes of a batch that a Python task gets, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, size)


def set_apart(docs: DataFrame, *needed: str):
    """``docs`` with every other column under a name that clashes with nothing, and the way back.

    The way back selects the columns of ``docs`` in their order and under
    their names.
    """
    hidden = {c: f"_extra_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    inside = docs.select(*(F.col(f"`{c}`").alias(hidden.get(c, c)) for c in docs.columns))

    def back(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(hidden.get(c, c)).alias(c) for c in docs.columns))

    return inside, back


def stored(df: DataFrame, label: str) -> DataFrame:
    """``materialize`` for wide rows: packed more tightly."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
