"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where more than half of the document's shingle
hashes (XXH64, seed 42, of four words, A-Z in lower case) have it set. Two
fingerprints link at ``RADIUS`` = 4 or fewer differing bits. Their 64 bits are
cut into segments of 23, 23 and 18 bits: of two linked fingerprints either one
of the first two segments differs in at most one bit, or both differ in two
and the third is equal. So every fingerprint is stored under its three
segments, asks for the 24 values around each of the first two and for its own
third one, and what it meets is compared over all 64 bits. Equal fingerprints
are collapsed before the search, so that only links between different ones
are made, and a group of copies of any size is one fingerprint. Links become
components by hooking to the smallest neighbour.

Null texts are empty; a text without words has fingerprint zero and links like
any other. Fewer than four words are one shingle. Components are named by
their smallest doc_id; null ids never name one unless it has no other. Repeated
rows keep their number, an empty table gives none, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded_batches, documents, set_apart, stored, text_groups
from shelfmark.operators.components import cluster_labels
from shelfmark.session import materialize

RADIUS = 4
SHINGLE = 4
#: (first bit, bits, radius of the ball searched) of each segment.
SEGMENTS = ((41, 23, 1), (18, 23, 1), (0, 18, 0))
#: Shingle hashes whose bits are counted in one step.
_STEP = 1 << 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, in order; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    if not n:
        return 0
    seen = np.zeros(64, np.int64)
    for i in range(0, n, _STEP):
        raw = hashes[i : i + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        seen += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * seen > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *keep: str, shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for _, group in text_groups(batch["text"].tolist()) for t in group]
            yield batch[list(keep)].assign(fp=np.array(fps, np.int64))

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "fp long"])
    return docs.select(*keep, "text").mapInPandas(run, schema)


def links(nodes: DataFrame) -> DataFrame:
    """(fp, near): pairs of different fingerprints with at most ``RADIUS`` differing bits, each at least once in one direction.

    nodes: distinct ``fp``.
    """
    stored, asked = [], []
    for n, (low, bits, radius) in enumerate(SEGMENTS):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))
        tag = F.lit(n << 32).cast("long")
        stored.append(value.bitwiseOR(tag))
        flips = [0, *(1 << b for b in range(bits))] if radius else [0]
        asked += [value.bitwiseXOR(F.lit(f).cast("long")).bitwiseOR(tag) for f in flips]
    table = nodes.select(F.explode(F.array(*stored)).alias("key"), F.col("fp").alias("near"))
    probes = nodes.select(F.explode(F.array(*asked)).alias("key"), "fp")
    close = (F.col("near") < F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("near"))) <= RADIUS)
    met = probes.join(table, (probes["key"] == table["key"]) & close)
    return met.select("fp", "near").distinct()


def components(prints: DataFrame, order: str = "doc_id") -> DataFrame:
    """(fp, component_id): the smallest ``order`` value of all rows whose fingerprints are connected."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(order).alias("first")), "fingerprints")
    pairs = materialize(links(nodes.select("fp")), "links")
    star = pairs.select(F.col("fp").alias("group_id"), F.col("near").alias("path"))
    star = star.unionAll(pairs.select(F.col("fp").alias("group_id"), F.col("fp").alias("path")).distinct())
    labels = cluster_labels(star).select(F.col("path").alias("fp"), "cluster")
    # only fingerprints with a link have a label
    named = nodes.join(labels, "fp", "left").withColumn("cluster", F.coalesce("cluster", "fp"))
    named = materialize(named, "named")
    firsts = named.groupBy("cluster").agg(F.min("first").alias("component_id"))
    return named.join(firsts, "cluster").select("fp", "component_id")


def near_groups(docs: DataFrame, *keep: str, order: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns, ``fp`` and ``component_id`` of every row."""
    prints = materialize(fingerprints(docs, *dict.fromkeys([*keep, order]), shingle=shingle), "prints")
    return prints.join(components(prints, order), "fp")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, nulls last, the first of equal ones.

    Groups are those of op7: fingerprints of shingles of ``shingle`` words,
    linked at ``RADIUS`` or fewer differing bits.
    """
    inside, back = set_apart(docs, "doc_id", "text")
    rows = stored(inside.withColumn("_row", F.monotonically_increasing_id()), "rows")
    ranked = rows.withColumn("_order", F.struct(F.col("doc_id").isNull().alias("null_last"), "doc_id", "_row"))
    kept = near_groups(ranked, "_row", order="_order", shingle=shingle).filter("_order = component_id").select("_row")
    return back(rows.join(kept, "_row", "left_semi"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    grouped = near_groups(documents(spark, sf_dir), "doc_id")
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
