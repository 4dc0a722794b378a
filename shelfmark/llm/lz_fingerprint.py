"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each phrase is the shortest prefix
of the rest that is not a phrase yet. The set of phrases is hashed, and the
smallest hash of each of ``BINS`` bins, sixteen bits of it, makes the
fingerprint; an empty bin is ``ffff``. The likeness of two fingerprints is the
share of equal bins among those that one of them fills, an estimate of the
overlap of the phrase sets, which follows how well one text compresses with
the other's dictionary.

Null and empty texts have no phrases: their fingerprint is all ``f``, and two
of them are alike (1.0). Equal texts have equal fingerprints. The next
document is the one before in ascending order of id (nulls first, equal ids by
text), the largest for the smallest; in a table of one row it is the row
itself. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded_batches, documents, range_cuts

BINS = 128
_EMPTY = 0xFFFF
#: Odd base of the rolling hash of phrases, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters per range of documents.
RANGE_CHARS = 16 << 20


class Parser:
    """Phrases of texts; the second halves of a text and of its edited form continue one parse of the first half."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up, self.down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)
        return self.up, self.down

    @staticmethod
    def _phrases(text: str, root: dict, node: dict, at: int, ends: list[int], made: list | None) -> dict:
        """Parse on from ``node``; phrase ends go to ``ends``, new entries to ``made``. Returns the node reached."""
        for c in text:
            at += 1
            child = node.get(c)
            if child is None:
                if made is not None:
                    made.append((node, c))
                node[c] = {}
                ends.append(at)
                node = root
            else:
                node = child
        return node

    def fingerprints(self, head: str, tails: list[str]) -> list[np.ndarray]:
        """Fingerprint of ``head`` followed by each of ``tails``."""
        root: dict = {}
        ends: list[int] = []
        node = self._phrases(head, root, root, 0, ends, None)
        out = []
        for i, tail in enumerate(tails):
            made: list | None = [] if i + 1 < len(tails) else None
            all_ends = ends.copy()
            self._phrases(tail, root, node, len(head), all_ends, made)
            for parent, c in made or ():
                parent.pop(c, None)
            out.append(self._bins(head + tail, np.array(all_ends, np.int64)))
        return out

    def _bins(self, text: str, ends: np.ndarray) -> np.ndarray:
        out = np.full(BINS, _EMPTY, np.uint16)
        if not len(ends):
            return out
        codes = np.frombuffer(text[: ends[-1]].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        up, down = self._powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=sums[1:])
        starts = np.concatenate(([0], ends[:-1]))
        h = (sums[ends] - sums[starts]) * down[starts]
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        h.sort()
        bins = (h >> np.uint64(57)).astype(np.int64)
        first = np.nonzero(np.diff(bins, prepend=-1))[0]
        out[bins[first]] = np.minimum(h[first] & np.uint64(0xFFFF), np.uint64(_EMPTY - 1)).astype(np.uint16)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != _EMPTY) | (b != _EMPTY)
    n = int(filled.sum())
    return 1.0 if not n else float(((a == b) & filled).sum()) / n


def to_text(bins: np.ndarray) -> str:
    return bins.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> tuple[str, str]:
    """Kept first part and replaced last part: half the characters come from the following document."""
    k = len(text) // 2
    return text[: len(text) - k], following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document, with its own, its edited text's fingerprint and their likeness to each other and the next document.

    Documents are dealt out in ranges of ids, the texts are moved once. The
    last rows of a range are also sent to the next range as its neighbours.
    """
    sizes = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = int(1 + sizes // RANGE_CHARS)
    ids = docs.select("doc_id")
    firsts = [r["doc_id"] for r in range_cuts(ids, ["doc_id"], parts)]
    cuts = np.array([c for c in firsts[1:] if c is not None], np.int64)
    n_ranges = len(cuts) + 1

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        filled = doc_id.fillna(np.iinfo(np.int64).min).astype("int64")
        return pd.Series(np.searchsorted(cuts, filled, side="right"))

    # one row per range reaches the driver
    tops = ids.withColumn("range", range_of("doc_id")).groupBy("range").agg(F.max("doc_id").alias("top")).collect()
    top_of = {r["range"]: r["top"] for r in tops}
    ranges = sorted(top_of)
    after = {r: ranges[(i + 1) % len(ranges)] for i, r in enumerate(ranges)}

    @F.pandas_udf("array<int>")
    def places(doc_id: pd.Series) -> pd.Series:
        filled = doc_id.fillna(np.iinfo(np.int64).min).astype("int64")
        own = np.searchsorted(cuts, filled, side="right").tolist()
        last = [pd.isna(d) if top_of[r] is None else d == top_of[r] for d, r in zip(doc_id, own, strict=True)]
        return pd.Series([[r, after[r]] if end else [r] for r, end in zip(own, last, strict=True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser, range_, before, before_bins = Parser(), None, "", None
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                text = r.text if isinstance(r.text, str) else ""
                if r.range != range_:
                    range_, before, before_bins = r.range, "", None
                if r.guest:
                    before, before_bins = text, None
                    continue
                if before_bins is None:
                    before_bins = parser.fingerprints(before, [""])[0]
                head, tail = edited(text, before)
                own, other = parser.fingerprints(head, [text[len(head) :], tail])
                digest = hashlib.sha256((head + tail).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((r.doc_id, len(text), digest, to_text(own), to_text(other), likeness(own, other), likeness(own, before_bins)))
                before, before_bins = text, own
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    placed = docs.select("doc_id", "text", F.posexplode(places("doc_id")).alias("guest", "range"))
    ordered = placed.repartition(n_ranges, "range").sortWithinPartitions(
        "range", F.col("guest").desc(), F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    return ordered.mapInPandas(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return fingerprints(documents(spark, sf_dir))
