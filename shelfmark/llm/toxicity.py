"""Toxicity by compression distance.

Two zstandard dictionaries are made, one trained on windows of ordinary text
and one of toxic text. Both classes share the languages they are written in, so
the toxic dictionary holds what sets toxic texts apart: beginnings of words made of
byte n-grams (``GRAMS``) that are far more frequent in toxic texts and stand in
many different contexts, so that copies of one text count once. It stands before
the ordinary content; a window that compresses better with it holds such runs.
Every text is cut into overlapping windows over its whole length, and those that
hold the beginning of a run are compressed with both. The bytes that they save
are compared with every threshold from 1 to ``LEVELS`` bytes; the
numbers and shares of windows beyond each, the strongest savings and the
mean are calibrated into a probability by logistic regression, weighted to the
true share of toxic texts.

The fit uses a bounded sample of labelled rows (``FIT_DOCS`` texts and
``FIT_CHARS`` characters a class, texts of all lengths; of one id its shortest
text) and runs on the driver; scoring covers all rows. A text of more than
``FIT_CHARS`` characters by itself is the only one that the sample can't hold.
Null and empty texts have one window, a blank, and get the score of no gain.
Without labelled texts of both classes every score is the share of toxic rows
(0 if there are none). Repeated rows get equal scores, several labels of one
id count as toxic if one of them is, and extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded_batches, documents

FIT_DOCS = 2000
FIT_CHARS = 4_000_000
WINDOW = 32
STEP = 24
LEVEL = 9
#: Bytes that the compressor takes for a match at least.
MIN_MATCH = 4
GRAMS = (5, 8)
#: A telling n-gram comes this much more often per byte of toxic than of ordinary text, and behind so many different runs.
LIFT = 12
CONTEXTS = 12
#: Bytes of a run's beginning, its blank included, that a window must hold to be compressed.
HEAD = 6
ORDINARY_BYTES = 8192
TOXIC_BYTES = 2048
#: Thresholds in bytes that a window's saving is compared with: 1 to LEVELS.
LEVELS = 12


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray | None = None
    share: float = 0.0


#: White space, and punctuation that opens a word.
_OPENING = re.compile(r"[^\S ]|(?<!\S)[^\w\s]+(?=\w)")


def _bytes(text: str | None) -> bytes:
    """Lower case, every word behind a blank, also behind other white space, brackets, quotes or marks."""
    return (" " + _OPENING.sub(lambda found: " " * len(found.group()), (text or "").lower())).encode()


def _windows(raw: bytes) -> Iterator[bytes]:
    return (raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - WINDOW + STEP), STEP))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    table = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=WINDOW, dict_size=len(content), min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    table.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=table, compression_params=params)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        if model.ordinary:
            self.plain, self.toxic = _compressor(model.ordinary), _compressor(model.toxic + model.ordinary)
            heads = sorted({b" " + run[: HEAD - 1] for run in model.toxic.split(b" ") if run})
            self.heads = re.compile(b"|".join(map(re.escape, heads))) if heads else None

    def gains(self, raw: bytes) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window.

        Windows that hold no beginning of a run of the toxic dictionary have
        nothing to gain from it and are not compressed; what the compressor
        saves there is chance.
        """
        n = len(range(0, max(1, len(raw) - WINDOW + STEP), STEP))
        gains = np.zeros(n, np.int32)
        if self.heads is None:
            return gains
        touched = set()
        for found in self.heads.finditer(raw):
            # windows i * STEP to i * STEP + WINDOW that hold the whole match
            touched.update(range(max(0, -(-(found.end() - WINDOW) // STEP)), min(n, found.start() // STEP + 1)))
        for i in touched:
            window = raw[i * STEP : i * STEP + WINDOW]
            gains[i] = len(self.plain.compress(window)) - len(self.toxic.compress(window))
        return gains

    def features(self, raw: bytes) -> np.ndarray:
        g = self.gains(raw)
        top = np.sort(np.partition(g, max(0, len(g) - 4))[-4:])[::-1].astype(float)
        beyond = (g[None, :] >= np.arange(1, LEVELS + 1)[:, None]).sum(1)
        return np.concatenate([[1.0, top[0], top[:2].mean(), top.sum() / 4, np.log(len(g)), np.maximum(g, 0).mean()], np.log1p(beyond), np.sqrt(beyond / len(g))])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model.weights is None:
            return np.full(len(texts), self.model.share)
        x = np.array([self.features(_bytes(t)) for t in texts]) if texts else np.empty((0, len(self.model.weights)))
        return 1 / (1 + np.exp(-np.clip(x @ self.model.weights, -30, 30)))


def _codes(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ``size`` bytes, 8 at most, as a number, and the 8 bytes before it."""
    padded = np.frombuffer(b"\0" * 8 + raw, np.uint8).astype(np.uint64)
    n = max(0, len(raw) - size + 1)

    def packed(start: int, width: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = out << np.uint64(8) | padded[start + k : start + k + n]
        return out

    return packed(8, size), packed(0, 8)


def _often(raws: list[bytes], size: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, how often it comes), a text counted 16 times at most; only ``known`` ones, if given."""
    codes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for raw in raws:
        found, n = np.unique(_codes(raw, size)[0], return_counts=True)
        if known is not None:
            some = np.isin(found, known, assume_unique=True)
            found, n = found[some], n[some]
        codes.append(found)
        counts.append(np.minimum(n, 16))
    names, at = np.unique(np.concatenate(codes), return_inverse=True)
    return names, np.bincount(at, weights=np.concatenate(counts), minlength=len(names))


def _telling(toxic: list[bytes], ordinary: list[bytes], size: int) -> np.ndarray:
    """N-grams that come far more often in toxic than in ordinary texts and behind many different runs."""
    pairs = [np.empty((0, 2), np.uint64)]
    for raw in toxic:
        gram, before = _codes(raw, size)
        mixed = gram * np.uint64(0x9E3779B97F4A7C15) ^ before * np.uint64(0xBF58476D1CE4E5B9)
        first = np.unique(mixed, return_index=True)[1]
        pairs.append(np.stack([mixed[first], gram[first]], axis=1))
    both = np.concatenate(pairs)
    both = both[np.unique(both[:, 0], return_index=True)[1]]
    gram, contexts = np.unique(both[:, 1], return_counts=True)
    known = gram[contexts >= min(CONTEXTS, max(2, len(toxic) // 4))]
    names, often = _often(toxic, size, known)
    usual = np.zeros(len(names))
    seen, n = _often(ordinary, size, known)
    usual[np.searchsorted(names, seen)] = n
    lift = LIFT * sum(map(len, toxic)) / max(1, sum(map(len, ordinary)))
    return names[often >= lift * (usual + 2)]


def _telling_runs(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Beginnings of words, behind their blank, that telling n-grams cover in toxic texts; the most frequent first."""
    telling = {size: _telling(toxic, ordinary, size) for size in GRAMS}
    runs: Counter = Counter()
    for raw in toxic:
        cover = np.zeros(len(raw) + 1, np.int64)
        for size, grams in telling.items():
            at = np.flatnonzero(np.isin(_codes(raw, size)[0], grams))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
        covered = np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(covered))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            words = raw[begin:end].split(b" ")[1:]
            runs.update(b" " + w for w in (x.strip(b".,;:!?|") for x in words) if len(w) >= 4)
    return [r for r, n in runs.most_common() if n >= 3]


def _trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the most frequent ones as they are
        return b" ".join(s for s, _ in reversed(Counter(samples).most_common(200)))[-size:]


def train(toxic: list[str], ordinary: list[str], n_toxic: int, n_ordinary: int) -> Model:
    """Fit on a sample of both classes; ``n_`` are the labelled rows that the samples stand for."""
    share = n_toxic / max(1, n_toxic + n_ordinary)
    if not toxic or not ordinary:
        return Model(share=share)
    bad, good = [_bytes(t) for t in toxic], [_bytes(t) for t in ordinary]
    windows = [w for raw in good for w in _windows(raw)]
    base = _trained(windows[:: max(1, len(windows) // 40_000)], ORDINARY_BYTES)
    toxic_runs = b"".join(reversed(_telling_runs(bad, good)))[-TOXIC_BYTES:]  # the most frequent nearest to the text
    model = Model(ordinary=base or b" ", toxic=toxic_runs, share=share)
    scorer = Scorer(model)
    x = np.array([scorer.features(raw) for raw in bad + good])
    y = np.repeat([1.0, 0.0], [len(bad), len(good)])
    w = np.where(y == 1, share / len(bad), (1 - share) / len(good)) * len(y)
    middle, spread = x.mean(0), x.std(0) + 1e-9
    middle[0], spread[0] = 0, 1
    weights = _logistic((x - middle) / spread, y, w) / spread
    weights[0] -= weights @ middle
    model.weights = weights
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    beta, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - keep * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(keep), gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def is_held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the labelled rows that aren't held out; a bounded sample of them reaches the driver."""
    marks = labels.filter("doc_id is not null and toxic is not null").filter(~is_held_out())
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = docs.filter("text is not null").groupBy("doc_id").agg(F.min(F.length("text")).alias("size")).join(marks, "doc_id")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = {}
    for toxic in (True, False):
        pick = known.filter((F.col("toxic") == toxic) & (F.col("size") <= FIT_CHARS)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
        ids, left = [], FIT_CHARS
        for r in pick.select("doc_id", "size").collect():
            if r["size"] <= left:
                ids.append(r["doc_id"])
                left -= r["size"]
        # of rows that repeat an id the shortest text, so that what is collected is bounded
        chosen = docs.filter(F.col("doc_id").isin(ids) & F.col("text").isNotNull())
        found = chosen.groupBy("doc_id").agg(F.min(F.struct(F.length("text"), "text"))["text"].alias("text")).collect() if ids else []
        texts[toxic] = [r["text"] for r in sorted(found, key=lambda r: r["doc_id"])]
    return train(texts[True], texts[False], totals.get(True, 0), totals.get(False, 0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scorer.score(batch["text"].where(batch["text"].notna(), None).tolist())})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
