"""Quality rules with thresholds that adapt to language and source.

Each text is measured: words, characters in words, symbols, repeated lines and
words in repeated three-word windows. Base rules reject texts of fewer than 50
words or with over half their words repeated. For the others, rates of the
measures go into KLL quantile sketches per language and source; sketches of
small groups are merged into their language's and, if that is small too, into
that of all texts. A document is rejected where a rate lies beyond the fence of
its group: a high (or low) quantile, and from there ``REACH`` times its distance
from the median. No fence is a number of ours; what is set is the quantile that
counts as usual for a rate. A share of counted things must also exceed the fence
by more than ``REACH`` standard deviations of such a count, so that a short text
is not rejected for one symbol where most texts have none.

Null texts have no words and fail the base rules. Null languages and sources
are groups of their own. Repeated rows get equal verdicts, an empty table gives
an empty one, and extra columns are kept by ``filter_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import bounded_batches, documents, drop_per_worker, set_apart
from shelfmark.session import materialize

MIN_WORDS = 50
REACH = 3.0
#: Texts that a group's own sketch needs.
GROUP_ROWS = 200
#: rate -> (numerator, denominator, quantile that is usual on the high side, and on the low side or None)
RATES: dict[str, tuple[str, str, float, float | None]] = {
    "symbol_rate": ("n_symbols", "word_chars", 0.9, None),
    "repeated_line_rate": ("n_dup_lines", "n_lines", 0.99, None),
    "repeated_word_rate": ("n_repeat_words", "n_words", 0.99, None),
    "word_length": ("word_chars", "n_words", 0.95, 0.05),
}
#: Rates whose numerator counts some of the things that the denominator counts.
SHARES = ("symbol_rate", "repeated_line_rate", "repeated_word_rate")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, _SPACE))
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return (
        len(words),
        word_chars,
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * np.int64(len(number)) + ids[2:]
    _, back, n = np.unique(windows, return_inverse=True, return_counts=True)
    again = n[back] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the measures of every row."""
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in MEASURES)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_per_worker("bpe")
        for batch in batches:
            found = np.array([measure_text(t if isinstance(t, str) else "") for t in batch["text"]], np.int64).reshape(-1, len(MEASURES))
            yield batch[list(keep)].assign(**{c: found[:, i] for i, c in enumerate(MEASURES)})

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rate(name: str) -> Column:
    top, bottom, *_ = RATES[name]
    return F.col(top) / F.when(F.col(bottom) > 0, F.col(bottom))


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, low and high fence of each rate), from the rows that pass the base rules.

    Every task sends one sketch per group and rate, whatever the group's size.
    """
    good = measured.filter(~base_failed())
    sketches = [F.kll_sketch_agg_double(_rate(name)).alias(name) for name in RATES]
    own = materialize(good.groupBy("lang", "source").agg(*sketches, F.count(F.lit(1)).alias("n")), "sketches")
    merged = [F.kll_merge_agg_double(name).alias(f"_{name}") for name in RATES]
    per_lang = own.groupBy(F.col("lang").alias("_lang")).agg(*merged, F.sum("n").alias("_n"))
    over_all = own.agg(*(F.kll_merge_agg_double(name).alias(f"__{name}") for name in RATES))
    whole = over_all.first()  # a few sketches of bounded size
    chosen = own.join(per_lang, F.col("lang").eqNullSafe(F.col("_lang")))
    fences = []
    for name, (_, _, upper, lower) in RATES.items():
        everywhere = F.lit(bytes(whole[f"__{name}"])) if whole[f"__{name}"] is not None else F.lit(None).cast("binary")
        sketch = F.when(F.col("n") >= GROUP_ROWS, F.col(name)).when(F.col("_n") >= GROUP_ROWS, F.col(f"_{name}")).otherwise(everywhere)

        def quantile(at: float, sketch: Column = sketch) -> Column:
            return F.kll_sketch_get_quantile_double(sketch, F.lit(at))

        middle = quantile(0.5)
        fences.append((quantile(upper) + REACH * (quantile(upper) - middle)).alias(f"{name}_high"))
        low = F.lit(None).cast("double") if lower is None else quantile(lower) - REACH * (middle - quantile(lower))
        fences.append(low.alias(f"{name}_low"))
    return chosen.select("lang", "source", *fences)


def verdicts(measured: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``."""
    # written first: its size is known, so that Spark need not shuffle the measured rows for a few fences
    fences = materialize(thresholds(measured).withColumnsRenamed({"lang": "_lang", "source": "_source"}), "fences")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    beyond = F.lit(False)
    for name, (_, bottom, *_) in RATES.items():
        rate, high = _rate(name), F.col(f"{name}_high")
        if name in SHARES:
            n = F.when(F.col(bottom) > 0, F.col(bottom))
            high = high + REACH * F.sqrt(high * n + 1) / n
        beyond = beyond | F.coalesce(rate > high, F.lit(False)) | F.coalesce(rate < F.col(f"{name}_low"), F.lit(False))
    joined = measured.join(fences, same, "left")
    joined = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~beyond)
    return joined.select(*measured.columns, "base_failed", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    inside, back = set_apart(docs, "text", "lang", "source")
    measured = materialize(measure(inside, *inside.columns), "measured")
    return back(verdicts(measured).filter("kept"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    measured = materialize(measure(documents(spark, sf_dir), "doc_id", "lang", "source"), "measured")
    return verdicts(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
