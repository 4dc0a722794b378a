"""Text previews with a status column; failures are values, not exceptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.settings import Settings

# An extractor gets the bytes of one file and returns its text.
Extractor = Callable[[bytes], str]


@F.pandas_udf(T.StringType())
def _utf16_text(content: pd.Series) -> pd.Series:
    def decode(raw):
        if raw is None:
            return None
        try:
            return bytes(raw).decode("utf-16")
        except UnicodeDecodeError:
            return None

    return content.map(decode)


def decode_bytes(content: Column) -> Column:
    """utf-8, else utf-16 with a byte order mark, else latin-1 (never fails).

    Only rows that carry a mark reach the Python decoder.
    """
    as_text = content.cast("string")
    head = F.hex(F.substring(content, 1, 2))
    marked = F.when(~F.is_valid_utf8(as_text) & head.isin("FFFE", "FEFF"), content)
    return F.coalesce(
        F.when(F.is_valid_utf8(as_text), as_text),
        _utf16_text(marked),
        F.decode(content, "ISO-8859-1"),
    )


def strip_rtf(text: Column) -> Column:
    # fixed values: what is taken out of a rich text
    no_words = F.regexp_replace(text, r"\\[a-z]+\d*\s?", " ")
    no_braces = F.regexp_replace(no_words, r"[{}]", "")
    return F.trim(F.regexp_replace(no_braces, r"\s+", " "))


def preview_text(text: Column, extension: Column, settings: Settings = Settings()) -> Column:
    """Preview of already decoded text; NULL for formats without an extractor."""
    cut = F.substring(text, 1, settings.preview_chars)
    lines = F.slice(F.split(cut, "\n"), 1, settings.csv_preview_lines)
    rtf = F.substring(strip_rtf(F.substring(text, 1, settings.preview_chars * 2)), 1, settings.preview_chars)
    return (
        F.when(extension == ".txt", cut)
        .when(extension == ".csv", F.array_join(lines, "\n"))
        .when(extension == ".rtf", rtf)
    )


def preview_status(extension: Column, size: Column, settings: Settings = Settings()) -> Column:
    return (
        F.when(size > settings.max_content_bytes, "too_large")
        .when(extension.isin(".txt", ".csv", ".rtf"), "ok")
        .otherwise("unsupported")
    )


def text_previews(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``preview`` and ``status`` from a ``text`` column of decoded content."""
    status = preview_status(F.col("extension"), F.col("size_bytes"), settings)
    text = F.when(status == "ok", preview_text(F.col("text"), F.col("extension"), settings))
    return files.withColumn("status", status).withColumn("preview", text)


def whole_texts(files: DataFrame) -> DataFrame:
    """``preview`` as the whole decoded text; NULL for formats without an extractor."""
    text = F.when(F.col("extension").isin(".txt", ".csv"), F.col("text")).when(F.col("extension") == ".rtf", strip_rtf(F.col("text")))
    return files.withColumn("preview", text)


def binary_previews(
    files: DataFrame,
    extractors: dict[str, Extractor] | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """``preview`` and ``status`` from a binary ``content`` column.

    Built-in formats stay in Catalyst. Rows whose extension has a registered
    extractor go through one ``mapInPandas`` branch; the rest never see Python
    workers except for marked utf-16 content.
    """
    extractors = extractors or {}
    native = files.filter(~F.col("extension").isin(list(extractors)) if extractors else F.lit(True))
    decoded = F.when(
        F.col("extension") == ".rtf", F.decode("content", "ISO-8859-1")
    ).otherwise(decode_bytes(F.col("content")))
    out = text_previews(native.withColumn("text", decoded), settings).drop("text", "content")
    if not extractors:
        return out

    too_large = settings.max_content_bytes
    limit = settings.preview_chars
    keep = [c for c in files.columns if c != "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            previews, states = [], []
            for ext, size, content in zip(batch["extension"], batch["size_bytes"], batch["content"]):
                if size > too_large:
                    previews.append(None)
                    states.append("too_large")
                    continue
                try:
                    previews.append(extractors[ext](bytes(content))[:limit])
                    states.append("ok")
                except Exception as err:  # noqa: BLE001 - a bad file must not fail the job
                    previews.append(None)
                    states.append(f"failed: {err}")
            yield batch[keep].assign(status=states, preview=previews)

    kept = [T.StructField(f.name, f.dataType) for f in files.select(*keep).schema]
    schema = T.StructType(
        [*kept, T.StructField("status", T.StringType()), T.StructField("preview", T.StringType())]
    )
    custom = files.filter(F.col("extension").isin(list(extractors))).mapInPandas(run, schema)
    return out.unionByName(custom)


def read_content(spark, roots_or_paths) -> DataFrame:
    """Binary content rows keyed by path, for joins with an inventory."""
    from shelfmark.functions import paths as P

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots_or_paths)
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(
        path.alias("path"),
        P.extension_of(P.filename_of(path)).alias("extension"),
        F.col("length").alias("size_bytes"),
        "content",
    )
