"""Small tables with odd rows for the operators of the folder."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the and erin thon ouble stand hether édouard über niño wh- 2021 lines,".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "ing", "ed", "."]) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = prose(1, 80)
    texts = [
        base,
        base,
        base.replace("the", "one", 1),
        "",
        None,
        " \t\n ",
        "a",
        "Mail x.y@example.com or +1 (555) 555-0100, card 4111 1111 1111 1111, host 10.0.0.1.",
        "one two three four five six seven eight nine\none two three four five six seven eight ten\n\nshort\nshort",
        "one two three four five six seven eight nine ten",
        "x" * 3000 + " <|endoftext|> " + "日本語 🙂 é",
        prose(2, 6000),
        "| # $ % & < > * |" * 20,
        "same words " * 60,
    ]
    rows = [(i, t, "en", f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(i, prose(i, 70), "fr" if i % 2 else None, None, None) for i in range(20, 32)]
    return [*rows, (31, prose(31, 70), "fr", None, None), (None, base, None, None, None), (None, None, None, None, None)]


def odd_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


#: Names that operators use for columns of their own.
CLASHES = ["fp", "ids", "n_words", "kept", "base_failed", "spans", "n_lines", "_row", "_order", "_base", "places", "range", "component_id", "score", "length"]


def with_clashes(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"mine {c}") for c in CLASHES})


def as_table(spark: SparkSession, docs: DataFrame, folder) -> str:
    """A folder that holds ``docs`` as its documents table."""
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)
