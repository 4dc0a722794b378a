import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import text as X
from shelfmark.functions import versions as V


def column(spark, values, expr, type_="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {type_}").select("i", expr(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]


@pytest.mark.parametrize(
    "name, suffix, stem",
    [
        ("a.txt", ".txt", "a"),
        ("A.TXT", ".txt", "A"),
        (".bashrc", "", ".bashrc"),
        ("a.", "", "a."),
        ("a.tar.gz", ".gz", "a.tar"),
        ("noext", "", "noext"),
    ],
)
def test_suffix_and_stem(spark, name, suffix, stem):
    assert column(spark, [name], P.extension_of) == [suffix]
    assert column(spark, [name], P.stem_of) == [stem]


def test_top_level_file_is_its_own_folder(spark):
    assert column(spark, ["a.txt", "x/y/a.txt"], P.top_folder_of) == ["a.txt", "x"]
    assert column(spark, ["a.txt", "x/y/a.txt"], P.ancestor_folders) == [[], ["x", "x/y"]]


def test_size_label_rounds_like_python(spark):
    rng = random.Random(3)
    sizes = [0, 1023, 1024, 121 * 1024 + 256, 1024**5 * 3] + [rng.randrange(10**14) for _ in range(500)]

    def python_label(n):
        n = float(n)
        for unit in ("B", "KB", "MB", "GB", "TB"):
            if n < 1024:
                return f"{n:.1f} {unit}"
            n /= 1024
        return f"{n:.1f} PB"

    assert column(spark, sizes, P.size_label, "long") == [python_label(s) for s in sizes]


@pytest.mark.parametrize(
    "name, base, number, final, draft",
    [
        ("Plan_v2.docx", "plan", 2, False, False),
        ("Plan-Version 4.txt", "plan-version 4", 4, False, False),
        ("Plan_FINAL.txt", "plan", None, True, False),
        ("Plan (3).txt", "plan", 3, False, False),
        ("Plan-draft_rev12.txt", "plan", 12, False, True),
        ("Plan_v" + "9" * 50 + ".txt", "plan", None, False, False),
        ("_WIP.txt", "", None, False, True),
    ],
)
def test_version_markers(spark, name, base, number, final, draft):
    assert column(spark, [name], V.base_name) == [base]
    got = column(spark, [name], V.version_number)[0]
    assert (int(got) if got is not None else None) == number
    assert column(spark, [name], V.is_final) == [final]
    assert column(spark, [name], V.is_draft) == [draft]


def test_review_bucket_is_case_split(spark):
    paths = ["/u/Work Documents/Alpha/x", "/u/Work Documents/x", "/u/work documents/Alpha/x", "/u/Archive/x", "/u/x"]
    assert column(spark, paths, P.review_bucket) == [
        "Work Documents/Alpha",
        "Work Documents/root",
        "Work Documents",
        "Archive",
        "Drive Root",
    ]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


WORDS = st.lists(st.tuples(*[st.text(alphabet="abcd", min_size=1, max_size=9)] * 2), min_size=1, max_size=30)


@given(WORDS)
@settings(max_examples=8, deadline=None)
def test_indel_ratio_matches_plain_python(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    rows = df.select("i", X.indel_ratio(F.col("a"), F.col("b")).alias("r"), X.indel_ratio(F.col("b"), F.col("a")).alias("s"))
    for r in rows.collect():
        a, b = pairs[r["i"]]
        assert r["r"] == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))
        assert r["r"] == r["s"] and 0 <= r["r"] <= 100


def test_shingles_of_short_texts_are_empty(spark):
    sizes = column(
        spark, ["", "one two", "one two three", "a b c d"], lambda c: F.size(X.hashed_shingles(X.words(c), 3))
    )
    assert sizes == [0, 0, 1, 2]
