"""Text measures: words, shingles, edit similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Non-empty words split on ASCII white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def hashed_shingles(word_array: Column, width: int) -> Column:
    """64-bit hashes of overlapping word n-grams, from ``width`` shifted slices.

    Zipping whole slices keeps the word array evaluated once; indexing it in a
    lambda would split the text again for every element. Words are hashed
    before they are joined, so no n-gram string is ever built.
    """
    count = F.greatest(F.size(word_array) - (width - 1), F.lit(0))
    hashes = F.transform(word_array, lambda w: F.xxhash64(w))
    out = F.slice(hashes, F.lit(1), count)
    for shift in range(1, width):
        out = F.zip_with(
            out, F.slice(hashes, F.lit(shift + 1), count), lambda a, b: F.xxhash64(a, b)
        )
    return out


def lcs_length(left: Column, right: Column) -> Column:
    """Longest common subsequence length of two strings.

    A fold over the letters of ``left``; the accumulator is one row of the
    usual table (prefixed by 0). Interpreted, so feed it few, short pairs.
    """
    a, b = F.split(left, ""), F.split(right, "")
    zero = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def next_row(row: Column, letter: Column) -> Column:
        diagonal = F.slice(row, F.lit(1), F.size(b))
        above = F.slice(row, F.lit(2), F.size(b))
        cell = F.zip_with(
            F.zip_with(b, diagonal, lambda x, d: F.when(x == letter, d + 1).otherwise(F.lit(0))),
            above,
            lambda take, up: F.greatest(take, up),
        )
        # running maximum turns the cell candidates into the new row
        return F.aggregate(
            cell,
            F.array(F.lit(0)),
            lambda acc, c: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), c))),
        )

    return F.element_at(F.aggregate(a, zero, next_row), -1)


def indel_ratio(left: Column, right: Column) -> Column:
    """200 * LCS / (len a + len b), 0..100."""
    total = F.length(left) + F.length(right)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(left, right) / total)
