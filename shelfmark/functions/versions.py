"""Version markers in file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.paths import stem_of

# Marker patterns, applied in this order.
VERSION_PATTERNS = (
    r"[_\-\s]v(\d+)",
    r"[_\-\s]V(\d+)",
    r"[_\-\s]version[_\-\s]?(\d+)",
    r"\s?\((\d+)\)",
    r"[_\-\s]r(\d+)",
    r"[_\-\s]rev[_\-\s]?(\d+)",
)
FINAL_WORDS = ("FINAL", "final", "Final", "APPROVED", "approved")
DRAFT_WORDS = ("DRAFT", "draft", "Draft", "WIP", "wip")


def base_name(filename: Column) -> Column:
    """Lower-cased stem without markers. Stripping is case-sensitive."""
    patterns = [*VERSION_PATTERNS, *(rf"[_\-\s]{w}" for w in FINAL_WORDS + DRAFT_WORDS), r"[_\-\s]+$"]
    return F.lower(reduce(lambda c, p: F.regexp_replace(c, p, ""), patterns, stem_of(filename)))


def version_number(filename: Column) -> Column:
    """First number any pattern finds, case-insensitively; NULL beyond 38 digits."""
    found = [F.nullif(F.regexp_extract(filename, "(?i)" + p, 1), F.lit("")) for p in VERSION_PATTERNS]
    return F.coalesce(*found).try_cast("decimal(38,0)")


def is_final(filename: Column) -> Column:
    return filename.rlike(r"[_\-\s](" + "|".join(FINAL_WORDS) + ")")


def is_draft(filename: Column) -> Column:
    return filename.rlike(r"[_\-\s](" + "|".join(DRAFT_WORDS) + ")")
