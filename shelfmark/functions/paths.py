"""Columns derived from path strings and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.settings import OTHER_AREA, REVIEW_AREAS, SPLIT_AREAS


def _slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def filename_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def raw_suffix(filename: Column) -> Column:
    """Last suffix with its dot; names such as ``.bashrc`` or ``a.`` have none."""
    return F.regexp_extract(filename, r"[^.](\.[^.]+)$", 1)


def extension_of(filename: Column) -> Column:
    return F.lower(raw_suffix(filename))


def stem_of(filename: Column) -> Column:
    return F.substring(filename, F.lit(1), F.length(filename) - F.length(raw_suffix(filename)))


def parent_path_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def parent_name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def top_folder_of(relative_path: Column) -> Column:
    """First path component; a file at the top counts as its own folder."""
    return F.element_at(F.split(relative_path, "/"), 1)


def folder_components(relative_path: Column) -> Column:
    parts = F.split(F.lower(relative_path), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def has_folder(relative_path: Column, names: tuple[str, ...] | list[str]) -> Column:
    """True when a folder above the file carries one of ``names`` (any case)."""
    if not names:
        return F.lit(False)
    wanted = F.array(*[F.lit(n.lower()) for n in names])
    return F.arrays_overlap(folder_components(relative_path), wanted)


def ancestor_folders(relative_path: Column) -> Column:
    """Every folder above the file, outermost first; empty for top-level files."""
    parts = F.split(relative_path, "/")
    depth = F.size(parts) - 1
    return F.when(
        depth >= 1,
        F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")),
    ).otherwise(F.array().cast("array<string>"))


def size_label(size: Column) -> Column:
    """1024-step label with one decimal, ties to even like C's ``%.1f``."""
    value = size.cast("double")
    units = ["B", "KB", "MB", "GB", "TB"]
    label = None
    for power, unit in enumerate(units):
        scaled = value / F.lit(float(1024**power))
        text = F.format_string(f"%.1f {unit}", F.bround(scaled, 1))
        limit = value < F.lit(float(1024 ** (power + 1)))
        label = F.when(limit, text) if label is None else label.when(limit, text)
    return label.otherwise(F.format_string("%.1f PB", F.bround(value / F.lit(float(1024**5)), 1)))


def review_bucket(path: Column, areas=REVIEW_AREAS, split=SPLIT_AREAS, other: str = OTHER_AREA) -> Column:
    """Label of the area a file lies in; first matching area wins."""
    norm = _slashes(path)
    low = F.lower(norm)
    hits = F.filter(F.array(*[F.when(low.contains(part), label) for part, label in areas]), lambda x: x.isNotNull())
    area = F.coalesce(F.get(hits, F.lit(0)), F.lit(other))
    for name in split:
        below = F.get(F.split(norm, f"{name}/"), F.lit(1))
        folder = F.when(below.contains("/"), F.substring_index(below, "/", 1)).otherwise("root")
        area = F.when((area == name) & below.isNotNull(), F.concat(F.lit(f"{name}/"), folder)).otherwise(area)
    return area
