"""Row filters and routing over an inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.settings import Settings


def prune_folders(files: DataFrame, names: Sequence[str] = Settings().skip_folders) -> DataFrame:
    """Drop files beneath a folder with a skip name; the root itself is not tested."""
    return files.filter(~P.has_folder(F.col("relative_path"), names))


def accepts_extension(extension: Column, deny: Sequence[str], allow: Sequence[str]) -> Column:
    """Deny wins over allow; an empty allow list accepts every extension."""
    keep = ~extension.isin([d.lower() for d in deny]) if deny else F.lit(True)
    return keep & extension.isin([a.lower() for a in allow]) if allow else keep


def filter_extensions(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return files.filter(
        accepts_extension(F.col("extension"), settings.skip_extensions, settings.process_extensions)
    )


def cleanup_route(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``route``: noisy or already archived folders go to cleanup, the rest to scoring."""
    noisy = P.has_folder(F.col("relative_path"), settings.cleanup_folders)
    archived = P.has_folder(F.col("relative_path"), settings.archived_folders)
    return files.withColumn("route", F.when(noisy | archived, "cleanup").otherwise("score"))


def pending_files(files: DataFrame, processed: DataFrame, key: str = "path") -> DataFrame:
    return files.join(processed.select(key), key, "left_anti")


def ungrouped_files(files: DataFrame, members: DataFrame) -> DataFrame:
    """Files that are in no earlier duplicate tier, as canonical or as duplicate."""
    return files.join(members.select("path"), "path", "left_anti")


def category_allowed(category: Column, allowed: Sequence[str]) -> Column:
    """Exact category or a sub-category of an allowed one."""
    names = F.array(*[F.lit(a) for a in allowed])
    return F.exists(names, lambda a: (category == a) | F.startswith(category, F.concat(a, F.lit("/"))))


def validate_categories(decisions: DataFrame, allowed: DataFrame) -> DataFrame:
    """``is_allowed`` against an allow-list table (column ``category``) of any size.

    A category is allowed when one of its own leading paths is on the list, so
    the prefix test becomes an equi-join on distinct categories.
    """
    cats = decisions.select("category").distinct()
    parts = F.split("category", "/")
    heads = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    good = (
        cats.select("category", F.explode(heads).alias("head"))
        .join(allowed.select(F.col("category").alias("head")).distinct(), "head", "left_semi")
        .select("category")
        .distinct()
        .withColumn("is_allowed", F.lit(True))
    )
    return decisions.join(good, "category", "left").withColumn(
        "is_allowed", F.coalesce("is_allowed", F.lit(False))
    )
