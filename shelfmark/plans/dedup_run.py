"""The three duplicate tiers over one archive, and the plan they lead to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfmark.operators import dedup, filters, neardup
from shelfmark.operators.scoring import Scorer
from shelfmark.session import materialize
from shelfmark.settings import Settings


@dataclass(frozen=True)
class DedupRun:
    members: DataFrame
    plan: DataFrame


def run_dedup(
    files: DataFrame, settings: Settings = Settings(), judge: Scorer | None = None, sketch: bool = False
) -> DedupRun:
    """Hash and version tiers over all files, near duplicates over the rest.

    ``files``: inventory with ``text``. ``judge`` has the last word on near
    duplicates, asked until every file is settled. ``sketch`` takes MinHash
    bands instead of the exact search.
    """
    exact = dedup.hash_duplicates(files)
    versions = dedup.version_duplicates(files)
    cheap = materialize(exact.unionByName(versions), "members")
    rest = filters.ungrouped_files(files, cheap.select("path").distinct())
    block = ("parent_folder", "extension")
    if judge is not None:
        losers = neardup.judged_duplicates(rest, judge, block, settings)
    else:
        losers = (neardup.near_duplicates_lsh if sketch else neardup.near_duplicates)(rest, block, settings)
    members = materialize(cheap.unionByName(dedup.near_members(losers, files)), "members")
    return DedupRun(members, dedup.delete_plan(members))
