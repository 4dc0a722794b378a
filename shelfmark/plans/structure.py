"""Folder-structure proposal: corpus summary, one request, parsed folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import review, scoring, stats


def structure_request(files: DataFrame, context: str) -> DataFrame:
    return scoring.proposal_request(stats.scan_report(files), review.sample_names(files), context)


def proposed_folders(request: DataFrame, scorer: scoring.Scorer) -> DataFrame:
    """Folder names in the scorer's answer, with an approval column still to be set."""
    replies = scoring.score_files(request.withColumn("path", F.lit("proposal")), scorer, "path")
    lines = replies.select(F.explode(F.split("reply", "\n")).alias("line"))
    return scoring.structure_paths(lines).withColumn("approved", F.lit(False))
