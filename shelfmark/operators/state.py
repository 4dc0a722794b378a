"""Decision state: append-only rows, latest row per path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """One row per path: the one of the highest wave, then the latest time."""
    others = [c for c in decisions.columns if c != "path"]
    order = [c for c in ("wave", "processed_at") if c in others]
    rest = [c for c in others if c not in order]
    return (
        decisions.groupBy("path")
        .agg(F.max(F.struct(*order, *rest)).alias("d"))
        .select("path", *[F.col(f"d.{c}").alias(c) for c in others])
    )


def unknowns_by_wave(decisions: DataFrame) -> DataFrame:
    """Paths that each wave left for review, as that wave saw them."""
    return decisions.filter(~F.col("action").isin("move", "skip", "delete")).select("wave", "path")
