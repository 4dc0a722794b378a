"""Append-only tables and report text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(lines: DataFrame, path: str, by: str | None = None) -> None:
    """One folder of text per report: lines sorted, sections in order.

    ``lines`` has (section, line_no, line), for reports in groups also
    (group_key, path), and, with ``by``, a report key such as the wave. Range partitioning keeps a large report in many files whose
    names sort in line order.
    """
    keys = [by] if by else []
    # groups stay together; equal line numbers of a group are told apart by path
    order = [*keys, *(c for c in ("section", "group_key", "line_no", "path") if c in lines.columns), "line"]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = ordered.select(*keys, F.col("line").alias("value")).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def action_rows(
    plan: DataFrame, verb: str, source: str, dest: str | None, at, dry_run: bool = False
) -> DataFrame:
    """Log rows for planned or performed actions; a dry run says WOULD."""
    names = {"MOVE": "MOVED", "DELETE": "DELETED", "REMOVE FOLDER": "REMOVED FOLDER"}
    action = f"WOULD {verb}" if dry_run else names[verb]
    return plan.select(
        F.lit(action).alias("action"),
        F.col(source).alias("source"),
        (F.col(dest) if dest else F.lit(None).cast("string")).alias("dest"),
        F.lit("ACTION").alias("level"),
        at.alias("ts"),
    )


def log_line(row_action="action", source="source", dest="dest", level="level", ts="ts"):
    """Text form of one log row."""
    arrow = F.concat(F.lit(" -> "), F.col(dest))
    return F.concat(
        F.lit("["),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.lit("] ["),
        F.col(level),
        F.lit("] "),
        F.col(row_action),
        F.lit(": "),
        F.col(source),
        F.coalesce(arrow, F.lit("")),
    )


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)
