"""Counts and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import size_label, top_folder_of
from shelfmark.operators.ranking import top_per_key


def scan_totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("bytes"),
        F.min("modified_time").alias("earliest"),
        F.max("modified_time").alias("latest"),
    )


def histograms(files: DataFrame, keys: dict[str, Column], k: int = 15) -> DataFrame:
    """(kind, rank, key, n): top ``k`` keys per kind (ties by key), one scan for all kinds.

    A last row per kind holds the number of keys beyond ``k``.
    """
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in keys.items()])
    counts = (
        files.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.key").agg(F.count(F.lit(1)).alias("n"))
    )
    top = top_per_key(counts, ["kind"], [F.desc("n"), F.col("key")], k)
    # the sum keeps n in this branch, so that both read the same exchange
    other = (
        counts.groupBy("kind")
        .agg((F.count(F.lit(1)) - k).alias("more"), F.sum("n").alias("total"))
        .filter("more > 0 and total > 0")
        .select("kind", F.lit(k + 1).alias("rank"), F.lit("(other keys)").alias("key"), F.col("more").alias("n"))
    )
    return top.select("kind", "rank", "key", "n").unionByName(other)


def scan_histograms(files: DataFrame, k: int = 15) -> DataFrame:
    return histograms(
        files, {"extension": F.col("extension"), "folder": top_folder_of(F.col("relative_path"))}, k
    )


def scan_report(files: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(section, line_no, line) of the scan summary."""
    totals = scan_totals(files).select(
        F.lit(0).alias("section"),
        F.posexplode(
            F.array(
                F.concat(F.lit("Files: "), F.col("files").cast("string")),
                F.concat(F.lit("Size: "), size_label(F.col("bytes"))),
                F.concat(
                    F.lit("Dates: "), F.date_format("earliest", "yyyy-MM-dd"),
                    F.lit(" to "), F.date_format("latest", "yyyy-MM-dd"),
                ),
            )
        ).alias("line_no", "line"),
    )
    bars = scan_histograms(files).select(
        F.when(F.col("kind") == "extension", 1).otherwise(2).alias("section"),
        F.col("rank").alias("line_no"),
        F.concat_ws(": ", F.col("key"), F.col("n").cast("string")).alias("line"),
    )
    out = totals.unionByName(bars)
    if errors is not None:
        lines = errors.select(F.lit(3).alias("section"), F.lit(0).alias("line_no"), F.col("message").alias("line"))
        out = out.unionByName(lines)
    return out


def move_category(dest: Column, root: str) -> Column:
    """Folder of a destination below the archive root; ``Root`` at its top level."""
    prefix = root.rstrip("/") + "/"
    inner = F.substring(dest, F.lit(len(prefix) + 1), F.length(dest))
    folder = F.regexp_extract(inner, r"^(.*)/[^/]*$", 1)
    return F.when(~F.startswith(dest, F.lit(prefix)), "Unknown").when(folder == "", "Root").otherwise(folder)


def run_summary(decisions: DataFrame) -> DataFrame:
    """Rows per wave and action with sub-totals (NULL wave or action)."""
    return (
        decisions.rollup("wave", "action")
        .agg(F.count(F.lit(1)).alias("files"))
        .select("wave", "action", "files")
    )


def category_summary(moves: DataFrame, root: str) -> DataFrame:
    """Moved files per category."""
    return moves.groupBy(move_category(F.col("dest"), root).alias("category")).agg(
        F.count(F.lit(1)).alias("files")
    )


def dedup_report(members: DataFrame, plan: DataFrame) -> DataFrame:
    """(section, group_key, line_no, line): one block of lines per duplicate group.

    A line per member, ordered by (kept first, path); a group of any size stays
    rows, it is never gathered into one value.
    """
    section = (
        F.when(F.col("method") == "hash", "1 exact").when(F.col("method") == "pattern", "2 versions").otherwise("3 near")
    )
    score = F.when(
        F.col("similarity").isNotNull(),
        F.concat(F.lit(" (similarity "), F.round(F.col("similarity") * 100, 0).cast("int").cast("string"), F.lit("%)")),
    )
    line = F.when(F.col("is_canonical"), F.concat(F.lit("keep "), "path")).otherwise(
        F.concat(F.lit("delete "), F.col("path"), F.coalesce(score, F.lit("")))
    )
    body = members.select(
        section.alias("section"), "group_key", F.when(F.col("is_canonical"), 0).otherwise(1).alias("line_no"), line.alias("line")
    )
    head = plan.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b")
    ).select(
        F.lit("0 totals").alias("section"),
        F.lit("").alias("group_key"),
        F.posexplode(
            F.array(
                F.concat(F.lit("Files to delete: "), F.col("n").cast("string")),
                F.concat(F.lit("Space to save: "), size_label(F.col("b"))),
            )
        ).alias("line_no", "line"),
    )
    return head.unionByName(body)


def wave_metrics(waves: DataFrame) -> DataFrame:
    """(wave, arrived, bytes, decided, errors, seconds, files_per_second) per wave and, with a null wave, over all of them."""
    sums = [F.sum(c).alias(c) for c in ("arrived", "bytes", "decided", "errors", "seconds")]
    totals = waves.rollup("wave").agg(*sums)
    speed = F.when(F.col("seconds") > 0, F.col("arrived") / F.col("seconds"))
    return totals.withColumn("files_per_second", speed)
