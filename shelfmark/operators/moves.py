"""Destination planning, folder listings, and folders left empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.operators.ranking import number_rows
from shelfmark.session import materialize


def move_plan(moves: DataFrame, archive: DataFrame, root: str) -> DataFrame:
    """(path, category, filename, dest): a free name for every move.

    ``moves``: (path, category, filename); ``archive``: (category, filename) of
    files already there. The first mover of a name (by path) takes it if the
    archive has no such file; the others take ``stem_1``, ``stem_2``, ... and
    skip every name that the archive or another mover's own name occupies.

    Only names that clash are ranked. A family of clashing names may hold any
    number of files: positions come from a distributed ranking.
    """
    names = moves.groupBy("category", "filename").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("first")
    )
    present = archive.select("category", "filename").distinct().withColumn("taken", F.lit(True))
    named = names.join(present, ["category", "filename"], "left").withColumn(
        "taken", F.coalesce("taken", F.lit(False))
    )
    # one row per destination name; four steps below read it
    named = materialize(named, "names")
    tagged = moves.join(named, ["category", "filename"])
    literal = ~F.col("taken") & (F.col("path") == F.col("first"))
    plain = tagged.filter(literal).select("path", "category", "filename", F.col("filename").alias("new_name"))

    # names in use: the archive and every mover that keeps its own name
    in_use = present.select("category", "filename").unionByName(
        named.filter(~F.col("taken")).select("category", "filename")
    )
    overflow = tagged.filter(~literal).select("path", "category", "filename")
    numbered = number_rows(overflow, ["category", "filename"], ["path"], "i")
    families = named.filter(F.col("taken") | (F.col("n") > 1)).select("category", "filename")
    slots = materialize(_occupied_slots(in_use, families).distinct(), "slots")
    placed = _free_slots(numbered, slots)
    suffix = P.raw_suffix(F.col("filename"))
    renamed = placed.select(
        "path",
        "category",
        "filename",
        F.concat(P.stem_of(F.col("filename")), F.lit("_"), F.col("slot").cast("string"), suffix).alias("new_name"),
    )
    dest = F.concat_ws("/", F.lit(root.rstrip("/")), "category", "new_name")
    return plain.unionByName(renamed).select("path", "category", "filename", dest.alias("dest"))


def _occupied_slots(in_use: DataFrame, families: DataFrame) -> DataFrame:
    """(category, filename, k): numbered names of a clashing family that are in use."""
    name = F.col("filename")
    stem, suffix = P.stem_of(name), P.raw_suffix(name)
    parsed = in_use.select(
        "category",
        F.concat(F.regexp_extract(stem, r"^(.*)_([1-9][0-9]*)$", 1), suffix).alias("family"),
        F.regexp_extract(stem, r"^(.*)_([1-9][0-9]*)$", 2).try_cast("long").alias("k"),
    ).filter("k is not null")
    return parsed.select("category", F.col("family").alias("filename"), "k").join(
        families, ["category", "filename"], "left_semi"
    )


def _free_slots(numbered: DataFrame, slots: DataFrame) -> DataFrame:
    """The i-th free number of each family as ``slot``.

    With the occupied numbers sorted as o_1 < o_2 < ..., number o_j comes before
    every file whose position is at least o_j - (j - 1). In the two lists
    merged on that, the place of a file is its number: a second distributed
    ranking.
    """
    if slots.isEmpty():
        return numbered.withColumnRenamed("i", "slot")
    taken = number_rows(slots, ["category", "filename"], ["k"], "j")
    marks = taken.select(
        "category",
        "filename",
        F.lit(None).cast("string").alias("path"),
        (F.col("k") - F.col("j") + 1).alias("at"),
        F.lit(0).alias("kind"),
        F.col("j").alias("tie"),
    )
    files = numbered.select(
        "category", "filename", "path", F.col("i").alias("at"), F.lit(1).alias("kind"), F.col("i").alias("tie")
    )
    touched = marks.select("category", "filename").distinct()
    free = files.join(touched, ["category", "filename"], "left_anti").select(
        "path", "category", "filename", F.col("at").alias("slot")
    )
    busy = files.join(touched, ["category", "filename"], "left_semi")
    merged = number_rows(busy.unionByName(marks), ["category", "filename"], ["at", "kind", "tie"], "slot")
    return free.unionByName(merged.filter("kind = 1").select("path", "category", "filename", "slot"))


def archive_folders(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Every folder of an archive: all ancestors of its files, plus listed empty ones."""
    folders = files.select(F.explode(P.ancestor_folders(F.col("relative_path"))).alias("folder"))
    if manifest is not None:
        folders = folders.unionByName(manifest.select("folder"))
    return folders.distinct()


def empty_folders(
    files: DataFrame, gone: DataFrame, manifest: DataFrame | None = None, cascade: bool = True
) -> DataFrame:
    """Folders without any file once the ``gone`` paths have left.

    ``cascade`` follows removals up to the parents; a dry run only reports
    folders that hold neither files nor folders to begin with.
    """
    folders = archive_folders(files, manifest)
    if cascade:
        kept = files.join(gone.select("path").distinct(), "path", "left_anti")
        return folders.join(archive_folders(kept), "folder", "left_anti")
    parents = folders.select(F.regexp_extract("folder", r"^(.*)/[^/]*$", 1).alias("folder"))
    with_files = files.select(F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1).alias("folder"))
    return folders.join(parents.unionByName(with_files).distinct(), "folder", "left_anti")
