"""Worksheets, options and bulk decisions for rows that need a human."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import review_bucket
from shelfmark.operators.ranking import number_rows, top_per_key
from shelfmark.session import materialize
from shelfmark.settings import Settings


def worksheet(unknowns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows numbered by lower-cased name within their bucket, in pages."""
    rows = unknowns.withColumn("bucket", review_bucket(F.col("path"))).withColumn("_low", F.lower("filename"))
    numbered = number_rows(rows, ["bucket"], ["_low", "path"], "row_no").drop("_low")
    page = F.floor((F.col("row_no") - 1) / F.lit(settings.review_page_rows)) + 1
    return numbered.withColumn("page", page.cast("long"))


def worksheet_summary(unknowns: DataFrame) -> DataFrame:
    bucket = review_bucket(F.col("path"))
    return unknowns.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    )


def review_options(unknowns: DataFrame) -> DataFrame:
    """(path, letter, choice): the proposal, up to three alternatives, skip, other."""
    fixed = F.array(F.lit("Skip this file"), F.lit("Other (name a category)"))
    alternatives = F.coalesce("alternatives", F.array().cast("array<string>"))
    choices = F.concat(F.array("category"), F.slice(alternatives, 1, 3), fixed)
    return unknowns.select("path", F.posexplode(choices).alias("pos", "choice")).select(
        "path", F.char(F.lit(65) + F.col("pos")).alias("letter"), "choice"
    )


# The written forms of a bulk decision.
_LINE = r"^\s*([^:#]+?)\s*(#[0-9,\s-]+)?\s*:\s*(.+?)\s*$"
_VERB = r"(?i)^(DELETE|SKIP|MOVE)\b"
_RANGE = r"^([0-9]+)(?:\s*-\s*([0-9]+))?$"


def parse_decisions(lines: DataFrame) -> DataFrame:
    """(bucket, lo, hi, action, dest, error) from written decisions.

    ``Papers: delete all``, ``Inbox: DELETE 5-8, 11, SKIP rest`` and
    ``Inbox #3,7: Clients/West, North/`` give one row per clause or number; a
    NULL range means the whole bucket. Verbs are read in any case, and a bare
    number takes the verb before it. A body without verb, or after ``MOVE:``,
    is a destination as it stands, commas included. Whatever can't be read
    gives a row with ``error`` (the line) and no action, never a move.
    """
    bucket, body = F.regexp_extract("line", _LINE, 1), F.regexp_extract("line", _LINE, 3)
    numbers = F.regexp_replace(F.regexp_extract("line", _LINE, 2), r"[#\s]", "")
    target = F.regexp_replace(F.regexp_replace(body, r"(?i)^MOVE\s*:\s*", ""), "/+$", "")
    rows = lines.select(
        "line", bucket.alias("bucket"), numbers.alias("numbers"), target.alias("target"), F.upper(F.regexp_extract(body, _VERB, 1)).alias("verb"),
        body.rlike(r"(?i)^MOVE\s*:").alias("moves"), F.split(body, r"\s*,\s*").alias("clauses"), body.alias("body"),
    )
    to = F.col("moves") | (F.col("verb") == "")
    # a destination, for the numbers listed or the whole bucket
    places = F.when(F.col("numbers") != "", F.split("numbers", ",")).otherwise(F.array(F.lit("")))
    moved = rows.filter(to).select("line", "bucket", F.explode(places).alias("r"), F.lit("MOVE").alias("action"), "target")
    # verbs: numbers stand before the colon, or behind each verb
    before = F.col("numbers") != ""
    bare = F.upper("body").isin("DELETE", "SKIP")
    verbs = F.transform("clauses", lambda c: F.upper(F.regexp_extract(c, r"(?i)^(DELETE|SKIP)\b", 1)))
    clause = F.transform(
        "clauses",
        lambda c, i: F.struct(
            F.get(F.filter(F.reverse(F.slice(F.col("verbs"), F.lit(1), i + 1)), lambda v: v != ""), F.lit(0)).alias("action"),
            F.regexp_replace(c, r"(?i)^(DELETE|SKIP)\b\s*", "").alias("r"),
        ),
    )
    listed = F.transform(F.split("numbers", ","), lambda n: F.struct(F.when(bare, F.col("verb")).alias("action"), n.alias("r")))
    spoken = (
        rows.filter(~to)
        .withColumn("verbs", verbs)
        .select("line", "bucket", F.explode(F.when(before, listed).otherwise(clause)).alias("c"))
        .select("line", "bucket", "c.r", "c.action", F.lit(None).cast("string").alias("target"))
    )
    every = F.lower("r").isin("", "all", "rest")
    lo, hi = F.regexp_extract("r", _RANGE, 1).try_cast("int"), F.regexp_extract("r", _RANGE, 2).try_cast("int")
    both = moved.unionByName(spoken).withColumn("lo", lo).withColumn("hi", F.coalesce(hi, lo)).withColumn("every", every)
    named = F.when(F.col("action") == "MOVE", F.length("target") > 0).otherwise(F.col("action").isin("DELETE", "SKIP"))
    good = (F.col("bucket") != "") & F.coalesce(named, F.lit(False)) & (F.col("every") | (F.col("lo") <= F.col("hi")))
    good = F.coalesce(good, F.lit(False))
    return both.select(
        "bucket",
        F.when(good & ~F.col("every"), F.col("lo")).alias("lo"),
        F.when(good & ~F.col("every"), F.col("hi")).alias("hi"),
        F.when(good, F.col("action")).alias("action"),
        F.when(good, F.col("target")).alias("dest"),
        F.when(~good, F.col("line")).alias("error"),
    )


def apply_decisions(sheet: DataFrame, decisions: DataFrame) -> DataFrame:
    """The most specific decision of each worksheet row: the narrowest range wins.

    A range of width w touches at most two aligned blocks of 2^k >= w numbers,
    so ranges join rows on (bucket, k, block), one k per width class in use.
    """
    merged = decisions.filter("action is not null").groupBy("bucket", "lo", "hi").agg(F.min(F.struct("action", "dest")).alias("d"))
    width = F.col("hi") - F.col("lo") + 1
    level = F.ceil(F.log2(width)).cast("int")
    block = lambda end: F.floor(end / F.pow(F.lit(2.0), level)).cast("long")
    ranges = merged.filter("lo is not null and hi >= lo").select(
        "bucket", "lo", "hi", width.alias("width"), "d", level.alias("level"),
        F.explode(F.array_distinct(F.array(block(F.col("lo")), block(F.col("hi"))))).alias("block"),
    )
    ranges = materialize(ranges, "ranges")
    levels = sorted(r[0] for r in ranges.select("level").distinct().collect())  # at most 31
    keys = F.array(*[
        F.struct(F.lit(k).alias("level"), F.floor(F.col("row_no") / F.lit(2.0**k)).cast("long").alias("block"))
        for k in levels
    ]) if levels else F.array().cast("array<struct<level:int,block:bigint>>")
    narrow = (
        sheet.select("bucket", "row_no", "path", F.explode(keys).alias("k"))
        .select("bucket", "row_no", "path", "k.level", "k.block")
        .join(ranges, ["bucket", "level", "block"])
        .filter(F.col("row_no").between(F.col("lo"), F.col("hi")))
        .groupBy("path")
        .agg(F.min(F.struct("width", "d"))["d"].alias("narrow"))
    )
    whole = merged.filter("lo is null").groupBy("bucket").agg(F.min("d").alias("whole"))
    return (
        sheet.select("bucket", "row_no", "path")
        .join(narrow, "path", "left")
        .join(whole, "bucket", "left")
        .withColumn("d", F.coalesce("narrow", "whole"))
        .filter("d is not null")
        .select("bucket", "row_no", "path", "d.action", "d.dest")
    )


def preview_moves(moves: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` moves of every category by path, and how many more there are."""
    counts = moves.groupBy("category").agg(F.count(F.lit(1)).alias("_n"))
    return (
        top_per_key(moves, ["category"], ["path"], k)
        .join(counts, "category")
        .select("category", "rank", "filename", "confidence", F.greatest(F.col("_n") - k, F.lit(0)).alias("more"))
    )


def preview_unknowns(unknowns: DataFrame, k: int = 20) -> DataFrame:
    return unknowns.orderBy("path").limit(k).select("path", "filename", "category", "confidence")


def sample_names(files: DataFrame, k: int = 100) -> DataFrame:
    return files.orderBy("path").limit(k).select("path", "filename")
