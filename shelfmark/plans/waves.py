"""One processing wave from inventory to decisions, plans and worksheet rows."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.operators import categorize, decide, dedup, filters, scoring
from shelfmark.operators.entities import learn_entities, match_substrings
from shelfmark.operators.moves import move_plan
from shelfmark.operators.review import worksheet
from shelfmark.session import materialize
from shelfmark.settings import Settings
from shelfmark.sources.preview import whole_texts
from shelfmark.sources.sinks import action_rows
from shelfmark.sources.store import Store


@dataclass(frozen=True)
class Wave:
    decisions: DataFrame
    version_members: DataFrame


def accepted(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return filters.filter_extensions(filters.prune_folders(files, settings.skip_folders), settings)


def run_wave(
    files: DataFrame,
    processed: DataFrame,
    aliases: DataFrame,
    wave: int,
    at,
    scorer: scoring.Scorer = scoring.phrase_scorer,
    critic: scoring.Scorer | None = None,
    earlier: DataFrame | None = None,
    context: str = "",
    settings: Settings = Settings(),
) -> Wave:
    """Decide every pending file once.

    ``files``: inventory with a ``text`` column; ``processed``: (path, ...);
    ``aliases``: (alias, canonical, ord); ``earlier``: scored moves of earlier
    waves for sibling context; ``at``: the decision time column.

    Older versions leave first, then the rules decide, and only rows without a
    rule hit reach the scorer: their paths meet the inventory before any text
    is looked at. The scorer gets whole texts; how much of one a request shows
    is a setting of the request. The second call is made for borderline
    answers alone.
    """
    slim = accepted(files.drop("text"), settings)
    pending = filters.pending_files(slim, processed)
    versions = materialize(dedup.version_duplicates(pending), "versions")
    older = versions.filter(~F.col("is_canonical")).select("path")
    open_rows = pending.join(older, "path", "left_anti")
    decided = decide_files(files, open_rows, aliases, scorer, critic, earlier, context, settings)
    decided = decided.unionByName(older_versions(older))
    return Wave(decided.select(F.lit(wave).alias("wave"), "*", at.alias("processed_at")), versions)


#: Columns of a decision besides its wave and time.
DECISION = [
    "path", "category", "confidence", "entity_detected", "reasoning", "action", "decided_by",
    "original_category", "original_confidence", "changed_after_critique", "critique", "alternatives",
]


def _plain(rows: DataFrame, by: str) -> DataFrame:
    """Decisions made without a scorer."""
    return rows.withColumns(
        {
            "decided_by": F.lit(by),
            "original_category": F.lit(None).cast("string"),
            "original_confidence": F.lit(None).cast("int"),
            "changed_after_critique": F.lit(None).cast("boolean"),
            "critique": F.lit(None).cast("string"),
            "alternatives": F.lit(None).cast("array<string>"),
        }
    ).select(*DECISION)


def older_versions(paths: DataFrame) -> DataFrame:
    """Decisions for files (path) that a better variant replaces."""
    rows = paths.select(
        "path",
        F.lit("DELETE (older version)").alias("category"),
        F.lit(10).alias("confidence"),
        F.lit(None).cast("string").alias("entity_detected"),
        F.lit(None).cast("string").alias("reasoning"),
        F.lit("delete").alias("action"),
    )
    return _plain(rows, "version")


def decide_files(
    files: DataFrame,
    pending: DataFrame,
    aliases: DataFrame,
    scorer: scoring.Scorer = scoring.phrase_scorer,
    critic: scoring.Scorer | None = None,
    earlier: DataFrame | None = None,
    context: str = "",
    settings: Settings = Settings(),
) -> DataFrame:
    """``DECISION`` rows of ``pending`` (inventory without text), by rules, else by the scorer and the second call."""
    ruled = materialize(categorize.cascade(pending, settings), "ruled")

    columns = ["path", "category", "confidence", "entity_detected", "reasoning", "action"]
    by_rule = _plain(ruled.filter(F.col("category").isNotNull()).select(*columns), "rule")
    open_rows = ruled.filter(F.col("category").isNull()).drop(*columns[1:])
    named = match_substrings(open_rows, "filename", aliases, "path", "_entity")
    clear = categorize.signal_regex(F.col("filename")) | F.col("_entity").isNotNull()
    signal = clear & F.lit(settings.skip_content_for_clear_signals)
    named = materialize(named.withColumn("_signal", signal), "open").withColumn("preview", F.lit(None).cast("string"))
    # rows with a clear signal are decided by their names: their texts are not read
    wanted = named.filter(~F.col("_signal")).select("path")
    texts = whole_texts(files.join(wanted, "path", "left_semi")).select("path", F.col("preview").alias("_whole"))
    previews = named.join(texts, "path", "left").withColumn("preview", F.col("_whole")).drop("_whole", "_signal")
    if earlier is not None and settings.sibling_context_enabled:
        folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
        previews = scoring.sibling_context(previews.withColumn("folder", folder), earlier, "folder", settings)
    else:
        previews = previews.withColumn(
            "siblings", F.lit(None).cast("array<struct<filename:string,category:string,confidence:int>>")
        )
    asked = scoring.scoring_requests(previews, context, settings).select("path", "filename", "preview", "request")
    # a scorer may cost money: its replies are kept, never computed twice
    first = materialize(scoring.score_and_parse(asked, scorer, "path", settings=settings), "answers")
    none = F.lit(None)
    if critic is None:
        second = first.limit(0).select(
            "path",
            F.lit(False).alias("changed"),
            F.lit("").alias("final_category"),
            F.lit(0).alias("final_confidence"),
            none.cast("string").alias("critique"),
            none.cast("array<string>").alias("alternatives"),
        )
    else:
        from shelfmark import schemas

        doubtful = scoring.critique_requests(scoring.critique_rows(first, settings))
        replies = scoring.score_files(doubtful, critic, "path", settings)
        second = materialize(
            replies.select("path", decide.parse_reply(F.col("reply"), schemas.CRITIQUE).alias("r")).select(
                "path", "r.changed", "r.final_category", "r.final_confidence", "r.critique",
                F.col("r.alternative_interpretations").alias("alternatives"),
            ),
            "critiques",
        )
    scored = decide.decide(first, second, "path", settings).withColumn("decided_by", F.lit("scorer"))
    return by_rule.unionByName(scored.select(*DECISION))


def run_stored_wave(
    store: Store,
    arrived: DataFrame,
    wave: int,
    aliases: DataFrame,
    at,
    scorer: scoring.Scorer = scoring.phrase_scorer,
    critic: scoring.Scorer | None = None,
    context: str = "",
    settings: Settings = Settings(),
    written: Callable[[str], None] = lambda kind: None,
) -> None:
    """Decide what has arrived and write every table of the wave to ``store``.

    ``arrived``: inventory with ``text``. Earlier waves give the files already
    decided, the names learned, the siblings, the destinations in use and the
    best variant of every version group. A file that is no better than it is an
    older version; one that is better displaces it, and the earlier winner
    gets a new decision in this wave. So the latest decisions don't depend on
    the order of arrival. All rows are written under the wave's number, and
    only earlier waves are read: an attempt that failed half-way is written
    over. ``written`` is told each table that is done.

    The wave's measures (files and bytes arrived, decisions, failed calls, seconds)
    are observed while its tables are written, without another pass.
    """
    spark, began = arrived.sparkSession, time.monotonic()
    came, made = Observation(), Observation()

    def put(kind: str, rows: DataFrame) -> None:
        store.put(kind, rows, wave)
        written(kind)

    slim = accepted(arrived.drop("text"), settings)
    known = store.before("decisions", wave, spark).select("path")
    pending = slim.join(known, "path", "left_anti")
    n = F.count(F.lit(1))
    pending = materialize(pending.observe(came, n.alias("arrived"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")), "pending")
    put("files", pending)

    keys = dedup.version_keys(pending)
    order = F.struct(*dedup.VERSION_ORDER, "path")
    new_best = keys.groupBy("group_key").agg(F.min(order).alias("best"))
    new_best = materialize(new_best, "best")
    # the table holds one row per group and wave: its minimum is the best so far
    old_best = store.before("variants", wave, spark).groupBy("group_key").agg(F.min(order).alias("old"))
    both = new_best.join(old_best, "group_key", "left").withColumn("winner", F.least("best", "old"))
    both = materialize(both, "winners")
    put("variants", new_best.select("group_key", "best.*"))
    winners = both.select("group_key", F.col("winner.path").alias("winner"))
    older = keys.join(winners, "group_key").filter(F.col("path") != F.col("winner")).select("path")
    older = materialize(older, "older")
    displaced = both.filter("old.path <> winner.path").select(F.col("old.path").alias("path"))

    before = store.before("decisions", wave, spark)
    moved = before.filter("action = 'move' and decided_by = 'scorer'")
    earlier = moved.select(
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
        "category", "confidence", "processed_at", "path",
    )
    learned = store.before("names", wave, spark)
    names = learned.select((F.lit(1 << 30) + F.col("wave")).cast("int").alias("ord"), F.lower("name").alias("alias"), F.col("name").alias("canonical"))
    every = aliases.select(F.col("ord").cast("int").alias("ord"), "alias", "canonical").unionByName(names)
    open_rows = pending.join(older, "path", "left_anti")
    decided = decide_files(arrived, open_rows, every, scorer, critic, earlier, context, settings)
    decided = decided.unionByName(older_versions(older.unionByName(displaced)))
    # scorers are asked once: everything below reads what is written here
    failed = F.count_if((F.col("decided_by") == "scorer") & F.col("reasoning").startswith("Error:"))
    decided = materialize(decided.withColumn("processed_at", at).observe(made, n.alias("decided"), failed.alias("errors")), "decided")
    put("decisions", decided)

    put("names", materialize(learn_entities(decided, aliases, learned), "names"))
    attributes = pending.select("path", "filename", "size_bytes")
    moves = decided.filter("action = 'move'").select("path", "category").join(attributes, "path")
    used = store.before("moves", wave, spark).select("category", F.regexp_extract("dest", r"([^/]*)$", 1).alias("filename"))
    planned = materialize(move_plan(moves.select("path", "category", "filename"), used, settings.archive_root), "moves")
    put("moves", planned)
    deletes = decided.filter("action = 'delete'").select("path")
    put("log", action_rows(planned, "MOVE", "path", "dest", at).unionByName(action_rows(deletes, "DELETE", "path", None, at)))
    unsure = decided.filter("action not in ('move', 'skip', 'delete')").select("path", "category", "alternatives").join(attributes, "path")
    put("worksheet", worksheet(unsure, settings))
    measures = {**came.get, **made.get, "seconds": time.monotonic() - began}
    put("waves", spark.range(1).select(*(F.lit(v).alias(k) for k, v in measures.items())))
