"""Queries: destinations, previews, reviews, summaries, waves."""

from __future__ import annotations

from functools import partial

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from shelfmark.checks import inputs as I
from shelfmark.checks import rule_sql as R
from shelfmark.checks.files import phrase_sql
from shelfmark.checks.duplicates import version_members
from shelfmark.checks.files import PATH_RULES, GENERIC_RULES, CLEAR_SIGNALS_SQL
from shelfmark.checks.registry import query
from shelfmark.operators import moves, review, stats
from shelfmark.plans import waves
from shelfmark.session import scratch_path
from shelfmark.sources.store import Store
from shelfmark.streaming.waves import run_arrivals

CLASHING = (
    "concat('Report ', cast(doc_id % 50 as string), case when doc_id % 7 = 0 then concat('_', doc_id % 4) else '' end, "
    "case when doc_id % 5 = 0 then '' else '.txt' end)"
)
MOVES = f"""moves as (select path, case doc_id % 3 when 0 then 'Customers/Acme' when 1 then 'HR' else 'Misc' end as category,
      {CLASHING} as filename from inv where doc_id % 2 = 0)"""
ARCHIVE = f"""archive as (select distinct case doc_id % 3 when 0 then 'Customers/Acme' when 1 then 'HR' else 'Misc' end as category,
      {CLASHING} as filename from inv where doc_id % 2 = 1 and doc_id % 11 < 3)"""


def _moves(spark, sf):
    category = F.expr("case doc_id % 3 when 0 then 'Customers/Acme' when 1 then 'HR' else 'Misc' end")
    rows = I.inv(spark, sf).select("doc_id", "path", category.alias("category"), F.expr(CLASHING).alias("filename"))
    return rows.filter("doc_id % 2 = 0").drop("doc_id"), rows.filter("doc_id % 2 = 1 and doc_id % 11 < 3").select(
        "category", "filename"
    )


@query(
    "move_plan",
    I.sql(
        f"""select path, category, filename, '/archive/' || category || '/' || filename as dest from own where literal
        union all select o.path, o.category, o.filename, '/archive/' || o.category || '/' || {R.stem('o.filename')}
          || '_' || f.k || regexp_extract(o.filename, '[^.](\\.[^.]+)$', 1)
        from over_rows o join free f on f.category = o.category and f.filename = o.filename and f.i = o.i""",
        I.INV,
        MOVES,
        ARCHIVE,
        """own as (select *, not taken and rn = 1 as literal from (
          select m.*, row_number() over (partition by m.category, m.filename order by path) as rn,
            a.filename is not null as taken
          from moves m left join archive a on a.category = m.category and a.filename = m.filename))""",
        "in_use as (select category, filename from archive union select category, filename from own where literal)",
        "over_rows as (select *, row_number() over (partition by category, filename order by path) as i from own where not literal)",
        f"""free as (select category, filename, k, row_number() over (partition by category, filename order by k) as i from (
          select f.category, f.filename, k from (select category, filename, unnest(range(1, n + 200)) as k from (
            select category, filename, count(*) as n from over_rows group by all)) f
          where not exists (select 1 from in_use u where u.category = f.category
            and u.filename = {R.stem('f.filename')} || '_' || k || regexp_extract(f.filename, '[^.](\\.[^.]+)$', 1))))""",
    ),
)
def move_plan(spark, sf):
    planned, archive = _moves(spark, sf)
    return moves.move_plan(planned, archive, "/archive")


@query(
    "archive_folders",
    I.sql(
        """select distinct array_to_string(parts[1:i], '/') as folder from (
          select string_split(relative_path, '/') as parts, unnest(range(1, len(string_split(relative_path, '/')))) as i
          from (select relative_path from inv union all select relative_path from order_files))""",
        I.INV,
        I.ORDER_FILES,
    ),
)
def archive_folders(spark, sf):
    files = I.inv(spark, sf).select("relative_path").unionByName(I.order_files(spark, sf).select("relative_path"))
    return moves.archive_folders(files)


GONE = "gone as (select path from inv where folder in ('Downloads', 'Finance/2023') or doc_id % 12 = 8 or size_bytes < 50000)"
FOLDERS = """folders as (select distinct array_to_string(parts[1:i], '/') as folder from (
    select string_split(relative_path, '/') as parts, unnest(range(1, len(string_split(relative_path, '/')))) as i from inv)
  union select 'Empty/' || source from documents union select 'Empty' from documents)"""


@query(
    "empty_folders",
    I.sql(
        """select 'cascade' as mode, folder from folders f where not exists (
            select 1 from inv i where i.path not in (select path from gone) and starts_with(i.relative_path, f.folder || '/'))
        union all select 'dry', folder from folders f where not exists (
            select 1 from inv i where starts_with(i.relative_path, f.folder || '/'))
          and not exists (select 1 from folders g where starts_with(g.folder, f.folder || '/'))""",
        I.INV,
        GONE,
        FOLDERS,
    ),
)
def empty_folders(spark, sf):
    files = I.inv(spark, sf)
    gone = files.filter("folder in ('Downloads', 'Finance/2023') or doc_id % 12 = 8 or size_bytes < 50000")
    manifest = I.table(spark, sf, "documents").select(
        F.explode(F.array(F.lit("Empty"), F.concat(F.lit("Empty/"), "source"))).alias("folder")
    )
    full = moves.empty_folders(files, gone, manifest).select(F.lit("cascade").alias("mode"), "folder")
    dry = moves.empty_folders(files, gone, manifest, cascade=False).select(F.lit("dry").alias("mode"), "folder")
    return full.unionByName(dry)


@query(
    "preview_topk",
    I.sql(
        """select 'move' as part, category, rank, filename, confidence, greatest(n - 10, 0) as more from (
            select *, row_number() over (partition by category order by path) as rank, count(*) over (partition by category) as n
            from processed_files where action = 'move') where rank <= 10
        union all select 'unknown', category, null, filename, confidence, null from (
          select * from processed_files where action = 'unknown' order by path limit 20)
        union all select 'sample', null, null, filename, null, null from (select * from inv order by path limit 100)""",
        I.INV,
        I.PROCESSED,
        I.PROCESSED_FILES,
    ),
)
def preview_topk(spark, sf):
    rows = I.processed_files(spark, sf)
    top = review.preview_moves(rows.filter("action = 'move'")).withColumn("part", F.lit("move"))
    unknown = review.preview_unknowns(rows.filter("action = 'unknown'")).drop("path").withColumn("part", F.lit("unknown"))
    sample = review.sample_names(I.inv(spark, sf)).drop("path").withColumn("part", F.lit("sample"))
    return top.unionByName(unknown, True).unionByName(sample, True)


SHEET = f"""sheet as (select *, row_number() over (partition by bucket order by lower(filename), path) as row_no
    from (select *, {R.review_bucket('path')} as bucket from inv))"""


@query(
    "review_worksheet",
    I.sql("select bucket, row_no, (row_no - 1) // 100 + 1 as page, path, filename from sheet", I.INV, SHEET),
)
def review_worksheet(spark, sf):
    return review.worksheet(I.inv(spark, sf).drop("text")).select("bucket", "row_no", "page", "path", "filename")


@query(
    "review_summary",
    I.sql(
        f"""select bucket, count(*) as files, cast(sum(size_bytes) as bigint) as bytes,
          {R.size_label('sum(size_bytes)')} as label from sheet group by bucket""",
        I.INV,
        SHEET,
    ),
)
def review_summary(spark, sf):
    from shelfmark.functions.paths import size_label

    return review.worksheet_summary(I.inv(spark, sf)).withColumn("label", size_label(F.col("bytes")))


ALTERNATIVES = "case doc_id % 4 when 0 then null when 1 then array('HR') when 2 then array('HR', 'Misc') " \
    "else array('A', 'B', 'C', 'D') end"


@query(
    "review_options",
    I.sql(
        f"""select path, chr(64 + pos::int) as letter, choices[pos] as choice from (
          select path, choices, unnest(range(1, len(choices) + 1)) as pos from (select path,
            [folder] || coalesce(list_slice({ALTERNATIVES.replace('array(', 'list_value(')}, 1, 3), []::varchar[])
              || ['Skip this file', 'Other (name a category)'] as choices from inv))""",
        I.INV,
    ),
)
def review_options(spark, sf):
    rows = I.inv(spark, sf).select("path", F.col("folder").alias("category"), F.expr(ALTERNATIVES).alias("alternatives"))
    return review.review_options(rows)


@query(
    "apply_review",
    I.sql(
        """select bucket, row_no, path, action, dest from (
          select s.bucket, s.row_no, s.path, d.action, d.dest,
            row_number() over (partition by s.path order by coalesce(d.hi - d.lo, 2147483647)) as rn
          from sheet s join written d on d.bucket = s.bucket and (d.lo is null or s.row_no between d.lo and d.hi))
        where rn = 1""",
        I.INV,
        SHEET,
        """written as (
          select * from (values ('Desktop', 1, 3, 'DELETE', null), ('Desktop', null, null, 'SKIP', null),
            ('Archive', null, null, 'DELETE', null), ('Downloads', 2, 2, 'MOVE', 'Customers/Acme')) t(bucket, lo, hi, action, dest)
          union all select 'Drive Root', k, k, 'MOVE', 'Customers/North ' || k from (
            select distinct cast(doc_id % 400 + 1 as int) as k from documents where doc_id % 3 = 0))""",
    ),
)
def apply_review(spark, sf):
    written = spark.createDataFrame(
        [("Desktop: DELETE 1-3, SKIP rest",), ("Archive: DELETE ALL",), ("Downloads #2: Customers/Acme/",)], "line string"
    )
    derived = I.table(spark, sf, "documents").filter("doc_id % 3 = 0").select(
        F.expr("concat('Drive Root #', doc_id % 400 + 1, ': Customers/North ', doc_id % 400 + 1, '/')").alias("line")
    )
    decisions = review.parse_decisions(written.unionByName(derived.distinct()))
    return review.apply_decisions(review.worksheet(I.inv(spark, sf).drop("text")), decisions)


@query(
    "run_summary",
    I.sql(
        """select 'action' as part, wave, action, cast(null as varchar) as category, count(*) as files
          from processed group by rollup(wave, action)
        union all select 'category', null, null, category, count(*) from processed where action = 'move' group by category
        union all select 'category', null, null, 'Root', count(*) from processed where action <> 'move'
        union all select 'pending', null, null, null, count(*) from inv where doc_id not in (select doc_id from processed)""",
        I.INV,
        I.PROCESSED,
    ),
)
def run_summary(spark, sf):
    done = I.processed(spark, sf)
    by_action = stats.run_summary(done).withColumn("part", F.lit("action"))
    dest = F.when(F.col("action") == "move", F.concat(F.lit("/archive/"), "category", F.lit("/f"))).otherwise("/archive/f")
    by_category = stats.category_summary(done.withColumn("dest", dest), "/archive").withColumn("part", F.lit("category"))
    pending = I.inv(spark, sf).join(done, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("files"))
    return by_action.unionByName(by_category, True).unionByName(pending.withColumn("part", F.lit("pending")), True)


# the whole wave: filters, older versions, rules, scorer, decision
WAVE = [
    """pending as (select * from inv where doc_id not in (select doc_id from processed)
      and not regexp_matches('/' || lower(folder) || '/', '/(node_modules|\\.git|__pycache__|\\.obsidian|\\.vscode|venv|\\.env)/')
      and extension in ('.docx', '.doc', '.xlsx', '.xls', '.pptx', '.ppt', '.pdf', '.txt', '.csv'))""",
    version_members("pending"),
    """decided as (select path, 'DELETE (older version)' as category, 10 as confidence, 'delete' as action
        from version_members where not is_canonical
      union all select path, coalesce(by_path, by_name), case when by_path is not null then 9 else 8 end, 'move' from cur
        where coalesce(by_path, by_name) is not null
      union all select path, coalesce(phrase, 'Unknown'), case when phrase is null then 2 else 8 end,
          case when phrase is null then 'unknown' else 'move' end
        from cur where coalesce(by_path, by_name) is null)""",
]
CUR = f"""cur as (select *, {R.first_hit(PATH_RULES, 'path', 'category')} as by_path,
    {R.first_hit(GENERIC_RULES, 'filename', 'category', True)} as by_name,
    case when {CLEAR_SIGNALS_SQL} or exists (select 1 from aliases where contains(lower(filename), alias)) then null
      else {phrase_sql('low')} end as phrase
  from (select *, lower(case when extension in ('.txt', '.csv') then text end) as low
    from pending where path not in (select path from version_members where not is_canonical)))"""


@query(
    "wave_run",
    I.sql(
        "select path, category, cast(confidence as int) as confidence, action, cast(4 as int) as wave from decided",
        I.INV,
        I.PROCESSED,
        I.ALIASES,
        WAVE[0],
        WAVE[1],
        CUR,
        WAVE[2],
    ),
)
def wave_run(spark, sf):
    files = I.inv(spark, sf)
    done = files.join(I.processed(spark, sf), "doc_id", "left_semi").select("path")
    out = waves.run_wave(files, done, I.aliases(spark), 4, F.current_timestamp().cast("timestamp_ntz"))
    return out.decisions.select("path", "category", "confidence", "action", "wave")


class _Broken(RuntimeError):
    """Stops a wave half-way, as a lost driver would."""


@query(
    "incremental_wave",
    I.sql(
        """select path, category, cast(confidence as int) as confidence, action,
            (select count(*) from pending) as files, (select count(*) from version_members where not is_canonical) as older
        from decided""",
        I.INV,
        "processed as (select doc_id from documents where false)",
        I.ALIASES,
        WAVE[0],
        WAVE[1],
        CUR,
        WAVE[2],
    ),
)
def incremental_wave(spark, sf):
    """Three arrivals of the documents, the second one broken off and repeated; the latest decisions are those of one batch."""
    from shelfmark.operators.state import latest_decisions

    docs = I.table(spark, sf, "documents")
    source, mark = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
    store = Store.open(spark, scratch_path(spark, "store"))
    now = F.current_timestamp().cast("timestamp_ntz")

    def break_off(kind):
        if kind == "decisions":
            raise _Broken(kind)

    for arrival in range(3):
        # an arrival is as many files as the scan has tasks
        docs.filter(F.pmod("doc_id", F.lit(3)) == arrival).write.parquet(f"{source}/{arrival}")
        run = partial(run_arrivals, store, f"{source}/*", docs.schema, mark, I.aliases(spark), now, I.inv_of, files_per_wave=None)
        if arrival == 1:
            try:
                run(written=break_off)
            except StreamingQueryException:
                pass
        run()
    latest = latest_decisions(store.all("decisions"))
    totals = store.all("files").agg(F.count(F.lit(1)).alias("files"))
    older = latest.filter("action = 'delete'").agg(F.count(F.lit(1)).alias("older"))
    rows = latest.select("path", "category", "confidence", "action", F.lit(1).alias("one"))
    sums = totals.withColumn("one", F.lit(1)).join(older.withColumn("one", F.lit(1)), "one")
    return rows.join(sums, "one").drop("one")
