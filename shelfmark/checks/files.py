"""Queries: scans, sources, sinks, filters and row rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.checks import inputs as I
from shelfmark.checks import rule_sql as R
from shelfmark.checks.registry import query
from shelfmark.functions import paths as P
from shelfmark.functions import versions as V
from shelfmark.operators import categorize, filters, stats
from shelfmark.settings import Settings
from shelfmark.sources import aliases as alias_store
from shelfmark.sources import inventory, records, sinks
from shelfmark.sources.preview import text_previews

SKIP = "'/(" + "|".join(n.replace(".", r"\.") for n in Settings().skip_folders) + ")/'"
RULES = Settings(
    filename_rules={
        r"Invoice[_ ]": "Finance/Invoices",
        r"budget \d+": "Finance/Budgets",
        r"plan.*-draft": "Projects/Drafts",
    }
)
NAME_RULES = [R.Rule(p, c) for p, c in RULES.filename_rules.items()]
GENERIC_RULES = [R.Rule(p, "Archive/Review") for p in categorize.GENERIC_NAMES]
CLEAR_SIGNALS_SQL = R.any_of(categorize.CLEAR_SIGNALS, "filename")
PATH_RULES = [*categorize.PATH_RULES, *R.named_folders(categorize.KNOWN_FOLDERS)]


@query(
    "inventory_scan",
    I.sql(
        """select path, filename, extension, size_bytes, modified_time, parent_folder, relative_path from inv
        union all by name
        select path, filename, extension, size_bytes, modified_time,
          regexp_extract(path, '([^/]*)/[^/]*$', 1) as parent_folder, relative_path from order_files""",
        I.INV,
        I.ORDER_FILES,
    ),
)
def inventory_scan(spark, sf):
    cols = ["path", "relative_path", "size_bytes", "modified_time"]
    manifest = I.inv(spark, sf).select(*cols).unionByName(I.order_files(spark, sf).select(*cols))
    return inventory.inventory_from_manifest(manifest)


ROOT_KIND = (
    "case folder when 'Desktop' then 'file' when 'misc' then 'missing' else 'dir' end"
)


@query(
    "multi_root_scan",
    I.sql(
        f"""select 'file' as kind, path as subject, filename as detail, size_bytes from inv where {ROOT_KIND} = 'dir'
        union all
        select distinct 'error', '/corpus/' || folder, case {ROOT_KIND} when 'missing'
          then 'Root does not exist: /corpus/' || folder else 'Root is not a directory: /corpus/' || folder end,
          cast(null as bigint) from inv where {ROOT_KIND} <> 'dir'""",
        I.INV,
    ),
)
def multi_root_scan(spark, sf):
    files = I.inv(spark, sf).withColumn("root", F.concat(F.lit("/corpus/"), "folder"))
    roots = files.select("root", F.expr(ROOT_KIND).alias("kind")).distinct()
    manifest = files.select(
        "root", "path", F.col("filename").alias("relative_path"), "size_bytes", "modified_time"
    )
    found, errors = inventory.multi_root_inventory(manifest, roots)
    return found.select(
        F.lit("file").alias("kind"), F.col("path").alias("subject"), F.col("relative_path").alias("detail"), "size_bytes"
    ).unionByName(
        errors.select(
            F.lit("error").alias("kind"),
            F.col("root").alias("subject"),
            F.col("message").alias("detail"),
            F.lit(None).cast("long").alias("size_bytes"),
        )
    )


@query(
    "path_attrs",
    I.sql(
        f"""select path, filename, extension, {R.stem('filename')} as stem, parent_folder,
          string_split(relative_path, '/')[1] as top_folder, '/corpus/' || folder as parent_path from inv""",
        I.INV,
    ),
)
def path_attrs(spark, sf):
    path, rel = F.col("path"), F.col("relative_path")
    name = P.filename_of(path)
    return I.inv(spark, sf).select(
        "path",
        name.alias("filename"),
        P.extension_of(name).alias("extension"),
        P.stem_of(name).alias("stem"),
        P.parent_name_of(path).alias("parent_folder"),
        P.top_folder_of(rel).alias("top_folder"),
        P.parent_path_of(path).alias("parent_path"),
    )


@query(
    "text_preview",
    r"""with t as (select doc_id, n_chars * 9700 as size_bytes,
        case doc_id % 4 when 0 then '.txt' when 1 then '.csv' when 2 then '.rtf' else '.pdf' end as extension,
        case when doc_id % 4 = 2 then '{\rtf1\ansi {\b ' || text || '}\par second}' else text end as text from documents),
      s as (select *, case when size_bytes > 52428800 then 'too_large' when extension = '.pdf' then 'unsupported'
        else 'ok' end as status from t)
      select doc_id, status, case when status <> 'ok' then null
        when extension = '.txt' then left(text, 5000)
        when extension = '.csv' then array_to_string(list_slice(string_split(left(text, 5000), chr(10)), 1, 20), chr(10))
        else left(trim(regexp_replace(regexp_replace(regexp_replace(left(text, 10000),
          '\\[a-z]+\d*\s?', ' ', 'g'), '[{}]', '', 'g'), '\s+', ' ', 'g')), 5000) end as preview from s""",
)
def text_preview(spark, sf):
    body = F.when(
        F.expr("doc_id % 4 = 2"), F.concat(F.lit("{\\rtf1\\ansi {\\b "), "text", F.lit("}\\par second}"))
    ).otherwise(F.col("text"))
    files = I.documents(spark, sf).select(
        "doc_id",
        (F.col("n_chars") * 9700).alias("size_bytes"),
        F.expr("case doc_id % 4 when 0 then '.txt' when 1 then '.csv' when 2 then '.rtf' else '.pdf' end").alias("extension"),
        body.alias("text"),
    )
    return text_previews(files).select("doc_id", "status", "preview")


@query(
    "alias_table",
    """with entries as (
        select 0 as part, c_custkey as major, 0 as minor, c_name as alias, c_name as canonical from customer
        union all select 0, c_custkey, 1, replace(c_name, '#', ' '), c_name from customer
        union all select 0, c_custkey, 2, c_mktsegment || ' ' || c_nationkey, c_name from customer
        union all select 1, s_suppkey, 0, s_name, s_name from supplier
        union all select 1, 1000000000 + p_partkey, 0, upper(p_name), upper(p_name) from part),
      keyed as (select *, part * 1000000000000000 + major * 10 + minor as place from entries)
      select lower(alias) as alias, min(place) as place, arg_max(canonical, place) as canonical
      from keyed group by lower(alias)""",
)
def alias_table(spark, sf):
    mappings = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ord"),
        F.col("c_name").alias("canonical"),
        F.array(
            F.replace("c_name", F.lit("#"), F.lit(" ")),
            F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")),
        ).alias("aliases"),
    )
    learned = (
        I.table(spark, sf, "supplier")
        .select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"))
        .unionByName(
            I.table(spark, sf, "part").select(
                (F.col("p_partkey") + 1000000000).alias("ord"), F.upper("p_name").alias("name")
            )
        )
    )
    place = F.col("ord.part") * F.lit(10**15) + F.col("ord.major") * 10 + F.col("ord.minor")
    return alias_store.flatten_aliases(mappings, learned).select("alias", place.alias("place"), "canonical")


@query(
    "record_json",
    I.sql(
        """select path, to_json({'path': path, 'filename': filename, 'extension': extension, 'size_bytes': size_bytes,
            'modified_time': strftime(modified_time, '%Y-%m-%dT%H:%M:%S'), 'parent_folder': parent_folder,
            'relative_path': relative_path})::varchar as record,
          size_bytes as parsed_size, modified_time as parsed_time, cast(null as varchar) as parsed_category
        from inv""",
        I.INV,
    ),
)
def record_json(spark, sf):
    files = inventory.inventory_from_manifest(
        I.inv(spark, sf).select("path", "relative_path", "size_bytes", "modified_time")
    )
    text = files.select("path", records.to_record(files).alias("record"))
    parsed = records.parse_files(F.col("record"))
    return text.select(
        "path",
        "record",
        parsed["size_bytes"].alias("parsed_size"),
        parsed["modified_time"].alias("parsed_time"),
        parsed["category"].alias("parsed_category"),
    )


@query(
    "state_json",
    """select doc_id, case when doc_id % 3 = 0 then 'wave_complete' else 'init' end as phase,
        cast(case when doc_id % 3 = 1 then doc_id % 7 else 1 end as int) as current_wave,
        cast(case when doc_id % 3 = 0 then n_chars else 0 end as int) as files_processed,
        false as structure_approved, cast(null as varchar) as last_file_processed from documents""",
)
def state_json(spark, sf):
    text = F.expr(
        "case doc_id % 3 when 0 then concat('{\"phase\":\"wave_complete\",\"files_processed\":', n_chars, '}') "
        "when 1 then concat('{\"current_wave\":', doc_id % 7, '}') else '{broken' end"
    )
    state = records.parse_state(text)
    return I.table(spark, sf, "documents").select("doc_id", state.alias("s")).select(
        "doc_id", "s.phase", "s.current_wave", "s.files_processed", "s.structure_approved", "s.last_file_processed"
    )


def _hist_sql(kind: str, key: str, section: int) -> str:
    return f"""select {section} as section, '{kind}' as kind, rank, key, n from (
        select key, n, row_number() over (order by n desc, key) as rank
        from (select {key} as key, count(*) as n from order_files group by 1)) where rank <= 15
      union all select {section}, '{kind}', 16, '(other keys)', count(*) - 15 from (
        select distinct {key} from order_files) having count(*) > 15"""


# few extensions but many top folders, so that the tail row shows
MANY_TOPS = I.ORDER_FILES.replace(
    "substring(o_orderpriority, 3, 20), '/', o_orderstatus",
    "'top ', cast(o_orderkey % 23 as string), '/', o_orderstatus",
)


def _many_tops(spark, sf):
    files = I.order_files(spark, sf)
    rel = F.concat(
        F.lit("top "), (F.col("o_orderkey") % 23).cast("string"), F.lit("/"),
        P.parent_name_of(F.col("path")), F.lit("/"), F.col("filename"),
    )
    return files.withColumn("relative_path", rel).withColumn("path", F.concat(F.lit("/orders/"), "relative_path"))


@query(
    "scan_histograms",
    I.sql(
        "select kind, rank, key, n from ("
        + _hist_sql("extension", "extension", 1)
        + " union all "
        + _hist_sql("folder", "string_split(relative_path, '/')[1]", 2)
        + ")",
        MANY_TOPS,
    ),
)
def scan_histograms(spark, sf):
    return stats.scan_histograms(_many_tops(spark, sf))


@query(
    "scan_totals",
    I.sql(
        """select count(*) as files, cast(sum(size_bytes) as bigint) as bytes, min(modified_time) as earliest,
        max(modified_time) as latest from order_files""",
        I.ORDER_FILES,
    ),
)
def scan_totals(spark, sf):
    return stats.scan_totals(I.order_files(spark, sf))


REPORT_SQL = f"""select 0 as section, 0 as line_no, 'Files: ' || count(*) as line from order_files
  union all select 0, 1, 'Size: ' || {R.size_label('sum(size_bytes)')} from order_files
  union all select 0, 2, 'Dates: ' || strftime(min(modified_time), '%Y-%m-%d') || ' to '
    || strftime(max(modified_time), '%Y-%m-%d') from order_files
  union all select section, rank, key || ': ' || n from ({_hist_sql('extension', 'extension', 1)})
  union all select section, rank, key || ': ' || n from ({_hist_sql('folder', "string_split(relative_path, '/')[1]", 2)})"""


@query("report_lines", I.sql(REPORT_SQL, MANY_TOPS))
def report_lines(spark, sf):
    return stats.scan_report(_many_tops(spark, sf)).withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "action_log",
    I.sql(
        """select path, '[' || strftime(modified_time, '%Y-%m-%d %H:%M:%S') || '] [ACTION] MOVED: ' || path
            || ' -> /archive/' || category || '/' || filename as line from processed_files where action = 'move'
        union all select path, '[' || strftime(modified_time, '%Y-%m-%d %H:%M:%S') || '] [ACTION] WOULD DELETE: '
            || path from processed_files where action <> 'move'""",
        I.INV,
        I.PROCESSED,
        I.PROCESSED_FILES,
    ),
)
def action_log(spark, sf):
    rows = I.processed_files(spark, sf).withColumn(
        "dest", F.concat_ws("/", F.lit("/archive"), "category", "filename")
    )
    moved = sinks.action_rows(rows.filter("action = 'move'"), "MOVE", "path", "dest", F.col("modified_time"))
    gone = sinks.action_rows(
        rows.filter("action <> 'move'"), "DELETE", "path", None, F.col("modified_time"), dry_run=True
    )
    return moved.unionByName(gone).select(F.col("source").alias("path"), sinks.log_line().alias("line"))


@query(
    "folder_prune",
    I.sql(f"select path from inv where not regexp_matches('/' || lower(folder) || '/', {SKIP})", I.INV),
)
def folder_prune(spark, sf):
    return filters.prune_folders(I.inv(spark, sf)).select("path")


@query(
    "extension_filter",
    I.sql(
        "select path from inv where extension not in ('.md', '.log', '.tmp', '.bak') and extension in "
        "('.docx', '.doc', '.xlsx', '.xls', '.pptx', '.ppt', '.pdf', '.txt', '.csv')",
        I.INV,
    ),
)
def extension_filter(spark, sf):
    return filters.filter_extensions(I.inv(spark, sf)).select("path")


@query(
    "path_category",
    I.sql(
        f"""select path, {R.first_hit(PATH_RULES, 'path', 'category')} as category,
          {R.first_hit(PATH_RULES, 'path', 'entity')} as entity_detected,
          cast(case when {R.first_hit(PATH_RULES, 'path', 'category')} is null then 0 else 9 end as int) as confidence
        from inv""",
        I.INV,
    ),
)
def path_category(spark, sf):
    hit = categorize.path_hit(F.col("path"), F.col("relative_path"))
    return I.inv(spark, sf).select(
        "path",
        hit["category"].alias("category"),
        hit["entity_detected"].alias("entity_detected"),
        F.coalesce(hit["confidence"], F.lit(0)).alias("confidence"),
    )


@query(
    "filename_rules",
    I.sql(
        f"""select path, {R.first_hit(NAME_RULES, 'filename', 'category', True)} as category,
          'File name matches pattern: ' || {R.first_hit(NAME_RULES, 'filename', 'pattern', True)} as reasoning
        from inv where {R.first_hit(NAME_RULES, 'filename', 'category', True)} is not null""",
        I.INV,
    ),
)
def filename_rules(spark, sf):
    hit = categorize.filename_hit(F.col("filename"), RULES.filename_rules)
    rows = I.inv(spark, sf).select("path", hit.alias("h")).filter("h is not null")
    return rows.select("path", "h.category", "h.reasoning")


@query(
    "generic_names",
    I.sql(
        f"""select path, 'Archive/Review' as category, cast(8 as int) as confidence, 'move' as action
        from inv where {R.first_hit(GENERIC_RULES, 'filename', 'category', True)} is not null""",
        I.INV,
    ),
)
def generic_names(spark, sf):
    hit = categorize.generic_hit(F.col("filename"))
    rows = I.inv(spark, sf).select("path", hit.alias("h")).filter("h is not null")
    return rows.select("path", "h.category", "h.confidence", "h.action")


@query(
    "clear_signal",
    I.sql(
        f"""select path, {R.any_of(categorize.CLEAR_SIGNALS, 'filename')}
          or exists (select 1 from names where contains(lower(filename), lower(name))) as has_signal from inv""",
        I.INV,
        "names as (select 'Budget ' || n_nationkey as name from nation union all select n_name from nation)",
    ),
)
def clear_signal(spark, sf):
    nation = I.table(spark, sf, "nation")
    names = nation.select(F.concat(F.lit("Budget "), F.col("n_nationkey").cast("string")).alias("name")).unionByName(
        nation.select(F.col("n_name").alias("name"))
    )
    return categorize.clear_signal(I.inv(spark, sf), names).select("path", "has_signal")


CASCADE_SQL = f"""select path, coalesce({R.first_hit(PATH_RULES, 'path', 'category')},
    {R.first_hit(NAME_RULES, 'filename', 'category', True)},
    {R.first_hit(GENERIC_RULES, 'filename', 'category', True)}) as category,
  cast(case when {R.first_hit(PATH_RULES, 'path', 'category')} is not null
      or {R.first_hit(NAME_RULES, 'filename', 'category', True)} is not null then 9
    when {R.first_hit(GENERIC_RULES, 'filename', 'category', True)} is not null then 8 end as int) as confidence,
  {R.first_hit(PATH_RULES, 'path', 'entity')} as entity_detected,
  case when {R.first_hit(PATH_RULES, 'path', 'category')} is not null
      then 'Taken from the folder structure: ' || relative_path
    when {R.first_hit(NAME_RULES, 'filename', 'category', True)} is not null
      then 'File name matches pattern: ' || {R.first_hit(NAME_RULES, 'filename', 'pattern', True)}
    when {R.first_hit(GENERIC_RULES, 'filename', 'category', True)} is not null
      then 'Default file name, needs review: ' || filename end as reasoning
  from inv"""


@query("rule_cascade", I.sql(CASCADE_SQL, I.INV))
def rule_cascade(spark, sf):
    return categorize.cascade(I.inv(spark, sf), RULES).select(
        "path", "category", "confidence", "entity_detected", "reasoning"
    )


ROUTED = """case doc_id % 11 when 0 then text || ' Risk Questionnaire' when 1 then 'BILL TO US ' || text
    when 2 then text || ' the account ended' when 3 then text || ' Statement of Work'
    when 4 then text || ' budget' when 5 then text || ' travel claim' when 6 then text || ' pitch template'
    else text end"""


def phrase_sql(text: str, rest: str = "") -> str:
    arms = [
        f"when {' or '.join(f'contains({text}, {R.quote(p)})' for p in phrases)} then {R.quote(category)}"
        for category, phrases in categorize.CONTENT_ROUTES
    ]
    return f"case {' '.join(arms)} {rest} end"


def _route_sql(text: str, modified: str) -> str:
    return phrase_sql(text, f"when {modified} < timestamp '{categorize.OLD_CONTENT_BEFORE} 00:00:00' then 'Archive-Pre-2025'")


@query(
    "content_routes",
    I.sql(
        f"select path, {_route_sql('low', 'modified_time')} as category from (select *, lower({ROUTED}) as low from inv)",
        I.INV,
    ),
)
def content_routes(spark, sf):
    files = I.inv(spark, sf).withColumn("text", F.expr(ROUTED))
    return files.select("path", categorize.content_route(F.col("text"), F.col("modified_time")).alias("category"))


@query(
    "review_bucket",
    I.sql(f"select path, {R.review_bucket('path')} as bucket from inv", I.INV),
)
def review_bucket(spark, sf):
    return I.inv(spark, sf).select("path", P.review_bucket(F.col("path")).alias("bucket"))


@query(
    "auto_skip_route",
    I.sql(
        """select path, case when regexp_matches('/' || lower(folder) || '/', '/(downloads|mailattachments|archive)/')
        then 'cleanup' else 'score' end as route from inv""",
        I.INV,
    ),
)
def auto_skip_route(spark, sf):
    return filters.cleanup_route(I.inv(spark, sf)).select("path", "route")


@query(
    "version_parse",
    I.sql(
        f"""select path, {R.base_name(R.stem('filename'))} as base_name, {R.version_number('filename')} as version,
          {R.marked('filename', V.FINAL_WORDS)} as is_final, {R.marked('filename', V.DRAFT_WORDS)} as is_draft
        from (select path, filename from inv union all select path, filename from order_files)""",
        I.INV,
        I.ORDER_FILES,
    ),
)
def version_parse(spark, sf):
    name = F.col("filename")
    files = I.inv(spark, sf).select("path", "filename").unionByName(I.order_files(spark, sf).select("path", "filename"))
    return files.select(
        "path",
        V.base_name(name).alias("base_name"),
        V.version_number(name).cast("long").alias("version"),
        V.is_final(name).alias("is_final"),
        V.is_draft(name).alias("is_draft"),
    )


@query(
    "size_label",
    I.sql(
        f"""select path, {R.size_label('size_bytes')} as label, {R.size_label('size_bytes * 1024')} as label_mb
        from order_files""",
        I.ORDER_FILES,
    ),
)
def size_label(spark, sf):
    size = F.col("size_bytes")
    return I.order_files(spark, sf).select(
        "path", P.size_label(size).alias("label"), P.size_label(size * 1024).alias("label_mb")
    )
