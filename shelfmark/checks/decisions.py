"""Queries: entities, scoring, decisions, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.checks import inputs as I
from shelfmark.checks import rule_sql as R
from shelfmark.checks.files import CASCADE_SQL, MANY_TOPS, REPORT_SQL, ROUTED, RULES, _many_tops, phrase_sql
from shelfmark.checks.registry import query
from shelfmark.operators import categorize, decide, entities, filters, neardup, scoring, state
from shelfmark.settings import Settings

PARSED_COLUMNS = ["category", "confidence", "entity_detected", "reasoning", "action"]


def _parsed(spark, sf):
    rows = I.replies(spark, sf)
    return rows.select("doc_id", decide.parse_reply(F.col("reply")).alias("r")).select("doc_id", "r.*")


@query(
    "parse_replies",
    I.sql("select * from parsed", I.REPLIES, I.PARSED),
)
def parse_replies(spark, sf):
    return _parsed(spark, sf)


@query(
    "critique_gate",
    I.sql("select doc_id, confidence from parsed where confidence between 6 and 8", I.REPLIES, I.PARSED),
)
def critique_gate(spark, sf):
    rows = _parsed(spark, sf)
    return rows.filter(decide.needs_critique(F.col("confidence"))).select("doc_id", "confidence")


@query(
    "decide_action",
    I.sql(
        """select doc_id,
            cast(case when failed then 0 when ch then coalesce(final_confidence, confidence)
              else coalesce(confidence, 0) end as int) as confidence,
            case when failed then 'unknown'
              when ch and coalesce(final_confidence, confidence) < 7 then 'unknown'
              when ch then coalesce(action, 'move')
              when action is null or (action = 'move' and coalesce(confidence, 0) < 7) then 'unknown'
              else action end as action,
            case when failed then 'Unknown' when ch then coalesce(final_category, category)
              else coalesce(category, 'Unknown') end as category,
            case when not failed then entity_detected end as entity_detected,
            ch as changed_after_critique
        from (select p.*, c.final_category, c.final_confidence,
            coalesce(p.category, p.reasoning, p.action, cast(p.confidence as varchar), p.entity_detected) is null as failed,
            coalesce(p.confidence between 6 and 8, false) and coalesce(c.changed, false) as ch
          from parsed p left join critiques c on c.doc_id = p.doc_id)""",
        I.REPLIES,
        I.PARSED,
        I.CRITIQUES,
    ),
)
def decide_action(spark, sf):
    return decide.decide(_parsed(spark, sf), I.critiques(spark, sf), "doc_id").select(
        "doc_id", "confidence", "action", "category", "entity_detected", "changed_after_critique"
    )


ALLOWED = ("Customers", "Archive", "HR", "Projects/Falcon")
CATEGORY = "case doc_id % 9 when 0 then 'Customers' when 1 then 'Customers2/X' when 2 then 'HR/Expenses' " \
    "when 3 then 'Projects' when 4 then 'Projects/Falcon/2023' when 5 then '' else folder end"


@query(
    "validate_category",
    I.sql(
        f"""select path, category, exists (select 1 from (values {", ".join(f"('{a}')" for a in ALLOWED)}) t(a)
          where category = a or starts_with(category, a || '/')) as is_allowed,
          exists (select 1 from tops where category = a or starts_with(category, a || '/')) as is_listed
        from (select *, {CATEGORY} as category from inv)""",
        I.INV,
        "tops as (select distinct folder as a from inv where size_bytes > 1000000 "
        "union select distinct 'Customers' from inv)",
    ),
)
def validate_category(spark, sf):
    files = I.inv(spark, sf).withColumn("category", F.expr(CATEGORY))
    allowed = (
        I.inv(spark, sf)
        .filter("size_bytes > 1000000")
        .select(F.col("folder").alias("category"))
        .unionByName(I.inv(spark, sf).select(F.lit("Customers").alias("category")))
        .distinct()
    )
    listed = filters.validate_categories(files, allowed).withColumnRenamed("is_allowed", "is_listed")
    return listed.select(
        "path", "category", filters.category_allowed(F.col("category"), ALLOWED).alias("is_allowed"), "is_listed"
    )


@query(
    "pending_files",
    I.sql(
        """select path from inv where doc_id not in (select doc_id from processed)
        union all select path from order_files where o_orderkey not in (select l_orderkey from lineitem)""",
        I.INV,
        I.PROCESSED,
        I.ORDER_FILES,
    ),
)
def pending_files(spark, sf):
    docs = filters.pending_files(I.inv(spark, sf), I.processed(spark, sf), "doc_id").select("path")
    seen = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return docs.unionByName(filters.pending_files(I.order_files(spark, sf), seen, "o_orderkey").select("path"))


@query(
    "entity_substring",
    I.sql(
        """select path, (select arg_min(canonical, ord) from aliases where contains(lower(relative_path), alias)) as entity
        from inv""",
        I.INV,
        I.ALIASES,
    ),
)
def entity_substring(spark, sf):
    files = I.inv(spark, sf).select("path", "relative_path")
    return entities.match_substrings(files, "relative_path", I.aliases(spark), "path").select("path", "entity")


MENTION = "concat(text, ' re: xCustomer#', lpad(cast((doc_id * 37) % 3000 as string), 9, '0'), ' n')"
SPACED = "replace(lower(c_name), '#', ' # ')"


@query(
    "entity_substring_store",
    f"""with texts as (select doc_id, lower(case when doc_id % 3 = 0 then replace({MENTION}, '#', ' # ')
          else {MENTION} end) as t from documents),
      store as (select c_custkey * 2 as ord, lower(c_name) as alias, c_name as canonical from customer
        union all select c_custkey * 2 + 1, {SPACED}, 'spaced ' || c_name from customer)
      select doc_id, arg_min(canonical, ord) as entity from texts left join store on contains(t, alias) group by doc_id""",
)
def entity_substring_store(spark, sf):
    """A store too large for the plan: the join over words takes over."""
    text = F.expr(f"case when doc_id % 3 = 0 then replace({MENTION}, '#', ' # ') else {MENTION} end")
    texts = I.documents(spark, sf).select("doc_id", text.alias("text"))
    customers = I.table(spark, sf, "customer")
    store = customers.selectExpr("c_custkey * 2 as ord", "lower(c_name) as alias", "c_name as canonical").unionByName(
        customers.selectExpr(
            "c_custkey * 2 + 1 as ord", f"{SPACED} as alias", "concat('spaced ', c_name) as canonical"
        )
    )
    return entities.match_substrings(texts, "text", store, "doc_id").select("doc_id", "entity")


# longest common subsequence by a fold over letters; every value is an int list
LCS = """list_reduce(
      list_prepend(list_transform(range(0, length(b) + 1), lambda z: 0),
        list_transform(range(1, length(a) + 1), lambda i: [unicode(a[i])])),
      lambda r, e: list_prepend(0, list_transform(range(1, length(b) + 1), lambda j:
        list_max(list_transform(range(1, j + 1), lambda t:
          greatest(case when unicode(b[t]) = e[1] then r[t] + 1 else 0 end, r[t + 1]))))))[-1]"""


@query(
    "entity_fuzzy",
    I.sql(
        f"""select path, first(word order by pos) as word, first(canonical order by pos) as entity,
            round(first(ratio order by pos), 6) as ratio from placed join hits using (word) group by path""",
        I.INV,
        I.ALIASES,
        """store as (select ord, alias, canonical from aliases
          union all select 100 + c_custkey, left(lower(c_name), 12) || lower(c_mktsegment), c_name from customer
            where c_custkey = (select min(c_custkey) from customer c2 where c2.c_mktsegment = customer.c_mktsegment))""",
        """placed as (select path, pos, w[pos] as word from (select path, w, unnest(range(1, len(w) + 1)) as pos from (
            select path, list_filter(string_split_regex(lower(regexp_replace(filename, '[-_.]', ' ', 'g') || ' '
              || left(text, 0) || case doc_id % 4 when 0 then ' akme' when 1 then ' customer#00furnitre'
                when 2 then ' globalindd' else '' end || ' ' || lower(text)), '\\s+'), lambda w: length(w) >= 3) as w from inv)))""",
        f"""scored as (select word, canonical, ord, 200.0 * {LCS} / (length(a) + length(b)) as ratio
          from (select word, canonical, ord, word as a, alias as b from (select distinct word from placed) v
            join store on least(length(word), length(alias)) * 3 >= greatest(length(word), length(alias)) * 2))""",
        """hits as (select word, first(canonical order by ratio desc, ord) as canonical, max(ratio) as ratio
          from scored where ratio >= 80 group by word)""",
    ),
)
def entity_fuzzy(spark, sf):
    tail = F.expr(
        "case doc_id % 4 when 0 then ' akme' when 1 then ' customer#00furnitre' when 2 then ' globalindd' else '' end"
    )
    text = F.concat(F.regexp_replace("filename", "[-_.]", " "), F.lit(" "), tail, F.lit(" "), "text")
    files = I.inv(spark, sf).select("path", text.alias("t"))
    customers = I.table(spark, sf, "customer")
    firsts = customers.groupBy("c_mktsegment").agg(F.min_by("c_name", "c_custkey").alias("c_name"), F.min("c_custkey").alias("k"))
    store = I.aliases(spark).select(F.col("ord").cast("long"), "alias", "canonical").unionByName(
        firsts.select(
            (F.col("k") + 100).alias("ord"),
            F.concat(F.substring(F.lower("c_name"), 1, 12), F.lower("c_mktsegment")).alias("alias"),
            F.col("c_name").alias("canonical"),
        )
    )
    return entities.match_fuzzy(files, "t", store, "path").withColumn("ratio", F.round("ratio", 6))


SIBLING_LINES = """siblings as (select folder, string_agg('* ' || filename || ' => ' || category || ' @' || confidence,
      chr(10) order by rn) as lines from (select *, row_number() over (partition by folder
        order by modified_time, path) as rn from processed_files where action = 'move') where rn <= 10 group by folder)"""


def _earlier(spark, sf):
    return I.processed_files(spark, sf).filter("action = 'move'").withColumn("processed_at", F.col("modified_time"))


@query(
    "sibling_context",
    I.sql(
        """select i.path, s.lines from inv i left join siblings s on s.folder = i.folder
        where i.doc_id not in (select doc_id from processed)""",
        I.INV,
        I.PROCESSED,
        I.PROCESSED_FILES,
        SIBLING_LINES,
    ),
)
def sibling_context(spark, sf):
    fresh = filters.pending_files(I.inv(spark, sf), I.processed(spark, sf), "doc_id")
    rows = scoring.sibling_context(fresh, _earlier(spark, sf))
    return rows.select("path", scoring.sibling_lines(F.col("siblings")).alias("lines"))


CONTEXT = Settings(
    own_names=("Our Firm",),
    vendors={"Global Industries": ["Global Ind", "GlobalInd"], "Paper Mill": []},
    customers={"Acme Corporation": ["Acme"]},
    former_customers={"Old Client": {"reason": "closed", "aliases": ["OC"]}},
    employees={"A. Person": {"role": "Analyst", "team": "Finance"}},
)
CONTEXT_TEXT = scoring.context_text(CONTEXT, ["Acme Corporation", "Beta Technologies"], ["Customers", "HR", "Admin"])
TEXT_BODY = (
    "case when extension = '.txt' then left(text, 5000) when extension = '.csv' then "
    "array_to_string(list_slice(string_split(left(text, 5000), chr(10)), 1, 20), chr(10)) end"
)
LAST_LINE = (
    "Answer with JSON: category, entity_detected, entity_type, confidence 1-10, reasoning, action. "
    "Use action unknown below confidence 7, skip to leave the file."
)


@query(
    "scoring_requests",
    I.sql(
        f"""select i.path, concat_ws(chr(10), 'path: ' || relative_path, 'name: ' || filename, 'type: ' || extension,
          'date: ' || strftime(modified_time, '%Y-%m-%d'), 'bytes: ' || size_bytes,
          case when length({TEXT_BODY}) > 0 then 'text:' || chr(10) || left({TEXT_BODY}, 3000) end,
          {R.quote(CONTEXT_TEXT)},
          case when length(s.lines) > 0 then 'filed from this folder:' || chr(10) || s.lines end,
          {R.quote(LAST_LINE)}) as request
        from inv i left join siblings s on s.folder = i.folder""",
        I.INV,
        I.PROCESSED,
        I.PROCESSED_FILES,
        SIBLING_LINES,
    ),
)
def scoring_requests(spark, sf):
    from shelfmark.sources.preview import text_previews

    rows = text_previews(I.inv(spark, sf))
    rows = scoring.sibling_context(rows, _earlier(spark, sf))
    return scoring.scoring_requests(rows, CONTEXT_TEXT, CONTEXT).select("path", "request")


@query(
    "critique_requests",
    I.sql(
        """select doc_id, 'answer: ' || category || chr(10) || 'confidence: ' || cast(confidence as int) || chr(10) || 'because: '
          || reasoning || chr(10) || 'What speaks against it, and what else could it be? Answer with JSON: critique, '
          || 'alternative_interpretations, final_category, final_confidence, changed.' as request
        from parsed where confidence between 6 and 8""",
        I.REPLIES,
        I.PARSED,
    ),
)
def critique_requests(spark, sf):
    return scoring.critique_requests(scoring.critique_rows(_parsed(spark, sf))).select("doc_id", "request")


@query(
    "proposal_request",
    I.sql(
        f"""select concat(string_agg(line, chr(10) order by part, section, line_no, line),
            chr(10), 'Propose a folder tree.') as request from (
          select 0 as part, section, line_no, line from ({{REPORT}})
          union all select 1, 0, 0, {R.quote(CONTEXT_TEXT)}
          union all select 2, 0, 0, '* ' || filename from (select path, filename from order_files order by path limit 100))""".replace(
            "{REPORT}", REPORT_SQL
        ),
        MANY_TOPS,
    ),
)
def proposal_request(spark, sf):
    from shelfmark.plans.structure import structure_request

    return structure_request(_many_tops(spark, sf), CONTEXT_TEXT)


@query(
    "find_entities",
    I.sql(
        f"""select path, coalesce((select arg_min(canonical, ord) from aliases where contains(lower(words), alias)),
            first(canonical order by pos) filter (canonical is not null)) as entity
        from (select p.path, p.words, p.pos, h.canonical from placed p left join hits h on h.word = p.word)
        group by path, words""",
        I.INV,
        I.ALIASES,
        """named as (select path, regexp_replace(filename, '[-_.]', ' ', 'g') as words from inv)""",
        """placed as (select path, words, pos, w[pos] as word from (select *, unnest(range(1, len(w) + 1)) as pos from (
            select path, words, list_filter(string_split_regex(lower(words), '\\s+'), lambda w: length(w) >= 3) as w from named)))""",
        f"""scored as (select word, canonical, ord, 200.0 * {LCS} / (length(a) + length(b)) as ratio
          from (select word, canonical, ord, word as a, alias as b from (select distinct word from placed) v
            join aliases on least(length(word), length(alias)) * 3 >= greatest(length(word), length(alias)) * 2))""",
        """hits as (select word, first(canonical order by ratio desc, ord) as canonical
          from scored where ratio >= 80 group by word)""",
    ),
)
def find_entities(spark, sf):
    files = I.inv(spark, sf).select("path", F.regexp_replace("filename", "[-_.]", " ").alias("words"))
    return entities.find_entities(files, "words", I.aliases(spark), "path").select("path", "entity")


@query(
    "score_files",
    f"""select doc_id, coalesce(c, 'Unknown') as category, cast(case when c is null then 2 else 8 end as int) as confidence,
        case when c is null then 'unknown' else 'move' end as action,
        case when c is null then 'No phrase found' else 'Phrase found in text' end as reasoning
      from (select doc_id, {phrase_sql('t')} as c from (select doc_id, lower({ROUTED}) as t from documents))""",
)
def score_files(spark, sf):
    rows = I.documents(spark, sf).select("doc_id", F.expr(ROUTED).alias("preview"))
    return scoring.score_and_parse(rows, key="doc_id").select("doc_id", "category", F.col("confidence").cast("int").alias("confidence"), "action", "reasoning")


TREE = (
    "case doc_id % 6 when 0 then concat('├── ', lang, '-', source, '/') when 1 then concat('│   ├── Acme ', source, '/') "
    "when 2 then concat('- Legal-', source, '/ contracts for ', lang) when 3 then '- no folder here' "
    "when 4 then concat('├── {', lang, '}/') else concat('└── ', source, '/', lang, '/') end"
)


@query(
    "structure_paths",
    f"""with lines as (select unnest([{TREE}] || string_split(text, chr(10))) as line from documents),
      bare as (select line, regexp_replace(line, '^[- ]+|[- ]+$', '', 'g') as b from lines),
      bullet as (select string_split_regex(ltrim(b), '\\s+')[1] as w from bare
        where starts_with(regexp_replace(line, '^\\s+', ''), '- ') and contains(line, '/'))
      select distinct folder from (
        select regexp_extract(line, '([A-Za-z0-9\\-_/{{}}]+)/', 1) as folder from lines
          where not starts_with(regexp_extract(line, '([A-Za-z0-9\\-_/{{}}]+)/', 1), '{{')
        union all select regexp_replace(w, '/+$', '') from bullet where ends_with(w, '/')) where folder <> ''""",
)
def structure_paths(spark, sf):
    lines = F.concat(F.array(F.expr(TREE)), F.split("text", "\n"))
    return scoring.structure_paths(I.documents(spark, sf).select(F.explode(lines).alias("line")))


@query(
    "cost_estimate",
    I.sql(
        """select n as files_to_score, pairs, n * 2400 + n * 0.3 * 500 as tokens_in, n * 150 + n * 0.3 * 200 as tokens_out,
          round(((n * 2400 + n * 0.3 * 500) * 15 + (n * 150 + n * 0.3 * 200) * 75) / 1e6, 6) as scoring_cost,
          round(pairs * 0.03, 6) as pair_cost
        from (select cast(count(*) as double) as n, (select cast(sum(p) as bigint) from (
            select count(*) * (count(*) - 1) // 2 as p from inv group by parent_folder, extension)) as pairs
          from cascade where category is null)""",
        I.INV,
        f"cascade as ({CASCADE_SQL})",
    ),
)
def cost_estimate(spark, sf):
    files = I.inv(spark, sf)
    left = categorize.cascade(files, RULES).filter("category is null")
    out = scoring.cost_estimate(left, neardup.candidate_blocks(files))
    return out.withColumn("files_to_score", F.col("files_to_score").cast("double"))


HISTORY = """history as (
  select wave, doc_id, category, confidence, action from processed
  union all select cast(wave + 3 as int), doc_id, category || '/Again', cast(confidence + 1 as int),
    case when doc_id % 2 = 0 then 'move' else 'unknown' end from processed where doc_id % 7 < 4)"""


def _history(spark, sf):
    first = I.processed(spark, sf)
    again = first.filter("doc_id % 7 < 4").selectExpr(
        "cast(wave + 3 as int) as wave",
        "doc_id",
        "concat(category, '/Again') as category",
        "cast(confidence + 1 as int) as confidence",
        "case when doc_id % 2 = 0 then 'move' else 'unknown' end as action",
    )
    return first.unionByName(again).withColumnRenamed("doc_id", "path")


@query(
    "decision_state",
    I.sql(
        """select 'latest' as part, doc_id as path, wave, category, confidence, action from (
          select *, row_number() over (partition by doc_id order by wave desc) as rn from history) where rn = 1
        union all select 'unknowns', doc_id, wave, null, null, null from history where action = 'unknown'""",
        I.PROCESSED,
        HISTORY,
    ),
)
def decision_state(spark, sf):
    history = _history(spark, sf)
    latest = state.latest_decisions(history).withColumn("part", F.lit("latest"))
    unknowns = state.unknowns_by_wave(history).withColumn("part", F.lit("unknowns"))
    return latest.unionByName(unknowns, allowMissingColumns=True)


@query(
    "learn_entities",
    I.sql(
        """select distinct entity_detected as name from parsed where coalesce(entity_detected, '') <> ''
          and entity_detected not in (select 'Acme ' || n_nationkey from nation)
          and entity_detected not in (select 'Acme ' || (s_suppkey + 25) from supplier where s_suppkey % 3 = 0)""",
        I.REPLIES,
        I.PARSED,
    ),
)
def learn_entities(spark, sf):
    mappings = I.table(spark, sf, "nation").selectExpr("concat('Acme ', n_nationkey) as canonical")
    learned = I.table(spark, sf, "supplier").filter("s_suppkey % 3 = 0").selectExpr("concat('Acme ', s_suppkey + 25) as name")
    return entities.learn_entities(_parsed(spark, sf), mappings, learned)


@query(
    "alias_maintenance",
    """with mappings as (select c_name as canonical, cast(null as varchar) as alias from customer),
      learned as (select s_name as name from supplier),
      new as (select 'det ' || (event_id % 500) as detected,
          case event_type when 'error' then 'Supplier#' || lpad(cast(user_id % 150 as varchar), 9, '0')
            else 'Customer#' || lpad(cast(user_id as varchar), 9, '0') end as possible_match,
          cast(80 + event_id % 20 as int) as confidence, 'f' || lpad(cast(event_id as varchar), 9, '0') as file_path from events),
      pending as (select detected, possible_match, arg_min(confidence, file_path) as confidence from new group by all),
      verdicts as (select detected, min(possible_match) as canonical, min(file_path) < 'f000000300' as confirmed
        from new where cast(substr(detected, 5) as int) % 3 < 2 group by detected),
      known as (select distinct canonical, detected as alias from verdicts where confirmed
        and (canonical in (select canonical from mappings) or canonical in (select name from learned))),
      out_map as (select * from mappings union select * from known),
      out_learned as (select name from learned where name not in (select canonical from known)
        union select detected from verdicts where not confirmed and detected not in (select canonical from mappings))
      select 'mapping' as part, canonical as name, alias as other, cast(null as int) as confidence from out_map
      union all select 'learned', name, null, null from out_learned
      union all select 'pending', detected, possible_match, confidence from pending
        where detected not in (select detected from verdicts)""",
)
def alias_maintenance(spark, sf):
    mappings = I.table(spark, sf, "customer").selectExpr("c_name as canonical", "cast(null as string) as alias")
    learned = I.table(spark, sf, "supplier").selectExpr("s_name as name")
    new = I.table(spark, sf, "events").selectExpr(
        "concat('det ', event_id % 500) as detected",
        "case event_type when 'error' then concat('Supplier#', lpad(user_id % 150, 9, '0')) "
        "else concat('Customer#', lpad(user_id, 9, '0')) end as possible_match",
        "cast(80 + event_id % 20 as int) as confidence",
        "concat('f', lpad(event_id, 9, '0')) as file_path",
    )
    pending = entities.add_pending(new.limit(0), new)
    verdicts = (
        new.filter("try_cast(substr(detected, 5) as int) % 3 < 2")
        .groupBy("detected")
        .agg(F.min("possible_match").alias("canonical"), (F.min("file_path") < "f000000300").alias("confirmed"))
    )
    maps, names, left = entities.apply_confirmations(mappings, learned, pending, verdicts)
    none_text, none_int = F.lit(None).cast("string"), F.lit(None).cast("int")
    return (
        maps.select(F.lit("mapping").alias("part"), F.col("canonical").alias("name"), F.col("alias").alias("other"), none_int.alias("confidence"))
        .unionByName(names.select(F.lit("learned").alias("part"), "name", none_text.alias("other"), none_int.alias("confidence")))
        .unionByName(
            left.select(F.lit("pending").alias("part"), F.col("detected").alias("name"), F.col("possible_match").alias("other"), "confidence")
        )
    )
