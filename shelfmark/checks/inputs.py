"""Inputs derived from the given tables, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.session import spread

FOLDER = (
    "case doc_id % 12 when 0 then 'Customers/Acme Corp' when 1 then 'a. Customers/BetaTech' "
    "when 2 then 'Vendors/Global Ind' when 3 then 'HR' when 4 then 'Finance/2023' when 5 then 'Downloads' "
    "when 6 then 'Desktop' when 7 then 'Archive/Old' when 8 then 'Work Documents/Alpha' "
    "when 9 then 'Projects/Falcon' when 10 then 'Node_Modules/pkg' else 'misc' end"
)
FILENAME = (
    "concat(case {G} % 7 when 0 then 'Invoice_Acme' when 1 then 'Proposal-Betatec' when 2 then 'Meeting Notes' "
    "when 3 then 'Plan' when 4 then 'Budget' when 5 then 'Untitled' else 'Report' end, ' ', "
    "cast({G} as string), case doc_id % 8 when 0 then '' when 1 then '_v1' when 2 then '_V2' when 3 then ' (1)' "
    "when 4 then '_FINAL' when 5 then '-draft' when 6 then '_rev3' else '-Version 4' end, "
    "case {G} % 5 when 0 then '.txt' when 1 then '.csv' when 2 then '.PDF' when 3 then '.docx' else '.md' end)"
)
REPLY = (
    "case doc_id % 5 "
    "when 0 then concat('{\"category\":\"Customers/Acme\",\"confidence\":', cast(doc_id % 11 as string), "
    "',\"entity_detected\":\"Acme ', cast(doc_id % 400 as string), '\",\"reasoning\":\"r\",\"action\":\"move\"}') "
    "when 1 then concat('Result: {\"category\":\"HR\",\"confidence\":', cast(doc_id % 10 as string), "
    "',\"reasoning\":\"r\",\"action\":\"move\"} end') "
    "when 2 then 'no json here' when 3 then '{broken' "
    "else concat('{\"category\":\"Admin\",\"confidence\":', cast(doc_id % 9 as string), "
    "',\"reasoning\":\"r\",\"action\":\"skip\"}') end"
)
ALIAS_ROWS = [
    (1, "acme corporation", "Acme Corporation"),
    (2, "acme corp", "Acme Corporation"),
    (3, "acme", "Acme Corporation"),
    (4, "beta technologies", "Beta Technologies"),
    (5, "betatech", "Beta Technologies"),
    (6, "global industries", "Global Industries"),
    (7, "globalind", "Global Industries"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def inv(spark: SparkSession, sf: str) -> DataFrame:
    """File inventory over ``documents``."""
    return inv_of(documents(spark, sf))


def inv_of(docs: DataFrame) -> DataFrame:
    hours = "make_dt_interval(0, cast((doc_id * 37) % 20000 as int))"
    base = docs.selectExpr(
        "doc_id",
        "text",
        "lang",
        "n_chars * 97 as size_bytes",
        f"timestamp_ntz'2022-01-01 00:00:00' + {hours} as modified_time",
        f"{FOLDER} as folder",
        f"{FILENAME.replace('{G}', '(doc_id div 8)')} as filename",
    )
    rel = F.concat_ws("/", "folder", "filename")
    return base.select(
        "*",
        rel.alias("relative_path"),
        F.concat(F.lit("/corpus/"), rel).alias("path"),
        P.extension_of(F.col("filename")).alias("extension"),
        P.filename_of(F.col("folder")).alias("parent_folder"),
    )


INV = f"""inv as (
  select *, '/corpus/' || relative_path as path,
    lower(regexp_extract(filename, '[^.](\\.[^.]+)$', 1)) as extension,
    regexp_extract(folder, '([^/]*)$', 1) as parent_folder
  from (select *, concat(folder, '/', filename) as relative_path from (
    select doc_id, text, lang, n_chars * 97 as size_bytes,
      timestamp '2022-01-01 00:00:00' + to_hours(cast((doc_id * 37) % 20000 as int)) as modified_time,
      {FOLDER} as folder, {FILENAME.replace('{G}', '(doc_id // 8)')} as filename
    from documents)))"""


def order_files(spark: SparkSession, sf: str) -> DataFrame:
    """A larger inventory without text, from ``orders``."""
    o = spread(table(spark, sf, "orders"), "o_orderkey")
    folder = F.concat_ws("/", F.substring("o_orderpriority", 3, 20), "o_orderstatus")
    name = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.expr(
        "case o_orderkey % 6 when 0 then '.pdf' when 1 then '_v2.pdf' when 2 then '.xlsx' when 3 then '-FINAL.xlsx' "
        "when 4 then '.docx' else '.log' end"))
    rel = F.concat_ws("/", folder, name)
    return o.select(
        "o_orderkey",
        F.concat(F.lit("/orders/"), rel).alias("path"),
        rel.alias("relative_path"),
        name.alias("filename"),
        P.extension_of(name).alias("extension"),
        F.round(F.col("o_totalprice") * 1000).cast("long").alias("size_bytes"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("modified_time"),
    )


ORDER_FILES = """order_files as (
  select *, '/orders/' || relative_path as path,
    lower(regexp_extract(filename, '[^.](\\.[^.]+)$', 1)) as extension
  from (select *, concat(folder, '/', filename) as relative_path from (
    select o_orderkey, concat(substring(o_orderpriority, 3, 20), '/', o_orderstatus) as folder,
      concat('order ', cast(o_orderkey as string), case o_orderkey % 6 when 0 then '.pdf' when 1 then '_v2.pdf'
        when 2 then '.xlsx' when 3 then '-FINAL.xlsx' when 4 then '.docx' else '.log' end) as filename,
      cast(round(o_totalprice * 1000) as bigint) as size_bytes, o_orderdate as modified_time
    from orders)))"""


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIAS_ROWS, "ord int, alias string, canonical string")


ALIASES = "aliases(ord, alias, canonical) as (values " + ", ".join(
    f"({o}, '{a}', '{c}')" for o, a, c in ALIAS_ROWS
) + ")"


def customer_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """An alias store that grows with the data: one alias per customer name."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ord"), F.lower("c_name").alias("alias"), F.col("c_name").alias("canonical")
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id", f"{REPLY} as reply")


REPLIES = f"replies as (select doc_id, {REPLY} as reply from documents)"

# the readable part of a reply: json_valid keeps broken text apart
PARSED = """parsed as (
  select doc_id, case when json_valid(j) then j->>'$.category' end as category,
    case when json_valid(j) then cast(j->>'$.confidence' as double) end as confidence,
    case when json_valid(j) then j->>'$.entity_detected' end as entity_detected,
    case when json_valid(j) then j->>'$.reasoning' end as reasoning,
    case when json_valid(j) then j->>'$.action' end as action
  from (select doc_id, coalesce(nullif(regexp_extract(reply, '(?s)\\{.*\\}', 0), ''), reply) as j from replies))"""


def critiques(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("doc_id % 4 <> 3").selectExpr(
        "doc_id",
        "doc_id % 3 = 0 as changed",
        "'Projects' as final_category",
        "cast(4 + doc_id % 6 as int) as final_confidence",
    )


CRITIQUES = """critiques as (
  select doc_id, doc_id % 3 = 0 as changed, 'Projects' as final_category,
    cast(4 + doc_id % 6 as int) as final_confidence from documents where doc_id % 4 <> 3)"""

_PROCESSED = """select cast(1 + doc_id % 3 as int) as wave, doc_id,
    case doc_id % 4 when 0 then 'Customers/Acme' when 1 then 'HR' when 2 then 'Projects' else 'Unknown' end as category,
    cast(doc_id % 11 as int) as confidence,
    case when doc_id % 4 = 3 then 'unknown' when doc_id % 11 >= 7 then 'move' else 'unknown' end as action
  from {t} where doc_id % 5 < 2"""


def processed(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of earlier waves: some documents were handled, the rest are new."""
    return spark.sql(_PROCESSED.format(t="{docs}"), docs=table(spark, sf, "documents"))


PROCESSED = f"processed as ({_PROCESSED.format(t='documents')})"


def processed_files(spark: SparkSession, sf: str) -> DataFrame:
    """``processed`` with its path, name, folder, size and time."""
    files = inv(spark, sf).select(
        "doc_id", "path", "filename", "folder", "relative_path", "size_bytes", "modified_time"
    )
    return processed(spark, sf).join(files, "doc_id")


PROCESSED_FILES = """processed_files as (
  select p.*, i.path, i.filename, i.folder, i.relative_path, i.size_bytes, i.modified_time
  from processed p join inv i on p.doc_id = i.doc_id)"""


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(ctes) + "\n" + body
