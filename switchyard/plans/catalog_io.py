"""Catalogue: scans, sources and sinks with oracle SQL.

Sinks write into the shared scratch folder (under ``spark.checkpoint.dir``)
and return what they wrote read back from storage, so the oracle checks the
round trip, not just the frame before the write.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..operators.aggregates import LOG_DIRS
from ..operators.setops import union_all
from ..sinks import blocks as BL
from ..sinks import checksums as CK
from ..sinks import export as EX
from ..sinks import versioned as V
from ..sources import files as FI
from ..sources import log_zones as LZ
from ..sources import sql_dump as SD
from ..sources import tables as TB
from ..sources import text as TX
from . import fixtures as P
from .catalog_checks import FIND_LOG_ERRORS_SQL, FINDINGS_SQL, healthcheck_findings
from .registry import register
from .sqlbits import kv_sql, sql_ago, sql_ts, sql_within


@register("src_table", section="2.1", oracle="select * from leads")
def src_table(fx):
    root = scratch_path(fx.spark, "tables")
    fx.leads.write.parquet(f"{root}/leads")
    return TB.read_table(fx.spark, "leads", "parquet", root)


@register("src_table_parquet", section="2.1", oracle="select * from orders")
def src_table_parquet(fx):
    return TB.read_table(fx.spark, "orders", "parquet", fx.sf_dir)


# A text column with quotes, backslashes, '),(' and parentheses, to exercise
# the quote-aware tuple split.
_NOTE_SQL = ("case when o_orderkey % 7 = 0 then 'it''s),(' || o_orderpriority "
             "when o_orderkey % 11 = 0 then null else 'back\\slash \"q\" (x), y' end")
DUMP_SOURCE_SQL = f"""select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
  {_NOTE_SQL} as note from orders"""
DUMP_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string, note string")


@register("src_sql_dump", section="2.1", oracle=f"""
select s.*, (select count(*) from orders where o_orderkey % 101 = 0) as rejected_tuples,
  (select count(*) from orders where o_orderkey % 103 = 0) as rejected_lines from ({DUMP_SOURCE_SQL}) s""")
def src_sql_dump(fx):
    """Orders as a dump: one-line statements, statements of a line a tuple, another table in the same files, broken lines."""
    k = F.col("o_orderkey")
    note = (F.when(k % 7 == 0, F.concat(F.lit("it's),("), F.col("o_orderpriority")))
            .when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.lit('back\\slash "q" (x), y')))
    rows = fx.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                            "o_orderpriority", note.alias("note"))
    long = F.floor(k / 50) % 2 == 0
    # beside the good lines, some with too few fields and some cut off inside a string
    short = fx.orders.where(k % 101 == 0).select(F.format_string("INSERT INTO `orders` VALUES (%d,'short');", k).alias("value"))
    cut = fx.orders.where(k % 103 == 0).select(F.format_string("INSERT INTO `orders` VALUES (%d,'cut", k).alias("value"))
    path, out = scratch_path(fx.spark, "dump"), scratch_path(fx.spark, "dump-rows")
    text = SD.dump_lines(rows.where(long), "orders", 50, "o_orderkey").unionByName(
        SD.dump_lines(rows.where(~long), "orders", 50, "o_orderkey", verb="replace into", tuple_lines=True)).unionByName(
        SD.dump_lines(rows, "other_orders", 500, "o_orderkey", tuple_lines=True))
    text.unionByName(short).unionByName(cut).write.text(path)
    entries = SD.load_dump(fx.spark, path, DUMP_SCHEMA, out, table="orders")
    counts = SD.tally_of(entries).select(F.struct("rejected_tuples", "rejected_lines")).scalar()
    return SD.rows_of(entries).select("*", counts["rejected_tuples"].alias("rejected_tuples"), counts["rejected_lines"].alias("rejected_lines"))


@register("src_log_lines", section="2.1", oracle=f"""
select line_no, host, line, try_strptime(regexp_extract(line, '{TX.LOG_RX}', 1), '%Y-%m-%d %H:%M:%S') as ts,
  nullif(regexp_extract(line, '{TX.LOG_RX}', 2), '') as level,
  nullif(regexp_extract(line, '{TX.LOG_RX}', 3), '') as component,
  regexp_extract(line, '{TX.LOG_RX}', 4) as message
from log_lines""")
def src_log_lines(fx):
    return TX.parse_log_lines(fx.log_lines.drop("ts"))


@register("src_kv_text", section="2.1", oracle=f"select * from {kv_sql('kv_lines', TX.PEER_KEYS + TX.CONFIG_KEYS)} k")
def src_kv_text(fx):
    return TX.extract_kv(fx.kv_lines, TX.PEER_KEYS + TX.CONFIG_KEYS)


@register("src_column_text", section="2.1", oracle=f"""
select line_no, string_split_regex(trim(line), '\\s+')[1] as channel, string_split_regex(trim(line), '\\s+')[2] as location,
  string_split_regex(trim(line), '\\s+')[3] as state, string_split_regex(trim(line), '\\s+')[4] as application
from channel_lines where not regexp_matches(line, '{TX.CHANNEL_DROP}')""")
def src_column_text(fx):
    return TX.parse_columns(fx.channel_lines)


@register("src_file_inventory", section="2.1")
def src_file_inventory(fx):
    # the inventory of the table files themselves; no SQL oracle can list files
    return FI.file_inventory(fx.spark, [fx.sf_dir], glob="*.parquet")


LEAD_CSV_SQL = """select list_id, phone_number, coalesce(first_name, '') as first_name, coalesce(last_name, '') as last_name,
  '' as email, '' as address1, '' as city, '' as state, '' as postal_code, coalesce(status, '') as status,
  coalesce(strftime(entry_date, '%Y-%m-%d %H:%M:%S'), '') as entry_date,
  coalesce(strftime(last_local_call_time, '%Y-%m-%d %H:%M:%S'), '') as last_local_call_time,
  coalesce(called_count, 0) as called_count from leads"""


@register("snk_lead_csv", section="2.1", oracle=LEAD_CSV_SQL)
def snk_lead_csv(fx):
    return EX.export_leads_csv(fx.leads, scratch_path(fx.spark, "leads-csv"))


@register("snk_table_package", section="2.1", oracle="""
select 'lists' as table_name, count(*) as row_count from lists
union all select 'leads', count(*) from leads
union all select 'alt_phones', count(*) from alt_phones""")
def snk_table_package(fx):
    return EX.export_package({"lists": fx.lists, "leads": fx.leads, "alt_phones": fx.alt_phones},
                             scratch_path(fx.spark, "package"))


@register("snk_manifest", section="2.1", oracle="""
select l.list_id, l.list_name, l.campaign_id, l.active, coalesce(c.n, 0) as lead_count,
  (select count(*) from lists) as total_lists, (select count(*) from leads) as total_leads,
  (select count(*) from alt_phones) as total_alt
from lists l left join (select list_id, count(lead_id) as n from leads group by list_id) c on l.list_id = c.list_id""")
def snk_manifest(fx):
    return EX.package_manifest(fx.lists, fx.leads, fx.alt_phones)


@register("snk_checksums", section="2.1", oracle="select doc_id, sha256(text) as sha256 from documents")
def snk_checksums(fx):
    return CK.text_checksums(fx.documents, "doc_id", "text")


@register("verify_checksums", section="2.1", oracle="""
with e as (select doc_id, sha256(text) as d from documents where doc_id % 17 <> 0),
     a as (select doc_id, sha256(case when doc_id % 10 = 3 then text || 'x' else text end) as d from documents
           where doc_id % 19 <> 0)
select coalesce(e.doc_id, a.doc_id) as doc_id,
  case when a.doc_id is null then 'missing' when e.doc_id is null then 'extra' when a.d = e.d then 'match'
       else 'mismatch' end as status
from e full outer join a on e.doc_id = a.doc_id""")
def verify_checksums(fx):
    docs = fx.documents
    expected = CK.text_checksums(docs.where(F.col("doc_id") % 17 != 0), "doc_id", "text")
    edited = docs.where(F.col("doc_id") % 19 != 0).select(
        "doc_id", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    actual = CK.text_checksums(edited, "doc_id", "text")
    return CK.verify_checksums(actual, expected, key="doc_id")


BLOCK = 4096  # bytes, so that the files of the test tables have several blocks
# a day's calls as the lines of its file
_CALL_LINES_SQL = """select cast(call_date as date)::varchar as day, call_id, call_id || ',' || lead_id || ',' || agent || ',' || status || chr(10) as line from call_log"""


def _calls_package(fx, calls, name):
    """Calls as one text file a day, written as a package; the file of a day is named by its folder."""
    path = scratch_path(fx.spark, name)
    rows = calls.select(F.date_format("call_date", "yyyy-MM-dd").alias("day"), "call_id", "lead_id", "agent", "status")
    EX.export_package({"calls": rows}, path, required=("calls",), fmt="csv", by={"calls": ("day", ["call_id"])})
    blocks = BL.block_digests(fx.spark, f"{path}/calls", BLOCK, glob="*.csv")
    return blocks.withColumn("file", F.regexp_extract("file", "^day=([^/]+)/", 1))


@register("snk_package_blocks", section="2.1", oracle=f"""
with f as (select day, string_agg(line, '' order by call_id) as content from ({_CALL_LINES_SQL}) l group by day),
b as (select day, content, unnest(range(0, cast(ceil(length(content) / {BLOCK}.0) as bigint))) as block from f)
select day as file, block, sha256(substring(content, block * {BLOCK} + 1, {BLOCK})) as sha256 from b""")
def snk_package_blocks(fx):
    return _calls_package(fx, fx.call_log, "blocks")


@register("verify_package", section="2.1", oracle=f"""
with l as (select *, dayofmonth(cast(day as date)) as d, sum(length(line)) over (partition by day order by call_id) as upto from ({_CALL_LINES_SQL}) x),
days as (select distinct day, d from l)
select day as file, cast(null as bigint) as block, case when d = 3 then 'missing' when d = 5 then 'extra' else 'match' end as status from days
where d in (3, 5) or day not in (select day from l where call_id % 5000 = 7 or call_id % 5000 = 11)
union all
select distinct day, cast((upto - 2) // {BLOCK} as bigint), 'changed' from l where call_id % 5000 in (7, 11) and d not in (3, 5)""")
def verify_package(fx):
    """A package against the tree recorded of it: one day lost, one added, the last letter of some calls' status changed."""
    day = F.dayofmonth("call_date")
    changed = F.concat(F.expr("left(status, length(status) - 1)"), F.lit("#"))
    edited = fx.call_log.withColumn("status", F.when(F.col("call_id") % 5000 == 7, changed).when(F.col("call_id") % 5000 == 11, changed).otherwise(F.col("status")))
    recorded = BL.block_tree(_calls_package(fx, fx.call_log.where(day != 5), "recorded"), scratch_path(fx.spark, "recorded-tree"))
    actual = BL.block_tree(_calls_package(fx, edited.where(day != 3), "actual"), scratch_path(fx.spark, "actual-tree"))
    return BL.differences(actual, recorded)


@register("snk_chunked", section="2.1", oracle="select * from leads")
def snk_chunked(fx):
    return EX.write_chunked(fx.leads, scratch_path(fx.spark, "chunked"), rows=1000)


@register("snk_findings", section="2.1", oracle=f"select side, count(*) as findings from {FINDINGS_SQL} u group by side")
def snk_findings(fx):
    return EX.write_findings(healthcheck_findings(fx), scratch_path(fx.spark, "findings"))


@register("snk_action_log", section="2.1", oracle=f"""
select {sql_ts(P.FILE_AS_OF)} as run_ts, total as total_bytes,
  cast(((total * 100) // 1024) // 1024 as double) / 100 as total_mb,
  case when total > {500 * 1024 * 1024} then 'Deleted file logs and truncated archives'
       else 'Truncated archives only (file logs under threshold)' end as action
from (select cast(coalesce(sum(length), 0) as bigint) as total from files
      where {' or '.join(f"starts_with(path, '{r}/')" for r in LOG_DIRS)}) t""")
def snk_action_log(fx):
    return EX.append_audit(EX.cleanup_audit_row(fx.files, P.FILE_AS_OF), scratch_path(fx.spark, "audit"))


# what stands for each archive table, in the order of ARCHIVE_TABLES
ARCHIVED_VIEWS = ("call_log", "leads", "alt_phones", "hopper", "peers", "metric_samples", "agent_events", "live_agents", "amd_log")


@register("truncate_archive", section="2.1", oracle=" union all ".join(
    f"select '{t}' as table_name, count(*) as rows_before, cast(0 as bigint) as rows_after from {v}"
    for t, v in zip(V.ARCHIVE_TABLES, ARCHIVED_VIEWS)))
def truncate_archive(fx):
    """All nine archive tables emptied by one change; ``rows_after`` is counted in what is left."""
    root = scratch_path(fx.spark, "archive")
    V.commit_tables({t: fx.view(v) for t, v in zip(V.ARCHIVE_TABLES, ARCHIVED_VIEWS)}, root)
    done = V.truncate_tables(fx.spark, root).drop("rows_after")
    left = [V.read_committed(fx.spark, root, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("rows_after"))
            for t in V.ARCHIVE_TABLES]
    return done.join(union_all(*left), "table_name")


def _day_logs(fx):
    """The service log as one file a day."""
    path = scratch_path(fx.spark, "logs")
    rows = fx.log_lines.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "line")
    EX.export_package({"logs": rows}, path, required=("logs",), fmt="text", by={"logs": ("day", ["line"])})
    return f"{path}/logs"


@register("src_log_window", section="2.1", oracle=f"""
with t as (select line, try_strptime(regexp_extract(line, '{TX.LOG_RX}', 1), '%Y-%m-%d %H:%M:%S') as ts,
  nullif(regexp_extract(line, '{TX.LOG_RX}', 2), '') as level,
  nullif(regexp_extract(line, '{TX.LOG_RX}', 3), '') as component,
  regexp_extract(line, '{TX.LOG_RX}', 4) as message, cast(ts as date) as day from log_lines),
days as (select day, max(ts) > {sql_ago(P.AS_OF, P.LOG_LOOKBACK)} and min(ts) <= {sql_ts(P.AS_OF)} as is_in from t group by day)
select line, ts, level, component, message, (select count(*) from days where is_in) as files_read
from t where {sql_within('ts', P.AS_OF, P.LOG_LOOKBACK)}""")
def src_log_window(fx):
    """The look-back over a folder of daily logs, and how many of its files that takes."""
    logs, root = _day_logs(fx), scratch_path(fx.spark, "log-zones")
    LZ.update_zones(fx.spark, logs, root)
    zones = V.read_committed(fx.spark, root, LZ.ZONES)
    files = LZ.files_in_window(fx.spark, logs, zones, P.AS_OF, P.LOG_LOOKBACK).agg(F.count(F.lit(1))).scalar()
    lines = LZ.read_window(fx.spark, logs, zones, P.AS_OF, P.LOG_LOOKBACK)
    return lines.select("line", "ts", "level", "component", "message", files.alias("files_read"))


@register("find_log_errors_files", section="2.9", oracle=FIND_LOG_ERRORS_SQL)
def find_log_errors_files(fx):
    return LZ.find_log_errors(fx.spark, _day_logs(fx), scratch_path(fx.spark, "log-zones"), P.AS_OF, P.LOG_LOOKBACK)
