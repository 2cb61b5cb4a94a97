"""Fixture views over the driver's TPC-H-ish tables (FIXTURES.md section 2).

Each view is one portable SQL text.  Spark runs it over the base tables read
from ``sf_dir``; the DuckDB oracle uses the same text as a CTE, so both
engines see identical inputs.  Views depend on base tables only.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEW_SQL: dict[str, str] = {
    "campaigns": """
select cast(n_nationkey as string) as campaign_id, n_name as campaign_name,
  case when n_nationkey % 5 <> 0 then 'Y' else 'N' end as active,
  cast(2 + n_nationkey % 6 as decimal(4,1)) * cast(0.5 as decimal(2,1)) as auto_dial_level,
  10 + n_nationkey * 5 as hopper_level, 'NEW' as dial_status_a,
  case when n_nationkey % 3 = 0 then 'N' else 'Y' end as answering_machine_detection,
  case when n_nationkey % 4 = 0 then 'none' when n_nationkey % 4 = 1 then '' else '8320' end as am_message_exten
from nation""",
    "lists": """
select 990 + s_suppkey as list_id, s_name as list_name,
  case when s_suppkey % 7 = 0 then '000' else cast(s_nationkey as string) end as campaign_id,
  case when s_acctbal > 0 then 'Y' else 'N' end as active
from supplier""",
    "leads": """
select o_orderkey as lead_id, 990 + o_custkey % 60 as list_id,
  case when o_orderkey % 37 = 0 then '555-0' || cast(o_custkey % 100 as string)
       else '(555) ' || lpad(cast(o_custkey as string), 7, '0') end as phone_number,
  case when o_orderkey % 11 = 0 then null else 'First' || cast(o_custkey as string) end as first_name,
  case when o_orderkey % 17 = 0 then null else 'Last' || cast(o_custkey % 97 as string) end as last_name,
  case o_orderstatus when 'O' then 'NEW' when 'F' then 'SALE' else 'NA' end as status,
  o_orderdate as entry_date,
  case when o_orderkey % 5 = 0 then null else o_orderdate end as last_local_call_time,
  case when o_orderkey % 13 = 0 then null else cast(o_orderkey % 7 as int) end as called_count,
  case when o_orderkey % 2 = 0 then 'N' else 'Y' end as called_since_last_reset
from orders""",
    "alt_phones": """
select l_orderkey as lead_id, l_linenumber as alt_phone_count,
  '555' || lpad(cast(l_partkey as string), 7, '0') as phone_number
from lineitem""",
    "hopper": """
select o_orderkey as lead_id, 990 + o_custkey % 60 as list_id, cast(o_custkey % 25 as string) as campaign_id,
  case o_orderpriority when '1-URGENT' then 'READY' when '2-HIGH' then 'QUEUE'
       when '4-NOT SPECIFIED' then 'INCALL' when '5-LOW' then 'DNC' else 'READY' end as status,
  0 as priority
from orders""",
    "call_log": """
select event_id as call_id, ts as call_date, event_id as lead_id, cast(user_id as string) as agent,
  case event_type when 'view' then 'NA' when 'click' then 'AMD' when 'purchase' then 'SALE'
       when 'signup' then 'DROP' else 'INCALL' end as status
from events""",
    "agent_events": """
select event_id, ts as event_time, cast(user_id as string) as agent,
  case event_type when 'view' then 'READY' when 'click' then 'INCALL' when 'signup' then 'PAUSED'
       when 'purchase' then 'CLOSER' else 'DEAD' end as status
from events""",
    "live_agents": """
select cast(user_id as string) as agent, cast(user_id % 25 as string) as campaign_id,
  case max_by(event_type, ts) when 'view' then 'READY' when 'click' then 'INCALL' when 'signup' then 'PAUSED'
       when 'purchase' then 'CLOSER' else 'DEAD' end as status,
  max(ts) as last_update_time,
  case when user_id % 13 = 0 then '' when user_id % 13 = 1 then null when user_id % 13 = 2 then '0'
       else cast(8600000 + user_id as string) end as conf_exten
from events group by user_id""",
    "conf_slots": """
select 8600000 + p_partkey as conf_exten, '10.0.0.' || cast(p_size % 4 as string) as server_ip,
  case when p_partkey % 3 = 0 then 'confbridges' else 'conferences' end as slot_table,
  case when p_partkey % 4 = 0 then '' when p_partkey % 4 = 1 then null
       else 'SIP/' || cast(p_partkey as string) || case when p_partkey % 8 = 2 then '_B' else '' end end as extension,
  case when p_partkey % 4 < 2 then 'idle' when p_partkey % 4 = 2 then 'LIA' else 'STUCK' end as extension_status,
  o_orderdate as last_update
from part join orders on p_partkey = o_orderkey""",
    "users": """
select case when c_custkey % 9 = 0 then cast(c_custkey - 1 as string) || '_B'
            when c_custkey % 50 = 7 then 'AGENT' || cast(c_custkey as string) || 'XB'
            when c_custkey % 50 = 8 then 'VERYLONGAGENTNAME' || lpad(cast(c_custkey as string), 6, '0')
            else cast(c_custkey as string) end as user_name,
  c_name || ' of the segment ' || c_mktsegment || ' with a long tail' as full_name,
  cast(c_custkey % 6 as int) as user_level, c_mktsegment as user_group,
  case when c_acctbal > 0 then 'Y' else 'N' end as active, '10.0.0.' || cast(c_nationkey % 4 as string) as server_ip
from customer""",
    "phones": """
select cast(c_custkey as string) as extension,
  case when c_custkey % 10 = 3 then 'x' || cast(c_custkey as string) else cast(c_custkey as string) end as dialplan_number,
  cast(8300 + c_custkey as string) as conf_on_extension, cast(8301 + c_custkey as string) as park_on_extension,
  cast(8302 + c_custkey as string) as VICIDIAL_park_on_extension,
  case when c_custkey % 7 = 0 then '' else cast(8309 + c_custkey as string) end as recording_exten,
  case when c_custkey % 11 = 0 then null else cast(c_custkey as string) end as voicemail_exten,
  case when c_custkey % 3 = 0 then 'N' else 'Y' end as active, c_name as fullname
from customer where c_custkey % 2 = 0""",
    "amd_log": """
select l_partkey as amd_id, case when l_partkey % 19 = 0 then null else l_orderkey end as lead_id, l_returnflag as amd_status
from lineitem""",
    "files": """
select case p.page_id % 4 when 0 then '/var/log/asterisk/' when 1 then '/var/log/astguiclient/'
            when 2 then '/var/log/httpd/' else '/var/log/amd/' end ||
       case p.page_id % 6 when 0 then 'a.log' when 1 then 'screenlog.0' when 2 then 'b.txt'
            when 3 then 'old.gz' when 4 then 'safe_x' else 'keep.conf' end as path,
  cast(length(p.html) as bigint) * 4096 as length, o.o_orderdate as modification_time
from pages p join orders o on p.page_id = o.o_orderkey""",
    "log_lines": """
select event_id as line_no, 'host' || cast(user_id % 10 as string) as host, ts,
  '[' || substr(cast(ts as string), 1, 19) || '] ' ||
  case event_type when 'error' then 'ERROR[1]: AGI script failed to connect' when 'click' then 'NOTICE[2]: 200 OK ANSWER'
       when 'view' then 'VERBOSE[3]: CONF agent joined' when 'signup' then 'NOTICE[4]: BRIDGE created'
       else 'WARNING[5]: VDAD hopper error' end as line
from events""",
    "channel_lines": """
select event_id as line_no, 'SIP/' || cast(user_id as string) || '-0001  ' || cast(user_id as string) || '@default  ' ||
  case event_type when 'view' then 'Up' when 'click' then 'Ring' when 'signup' then 'Down' else 'Ringing' end ||
  '  Dial(SIP/x)' as line
from events""",
    "kv_lines": """
select event_id as line_no, 'host' || cast(user_id % 10 as string) as host,
  case event_type when 'view' then 'Status       : OK (' || cast(cast(floor(value) as bigint) as string) || 'ms)'
       when 'click' then 'Codecs       : (ulaw|g729)' when 'signup' then 'DirectMedia  : No'
       when 'purchase' then case when user_id % 10 > 7 then 'Transport    : UDP' when event_id % 3 = 0 then 'rtpstart=10000'
         when event_id % 3 = 1 and user_id % 2 = 0 then 'jbimpl=adaptive'
         else 'jbmaxsize=' || cast(100 + event_id % 5 * 100 as string) end
       else case when user_id % 10 > 7 then 'Qualify      : yes' when user_id % 10 = 5 then 'jbenable=no' else 'jbenable=yes' end
  end as line
from events""",
    "metric_samples": """
select event_id as sample_id, 'host' || cast(user_id % 10 as string) as host, ts,
  case event_id % 11 when 0 then 'rtt_ms' when 1 then 'iowait' when 2 then 'mem_avail_mb' when 3 then 'pkt_loss'
       when 4 then 'load1' when 5 then 'load5' when 6 then case when user_id % 10 = 8 then 'other' else 'cores' end
       when 7 then case when user_id % 10 = 9 then 'other' else 'nice' end
       when 8 then case when user_id % 10 in (7, 9) then 'other' else 'rt_priority' end
       when 9 then 'timing_pct' else 'jitter_ms' end as metric,
  case event_id % 11 when 0 then value * 2 when 1 then value / 5 when 2 then value * 10 when 3 then floor(value / 40)
       when 4 then value / 8 when 5 then value / 8 when 6 then 8 when 7 then floor(value / 100) - 1
       when 8 then floor(value / 30) when 9 then 100 - value / 1000 else value / 3 end as value
from events""",
    "peers": """
select cast(c_custkey as string) as peer,
  case when c_custkey % 10 = 9 then 'UNREACHABLE' else 'OK (' || cast(c_custkey * 7 % 220 as string) || 'ms)' end as status,
  case when c_custkey % 6 = 0 then 'no' else 'yes' end as qualify,
  case c_custkey % 4 when 0 then '(ulaw|alaw)' when 1 then '(g729|ulaw)' when 2 then '(alaw)' else '(opus)' end as codecs,
  case c_custkey % 5 when 0 then 'Yes' when 1 then 'update' else 'No' end as direct_media
from customer""",
    "process_rows": """
select event_id as row_no, 'host' || cast(user_id % 10 as string) as host,
  case event_type when 'error' then 'perl AST_VDauto_dial.pl VDAD' when 'click' then 'perl FastAGI_log.pl'
       when 'view' then case when user_id % 10 < 7 then 'manager vicidial cron' else 'sshd' end else 'mysqld' end as line
from events""",
    # derived inputs (FIXTURES.md section 2, last paragraph)
    "servers": """
select server_ip, case when server_ip in ('10.0.0.0', '10.0.0.1') then 'CONFBRIDGE' else 'MEETME' end as conf_engine
from (select distinct '10.0.0.' || cast(p_size % 4 as string) as server_ip from part) s""",
}

# Fixed parameters for oracle runs (FIXTURES.md section 3); the operators'
# own defaults stay the reference's values.
AS_OF = "2024-01-31 00:00:00"
MIDNIGHT_AS_OF = "2024-01-30 12:00:00"
FILE_AS_OF = "1998-06-01 00:00:00"
AGENT_ACTIVE_LOOKBACK = "12 hours"
AGENT_STATE_LOOKBACK = "1 day"
CALL_RATE_LOOKBACK = "7 days"
OUTCOME_LOOKBACK = "14 days"
LOG_LOOKBACK = "1 day"
IDLE_WARN_SECONDS, IDLE_FAIL_SECONDS = 14_400, 43_200
HOPPER_NEARLY_EMPTY, HOPPER_LOW = 590, 620
AMD_HIGH_PCT, AMD_ELEVATED_PCT = 25, 15
ROWS_PER_LIST = 40
TARGET_CAMPAIGN = "7"

_VIEW_NAME = re.compile(r"\b(" + "|".join(sorted(VIEW_SQL, key=len, reverse=True)) + r")\b")


def views_used(sql: str) -> list[str]:
    """View names referenced by ``sql`` in definition order."""
    found = set(_VIEW_NAME.findall(sql))
    return [v for v in VIEW_SQL if v in found]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it references as CTEs."""
    used = views_used(sql)
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{v} as ({VIEW_SQL[v].strip()})" for v in used)
    body = sql.strip()
    if re.match(r"(?is)^with\s", body):
        return f"with {ctes},\n{body[4:].lstrip()}"
    return f"with {ctes}\n{body}"


class Fixture:
    """Lazily built fixture views over the parquet tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """The fixture view ``name``; one DataFrame per fixture and view."""
        if name not in self._views:
            self._views[name] = self._build(name)
        return self._views[name]

    def _build(self, name: str) -> DataFrame:
        sql = VIEW_SQL[name]
        tables = {t: self.table(t) for t in BASE_TABLES if re.search(rf"\b{t}\b", sql)}
        # DataFrame arguments bind the base tables of this sf_dir only, so
        # concurrent fixtures over other scales never see each other.
        text = sql
        for t in tables:
            text = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_SQL:
            return self.view(name)
        if name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)

    # Derived inputs for the import tests: package = lists with list_id % 3 = 0,
    # destination = lists with list_id % 2 = 0, each with its leads.
    @cached_property
    def package_lists(self) -> DataFrame:
        return self.lists.where("list_id % 3 = 0")

    @cached_property
    def destination_lists(self) -> DataFrame:
        return self.lists.where("list_id % 2 = 0")

    @cached_property
    def package_leads(self) -> DataFrame:
        return self.leads.where("list_id % 3 = 0")

    @cached_property
    def destination_leads(self) -> DataFrame:
        return self.leads.where("list_id % 2 = 0")


PACKAGE_LISTS_SQL = "(select * from lists where list_id % 3 = 0)"
DESTINATION_LISTS_SQL = "(select * from lists where list_id % 2 = 0)"
PACKAGE_LEADS_SQL = "(select * from leads where list_id % 3 = 0)"
DESTINATION_LEADS_SQL = "(select * from leads where list_id % 2 = 0)"
