"""Catalogue: projections, filters, joins, aggregates, windows, top-k and set
operations (SURVEY sections 2.2 to 2.7) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggregates as A
from ..operators import changes as C
from ..operators import checks as K
from ..operators import filters as Fl
from ..operators import joins as J
from ..operators import rules as R
from ..operators import topk as T
from ..operators import windows as W
from ..operators.setops import append_rows
from ..sources import text as TX
from . import fixtures as P
from .registry import register
from .sqlbits import (ELIGIBLE_SQL, ELIGIBLE_TABLE_SQL, RECENT_CALLS_SQL, graded_sql, sql_round_half_up_ratio,
                      sql_truncate_ratio, sql_ts, sql_values, sql_within)

AS_OF_SQL = sql_ts(P.AS_OF)

# ---------------------------------------------------------------- 2.2 filters


@register("lead_projection", section="2.2", oracle="""
select list_id, phone_number, coalesce(first_name, '') as first_name, coalesce(last_name, '') as last_name,
  '' as email, '' as address1, '' as city, '' as state, '' as postal_code, coalesce(status, '') as status,
  coalesce(strftime(entry_date, '%Y-%m-%d %H:%M:%S'), '') as entry_date,
  coalesce(strftime(last_local_call_time, '%Y-%m-%d %H:%M:%S'), '') as last_local_call_time,
  coalesce(called_count, 0) as called_count
from leads""")
def lead_projection(fx):
    return Fl.project_leads(fx.leads)


_LABEL_VALUES = sql_values([r for r in Fl.STATUS_LABELS if r[0] == "disposition"], ["kind", "code", "label", "severity"],
                           alias="d")


@register("status_label", section="2.2", oracle=f"""
select c.call_id, c.call_date, c.lead_id, c.agent, c.status, coalesce(d.label, 'other') as label,
  coalesce(d.severity, 'info') as severity
from call_log c left join {_LABEL_VALUES} on c.status = d.code""")
def status_label(fx):
    return Fl.label_status(fx.call_log, "disposition")


@register("filter_recent", section="2.2", oracle=f"select * from {RECENT_CALLS_SQL} r")
def filter_recent(fx):
    return Fl.recent(fx.call_log, "call_date", P.AS_OF, P.CALL_RATE_LOOKBACK)


@register("filter_since_midnight", section="2.2", oracle=f"""
select * from call_log where call_date > date_trunc('day', {sql_ts(P.MIDNIGHT_AS_OF)}) and call_date <= {sql_ts(P.MIDNIGHT_AS_OF)}
  and status not in ('DROP', 'ABAND')""")
def filter_since_midnight(fx):
    return Fl.since_midnight(fx.call_log, "call_date", P.MIDNIGHT_AS_OF)


@register("filter_in_set", section="2.2", oracle="select * from lists where list_id not in (998, 999, 1001)")
def filter_in_set(fx):
    return Fl.in_set(fx.lists, "list_id", C.PROTECTED_LISTS, negate=True)


@register("filter_suffix", section="2.2", oracle="select * from users where suffix(user_name, '_B')")
def filter_suffix(fx):
    return Fl.shadow_rows(fx.users, "user_name")


@register("filter_suffix_wildcard", section="2.2", oracle="select * from users where user_name like '%_B'")
def filter_suffix_wildcard(fx):
    return Fl.shadow_rows(fx.users, "user_name", wildcard=True)


@register("filter_blank", section="2.2", oracle="select * from live_agents where conf_exten is null or conf_exten in ('', '0')")
def filter_blank(fx):
    return fx.live_agents.where(X.blank("conf_exten"))


@register("eligible_agents", section="2.2", oracle=f"select * from {ELIGIBLE_SQL} e")
def eligible_agents(fx):
    return Fl.eligible_agents(fx.users)


@register("filter_regex_lines", section="2.2", oracle=f"""
select line_no, line from log_lines where regexp_matches(line, '{K.CALL_FLOW_INCLUDE}')
  and not regexp_matches(line, '{K.CALL_FLOW_EXCLUDE}')""")
def filter_regex_lines(fx):
    return Fl.grep_lines(fx.log_lines, K.CALL_FLOW_INCLUDE, K.CALL_FLOW_EXCLUDE).select("line_no", "line")


@register("invalid_phone", section="2.2", oracle="""
select lead_id, phone_number from leads where length(regexp_replace(phone_number, '[^0-9]', '', 'g')) < 10""")
def invalid_phone(fx):
    return fx.leads.where(Fl.invalid_phone("phone_number")).select("lead_id", "phone_number")


@register("campaign_settings", section="2.2", oracle="""
select campaign_id, campaign_name, active, dial_status_a, cast(auto_dial_level as double) as auto_dial_level,
  hopper_level, answering_machine_detection, am_message_exten,
  auto_dial_level > 3 as aggressive_dial,
  answering_machine_detection = 'N' and coalesce(am_message_exten, '') <> '' and coalesce(am_message_exten, '') <> 'none'
    as amd_off_message_set
from campaigns where active = 'Y'""")
def campaign_settings(fx):
    return Fl.campaign_flags(fx.campaigns)


_JUNK_RX = X.glob_to_regex(Fl.JUNK_GLOBS)


@register("retention_by_glob", section="2.2", oracle=f"""
select * from files where regexp_matches(string_split(path, '/')[-1], '{_JUNK_RX}')""")
def retention_by_glob(fx):
    return Fl.junk_files(fx.files)


_POLICY_VALUES = sql_values([(r, X.glob_to_regex(g), g, d) for r, g, d in Fl.AGE_POLICY],
                            ["root", "name_regex", "name_glob", "days"], alias="p")


@register("retention_by_age", section="2.2", oracle=f"""
select f.path, p.root, p.name_glob, p.days, f.age_days from
  (select path, string_split(path, '/')[-1] as name,
          cast(floor(date_sub('second', modification_time, {sql_ts(P.FILE_AS_OF)}) / 86400) as bigint) as age_days
   from files) f
join {_POLICY_VALUES} on starts_with(f.path, p.root || '/') and regexp_matches(f.name, p.name_regex)
where f.age_days > p.days""")
def retention_by_age(fx):
    return Fl.expired_files(fx.files, P.FILE_AS_OF)


# ------------------------------------------------------------------ 2.3 joins


@register("join_list_lead_counts", section="2.3", oracle="""
select l.list_id, l.list_name, coalesce(c.n, 0) as total_leads
from lists l left join (select list_id, count(*) as n from leads where lead_id is not null group by list_id) c
  on l.list_id = c.list_id""")
def join_list_lead_counts(fx):
    return J.list_lead_counts(fx.lists, fx.leads)


HOPPER_CAMPAIGN_SQL = """(select h.campaign_id, count(*) as hopper_count, c.dial_status_a, c.hopper_level,
  cast(c.auto_dial_level as double) as auto_dial_level
from hopper h join campaigns c on h.campaign_id = c.campaign_id where c.active = 'Y'
group by h.campaign_id, c.dial_status_a, c.hopper_level, c.auto_dial_level)"""


@register("join_hopper_campaign", section="2.3", oracle=f"select * from {HOPPER_CAMPAIGN_SQL} x")
def join_hopper_campaign(fx):
    return J.hopper_by_campaign(fx.hopper, fx.campaigns)


def agent_math_sql(lookback: str) -> str:
    return f"""(select a.campaign_id, count(case when a.status = 'READY' then 1 end) as ready_agents,
  count(case when a.status = 'INCALL' then 1 end) as incall_agents, count(*) as total_agents,
  cast(c.auto_dial_level as double) as auto_dial_level
from live_agents a join campaigns c on a.campaign_id = c.campaign_id
where {sql_within('a.last_update_time', P.AS_OF, lookback)} and c.active = 'Y'
group by a.campaign_id, c.auto_dial_level)"""


@register("join_agent_campaign", section="2.3", oracle=f"select * from {agent_math_sql(P.AGENT_ACTIVE_LOOKBACK)} x")
def join_agent_campaign(fx):
    return J.agent_math(fx.live_agents, fx.campaigns, P.AS_OF, P.AGENT_ACTIVE_LOOKBACK)


@register("join_lead_hopper", section="2.3", oracle="""
select l.lead_id, l.list_id, l.phone_number, l.called_count, h.status as hopper_status, h.campaign_id as hopper_campaign
from leads l join hopper h on l.lead_id = h.lead_id""")
def join_lead_hopper(fx):
    return J.hopper_leads(fx.leads, fx.hopper)


@register("anti_null_aware", section="2.3", oracle="""
select * from amd_log where lead_id not in (select lead_id from leads where status = 'NEW')""")
def anti_null_aware(fx):
    return J.not_in_subquery(fx.amd_log, fx.leads.where(F.col("status") == "NEW"), "lead_id")


@register("anti_missing_shadow", section="2.3", oracle=f"""
select e.user_name, e.server_ip, e.slot_table,
  not exists (select 1 from users u where u.user_name = e.user_name || '_B') as missing_user,
  not exists (select 1 from phones p where p.extension = e.user_name || '_B') as missing_phone,
  not exists (select 1 from conf_slots s where s.server_ip = e.server_ip and s.slot_table = e.slot_table
              and (s.extension = 'SIP/' || e.user_name || '_B' or s.extension = e.user_name || '_B')) as missing_slot
from {ELIGIBLE_TABLE_SQL} e""")
def anti_missing_shadow(fx):
    return J.missing_shadows(Fl.eligible_agents(fx.users), fx.users, fx.phones, fx.conf_slots, fx.servers)


@register("semi_exists", section="2.3", oracle="""
select * from users u where exists (select 1 from phones p where p.extension = u.user_name and p.active = 'Y')""")
def semi_exists(fx):
    return J.exists_in(fx.users, fx.phones.where(F.col("active") == "Y"), "user_name", "extension")


@register("id_collisions", section="2.3", oracle=f"""
select p.list_id, exists (select 1 from {P.DESTINATION_LISTS_SQL} d where d.list_id = p.list_id) as collides
from (select distinct list_id from {P.PACKAGE_LISTS_SQL} x) p""")
def id_collisions(fx):
    return J.id_collisions(fx.package_lists, fx.destination_lists)


NEW_ID_MAP_SQL = f"""(select list_id as old_id,
  greatest((select max(list_id) from {P.DESTINATION_LISTS_SQL} a), (select max(list_id) from {P.PACKAGE_LISTS_SQL} b))
    + row_number() over (order by list_id) as new_id
from (select distinct list_id from {P.PACKAGE_LISTS_SQL} p
      where list_id in (select list_id from {P.DESTINATION_LISTS_SQL} d)) c)"""


def new_id_map(fx):
    coll = J.id_collisions(fx.package_lists, fx.destination_lists).where("collides").select("list_id")
    base = F.greatest(fx.destination_lists.select(F.max("list_id")).scalar(),
                      fx.package_lists.select(F.max("list_id")).scalar())
    return W.assign_new_ids(coll, "list_id", base).select(F.col("list_id").alias("old_id"), "new_id")


@register("join_remap", section="2.3", oracle=f"""
select l.lead_id, coalesce(m.new_id, l.list_id) as list_id, l.list_id as old_list_id
from {P.PACKAGE_LEADS_SQL} l left join {NEW_ID_MAP_SQL} m on l.list_id = m.old_id""")
def join_remap(fx):
    return J.remap_ids(fx.package_leads.select("lead_id", "list_id"), new_id_map(fx), "list_id",
                       keep_old_as="old_list_id")


NEEDS_SQL = f"""(select e.user_name, e.server_ip, e.slot_table from {ELIGIBLE_TABLE_SQL} e
 where not exists (select 1 from conf_slots s where s.server_ip = e.server_ip and s.slot_table = e.slot_table
   and (s.extension = 'SIP/' || e.user_name || '_B' or s.extension = e.user_name || '_B')))"""
FREE_SLOTS_SQL = "(select server_ip, slot_table, conf_exten from conf_slots where extension is null or extension = '')"


@register("join_rank_zip", section="2.3", oracle=f"""
with n as (select user_name, server_ip, slot_table,
             row_number() over (partition by server_ip, slot_table order by user_name) as rn from {NEEDS_SQL} x),
     f as (select server_ip, slot_table, conf_exten,
             row_number() over (partition by server_ip, slot_table order by conf_exten) as rn from {FREE_SLOTS_SQL} y)
select n.server_ip, n.slot_table, n.rn, n.user_name, f.conf_exten as slot_conf_exten
from n left join f on n.server_ip = f.server_ip and n.slot_table = f.slot_table and n.rn = f.rn""")
def join_rank_zip(fx):
    needs = J.missing_shadows(Fl.eligible_agents(fx.users), fx.users, fx.phones, fx.conf_slots, fx.servers) \
        .where("missing_slot").select("user_name", "server_ip", "slot_table")
    return J.zip_assign(needs, C.free_slots(fx.conf_slots), ["server_ip", "slot_table"], ["user_name"], ["conf_exten"]).select(
        "server_ip", "slot_table", "rn", "user_name", "slot_conf_exten")


_ALL_RULES = R.HOST_RULES + R.NETWORK_RULES


@register("join_grade_rules", section="2.3",
          oracle=f"select * from {graded_sql('metric_samples', ['sample_id', 'host', 'ts', 'metric', 'value'], _ALL_RULES)} g")
def join_grade_rules(fx):
    return K.grade_samples(fx.metric_samples)


@register("join_verify_import", section="2.3", oracle=f"""
with ids as (select distinct list_id from {P.PACKAGE_LISTS_SQL} p),
     lc as (select list_id, count(*) as n from leads group by list_id),
     hc as (select list_id, count(*) as n from hopper group by list_id)
select i.list_id, l.list_name, coalesce(lc.n, 0) as lead_count, coalesce(lc.n, 0) as cache_dialable,
  l.campaign_id, 'Y' as active, coalesce(hc.n, 0) as hopper_count
from ids i left join lists l on i.list_id = l.list_id left join lc on i.list_id = lc.list_id
left join hc on i.list_id = hc.list_id""")
def join_verify_import(fx):
    ids = fx.package_lists.select("list_id")
    rebuilt = C.rebuild_cache(fx.lists, fx.leads, ids, P.AS_OF)
    return J.verify_import(rebuilt, fx.leads, fx.hopper, ids)


# ------------------------------------------------------------- 2.4 aggregates


@register("agg_count", section="2.4", oracle="""
select count(*) as row_count, count(*) filter (where status = 'NEW') as matching from leads""")
def agg_count(fx):
    return A.count_rows(fx.leads, F.col("status") == "NEW")


@register("agg_status_count", section="2.4", oracle="select status, count(*) as count from hopper group by status")
def agg_status_count(fx):
    return A.status_counts(fx.hopper)


@register("agg_state_breakdown", section="2.4", oracle=f"""
select status, count(*) as count,
  {sql_round_half_up_ratio(f"sum(date_sub('second', last_update_time, {AS_OF_SQL}))", 'count(*)')} as avg_seconds_in_state
from live_agents where {sql_within('last_update_time', P.AS_OF, P.AGENT_STATE_LOOKBACK)} group by status""")
def agg_state_breakdown(fx):
    return A.state_breakdown(fx.live_agents, P.AS_OF, P.AGENT_STATE_LOOKBACK)


@register("agg_conditional_count", section="2.4", oracle="""
select campaign_id, count(case when status = 'READY' then 1 end) as ready,
  count(case when status = 'INCALL' then 1 end) as incall, count(case when status = 'PAUSED' then 1 end) as paused,
  count(*) as total
from live_agents group by campaign_id""")
def agg_conditional_count(fx):
    st = F.col("status")
    return A.conditional_counts(fx.live_agents, {"ready": st == "READY", "incall": st == "INCALL",
                                                 "paused": st == "PAUSED"}, ["campaign_id"])


@register("agg_multi_metric", section="2.4", oracle=f"""
select count(*) filter (where r) as agents_logged_in,
  count(*) filter (where r and status = 'READY') as agents_ready,
  count(*) filter (where r and status = 'INCALL') as agents_incall,
  count(*) filter (where r and status = 'PAUSED') as agents_paused,
  count(*) filter (where r and status = 'READY' and (conf_exten is null or conf_exten in ('', '0'))) as ready_without_conf
from (select *, {sql_within('last_update_time', P.AS_OF, P.AGENT_ACTIVE_LOOKBACK)} as r from live_agents) a""")
def agg_multi_metric(fx):
    return A.agent_snapshot(fx.live_agents, P.AS_OF, P.AGENT_ACTIVE_LOOKBACK)


@register("agg_fd_columns", section="2.4", oracle="""
select h.campaign_id, c.hopper_level, c.dial_status_a, cast(c.auto_dial_level as double) as auto_dial_level,
  count(*) as hopper_count
from hopper h join campaigns c on h.campaign_id = c.campaign_id
group by h.campaign_id, c.hopper_level, c.dial_status_a, c.auto_dial_level""")
def agg_fd_columns(fx):

    camp = fx.campaigns.select("campaign_id", "hopper_level", "dial_status_a",
                               F.col("auto_dial_level").cast("double").alias("auto_dial_level"))
    joined = fx.hopper.select("campaign_id").join(camp, "campaign_id")
    return A.group_with_attrs(joined, "campaign_id", ["hopper_level", "dial_status_a", "auto_dial_level"],
                              [F.count(F.lit(1)).alias("hopper_count")])


@register("agg_max_watermark_id", section="2.4", oracle="select coalesce(max(lead_id), 0) as max_id from leads")
def agg_max_watermark_id(fx):
    return A.max_id(fx.leads, "lead_id")


@register("agg_string_list", section="2.4", oracle="""
select string_agg(cast(list_id as varchar), ',' order by list_id) as ids from lists where list_id not in (998, 999, 1001)""")
def agg_string_list(fx):
    return A.id_list(Fl.in_set(fx.lists, "list_id", C.PROTECTED_LISTS, negate=True), "list_id")


def _root_case() -> str:
    arms = " ".join(f"when starts_with(path, '{r}/') then '{r}'" for r in A.LOG_DIRS)
    return f"case {arms} end"


SIZE_GATE_SQL = f"""(with t as (select {_root_case()} as root, length from files),
     t2 as (select * from t where root is not null),
     tot as (select cast(coalesce(sum(length), 0) as bigint) as total from t2)
select root, cast(sum(length) as bigint) as dir_bytes, (select total from tot) as total_bytes,
  cast((((select total from tot) * 100) // 1024) // 1024 as double) / 100 as total_mb,
  (select total from tot) > {A.SIZE_GATE_MB * 1024 * 1024} as over_threshold
from t2 group by root)"""


@register("agg_size_gate", section="2.4", oracle=f"select * from {SIZE_GATE_SQL} g")
def agg_size_gate(fx):
    return A.size_gate(fx.files)


@register("agg_distinct_sorted", section="2.4", oracle="select distinct list_id from leads")
def agg_distinct_sorted(fx):
    return A.distinct_sorted(fx.leads, "list_id")


@register("agg_line_freq", section="2.4", oracle=f"""
select string_split_regex(trim(line), '\\s+')[3] as state, count(*) as count from channel_lines
where not regexp_matches(line, '{TX.CHANNEL_DROP}') group by 1""")
def agg_line_freq(fx):
    return A.column_freq(TX.parse_columns(fx.channel_lines), "state")


def rates_sql(lookback: str) -> str:
    amd = ", ".join(f"'{s}'" for s in A.AMD_STATUSES)
    drop = ", ".join(f"'{s}'" for s in A.DROP_STATUSES)
    return f"""(select amd_kills, drop_count, total_calls,
  case when amd_kills > 0 and total_calls > 0 then {sql_truncate_ratio('amd_kills * 100', 'total_calls')} end as amd_pct,
  case when drop_count > 0 and total_calls > 0 then {sql_truncate_ratio('drop_count * 100', 'total_calls')} end as drop_pct
from (select count(*) filter (where status in ({amd})) as amd_kills, count(*) filter (where status in ({drop})) as drop_count,
        count(*) as total_calls from call_log where {sql_within('call_date', P.AS_OF, lookback)}) c)"""


@register("agg_rates", section="2.4", oracle=f"select * from {rates_sql(P.CALL_RATE_LOOKBACK)} r")
def agg_rates(fx):
    return A.call_rates(fx.call_log, P.AS_OF, P.CALL_RATE_LOOKBACK)


@register("agg_channel_ratio", section="2.4", oracle=f"""
with u as (select count(*) filter (where contains(line, ' Up ')) as calls_up from channel_lines),
     a as (select count(*) as agents_incall from live_agents
           where {sql_within('last_update_time', P.AS_OF, P.AGENT_ACTIVE_LOOKBACK)} and status = 'INCALL')
select u.calls_up, a.agents_incall,
  case when u.calls_up > 0 and a.agents_incall > 0 then {sql_truncate_ratio('u.calls_up', 'a.agents_incall')} end as ratio,
  coalesce(u.calls_up > 0 and a.agents_incall > 0 and {sql_truncate_ratio('u.calls_up', 'a.agents_incall')} > 3, false)
    as high_ratio
from u, a""")
def agg_channel_ratio(fx):
    return A.channel_ratio(fx.channel_lines, fx.live_agents, P.AS_OF, P.AGENT_ACTIVE_LOOKBACK)


@register("agg_expected_calls", section="2.4", oracle=f"""
select campaign_id, ready_agents, auto_dial_level, cast(ready_agents * cast(auto_dial_level as decimal(6,2)) as double)
  as expected_calls from {agent_math_sql(P.AGENT_ACTIVE_LOOKBACK)} m""")
def agg_expected_calls(fx):
    return A.expected_calls(J.agent_math(fx.live_agents, fx.campaigns, P.AS_OF, P.AGENT_ACTIVE_LOOKBACK))


def _presence_sql() -> str:
    cols = ", ".join(
        f"count(*) filter (where regexp_matches(line, '{('(?i)' if ci else '') + rx}')) as {name}"
        for name, rx, ci in A.COMPONENTS)
    arms = " union all ".join(
        f"select host, '{name}' as component, cast({name} as bigint) as matches from w" for name, _, _ in A.COMPONENTS)
    return f"""(with w as (select host, {cols} from process_rows group by host)
select host, component, matches, case when matches = 0 then 'FAIL' else 'PASS' end as status from ({arms}) u)"""


PRESENCE_SQL = _presence_sql()


@register("agg_component_presence", section="2.4", oracle=f"select * from {PRESENCE_SQL} p")
def agg_component_presence(fx):
    return A.component_presence(fx.process_rows)


@register("estimate_bytes", section="2.4", oracle="select count(*) as leads, (count(*) * 500) // 1024 as needed_kb from leads")
def estimate_bytes(fx):
    return A.estimate_export(fx.leads)


# ---------------------------------------------------------------- 2.5 windows


@register("win_share_of_total", section="2.5", oracle=f"""
with r as {RECENT_CALLS_SQL}, c as (select status, count(*) as count from r group by status)
select status, count, {sql_round_half_up_ratio('count * 100', '(select count(*) from r)')} as pct
from c order by count desc, status limit 20""")
def win_share_of_total(fx):
    return W.share_of_total(Fl.recent(fx.call_log, "call_date", P.AS_OF, P.CALL_RATE_LOOKBACK), "status", 20)


@register("win_topn_per_list", section="2.5", oracle=f"""
select lead_id, list_id, rn from (select lead_id, list_id, row_number() over (partition by list_id order by lead_id) as rn
from leads) x where rn <= {P.ROWS_PER_LIST}""")
def win_topn_per_list(fx):
    return W.topn_per_key(fx.leads.select("lead_id", "list_id"), "list_id", ["lead_id"], P.ROWS_PER_LIST)


@register("win_sequence_ids", section="2.5", oracle=f"select * from {NEW_ID_MAP_SQL} m")
def win_sequence_ids(fx):
    return new_id_map(fx)


@register("win_latest_per_key", section="2.5", oracle="""
select user_id, arg_max(event_type, {'t': ts, 'k': event_id}) as event_type, max(ts) as ts from events group by user_id""")
def win_latest_per_key(fx):
    return W.latest_per_key(fx.events, "user_id", "ts", "event_id", ["event_type"])


# ------------------------------------------------------------------ 2.6 top-k


@register("top_idle_agents", section="2.6", oracle=f"""
select agent, campaign_id, conf_exten, idle_seconds,
  case when idle_seconds > {P.IDLE_FAIL_SECONDS} then 'IDLE TOO LONG'
       when idle_seconds > {P.IDLE_WARN_SECONDS} then 'elevated wait' else '' end as flag
from (select agent, campaign_id, conf_exten, date_sub('second', last_update_time, {AS_OF_SQL}) as idle_seconds
      from live_agents where status = 'READY' and {sql_within('last_update_time', P.AS_OF, P.AGENT_STATE_LOOKBACK)}) a
order by idle_seconds desc, agent limit 15""")
def top_idle_agents(fx):
    return T.top_idle(fx.live_agents, P.AS_OF, P.AGENT_STATE_LOOKBACK, 15, P.IDLE_WARN_SECONDS, P.IDLE_FAIL_SECONDS)


@register("top_statuses", section="2.6", oracle=f"""
select status, count(*) as count from call_log where {sql_within('call_date', P.AS_OF, P.OUTCOME_LOOKBACK)}
group by status order by count desc, status limit 15""")
def top_statuses(fx):
    return T.top_statuses(fx.call_log, P.AS_OF, P.OUTCOME_LOOKBACK, 15)


@register("sort_by_key", section="2.6", oracle="select * from lists order by list_id")
def sort_by_key(fx):
    return T.sort_by(fx.lists, ["list_id"])


@register("tail_filter_tail", section="2.6", oracle=f"""
select * from (select * from log_lines where regexp_matches(line, '{K.CALL_FLOW_INCLUDE}')
               order by ts desc, line_no desc limit 50) x
where not regexp_matches(line, '{K.CALL_FLOW_EXCLUDE}') order by ts desc, line_no desc limit 20""")
def tail_filter_tail(fx):
    return T.tail_matches(fx.log_lines, K.CALL_FLOW_INCLUDE, K.CALL_FLOW_EXCLUDE, 50, 20)


@register("head_n", section="2.6", oracle=f"select conf_exten, server_ip from {FREE_SLOTS_SQL} f order by conf_exten limit 10")
def head_n(fx):
    return T.head_n(C.free_slots(fx.conf_slots).select("conf_exten", "server_ip"), ["conf_exten"], 10)


# ------------------------------------------------------------------ 2.7 set ops

CLONE_USERS_SQL = f"""(select u.user_name || '_B' as user_name, substring(u.full_name, 1, 47) || ' (B)' as full_name,
  u.user_level, u.user_group, u.active, u.server_ip
from users u where u.user_name in (select e.user_name from {ELIGIBLE_SQL} e
  where not exists (select 1 from users s where s.user_name = e.user_name || '_B')))"""


@register("union_append", section="2.7", oracle=f"select * from users union all select * from {CLONE_USERS_SQL} c")
def union_append(fx):
    users = fx.users
    return append_rows(users, C.clone_users(users, Fl.eligible_agents(users)))
