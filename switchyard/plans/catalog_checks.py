"""Catalogue: diagnostic findings, verdict, grading, scalar functions and
rules as data (SURVEY sections 2.9, 2.10, 2.12, union_findings, agg_verdict)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggregates as A
from ..operators import checks as K
from ..operators import rules as R
from ..operators.setops import union_all
from ..operators.windows import latest_per_key
from ..sources import text as TX
from . import fixtures as P
from .catalog_relational import HOPPER_CAMPAIGN_SQL, PRESENCE_SQL, agent_math_sql, rates_sql
from .diagnosis import DiagnosisParams
from .diagnosis import findings as diagnosis_findings
from .registry import register
from .sqlbits import (graded_sql, kv_sql, latest_metric_sql, sql_ago, sql_round_half_up_ratio, sql_truncate_ratio,
                      sql_ts, sql_within)

AS_OF_SQL = sql_ts(P.AS_OF)


def _f(check: str, side: str, measure: str, message: str, entity: str = "'all'") -> str:
    return (f"'{check}' as \"check\", {side if side.startswith(('case', chr(39))) else repr(side)} as side, "
            f"cast({entity} as varchar) as entity, cast({measure} as double) as measure, {message} as message")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FIND_READY_NO_CONF_SQL = f"""select {_f('ready_no_conf', "'SERVER'", 'n', _q('READY agent(s) have NO conference extension assigned — calls cannot be bridged to them'))}
from (select count(*) as n from live_agents where status = 'READY' and (conf_exten is null or conf_exten in ('', '0'))
      and {sql_within('last_update_time', P.AS_OF, P.AGENT_ACTIVE_LOOKBACK)}) x where n > 0"""

FIND_HOPPER_LOW_SQL = f"""select {_f('hopper_low', f"case when hopper_count < {P.HOPPER_NEARLY_EMPTY} then 'CLIENT' else 'INFO' end",
  'hopper_count', f"case when hopper_count < {P.HOPPER_NEARLY_EMPTY} then {_q('hopper nearly empty — dialer will idle agents')} else 'hopper low' end",
  'campaign_id')}
from {HOPPER_CAMPAIGN_SQL} h where hopper_count < {P.HOPPER_LOW}"""

FIND_HOPPER_EMPTY_SQL = f"""select {_f('hopper_empty', "'CLIENT'", 'n', _q('Hopper is EMPTY — no leads queued for dialing'))}
from (select count(*) as n from hopper) x where n = 0"""

FIND_STUCK_INCALL_SQL = f"""select {_f('stuck_incall', "'SERVER'", 'n', _q('lead(s) stuck in INCALL status in hopper — VDAD not cleaning up properly'))}
from (select count(*) filter (where status = 'INCALL') as n from hopper) x where n > 0"""

FIND_RATES_SQL = f"""select {_f('amd_rate', "'CLIENT'", 'amd_pct',
  f"case when amd_pct > {P.AMD_HIGH_PCT} then {_q('AMD killing answered calls — lead list is heavily machine/voicemail')} else {_q('High AMD rate — significant portion of leads are non-human answers')} end")}
from {rates_sql(P.CALL_RATE_LOOKBACK)} r where amd_pct > {P.AMD_ELEVATED_PCT}
union all
select {_f('drop_rate', "'SERVER'", 'drop_pct', _q('Drop rate exceeds the 5% limit — calls answered but no agent available fast enough'))}
from {rates_sql(P.CALL_RATE_LOOKBACK)} r2 where drop_pct > 5"""

FIND_ZERO_READY_SQL = f"""select {_f('zero_ready', "'SERVER'", 'total_agents', _q('agents logged in but ZERO in READY state — all paused or stuck'), 'campaign_id')}
from {agent_math_sql(P.AGENT_ACTIVE_LOOKBACK)} m where ready_agents = 0 and total_agents > 0"""

FIND_LOG_ERRORS_SQL = f"""with c as (select
  count(*) filter (where regexp_matches(line, '{K.DIALER_ERROR_PATTERN}') and ts > {sql_ago(P.AS_OF, P.LOG_LOOKBACK)} and ts <= {AS_OF_SQL}) as dialer,
  count(*) filter (where regexp_matches(line, '{K.AGI_ERROR_PATTERN}')) as agi from log_lines)
select {_f('dialer_errors', "'SERVER'", 'dialer', _q('VDAD errors found in recent log'))} from c where dialer > 0
union all
select {_f('agi_errors', "'SERVER'", 'agi', _q('AGI errors detected — call routing scripts failing'))} from c where agi > 0"""

FIND_SLOTS_SQL = f"""with m as (select count(*) as total_slots, count(*) filter (where extension_status = 'idle') as idle_slots,
  count(*) filter (where extension_status = 'LIA') as in_use_slots,
  count(*) filter (where extension_status <> 'idle' and last_update < {sql_ago(P.FILE_AS_OF, '10 minutes')}) as stuck_slots
  from conf_slots)
select {_f('slots_stuck', "'SERVER'", 'stuck_slots', _q('conference extension(s) stuck in non-idle state — may block agent bridging'))} from m where stuck_slots > 0
union all select {_f('slots_none_idle', "'SERVER'", 'idle_slots', _q('No idle conference extensions available — calls cannot be bridged to agents'))} from m where idle_slots = 0
union all select {_f('slots_total', "'INFO'", 'total_slots', _q('Total conference extensions'))} from m
union all select {_f('slots_idle', "'INFO'", 'idle_slots', _q('Idle (available) conference extensions'))} from m
union all select {_f('slots_in_use', "'INFO'", 'in_use_slots', _q('In use (LIA) conference extensions'))} from m"""

FIND_LEAD_QUALITY_SQL = f"""with q as (select count(*) filter (where length(regexp_replace(l.phone_number, '[^0-9]', '', 'g')) < 10) as invalid,
  count(*) filter (where l.called_count > 3) as called_many from leads l join hopper h on l.lead_id = h.lead_id),
  d as (select count(*) filter (where status = 'DNC') as dnc from hopper),
  t as (select count(*) as n from call_log where call_date > date_trunc('day', {sql_ts(P.MIDNIGHT_AS_OF)}) and call_date <= {sql_ts(P.MIDNIGHT_AS_OF)}
        and status not in ('DROP', 'ABAND'))
select {_f('invalid_phones', "'CLIENT'", 'invalid', _q('leads in hopper have invalid phone numbers — wasted dials, no answer'))} from q where invalid > 0
union all select {_f('dnc_in_hopper', "'CLIENT'", 'dnc', _q('DNC entries in hopper — compliance risk + wasted agent time'))} from d where dnc > 0
union all select {_f('called_many_times', "'CLIENT'", 'called_many', _q('leads already called more than 3 times — exhausted list, low contact rate expected'))} from q where called_many > 50
union all select {_f('calls_today', "'INFO'", 'n', _q('Calls completed today'))} from t"""

PEER_LINES_SQL = "(select peer as line_no, peer || ' ' || status as line from peers)"

FIND_REGISTRATION_SQL = f"""select {_f('registration_failed', "'SERVER'", '1', _q('SIP trunk registration failed'), 'line_no')}
from log_lines where not regexp_matches(line, '{K.REGISTERED}') and regexp_matches(line, '{K.REGISTRY_FAILED}')
union all
select {_f('peer_down', "'INFO'", '1', _q('SIP peer unreachable or unknown'), 'line_no')}
from {PEER_LINES_SQL} p where not regexp_matches(line, '{K.PEER_OK}') and regexp_matches(line, '{K.PEER_DOWN}')"""


FIND_CHANNEL_RATIO_SQL = f"""select {_f('channel_ratio', "'SERVER'", 'ratio', _q('High channel/agent ratio — answered calls not reaching agents'))}
from (select {sql_truncate_ratio('u.calls_up', 'a.agents_incall')} as ratio
      from (select count(*) filter (where contains(line, ' Up ')) as calls_up from channel_lines) u,
           (select count(*) as agents_incall from live_agents
            where {sql_within('last_update_time', P.AS_OF, P.AGENT_ACTIVE_LOOKBACK)} and status = 'INCALL') a
      where u.calls_up > 0 and a.agents_incall > 0) r where ratio > 3"""


def _components_sql() -> str:
    names = [c for c, _ in K.COMPONENT_FINDINGS]
    msg = "case " + " ".join(f"when component = '{c}' then {_q(t)}" for c, t in K.COMPONENT_FINDINGS) + " end"
    inlist = ", ".join(f"'{c}'" for c in names)
    return f"""select {_f('component_missing', "'SERVER'", 'matches', msg, "host || ':' || component")}
from {PRESENCE_SQL} p where matches = 0 and component in ({inlist})"""


FIND_AMD_MESSAGE_SQL = f"""select {_f('amd_off_message_set', "'INFO'", '1', _q('AMD is OFF but am_message_exten is set — machines may get dead air'), 'campaign_id')}
from campaigns where active = 'Y' and answering_machine_detection = 'N' and coalesce(am_message_exten, '') <> ''
  and coalesce(am_message_exten, '') <> 'none'"""


def _peer_lines(fx):
    return fx.peers.select(F.col("peer").alias("line_no"), F.concat_ws(" ", "peer", "status").alias("line"))


FINDINGS = {
    "find_ready_no_conf": (lambda fx: K.find_ready_no_conf(fx.live_agents, P.AS_OF, P.AGENT_ACTIVE_LOOKBACK),
                           FIND_READY_NO_CONF_SQL),
    "find_hopper_low": (lambda fx: K.find_hopper_low(fx.hopper, fx.campaigns, P.HOPPER_NEARLY_EMPTY, P.HOPPER_LOW),
                        FIND_HOPPER_LOW_SQL),
    "find_hopper_empty": (lambda fx: K.find_hopper_empty(fx.hopper), FIND_HOPPER_EMPTY_SQL),
    "find_stuck_incall": (lambda fx: K.find_stuck_incall(fx.hopper), FIND_STUCK_INCALL_SQL),
    "find_rates": (lambda fx: K.find_rates(fx.call_log, P.AS_OF, P.CALL_RATE_LOOKBACK, P.AMD_HIGH_PCT,
                                           P.AMD_ELEVATED_PCT), FIND_RATES_SQL),
    "find_zero_ready": (lambda fx: K.find_zero_ready(fx.live_agents, fx.campaigns, P.AS_OF, P.AGENT_ACTIVE_LOOKBACK),
                        FIND_ZERO_READY_SQL),
    "find_log_errors": (lambda fx: K.find_log_errors(fx.log_lines, P.AS_OF, P.LOG_LOOKBACK), FIND_LOG_ERRORS_SQL),
    "find_slots": (lambda fx: K.find_slots(fx.conf_slots, P.FILE_AS_OF), FIND_SLOTS_SQL),
    "find_lead_quality": (lambda fx: K.find_lead_quality(fx.leads, fx.hopper, fx.call_log, P.MIDNIGHT_AS_OF),
                          FIND_LEAD_QUALITY_SQL),
    "find_registration": (lambda fx: K.find_registration(fx.log_lines, _peer_lines(fx)), FIND_REGISTRATION_SQL),
}

for _key, (_fn, _sql) in FINDINGS.items():
    register(_key, section="2.9", oracle=_sql)(_fn)

# Checks of the diagnosis that have no key of their own in SURVEY section 2
# (they compose agg_channel_ratio, agg_component_presence, campaign_settings)
# but whose findings count towards the verdict.
EXTRA_FINDINGS = {
    "channel_ratio": (lambda fx: K.find_channel_ratio(fx.channel_lines, fx.live_agents, P.AS_OF,
                                                      P.AGENT_ACTIVE_LOOKBACK), FIND_CHANNEL_RATIO_SQL),
    "components": (lambda fx: K.find_components(fx.process_rows), _components_sql()),
    "amd_message": (lambda fx: K.find_amd_message(fx.campaigns), FIND_AMD_MESSAGE_SQL),
}
ALL_FINDINGS = {**FINDINGS, **EXTRA_FINDINGS}


FIXTURE_DIAGNOSIS = DiagnosisParams(
    as_of=P.AS_OF, agent_active_lookback=P.AGENT_ACTIVE_LOOKBACK, call_rate_lookback=P.CALL_RATE_LOOKBACK,
    log_lookback=P.LOG_LOOKBACK, slot_as_of=P.FILE_AS_OF, midnight_as_of=P.MIDNIGHT_AS_OF,
    hopper_nearly_empty=P.HOPPER_NEARLY_EMPTY, hopper_low=P.HOPPER_LOW, amd_high_pct=P.AMD_HIGH_PCT,
    amd_elevated_pct=P.AMD_ELEVATED_PCT)


def healthcheck_findings(fx):
    """All findings of a diagnosis run, one frame."""
    t = {v: fx.view(v) for v in ("live_agents", "channel_lines", "hopper", "campaigns", "call_log", "process_rows",
                                 "log_lines", "conf_slots", "leads")}
    t["registry_lines"], t["peer_lines"] = fx.log_lines, _peer_lines(fx)
    return diagnosis_findings(t, FIXTURE_DIAGNOSIS)


FINDINGS_SQL = "(" + "\nunion all\n".join(f"select * from ({sql}) f{i}" for i, (_, sql) in enumerate(ALL_FINDINGS.values())) + ")"


@register("union_findings", section="2.7", oracle=f"select * from {FINDINGS_SQL} u")
def union_findings(fx):
    return healthcheck_findings(fx)


@register("agg_verdict", section="2.4", oracle=f"""
select server_issues, client_issues, info_count,
  case when server_issues > 0 and client_issues = 0 then 'SERVER' when client_issues > 0 and server_issues = 0 then 'CLIENT'
       when server_issues > 0 and client_issues > 0 then 'MIXED' else 'NONE' end as verdict
from (select count(*) filter (where side = 'SERVER') as server_issues, count(*) filter (where side = 'CLIENT') as client_issues,
        count(*) filter (where side = 'INFO') as info_count from {FINDINGS_SQL} u) t""")
def agg_verdict(fx):
    return K.verdict(healthcheck_findings(fx))


@register("classify_call_flow", section="2.9", oracle=f"""
select line_no, line, case when regexp_matches(line, '{K.CALL_FLOW_CLASSES[0][1]}') then 'answer'
  when regexp_matches(line, '{K.CALL_FLOW_CLASSES[1][1]}') then 'bridge'
  when regexp_matches(line, '{K.CALL_FLOW_CLASSES[2][1]}') then 'conference' else 'other' end as flow_class
from log_lines where regexp_matches(line, '{K.CALL_FLOW_INCLUDE}') and not regexp_matches(line, '{K.CALL_FLOW_EXCLUDE}')""")
def classify_call_flow(fx):
    return K.classify_call_flow(fx.log_lines)


def _grade_host_sql() -> str:
    ms = K.HOST_METRICS
    piv = ", ".join(f"max(case when metric = '{m}' then value end) as {m}" for m in ms)
    return f"""(with w as (select host, {piv} from {latest_metric_sql(ms)} l group by host),
g as (select host, load1, load5, iowait, mem_avail_mb, timing_pct,
  case when load1 is null or cores is null then 'SKIP' when load1 > cores * cast(0.85 as double) then 'FAIL'
       when load5 > cores then 'FAIL' else 'PASS' end as load_grade,
  case when iowait is null then 'WARN' when iowait > 10 then 'FAIL' else 'PASS' end as iowait_grade,
  case when nice is null then 'FAIL' when nice > 0 then 'WARN' else 'PASS' end as nice_grade,
  case when nice is null then 'SKIP' when rt_priority is null or rt_priority = 0 then 'WARN' else 'PASS' end as rt_grade,
  case when mem_avail_mb is null then 'SKIP' when mem_avail_mb < 256 then 'FAIL' when mem_avail_mb < 512 then 'WARN'
       else 'PASS' end as mem_grade,
  case when timing_pct is null then 'WARN' when timing_pct < 99.95 then 'FAIL' when timing_pct < 99.98 then 'WARN'
       else 'PASS' end as timing_grade from w)
select *, case when 'FAIL' in (load_grade, iowait_grade, nice_grade, rt_grade, mem_grade, timing_grade) then 'FAIL'
  when 'WARN' in (load_grade, iowait_grade, nice_grade, rt_grade, mem_grade, timing_grade) then 'WARN' else 'PASS' end
  as overall from g)"""


@register("grade_host", section="2.9", oracle=f"select * from {_grade_host_sql()} h")
def grade_host(fx):
    return K.grade_host(fx.metric_samples)


@register("grade_peer", section="2.9", oracle=f"""
select peer, rtt_ms, case when regexp_matches(p."qualify", '{K.QUALIFY_OFF}') then 'WARN' else 'PASS' end as qualify_grade,
  case when regexp_matches(p."qualify", '{K.QUALIFY_OFF}') or rtt_ms is null then null when rtt_ms > 150 then 'FAIL'
       when rtt_ms > 80 then 'WARN' else 'PASS' end as rtt_grade,
  case when regexp_matches(codecs, '{K.TRANSCODING_CODECS}') then 'WARN' when regexp_matches(codecs, '{K.NATIVE_CODECS}') then 'PASS'
  end as codec_grade,
  case when regexp_matches(direct_media, '{K.DIRECT_MEDIA_ON}') then 'FAIL' else 'PASS' end as direct_media_grade
from (select *, try_cast(nullif(regexp_extract(status, '([0-9]+)ms', 1), '') as integer) as rtt_ms from peers) p""")
def grade_peer(fx):
    return K.grade_peer(fx.peers)


@register("grade_network", section="2.9",
          oracle=f"select * from {graded_sql(latest_metric_sql(('pkt_loss', 'jitter_ms')), ['host', 'metric', 'value'], R.NETWORK_RULES)} g")
def grade_network(fx):
    return K.grade_network(fx.metric_samples)


@register("grade_jitter_buffer", section="2.9", oracle=f"""
with kv as {kv_sql('kv_lines', TX.CONFIG_KEYS)},
w as (select host, max(case when key = 'jbenable' then value end) as jbenable, max(case when key = 'jbimpl' then value end) as jbimpl,
  max(case when key = 'jbmaxsize' then value end) as jbmaxsize_text, max(case when key = 'rtpstart' then value end) as rtpstart
  from kv group by host)
select h.host, jbenable, coalesce(jbimpl, 'fixed') as jbimpl, try_cast(jbmaxsize_text as integer) as jbmaxsize, rtpstart,
  case when coalesce(jbenable, 'no') = 'yes' then 'PASS' else 'FAIL' end as enable_grade,
  case when not coalesce(jbenable, 'no') = 'yes' then null when coalesce(jbimpl, 'fixed') = 'fixed' then 'WARN' else 'PASS' end
    as impl_grade,
  case when not coalesce(jbenable, 'no') = 'yes' or try_cast(jbmaxsize_text as integer) is null then null
       when try_cast(jbmaxsize_text as integer) < 300 then 'WARN' else 'PASS' end as size_grade,
  case when rtpstart is null then 'WARN' else 'PASS' end as rtp_grade
from (select distinct host from kv_lines) h left join w on h.host = w.host""")
def grade_jitter_buffer(fx):
    return K.grade_jitter_buffer(TX.extract_kv(fx.kv_lines, TX.CONFIG_KEYS), fx.kv_lines)


_RULES = R.HOST_RULES + R.NETWORK_RULES
_RULE_METRICS = tuple(dict.fromkeys(r[0] for r in _RULES))


@register("agg_grade_verdict", section="2.9", oracle=f"""
select pass_count, warn_count, fail_count,
  case when fail_count > 0 then 'FAIL' when warn_count > 0 then 'WARN' else 'CLEAN' end as result
from (select count(*) filter (where severity = 'PASS') as pass_count, count(*) filter (where severity = 'WARN') as warn_count,
        count(*) filter (where severity = 'FAIL') as fail_count
      from {graded_sql(latest_metric_sql(_RULE_METRICS), ['host', 'metric', 'value'], _RULES)} g) t""")
def agg_grade_verdict(fx):
    samples = fx.metric_samples.where(F.col("metric").isin(*_RULE_METRICS))
    latest = latest_per_key(samples, ["host", "metric"], "ts", "sample_id", ["value"]).select("host", "metric", "value")
    return R.grade_verdict(K.grade_samples(latest))


# ------------------------------------------------------------ 2.10 functions


@register("fn_null", section="2.10", oracle="""
select lead_id, coalesce(first_name, '') as first_name, first_name is null as first_missing,
  coalesce(called_count, 0) as called_count, coalesce(last_name, 'unknown') as last_name from leads""")
def fn_null(fx):
    return fx.leads.select("lead_id", F.coalesce("first_name", F.lit("")).alias("first_name"),
                           F.col("first_name").isNull().alias("first_missing"),
                           F.coalesce("called_count", F.lit(0)).alias("called_count"),
                           F.coalesce("last_name", F.lit("unknown")).alias("last_name"))


@register("fn_string", section="2.10", oracle="""
select user_name, user_name || '_B' as shadow, substring(full_name, 1, 47) || ' (B)' as shadow_name,
  cast(strlen(user_name) as bigint) as name_bytes, user_name like '%_B' as legacy_shadow,
  regexp_replace(full_name, '[^A-Za-z ]', '', 'g') as letters, split_part(full_name, ' ', 1) as first_word,
  trim('  ' || user_group || '  ') as trimmed, translate(user_group, 'AEIOU', 'aeiou') as lowered_vowels,
  string_split(server_ip, '.')[-1] as host_octet
from users""")
def fn_string(fx):
    u = F.col("user_name")
    return fx.users.select(
        "user_name", F.concat(u, F.lit("_B")).alias("shadow"),
        F.concat(F.substring("full_name", 1, 47), F.lit(" (B)")).alias("shadow_name"),
        F.octet_length(u).cast("long").alias("name_bytes"), u.like("%_B").alias("legacy_shadow"),
        F.regexp_replace("full_name", "[^A-Za-z ]", "").alias("letters"),
        F.split_part(F.col("full_name"), F.lit(" "), F.lit(1)).alias("first_word"),
        F.trim(F.concat(F.lit("  "), F.col("user_group"), F.lit("  "))).alias("trimmed"),
        F.translate("user_group", "AEIOU", "aeiou").alias("lowered_vowels"),
        F.element_at(F.split("server_ip", r"\."), -1).alias("host_octet"))


@register("fn_regex_extract", section="2.10", oracle="""
select peer, regexp_extract(status, '([0-9]+)ms', 1) as rtt_text, regexp_extract(codecs, '\\(([a-z0-9]+)', 1) as first_codec,
  regexp_extract(status, '([0-9]+\\.?[0-9]*)', 1) as first_number from peers""")
def fn_regex_extract(fx):
    return fx.peers.select("peer", F.regexp_extract("status", "([0-9]+)ms", 1).alias("rtt_text"),
                           F.regexp_extract("codecs", r"\(([a-z0-9]+)", 1).alias("first_codec"),
                           F.regexp_extract("status", r"([0-9]+\.?[0-9]*)", 1).alias("first_number"))


@register("fn_datetime", section="2.10", oracle=f"""
select call_id, call_date > {sql_ago(P.AS_OF, P.CALL_RATE_LOOKBACK)} as in_window,
  date_sub('second', call_date, {AS_OF_SQL}) as seconds_before, date_trunc('day', call_date) as call_day,
  strftime(call_date, '%Y-%m-%d %H:%M') as minute_text from call_log""")
def fn_datetime(fx):
    c = F.col("call_date")
    return fx.call_log.select(
        "call_id", (c > X.ago(P.AS_OF, P.CALL_RATE_LOOKBACK)).alias("in_window"),
        X.seconds_between(c, X.ts_literal(P.AS_OF)).alias("seconds_before"),
        X.day_start(c).alias("call_day"),
        F.date_format(c, "yyyy-MM-dd HH:mm").alias("minute_text"))


@register("fn_math", section="2.10", oracle=f"""
select path, length, length // 1024 as kib,
  cast(((length * 100) // 1024) // 1024 as double) / 100 as mib_trunc2,
  {sql_round_half_up_ratio('length', '1048576')} as mib_round1,
  length + 10000 as offset_length from files""")
def fn_math(fx):
    ln = F.col("length")
    kib = ((ln - ln % 1024) / 1024).cast("long")
    k100 = ((ln * 100 - (ln * 100) % 1024) / 1024).cast("long")
    return fx.files.select(
        "path", "length", kib.alias("kib"), (((k100 - k100 % 1024) / 1024).cast("long") / 100).alias("mib_trunc2"),
        X.round_half_up_ratio(ln, F.lit(1048576)).alias("mib_round1"), (ln + 10000).alias("offset_length"))


@register("fn_hash", section="2.10", oracle="select page_id, sha256(url || html) as digest from pages")
def fn_hash(fx):
    return fx.pages.select("page_id", F.sha2(F.concat("url", "html"), 256).alias("digest"))


@register("fn_conditional", section="2.10", oracle=f"""
select agent, date_sub('second', last_update_time, {AS_OF_SQL}) as idle_seconds,
  case when date_sub('second', last_update_time, {AS_OF_SQL}) > {P.IDLE_FAIL_SECONDS} then 'IDLE TOO LONG'
       when date_sub('second', last_update_time, {AS_OF_SQL}) > {P.IDLE_WARN_SECONDS} then 'elevated wait' else 'ok' end as idle_flag,
  case status when 'READY' then 'waiting for call' when 'INCALL' then 'on a live call' when 'PAUSED' then 'paused/break'
    when 'DEAD' then 'session dead' when 'CLOSER' then 'closer agent' when 'QUEUE' then 'in queue' else 'other' end as state_label
from live_agents""")
def fn_conditional(fx):
    idle = X.seconds_between("last_update_time", X.ts_literal(P.AS_OF))
    label = F.lit("other")
    for _, code, text, _ in reversed([r for r in K.filters.STATUS_LABELS if r[0] == "agent"]):
        label = F.when(F.col("status") == code, F.lit(text)).otherwise(label)
    return fx.live_agents.select(
        "agent", idle.alias("idle_seconds"),
        F.when(idle > P.IDLE_FAIL_SECONDS, "IDLE TOO LONG").when(idle > P.IDLE_WARN_SECONDS, "elevated wait")
        .otherwise("ok").alias("idle_flag"), label.alias("state_label"))


# ---------------------------------------------------------- 2.12 rules as data

# Fixture thresholds for the call-rate rules (FIXTURES.md section 3).
RATE_RULES = (
    ("amd_pct", float(P.AMD_HIGH_PCT), None, "FAIL", "CLIENT", "AMD killing answered calls"),
    ("amd_pct", float(P.AMD_ELEVATED_PCT), None, "WARN", "CLIENT", "High AMD rate"),
    ("drop_pct", 5.0, None, "FAIL", "SERVER", "Drop rate exceeds the 5% limit"),
)


@register("rules_as_data", section="2.12", oracle=f"""
select * from {graded_sql(f"(select 'amd_pct' as metric, amd_pct as value from {rates_sql(P.CALL_RATE_LOOKBACK)} a union all select 'drop_pct', drop_pct from {rates_sql(P.CALL_RATE_LOOKBACK)} b)", ['metric', 'value'], RATE_RULES)} g""")
def rules_as_data(fx):
    rates = A.call_rates(fx.call_log, P.AS_OF, P.CALL_RATE_LOOKBACK)
    metrics = rates.unpivot([], ["amd_pct", "drop_pct"], "metric", "value")
    return R.grade(metrics, R.rules_table(fx.spark, RATE_RULES))
