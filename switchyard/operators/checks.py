"""Diagnostic findings and the verdict.

Each check is a small aggregate over one of the operators above and returns
rows of the findings schema ``(check, side, entity, measure, message)``,
one row per finding (none when the check passes).  Unlike the reference,
findings raised per campaign or per line are all counted (SURVEY Q1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import aggregates, filters, joins
from .rules import HOST_RULES, NETWORK_RULES, grade, rules_table
from .setops import union_all
from .windows import latest_per_key

FINDINGS_SCHEMA = "check string, side string, entity string, measure double, message string"


def _finding(df: DataFrame, check: str, side: str | Column, measure: Column, message: str | Column,
             entity: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"),
        (F.lit(side) if isinstance(side, str) else side).alias("side"),
        (entity if entity is not None else F.lit("all")).cast("string").alias("entity"),
        measure.cast("double").alias("measure"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
    )


def find_ready_no_conf(agents: DataFrame, as_of: str, lookback: str = "5 minutes") -> DataFrame:
    """READY agents with a blank conference extension -> SERVER."""
    return snapshot_findings(agents_channels_snapshot(agents, None, as_of, lookback),
                             [agent_specs()["ready_no_conf"]])

def find_hopper_low(hopper: DataFrame, campaigns: DataFrame, nearly_empty: int = 10, low: int = 50) -> DataFrame:
    """Per active campaign: hopper below ``nearly_empty`` -> CLIENT, below ``low`` -> INFO."""
    h = joins.hopper_by_campaign(hopper, campaigns)
    c = F.col("hopper_count")
    flagged = h.where(c < low)
    return _finding(flagged, "hopper_low", F.when(c < nearly_empty, "CLIENT").otherwise("INFO"), c,
                    F.when(c < nearly_empty, "hopper nearly empty — dialer will idle agents").otherwise("hopper low"),
                    F.col("campaign_id"))


def find_hopper_empty(hopper: DataFrame) -> DataFrame:
    """No lead in the hopper at all -> CLIENT."""
    return snapshot_findings(hopper_snapshot(hopper), [hopper_specs()["hopper_empty"]])

def find_stuck_incall(hopper: DataFrame) -> DataFrame:
    """Hopper rows in INCALL -> SERVER."""
    return snapshot_findings(hopper_snapshot(hopper), [hopper_specs()["stuck_incall"]])

def find_rates(log: DataFrame, as_of: str, lookback: str = "30 minutes", amd_high: float = 60,
               amd_elevated: float = 40, drop_limit: float = 5) -> DataFrame:
    """AMD above ``amd_high`` or ``amd_elevated`` -> CLIENT; drops above ``drop_limit`` -> SERVER."""
    specs = call_specs(amd_high, amd_elevated, drop_limit)
    return snapshot_findings(call_snapshot(log, as_of, lookback), [specs["amd_rate"], specs["drop_rate"]])

def find_zero_ready(agents: DataFrame, campaigns: DataFrame, as_of: str, lookback: str = "5 minutes") -> DataFrame:
    """Campaigns with agents logged in but none READY -> SERVER."""
    m = joins.agent_math(agents, campaigns, as_of, lookback)
    return _finding(m.where((F.col("ready_agents") == 0) & (F.col("total_agents") > 0)), "zero_ready", "SERVER",
                    F.col("total_agents"), "agents logged in but ZERO in READY state — all paused or stuck",
                    F.col("campaign_id"))


# Fixed values that must equal the reference: log error patterns.
DIALER_ERROR_PATTERN = "(?i)VDAD|vicidial.*error|auto_dial.*error|hopper.*error"
AGI_ERROR_PATTERN = "(?i)AGI.*error|AGI.*failed|AGI.*connect|AGI.*timeout"


def find_log_errors(lines: DataFrame, as_of: str, lookback: str = "5 minutes") -> DataFrame:
    """Dialer errors inside the look-back (by parsed time) and any AGI error -> SERVER."""
    line = F.col("line")
    in_window = X.within("ts", as_of, lookback)
    c = lines.agg(F.count_if(line.rlike(DIALER_ERROR_PATTERN) & in_window).alias("dialer"),
                  F.count_if(line.rlike(AGI_ERROR_PATTERN)).alias("agi"))
    return log_error_findings(c)


def log_error_findings(counts: DataFrame) -> DataFrame:
    """The findings of one row of counts, ``dialer`` inside the look-back and ``agi`` of all time."""
    d, a = F.col("dialer"), F.col("agi")
    return snapshot_findings(counts, [("dialer_errors", "SERVER", d, MSG["dialer_errors"], d > 0),
                                      ("agi_errors", "SERVER", a, MSG["agi_errors"], a > 0)])


def slot_metrics(slots: DataFrame, as_of: str, stale: str = "10 minutes") -> DataFrame:
    """One pass: total, idle, in-use (LIA) and stale non-idle slots."""
    st = F.col("extension_status")
    return aggregates.snapshot_metrics(slots, {
        "total_slots": F.lit(True), "idle_slots": st == "idle", "in_use_slots": st == "LIA",
        "stuck_slots": (st != "idle") & (F.col("last_update") < X.ago(as_of, stale)),
    })


def find_slots(slots: DataFrame, as_of: str, stale: str = "10 minutes") -> DataFrame:
    """Stale non-idle slots -> SERVER; no idle slot -> SERVER; counts as INFO."""
    m = slot_metrics(slots, as_of, stale)
    stuck, idle, total, used = (F.col(c) for c in ("stuck_slots", "idle_slots", "total_slots", "in_use_slots"))
    return snapshot_findings(m, [
        ("slots_stuck", "SERVER", stuck,
         "conference extension(s) stuck in non-idle state — may block agent bridging", stuck > 0),
        ("slots_none_idle", "SERVER", idle,
         "No idle conference extensions available — calls cannot be bridged to agents", idle == 0),
        ("slots_total", "INFO", total, "Total conference extensions", F.lit(True)),
        ("slots_idle", "INFO", idle, "Idle (available) conference extensions", F.lit(True)),
        ("slots_in_use", "INFO", used, "In use (LIA) conference extensions", F.lit(True)),
    ])

def lead_quality_findings(leads: DataFrame, hopper: DataFrame, many_calls: int = 3, many_leads: int = 50) -> DataFrame:
    """Invalid phones and much-called leads among hopper leads (one join, one aggregate)."""
    j = joins.hopper_leads(leads, hopper)
    q = j.agg(F.count_if(filters.invalid_phone("phone_number")).alias("invalid"),
              F.count_if(F.col("called_count") > many_calls).alias("called_many"))
    inv, many = F.col("invalid"), F.col("called_many")
    return snapshot_findings(q, [("invalid_phones", "CLIENT", inv, MSG["invalid_phones"], inv > 0),
                                 ("called_many_times", "CLIENT", many, MSG["called_many_times"], many > many_leads)])


def find_lead_quality(leads: DataFrame, hopper: DataFrame, log: DataFrame | None = None,
                      midnight_as_of: str | None = None, many_calls: int = 3, many_leads: int = 50) -> DataFrame:
    """Invalid phones in hopper, DNC in hopper, leads called more than
    ``many_calls`` times for more than ``many_leads`` hopper leads -> CLIENT;
    calls since midnight as INFO."""
    parts = [lead_quality_findings(leads, hopper, many_calls, many_leads),
             snapshot_findings(hopper_snapshot(hopper), [hopper_specs()["dnc_in_hopper"]])]
    if log is not None and midnight_as_of is not None:
        today = filters.since_midnight(log, "call_date", midnight_as_of).agg(F.count(F.lit(1)).alias("calls_today"))
        parts.append(snapshot_findings(today, [call_specs(today=True)["calls_today"]]))
    return union_all(*parts)

# Fixed values that must equal the reference: registry / peer line classes.
REGISTERED = "(?i)Registered"
REGISTRY_FAILED = "(?i)Failed|Timeout|No Auth"
PEER_OK = "(?i)OK"
PEER_DOWN = "(?i)UNREACHABLE|UNKNOWN"


def classify_registration(lines: DataFrame, kind: str, id_col: str = "line_no") -> DataFrame:
    """Registry lines: registered / failed / other; peer lines: ok / down / other."""
    line = F.col("line")
    if kind == "registry":
        cls = F.when(line.rlike(REGISTERED), "registered").when(line.rlike(REGISTRY_FAILED), "failed").otherwise("other")
    else:
        cls = F.when(line.rlike(PEER_OK), "ok").when(line.rlike(PEER_DOWN), "down").otherwise("other")
    return lines.select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("item"), cls.alias("class"))


def find_registration(registry_lines: DataFrame, peer_lines: DataFrame, id_col: str = "line_no") -> DataFrame:
    """Every registry line with a failed registration is a SERVER finding; every
    unreachable or unknown peer is INFO (shown, but no issue of either side)."""
    reg = classify_registration(registry_lines, "registry", id_col).where(F.col("class") == "failed")
    down = classify_registration(peer_lines, "peer", id_col).where(F.col("class") == "down")
    return union_all(
        _finding(reg, "registration_failed", "SERVER", F.lit(1), MSG["registration_failed"], F.col("item")),
        _finding(down, "peer_down", "INFO", F.lit(1), MSG["peer_down"], F.col("item")))


# Fixed values that must equal the reference: call-flow grep and classes.
CALL_FLOW_INCLUDE = "ANSWER|200 OK|AGI|BRIDGE|CONF|agent|DIAL|pickup|CONNECT"
CALL_FLOW_EXCLUDE = "DEBUG|VERBOSE"
CALL_FLOW_CLASSES = (
    ("answer", "(?i)200 OK|ANSWER"),
    ("bridge", "(?i)BRIDGE|CONNECT|pickup"),
    ("conference", "(?i)CONF|agent"),
)


def call_flow_class(line: Column) -> Column:
    out = F.lit("other")
    for name, rx in reversed(CALL_FLOW_CLASSES):
        out = F.when(line.rlike(rx), F.lit(name)).otherwise(out)
    return out


def classify_call_flow(lines: DataFrame) -> DataFrame:
    """Call-flow lines (grep include, drop DEBUG/VERBOSE) tagged first-match-wins."""
    kept = filters.grep_lines(lines, CALL_FLOW_INCLUDE, CALL_FLOW_EXCLUDE)
    return kept.select("line_no", "line", call_flow_class(F.col("line")).alias("flow_class"))


def host_metrics(samples: DataFrame, metrics, ts: str = "ts", tie: str = "sample_id") -> DataFrame:
    """Latest value per (host, metric), pivoted to one row per host."""
    latest = latest_per_key(samples.where(F.col("metric").isin(*metrics)), ["host", "metric"], ts, tie, ["value"])
    return latest.groupBy("host").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


HOST_METRICS = ("load1", "load5", "cores", "iowait", "nice", "rt_priority", "mem_avail_mb", "timing_pct")


def grade_host(samples: DataFrame) -> DataFrame:
    """PASS / WARN / FAIL per host on its latest samples (SKIP when not collected).

    load: load1 > 0.85 x cores, else load5 > cores -> FAIL; iowait > 10 -> FAIL
    (not collected -> WARN); no nice value: the telephony process was not
    found -> FAIL (its RT priority is then skipped); nice > 0 -> WARN; RT
    priority absent or 0 -> WARN; RAM < 256 MB -> FAIL, < 512 -> WARN; timing < 99.95 % -> FAIL, < 99.98 -> WARN
    (not collected -> WARN).
    """
    m = host_metrics(samples, HOST_METRICS)
    c = F.col("cores")
    load = (F.when(F.col("load1").isNull() | c.isNull(), "SKIP").when(F.col("load1") > c * 0.85, "FAIL")
            .when(F.col("load5") > c, "FAIL").otherwise("PASS"))
    iow = F.when(F.col("iowait").isNull(), "WARN").when(F.col("iowait") > 10, "FAIL").otherwise("PASS")
    nice = F.when(F.col("nice").isNull(), "FAIL").when(F.col("nice") > 0, "WARN").otherwise("PASS")
    rt = F.when(F.col("nice").isNull(), "SKIP").when(F.col("rt_priority").isNull() | (F.col("rt_priority") == 0), "WARN").otherwise("PASS")
    mem = (F.when(F.col("mem_avail_mb").isNull(), "SKIP").when(F.col("mem_avail_mb") < 256, "FAIL")
           .when(F.col("mem_avail_mb") < 512, "WARN").otherwise("PASS"))
    tim = (F.when(F.col("timing_pct").isNull(), "WARN").when(F.col("timing_pct") < 99.95, "FAIL")
           .when(F.col("timing_pct") < 99.98, "WARN").otherwise("PASS"))
    graded = m.select("host", "load1", "load5", "iowait", "mem_avail_mb", "timing_pct",
                      load.alias("load_grade"), iow.alias("iowait_grade"), nice.alias("nice_grade"),
                      rt.alias("rt_grade"), mem.alias("mem_grade"), tim.alias("timing_grade"))
    g = [F.col(x) for x in ("load_grade", "iowait_grade", "nice_grade", "rt_grade", "mem_grade", "timing_grade")]
    worst = (F.when(F.array_contains(F.array(*g), "FAIL"), "FAIL").when(F.array_contains(F.array(*g), "WARN"), "WARN")
             .otherwise("PASS"))
    return graded.withColumn("overall", worst)


# Fixed values that must equal the reference: codec and direct-media classes.
TRANSCODING_CODECS = "(?i)g729|g723|g726|ilbc"
NATIVE_CODECS = "(?i)ulaw|alaw|g711"
DIRECT_MEDIA_ON = "(?i)yes|update"
QUALIFY_OFF = "(?i)disable|no"


def grade_peer(peers: DataFrame, fail_ms: int = 150, warn_ms: int = 80) -> DataFrame:
    """Qualify, RTT (only when qualify is on), codec class and direct media."""
    rtt = F.nullif(F.regexp_extract(F.col("status"), "([0-9]+)ms", 1), F.lit("")).try_cast("int")
    q_off = F.col("qualify").rlike(QUALIFY_OFF)
    rtt_grade = (F.when(q_off | rtt.isNull(), F.lit(None).cast("string")).when(rtt > fail_ms, "FAIL")
                 .when(rtt > warn_ms, "WARN").otherwise("PASS"))
    codec = (F.when(F.col("codecs").rlike(TRANSCODING_CODECS), "WARN")
             .when(F.col("codecs").rlike(NATIVE_CODECS), "PASS"))
    dm = F.when(F.col("direct_media").rlike(DIRECT_MEDIA_ON), "FAIL").otherwise("PASS")
    return peers.select("peer", rtt.alias("rtt_ms"), F.when(q_off, "WARN").otherwise("PASS").alias("qualify_grade"),
                        rtt_grade.alias("rtt_grade"), codec.alias("codec_grade"), dm.alias("direct_media_grade"))


def grade_network(samples: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Latest packet loss and jitter per host graded by the network rules."""
    spark = samples.sparkSession
    rules = rules if rules is not None else rules_table(spark, NETWORK_RULES)
    metrics = ("pkt_loss", "jitter_ms")
    latest = latest_per_key(samples.where(F.col("metric").isin(*metrics)), ["host", "metric"], "ts", "sample_id",
                            ["value"])
    return grade(latest.select("host", "metric", "value"), rules)


def grade_samples(samples: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Every sample graded by the host rules (the rules-join form)."""
    spark = samples.sparkSession
    rules = rules if rules is not None else rules_table(spark, HOST_RULES + NETWORK_RULES)
    return grade(samples, rules)


def grade_jitter_buffer(kv: DataFrame, hosts: DataFrame, max_size_ms: int = 300) -> DataFrame:
    """Jitter-buffer settings of every host of ``hosts`` from extracted ``(host, key, value)``.

    A host without any setting is graded as unset.  Disabled or unset -> FAIL; fixed (the default) -> WARN; max size below
    ``max_size_ms`` -> WARN; media port range missing -> WARN.
    """
    keys = ("jbenable", "jbimpl", "jbmaxsize", "rtpstart")
    wide = kv.groupBy("host").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
    wide = hosts.select("host").distinct().join(wide, "host", "left")
    enabled = F.coalesce(F.col("jbenable"), F.lit("no")) == "yes"
    impl = F.coalesce(F.col("jbimpl"), F.lit("fixed"))
    size = F.col("jbmaxsize").try_cast("int")
    return wide.select(
        "host", "jbenable", impl.alias("jbimpl"), size.alias("jbmaxsize"), "rtpstart",
        F.when(enabled, "PASS").otherwise("FAIL").alias("enable_grade"),
        F.when(~enabled, F.lit(None).cast("string")).when(impl == "fixed", "WARN").otherwise("PASS").alias("impl_grade"),
        F.when(~enabled | size.isNull(), F.lit(None).cast("string")).when(size < max_size_ms, "WARN")
        .otherwise("PASS").alias("size_grade"),
        F.when(F.col("rtpstart").isNull(), "WARN").otherwise("PASS").alias("rtp_grade"),
    )


def verdict(findings: DataFrame) -> DataFrame:
    """Root-cause class from the findings: SERVER, CLIENT, MIXED or NONE."""
    s = F.col("side")
    t = findings.agg(F.count_if(s == "SERVER").alias("server_issues"), F.count_if(s == "CLIENT").alias("client_issues"),
                     F.count_if(s == "INFO").alias("info_count"))
    sv, cl = F.col("server_issues"), F.col("client_issues")
    return t.withColumn("verdict", F.when((sv > 0) & (cl == 0), "SERVER").when((cl > 0) & (sv == 0), "CLIENT")
                        .when((sv > 0) & (cl > 0), "MIXED").otherwise("NONE"))


def find_channel_ratio(channels: DataFrame, agents: DataFrame, as_of: str, lookback: str = "5 minutes",
                       limit: float = 3.0) -> DataFrame:
    """More than ``limit`` answered channels per INCALL agent -> SERVER."""
    snap = agents_channels_snapshot(agents, channels, as_of, lookback)
    return snapshot_findings(snap, [agent_specs(limit, with_channels=True)["channel_ratio"]])

# Fixed values that must equal the reference: which component absences are
# server findings.  The messages are this library's words.
COMPONENT_FINDINGS = (
    ("vdad", "No auto-dial daemon running — dialer is completely stopped"),
    ("fastagi", "FastAGI server not running — call routing scripts cannot run"),
    ("ami", "No manager interface connections — dialer cannot control call routing"),
)


def find_components(rows: DataFrame) -> DataFrame:
    """Per host, every required component with zero matching rows -> SERVER."""
    p = aggregates.component_presence(rows)
    msg = F.lit(None).cast("string")
    for name, text in reversed(COMPONENT_FINDINGS):
        msg = F.when(F.col("component") == name, F.lit(text)).otherwise(msg)
    hit = p.where((F.col("matches") == 0) & F.col("component").isin(*[c for c, _ in COMPONENT_FINDINGS]))
    return _finding(hit, "component_missing", "SERVER", F.col("matches"), msg,
                    F.concat_ws(":", F.col("host"), F.col("component")))


def find_amd_message(campaigns: DataFrame) -> DataFrame:
    """Active campaigns with AMD off but a machine-message extension -> INFO."""
    f = filters.campaign_flags(campaigns)
    return _finding(f.where("amd_off_message_set"), "amd_off_message_set", "INFO", F.lit(1),
                    "AMD is OFF but am_message_exten is set — machines may get dead air", F.col("campaign_id"))


# One-pass snapshots (SURVEY section 3.1: one aggregate per table instead of
# a query per number).  A spec turns snapshot columns into one finding:
# (check, side, measure, message, fires-when); side and message may be columns.

def snapshot_findings(snapshot: DataFrame, specs) -> DataFrame:
    """Every finding of ``specs`` that fires on the one-row ``snapshot``,
    produced in one projection (array of findings, filtered, exploded)."""
    def lit(v):
        return F.lit(v) if isinstance(v, str) else v

    items = F.array(*[F.struct(F.lit(check).alias("check"), lit(side).alias("side"), F.lit("all").alias("entity"),
                               measure.cast("double").alias("measure"), lit(message).alias("message"),
                               F.coalesce(cond, F.lit(False)).alias("fires"))
                      for check, side, measure, message, cond in specs])
    f = snapshot.select(F.explode(F.filter(items, lambda x: x["fires"])).alias("f"))
    return f.select(*[F.col(f"f.{c}").alias(c) for c in ("check", "side", "entity", "measure", "message")])


def hopper_snapshot(hopper: DataFrame) -> DataFrame:
    st = F.col("status")
    return hopper.agg(F.count(F.lit(1)).alias("hopper_total"), F.count_if(st == "INCALL").alias("hopper_incall"),
                      F.count_if(st == "DNC").alias("hopper_dnc"))



# Finding messages: the reference's meaning in this library's words.
MSG = {
    "ready_no_conf": "READY agent(s) have NO conference extension assigned — calls cannot be bridged to them",
    "channel_ratio": "High channel/agent ratio — answered calls not reaching agents",
    "hopper_empty": "Hopper is EMPTY — no leads queued for dialing",
    "stuck_incall": "lead(s) stuck in INCALL status in hopper — VDAD not cleaning up properly",
    "dnc_in_hopper": "DNC entries in hopper — compliance risk + wasted agent time",
    "amd_high": "AMD killing answered calls — lead list is heavily machine/voicemail",
    "amd_elevated": "High AMD rate — significant portion of leads are non-human answers",
    "drop_rate": "Drop rate exceeds the 5% limit — calls answered but no agent available fast enough",
    "calls_today": "Calls completed today",
    "dialer_errors": "VDAD errors found in recent log",
    "agi_errors": "AGI errors detected — call routing scripts failing",
    "invalid_phones": "leads in hopper have invalid phone numbers — wasted dials, no answer",
    "registration_failed": "SIP trunk registration failed",
    "peer_down": "SIP peer unreachable or unknown",
    "called_many_times": "leads already called more than 3 times — exhausted list, low contact rate expected",
}


def hopper_specs():
    t, i, d = F.col("hopper_total"), F.col("hopper_incall"), F.col("hopper_dnc")
    return {"hopper_empty": ("hopper_empty", "CLIENT", t, MSG["hopper_empty"], t == 0),
            "stuck_incall": ("stuck_incall", "SERVER", i, MSG["stuck_incall"], i > 0),
            "dnc_in_hopper": ("dnc_in_hopper", "CLIENT", d, MSG["dnc_in_hopper"], d > 0)}


def call_snapshot(log: DataFrame, as_of: str, lookback: str, midnight_as_of: str | None = None) -> DataFrame:
    """Call counts of the diagnosis in one pass: AMD kills, drops and all calls
    in the look-back, calls since midnight; plus the truncated rates."""
    st, when = F.col("status"), F.col("call_date")
    recent = X.within(when, as_of, lookback)
    aggs = [F.count_if(recent & st.isin(*aggregates.AMD_STATUSES)).alias("amd_kills"),
            F.count_if(recent & st.isin(*aggregates.DROP_STATUSES)).alias("drop_count"),
            F.count_if(recent).alias("total_calls")]
    if midnight_as_of is not None:
        midnight, until = X.day_start(X.ts_literal(midnight_as_of)), X.ts_literal(midnight_as_of)
        today = (when > midnight) & (when <= until) & ~st.isin("DROP", "ABAND")
        aggs.append(F.count_if(today).alias("calls_today"))
    # only what some count reads leaves the scan
    first, last = X.ago(as_of, lookback), X.ts_literal(as_of)
    if midnight_as_of is not None:
        first, last = F.least(first, midnight), F.greatest(last, until)
    snap = log.where((when > first) & (when <= last)).agg(*aggs)

    def rate(n):
        return F.when((F.col(n) > 0) & (F.col("total_calls") > 0), X.truncate_ratio(F.col(n) * 100, "total_calls"))

    return snap.select("*", rate("amd_kills").alias("amd_pct"), rate("drop_count").alias("drop_pct"))


def call_specs(amd_high: float = 60, amd_elevated: float = 40, drop_limit: float = 5, today: bool = False):
    amd, drop = F.col("amd_pct"), F.col("drop_pct")
    specs = {"amd_rate": ("amd_rate", "CLIENT", amd,
                          F.when(amd > amd_high, MSG["amd_high"]).otherwise(MSG["amd_elevated"]), amd > amd_elevated),
             "drop_rate": ("drop_rate", "SERVER", drop, MSG["drop_rate"], drop > drop_limit)}
    if today:
        specs["calls_today"] = ("calls_today", "INFO", F.col("calls_today"), MSG["calls_today"], F.lit(True))
    return specs


def agent_specs(limit: float = 3.0, with_channels: bool = False):
    n = F.col("ready_without_conf")
    specs = {"ready_no_conf": ("ready_no_conf", "SERVER", n, MSG["ready_no_conf"], n > 0)}
    if with_channels:
        up, incall = F.col("calls_up"), F.col("agents_incall")
        ratio = F.when((up > 0) & (incall > 0), X.truncate_ratio(up, incall))
        specs["channel_ratio"] = ("channel_ratio", "SERVER", ratio, MSG["channel_ratio"], ratio > limit)
    return specs


def agents_channels_snapshot(agents: DataFrame, channels: DataFrame | None, as_of: str, lookback: str) -> DataFrame:
    """READY-without-conference and INCALL counts in one pass over the agents,
    with the 'Up' channel count as a scalar subquery when channels are given."""
    recent = X.within("last_update_time", as_of, lookback)
    st = F.col("status")
    snap = agents.where(recent).agg(F.count_if((st == "READY") & X.blank("conf_exten")).alias("ready_without_conf"),
                                    F.count_if(st == "INCALL").alias("agents_incall"))
    if channels is not None:
        up = channels.select(F.count_if(F.col("line").contains(" Up ")).cast("long")).scalar()
        snap = snap.select("*", up.alias("calls_up"))
    return snap
