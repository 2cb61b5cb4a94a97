"""Aggregations.

Every aggregate here is algebraic (count, sum, min, max, max_by), so Spark
combines it partially on the map side: a hot key costs one row per task in
the shuffle, not a third of the table.  Several single-number queries of the
reference become one multi-predicate pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import filters


def count_rows(df: DataFrame, where: Column | None = None) -> DataFrame:
    """COUNT(*) plus, when given, the count of rows matching ``where``."""
    aggs = [F.count(F.lit(1)).alias("row_count")]
    if where is not None:
        aggs.append(F.count_if(where).alias("matching"))
    return df.agg(*aggs)


def status_counts(df: DataFrame, status_col: str = "status") -> DataFrame:
    """COUNT by status, largest first (ties by status)."""
    return df.groupBy(status_col).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), F.col(status_col))


def state_breakdown(agents: DataFrame, as_of: str, lookback: str = "10 minutes") -> DataFrame:
    """Per state: agents and ROUND(AVG(whole seconds since update), 1)."""
    recent = filters.recent(agents, "last_update_time", as_of, lookback)
    secs = X.seconds_between("last_update_time", X.ts_literal(as_of))
    per = recent.groupBy("status").agg(F.count(F.lit(1)).alias("count"), F.sum(secs).alias("_sum"))
    return per.select("status", "count", X.round_half_up_ratio("_sum", "count").alias("avg_seconds_in_state")).orderBy(
        F.col("count").desc(), "status")


def conditional_counts(df: DataFrame, preds: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """COUNT(CASE WHEN p THEN 1 END) per predicate beside COUNT(*)."""
    aggs = [F.count(F.when(p, 1)).alias(n) for n, p in preds.items()] + [F.count(F.lit(1)).alias("total")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def snapshot_metrics(df: DataFrame, preds: Mapping[str, Column]) -> DataFrame:
    """Many predicate counts over one table in a single scan (one row)."""
    return df.agg(*[F.count_if(p).alias(n) for n, p in preds.items()])


def agent_snapshot(agents: DataFrame, as_of: str, lookback: str = "5 minutes") -> DataFrame:
    """Section-1 numbers of the diagnosis in one pass over live agents."""
    st = F.col("status")
    return snapshot_metrics(filters.recent(agents, "last_update_time", as_of, lookback), {
        "agents_logged_in": F.lit(True),
        "agents_ready": st == "READY",
        "agents_incall": st == "INCALL",
        "agents_paused": st == "PAUSED",
        "ready_without_conf": (st == "READY") & X.blank("conf_exten"),
    })


def group_with_attrs(df: DataFrame, key: str, attrs: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """GROUP BY key while selecting columns functionally dependent on it."""
    return df.groupBy(key).agg(*[F.any_value(a).alias(a) for a in attrs], *aggs)


def max_id(df: DataFrame, c: str, out: str = "max_id") -> DataFrame:
    """IFNULL(MAX(c), 0): the import high-water mark."""
    return df.agg(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(out))


def id_list(df: DataFrame, c: str, out: str = "ids", sep: str = ",") -> DataFrame:
    """GROUP_CONCAT of ids in numeric order; NULL when there are none."""
    return df.select(F.col(c).alias("_id")).agg(
        F.expr(f"listagg(cast(_id as string), '{sep}') within group (order by _id)").alias(out))


# Fixed values that must equal the reference: the directories the size gate
# adds up (the web-server folder is the RHEL-family default) and the gate.
LOG_DIRS = ("/var/log/asterisk", "/var/log/astguiclient", "/var/log/httpd", "/var/log/amd")
SIZE_GATE_MB = 500


def size_gate(files: DataFrame, roots: Iterable[str] = LOG_DIRS, threshold_mb: int = SIZE_GATE_MB) -> DataFrame:
    """Bytes per root and in total; flag a total above ``threshold_mb`` MiB.

    ``total_mb`` truncates twice to two decimals, as ``scale=2; b/1024/1024``.
    """
    roots = list(roots)
    root = F.lit(None).cast("string")
    for r in reversed(roots):
        root = F.when(F.col("path").startswith(r + "/"), F.lit(r)).otherwise(root)
    tagged = files.select(root.alias("root"), "length").where(F.col("root").isNotNull())
    per = tagged.groupBy("root").agg(F.sum("length").cast("long").alias("dir_bytes"))
    total = per.select(F.coalesce(F.sum("dir_bytes"), F.lit(0)).cast("long")).scalar()
    kb100 = (total * 100 - (total * 100) % 1024) / 1024
    mb100 = ((kb100 - kb100 % 1024) / 1024).cast("long")
    return per.select(
        "root", "dir_bytes", total.alias("total_bytes"), (mb100 / 100).alias("total_mb"),
        (total > threshold_mb * 1024 * 1024).alias("over_threshold"),
    )


def distinct_sorted(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).distinct().orderBy(c)


def column_freq(df: DataFrame, c: str, out: str = "count") -> DataFrame:
    """Frequency of a value (``sort | uniq -c | sort -rn``)."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias(out)).orderBy(F.col(out).desc(), c)


# Fixed values that must equal the reference: the status sets of the rates.
AMD_STATUSES = ("AM", "AA", "AMD", "MACHINE")
DROP_STATUSES = ("DROP", "ABAND")


def call_rates(log: DataFrame, as_of: str, lookback: str = "30 minutes") -> DataFrame:
    """AMD and drop rates, truncated to one decimal; NULL unless both counts > 0."""
    recent = filters.recent(log, "call_date", as_of, lookback)
    st = F.col("status")
    c = recent.agg(
        F.count_if(st.isin(*AMD_STATUSES)).alias("amd_kills"),
        F.count_if(st.isin(*DROP_STATUSES)).alias("drop_count"),
        F.count(F.lit(1)).alias("total_calls"),
    )

    def rate(n):
        return F.when((F.col(n) > 0) & (F.col("total_calls") > 0),
                      X.truncate_ratio(F.col(n) * 100, "total_calls"))

    return c.select("amd_kills", "drop_count", "total_calls", rate("amd_kills").alias("amd_pct"),
                    rate("drop_count").alias("drop_pct"))


def channel_ratio(channels: DataFrame, agents: DataFrame, as_of: str, lookback: str = "5 minutes",
                  limit: float = 3.0) -> DataFrame:
    """Up channels per INCALL agent, truncated to one decimal; flag above ``limit``."""
    up = channels.select(F.count_if(F.col("line").contains(" Up ")).cast("long")).scalar()
    recent = X.within("last_update_time", as_of, lookback)
    incall = agents.where(recent & (F.col("status") == "INCALL")).agg(F.count(F.lit(1)).alias("agents_incall"))
    ratio = F.when((up > 0) & (F.col("agents_incall") > 0), X.truncate_ratio(up, "agents_incall"))
    return incall.select(up.alias("calls_up"), "agents_incall", ratio.alias("ratio"),
                         F.coalesce(ratio > limit, F.lit(False)).alias("high_ratio"))


def expected_calls(math: DataFrame) -> DataFrame:
    """READY agents x dial level per campaign (a product keeps its scale)."""
    return math.select("campaign_id", "ready_agents", "auto_dial_level",
                       (F.col("ready_agents").cast("decimal(20,0)") * F.col("auto_dial_level").cast("decimal(6,2)"))
                       .cast("double").alias("expected_calls"))


# Fixed values that must equal the reference: process / connection patterns.
COMPONENTS = (
    ("vdad", "VDAD|vicidial_auto|AST_auto", False),
    ("fastagi", "FastAGI|fastagi", True),
    ("ami", "vicidial|VDAD|cron", False),
    ("daemons", "VDAD|vicidial_auto|AST_auto|manager_send|FastAGI|ip_relay", False),
)


def component_presence(rows: DataFrame, components=COMPONENTS, host_col: str = "host") -> DataFrame:
    """Matching rows per host and component, zero-filled; zero is a failure.

    One pass: a conditional count per component per host, then unpivot.
    """
    aggs = [F.count_if(F.col("line").rlike(("(?i)" if ci else "") + rx)).alias(name) for name, rx, ci in components]
    wide = rows.groupBy(host_col).agg(*aggs)
    names = [c[0] for c in components]
    long = wide.unpivot([host_col], names, "component", "matches")
    return long.select(host_col, "component", F.col("matches").cast("long").alias("matches"),
                       F.when(F.col("matches") == 0, "FAIL").otherwise("PASS").alias("status"))


def estimate_export(leads: DataFrame, bytes_per_lead: int = 500) -> DataFrame:
    """Export size estimate: leads x 500 B in whole KiB."""
    return leads.agg(F.count(F.lit(1)).alias("leads")).select(
        "leads", ((F.col("leads") * bytes_per_lead - (F.col("leads") * bytes_per_lead) % 1024) / 1024)
        .cast("long").alias("needed_kb"))
