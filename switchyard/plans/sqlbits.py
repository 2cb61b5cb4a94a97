"""Oracle SQL fragments shared by several catalogue entries (DuckDB dialect)."""

from __future__ import annotations

from ..functions.exprs import sql_ago, sql_round_half_up_ratio, sql_truncate_ratio, sql_ts, sql_values, sql_within
from ..operators.rules import SEVERITY_RANK
from . import fixtures as P

ELIGIBLE_SQL = ("(select * from users where active = 'Y' and user_level between 1 and 4 "
                "and not suffix(user_name, '_B') and strlen(user_name) <= 18)")

# every eligible agent with the slot table its server's engine uses
ELIGIBLE_TABLE_SQL = f"""(select e.*, case when v.conf_engine = 'CONFBRIDGE' then 'confbridges' else 'conferences' end as slot_table
 from {ELIGIBLE_SQL} e left join servers v on v.server_ip = e.server_ip)"""

RECENT_CALLS_SQL = f"(select * from call_log where {sql_within('call_date', P.AS_OF, P.CALL_RATE_LOOKBACK)})"


def rank_case(col: str) -> str:
    parts = " ".join(f"when {col} = '{k}' then {v}" for k, v in SEVERITY_RANK.items())
    return f"case {parts} else 0 end"


def rules_sql(rows) -> str:
    return sql_values(rows, ["metric", "lo", "hi", "severity", "side", "message"])


def graded_sql(samples_sql: str, cols: list[str], rules) -> str:
    """Samples with the worst matching rule (arg_max by severity rank)."""
    keep = ", ".join(f"s.{c}" for c in cols)
    return f"""(select {keep},
  coalesce(arg_max(r.severity, r.rnk), 'PASS') as severity, arg_max(r.side, r.rnk) as side,
  arg_max(r.message, r.rnk) as message
from {samples_sql} s
left join (select *, {rank_case('severity')} as rnk from {rules_sql(rules)}) r
  on s.metric = r.metric and (r.lo is null or s.value > r.lo) and (r.hi is null or s.value < r.hi)
group by {keep})"""


def latest_metric_sql(metrics) -> str:
    ms = ", ".join(f"'{m}'" for m in metrics)
    return f"""(select host, metric, arg_max(value, {{'t': ts, 'k': sample_id}}) as value
from metric_samples where metric in ({ms}) group by host, metric)"""


def kv_sql(source: str, keys) -> str:
    """extract_kv in SQL: first line per (host, key), field 2, xargs-trimmed."""
    parts = []
    for name, rx, sep in keys:
        parts.append(
            f"select host, line_no, '{name}' as key, "
            f"trim(regexp_replace(split_part(line, '{sep}', 2), '\\s+', ' ', 'g')) as value "
            f"from {source} where regexp_matches(line, '{rx}')")
    u = " union all ".join(parts)
    return f"(select host, key, arg_min(value, line_no) as value from ({u}) x group by host, key)"


__all__ = ["ELIGIBLE_SQL", "ELIGIBLE_TABLE_SQL", "RECENT_CALLS_SQL", "graded_sql", "kv_sql", "latest_metric_sql", "rank_case",
           "rules_sql", "sql_ago", "sql_round_half_up_ratio", "sql_truncate_ratio", "sql_ts", "sql_values", "sql_within"]
