"""Catalogue: streaming operators.

The stream input is data Spark derives from the tables (call_log,
log_lines, users), written to the shared scratch folder as a file stream.
Each query runs with ``availableNow`` over everything available and writes
idempotent per-batch output; the registered frame is that output read back.
The oracle is the batch SQL of the final (watermark-closed) windows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.setops import union_all
from ..session import scratch_path
from ..streaming import streams as S
from ..streaming.keyed_table import KeyedTable
from .catalog_changes import ASSIGN_SLOTS_SQL, CLONE_PHONES_SQL
from .catalog_relational import CLONE_USERS_SQL
from .registry import register
from .sqlbits import sql_round_half_up_ratio

WATERMARK_MINUTES = 10


def _bucket(col: str, minutes: int) -> str:
    return f"(date_trunc('minute', {col}) - to_minutes(cast(minute({col}) % {minutes} as bigint)))"


@register("stream_disposition_mix", section="2.11", oracle=f"""
with b as (select {_bucket('call_date', 5)} as bucket, status from call_log),
w as (select bucket - to_minutes(cast(k * 5 as bigint)) as window_start, status from b, range(0, 6) r(k)),
c as (select window_start, window_start + interval 30 minutes as window_end, status, count(*) as count
      from w group by window_start, status),
f as (select * from c where window_end <= (select max(call_date) from call_log) - interval {WATERMARK_MINUTES} minutes)
select window_start, window_end, status, count,
  {sql_round_half_up_ratio('count * 100', 'sum(count) over (partition by window_start)')} as pct
from f""")
def stream_disposition_mix(fx):
    spark = fx.spark
    src = S.stage_stream_input(fx.call_log, "calls-stream")
    calls = spark.readStream.schema(S.CALL_SCHEMA).parquet(src)
    shares = S.stream_disposition_shares(calls, f"{WATERMARK_MINUTES} minutes")
    return S.run_available_now(shares, scratch_path(spark, "mix-out"), scratch_path(spark, "mix-ckpt")).drop("batch_id")


@register("stream_error_counts", section="2.11", oracle=f"""
with e as (select {_bucket('ts', 5)} as window_start from log_lines where regexp_matches(line, '{S.DIALER_ERROR_PATTERN}'))
select window_start, window_start + interval 5 minutes as window_end, count(*) as errors from e
group by window_start
having window_start + interval 5 minutes <= (select max(ts) from log_lines)
  - interval {WATERMARK_MINUTES} minutes""")
def stream_error_counts(fx):
    spark = fx.spark
    src = S.stage_stream_input(fx.log_lines, "log-stream")
    lines = spark.readStream.schema(S.LOG_SCHEMA).parquet(src)
    errs = S.stream_errors(lines, watermark=f"{WATERMARK_MINUTES} minutes")
    out = S.run_available_now(errs, scratch_path(spark, "err-out"), scratch_path(spark, "err-ckpt"))
    return out.drop("batch_id")


@register("stream_agent_state", section="2.11", oracle=f"""
with l as (select agent, arg_max(status, {{'t': event_time, 'k': event_id}}) as status, max(event_time) as last_update_time
           from agent_events where agent is not null group by agent),
w as (select *, (select date_trunc('milliseconds', max(event_time)) from agent_events) - interval {WATERMARK_MINUTES} minutes as as_of from l),
i as (select *, epoch_ms(as_of) - epoch_ms(last_update_time) as idle_ms from w)
select agent, status, last_update_time, case when status = 'READY' then date_diff('microsecond', last_update_time, as_of) // 1000000 end as idle_seconds,
  case when status = 'READY' and idle_ms > 120000 then 'IDLE TOO LONG' when status = 'READY' and idle_ms > 60000 then 'elevated wait' else '' end as flag
from i where idle_ms <= 12 * 3600000""")
def stream_agent_state(fx):
    """Agents not silent for twelve hours at the last watermark."""
    spark = fx.spark
    events = fx.agent_events
    src = S.stage_stream_input(events, "state-stream")
    stream = spark.readStream.schema(S.AGENT_SCHEMA).parquet(src)
    state = S.stream_agent_state(stream, ts_col="event_time", tie="event_id", expire="12 hours", watermark=f"{WATERMARK_MINUTES} minutes")
    out = S.run_available_now(state, scratch_path(spark, "state-out"), scratch_path(spark, "state-ckpt"), mode="update", state_store=S.ROCKSDB)
    as_of = events.select(F.date_trunc("millisecond", F.max("event_time")).cast("timestamp_ntz") - F.expr(f"interval {WATERMARK_MINUTES} minutes")).scalar()
    return S.agent_states(out, as_of)


@register("stream_agent_sync", section="2.11", oracle=f"select * from users union all select * from {CLONE_USERS_SQL} c")
def stream_agent_sync(fx):
    spark = fx.spark
    users = fx.users
    table = scratch_path(spark, "users-table")
    S.create_accounts(users, table, buckets=8)
    src = S.stage_stream_input(users, "users-stream")
    stream = spark.readStream.schema(S.USER_SCHEMA).parquet(src)
    S.stream_sync(stream, table, scratch_path(spark, "sync-ckpt"))
    return KeyedTable.open(spark, table).read(spark).select(*users.columns)


@register("stream_account_sync", section="2.11", oracle=f"""
select 'user' as item, user_name as name, full_name as value from users
union all select 'user', user_name, full_name from {CLONE_USERS_SQL} c
union all select 'phone', extension, dialplan_number from phones
union all select 'phone', extension, dialplan_number from {CLONE_PHONES_SQL} p
union all
select 'slot', s.server_ip || '/' || s.slot_table || '/' || cast(s.conf_exten as varchar), coalesce(a.new_extension, s.extension)
from conf_slots s left join (select * from {ASSIGN_SLOTS_SQL} x where result = 'assigned') a
  on a.server_ip = s.server_ip and a.slot_table = s.slot_table and a.conf_exten = s.conf_exten""")
def stream_account_sync(fx):
    """Users, phones and slots after a streamed sync of all users."""
    spark = fx.spark
    path, root = scratch_path(spark, "sync-users"), scratch_path(spark, "sync-accounts")
    accounts = S.create_accounts(fx.users, path, fx.phones, fx.conf_slots, fx.servers, root, buckets=8)
    src = S.stage_stream_input(fx.users, "accounts-stream")
    S.stream_sync(spark.readStream.schema(S.USER_SCHEMA).parquet(src), path, scratch_path(spark, "accounts-ckpt"), accounts=accounts)
    users, phones, after = (KeyedTable.open(spark, p).read(spark) for p in (path, accounts.phones_path, accounts.slots_path))
    return union_all(
        users.select(F.lit("user").alias("item"), F.col("user_name").alias("name"), F.col("full_name").alias("value")),
        phones.select(F.lit("phone").alias("item"), F.col("extension").alias("name"), F.col("dialplan_number").alias("value")),
        after.select(F.lit("slot").alias("item"), F.concat_ws("/", "server_ip", "slot_table", "conf_exten").alias("name"),
                     F.col("extension").alias("value")))
