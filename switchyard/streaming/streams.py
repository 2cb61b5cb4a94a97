"""Structured Streaming versions of the rolling checks.

The reference re-polls ``NOW() - INTERVAL`` every few minutes.  Here the
same checks are incremental queries: event time comes from the rows,
late data is bounded by a watermark, and state is evicted once a window
closes.  Sinks are idempotent per micro-batch (``foreachBatch`` writes each
batch to its own folder with overwrite), and checkpoints live under the
shared ``spark.checkpoint.dir``, so a restarted query neither loses nor
repeats output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import changes, filters
from ..operators.checks import DIALER_ERROR_PATTERN
from ..session import path_exists, scratch_path
from .keyed_table import KeyedTable

CALL_SCHEMA = "call_id bigint, call_date timestamp_ntz, lead_id bigint, agent string, status string"
AGENT_SCHEMA = "event_id bigint, event_time timestamp_ntz, agent string, status string"
LOG_SCHEMA = "line_no bigint, host string, ts timestamp_ntz, line string"
USER_SCHEMA = ("user_name string, full_name string, user_level int, user_group string, active string, "
               "server_ip string")



def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _event_time(df: DataFrame, ts_col: str) -> DataFrame:
    """Event time for the watermark (which needs TIMESTAMP, not TIMESTAMP_NTZ):
    the instant whose UTC wall clock equals the NTZ value.  Computed from
    microseconds since the epoch, so no session zone or DST shift applies."""
    return df.withColumn("_et", F.timestamp_micros(X.ntz_micros(ts_col)))


def _wall(c):
    """Back from an event-time instant to the NTZ wall clock (inverse of ``_event_time``)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), _epoch())


def _window_counts(calls: DataFrame, watermark: str, window: str, slide: str) -> DataFrame:
    ev = _event_time(calls, "call_date").withWatermark("_et", watermark)
    return ev.groupBy(F.window("_et", window, slide).alias("w"), "status").agg(F.count(F.lit(1)).alias("count"))


def stream_dispositions(calls: DataFrame, watermark: str = "10 minutes", window: str = "30 minutes",
                        slide: str = "5 minutes") -> DataFrame:
    """Sliding-window status counts; a window is final once the watermark passes its end."""
    return _window_counts(calls, watermark, window, slide).select(
        _wall(F.col("w.start")).alias("window_start"), _wall(F.col("w.end")).alias("window_end"), "status", "count")


def stream_disposition_shares(calls: DataFrame, watermark: str = "10 minutes", window: str = "30 minutes",
                              slide: str = "5 minutes") -> DataFrame:
    """Status counts per sliding window with their share of it, ROUND(count*100/total, 1), in the stream itself.

    Two stateful operators in a chain: calls are counted per window and status,
    and the counts of a window that the watermark has closed meet in a second
    aggregate, which closes with the same watermark.  It holds one entry a
    status and window (status codes, not calls), so a sink gets finished shares
    once and never reads its own output again.
    """
    counts = _window_counts(calls, watermark, window, slide)
    closed = counts.groupBy("w").agg(F.sum("count").alias("_total"), F.collect_list(F.struct("status", "count")).alias("_counts"))
    return closed.select("w", "_total", F.inline("_counts")).select(
        _wall(F.col("w.start")).alias("window_start"), _wall(F.col("w.end")).alias("window_end"), "status", "count",
        X.round_half_up_ratio(F.col("count") * 100, "_total").alias("pct"))


def stream_errors(lines: DataFrame, pattern: str = DIALER_ERROR_PATTERN, watermark: str = "10 minutes",
                  window: str = "5 minutes") -> DataFrame:
    """Error lines per tumbling window; rows later than the watermark are dropped.

    Every line moves the watermark, whether it is an error or not, so a
    window closes though no further error comes.
    """
    ev = _event_time(lines, "ts").withWatermark("_et", watermark)
    agg = (ev.groupBy(F.window("_et", window).alias("w")).agg(F.count_if(F.col("line").rlike(pattern)).alias("errors"))
           .where("errors > 0"))
    return agg.select(_wall(F.col("w.start")).alias("window_start"), _wall(F.col("w.end")).alias("window_end"),
                      "errors")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_agent_state(events: DataFrame, key: str = "agent", ts_col: str = "call_date", tie: str = "call_id", status_col: str = "status",
                       ready: tuple[str, ...] = ("READY",), warn_seconds: int = 60, fail_seconds: int = 120,
                       expire: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Current status per agent (latest by event time, tie-broken), how long it has been idle, and when it is gone.

    Keyed state holds one row an agent.  Event-time timers raise the flag of
    an agent that stays ``ready`` over ``warn_seconds`` and ``fail_seconds``
    though no event comes, and drop the state of an agent silent for
    ``expire`` (its last row says ``gone``), so state is bounded by the agents
    of that span.  Rows are emitted in update mode: the agent, ``status``,
    ``last_update_time``, ``idle_seconds`` as of the watermark, ``flag`` and
    ``gone``.  An older event than the known one changes nothing; events
    without an agent or a time are left out.

    Timers need the RocksDB state store: ``run_available_now(..., state_store=ROCKSDB)``.
    """
    from .agents import agent_timers

    spark = events.sparkSession
    millis = spark.range(1).select(F.expr(f"unix_millis(timestamp '1970-01-01 00:00:00Z' + interval {expire})")).first()[0]
    known = events.where(F.col(key).isNotNull() & F.col(ts_col).isNotNull())
    ev = _event_time(known, ts_col).withWatermark("_et", watermark)
    ev = ev.select(F.col(key), "_et", X.ntz_micros(ts_col).alias("t"), F.col(tie).cast("long").alias("k"), F.col(status_col).alias("status"))
    schema = f"{key} {events.schema[key].dataType.simpleString()}, status string, t long, idle_ms long, flag string, gone boolean"
    rows = ev.groupBy(key).transformWithStateInPandas(
        agent_timers(key, ready, warn_seconds * 1000, fail_seconds * 1000, millis), schema, "update", "eventTime")
    return rows.select(key, "status", _wall(F.timestamp_micros("t")).alias("last_update_time"),
                       F.floor(F.col("idle_ms") / 1000).alias("idle_seconds"), "flag", "gone")


def agent_states(out: DataFrame, as_of: str | Column, key: str = "agent", ready: tuple[str, ...] = ("READY",)) -> DataFrame:
    """The agents that are not gone, from the rows of ``stream_agent_state``: idle seconds of the ready ones at ``as_of``."""
    last = latest_batch_rows(out, key).where("not gone")
    as_of = as_of if isinstance(as_of, Column) else X.ts_literal(as_of)
    idle = F.when(F.col("status").isin(*ready), X.seconds_between("last_update_time", as_of))
    return last.select(key, "status", "last_update_time", idle.alias("idle_seconds"), "flag")


def run_available_now(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", state_store: str | None = None) -> DataFrame:
    """Run a streaming frame over everything available, idempotently.

    Each micro-batch is written to ``sink/batch_id=<n>`` with overwrite, so
    a batch replayed after a failure replaces its own output.  Returns the
    sink read back with a ``batch_id`` column.  ``state_store`` names the
    provider class of the run's state store, if not the session's.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    # windows closed by the final watermark are emitted by a trailing no-data
    # micro-batch; make sure the session allows it for this run
    wanted = {"spark.sql.streaming.noDataMicroBatches.enabled": "true"}
    if state_store:
        wanted["spark.sql.streaming.stateStore.providerClass"] = state_store
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        q = (df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(_with_batch(df)).parquet(sink) if path_exists(spark, sink) else \
        spark.createDataFrame([], _with_batch(df))


def _with_batch(df: DataFrame):
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType(list(df.schema.fields) + [StructField("batch_id", LongType())])


def latest_batch_rows(out: DataFrame, key: str) -> DataFrame:
    """Final state from update-mode output: the row of the latest batch per key."""
    cols = [c for c in out.columns if c not in (key, "batch_id")]
    best = out.groupBy(key).agg(F.max(F.struct("batch_id", *cols)).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in cols])


@dataclass
class Accounts:
    """Where the phones and slots that belong to the users are stored, as keyed tables:
    phones in buckets by ``extension``, slots by ``server_ip`` with their key (a later row of a slot replaces it)."""

    phones_path: str
    slots_path: str
    servers: DataFrame  # (server_ip, conf_engine), a static table


def create_accounts(users: DataFrame, users_path: str, phones: DataFrame | None = None, slots: DataFrame | None = None,
                    servers: DataFrame | None = None, root: str | None = None, buckets: int = 64) -> Accounts | None:
    """The initial tables of a shadow sync, as keyed tables."""
    KeyedTable.create(users, users_path, "user_name", buckets=buckets)
    if phones is None:
        return None
    out = Accounts(f"{root}/phones", f"{root}/slots", servers)
    KeyedTable.create(phones, out.phones_path, "extension", buckets=buckets)
    KeyedTable.create(slots, out.slots_path, "server_ip", changes.SLOT_KEY, buckets)
    return out


def _with_shadows(names: DataFrame, suffix: str) -> DataFrame:
    """Names and their shadows' names."""
    c = F.col(names.columns[0])
    return names.select(F.explode(F.array(c, F.concat(c, F.lit(suffix)))).alias("name"))


def sync_accounts(eligible: DataFrame, batch_id: int, accounts: Accounts, suffix: str = "_B") -> None:
    """Shadow phones and slots of one micro-batch's eligible agents; safe to replay."""
    spark = eligible.sparkSession
    phones = KeyedTable.open(spark, accounts.phones_path)
    known = phones.read(spark, _with_shadows(eligible.select("user_name"), suffix), batch_id)
    phones.commit(changes.clone_phones(known, eligible, suffix), batch_id)
    table = KeyedTable.open(spark, accounts.slots_path)
    slots = table.read(spark, eligible.select("server_ip"), batch_id)
    plan = changes.assign_slots(eligible.select("user_name", "server_ip"), slots, accounts.servers, suffix)
    table.commit(changes.apply_slot_assignments(slots, plan).where("change = 'update'").drop("change"), batch_id)


def start_sync_stream(users_stream: DataFrame, table_path: str, checkpoint: str, every: str = "5 minutes",
                      suffix: str = "_B", accounts: Accounts | None = None):
    """Run the shadow sync continuously, one micro-batch every ``every``
    (the reference's cron period); returns the running StreamingQuery."""
    def sync(batch: DataFrame, batch_id: int) -> None:
        sync_batch(batch, batch_id, table_path, suffix, accounts)

    return (users_stream.writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint)
            .trigger(processingTime=every).start())


def stream_sync(users_stream: DataFrame, table_path: str, checkpoint: str, suffix: str = "_B",
                accounts: Accounts | None = None) -> None:
    """Shadow users for newly seen eligible agents, once each.

    ``table_path`` holds the users as a keyed table (``create_accounts``).
    Every micro-batch takes the user rows of the stream (of several of one
    name in a batch an active one), looks up these names and their shadows,
    adds users the table does not have yet, clones the eligible ones that have
    no shadow, and commits both (INSERT IGNORE semantics, replay-safe).  With
    ``accounts`` their phones and slots follow in the same micro-batch.
    """
    def sync(batch: DataFrame, batch_id: int) -> None:
        sync_batch(batch, batch_id, table_path, suffix, accounts)

    q = (users_stream.writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


USER_COLUMNS = ("user_name", "full_name", "user_level", "user_group", "active", "server_ip")


def sync_batch(batch: DataFrame, batch_id: int, table_path: str, suffix: str = "_B",
               accounts: Accounts | None = None) -> None:
    """One micro-batch of ``stream_sync``; safe to replay.

    The table is read as it was before this batch, so a replayed batch
    recomputes the same clones instead of finding them already present; of the
    table only the buckets of the batch's own names are read.
    """
    spark = batch.sparkSession
    stored = KeyedTable.open(spark, table_path)
    # no state over the stream: a user that becomes active later is cloned then, from that row
    best = F.max_by(F.struct(*USER_COLUMNS), F.struct(F.coalesce(F.col("active") == "Y", F.lit(False)), *USER_COLUMNS[1:]))
    incoming = batch.groupBy("user_name").agg(best.alias("_r")).select(*[F.col("_r")[c].alias(c) for c in USER_COLUMNS])
    table = stored.read(spark, _with_shadows(incoming.select("user_name"), suffix), batch_id).select(*USER_COLUMNS)
    # users first seen in the stream join the table (INSERT IGNORE by name)
    new_users = incoming.join(table.select("user_name"), "user_name", "left_anti")
    users = table.join(incoming.select("user_name"), "user_name", "left_anti").unionByName(incoming)
    eligible = filters.eligible_agents(incoming, suffix)
    clones = changes.clone_users(users, eligible, suffix)
    stored.commit(new_users.unionByName(clones), batch_id)
    if accounts is not None:
        sync_accounts(eligible, batch_id, accounts, suffix)


def stage_stream_input(df: DataFrame, name: str) -> str:
    """Write a frame Spark derived from the tables as a folder of files for a file stream."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return path
