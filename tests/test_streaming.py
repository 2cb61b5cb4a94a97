"""Streaming: late data beyond the watermark, restart without duplicates."""

import datetime as dt
import re
import time

import pytest
from pyspark.sql import functions as F

from switchyard.session import scratch_path
from switchyard.streaming import streams as S


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)  # file sources order new files by modification time


def test_late_row_beyond_watermark_is_dropped(spark):
    # Lateness is judged against the previous micro-batch's watermark
    # (eviction uses the current one), so the late row comes in batch 3.
    src = scratch_path(spark, "late-src")
    t = dt.datetime(2024, 1, 30, 10, 0)
    m = dt.timedelta(minutes=1)
    _write(spark, src, [(i, "h", t + i * m, "VDAD ERROR x") for i in range(31)], S.LOG_SCHEMA)   # 10:00-10:30
    _write(spark, src, [(100, "h", t + 45 * m, "VDAD ERROR advance")], S.LOG_SCHEMA)              # watermark -> 10:35
    _write(spark, src, [(101, "h", t + 5 * m, "VDAD ERROR too late"),                            # < 10:20: dropped
                        (102, "h", t + 28 * m, "VDAD ERROR inside")], S.LOG_SCHEMA)              # >= 10:20: counted
    lines = spark.readStream.schema(S.LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out = S.run_available_now(S.stream_errors(lines, watermark="10 minutes"), scratch_path(spark, "late-out"),
                              scratch_path(spark, "late-ckpt"))
    got = {r.window_start.strftime("%H:%M"): r.errors for r in out.collect()}
    assert got["10:05"] == 5          # the late 10:05 row was dropped
    assert got["10:25"] == 6          # the 10:28 row inside the watermark was counted
    assert "10:45" not in got         # still open: its end 10:50 is past the watermark


def _agent_run(spark, src, sink, ckpt, **options):
    events = spark.readStream.schema(S.AGENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    state = S.stream_agent_state(events, ts_col="event_time", tie="event_id", watermark="0 seconds", **options)
    return S.run_available_now(state, sink, ckpt, mode="update", state_store=S.ROCKSDB)


def test_restart_from_checkpoint_no_duplicates(spark):
    src = scratch_path(spark, "state-src")
    sink, ckpt = scratch_path(spark, "state-out"), scratch_path(spark, "state-ckpt")
    t = dt.datetime(2024, 1, 30, 10, 0)
    _write(spark, src, [(1, t, "a1", "READY"), (2, t, "a2", "INCALL"), (3, t, None, "READY")], S.AGENT_SCHEMA)
    first = _agent_run(spark, src, sink, ckpt, expire="1 hour")
    assert first.count() == 2
    again = _agent_run(spark, src, sink, ckpt, expire="1 hour")  # same checkpoint, no new data: nothing new
    assert again.count() == 2
    _write(spark, src, [(4, t + dt.timedelta(minutes=5), "a1", "PAUSED"), (0, t, "a2", "DEAD")], S.AGENT_SCHEMA)
    final = S.agent_states(_agent_run(spark, src, sink, ckpt, expire="1 hour"), "2024-01-30 10:06:00")
    assert sorted((r.agent, r.status, r.idle_seconds, r.flag) for r in final.collect()) == [("a1", "PAUSED", None, ""), ("a2", "INCALL", None, "")]


def test_idle_agents_are_flagged_by_timers_and_gone_ones_evicted(spark):
    """One event of a1, then only other agents: its flags come from timers, also over a restart; silent agents go."""
    src = scratch_path(spark, "idle-src")
    sink, ckpt = scratch_path(spark, "idle-out"), scratch_path(spark, "idle-ckpt")
    t = dt.datetime(2024, 1, 30, 10, 0)

    def at(seconds, *rows):
        _write(spark, src, [(seconds * 10 + i, t + dt.timedelta(seconds=seconds), a, s) for i, (a, s) in enumerate(rows)], S.AGENT_SCHEMA)
        return _agent_run(spark, src, sink, ckpt)

    def state(out):
        return {r.agent: (r.status, r.flag, r.gone) for r in S.latest_batch_rows(out, "agent").collect()}

    assert state(at(0, ("a1", "READY"), ("a2", "INCALL"), ("a3", "READY")))["a1"] == ("READY", "", False)
    got = state(at(61, ("a3", "PAUSED"), ("a4", "READY")))
    assert got["a1"] == ("READY", "elevated wait", False) and got["a2"][1] == "" and got["a3"] == ("PAUSED", "", False)
    got = state(at(121, ("a4", "READY")))
    assert got["a1"] == ("READY", "IDLE TOO LONG", False) and got["a4"] == ("READY", "", False)
    out = at(601, ("a5", "READY"))
    got = state(out)
    assert got["a1"] == ("READY", "IDLE TOO LONG", True) and got["a2"] == ("INCALL", "", True)
    assert not got["a3"][2] and got["a4"][:2] == ("READY", "IDLE TOO LONG")
    left = S.agent_states(out, "2024-01-30 10:10:01")
    assert sorted((r.agent, r.idle_seconds) for r in left.collect() if r.status == "READY") == [("a4", 480), ("a5", 0)]
    got = state(at(602, ("a1", "READY")))     # a gone agent may come back
    assert got["a1"] == ("READY", "", False)


def test_log_text_stream_matches_batch_parse(spark):
    from switchyard.sources import text as TX

    src = scratch_path(spark, "log-text")
    lines = ["[2024-01-30 10:00:01] ERROR[1]: AGI script failed", "[Jan 30 10:00:02] VERBOSE[2][C-1]: CONF joined",
             "not a log line"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(src)
    stream = TX.read_log_stream(spark, src, host="h1", year=2024)
    out = S.run_available_now(stream, scratch_path(spark, "log-text-out"), scratch_path(spark, "log-text-ckpt"))
    got = sorted(((r.level, r.component, r.message, r.ts) for r in out.collect()), key=repr)
    batch = TX.read_log_lines(spark, src, host="h1", year=2024)
    want = sorted(((r.level, r.component, r.message, r.ts) for r in batch.collect()), key=repr)
    assert got == want
    assert (None, None, "", None) in got
    assert ("ERROR", "1", "AGI script failed", dt.datetime(2024, 1, 30, 10, 0, 1)) in got
    assert ("VERBOSE", "2", "CONF joined", dt.datetime(2024, 1, 30, 10, 0, 2)) in got


def test_sync_batch_replay_keeps_clones(spark):
    from switchyard.plans.fixtures import Fixture

    users = Fixture(spark, "/root/testdata/sf0.001").users
    table = scratch_path(spark, "sync-replay")
    S.create_accounts(users, table)

    def names():
        return sorted(r.user_name for r in S.KeyedTable.open(spark, table).read(spark).collect())

    S.sync_batch(users, 0, table)
    first = names()
    S.sync_batch(users, 0, table)          # the same batch again, as after a crash before commit
    assert len(first) > users.count() and names() == first
    S.sync_batch(users, 1, table)          # a later batch with the same users adds nothing
    assert names() == first


def test_a_lookup_reads_the_buckets_of_its_keys(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    table = S.KeyedTable.create(df, scratch_path(spark, "keyed"), "k", buckets=16)
    table.commit(df.where("v in (5, 6)"), 0)
    keys = spark.createDataFrame([("5",), ("7",)], "k string")
    found = table.read(spark, keys)
    buckets = {re.search("bucket=([0-9]+)", f).group(1) for f in found.inputFiles()}
    want = {str(r.b) for r in keys.select(table._bucket(F.col("k")).alias("b")).collect()}
    assert buckets == want and len(want) <= 2
    assert sorted(r.v for r in found.where("k in ('5', '7')").collect()) == [5, 5, 7]
    assert table.read(spark).count() == 1002


def test_later_rows_replace_and_buckets_are_merged(spark):
    rows = spark.createDataFrame([(i, "old") for i in range(40)], "k long, v string")
    table = S.KeyedTable.create(rows, scratch_path(spark, "keyed"), "k", ("k",), buckets=2)
    want = {i: "old" for i in range(40)}
    for n in range(20):
        table.commit(spark.createDataFrame([(n, f"new{n}")], "k long, v string"), n)
        want[n] = f"new{n}"
        assert {r.k: r.v for r in table.read(spark).collect()} == want
    live = table._live(spark, None)
    assert all(len(s["deltas"]) < 8 for s in live.values()) and any(s["base"] >= 0 for s in live.values())
    assert {r.k: r.v for r in table.read(spark, before=0).collect()} == {i: "old" for i in range(40)}


def test_a_crash_in_a_merge_leaves_the_state_before(spark, monkeypatch):
    one = lambda k, v: spark.createDataFrame([(k, v)], "k long, v string")
    table = S.KeyedTable.create(one(1, "a"), scratch_path(spark, "keyed"), "k", ("k",), buckets=1)
    save = S.KeyedTable._save

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(S.KeyedTable, "_save", crash)   # delta and merged base are written, the manifest is not
    with pytest.raises(RuntimeError):
        table.commit(one(1, "b"), 0)
    monkeypatch.setattr(S.KeyedTable, "_save", save)
    assert [tuple(r) for r in table.read(spark).collect()] == [(1, "a")]
    table.commit(one(2, "c"), 0)                         # the replay, here with other rows: nothing of the crash is left
    assert sorted(tuple(r) for r in table.read(spark).collect()) == [(1, "a"), (2, "c")]


def test_sync_batch_clones_users_new_to_the_stream(spark):
    table = scratch_path(spark, "sync-new")
    S.create_accounts(spark.createDataFrame([("100", "Old Agent", 2, "g", "Y", "ip")], S.USER_SCHEMA), table)
    batch = spark.createDataFrame([("100", "Old Agent", 2, "g", "Y", "ip"), ("200", "New Agent", 3, "g", "Y", "ip")], S.USER_SCHEMA)
    S.sync_batch(batch, 0, table)
    got = sorted(r.user_name for r in S.KeyedTable.open(spark, table).read(spark).collect())
    assert got == ["100", "100_B", "200", "200_B"]


def test_dst_day_keeps_wall_clock(spark):
    from switchyard.sources import text as TX

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        src = scratch_path(spark, "dst-src")
        t = dt.datetime(2024, 3, 10, 2, 30)      # does not exist in New York: clocks jump 02:00 -> 03:00
        _write(spark, src, [(1, "h", t, "VDAD ERROR a"), (2, "h", t + dt.timedelta(hours=2), "VDAD ERROR b")], S.LOG_SCHEMA)
        lines = spark.readStream.schema(S.LOG_SCHEMA).parquet(src)
        out = S.run_available_now(S.stream_errors(lines, watermark="10 minutes"), scratch_path(spark, "dst-out"),
                                  scratch_path(spark, "dst-ckpt"))
        assert [r.window_start for r in out.collect()] == [t]
        parsed = spark.createDataFrame([("[2024-03-10 02:30:00] ERROR[1]: x",)], "line string")
        assert TX.parse_log_lines(parsed).first().ts == t
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_clean_lines_close_windows(spark):
    """The watermark moves with every line: one error, then only other lines for two hours."""
    src = scratch_path(spark, "quiet-src")
    t = dt.datetime(2024, 1, 30, 10, 0)
    rows = [(0, "h", t, "VDAD error")] + [(i, "h", t + dt.timedelta(minutes=i), "fine") for i in range(1, 150)]
    _write(spark, src, rows, S.LOG_SCHEMA)
    lines = spark.readStream.schema(S.LOG_SCHEMA).parquet(src)
    out = S.run_available_now(S.stream_errors(lines), scratch_path(spark, "quiet-out"), scratch_path(spark, "quiet-ckpt"))
    assert [(r.window_start, r.errors) for r in out.collect()] == [(t, 1)]
