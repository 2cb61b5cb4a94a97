"""Branches that whole-table fixtures do not reach: empty tables, missing hosts, later rows, package order."""

import datetime as dt

from switchyard.operators import aggregates as A
from switchyard.operators import changes as C
from switchyard.operators import checks as K
from switchyard.operators import filters as Fl
from switchyard.operators import rules as R
from switchyard.plans import migration
from switchyard.session import scratch_path
from switchyard.sources import sql_dump as SD
from switchyard.sources import tables as TB
from switchyard.streaming import streams as S

AS_OF = "2024-01-31 00:00:00"


def _checks(df):
    return sorted((r["check"], r["side"], r["entity"]) for r in df.collect())


def test_empty_hopper_and_no_idle_slot(spark):
    hopper = spark.createDataFrame([], "lead_id long, list_id long, campaign_id string, status string")
    assert _checks(K.find_hopper_empty(hopper)) == [("hopper_empty", "CLIENT", "all")]
    slots = spark.createDataFrame([("LIA", dt.datetime(2024, 1, 30)), ("LIA", dt.datetime(2024, 1, 30, 23, 59))],
                                  "extension_status string, last_update timestamp_ntz")
    got = [c for c, side, _ in _checks(K.find_slots(slots, AS_OF)) if side == "SERVER"]
    assert got == ["slots_none_idle", "slots_stuck"]


def test_peer_lines_give_info_for_unreachable_and_unknown(spark):
    registry = spark.createDataFrame([(1, "host Registered"), (2, "host Timeout")], "line_no long, line string")
    peers = spark.createDataFrame([(7, "a OK (20 ms)"), (8, "b UNREACHABLE"), (9, "c UNKNOWN"), (10, "d")], "line_no long, line string")
    assert _checks(K.find_registration(registry, peers)) == [
        ("peer_down", "INFO", "8"), ("peer_down", "INFO", "9"), ("registration_failed", "SERVER", "2")]


def test_host_without_process_or_cores(spark):
    t = dt.datetime(2024, 1, 30)
    rows = [("up", "load1", 2.0), ("up", "cores", 8.0), ("up", "nice", 0.0), ("up", "rt_priority", 10.0), ("nocores", "load1", 99.0),
            ("nocores", "nice", 0.0), ("down", "load1", 1.0), ("down", "cores", 8.0)]
    samples = spark.createDataFrame([(i, h, t, m, v) for i, (h, m, v) in enumerate(rows)],
                                    "sample_id long, host string, ts timestamp_ntz, metric string, value double")
    got = {r["host"]: (r["load_grade"], r["nice_grade"], r["rt_grade"]) for r in K.grade_host(samples).collect()}
    assert got == {"up": ("PASS", "PASS", "PASS"), "nocores": ("SKIP", "PASS", "WARN"), "down": ("PASS", "FAIL", "SKIP")}


def test_host_without_jitter_settings_fails(spark):
    kv = spark.createDataFrame([("a", "jbenable", "yes")], "host string, key string, value string")
    hosts = spark.createDataFrame([("a",), ("b",), ("b",)], "host string")
    got = {r["host"]: r["enable_grade"] for r in K.grade_jitter_buffer(kv, hosts).collect()}
    assert got == {"a": "PASS", "b": "FAIL"}


def test_grade_verdict(spark):
    def result(*grades):
        return R.grade_verdict(spark.createDataFrame([(g,) for g in grades], "severity string")).first()["result"]

    assert [result("PASS", "WARN", "FAIL"), result("PASS", "WARN"), result("PASS")] == ["FAIL", "WARN", "CLEAN"]


def test_rows_after_as_of_do_not_count(spark):
    log = spark.createDataFrame([(dt.datetime(2024, 1, 30, 23, 50), "AMD"), (dt.datetime(2024, 1, 31, 0, 0), "SALE"),
                                 (dt.datetime(2024, 1, 31, 0, 1), "AMD")], "call_date timestamp_ntz, status string")
    assert Fl.recent(log, "call_date", AS_OF, "30 minutes").count() == 2
    assert A.call_rates(log, AS_OF, "30 minutes").first()["total_calls"] == 2
    assert K.call_snapshot(log, AS_OF, "30 minutes", AS_OF).first()["total_calls"] == 2


def test_revert_rows_and_counts_agree(spark):
    users = spark.createDataFrame([("a",), ("a_B",)], "user_name string")
    phones = spark.createDataFrame([("a_B",), ("xB",)], "extension string")
    slots = spark.createDataFrame([("s", "conferences", 1, "SIP/a_B"), ("s", "conferences", 2, "SIP/a"), ("s", "confbridges", 1, None)],
                                  "server_ip string, slot_table string, conf_exten long, extension string")
    got = sorted(map(tuple, C.revert_rows(users, phones, slots).collect()))
    assert got == [("conf_slots", "blank", "s/conferences/1"), ("phones", "delete", "a_B"), ("users", "delete", "a_B")]
    assert [r["row_count"] for r in C.revert_shadows(users, phones, slots).collect()] == [1, 1, 1]


def test_import_from_dump_files_keeps_the_first_line(spark):
    path = scratch_path(spark, "dump")
    spark.createDataFrame([("INSERT INTO `leads` VALUES (1,5,'zzz first'),(2,5,'b');",), ("INSERT INTO `leads` VALUES (1,5,'aaa second');",)],
                          "value string").coalesce(1).write.text(path)
    schema = "lead_id long, list_id long, status string"
    leads = SD.read_sql_dump(spark, path, schema, "leads", order="line").withColumn("called_since_last_reset", SD.F.lit("Y"))
    lists = spark.createDataFrame([(5, "x", "c", "N")], "list_id long, list_name string, campaign_id string, active string")
    alt = spark.createDataFrame([(1, 1, "555"), (1, 1, "556"), (2, 1, "557")], "lead_id long, alt_phone_count int, phone_number string")
    line = SD.F.monotonically_increasing_id()
    dest_leads = leads.drop("line").limit(0)
    hopper = spark.createDataFrame([], "lead_id long, list_id long, campaign_id string, status string, priority int")
    plan = migration.plan_import(lists.limit(0), dest_leads, hopper, lists.withColumn("line", line), leads, AS_OF,
                                 dest_alt=alt.where("lead_id = 2"), pkg_alt=alt.coalesce(1).withColumn("line", line), order="line")
    assert sorted((r["lead_id"], r["status"]) for r in plan.leads.collect()) == [(1, "zzz first"), (2, "b")]
    assert sorted(map(tuple, plan.alt_phones.collect())) == [(1, 1, "555"), (2, 1, "557")]
    counts = {(r["table_name"], r["change"]): r["row_count"] for r in plan.summary.collect()}
    assert counts[("alt_phones", "insert")] == 1 and counts[("alt_phones", "ignored")] == 2
    assert counts[("leads", "insert")] == 2 and counts[("leads", "ignored")] == 1


def test_sync_gives_phones_and_slots_and_can_be_replayed(spark):
    users = scratch_path(spark, "u")
    one = spark.createDataFrame([("100", "Agent", 2, "g", "Y", "ip")], S.USER_SCHEMA)
    phones = spark.createDataFrame([("100", "100", "Y")], "extension string, dialplan_number string, active string")
    slots = spark.createDataFrame([("ip", "confbridges", 7, None, "idle"), ("ip", "conferences", 6, "", "idle")],
                                  "server_ip string, slot_table string, conf_exten long, extension string, extension_status string")
    servers = spark.createDataFrame([("ip", "CONFBRIDGE")], "server_ip string, conf_engine string")
    accounts = S.create_accounts(one, users, phones, slots, servers, scratch_path(spark, "a"), buckets=4)
    for batch_id in (0, 0, 1):
        S.sync_batch(one, batch_id, users, accounts=accounts)
    phones, slots = (S.KeyedTable.open(spark, p).read(spark) for p in (accounts.phones_path, accounts.slots_path))
    assert sorted(r["extension"] for r in phones.collect()) == ["100", "100_B"]
    got = sorted((r["slot_table"], r["conf_exten"], r["extension"]) for r in slots.collect())
    assert got == [("confbridges", 7, "SIP/100_B"), ("conferences", 6, "")]
