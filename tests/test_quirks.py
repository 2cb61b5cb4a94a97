"""Hand-made edge frames for the semantics decisions."""

import datetime as dt

from pyspark.sql import functions as F

from switchyard.functions import exprs as X
from switchyard.operators import aggregates as A
from switchyard.operators import changes as C
from switchyard.operators import filters as Fl
from switchyard.operators import joins as J
from switchyard.operators import windows as W
from switchyard.sources import sql_dump as SD
from switchyard.sinks import export as EX
from switchyard.session import scratch_path


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# Q2: bc truncates, SQL ROUND rounds half away from zero -----------------------

def test_truncate_and_round(spark):
    df = spark.createDataFrame([(2, 3), (1, 20), (-1, 20), (1, 40), (0, 5)], "n long, d long")
    out = df.select(X.truncate_ratio(F.col("n") * 100, "d").alias("t"), X.round_half_up_ratio("n", "d", 1).alias("r"))
    got = [(r.t, r.r) for r in out.collect()]
    assert got == [(66.6, 0.7), (5.0, 0.1), (-5.0, -0.1), (2.5, 0.0), (0.0, 0.0)]


def test_rates_null_when_zero(spark):
    ts = dt.datetime(2024, 1, 30, 23, 50)
    log = spark.createDataFrame([(1, ts, "NA"), (2, ts, "SALE"), (3, ts, "AMD")],
                                "call_id long, call_date timestamp_ntz, status string")
    r = A.call_rates(log, "2024-01-31 00:00:00", "30 minutes").first()
    assert (r.amd_kills, r.drop_count, r.total_calls) == (1, 0, 3)
    assert r.amd_pct == 33.3 and r.drop_pct is None
    empty = A.call_rates(log.limit(0), "2024-01-31 00:00:00", "30 minutes").first()
    assert empty.total_calls == 0 and empty.amd_pct is None


def test_expected_calls_keeps_scale(spark):
    m = spark.createDataFrame([("1", 4, 2.5)], "campaign_id string, ready_agents long, auto_dial_level double")
    assert A.expected_calls(m).first().expected_calls == 10.0


# Q4: id remap ------------------------------------------------------------------

def test_remap_new_ids_above_both_maxima(spark):
    pkg = spark.createDataFrame([(9,), (10,)], "list_id long")
    dest = spark.createDataFrame([(5,), (9,)], "list_id long")
    coll = J.id_collisions(pkg, dest).where("collides").select("list_id")
    base = F.greatest(dest.select(F.max("list_id")).scalar(), pkg.select(F.max("list_id")).scalar())
    m = W.assign_new_ids(coll, "list_id", base)
    assert rows(m, "list_id", "new_id") == [(9, 11)]


# Q7: strict suffix vs legacy wildcard -----------------------------------------

def test_suffix_modes(spark):
    names = ["1001_B", "BOB", "B", "_B", "AB", "a" * 18, "a" * 19, "é" * 9, "é" * 10]
    users = spark.createDataFrame([(n, "x", 2, "g", "Y", "ip") for n in names],
                                  "user_name string, full_name string, user_level int, user_group string, active string, server_ip string")
    strict = {r.user_name for r in Fl.shadow_rows(users, "user_name").collect()}
    legacy = {r.user_name for r in Fl.shadow_rows(users, "user_name", wildcard=True).collect()}
    assert strict == {"1001_B", "_B"}
    assert legacy == {"1001_B", "_B", "BOB", "AB"}
    elig = {r.user_name for r in Fl.eligible_agents(users).collect()}
    assert "a" * 18 in elig and "a" * 19 not in elig
    assert "é" * 9 in elig and "é" * 10 not in elig  # 20 bytes
    assert "BOB" in elig and "1001_B" not in elig


# Q8: quote-aware dump parsing --------------------------------------------------

def test_dump_parse_edge_values(spark):
    lines = [
        "INSERT INTO `t` VALUES (1,'a),(b',NULL,-5),(2,'it\\'s','x''y',0);",
        "INSERT INTO `t` (`id`,`s`,`u`,`n`) VALUES (3,'back\\\\slash','(paren)',12),(4,'',' sp ',NULL);",
        "INSERT INTO `other` VALUES (9,'skip',NULL,1);",
        "-- comment line",
    ]
    df = spark.createDataFrame([(s,) for s in lines], "value string")
    out = SD.parse_dump_lines(df, "id long, s string, u string, n long", table="t")
    assert rows(out, "id", "s", "u", "n") == [
        (1, "a),(b", None, -5), (2, "it's", "x'y", 0), (3, "back\\slash", "(paren)", 12), (4, "", " sp ", None)]


def test_dump_roundtrip_identity(spark):
    data = [(1, "o'k \\ \n new", 1.5), (2, None, -2.0), (3, "),(", 0.0)]
    df = spark.createDataFrame(data, "id long, s string, x double")
    back = SD.parse_dump_lines(SD.dump_lines(df, "t", 2, "id"), "id long, s string, x double")
    assert rows(back, "id", "s", "x") == sorted(data, key=lambda r: r[0])


# Q11: hopper seed order --------------------------------------------------------

def test_seed_hopper_first_n_by_lead_id(spark):
    leads = spark.createDataFrame([(i, "555", 1, "NEW", "N") for i in (5, 3, 9, 1, 7)] + [(2, "555", 1, "SALE", "N")],
                                  "lead_id long, phone_number string, list_id long, status string, called_since_last_reset string")
    lists = spark.createDataFrame([(1, "C1"), (2, "000")], "list_id long, campaign_id string")
    got = rows(C.seed_hopper(leads, lists, n=3), "lead_id")
    assert got == [(1,), (3,), (5,)]


# Q16: decimal offset, not octal ------------------------------------------------

def test_phone_offset(spark):
    df = spark.createDataFrame([("8300",), ("010",), ("x12",), ("",), (None,)], "dialplan_number string")
    got = [r[0] for r in C.offset_if_digits(df, ["dialplan_number"]).collect()]
    assert got == ["18300", "10010", "x12", "", None]


# Q20: NOT IN three-valued logic --------------------------------------------------

def test_not_in_null_semantics(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "lead_id long")
    right = spark.createDataFrame([(2,)], "lead_id long")
    right_null = spark.createDataFrame([(2,), (None,)], "lead_id long")
    empty = right.limit(0)
    assert rows(J.not_in_subquery(left, right, "lead_id"), "lead_id") == [(1,)]
    assert rows(J.not_in_subquery(left, right_null, "lead_id"), "lead_id") == []
    assert len(J.not_in_subquery(left, empty, "lead_id").collect()) == 3
    # the same answer as Spark SQL's null-aware anti join
    left.createOrReplaceTempView("l_t")
    right_null.createOrReplaceTempView("r_t")
    assert spark.sql("select * from l_t where lead_id not in (select lead_id from r_t)").count() == 0


def test_delete_keeps_null_list(spark):
    lists = spark.createDataFrame([(998,), (5,)], "list_id long")
    leads = spark.createDataFrame([(1, 998), (2, 5), (3, None)], "lead_id long, list_id long")
    plan = C.plan_delete(lists, leads)
    assert rows(plan, "table_name", "row_id", "change") == [
        ("leads", 1, "keep"), ("leads", 2, "delete"), ("leads", 3, "keep"), ("lists", 5, "delete"), ("lists", 998, "keep")]


# Slots: more needs than free slots; one agent already holds a slot ------------

def test_assign_slots_one_to_one(spark):
    needs = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s1"), ("d", "s2")], "user_name string, server_ip string")
    # s1 uses its bridges, s2 its rooms: the other table's free or held slots do not count
    slots = spark.createDataFrame(
        [(9, "s1", "conferences", ""), (9, "s1", "conferences", "a_B"), (10, "s1", "confbridges", ""), (11, "s1", "confbridges", None),
         (12, "s1", "confbridges", "SIP/c_B"), (10, "s1", "conferences", None), (20, "s2", "conferences", "SIP/x"),
         (21, "s2", "confbridges", "")],
        "conf_exten long, server_ip string, slot_table string, extension string")
    servers = spark.createDataFrame([("s1", "CONFBRIDGE"), ("s2", "MEETME")], "server_ip string, conf_engine string")
    out = C.assign_slots(needs, slots, servers)
    assert rows(out, "user_name", "conf_exten", "result", "slot_table") == [
        ("a", 10, "assigned", "confbridges"), ("b", 11, "assigned", "confbridges"),
        ("c", 12, "already", "confbridges"), ("d", None, "none", "conferences")]
    after = C.apply_slot_assignments(slots, out)
    assert rows(after.where("change = 'update'"), "slot_table", "conf_exten", "extension") == [
        ("confbridges", 10, "SIP/a_B"), ("confbridges", 11, "SIP/b_B")]


# CSV with comma, quote, newline and NULL --------------------------------------

def test_csv_quoting_roundtrip(spark):
    leads = spark.createDataFrame(
        [(1, 1, "555", 'a,"b"', "x\ny", None, dt.datetime(2024, 1, 2, 3, 4, 5), None, None, "N")],
        "lead_id long, list_id long, phone_number string, first_name string, last_name string, status string, "
        "entry_date timestamp_ntz, last_local_call_time timestamp_ntz, called_count int, called_since_last_reset string")
    back = EX.export_leads_csv(leads, scratch_path(spark, "csv-test")).first()
    assert back.first_name == 'a,"b"' and back.last_name == "x\ny" and back.status == ""
    assert back.entry_date == "2024-01-02 03:04:05" and back.last_local_call_time == "" and back.called_count == 0


# Skew-safe ranking equals row_number on a hot group -----------------------------

def test_ranked_hot_group(spark):
    from pyspark.sql import Window

    n = 3000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string"))
                               .alias("g"), ((F.col("id") * 7919) % n).alias("k"))
    got = W.ranked(df, ["g"], ["k"], out="rn", num_partitions=7)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k")).cast("long"))
    assert sorted(got.collect()) == sorted(ref.collect())
    glob = W.ranked(df, [], ["k"], out="rn", num_partitions=5)
    assert sorted(r.rn for r in W.ranked(df, [], ["k"], out="rn").collect()) == list(range(1, n + 1))
    assert sorted(r.rn for r in glob.collect()) == list(range(1, n + 1))


def test_dump_zero_date_is_null_and_lines_deterministic(spark):
    df = spark.createDataFrame(["INSERT INTO `t` VALUES (1,'0000-00-00 00:00:00'),(2,'2024-01-02 03:04:05');"], "string")
    out = SD.parse_dump_lines(df, "id long, d timestamp_ntz")
    assert rows(out, "id", "d") == [(1, None), (2, dt.datetime(2024, 1, 2, 3, 4, 5))]
    data = spark.range(500).select(F.col("id"), (F.col("id") * 3).cast("string").alias("s"))
    a = sorted(r.value for r in SD.dump_lines(data.repartition(7), "t", 50, "id").collect())
    b = sorted(r.value for r in SD.dump_lines(data.repartition(3).orderBy(F.rand()), "t", 50, "id").collect())
    assert a == b


def test_audit_row_without_log_files(spark):
    files = spark.createDataFrame([("/other/x", 10, dt.datetime(2024, 1, 1))],
                                  "path string, length long, modification_time timestamp_ntz")
    r = EX.cleanup_audit_row(files, "2024-01-02 00:00:00").collect()
    assert len(r) == 1 and r[0].total_bytes == 0 and r[0].action.startswith("Truncated archives only")


def test_import_summary_counts_package_duplicates(spark):
    from switchyard.plans import migration

    lists = spark.createDataFrame([(1, "a", "c", "Y")], "list_id long, list_name string, campaign_id string, active string")
    leads = spark.createDataFrame([(10, 1, "555", "NEW", "Y")],
                                  "lead_id long, list_id long, phone_number string, status string, called_since_last_reset string")
    hopper = spark.createDataFrame([], "lead_id long, list_id long, campaign_id string, status string, priority int")
    pkg_leads = spark.createDataFrame([(10, 2, "1", "NEW", "Y"), (500, 2, "2", "NEW", "Y"), (500, 2, "3", "NEW", "Y")],
                                      leads.schema)
    pkg_lists = spark.createDataFrame([(2, "b", "c", "N")], lists.schema)
    plan = migration.plan_import(lists, leads, hopper, pkg_lists, pkg_leads, "2024-01-31 00:00:00")
    s = {(r.table_name, r.change): r.row_count for r in plan.summary.collect()}
    assert s[("leads", "insert")] == 1 and s[("leads", "ignored")] == 2
    assert s[("lists", "insert")] == 1 and s[("lists", "ignored")] == 0
    assert plan.mark == 10 and plan.leads.count() == 2


def test_ranked_desc_order_and_null_group(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("a", 5)], "g string, k long")
    got = W.ranked(df, ["g"], [F.col("k").desc()], out="rn", num_partitions=3)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(F.col("k").desc())).cast("long"))
    assert sorted(got.collect(), key=repr) == sorted(ref.collect(), key=repr)


def test_exact_ratio_zero_denominator_and_large_values(spark):
    from decimal import Decimal

    df = spark.createDataFrame([(Decimal(5), 0), (Decimal(9_000_000_000_000_000_000), 3)], "n decimal(38,0), d long")
    got = [(r.t, r.r) for r in df.select(X.truncate_ratio("n", "d").alias("t"), X.round_half_up_ratio("n", "d").alias("r")).collect()]
    assert got[0] == (None, None)
    assert got[1][0] == 3e18 and got[1][1] == 3e18


def test_dump_fields_with_spaces(spark):
    df = spark.createDataFrame(["INSERT INTO `t` VALUES (1, 'a, b', NULL), (2, 'x', 7);"], "string")
    out = SD.parse_dump_lines(df, "id long, s string, n long")
    assert rows(out, "id", "s", "n") == [(1, "a, b", None), (2, "x", 7)]


def test_session_without_checkpoint_setting(tmp_path):
    import subprocess
    import sys

    conf = tmp_path / "conf"
    conf.mkdir()
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from switchyard.session import local_session, scratch_path, checkpoint_dir\n"
        "from switchyard.operators import windows as W\n"
        "spark = local_session(2)\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "p = scratch_path(spark, 'x'); spark.range(3).write.parquet(p)\n"
        "assert sorted(r.rn for r in W.ranked(spark.range(5), [], ['id']).collect()) == [1, 2, 3, 4, 5]\n"
        "print('OK', checkpoint_dir(spark))\n" % str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    env = dict(__import__("os").environ, SPARK_CONF_DIR=str(conf))
    r = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert r.returncode == 0 and "OK" in r.stdout, r.stderr[-2000:]
