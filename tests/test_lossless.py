"""Nothing is cut or lost: dump text, long digits, later activations, pruned scans."""

from pyspark.sql import functions as F

from switchyard.operators import changes as C
from switchyard.operators import checks
from switchyard.plans.fixtures import Fixture
from switchyard.session import scratch_path
from switchyard.sources import sql_dump as SD
from switchyard.streaming import streams as S

from paths import SF001

SCHEMA = "a int, b string, c int"


def test_dump_reads_introducers_tuple_lines_and_counts_what_it_leaves(spark):
    lines = spark.createDataFrame([
        ("INSERT INTO `t` VALUES (1,_binary 'abc',2),(2,_utf8mb4'x\\'y',3);",), ("INSERT INTO `t` VALUES",), ("(3,'d',4),",), ("  (4,NULL,5);",),
        ("INSERT INTO `t` VALUES (5,'short');",), ("INSERT INTO `t` VALUES (6,'e',6),(7,'trunca",), ("-- a comment",)], "value string")
    got = sorted(map(tuple, SD.parse_dump_lines(lines, SCHEMA).collect()))
    assert got == [(1, "abc", 2), (2, "x'y", 3), (3, "d", 4), (4, None, 5), (6, "e", 6)]
    assert tuple(SD.dump_tally(lines, SCHEMA).first()) == (5, 1, 1)
    assert sorted(r["reason"] for r in SD.dump_rejects(lines, SCHEMA).collect()) == ["fields", "not a tuple"]


def test_dump_files_are_read_whole(spark):
    path = scratch_path(spark, "dump")
    long = "x" * 300_000
    spark.createDataFrame([(f"INSERT INTO `t` VALUES (1,'{long}',2),(2,'b',3);",)], "value string").write.text(path)
    got = SD.read_sql_dump(spark, path, SCHEMA, "t").collect()
    assert sorted((r["a"], len(r["b"])) for r in got) == [(1, 300_000), (2, 1)]


def test_offset_of_digits_of_any_length(spark):
    values = ["0", "007", "9" * 18, "9" * 38, "9" * 60, "1" + "0" * 50, "123" + "9" * 45, "8" * 40, "0" * 50 + "5", "12a", "", None]
    df = spark.createDataFrame([(v, v) for v in values], "v string, o string")
    got = C.offset_if_digits(df, ["o"]).collect()
    assert len(got) == len(values)
    for r in got:
        want = str(int(r["v"]) + 10000) if r["v"] and r["v"].isdigit() else r["v"]
        assert r["o"] == want


def test_user_activated_later_is_cloned(spark):
    table, src, ckpt = (scratch_path(spark, n) for n in ("act-table", "act-in", "act-ckpt"))
    row = ("u1", "User One", 1, "AGENTS", "N", "10.0.0.1")
    S.create_accounts(spark.createDataFrame([("u0", "Zero", 1, "ADMIN", "N", "10.0.0.1")], S.USER_SCHEMA), table)
    for active in "NYY":
        spark.createDataFrame([(*row[:4], active, row[5])], S.USER_SCHEMA).write.mode("append").parquet(src)
        S.stream_sync(spark.readStream.schema(S.USER_SCHEMA).parquet(src), table, ckpt)
    got = [(r["user_name"], r["active"]) for r in S.KeyedTable.open(spark, table).read(spark).collect()]
    assert sorted(got) == [("u0", "N"), ("u1", "N"), ("u1_B", "Y")]


def test_log_scans_are_pruned_by_time(spark):
    fx = Fixture(spark, SF001)
    path = scratch_path(spark, "log")
    fx.call_log.write.parquet(path)
    log = spark.read.parquet(path)
    for snap in (checks.call_snapshot(log, "2024-01-31 00:00:00", "30 minutes"),
                 checks.call_snapshot(log, "2024-01-31 00:00:00", "30 minutes", "2024-01-31 00:00:00")):
        plan = snap._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThan(call_date" in plan.split("PushedFilters", 1)[1]


def test_null_keys_are_flagged_without_the_join(spark):
    from switchyard.operators import joins as J

    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    for other, want in (([(1,)], {1: False, 2: True, None: False}), ([(1,), (None,)], {1: False, 2: False, None: False}),
                        ([], {1: True, 2: True, None: True})):
        got = J.not_in_flag(df, spark.createDataFrame(other, "k int"), "k")
        assert {r["k"]: r["not_in"] for r in got.collect()} == want


def test_joins_start_no_job_when_planned(spark):
    fx = Fixture(spark, SF001)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    C.seed_hopper(fx.leads, fx.lists)
    assert len(tracker.getJobIdsForGroup("planning")) <= 4  # schema reads only
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
