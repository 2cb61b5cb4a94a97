"""Properties of the change sets and windows."""

import pytest

from pyspark.sql import functions as F

from paths import SF001
from switchyard.operators import changes as C
from switchyard.operators import filters as Fl
from switchyard.operators import windows as W
from switchyard.plans.fixtures import Fixture


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_ignore_idempotent(spark):
    fx = Fixture(spark, SF001)
    once = C.insert_ignore(fx.destination_lists, fx.package_lists, "list_id")
    twice = C.insert_ignore(once, fx.package_lists, "list_id")
    assert as_set(once) == as_set(twice)
    assert once.select("list_id").distinct().count() == once.count()


def test_insert_ignore_first_incoming_wins(spark):
    dest = spark.createDataFrame([(1, "old")], "k long, v string")
    inc = spark.createDataFrame([(1, "new", 0), (2, "b", 5), (2, "a", 3), (5, "zzz first", 6), (5, "aaa second", 7)], "k long, v string, o int")
    out = C.insert_ignore(dest, inc, "k", "o")
    assert as_set(out) == [(1, "old"), (2, "a"), (5, "zzz first")]
    read_order = C.insert_ignore(dest, inc.drop("o").coalesce(1), "k")
    assert as_set(read_order) == [(1, "old"), (2, "b"), (5, "zzz first")]
    with pytest.raises(ValueError):
        C.insert_ignore(dest, inc, "k", "k")


def test_delete_plan_partitions_input(spark):
    fx = Fixture(spark, SF001)
    plan = C.plan_delete(fx.lists, fx.leads)
    counts = {(r.table_name, r.change): r.row_count for r in C.dry_run(plan).collect()}
    assert counts[("lists", "delete")] + counts[("lists", "keep")] == fx.lists.count()
    assert counts[("leads", "delete")] + counts[("leads", "keep")] == fx.leads.count()


def test_assign_slots_one_to_one_on_fixture(spark):
    fx = Fixture(spark, SF001)
    plan = C.assign_slots(Fl.eligible_agents(fx.users).select("user_name", "server_ip"), fx.conf_slots, fx.servers)
    got = plan.where("result = 'assigned'")
    assert got.count() == got.select("server_ip", "slot_table", "conf_exten").distinct().count()
    free = fx.conf_slots.where(F.col("extension").isNull() | (F.col("extension") == ""))
    assert got.join(free, ["server_ip", "slot_table", "conf_exten"], "left_anti").count() == 0


def test_shares_sum_to_hundred(spark):
    fx = Fixture(spark, SF001)
    rows = W.share_of_total(fx.call_log, "status", None).collect()
    assert abs(sum(r.pct for r in rows) - 100) <= 0.05 * len(rows) + 1e-9


def test_rollback_restores_keys(spark):
    fx = Fixture(spark, SF001)
    dest = fx.leads.where("lead_id <= 20000")
    pkg = fx.leads.where("lead_id > 20000")
    mark = dest.select(F.coalesce(F.max("lead_id"), F.lit(0))).scalar()
    merged = C.insert_ignore(dest, pkg, "lead_id")
    plan = C.rollback_plan(merged, fx.alt_phones, fx.lists.limit(0), fx.hopper.limit(0), mark,
                           fx.lists.limit(0).select("list_id"))
    removed = plan.where("table_name = 'leads'").select(F.col("row_id").alias("lead_id"))
    restored = merged.join(removed, "lead_id", "left_anti")
    assert as_set(restored.select("lead_id")) == as_set(dest.select("lead_id"))


def test_topn_above_group_limit_threshold(spark):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
    try:
        df = spark.range(200).select((F.col("id") % 3).alias("g"), "id")
        out = W.topn_per_key(df, "g", ["id"], 10)
        assert out.count() == 30
        assert sorted(r.id for r in out.where("g = 0").collect()) == list(range(0, 30, 3))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_dump_parse_roundtrip_property(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    from switchyard.sources import sql_dump as SD

    alphabet = st.sampled_from(list("ab ,()'\\\"\n\r\t\x00é;") + ["),(", "''", "\\'", "NULL"])
    text = st.lists(alphabet, max_size=12).map("".join)
    rows_st = st.lists(st.tuples(st.one_of(st.none(), text), st.integers(-10**12, 10**12)), min_size=1, max_size=25)

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(rows_st)
    def roundtrip(rows):
        data = [(i, s, n) for i, (s, n) in enumerate(rows)]
        df = spark.createDataFrame(data, "id long, s string, n long")
        back = SD.parse_dump_lines(SD.dump_lines(df, "t", 7, "id"), "id long, s string, n long")
        assert sorted(tuple(r) for r in back.collect()) == sorted(data)

    roundtrip()
