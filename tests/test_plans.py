"""User-level compositions: diagnosis run, package import, shadow sync."""

from pyspark.sql import functions as F

from paths import SF001
from switchyard.plans import diagnosis, fixtures as P, migration, shadow_sync
from switchyard.plans.catalog import QUERIES
from switchyard.plans.fixtures import Fixture


def test_diagnosis_run_matches_catalogue_verdict(spark):
    fx = Fixture(spark, SF001)
    peers = fx.peers.select(F.col("peer").alias("line_no"), F.concat_ws(" ", "peer", "status").alias("line"))
    t = {v: fx.view(v) for v in ("live_agents", "channel_lines", "hopper", "campaigns", "call_log", "process_rows",
                                 "log_lines", "conf_slots", "leads")}
    t["registry_lines"], t["peer_lines"] = fx.log_lines, peers
    p = diagnosis.DiagnosisParams(
        as_of=P.AS_OF, agent_active_lookback=P.AGENT_ACTIVE_LOOKBACK, call_rate_lookback=P.CALL_RATE_LOOKBACK,
        log_lookback=P.LOG_LOOKBACK, slot_as_of=P.FILE_AS_OF, midnight_as_of=P.MIDNIGHT_AS_OF,
        hopper_nearly_empty=P.HOPPER_NEARLY_EMPTY, hopper_low=P.HOPPER_LOW, amd_high_pct=P.AMD_HIGH_PCT,
        amd_elevated_pct=P.AMD_ELEVATED_PCT)
    f, v = diagnosis.run(t, p)
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, QUERIES["union_findings"](spark, SF001).collect()))
    assert v.first().asDict() == QUERIES["agg_verdict"](spark, SF001).first().asDict()


def test_import_plan_round_trip(spark):
    fx = Fixture(spark, SF001)
    cut = fx.leads.agg(F.max("lead_id")).first()[0] // 2
    dest_leads = fx.leads.where(F.col("lead_id") <= cut)
    pkg_leads = fx.leads.where(F.col("lead_id") > cut)
    dest_lists = fx.lists.where("list_id % 2 = 0")
    pkg_lists = fx.lists.where("list_id % 3 = 0")
    plan = migration.plan_import(dest_lists, dest_leads, fx.hopper, pkg_lists, pkg_leads, P.AS_OF,
                                 target_campaign="7", seed=True, seed_rows=P.ROWS_PER_LIST)
    n_coll = pkg_lists.join(dest_lists, "list_id", "left_semi").count()
    assert plan.id_map.count() == n_coll
    assert plan.verify.count() == pkg_lists.count()
    # every imported list: active, target campaign, cache = its lead count
    rows = plan.verify.collect()
    assert all(r.active == "Y" and r.campaign_id == "7" and r.cache_dialable == r.lead_count for r in rows)
    # rollback removes exactly the imported leads (all package ids exceed the mark)
    removed = plan.rollback.where("table_name = 'leads'").select(F.col("row_id").alias("lead_id"))
    assert plan.leads.join(removed, "lead_id", "left_anti").count() == dest_leads.count()
    summary = {(r.table_name, r.change): r.row_count for r in plan.summary.collect()}
    assert summary[("leads", "insert")] == pkg_leads.count()
    assert summary[("hopper", "insert")] == plan.hopper_seed.count()
    # imported lead list ids all point at imported (possibly remapped) lists
    imported = plan.leads.where(F.col("lead_id") > cut).select("list_id").distinct()
    lost = imported.join(plan.lists, "list_id", "left_anti")
    assert lost.join(pkg_lists, "list_id", "left_semi").count() == 0


def test_shadow_sync_report_matches_operators(spark):
    fx = Fixture(spark, SF001)
    plan = shadow_sync.plan_sync(fx.users, fx.phones, fx.conf_slots, fx.servers)
    report = {r.item: r.row_count for r in plan.report.collect()}
    assert report["users_created"] == QUERIES["clone_users"](spark, SF001).count()
    assert report["phones_created"] == QUERIES["clone_phones"](spark, SF001).count()
    slots = QUERIES["assign_slots"](spark, SF001)
    assert report.get("slots_assigned", 0) == slots.where("result = 'assigned'").count()
    assert plan.slots_after.where("change = 'update'").count() == report.get("slots_assigned", 0)


def test_diagnosis_with_partial_inputs(spark):
    hopper = spark.createDataFrame([(1, 1, "3", "DNC", 0), (2, 1, "3", "INCALL", 0)],
                                   "lead_id long, list_id long, campaign_id string, status string, priority int")
    f, v = diagnosis.run({"hopper": hopper}, diagnosis.DiagnosisParams(as_of=P.AS_OF))
    assert sorted(r.check for r in f.collect()) == ["dnc_in_hopper", "stuck_incall"]
    r = v.first()
    assert (r.server_issues, r.client_issues, r.verdict) == (1, 1, "MIXED")


def test_export_package_and_manifest(spark):
    from switchyard.session import scratch_path
    from switchyard.sources import tables as TB

    fx = Fixture(spark, SF001)
    out = scratch_path(spark, "export")
    manifest = migration.export({"lists": fx.lists, "leads": fx.leads, "alt_phones": fx.alt_phones}, out)
    rows = manifest.collect()
    assert len(rows) == fx.lists.count()
    matched = fx.leads.join(fx.lists.select("list_id"), "list_id", "left_semi").count()
    assert sum(r.lead_count for r in rows) == matched
    assert {r.total_leads for r in rows} == {fx.leads.count()}
    back = TB.read_table(spark, "leads", "parquet", out)
    assert back.count() == fx.leads.count()
