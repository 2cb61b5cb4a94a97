"""Catalogue: change-set operators with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import filters as Fl
from . import fixtures as P
from . import migration as M
from .catalog_relational import CLONE_USERS_SQL, NEW_ID_MAP_SQL
from .registry import register
from .sqlbits import ELIGIBLE_SQL, ELIGIBLE_TABLE_SQL, sql_ts

_PROT = ", ".join(str(i) for i in C.PROTECTED_LISTS)

DELETE_PLAN_SQL = f"""(select 'lists' as table_name, list_id as row_id, list_id,
  case when list_id not in ({_PROT}) then 'delete' else 'keep' end as change from lists
union all
select 'leads' as table_name, lead_id as row_id, list_id,
  case when list_id not in ({_PROT}) then 'delete' else 'keep' end as change from leads)"""


@register("delete_unprotected", section="2.8", oracle=f"select * from {DELETE_PLAN_SQL} d")
def delete_unprotected(fx):
    return C.plan_delete(fx.lists, fx.leads)


@register("cascade_orphans", section="2.8", oracle=f"""
with kept as (select lead_id from leads where not coalesce(list_id not in ({_PROT}), false))
select amd_id, lead_id, amd_status,
  case when lead_id not in (select lead_id from kept) then 'delete' else 'keep' end as change
from amd_log""")
def cascade_orphans(fx):
    kept = fx.leads.where(~F.coalesce(~F.col("list_id").isin(*C.PROTECTED_LISTS), F.lit(False)))
    return C.cascade_orphans(fx.amd_log, kept.select("lead_id"))


@register("insert_ignore", section="2.8", oracle=f"""
select * from {P.DESTINATION_LISTS_SQL} d
union all
select list_id, case when list_id % 9 = 0 then 'again ' || list_name else list_name end, campaign_id, active
from {P.PACKAGE_LISTS_SQL} p
where not exists (select 1 from {P.DESTINATION_LISTS_SQL} d2 where d2.list_id = p.list_id)""")
def insert_ignore(fx):
    # every key twice; the second copy stands first in the package where the key is divisible by 9
    once = fx.package_lists.withColumn("line", F.lit(2))
    again = once.withColumn("list_name", F.concat(F.lit("again "), "list_name")).withColumn(
        "line", F.when(F.col("list_id") % 9 == 0, 1).otherwise(3))
    return C.insert_ignore(fx.destination_lists, once.unionByName(again), "list_id", "line")


@register("override_column", section="2.8", oracle=f"""
select list_id, list_name, '{P.TARGET_CAMPAIGN}' as campaign_id, active from lists""")
def override_column(fx):
    return C.override(fx.lists, "campaign_id", P.TARGET_CAMPAIGN)


@register("reset_columns", section="2.8", oracle=f"""
select lead_id, list_id, phone_number, first_name, last_name, status, entry_date, last_local_call_time,
  called_count, 'N' as called_since_last_reset from leads""")
def reset_columns(fx):
    return C.reset(fx.leads, {"called_since_last_reset": "N"})


@register("rebuild_list_cache", section="2.8", oracle=f"""
with n as (select list_id, count(*) as n from leads group by list_id),
     ids as (select distinct list_id from {P.PACKAGE_LISTS_SQL} p)
select l.list_id, l.list_name, l.campaign_id,
  case when i.list_id is not null then 'Y' else l.active end as active,
  case when i.list_id is not null then coalesce(n.n, 0) end as cache_count,
  case when i.list_id is not null then coalesce(n.n, 0) end as cache_count_new,
  case when i.list_id is not null then coalesce(n.n, 0) end as cache_count_dialable_new,
  case when i.list_id is not null then {sql_ts(P.AS_OF)} end as cache_date,
  cast(null as timestamp) as list_lastcalldate
from lists l left join ids i on l.list_id = i.list_id left join n on l.list_id = n.list_id""")
def rebuild_list_cache(fx):
    return C.rebuild_cache(fx.lists, fx.leads, fx.package_lists.select("list_id"), P.AS_OF)


@register("seed_hopper", section="2.8", oracle=f"""
select lead_id, phone_number, list_id, campaign_id, 'READY' as status, 0 as priority from (
  select l.lead_id, l.phone_number, l.list_id, s.campaign_id,
    row_number() over (partition by l.list_id order by l.lead_id) as rn
  from leads l join lists s on l.list_id = s.list_id
  where l.status = 'NEW' and l.called_since_last_reset = 'N'
    and s.campaign_id is not null and s.campaign_id <> '' and s.campaign_id <> '000') x
where rn <= {P.ROWS_PER_LIST}""")
def seed_hopper(fx):
    return C.seed_hopper(fx.leads, fx.lists, P.ROWS_PER_LIST)


@register("clone_users", section="2.8", oracle=f"select * from {CLONE_USERS_SQL} c")
def clone_users(fx):
    return C.clone_users(fx.users, Fl.eligible_agents(fx.users))


def _offset_sql(c: str) -> str:
    return (f"case when regexp_matches({c}, '^[0-9]+$') then cast(cast({c} as decimal(38,0)) + {C.PHONE_OFFSET} as varchar)"
            f" else {c} end")


CLONE_PHONES_SQL = f"""(with need as (select e.user_name from {ELIGIBLE_SQL} e
  where not exists (select 1 from phones p where p.extension = e.user_name || '_B')
    and exists (select 1 from phones p where p.extension = e.user_name and p.active = 'Y'))
select p.extension || '_B' as extension, {_offset_sql('p.dialplan_number')} as dialplan_number,
  {_offset_sql('p.conf_on_extension')} as conf_on_extension, {_offset_sql('p.park_on_extension')} as park_on_extension,
  {_offset_sql('p.VICIDIAL_park_on_extension')} as "VICIDIAL_park_on_extension", {_offset_sql('p.recording_exten')} as recording_exten,
  {_offset_sql('p.voicemail_exten')} as voicemail_exten,
  p.active, substring(p.fullname, 1, 47) || ' (B)' as fullname
from phones p where p.extension in (select user_name from need))"""


@register("clone_phones", section="2.8", oracle=f"select * from {CLONE_PHONES_SQL} c")
def clone_phones(fx):
    return C.clone_phones(fx.phones, Fl.eligible_agents(fx.users))


ASSIGN_SLOTS_SQL = f"""(with e as {ELIGIBLE_TABLE_SQL},
  held as (select e.user_name, e.server_ip, e.slot_table, min(s.conf_exten) as held_conf from e join conf_slots s
           on s.server_ip = e.server_ip and s.slot_table = e.slot_table and (s.extension = 'SIP/' || e.user_name || '_B' or s.extension = e.user_name || '_B')
           group by e.user_name, e.server_ip, e.slot_table),
  todo as (select e.user_name, e.server_ip, e.slot_table from e where not exists
           (select 1 from held h where h.user_name = e.user_name and h.server_ip = e.server_ip)),
  n as (select *, row_number() over (partition by server_ip, slot_table order by user_name) as rn from todo),
  f as (select *, row_number() over (partition by server_ip, slot_table order by conf_exten) as rn
        from conf_slots where extension is null or extension = ''),
  a as (select n.user_name, n.server_ip, n.slot_table, f.conf_exten,
          case when f.conf_exten is not null then 'assigned' else 'none' end as result
        from n left join f on n.server_ip = f.server_ip and n.slot_table = f.slot_table and n.rn = f.rn
        union all select user_name, server_ip, slot_table, held_conf, 'already' from held)
select a.user_name, a.server_ip, a.conf_exten, a.result, a.slot_table,
  case when a.result = 'assigned' then 'SIP/' || a.user_name || '_B' end as new_extension
from a)"""


@register("assign_slots", section="2.8", oracle=f"select * from {ASSIGN_SLOTS_SQL} x")
def assign_slots(fx):
    return C.assign_slots(Fl.eligible_agents(fx.users).select("user_name", "server_ip"), fx.conf_slots, fx.servers)


@register("revert_shadows", section="2.8", oracle="""
select 'users' as table_name, 'delete' as change, count(*) filter (where suffix(user_name, '_B')) as row_count from users
union all
select 'phones', 'delete', count(*) filter (where suffix(extension, '_B')) from phones
union all
select 'conf_slots', 'blank', count(*) filter (where starts_with(extension, 'SIP/') and suffix(extension, '_B')) from conf_slots""")
def revert_shadows(fx):
    return C.revert_shadows(fx.users, fx.phones, fx.conf_slots)


@register("revert_rows", section="2.8", oracle="""
select 'users' as table_name, 'delete' as change, user_name as row_key from users where suffix(user_name, '_B')
union all select 'phones', 'delete', extension from phones where suffix(extension, '_B')
union all select 'conf_slots', 'blank', server_ip || '/' || slot_table || '/' || cast(conf_exten as varchar) from conf_slots
where starts_with(extension, 'SIP/') and suffix(extension, '_B')""")
def revert_rows(fx):
    return C.revert_rows(fx.users, fx.phones, fx.conf_slots)


MARK_SQL = "(select coalesce(max(lead_id), 0) from leads where lead_id <= (select max(lead_id) // 2 from leads))"


def import_mark(fx):
    """High-water mark of the pre-import destination (its lower half of ids)."""
    leads = fx.leads
    half = leads.select((F.max("lead_id") - F.max("lead_id") % 2) / 2).scalar()
    return leads.where(F.col("lead_id") <= half).select(F.coalesce(F.max("lead_id"), F.lit(0))).scalar()


@register("rollback_plan", section="2.8", oracle=f"""
with ids as (select distinct list_id from {P.PACKAGE_LISTS_SQL} p)
select 'leads' as table_name, lead_id as row_id from leads where lead_id > {MARK_SQL}
union all select 'alt_phones', lead_id from alt_phones where lead_id > {MARK_SQL}
union all select 'lists', list_id from lists where list_id in (select list_id from ids)
union all select 'hopper', lead_id from hopper where list_id in (select list_id from ids)""")
def rollback_plan(fx):
    return C.rollback_plan(fx.leads, fx.alt_phones, fx.lists, fx.hopper, import_mark(fx),
                           fx.package_lists.select("list_id"))


@register("imported_count", section="2.8", oracle=f"""
select count(*) filter (where lead_id > {MARK_SQL}) as imported from leads""")
def imported_count(fx):
    return C.imported_count(fx.leads, import_mark(fx))


# the whole import: remapped lists, INSERT IGNORE merges, cache rebuild and hopper seed
IMPORT_SQL = f"""m as {NEW_ID_MAP_SQL},
pl as (select coalesce(m.new_id, l.list_id) as list_id, l.list_name from {P.PACKAGE_LISTS_SQL} l left join m on l.list_id = m.old_id),
fresh as (select p.lead_id, coalesce(m.new_id, p.list_id) as list_id, p.status
          from {P.PACKAGE_LEADS_SQL} p left join m on p.list_id = m.old_id
          where not exists (select 1 from {P.DESTINATION_LEADS_SQL} d where d.lead_id = p.lead_id)),
merged as (select lead_id, list_id, status, called_since_last_reset from {P.DESTINATION_LEADS_SQL} d
           union all select lead_id, list_id, status, 'N' from fresh),
per as (select pl.list_id, pl.list_name, count(g.lead_id) as n,
          least(count(*) filter (where g.status = 'NEW' and g.called_since_last_reset = 'N'), {P.ROWS_PER_LIST}) as seeded
        from pl left join merged g on g.list_id = pl.list_id group by pl.list_id, pl.list_name),
pa as (select a.* from alt_phones a where a.lead_id in (select lead_id from {P.PACKAGE_LEADS_SQL} p)),
new_alt as (select distinct lead_id, alt_phone_count from pa
            where lead_id not in (select lead_id from {P.DESTINATION_LEADS_SQL} d))"""


def _import_plan(fx):
    alt = fx.alt_phones
    return M.plan_import(
        fx.destination_lists, fx.destination_leads, fx.hopper.where("list_id % 2 = 0"), fx.package_lists, fx.package_leads,
        P.AS_OF, target_campaign=P.TARGET_CAMPAIGN, seed=True, seed_rows=P.ROWS_PER_LIST,
        dest_alt=alt.join(fx.destination_leads, "lead_id", "left_semi"), pkg_alt=alt.join(fx.package_leads, "lead_id", "left_semi"))


@register("import_summary", section="2.8", oracle=f"""
with {IMPORT_SQL}
select 'lists' as table_name, 'insert' as change, count(*) as row_count from pl
union all select 'lists', 'ignored', 0
union all select 'leads', 'insert', count(*) from fresh
union all select 'leads', 'ignored', (select count(*) from {P.PACKAGE_LEADS_SQL} p) - count(*) from fresh
union all select 'alt_phones', 'insert', count(*) from new_alt
union all select 'alt_phones', 'ignored', (select count(*) from pa) - count(*) from new_alt
union all select 'hopper', 'insert', cast(sum(seeded) as bigint) from per having sum(seeded) > 0""")
def import_summary(fx):
    return _import_plan(fx).summary


@register("import_verify", section="2.8", oracle=f"""
with {IMPORT_SQL},
hc as (select list_id, count(*) as n from hopper where list_id % 2 = 0 group by list_id)
select per.list_id, per.list_name, per.n as lead_count, per.n as cache_dialable, '{P.TARGET_CAMPAIGN}' as campaign_id, 'Y' as active,
  per.seeded + coalesce(hc.n, 0) as hopper_count
from per left join hc on per.list_id = hc.list_id""")
def import_verify(fx):
    return _import_plan(fx).verify


@register("dry_run_plan", section="2.8", oracle=f"""
select table_name, change, count(*) as row_count from {DELETE_PLAN_SQL} d group by table_name, change""")
def dry_run_plan(fx):
    return C.dry_run(C.plan_delete(fx.lists, fx.leads))

