"""Shadow-account sync: one plan for all agents.

Three anti-joins, two cloning projections and one rank-zip join replace the
reference's per-agent loop of single-row queries.  Returns change sets; the
streaming form is ``streaming.streams.stream_sync``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import filters as Fl
from ..operators.setops import union_all


@dataclass
class SyncPlan:
    new_users: DataFrame     # shadow user rows to insert
    new_phones: DataFrame    # shadow phone rows to insert
    slots: DataFrame         # per agent: assigned / already / none, with the slot
    slots_after: DataFrame   # slot table with assignments applied and a change column
    report: DataFrame        # counts: users and phones created, slots assigned / already / none


def plan_sync(users: DataFrame, phones: DataFrame, slots: DataFrame, servers: DataFrame, suffix: str = "_B",
              offset: int = C.PHONE_OFFSET) -> SyncPlan:
    elig = Fl.eligible_agents(users, suffix)
    new_users = C.clone_users(users, elig, suffix)
    new_phones = C.clone_phones(phones, elig, suffix, offset)
    plan = C.assign_slots(elig.select("user_name", "server_ip"), slots, servers, suffix)
    after = C.apply_slot_assignments(slots, plan)
    report = union_all(
        new_users.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("users_created").alias("item"), "row_count"),
        new_phones.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("phones_created").alias("item"), "row_count"),
        plan.groupBy(F.concat(F.lit("slots_"), F.col("result")).alias("item")).agg(F.count(F.lit(1)).alias("row_count")),
    )
    return SyncPlan(new_users, new_phones, plan, after, report)
