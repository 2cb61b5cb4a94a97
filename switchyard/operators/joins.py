"""Joins.

Big sides are pre-aggregated before they meet a dimension, so the shuffle
carries one row per key instead of every fact row.  No side is hinted for
broadcast: adaptive execution decides on measured bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import filters
from .windows import ranked


def list_lead_counts(lists: DataFrame, leads: DataFrame, count_col: str = "total_leads") -> DataFrame:
    """LEFT OUTER lists x leads, COUNT(lead_id) per list; empty lists give 0."""
    per_list = leads.where(F.col("lead_id").isNotNull()).groupBy("list_id").agg(F.count(F.lit(1)).alias("_n"))
    return lists.join(per_list, "list_id", "left").select(
        "list_id", "list_name", F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias(count_col)
    )


def hopper_by_campaign(hopper: DataFrame, campaigns: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Hopper rows per active campaign with the campaign's dial settings.

    The default is the reference's INNER join (campaigns with an empty hopper
    vanish); ``keep_empty`` keeps them with a zero count.
    """
    counts = hopper.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("hopper_count"))
    active = campaigns.where(F.col("active") == "Y")
    attrs = [c for c in ("dial_status_a", "dial_status_b", "dial_status_c", "hopper_level", "auto_dial_level")
             if c in campaigns.columns]
    active = active.select("campaign_id", *attrs)
    if keep_empty:
        joined = active.join(counts, "campaign_id", "left").withColumn(
            "hopper_count", F.coalesce(F.col("hopper_count"), F.lit(0)).cast("long"))
    else:
        joined = counts.join(active, "campaign_id", "inner")
    return joined.select(
        "campaign_id", "hopper_count",
        *[F.col(c).cast("double").alias(c) if c == "auto_dial_level" else F.col(c) for c in attrs],
    )


def agent_math(agents: DataFrame, campaigns: DataFrame, as_of: str, lookback: str = "5 minutes") -> DataFrame:
    """Per active campaign: READY, INCALL and all recently updated agents."""
    recent = filters.recent(agents, "last_update_time", as_of, lookback)
    per = recent.groupBy("campaign_id").agg(
        F.count(F.when(F.col("status") == "READY", 1)).alias("ready_agents"),
        F.count(F.when(F.col("status") == "INCALL", 1)).alias("incall_agents"),
        F.count(F.lit(1)).alias("total_agents"),
    )
    active = campaigns.where(F.col("active") == "Y").select("campaign_id", "auto_dial_level")
    return per.join(active, "campaign_id", "inner").select(
        "campaign_id", "ready_agents", "incall_agents", "total_agents",
        F.col("auto_dial_level").cast("double").alias("auto_dial_level"),
    )


def hopper_leads(leads: DataFrame, hopper: DataFrame) -> DataFrame:
    """INNER leads x hopper on lead_id (the planner picks the strategy)."""
    h = hopper.select("lead_id", F.col("status").alias("hopper_status"), F.col("campaign_id").alias("hopper_campaign"))
    return leads.select("lead_id", "list_id", "phone_number", "called_count").join(h, "lead_id", "inner")


def not_in_flag(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None,
                out: str = "not_in") -> DataFrame:
    """``df`` with ``out`` = (key NOT IN (SELECT other_key FROM other)) IS TRUE.

    Same answer as the null-aware anti join SQL plans for NOT IN, without
    broadcasting ``other``: a shuffle join against the distinct non-null keys
    plus two scalars over ``other`` (row count, NULL-key count).  If ``other``
    is empty the predicate is TRUE for every row; if it holds a NULL key it is
    never TRUE; otherwise it is TRUE for non-null keys without a match.
    """
    ok = other_key or key
    # distinct keys (NULL included) are the only thing read from ``other``;
    # the scalars and the join both use this one aggregate
    keys = other.select(F.col(ok).alias("_k")).distinct()
    stats = keys.select(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_k").isNull()).alias("nulls"))).scalar()
    right = keys.where(F.col("_k").isNotNull()).withColumn("_m", F.lit(True))
    # rows with a NULL key need no partner, so they do not meet in one partition of the join
    j = df.where(F.col(key).isNotNull()).join(right, F.col(key) == F.col("_k"), "left")
    flag = F.when(stats["n"] == 0, F.lit(True)).when(stats["nulls"] > 0, F.lit(False)).otherwise(F.col("_m").isNull())
    flagged = j.select(*[F.col(c) for c in df.columns], flag.alias(out))
    unkeyed = df.where(F.col(key).isNull()).select("*", (stats["n"] == 0).alias(out))
    return flagged.unionByName(unkeyed)


def not_in_subquery(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose ``key`` is NOT IN (SELECT other_key FROM other), SQL semantics."""
    return not_in_flag(df, other, key, other_key, "_not_in").where("_not_in").drop("_not_in")


def _flag_from(df: DataFrame, left_key: Column, keys: DataFrame, flag: str) -> DataFrame:
    k = keys.select(F.col(keys.columns[0]).alias("_k")).distinct().withColumn(flag, F.lit(True))
    out = df.join(k, left_key == F.col("_k"), "left").drop("_k")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def missing_shadows(eligible: DataFrame, users: DataFrame, phones: DataFrame, slots: DataFrame,
                    servers: DataFrame, suffix: str = "_B") -> DataFrame:
    """Eligible agents lacking a shadow user, shadow phone or shadow slot (in
    the slot table their server uses)."""
    shadow = F.concat(F.col("user_name"), F.lit(suffix))
    base = eligible.select("user_name", "server_ip")
    base = _flag_from(base, shadow, users.select("user_name"), "has_user")
    base = _flag_from(base, shadow, phones.select("extension"), "has_phone")
    from .changes import slot_holders, with_slot_table

    holders = slot_holders(slots).select(F.col("server_ip").alias("_ip"), F.col("slot_table").alias("_t"),
                                         F.col("holder").alias("_h")).distinct().withColumn("has_slot", F.lit(True))
    base = with_slot_table(base, servers)
    base = base.join(holders, (F.col("server_ip") == F.col("_ip")) & (F.col("slot_table") == F.col("_t"))
                     & (shadow == F.col("_h")), "left")
    return base.select(
        "user_name", "server_ip", "slot_table",
        (~F.col("has_user")).alias("missing_user"),
        (~F.col("has_phone")).alias("missing_phone"),
        F.col("has_slot").isNull().alias("missing_slot"),
    )


def exists_in(df: DataFrame, other: DataFrame, key: str | Column, other_key: str) -> DataFrame:
    """Rows with at least one match in ``other`` (left semi join)."""
    k = X.col(key)
    right = other.select(F.col(other_key).alias("_k"))
    return df.join(right, k == F.col("_k"), "left_semi")


def id_collisions(pkg: DataFrame, dest: DataFrame, key: str = "list_id") -> DataFrame:
    """Each package id with a flag telling whether the destination has it."""
    d = dest.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return pkg.select(key).distinct().join(d, F.col(key) == F.col("_k"), "left").select(
        key, F.coalesce(F.col("_hit"), F.lit(False)).alias("collides"))


def remap_ids(df: DataFrame, id_map: DataFrame, c: str, old: str = "old_id", new: str = "new_id",
              keep_old_as: str | None = None) -> DataFrame:
    """Rewrite foreign key ``c`` through an old -> new map; unmapped ids stay."""
    # one new id per old id (the smallest if a map repeats a key), so a
    # repeated key cannot duplicate rows; adaptive execution decides on a broadcast by its bytes
    m = id_map.groupBy(F.col(old).alias("_old")).agg(F.min(new).alias("_new"))
    out = df.join(m, F.col(c) == F.col("_old"), "left")
    cols = [F.coalesce(F.col("_new"), F.col(c)).alias(c) if x == c else F.col(x) for x in df.columns]
    if keep_old_as:
        cols.append(F.col(c).alias(keep_old_as))
    return out.select(*cols)


def zip_assign(needs: DataFrame, free: DataFrame, part: str | Sequence[str], need_order: Sequence[str],
               free_order: Sequence[str]) -> DataFrame:
    """Pair the k-th need with the k-th free slot inside each ``part``.

    Both sides go through one skew-safe ``ranked`` (a few servers may each
    hold a large share of rows), numbered apart inside each ``part``; the rows
    of a (part, rank), two at most, then meet in an aggregate.  Needs without a
    slot, or with a NULL in ``part``, keep NULL slot columns.
    """
    keys = [part] if isinstance(part, str) else list(part)
    need_cols, slot_cols = ([c for c in df.columns if c not in keys] for df in (needs, free))
    need, slot = F.struct(*need_cols), F.struct(*slot_cols)
    none = F.lit(None)
    need_type, slot_type = needs.select(need).schema[0].dataType, free.select(slot).schema[0].dataType
    both = needs.select(*keys, F.lit(0).alias("_side"), need.alias("_need"), none.cast(slot_type).alias("_slot")).unionByName(
        free.select(*keys, F.lit(1).alias("_side"), none.cast(need_type).alias("_need"), slot.alias("_slot")))
    order = [*[F.col("_need")[c] for c in need_order], *[F.col("_slot")[c] for c in free_order]]
    numbered = ranked(both, [*keys, "_side"], order, out="rn")
    pairs = numbered.groupBy(*keys, "rn").agg(F.first("_need", ignorenulls=True).alias("_need"), F.first("_slot", ignorenulls=True).alias("_slot"))
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    return pairs.where("_need is not null").select(
        *keys, "rn", *[F.col("_need")[c].alias(c) for c in need_cols],
        *[F.when(keyed, F.col("_slot")[c]).alias(f"slot_{c}") for c in slot_cols])


def verify_import(lists: DataFrame, leads: DataFrame, hopper: DataFrame, ids: DataFrame) -> DataFrame:
    """Per imported list in one row: leads, cache, campaign, active, hopper rows
    and name (two pre-aggregates and left joins instead of a query per value)."""
    i = ids.select(F.col(ids.columns[0]).alias("list_id")).distinct()
    lc = leads.join(i, "list_id", "left_semi").groupBy("list_id").agg(F.count(F.lit(1)).alias("_leads"))
    hc = hopper.join(i, "list_id", "left_semi").groupBy("list_id").agg(F.count(F.lit(1)).alias("_hop"))
    j = i.join(lists, "list_id", "left").join(lc, "list_id", "left").join(hc, "list_id", "left")
    return j.select("list_id", "list_name", F.coalesce(F.col("_leads"), F.lit(0)).cast("long").alias("lead_count"),
                    F.col("cache_count_dialable_new").alias("cache_dialable"), "campaign_id", "active",
                    F.coalesce(F.col("_hop"), F.lit(0)).cast("long").alias("hopper_count"))
