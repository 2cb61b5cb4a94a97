"""Change-set operators: DML as dataflow.

Nothing is modified in place.  Each operator returns the resulting rows or a
plan with a ``change`` column that a caller can review, count (dry run) and
then write.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import filters, joins
from .setops import union_all
from .windows import topn_per_key

# Fixed values that must equal the reference: protected list ids.
PROTECTED_LISTS = (998, 999, 1001)


def delete_flag(key: str, protected: Iterable[int] = PROTECTED_LISTS) -> Column:
    """'delete' where ``key NOT IN protected`` is TRUE; NULL keys are kept."""
    return F.when(~F.col(key).isin(*protected), "delete").otherwise("keep")


def plan_delete(lists: DataFrame, leads: DataFrame, protected: Iterable[int] = PROTECTED_LISTS) -> DataFrame:
    """Lists and leads tagged delete / keep by the protected list ids."""
    protected = list(protected)
    a = lists.select(F.lit("lists").alias("table_name"), F.col("list_id").alias("row_id"), "list_id",
                     delete_flag("list_id", protected).alias("change"))
    b = leads.select(F.lit("leads").alias("table_name"), F.col("lead_id").alias("row_id"), "list_id",
                     delete_flag("list_id", protected).alias("change"))
    return union_all(a, b)


def cascade_orphans(log: DataFrame, retained_leads: DataFrame, key: str = "lead_id") -> DataFrame:
    """Log rows tagged by ``DELETE ... WHERE key NOT IN (SELECT key FROM retained)``:
    'delete' where the predicate is TRUE, 'keep' where it is FALSE or NULL."""
    flagged = joins.not_in_flag(log, retained_leads, key, out="_del")
    return flagged.select(*log.columns, F.when(F.col("_del"), "delete").otherwise("keep").alias("change"))


def insert_ignore(dest: DataFrame, incoming: DataFrame, pk: str | Sequence[str], order: str | None = None) -> DataFrame:
    """INSERT IGNORE merge: existing keys win; inside the package the first
    incoming row wins.

    ``order`` names a column that holds the package's file and line order
    (not part of the key; it need not be a column of ``dest``); without one
    the order in which Spark reads the package is taken.  Keys that exist are
    dropped first; the rest is deduplicated by ``min_by``, so a key repeated
    in a third of the package combines partially per task.
    """
    keys = [pk] if isinstance(pk, str) else list(pk)
    if order in keys:
        raise ValueError("the order of incoming rows cannot be their key")
    rows = incoming.withColumn("_seq", F.col(order) if order else F.monotonically_increasing_id())
    others = [c for c in dest.columns if c not in keys]
    fresh = rows.join(dest.select(*keys), keys, "left_anti")
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(F.col("_seq"))).alias("_r"))
    return dest.unionByName(first.select(*keys, *[F.col("_r")[c].alias(c) for c in others]).select(*dest.columns))


def override(df: DataFrame, c: str, value) -> DataFrame:
    """Set column ``c`` to ``value`` on every row."""
    return df.withColumn(c, F.lit(value).cast(dict(df.dtypes).get(c, "string")))


def reset(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Set several columns to constants (typed like the existing column)."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.lit(v).cast(types.get(c, "string")) if v is not None else F.lit(None).cast(types.get(c, "string"))
                           for c, v in values.items()})


LIST_CACHE_COLUMNS = {
    "cache_count": "bigint", "cache_count_new": "bigint", "cache_count_dialable_new": "bigint",
    "cache_date": "timestamp_ntz", "list_lastcalldate": "timestamp_ntz",
}


def with_cache_columns(lists: DataFrame) -> DataFrame:
    """Lists with the cache columns present (NULL where the source lacks them)."""
    missing = {c: F.lit(None).cast(t) for c, t in LIST_CACHE_COLUMNS.items() if c not in lists.columns}
    return lists.withColumns(missing) if missing else lists


def rebuild_cache(lists: DataFrame, leads: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """For lists in ``ids``: three cache counts = actual lead count (all
    leads, not only NEW), cache date = as_of, last call NULL, active 'Y'.
    Other lists pass through unchanged.
    """
    lists = with_cache_columns(lists)
    hit = ids.select(F.col(ids.columns[0]).alias("list_id")).distinct().withColumn("_hit", F.lit(True))
    counts = leads.join(hit, "list_id", "left_semi").groupBy("list_id").agg(F.count(F.lit(1)).alias("_n"))
    j = lists.join(hit, "list_id", "left").join(counts, "list_id", "left")
    on = F.coalesce(F.col("_hit"), F.lit(False))
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("long")
    upd = {
        "cache_count": n, "cache_count_new": n, "cache_count_dialable_new": n,
        "cache_date": X.ts_literal(as_of), "list_lastcalldate": F.lit(None).cast("timestamp_ntz"),
        "active": F.lit("Y"),
    }
    cols = [F.when(on, upd[c]).otherwise(F.col(c)).alias(c) if c in upd else F.col(c) for c in lists.columns]
    return j.select(*cols)


def seed_hopper(leads: DataFrame, lists: DataFrame, n: int = 1000, ids: DataFrame | None = None) -> DataFrame:
    """READY hopper rows: NEW leads not called since reset, of lists that have
    a campaign (not NULL, '' or '000'), at most ``n`` per list by lead_id."""
    camp = F.col("campaign_id")
    usable = lists.where(camp.isNotNull() & (camp != "") & (camp != "000")).select("list_id", "campaign_id")
    if ids is not None:
        usable = usable.join(ids.select(F.col(ids.columns[0]).alias("list_id")).distinct(), "list_id", "left_semi")
    cand = leads.where((F.col("status") == "NEW") & (F.col("called_since_last_reset") == "N")).select(
        "lead_id", "phone_number", "list_id")
    # adaptive execution broadcasts the list dimension if its bytes allow
    picked = topn_per_key(cand.join(usable, "list_id", "inner"), "list_id", ["lead_id"], n,
                          rn_col=None)
    return picked.select("lead_id", "phone_number", "list_id", "campaign_id",
                         F.lit("READY").alias("status"), F.lit(0).alias("priority"))


def clone_users(users: DataFrame, eligible: DataFrame, suffix: str = "_B", name_chars: int = 47,
                name_tag: str = " (B)") -> DataFrame:
    """Shadow user rows for eligible agents that have none: user = user + suffix,
    full_name = first 47 characters + ' (B)', every other column unchanged."""
    need = eligible.select("user_name").join(
        users.select(F.col("user_name").alias("_s")), F.concat(F.col("user_name"), F.lit(suffix)) == F.col("_s"),
        "left_anti")
    src = users.join(need, "user_name", "left_semi")
    return src.withColumns({
        "user_name": F.concat(F.col("user_name"), F.lit(suffix)),
        "full_name": F.concat(F.substring(F.col("full_name"), 1, name_chars), F.lit(name_tag)),
    })


# Fixed values that must equal the reference: the extension offset and the
# phone fields it applies to when they are all digits.
PHONE_OFFSET = 10000
PHONE_OFFSET_FIELDS = ("dialplan_number", "conf_on_extension", "park_on_extension",
                       "VICIDIAL_park_on_extension", "recording_exten", "voicemail_exten")


# all digits: those before the last 18 (leading zeros left out), and the last 18
DIGITS_RX = "^0*([0-9]*?)([0-9]{1,18})$"


def _offset_text(c: Column, head: Column, tail: Column, total: Column) -> Column:
    """``c`` plus the offset, from the digits before the last 18, the last 18, and their sum with the offset."""
    one = F.lit(10**18)
    last = r"^(.*?)([0-8]?)(9*)$"  # the digit that a carry raises, and the nines behind it
    raised = F.concat(F.regexp_extract(head, last, 1),
                      F.coalesce(F.nullif(F.regexp_extract(head, last, 2), F.lit("")).cast("int") + 1, F.lit(1)).cast("string"),
                      F.regexp_replace(F.regexp_extract(head, last, 3), "9", "0"))
    return (F.when(tail == "", c).when(head == "", total.cast("string"))
            .when(total >= one, F.concat(raised, F.lpad((total - one).cast("string"), 18, "0")))
            .otherwise(F.concat(head, F.lpad(total.cast("string"), 18, "0"))))


def offset_if_digits(df: DataFrame, cols: Iterable[str], offset: int = PHONE_OFFSET) -> DataFrame:
    """``df`` with each of ``cols`` raised by ``offset`` where it is all digits (decimal, of any length).

    The parts of a number are columns of a projection of their own, so the
    generated code evaluates them once.
    """
    cols = list(cols)
    parts = df.withColumns({f"_{name}_{c}": F.regexp_extract(c, DIGITS_RX, i) for c in cols for i, name in ((1, "head"), (2, "tail"))})
    sums = parts.withColumns({f"_sum_{c}": F.col(f"_tail_{c}").try_cast("bigint") + offset for c in cols})
    raised = sums.withColumns({c: _offset_text(F.col(c), F.col(f"_head_{c}"), F.col(f"_tail_{c}"), F.col(f"_sum_{c}")) for c in cols})
    return raised.select(*df.columns)


def clone_phones(phones: DataFrame, eligible: DataFrame, suffix: str = "_B", offset: int = PHONE_OFFSET,
                 name_chars: int = 47, name_tag: str = " (B)") -> DataFrame:
    """Shadow phone rows for eligible agents with an active phone and no shadow
    phone: extension = agent + suffix, numeric extension fields + offset."""
    shadow_exists = phones.select(F.col("extension").alias("_s"))
    need = eligible.select("user_name").join(
        shadow_exists, F.concat(F.col("user_name"), F.lit(suffix)) == F.col("_s"), "left_anti")
    has_active = phones.where(F.col("active") == "Y").select(F.col("extension").alias("user_name")).distinct()
    need = need.join(has_active, "user_name", "left_semi")
    src = phones.join(need, F.col("extension") == F.col("user_name"), "left_semi")
    src = offset_if_digits(src, [c for c in PHONE_OFFSET_FIELDS if c in phones.columns], offset)
    upd = {"extension": F.concat(F.col("extension"), F.lit(suffix))}
    if "fullname" in phones.columns:
        upd["fullname"] = F.concat(F.substring(F.col("fullname"), 1, name_chars), F.lit(name_tag))
    return src.withColumns(upd)


SLOT_KEY = ("server_ip", "slot_table", "conf_exten")


def slot_holders(slots: DataFrame) -> DataFrame:
    """(server_ip, slot_table, conf_exten, holder) for every name a slot's extension
    names: the extension itself and, for 'SIP/<name>', the bare name."""
    ext = F.col("extension")
    names = F.array_distinct(F.array_compact(F.array(
        ext, F.when(ext.startswith("SIP/"), F.substr(ext, F.lit(5))))))
    return slots.where(ext.isNotNull()).select(*SLOT_KEY, F.explode(names).alias("holder"))


def slot_table_for(servers: DataFrame) -> DataFrame:
    """Which slot table each server uses: conference bridges or meet-me rooms."""
    table = F.when(F.col("conf_engine") == "CONFBRIDGE", "confbridges").otherwise("conferences")
    return servers.groupBy("server_ip").agg(F.min(table).alias("slot_table"))


def with_slot_table(agents: DataFrame, servers: DataFrame) -> DataFrame:
    """Agents with the slot table of their server (meet-me rooms if the server is unknown)."""
    out = agents.join(slot_table_for(servers), "server_ip", "left")
    return out.withColumn("slot_table", F.coalesce("slot_table", F.lit("conferences")))


def free_slots(slots: DataFrame) -> DataFrame:
    """Slots without an extension (NULL or '')."""
    return slots.where(F.col("extension").isNull() | (F.col("extension") == "")).select(*SLOT_KEY)


def assign_slots(needs: DataFrame, slots: DataFrame, servers: DataFrame, suffix: str = "_B") -> DataFrame:
    """Slot change set for shadow agents.

    ``needs``: (user_name, server_ip) of eligible agents; ``slots`` holds both
    slot tables, told apart by ``slot_table``.  Only the table that the
    server's conference engine uses counts: agents already holding
    'SIP/<user>_B' or '<user>_B' in it are 'already'; the others are paired in
    name order with its free slots (extension NULL or '') in conf_exten order:
    'assigned', or 'none' when they run out.  Returns one row per agent with
    the slot it gets.
    """
    shadow = F.concat(F.col("user_name"), F.lit(suffix))
    held = slot_holders(slots).select(F.col("server_ip").alias("_ip"), F.col("slot_table").alias("_table"),
                                      F.col("holder").alias("_holder"), F.col("conf_exten").alias("_held"))
    n = with_slot_table(needs.select("user_name", "server_ip"), servers)
    # one equi-join on (server, table, holder name); no OR inside the join condition
    have = n.join(held, (F.col("server_ip") == F.col("_ip")) & (F.col("slot_table") == F.col("_table"))
                  & (shadow == F.col("_holder")), "inner") \
        .groupBy("user_name", "server_ip", "slot_table").agg(F.min("_held").alias("held_conf"))
    todo = n.join(have.select("user_name", "server_ip"), ["user_name", "server_ip"], "left_anti")
    paired = joins.zip_assign(todo, free_slots(slots), ["server_ip", "slot_table"], ["user_name"], ["conf_exten"])
    assigned = paired.select(
        "user_name", "server_ip", "slot_table", F.col("slot_conf_exten").alias("conf_exten"),
        F.when(F.col("slot_conf_exten").isNotNull(), "assigned").otherwise("none").alias("result"))
    already = have.select("user_name", "server_ip", "slot_table", F.col("held_conf").alias("conf_exten"),
                          F.lit("already").alias("result"))
    return union_all(assigned, already).select(
                      "user_name", "server_ip", "conf_exten", "result", "slot_table",
                      F.when(F.col("result") == "assigned", F.concat(F.lit("SIP/"), shadow)).alias("new_extension"))


def apply_slot_assignments(slots: DataFrame, plan: DataFrame) -> DataFrame:
    """Slots after the assignment plan: assigned slots get 'SIP/<user>_B'."""
    a = plan.where(F.col("result") == "assigned").select(
        *[F.col(c).alias(f"_{c}") for c in SLOT_KEY], "new_extension")
    j = slots.join(a, [F.col(c) == F.col(f"_{c}") for c in SLOT_KEY], "left")
    return j.select(*[F.coalesce(F.col("new_extension"), F.col(c)).alias(c) if c == "extension" else F.col(c)
                      for c in slots.columns],
                    F.when(F.col("new_extension").isNotNull(), "update").otherwise("keep").alias("change"))


def revert_shadows(users: DataFrame, phones: DataFrame, slots: DataFrame, suffix: str = "_B",
                   wildcard: bool = False) -> DataFrame:
    """Counts of what a revert removes or blanks: shadow users, shadow
    phones, and slots whose extension is 'SIP/' + a shadow name."""
    u = users.agg(F.count_if(filters.is_shadow(F.col("user_name"), suffix, wildcard)).alias("row_count"))
    p = phones.agg(F.count_if(filters.is_shadow(F.col("extension"), suffix, wildcard)).alias("row_count"))
    ext = F.col("extension")
    slot_pred = ext.like("SIP/%" + suffix) if wildcard else (ext.startswith("SIP/") & ext.endswith(suffix))
    s = slots.agg(F.count_if(slot_pred).alias("row_count"))
    return union_all(
        u.select(F.lit("users").alias("table_name"), F.lit("delete").alias("change"), "row_count"),
        p.select(F.lit("phones").alias("table_name"), F.lit("delete").alias("change"), "row_count"),
        s.select(F.lit("conf_slots").alias("table_name"), F.lit("blank").alias("change"), "row_count"),
    )


def revert_rows(users: DataFrame, phones: DataFrame, slots: DataFrame, suffix: str = "_B",
                wildcard: bool = False) -> DataFrame:
    """The rows a revert changes: shadow users and shadow phones to delete, and
    slots of 'SIP/' + a shadow name whose extension becomes ''."""
    ext = F.col("extension")
    held = ext.like("SIP/%" + suffix) if wildcard else (ext.startswith("SIP/") & ext.endswith(suffix))
    return union_all(
        filters.shadow_rows(users, "user_name", suffix, wildcard).select(
            F.lit("users").alias("table_name"), F.lit("delete").alias("change"), F.col("user_name").alias("row_key")),
        filters.shadow_rows(phones, "extension", suffix, wildcard).select(
            F.lit("phones").alias("table_name"), F.lit("delete").alias("change"), ext.alias("row_key")),
        slots.where(held).select(
            F.lit("conf_slots").alias("table_name"), F.lit("blank").alias("change"),
            F.concat_ws("/", *SLOT_KEY).alias("row_key")))


def rollback_plan(leads: DataFrame, alt: DataFrame, lists: DataFrame, hopper: DataFrame, mark: Column,
                  mapped_ids: DataFrame) -> DataFrame:
    """Rows an import rollback deletes: leads and alt phones above the mark,
    lists and hopper rows of the imported (mapped) list ids."""
    ids = mapped_ids.select(F.col(mapped_ids.columns[0]).alias("list_id")).distinct()
    return union_all(
        leads.where(F.col("lead_id") > mark).select(F.lit("leads").alias("table_name"), F.col("lead_id").alias("row_id")),
        alt.where(F.col("lead_id") > mark).select(F.lit("alt_phones").alias("table_name"), F.col("lead_id").alias("row_id")),
        lists.join(ids, "list_id", "left_semi").select(F.lit("lists").alias("table_name"), F.col("list_id").alias("row_id")),
        hopper.join(ids, "list_id", "left_semi").select(F.lit("hopper").alias("table_name"), F.col("lead_id").alias("row_id")),
    )


def imported_count(leads: DataFrame, mark: Column) -> DataFrame:
    """Rows above the pre-import mark."""
    return leads.agg(F.count_if(F.col("lead_id") > mark).alias("imported"))


def dry_run(changes: DataFrame, table_col: str = "table_name", change_col: str = "change") -> DataFrame:
    """Describe a change set without writing: rows per (table, change)."""
    return changes.groupBy(table_col, change_col).agg(F.count(F.lit(1)).alias("row_count"))
