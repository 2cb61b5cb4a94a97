"""Lead package export and key-safe import as change sets.

``plan_import`` takes the destination tables and a package (read with
``sources.sql_dump.read_sql_dump`` or from Parquet) and returns every change
as a DataFrame: the id map, the merged lists and leads, the rebuilt list
caches, the hopper seed, the rollback plan, the per-list verification and a
dry-run summary.  Nothing is written; a dry run and a real run compute the
same plan (SURVEY Q4).  Per-list loops of the reference are grouped plans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import joins as J
from ..operators import windows as W
from ..operators.setops import union_all
from ..sinks import export as EX


@dataclass
class ImportPlan:
    id_map: DataFrame          # old_id -> new_id for colliding list ids
    lists: DataFrame           # destination lists after the merge and cache rebuild
    leads: DataFrame           # destination leads after the merge
    alt_phones: DataFrame | None  # destination alternate phones after the merge (None without any)
    hopper_seed: DataFrame     # READY rows to add (empty unless seeding)
    rollback: DataFrame        # (table_name, row_id) to delete to undo the import
    verify: DataFrame          # one row per imported list
    summary: DataFrame         # dry run: rows per (table_name, change)
    mark: int                  # lead-id high-water mark before the import


def export(tables: Mapping[str, DataFrame], out: str, where: Mapping[str, str] | None = None) -> DataFrame:
    """Write a package (one folder per table) and return its per-list manifest."""
    EX.export_package(tables, out, where)
    return EX.package_manifest(tables["lists"], tables["leads"], tables.get("alt_phones"))


def plan_import(dest_lists: DataFrame, dest_leads: DataFrame, dest_hopper: DataFrame, pkg_lists: DataFrame,
                pkg_leads: DataFrame, as_of: str, target_campaign: str | None = None, seed: bool = False,
                seed_rows: int = 1000, dest_alt: DataFrame | None = None, pkg_alt: DataFrame | None = None,
                alt_key: Sequence[str] = ("lead_id", "alt_phone_count"), order: str | None = None) -> ImportPlan:
    """Plan importing a package into the destination without writing anything.

    ``order`` names the column of the package tables that holds their file and
    line order (``sources.sql_dump.read_sql_dump(..., order=...)`` adds one): of
    a key repeated in the package its first row is taken.  Without one the
    order in which Spark reads the package is taken.
    """
    line = order or "_line"
    if order is None:
        pkg_lists, pkg_leads = (t.withColumn(line, F.monotonically_increasing_id()) for t in (pkg_lists, pkg_leads))
        pkg_alt = pkg_alt.withColumn(line, F.monotonically_increasing_id()) if pkg_alt is not None else None
    # the high-water mark is captured now, before anything is applied: a
    # rollback run later must not see the imported leads in it
    mark_value = dest_leads.agg(F.coalesce(F.max("lead_id"), F.lit(0))).first()[0]
    mark = F.lit(mark_value).cast("long")
    coll = J.id_collisions(pkg_lists, dest_lists).where("collides").select("list_id")
    base = F.greatest(dest_lists.select(F.max("list_id")).scalar(), pkg_lists.select(F.max("list_id")).scalar())
    id_map = W.assign_new_ids(coll, "list_id", base).select(F.col("list_id").alias("old_id"), "new_id")

    lists_in = J.remap_ids(pkg_lists, id_map, "list_id")
    if target_campaign is not None:
        lists_in = C.override(lists_in, "campaign_id", target_campaign)
    lists_in = C.with_cache_columns(lists_in)
    lists_in = C.reset(lists_in, {"cache_count": 0, "cache_count_new": 0, "cache_count_dialable_new": 0})
    leads_in = C.reset(J.remap_ids(pkg_leads, id_map, "list_id"), {"called_since_last_reset": "N"})

    dest_lists_c = C.with_cache_columns(dest_lists)
    merged_lists = C.insert_ignore(dest_lists_c, lists_in.select(*dest_lists_c.columns, line), "list_id", line)
    merged_leads = C.insert_ignore(dest_leads, leads_in.select(*dest_leads.columns, line), "lead_id", line)
    if pkg_alt is not None:
        before = dest_alt if dest_alt is not None else pkg_alt.drop(line).limit(0)
        merged_alt = C.insert_ignore(before, pkg_alt.select(*before.columns, line), list(alt_key), line)
    else:
        before, merged_alt = dest_alt, dest_alt
    imported_ids = lists_in.select("list_id").distinct()
    rebuilt = C.rebuild_cache(merged_lists, merged_leads, imported_ids, as_of)

    if seed:
        hopper_seed = C.seed_hopper(merged_leads, rebuilt, seed_rows, ids=imported_ids)
        hopper_seed = hopper_seed.select(*[c for c in hopper_seed.columns if c in dest_hopper.columns])
    else:
        hopper_seed = dest_hopper.limit(0)
    hopper_after = dest_hopper.unionByName(hopper_seed, allowMissingColumns=True)
    alt = merged_alt if merged_alt is not None else merged_leads.select("lead_id").limit(0)
    rollback = C.rollback_plan(merged_leads, alt, rebuilt, hopper_after, mark, imported_ids)
    verify = J.verify_import(rebuilt, merged_leads, hopper_after, imported_ids)
    summary = union_all(
        _merge_counts(lists_in, dest_lists, "list_id", "lists"),
        _merge_counts(leads_in, dest_leads, "lead_id", "leads"),
        *([_merge_counts(pkg_alt, before, list(alt_key), "alt_phones")] if pkg_alt is not None else []),
        C.dry_run(hopper_seed.select(F.lit("hopper").alias("table_name"), F.lit("insert").alias("change"))),
    )
    return ImportPlan(id_map, rebuilt, merged_leads, merged_alt, hopper_seed, rollback, verify, summary, mark_value)


def _merge_counts(incoming: DataFrame, dest: DataFrame, pk: str | Sequence[str], table: str) -> DataFrame:
    """INSERT IGNORE outcome counts: one insert per new key; every other
    incoming row (key already present, or a repeat inside the package) is
    ignored.  Keys are counted with partial aggregation."""
    keys = [pk] if isinstance(pk, str) else list(pk)
    per_key = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    flagged = per_key.join(dest.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left")
    t = flagged.agg(F.count_if(F.col("_there").isNull()).alias("ins"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("all"))
    return union_all(
        t.select(F.lit(table).alias("table_name"), F.lit("insert").alias("change"), F.col("ins").alias("row_count")),
        t.select(F.lit(table).alias("table_name"), F.lit("ignored").alias("change"),
                 (F.col("all") - F.col("ins")).cast("long").alias("row_count")),
    )
