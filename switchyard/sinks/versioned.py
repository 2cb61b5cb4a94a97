"""Sets of tables that change together (SURVEY truncate_archive).

Every change writes new folders, ``<root>/<table>/v=<n>``, and then one
manifest, ``<root>/_manifests/<n>``, that names the live folder, the schema and
the row count of every table.  The manifest's success mark is the commit:
before it readers see all tables as they were, after it all as they are, and a
run that dies in between has changed nothing.  The next change takes the same
number again and overwrites what the dead one staged.  One writer at a time.

Row counts are observed by the writes, so emptying tables of any size reads
no row of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import delete_path, list_names, path_exists

# Fixed values that must equal the reference: the tables a cleanup empties.
ARCHIVE_TABLES = (
    "call_log_archive",
    "vicidial_log_archive",
    "vicidial_log_extended_archive",
    "vicidial_dial_log_archive",
    "vicidial_dial_cid_log_archive",
    "vicidial_carrier_log_archive",
    "vicidial_agent_log_archive",
    "vicidial_agent_visibility_log_archive",
    "vicidial_amd_log_archive",
)


def _committed(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and tables of the latest change; (0, {}) before the first."""
    for n in sorted((int(n) for n in list_names(spark, f"{root}/_manifests")), reverse=True):
        if path_exists(spark, f"{root}/_manifests/{n}/_SUCCESS"):
            return n, json.loads(spark.read.text(f"{root}/_manifests/{n}").first()["value"])
    return 0, {}


def _save(spark: SparkSession, root: str, n: int, tables: dict) -> None:
    spark.createDataFrame([(json.dumps(tables),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/_manifests/{n}")


def commit_tables(tables: Mapping[str, DataFrame], root: str) -> dict[str, int]:
    """Replaces the named tables, all or none; others stay.  Returns the rows written of each.

    A frame may read the tables it replaces: their folders stay until ``drop_old``.
    """
    spark = next(iter(tables.values())).sparkSession
    n, live = _committed(spark, root)
    staged = {}
    for name, df in tables.items():
        seen = Observation()
        folder = f"{name}/v={n + 1}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{root}/{folder}")
        staged[name] = {"folder": folder, "rows": seen.get["rows"], "schema": df.schema.jsonValue()}
    _save(spark, root, n + 1, live | staged)
    return {name: t["rows"] for name, t in staged.items()}


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` as the latest change left it."""
    _, live = _committed(spark, root)
    if name not in live:
        raise FileNotFoundError(f"no table {name} at {root}")
    return spark.read.schema(StructType.fromJson(live[name]["schema"])).parquet(f"{root}/{live[name]['folder']}")


def has_table(spark: SparkSession, root: str, name: str) -> bool:
    return name in _committed(spark, root)[1]


def drop_old(spark: SparkSession, root: str) -> int:
    """Deletes the folders that the latest manifest does not name, and older manifests.

    For when no reader of an earlier change is left.  It may be run again
    after a crash: what it deletes is never live.  Returns the folders deleted.
    """
    n, live = _committed(spark, root)
    kept = {t["folder"] for t in live.values()}
    old = [f"{name}/{v}" for name in live for v in list_names(spark, f"{root}/{name}") if f"{name}/{v}" not in kept]
    old += [f"_manifests/{m}" for m in list_names(spark, f"{root}/_manifests") if int(m) != n]
    for folder in old:
        delete_path(spark, f"{root}/{folder}")
    return len(old)


def truncate_tables(spark: SparkSession, root: str, tables: Iterable[str] = ARCHIVE_TABLES) -> DataFrame:
    """Empties all the named tables in one change and frees their space.

    Schemas stay.  A name without a table stops the run before anything is
    changed.  Returns (table_name, rows_before, rows_after).
    """
    tables = list(tables)
    _, live = _committed(spark, root)
    if unknown := [t for t in tables if t not in live]:
        raise FileNotFoundError(f"no table {', '.join(unknown)} at {root}")
    after = commit_tables({t: spark.createDataFrame([], StructType.fromJson(live[t]["schema"])) for t in tables}, root)
    drop_old(spark, root)
    return spark.createDataFrame([(t, live[t]["rows"], after[t]) for t in tables],
                                 "table_name string, rows_before long, rows_after long")
